import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from memberlens.llm import listrank, order, prefix_trie
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_turns(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}


def plain_rebuilt(rows):
    turns = plain_turns(rows)
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    return {c: turns.get(c - c % 100, [])[:h[c]] + turns[c][h[c]:] for c in turns}


def plain(whole):
    """Rows of every node of {conv: [(role, text)]}."""
    members = collections.defaultdict(list)
    for c, turns in sorted(whole.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, ids in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(ids) - 1) * len(k[-1][1]) if k else 0
    ends = collections.defaultdict(list)
    for c, turns in sorted(whole.items()):
        ends[tuple(turns)].append(str(c))
    return sorted(((ids[0], len(k), members[k[:-1]][0] if k else None, len(ids), children[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(ends[k]).encode()).hexdigest()) for k, ids in members.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(n=260, seed=5):
    r = random.Random(seed)
    rows = [(100 * (c // 37) + c % 37, t, r.choice(["user", "bot", None]), r.choice(["hé", "yes", "no no", "", None])) for c in range(n) for t in range(r.randrange(0, 8))]
    rows += [(9000 + i, 0, "user", "start") for i in range(60)] + [(9000 + i, 1, "bot", f"answer {i % 7}") for i in range(60)]
    rows += [(9100, None, "a", "first"), (9100, None, None, None), (9100, 3, "b", "z"), (9100, 3, "b", "z"), (9100, 3, "a", "z"), (None, 1, "a", "b"), (None, None, None, None)]
    rows += [(9200 + i % 3, t, "user", "x" * (t % 5)) for i in range(3) for t in range(400)] + [(9351, 0, "u", "short")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy,block,finish", [(4096, 65_536, 262_144), (1, 7, 20), (6, 64, 3)])
def test_equals_plain_trie(spark, heavy, block, finish):
    rows = conversations()
    df = brute.clashing(spark.createDataFrame(rows, SCHEMA))
    trie = prefix_trie.prefix_trie(*prefix_trie.rebuilt(df), heavy=heavy, block=block, finish=finish)
    assert got(prefix_trie.digest(trie)) == plain(plain_rebuilt(rows))


def test_whole_conversations_without_rebuilding(spark):
    rows = conversations(40)
    turns = prefix_trie.turns_of(spark.createDataFrame(rows, SCHEMA))
    assert got(prefix_trie.digest(prefix_trie.prefix_trie(turns, turns.select("conv")))) == plain(plain_turns(rows))


def test_ends_of_one_node_in_pieces(spark):
    ids = random.Random(1).sample(range(10_000), 700)
    ends = spark.createDataFrame([(4, i) for i in ids] + [(5, 1)], "node long, conv long").repartition(5)
    want = {4: ",".join(map(str, sorted(ids))), 5: "1"}
    found = {r["node"]: r["ends_sha256"] for r in prefix_trie.ends_digest(ends, piece=9).collect()}
    assert found == {n: hashlib.sha256(x.encode()).hexdigest() for n, x in want.items()}


def test_turnless_only_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.digest(prefix_trie.prefix_trie(*prefix_trie.rebuilt(empty))).count() == 0
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 0, "a", "b")]
    found = got(prefix_trie.digest(prefix_trie.prefix_trie(*prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)))))
    assert found == plain(plain_rebuilt(rows)) and len(found) == 1


@pytest.mark.parametrize("n,block,finish", [(1, 4, 9), (500, 7, 11), (3000, 64, 40), (400, 1000, 1)])
def test_list_places(spark, n, block, finish):
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    links = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:] + [-1])], "id long, next long")
    assert {r["id"]: r["place"] for r in listrank.ranked(links, block, finish).collect()} == {x: i for i, x in enumerate(ids)}


def test_paths_inside_a_block():
    ids, head, offset, out, total = listrank.walk(np.array([5, 3, 9, 4]), np.array([9, 4, 70, 1]), np.array([1, 2, 3, 4]))
    assert dict(zip(ids, head)) == {5: 5, 9: 5, 3: 3, 4: 3} and dict(zip(ids, offset)) == {5: 0, 9: 1, 3: 0, 4: 2}
    assert (dict(zip(ids, out))[5], dict(zip(ids, total))[5], dict(zip(ids, out))[3], dict(zip(ids, total))[3]) == (70, 4, 1, 6)


def test_running_totals_over_blocks_of_blocks(spark):
    values = [(i, i % 7) for i in range(300)]
    found = order.prefix_sums(spark.createDataFrame(values, "n long, v long"), "n", ["v"], block=4)
    assert {r["n"]: r["sum_v"] for r in found.collect()} == {i: sum(v for _, v in values[:i + 1]) for i in range(300)}


def test_numbers_in_an_order(spark):
    rows = [(i % 5, i) for i in range(200)]
    found = order.numbered(spark.createDataFrame(rows, "a long, b long").repartition(6), ["a", "b"], "t").collect()
    assert {(r["a"], r["b"]): r["number"] for r in found} == {x: i for i, x in enumerate(sorted(rows))}
