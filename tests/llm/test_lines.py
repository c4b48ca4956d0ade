import collections
import hashlib

import pytest

from memberlens.llm import lines
from tests.llm import brute

BLANK = " \t\n\x0b\x0c\r"


def plain(rows, min_docs, min_chars=1):
    """[(doc_id, kept text, lines, dropped)]"""
    def key(line):
        return line.strip(BLANK).translate(brute.LOWER)

    owners = collections.defaultdict(set)
    for k, t, *_ in rows:
        for line in (t or "").split("\n"):
            owners[key(line)].add(k)
    gone = {x for x, ids in owners.items() if len(x) >= min_chars and len(ids) >= min_docs}
    out = []
    for k, t, *_ in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if key(x) not in gone]
        out.append((k, "\n".join(stay), len(all_lines), len(all_lines) - len(stay)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["key"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=repr)


def texts():
    shared = ["Cookie notice", "  cookie NOTICE\r", "\tÉté commun", "a"]
    rows = [(i, "\n".join([f"own line {i}", shared[i % 2], "", shared[2] if i % 3 else "été commun", shared[3] * (1 + i % 2), f"own line {i}"]), "en", "s", 1) for i in range(40)]
    long = "\n".join(["x%d" % (i % 3000) if i % 4 else "Cookie notice" for i in range(20_000)])
    return rows + [(100, None, None, None, None), (101, "", "en", None, 0), (102, long, None, "s", 3), (103, "cookie notice", "en", "s", 1), (103, "cookie notice", "en", "s", 1),
                   (None, "Cookie notice\nonly here", None, None, None), (None, "only here", None, None, None), (104, "\n\n", "x", "y", 2), (105, "own line 3\nother", "x", "y", 2)]


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 1), (10, 14), (1, 0)])
def test_equals_plain_counting(spark, min_docs, min_chars):
    rows = texts() + brute.awkward()
    df = brute.clashing(brute.frame(spark, rows))
    assert got(lines.without_frequent_lines(df, min_docs=min_docs, min_chars=min_chars)) == plain(rows, min_docs, min_chars)


def test_one_document_of_many_rows_counts_once(spark):
    rows = [(7, f"same line\nrow {i}", None, None, None) for i in range(30)]
    assert {r[3] for r in got(lines.without_frequent_lines(brute.frame(spark, rows)))} == {0}
    rows += [(i, "same line", None, None, None) for i in range(20, 29)]
    assert {r[3] for r in got(lines.without_frequent_lines(brute.frame(spark, rows)))} == {1}


def test_heavy_and_light_keys_give_the_same(spark, monkeypatch):
    rows = texts()
    for most in (1, 3, 1000):
        monkeypatch.setattr(lines, "semi_join", lambda *a, m=most: __import__("memberlens.llm.skew", fromlist=["x"]).semi_join(*a, most=m))
        assert got(lines.without_frequent_lines(brute.frame(spark, rows))) == plain(rows, 10)


def test_columns_are_handed_through(spark):
    df = brute.clashing(brute.frame(spark, texts()))
    out = lines.without_frequent_lines(df, keep=df.columns)
    assert out.columns == ["key", "kept_text", "n_lines", "n_dropped", *df.columns]
    plain_rows = sorted(repr(tuple(r)) for r in df.collect())
    assert sorted(repr(tuple(r)[4:]) for r in out.collect()) == plain_rows


def test_empty_table_and_digest(spark):
    empty = lines.digest(lines.without_frequent_lines(brute.frame(spark, [])))
    assert empty.count() == 0 and dict(empty.dtypes) == {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"}
    one = lines.digest(lines.without_frequent_lines(brute.frame(spark, [(1, None, None, None, None)]))).first()
    assert tuple(one) == (1, 1, 0, hashlib.sha256(b"").hexdigest())
