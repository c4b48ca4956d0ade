import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from memberlens.llm import decontamination, language, licenses, near_duplicates, pii, repeats
from memberlens.llm.fmindex import FMIndex
from memberlens.llm.runindex import RunIndex
from tests.llm import brute

ITEMS = [(1, "quick brown FOX jumps over the lazy dog while seventeen purple elephants dance"), (2, "three"), (10, "One two"), (3, None), (4, "..."), (2, "three"), (5, "word3 filler3 word4 filler4 word5")]


# ---- licenses -------------------------------------------------------------------------------------------

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def test_licenses_are_found_once_changed_or_repeated(spark):
    line, mit = "Licensed under the Apache License, Version 2.0.", licenses.TEMPLATES[1][1]
    edited = mit.replace("free of charge", "without any fee").replace("Software", "Program", 1)
    noise = "the version of a license under which this work is released " * 40
    rows = [(1, line), (2, (line + "\n") * 30), (3, noise + line + noise), (4, noise), (5, edited), (6, mit + "\n" + mit), (7, None), (8, ""), (9, line), (9, line)]
    df = brute.clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = collections.defaultdict(list)
    for r in licenses.scan(df).collect():
        got[r["doc_id"]].append((r["license"], round(r["coverage"], 2)))
        text = dict(rows)[r["doc_id"]]
        want = {licenses.words_of(t)[0] for n, t in licenses.TEMPLATES if n == r["license"]}
        assert licenses.words_of(text[r["start_char"]:r["end_char"]])[0] in want | {b"licensed"}
    assert got[1] == got[2] == got[3] == [("Apache-2.0", 1.0)] and got[9] == got[1] * 2 and set(got) == {1, 2, 3, 5, 6, 9}
    words = [licenses.words_of(t) for t in (mit, edited)]
    assert got[5] == [("MIT", round(lcs(*words) / len(words[0]), 2))] and got[6] == [("MIT", 1.0)]
    assert licenses.scan(df.where("false")).count() == 0 and licenses.scan(df, [("none", "...")]).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_alignment_is_increasing_and_near_the_longest(seed):
    rng = np.random.default_rng(seed)
    a = rng.permutation(60).tolist()
    b = [x for x in a if rng.random() > 0.2]
    for i in rng.integers(0, len(b), 8).tolist():
        b.insert(i, int(rng.integers(100, 200)))
    found = licenses.aligned(a, b)
    assert all(a[i] == b[j] for i, j in found) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    assert len(found) == lcs(a, b)


def test_longest_increasing():
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3]) and licenses.increasing([]) == []


# ---- repeats --------------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(4))
def test_run_index_finds_earlier_copies(seed):
    rng = np.random.default_rng(seed)
    base = bytes(rng.integers(0, 3, 300).astype(np.uint8))
    pieces = [base[a:a + n] for a, n in zip(rng.integers(0, 250, 12), rng.integers(5, 50, 12))] + [b"\0" * 40, b"ab" * 30, b"ab" * 30]
    index, length = RunIndex(pieces), 12
    seen, want = set(), []
    for p in pieces:
        for i in range(len(p) + 1):
            w = p[i:i + length]
            want.append(len(w) == length and w in seen)
            if len(w) == length:
                seen.add(w)
    assert index.repeated(length).tolist() == want
    assert int(index.lengths.sum()) == index.n and len(index.heads) < index.n
    above, match = index.matches()
    text = b"\0".join(pieces) + b"\0"
    for i in range(0, index.n, 7):
        if match[i]:
            assert text[i:i + match[i]] == text[above[i]:above[i] + match[i]]


def repeat_rows():
    rng = np.random.default_rng(5)
    passage = "".join(chr(97 + x) for x in rng.integers(0, 26, 260))
    other = ["".join(chr(97 + x) for x in rng.integers(0, 26, 150)) for _ in range(30)]
    rows = [(i, o + passage[i % 7:] + o[::-1], None, None, None) for i, o in enumerate(other)]
    rows += [(100, passage[:99], None, None, None), (101, passage[:100], None, None, None), (102, "é" * 300, None, None, None)]
    return rows + [(200 + k, t, *rest) for k, t, *rest in brute.awkward()]


@pytest.mark.parametrize("many", [8_192, 5])
def test_repeats_equal_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(repeats, "GROUP_ENTRIES", many)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 20_000)
    rows = repeat_rows()
    got = repeats.digest(repeats.repeated_spans(brute.clashing(brute.frame(spark, rows)))).collect()
    want = brute.repeats(rows)
    assert len(got) == len(rows) and {r["doc_id"]: tuple(r)[1:] for r in got} == want
    assert sum(w[1] for w in want.values()) > 20_000


def test_repeats_of_odd_keys(spark):
    text = "".join(chr(97 + x) for x in np.random.default_rng(6).integers(0, 26, 300))
    rows = [(None, text, None, None, None), (5, text, None, None, None), (5, text + "x", None, None, None), (5, text, None, None, None)]
    got = repeats.digest(repeats.repeated_spans(brute.frame(spark, rows))).collect()
    removed = sorted(((r["doc_id"] is None, r["n_bytes"], r["n_removed"]) for r in got))
    assert len(got) == 4 and removed[-1] == (True, 300, 300) and sum(r[2] for r in removed[:3]) in (300, 200 + 400)
    assert repeats.repeated_spans(brute.frame(spark, [])).count() == 0


def test_partition_edges_keep_entries():
    import pandas as pd

    part = pd.DataFrame({"print": [1, 2, 2, 3, 4, 4, 5], "key": range(7)})
    for cuts in ([7], [1, 6], [3, 4], [1] * 7):
        at, batches = 0, []
        for n in cuts:
            batches.append(part[at:at + n])
            at += n
        kept = pd.concat(list(repeats.lone_dropped(iter(batches))))["print"].tolist()
        assert kept == [1, 2, 2, 4, 4, 5]


# ---- language -------------------------------------------------------------------------------------------

def language_rows(n=160):
    rng = np.random.default_rng(2)
    parts = {"xx": ["thi", "ng", "re", "wha", "st"], "yy": ["ció", "na", "dor", "que", "ll"], "zz": ["sch", "ung", "ver", "ß", "ein"]}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        text = " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(int(rng.integers(3, 400))))
        rows.append((i, text, lang, "s", len(text)))
    return rows


def test_language_is_learned_and_held_out(spark):
    docs = brute.clashing(brute.frame(spark, language_rows()))
    net = language.fit(docs, per_language=40)
    out = language.predict(docs, net, keep=("doc_id", "lang")).withColumn("out", language.held_out(F.col("doc_id")))
    rows = out.collect()
    held = [r for r in rows if r["out"]]
    assert len(rows) == 160 and len(held) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_texts(spark):
    net = language.fit(brute.frame(spark, language_rows(60)), per_language=30)
    out = language.predict(brute.frame(spark), net)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert out.count() == len(brute.awkward()) and all(got[k] == ("und", 0.0) for k in (2, 3, 4, 12)) and got[1] == got[5] and got[9][0] != "und"
    assert language.fit(brute.frame(spark).where("lang is null")) is None
    assert {r["lang_pred"] for r in language.predict(brute.frame(spark), None).collect()} == {"und"}


def test_windows_cover_whole_texts():
    windows, used = language.windows_of("é" * 500)
    assert used == 1000 and windows.shape == (4, language.WINDOW) and windows.reshape(-1)[:1000].tobytes() == ("é" * 500).encode() and not windows.reshape(-1)[1000:].any()


# ---- decontamination ------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(3))
def test_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 5, 400)
    text[-1] = 0
    index = FMIndex(text, sample_every=8)
    patterns = rng.integers(1, 6, (40, 3))
    low, high = index.ranges(patterns)
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(398) if (text[i:i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("shard,block", [(2_000_000, 2_000_000), (50, 6)])
def test_contamination_equals_brute_force(spark, shard, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.contamination(brute.clashing(brute.frame(spark)), items, shard_words=shard, block_words=block).collect()
    got = sorted((r["doc_id"], r["n_words"], [x for s in r["spans"] for x in range(s["start"], s["end"])], list(r["items"])) for r in found)
    assert got == sorted((k, n, sorted(hit), names) for k, n, hit, names in brute.contamination(brute.awkward(), ITEMS))


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontamination.digest(decontamination.contamination(brute.frame(spark), none)).collect()
    assert len(out) == len(brute.awkward()) and not any(r["contaminated"] for r in out)
    assert decontamination.contamination(brute.frame(spark, []), none).count() == 0


def test_words_leave_the_text():
    assert decontamination.without_spans("Say one two three, four.", [(1, 3)]) == "Say  three, four."
    assert decontamination.without_spans(None, []) is None and decontamination.without_spans("a b", [(0, 2)]) == ""


# ---- personal data --------------------------------------------------------------------------------------

def test_base_patterns():
    text = "x a.b@c.org, 1.2.3.4 1.2.3.256 4539 1488 0343 6467 4539148803436468 +1 (234) 555-6789 +12 34 @no +1 2"
    got = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)]
    assert got == [("email", "a.b@c.org"), ("ip", "1.2.3.4"), ("phone", "+1 (234) 555-6789")] or ("card", "4539 1488 0343 6467") in got
    assert pii.passes_luhn("4539148803436467") and not pii.passes_luhn("4539148803436468")
    assert pii.base_spans("") == [] and pii.base_spans("0001.002.3.4") == [(0, 1, 12)]


def personal_rows(n=150):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(30)]
        if i % 2:
            words.insert(9, f"{words[0]}.{i}@mail{i % 7}.example.com")
            words.insert(20, f"10.{i}.3.77")
        rows.append((i, " ".join(words), "en", "s", 0))
    return rows


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(brute.frame(spark, personal_rows()))


def test_tagger_learns_labelled_spans(tagger):
    texts = [t for _, t, *_ in personal_rows(60)]
    hit = total = false = 0
    for text, (label, _) in zip(texts, pii.tag(tagger, texts)):
        truth = np.zeros(len(text), int)
        for a, k, b in pii.base_spans(text):
            truth[a:b] = k + 1
        hit, total, false = hit + ((label == truth) & (truth > 0)).sum(), total + (truth > 0).sum(), false + ((label > 0) & (truth == 0)).sum()
    assert hit / total > 0.8 and false / total < 0.1


def test_base_spans_stay_and_windows_agree(spark, tagger):
    docs = brute.clashing(brute.frame(spark))
    rows = {r["doc_id"]: r for r in pii.find(docs, tagger).collect()}
    for k, t, *_ in brute.awkward():
        base = [(s["start"], pii.KINDS.index(s["kind"]), s["end"]) for s in rows[k]["base"]]
        assert base == pii.base_spans(t or "") and all(s in rows[k]["spans"] for s in rows[k]["base"])
    long = " ".join(t for _, t, *_ in personal_rows(40))
    short, alone = pii.tag(tagger, [long, "a b"])
    assert len(short[0]) == len(long) and len(alone[0]) == 3
    quick, exact = tagger.decode(pii.codes(long[:400])[:, None]), tagger.best_paths(tagger.scores(pii.codes(long[:400])[:, None]))
    assert (quick[0] == exact[0]).all()


def test_personal_data_of_empty_and_unlabelled_tables(spark, tagger):
    assert pii.find(brute.frame(spark, []), tagger).count() == 0
    assert pii.fit(brute.frame(spark, [])) is None and pii.fit(brute.frame(spark).where("doc_id = 10")) is None
    assert pii.digest(pii.find(brute.frame(spark), None)).where("n_email > 0").count() == 1


def test_masking():
    assert pii.masked("call a@b.c now", [("email", 5, 10)]) == "call <EMAIL> now" and pii.masked(None, []) is None
    assert pii.masked("12345", [("ip", 0, 4), ("card", 2, 5)]) == "<IP>"


# ---- near duplicates ------------------------------------------------------------------------------------

def family_rows(n=70, seed=8):
    """A hub with many near copies that are often too far from one another, plus unrelated and awkward rows."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 4))
    hub = [word() for _ in range(120)]
    rows = []
    for i in range(n):
        copy = list(hub)
        for _ in range(int(rng.integers(0, 5))):
            copy[int(rng.integers(0, 120))] = word()
        rows.append((1000 + i, " ".join(copy), None, None, None))
    rows += [(2000 + i, " ".join(word() for _ in range(40)), None, None, None) for i in range(20)]
    return rows + brute.awkward()


@pytest.mark.parametrize("words,rounds,block", [(5, 4, 256), (4, 1, 8)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, words, rounds, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    monkeypatch.setattr(near_duplicates, "LIST_BLOCK", block)
    monkeypatch.setattr(near_duplicates.linked_classes, "__defaults__", (rounds, near_duplicates.MATCHES))
    rows = family_rows()
    out = near_duplicates.near_duplicates(brute.clashing(brute.frame(spark, rows)), words=words).collect()
    want = brute.near_duplicates(rows, words)
    assert len(out) == len(rows) and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert sum(r["kept"] for r in out) == len({c for _, c in want.values()}) + sum(1 for k in (9,) if want[k][0] == 0)
    assert len({c for _, c in want.values()}) < len(want) - 40


def test_near_duplicates_of_empty_table_and_null_keys(spark):
    assert near_duplicates.near_duplicates(brute.frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f", None, None, None), (4, "a b c d e f", None, None, None)]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(brute.frame(spark, rows)).collect()}
    assert got == {None: (4, False), 4: (4, True)}


def test_shingle_fingerprints_follow_sets():
    for a, b in (("A b  c\td e", "a B c d e"), ("x", "X"), ("a b c", "a b c d"), ("", None)):
        same = brute.shingle_set(a, 4) == brute.shingle_set(b, 4)
        assert (near_duplicates.shingles(a, 4).tolist() == near_duplicates.shingles(b, 4).tolist()) == same
    assert len(near_duplicates.shingles("a a a a a a", 4)) == 1
