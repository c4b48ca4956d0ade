"""Plain versions of the operators, for small tables, and awkward rows for all of them."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

WORDS = re.compile("[^\x20\x09-\x0d]+")
ITEM_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def awkward():
    """(doc_id, text, lang, source, n_chars): nulls, empty, no letters, repeats, a repeated key, ties, a very long text."""
    base = "The quick brown fox jumps over the lazy dog while seventeen purple elephants dance under a silver moon in the quiet garden "
    long = " ".join(f"word{i % 977} filler{i % 31}" for i in range(9000))
    rows = [
        (1, base * 3, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, "12345 !!! 678", "en", None), (5, base * 3, "en", "a"),
        (6, base * 3 + "and one more ending", "en", "a"), (7, long, "de", "b"), (8, long + " tail", "de", "b"), (9, "é", "fr", "c"), (9, "é", "fr", "c"),
        (10, "one two three", None, "c"), (11, "ONE TWO THREE", "en", "c"), (12, "   \n\t ", "en", "c"), (13, "mail me: a.b@c.org or +1 (234) 555-6789", "en", "c"),
        (14, "aaaa " * 400, "en", "c"), (15, "\U0001f600 emoji 漢字 text \x1c odd space", "ja", "c"),
    ]
    return [(k, t, lang, s, len(t) if t is not None else None) for k, t, lang, s in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def clashing(df):
    """The same rows with columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["key", "body", "row", "keys", "node", "spans", "base", "items", "set_id", "lang_pred", "score", "kept_0", "variant", "piece", "item", "slot", "shard", "bin"]
    return df.select("*", *[F.lit("x").alias(n) for n in names])


def shingle_set(text, n):
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def near_duplicates(rows, n=5, percent=80):
    """{doc_id: (shingles, component)}"""
    keys = sorted({r[0] for r in rows})
    sets = {k: shingle_set(t, n) for k, t, *_ in rows}
    name = {k: k for k in keys}

    def find(k):
        while name[k] != k:
            k = name[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                name[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}


def item_words(text):
    return ITEM_WORDS.findall((text or "").translate(LOWER))


def contamination(rows, items, window=10):
    """[(doc_id, n_words, hit words, item keys)]"""
    wins = []
    for key, text in items:
        w = item_words(text)
        n = min(window, len(w))
        wins += [(str(key), tuple(w[i:i + n])) for i in range(len(w) - n + 1)] if n else []
    out = []
    for k, t, *_ in rows:
        w, hit, found = item_words(t), set(), set()
        for key, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(key)
        out.append((k, len(w), hit, sorted(found)))
    return out


def repeats(rows, length=100):
    """{doc_id: (bytes, removed, spans, sha256 of the rest)} for distinct keys."""
    seen, out = set(), {}
    for k, t, *_ in sorted({(r[0], r[1] or "") for r in rows}):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def top_k(rows, asked, k=10, scale=1024):
    """{query: [(score, vec_id)]}; rows are (id, list of floats)."""
    whole = {i: np.floor(np.array(v, float) * scale).astype(int) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)}
    return {q: sorted(((int(v @ whole[q]), -i) for i, v in whole.items() if i != q), reverse=True)[:k] for q in whole if asked(q)}


def token_ids(text, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
