"""Benchmark decontamination by an FM-index per training shard.

Words are what ``WORD`` finds in a text with A-Z in lower case. A benchmark item gives every run of ``WINDOW`` consecutive
words as a window; an item of fewer words, but not none, is one window. Documents stream through each task in shards of
bounded size. A shard keeps only words that benchmark items use (no window holds another), in runs no shorter than the
shortest window; it indexes them, searches every window backwards, locates the occurrences and merges them to spans.

Benchmark items are read in blocks of at most ``BLOCK_WORDS`` words (a longer item is a block of its own), one block at a time,
and each is broadcast to a pass over the documents. A benchmark of one block is searched in one pass. With more, every pass
stores what it found by a digest of the text and its block is given up before the next one is read, so neither driver nor
executors hold more than a block; the findings of all passes then meet the documents again.

Defined results: null texts and texts without words have no words, no spans and no items; a null item text or one without
words has no window; items with a null key hit
words like any others and stand together as one null, the last of the items (as in SQL, ``digest`` counts it and leaves it
out of the joined names); repeated items each count; repeated documents each give a row; an empty benchmark leaves all
documents clean. Only the key and text columns are read; other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import by_small_batches, carried, column, in_text_batches, restored
from memberlens.llm.fmindex import FMIndex
from memberlens.sources.tables import stored

WINDOW = 10

#: Words per index; a longer document is an index of its own.
SHARD_WORDS = 2_000_000

#: Words of benchmark items in one broadcast block.
BLOCK_WORDS = 2_000_000

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})
#: The same by bytes of UTF-8: digits, small letters and everything above ASCII stay, A-Z become small, the rest is space.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPANS = "array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BYTES).split()


def item_blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items as (key, words), in blocks of bounded size, streamed through the driver one block at a time."""
    block, size = [], 0
    for row in items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["k"], words))
        size += len(words)
    if block:
        yield block


class Windows:
    """The windows of a block of items, as numbers over the words that the items use."""

    def __init__(self, block: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, words in block for w in words}))}
        self.items = [k for k, _ in block]
        found: dict[tuple[int, ...], set[int]] = {}
        for i, (_, words) in enumerate(block):
            ids = [self.vocabulary[w] for w in words]
            n = min(window, len(ids))
            for a in range(len(ids) - n + 1):
                found.setdefault(tuple(ids[a:a + n]), set()).add(i)
        self.lengths = sorted({len(w) for w in found})
        self.patterns = {n: np.array([w for w in found if len(w) == n], np.int64) for n in self.lengths}
        self.owners = {n: [np.array(sorted(found[w])) for w in found if len(w) == n] for n in self.lengths}


def runs_kept(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Reduced sequence and the place of each of its symbols: runs of known words of at least ``shortest``, each followed
    by a zero."""
    known = np.concatenate(([False], ids > 0, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts + 1  # with the zero
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)
    text = ids[np.minimum(place, len(ids) - 1)].astype(np.int64)
    text[first + sizes - 1] = 0
    return text, place


def search_shard(docs: list[list[bytes]], windows: Windows) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each document its merged spans (start, end in words, end exclusive) and the positions of its items."""
    get = windows.vocabulary.get
    sizes = np.array([len(d) + 1 for d in docs])  # a gap after each document
    base = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), np.int32)
    for d, b in zip(docs, base.tolist()):
        ids[b:b + len(d)] = np.fromiter(map(get, d, repeat(0)), np.int32, len(d))
    none = [np.zeros((0, 2), np.int64)] * len(docs), [np.zeros(0, np.int64)] * len(docs)
    text, place = runs_kept(ids, windows.lengths[0]) if windows.lengths else (np.zeros(0), None)
    if not len(text):
        return none
    index = FMIndex(text)
    cover = np.zeros(len(ids) + 1, np.int64)
    pairs = []
    for n in windows.lengths:
        low, high = index.ranges(windows.patterns[n])
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        counts = (high - low)[hit]
        rows = np.repeat(low[hit] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        at = place[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        doc = np.searchsorted(base, at, "right") - 1
        seen = np.unique(doc * len(windows.owners[n]) + np.repeat(hit, counts))
        for code in seen.tolist():
            d, w = divmod(code, len(windows.owners[n]))
            pairs.append((d, windows.owners[n][w]))
    covered = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
    edges = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2)
    owner = np.searchsorted(base, edges[:, 0], "right") - 1
    spans, items = list(none[0]), list(none[1])
    for d in np.unique(owner).tolist():
        spans[d] = edges[owner == d] - base[d]
    by_doc: dict[int, list[np.ndarray]] = {}
    for d, owned in pairs:
        by_doc.setdefault(d, []).append(owned)
    for d, owned in by_doc.items():
        items[d] = np.unique(np.concatenate(owned))
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans; touching ones join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def in_order(names: set[str | None]) -> list[str | None]:
    """Sorted, null last."""
    return sorted(names, key=lambda k: (k is None, k or ""))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, shard_words: int = SHARD_WORDS,
                  block_words: int = BLOCK_WORDS, change: Callable[[str, list[tuple[int, int]]], str] | None = None) -> DataFrame:
    """key, n_words, spans (in words, end exclusive), items (keys as text, sorted, null last) of every document.

    ``keep`` names further columns to hand through. With ``change``, a text that has spans is handed through as
    ``change(text, spans)``, from the Python step that settles them.
    """
    spark, docs = docs.sparkSession, in_text_batches(docs)
    keep = tuple(c for c in keep if c != key)
    none = F.slice(F.array(F.lit(None).cast("string")), 1, 0)  # an array that may hold nulls
    out = docs.select(column(key).alias("key"), column(text).alias("body"), F.lit(0).cast("long").alias("n_words"),
                      F.array().cast(SPANS).alias("spans"), none.alias("items"), *carried(keep, text))
    blocks = item_blocks(items, item_key, item_text, block_words)
    block, after = next(blocks, []), next(blocks, None)
    if after is None:
        sent = spark.sparkContext.broadcast(Windows(block, window))
        out = out.mapInPandas(shard_search(sent, shard_words, change), out.schema)
    else:
        found = None
        while block is not None:
            part = block_findings(docs, text, Windows(block, window), shard_words)
            found = part if found is None else found.unionByName(part)
            block, after = after, next(blocks, None)
        out = with_findings(out, found, change)
    return out.select(F.col("key").alias(key), "n_words", "spans", "items", *restored(keep, text))


def block_findings(docs: DataFrame, text: str, windows: Windows, shard_words: int) -> DataFrame:
    """Stored (digest, found_spans, found_items) of the texts that a block hits, one row each."""
    sent = docs.sparkSession.sparkContext.broadcast(windows)
    rows = docs.select(column(text).alias("body")).where("body is not null")
    search = shard_search(sent, shard_words)

    def run(batches):
        for frame in search(f.assign(spans=[[]] * len(f), items=[[]] * len(f)) for f in batches):
            hit = frame[np.array([len(s) > 0 for s in frame["spans"]], bool)]
            if not len(hit):
                continue
            yield pd.DataFrame({"digest": [hashlib.sha256(t.encode()).digest() for t in hit["body"]], "found_spans": list(hit["spans"]), "found_items": list(hit["items"])})

    part = stored(rows.mapInPandas(run, f"digest binary, found_spans {SPANS}, found_items array<string>").dropDuplicates(["digest"]), "block-findings")
    sent.destroy()
    return part


def with_findings(out: DataFrame, found: DataFrame, change=None) -> DataFrame:
    """Spans and items of all blocks at every document with their text."""
    found = found.groupBy("digest").agg(F.flatten(F.collect_list("found_spans")).alias("found_spans"), F.flatten(F.collect_list("found_items")).alias("found_items"))
    digest = F.unhex(F.sha2(F.col("body").cast("binary"), 256))
    met = out.join(found, digest == F.col("digest"), "left").select(*[c for c in out.columns if c not in ("spans", "items")], F.coalesce("found_spans", "spans").alias("spans"), F.coalesce("found_items", "items").alias("items"))

    def run(batches):
        for frame in batches:
            frame["n_words"] = [len(words_of(t)) for t in frame["body"]]
            frame["spans"] = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in spans])] for spans in frame["spans"]]
            frame["items"] = [in_order(set(names)) for names in frame["items"]]
            yield changed(frame, change)

    return met.mapInPandas(run, met.schema)


def changed(frame: pd.DataFrame, change) -> pd.DataFrame:
    """The batch with ``change`` made to the texts that have spans."""
    if change is not None:
        spans = [[(x["start"], x["end"]) for x in row] for row in frame["spans"]]
        frame["body"] = pd.Series([change(t, s) if s else t for t, s in zip(frame["body"], spans)], index=frame.index, dtype=object)
    return frame


def shard_search(sent, shard_words: int, change=None):
    @by_small_batches("body")
    def run(batches):
        for frame in batches:
            words = [words_of(t) for t in frame["body"]]
            frame["n_words"] = [len(w) for w in words]
            spans: list = []
            items: list = []
            start = size = 0
            for i in range(len(words) + 1):
                if i == len(words) or (size and size + len(words[i]) > shard_words):
                    found, owned = search_shard(words[start:i], sent.value)
                    spans += found
                    items += owned
                    start, size = i, 0
                if i < len(words):
                    size += len(words[i])
            names = sent.value.items
            frame["spans"] = [
                [{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in old] + new.tolist())]
                for old, new in zip(frame["spans"], spans)
            ]
            frame["items"] = [in_order({*old, *(names[k] for k in new)}) for old, new in zip(frame["items"], items)]
            yield changed(frame, change)

    return run


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end:at[a][0]])
        end = at[b - 1][1]
    return "".join(out) + text[end:]


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of a report: numbers of words, hit words and items, and a checksum of the items."""
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col(key), "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))
