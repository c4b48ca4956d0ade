"""Removal of long repeated byte strings with run-length indexes.

A byte goes if some ``length`` bytes of the input that cover it also start earlier: in a document with a smaller key, or
earlier in the same one. All texts are read whole, as UTF-8.

* Texts that an earlier row holds whole go at once.
* Of the others, every window of ``length`` bytes names one of its grams by the smallest fingerprint (the leftmost of equals), so equal
  windows name equal grams. Neighbouring windows that name the same gram form one entry; a text has about one entry in 35
  bytes. Entries are dealt by ranges of fingerprints and sorted; a fingerprint that stands alone is dropped. A fingerprint
  that very many entries share may lie over several ranges; the outermost ones of a range are kept in case.
* What is left meets its texts again and takes its bytes along. Entries of equal fingerprints go to one group of bounded size. A
  group joins its distinct pieces to a text, in order of position, builds the run-compressed transform with samples at the
  run ends, streams the matches over it and marks windows with an earlier equal.
* Of a fingerprint with more than ``GROUP_ENTRIES`` entries only the first of equal pieces goes on, found by aggregation. If
  distinct ones are still too many for a group, their windows are dealt by all their bytes instead.

Defined results: a null text counts as empty; texts shorter than ``length`` stay whole; a null key comes last; rows that
repeat key and text count once and get the same result each; rows that repeat a key with different texts are ordered by a
hash of the text; an empty table gives no rows. Only key and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import carried, column, restored
from memberlens.llm.runindex import RunIndex
from memberlens.session import shared_dir
from memberlens.sources.tables import stored

LENGTH = 100
GRAM = 32  # a power of two

#: Bytes of pieces in an index, and entries of one fingerprint that may share it.
GROUP_BYTES = 2_000_000
GROUP_ENTRIES = 8_192

#: Keys that may be broadcast (12 bytes each).
SENT_KEYS = 500_000

#: Bytes fingerprinted at once.
CHUNK = 1 << 17

ENTRY = "print long, key long, variant long, start int, windows int"
PRIME = 0x9E3779B97F4A7C15
MIX = 0xC2B2AE3D27D4EB4F
WORD = (1 << 64) - 1


def gram_prints(raw: np.ndarray) -> np.ndarray:
    """Fingerprint of the ``GRAM`` bytes from each position; doubling combines two halves."""
    out = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
    size, power = 1, PRIME
    while size < GRAM:
        out = out[:-size] * np.uint64(power) + out[size:]
        size, power = 2 * size, power * power & WORD
    out ^= out >> np.uint64(32)
    out *= np.uint64(MIX)
    out ^= out >> np.uint64(29)
    return out


def named_grams(prints: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` neighbouring grams the place of its smallest one, the leftmost of equals."""
    least, where, size = prints, np.arange(len(prints), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        take = least[step:] < least[:-step]
        where = np.where(take, where[step:], where[:-step])
        least = np.where(take, least[step:], least[:-step])
        size += step
    return where


def entries(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, fingerprint, first window, windows) of all texts."""
    out: list[tuple[np.ndarray, ...]] = []
    i = 0
    while i < len(texts):
        a, size = i, 0
        while i < len(texts) and (i == a or size + len(texts[i]) <= CHUNK):
            size += len(texts[i])
            i += 1
        if size < length:
            continue
        raw = np.frombuffer(b"".join(texts[a:i]), np.uint8)
        prints = gram_prints(raw)
        where = named_grams(prints, length - GRAM + 1)  # a window each
        sizes = np.array([len(t) for t in texts[a:i]])
        base = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(i - a), sizes)[:len(where)]
        inside = np.arange(len(where)) + length <= (base + sizes)[owner]
        place = np.flatnonzero(inside)
        if not len(place):
            continue
        gram, text = where[place], owner[place]
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])))
        first = np.flatnonzero(new)
        out.append((text[first] + a, prints[gram[first]].view(np.int64), place[first] - base[text[first]], np.diff(np.append(first, len(place)))))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out))


def keyed(docs: DataFrame, key: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """(key, variant, body, kept columns): variant is the hash of the text under a repeated key with different texts and 0
    elsewhere. Texts are dealt by key and hash, so a key of very many rows is spread over tasks."""
    rows = docs.select(column(key).cast("long").alias("key"), column(text).alias("body"), *carried(keep, text))
    hashed = stored(rows.select("key", F.xxhash64("body").alias("hash")).distinct(), "hashes")
    several = hashed.groupBy(F.col("key").alias("of")).agg((F.min("hash") != F.max("hash")).alias("differ")).where("differ")
    if several.isEmpty():
        return rows.withColumn("variant", F.lit(0).cast("long"))
    met = hashed.join(several, F.col("key").eqNullSafe(F.col("of")), "left_semi").select(F.col("key").alias("of"), F.col("hash").alias("variant"))
    same = F.col("key").eqNullSafe(F.col("of")) & (F.xxhash64("body") == F.col("variant"))
    return rows.join(met, same, "left").drop("of").withColumn("variant", F.coalesce("variant", F.lit(0).cast("long")))


def later_copies(rows: DataFrame, length: int) -> DataFrame:
    """Stored (key, variant, start, end) of texts that an earlier row holds whole: every byte of theirs goes."""
    place = F.struct(F.col("key").isNull().alias("none"), F.coalesce("key", F.lit(0)).alias("key"), "variant")
    texts = rows.where(F.octet_length("body") >= length).select("key", "variant", F.md5("body").alias("digest"), F.octet_length("body").alias("n"))
    first = texts.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = texts.join(first, "digest").where(place != F.col("first"))
    return stored(later.select("key", "variant", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end")).distinct(), "copies")


def without(rows: DataFrame, later: DataFrame) -> DataFrame:
    """Rows that are not among ``later``; a short list is sent to the rows, a long one is shuffled."""
    gone = later.select(F.col("key").alias("of"), F.col("variant").alias("of_variant"))
    known = gone.limit(SENT_KEYS + 1).count()
    same = F.col("key").eqNullSafe(F.col("of")) & (F.col("variant") == F.col("of_variant"))
    return rows.join(F.broadcast(gone) if known <= SENT_KEYS else gone, same, "left_anti")


def lone_dropped(batches):
    """Of entries sorted by fingerprint those that share theirs; the outermost ones of a partition may share it with
    another partition and are kept."""
    held = None
    first = True
    for frame in batches:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        prints = frame["print"].to_numpy()
        same = prints[1:] == prints[:-1]
        keep = np.concatenate(([first or before], same)) | np.concatenate((same, [False]))
        # the last row waits for the next batch
        held, before = frame.iloc[-1:], bool(same[-1]) if len(same) else (first or before)
        yield frame[:-1][keep[:-1]]
        first = False
    if held is not None:
        yield held


def shared_entries(docs: DataFrame, length: int) -> DataFrame:
    """Stored entries whose fingerprint is shared, with ``many`` where too many share it."""

    def run(batches):
        for frame in batches:
            text, prints, start, windows = entries([(t or "").encode() for t in frame["body"]], length)
            yield pd.DataFrame({"print": prints, "key": frame["key"].take(text).to_numpy(), "variant": frame["variant"].take(text).to_numpy(), "start": start, "windows": windows}).astype({"variant": "int64", "start": "int32", "windows": "int32", "key": "Int64"})

    found = compact(docs.select("key", "variant", "body").mapInPandas(run, ENTRY), "entries")
    dealt = found.repartitionByRange("print", "key").sortWithinPartitions("print")
    shared = compact(dealt.mapInPandas(lone_dropped, ENTRY), "shared")
    many = shared.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_ENTRIES).select("print", F.lit(True).alias("many"))
    if many.isEmpty():
        return shared.withColumn("many", F.lit(False))
    return shared.join(many, "print", "left").withColumn("many", F.coalesce("many", F.lit(False)))


def compact(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, more tightly packed."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PIECE = "print long, digest binary, key long, variant long, start int, windows int, bytes binary"


def piece_frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of ``PIECE``; whole numbers beside nulls never pass through floats."""
    kinds = {"long": "Int64", "int": "Int32", "binary": object}
    fields = [f.split() for f in PIECE.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pd.DataFrame({name: pd.Series(list(c), dtype=kinds[kind]) for (name, kind), c in zip(fields, columns)})


def pieces(docs: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """Stored entries with their bytes; those of crowded fingerprints also have a digest of them. Pieces that the same text
    holds earlier come as joined stretches without bytes: all their windows are repeated."""
    by_text = shared.groupBy("key", "variant").agg(F.collect_list(F.struct("print", "start", "windows", "many")).alias("found"))
    by_text = by_text.select(F.col("key").alias("of"), F.col("variant").alias("of_variant"), "found")
    same = F.col("key").eqNullSafe(F.col("of")) & (F.col("variant") == F.col("of_variant"))
    met = docs.select("key", "variant", "body").join(by_text, same).select("key", "variant", "body", "found")

    def run(batches):
        for frame in batches:
            seen: set = set()
            out = []
            for key, variant, body, found in zip(frame["key"], frame["variant"], frame["body"], frame["found"]):
                key = None if pd.isna(key) else int(key)
                if (key, variant) in seen:
                    continue  # a repeated row
                seen.add((key, variant))
                raw, here, again = body.encode(), set(), []
                for e in sorted(found, key=lambda e: e["start"]):
                    start, windows = e["start"], e["windows"]
                    piece = raw[start:start + windows + length - 1]
                    if piece in here:  # earlier in the same text
                        if again and start <= again[-1][1]:
                            again[-1][1] = max(again[-1][1], start + len(piece))
                        else:
                            again.append([start, start + len(piece)])
                        continue
                    here.add(piece)
                    out.append((e["print"], xxhash.xxh3_128_digest(piece) if e["many"] else None, key, variant, start, windows, piece))
                out += [(None, None, key, variant, a, b - a - length + 1, None) for a, b in again]
            yield piece_frame(out)

    return compact(met.mapInPandas(run, PIECE), "pieces")


REMOVED = "key long, variant long, start long, end long"


def marked(length: int):
    """Windows of a group of pieces that also start earlier, as spans of bytes."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(none=frame["key"].isna()).sort_values(["none", "key", "variant", "start"], kind="stable")
        frame = frame.drop_duplicates(["none", "key", "variant", "start"])
        repeat = frame.duplicated(["print", "bytes"]).to_numpy()
        start, windows = frame["start"].to_numpy(), frame["windows"].to_numpy()
        rows, low, high = [np.flatnonzero(repeat)], [start[repeat]], [start[repeat] + windows[repeat] + length - 1]
        distinct = frame[~repeat].groupby("print")["print"].transform("size").reindex(frame.index).to_numpy()
        indexed = np.flatnonzero(~repeat & (distinct > 1))
        if len(indexed):
            index = RunIndex(frame["bytes"].iloc[indexed].tolist())
            hit = index.repeated(length)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
            a, b = edges[::2], edges[1::2]  # runs of windows; each ends before its piece does
            piece = np.searchsorted(index.starts, a, "right") - 1
            offset = start[indexed][piece] - index.starts[piece]
            rows.append(indexed[piece])
            low.append(a + offset)
            high.append(b - 1 + length + offset)
        rows = np.concatenate(rows)
        return pd.DataFrame({"key": frame["key"].iloc[rows].to_numpy(), "variant": frame["variant"].iloc[rows].to_numpy(), "start": np.concatenate(low).astype(np.int64), "end": np.concatenate(high).astype(np.int64)})

    return run


def removals(found: DataFrame, length: int) -> DataFrame:
    """(key, variant, start, end) of all repeated windows; ``found`` are stored pieces."""
    plain, crowded = found.where("digest is null and bytes is not null"), found.where("digest is not null")
    here = spans_of(found.where("bytes is null"), length)
    if crowded.isEmpty():
        return indexed(plain, length).unionByName(here)
    heads, by_piece = firsts(crowded)
    heads = stored(heads.select(*found.columns), "heads")
    sizes = heads.groupBy("print").agg(F.count(F.lit(1)).alias("n"))
    met = heads.join(sizes, "print")
    fitting = met.where(F.col("n") <= GROUP_ENTRIES).select(*found.columns)

    def windows(batches):
        for frame in batches:
            rows = [(None, xxhash.xxh3_128_digest(raw[p:p + length]), None if pd.isna(k) else int(k), v, s + p, 1, None)
                    for k, v, s, n, raw in zip(frame["key"], frame["variant"], frame["start"], frame["windows"], frame["bytes"]) for p in range(n)]
            yield piece_frame(rows)

    single = met.where(F.col("n") > GROUP_ENTRIES).select(*found.columns).mapInPandas(windows, PIECE)
    by_window = firsts(single)[1]
    later = spans_of(by_piece.unionByName(by_window), length)
    return indexed(plain.unionByName(fitting), length).unionByName(later).unionByName(here)


def spans_of(rows: DataFrame, length: int) -> DataFrame:
    """The bytes that runs of windows cover."""
    end = (F.col("start") + F.col("windows") + F.lit(length - 1)).cast("long").alias("end")
    return rows.select("key", "variant", F.col("start").cast("long").alias("start"), end)


def indexed(pieces_: DataFrame, length: int) -> DataFrame:
    """Repeated windows by run-length indexes over groups of pieces; equal fingerprints share a group."""
    total = pieces_.agg(F.sum(F.length("bytes"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    part = F.pmod(F.xxhash64("print"), F.lit(groups)).alias("part")
    grouped = pieces_.select(part, "print", "key", "variant", "start", "windows", "bytes")
    return grouped.groupBy("part").applyInPandas(marked(length), REMOVED)


def firsts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row of every digest, and the later ones."""
    first = rows.groupBy("digest").agg(F.min(position()).alias("first"))
    met = rows.join(first, "digest")
    return met.where(position() == F.col("first")), met.where(position() != F.col("first"))


def position() -> Column:
    """Order of windows over all texts; keys that are null come last (and equal one another here)."""
    return F.struct(F.col("key").isNull().alias("none"), F.coalesce("key", F.lit(0)).alias("key"), "variant", "start")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, body (the text), spans (start and end in bytes, merged, in order) and the columns of ``keep`` for every row."""
    keep = tuple(c for c in keep if c != key)
    rows = keyed(docs, key, text, keep)
    copies = later_copies(rows, length)
    heads = without(rows, copies)
    shared = shared_entries(heads, length)
    removed = stored(removals(pieces(heads, shared, length), length).unionByName(copies), "removed")
    by_text = removed.groupBy("key", "variant").agg(F.collect_set(F.struct("start", "end")).alias("found"))
    by_text = by_text.select(F.col("key").alias("of"), F.col("variant").alias("of_variant"), "found")
    same = F.col("key").eqNullSafe(F.col("of")) & (F.col("variant") == F.col("of_variant"))
    met = rows.join(by_text, same, "left").drop("of", "of_variant", "variant")
    merged = F.aggregate(F.array_sort(F.coalesce("found", F.array())), F.array().cast("array<struct<start:long,end:long>>"), joined_span)
    return met.withColumn("spans", merged).select(F.col("key").alias(key), "body", "spans", *restored(keep, text))


def joined_span(done: Column, span: Column) -> Column:
    last = F.element_at(done, -1)
    apart = (F.size(done) == 0) | (span["start"] > last["end"])
    longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))))
    return F.when(apart, F.concat(done, F.array(span))).otherwise(longer)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Numbers of bytes, removed bytes and spans, and a checksum of the bytes that stay."""

    def run(batches):
        for frame in batches:
            sums = []
            for body, spans in zip(frame["body"], frame["spans"]):
                raw, end = (body or "").encode(), 0
                kept = hashlib.sha256()
                for s in spans:
                    kept.update(raw[end:s["start"]])
                    end = s["end"]
                kept.update(raw[end:])
                sums.append((len(raw), sum(s["end"] - s["start"] for s in spans), len(spans), kept.hexdigest()))
            n, removed, parts, sha = zip(*sums) if sums else ((), (), (), ())
            yield pd.DataFrame({key: frame["key"], "n_bytes": n, "n_removed": removed, "n_spans": parts, "kept_sha256": sha})

    kind = found.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return found.select(column(key).alias("key"), "body", "spans").mapInPandas(run, schema)
