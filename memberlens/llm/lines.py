"""Removal of lines that many documents share.

Every text is split at line feeds, the lines are normalised, hashed and counted by distinct documents; lines of frequent keys
leave every document, what stays is joined again by position. All steps are DataFrame functions.

A document is an id: rows that repeat an id are one document, all rows without an id are one document. A key is named by 128
bits of its hash. Counts are added up before they are shuffled, so a line of a third of all documents is a row per task; keys
that stand for a large part of all lines are broadcast (fewer than ``skew.HEAVY``), the others are joined. Rows with the same
id and text share what is found for them.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code points always stay; an empty
table gives an empty one; a text whose lines all go becomes empty. Only id, text and the columns of ``keep`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memberlens.llm.common import carried, column, restored
from memberlens.llm.skew import semi_join
from memberlens.sources.tables import stored

MIN_DOCS = 10
MIN_CHARS = 1

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The whole text; a null one is empty.
WHOLE = "coalesce(body, '')"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_keys(text: Column) -> Column:
    """Normalised lines in their order: blanks at both ends gone, A-Z in lower case."""
    return F.transform(lines_of(F.translate(text, UPPER, LOWER)), lambda x: F.btrim(x, F.lit(BLANK)))


def digests(name: str, *columns: Column) -> list[Column]:
    """128 bits of a value as two numbers."""
    return [F.xxhash64(*columns).alias(f"{name}_a"), F.xxhash64(F.lit(1), *columns).alias(f"{name}_b")]


def with_row_digest(docs: DataFrame, key: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    rows = docs.select(column(key).alias("key"), column(text).cast("string").alias("body"), *carried(keep, text))
    return rows.select("*", *digests("row", F.isnull("key"), F.col("key"), F.expr(WHOLE)))


def exploded(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, row_a, row_b, position, line_a, line_b) of every line whose key is long enough."""
    lines = rows.select("key", "row_a", "row_b", F.posexplode(line_keys(F.expr(WHOLE))).alias("position", "line"))
    return lines.where(F.length("line") >= min_chars).select("key", "row_a", "row_b", "position", *digests("line", F.col("line")))


def frequent(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(line_a, line_b, n_docs, n_lines) of the keys of at least ``min_docs`` documents."""
    per_document = lines.groupBy("line_a", "line_b", "key").agg(F.count(F.lit(1)).alias("n"))
    counts = per_document.groupBy("line_a", "line_b").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"))
    return counts.where(F.col("n_docs") >= min_docs)


def without_frequent_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = (), min_docs: int = MIN_DOCS,
                           min_chars: int = MIN_CHARS) -> DataFrame:
    """key, kept_text, n_lines, n_dropped and the columns of ``keep``, one row per row of ``docs``.

    Texts are shuffled once, to meet the positions of their lost lines.
    """
    rows = with_row_digest(docs, key, text, keep)
    lines = stored(exploded(rows, min_chars), "lines")
    common = stored(frequent(lines, min_docs), "frequent-lines")
    hits = semi_join(lines.select("row_a", "row_b", "position", "line_a", "line_b"), common, ["line_a", "line_b"], "n_lines")
    lost = hits.groupBy("row_a", "row_b").agg(F.collect_set("position").alias("lost"))
    found = rows.join(lost, ["row_a", "row_b"], "left")
    body = F.expr(WHOLE)
    n = F.size(lines_of(body))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("lost"))
    # the outer array binds the lines, so that they are split once and not for every position
    joined = F.get(F.transform(F.array(lines_of(body)), lambda lines: F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")), 0)
    return found.select(
        "key", F.when(F.col("lost").isNull(), body).otherwise(joined).alias("kept_text"), n.cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), *restored(keep, text))


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("key").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
