"""Columns that operators hand through, under names of their own so that none can clash with the operator's."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def carried(keep: Sequence[str], text: str | None = None) -> list[Column]:
    """The columns of ``keep`` under neutral names; the text column travels as the operator's own ``body``."""
    return [column(c).alias(f"kept_{i}") for i, c in enumerate(keep) if c != text]


def restored(keep: Sequence[str], text: str | None = None) -> list[Column]:
    """The columns of ``keep`` under their own names again, in their order."""
    return [(F.col("body") if c == text else F.col(f"kept_{i}")).alias(c) for i, c in enumerate(keep)]


def release() -> None:
    """Give freed memory back to the system: workers live on and would hold it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Whole texts in an Arrow batch, at most.
TEXT_ROWS = 1_000


def in_text_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends at most ``TEXT_ROWS`` rows to Python at once from now on: rows here hold whole texts, and frames
    are run after their operator has returned, so the setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(df.sparkSession.conf.get(key))
    if not 0 < held <= TEXT_ROWS:
        df.sparkSession.conf.set(key, TEXT_ROWS)
    return df


#: Characters of text that a step takes at once, whole texts each.
TEXTS_AT_ONCE = 4_000_000


def small_batches(frames: Iterable[pd.DataFrame], text: str, most: int = TEXTS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """The same rows in their order, cut where a batch would hold more than ``most`` characters (or one text)."""
    for frame in frames:
        sizes = frame[text].str.len().fillna(0).to_numpy()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield frame.iloc[start:i].reset_index(drop=True)
                start, held = i, 0
            held += n
        yield frame.iloc[start:].reset_index(drop=True) if start else frame


def by_small_batches(text: str):
    """For a function over batches: it gets small ones, and memory is released after the last."""

    def wrap(run: Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]):
        @functools.wraps(run)
        def wrapped(frames):
            yield from run(small_batches(frames, text))
            release()

        return wrapped

    return wrap
