"""Scans, caches and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from memberlens.session import run_folder


def scan(spark: SparkSession, name: str) -> DataFrame:
    """A table by a name that is only known at run time."""
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": name})


def run_script(spark: SparkSession, script: str, tables: Mapping[str, str], values: Mapping[str, object] = {}) -> DataFrame:
    """Run a stored SQL text over tables and values that are only known now, and return its rows.

    ``script`` names tables as ``IDENTIFIER(:name)`` and values as ``:name``. Both become variables of the session, and EXECUTE
    IMMEDIATE binds them, so one text serves any table, nothing is pasted into it, and the text of a value is never read as
    SQL. Variables have names of their own and are dropped when the rows are planned.
    """
    mark = uuid.uuid4().hex
    bound = {**tables, **values}
    names = {k: f"v_{i}_{mark}" for i, k in enumerate([*bound, "script"])}
    try:
        for k, v in {**bound, "script": script}.items():
            kind = {bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE"}.get(type(v), "STRING")
            spark.sql(f"DECLARE VARIABLE {names[k]} {kind}")
            spark.sql(f"SET VAR {names[k]} = :v", args={"v": v})
        using = ", ".join(f"{names[k]} AS {k}" for k in bound)
        return spark.sql(f"EXECUTE IMMEDIATE {names['script']}" + (f" USING {using}" if using else ""))
    finally:
        for n in names.values():
            spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS {n}")


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is present; the filter reaches the parquet scan."""
    return df.where(F.col(target).isNotNull())


def map_chunks(df: DataFrame, fn: Callable, schema: T.StructType | str) -> DataFrame:
    """Apply ``fn(pandas frame) -> pandas frame`` to bounded batches of a large scan.

    Batches are Arrow record batches inside each task, so nothing passes through the driver.
    """

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def read_csv_numeric(spark: SparkSession, path: str, numeric: Iterable[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; the named columns become doubles, unreadable values NULL."""
    reader = spark.read.option("header", True)
    raw = reader.schema(schema).csv(path) if schema else reader.csv(path)
    wanted = set(numeric)
    return raw.select(*[F.col(c).try_cast("double").alias(c) if c in wanted else F.col(c) for c in raw.columns])


def columns_by_keyword(metadata: DataFrame, keywords: Mapping[str, str], code: str = "column_code",
                       label: str = "label") -> DataFrame:
    """Metadata rows whose text mentions a keyword: (code, label, keyword, direction)."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in metadata.columns]))
    hits = F.array(*[
        F.when(text.contains(k.lower()), F.struct(F.lit(k).alias("keyword"), F.lit(d).alias("direction")))
        for k, d in keywords.items()
    ])
    found = metadata.withColumn("_hit", F.explode(F.filter(hits, lambda h: h.isNotNull())))
    return found.select(F.col(code).alias("code"), F.col(label).alias("label"), "_hit.keyword", "_hit.direction")


def cache_age(spark: SparkSession, path: str) -> datetime | None:
    """Time of the newest file under ``path``, or None when there is no readable parquet table."""
    try:
        files = spark.read.parquet(path).select("_metadata.file_modification_time")
    except AnalysisException:
        return None
    return files.agg(F.max("file_modification_time")).first()[0]


def fingerprint(df: DataFrame) -> str:
    """Of the files a frame reads: changes when a file is added, removed, replaced or resized."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    each = F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(20,0)")
    total = files.agg(F.count("*").alias("n"), F.sum(each).alias("t")).first()
    return f"{total['n']}-{int(total['t'] or 0) & (1 << 64) - 1:016x}"


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], now: datetime | None = None,
           hours: float = 24, force: bool = False) -> DataFrame:
    """The parquet copy at ``path`` while it is fresh, else a rebuilt one.

    The copy lives in storage all executors share, so a lost executor re-reads it instead of recomputing.
    """
    if not force:
        written = cache_age(spark, path)
        now = now or datetime.now()
        if written is not None and now - written <= timedelta(hours=hours):
            return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str | None = None) -> None:
    """Write as a whole-table replacement, optionally partitioned so that later scans can skip files."""
    writer = df.write.mode("overwrite")
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = (), compression: str | None = None) -> DataFrame:
    """Write a stage to the shared folder, under a name of its own, and read it back.

    What follows starts from the files: a long lineage ends here, a lost executor re-reads instead of recomputing, and
    later scans take only the columns and partitions they need.
    """
    spark = df.sparkSession
    folder = run_folder(spark, name)
    replace_table(df, folder, partition_by, compression)
    return spark.read.schema(df.schema).parquet(folder).select(*df.columns)


def bucketed(df: DataFrame, name: str, key: str, compression: str | None = None) -> DataFrame:
    """A stage whose files are hashed and sorted by ``key``, in as many buckets as a shuffle has partitions.

    Groups, windows and joins by the key then start where the rows lie. Rows should be reduced before: all rows of a key
    share a bucket.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
    writer = writer.option("compression", compression) if compression else writer
    writer.option("path", run_folder(spark, name)).saveAsTable(table)
    return spark.table(table)


def kept_in_place(df: DataFrame, name: str, key: str, order: Sequence[str] = (), compression: str | None = None) -> DataFrame:
    """``bucketed`` for rows that a shuffle has already hashed by ``key``: written where they lie, without another shuffle.

    Cuts a long chain of joins and windows, whose sorts would all hold memory of one task. Partitions are not merged meanwhile, so
    a task has the rows of one bucket; rows that lie otherwise are written correctly, in more files.
    """
    spark = df.sparkSession
    conf, table = "spark.sql.adaptive.coalescePartitions.enabled", f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        writer = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key, *order)
        writer = writer.option("compression", compression) if compression else writer
        writer.option("path", run_folder(spark, name)).saveAsTable(table)
    finally:
        spark.conf.set(conf, before)
    return spark.table(table)


#: Rows of a source that a task may stand for.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, key: str | Sequence[str], source: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Rows hashed by ``key`` into tasks whose number follows the rows of ``source``, ``rows`` each, and never fewer than a shuffle has.

    A number that is asked for is not lowered at run time, where small rows that multiply later would be merged into few tasks.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-source.count() // rows))
    return df.repartition(n, *([key] if isinstance(key, str) else key))


@contextmanager
def shuffled_by_rows(source: DataFrame, rows: int = TASK_ROWS):
    """While an action runs, a shuffle and a bucketed stage have a partition for every ``rows`` rows of ``source``, and never fewer
    than before."""
    key, spark = "spark.sql.shuffle.partitions", source.sparkSession
    before = spark.conf.get(key)
    spark.conf.set(key, max(int(before), -(-source.count() // rows)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def wide_rows(spark: SparkSession, fields: int = 30):
    """While an action runs, steps over more than ``fields`` columns are not fused into one method, which the JVM would no longer
    compile."""
    key = "spark.sql.codegen.maxFields"
    before = spark.conf.get(key)
    spark.conf.set(key, fields)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def co_partitioned(spark: SparkSession):
    """While an action runs, tables hashed by some of a join's keys are joined where they lie.

    The size of a stage's files says little of its rows: columns of flags shrink to a hundredth. So no table is broadcast for the size of
    its files, which the driver would have to unpack; what was shuffled has a measured size and still is.
    """
    measured, by_files = "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.autoBroadcastJoinThreshold"
    names = ("spark.sql.requireAllClusterKeysForCoPartition", measured, by_files)
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in zip(names, ("false", before[measured] or spark.conf.get(by_files), "-1"), strict=True):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def insert_into(df: DataFrame, schema: T.StructType, path: str) -> None:
    """Append to a table with a declared schema; columns are matched by name and cast or rejected."""
    df.to(schema).write.mode("append").parquet(path)


def session_table(df: DataFrame, name: str) -> DataFrame:
    """A name for the rest of the session; nothing is computed or stored."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def inline(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small table written in code, marked for broadcast (its size is that of the source text)."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def schema_catalogue(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Name, position, type, nullability and comment of every column of every table."""
    spark = next(iter(tables.values())).sparkSession
    rows = [
        Row(table_name=name, ordinal=i, column_name=f.name, data_type=f.dataType.simpleString(), nullable=f.nullable,
            comment=f.metadata.get("comment"))
        for name, df in tables.items() for i, f in enumerate(df.schema.fields, start=1)
    ]
    schema = "table_name string, ordinal int, column_name string, data_type string, nullable boolean, comment string"
    return spark.createDataFrame(rows, schema)


def listed_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of the session catalogue."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, kind string, is_temporary boolean")


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """CSV (with header) or JSON report; nested values become JSON text in CSV."""
    if kind == "json":
        df.write.mode("overwrite").json(path)
        return
    if kind != "csv":
        raise ValueError(f"unknown report kind {kind!r}")
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])
    flat.write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def stacked(frames: Mapping[str, DataFrame], column: str = "origin") -> DataFrame:
    """Frames of one schema under each other, with a column naming the frame."""
    return reduce(DataFrame.unionByName, [df.withColumn(column, F.lit(name)) for name, df in frames.items()])
