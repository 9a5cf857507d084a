"""Delimited, Parquet and JSON sources and sinks."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines of a cluster share.

    Only a session on one machine may leave it unset: it gets a temporary folder. Elsewhere that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new folder in the shared one, removed when the application ends."""
    path = f"{shared_dir(spark)}/quarrymill-{uuid.uuid4().hex}"
    system, where = _hadoop_path(spark, path)
    system.deleteOnExit(where)
    return f"{path}/{name}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing will read again."""
    system, where = _hadoop_path(spark, path)
    system.delete(where, True)


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _delimited(spark: SparkSession):
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    return reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)


def scan_delimited(spark: SparkSession, path: str, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """All-text scan of delimited files, .gz decompressed by its ending. A path without files is an error.

    gzip files can't be split: partitions spreads their rows for the work that follows.
    """
    df = _delimited(spark).schema(text_schema(columns)).csv(path)
    return df.repartition(partitions) if partitions else df


#: Bytes of a file that are looked at for its header, and files looked at together.
HEADER, READERS = 65_536, 16


def _data_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, a folder's or a pattern's; hidden ones don't count. A path without files is an error."""
    system, where = _hadoop_path(spark, path)
    found = []
    for status in system.globStatus(where) or []:
        listed = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath() for s in listed if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(path)
    return [p.toString() for p in found]


def state_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, time of change and size of a path's files, of folders below it too, by name."""
    system, where = _hadoop_path(spark, path)
    found, every = [], system.listFiles(where, True)
    while every.hasNext():
        s = every.next()
        found.append((s.getPath().toString(), s.getModificationTime(), s.getLen()))
    return sorted(found)


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A delimited file's column names; none for an empty file. Only the file's beginning is read."""
    system, where = _hadoop_path(spark, path)
    stream = system.open(where)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(where)
        text = stream if codec is None else codec.createInputStream(stream)
        raw = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(text, HEADER))
    finally:
        stream.close()
    return tuple(next(csv.reader(io.StringIO(bytes(raw).decode("utf-8", "replace"))), ()))


def scan_with_drift(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Scan of files whose headers differ: columns by name, missing ones null, additional ones kept at the end.

    Files are grouped by their header, which the driver reads as it lists the files: one scan for each distinct header, with
    a schema of text, however many files there are. Files without a header are left out.
    """
    every = [f for path in paths for f in _data_files(spark, path)]
    with ThreadPoolExecutor(READERS) as readers:
        headers = list(readers.map(lambda f: header_of(spark, f), every))
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, header in zip(every, headers, strict=True):
        if header:
            groups.setdefault(header, []).append(name)
    frames = [_delimited(spark).schema(text_schema(header)).csv(names) for header, names in groups.items()]
    if not frames:
        return spark.createDataFrame([], text_schema(columns))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*columns, *[c for c in out.columns if c not in columns])


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Snappy Parquet, replacing what is there."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def sized(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read again: its rows are made once, and Spark knows its size where it is joined."""
    path = scratch(df.sparkSession, name)
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_fan_out(flags: DataFrame, valid: DataFrame, rejected: DataFrame, clean_path: str, quarantine_path: str) -> None:
    """Two sinks of one flow: the shared prefix is kept while both are written."""
    flags.persist()
    try:
        write_parquet(valid, clean_path)
        write_parquet(rejected, quarantine_path)
    finally:
        flags.unpersist()


def write_delimited(df: DataFrame, path: str, single: bool = False, compression: str | None = None) -> None:
    """Delimited text with a header, spaces around values kept; single: one file, for aggregate tables."""
    out = (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"')
    out = out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (out.option("compression", compression) if compression else out).csv(path)


def write_chunks(df: DataFrame, path: str, chunks: int, key: str, then: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """gzip delimited text in so many files, by ranges of the key; then makes the text of rows that are already dealt."""
    write_delimited(then(df.repartitionByRange(chunks, key)), path, compression="gzip")


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_by_recipient(df: DataFrame, recipient: str, path: str, spread: int | None = 8) -> None:
    """One folder per value of the recipient column, with up to spread files each.

    Rows are dealt by the value and a hash of the row, so that a hot value's rows are written by several tasks and a value's
    files don't multiply with the tasks. None: every task writes the rows that it has, a file for each of its values, and no
    row moves; for rows that a shuffle has dealt by then, whose tasks Spark bounds.
    """
    if spread:
        df = df.repartition(F.col(recipient), F.pmod(F.xxhash64(*df.columns), F.lit(spread)))
    df.write.mode("overwrite").partitionBy(recipient).parquet(path)


def recipient_extracts(df: DataFrame, recipients: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each recipient's rows, with the column recipient; a row that several may see comes once for each.

    recipients: (recipient, field, value), any number of values each. A recipient's values of one field are alternatives; of
    a recipient with several fields all must hold. key names a row. Null values match nothing. The mapping is written and
    joined by (field, value), broadcast only while Spark knows it to be small: a row meets the recipients of its value in
    their first field, and keeps those whose values of each other field, joined in turn, have the row's too. So every row is
    looked at once, by itself, and nothing is counted.
    """
    recipients = sized(recipients.select("recipient", "field", F.col("value").cast("string").alias("value")).distinct(), "recipients")
    held = recipients.groupBy("recipient").agg(
        F.array_sort(F.collect_set("field")).alias("_fields"), F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), F.col("field")))).alias("_valued")
    )
    # A recipient with a field that has no value, or that the rows lack, sees nothing.
    able = held.where((F.col("_fields") == F.col("_valued")) & (F.size(F.array_except("_fields", F.lit(list(df.columns)))) == 0))
    pairs = recipients.where("value IS NOT NULL").join(able.drop("_valued"), "recipient").select(
        "recipient", "_fields", F.col("field").alias("_field"), F.col("value").alias("_value")
    )
    pairs = sized(pairs, "pairs")
    found = [(r._field, r._first) for r in pairs.select("_field", (F.col("_field") == F.col("_fields")[0]).alias("_first")).distinct().collect()]
    given = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in sorted(f for f, first in found if first)])
    seen = df.withColumn("_p", F.explode(given.cast("array<struct<field:string,value:string>>")))
    first = pairs.where(F.col("_field") == F.col("_fields")[0])
    met = seen.join(first, (F.col("_p.field") == F.col("_field")) & (F.col("_p.value") == F.col("_value"))).drop("_p", "_field", "_value")
    for f in sorted(f for f, first in found if not first):
        other = pairs.where((F.col("_field") == f) & (F.col("_fields")[0] != f)).select(F.col("recipient").alias("_r"), F.col("_value").alias("_v"))
        met = met.join(other, (F.col("recipient") == F.col("_r")) & (F.col(f).cast("string") == F.col("_v")), "left")
        asked = F.array_contains("_fields", f) & (F.col("_fields")[0] != f)
        met = met.where(~asked | F.col("_r").isNotNull()).drop("_r", "_v")
    return met.select(*df.columns, "recipient")


def load_typed(df: DataFrame, expressions: dict[str, Column]) -> DataFrame:
    """A text load with one expression per output column."""
    return df.select(*[e.alias(name) for name, e in expressions.items()])


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every column renamed with a prefix, but for those to keep."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def publish(views: dict[str, DataFrame]) -> None:
    """Temporary views by name."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
