"""Sinks and their readers: tables as Parquet, reports as JSON; and tables that a session builds once and reads often."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver can read: ``spark.checkpoint.dir``.

    A session whose executors are threads of the driver and that names none gets a temporary folder; any other session
    without one is an error, since a machine-local folder would lose data there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"ridgeline-{os.getuid()}"))
    return spark.sparkContext.getCheckpointDir()


#: Rows that a bucket of a stored table holds, about: a task sorts one, with all features some 250 bytes a row. Of keys with
#: more than half as many rows (the panel has few dates, which widen with it), a bucket may hold two.
BUCKET_ROWS = 500_000


class _Stored(NamedTuple):
    table: str
    path: str
    sources: str
    built: float


_stored: dict[tuple[str, str, str], _Stored] = {}


def bucket_count(spark: SparkSession, rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-rows // BUCKET_ROWS))


def even_buckets(spark: SparkSession, rows: DataFrame, key: str) -> int:
    """A number of buckets for keys so few that chance crowds them: a count of each reaches the driver.

    The fewest buckets, from ``bucket_count`` on, of which none holds more than ``BUCKET_ROWS`` or two keys of the widest; where no
    number does up to four times the keys, the one with the least in its fullest bucket."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(F.hash(key).alias("_h"), "_n").toArrow()
    places, counts = sizes.column("_h").to_numpy().astype(np.int64), sizes.column("_n").to_numpy()
    least = bucket_count(spark, int(counts.sum()))
    if not len(counts):
        return least
    fullest = {}
    for buckets in range(least, max(2 * least, 4 * len(counts)) + 1):
        fullest[buckets] = int(np.bincount(places % buckets, counts).max())  # Spark's place of a key: its hash modulo the number
        if fullest[buckets] <= max(BUCKET_ROWS, 2 * int(counts.max())):
            return buckets
    return min(fullest, key=fullest.get)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the files under ``paths``: their names, sizes and times of change. A missing path has none."""
    jvm, conf, seen = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in sorted(paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(conf)
        if fs.exists(where):
            files = fs.listFiles(where, True)
            while files.hasNext():
                f = files.next()
                seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def _sources(spark: SparkSession, source: str, tables: list[str]) -> str:
    return fingerprint(spark, [f"{source}/{t}.parquet" for t in tables])


def is_stored(spark: SparkSession, source: str, name: str, tables: list[str]) -> bool:
    """Whether ``stored`` would read the table as it is."""
    have = _stored.get((spark.sparkContext.applicationId, source, name))
    return have is not None and have.sources == _sources(spark, source, tables) and spark.catalog.tableExists(have.table)


def stored(spark: SparkSession, source: str, name: str, key: str, order: str, build: Callable[[], tuple[DataFrame, int]], tables: list[str], max_age: float | None = None) -> DataFrame:
    """The table that ``build`` makes from the Parquet ``tables`` in the folder ``source``, written by the first use in a
    session, and anew as soon as a file of those has changed or the table is ``max_age`` seconds old.

    ``build`` returns the rows and a number of buckets. The table is bucketed by ``key`` and sorted by ``order`` in each
    bucket, so windows and aggregates by ``key`` read it without a shuffle. It is external, in the shared folder. One that is
    built anew takes the place of the old one, whose files go; what still reads those must be made again.
    """
    found, now = (spark.sparkContext.applicationId, source, name), _sources(spark, source, tables)
    have = _stored.get(found)
    if have is None or have.sources != now or (max_age is not None and time.time() - have.built > max_age) or not spark.catalog.tableExists(have.table):
        rows, buckets = build()
        table = f"{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/ridgeline-{table}"
        writer = rows.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(*dict.fromkeys((key, order)))
        writer.option("path", path).saveAsTable(table)
        _drop(spark, found)
        _stored[found] = _Stored(table, path, now, time.time())
    return spark.table(_stored[found].table)


def _drop(spark: SparkSession, found: tuple[str, str, str]) -> None:
    if (old := _stored.pop(found, None)) is not None:
        spark.sql(f"DROP TABLE IF EXISTS {old.table}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old.path)  # dropping an external table leaves its files
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def forget(spark: SparkSession, source: str) -> None:
    """Drop the stored tables of ``source`` with their files; their next use builds them anew."""
    for found in [k for k in _stored if k[:2] == (spark.sparkContext.applicationId, source)]:
        _drop(spark, found)


def write_table(rows: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append to a folder of CSV parts, each with its header."""
    rows.write.mode("append").option("header", True).csv(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def sampled(rows: DataFrame, most: int, key: str, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, drawn by hash of the text ``key`` and ``seed``: a top-k per task, no sort of the whole."""
    return rows.orderBy(F.md5(F.concat_ws("|", key, F.lit(str(seed))).cast("binary")), key).limit(most)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON of one document or array per file; bare NaN is read as such."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)
