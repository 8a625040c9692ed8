"""Where intermediate tables live, and small helpers that every corpus operator uses."""

from __future__ import annotations

import os
import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.sources import store

#: A key that holds at least one row in this many is hot; there are at most this many hot keys, whatever the data.
HOT_SHARE = 1000


#: Rows of an Arrow batch where the session has Spark's default of ten times as many: texts of a few kilobytes then make
#: batches of a few megabytes, of which the JVM and the worker hold a copy each for every running task.
BATCH_ROWS, _BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def let_workers_import(spark: SparkSession) -> None:
    """Put the folder that holds this package on the Python workers' path, for sessions started without --py-files, and
    keep Arrow batches small unless the session says otherwise."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver can read: ``spark.checkpoint.dir`` (see ``sources.store``)."""
    let_workers_import(spark)
    return store.shared_dir(spark)


class _Open(threading.local):
    """The lists of folders that the surrounding ``scratch`` and ``recorded`` blocks of this thread keep."""

    def __init__(self):
        self.lists: list[list[str]] = []


_open = _Open()


def fresh_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/ridgeline-{what}-{uuid.uuid4().hex}"
    if _open.lists:
        _open.lists[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what operators wrote in the shared folder inside; write results elsewhere before that."""
    _open.lists.append([])
    try:
        yield
    finally:
        for path in _open.lists.pop():
            delete(spark, path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The list of folders that operators write inside."""
    _open.lists.append([])
    try:
        yield _open.lists[-1]
    finally:
        paths = _open.lists.pop()
        if _open.lists:
            _open.lists[-1].extend(paths)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, so a lost executor costs nothing."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until it is none of ``taken`` in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


#: Files that ``with_row_key`` numbers by a broadcast table (about 1 MB of paths).
FILES = 10_000
#: The same file is file:/x here and file:///x there.
_SLASHES = "^([A-Za-z][A-Za-z0-9+.-]*):/+"


def _is_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is columns and filters of one relation, so that no row of a file comes twice."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart and stays the same however often they are read, and its name.

    Rows of Parquet files are known by the number of their file and their place in it, so nothing is written; others are
    written once with an id.
    """
    key = free_name(docs.columns, "_row")
    try:
        files = sorted(docs.inputFiles()) if _is_scan(docs) else []
        if 0 < len(files) <= FILES:
            file, place, number = (free_name(docs.columns, c) for c in ("_file", "_place", "_number"))
            placed = docs.select("*", F.regexp_replace("_metadata.file_path", _SLASHES, "$1:/").alias(file), F.col("_metadata.row_index").alias(place))
            numbers = docs.sparkSession.createDataFrame([(k, re.sub(_SLASHES, r"\1:/", f)) for k, f in enumerate(files)], f"`{number}` long, `{file}` string")
            known = F.coalesce(F.col(number), F.raise_error(F.concat(F.lit("a file that was not there before: "), F.col(file))).cast("long"))
            return placed.join(F.broadcast(numbers), file, "left").withColumn(key, F.shiftleft(known, 40) + F.col(place)).select(*docs.columns, key), key
    except AnalysisException:
        pass
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def join_hot(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, listed: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``table``, whose column ``size`` tells how many of the ``total`` rows have its ``key``.

    The entries of keys that hold a thousandth of the rows or more are broadcast (there can't be more than a thousand
    such keys), so no task meets all rows of one key; the rest is joined by shuffle. ``listed``, for keys that are
    numbers: the hot ones are known to the plan by value, and where there are none, they cost nothing.
    """
    hot = table.where(F.col(size) * HOT_SHARE >= max(total, HOT_SHARE * 100))
    if listed:
        keys = [r[0] for r in hot.select(key).distinct().collect()]  # a thousand at most
        if not keys:
            return rows.join(table, key)
        cold = rows.where(~F.col(key).isin(keys)).join(table, key)
    else:
        cold = rows.join(F.broadcast(hot.select(key).distinct()), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column, modulus: int) -> Column:
    """True where crc32 of the id as text leaves remainder 1. A null id counts as the empty string."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == 1
