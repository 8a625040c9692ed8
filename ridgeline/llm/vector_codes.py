"""Codes of vectors by parts: Lloyd's rounds kept up to date by what changes.

A vector is cut into parts, each with a codebook of its own; the code of a vector names the nearest entry for each part.
All is done in whole numbers, so sums are exact and do not hang on the order in which Spark adds them.

Every round writes the rows with their assignment before and after it. The running sums and counts of the entries are
a table too: a round shuffles only what the parts whose assignment changed take from one entry and bring to another, summed in
each task first (at most parts x entries rows), and adds that to the sums of the round before. The first round counts
every part as changed. Codebooks (parts x entries) are all that passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shared import delete, fresh_path, join_hot, let_workers_import, materialize
from ridgeline.llm.vectors import about, integer_vectors, matrix, products

#: Largest magnitude of a scaled component: squared distances of 64-bit vectors of up to 64 components stay exact.
LARGEST = 1 << 27


def cuts(dim: int, parts: int) -> list[int]:
    """Bounds of ``parts`` consecutive parts, equal where ``parts`` divides ``dim``, else the first ones longer by one."""
    small, more = divmod(dim, parts)
    return [k * small + min(k, more) for k in range(parts + 1)]


def assign(x: np.ndarray, books: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part's book for each row (ties to the lower index), and the sum of squared distances."""
    codes, error, at = np.zeros((len(x), len(books)), np.int32), np.zeros(len(x), np.int64), 0
    for k, book in enumerate(books):
        part = x[:, at : at + book.shape[1]]
        far = (book * book).sum(axis=1)[None, :] - 2 * products(part, book, most)
        codes[:, k] = far.argmin(axis=1)
        error += far[np.arange(len(x)), codes[:, k]] + (part * part).sum(axis=1)
        at += book.shape[1]
    return codes, error


def _moved(state: DataFrame, bounds: list[int]) -> DataFrame:
    """``part, entry, n, s0, s1, ...``: what the parts that changed bring (+) and take (-), a row for each entry met."""
    width = max(b - a for a, b in zip(bounds, bounds[1:], strict=False))
    each = F.explode(F.sequence(F.lit(0), F.lit(len(bounds) - 2))).alias("part")
    rows = state.where("changed").select("x", "was", "code", each)
    rows = rows.select("x", "part", F.get("was", F.col("part")).alias("was"), F.get("code", F.col("part")).alias("code")).where("was <> code")
    both = F.explode(F.array(F.struct(F.col("code").alias("entry"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("entry"), F.lit(-1).alias("sign")))).alias("move")
    first = F.get(F.lit(bounds[:-1]), F.col("part"))
    long = F.get(F.lit([b - a for a, b in zip(bounds, bounds[1:], strict=False)]), F.col("part"))
    values = [F.when(F.lit(i) < long, F.get("x", first + i)).otherwise(0).alias(f"x{i}") for i in range(width)]
    rows = rows.select("part", both, *values).where("move.entry >= 0")
    sums = [F.sum(F.col("move.sign") * F.col(f"x{i}")).alias(f"s{i}") for i in range(width)]
    return rows.groupBy("part", F.col("move.entry").alias("entry")).agg(F.sum("move.sign").cast("long").alias("n"), *sums)


def lloyd_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """``<id_col>, <label_col>, code (array of int), error (long)`` of every usable row, and the codebooks by part.

    Components are floor(scale * x). A part's codebook starts as that part of the ``entries`` rows of smallest id (of one id,
    the smallest vector; null ids last) and has fewer entries if there are fewer rows. A round assigns all parts to their nearest
    entries, ties to the lower index, and replaces each entry that has parts by the componentwise floor of their mean. After
    ``rounds`` of them the parts are assigned once more; ``error`` is the sum of their squared distances. Repeated rows count
    each, null labels and ids stay; for rows left out see ``integer_vectors``. Without usable rows the result is empty and the
    codebooks too. Components beyond 2^27 in magnitude after scaling are an error, since sums of squares would overflow.
    """
    spark = vectors.sparkSession
    let_workers_import(spark)
    rows = integer_vectors(vectors, vector_col, scale, id=id_col, label=label_col)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    state = rows.withColumns({"was": F.array_repeat(F.lit(-1), parts), "code": F.array_repeat(F.lit(-1), parts), "changed": F.lit(True)})
    path = fresh_path(spark, "codes")
    state.write.parquet(path)
    state = spark.read.schema(state.schema).parquet(path)
    n = about(state)
    named = [F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"]
    if not n.n:
        return state.withColumn("error", F.lit(0).cast("long")).select(*named), []
    if n.m > LARGEST:
        raise ValueError(f"components reach {n.m} after scaling; the largest that distances are exact for is {LARGEST}")
    bounds, dim, most = cuts(n.d, parts), n.d, n.m
    firsts = state.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).toArrow()
    seed = matrix(firsts.column("x"), dim).astype(np.int64)
    books = [seed[:, a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def assigned(state: DataFrame, books: list[np.ndarray], final: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                for s in range(0, batch.num_rows, 4096):
                    one = batch.slice(s, 4096)
                    codes, error = assign(matrix(one.column("x"), dim).astype(np.int64), books, most)
                    as_list = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
                    if final:
                        yield pa.RecordBatch.from_arrays([one.column("id"), one.column("label"), as_list, pa.array(error)], ["id", "label", "code", "error"])
                    else:
                        was = one.column("code")
                        changed = (matrix(was, parts) != codes).any(axis=1)
                        yield pa.RecordBatch.from_arrays([one.column("id"), one.column("label"), one.column("x"), was, as_list, pa.array(changed)], ["id", "label", "x", "was", "code", "changed"])

        if final:
            return state.select("id", "label", "x").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long")
        return state.select("id", "label", "x", "code").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, x array<long>, was array<int>, code array<int>, changed boolean")

    sums = None
    for _ in range(rounds):
        new = fresh_path(spark, "codes")
        assigned(state, books, False).write.parquet(new)
        delete(spark, path)
        path, state = new, spark.read.schema(state.schema).parquet(new)
        moved = _moved(state, bounds)
        if sums is not None:
            moved = sums.unionByName(moved).groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in moved.columns[2:]))
        sums = materialize(moved.coalesce(1), "sums")  # parts x entries rows
        for r in sums.where("n > 0").collect():
            width = bounds[r.part + 1] - bounds[r.part]
            books[r.part] = books[r.part].copy()
            books[r.part][r.entry] = [s // r.n for s in r[3 : 3 + width]]
    return assigned(state, books, True).select(*named), books


def label_errors(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """``codes`` with ``label_error``: ``error`` summed over the rows of the same label, nulls together."""
    codes = materialize(codes.withColumn("_same", F.struct(label_col)), "coded")
    sums = materialize(codes.groupBy("_same").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows")), "label_sums")
    return join_hot(codes, sums, "_same", "_rows", codes.count()).drop("_same", "_rows")
