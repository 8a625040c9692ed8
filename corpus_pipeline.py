"""From raw documents to packed training sequences: quality, exact and near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the last return the
columns of ``documents``. Stages read their input more than once, so it should be a written table, as in ``run``.
Rows are known by their place in it: ids may be null or repeat. Extra columns of ``docs`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.exact_dedup import exact_dedup
from ridgeline.llm.minhash import near_dedup
from ridgeline.llm.packing import pack
from ridgeline.llm.quality import keep_good
from ridgeline.llm.shared import delete, materialize, recorded, scan, with_row_key
from ridgeline.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Up to this many keys of dropped rows (8 MB) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: The trained stages and the hashed candidates have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def _without_copies(docs: DataFrame, find: Callable[..., DataFrame], group: str) -> DataFrame:
    """One row of each group that ``find`` puts the rows of ``docs`` in: the one with the smallest id (null first).

    ``find`` sees a key of the row instead of its id, so rows that repeat an id or have none are told apart.
    """
    keyed, key = with_row_key(docs.select(*COLUMNS))
    found = find(keyed, id_col=key).select(key, F.col(group).alias("_group"))
    found = materialize(found.join(keyed.select(key, "doc_id"), key), "groups")
    first = found.groupBy("_group").agg(F.min(F.struct("doc_id", key)).alias("_first")).select(F.col("_first")[key].alias(key))
    gone = materialize(found.select(key).join(first, key, "left_anti"), "gone")
    if gone.count() <= BROADCAST_IDS:  # then no text is shuffled
        gone = F.broadcast(gone)
    return keyed.join(gone, key, "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Null and wordless texts are judged by their site alone; rows that repeat an
    id are judged one by one, all with that id's label."""
    return keep_good(docs.select(*COLUMNS), scan(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text but for white space; null and empty texts are one. The smallest id stays, of repeated rows one."""
    return _without_copies(docs, exact_dedup, "keep_id")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents that are linked by near-equal texts; texts without words are linked with nothing."""
    return _without_copies(docs, near_dedup, "component_id")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand anywhere else too. One whose passages all go stays as an empty text;
    untouched null texts stay null; rows that repeat an id and text repeat each other, so nothing of both stays."""
    cut = remove_repeats(docs.select(*COLUMNS), carry=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences, as ``packing.pack``: a null or empty text is its end token alone, repeated
    rows have each their own pieces."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", passages), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. Each stage's rows are written in the shared folder and read again by the next; what it
    wrote on its way, and its input, goes as soon as they are. The last stage's result still reads its own."""
    docs, before = scan(spark, sf_dir, "documents").select(*COLUMNS), []
    for name, stage in STAGES[:-1]:
        with recorded() as own:
            out = stage(spark, docs, sf_dir)
        with recorded() as written:
            docs = materialize(out, name)
        for path in [*own, *before]:
            delete(spark, path)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
