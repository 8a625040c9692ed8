"""Quality classification with hierarchical empirical Bayes over sites.

A document's own evidence is a logistic model on its layout, repetition and words: what its words say is their mean
log odds between good and bad labelled texts, by hashed word, which a text of the sample takes from the half of the
sample that it isn't in. Every text is featurised once, into one number; all that follows works on narrow rows.

Grouped aggregation (with map-side partial sums, so a host with a third of all rows costs its reducer a few partial
rows) gives every site the number of documents and the sum of their probabilities, labelled documents with their label
instead. Sites are levels, each within the one before: global prior -> host -> path -> deeper paths. Each level's rate is
shrunk toward the level above by a strength estimated from the spread between its sites, so a site with few documents
says little. A document's odds are then its own odds times its site's odds over the global odds; its own contribution
to its sites is taken out first.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import kernels as K
from ridgeline.llm.shared import let_workers_import, materialize, with_row_key

SURFACE, WORDS = 16, 1 << 14
FEATURES = SURFACE + 1
#: Site tables of up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Up to this many keys of rejected rows (8 MB) are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:?'\"-"]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``SURFACE`` numbers per text; all zero for a text without words."""
    n = len(offsets) - 1
    starts, ends, first = K.spans(data, offsets)
    out = np.zeros((n, SURFACE))
    full = np.flatnonzero(first[1:] > first[:-1])
    if not len(full):
        return out
    h = K.span_hashes(data, starts, ends)

    def per_word(mask):
        run = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return run[ends] - run[starts]

    size = (ends - starts).astype(float)
    upper, alpha, digit, mark = per_word(_UPPER[data]), per_word(_ALPHA[data]), per_word(_DIGIT[data]), per_word(_END[data])
    sign = size - alpha - digit - mark
    repeat = np.zeros(len(h))
    repeat[1:] = h[1:] == h[:-1]
    repeat[first[:-1][first[:-1] < len(h)]] = 0
    loud = (upper >= 2) & (upper >= alpha - 1)
    bare = (alpha == 0) & (digit == 0)
    words = np.diff(first)[full].astype(float)

    def mean(x):
        return np.add.reduceat(np.asarray(x, float), first[full]) / words

    distinct, top = np.zeros(len(full)), np.zeros(len(full))
    for k, t in enumerate(full):
        _, c = np.unique(h[first[t] : first[t + 1]], return_counts=True)
        distinct[k], top[k] = len(c), c.max()
    chars = mean(size)
    out[full] = np.stack(
        [
            np.ones(len(full)), mean(upper) / chars, mean(digit) / chars, mean(mark) / chars, mean(sign) / chars, mean(sign > 0), mean(loud), mean(bare), mean(repeat),
            np.minimum(mean(repeat) * words, 50) / 50, np.log(words), distinct / np.sqrt(words), top / words, chars / 10, np.minimum(mean(sign > 0) * words, 50) / 50, mean((mark > 0) & (alpha > 0)),
        ],
        axis=1,
    )
    return out


def word_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash cell of every word, and each text's first."""
    starts, ends, first = K.spans(data, offsets)
    return (K.span_hashes(data, starts, ends) & np.uint64(WORDS - 1)).astype(np.int64), first


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    odds: np.ndarray  # log odds of each word cell

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -15, 15)))

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of each text of being good."""
        cells, first = word_cells(data, offsets)
        run = np.concatenate(([0.0], np.cumsum(self.odds[cells])))
        said = (run[first[1:]] - run[first[:-1]]) / np.maximum(1, np.diff(first))
        return self.probability(np.concatenate((features(data, offsets), said[:, None]), axis=1))


def word_odds(cells: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Log odds of each cell between good and bad texts of ``which``, by the share of texts that have it, smoothed."""
    have = np.zeros((2, WORDS))
    for k in np.flatnonzero(which):
        have[int(y[k]), cells[k]] += 1
    n = np.array([[(which & (y == 0)).sum()], [(which & (y == 1)).sum()]])
    share = (have + 1) / (n + 2)
    return np.log(share[1]) - np.log(share[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, ridge: float = 1e-2) -> Model:
    """Fit on at most ``sample`` labelled documents, those with the smallest hashes of the id. Without labels of both
    kinds every document gets the share of good labels (1 if there are none).

    An id labelled twice has the lower label; of rows that repeat an id the text with the smallest hash counts; null ids,
    null labels and labels without a document don't. Only the ids, at most ``sample``, are broadcast, and only those
    documents' features reach the driver. Newton's method on a ridge logistic loss of 17 features.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")

    def emit(batches):
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for i, j, part, off in K.slices(data, offsets):
                cells, first = word_cells(part, off)
                found = [np.unique(cells[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
                x = [row.tobytes() for row in features(part, off)]
                words = [[v.astype(np.int32).tobytes() for v in pair] for pair in found]
                cols = [pa.array(x, pa.binary()), pa.array([w[0] for w in words], pa.binary()), pa.array([w[1] for w in words], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "quality", "h")), *cols], ["doc_id", "quality", "h", "x", "cells", "counts"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known.select(F.col("doc_id").cast("long"), F.col("quality").cast("long"))), "doc_id")
    asked = asked.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    let_workers_import(docs.sparkSession)
    each = asked.select("doc_id", "quality", "h", "text").mapInArrow(emit, "doc_id long, quality long, h long, x binary, cells binary, counts binary")
    rows = each.groupBy("doc_id").agg(F.min(F.struct("h", "quality", "x", "cells", "counts")).alias("r")).select("doc_id", "r.*").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    y = np.array([1.0 if r.quality > 0 else 0.0 for r in rows])
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 1.0
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 15.0 if rate == 1 else -15.0, np.zeros(WORDS))
    cells, counts = ([np.frombuffer(r[c], np.int32) for r in rows] for c in ("cells", "counts"))
    half = np.arange(len(y)) % 2 == 0
    said = np.zeros(len(y))
    for own in (half, ~half):
        odds = word_odds(cells, counts, y, ~own)
        for k in np.flatnonzero(own):
            said[k] = odds[cells[k]] @ counts[k] / max(1, counts[k].sum())
    x = np.concatenate((np.array([np.frombuffer(r.x) for r in rows]), said[:, None]), axis=1)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = np.concatenate(((x - mean) / scale, np.ones((len(x), 1))), axis=1)
    w = np.zeros(FEATURES + 1)
    penalty = np.append(np.full(FEATURES, ridge), 1e-9) * len(y)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -15, 15)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w[:-1], float(w[-1]), word_odds(cells, counts, y, np.ones(len(y), bool)))


def document_evidence(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of ``docs(text, ...)`` and ``p_doc``, the document's own probability of being good."""
    let_workers_import(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    fields = [docs.schema[c] for c in carry]

    def emit(batches):
        m = Model(*shared.value)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for i, j, part, off in K.slices(data, offsets):
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(i, j - i) for f in fields), pa.array(m.judge(part, off))], [*(f.name for f in fields), "p_doc"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text")).mapInArrow(emit, f"{schema}, p_doc double")


def _strength(sites: DataFrame, mu: float) -> float:
    """Prior strength by moments: how many documents the level above counts for, from the spread of the site rates."""
    s = sites.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.lit(mu), 2)).alias("v"), F.count(F.lit(1)).alias("k")).first()
    if not s.n or s.k < 2:
        return 10.0
    within = mu * (1 - mu) * s.k / s.n
    between = max(s.v / s.n - within, 1e-9)
    return float(np.clip(mu * (1 - mu) / between - 1, 1.0, 1e4))


class Sites(NamedTuple):
    table: DataFrame  # _site0 .. _site<k>, and n0, s0 .. n<k>, s<k>: documents and sums of the site at every level
    mu: float
    strengths: list[float]  # by level


def site_levels(levels: int) -> list[str]:
    return [f"_site{k}" for k in range(levels)]


def site_posteriors(evidence: DataFrame, levels: int = 2) -> Sites:
    """Sums of ``evidence(_site0, _site1, ..., said)`` by site at every level, and the global prior; a level counts within
    the levels before it, and null sites are one site."""
    keys = site_levels(levels)
    table = materialize(evidence.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n{levels - 1}"), F.sum("said").alias(f"s{levels - 1}")), "sites")
    deepest, sums = table, []
    for k in range(levels - 1, -1, -1):
        sites = table if k == levels - 1 else deepest.groupBy(*keys[: k + 1]).agg(F.sum(f"n{levels - 1}").alias(f"n{k}"), F.sum(f"s{levels - 1}").alias(f"s{k}"))
        if k < levels - 1:
            on = [F.col(f"t.{c}").eqNullSafe(F.col(f"u.{c}")) for c in keys[: k + 1]]
            table = table.alias("t").join(sites.alias("u"), on).select("t.*", f"u.n{k}", f"u.s{k}")
        sums.insert(0, sites.select(F.col(f"n{k}").alias("n"), F.col(f"s{k}").alias("s")))
    total = sums[0].agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mu = float(np.clip((total.s + 1) / (total.n + 2), 1e-3, 1 - 1e-3)) if total.n else 0.5
    return Sites(table, mu, [_strength(x, mu) for x in sums])


def combined(sites: Sites, own: Column, said: Column) -> tuple[list[Column], Column]:
    """The rate of each level's site, and the document's final probability; ``own`` is its probability by its text,
    ``said`` what it brought to its sites' sums, which is taken out of them."""
    rate, rates = F.lit(sites.mu), []
    for k, strength in enumerate(sites.strengths):
        rate = (F.col(f"s{k}") - said + strength * rate) / (F.col(f"n{k}") - 1 + strength)
        rates.append(rate)
    safe = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = own / (1 - own) * (safe / (1 - safe)) / F.lit(sites.mu / (1 - sites.mu))
    return rates, odds / (1 + odds)


def url_sites(url: Column, levels: int = 3) -> list[Column]:
    """Host, and host with the first, the first two, ... directories of the path, for ``classify(sites=...)``."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))  # the last part is the page
    return [host, *(F.concat_ws("/", host, F.slice(parts, 1, k)) for k in range(1, levels))]


def _judged(docs: DataFrame, labels: DataFrame, sites: list[Column] | None, keep: list[str], threshold: float, sample: int) -> DataFrame:
    """``keep`` columns and verdicts of every row: texts are read once for the fit and once for the evidence."""
    levels = [F.col("source"), F.concat_ws("/", F.col("source"), F.coalesce("lang", F.lit("")))] if sites is None else sites
    keys = site_levels(len(levels))
    model = fit(docs, labels, sample)
    sited = docs.select(*keep, "text", *([] if "doc_id" in keep else ["doc_id"]), *(F.coalesce(c.cast("string"), F.lit("")).alias(k) for c, k in zip(levels, keys, strict=True)))
    narrow = materialize(document_evidence(sited, model, [*dict.fromkeys([*keep, "doc_id"]), *keys]), "evidence")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.min((F.col("quality") > 0).cast("double")).alias("_label"))
    narrow = materialize(narrow.join(known, F.col("doc_id") == F.col("_labelled"), "left").withColumn("said", F.coalesce("_label", "p_doc")).drop("_labelled", "_label"), "said")
    found = site_posteriors(narrow, len(levels))
    table = materialize(found.table, "site-table")
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    rates, quality = combined(found, F.col("p_doc"), F.col("said"))
    rates = [r.alias(name) for r, name in zip(rates, ["host_rate", "path_rate", *(f"path{k}_rate" for k in range(2, len(rates)))], strict=False)]
    return narrow.join(table, keys).select(*keep, "p_doc", *rates, quality.alias("quality"), (quality >= threshold).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, sites: list[Column] | None = None, threshold: float = 0.5, sample: int = 10_000) -> DataFrame:
    """``doc_id, p_doc, host_rate, path_rate, quality, kept`` for every row of ``docs(doc_id, text, ...)``.

    ``sites`` are the levels of its site, coarsest first (``source`` and ``source/lang`` by default, ``url_sites`` where
    there are addresses); a third level and on add ``path2_rate`` and so forth. Rejected are rows whose combined
    probability is below ``threshold``. A null or wordless text has all-zero features and is judged by them and its site; a
    null site is one site. Rows that repeat an id are judged one by one, all with that id's label. An empty table gives an
    empty result; other columns are not read.
    """
    return _judged(docs, labels, sites, ["doc_id"], threshold, sample)


def keep_good(docs: DataFrame, labels: DataFrame, sites: list[Column] | None = None, threshold: float = 0.5, sample: int = 10_000) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their columns as they were. The keys of rejected rows are
    broadcast while they are few, so that no text is shuffled."""
    keyed, key = with_row_key(docs)
    gone = materialize(_judged(keyed, labels, sites, [key], threshold, sample).where("not kept").select(key), "rejected")
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return keyed.join(gone, key, "left_anti").select(*docs.columns)
