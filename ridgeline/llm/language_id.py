"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become code points in NumPy; letters are lower-cased, all else counts as one blank. N-grams of 1 to 3 characters
are hashed to 2**16 buckets. A text's features are tf * idf, scaled to a fixed sum, so its class scores are sums of
per-bucket values over its characters and need no per-text sorting.

Document frequencies come from every training row. The weights are fitted on the driver with follow-the-regularised-
leader under an elastic-net penalty, on a sample of bounded size (``sample`` rows, equal shares per language, chosen by
hash of the id), and a temperature is fitted on the part of the sample that training left out.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm import kernels as K
from ridgeline.llm.shared import let_workers_import

DIM, ORDERS, SCALE, UNKNOWN = 1 << 16, 3, 40.0, "und"
_fold: dict[str, np.ndarray] = {}


def _letter_table() -> np.ndarray:
    """For each code point below 2**16 its lower-case letter, or a blank."""
    if "table" not in _fold:
        table = np.full(1 << 16, 32, np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _fold["table"] = table
    return _fold["table"]


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of texts laid end to end (a blank for every non-letter) and each text's place among them."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    b0, b1, b2, b3 = b[at], b[at + 1] & 63, b[at + 2] & 63, b[at + 3] & 63
    point = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)))
    out = _letter_table()[np.minimum(point, 0xFFFF)]
    high = np.flatnonzero(point > 0xFFFF)
    if len(high):
        kinds, back = np.unique(point[high], return_inverse=True)
        out[high] = np.array([int(p) if p < 0x110000 and chr(int(p)).isalpha() else 32 for p in kinds], np.uint32)[back]
    return out, np.searchsorted(at, offsets)


def grams(points: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of the n-gram that begins at each character, and whether there is one: it must hold a
    letter at its start or end and not run over the end of its text."""
    n = len(points)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # characters to the end of the text
    letter = points != 32
    out = []
    h = np.zeros(n, np.uint32)
    for order in range(1, ORDERS + 1):
        shifted, edge = np.zeros(n, np.uint32), np.zeros(n, bool)
        shifted[: n - order + 1] = points[order - 1 :]
        edge[: n - order + 1] = letter[order - 1 :]
        h = h * np.uint32(0x01000193) ^ (shifted * np.uint32(0x9E3779B1))
        bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(order * 0x3C6EF372)) >> np.uint32(16)
        out.append((bucket.astype(np.int64), (left >= order) & (letter | edge)))
    return out


def _text_grams(grams_, a, b) -> np.ndarray:
    return np.concatenate([bucket[a:b][ok[a:b]] for bucket, ok in grams_])


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIM x languages
    bias: np.ndarray
    temperature: float


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows, and the number of texts. Dense blocks, summed in two steps."""
    parts = 64

    def count(batches):
        df, n = np.zeros(DIM, np.int64), 0
        seen = np.zeros(DIM, bool)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(0))
            for _, _, part, off in K.slices(data, offsets):
                points, first = letters(part, off)
                found = grams(points, first)
                for a, b in zip(first[:-1], first[1:], strict=True):
                    seen[:] = False
                    seen[_text_grams(found, a, b)] = True
                    df += seen
                n += len(off) - 1
        lane = int(np.random.default_rng().integers(parts))
        blocks = df.reshape(parts, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(parts + 1)), pa.array(np.full(parts + 1, lane)), pa.array([*(x.tobytes() for x in blocks), np.array([n]).tobytes()], pa.binary())],
            ["block", "lane", "counts"],
        )

    def add(key, table):
        total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"block": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    lanes = docs.mapInArrow(count, "block long, lane long, counts binary").groupBy("block", "lane").applyInArrow(add, "block long, counts binary")
    rows = lanes.groupBy("block").applyInArrow(add, "block long, counts binary").collect()  # parts + 1 rows of fixed size
    df, n = np.zeros((parts, DIM // parts), np.int64), 0
    for r in rows:
        if r.block < parts:
            df[r.block] = np.frombuffer(r.counts, np.int64)
        else:
            n = int(np.frombuffer(r.counts, np.int64)[0])
    return df.ravel(), n


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha=0.5, beta=1.0, l1=1e-3, l2=1e-3, epochs=6, batch=32, seed=1):
    """Follow the regularised leader (proximal), minibatches, softmax loss. Returns weights and bias; l1 makes exact zeros."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            cols = np.concatenate([np.append(rows[k][0], DIM) for k in pick])
            vals = np.concatenate([np.append(rows[k][1], 1.0) for k in pick])
            row = np.repeat(np.arange(len(pick)), [len(rows[k][0]) + 1 for k in pick])
            used, back = np.unique(cols, return_inverse=True)
            w = weights(used)
            logits = np.stack([np.bincount(row, vals * w[back, c], len(pick)) for c in range(classes)], axis=1)
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            g = np.stack([np.bincount(back, vals * p[row, c], len(used)) for c in range(classes)], axis=1) / len(pick)
            step = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - step * w
            n[used] += g * g
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, on a fixed grid of factors; 1 without rows."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))

    def loss(t):
        s = logits / t
        m = s.max(axis=1, keepdims=True)
        return (np.log(np.exp(s - m).sum(axis=1)) + m[:, 0] - s[np.arange(len(y)), y]).mean()

    return float(min(grid, key=loss))


def fit(train: DataFrame, sample: int = 2400) -> Model | None:
    """Fit on ``train(doc_id, text, lang)``; rows without a language are left out. None if no row is left.

    ``sample`` bounds the rows that reach the driver, in equal shares per language (at least 8 each). The rows of a
    language are cut by a hash of the id that lets about twice its share through, so no task sees a language's rows;
    of those the ones with the smallest hashes count. Of rows that repeat an id and language one counts: the one with
    the smallest n-grams.
    """
    train = train.where("lang is not null")
    sizes = {r.lang: r.n for r in train.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return None
    df, n = document_frequencies(train.select(F.coalesce("text", F.lit("")).alias("text")))
    idf = np.log((1 + n) / (1 + df)) + 1.0
    share = max(8, sample // len(languages))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    cut = F.lit(None).cast("double")
    for lang, n in sizes.items():
        cut = F.when(F.col("lang") == lang, F.lit((2 * share + 50) / max(1, n))).otherwise(cut)
    near = train.where("doc_id is not null").where(order / F.lit(2.0**64) + 0.5 < cut).select("doc_id", "lang", order.alias("h")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))  # about 2 * share + 50 rows each
    picked = near.withColumn("place", place).where(F.col("place") <= share).select("doc_id", "lang")
    held = train.join(F.broadcast(picked), ["doc_id", "lang"])  # at most ``sample`` ids, or 8 a language

    def sparse(batches):
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for i, j, part, off in K.slices(data, offsets):
                points, first = letters(part, off)
                found = grams(points, first)
                cells = [np.unique(_text_grams(found, a, b), return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("lang").slice(i, j - i), pa.array([c.astype(np.int32).tobytes() for c, _ in cells], pa.binary()), pa.array([v.astype(np.int32).tobytes() for _, v in cells], pa.binary())],
                    ["doc_id", "lang", "cells", "counts"],
                )

    each = held.select("doc_id", "text", "lang").mapInArrow(sparse, "doc_id long, lang string, cells binary, counts binary")
    one = each.groupBy("doc_id", "lang").agg(F.min(F.struct("cells", "counts")).alias("x")).select("lang", "x.cells", "x.counts")
    got = one.collect()  # at most as many rows as ids were picked
    rows, y = [], []
    for r in sorted(got, key=lambda r: (r.lang, r.cells, r.counts)):
        cells = np.frombuffer(r.cells, np.int32)
        if len(cells):
            v = np.frombuffer(r.counts, np.int32) * idf[cells]
            rows.append((cells, v * (SCALE / v.sum())))
            y.append(languages.index(r.lang))
    y = np.array(y, np.int64)
    if not len(y):
        return None
    kept_out = np.arange(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    fit_on = np.flatnonzero(~kept_out)
    w, bias = ftrl([rows[k] for k in fit_on], y[fit_on], len(languages))
    check = np.flatnonzero(kept_out)
    logits = np.array([rows[k][1] @ w[rows[k][0]] + bias for k in check]).reshape(len(check), len(languages))
    return Model(languages, idf, w, bias, _temperature(logits, y[check]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the ``carry`` columns, ``lang_pred`` and ``score`` (calibrated probability) for every row of ``docs``.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned. Whole
    texts count, whatever their length.
    """
    let_workers_import(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 buckets x languages: fixed by the label set
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *carry)
    fields = [f for f in held.schema.fields if f.name != "text"]

    def emit(batches):
        m = shared.value
        table = None if m is None else np.concatenate((m.weights * m.idf[:, None], m.idf[:, None]), axis=1)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for i, j, part, off in K.slices(data, offsets):
                names, score = [UNKNOWN] * (j - i), np.zeros(j - i)
                if m is not None and len(part):
                    points, first = letters(part, off)
                    full = np.flatnonzero(first[1:] > first[:-1])
                    total = np.zeros((j - i, table.shape[1]))
                    for bucket, ok in grams(points, first):
                        cell = table[bucket]
                        cell[~ok] = 0
                        total[full] += np.add.reduceat(cell, first[full], axis=0)
                    known = np.zeros(j - i, bool)
                    known[full] = np.logical_or.reduceat(points != 32, first[full])
                    logits = (total[:, :-1] * (SCALE / np.maximum(total[:, -1:], 1e-300)) + m.bias) / m.temperature
                    p = np.exp(logits - logits.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    names = [m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    score = np.where(known, p[np.arange(j - i), best], 0.0)
                cols = [batch.column(f.name).slice(i, j - i) for f in fields]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names, pa.string()), pa.array(score)], [*(f.name for f in fields), "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return held.mapInArrow(emit, f"{schema}, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def identify(docs: DataFrame, held: Column, sample: int = 2400) -> DataFrame:
    """Learn from the rows of ``docs(doc_id, text, lang)`` outside ``held`` and predict all: ``doc_id, held_out,
    lang_pred, score``. An empty table gives an empty result; only ids and texts reach a prediction."""
    model = fit(docs.where(~held).select("doc_id", "text", "lang"), sample)
    return predict(docs.withColumn("held_out", held), model, carry=("held_out",)).select("doc_id", "held_out", "lang_pred", "score")
