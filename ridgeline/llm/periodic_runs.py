"""Runs of words that repeat with a period, and texts with every repetition but the first taken out.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least ``least`` words
and ``times`` periods, which no neighbouring word extends keeping the period. They are found by harmonic grid probing:
a run of period p and three periods or more covers two neighbouring pairs of the grid (jp, (j+1)p), so for every p only
those pairs are tested, n/p of them, n log n in all. Grid points inside a run found before, whose period divides p, are
skipped, since they lead to that run again. What survives is extended by comparing chunks of growing length, all
survivors at once, and only the first grid point of a stretch to its ends.

Documents are taken a slice at a time: their words, as numbers that are equal where the words are, lie end to end with
a number of its own after each document, so no run crosses from one into the next. A longer document is a slice of its
own. Nothing is shuffled; the work of a document hangs on its own words only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import kernels as K
from ridgeline.llm.shared import let_workers_import

#: Words of a run, and periods of a run, at least. The grid finds runs of three periods and more.
LEAST, TIMES = 24, 3
#: Grid pairs probed at once, and words compared at once when survivors are extended.
PROBES, CHUNK, GATHER = 1 << 19, 16, 1 << 20
RUN = "struct<start:long,length:long,period:long>"


def matches(w: np.ndarray, a: np.ndarray, b: np.ndarray, step: int, most: np.ndarray | None = None) -> np.ndarray:
    """How many words are equal going from ``a`` and ``b`` by ``step`` (1 or -1), ``most`` at most.

    ``w`` begins and ends with numbers that occur nowhere else, so every comparison ends inside it. Chunks grow fourfold,
    so survivors that end early cost little and long ones few rounds.
    """
    got, live, chunk = np.zeros(len(a), np.int64), np.arange(len(a)), CHUNK
    while len(live):
        ended = np.zeros(len(live), bool)
        rows = max(1, GATHER // chunk)
        reach = step * np.arange(chunk)
        for s in range(0, len(live), rows):
            i = live[s : s + rows]
            x = np.clip((a[i] + step * got[i])[:, None] + reach, 0, len(w) - 1)
            y = np.clip((b[i] + step * got[i])[:, None] + reach, 0, len(w) - 1)
            differ = w[x] != w[y]
            first = np.where(differ.any(axis=1), differ.argmax(axis=1), chunk)
            got[i] += first
            ended[s : s + rows] = first < chunk
        if most is not None:
            ended |= got[live] >= most[live]
        live = live[~ended]
        chunk = min(4 * chunk, 1 << 16)
    return got if most is None else np.minimum(got, most)


def _known(key: np.ndarray, n: int, low: int, high: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of the sorted triples ``key`` = p * n + first point, low <= p < high, lie in a run whose period divides p."""
    most = np.minimum(high - 1, (end - start) // 3)
    k0, k1 = -(-low // period), most // period
    many = np.maximum(0, k1 - k0 + 1)
    run = np.repeat(np.arange(len(start)), many)
    p = period[run] * (k0[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many))
    lo = np.searchsorted(key, p * n + start[run])
    hi = np.searchsorted(key, p * n + end[run] - 2 * p - 1, "right")
    cover = np.zeros(len(key) + 1, np.int64)
    some = lo < hi
    np.add.at(cover, lo[some], 1)
    np.add.at(cover, hi[some], -1)
    return np.cumsum(cover[:-1]) > 0


def word_runs(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs of ``words`` in order of start and period; no run is over ``longest`` words."""
    if times < 3:
        raise ValueError("the grid finds runs of three periods or more")
    n = len(words)
    low_sentinel = int(words.min(initial=0)) - 1
    w = np.concatenate(([low_sentinel], words, [low_sentinel - 1])).astype(np.int64)
    n_w = len(w)
    start = end = period = np.zeros(0, np.int64)
    p, last = 1, longest // times if longest >= least else 0
    while p <= last:
        high, total = p + 1, (n - 1) // p
        while high <= last and high < 2 * p and total + (n - 1) // high <= PROBES:
            total += (n - 1) // high
            high += 1
        ps = np.arange(p, high)
        many = (n - 1) // ps
        each = np.repeat(ps, many)
        j = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        x = 1 + j * each
        same = w[x] == w[x + each]
        both = np.flatnonzero(same[:-1] & same[1:] & (each[:-1] == each[1:]))
        x, q = x[both], each[both]
        if len(x) and len(start):
            wide = end - start >= times * p
            fresh = ~_known(q * n_w + x, n_w, p, high, start[wide], end[wide], period[wide])
            x, q = x[fresh], q[fresh]
        # A triple counts if the words from its first to its second point equal those one period on. Such neighbours on the
        # grid lie in one stretch, so only the first of a chain of them is extended to both sides.
        whole = matches(w, x, x + q, 1, q + 1) > q
        x, q = x[whole], q[whole]
        head = np.ones(len(x), bool)
        head[1:] = (q[1:] != q[:-1]) | (x[1:] - x[:-1] != q[1:])
        x, q = x[head], q[head]
        s, e = x - matches(w, x - 1, x + q - 1, -1), x + q + matches(w, x, x + q, 1)
        good = e - s >= np.maximum(least, times * q)
        start, end, period = (np.concatenate(z) for z in ((start, s[good]), (end, e[good]), (period, q[good])))
        p = high
    order = np.lexsort((period, start))
    return start[order] - 1, end[order] - 1, period[order]


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal where the bytes are."""
    lengths = ends - starts
    to = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(to[-1]) + np.repeat(starts - to[:-1], lengths)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data[at])])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray) -> pa.Array:
    """The kept words of each document joined by one space."""
    lengths = np.where(keep, ends - starts + 1, 0)
    to = np.concatenate(([0], np.cumsum(lengths)))
    at = np.arange(to[-1]) + np.repeat(np.where(keep, starts - to[:-1], 0), lengths)
    out = data[np.minimum(at, max(0, len(data) - 1))] if len(at) else np.zeros(0, np.uint8)
    closing = to[1:][keep] - 1
    out[closing] = 32
    bounds = to[first]
    some = bounds[1:] > bounds[:-1]
    drop = np.zeros(len(out), bool)
    drop[bounds[1:][some] - 1] = True  # the space after a document's last word
    sizes = bounds[1:] - bounds[:-1] - some
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(out[~drop]))


def _slice_runs(data: np.ndarray, offsets: np.ndarray, least: int, times: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    starts, ends, first = K.spans(data, offsets)
    n_docs, counts = len(offsets) - 1, np.diff(first)
    numbers = _numbers(data, starts, ends)
    doc_of = np.repeat(np.arange(n_docs), counts)
    apart = np.empty(len(numbers) + n_docs, np.int64)
    apart[np.arange(len(numbers)) + doc_of] = numbers
    apart[first[1:] + np.arange(n_docs)] = -1 - np.arange(n_docs)
    s, e, q = word_runs(apart, int(counts.max(initial=0)), least, times)
    doc = np.searchsorted(first[1:] + np.arange(n_docs), s, "right")  # the number after a document stands at its end
    s, e = s - doc, e - doc  # words of the slice
    gone = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(gone, s + q, 1)
    np.add.at(gone, e, -1)
    text = _collapsed(data, starts, ends, np.cumsum(gone[:-1]) == 0, first)
    runs = pa.StructArray.from_arrays([pa.array(v) for v in (s - first[doc], e - s, q)], ["start", "length", "period"])
    per_doc = pa.array(np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32))
    return counts, pa.ListArray.from_arrays(per_doc, runs), text


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``<id_col>, n_words, runs, collapsed``: one row for each row of ``docs``, repeated and null ids included.

    ``runs`` is an array of ``start, length, period`` in words, in order of start and period; ``collapsed`` has the words
    that no run contains after its first period, joined by one space. Words are runs of characters other than space and
    the five controls from tab to carriage return. A null or empty text has no words, no runs and an empty collapsed text.
    Other columns of ``docs`` are not read. An empty table gives an empty result.
    """
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            for i, j, part, bounds in K.slices(data, offsets):
                counts, runs, text = _slice_runs(part, bounds, least, times)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(counts.astype(np.int64)), runs, text.cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, of equal ones the first in the array; null of an empty array."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def looped(doc_id: Column, text: Column) -> Column:
    """``text``, with a loop written into every tenth document by crc32 of its id: known runs to be found.

    With h the checksum and g = floor(h / 10), where h % 10 = 0 the words from a = g % n on repeat the p words at a,
    p = 1 + floor((n - a) / (3 + g % 8)). Others, and texts without words, stay as they are. A null id counts as empty text.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")

    def loop(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda x, i: F.when(i < a, x).otherwise(F.get(words, (a + F.pmod(i - a, p)).cast("int")))), " ")

    # The words go through an array of one, so that they are split once and not again for every word.
    once = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, loop(w))), F.lit(0))
    return F.when(h % 10 == 0, F.coalesce(once, text)).otherwise(text)
