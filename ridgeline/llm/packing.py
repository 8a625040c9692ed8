"""Packing documents into sequences of a fixed number of tokens by bin completion.

The packing is decided on the histogram of piece lengths, which has at most ``capacity`` entries whatever the size of
the data, so the driver's search sees every piece of the corpus and no document group is packed apart from the rest.
Bin completion takes the largest length left, enumerates the undominated fillings of the room beside it, and applies
one as often as the counts allow, which uses up a length or all but a remainder of it, so a descent is a few thousand
steps. Branch and bound over fillings and multiplicities prunes by waste and by the lower bound of what is left. The
first incumbent is best-fit decreasing.

Pieces then take their places by rank among the pieces of their length. Ranks come from counts per (length, hash
bucket), so one length that a third of all pieces share is still dealt over many tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm import kernels as K
from ridgeline.llm.shared import materialize
from ridgeline.llm.word_tokens import tokens_from

CAPACITY, END_ID = 4096, 1
#: Nodes whose branches the search holds open, at up to a megabyte each.
OPEN_NODES = 32
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    A document is its ids and then ``end_id``; a null or empty text is ``end_id`` alone. Only documents of more than
    ``capacity`` ids are cut.
    """

    def emit(batches):
        tok = tokens_from(tokenizer_path)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for i, j, part, off in K.slices(data, offsets):
                flat, first = tok.flat_ids(part, off)
                rows: list[tuple] = []
                tokens: list[np.ndarray] = []
                for k in range(i, j):
                    own = np.append(flat[first[k - i] : first[k - i + 1]], np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part_ids = own[s : s + capacity]
                        rows.append((ids[k], p, s, len(part_ids), zlib.crc32(part_ids.tobytes())))
                        if with_ids:
                            tokens.append(part_ids.astype(np.int32))
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    at = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(tokens))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(emit, _PIECES + (", ids array<int>" if with_ids else ""))


def lower_bound(counts: np.ndarray) -> int:
    """Martello and Toth's L2 bound; counts[l] pieces have length l, and the last index is the capacity."""
    c = len(counts) - 1
    n, s = np.cumsum(counts), np.cumsum(counts * np.arange(c + 1))
    half = c // 2
    k = np.arange(half + 1)
    alone, pair, pair_sum = n[c] - n[c - k], n[c - k] - n[half], s[c - k] - s[half]
    rest = s[half] - np.where(k > 0, s[k - 1], 0)
    return int((alone + pair + np.maximum(0, -((pair * c - pair_sum - rest) // c))).max())


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: each piece, longest first, goes where least room is left beside it. Open
    sequences with the same contents are one entry, so a length costs a few steps however often it occurs."""
    top = len(counts) - 1
    rooms = np.zeros(top + 1, bool)  # which amounts of room are left somewhere
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(take: tuple[int, ...], m: int) -> None:
        if m:
            room = top - sum(take)
            open_.setdefault(room, []).append((take, m))
            rooms[room] = True

    for x in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[x])
        while n:
            at = np.flatnonzero(rooms[x:])
            if len(at):
                room = x + int(at[0])
                take, m = open_[room].pop()
                rooms[room] = bool(open_[room])
            else:
                room, take, m = top, (), n
            each = room // x
            full = min(m, n // each)
            put((*take, *[x] * each), full)
            n -= full * each
            if n and full < m:  # the last one takes what is left of this length
                put((*take, *[x] * n), 1)
                n, full = 0, full + 1
            if take:
                put(take, m - full)
    return [p for group in open_.values() for p in group]


def fillings(left: np.ndarray, room: int, slack: int) -> Iterator[tuple[int, ...] | None]:
    """The undominated fillings of ``room`` from the lengths left that waste at most ``slack`` of it: least waste first,
    longest lengths first among these. None stands for a dominated one that was looked at.

    A filling is dominated if some of its pieces could make way for one piece left out that is no shorter than they are
    together and fits: that piece's place is then the better one for them (Martello and Toth's criterion in Korf's
    form). Sets of sums are the bits of an integer, so the search for fillings of a given waste meets no dead end, and
    the test for dominance is a few shifts.
    """
    have = np.flatnonzero(left[: room + 1])[::-1]
    lengths, counts = have.tolist(), left[have].tolist()
    places = (-have).tolist()
    whole = (1 << (room + 1)) - 1
    available = int.from_bytes(np.packbits(left[: room + 1] > 0, bitorder="little").tobytes(), "little")
    reach, full = [1] * (len(lengths) + 1), 0  # reach[i]: the sums that lengths[i:] can make
    for i in range(len(lengths) - 1, -1, -1):
        r, x, n, step = reach[i + 1], lengths[i], min(counts[i], room // lengths[i]), 1
        while n:
            step = min(step, n)
            r |= r << (step * x) & whole
            n, step = n - step, step * 2
        reach[i] = r
        if r == whole:
            full = i
            break
    reach[:full] = [whole] * full

    def exactly(i: int, rest: int) -> Iterator[list[tuple[int, int]]]:
        if not rest:
            yield []
            return
        i = max(i, bisect_left(places, -rest))
        while i < len(lengths) and reach[i] >> rest & 1:
            for k in range(min(counts[i], rest // lengths[i]), 0, -1):
                if reach[i + 1] >> (rest - k * lengths[i]) & 1:
                    for more in exactly(i + 1, rest - k * lengths[i]):
                        yield [(i, k), *more]
            i += 1

    def dominated(uses: list[tuple[int, int]], waste: int) -> bool:
        one, several, outside = 0, 0, available  # sums of one piece, sums of several
        for i, k in uses:
            x = lengths[i]
            if k == counts[i]:
                outside &= ~(1 << x)
            for _ in range(k):
                several |= (several | one) << x
                one |= 1 << x
        spread, width = (several | one | 1) << 1 if waste else 0, 1
        while width < waste:  # the sums raised by 1, 2, ... waste
            step = min(width, waste - width)
            spread |= spread << step
            width += step
        return bool((spread | several) & outside)

    def each() -> Iterator[tuple[int, ...] | None]:
        for waste in range(min(slack, room) + 1):
            if reach[0] >> (room - waste) & 1:
                for uses in exactly(0, room - waste):
                    yield None if dominated(uses, waste) else tuple(lengths[i] for i, k in uses for _ in range(k))

    return each()


def bin_completion(counts: np.ndarray, most_nodes: int = 20_000) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use up the histogram in as few sequences as the search finds.

    A node is the histogram left. A branch fills sequences around the largest length left with one undominated filling,
    as many times as the counts allow or, after all others, any number of times less (then another filling follows).
    It is cut when its waste exceeds what a packing better than the incumbent can afford, when its sequences and the
    lower bound of what is left reach the incumbent, or when its histogram was met before at no more sequences.

    The search ends when it meets the lower bound, when it has seen every branch (its packing is then the best there
    is), or when it has looked at ``most_nodes`` fillings; then the best packing so far stands, every piece placed.
    """
    top = len(counts) - 1
    left = counts.astype(np.int64)
    total = int((left * np.arange(top + 1)).sum())
    best = best_fit(left)
    used, bound = sum(m for _, m in best), lower_bound(left)
    nodes = bins = waste = 0
    path: list[tuple[tuple[int, ...], int]] = []
    met: dict[bytes, int] = {}

    def branches(not_this: tuple[int, ...], skip: int = 0) -> Iterator[tuple[tuple[int, ...], int, bool]]:
        """The branches of the node, after the first ``skip``, which have been looked at before."""
        nonlocal nodes
        a = int(np.flatnonzero(left)[-1])
        here = left.copy()
        here[a] -= 1
        seen = []
        for filling in fillings(here, top - a, (used - 1) * top - total - waste):
            nodes += len(seen) >= skip
            if nodes >= most_nodes:
                return
            if filling is not None and (take := (a, *filling)) != not_this:
                most = min(int(left[x]) // k for x, k in Counter(take).items())
                seen.append((take, most))
                if len(seen) > skip:
                    yield take, most, True
        skip = max(0, skip - len(seen))
        for take, most in seen:
            for m in range(most - 1, 0, -1):
                if skip:
                    skip -= 1
                    continue
                nodes += 1
                if nodes >= most_nodes:
                    return
                yield take, m, False

    def move(take: tuple[int, ...], m: int) -> None:
        nonlocal bins, waste
        for x in take:
            left[x] -= m
        bins += m
        waste += m * (top - sum(take))

    # per node of the path: its branches (of the last few nodes only, for the rest they are found again), how many were
    # taken, and what must not follow
    todo = [[branches(()), 0, ()]] if used > bound else []
    while todo and used > bound and nodes < most_nodes:
        here = todo[-1]
        if here[0] is None:
            here[0] = branches(here[2], here[1])
        step = next(here[0], None)
        if step is None:
            todo.pop()
            if path:
                take, m = path.pop()
                move(take, -m)
            continue
        here[1] += 1
        take, m, all_of_it = step
        move(take, m)
        if waste <= (used - 1) * top - total:
            if not left.any():
                best, used = [*path, (take, m)], bins
            elif bins + lower_bound(left) < used:
                key = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
                if met.get(key, bins + 1) > bins:
                    met[key] = bins
                    path.append((take, m))
                    not_this = () if all_of_it else take
                    todo.append([branches(not_this), 0, not_this])
                    if len(todo) > OPEN_NODES:
                        todo[-1 - OPEN_NODES][0] = None
                    continue
        move(take, -m)
    return best


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``doc_id, piece, length``) plus ``sequence_id`` and ``offset``; every sequence is gapless from 0."""
    histogram = {int(r.length): r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    rows, taken, base = [], Counter(), 0
    for take, m in bin_completion(counts):
        at = 0
        for length in take:
            rows.append((length, taken[length], base, at))
            taken[length] += m
            at += length
        base += m
    rows.sort()
    slots = np.array(rows, np.int64).reshape(-1, 4)
    shared = pieces.sparkSession.sparkContext.broadcast(slots)  # a few rows per length: bounded by the capacity

    buckets = max(256, int(counts.sum() // 20_000))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    ranked = ranked.drop("bucket", "before", "within")
    fields = [f for f in ranked.schema.fields if f.name != "rank"]

    def seat(batches):
        table = shared.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for b in batches:
            rank = b.column("rank").to_numpy()
            k = np.searchsorted(keys, (b.column("length").to_numpy() << 44) + rank, "right") - 1
            cols = [b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(table[k, 2] + rank - table[k, 1]), pa.array(table[k, 3])], [*(f.name for f in fields), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ranked.mapInArrow(seat, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where every piece of every document goes: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Rows that repeat an id are packed as documents of their own; a null id stays null. An empty table gives an empty
    result. Other columns of ``docs`` are not read.
    """
    pieces = materialize(cut_documents(docs, tokenizer_path, capacity, end_id, False, id_col, text_col), "pieces")
    out = place(pieces, capacity)
    return out.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` of at most ``capacity`` tokens each."""
    placed = place(materialize(cut_documents(docs, tokenizer_path, capacity, end_id, True), "pieces"), capacity)
    return placed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
