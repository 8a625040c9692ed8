"""Encoding and decoding with a SentencePiece BPE model, with seeded merge dropout.

Encoding merges the best-scored adjacent pair again and again, the leftmost of equals, as the agenda of the library
does. With dropout each candidate merge (its place in the word, the border between its parts, the piece it makes) is
skipped if a hash keyed by seed, variant and word falls below the rate; a skipped candidate stays out of the agenda.
Every occurrence of a word has a key of its own, from seed, document and place, so segmentations vary from place to
place, yet any rerun gives the same. With ``variants``, a power of two, words too short to have more segmentations than
that share so many keys, which saves time. Decoding gives back the text whatever was skipped.

No piece holds a blank after another sign, so words (with the blanks before them) are encoded apart; the constructor
checks that of the model. The distinct words and variants of a slice run their agendas side by side in NumPy, one merge
a round; words of over 48 characters run an agenda of their own on a heap.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import kernels as K
from ridgeline.llm.ppm import Hashed
from ridgeline.llm.shared import let_workers_import

BLANK, LONG = "▁", 48
_U = np.uint64
_NONE, _LAST = np.int64(1 << 40), np.int32(2**31 - 1)


class Pieces:
    """The tables of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        if any(BLANK in t.lstrip(BLANK) for t in text.values()):
            raise ValueError("a piece holds a blank after another sign")
        self.of = {t: i for i, t in text.items()}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        scores = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        rank = {i: scores[model.get_score(i)] for i in plain}
        pairs = {}
        for i, t in text.items():
            for cut in range(1, len(t)):
                left, right = self.of.get(t[:cut]), self.of.get(t[cut:])
                if left is not None and right is not None:
                    pairs[left * n + right] = (rank[i], i)
        keys = np.array(list(pairs), np.uint64)
        self.pairs = Hashed(keys)
        self.ranks = np.array([r for r, _ in pairs.values()], np.int64)
        self.made = np.array([i for _, i in pairs.values()], np.int64)
        self.by_pair = pairs
        #: Characters without a piece are symbols from ``size`` on and come out as bytes.
        self.char = np.arange(1 << 16, dtype=np.int64) + n
        self.high: dict[int, int] = {}
        for t, i in self.of.items():
            if len(t) == 1:
                if ord(t) < 1 << 16:
                    self.char[ord(t)] = i
                else:
                    self.high[ord(t)] = i
        self.char[32] = self.of[BLANK]
        spelled = [b""] * n
        for i, t in text.items():
            spelled[i] = t.replace(BLANK, " ").encode()
        for b in range(256):
            spelled[self.byte_ids[b]] = bytes([b])
        self.spelled_len = np.array([len(s) for s in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_len) - self.spelled_len
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def symbol(self, points: np.ndarray) -> np.ndarray:
        out = self.char[np.minimum(points, 0xFFFF)]
        for k in np.flatnonzero(points > 0xFFFF):
            out[k] = self.high.get(int(points[k]), self.size + int(points[k]))
        # the blank sign itself can't be told from a blank, so it is spelled in bytes
        return np.where(points == ord(BLANK), self.size + ord(BLANK), out)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (left < self.size) & (right < self.size)
        row = self.pairs.find(np.where(ok, left * self.size + right, 0).astype(np.uint64))
        hit = ok & (row >= 0)
        return np.where(hit, self.ranks[row], _NONE), np.where(hit, self.made[row], -1)

    def spell_unknown(self, symbol: int) -> np.ndarray:
        return self.byte_ids[np.frombuffer(chr(symbol - self.size).encode("utf-8", "surrogatepass"), np.uint8)]


def _skipped(key, start, border, piece, most: int) -> np.ndarray:
    """Whether candidates are dropped: a keyed hash of their places and piece lies below ``most``."""
    h = key ^ (np.asarray(start).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + np.asarray(border).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + np.asarray(piece).astype(np.uint64) * _U(0x165667B19E3779F9))
    return (K.mix(h) >> _U(11)) < _U(most)


def encode_alone(p: Pieces, symbols: np.ndarray, key: int, most: int) -> list[int]:
    """One word's agenda on a heap: candidates by (rank, place), each looked at once."""
    n = len(symbols)
    sym, nxt, prev = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int, int]] = []

    def offer(a):
        b = nxt[a] if 0 <= a < n else n
        if a < 0 or b >= n:
            return
        found = p.by_pair.get(sym[a] * p.size + sym[b]) if sym[a] < p.size and sym[b] < p.size else None
        if found:
            heapq.heappush(agenda, (found[0], a, b, nxt[b], found[1]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    keys = np.array([key], np.uint64)
    while agenda:
        _, a, b, end, piece = heapq.heappop(agenda)
        if not (alive[a] and alive[b]) or nxt[a] != b or nxt[b] != end:
            continue
        if most and _skipped(keys, [a], [b], [piece], most)[0]:
            continue
        sym[a], alive[b], nxt[a] = piece, False, end
        if end < n:
            prev[end] = a
        offer(prev[a])
        offer(a)
    out = []
    i = 0
    while i < n:
        out.append(sym[i])
        i = nxt[i]
    return out


def encode_words(p: Pieces, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of many words laid end to end, and how many each has; one merge a word and round."""
    words = len(lengths)
    at = np.cumsum(lengths) - lengths
    counts = np.zeros(words, np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, their counts, padded symbols
    for lo, hi in ((1, 4), (5, 7), (8, 10), (11, 14), (15, 20), (21, 30), (31, LONG)):
        which = np.flatnonzero((lengths >= lo) & (lengths <= hi))
        for s in range(0, len(which), 1 << 14):
            rows = which[s : s + (1 << 14)]
            wide = hi
            col = np.arange(wide)
            size = lengths[rows].copy()
            inside = col[None, :] < size[:, None]
            # One number a symbol: itself, what it makes with the next one (plus 1), and its place in the word.
            cell = np.where(inside, symbols[np.minimum(at[rows][:, None] + col, len(symbols) - 1)], 0) << 32 | col
            rank = np.full(cell.shape, _LAST, np.int32)
            own, place = keys[rows], np.arange(len(rows))
            final = np.zeros(cell.shape, np.int64)

            def offer(r, c):
                ok = (c >= 0) & (c + 1 < size[r])
                gone = ~ok & (c >= 0)
                rank[r[gone], c[gone]] = _LAST
                r, c = r[ok], c[ok]
                x, y = cell[r, c], cell[r, c + 1]
                k, m = p.pair(x >> 32, y >> 32)
                if most:
                    k = np.where((m >= 0) & _skipped(own[r], x & 1023, y & 1023, m, most), _NONE, k)
                rank[r, c] = np.minimum(k, _LAST)
                cell[r, c] = x >> 32 << 32 | (m + 1) << 10 | x & 1023

            offer(*np.nonzero(inside))
            counts[rows] = size
            while len(place):
                best = rank.argmin(axis=1)
                line = np.arange(len(place))
                ok = rank[line, best] < _LAST
                if not ok.all():  # words without a candidate are done
                    final[place[~ok]], counts[rows[place[~ok]]] = cell[~ok] >> 32, size[~ok]
                    cell, rank, size, own, place, best = (v[ok] for v in (cell, rank, size, own, place, best))
                    if not len(place):
                        break
                    line = np.arange(len(place))
                x = cell[line, best]
                cell[line, best] = ((x >> 10 & 0x3FFFFF) - 1) << 32 | x & 1023
                shift = np.minimum(col[None, :] + (col[None, :] > best[:, None]), wide - 1)
                cell, rank = np.take_along_axis(cell, shift, 1), np.take_along_axis(rank, shift, 1)
                size = size - 1
                offer(np.concatenate((line, line)), np.concatenate((best - 1, best)))
            done.append((rows, counts[rows], final))
    for k in np.flatnonzero(lengths > LONG):
        got = encode_alone(p, symbols[at[k] : at[k] + lengths[k]], int(keys[k]), most)
        counts[k] = len(got)
        done.append((np.array([k]), counts[k : k + 1], np.array([got])))
    out = np.zeros(counts.sum(), np.int64)
    first = np.cumsum(counts) - counts
    for rows, size, sym in done:
        r, c = np.nonzero(np.arange(sym.shape[1])[None, :] < size[:, None])
        out[first[rows[r]] + c] = sym[r, c]
    return out, counts


def _points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
    b0, b1, b2, b3 = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
    return np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)))


def encode_slice(p: Pieces, data: np.ndarray, offsets: np.ndarray, doc_keys: np.ndarray, dropout: float, seed: int, variants: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts laid end to end, and where each text's begin. An empty text has no ids, as in the library."""
    texts = len(offsets) - 1
    full = np.diff(offsets) > 0
    # every text gets the blank before it that the model's dummy prefix stands for
    to = offsets + np.concatenate(([0], np.cumsum(full)))
    flow = np.full(to[-1], 32, np.uint8)
    keep = np.ones(to[-1], bool)
    keep[to[:-1][full]] = False
    flow[keep] = data
    if not len(flow):
        return np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)
    blank = flow == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[to[:-1][full]] = True
    begins = np.flatnonzero(begins)
    ends = np.append(begins[1:], len(flow))
    first = np.searchsorted(begins, to)
    h = K.span_hashes(flow, begins, ends, lower=False)
    most = int(dropout * 2**53)
    if most:
        place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        doc = np.repeat(doc_keys.view(np.uint64), np.diff(first))
        variant = K.mix(doc * _U(0x9E3779B97F4A7C15) ^ (place.astype(np.uint64) + _U(seed * 0x51ED27)))
        if variants:  # n bytes have at most 2**(n - 1) segmentations
            variant = np.where(ends - begins <= variants.bit_length(), variant % _U(variants), variant)
        h = K.mix(h ^ K.mix(variant + _U((seed + 1) * 0x2545F491)))
    keys, at, back = np.unique(h, return_index=True, return_inverse=True)
    a, b = begins[at], ends[at]
    length = b - a
    total = np.cumsum(length)
    source = np.repeat(a - (total - length), length) + np.arange(total[-1])
    own = flow[source]
    lead = np.flatnonzero((own & 0xC0) != 0x80)
    symbols = p.symbol(_points(own, lead))
    chars = np.diff(np.searchsorted(lead, np.concatenate(([0], total))))
    flat, n = encode_words(p, symbols, chars, keys, most)
    odd = np.flatnonzero(flat >= p.size)
    if len(odd):  # characters without a piece: their bytes
        spelled = {int(s): p.spell_unknown(int(s)) for s in np.unique(flat[odd])}
        times = np.ones(len(flat), np.int64)
        times[odd] = [len(spelled[int(s)]) for s in flat[odd]]
        where = np.cumsum(times) - times
        wide = np.repeat(flat, times)
        for k in odd:
            got = spelled[int(flat[k])]
            wide[where[k] : where[k] + len(got)] = got
        n = np.add.reduceat(times, np.cumsum(n) - n) if len(n) else n
        flat = wide
    start = np.cumsum(n) - n
    m = n[back]
    stop = np.cumsum(m)
    ids = flat[np.arange(stop[-1]) - np.repeat(stop - m - start[back], m)]
    return ids, np.concatenate(([0], stop))[first]


def decode_slice(p: Pieces, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of id lists laid end to end, and where each text begins: the pieces' bytes without the blank in front."""
    n = p.spelled_len[ids]
    stop = np.cumsum(n)
    out = p.spelled[np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - n - p.spelled_at[ids], n)]
    place = np.concatenate(([0], stop))[first]
    lead = place[:-1][place[1:] > place[:-1]]
    drop = lead[out[lead] == 32]
    keep = np.ones(len(out), bool)
    keep[drop] = False
    return out[keep], place - np.searchsorted(drop, place)


_loaded: dict[str, Pieces] = {}


def pieces_from(path: str) -> Pieces:
    """One per file and Python worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model_path: str, dropout: float = 0.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, variants: int | None = None) -> DataFrame:
    """``id_col, ids`` of every row of ``docs``; with ``digest`` instead ``id_col, n_ids, ids_crc32, n_bytes, lossless``.

    ``lossless``: the ids, decoded, give back exactly the text. ``ids_crc32`` is over unsigned little-endian 32-bit ids.
    Null counts as empty, and an empty text has no ids. Dropout 0 gives the library's own segmentation. ``variants``
    lets words that can't have more segmentations share that many keys; None gives every occurrence its own. Rows that repeat
    an id and text get equal segmentations. Whole texts, other columns not read; an empty table gives an empty result.
    """
    let_workers_import(docs.sparkSession)

    def emit(batches):
        p = pieces_from(model_path)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            names = batch.column("doc_id")
            doc_keys = names.fill_null(-1).to_numpy(zero_copy_only=False)
            for i, j, part, off in K.slices(data, offsets):
                ids, first = encode_slice(p, part, off, doc_keys[i:j], dropout, seed, variants)
                own = names.slice(i, j - i)
                if not digest:
                    yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))], [id_col, "ids"])
                    continue
                back, place = decode_slice(p, ids, first)
                whole = len(back) == len(part) and (place == off).all() and (back == part).all()
                same = [True] * (j - i) if whole else [bytes(back[place[k] : place[k + 1]]) == bytes(part[off[k] : off[k + 1]]) for k in range(j - i)]
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(first)), pa.array(crc, pa.int64()), pa.array(np.diff(off)), pa.array(same)], [id_col, "n_ids", "ids_crc32", "n_bytes", "lossless"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "n_ids long, ids_crc32 long, n_bytes long, lossless boolean" if digest else "ids array<int>"
    return rows.mapInArrow(emit, f"`{id_col}` long, {kinds}")


def decode(coded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` for id lists; ids outside the model are an error, a null list gives the empty text."""
    let_workers_import(coded.sparkSession)

    def emit(batches):
        p = pieces_from(model_path)
        for batch in batches:
            lists = batch.column("ids")
            n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            out, place = decode_slice(p, flat, np.concatenate(([0], np.cumsum(n))))
            raw = out.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], [id_col, "text"])

    return coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(emit, f"`{id_col}` long, text string")
