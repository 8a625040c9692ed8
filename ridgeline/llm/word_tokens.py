"""Token ids of many texts by a word-level BPE tokenizer file, exact and fast.

The tokenizer drops white space and splits what is left into runs of letters, single digits and runs of other signs,
so its ids are those of the pieces one after another. Pieces are found and hashed with NumPy; the distinct ones of a
slice of text are looked up in a direct-mapped cache of fixed size, and only those not there go through the
``tokenizers`` library. Words with anything but printable ASCII, or with an apostrophe or ``<`` (contractions and
special tokens cross those borders), go through the whole tokenizer as they are.
"""

from __future__ import annotations

import json
import os

import numpy as np

from ridgeline.llm import kernels as K

_SLOTS, _WIDTH = 1 << 20, 8
_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[[ord("'"), ord("<")]] = 4
_WHOLE = np.uint64(0x5851F42D4C957F2D)


class WordTokens:
    """``flat_ids(data, offsets)``: the ids of texts laid end to end and where each text's begin."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path) as f:
            raw = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(raw))
        raw["normalizer"] = raw["pre_tokenizer"] = None
        raw["added_tokens"] = []
        self.model = Tokenizer.from_str(json.dumps(raw)).model
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.size = np.zeros(_SLOTS, np.uint8)
        self.ids = np.zeros((_SLOTS, _WIDTH), np.uint16)

    def units(self, data, offsets):
        """Starts, ends and hashes of the pieces, a mask of those that need the whole tokenizer, and each text's first."""
        starts, ends, first = K.spans(data, offsets)
        kind = _CLASS[data]
        odd = np.concatenate(([0], np.cumsum(kind == 4, dtype=np.int64)))
        plain = odd[ends] == odd[starts]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[plain]] += 1
        inside[ends[plain]] -= 1
        inside = np.cumsum(inside[:-1]).astype(bool)
        cut = np.empty(len(data), bool)
        if len(data):
            cut[0], cut[1:] = False, (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        cut &= inside
        cut[starts] = True
        begins = np.flatnonzero(cut)
        word_of = np.searchsorted(starts, begins, "right") - 1
        last = np.empty(len(begins), bool)
        last[:-1], last[-1:] = word_of[1:] != word_of[:-1], True
        stops = np.empty(len(begins), np.int64)
        stops[:-1] = begins[1:]
        stops[last] = ends[word_of[last]]
        whole = ~plain[word_of]
        h = K.span_hashes(data, begins, stops)
        if whole.any():
            h[whole] = K.span_hashes(data, begins[whole], stops[whole], lower=False) ^ _WHOLE
        return begins, stops, h, whole, np.searchsorted(begins, offsets)

    def flat_ids(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        begins, stops, h, whole, first = self.units(data, offsets)
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        slot = (keys & np.uint64(_SLOTS - 1)).astype(np.int64)
        hit = self.keys[slot] == keys
        size = self.size[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        table = np.zeros((len(keys), _WIDTH), np.uint32)
        table[hit] = self.ids[slot[hit]]
        long: dict[int, np.ndarray] = {}
        raw = data.tobytes()
        for flag in (True, False):
            some = miss[whole[at[miss]] == flag]
            if not len(some):
                continue
            words = [raw[b:e].decode("utf-8", "replace") for b, e in zip(begins[at[some]].tolist(), stops[at[some]].tolist(), strict=True)]
            if flag:
                got = self.whole.encode(words, is_pretokenized=True, add_special_tokens=False)
                flat, owner = np.array(got.ids, np.uint32), np.array(got.word_ids, np.int64)
                n = np.bincount(owner, minlength=len(words))
            else:
                cut = [self.model.tokenize(w) for w in " ".join(words).lower().split(" ")]
                n = np.array([len(x) for x in cut], np.int64)
                flat = np.array([t.id for x in cut for t in x], np.uint32)
                owner = np.repeat(np.arange(len(words)), n)
            size[some] = n
            first_id = np.cumsum(n) - n
            place = np.arange(len(flat)) - first_id[owner]
            fits = n <= _WIDTH
            block = np.zeros((len(words), _WIDTH), np.uint32)
            use = fits[owner]
            block[owner[use], place[use]] = flat[use]
            table[some] = block
            # of pieces that want the same slot the last one gets all of it
            short = np.flatnonzero(fits)
            s, pick = np.unique(slot[some[short]][::-1], return_index=True)
            pick = short[len(short) - 1 - pick]
            self.keys[s], self.size[s], self.ids[s] = keys[some[pick]], n[pick], block[pick]
            for k in np.flatnonzero(~fits):
                long[int(some[k])] = flat[first_id[k] : first_id[k] + n[k]]
        begin = np.cumsum(np.minimum(size, _WIDTH)) - np.minimum(size, _WIDTH)
        pool = table[np.arange(_WIDTH)[None, :] < np.where(size <= _WIDTH, size, _WIDTH)[:, None]]
        if long:
            extra = list(long.values())
            begin[list(long)] = len(pool) + np.concatenate(([0], np.cumsum([len(x) for x in extra])[:-1]))
            pool = np.concatenate([pool, *extra])
        n = size[back]
        ends = np.cumsum(n)
        out = pool[np.arange(ends[-1]) - np.repeat(ends - n - begin[back], n)]
        return out, np.concatenate(([0], ends))[first]


    def word_counts(self, data, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and token counts of the words (runs without white space), and each text's first word."""
        starts, ends, first = K.spans(data, offsets)
        if not len(starts):
            return starts, ends, np.zeros(0, np.int64), first
        # a word's pieces are those of a text that is the word alone
        places = np.concatenate((starts, [len(data)]))
        _, at = self.flat_ids(data, places) if starts[0] == 0 else self.flat_ids(data, np.concatenate(([0], places)))
        return starts, ends, np.diff(at if starts[0] == 0 else at[1:]), first


_loaded: dict[str, WordTokens] = {}


def tokens_from(path: str) -> WordTokens:
    """One per file and Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]
