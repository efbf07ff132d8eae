"""Token ids of whole texts, by the `tokenizers` library, with a cache of pieces that is looked up in numpy.

The tokenizer used here (BPE with word ends; NFC, lower-casing) drops white space and forms no token across it, so a text's ids
are the ids of its chunks between ASCII white space, one after another. A plain chunk (ASCII without control characters, apostrophe and ``<``, and
the letters of Latin-1) splits further, exactly as the tokenizer splits it: runs of letters, single digits, runs of other marks. Any
other chunk is one piece. Pieces are found in the bytes of a slice at once and looked up in a table of open addresses; each
different piece is encoded by the library once.

A piece of up to 16 bytes is held in the table byte for byte, so no hash decides on ids; longer ones are kept in a dictionary.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np

from .bytescan import LOWER, mix

#: Different pieces in the cache, short and long ones; it starts afresh when it is full.
CACHE = 400_000
LONG = 60_000
#: Slots of the table, a power of two.
SLOTS = 1 << 20

_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
#: What the splitting relies on; other tokenizers encode texts whole.
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _classes() -> np.ndarray:
    t = np.full(256, _ODD, dtype=np.uint8)
    t[0x21:0x7F] = _MARK
    t[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
    t[0x30:0x3A] = _DIGIT
    t[[0x20, *range(0x09, 0x0E)]] = _SPACE
    t[[0x27, 0x3C]] = _ODD
    return t


_CLASS = _classes()
#: Second bytes after 0xC3 that make a letter (U+00C0 to U+00FF but the signs of multiplication and division).
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: Masks of the first bytes of a little-endian word, by length.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and plainness of each piece of texts, and the number of pieces before each text and after the last."""
    n = len(data)
    kind = _CLASS[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[lead + 1 < n]
    lead = lead[_LATIN[data[lead + 1]]]
    kind[lead] = _LETTER
    kind[lead + 1] = _LETTER
    # A piece begins where the class changes, and at every digit; texts are apart.
    fresh = np.empty(n, dtype=bool)
    fresh[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
    fresh |= kind == _DIGIT
    fresh[offs[:-1][offs[:-1] < n]] = True
    start = np.flatnonzero(fresh)
    what = kind[start]
    end = np.append(start[1:], n)
    plain = np.ones(len(start), dtype=bool)
    if (what == _ODD).any():
        # Chunks with an odd byte are put together again.
        space = what == _SPACE
        edge = np.empty(len(start), dtype=bool)
        edge[:1] = True
        edge[1:] = space[1:] | space[:-1]
        begins = np.zeros(n, dtype=bool)
        begins[offs[:-1][offs[:-1] < n]] = True
        edge |= begins[start]
        chunk = np.cumsum(edge) - 1
        odd = np.zeros(chunk[-1] + 1, dtype=bool)
        odd[chunk[what == _ODD]] = True
        plain = ~odd[chunk]
        keep = plain | edge
        start, what, plain = start[keep], what[keep], plain[keep]
        end = np.append(start[1:], n)
    word = what != _SPACE
    start, end, plain = start[word], end[word], plain[word]
    return start, end, plain, np.searchsorted(start, offs)


class PieceEncoder:
    """Encodes slices of texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        steps = [x["type"] for x in (conf.get("normalizer") or {}).get("normalizers", [])]
        cuts = (conf.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.splits = (
            steps == _NORMALISERS and bool(cuts) and cuts[0].get("pattern", {}).get("Regex") == _SPLIT
            and all(a["content"].startswith("<") and not (a["lstrip"] or a["rstrip"] or any(c.isspace() for c in a["content"])) for a in conf["added_tokens"])
        )
        vocab = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.head, self.tail = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.uint64)
        self.size = np.zeros(SLOTS, dtype=np.uint8)  # 0: free
        self.place = np.zeros(SLOTS, dtype=np.int32)
        self.at, self.many = np.zeros(CACHE + LONG + 1, dtype=np.int64), np.zeros(CACHE + LONG + 1, dtype=np.int32)
        self.held, self.used = 0, 0
        self.pool = np.zeros(1 << 20, dtype=np.uint32)
        self.long: dict[bytes, int] = {}

    def _add(self, raw: list[bytes], plain: np.ndarray) -> np.ndarray:
        """Encode different pieces; their places."""
        many = np.zeros(len(raw), dtype=np.int32)
        order, found = [], []
        some = np.flatnonzero(plain)
        if len(some):
            # Each piece ends with the one token that carries its end, so one call encodes them all.
            text = b" ".join([raw[i] for i in some.tolist()]).decode()
            every = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
            stops = np.flatnonzero(self.is_end[every]) + 1
            if len(stops) == len(some):
                many[some] = np.diff(stops, prepend=0)
                order.append(some)
                found.append(every)
            else:
                plain = np.zeros(len(raw), dtype=bool)
        rest = np.flatnonzero(~plain)
        if len(rest):
            each = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast([raw[i].decode() for i in rest.tolist()], add_special_tokens=False)]
            many[rest] = [len(x) for x in each]
            order.append(rest)
            found.append(np.frombuffer(b"".join([x.tobytes() for x in each]), dtype=np.uint32))
        total, rank = int(many.sum()), np.concatenate(order)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), dtype=np.uint32)])
        self.pool[self.used : self.used + total] = np.concatenate(found)
        place = np.arange(self.held, self.held + len(raw))
        self.at[place[rank]] = self.used + np.cumsum(many[rank]) - many[rank]
        self.many[place] = many
        self.held, self.used = self.held + len(raw), self.used + total
        return place

    def _short(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Places of pieces of up to 16 bytes; those that aren't in the table are learned."""
        wide = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        size = end - start
        head = wide[start] & _MASK[np.minimum(size, 8)]
        tail = np.where(size > 8, wide[np.maximum(end - 8, 0)], np.uint64(0))
        # Plain pieces and others never have the same bytes, so bytes and size say it all.
        size = size.astype(np.uint8)
        slot = (mix(head ^ (tail * np.uint64(0x9E3779B97F4A7C15)) ^ size) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        out = np.full(len(start), -1, dtype=np.int64)
        todo, missed = np.arange(len(start)), []
        while len(todo):
            s = slot[todo]
            same = (self.head[s] == head[todo]) & (self.tail[s] == tail[todo]) & (self.size[s] == size[todo])
            out[todo[same]] = self.place[s[same]]
            free = self.size[s] == 0
            missed.append(todo[free])
            todo = todo[~same & ~free]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
        new = np.concatenate(missed) if missed else todo
        if len(new):
            # One of each different piece.
            order = np.lexsort((size[new], tail[new], head[new]))
            new = new[order]
            h, t, z = head[new], tail[new], size[new]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1]) | (z[1:] != z[:-1])])
            one = new[first]
            place = self._add([data[a:b].tobytes() for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)], plain[one])
            out[new] = place[np.cumsum(first) - 1]
            left, p = one, place
            while len(left):
                s = slot[left]
                free = np.flatnonzero(self.size[s] == 0)
                _, w = np.unique(s[free], return_index=True)
                won = free[w]
                s = s[won]
                self.head[s], self.tail[s], self.size[s], self.place[s] = head[left[won]], tail[left[won]], size[left[won]], p[won]
                lost = np.ones(len(left), dtype=bool)
                lost[won] = False
                left, p = left[lost], p[lost]
                slot[left] = (slot[left] + 1) & (SLOTS - 1)
        return out

    def _longer(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, plain: np.ndarray) -> np.ndarray:
        raw = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        fresh = {r: i for i, r in enumerate(raw) if r not in self.long}
        if fresh:
            for r, p in zip(fresh, self._add(list(fresh), plain[list(fresh.values())]).tolist(), strict=True):
                self.long[r] = p
        return np.array([self.long[r] for r in raw], dtype=np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice (bytes, offsets), and the texts' bounds in them."""
        if not self.splits:
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            found = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([*found, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[: len(data)] = LOWER[data]
        start, end, plain, bounds = pieces(data, offs)
        odd = ~plain
        if odd.any():
            # A capital may compose with a mark after it otherwise than the small letter does: these pieces stay as they are.
            edge = np.zeros(len(data) + 1, dtype=np.int8)
            edge[start[odd]] = 1
            edge[end[odd]] -= 1
            kept = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
            padded[kept] = data[kept]
        short = end - start <= 16
        longer = np.flatnonzero(~short)
        # As many new pieces as there are pieces at most; a slice with more than the cache holds is done in parts.
        if len(start) > CACHE // 2 or len(longer) > LONG // 2:
            if len(offs) > 2:
                m = len(offs) // 2
                a, b = self.encode(data[: offs[m]], offs[: m + 1]), self.encode(data[offs[m] :], offs[m:] - offs[m])
                return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1][1:] + a[1][-1]])
            cut = start[len(start) // 2]
            a, b = self.encode(data[:cut], np.array([0, cut])), self.encode(data[cut:], np.array([0, len(data) - cut]))
            return np.concatenate([a[0], b[0]]), np.array([0, len(a[0]) + len(b[0])])
        if self.held + len(start) > CACHE + LONG or len(self.long) + len(longer) > LONG:
            self._clear()
        place = np.empty(len(start), dtype=np.int64)
        if len(longer) == 0:
            place = self._short(padded, start, end, plain)
        else:
            place[short] = self._short(padded, start[short], end[short], plain[short])
            place[longer] = self._longer(padded, start[longer], end[longer], plain[longer])
        many = self.many[place]
        after = np.cumsum(many, dtype=np.int64)
        ids = self.pool[np.repeat(self.at[place] - (after - many), many) + np.arange(after[-1] if len(after) else 0)]
        return ids, np.concatenate([[0], after])[bounds]


@lru_cache(maxsize=1)
def encoder(path: str) -> PieceEncoder:
    """The worker's encoder; it outlives a task, so later tasks find the cache filled."""
    return PieceEncoder(path)
