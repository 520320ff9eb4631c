"""Encoding with a tokenizers file: whole texts with their offsets, or ids alone with each distinct piece encoded once.

The pre-tokenizer of a byte-level BPE never puts a single blank and the solid character before it in
one token, nor a letter and a sign behind it, nor a single line feed and its neighbours. So a text may be
cut there, though not within an added token, and the ids of the text are the ids of its pieces in order.
Pieces repeat a lot, the more so without their signs; the library encodes the distinct ones and numpy
lays out the ids. Pieces are found by a 64-bit hash and then compared byte by byte. Tokenizers of another kind
encode each text whole.
"""

from __future__ import annotations

import itertools
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .textkit import _FIRST, _SHORT, BLANK, distinct, eights, numbers, rows, span_hash


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer, and whether texts may be cut into pieces."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    kind = json.loads(tokenizer.to_str())
    pre = kind.get("pre_tokenizer") or {}
    added = all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in kind["added_tokens"])
    return tokenizer, pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and kind.get("normalizer") is None and added


def _solid(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte surely is no white space: a plain solid byte, or a letter of the block that begins with byte C3."""
    last, before = data[at], data[np.maximum(at - 1, 0)]
    return (last > 32) & (last < 127) | (last >= 128) & (last < 192) & (before == 0xC3) & (at > 0)


#: ASCII letters, and ASCII characters that are no letter, digit or white space.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:127] = True
_SIGN[48:58] = False
_SIGN &= ~_LETTER


def _lettered(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte surely is a letter: a plain one, or one of the block that begins with byte C3, but for its two signs."""
    last, before = data[at], data[np.maximum(at - 1, 0)]
    return _LETTER[last] | (last >= 128) & (last < 192) & (before == 0xC3) & (at > 0) & (last != 0x97) & (last != 0xB7)


def _inside(data: bytes, places: np.ndarray, added: tuple[bytes, ...]) -> np.ndarray:
    """Whether each place is within a spelling of an added token, not at its ends."""
    out = np.zeros(len(places), bool)
    for token in added:
        at = data.find(token)
        while at >= 0:
            out |= (places > at) & (places < at + len(token))
            at = data.find(token, at + 1)
    return out


def _cuts(buf: np.ndarray, offsets: np.ndarray, data: bytes, added: tuple[bytes, ...]) -> np.ndarray:
    """Where pieces begin: rows, single blanks between a solid character and one that isn't white, signs behind a letter, and single line feeds between solid characters, with what follows them."""
    n = len(buf)
    if n < 3:
        return distinct(offsets[:-1])
    inner = buf[1 : n - 1]
    blank = np.flatnonzero(inner == 32) + 1
    line = np.flatnonzero(inner == 10) + 1
    after = buf[line + 1]
    line = line[_solid(buf, line - 1) & ((after > 32) & (after < 127) | (after == 0xC3))]
    sign = np.flatnonzero(_SIGN[buf[1:]]) + 1
    fine = np.concatenate([sign[_lettered(buf, sign - 1)], line, line + 1])
    fine = fine[~_inside(data, fine, added)]
    return distinct(np.concatenate([blank[_solid(buf, blank - 1) & ~BLANK[buf[blank + 1]]], fine, offsets[:-1]]))


def _spelled(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the pieces, one after the other."""
    size = ends - starts
    return buf[np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)]


class Pieces:
    """Ids of the pieces seen so far in this worker. Emptied at ``MOST`` pieces."""

    MOST, JOINED, SLOTS = 600_000, 1 << 15, 20

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        added = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        #: No piece begins within one of these.
        self.added = tuple(t.encode() for t in added if t)
        #: Bytes of each id: a byte-level token has a character for each byte.
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes[i] = len(token.encode()) if token in added else len(token)
        self.clear()

    def clear(self):
        #: Sorted keys and the entry of each; of each entry the place and number of its ids in ``flat``.
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.base, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        #: The bytes of all entries, where each begins, and how long it is.
        self.text, self.begin, self.length = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.eights = eights(self.text)
        #: A slot holds the last key that came to it, so that common pieces are found without a search.
        self.slot_key, self.slot_entry = np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.int32)

    def find(self, buf: np.ndarray, data: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each piece; pieces not held yet, or that share their hash with others, are encoded."""
        entry = self._by_key(buf, data, keys, starts, ends)
        if len(other := np.flatnonzero(~self._same(buf, data, starts, ends - starts, entry))):
            entry[other] = np.arange(len(self.base), len(self.base) + len(other))
            self.add(buf, data, None, starts[other], ends[other])
        return entry

    def _same(self, buf: np.ndarray, data: bytes, starts: np.ndarray, size: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether each piece has its entry's bytes. Up to eight bytes, equal hashes and sizes make equal bytes, as the hash is a bijection."""
        good = self.length[entry] == size
        for i in np.flatnonzero(good & (size > _SHORT)).tolist():
            at = int(self.begin[entry[i]])
            good[i] = data[starts[i] : starts[i] + size[i]] == self.text[at : at + int(size[i])].tobytes()
        here = eights(buf)
        some = np.flatnonzero(good & (size > 8) & (size <= _SHORT))
        for k in range(0, _SHORT, 8):
            left = size[some] - k
            equal = (numbers(here, starts[some] + k) ^ numbers(self.eights, self.begin[entry[some]] + k)) & _FIRST[np.clip(left, 0, 8)] == 0
            good[some[~equal]] = False
            some = some[equal & (left > 8)]
            if not len(some):
                break
        return good

    def _by_key(self, buf: np.ndarray, data: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        entry = self.slot_entry[slot]
        miss = np.flatnonzero((self.slot_key[slot] != keys) | (keys == 0))
        if not len(miss):
            return entry
        own, one, which = np.unique(keys[miss], return_index=True, return_inverse=True)
        if len(self.keys) + len(own) > self.MOST and len(self.keys):
            self.clear()
            return self._by_key(buf, data, keys, starts, ends)
        place = np.searchsorted(self.keys, own)
        place[place == len(self.keys)] = 0
        new = self.keys[place] != own if len(self.keys) else np.ones(len(own), bool)
        if new.any():
            at = miss[one[new]]
            self.add(buf, data, own[new], starts[at], ends[at])
            place = np.searchsorted(self.keys, own)
        found = self.entry[place]
        entry[miss] = found[which]
        slot = (own >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        self.slot_key[slot], self.slot_entry[slot] = own, found
        # Two keys of one slot: the last one written is the slot's key, and so is its entry.
        return entry

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of each text. A few texts at a time: the library's results are many times as large as the ids."""
        ids, size, low, weight = [np.zeros(0, np.uint32)], [], 0, 0
        for i, t in enumerate(texts):
            weight += len(t)
            if weight >= 4 * self.JOINED or i + 1 == len(texts):
                found = [x.ids for x in self.tokenizer.encode_batch_fast([t.decode() for t in texts[low : i + 1]], add_special_tokens=False)]
                size += map(len, found)
                ids.append(np.fromiter(itertools.chain.from_iterable(found), np.uint32))
                low, weight = i + 1, 0
        return np.concatenate(ids), np.array(size, np.int64)

    def add(self, buf: np.ndarray, data: bytes, keys: np.ndarray | None, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes new pieces; ``keys`` are sorted and not yet held. Without keys they are entries that no later search finds.

        Pieces that begin with their blank and end solidly are encoded many in one text: there the
        tokenizer cuts between them, and the ids' bytes tell which piece they belong to.
        """
        joined = (buf[starts] == 32) & (ends - starts > 1) & _solid(buf, ends - 1)
        joined &= ~BLANK[buf[np.minimum(starts + 1, len(buf) - 1)]]
        one, many = np.flatnonzero(~joined), np.flatnonzero(joined)
        ids, size = self._encoded([data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
        flat, sizes = [ids], np.zeros(len(starts), np.int64)
        sizes[one] = size
        if len(many):
            length = ends[many] - starts[many]
            total = np.cumsum(length)
            text = _spelled(buf, starts[many], ends[many]).tobytes()
            stop = total[distinct(np.append(np.searchsorted(total, np.arange(self.JOINED, total[-1], self.JOINED)), len(total) - 1))]
            ids, _ = self._encoded([text[a:b] for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True)])
            reach = np.cumsum(self.bytes[ids])
            edge = np.searchsorted(reach, total)
            if not len(reach) or (reach[np.minimum(edge, len(reach) - 1)] != total).any():
                raise ValueError("the tokenizer joins what pieces keep apart")
            flat.append(ids)
            sizes[many] = np.diff(np.concatenate([[0], edge + 1]))
        order = np.concatenate([one, many])
        base = np.empty(len(starts), np.int64)
        base[order] = np.cumsum(sizes[order]) - sizes[order] + len(self.flat)
        self.flat = np.concatenate([self.flat, *flat])
        entry = np.arange(len(self.base), len(self.base) + len(starts), dtype=np.int32)
        own = ends - starts
        self.begin, self.length = np.concatenate([self.begin, np.cumsum(own) - own + len(self.text)]), np.concatenate([self.length, own])
        self.text = np.concatenate([self.text, _spelled(buf, starts, ends)])
        self.eights = eights(self.text)
        self.base, self.size = np.concatenate([self.base, base]), np.concatenate([self.size, sizes.astype(np.int32)])
        if keys is None:
            return
        place = np.searchsorted(self.keys, keys)
        self.keys, self.entry = np.insert(self.keys, place, keys), np.insert(self.entry, place, entry)


@lru_cache(maxsize=2)
def _held(path: str) -> Pieces:
    return Pieces(load(path)[0])


#: Bytes of text that the library encodes at a time: its results are many times as large.
WHOLE_BYTES = 1 << 18


def encode_whole(column: pa.Array, path: str):
    """Runs of rows of a string column, each text encoded whole and once: first row, ids, each row's first id, and the ids' code-point spans.

    The ids of a byte-level tokenizer are its text's bytes in order, so their spans follow from their numbers
    of bytes, and the library needn't make them. Other tokenizers give their own.
    """
    tokenizer, bytewise = load(path)
    texts = [x or "" for x in column.to_pylist()]
    chain = itertools.chain.from_iterable
    low = weight = 0
    for i, t in enumerate(texts):
        weight += len(t)
        if weight < WHOLE_BYTES and i + 1 < len(texts):
            continue
        own = texts[low : i + 1]
        found = [x.ids for x in tokenizer.encode_batch_fast(own, add_special_tokens=False)] if bytewise else tokenizer.encode_batch(own, add_special_tokens=False)
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        if bytewise:
            ids = np.fromiter(chain(found), np.uint32, int(at[-1]))
            begin, end = _spans(own, ids, at, _held(path).bytes)
        else:
            ids = np.fromiter(chain(x.ids for x in found), np.uint32, int(at[-1]))
            begin, end = np.fromiter(chain(chain(x.offsets) for x in found), np.int64, 2 * int(at[-1])).reshape(-1, 2).T
        yield low, ids, at, begin, end
        low, weight = i + 1, 0


def _spans(texts: list[str], ids: np.ndarray, at: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code-point spans of the ids of texts, from the bytes of each id."""
    data = [t.encode() for t in texts]
    edge = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    size = held[ids]
    stop = np.cumsum(size)
    if (np.concatenate([[0], stop])[at] != edge).any():
        raise ValueError("the ids' bytes are not those of the text")
    points = np.concatenate([[0], np.cumsum((np.frombuffer(b"".join(data), np.uint8) & 0xC0) != 0x80)])
    origin = np.repeat(points[edge[:-1]], np.diff(at))
    return points[stop - size + 1] - 1 - origin, points[stop] - origin


def encode(column: pa.Array, path: str, spans: bool = False):
    """For each chunk of a string column: first row, ids, each row's first id, and with ``spans`` the ids' code-point spans.

    Yields ``(first, ids, at, begin, end)``; ``begin`` and ``end`` are None without ``spans``. An id
    that holds part of a character spans the whole character.
    """
    _, cut = load(path)
    if not cut:
        yield from encode_whole(column, path)
        return
    held = _held(path)
    for first, _, buf, offsets in rows(column):
        data = buf.tobytes()
        starts = _cuts(buf, offsets, data, held.added)
        starts = starts[starts < len(buf)]
        if not len(starts):
            yield first, np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64), *((np.zeros(0, np.int64),) * 2 if spans else (None, None))
            continue
        ends = np.append(starts[1:], len(buf))
        entry = held.find(buf, data, span_hash(buf, starts, ends), starts, ends)
        base, count = held.base[entry], held.size[entry]
        at = np.concatenate([[0], np.cumsum(count)])
        ids = held.flat[np.repeat(base - at[:-1], count) + np.arange(at[-1])]
        row_at = at[np.searchsorted(starts, offsets)]
        if not spans:
            yield first, ids, row_at, None, None
            continue
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        size = held.bytes[ids]
        stop = np.cumsum(size)
        origin = np.repeat(points[offsets[:-1]], np.diff(row_at))
        yield first, ids, row_at, points[stop - size + 1] - 1 - origin, points[stop] - origin
