"""Operator 9, language-model scoring with an Elias-Fano n-gram trie.

The model is an interpolated trigram model with absolute discounting over add-one unigrams. Its trie
has three levels. The first holds the vocabulary as a monotone sequence of word hashes in Elias-Fano
code, with each word's count and the quantised weight that it passes on as a context. The second holds
the successors of every word, the third those of every pair of words: monotone pointers into one
sequence of keys (context, successor) in Elias-Fano code, with an 8-bit code of each quantised log
probability, and on the third level one of the weight that a pair passes on. A pair's context on the
third level is its place on the second. An n-gram is found by a successor search for its key within
its context's range; a bit array before each level tells most absent keys without a search. All arrays
lie in files that are mapped into memory, not read.

Every word, pair and trigram of the training texts is in the trie. Codes are rounded down, and what a
context passes on is what the restored shares of its n-grams leave, in 16 bits, so that the probabilities of
the trie as it stands sum to one, but for the rounding of the passed weight.

Texts are split twice: to count words, and to write the numbers of their words, which all later passes
read instead; pairs and trigrams are counted from these, in a pass each, so that only their blobs' shuffle and the
shards' packed files hold them. Counts cover all training documents. Each task sums its words, pairs or trigrams in sorted arrays and
sends them as one packed blob for each shard, as in any shuffle; a shard's blobs are merged in one task,
whose size is bounded by the number of shards, which follows the number of tokens. Words are dealt to
shards by the top bits of their hash, pairs and trigrams by a hash of a pair of words, so that a frequent
word is spread over all shards. Counts wait for the discounts in packed files that go once the levels are
made. Files lie in the shared folder; where that isn't a local path, a process copies each into a file without
a name, so that it can be mapped, and the system frees that when the process ends, however it ends.

Unigram counts are exact, and base scores use them unquantised. The 64-bit hash of a word stands for
it: two of V words share one with a probability below V^2 / 2^65. More than 2^32 words are an error.

Defined results: a null text is an empty one, of the end token alone. A null doc_id counts as not
held out. Repeated rows are learned from as often as they stand. Without training documents all
probabilities are 1 and scores 0. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Iterator
from functools import cached_property, partial
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, remove, scratch, small_batches, stored

U64 = np.uint64
TOKENS_A_SHARD, WORDS_A_SHARD = 3_000_000, 1_000_000
PAIRS_HELD, TRIPLES_HELD, WORDS_HELD, CACHE_WORDS = 3_000_000, 1_500_000, 400_000, 400_000
#: Bytes of texts, or of numbers of words, that are handled at once.
BATCH, CODED = 12 << 20, 6 << 20
#: Keys in a packed piece.
PACKED = 1 << 18
#: Sums of shares in a blob are whole numbers of this part of one.
UNIT = float(1 << 50)
UNKNOWN = 0xFFFFFFFF
END = xxhash.xxh64_intdigest(b"\n", 7)  # no word holds a line end
LEAST_LOG = -12.0  # of quantised log10 values


# --- Elias-Fano -----------------------------------------------------------------------------------


def _bits_needed(universe: int, n: int) -> int:
    return max(0, (universe // max(1, n)).bit_length() - 1)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray | int]:
    """A sorted sequence: low bits packed, high parts in unary, counts of ones before each word."""
    n, low = len(values), _bits_needed(universe, len(values))
    lows = np.zeros((n * low + 63) // 64 + 2, U64)
    if low:
        at = np.arange(n, dtype=U64) * U64(low)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        part = values & U64((1 << low) - 1)
        np.bitwise_or.at(lows, word, part << shift)
        over = shift + U64(low) > U64(64)
        np.bitwise_or.at(lows, word[over] + 1, part[over] >> (U64(64) - shift[over]))
    place = (values >> U64(low)) + np.arange(n, dtype=U64)
    high = np.zeros(int(place[-1] >> U64(6)) + 2 if n else 2, U64)
    np.bitwise_or.at(high, (place >> U64(6)).astype(np.int64), U64(1) << (place & U64(63)))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.uint64)
    return {"n": n, "low": low, "lows": lows, "high": high, "ones": ones}


_EACH, _TOP = U64(0x0101010101010101), U64(0x8080808080808080)
#: Place of the n-th one in a byte.
_NTH = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    def __init__(self, n: int, low: int, lows: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low, self.lows, self.high, self.ones = n, low, lows, high, ones

    def _select(self, rank: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the rank-th (from 0) one or zero of the unary part."""
        before = np.arange(len(self.ones), dtype=U64) * U64(64) - self.ones if zeros else self.ones
        word = np.minimum(np.searchsorted(before, rank, side="right") - 1, len(self.high) - 1)
        left = rank - before[word]
        bits = self.high[word]
        if zeros:
            bits = ~bits
        # Counts of all bytes up to each one, side by side in a word; then the byte, then the bit in it.
        sums = bits - ((bits >> U64(1)) & U64(0x5555555555555555))
        sums = (sums & U64(0x3333333333333333)) + ((sums >> U64(2)) & U64(0x3333333333333333))
        sums = ((sums + (sums >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _EACH
        byte = np.bitwise_count(((left * _EACH | _TOP) - sums) & _TOP).astype(U64) << U64(3)
        left -= (sums << U64(8)) >> byte & U64(0xFF)
        return word * 64 + byte.astype(np.int64) + _NTH[(bits >> byte & U64(0xFF)).astype(np.int64), np.minimum(left, U64(7)).astype(np.int64)]

    def _next(self, start: np.ndarray, rank: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the rank-th one or zero, which is the first at or after ``start``; mostly it is in the same word."""
        bits = self.high[start >> 6]
        rest = (~bits if zeros else bits) >> (start & 63).astype(U64)
        out = start + np.bitwise_count(~rest & (rest - U64(1)))
        far = np.flatnonzero(rest == 0)
        if len(far):
            out[far] = self._select(rank[far], zeros)
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """The low bits of elements."""
        at = i.astype(U64) * U64(self.low)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        part = self.lows[word] >> shift | self.lows[word + 1] << U64(1) << (U64(63) - shift)
        return part & U64((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        high = (self._select(i.astype(U64), False) - i).astype(U64) << U64(self.low)
        return high | self._lows(i) if self.low else high

    def range(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The elements at i and i + 1."""
        i = i.astype(np.int64)
        place = self._select(i.astype(U64), False)
        highs = (place - i, self._next(place + 1, (i + 1).astype(U64), False) - i - 1)
        return tuple(h.astype(U64) << U64(self.low) | (self._lows(i + k) if self.low else U64(0)) for k, h in enumerate(highs))

    @cached_property
    def _most(self) -> int:
        """The greatest high part."""
        return int(self.get(np.array([self.n - 1]))[0]) >> self.low if self.n else 0

    def _search(self, value: np.ndarray, first: np.ndarray | None, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the least element >= value, within [first, last) where given, and the end of the elements
        of the same high part; among those only low bits are compared."""
        top = value >> U64(self.low)
        inside = np.minimum(top, U64(self._most))
        start = np.where(inside == 0, 0, self._select(np.maximum(inside, U64(1)) - U64(1), True) + 1)
        lo, hi = (np.where(top > inside, self.n, x - inside.astype(np.int64)) for x in (start, self._next(start, inside, True)))
        if first is not None:
            lo, hi = np.clip(lo, first, last), np.clip(hi, first, last)
        end, low = hi.copy(), value & U64((1 << self.low) - 1)
        open_ = np.flatnonzero(lo < hi) if self.low else lo[:0]
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            below = self._lows(mid) < low[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return lo, end

    def successor(self, value: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of the least element >= value, within [first, last) where given."""
        return self._search(value, first, last)[0]

    def find(self, value: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of the first element that equals value, within [first, last) where given; -1 where there is none."""
        at, end = self._search(value, first, last)
        ok = at < end
        if self.low:
            ok[ok] = self._lows(at[ok]) == value[ok] & U64((1 << self.low) - 1)
        return np.where(ok, at, -1)


# --- files ----------------------------------------------------------------------------------------


def write_arrays(uri: str, **arrays) -> None:
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [str(a.dtype), len(a), at] if isinstance(a, np.ndarray) else a
        at += -(-a.nbytes // 8) * 8 if isinstance(a, np.ndarray) else 0
    head = json.dumps(head).encode()
    with where.open_output_stream(own, compression=None) as f:
        f.write(len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8))
        for a in arrays.values():
            if isinstance(a, np.ndarray):
                f.write(a.tobytes() + bytes(-a.nbytes % 8))
    where.move(own, path)


#: Files of this process that lie in a store which can't be mapped.
_COPIES: dict[str, np.ndarray] = {}


def _mapped(uri: str) -> np.ndarray:
    """The bytes of a file, mapped: of the file itself, or of this process's copy, which has no name to be left behind."""
    if urlparse(uri).scheme in ("", "file"):
        return np.memmap(urlparse(uri).path, np.uint8, "r")
    if uri not in _COPIES:
        where, source = fs.FileSystem.from_uri(uri)
        with tempfile.TemporaryFile() as own, where.open_input_stream(source) as data:
            while part := data.read(1 << 22):
                own.write(part)
            own.flush()
            _COPIES[uri] = np.memmap(own, np.uint8, "r")
    return _COPIES[uri]


def map_arrays(uri: str) -> dict:
    whole = _mapped(uri).view(np.ndarray)  # slices of a memmap are slow
    size = int(whole[:8].view(np.uint64)[0])
    head, start = json.loads(whole[8 : 8 + size].tobytes()), 8 + -(-size // 8) * 8
    return {k: whole[start + v[2] : start + v[2] + np.dtype(v[0]).itemsize * v[1]].view(v[0]) if isinstance(v, list) else v for k, v in head.items()}


def write_packed(uri: str, keys: np.ndarray, *rows: np.ndarray) -> None:
    """Sorted keys and what stands by them, in pieces that are packed one by one."""
    parts = [np.frombuffer(blob(keys[at : at + PACKED], *(r[at : at + PACKED] for r in rows)), np.uint8) for at in range(0, len(keys), PACKED)]
    write_arrays(uri, sizes=np.array([len(p) for p in parts], np.int64), data=np.concatenate(parts) if parts else np.empty(0, np.uint8))


def read_packed(uri: str, rows: int = 1) -> np.ndarray:
    own = map_arrays(uri)
    ends = np.cumsum(own["sizes"])
    parts = [unblob(own["data"][e - n : e].tobytes(), rows) for e, n in zip(ends.tolist(), own["sizes"].tolist())]
    return np.concatenate(parts, axis=1) if parts else np.empty((1 + rows, 0), U64)


def _planes(*rows: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes first, so that zero bytes compress away."""
    out = np.zeros((len(rows), 8, len(rows[0])), np.uint8)
    for own, row in zip(out, rows):
        each = np.ascontiguousarray(row, np.uint64).view(np.uint8).reshape(-1, 8)
        for i in range((int(row.max(initial=0)).bit_length() + 7) // 8):
            own[i] = each[:, i]
    return zstandard.compress(out.tobytes(), 1)


def _numbers(data: bytes, rows: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(rows, 8, -1)
    out = np.zeros((rows, planes.shape[2], 8), np.uint8)
    for own, each in zip(out, planes):
        for i, plane in enumerate(each):
            if plane.any():
                own[:, i] = plane
    return out.view(U64).reshape(rows, -1)


def blob(keys: np.ndarray, *rows: np.ndarray) -> bytes:
    """Sorted keys, as differences, and what stands by them."""
    return _planes(np.diff(keys, prepend=U64(0)), *rows)


def unblob(data: bytes, rows: int = 1) -> np.ndarray:
    own = _numbers(data, 1 + rows)
    own[0] = np.cumsum(own[0], dtype=U64)
    return own


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unblob(x) for x in blobs]
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


# --- counting -------------------------------------------------------------------------------------


def split(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts, every word as a place among them, and each text's number of words."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    words = lists.flatten()
    some = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(some)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = pc.ascii_lower(words.filter(pa.array(some))).dictionary_encode()  # lower case of a slice of texts would be wrong
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(), np.diff(upto)


def _word_blobs(keys: np.ndarray, counts: np.ndarray, shards: int, per: int):
    """Blobs of at most ``per`` keys, sorted, each of one shard by the top bits of the key."""
    owner = ((keys >> U64(32)) * U64(shards)) >> U64(32)
    edge = np.searchsorted(owner, np.arange(shards + 1, dtype=U64))
    for s in range(shards):
        for lo in range(int(edge[s]), int(edge[s + 1]), per):
            hi = min(lo + per, int(edge[s + 1]))
            yield s, blob(keys[lo:hi], counts[lo:hi])


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "blob"])


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U64, len(words))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and their counts summed."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush():
        return _batch(list(_word_blobs(*summed(*(np.concatenate(x) for x in zip(*held))), shards, 1 << 16)))

    for batch in small_batches(batches, BATCH):
        words, codes, sizes = split(batch.column("text"))
        held.append((np.append(hashes(words), U64(END)), np.append(np.bincount(codes, minlength=len(words)), len(sizes)).astype(U64)))
        n += len(words)
        if n > WORDS_HELD:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _build_words(table: pa.Table, folder: str) -> pa.Table:
    shard = table.column("shard")[0].as_py()
    keys, counts = merged(table.column("blob").to_pylist())
    write_arrays(f"{folder}/words-{shard}", **encode(keys, 1 << 64), counts=counts)
    return pa.table({"shard": pa.array([shard], pa.int32()), "words": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})


class Level1:
    """Numbers and counts of words. ``sizes``: words in each shard."""

    def __init__(self, folder: str, sizes: list[int]):
        self.shards, self.first = len(sizes), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        files = [map_arrays(f"{folder}/words-{s}") if n else None for s, n in enumerate(sizes)]
        self.parts = [f and (EliasFano(f["n"], f["low"], f["lows"], f["high"], f["ones"]), f["counts"]) for f in files]
        self.ids: dict[bytes, int] = {}

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1: unknown) and count of each word."""
        owner = (((hashes >> U64(32)) * U64(self.shards)) >> U64(32)).astype(np.int64)
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for s in np.unique(owner):
            if self.parts[s] is None:
                continue
            ef, counts = self.parts[s]
            mine = np.flatnonzero(owner == s)
            at = ef.find(hashes[mine])
            ok = at >= 0
            number[mine[ok]] = at[ok] + self.first[s]
            count[mine[ok]] = counts[at[ok]]
        return number, count

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Their numbers, through a bounded table."""
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > CACHE_WORDS:
            self.ids, new = {}, words
        found, _ = self.look(hashes(new))
        self.ids.update(zip(new, found.tolist()))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))


def mix(keys: np.ndarray) -> np.ndarray:
    x = keys * U64(0x9E3779B97F4A7C15)
    return x ^ (x >> U64(32))


#: An odd number, whose product with keys of up to 64 bits spreads them, and can be taken back.
SPREAD = 0x9E3779B97F4A7C15


def spread(keys: np.ndarray, words: int) -> np.ndarray:
    """Keys of two numbers below ``words`` (or -1, as any), spread evenly over all numbers of their 2 * bits bits.
    A shard has a range of these, so the differences in its blobs are as small however many shards there are."""
    bits = words.bit_length()
    mask = U64((1 << 2 * bits) - 1)
    return ((keys >> U64(32)) << U64(bits) | keys & U64((1 << bits) - 1)) * U64(SPREAD & int(mask)) & mask


def gathered(keys: np.ndarray, words: int) -> np.ndarray:
    """What ``spread`` was given."""
    bits = words.bit_length()
    mask = (1 << 2 * bits) - 1
    narrow = keys * U64(pow(SPREAD, -1, 1 << 2 * bits)) & U64(mask)
    return narrow >> U64(bits) << U64(32) | narrow & U64((1 << bits) - 1)


def shard_of(keys: np.ndarray, words: int, shards: int) -> np.ndarray:
    """The shard of keys that ``spread`` gave."""
    top = keys << U64(64 - 2 * words.bit_length())
    return ((top >> U64(32)) * U64(shards)) >> U64(32)


def coded(level: Level1, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers (-1: unknown) of all texts, each with the end token after it, and their sizes."""
    words, codes, sizes = split(column)
    out = np.full(len(codes) + len(sizes), end, np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = level.numbers(words)[codes]
    return out, sizes + 1


def pair_keys(ids: np.ndarray, end: int) -> np.ndarray:
    """Numbers of each token and of the one before it, as one key. The end token before a text is its first context."""
    ids = ids.astype(U64)
    return np.concatenate([[U64(end)], ids[:-1]]) << U64(32) | ids


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of coded texts with their numbers, -1 where unknown, and sizes."""
    for batch in small_batches(batches, CODED):
        each = batch.column("ids").to_pylist()
        ids = np.frombuffer(b"".join(each), np.uint32).astype(np.int64)
        ids[ids == UNKNOWN] = -1
        yield batch, ids, np.array([len(x) // 4 for x in each], np.int64)


def bits_of(keys: np.ndarray) -> np.ndarray:
    """A bit array that has a bit for every key, of 8 bits a key or more."""
    size = max(6, (8 * max(1, len(keys)) - 1).bit_length())
    out = np.zeros(1 << (size - 6), U64)
    at = mix(keys) >> U64(64 - size)
    np.bitwise_or.at(out, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    return out


def may_have(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = mix(keys) >> U64(64 - (len(bits).bit_length() - 1 + 6))
    return (bits[(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)


def _dealt(owner: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each shard, in order."""
    order = np.argsort(owner.astype(np.uint16 if shards <= 1 << 16 else np.int64), kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(owner.astype(np.int64), minlength=shards))])
    for s in range(shards):
        if edge[s] < edge[s + 1]:
            yield s, order[edge[s] : edge[s + 1]]


def _code(batches: Iterator[pa.RecordBatch], folder: str, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """doc_id, held_out and ids of every text."""
    level = Level1(folder, sizes)
    end = int(level.look(np.array([END], U64))[0][0])
    for batch in small_batches(batches, BATCH):
        ids, sizes_ = coded(level, batch.column("text"), end)
        cuts = np.concatenate([[0], np.cumsum(sizes_)])
        short = ids.astype(np.uint32).tobytes()  # -1 becomes UNKNOWN
        out = pa.array([short[4 * a : 4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), out], ["doc_id", "held_out", "ids"])


def _count_pairs(batches: Iterator[pa.RecordBatch], folder: str, sizes: list[int], shards: int) -> Iterator[pa.RecordBatch]:
    """The training texts' pairs."""
    end = int(Level1(folder, sizes).look(np.array([END], U64))[0][0])
    held, n, words = [], 0, sum(sizes)

    def flush():
        keys, counts = np.unique(spread(np.concatenate(held), words), return_counts=True)
        return _batch([(s, blob(keys[own], counts[own])) for s, own in _dealt(shard_of(keys, words, shards), shards)])

    for _, ids, _ in _sequences(batches):
        held.append(pair_keys(ids, end))
        n += len(held[-1])
        if n > PAIRS_HELD:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _merge_pairs(table: pa.Table, folder: str, words: int) -> pa.Table:
    """Writes a shard's pairs with their counts; gives how many stand once and twice."""
    shard = table.column("shard")[0].as_py()
    keys, counts = merged(table.column("blob").to_pylist())
    keys = gathered(keys, words)
    order = np.argsort(keys)
    write_packed(f"{folder}/raw/pairs-{shard}", keys[order], counts[order])
    return _seen(shard, counts)


def _seen(shard: int, counts: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), **{name: pa.array([int((counts == n).sum())], pa.int64()) for n, name in ((1, "once"), (2, "twice"))}})


def _count_triples(batches: Iterator[pa.RecordBatch], folder: str, sizes: list[int], shards: int) -> Iterator[pa.RecordBatch]:
    """The training texts' trigrams, by the shard of their first pair."""
    end = int(Level1(folder, sizes).look(np.array([END], U64))[0][0])
    held, n, words = [], 0, sum(sizes)

    def flush():
        pairs, ranks = np.unique(spread(np.concatenate([x for x, _ in held]), words), return_inverse=True)
        keys, counts = np.unique(ranks.astype(U64) << U64(32) | np.concatenate([x for _, x in held]), return_counts=True)
        pairs, last = pairs[(keys >> U64(32)).astype(np.int64)], keys & U64(0xFFFFFFFF)
        return _batch([(s, blob(pairs[own], last[own], counts[own])) for s, own in _dealt(shard_of(pairs, words, shards), shards)])

    for _, ids, _ in _sequences(batches):
        keys = pair_keys(ids, end)
        at = np.flatnonzero(ids[:-1] != end)  # a pair that ends a text is no context
        held.append((keys[at], ids[at + 1].astype(U64)))
        n += len(at)
        if n > TRIPLES_HELD:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def _merge_triples(table: pa.Table, folder: str, words: int) -> pa.Table:
    """Writes a shard's trigrams, the places of their first pairs and their words, with counts; gives how many stand
    once and twice."""
    shard = table.column("shard")[0].as_py()
    pairs, last, counts = np.concatenate([unblob(x, 2) for x in table.column("blob").to_pylist()], axis=1)
    place = np.searchsorted(read_packed(f"{folder}/raw/pairs-{shard}")[0], gathered(pairs, words)).astype(U64)
    keys, counts = summed(place << U64(32) | last, counts)
    write_packed(f"{folder}/raw/triples-{shard}", keys, counts)
    return _seen(shard, counts)


def quantise(log10: np.ndarray, kind=np.uint8) -> np.ndarray:
    """Codes of 8 or 16 bits, rounded down, so that restored shares sum to no more than the shares."""
    most = np.iinfo(kind).max
    return np.clip(np.floor((log10 / -LEAST_LOG + 1) * most + 1e-9), 0, most).astype(kind)


def restore(code: np.ndarray) -> np.ndarray:
    return LEAST_LOG + code.astype(np.float64) * (-LEAST_LOG / np.iinfo(code.dtype).max)


def left_over(sums: np.ndarray) -> np.ndarray:
    """Codes of what restored shares leave of one. There is one a context, so these have 16 bits."""
    return quantise(np.log10(np.clip(1.0 - sums, 10.0**LEAST_LOG, 1.0)), np.uint16)


def _build_passes(table: pa.Table, folder: str) -> pa.Table:
    """The weight that each word of a block of numbers passes on: what the shares of its pairs leave."""
    block = table.column("shard")[0].as_py()
    contexts, sums = merged(table.column("blob").to_pylist())
    codes = np.full(WORDS_A_SHARD, np.iinfo(np.uint16).max, np.uint16)
    codes[contexts.astype(np.int64) - block * WORDS_A_SHARD] = left_over(sums / UNIT)
    write_arrays(f"{folder}/passes-{block}", codes=codes)
    return pa.table({"shard": pa.array([block], pa.int32())})


def counts_at(folder: str, sizes: list[int], numbers: np.ndarray) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    owner, out = np.searchsorted(first, numbers, side="right") - 1, np.zeros(len(numbers), np.int64)
    for s in np.unique(owner):
        own = owner == s
        out[own] = map_arrays(f"{folder}/words-{s}")["counts"][numbers[own] - first[s]]
    return out


def level_arrays(contexts: np.ndarray, words: np.ndarray, universe: int, vocabulary: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """A level of the trie: its contexts, monotone pointers and sequence of keys, from sorted pairs of a
    context and a word; the distinct contexts, and the place of each pair's context among them."""
    distinct, first = np.unique(contexts, return_index=True)
    own = np.repeat(np.arange(len(distinct)), np.diff(np.append(first, len(contexts))))
    # A key is (context's place, successor), so the whole sequence is monotone.
    keys = own.astype(U64) * U64(vocabulary) + words.astype(U64)
    arrays = {}
    for name, ef in (("c", encode(distinct, universe)), ("p", encode(np.append(first, len(contexts)).astype(U64), len(contexts) + 1)), ("s", encode(keys, max(1, len(distinct) * vocabulary)))):
        arrays |= {f"{name}_{k}": v for k, v in ef.items()}
    return arrays | {"bits": bits_of(mix(contexts.astype(U64)) + words.astype(U64))}, distinct, own


class Level:
    """A mapped level. ``codes``: of the n-grams' shares."""

    def __init__(self, uri: str, vocabulary: int):
        self.arrays, self.vocabulary = map_arrays(uri), vocabulary
        self.contexts, self.pointers, self.sequence = (EliasFano(*(self.arrays[f"{k}_{x}"] for x in ("n", "low", "lows", "high", "ones"))) for k in "cps")

    def find(self, contexts: np.ndarray, words: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """The place of each n-gram, -1 where there is none. ``places``: those of the contexts, where they are known."""
        out = np.full(len(contexts), -1, np.int64)
        held = np.flatnonzero(may_have(self.arrays["bits"], mix(contexts) + words))
        if not len(held):
            return out
        at = self.place(contexts[held]) if places is None else places[held]
        held, at = held[at >= 0], at[at >= 0]
        want = at.astype(U64) * U64(self.vocabulary) + words[held]
        order = np.argsort(want)  # neighbours are searched one after the other
        held, at, want = held[order], at[order], want[order]
        new = np.diff(at, prepend=-1) > 0
        back = np.cumsum(new) - 1
        first, last = (x.astype(np.int64)[back] for x in self.pointers.range(at[new]))
        out[held] = self.sequence.find(want, first, last)
        return out

    def place(self, contexts: np.ndarray) -> np.ndarray:
        """The place of each context on the level, -1 where it has no successors."""
        which, back = np.unique(contexts, return_inverse=True)
        return self.contexts.find(which)[back]


def _build_second(table: pa.Table, folder: str, sizes: list[int], discount: float) -> pa.Table:
    """Writes a shard's second level; gives what it has of each context's shares, as blobs of blocks of words."""
    shard, words = table.column("shard")[0].as_py(), int(sum(sizes))
    keys, counts = read_packed(f"{folder}/raw/pairs-{shard}")
    arrays, distinct, own = level_arrays(keys >> U64(32), keys & U64(0xFFFFFFFF), words + 1, words)
    codes = quantise(np.log10(np.maximum(counts.astype(np.float64) - discount, 1e-12) / counts_at(folder, sizes, distinct.astype(np.int64))[own]))
    write_arrays(f"{folder}/second-{shard}", **arrays, codes=codes)
    sums = np.round(np.bincount(own, 10 ** restore(codes), len(distinct)) * UNIT).astype(U64)
    owner = distinct // U64(WORDS_A_SHARD)
    rows = [(shard, int(b), blob(distinct[owner == b], sums[owner == b])) for b in np.unique(owner)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["made", "shard", "blob"])


def _build_third(table: pa.Table, folder: str, sizes: list[int], discount: float) -> pa.Table:
    shard, words = table.column("shard")[0].as_py(), int(sum(sizes))
    keys, counts = read_packed(f"{folder}/raw/triples-{shard}")
    pairs = read_packed(f"{folder}/raw/pairs-{shard}")[1]
    arrays, distinct, own = level_arrays(keys >> U64(32), keys & U64(0xFFFFFFFF), len(pairs) + 1, words)
    codes = quantise(np.log10(np.maximum(counts.astype(np.float64) - discount, 1e-12) / pairs[distinct.astype(np.int64)].astype(np.float64)[own]))
    passes = left_over(np.bincount(own, 10 ** restore(codes), len(distinct)))
    parents = np.zeros((len(pairs) + 63) // 64, U64)
    np.bitwise_or.at(parents, (distinct >> U64(6)).astype(np.int64), U64(1) << (distinct & U64(63)))
    write_arrays(f"{folder}/third-{shard}", **arrays, codes=codes, passes=passes, parents=parents)
    return pa.table({"shard": pa.array([shard], pa.int32())})


class Model:
    """The mapped trie."""

    def __init__(self, info: dict):
        self.info, folder = info, info["folder"]
        self.level = Level1(folder, info["sizes"])
        self.words, self.total = sum(info["sizes"]), info["tokens"]
        self.end = int(self.level.look(np.array([END], U64))[0][0]) if self.words else -1
        self.passes = {b: map_arrays(f"{folder}/passes-{b}")["codes"] for b in info["blocks"]}
        self.second, self.third = ({s: Level(f"{folder}/{name}-{s}", self.words) for s in info[name]} for name in ("second", "third"))

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.total + self.words + 1.0)

    def passed(self, contexts: np.ndarray) -> np.ndarray:
        out = np.ones(len(contexts))
        for b in np.unique(contexts[contexts >= 0] // WORDS_A_SHARD):
            if b in self.passes:
                own = (contexts >= 0) & (contexts // WORDS_A_SHARD == b)
                out[own] = 10 ** restore(self.passes[b][contexts[own] - b * WORDS_A_SHARD])
        return out

    def pairs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct pair of known words its shard, its place there (-1: never seen) and its discounted share."""
        owner, place, share = shard_of(spread(keys, self.words), self.words, self.info["shards"]), np.full(len(keys), -1, np.int64), np.zeros(len(keys))
        for s, own in _dealt(owner, self.info["shards"]):
            if s in self.second:
                level = self.second[s]
                place[own] = level.find(keys[own] >> U64(32), keys[own] & U64(0xFFFFFFFF))
                ok = own[place[own] >= 0]
                share[ok] = 10 ** restore(level.arrays["codes"][place[ok]])
        return owner.astype(np.int64), place, share

    def triples(self, owner: np.ndarray, place: np.ndarray, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """owner, place: shards and places of distinct pairs. Of each trigram (which of these its first pair is, number
        of its word or -1) the weight that the pair passes on, and the trigram's own discounted share."""
        passed, context, share = np.ones(len(owner)), np.full(len(owner), -1, np.int64), np.zeros(len(first))
        known = np.flatnonzero(place >= 0)
        for s, own in _dealt(owner[known], self.info["shards"]):
            if s not in self.third:
                continue
            level, own = self.third[s], known[own]
            at = place[own].astype(U64)
            own = own[(level.arrays["parents"][(at >> U64(6)).astype(np.int64)] >> (at & U64(63)) & U64(1)).astype(bool)]
            context[own] = level.place(place[own].astype(U64))
            passed[own] = 10 ** restore(level.arrays["passes"][context[own]])
        some = np.flatnonzero((context[first] >= 0) & (words >= 0))
        for s, own in _dealt(owner[first[some]], self.info["shards"]):
            level, own = self.third[s], some[own]
            found = level.find(place[first[own]].astype(U64), words[own].astype(U64), context[first[own]])
            share[own[found >= 0]] = 10 ** restore(level.arrays["codes"][found[found >= 0]])
        return passed[first], share

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base and score of each coded text, and its score without the third level."""
        own, numbers = pd.factorize(ids)
        many = np.int64(len(numbers))
        counts = np.zeros(len(numbers), np.int64)
        if (numbers >= 0).any():
            counts[numbers >= 0] = counts_at(self.info["folder"], self.info["sizes"], numbers[numbers >= 0])
        base, passed = self.unigram(counts), self.passed(numbers)
        context = np.concatenate([own[-1:], own[:-1]])  # the last token is an end, as before every text
        # Pairs by the places of their words, each distinct one once.
        codes, distinct = pd.factorize(context * many + own)
        a, b = numbers[distinct // many], numbers[distinct % many]
        owner, place, share = np.zeros(len(distinct), np.int64), np.full(len(distinct), -1, np.int64), np.zeros(len(distinct))
        both = np.flatnonzero((a >= 0) & (b >= 0))
        owner[both], place[both], share[both] = self.pairs(a[both].astype(U64) << U64(32) | b[both].astype(U64))
        two = passed[context] * base[own] + share[codes]
        # A token's trigram has the pair before it as its context, but for the first token of a text.
        place[b == self.end] = -1
        again, trigrams = pd.factorize(codes[:-1] * many + own[1:])
        weight, extra = self.triples(owner, place, trigrams // many, numbers[trigrams % many])
        three = two.copy()
        three[1:] = weight[again] * two[1:] + extra[again]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = lambda x: np.add.reduceat(x, first)
        return sizes, sums((counts > 0)[own].astype(np.int64)), sums(np.log10(base)[own]), sums(np.log10(three)), sums(np.log10(two))


def _score(batches: Iterator[pa.RecordBatch], info: dict) -> Iterator[pa.RecordBatch]:
    model = Model(info)
    for batch, ids, sizes in _sequences(batches):
        n, known, base, score, _ = model.score(ids, sizes)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.total] * batch.num_rows, pa.int64()), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _discount(once: int | None, twice: int | None) -> float:
    return (once or 0) / max(1, (once or 0) + 2 * (twice or 0)) or 0.5


def fit(docs: DataFrame) -> tuple[dict, DataFrame]:
    """Builds the trie from the texts of ``docs`` (doc_id, text, held_out) that aren't held out; gives what a
    task needs to map it, and all texts coded (doc_id, held_out, ids)."""
    spark = docs.sparkSession
    folder = scratch(spark, "trie")
    docs = docs.select("doc_id", "text", "held_out")
    train = docs.where("not held_out").select("text")
    texts, size = train.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    shards = max(4, (size or 0) // (6 * TOKENS_A_SHARD) + 1)
    by_shard = lambda blobs: blobs.repartition(shards, "shard").groupBy("shard")
    with Scratch(spark) as tmp:
        blobs = train.mapInArrow(partial(_count_words, shards=shards), "shard int, blob binary")
        stats = tmp.stored(by_shard(blobs).applyInArrow(lambda t: _build_words(t, folder), "shard int, words long, tokens long"), "words").collect()
        sizes = [0] * shards
        for r in stats:
            sizes[r["shard"]] = r["words"]
        n, total = sum(sizes), sum(r["tokens"] for r in stats)
        if n >= UNKNOWN:
            raise ValueError("the vocabulary has 2^32 words or more")
        info = {"folder": folder, "sizes": sizes, "tokens": total, "shards": shards, "second": [], "third": [], "blocks": []}
        kind = docs.schema["doc_id"].dataType.simpleString()
        own = stored(docs.mapInArrow(partial(_code, folder=folder, sizes=sizes), f"doc_id {kind}, held_out boolean, ids binary"), "coded")
        if not total:
            return info, own
        count = "shard int, once long, twice long"
        known = own.where("not held_out").select("ids")
        blobs = lambda f: known.mapInArrow(partial(f, folder=folder, sizes=sizes, shards=shards), "shard int, blob binary")
        pairs = tmp.stored(by_shard(blobs(_count_pairs)).applyInArrow(lambda t: _merge_pairs(t, folder, n), count), "pairs")
        triples = tmp.stored(by_shard(blobs(_count_triples)).applyInArrow(lambda t: _merge_triples(t, folder, n), count), "triples")
        second, third = (_discount(*df.agg(F.sum("once"), F.sum("twice")).first()) for df in (pairs, triples))
        made = tmp.stored(by_shard(pairs.select("shard")).applyInArrow(lambda t: _build_second(t, folder, sizes, second), "made int, shard int, blob binary"), "second")
        info["second"] = [r[0] for r in made.select("made").distinct().collect()]
        blocks = made.select("shard", "blob").repartition(-(-n // WORDS_A_SHARD), "shard").groupBy("shard")
        info["blocks"] = [r[0] for r in tmp.stored(blocks.applyInArrow(lambda t: _build_passes(t, folder), "shard int"), "passes").collect()]
        info["third"] = [r[0] for r in tmp.stored(by_shard(triples.select("shard")).applyInArrow(lambda t: _build_third(t, folder, sizes, third), "shard int"), "third").collect()]
        remove(spark, f"{folder}/raw")
    return info, own


def op9_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)))
    info, own = fit(docs)
    return own.mapInArrow(partial(_score, info=info), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
