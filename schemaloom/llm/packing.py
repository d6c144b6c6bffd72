"""Operator 4, packing by minimum bin slack.

A document of n tokens fills n // 4096 windows alone; the rest, shorter than a window, joins a
multiset of remaining lengths. For each window the longest remaining length is fixed, and a
subset-sum dynamic program over the others (one big integer is the bitset of reachable sums, each
length taken in powers of two up to its count) finds the multiset that comes closest to the
window; the counts are read back through the stages. Where no multiset fits exactly, the longest
piece left over is cut, so a block wastes nothing. Only the last window of a task stays partly
filled; those windows, one per task at most, are packed once more, unevenly long pieces whole, in
groups of ``GROUP`` tasks.

A task holds one block of at most ``BLOCK_TOKENS`` tokens, whatever the size of its partition or
of a text. Token ids are those of the whole text: words between ASCII white space are tokenized
once each and kept in a bounded table, which gives the same ids, as the tokenizer drops white
space and never joins across it.

Defined results: a null text is an empty one, of one end token. Rows with the same doc_id are
packed as separate documents. Ties between lengths don't exist; equal lengths are taken in row
order. A null doc_id is carried. Empty tables give no pieces.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, utf8

WINDOW, END = 4096, 2
BLOCK_TOKENS = 1 << 22
CACHE_WORDS = 500_000
#: Bytes of texts whose words are numbered at once.
BATCH = 1 << 20
MARKS = ".,;:!?#*$%&|"
GROUP = 4096
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], order: list[int], capacity: int) -> dict[int, int]:
    """Lengths and how often each is taken: the longest one, and what comes closest to the capacity
    with it. ``order``: the lengths in stock, ascending, none over the capacity."""
    first, mask = order[-1], (1 << (capacity + 1)) - 1
    reach, stages = 1 << first, []
    for x in reversed(order):
        left = counts[x] - (x == first)
        left = min(left, (capacity - first) // x)
        step = 1
        while left > 0:
            take = min(step, left)
            stages.append((x, take, reach))
            reach |= (reach << (x * take)) & mask
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    best, taken = reach.bit_length() - 1, {first: 1}
    for x, take, before in reversed(stages):
        if not before >> best & 1:
            best -= x * take
            taken[x] = taken.get(x, 0) + take
    return taken


def pack(lengths: list[int], capacity: int, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length). With ``cut``, all windows but the last are full."""
    stock: dict[int, list[tuple[int, int]]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        if lengths[i]:
            stock.setdefault(lengths[i], []).append((i, 0))
    counts = {x: len(v) for x, v in stock.items()}
    order, out = sorted(counts), []

    def drop(x: int) -> None:
        if not counts[x]:
            del counts[x], stock[x], order[bisect_left(order, x)]

    while counts:
        taken = fill(counts, order, capacity)
        slack = capacity - sum(x * n for x, n in taken.items())
        # The same multiset serves as many windows as the counts allow.
        times = min(counts[x] // n for x, n in taken.items()) if not slack or not cut else 1
        for _ in range(times):
            own = []
            for x, n in taken.items():
                for _ in range(n):
                    item, start = stock[x].pop()
                    own.append((item, start, x))
                counts[x] -= n
            out.append(own)
        for x in taken:
            drop(x)
        if slack and cut and counts:
            x = order[-1]
            item, start = stock[x].pop()
            counts[x] -= 1
            drop(x)
            part = min(slack, x)
            out[-1].append((item, start, part))
            if x > part:
                if x - part not in counts:
                    insort(order, x - part)
                stock.setdefault(x - part, []).append((item, start + part))
                counts[x - part] = counts.get(x - part, 0) + 1
    return out


class Words:
    """Ids of texts, through a bounded table of the ids of words."""

    def __init__(self, path: str, end: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end, self.known = array("I", [end]).tobytes(), {}

    def learn(self, words: set[bytes]) -> None:
        """A word's ids are those of what stands before its closing marks and of the marks, as the
        tokenizer never joins letters and marks. What may hold a special token is left as it is."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {w: x for w in words if (x := self.known.get(w)) is not None}
        known = self.known
        new = list(words - known.keys())
        spelled, other, parts, unseen = [], [], [], {}
        for w, t in zip(new, b" ".join(new).decode("utf-8", "replace").split(" ")):
            if t.isalpha():
                spelled.append((w, t))
            elif (core := t.rstrip(MARKS)) != t and core[-1:].lower().isalnum() and "<|" not in core:
                n = len(core) - len(t)  # marks are one byte each
                parts.append((w, w[:n], w[n:]))
                if w[:n] not in known and w[:n] not in words:
                    unseen[w[:n]] = core
                if w[n:] not in known and w[n:] not in words:
                    unseen[w[n:]] = t[n:]
            else:
                other.append((w, t))
        for k, x in unseen.items():
            (spelled if x.isalpha() else other).append((k, x))
        for at in range(0, len(spelled), 2048):
            self._spelled(spelled[at : at + 2048])
        self._encode(other)
        for w, core, marks in parts:
            known[w] = known[core] + known[marks]

    def _encode(self, words: list[tuple[bytes, str]]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            for (w, _), e in zip(some, self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)):
                self.known[w] = array("I", e.ids).tobytes()

    def _spelled(self, words: list[tuple[bytes, str]]) -> None:
        """Words of letters alone, as one text: each ends at the first token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join([t for _, t in words])], add_special_tokens=False)[0].ids, np.uint32)
        cuts = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        if len(cuts) != len(words):  # a letter whose lower case isn't one
            self._encode(words)
            return
        ids = ids.tobytes()
        self.known.update(zip([w for w, _ in words], [ids[a:b] for a, b in zip([0, *cuts], cuts)]))

    def ids(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end token.

        Texts are put in lower case first, as the tokenizer does it too; not those that may hold a
        special token, which it looks for before, or a combining mark (U+0300 to U+036F, whose first
        bytes stand for nothing else but U+0370 to U+037F), with which it composes letters before: H, J,
        T, W and Y take marks in lower case that they don't take in upper case.
        """
        split = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split() if t else [] for t in texts]
        self.learn(set().union(*split) if split else set())
        get = self.known.__getitem__
        for words in split:
            yield b"".join(map(get, words)) + self.end


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int) -> Iterator[pa.RecordBatch]:
    words, part = Words(path, end), TaskContext.get().partitionId()
    held: list[tuple[object, int, int, bytes]] = []  # doc_id, start, tokens of the document, ids of the rest
    rows: list[tuple] = []
    state = {"sequence": part << 32, "tokens": 0}

    def close(last: bool) -> None:
        nonlocal held
        windows = pack([len(x[3]) // 4 for x in held], window, cut=True)
        back = []
        for k, own in enumerate(windows):
            if k == len(windows) - 1 and not last and sum(n for _, _, n in own) < window:
                back = [(held[i][0], held[i][1] + s, held[i][2], held[i][3][4 * s : 4 * (s + n)]) for i, s, n in own]
                break
            offset = 0
            for i, s, n in own:
                doc, start, total, ids = held[i]
                rows.append((doc, start + s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), total, state["sequence"], offset))
                offset += n
            state["sequence"] += 1
        held, state["tokens"] = back, sum(len(x[3]) // 4 for x in back)

    def flush():
        columns = list(zip(*rows)) or [()] * 7
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECE.split(", ")])

    for batch in small_batches(batches, BATCH):
        for doc, ids in zip(batch.column("doc_id").to_pylist(), words.ids(utf8(batch.column("text")))):
            n = len(ids) // 4
            full = n - n % window
            for s in range(0, full, window):
                rows.append((doc, s, window, zlib.crc32(ids[4 * s : 4 * (s + window)]), n, state["sequence"], 0))
                state["sequence"] += 1
            if n > full:
                held.append((doc, full, n, ids[4 * full :]))
                state["tokens"] += n - full
        if state["tokens"] >= BLOCK_TOKENS:
            close(last=False)
        if len(rows) > 20_000:
            yield flush()
    close(last=True)
    yield flush()


def _join_rests(batch: pa.Table, window: int) -> pa.Table:
    """The partly filled windows of a group of tasks, packed whole."""
    rests = batch.sort_by("sequence_id").to_pydict()
    chosen = pack(rests["tokens"], window, cut=False)
    was, now, shift = [], [], []
    for own in chosen:
        at = 0
        for i, _, n in own:
            was.append(rests["sequence_id"][i])
            now.append(rests["sequence_id"][own[0][0]])
            shift.append(at)
            at += n
    return pa.table({"sequence_id": pa.array(was, pa.int64()), "now": pa.array(now, pa.int64()), "shift": pa.array(shift, pa.int64())})


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    One pass over the texts; only the rests, a row a task, are shuffled.
    """
    pieces = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_pieces, path=tokenizer, window=window, end=end), PIECE), "pieces")
    # A piece shorter than the window may stand in a rest; full windows of one piece can't.
    rests = pieces.where(F.col("length") < window).groupBy("sequence_id").agg(F.sum("length").alias("tokens")).where(F.col("tokens") < window)
    moves = rests.withColumn("g", F.expr(f"shiftright(sequence_id, 32) div {GROUP}")).groupBy("g").applyInArrow(lambda t: _join_rests(t, window), "sequence_id long, now long, shift long")
    out = pieces.join(moves, "sequence_id", "left")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("now", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
