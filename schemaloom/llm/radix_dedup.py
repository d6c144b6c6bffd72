"""Operator 13, exact dedup: compressed radix tries own the texts, terminal nodes hold the smallest doc_id.

Texts are equal when their normal forms are: each run of ``[\\x20\\x09-\\x0D]`` is one space there. A task
first counts the equal texts of what it reads, a bounded block at a time, so that a text with many copies
leaves it a few times at most. The counted texts are dealt out by length and content hash, and each task
inserts the whole byte strings of its share into a Patricia trie. Two strings share a terminal node if
they agree in every byte; the hash only says where they meet. A terminal sums rows and keeps the smallest
identifier.

A trie that grows beyond its budget hands over its largest subtree: the counts that it has gathered
leave the task as rows, and so does whatever falls into that place later. These rows are written to the
shared folder with the finished ones, dealt out anew over more tasks, and owned in the next round; nothing
lies in a folder of one machine, so lost executors cost a task's work only. A single string larger than
the budget is held.

Owners of two rows or more go back to the documents by length and digest, as a table of its own, so that
adaptive execution can split a text with very many copies; all other documents own themselves. Should
different strings share length and digest, their owners keep the string, and the documents concerned
are joined by it.

Defined results: null texts count as empty, and equal each other; a text of blanks only is one space.
The smallest doc_id of those that aren't null stays; where all are null, keep_id is null. Rows repeated
with their doc_id count in group_size, and stay or go together; a row with a null doc_id stays only where
all of its group are null. An empty table gives no rows. doc_id is a column of integers.
Extra columns are ignored by ``owners`` and ``classes`` and kept by ``keep``.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small_batches, stored, unused, utf8

BLANKS = b" \t\n\x0b\x0c\r"
#: Bytes of distinct texts that a task counts before it passes them on.
BLOCK = 32 << 20
#: Bytes that a trie may hold, and what a node counts for besides its label.
BUDGET, NODE = 128 << 20, 400
#: Bytes of strings in a batch that leaves a task.
OUT = 8 << 20

Digest = Callable[[bytes], bytes]


def normal(text: bytes | None) -> bytes:
    """Each run of blanks as one space."""
    if not text:
        return b""
    body = b" ".join(text.split())
    if not body:
        return b" "
    return (b" " if text[0] in BLANKS else b"") + body + (b" " if text[-1] in BLANKS else b"")


def sha256(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # by halves, as bytes compare fast
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    __slots__ = ("label", "kids", "ends", "gone")

    def __init__(self, label: bytes):
        self.label, self.kids = label, {}
        self.ends: list | None = None  # [smallest identifier, rows] of the string that ends here
        self.gone = False  # handed over: what passes here is no longer owned


class Trie:
    """A Patricia trie over byte strings that hands over subtrees beyond ``budget`` bytes."""

    def __init__(self, budget: int):
        self.root, self.budget, self.held = _Node(b""), budget, 0
        self.open = 0  # strings owned

    def add(self, body: bytes, least: int | None, rows: int) -> bool:
        """False if the string lies in a subtree that has been handed over."""
        at, rest = self.root, body
        while True:
            if at.gone:
                return False
            if not rest:
                break
            kid = at.kids.get(rest[0])
            if kid is None:
                kid = at.kids[rest[0]] = _Node(rest)
                self.held += len(rest) + NODE
                at, rest = kid, b""
            elif rest.startswith(kid.label):
                at, rest = kid, rest[len(kid.label) :]
            else:
                n = _shared(kid.label, rest)
                mid = at.kids[rest[0]] = _Node(kid.label[:n])
                kid.label = kid.label[n:]
                mid.kids[kid.label[0]] = kid
                self.held += NODE
                at, rest = mid, rest[n:]
        if at.ends is None:
            at.ends = [least, rows]
            self.open += 1
        else:
            at.ends[:] = _least(at.ends[0], least), at.ends[1] + rows
        return True

    def full(self) -> bool:
        """One string is held however long it is, so that every round settles some."""
        return self.held > self.budget and self.open > 1

    @staticmethod
    def _size(node: _Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + NODE
            todo += x.kids.values()
        return total

    def hand_over(self) -> Iterator[tuple[bytes, int | None, int]]:
        """The strings of the largest subtree below the root, which is closed from now on.

        Where one child holds nearly everything, its own largest child is taken, so that a common beginning
        of all texts doesn't close the trie as a whole.
        """
        at, prefix = self.root, b""
        while True:
            size, key = max((self._size(x), k) for k, x in at.kids.items() if not x.gone)
            kid = at.kids[key]
            if 2 * size < self.budget or not any(not x.gone for x in kid.kids.values()):
                break
            at, prefix = kid, prefix + kid.label
        out = list(self.strings(kid, prefix))
        kid.kids, kid.ends, kid.gone = {}, None, True
        self.held -= size - len(kid.label) - NODE
        self.open -= len(out)
        return iter(out)

    def strings(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        todo = [(node or self.root, prefix)]
        while todo:
            x, before = todo.pop()
            if x.gone:
                continue
            body = before + x.label
            if x.ends is not None:
                yield body, *x.ends
            todo += [(kid, body) for kid in x.kids.values()]


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Record batches of about OUT bytes."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += weigh(row) + 64
        if held > OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


COUNTED = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("least", pa.int64()), ("n", pa.int64())])
OWNED = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("body", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("settled", pa.bool_())])


def _count(batches: Iterator[pa.RecordBatch], digest: Digest, block: int) -> Iterator[pa.RecordBatch]:
    """Equal texts of a block as one row."""

    def rows():
        seen: dict[bytes, list] = {}
        held = 0
        for batch in small_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                body = normal(text)
                own = seen.get(body)
                if own is None:
                    seen[body] = [doc, 1]
                    held += len(body) + NODE
                    if held > block:
                        yield from seen.items()
                        seen, held = {}, 0
                else:
                    own[0], own[1] = _least(own[0], doc), own[1] + 1
        yield from seen.items()

    each = ((len(body), digest(body), body, *own) for body, own in rows())
    yield from _batches(each, COUNTED, lambda r: r[0])


def _own(batches: Iterator[pa.RecordBatch], digest: Digest, budget: int) -> Iterator[pa.RecordBatch]:
    """Owners of strings that have several rows, and the unsettled rows of subtrees handed over.

    A settled row has its string only where another one of this task has the same length and digest.
    """

    def rows():
        trie = Trie(budget)
        for batch in batches:
            for body, least, n in zip(*(batch.column(c).to_pylist() for c in ("body", "least", "n"))):
                if not trie.add(body, least, n):
                    yield len(body), digest(body), body, least, n, False
                while trie.full():
                    for out, low, count in trie.hand_over():
                        yield len(out), digest(out), out, low, count, False
        keys = Counter((len(body), digest(body)) for body, _, _ in trie.strings())
        twins = {key for key, strings in keys.items() if strings > 1}
        for body, least, n in trie.strings():
            if n > 1 or twins:
                key = (len(body), digest(body))
                if n > 1 or key in twins:
                    yield *key, body if key in twins else None, least, n, True

    yield from _batches(rows(), OWNED, lambda r: len(r[2] or b""))


def _keys(batches: Iterator[pa.RecordBatch], digest: Digest, whole: bool) -> Iterator[pa.RecordBatch]:
    """Length and digests of each document's normal form, and with ``whole`` the form itself."""
    for batch in small_batches(batches):
        bodies = [normal(t) for t in utf8(batch.column(1))]
        hashes = [sha256(b) for b in bodies]
        marks = hashes if digest is sha256 else [digest(b) for b in bodies]
        columns = [batch.column(0), pa.array(map(len, bodies), pa.int64()), pa.array(marks, pa.binary()), pa.array([h.hex() for h in hashes], pa.string()), *([pa.array(bodies, pa.binary())] * whole)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "length", "digest", "text_sha256", "body"][: len(columns)])


def owners(docs: DataFrame, tmp: Scratch, digest: Digest = sha256, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """length, digest, body, least, n: the texts of two rows or more; body only where several share length and digest."""
    spark = docs.sparkSession
    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_count, digest=digest, block=block), "length long, digest binary, body binary, least long, n long")
    parts, done = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    deal = counted.repartition("length", "digest")
    while True:
        out = tmp.stored(deal.mapInArrow(partial(_own, digest=digest, budget=budget), "length long, digest binary, body binary, least long, n long, settled boolean"), "owned")
        settled = out.where("settled").drop("settled")
        done = settled if done is None else done.unionByName(settled)
        left = out.where("NOT settled").drop("settled")
        size, rows = left.agg(F.sum(F.col("length") + NODE), F.count(F.lit(1))).first()
        if not rows:
            return done
        # So many tasks that a share fits, were all strings different.
        parts = max(2 * parts, min(rows, 2 * -(-size // budget)))
        deal = left.repartition(parts, "length", "digest")


def classes(docs: DataFrame, digest: Digest = sha256, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs``."""
    with Scratch(docs.sparkSession) as tmp:
        own = stored(owners(docs, tmp, digest, budget, block), "owners")
    different = not own.where("body IS NOT NULL").isEmpty()  # strings of one length and digest
    columns = [T.StructField("length", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("text_sha256", T.StringType()), T.StructField("body", T.BinaryType())]
    shape = T.StructType([docs.schema["doc_id"], *columns[: 4 if different else 3]])
    keys = docs.select("doc_id", "text").mapInArrow(partial(_keys, digest=digest, whole=different), shape)
    same = (keys["length"] == own["length"]) & (keys["digest"] == own["digest"])
    if different:
        same &= own["body"].isNull() | (own["body"] == keys["body"])
    out, kind = keys.join(own, same, "left"), docs.schema["doc_id"].dataType
    least = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("least").cast(kind))
    return out.select(keys["doc_id"], least.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(least).alias("kept"), "text_sha256")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    of, digest = (unused(c, docs) for c in ("of", "digest"))
    gone = classes(docs).where("NOT kept").select(F.col("doc_id").alias(of), F.col("text_sha256").alias(digest)).distinct()
    own = F.sha2(F.regexp_replace(F.coalesce(docs["text"], F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(of)) & (own == F.col(digest)), "left_anti")


def op13_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, (count(*) OVER w)::BIGINT AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
