"""Operator 10, near duplicates by min-max hashing.

A text's set is its distinct word shingles. Each permutation is evaluated once per shingle and
gives two signature values, its minimum and its maximum, so a signature of 2P values costs P
evaluations a shingle. Minima and maxima are both unbiased for the Jaccard similarity. Bands of
``ROWS`` values are buckets; texts that share one are candidates, and a link counts only when
the full shingle sets, made again from the texts, confirm it.

Large groups stay linear:

* texts with equal sets are one class, whose least doc_id stands for it (no buckets, no pairs);
* a bucket first links its members to its least member (a star), not to each other;
* the verified stars give components. Where a bucket still holds several, its members outside the
  largest one (the outsiders) are compared with all members: blocks of ``OUTSIDERS`` of them meet
  blocks of ``MEMBERS``, so a bucket of n members with r outsiders moves about n * r / OUTSIDERS + n
  rows, and one with a single outsider n;
* in a first pass these rows are numbers and signatures. A block names the ``FIRST`` pairs at most of
  each component whose signatures agree best, of those that agree in ``ESTIMATE`` of their values (six
  standard deviations below the threshold), and says whether it held pairs back. Only the texts of
  named pairs are fetched and compared;
* a second pass, over the buckets that held pairs back and still hold several components, carries the
  full sets too. Its blocks compare all pairs that may be links and are apart, and give out links.

A link that can change a component is thus lost only where banding misses it: with 32 bands of 4
values a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^32 < 5e-8.

Joins on a digest, bucket or centre that a large part of the rows may share have a stored table on
their other side, so that adaptive execution can split the hot partition.

Defined results: doc_ids are integers. A text without words, or null, has an empty set, is linked
with nothing and is its own component. Fewer words than a shingle: the whole sequence is the one
shingle. Rows with equal doc_ids are one document if their sets are equal, and are otherwise joined
through that doc_id; a row with a null doc_id is left out of components (component_id null, kept
true). ``keep`` keeps extra columns, whatever their names, and all rows of a doc_id that stays, so
rows that are repeated with their doc_id stay repeated. Empty tables give empty tables. Components
that don't settle in ``most`` rounds are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small_batches, stored, unused, utf8

PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
PERCENT = 80
#: Agreeing signature values, of 2 * PERMUTATIONS, from which a pair is verified.
ESTIMATE = int(2 * PERMUTATIONS * (PERCENT / 100 - 6 * (0.16 / (2 * PERMUTATIONS)) ** 0.5))
OUTSIDERS, MEMBERS = 512, 8192
#: Pairs that a block names for a component in the first pass.
FIRST = 2
#: Rows of small buckets that are handled together; bytes of sets in a side of a block, or in a group, of the second pass.
ROWS_A_GROUP, SET_BYTES = 4096, 64 << 20

_rng = np.random.default_rng(20)
_MUL = _rng.integers(1 << 62, size=PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1 << 63, size=PERMUTATIONS, dtype=np.uint64)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    codes = dict.fromkeys(words)
    for w in codes:
        codes[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """2 * PERMUTATIONS values of 32 bits; the minima and the maxima of each permutation."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(s), 1024):  # in cache-sized blocks
        x = s[None, at : at + 1024] * _MUL[:, None]
        x += _ADD[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high], axis=1).reshape(-1) >> np.uint64(32)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """doc_id, set size, a 128-bit digest of the set and its signature."""
    for batch in small_batches(batches):
        sizes, digests, sigs = [], [], []
        for text in utf8(batch.column("text")):
            s = shingles(text, k)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).astype(np.uint32).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sigs.shape[:2])
        for r in range(ROWS):
            key = (key ^ sigs[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
            key = key ^ (key >> np.uint64(32))
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(ids))), pa.array(np.repeat(ids, BANDS))], ["bucket", "band", "id"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures leave a link possible."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, 2 * PERMUTATIONS) for c in ("sig_a", "sig_b"))
        yield batch.filter(pa.array((a == b).sum(axis=1) >= ESTIMATE)).select(["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets, made from the texts, confirm the link."""
    for batch in small_batches(batches):
        keep, seen = [], {}
        for x, y, s, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), utf8(batch.column("text_a")), utf8(batch.column("text_b"))):
            for text in (s, t):
                if text not in seen:
                    seen[text] = shingles(text, k)
            p, q = seen[s], seen[t]
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _full(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Signatures and full sets of texts."""
    for batch in small_batches(batches):
        sets = [shingles(t, k) for t in utf8(batch.column("text"))]
        sigs = [signature(s).astype(np.uint32).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sigs, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "sig", "set"])


def _near(left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each outsider (left) of a bucket its place, those of the members (right) that it may be linked
    with, and in how many values they agree, best first.

    A pair that shares several buckets is looked at in the bucket of its first common band only, by the values
    that the buckets are made of, and a pair of outsiders from its smaller id only.
    """
    band, ids, comps, sigs = int(left["band"][0]), right["id"], right["comp"], right["sig"]
    for i, (x, c, p) in enumerate(zip(left["id"].tolist(), left["comp"].tolist(), left["sig"])):
        at = np.flatnonzero((comps != c) & (~right["outside"] | (ids > x)))
        same = sigs[at] == p
        agree = np.count_nonzero(same, axis=1)
        near = np.flatnonzero(agree >= ESTIMATE)
        near = near[same[near].reshape(len(near), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        near = near[np.argsort(-agree[near], kind="stable")]
        yield i, at[near], agree[near]


def _named(left: dict, right: dict, first: int) -> tuple[list[tuple[int, int]], bool]:
    """The ``first`` best pairs of each outsider's component, and whether there were more."""
    best: dict[int, list[tuple[int, int, int]]] = {}
    more = False
    for i, at, agree in _near(left, right):
        own = best.setdefault(int(left["comp"][i]), [])
        own += zip((-agree[: first + 1]).tolist(), [int(left["id"][i])] * len(at), right["id"][at[: first + 1]].tolist())
        more |= len(own) > first
        own.sort()
        del own[first:]
    return [(min(x, y), max(x, y)) for own in best.values() for _, x, y in own], more


def _linked(left: dict, right: dict, percent: int) -> list[tuple[int, int]]:
    """Links between different components, by full sets; what is joined by one isn't compared again."""
    out, joined = [], {}

    def root(i: int) -> int:
        while joined.get(i, i) != i:
            i = joined[i]
        return i

    for i, at, _ in _near(left, right):
        x, p = int(left["id"][i]), np.frombuffer(left["set"][i], np.uint64)
        for j in at.tolist():
            one, other = root(int(left["comp"][i])), root(int(right["comp"][j]))
            q = np.frombuffer(right["set"][j], np.uint64)
            if one == other or 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                continue
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= percent * (len(p) + len(q) - both):
                joined[max(one, other)] = min(one, other)
                out.append((min(x, int(right["id"][j])), max(x, int(right["id"][j]))))
    return out


def _blocks(left: pa.Table, right: pa.Table, first: int, percent: int) -> pa.Table:
    """One block of outsiders against one of members, or all of those of some small buckets. With sets:
    links; without them: the best pairs."""
    out: list[tuple[int, int, int, bool]] = []
    if left.num_rows and right.num_rows:

        def by_bucket(t: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
            t = t.sort_by("bucket").combine_chunks()
            own = {c: t.column(c).to_numpy() for c in ("bucket", "band", "id", "comp", "outside")}
            own["sig"] = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, 2 * PERMUTATIONS)
            if "set" in t.column_names:
                own["set"] = np.array([*t.column("set").to_pylist(), None], object)[:-1]
            return own, *np.unique(own["bucket"], return_index=True)

        x, names, starts = by_bucket(left)
        y, others, begins = by_bucket(right)
        for k, name in enumerate(names):
            j = int(np.searchsorted(others, name))
            if j == len(others) or others[j] != name:
                continue
            a, b = (slice(at[i], at[i + 1] if i + 1 < len(at) else None) for at, i in ((starts, k), (begins, j)))
            p, q = {c: v[a] for c, v in x.items()}, {c: v[b] for c, v in y.items()}
            found, more = (_linked(p, q, percent), False) if "set" in p else _named(p, q, first)
            out += [(*pair, int(name), more) for pair in found]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.table([pa.array([p[i] for p in out], t) for i, t in enumerate(kinds)], ["a", "b", "bucket", "more"])


def _asked(first: int, percent: int):
    return lambda left, right: _blocks(left, right, first, percent)


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """id, comp: the least id that each end of an edge can reach.

    Rounds of large star and small star, each written to the shared folder; the number of rounds
    grows with the logarithm of the longest path. Rows of hot centres meet in partial aggregates, and
    in joins with stored tables that adaptive execution can split.
    """
    spark = edges.sparkSession
    marks = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    was = marks(e)
    for _ in range(most):
        with Scratch(spark) as tmp:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = tmp.stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
            large = tmp.stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
            low = tmp.stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
            small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
            e = stored(small, "edges")
        now = marks(e)
        if now == was:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        was = now
    raise RuntimeError(f"components haven't settled in {most} rounds")


def _labelled(ids: DataFrame, comps: DataFrame) -> DataFrame:
    return ids.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(partial(_verify, k=k, percent=percent), "a long, b long").distinct()


def _grid(members: DataFrame, comps: DataFrame, sigs: DataFrame, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """sigs: id, sig and, for the second pass, set. Both sides of the comparison inside buckets of several components: outsiders and members, each
    copied to the blocks that it meets. Blocks are bounded by rows, and by the bytes of sets where there are any."""
    named = _labelled(members.select("id", "bucket", "band"), comps)
    held = sigs.select("id", F.octet_length("set").cast("long").alias("w")) if "set" in sigs.columns else None
    named = tmp.stored(named.withColumn("w", F.lit(0).cast("long")) if held is None else named.join(held.groupBy("id").agg(F.sum("w").alias("w")), "id"), "named")
    sizes = named.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("w"))
    mixed = sizes.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum("w").alias("w"), F.max(F.struct("c", "comp", "w")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    blocks = lambda n, w, most: F.ceil(F.greatest(n / most, w / SET_BYTES)).cast("int")
    others = F.col("n") - F.col("top.c"), F.col("w") - F.col("top.w")
    mixed = tmp.stored(mixed.select("bucket", F.col("top.comp").alias("top"), blocks(F.col("n"), F.col("w"), MEMBERS).alias("rs"), blocks(*others, OUTSIDERS).alias("ls"), "n", "w"), "mixed")
    rows, weight = mixed.agg(F.sum("n"), F.sum("w")).first()
    groups = max(1, (rows or 0) // ROWS_A_GROUP, (weight or 0) // SET_BYTES)
    inside = named.drop("w").join(mixed.drop("n", "w"), "bucket").join(sigs, "id").withColumn("outside", F.col("comp") != F.col("top"))
    # Buckets of one block by one block are handled together, so many to a group.
    inside = tmp.stored(inside.withColumn("g", F.when((F.col("ls") == 1) & (F.col("rs") == 1), F.pmod(F.xxhash64("bucket"), F.lit(groups))).otherwise(F.col("bucket"))), "inside")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    alone = ((F.col("ls") == 1) & (F.col("rs") == 1)).alias("alone")
    columns = ("bucket", "band", "id", "comp", "outside", *sigs.drop("id").columns)
    left = inside.where("outside").select(alone, "g", block("ls").alias("i"), each("rs").alias("j"), *columns)
    right = inside.select(alone, "g", each("ls").alias("i"), block("rs").alias("j"), *columns)
    return left, right


def _compared(members: DataFrame, comps: DataFrame, sigs: DataFrame, tmp: Scratch, percent: int) -> DataFrame:
    left, right = _grid(members, comps, sigs, tmp)
    key = ("alone", "g", "i", "j")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_asked(FIRST, percent), "a long, b long, bucket long, more boolean")
    return tmp.stored(found, "pairs")


def _joined(links: DataFrame, new: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links, and the components that they give."""
    return (links, comps) if new.isEmpty() else (both := links.union(new), components(both))


def classes(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(spark) as tmp:
        sets = tmp.stored(docs.mapInArrow(partial(_sets, k=k), "doc_id long, n_shingles long, digest binary, sig binary"), "sets")
        full = sets.where("doc_id is not null and digest is not null").select("doc_id", "digest")
        # Equal sets are one class. Rows that share a doc_id tie their classes together; where it stands
        # for several classes, each of its texts takes part under that one id.
        own = tmp.stored(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "own")
        several = tmp.stored(full.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).where("x != y").select("doc_id"), "several")
        tied = full.join(several, "doc_id", "left_semi").join(own, "digest").groupBy("doc_id").agg(F.min("rep").alias("least"), F.collect_set("rep").alias("reps"))
        links = tmp.stored(tied.select(F.col("least").alias("a"), F.explode("reps").alias("b")).where("a != b").distinct(), "links")
        sigs = own.join(sets.where("digest is not null").select(F.col("doc_id").alias("rep"), "digest", "sig"), ["rep", "digest"])
        sigs = tmp.stored(sigs.select(F.col("rep").alias("id"), "digest", "sig").dropDuplicates(["id", "digest"]).drop("digest"), "signatures")
        buckets = sigs.mapInArrow(_bands, "bucket long, band int, id long")
        centre = tmp.stored(buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("bucket", "a"), "centres")
        members = tmp.stored(buckets.join(centre, "bucket").select("bucket", "band", "id", "a").distinct(), "buckets")
        near = tmp.stored(members.select("id").distinct(), "near")
        texts = docs.select(F.col("doc_id").alias("id"), "text").join(near, "id", "left_semi").withColumn("h", F.xxhash64("text"))
        texts = tmp.stored(texts.dropDuplicates(["id", "h"]).drop("h"), "texts")
        sigs = tmp.stored(sigs.join(near, "id", "left_semi"), "sigs")

        star = members.where("id != a").select("a", F.col("id").alias("b")).distinct()
        sig_a, sig_b = (sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        star = tmp.stored(star.join(sig_b, "b").join(sig_a, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(_agree, "a long, b long").distinct(), "stars")
        links = tmp.stored(links.union(_confirmed(star, texts, k, percent)), "links")
        comps = components(links)

        # Buckets that still hold several components: first by signatures, then by sets where pairs were held back.
        found = _compared(members, comps, sigs, tmp, percent)
        new = tmp.stored(_confirmed(found.select("a", "b").distinct(), texts, k, percent), "links")
        links, comps = _joined(links, new, comps)
        members = tmp.stored(members.join(found.where("more").select("bucket").distinct(), "bucket", "left_semi"), "held")
        if not members.isEmpty():
            some = texts.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(partial(_full, k=k), "id long, sig binary, set binary")
            found = _compared(members, comps, some, tmp, percent)
            links, comps = _joined(links, found.select("a", "b"), comps)

        rep = tmp.stored(_labelled(own.select(F.col("rep").alias("id"), "digest"), comps).select("digest", F.col("comp").alias("component")), "labels")
        return stored(sets.join(rep, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "classes")


def keep(docs: DataFrame, k: int = 5, percent: int = PERCENT, also: DataFrame | None = None) -> DataFrame:
    """One document of each component, the one with the least doc_id, with all its columns.

    ``also``: further texts (doc_id, text) that stand for these documents; near copies of them link too.
    """
    texts = docs.select("doc_id", "text")
    out = classes(texts if also is None else texts.union(also.select("doc_id", "text")), k, percent)
    gone = unused("gone", docs)
    out = out.where("doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(out, docs["doc_id"] == F.col(gone), "left_anti")


def op10_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs, k=4).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Every pair with a common shingle, by exact set sizes; components by recursion.
NEAR_SQL = r"""
nd_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
nd_sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+{k}-1], ' ') FOR i IN range(1, len(w) - {k} + 2)]) END AS s FROM nd_words),
nd_class AS (SELECT min(doc_id) AS rep, list_sort(s) AS s FROM nd_sets WHERE len(s) > 0 GROUP BY list_sort(s)),
nd_item AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM nd_class),
nd_link AS (SELECT a.rep AS x, b.rep AS y FROM nd_item a JOIN nd_item b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
nd_both AS (SELECT x, y FROM nd_link UNION ALL SELECT y, x FROM nd_link),
nd_reach AS (SELECT rep AS x, rep AS y FROM nd_class UNION SELECT r.x, b.y FROM nd_reach r JOIN nd_both b ON r.y = b.x),
nd_comp AS (SELECT x AS rep, min(y) AS component FROM nd_reach GROUP BY x),
nd AS (SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component, s.doc_id) AS component_id, coalesce(m.component, s.doc_id) = s.doc_id AS kept
       FROM nd_sets s LEFT JOIN nd_class c ON list_sort(s.s) = c.s LEFT JOIN nd_comp m USING (rep))
"""
OP10_SQL = "WITH RECURSIVE " + NEAR_SQL.format(docs="documents", k=4) + "SELECT * FROM nd"
