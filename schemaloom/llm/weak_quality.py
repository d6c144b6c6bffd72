"""Operator 7, quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote bad, good or nothing on a document; human labels, where a document has
one that may be learned from, are one more labeller. All documents are summed by pattern of votes,
so expectation-maximisation works on exact counts of all of them and on at most 3^n patterns. It
estimates how often each labeller votes what on good and on bad documents, and gives each pattern
the posterior of being good. A document with a human label has that label's posterior from the start
(``TRUST``), so the heuristics' accuracies are learned against it. Two such models stand side by
side, one for quality and one for toxicity.

The toxic head has three labellers of which each counts words the others don't: words learned from
the labels, beginnings of other words learned from them, and a general list of insults in four languages
for what is neither. Learned are those in whose documents toxic labels are much more frequent than elsewhere, over all
documents with a label that may be learned from.

The posteriors label a sample, chosen by a hash of doc_id: about ``SAMPLE_DOCS`` documents with a
human label and ``SAMPLE_REST`` without, which count ``REST_WEIGHT`` each. On them a linear scorer is
trained for each of the two by logistic regression: first over a few rates and the bad votes by
Newton's method, then, for what these leave over, over 2^20 hashed features (a text's distinct words
and their beginnings) that stand in ``MIN_DOCS`` sampled texts or one in 125, whichever is less, but
three at least. It scores every whole text.

Documents with a human label carry most of the weight. When all weigh the same and those without one are
the most, the scorer learns to keep bad texts that no heuristic sees: of held-out low-quality documents of
sf0.1 it then rejects 45 to 78 % instead of 98 %, by the human labels' given accuracy and share.

Defined results: a null or empty text gets no labeller's vote but that of length, and score of the
bias alone. Of several labels for a document the worst counts. Without any labels the heuristics
stand alone. Rows are scored by themselves, so null and repeated doc_ids don't matter. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, utf8
from .quality_rules import Doc

BITS, MIN_DOCS, EPOCHS, RATE, L2, RIDGE = 20, 20, 10, 1.0, 1e-3, 1.0
SAMPLE_DOCS, SAMPLE_REST, REST_WEIGHT = 9_000, 3_000, 0.3
TRUST = 0.97
DENSE, PREFIXES = 7 + 8, (4, 6)
PER_WORD = 1 + len(PREFIXES)
CACHE_WORDS = 200_000
ROUNDS = 50
#: Insults whose presence is a vote for toxic, written down from common use in English,
#: German, French and Spanish, not from any table; none is an everyday word of another of these languages.
INSULTS = frozenset(x.encode() for x in "asshole bastard bitch coward creep dumb idiot idiots imbecile jerk loser losers moron morons scumbag stupid arschloch blöd depp dummkopf dumm mistkerl schlampe trottel versager vollidiot abruti bouffon connard connasse crétin débile imbécile minable ordure salaud salope cabrón estúpida estúpido gilipollas idiota imbécil inútil pendejo tonto".split())
#: A term is learned if so many toxic documents hold it, at least, so large a share of its documents is
#: toxic, and the log-likelihood gained over the share of all documents is so large. Terms, at most.
TERM_DOCS, TERM_SHARE, TERM_GAIN, TERMS, TERM_TABLE = 5, 0.8, 12.0, 4_000, 500_000
_TRIM = b".,;:!?\"'()[]#*$%&|<>"

#: Votes: b (bad), g (good), - (none). The first string belongs to quality, the second to toxicity.
HEADS = ("quality", "toxic")
TARGETS = [f"{x}_{h}" for h in HEADS for x in "pw"]


Learned = tuple[frozenset[bytes], frozenset[bytes]]
NOTHING: Learned = (frozenset(), frozenset())


def terms(text: bytes) -> tuple[set[bytes], set[bytes]]:
    """The distinct words of a text and their beginnings."""
    words = {w.strip(_TRIM) for w in set(text.lower().split())}
    words.discard(b"")
    return words, {w[:n] for w in words for n in PREFIXES}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and toxic documents that hold each term, in parts that are to be summed; the empty word is in all."""
    counts: dict[bytes, list[int]] = {}

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(2))], ["term", "n", "bad"])
        counts.clear()
        return out

    for batch in small_batches(batches):
        for text, bad in zip(utf8(batch.column("text")), batch.column("bad").to_pylist()):
            words, starts = terms(text or b"")
            for t in [b"=", *(b"=" + w for w in words), *(b"^" + w for w in starts)]:
                c = counts.setdefault(t, [0, 0])
                c[0] += 1
                c[1] += bad
        if len(counts) > TERM_TABLE:
            yield flush()
    yield flush()


def learn_terms(docs: DataFrame, human: DataFrame) -> Learned:
    """Words and beginnings of words that tell toxic documents. human: doc_id and ht, 1 for toxic."""
    known = docs.join(human.where("ht is not null"), "doc_id").select("text", (F.col("ht") != 0).cast("long").alias("bad"))
    counts = stored(known.mapInArrow(_count_terms, "term binary, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("bad") >= TERM_DOCS), "terms")
    whole = counts.where(F.col("term") == F.lit(b"=")).first()
    if whole is None or whole["bad"] == whole["n"]:
        return NOTHING
    n, bad, share = F.col("n"), F.col("bad"), whole["bad"] / whole["n"]
    gain = bad * F.log(bad / n / share) + F.when(bad < n, (n - bad) * F.log((n - bad) / n / (1 - share))).otherwise(0.0)
    best = counts.where((F.col("term") != F.lit(b"=")) & (bad >= TERM_SHARE * n) & (gain >= TERM_GAIN)).orderBy(gain.desc(), "term").limit(TERMS)
    found = [bytes(r["term"]) for r in best.select("term").collect()]
    words, starts = (frozenset(t[1:] for t in found if t[:1] == k) for k in (b"=", b"^"))
    return words, starts


def heuristics(d: Doc, learned: Learned = NOTHING) -> tuple[str, str]:
    n = d.n_words
    vote = lambda bad, good: "b" if bad else "g" if good else "-"
    quality = vote(10 * d.n_symbols > n, not d.n_symbols) + vote(5 * d.n_upper > d.word_chars, 20 * d.n_upper < d.word_chars) + vote(5 * d.n_repeat_words > 2 * n, not d.n_repeat_words) + vote(3 * d.lines[1] > d.lines[0], not d.lines[1] and d.lines[0] > 1) + vote(n < 10, n >= 100)
    words = {w.strip(_TRIM) for w in set(d.text.lower().split())}
    told, rest = not words.isdisjoint(learned[0]), words - learned[0]
    starts = not all(learned[1].isdisjoint({w[:k] for w in rest}) for k in PREFIXES) if learned[1] else False
    listed = any(all(w[:k] not in learned[1] for k in PREFIXES) for w in rest & INSULTS)
    return quality, vote(listed, False) + vote(told, learned[0] and n) + vote(starts, learned[1] and n and not told)


def rates(d: Doc, learned: Learned = NOTHING) -> list[float]:
    n, chars = max(1, d.n_words), max(1, d.word_chars)
    return [1.0, min(1.0, 4 * d.n_symbols / n), min(1.0, 3 * d.n_upper / chars), d.n_repeat_words / n, d.lines[1] / max(1, d.lines[0]), min(1.0, n / 100), 1 - d.n_distinct / n] + [float(v == "b") for x in heuristics(d, learned) for v in x]


def features(word: bytes) -> tuple[int, ...]:
    w = word.strip(_TRIM)
    mask = (1 << BITS) - 1
    return zlib.crc32(w) & mask, *(zlib.crc32(b"^" + w[:n]) & mask for n in PREFIXES)


def _votes(batches: Iterator[pa.RecordBatch], learned: Learned) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        both = [heuristics(Doc(t), learned) for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k"), pa.array([a for a, _ in both], pa.string()), pa.array([b for _, b in both], pa.string())], ["doc_id", "k", "quality", "toxic"])


def expectation_maximisation(patterns: dict[str, int], rounds: int = ROUNDS, anchored: bool = True) -> dict[str, float]:
    """The posterior of good for each pattern of votes, the last of which is human. ``anchored``: a document with
    a human vote has its posterior from that; else the human voter is one labeller among the others."""
    names = list(patterns)
    if not names:
        return {}
    n = np.array([patterns[x] for x in names], float)
    votes = np.array([["b-g".index(v) for v in x] for x in names])
    label = votes[:, -1] - 1 if anchored else np.zeros(len(votes))
    good = np.clip(0.5 + 0.2 * (votes - 1).sum(axis=1), 0.05, 0.95)
    for _ in range(rounds):
        good = np.where(label == 0, good, np.where(label > 0, TRUST, 1 - TRUST))
        like = []
        for p in (1 - good, good):
            own = np.log((p * n).sum() + 1)
            for j in range(votes.shape[1] - anchored):
                seen = np.array([(p * n)[votes[:, j] == v].sum() for v in range(3)]) + 0.1
                own = own + np.log(seen / seen.sum())[votes[:, j]]
            like.append(own)
        good = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
    good = np.where(label == 0, good, np.where(label > 0, TRUST, 1 - TRUST))
    return dict(zip(names, good.tolist()))


def _rows(batches: Iterator[pa.RecordBatch], learned: Learned) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        sparse, dense = [], []
        for t in utf8(batch.column("text")):
            d = Doc(t)
            sparse.append(np.array(sorted(f for w in set(d.text.lower().split()) for f in features(w)), np.uint32).tobytes())
            dense.append(np.array(rates(d, learned)).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in TARGETS), pa.array(sparse, pa.binary()), pa.array(dense, pa.binary())], [*TARGETS, "sparse", "dense"])


def newton(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression on few columns."""
    v = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        slope = x.T @ (weight * (p - target)) + RIDGE * v
        v -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(v)), slope)
    return v


def train(rows: pa.Table) -> pa.Table:
    """Weights of both heads, the hashed ones by AdaGrad in a fixed order of rows."""
    rows = rows.sort_by([("sparse", "ascending")])
    sparse, dense = ([np.frombuffer(x, t) for x in rows.column(c).to_pylist()] for c, t in (("sparse", np.uint32), ("dense", np.float64)))
    seen = np.zeros(1 << BITS, np.int32)
    sparse = [(len(x), *np.unique(x, return_counts=True)) for x in sparse]
    for _, x, _ in sparse:
        seen[x] += 1
    least = max(3, min(MIN_DOCS, len(sparse) // 125))
    sparse = [(x[often := seen[x] >= least], c[often, None] / max(1, n) ** 0.5) for n, x, c in sparse]
    targets, trust = (np.stack([rows.column(f"{x}_{h}").to_numpy() for h in HEADS], axis=1) for x in "pw")
    share = (targets * trust).sum(axis=0) / trust.sum(axis=0)
    weight = trust * np.where(targets >= 0.5, 0.5 / np.maximum(share, 0.02), 0.5 / np.maximum(1 - share, 0.02))  # both sides count alike
    dense = np.stack(dense)
    v = np.stack([newton(dense, targets[:, k], weight[:, k]) for k in range(2)], axis=1)
    base, w, g = dense @ v, np.zeros((1 << BITS, 2)), np.full((1 << BITS, 2), 1e-3)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(sparse)):
            x, c = sparse[i]
            err = (1 / (1 + np.exp(-np.clip((w[x] * c).sum(axis=0) + base[i], -30, 30))) - targets[i]) * weight[i]
            step = err * c + L2 * w[x]
            g[x] += step**2
            w[x] -= RATE * step / np.sqrt(g[x])
    return pa.table({"head": list(HEADS), "w": [w[:, k].astype(np.float32).tobytes() for k in range(2)], "v": [v[:, k].tobytes() for k in range(2)]})


def _score(batches: Iterator[pa.RecordBatch], weights, learned: Learned) -> Iterator[pa.RecordBatch]:
    w, v = weights.value
    known: dict[bytes, int] = {}
    rows = np.zeros((0, 2), np.float32)
    for batch in small_batches(batches, 4 << 20):
        texts = utf8(batch.column("text"))
        split = [set((t or b"").lower().split()) for t in texts]
        seen = set().union(*split) if split else set()
        new = [x for x in seen if x not in known]
        if len(known) + len(new) > CACHE_WORDS:
            new, known, rows = list(seen), {}, rows[:0]
        known |= {x: len(rows) + i for i, x in enumerate(new)}
        pairs = np.array([features(x) for x in new], np.int64).reshape(-1, PER_WORD)
        rows = np.concatenate([rows, w[pairs].sum(axis=1)])
        out = np.zeros((len(texts), 2))
        for i, (t, words) in enumerate(zip(texts, split)):
            if words:
                out[i] = rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0) / (PER_WORD * len(words)) ** 0.5
            out[i] += np.array(rates(Doc(t), learned)) @ v
        p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p[:, 0]), pa.array(p[:, 1])], ["doc_id", "quality_score", "clean_score"])


def classify(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_rest: int = SAMPLE_REST, rest_weight: float = REST_WEIGHT, anchored: bool = True) -> DataFrame:
    """doc_id, quality_score, clean_score (1: not toxic) and kept, which both must allow.

    docs: doc_id, text; labels: doc_id, quality, toxic, those that may be learned from. With ``rest_weight`` 1 and
    not ``anchored``, posteriors of the labellers alone label what the scorers learn from, human votes being one
    labeller's; the defaults lean on human labels, see above.
    """
    spark = docs.sparkSession
    docs, kind = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()
    human = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("hq"), F.max("toxic").alias("ht"))
    learned = learn_terms(docs, human)
    votes = docs.withColumn("k", F.xxhash64("doc_id", "text")).mapInArrow(partial(_votes, learned=learned), f"doc_id {kind}, k long, quality string, toxic string")
    votes = votes.join(human, "doc_id", "left")
    say = lambda c, good: F.when(F.col(c).isNull(), "-").when(F.col(c) == good, "g").otherwise("b")
    votes = stored(votes.select("doc_id", "k", F.concat("quality", say("hq", 1)).alias("quality"), F.concat("toxic", say("ht", 0)).alias("toxic")), "votes")
    posterior = {}
    for head in HEADS:
        posterior[head] = expectation_maximisation({r[0]: r[1] for r in votes.groupBy(head).count().collect()}, anchored=anchored)
    look = lambda head, c: F.element_at(F.create_map(*(F.lit(x) for kv in posterior[head].items() for x in kv)), F.col(c)) if posterior[head] else F.lit(None).cast("double")
    labelled = F.greatest(*(~F.col(h).endswith("-") for h in HEADS))
    n = {r[0]: r[1] for r in votes.groupBy(labelled).count().collect()}
    most = {x: int((1 << 20) * min(1.0, size / max(1, n.get(x, 0)))) + 1 for x, size in ((True, sample_docs), (False, sample_rest))}
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 20))
    weight = lambda h: F.when(F.col(h).endswith("-"), float(rest_weight)).otherwise(1.0)
    chosen = votes.where(draw < F.when(labelled, most[True]).otherwise(most[False])).dropDuplicates(["k"])
    chosen = chosen.select("k", *(c for h in HEADS for c in (look(h, h).alias(f"p_{h}"), weight(h).alias(f"w_{h}"))))
    sample = docs.withColumn("k", F.xxhash64("doc_id", "text")).where(draw < max(most.values())).join(chosen, "k").select(*TARGETS, "text")
    fitted = sample.mapInArrow(partial(_rows, learned=learned), ", ".join(f"{c} double" for c in TARGETS) + ", sparse binary, dense binary").withColumn("one", F.lit(1)).groupBy("one").applyInArrow(lambda t: train(t.select([*TARGETS, "sparse", "dense"])), "head string, w binary, v binary").collect()
    fitted = {r["head"]: r for r in fitted}
    w = np.stack([np.frombuffer(fitted[h]["w"], np.float32) for h in HEADS], axis=1) if fitted else np.zeros((1 << BITS, 2), np.float32)
    v = np.stack([np.frombuffer(fitted[h]["v"], np.float64) for h in HEADS], axis=1) if fitted else np.zeros((DENSE, 2))
    scored = docs.mapInArrow(partial(_score, weights=spark.sparkContext.broadcast((w, v)), learned=learned), f"doc_id {kind}, quality_score double, clean_score double")
    return scored.withColumn("kept", (F.col("quality_score") >= 0.5) & (F.col("clean_score") >= 0.5))


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents whose crc32(doc_id as text) is a multiple of 5 are left for measuring."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
