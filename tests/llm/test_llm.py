"""The training-data operators against brute force, on small tables with nulls, copies and long texts."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import public_tokenizers
from schemaloom.llm import decontaminate, language_id, line_dedup, min_max_hash, ngram_trie, packing, quality_rules, registry, token_rollup, warc, weak_quality
from schemaloom.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = words(rng, 120)
    passage = words(rng, 60)
    near = base.split()
    out = [None, "", "  \n ", "one", "one two", base, base, base.upper(), " ".join(near[:118] + ["new", "end"]), passage, f"{words(rng, 30)}\n{passage}\n{words(rng, 20)}", f"{passage}\n{words(rng, 9)}"]
    out += ["x" * 50_000, words(rng, 9000), "same " * 100, "\n".join(["a b c"] * 30)]
    return out + [words(rng, rng.randrange(1, 200)) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_counts(docs, texts):
    got = {r["doc_id"]: r for r in quality_rules.measure(docs).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"], got[i]["word_chars"]) == (len(w), len(covered), sum(map(len, w)))
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_rules_that_repeat_others_come_late(monkeypatch):
    """The second of two alike rules rejects nothing that is left, so a rule with fewer rejections goes before it."""
    monkeypatch.setattr(quality_rules, "RULES", dict.fromkeys(["alike1", "alike2", "other", "never"]))
    seconds = {"alike1": 1.0, "alike2": 1.1, "other": 1.0, "never": 0.001}
    assert quality_rules.ranked(seconds, {0b0011: 50, 0b0111: 10, 0b0100: 5, 0: 900}) == ["alike1", "other", "alike2", "never"]
    assert quality_rules.ranked({}, {}) == ["alike1", "alike2", "never", "other"]


def test_quality_keep_agrees(spark, docs):
    want = {r["doc_id"] for r in quality_rules.measure(docs).where("kept").collect()}
    assert {r["doc_id"] for r in quality_rules.keep(docs).collect()} == want
    assert quality_rules.keep(empty(spark)).count() == 0


def test_line_dedup(spark, docs, texts):
    first, out = set(), {}
    places = []
    for i, t in enumerate(texts):
        if t is None:
            continue
        lines = [(p, x, len(x.split())) for p, x in enumerate(t.split("\n")) if x.split()]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(x[2] for x in lines[a : b + 1]) >= 50:
                    places.append((i, lines[a][0], lines[b][0], "\n".join(x[1] for x in lines[a : b + 1])))
                    break
        for b in range(len(lines)):
            for a in range(b, -1, -1):
                if sum(x[2] for x in lines[a : b + 1]) >= 50:
                    places.append((i, lines[a][0], lines[b][0], "\n".join(x[1] for x in lines[a : b + 1])))
                    break
    origin, gone = {}, set()
    for i, a, b, body in sorted(set(places)):
        if origin.setdefault(body, (i, a)) != (i, a):
            gone |= {(i, p) for p in range(a, b + 1)}
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    for i, t in enumerate(texts):
        want = t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        assert got[i] == want
    assert got[6] == "" and got[9] and got[11].count("\n") == 0
    assert line_dedup.dedup(empty(spark)).count() == 0
    twice = line_dedup.dedup(docs.union(docs)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in twice) == sorted((i, t or "") for i, t in got.items() for _ in range(2))


def brute_components(texts, k):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_near_duplicates(spark, docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in min_max_hash.classes(docs, 4).collect()}
    assert got == brute_components(texts, 4)
    kept = {r["doc_id"] for r in min_max_hash.keep(docs, 5).collect()}
    assert kept == {i for i, (_, c) in brute_components(texts, 5).items() if c == i}
    assert min_max_hash.classes(empty(spark), 4).count() == 0
    clash = spark.createDataFrame([(1, "a b c d e"), (1, "f g h i j"), (2, "f g h i j"), (None, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in min_max_hash.classes(clash, 4).collect())[1:] == [(1, 1), (1, 1), (2, 1)]


def test_texts_of_one_shingle(spark):
    """A text of k words has the shingle that it has in a longer text."""
    out = ["ha ha ha ha", "ha ha ha ha ha", "Ha ha ha ha ha ha", "ha ha ha", "a b c d", "a b c d", "x a b c d"]
    df = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in min_max_hash.classes(df, 4).collect()}
    assert got == brute_components(out, 4) and [got[i][1] for i in range(7)] == [0, 0, 0, 3, 4, 4, 6]


def test_chains_of_near_duplicates(spark):
    rng = random.Random(5)
    own, out = [f"w{rng.randrange(10**6)}" for _ in range(100)], []
    for i in range(25):  # each differs a little from the one before, far ends are unlike
        own = own[:]
        for _ in range(2):
            own[rng.randrange(100)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in min_max_hash.classes(df, 4).collect()} == brute_components(out, 4)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(1 << 62, size=900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(1 << 62, size=100, dtype=np.uint64)])
    same = (min_max_hash.signature(np.unique(a)) == min_max_hash.signature(np.unique(b))).mean()
    assert abs(same - 0.8) < 0.15


def test_leaks(spark, docs, texts):
    rng = random.Random(9)
    items = [(i, f"{words(rng, 20)}. {words(rng, 6)}.") for i in range(70)]
    planted = [(1000 + i, f"{words(rng, 150)} {t.upper()} {words(rng, 77)}") for i, t in items[:9]]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    bench = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    found = []
    for shard in (2_000_000, 300):
        rows = decontaminate.leaks(both, bench, shard).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1000 + i, i) for i in range(9)}
        found.append({(r["doc_id"], r["item_id"]): r["score"] for r in rows})
    assert found[0] == pytest.approx(found[1])  # statistics are those of all items
    assert {r["doc_id"] for r in decontaminate.keep(both, bench).collect()} == set(range(len(texts)))
    assert decontaminate.leaks(both, bench.limit(0)).count() == 0


def test_scores_are_those_of_bm25_over_all_items(spark):
    """In shards of 40 words as in one; windows are those of items of like length, however long another item is."""
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(8, 16), 90) for _ in range(60)]
    items = [(i, t) for i, t in enumerate(texts)] + [(500, words(rng, 3000, 90))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (7, texts[7]), (900, items[-1][1])], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id")
    stats = decontaminate.Statistics.of([t.encode() for _, t in items])

    def score(text, item):
        own, size = {}, len(item.split())
        for w in set(item.split()):
            f = item.split().count(w)
            own[w] = math.log(1 + (len(items) - stats.df[w.encode()] + 0.5) / (stats.df[w.encode()] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / stats.mean))
        return sum(own[w] for w in set(text.split()) if w in own) / (decontaminate.RETRIEVE * sum(own.values()))

    import math

    for shard in (2_000_000, 40):
        got = decontaminate.leaks(docs, bench, shard).collect()
        assert all(r["score"] == pytest.approx(score(texts[r["doc_id"] or 0], texts[r["item_id"]])) for r in got if r["item_id"] < 500 and (r["doc_id"] or 0) < 60)
        seen = {(r["doc_id"], r["item_id"]) for r in got}
        assert seen >= {(i, i) for i in range(60)} | {(None, 0), (900, 500)}
        # The window of a short item is at most twice the longest of its kind.
        assert sum(r["doc_id"] == 900 and r["item_id"] < 500 for r in got) == 0
    assert decontaminate.keep(docs, bench).columns == docs.columns and decontaminate.keep(docs, bench).count() == 0


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(2)
    index = decontaminate.Index([(i, words(rng, rng.randrange(8, 40), 60).encode()) for i in range(200)])
    for _ in range(40):
        terms = sorted({index.terms[w.encode()] for w in words(rng, 45, 60).split() if w.encode() in index.terms})
        want = {}
        for t in terms:
            for d, x in zip(index.docs[t], index.impacts[t]):
                want[d] = want.get(d, 0) + x
        got = dict(hit for block in range(index.block_max.shape[1]) for hit in index.wand(terms, block))
        assert got.keys() == {d for d, x in want.items() if x >= 1 - 1e-9}


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["It's <|endoftext|> <|ENDOFTEXT|> don't, can't.", "é́É. İstanbul, ŒUVRE! a.b, c!! d?!", "x y z\x1cq"]
    own = spark.createDataFrame(list(enumerate(odd, 500)), "doc_id long, text string").union(docs.select("doc_id", "text"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in [*enumerate(odd, 500), *enumerate(texts)]}
    rows = packing.pack_documents(own, path).collect()
    seen, fill = {}, {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == seen.get(r["doc_id"], 0)
        seen[r["doc_id"]] = r["start"] + r["length"]
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert (zlib.crc32(part.tobytes()), r["doc_tokens"]) == (r["ids_crc32"], len(ids[r["doc_id"]]))
    assert seen == {i: len(x) for i, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 4096 and sum(n < 4096 for n in fill.values()) <= 2
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_packing_of_odd_rows(spark):
    """Null doc_ids and rows repeated with theirs are documents of their own; clashing names and a 3 MB text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "a b c"), (None, None), (7, "same text"), (7, "same text"), (7, "another text"), (8, "long word " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS sequence_id", "3 AS tokens").repartition(3)
    got = packing.pack_documents(df, path).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == {None: 3 + 1 + 1, 7: 3 + 3 + 3, 8: 600_001}
    assert sorted((r["start"], r["length"]) for r in got if r["doc_id"] == 7) == [(0, 3)] * 3
    held = Counter()
    for r in got:
        held[r["sequence_id"]] += r["length"]
    assert max(held.values()) <= 4096 and sum(n < 4096 for n in held.values()) <= 2


def test_fill_is_closest():
    rng = random.Random(4)
    for _ in range(60):
        counts = Counter(rng.randrange(1, 30) for _ in range(9))
        first = max(counts)
        sums = {first}
        left = counts.copy()
        left[first] -= 1
        for x in left.elements():
            sums |= {s + x for s in sums if s + x <= 60}
        got = packing.fill(dict(counts), sorted(counts), 60)
        assert sum(x * n for x, n in got.items()) == max(sums) and all(n <= counts[x] for x, n in got.items())


def test_warc(spark):
    big = "<p>é" + "y" * 2000
    pages = spark.createDataFrame([(1, "http://a/\n", big), (2, None, big), (3, "u", None), (4, "u", "same"), (5, "u", "same"), (6, "u", big), (None, "u", "\r\n\r\nWARC/1.1\r\n")], "page_id long, url string, html string").repartition(3)
    folder = scratch(spark, "t")
    manifest = warc.write_monoliths(pages, folder)
    got = {r["page_id"]: r for r in warc.read_back(warc.normalise(warc.decide(manifest), folder), folder).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 6), 2: ("revisit", 6), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}
    assert got[1]["payload_bytes"] == len(big.encode()) and got[3]["payload_digest"] == "da39a3ee5e6b4b0d3255bfef95601890afd80709"
    assert warc.write_monoliths(pages.limit(0), folder).count() == 0
    none = warc.decide(warc.write_monoliths(pages.limit(0), folder))
    assert none.count() == 0 and warc.read_back(warc.normalise(none, folder), folder).count() == 0


def test_warc_of_empty_and_long_pages(spark):
    """95 % of the pages are empty: none of them takes part in a join. One page is of 10 MB; names clash."""
    F = warc.F
    long = "x" * 10_000_000
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") < 1900, F.lit("")).when(F.col("id") < 1998, F.concat(F.lit("y" * 1500), F.col("id") % 3)).otherwise(F.lit(long)).alias("html"), F.lit(1).alias("digest"), F.lit(2).alias("archive"), F.lit(3).alias("seq"))
    folder = scratch(spark, "t")
    manifest = warc.write_monoliths(pages.repartition(4), folder)
    decisions = warc.decide(manifest)
    plan = decisions._jdf.queryExecution().optimizedPlan().toString()
    assert "payload_bytes" in plan and "LeftOuter" in plan and plan.index("Union") < plan.index("LeftOuter")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_back(warc.normalise(decisions, folder), folder).collect()}
    assert all(got[i] == ("response", None, 0) for i in range(1900))
    last = {k: max(i for i in range(1900, 1998) if i % 3 == k) for k in range(3)}
    assert all(got[i] == (("response", None, 1501) if i == last[i % 3] else ("revisit", last[i % 3], 1501)) for i in range(1900, 1998))
    assert got[1998] == ("revisit", 1999, 10_000_000) and got[1999] == ("response", None, 10_000_000)


def test_language_id(spark):
    rng = random.Random(6)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60))
    rows = [(i, make("abcdefgh" if i % 2 else "efghijkl"), "x" if i % 2 else "y") for i in range(200)] + [(900, None, "x"), (901, "12 !! 3", "x"), (902, "abab" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", language_id.F.col("doc_id") % 5 == 0)
    models = language_id.fit(df.where("not held_out and lang is not null and text is not null"))
    got = {r["doc_id"]: r for r in language_id.predict(df, models).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:200])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "x"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    # Rejection: texts of a learned language rarely, of one that wasn't learned nearly always.
    odd = [(2000 + i, make("abcdefgh"), None) for i in range(60)] + [(3000 + i, " ".join("".join(rng.choice("mnopqrst") for _ in range(5)) for _ in range(40)), None) for i in range(60)]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("held_out", language_id.F.lit(True))
    many = spark.createDataFrame([(i, make("abcdefgh" if i % 2 else "efghijkl"), "x" if i % 2 else "y") for i in range(700)], "doc_id long, text string, lang string")
    said = {r["doc_id"]: r["rejected"] for r in language_id.predict(more, language_id.fit(many)).collect()}
    assert sum(said[2000 + i] for i in range(60)) <= 4 and all(said[3000 + i] for i in range(60))
    none = language_id.predict(df, language_id.fit(df.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_language_id_of_odd_rows(spark):
    """Null doc_ids, repeated rows and clashing names; texts that are as likely under two languages go to one of them, always the same."""
    same = [(i, "abc abd bcd " * 20, "x" if i % 2 else "y") for i in range(80)] + [(None, "abc abd " * 9, "x"), (None, None, None), (3, "abc " * 30, "x"), (3, "abc " * 30, "x")]
    df = spark.createDataFrame(same, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS gram", "4 AS n", "false AS held_out")
    models = language_id.fit(df.where("lang is not null and text is not null"))
    got = language_id.predict(df.repartition(3), models).collect()
    assert len(got) == len(same)
    ties = {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] is not None and r["doc_id"] != 3}
    assert len(ties) == 1 and next(iter(ties))[0] in ("x", "y")
    assert {r["lang_pred"] for r in got if r["doc_id"] is None} <= {"x", "y", "und"} and sum(r["lang_pred"] == "und" for r in got) == 1


def test_kneser_ney_sums_to_one():
    m = language_id.Models({"a": Counter(g for w in ("abba", "abc", "cab") for s in ["\x02" * 3 + w + "\x03"] for g in (s[i : i + 4] for i in range(len(w) + 1)))})
    for context in ("\x02ab", "abb", "zzz", "\x02\x02\x02"):
        bits = m._bits([context + c for c in "abc\x03z"], m.models)[0]  # z stands for all characters that were never seen
        assert np.exp2(-bits).sum() == pytest.approx(1)


def plain_kneser_ney(words):
    """Probability of a character after a context, by recursion over plain counts."""
    grams = [Counter(s[i : i + 4] for w in words for s in ["\x02" * 3 + w + "\x03"] for i in range(len(w) + 1))]
    for _ in range(3):
        grams.append(Counter(g[1:] for g in grams[-1]))
    grams.reverse()
    size = len(grams[0]) + 1

    def p(context, c, k):
        lower = p(context[1:], c, k - 1) if k else 1 / size
        n = {g: v for g, v in grams[k].items() if g[:-1] == context}
        if not n:
            return lower
        total = sum(n.values())
        return max(n.get(context + c, 0) - 0.75, 0) / total + 0.75 * len(n) / total * lower

    return lambda context, c: p(context, c, 3)


def test_kneser_ney_against_recursion():
    import math

    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    grams = Counter(s[i : i + 4] for w in words for s in ["\x02" * 3 + w + "\x03"] for i in range(len(w) + 1))
    m, p = language_id.Models({"x": grams}), plain_kneser_ney(words)
    for w in (*words[:20], "zab", "ddddddd", "a"):
        s = "\x02" * 3 + w + "\x03"
        want = -sum(math.log2(p(s[i : i + 3], s[i + 3])) for i in range(len(w) + 1))
        assert m.words([w])[0].tolist() == pytest.approx([want, len(w) + 1])


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, universe in ((1, 10), (1000, 1 << 64), (5000, 6000), (700, 1 << 20)):
        values = np.sort(rng.choice(universe, n, replace=False).astype(np.uint64)) if universe <= 1 << 20 else np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        ef = ngram_trie.EliasFano(**ngram_trie.encode(values, universe))
        assert (ef.get(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, values + np.uint64(1), np.array([0, universe - 1], np.uint64)])
        assert (ef.successor(asked) == np.searchsorted(values, asked)).all()


def test_elias_fano_finds_by_low_bits(monkeypatch):
    """Lookups read no element whole: high parts come from the bucket, so only low bits are compared."""
    rng = np.random.default_rng(5)
    for n, universe in ((0, 10), (1, 1 << 64), (5, 5), (700, 900), (3000, 1 << 40), (3000, 1 << 64)):
        values = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        values = np.sort(np.concatenate([values, values[: len(values) // 2] // np.uint64(1 << 6)]))  # crowded at the lower end, with equal ones
        values = np.unique(values) if universe > 900 else values
        ef = ngram_trie.EliasFano(**ngram_trie.encode(values, universe))
        asked = np.concatenate([values, rng.integers(0, universe, 500, dtype=np.uint64), np.array([0, universe - 1], np.uint64)])
        least = np.searchsorted(values, asked)
        equal = np.append(values, np.uint64(0))[least] == asked
        first = rng.integers(0, len(values) + 1, len(asked))
        last = np.minimum(first + rng.integers(0, 40, len(asked)), len(values))
        assert ef._most == (int(values[-1]) >> ef.low if len(values) else 0)
        with monkeypatch.context() as m:
            m.setattr(ef, "get", None)
            assert (ef.successor(asked) == least).all()
            assert (ef.successor(asked, first, last) == np.clip(least, first, last)).all()
            assert (ef.find(asked) == np.where(equal & (least < len(values)), least, -1)).all()
            inside = np.clip(least, first, last)
            same = (inside < last) & (np.append(values, np.uint64(0))[inside] == asked)
            assert (ef.find(asked, first, last) == np.where(same, inside, -1)).all()
            if len(values) > 1:
                at = rng.integers(0, len(values) - 1, 200)
                assert all((x == values[at + k]).all() for k, x in enumerate(ef.range(at)))


def test_scores(spark, docs, texts):
    """Against counts in plain Python, with the model's own codes, to 1e-9."""
    import math

    import pyarrow as pa

    own = docs.withColumn("held_out", ngram_trie.F.col("doc_id") % 3 == 0)
    info, rows = ngram_trie.fit(own.union(own.where("doc_id % 6 = 1")))
    model = ngram_trie.Model(info)
    assert rows.count() == len(texts) + sum(i % 6 == 1 for i in range(len(texts)))
    score_of = lambda m, t: m.score(*ngram_trie.coded(m.level, pa.array(t, pa.string()), m.end))
    tokens = [[*(t or "").lower().encode().split(), b"\n"] for t in texts]
    train = [t for i, t in enumerate(tokens) for _ in range((i % 3 > 0) + (i % 6 == 1))]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([b"\n", *t], t))
    triples = Counter(p for t in train for p in zip([b"\n", *t], t, t[1:]))
    total = sum(c.values())
    discount = lambda n: (one := sum(v == 1 for v in n.values())) / (one + 2 * sum(v == 2 for v in n.values()))
    d, e = discount(pairs), discount(triples)
    # As the trie has them: rounded down to a code, and passing on what the rounded ones leave.
    down = lambda x: float(ngram_trie.restore(ngram_trie.quantise(np.log10(np.array([x]))))[0])
    two_kept, kept = {k: 10 ** down((v - d) / c[k[0]]) for k, v in pairs.items()}, {k: 10 ** down((v - e) / pairs[k[:2]]) for k, v in triples.items()}
    given, gave = Counter(), Counter()
    for (a, _), v in two_kept.items():
        gave[a] += v
    for (a, b, _), v in kept.items():
        given[a, b] += v
    left = lambda x: 10 ** float(ngram_trie.restore(ngram_trie.left_over(np.array([x])))[0])
    n, known, base, score, two = score_of(model, texts)
    for i, t in enumerate(tokens):
        p = [(c[w] + 1) / (total + len(c) + 1) for w in t]
        assert (n[i], known[i]) == (len(t), sum(w in c for w in t)) and base[i] == pytest.approx(sum(map(math.log10, p)))
        q = [u * left(gave[a]) + two_kept.get((a, w), 0) for a, w, u in zip([b"\n", *t], t, p)]
        r = q[:1] + [left(given[a, b]) * u + kept.get((a, b, w), 0) for a, b, w, u in zip([b"\n", *t], t, t[1:], q[1:])]
        assert two[i] == pytest.approx(sum(map(math.log10, q)), rel=1e-9) and score[i] == pytest.approx(sum(map(math.log10, r)), rel=1e-9)
    # Over all words and an unknown one, probabilities sum to one, but for the rounding of two passed weights.
    for a, b in list(given)[::7]:
        assert 1 - 2e-3 <= given[a, b] + left(given[a, b]) * (gave[b] + left(gave[b])) <= 1 + 1e-9
    assert sum(score) > sum(two) + 10  # copies stand out
    got = {r["doc_id"]: r["score"] for r in rows.mapInArrow(ngram_trie.partial(ngram_trie._score, info=info), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").collect()}
    assert all(got[i] == pytest.approx(x) for i, x in enumerate(score.tolist()))
    none, rows = ngram_trie.fit(own.withColumn("held_out", ngram_trie.F.lit(True)))
    assert none["tokens"] == 0 and rows.count() == len(texts) and score_of(ngram_trie.Model(none), ["a b", None])[3].tolist() == [0.0, 0.0]
    assert ngram_trie.fit(own.limit(0))[1].count() == 0


def test_held_out_texts_gain_from_all_ngrams(spark):
    """Mean log10 of a held-out token on real tables: add-one unigrams give -4.07, pairs and trigrams that stand twice -3.84."""
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    F = ngram_trie.F
    r = registry.QUERIES["op9_ngram_trie"](spark, sf).where("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("score"), (F.sum("base_score") / F.sum("n_tokens")).alias("base")).first()
    assert r["base"] == pytest.approx(-4.07, abs=0.01) and r["score"] >= -3.3


def test_copies_of_files_have_no_name(tmp_path, monkeypatch):
    """Files in a store that can't be mapped are copied into one that is gone with the process."""
    import os
    import tempfile

    own = {"keys": np.arange(9, dtype=np.uint64), "n": 4}
    ngram_trie.write_arrays(f"file://{tmp_path}/x", **own)
    monkeypatch.setattr(ngram_trie, "urlparse", lambda uri: type("U", (), {"scheme": "store", "path": ""}))
    before = set(os.listdir(tempfile.gettempdir()))
    got = ngram_trie.map_arrays(f"file://{tmp_path}/x")
    assert got["keys"].tolist() == list(range(9)) and got["n"] == 4 and ngram_trie.map_arrays(f"file://{tmp_path}/x")["n"] == 4
    assert not [f for f in set(os.listdir(tempfile.gettempdir())) - before if "schemaloom" in f]


def test_packed_keys_come_back(tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_trie, "PACKED", 7)
    keys, counts = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 40).astype(np.uint64)), None
    counts = np.arange(len(keys), dtype=np.uint64)
    ngram_trie.write_packed(f"file://{tmp_path}/a", keys, counts)
    assert (ngram_trie.read_packed(f"file://{tmp_path}/a") == np.stack([keys, counts])).all()
    ngram_trie.write_packed(f"file://{tmp_path}/b", keys[:0], counts[:0])
    assert ngram_trie.read_packed(f"file://{tmp_path}/b").shape == (2, 0)


def test_splitting_is_pythons():
    import pyarrow as pa

    odd = [" Ab c\n\x0bD ", "", None, "É e\u00a0f\u2003g", "\x1ca\x1d b", "  "]
    for texts in (odd, [t for t in odd if t is not None]):
        for at in range(len(texts)):
            words, codes, sizes = ngram_trie.split(pa.array(texts).slice(at, 3))
            part = [(t or "").encode().lower().split() for t in texts[at : at + 3]]
            assert [words[i] for i in codes] == [w for t in part for w in t] and sizes.tolist() == [len(t) for t in part]


def test_rollup(spark):
    r = token_rollup.Rollup(spark, scratch(spark, "roll"))
    assert r.totals().count() == 0
    df = spark.createDataFrame([("insert", "a", None, "v1", 5, None, None), ("insert", "a", None, "v1", 7, None, None), ("revise", "a", None, "v2", 9, "v1", 7)], "op string, source string, lang string, tokenizer_version string, n_tokens long, old_version string, old_tokens long")
    assert r.commit("1", df) and not r.commit("1", df)
    assert sorted(map(tuple, r.totals().collect())) == [("a", None, "v1", 1, 5), ("a", None, "v2", 1, 9)]
    r.compact()
    assert not r.commit("1", df) and r.committed("1") and sorted(map(tuple, r.totals().collect())) == [("a", None, "v1", 1, 5), ("a", None, "v2", 1, 9)]
    r.commit("2", df.where("n_tokens = 5").withColumn("op", token_rollup.F.lit("delete")))
    for _ in range(3):  # also without new batches
        assert [tuple(x) for x in r.totals().collect()] == [("a", None, "v2", 1, 9)]
        r.compact()
    assert not r.commit("2", df) and r._names("batch=") == [] and len(r._names("base=")) == 1
    empty_one = token_rollup.Rollup(spark, scratch(spark, "roll"))
    empty_one.compact()
    assert empty_one.commit("x", df.limit(0)) and empty_one.totals().count() == 0


def test_two_writers_of_one_batch(spark):
    """Both have passed the tests before either moves its folder: one commits, the other says that it hasn't."""
    df = spark.createDataFrame([("insert", "a", None, "v1", 5, None, None)], "op string, source string, lang string, tokenizer_version string, n_tokens long, old_version string, old_tokens long")
    path = scratch(spark, "roll")
    first, second = token_rollup.Rollup(spark, path), token_rollup.Rollup(spark, path)
    second.committed = lambda batch: False
    assert first.commit("1", df) and not second.commit("1", df)
    assert [tuple(x) for x in first.totals().collect()] == [("a", None, "v1", 1, 5)] and first._names("_aside") == []


def test_rollup_of_tokenizers(spark, docs, texts):
    """Inserted under one tokenizer and revised to another."""
    from tokenizers import Tokenizer

    files = {"bytes": public_tokenizers.path("byte_bpe_50k.json"), "words": public_tokenizers.path("word_bpe_49k.json")}
    each = token_rollup.stored(token_rollup.tokenized(docs, files), "each")
    want = {}
    for name, path in files.items():
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        want[name] = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    got = {r["doc_id"]: r for r in each.collect()}
    assert all(got[i][name] == n for name, own in want.items() for i, n in enumerate(own))
    F = token_rollup.F
    event = lambda op, version, old: each.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), F.col(version).alias("n_tokens"), F.lit(old).cast("string").alias("old_version"), (F.col(old) if old else F.lit(None)).cast("long").alias("old_tokens"))
    r = token_rollup.Rollup(spark, scratch(spark, "roll"))
    r.commit("1", event("insert", "bytes", None))
    r.commit("2", event("revise", "words", "bytes"))
    total = r.totals().collect()
    assert {x["tokenizer_version"] for x in total} == {"words"} and sum(x["n_tokens"] for x in total) == sum(want["words"]) and sum(x["n_docs"] for x in total) == len(texts)


def test_rollup_of_odd_rows(spark, tmp_path):
    """Null texts have no copies; repeated rows are copies of no smaller id; null groups stand by themselves."""
    rows = [(3, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, "a b", None, None, 3), (4, None, "en", "s", 0), (5, None, "en", "s", 0), (6, "", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["source"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in token_rollup.op8_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {("s", "words-1"): (5, 4), ("s", "marks-2"): (5, 4)}


def test_weak_labels():
    rng = random.Random(8)
    votes = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        votes["".join("-" if rng.random() < 0.3 else ("g" if good == (rng.random() < q) else "b") for q in (0.9, 0.8, 0.7, 0.95))] += 1
    p = weak_quality.expectation_maximisation(dict(votes))
    assert p["gggg"] > 0.95 and p["bbbb"] < 0.05


def plain_em(documents, anchored, rounds=50):
    """A document at a time, with logarithms of products only."""
    import math

    sign = {"b": -1, "-": 0, "g": 1}
    trusted = lambda d: {"g": weak_quality.TRUST, "b": 1 - weak_quality.TRUST}.get(d[-1]) if anchored else None
    good = [min(0.95, max(0.05, 0.5 + 0.2 * sum(sign[v] for v in d))) for d in documents]
    voters = range(len(documents[0]) - anchored)
    for _ in range(rounds):
        good = [trusted(d) if trusted(d) is not None else p for d, p in zip(documents, good)]
        tables, sizes = [], []
        for side in (0, 1):
            mass = [p if side else 1 - p for p in good]
            sizes.append(sum(mass) + 1)
            each = []
            for j in voters:
                seen = {v: 0.1 + sum(m for d, m in zip(documents, mass) if d[j] == v) for v in "b-g"}
                each.append({v: n / sum(seen.values()) for v, n in seen.items()})
            tables.append(each)
        good = []
        for d in documents:
            odds = [math.log(sizes[s]) + sum(math.log(tables[s][j][d[j]]) for j in voters) for s in (0, 1)]
            good.append(1 / (1 + math.exp(min(50, max(-50, odds[0] - odds[1])))))
    return {d: trusted(d) if trusted(d) is not None else p for d, p in zip(documents, good)}


@pytest.mark.parametrize("anchored", [True, False])
def test_em_by_brute_force(anchored):
    """Posteriors of patterns with counts are those of the documents one by one; ties, repeats and voters that say nothing too."""
    rng = random.Random(4)
    documents = []
    for _ in range(300):
        good = rng.random() < 0.7
        votes = ["-" if rng.random() < 0.3 else "g" if good == (rng.random() < q) else "b" for q in (0.9, 0.75, 0.6)]
        documents.append("".join([*votes, "-", rng.choice("-" * 5 + ("g" if good else "b"))]))
    got = weak_quality.expectation_maximisation(dict(Counter(documents)), anchored=anchored)
    want = plain_em(documents, anchored)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(p, abs=1e-6) for k, p in want.items())
    assert weak_quality.expectation_maximisation({}) == {}


def test_weak_quality_of_odd_rows(spark, docs, texts):
    """Repeated rows, null ids and clashing names; labellers alone, without a human label."""
    odd = docs.select("doc_id", "text").union(docs.select(weak_quality.F.lit(None).cast("long"), "text")).union(docs.select("doc_id", "text").limit(5))
    odd = odd.selectExpr("*", "1 AS k", "2 AS quality", "3 AS toxic", "4 AS p_quality")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = weak_quality.classify(odd, labels, rest_weight=1.0, anchored=False)
    assert got.columns == ["doc_id", "quality_score", "clean_score", "kept"] and got.count() == 2 * len(texts) + 5
    scores = {}
    for r in got.where("doc_id is not null").collect():
        assert scores.setdefault(r["doc_id"], r["quality_score"]) == r["quality_score"]


def test_weak_quality(spark, docs, texts):
    labels = spark.createDataFrame([(20, 1, 0), (21, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = weak_quality.classify(docs, labels).collect()
    assert len(got) == len(texts) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert weak_quality.classify(docs.limit(0), labels.limit(0)).count() == 0


def test_toxic_labellers_are_learned(spark):
    """Any word that toxic labels single out is a vote, in any language; no word votes twice."""
    rng = random.Random(12)
    bad = [f"{words(rng, 30)} zorgle{'n' * (i % 2)} {words(rng, 30)}" for i in range(30)]
    docs = spark.createDataFrame([*enumerate(bad), *((i, words(rng, 60)) for i in range(30, 300)), (300, None)], "doc_id long, text string")
    human = spark.createDataFrame([(i, int(i < 30)) for i in range(301)], "doc_id long, ht int")
    learned = weak_quality.learn_terms(docs, human)
    assert learned == ({b"zorgle", b"zorglen"}, {b"zorg", b"zorgle"})
    votes = lambda t: weak_quality.heuristics(quality_rules.Doc(t), learned)[1]
    assert [votes(t) for t in (b"w1 Zorgle!", b"w1 zorgles", b"w1 idiot", b"w1 w2", b"")] == ["-b-", "-gb", "bgg", "-gg", "---"]
    assert weak_quality.learn_terms(docs, human.limit(0)) == weak_quality.NOTHING
    labels = human.where("doc_id < 250").selectExpr("doc_id", "1 AS quality", "ht AS toxic")
    new = docs.union(spark.createDataFrame([(900 + i, f"{words(rng, 40)} zorgle {words(rng, 20)}") for i in range(5)], "doc_id long, text string"))
    assert all(not r["kept"] for r in weak_quality.classify(new, labels).where("doc_id >= 900").collect())


def test_registry_and_pipeline(spark):
    import corpus_pipeline

    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 14)}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and "sequence_id" in out.columns


def test_packing_ids_of_odd_texts():
    """The table of words gives the ids of whole texts, special tokens, marks and odd letters included."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, words, rng = Tokenizer.from_file(path), packing.Words(path, 2), random.Random(1)
    parts = ["a", "B", "é", "É", "İ", "ß", "'s", "'", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", ".", "!", "#", "*%", " ", "\n", "\x0b", "\x1c", "　", "1", "²", "日", "̸", "don't", "$$$", "ǅ"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(next(words.ids([text.encode()])), np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids + [2], text


def test_packing_ids_of_decomposed_letters():
    """Letters that only compose in lower case keep the ids of the whole text; beside marks on any letter."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, rng = Tokenizer.from_file(path), random.Random(2)
    five = ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "Y\u030a"]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZhjtwyzé."
    texts = [f"{x}x a{x}b" for x in five] + [c + chr(m) + "x" for c in letters for m in range(0x300, 0x370)] + ["".join(rng.choice([*five, *letters, " ", "\u0323", "\u0301"]) for _ in range(9)) for _ in range(2000)]
    words = packing.Words(path, 2)
    for text in texts:
        assert np.frombuffer(next(words.ids([text.encode()])), np.uint32).tolist() == whole.encode(text, add_special_tokens=False).ids + [2], text
    # No mark outside of this range composes with an ASCII letter.
    import unicodedata

    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        assert all(unicodedata.normalize("NFC", c + chr(m)) == c + unicodedata.normalize("NFC", chr(m)) for m in range(0x370, 0x11000) if not 0xD800 <= m < 0xE000)


def test_one_outsider_in_a_large_bucket(spark):
    """A bucket of 20,000 members with one outsider: rows stay linear, and the outsider's link is found."""
    rng = np.random.default_rng(5)
    sig = rng.integers(1 << 30, size=2 * min_max_hash.PERMUTATIONS, dtype=np.int64).astype(np.uint32)
    members = spark.createDataFrame([(i, 7, 0) for i in range(20_000)], "id long, bucket long, band int")
    comps = spark.createDataFrame([(i, 0) for i in range(1, 19_999)], "id long, comp long")  # the last one stands alone
    short = spark.range(20_000).select("id", min_max_hash.F.lit(bytearray(sig.tobytes())).alias("sig"))
    with min_max_hash.Scratch(spark) as tmp:
        left, right = min_max_hash._grid(members, comps, short, tmp)
        assert (left.count(), right.count()) == (-(-20_000 // min_max_hash.MEMBERS), 20_000)
        key = ("alone", "g", "i", "j")
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(min_max_hash._asked(2, 80), "a long, b long, bucket long, more boolean").collect()
    assert 0 < len(found) <= 3 * 2 and all(r["b"] == 19_999 and r["more"] for r in found)


def test_first_common_band_is_that_of_the_buckets():
    """Two signatures that agree in band 1, and in the low halves of the values of band 0: they meet in band 1."""
    rng = np.random.default_rng(8)
    one = rng.integers(1 << 32, size=2 * min_max_hash.PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
    other = one.copy()
    other[: min_max_hash.ROWS] ^= np.uint32(1 << 20)
    side = lambda i, sig, outside: {"band": np.array([1]), "id": np.array([i]), "comp": np.array([i]), "outside": np.array([outside]), "sig": sig[None]}
    assert [at.tolist() for _, at, _ in min_max_hash._near(side(1, one, True), side(2, other, False))] == [[0]]


def test_blocks_of_large_sets_are_small(spark):
    """Sets of 4 MB each: no side of a block has more than SET_BYTES of them, or one more by chance of the hash."""
    members = spark.createDataFrame([(i, 7, 0) for i in range(100)], "id long, bucket long, band int")
    sets = spark.range(100).select("id", min_max_hash.F.lit(bytearray(512)).alias("sig"), min_max_hash.F.expr("cast(repeat('x', 4000000) as binary)").alias("set"))
    with min_max_hash.Scratch(spark) as tmp:
        left, right = min_max_hash._grid(members, spark.createDataFrame([(1, 0), (2, 0)], "id long, comp long"), sets, tmp)
        for side in (left, right):
            most = side.groupBy("alone", "g", "i", "j").agg(min_max_hash.F.sum(min_max_hash.F.octet_length("set").cast("long")).alias("n")).agg({"n": "max"}).first()[0]
            assert most <= 2 * min_max_hash.SET_BYTES


def test_blocks_are_asked_again(spark, monkeypatch):
    """Two groups in common buckets whose only link is between two members that agree less than others do."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    out = []
    for i in range(40):  # all alike at about 0.7: many candidates, few links
        own = base[:]
        for j in rng.sample(range(60), 3):
            own[j] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    monkeypatch.setattr(min_max_hash, "FIRST", 1)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in min_max_hash.classes(df, 4).collect()} == brute_components(out, 4)


def test_components_that_dont_settle_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert {r["comp"] for r in min_max_hash.components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        min_max_hash.components(path, most=2)


def test_clashing_names(spark, docs, texts):
    """Columns named like internal ones are kept as they are."""
    names = ["_gone", "gone", "_runs", "cut", "own", "of", "_removed", "removed", "copy", "bucket", "id"]
    odd = docs.withColumns({n: language_id.F.lit(n) for n in names})
    for f in (lambda d: min_max_hash.keep(d, 5), lambda d: line_dedup.dedup(d).drop("n_removed_lines"), quality_rules.keep):
        plain, got = f(docs), f(odd)
        assert got.columns == odd.columns and all(r[n] == n for r in got.collect() for n in names)
        assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == sorted((r["doc_id"], r["text"] or "") for r in plain.collect())


def brute_pipeline_near(ids, own, whole):
    """The documents that stay: the least of each component, linked by their own or their whole texts."""
    sets = []
    for i in ids:
        each = []
        for t in {own[i], whole[i]}:
            w = (t or "").lower().split()
            each.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
        sets.append(each)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {ids[i] for i in range(len(ids)) if find(i) == i}


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """Copies leave one document, cut near copies too; nothing that packing gets is empty."""
    import corpus_pipeline

    rng = random.Random(31)
    line = lambda n: " ".join(f"{'abcdefgh'[rng.randrange(8)]}x{rng.randrange(3000)}" for _ in range(n))
    text = lambda: "\n".join(line(30) for _ in range(8))
    base, passage = text(), "\n".join([line(30), line(30)])
    near = base.split("\n")
    for k in (3, 5):  # the rest is cut, but for three lines
        near[k] = line(2) + " " + near[k].split(" ", 2)[2]
    item = f"{line(20)}. {line(6)}."
    rows = [text() for _ in range(20)] + [base, base, "\n".join(near), base.replace("\n", " \n"), f"{text()}\n{passage}", f"{passage}\n{text()}", passage, f"{text()}\n{item}", "short", None, "", "x " * 200]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage, seen = dict(corpus_pipeline.STAGES), {}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in list(stage)[:-1]:
        now = stage[name](spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert sorted(now.columns) == sorted(docs.columns)
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    good = {i: t for i, t in enumerate(rows) if quality_rules.verdict(quality_rules.Doc((t or "").encode()), list(quality_rules.RULES))}
    assert seen["quality_rules"] == good and set(good) == set(range(28))
    assert set(seen["line_dedup"]) == set(range(28)) - {21, 26}
    assert seen["line_dedup"][25] == rows[25].split("\n", 2)[2] and seen["line_dedup"][22] == "\n".join(near[3:6])
    ids = sorted(seen["line_dedup"])
    assert set(seen["near_dedup"]) == brute_pipeline_near(ids, seen["line_dedup"], rows)
    assert 20 in seen["near_dedup"] and not {21, 22, 23, 26} & set(seen["near_dedup"])
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {27}
    packed = stage["packing"](spark, now, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(seen["decontamination"]) and min(r["doc_tokens"] for r in packed) > 50
    for name, f in list(stage.items()):
        none = f(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        if name != "packing":
            odd = f(spark, docs.where("doc_id > 26").withColumns({c: corpus_pipeline.F.lit(c) for c in ("removed", "own", "x")}), str(tmp_path))
            assert {"removed", "own", "x"} <= set(odd.columns) and all(r["own"] == "own" for r in odd.collect())


def test_pipeline_leaves_no_copies(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(corpus_pipeline.F.max("doc_tokens").alias("n")).collect()
    assert min(r["n"] for r in packed) > 50
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(r["doc_id"] for r in packed)
    assert brute_pipeline_near(ids, texts, texts) == set(ids)


def test_spread_keys_come_back():
    rng = np.random.default_rng(4)
    for words in (1, 2, 1000, 3_000_000, (1 << 32) - 2):
        a, b = (rng.integers(0, words, 500, dtype=np.uint64) for _ in range(2))
        keys = a << np.uint64(32) | b
        out = ngram_trie.spread(keys, words)
        assert (ngram_trie.gathered(out, words) == keys).all() and ngram_trie.shard_of(out, words, 7).max() < 7
    assert len(set(ngram_trie.shard_of(out, words, 7).tolist())) == 7


def test_counts_are_matches(spark):
    import re

    rng = random.Random(17)
    texts = ["".join(rng.choice("ab9 \n\t\x1c.,-_é日~\x7f\x0b") for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, ""]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in token_rollup.counted(df).collect()}
    for i, t in enumerate(texts):
        assert {v: got[i][v] for v in token_rollup.VERSIONS} == {v: len(re.findall(p, t or "")) for v, p in token_rollup.VERSIONS.items()}, t


def test_near_dedup_meets_repeated_rows_once(spark, tmp_path, monkeypatch):
    """Rows repeated with their doc_id don't meet in pairs where documents stand for their whole texts."""
    import corpus_pipeline

    lines = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(30)]
    whole, cut, other = "\n".join(lines), "\n".join(lines[:9] + lines[15:]), "\n".join(lines).replace("w29x11", "else")
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, whole), (2, other)] * 6, schema).write.parquet(f"{tmp_path}/documents.parquet")
    seen, real = {}, corpus_pipeline.stored
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df, name: seen.setdefault(name, real(df, name)))
    got = corpus_pipeline.near(spark, spark.createDataFrame([(2, other)] * 6 + [(1, cut)] * 6, schema), str(tmp_path)).collect()
    assert [tuple(r) for r in seen["whole"].collect()] == [(1, whole)]
    assert [tuple(r) for r in got] == [(1, cut)] * 6


def test_pairs_are_not_stored_beside_the_coded_texts(spark, docs):
    """The coded texts stay until all are scored; pairs are counted from them and go straight to their shards."""
    info, rows = ngram_trie.fit(docs.withColumn("held_out", ngram_trie.F.col("doc_id") % 3 == 0))
    whole = spark.read.parquet(rows.inputFiles()[0].rpartition("/")[0])
    assert whole.columns == ["doc_id", "held_out", "ids"] and whole.count() == docs.count() and info["second"]


def test_decontamination_holds_few_texts_at_once():
    """What a task holds follows a slice of texts, not its batch."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = random.Random(23)
    items = [(i, words(rng, 40, 4000).encode()) for i in range(200)]
    texts = [words(rng, 600, 4000) for _ in range(2000)]
    texts[::100] = [f"{t} {items[i][1].decode()}" for i, t in enumerate(texts[::100])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    index = SimpleNamespace(value=[decontaminate.Index(items)])
    tracemalloc.start()
    kept = [i for b in decontaminate._clean(iter([batch]), index) for i in b.column("doc_id").to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept == [i for i in range(2000) if i % 100] and most < 60e6, most


def test_packing_holds_few_texts_at_once(monkeypatch):
    """What a task holds of its texts follows a slice, not its batch; every id still lies in one piece."""
    import pyarrow as pa

    rng, seen, real = random.Random(29), [], packing.utf8
    texts = [words(rng, 600) for _ in range(2000)]
    monkeypatch.setattr(packing, "utf8", lambda column: seen.append(column.nbytes) or real(column))
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    path = public_tokenizers.path("word_bpe_49k.json")
    out = [r for b in packing._pieces(iter([batch]), path, 4096, 2) for r in b.to_pylist()]
    assert max(seen) <= 1.2 * (1 << 20) and len({r["doc_id"] for r in out}) == 2000
    assert sum(r["length"] for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())
