"""Filter audit, vector codes and exact dedup against brute force."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from schemaloom.llm import filter_audit, radix_dedup, registry, vector_codes
from schemaloom.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
OUT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def write(spark, path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


def odd_documents():
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(260))
    texts = [None, "", " \n", "A B C", long, long.title(), f"{long} #tag", "same " * 300, "UPPER " * 210, long, f"{long}|", "é" * 40, "x" * 200_000, long.replace(" ", "\n\t ")]
    rows = [(i, t, None if i % 5 == 0 else "de" if i % 3 else "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(None, long, "en", None, None), (None, None, None, None, None), (4, long, "en", "s", 0), (4, long, "en", "s", 0), (9, "another text of a doc_id", "en", "s", 0)]
    return rows + [(100 + i, rng.choice(texts), rng.choice(["en", "de", None]), "s", 0) for i in range(60)]


def plain_audit(rows, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    table = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = words(t)
        twins = [r[0] for r in rows if (r[1] or "") == t and r[0] is not None]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and min(twins) < i}
        table.append((lang or "", fails, any(x[0] == i and x[1] == 1 for x in labels if i is not None), any(x[0] == i and x[2] == 1 for x in labels if i is not None)))
    out = {}
    for part in {x[0] for x in table}:
        own = [x for x in table if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                fails = [x for x in own if x[1][f]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(fails) - len(gone), sum(sum(x[1].values()) == 1 for x in fails), sum(x[2] for x in gone), sum(x[3] for x in gone), 0]
    share = {}
    for (part, order, k), v in out.items():
        share[part, order[k - 1]] = share.get((part, order[k - 1]), 0) + v[1]
    for (part, order, k), v in out.items():
        v[6] = share[part, order[k - 1]]
    return out


def test_audit_by_brute_force(spark, tmp_path):
    rows = odd_documents()
    labels = [(1, 1, 0), (4, 0, 1), (4, 1, None), (9, 1, 1), (None, 1, 1), (5000, 1, 1), (101, 1, 0), (102, 0, 1), (103, None, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "text AS A", "1 AS words", "2 AS n", "3 AS subset").repartition(5)
    sf = write(spark, tmp_path, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good"))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in OUT] for r in registry.QUERIES["op11_filter_audit"](spark, sf).collect()}
    assert got == plain_audit(rows, labels)


def test_audit_of_nothing(spark, tmp_path):
    sf = write(spark, tmp_path, documents=spark.createDataFrame([], DOCS), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert registry.QUERIES["op11_filter_audit"](spark, sf).count() == 0


def test_audit_of_other_filters(spark):
    """Three filters of any names; what a filter removes over all orders follows from the subsets."""
    cells = spark.createDataFrame([("p", True, False, True, 5, 1, 0), ("p", False, False, False, 7, 2, 1), ("p", True, False, False, 2, 0, 0), ("q", False, True, True, 4, 4, 4)], "part string, long boolean, odd boolean, old boolean, n long, good long, toxic long")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(cells, ["long", "odd", "old"]).collect()}
    assert len(got) == 2 * math.factorial(3) * 3
    assert [got["p", "longoddold", k]["removed"] for k in (1, 2, 3)] == [7, 0, 0]
    assert [got["p", "oldoddlong", k]["removed"] for k in (1, 2, 3)] == [5, 0, 2]
    assert got["p", "oldoddlong", 3]["redundant"] == 5 and got["p", "oldoddlong", 3]["unique_fails"] == 2
    assert got["q", "longoddold", 3]["kept"] == 0 and got["q", "longoddold", 2]["good_lost"] == 4
    with pytest.raises(ValueError):
        filter_audit.audit(cells, list("abcdefgh"))


def plain_codes(vectors, parts, entries, rounds):
    """vec_id to code and error, and the codebooks, by comparing with every entry."""
    kept = [(i, v) for i, v, _ in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept = sorted(((i, [math.floor(256 * c) for c in v]) for i, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v in kept], object)
    width = x.shape[1] // parts
    books = [[list(r[p * width : (p + 1) * width]) for r in x[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((int(c) - int(d)) ** 2 for c, d in zip(a, b))
    assign = lambda: [[min(range(len(b)), key=lambda e: (gap(r[p * width : (p + 1) * width], b[e]), e)) for p, b in enumerate(books)] for r in x]
    for _ in range(rounds):
        codes = assign()
        for p, book in enumerate(books):
            for e in range(len(book)):
                own = [r[p * width : (p + 1) * width] for r, c in zip(x, codes) if c[p] == e]
                if own:
                    book[e] = [sum(int(r[j]) for r in own) // len(own) for j in range(width)]
    codes = assign()
    errors = [sum(gap(r[p * width : (p + 1) * width], books[p][c[p]]) for p in range(parts)) for r, c in zip(x, codes)]
    return sorted((i, "".join(f"{c:02x}" for c in code), e) for (i, _), code, e in zip(kept, codes, errors)), books


def odd_vectors(rng, n=300, size=64):
    base = rng.normal(size=(6, size))
    rows = [(i, [float(c) for c in np.float32(base[i % 6] * (0.2 + i % 3) + rng.normal(size=size) * 0.3)], i % 4 if i % 7 else None) for i in range(n)]
    rows += [(n, rows[3][1], 1), (n + 1, rows[3][1], 1), (n + 2, [0.0] * size, 2), (n + 3, [0.0] * size, 2)]  # ties
    rows += [(n + 4, [1000.0] * size, 9), (n + 5, [-1000.0] * size, 9), (n + 5, [-1000.0] * size, 9)]  # far off, and repeated
    return rows + [(-5, None, 1), (-4, [float("nan")] * size, 1), (-3, [1.0] * (size - 1) + [float("inf")], 1), (-2, [None] + [1.0] * (size - 1), None)]


def test_codes_by_brute_force(spark, tmp_path):
    rows = odd_vectors(np.random.default_rng(5))
    random.Random(1).shuffle(rows)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS x", "2 AS code").repartition(7)
    want, books = plain_codes(rows, 16, 64, 2)
    got = registry.QUERIES["op12_vector_codes"](spark, write(spark, tmp_path, embeddings=vectors)).collect()
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got) == want
    label, total = {i: x for i, _, x in rows}, {}
    for i, _, e in want:
        total[label[i]] = total.get(label[i], 0) + e
    assert all(r["label_error"] == total[label[r["vec_id"]]] for r in got)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_of_small_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert vector_codes.encode(frame([]))[0].count() == 0
    assert vector_codes.encode(frame([(1, None, 1), (2, [float("nan")], 1)]))[0].count() == 0
    few = [(3, [0.5] * 32, None), (None, [0.25] * 32, None), (2, [-0.5] * 32, 1), (1, [0.1] * 31, 1)]
    # Only vectors as long as the first one: here of 31 components, padded to 32.
    got, books = vector_codes.encode(frame(few))
    assert [tuple(r) for r in got.select("vec_id", "code", "error").collect()] == [(1, "00" * 16, 0)] and len(books[0]) == 1
    got, books = vector_codes.encode(frame(few[:3]))
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got.collect()} == {2: ("00" * 16, 0), 3: ("01" * 16, 0), None: ("02" * 16, 0)}
    assert len(vector_codes.encode(frame([(1, [], 1), (2, [], None)]))[0].collect()) == 2
    with pytest.raises(Exception, match="in size"):
        vector_codes.encode(frame([(1, [2.0**21] * 16, 1)]))


def test_bounds_pass_over_most_entries():
    rng = np.random.default_rng(2)
    centres = rng.integers(-400, 400, (64, 4))
    x = centres[rng.integers(0, 64, 2000)] + rng.integers(-9, 10, (2000, 4))
    book = vector_codes.Part(centres, 3)
    state = book.first(x)
    moved = vector_codes.Part(centres + rng.integers(-3, 4, centres.shape), 3, centres)
    own, upper, lower, measured = moved.next(x, *state)
    squares = ((x[:, None] - moved.book[None]) ** 2).sum(2)
    assert (own == squares.argmin(1)).all() and measured < squares.size / 10
    far = np.sqrt(squares) / 3
    assert (lower <= far + 1e-9).all() and (upper >= far[np.arange(len(x)), own] - 1e-9).all()


# Exact dedup.


def plain_classes(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[norm(t)]
        least = min((x for x in own if x is not None), default=None)
        out.append((i, least, len(own), i == least, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_texts():
    rng = random.Random(4)
    long = "q" * 300_000
    base = ["", None, " ", "\n\t ", "a", " a", "a ", "a  b", "a\tb", "a b", "a\xa0b", "é", "é", "\0", "\0\0", long, long + "q", long, "日本 語", "日本\x0b語"]
    texts = base + ["hot  text\n" * 40] * 150 + [f"shared beginning {'x' * rng.randrange(60)}{rng.choice(' \n')}{rng.randrange(4)}" for _ in range(300)]
    rng.shuffle(texts)
    rows = [(i * 3 + 7, t, "en", "s", 0) for i, t in enumerate(texts)]
    return rows + [(None, "a b", None, None, None), (None, "only null ids", None, None, None), (None, "only  null ids", None, None, None), rows[5], rows[5], (rows[6][0], "its own text", "en", "s", 0)]


@pytest.mark.parametrize("budget,block", [(radix_dedup.BUDGET, radix_dedup.BLOCK), (40_000, 2000)])
def test_classes_by_brute_force(spark, budget, block):
    rows = odd_texts()
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    got = radix_dedup.classes(docs, budget=budget, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_classes(rows)


def test_strings_of_one_hash_are_told_apart(spark):
    rows = odd_texts()
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    got = radix_dedup.classes(docs, digest=lambda body: bytes([len(body) % 3]), budget=80_000).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_classes(rows)


def test_copies_of_a_text_leave_a_task_once(spark):
    docs = spark.createDataFrame([(i, "one hot text" if i % 3 else f"text {i}", "en", "s", 0) for i in range(3000)], DOCS).coalesce(4)
    counted = docs.select("doc_id", "text").mapInArrow(lambda b: radix_dedup._count(b, radix_dedup.sha256, radix_dedup.BLOCK), "length long, digest binary, body binary, least long, n long")
    assert counted.count() <= 1000 + 4 and counted.where("n > 1").count() <= 4


def test_keep_and_clashing_names(spark):
    rows = odd_texts()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS `of`", "2 AS digest", "3 AS length", "4 AS keep_id", "5 AS body")
    kept = radix_dedup.keep(docs)
    assert kept.columns == docs.columns
    want = sorted((c[0] for c in plain_classes(rows) if c[3]), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == want
    nothing = spark.createDataFrame([], DOCS)
    assert radix_dedup.classes(nothing).count() == 0 and radix_dedup.keep(nothing).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.one_of(st.none(), st.integers(0, 50))), max_size=60), st.sampled_from([1, 1000, 3000, 10**9]))
def test_trie(strings, budget):
    """What a trie owns and what it hands over are all rows, and no string is in both after it has been closed off."""
    trie, out = radix_dedup.Trie(budget), []
    for body, i in strings:
        if not trie.add(body, i, 1):
            out.append((body, i, 1))
        while trie.full():
            out += trie.hand_over()
    own = list(trie.strings())
    assert len({b for b, *_ in own}) == len(own) == trie.open and (own or not strings)
    total = {}
    for body, i, n in own + out:
        least, rows = total.get(body, (None, 0))
        total[body] = radix_dedup._least(least, i), rows + n
    want = {}
    for body, i in strings:
        least, rows = want.get(body, (None, 0))
        want[body] = radix_dedup._least(least, i), rows + 1
    assert total == want
    # An owner has every row of its string that wasn't handed over before the string came to stay.
    assert not budget > 10**6 or not out
