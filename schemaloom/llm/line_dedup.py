"""Operator 2, line dedup: winnowing over line hashes, in DataFrame operations only.

The lines of a text that have a word are a sequence of (hash, words). From each line on, the
window of the fewest lines that come to ``min_words`` words picks the least hash in it as its
fingerprint; the same holds backwards, for the window that ends at a line. Equal runs of
``min_words`` words or more hold a whole window at the same place, so they share its minimum:
that is the guarantee of winnowing. Only windows whose fingerprint stands at two places or more
are looked at further. A match is extended from its fingerprint to both ends of its window: windows
with the same fingerprint and the same lines before and after it are the same passage, and the first
by (doc_id, line) is the one that stays. Windows that overlap join to runs, and every line of a
later run goes, with the blank lines inside it. That is as far as a match can be extended by lines,
since every line of a longest common run of ``min_words`` words lies in a window that is common too;
no match is extended by words into a line that is shared in part.

No pairs of places are made: all places of a passage meet its first place only, through an
aggregate with partial sums, so the rows stay linear in the number of lines whatever repeats.

Defined results: null texts and rows with a null doc_id stay as they are. Rows with the same
doc_id and the same text are treated as one and keep the same text. Ties within a text go to
the earlier line. A text that is a copy of an earlier one becomes empty; its row stays. Extra
columns are kept, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Scratch, stored, unused

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, copy (of the text), pos, h, n, s (words before the line), e (words up to its end)."""
    own = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").alias("t"), F.xxhash64("text").alias("copy"))
    each = own.select("doc_id", "copy", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    each = each.select("doc_id", "copy", "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).alias("n")).where("n > 0")
    each = each.dropDuplicates(["doc_id", "copy", "pos"])  # repeated rows
    by_doc = W.partitionBy("doc_id", "copy").orderBy("pos")
    return each.withColumn("e", F.sum("n").over(by_doc).cast("int")).withColumn("s", F.col("e") - F.col("n"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """Both windows of each line: fingerprint, lines before it, lines from it on, first and last position."""
    by_doc = W.partitionBy("doc_id", "copy")
    on, back = by_doc.orderBy("s").rangeBetween(0, min_words - 1), by_doc.orderBy("e").rangeBetween(1 - min_words, 0)
    lines = lines.select("*", *(f(c).over(w).alias(k) for k, f, c, w in (("on_h", F.collect_list, "h", on), ("on_e", F.max, "e", on), ("on_pos", F.max, "pos", on), ("back_h", F.collect_list, "h", back), ("back_s", F.min, "s", back), ("back_pos", F.min, "pos", back))))

    def window(hashes: str, first: Column, last: Column) -> Column:
        return F.struct(F.col(hashes).alias("hashes"), first.alias("first"), last.alias("last"))

    both = F.array(
        F.when(F.col("on_e") - F.col("s") >= min_words, window("on_h", F.col("pos"), F.col("on_pos"))),
        F.when(F.col("e") - F.col("back_s") >= min_words, window("back_h", F.col("back_pos"), F.col("pos"))),
    )
    each = lines.select("doc_id", "copy", F.explode(F.array_compact(both)).alias("x")).select("doc_id", "copy", "x.*")
    each = each.dropDuplicates(["doc_id", "copy", "first", "last"]).withColumn("mark", F.array_min("hashes"))
    at = F.array_position("hashes", F.col("mark")).cast("int")
    return each.select("doc_id", "copy", "first", "last", "mark", F.xxhash64(F.expr(f"slice(hashes, 1, array_position(hashes, mark) - 1)"), F.lit(1)).alias("before"), F.xxhash64(F.slice("hashes", at, F.size("hashes")), F.lit(2)).alias("after"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, copy, first, last: the runs of lines that repeat an earlier run.

    Windows are made once. Marks and passages that stand at several places are written as tables, so
    that a hot one, in the joins with all windows, is a partition that adaptive execution can split.
    """
    place = F.struct("doc_id", "first", "copy")
    with Scratch(docs.sparkSession) as tmp:
        windows = tmp.stored(_windows(_lines(docs), min_words), "windows")
        at = F.xxhash64("doc_id", "first", "copy")
        marks = tmp.stored(windows.groupBy("mark").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo < hi").select("mark"), "marks")
        found = tmp.stored(windows.join(marks, "mark"), "found")
        firsts = found.groupBy("mark", "before", "after").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("places")).where("places > 1").drop("places")
        firsts = tmp.stored(firsts, "passages")
        later = tmp.stored(found.join(firsts, ["mark", "before", "after"]).where(place != F.col("origin")).select("doc_id", "copy", "first", "last"), "later")
        by_doc = W.partitionBy("doc_id", "copy").orderBy("first", "last")
        later = later.withColumn("new", (F.col("first") > F.coalesce(F.max("last").over(by_doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
        later = later.withColumn("run", F.sum("new").over(by_doc)).groupBy("doc_id", "copy", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")
        return stored(later, "runs")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, removed: str = "n_removed_lines") -> DataFrame:
    """The documents, with ``text`` rid of later repeated runs, and the number of lines that went in a column
    named by ``removed``, a name that ``docs`` must not have."""
    own, of, cut = (unused(c, docs) for c in ("own", "of", "cut"))
    runs = repeated_runs(docs, min_words).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("first", "last")).alias(cut))
    runs = runs.select(F.col("doc_id").alias(own), F.col("copy").alias(of), cut)
    # Always a merge join: the runs grow with the documents, so the plan is the same at every size.
    both = docs.join(runs.hint("merge"), (docs["doc_id"] == F.col(own)) & (F.xxhash64(docs["text"]) == F.col(of)), "left")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda _, i: ~F.exists(cut, lambda r: i.between(r["first"], r["last"])))
    gone = F.when(F.col(cut).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(left)).cast("long")
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return both.select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns), gone.alias(removed))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs)


#: Fewer words than a window, and no fingerprints: every window of lines, by its text.
DEDUP_SQL = r"""
dd_lines AS (
  SELECT doc_id, pos, line, n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS e
  FROM (SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM {docs}))
  WHERE n > 0),
dd_win AS (
  SELECT doc_id, pos AS first, max(pos) OVER f AS last, string_agg(line, chr(10)) OVER f AS body, max(e) OVER f - (e - n) AS words FROM dd_lines
  WINDOW f AS (PARTITION BY doc_id ORDER BY e - n RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, min(pos) OVER b, pos, string_agg(line, chr(10)) OVER b, e - min(e - n) OVER b FROM dd_lines
  WINDOW b AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
dd_later AS (
  SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS k FROM dd_win WHERE words >= 50) WHERE k > 1),
dd_gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM dd_later),
dd_sets AS (SELECT doc_id, list(pos) AS gone FROM dd_gone GROUP BY doc_id),
dd AS (
  SELECT d.* REPLACE (CASE WHEN gone IS NULL THEN text ELSE array_to_string([x FOR x, i IN string_split(text, chr(10)) IF NOT list_contains(gone, i - 1)], chr(10)) END AS text), coalesce(len(gone), 0)::BIGINT AS n_removed_lines
  FROM {docs} d LEFT JOIN dd_sets USING (doc_id))
"""
OP2_SQL = "WITH " + DEDUP_SQL.format(docs="documents") + "SELECT doc_id, text, n_removed_lines FROM dd"
