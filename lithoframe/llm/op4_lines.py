"""Line dedup: content-defined chunks of lines; chunks of several lines that occur again in the corpus are removed.

A rolling hash over the hashes of two neighbouring lines says whether they belong together: they do if the corpus holds the
same two lines in a row elsewhere too. A chunk is a longest run of lines whose rolling hashes all occur earlier in the
corpus, so its boundaries lie where a passage starts or stops being a copy, hang on two lines each, and survive whatever is
inserted or removed elsewhere. (Boundaries that are chosen by a hash's value alone leave most passages of two to five lines
whole, as two boundaries must fall into each.) Chunks have two lines or more; single repeated lines stay.

Rolling hashes are counted without texts. Texts are shuffled by id to get the bytes of the lines whose hash occurs again,
and to rewrite; both are merge joins at every size, as what they meet grows with the corpus. Two lines are named by two
64-bit rolling hashes. The first occurrence (by id, text hash, line number) stays, and another one goes only if its bytes
are those of the first. The earliest occurrence of every line is in no chunk that goes, so no line is lost from
the corpus. All of it is DataFrame operations. Counts and first places combine on the map side, and joins by key are inner
joins of many rows against one row for each key, so a key that a third of all rows share can be split over tasks.

Defined cases: a null text stays null; an empty text is one empty line; a text of one line stays; two empty lines in a row
are no chunk by themselves; repeated rows (same id and text) are one document and stay equal; rows with a null id are
documents like others; columns pass through, and those named like the new ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table

_NEW = ("n_lines", "n_removed_chunks", "n_removed_lines")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body names it, also within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rolling(lines: Column) -> Column:
    """Two hashes for each two neighbouring lines, from two hashes of the lines; null for two empty ones."""
    empty = F.xxhash64(F.lit(""))
    pair = lambda x, y: F.when((x["a"] != empty) | (y["a"] != empty), F.struct(F.xxhash64(x["a"], y["a"]).alias("key"), F.xxhash64(x["b"], y["b"]).alias("check")))
    both = lambda h: F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), pair)
    return _let(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))), both)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text rewritten, and the numbers of lines, removed chunks and removed lines."""
    keep = [c for c in docs.columns if c not in _NEW]
    names = {"_lf_id": F.col(id_col).cast("string"), "_lf_h": F.xxhash64(text_col)}
    lines = F.split(text_col, "\n", -1)
    small = docs.select(F.col(id_col), F.col(text_col)).withColumns(names).where(F.instr(text_col, "\n") > 0)
    each = small.select("_lf_id", "_lf_h", F.posexplode(_rolling(lines)).alias("no", "k")).where("k is not null")
    each = cut(each.select("_lf_id", "_lf_h", "no", "k.*"), "line-pairs")
    place = F.struct("_lf_id", "_lf_h", "no")
    first = each.groupBy("key", "check").agg(F.min(place).alias("at"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = each.join(first, ["key", "check"]).withColumn("first", place.eqNullSafe(F.col("at")))
    by_doc = again.groupBy(F.col("_lf_id").alias("gid"), F.col("_lf_h").alias("gh")).agg(F.collect_set(F.struct("no", "key", "check", "first")).alias("_lf_again"))
    same_doc = F.col("_lf_id").eqNullSafe(F.col("gid")) & F.col("_lf_h").eqNullSafe(F.col("gh"))
    plain = docs.select(*keep).withColumns(names)
    # bytes of those lines that have an equal rolling hash somewhere, and of no others; repeated rows come more than once
    two = lambda own: F.transform("_lf_again", lambda r: F.struct(r.alias("r"), F.concat_ws("\n", F.element_at(own, r["no"] + 1), F.element_at(own, r["no"] + 2)).alias("chunk")))
    held = plain.join(by_doc.hint("merge"), same_doc).select("gid", "gh", F.explode(_let(lines, two)).alias("x"))
    held = cut(held.select("gid", "gh", "x.r.*", "x.chunk"), "line-repeats")
    drop(each)
    originals = held.where("first").groupBy("key", "check").agg(F.min("chunk").alias("original"))
    gone = held.where("not first").join(originals, ["key", "check"]).where(F.col("chunk") == F.col("original"))
    gone = cut(gone.groupBy("gid", "gh").agg(F.collect_set("no").alias("_lf_gone")), "line-gone")
    drop(held)
    after = F.transform("_lf_gone", lambda i: i + 1)
    joined = plain.join(gone.hint("merge"), same_doc, "left").drop("_lf_id", "_lf_h", "gid", "gh")
    left = lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.array_union("_lf_gone", after)), lambda i: F.element_at(own, i + 1))
    count = F.char_length(text_col) - F.char_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    some = lambda value: F.coalesce(F.when(F.col("_lf_gone").isNotNull(), value), F.lit(0)).cast("long")
    done = joined.withColumns({"n_lines": F.coalesce(count, F.lit(0)).cast("long"), "n_removed_chunks": some(F.size(F.array_except("_lf_gone", after))), "n_removed_lines": some(F.size(F.array_union("_lf_gone", after)))})
    return done.withColumn(text_col, F.when(F.col("_lf_gone").isNotNull(), F.array_join(_let(lines, left), "\n")).otherwise(F.col(text_col))).select(*keep, *_NEW)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM l),
r AS (SELECT *, after IS NOT NULL AND (line <> '' OR after <> '') AND row_number() OVER (PARTITION BY line, after ORDER BY CAST(doc_id AS VARCHAR), i) > 1 AS copied FROM p),
g AS (SELECT *, copied OR lag(copied, 1, false) OVER w AS gone, copied AND NOT lag(copied, 1, false) OVER w AS starts FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') END AS text, count(i) AS n_lines,
  count(i) FILTER (starts) AS n_removed_chunks, count(i) FILTER (gone) AS n_removed_lines
FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id, d.text
"""
