"""Secret scans: candidate spans by pattern, and how many repositories and owners hold each candidate across the corpus.

Base kinds are assign, access and hex; the method adds `opaque` spans, long tokens with upper and lower case and a digit.
Every candidate's value (the assigned value, else the match) is hashed, and distinct repositories and owners are counted
over the whole corpus. A value of EXAMPLE_OWNERS owners or more, or in EXAMPLE_REPOS repositories or more of fewer owners, is
an example that people copy; else it looks live. Opaque tokens are reported only where they look live; base spans always
stay. Every row tells the largest of its values' numbers of owners and repositories.

All of it is DataFrame operations, and one scan looks for all patterns. A pattern's matches come from regexp_extract_all and the gaps between them from split,
and a running sum over both gives offsets, so a text with many matches costs in proportion. Texts never enter a shuffle;
only candidates do. Counts combine on the map side first, so a value that a third of all rows hold is no hot task.

Defined cases: a null or empty text has no span; repeated rows (same id and text) are each answered with the same spans,
and so are rows with a null id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, table

KINDS = ("assign", "access", "hex", "opaque")
#: Patterns as Java's regular expressions, and the least length of the value (assign) or match. Lengths of access and hex stand in the pattern, which finds the same matches as filtering maximal runs.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_-]{24,}"
MIN_VALUE, EXAMPLE_OWNERS, EXAMPLE_REPOS = 12, 3, 50


def _matches(docs: DataFrame) -> DataFrame:
    """One row for each match: keys of its text, kind, number, code points since the last match of the kind, length, match."""

    def found(code: int, pattern: str) -> Column:
        pairs = F.zip_with(
            F.split("text", pattern, -1),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
            lambda gap, hit: F.struct(F.char_length(gap).cast("long").alias("gap"), F.char_length(hit).cast("long").alias("len"), hit.alias("hit")),
        )
        return F.struct(F.lit(code).alias("kind"), F.when(F.col("text").rlike(pattern), pairs).alias("pairs"))

    each = docs.select("id", "owner", "repo", "h", F.explode(F.array(*[found(k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, OPAQUE))])).alias("k")).where("k.pairs is not null")
    return each.select("id", "owner", "repo", "h", "k.kind", F.posexplode("k.pairs").alias("pos", "m")).where("m.hit is not null").select("id", "owner", "repo", "h", "kind", "pos", "m.*")


def assigned(hit: Column) -> Column:
    """The value of an assignment: what follows keyword, separator and quotes."""
    return F.regexp_replace(hit, r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "")


def candidates(docs: DataFrame) -> DataFrame:
    """(id, owner, repo, h, kind, start, end, value) of all candidates of docs(id, owner, repo, h, text)."""
    # repeated rows give the same candidates and merge here
    each = _matches(docs).groupBy("id", "h", "kind", "pos").agg(F.first("gap").alias("gap"), F.first("len").alias("len"), F.first("hit").alias("hit"), F.min("owner").alias("owner"), F.min("repo").alias("repo"))
    run = W.Window.partitionBy("id", "h", "kind").orderBy("pos").rowsBetween(W.Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run))
    each = each.withColumn("value", F.when(F.col("kind") == 0, assigned(F.col("hit"))).otherwise(F.col("hit")))
    mixed = F.col("hit").rlike("[A-Z]") & F.col("hit").rlike("[a-z]") & F.col("hit").rlike("[0-9]")
    fits = F.when(F.col("kind") == 0, F.char_length("value") >= MIN_VALUE).when(F.col("kind") == 3, mixed).otherwise(True)
    return each.where(fits).select("id", "owner", "repo", "h", "kind", (F.col("end") - F.col("len")).alias("start"), "end", F.xxhash64("value").alias("secret"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row for each row of docs: counts of base kinds, base digest, all spans, how many spans look live or copied, and the most owners and repositories of one of its values."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[owner_col].cast("string").alias("owner"), docs[repo_col].cast("string").alias("repo"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    found = cut(candidates(rows), "secrets")
    by_owner = found.groupBy("secret", "owner").agg(F.countDistinct("repo").alias("repos"))
    owned = by_owner.groupBy("secret").agg(F.count("owner").alias("owners"), F.sum("repos").alias("repos"))
    known = found.join(owned, "secret").withColumn("live", (F.col("owners") < example_owners) & (F.col("repos") < example_repos)).where("kind < 3 or live")
    names = F.array(*[F.lit(k) for k in KINDS])
    span = F.struct("start", "kind", "end", "live")
    spans = known.groupBy("id", "h").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.max("owners").alias("owners"), F.max("repos").alias("repos"))
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = listed(F.filter("spans", lambda x: x["kind"] < 3))
    told = spans.select(
        "id", "h", *[of(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_copied"), F.col("owners").alias("n_owners"), F.col("repos").alias("n_repos"), base.alias("base"), listed(F.col("spans")).alias("spans"),
    )
    both = rows.select("id", "h").alias("r").join(told.alias("t"), F.col("r.id").eqNullSafe(F.col("t.id")) & F.col("r.h").eqNullSafe(F.col("t.h")), "left")
    n = [F.coalesce(F.col(f"n_{k}"), F.lit(0).cast("long")).alias(f"n_{k}") for k in (*KINDS, "live", "copied", "owners", "repos")]
    return both.select(F.col("r.id").alias("doc_id"), *n, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


_KEYWORD = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?"
_VALUE = "[A-Za-z0-9+/_.=-]+"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text,'') AS text FROM documents),
pat AS (SELECT * FROM (VALUES (0,'{_KEYWORD}{_VALUE}'),(1,'{ACCESS}'),(2,'{HEX}'),(3,'{OPAQUE}')) p(kind, p)),
hits AS (SELECT doc_id, source, kind, regexp_extract_all(text, p) AS hits, regexp_split_to_array(text, p) AS gaps FROM d, pat WHERE regexp_matches(text, p)),
each AS (SELECT doc_id, source, kind, unnest(range(1, len(hits)+1)) AS pos, hits, gaps FROM hits),
m AS (SELECT doc_id, source, kind, pos, hits[pos] AS hit, sum(length(gaps[pos]) + length(hits[pos])) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS e FROM each),
v AS (SELECT doc_id, source, kind, CAST(e - length(hit) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CASE WHEN kind = 0 THEN regexp_replace(hit, '^{_KEYWORD}', '') ELSE hit END AS value FROM m),
c AS (SELECT * FROM v WHERE CASE WHEN kind = 0 THEN length(value) >= {MIN_VALUE} WHEN kind = 3 THEN regexp_matches(value,'[A-Z]') AND regexp_matches(value,'[a-z]') AND regexp_matches(value,'[0-9]') ELSE true END),
o AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repos FROM c GROUP BY value),
k AS (SELECT c.*, owners, repos, owners < {EXAMPLE_OWNERS} AND repos < {EXAMPLE_REPOS} AS live, list_extract(['assign','access','hex','opaque'], kind+1) || ':' || s || ':' || e AS span FROM c JOIN o USING (value) WHERE kind < 3 OR (owners < {EXAMPLE_OWNERS} AND repos < {EXAMPLE_REPOS})),
g AS (SELECT doc_id, count(*) FILTER (kind=0) AS n_assign, count(*) FILTER (kind=1) AS n_access, count(*) FILTER (kind=2) AS n_hex, count(*) FILTER (kind=3) AS n_opaque,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied, max(owners) AS n_owners, max(repos) AS n_repos, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign,0) AS n_assign, coalesce(n_access,0) AS n_access, coalesce(n_hex,0) AS n_hex, coalesce(n_opaque,0) AS n_opaque, coalesce(n_live,0) AS n_live, coalesce(n_copied,0) AS n_copied, coalesce(n_owners,0) AS n_owners, coalesce(n_repos,0) AS n_repos,
  sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
