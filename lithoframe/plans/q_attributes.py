"""Queries over attribute tables: directions, crosswalks, counters, text and null policies."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.scalars import confidence, export_text, id_stem, no_nan, normalise_directions, num, parse_direction_text, r6, safe_div
from .registry import query

_CODES = r"""list_transform(regexp_extract_all(upper(trim(regexp_replace(raw_dir, '\(.*?\)', '', 'g'))), '\b(NORTH|SOUTH|EAST|WEST|N|S|E|W)\b', 1), lambda w: substr(w, 1, 1))"""
_DIRS = f"dirs AS (SELECT row_no, chapel_id, raw_dir, coalesce(list_filter(c, lambda x, i: list_position(c, x) = i), []) AS direction FROM (SELECT row_no, chapel_id, raw_dir, {_CODES} AS c FROM fx_sheet))"


@query("direction_normalise", _DIRS, "SELECT row_no, array_to_string(direction, '|') AS direction FROM dirs")
def direction_normalise(fx):
    return fx.sheet.select("row_no", F.array_join(normalise_directions(F.col("raw_dir")), "|").alias("direction"))


@query("direction_counts", _DIRS, "SELECT key, count(*) AS n FROM (SELECT CASE WHEN len(direction) = 0 THEN 'none' ELSE array_to_string(list_sort(direction), '|') END AS key FROM dirs) GROUP BY key")
def direction_counts(fx):
    d = F.array_join(F.array_sort(normalise_directions(F.col("raw_dir"))), "|")
    return fx.sheet.groupBy(F.when(d == "", "none").otherwise(d).alias("key")).agg(F.count("*").alias("n"))


@query("parse_direction_text", _DIRS, "SELECT row_no, array_to_string(direction, '-') AS direction, len(direction) AS n FROM dirs")
def parse_direction(fx):
    """Round trip: codes are written as a tuple's text and read again."""
    text = F.concat(F.lit("('"), F.array_join(normalise_directions(F.col("raw_dir")), "', '"), F.lit("',)"))
    back = parse_direction_text(text)
    return fx.sheet.select("row_no", F.array_join(back, "-").alias("direction"), F.size(back).cast("long").alias("n"))


_CW = "cw AS (SELECT s_suppkey AS shp_idx, CAST(100 + (s_suppkey*3) % 140 AS VARCHAR) AS chapel_id FROM supplier WHERE s_suppkey < 100 AND s_suppkey % 5 <> 0)"
_FIRST = "firsts AS (SELECT * FROM dirs QUALIFY row_number() OVER (PARTITION BY chapel_id ORDER BY row_no) = 1)"
_ATT = "att AS (SELECT f.shp_idx, c.chapel_id, d.raw_dir, coalesce(d.direction, []) AS direction FROM fx_footprints f LEFT JOIN cw c USING (shp_idx) LEFT JOIN firsts d ON d.chapel_id = c.chapel_id)"


def attributed(fx):
    """Footprints with chapel and directions: the first sheet row of a chapel counts, unmatched footprints keep nothing."""
    cw = fx.footprints.where("shp_idx % 5 <> 0").select("shp_idx", (100 + (F.col("shp_idx") * 3) % 140).cast("string").alias("chapel_id"))
    first = fx.sheet.withColumn("rn", F.row_number().over(W.Window.partitionBy("chapel_id").orderBy("row_no"))).where("rn = 1").drop("rn", "row_no")
    joined = fx.footprints.join(cw, "shp_idx", "left").join(first, "chapel_id", "left")
    return joined.withColumn("direction", normalise_directions(F.col("raw_dir")))


@query("crosswalk_join", _DIRS, _CW, _FIRST, _ATT, "SELECT shp_idx, chapel_id, raw_dir, array_to_string(direction, '|') AS direction FROM att")
def crosswalk_join(fx):
    return attributed(fx).select("shp_idx", "chapel_id", "raw_dir", F.array_join("direction", "|").alias("direction"))


@query("attribution_counters", _DIRS, _CW, _FIRST, _ATT, "SELECT count(chapel_id) AS labelled, count(*) FILTER (chapel_id IS NOT NULL AND len(direction) > 0) AS with_dir, count(chapel_id) - count(*) FILTER (chapel_id IS NOT NULL AND len(direction) > 0) AS no_dir, count(*) - count(chapel_id) AS unlabelled FROM att")
def attribution_counters(fx):
    has = F.col("chapel_id").isNotNull() & (F.size("direction") > 0)
    return attributed(fx).agg(F.count("chapel_id").alias("labelled"), F.count_if(has).alias("with_dir"), (F.count("chapel_id") - F.count_if(has)).alias("no_dir"), (F.count("*") - F.count("chapel_id")).alias("unlabelled"))


@query("first_match", "SELECT chapel_id, row_no, raw_dir FROM fx_sheet QUALIFY row_number() OVER (PARTITION BY chapel_id ORDER BY row_no) = 1")
def first_match(fx):
    return fx.sheet.groupBy("chapel_id").agg(F.min_by(F.struct("row_no", "raw_dir"), "row_no").alias("f")).select("chapel_id", "f.row_no", "f.raw_dir")


@query("key_prefix_source", "SELECT min(door_id) AS source FROM fx_doors WHERE split_part(chapel_id || '.0', '.', 1) = '179'")
def key_prefix_source(fx):
    return fx.doors.where(id_stem(F.concat("chapel_id", F.lit(".0"))) == "179").agg(F.min("door_id").alias("source"))


@query("string_ids", "SELECT door_id, 'EW_' || chapel_id || '_' || (door_id % 3) AS road, 'HUB_' || (door_id % 7) AS hub, 'door_' || door_id AS node, direction || '-' || chapel_id AS pair FROM fx_doors")
def string_ids(fx):
    return fx.doors.select("door_id", F.format_string("EW_%s_%d", "chapel_id", F.col("door_id") % 3).alias("road"), F.format_string("HUB_%d", F.col("door_id") % 7).alias("hub"), F.format_string("door_%d", "door_id").alias("node"), F.concat_ws("-", "direction", "chapel_id").alias("pair"))


@query("rounding_report", "SELECT door_id, CAST(floor(x*8) AS BIGINT) AS eighths, round_even(floor(x*8)/8, 2)+0 AS half_even FROM fx_doors")
def rounding_report(fx):
    eighths = F.floor(F.col("x") * 8)
    return fx.doors.select("door_id", eighths.alias("eighths"), (F.bround(eighths / num(8), 2) + num(0)).alias("half_even"))


@query("chapels_text", "SELECT g, string_agg(chapel_id, ', ' ORDER BY i) AS chapels FROM (SELECT door_id % 9 AS g, CASE WHEN door_id % 11 = 0 THEN NULL ELSE direction END AS chapel_id, min(door_id) AS i FROM fx_doors GROUP BY 1, 2) WHERE chapel_id IS NOT NULL GROUP BY g")
def chapels_text(fx):
    v = F.when(F.col("door_id") % 11 != 0, F.col("direction"))
    each = fx.doors.select((F.col("door_id") % 9).alias("g"), v.alias("v"), "door_id").where("v is not null").groupBy("g", "v").agg(F.min("door_id").alias("i"))
    return each.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]), ", ").alias("chapels"))


@query("null_policy", "SELECT vec_id, round(CASE WHEN dn2 <> 0 THEN dn1/dn2 WHEN dn2 = 0 THEN 0.0 END,6)+0 AS ratio, round(coalesce(nullif(dn1,0)*0.5,0)+coalesce(dn3,0),6)+0 AS weighted FROM fx_pixels")
def null_policy(fx):
    """Division by zero gives 0; NaN becomes NULL; NULL counts as 0 in weighted sums."""
    hole = no_nan(F.when(F.col("dn1") == 0, F.lit(float("nan"))).otherwise(F.col("dn1")))
    return fx.pixels.select("vec_id", r6(safe_div(F.col("dn1"), F.col("dn2"))).alias("ratio"), r6(F.coalesce(hole * num(0.5), num(0)) + F.coalesce("dn3", num(0))).alias("weighted"))


@query("null_aware_mean", "SELECT row_id, round(coalesce(avg(nullif(dn1,0)),0),6)+0 AS mean FROM fx_pixels GROUP BY row_id")
def null_aware_mean(fx):
    return fx.pixels.groupBy("row_id").agg(r6(F.coalesce(F.avg(F.nullif("dn1", num(0))), num(0))).alias("mean"))


@query("predicates_basic", "SELECT count(*) FILTER (dn1 BETWEEN 900 AND 1100) AS in_range, count(*) FILTER (dn1 > 0.1 AND dn1 < 1000) AS open_range, count(*) FILTER (dn1 IS NOT NULL AND dn1 <> 0) AS valid, count(*) FILTER (label IN (1,3)) AS listed, count(*) FILTER (NOT (dn1 >= 1000)) AS below FROM fx_pixels")
def predicates_basic(fx):
    d = F.col("dn1")
    return fx.pixels.agg(F.count_if(d.between(900, 1100)).alias("in_range"), F.count_if((d > 0.1) & (d < 1000)).alias("open_range"), F.count_if(d.isNotNull() & (d != 0)).alias("valid"), F.count_if(F.col("label").isin(1, 3)).alias("listed"), F.count_if(~(d >= 1000)).alias("below"))


@query("confidence_counts", "SELECT CASE WHEN s >= 0.6 THEN 'high' WHEN s >= 0.4 THEN 'moderate' ELSE 'speculative' END AS confidence, count(*) AS n FROM (SELECT (door_id % 101)/101.0::DOUBLE AS s FROM fx_doors) GROUP BY 1")
def confidence_counts(fx):
    return fx.doors.groupBy(confidence((F.col("door_id") % 101) / num(101)).alias("confidence")).agg(F.count("*").alias("n"))


@query("export_text", "SELECT row_no, CASE WHEN raw_dir IS NULL OR raw_dir IN ('None','nan') THEN '' ELSE raw_dir END AS raw_dir FROM (SELECT row_no, CASE row_no % 3 WHEN 0 THEN 'nan' WHEN 1 THEN 'None' ELSE raw_dir END AS raw_dir FROM fx_sheet)")
def export_texts(fx):
    mixed = F.when(F.col("row_no") % 3 == 0, "nan").when(F.col("row_no") % 3 == 1, "None").otherwise(F.col("raw_dir"))
    return fx.sheet.select("row_no", export_text(mixed).alias("raw_dir"))


@query("col_over_max", "SELECT door_id, round(greatest(0, least(1, x/(SELECT max(x) FROM fx_doors))),6)+0 AS share FROM fx_doors")
def col_over_max(fx):
    most = fx.doors.agg(F.max("x").alias("most"))  # one row
    return fx.doors.join(F.broadcast(most)).select("door_id", r6(F.greatest(num(0), F.least(num(1), F.col("x") / F.col("most")))).alias("share"))


@query("running_ratio", "SELECT chapel_id, n, round(sum(n) OVER (ORDER BY n DESC, chapel_id)/(SELECT count(*) FROM fx_sheet)::DOUBLE,6)+0 AS running FROM (SELECT chapel_id, count(*) AS n FROM fx_sheet GROUP BY chapel_id)")
def running_ratio(fx):
    each = fx.sheet.groupBy("chapel_id").agg(F.count("*").alias("n"))
    return each.select("chapel_id", "n", r6(F.sum("n").over(W.Window.orderBy(F.desc("n"), "chapel_id")) / F.sum("n").over(W.Window.partitionBy())).alias("running"))


@query("ranked_candidates", "SELECT row_number() OVER (ORDER BY x DESC, door_id) AS rank, door_id FROM fx_doors QUALIFY rank <= 30")
def ranked_candidates(fx):
    first = fx.doors.orderBy(F.desc("x"), "door_id").limit(30)  # each task keeps 30, and only these are ranked
    return first.select(F.row_number().over(W.Window.orderBy(F.desc("x"), "door_id")).cast("long").alias("rank"), "door_id")


@query("union_layers", "SELECT 'door' AS layer, CAST(door_id AS BIGINT) AS id, x, y FROM fx_doors UNION ALL SELECT 'footprint', shp_idx, cx, cy FROM fx_footprints UNION ALL SELECT 'label', CAST(label AS BIGINT), x, y FROM fx_labels")
def union_layers(fx):
    doors = fx.doors.select(F.lit("door").alias("layer"), F.col("door_id").alias("id"), "x", "y")
    prints = fx.footprints.select(F.lit("footprint").alias("layer"), F.col("shp_idx").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    return doors.unionByName(prints).unionByName(fx.labels.select(F.lit("label").alias("layer"), F.col("label").cast("long").alias("id"), "x", "y"))


@query("terminal_intersection", "SELECT chapel_id FROM fx_doors WHERE chapel_id IN (SELECT label FROM fx_labels)")
def terminal_intersection(fx):
    return fx.doors.join(fx.labels, F.col("chapel_id") == F.col("label"), "left_semi").select("chapel_id")


@query("others_except", "SELECT chapel_id FROM fx_doors WHERE chapel_id NOT IN (SELECT label FROM fx_labels)")
def others_except(fx):
    return fx.doors.join(fx.labels, F.col("chapel_id") == F.col("label"), "left_anti").select("chapel_id")


@query("edge_dedupe", "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT door_id % 40 AS a, (door_id*7) % 40 AS b FROM fx_doors) WHERE a <> b")
def edge_dedupe(fx):
    raw = fx.doors.select((F.col("door_id") % 40).alias("a"), ((F.col("door_id") * 7) % 40).alias("b")).where("a <> b")
    return raw.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query("signature_subset", "SELECT g FROM (SELECT DISTINCT door_id % 30 AS g FROM fx_doors) WHERE NOT EXISTS (SELECT 1 FROM fx_doors d WHERE d.door_id % 30 = g AND d.direction NOT IN ('N','S'))")
def signature_subset(fx):
    """Groups whose every member is in a given set."""
    outside = fx.doors.where(~F.col("direction").isin("N", "S")).select((F.col("door_id") % 30).alias("g"))
    return fx.doors.select((F.col("door_id") % 30).alias("g")).distinct().join(outside, "g", "left_anti")
