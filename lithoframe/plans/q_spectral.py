"""Queries over pixels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import constants as C
from ..functions.scalars import class_name, num, r6
from ..operators import spectral as S
from .registry import query

_RAD = "rad AS (SELECT row_id, col_id, label, " + ", ".join(f"CASE WHEN dn1 <> 0 THEN dn{k + 1} * CAST({C.ABSCAL[k]!r} AS DOUBLE) / CAST({C.EFF_BW[k]!r} AS DOUBLE) END AS {b}" for k, b in enumerate(C.BANDS)) + " FROM fx_pixels)"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({a})+({b}) <> 0 THEN (({a})-({b}))/(({a})+({b})) WHEN ({a})+({b}) = 0 THEN 0.0::DOUBLE END"


_IDX = f"""idx AS (SELECT *, {_ratio("nir1", "red")} AS ndvi, {_ratio("green", "nir1")} AS ndwi, {_ratio("nir1", "rededge")} AS ndre,
  {_ratio("red+blue", "nir1+green")} AS bsi, {_ratio("nir2", "rededge")} AS cbi, {_ratio("nir1", "green")} AS gndvi, rededge - (red + (nir1 - blue)*0.5::DOUBLE) AS fdi FROM rad)"""
_NAMES = ("ndvi", "ndwi", "ndre", "bsi", "cbi", "gndvi", "fdi")


@query("spectral_indices", _RAD, _IDX, f"SELECT row_id, col_id, {', '.join(f'round({c}, 6)+0 AS {c}' for c in _NAMES)} FROM idx")
def spectral_indices(fx):
    return S.with_indices(S.radiance(fx.pixels)).select("row_id", "col_id", *[r6(F.col(c)).alias(c) for c in _NAMES])


_PCT = "pct AS (SELECT " + ", ".join(f"quantile_cont({c}, {p}) AS {n}_{k}" for n, conds in S.MASKS.items() for k, (c, p, _) in enumerate(conds)) + " FROM idx)"
_MSK = "msk AS (SELECT idx.*, " + ", ".join(" AND ".join(f"{c} {'>' if up else '<'} {n}_{k}" for k, (c, _, up) in enumerate(conds)) + f" AS mask_{n}" for n, conds in S.MASKS.items()) + " FROM idx, pct WHERE coastal IS NOT NULL)"
_LONG = "lng AS (" + " UNION ALL ".join(f"SELECT '{n}' AS cover, {', '.join(C.BANDS)} FROM msk WHERE mask_{n}" for n in S.MASKS) + ")"


@query("spectral_masks", _RAD, _IDX, _PCT, _MSK, f"SELECT row_id, col_id, {', '.join(f'mask_{n}' for n in S.MASKS)} FROM msk")
def spectral_masks(fx):
    return S.masks(S.with_indices(S.radiance(fx.pixels))).select("row_id", "col_id", *[f"mask_{n}" for n in S.MASKS])


@query("class_signatures", _RAD, _IDX, _PCT, _MSK, _LONG, "SELECT cover, count(*) AS n, " + ", ".join(f"round(avg({b}), 6)+0 AS mean_{b}, round(stddev_pop({b}), 6)+0 AS std_{b}" for b in C.BANDS) + " FROM lng GROUP BY cover")
def class_signatures(fx):
    out = S.signatures(S.masks(S.with_indices(S.radiance(fx.pixels))))
    return out.select("cover", "n", *[r6(F.col(f"{p}_{b}")).alias(f"{p}_{b}") for b in C.BANDS for p in ("mean", "std")])


@query("band_stats", _RAD, " UNION ALL ".join(f"SELECT '{b}' AS band, count({b}) AS n, round(avg({b}),6)+0 AS mean, round(stddev_pop({b}),6)+0 AS std, round(max({b}),6)+0 AS most FROM rad" for b in C.BANDS))
def band_stats(fx):
    long = S.radiance(fx.pixels).unpivot(["row_id", "col_id"], list(C.BANDS), "band", "v")
    return long.groupBy("band").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean"), r6(F.stddev_pop("v")).alias("std"), r6(F.max("v")).alias("most"))


_PAIRS = [(C.BANDS[i], C.BANDS[j]) for i in range(8) for j in range(i + 1, 8)]


@query("band_correlation", _RAD, " UNION ALL ".join(f"SELECT '{a}' AS band_a, '{b}' AS band_b, round(corr({a},{b}),6)+0 AS corr FROM rad" for a, b in _PAIRS))
def band_correlation(fx):
    one = S.radiance(fx.pixels).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in _PAIRS])
    long = one.unpivot([], [f"`{a}|{b}`" for a, b in _PAIRS], "pair", "corr")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("band_a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("band_b"), r6(F.col("corr")).alias("corr"))


_NB = "nb AS (SELECT " + ", ".join(f"b.{x}-a.{x} AS {x}" for x in C.BANDS) + " FROM rad a JOIN rad b ON a.row_id = b.row_id AND b.col_id = a.col_id + 1 WHERE a.coastal IS NOT NULL AND b.coastal IS NOT NULL)"


@query("noise_cov", _RAD, _NB, " UNION ALL ".join(f"SELECT '{a}' AS band_a, '{b}' AS band_b, round(covar_samp({a},{b})/2,6)+0 AS cov FROM nb" for a in C.BANDS for b in C.BANDS))
def noise_cov(fx):
    m = S.noise_covariance(S.radiance(fx.pixels))
    rows = [(a, b, float(m[i, j])) for i, a in enumerate(C.BANDS) for j, b in enumerate(C.BANDS)]
    return fx.spark.createDataFrame(rows, "band_a string, band_b string, cov double").withColumn("cov", r6(F.col("cov")))


def _n01(c: str, src: str, lo: str = "0.02", hi: str = "0.98") -> str:
    q = lambda p: f"(SELECT quantile_cont({c}, {p}) FROM {src})"
    return f"CASE WHEN {c} IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({c}-{q(lo)})/({q(hi)}-{q(lo)}+1e-9::DOUBLE))) END"


@query("norm01_layer", _RAD, _IDX, f"SELECT row_id, col_id, round({_n01('bsi', 'idx')},6)+0 AS bsi01 FROM idx")
def norm01_layer(fx):
    return S.norm01(S.with_indices(S.radiance(fx.pixels)), "bsi", "bsi01").select("row_id", "col_id", r6(F.col("bsi01")).alias("bsi01"))


@query("rgb_composite", _RAD, "SELECT row_id, col_id, " + ", ".join(f"round(coalesce({_n01(b, 'rad')},0.0),6)+0 AS {n}" for b, n in (("red", "r"), ("green", "g"), ("blue", "b"))) + " FROM rad")
def rgb_composite(fx):
    df = S.radiance(fx.pixels)
    for b, n in (("red", "r"), ("green", "g"), ("blue", "b")):
        df = S.norm01(df, b, n)
    return df.select("row_id", "col_id", *[r6(F.coalesce(n, num(0))).alias(n) for n in "rgb"])


_CH = "ch AS (SELECT a.row_id, a.col_id, a.red AS r1, b.red AS r2, " + ", ".join(f"a.{x}01 AS a_{x}, b.{x}01 AS b_{x}" for x in ("red", "green", "nir1")) + " FROM n a JOIN n b ON a.row_id = b.row_id AND b.col_id = a.col_id + 1)"
_N3 = "n AS (SELECT row_id, col_id, red, " + ", ".join(f"{_n01(x, 'rad')} AS {x}01" for x in ("red", "green", "nir1")) + " FROM rad)"


@query("change_magnitude", _RAD, _N3, _CH, "SELECT row_id, col_id, CASE WHEN r1 > 0 AND r2 > 0 THEN round(sqrt(" + "+".join(f"(b_{x}-a_{x})*(b_{x}-a_{x})" for x in ("red", "green", "nir1")) + "),6)+0 END AS change FROM ch")
def change_magnitude(fx):
    """Between two dates; the stand-in's second date is the grid shifted by one column."""
    df = S.radiance(fx.pixels)
    for b in ("red", "green", "nir1"):
        df = S.norm01(df, b, f"{b}01")
    names = ["red01", "green01", "nir101"]
    late = df.select("row_id", (F.col("col_id") - 1).alias("col_id"), F.col("red").alias("red_2"), *[F.col(c).alias(f"{c}_2") for c in names])
    norm = F.sqrt(sum(((F.col(f"{c}_2") - F.col(c)) * (F.col(f"{c}_2") - F.col(c)) for c in names), num(0)))
    return df.join(late, ["row_id", "col_id"]).select("row_id", "col_id", F.when((F.col("red") > 0) & (F.col("red_2") > 0), r6(norm)).alias("change"))


@query("material_score", _RAD, _IDX, "m AS (SELECT quantile_cont(bsi,0.5) AS b, quantile_cont(fdi,0.5) AS f FROM idx)", "SELECT row_id, col_id, round(0.60*(1/(1+exp(25*(bsi-b)))) + 0.40*(1/(1+exp(0.08*(fdi-f)))),6)+0 AS material FROM idx, m")
def material_score(fx):
    return S.material_score(S.with_indices(S.radiance(fx.pixels))).select("row_id", "col_id", r6(F.col("material")).alias("material"))


_DOT = lambda a, b: "(" + "+".join(f"{a}.{x}*{b}.{x}" for x in C.BANDS) + ")"
_MEANS = "means AS (SELECT label, " + ", ".join(f"avg({b}) AS {b}" for b in C.BANDS) + " FROM rad WHERE coastal IS NOT NULL GROUP BY label)"


@query("sam_angles", _RAD, _MEANS, f"SELECT p.row_id, p.col_id, m.label, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_DOT('p', 'm')}/(sqrt({_DOT('p', 'p')})*sqrt({_DOT('m', 'm')})+1e-12::DOUBLE))))),4)+0 AS angle FROM rad p, means m WHERE p.coastal IS NOT NULL")
def sam_angles(fx):
    df = S.radiance(fx.pixels)
    means = df.where("coastal is not null").groupBy("label").agg(*[F.avg(b).alias(b) for b in C.BANDS])
    return S.angles(df, means, "label").withColumn("angle", r6(F.col("angle"), 4))


@query("extremal_class", _RAD, _MEANS, "SELECT (SELECT label FROM means ORDER BY nir1, label LIMIT 1) AS darkest, (SELECT label FROM means ORDER BY nir1 DESC, label LIMIT 1) AS brightest")
def extremal_class(fx):
    means = S.radiance(fx.pixels).where("coastal is not null").groupBy("label").agg(F.avg("nir1").alias("nir1"))
    return means.agg(F.min_by("label", F.struct("nir1", "label")).alias("darkest"), F.max_by("label", F.struct("nir1", -F.col("label"))).alias("brightest"))


@query("sam_classes", _RAD, _MEANS, f"SELECT row_id, col_id, arg_min(label, angle) AS label FROM (SELECT p.row_id, p.col_id, m.label, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {_DOT('p', 'm')}/(sqrt({_DOT('p', 'p')})*sqrt({_DOT('m', 'm')})+1e-12::DOUBLE))))),9)*1000000 + m.label/1e6 AS angle FROM rad p, means m WHERE p.coastal IS NOT NULL) GROUP BY row_id, col_id")
def sam_classes(fx):
    df = S.radiance(fx.pixels)
    means = df.where("coastal is not null").groupBy("label").agg(*[F.avg(b).alias(b) for b in C.BANDS])
    return S.angles(df, means, "label").groupBy("row_id", "col_id").agg(F.min_by("label", F.struct(F.round("angle", 9), "label")).alias("label"))


@query("cluster_bsi", _RAD, _IDX, "SELECT label, count(*) AS n, round(avg(bsi),6)+0 AS bsi, " + ", ".join(f"round(avg({b}),6)+0 AS mean_{b}" for b in C.BANDS) + " FROM idx WHERE coastal IS NOT NULL GROUP BY label")
def cluster_bsi(fx):
    df = S.with_indices(S.radiance(fx.pixels)).where("coastal is not null")
    return df.groupBy("label").agg(F.count("*").alias("n"), r6(F.avg("bsi")).alias("bsi"), *[r6(F.avg(b)).alias(f"mean_{b}") for b in C.BANDS])


@query("standardise", _RAD, "SELECT row_id, col_id, " + ", ".join(f"round(({b} - (SELECT avg({b}) FROM rad))/(SELECT stddev_pop({b}) FROM rad),6)+0 AS z_{b}" for b in C.BANDS) + " FROM rad")
def standardise(fx):
    return S.standardise(S.radiance(fx.pixels)).select("row_id", "col_id", *[r6(F.col(z)).alias(z) for z in S.Z])


@query("percentiles", _RAD, _IDX, "SELECT " + ", ".join(f"round(quantile_cont({c}, {p}),6)+0 AS {c}_{round(p * 100)}" for c in ("ndvi", "bsi", "nir1") for p in (0.02, 0.05, 0.15, 0.5, 0.75, 0.95, 0.98)) + " FROM idx")
def percentiles(fx):
    wanted = {f"{c}_{round(p * 100)}": (c, p) for c in ("ndvi", "bsi", "nir1") for p in (0.02, 0.05, 0.15, 0.5, 0.75, 0.95, 0.98)}
    one = S.percentiles(S.with_indices(S.radiance(fx.pixels)), wanted)
    return one.select(*[r6(F.col(c)).alias(c) for c in wanted])


@query("label_map_default", "SELECT vec_id, CASE label WHEN 3 THEN 'shadow_alley' WHEN 6 THEN 'shaded_compacted' WHEN 4 THEN 'bright_anomaly' ELSE 'desert_sand' END AS class_name FROM fx_pixels")
def label_map_default(fx):
    return fx.pixels.select("vec_id", class_name(F.col("label")).alias("class_name"))


@query("class_mask", "SELECT row_id, col_id, label IN (3,6) AND dn1 <> 0 AS is_path FROM fx_pixels")
def class_mask(fx):
    return fx.pixels.select("row_id", "col_id", (F.col("label").isin(3, 6) & (F.col("dn1") != 0)).alias("is_path"))


@query("neighbour_diff", "SELECT row_id, col_id, round(lead(dn3) OVER (PARTITION BY row_id ORDER BY col_id) - dn3, 6)+0 AS diff FROM fx_pixels")
def neighbour_diff(fx):
    return fx.pixels.select("row_id", "col_id", r6(F.lead("dn3").over(W.Window.partitionBy("row_id").orderBy("col_id")) - F.col("dn3")).alias("diff"))


@query("cumulative_variance", _RAD, "v AS (" + " UNION ALL ".join(f"SELECT '{b}' AS band, var_pop({b}) AS v FROM rad" for b in C.BANDS) + ")", "SELECT band, round(sum(v) OVER (ORDER BY v DESC, band)/(SELECT sum(v) FROM v),6)+0 AS running FROM v")
def cumulative_variance(fx):
    one = S.radiance(fx.pixels).agg(*[F.var_pop(b).alias(b) for b in C.BANDS]).unpivot([], list(C.BANDS), "band", "v")
    run, every = W.Window.orderBy(F.desc("v"), "band"), W.Window.partitionBy()
    return one.select("band", r6(F.sum("v").over(run) / F.sum("v").over(every)).alias("running"))


@query("pca_variance")
def pca_variance(fx):
    """Shares of variance and how many components reach 95 per cent of it."""
    _, share = S.pca(S.radiance(fx.pixels))
    total, rows, kept = 0.0, [], 0
    for k, v in enumerate(share.tolist(), 1):
        kept += total < 0.95
        total += v
        rows.append((k, v, total))
    return fx.spark.createDataFrame([(*r, r[0] <= kept) for r in rows], "component int, share double, running double, kept boolean")


@query("pca_scores")
def pca_scores(fx):
    return S.pca(S.radiance(fx.pixels))[0].where("coastal is not null").select("row_id", "col_id", "pc1", "pc2", "pc3")


@query("mnf")
def mnf(fx):
    return S.mnf(S.radiance(fx.pixels))[0].where("coastal is not null").select("row_id", "col_id", "mnf1", "mnf2", "mnf3", "mnf4")


@query("kmeans_sizes")
def kmeans_sizes(fx):
    """Clusters of the first components, numbered by brightness."""
    scored, _ = S.pca(S.radiance(fx.pixels))
    found = S.ordered_classes(S.kmeans(scored, ["pc1", "pc2", "pc3", "pc4", "pc5", "pc6", "pc7"]))
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("nir1").alias("nir1"))


@query("hash_sample", "SELECT vec_id, label FROM fx_pixels WHERE dn1 <> 0 ORDER BY (vec_id * 2654435761 + 42) % 4294967296, vec_id LIMIT 100")
def hash_sample(fx):
    """A fixed sample of 100 rows, in the order of an integer hash."""
    h = (F.col("vec_id") * F.lit(2654435761) + 42) % F.lit(4294967296)
    return fx.pixels.where("dn1 <> 0").orderBy(h, "vec_id").limit(100).select("vec_id", "label")
