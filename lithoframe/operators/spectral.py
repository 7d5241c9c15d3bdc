"""Multiband pixels: radiance, indices, masks, signatures, normalisation, principal components, noise whitening, classes.

A pixel table has one row for each cell with one column for each band; cells without data have NULL bands and need no
mask. Statistics are aggregates; small matrices (8 x 8) are decomposed on the driver and return as literals.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import constants as C
from ..functions.scalars import clip, indices, num, sigmoid, spectral_angle, zero_if_null

Z = [f"z_{b}" for b in C.BANDS]


def radiance(pixels: DataFrame) -> DataFrame:
    """dn1..dn8 to the bands' radiance; a zero in the first band is no data."""
    valid = F.col("dn1") != 0
    bands = {b: F.when(valid, F.col(f"dn{k + 1}") * num(C.ABSCAL[k]) / num(C.EFF_BW[k])) for k, b in enumerate(C.BANDS)}
    return pixels.withColumns(bands).drop(*[f"dn{k}" for k in range(1, 9)])


def with_indices(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns(indices({b: F.col(b) for b in C.BANDS}))


def percentiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: exact interpolated percentiles, name -> (column, share)."""
    return df.agg(*[F.percentile(c, num(p)).alias(n) for n, (c, p) in wanted.items()])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a one-row aggregate."""
    return df.join(F.broadcast(one_row))


def norm01(df: DataFrame, column: str, out: str, pct: tuple[float, float] = C.NORM_PCT) -> DataFrame:
    """Scaled between two percentiles and clipped; NULL stays, and a column without values gives 0 nowhere."""
    lo, hi = f"_{out}_lo", f"_{out}_hi"
    df = with_scalars(df, percentiles(df, {lo: (column, pct[0]), hi: (column, pct[1])}))
    return df.withColumn(out, clip((F.col(column) - F.col(lo)) / (F.col(hi) - F.col(lo) + num(C.NORM_EPS)), 0, 1)).drop(lo, hi)


#: Masks of land cover: name -> conditions (column, share of the percentile, above).
MASKS = {
    "vegetation": (("ndvi", 0.95, True),), "bare": (("bsi", 0.75, True),), "shadow": (("nir1", 0.05, False),),
    "bright": (("nir1", 0.95, True),), "path": (("bsi", 0.50, True), ("ndvi", 0.50, False), ("nir1", 0.15, True)),
}


def masks(indexed: DataFrame) -> DataFrame:
    """Rows of indexed pixels that have data, with a boolean mask_<name> for each land cover."""
    wanted = {f"_{n}_{k}": (c, p) for n, conds in MASKS.items() for k, (c, p, _) in enumerate(conds)}
    df = with_scalars(indexed, percentiles(indexed, wanted)).where(F.col(C.BANDS[0]).isNotNull())
    for n, conds in MASKS.items():
        hit = F.lit(True)
        for k, (c, _, above) in enumerate(conds):
            hit = hit & ((F.col(c) > F.col(f"_{n}_{k}")) if above else (F.col(c) < F.col(f"_{n}_{k}")))
        df = df.withColumn(f"mask_{n}", hit)
    return df.drop(*wanted)


def signatures(masked: DataFrame, least: int = 1) -> DataFrame:
    """Mean and standard deviation of each band within each land cover, for covers of `least` pixels or more."""
    each = masked.select(*C.BANDS, F.explode(F.filter(F.array(*[F.when(F.col(f"mask_{n}"), F.lit(n)) for n in MASKS]), lambda x: x.isNotNull())).alias("cover"))
    stats = [f(b).alias(f"{p}_{b}") for b in C.BANDS for f, p in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return each.groupBy("cover").agg(F.count("*").alias("n"), *stats).where(F.col("n") >= least)


def material_score(indexed: DataFrame) -> DataFrame:
    bsi, fdi = C.MATERIAL[0], C.MATERIAL[1]
    df = with_scalars(indexed, percentiles(indexed, {"_b": ("bsi", 0.5), "_f": ("fdi", 0.5)}))
    score = num(C.MATERIAL[2]) * sigmoid(num(-bsi) * (F.col("bsi") - F.col("_b"))) + num(C.MATERIAL[3]) * sigmoid(num(-fdi) * (F.col("fdi") - F.col("_f")))
    return df.withColumn("material", score).drop("_b", "_f")


def standardise(pixels: DataFrame) -> DataFrame:
    """z_<band>: over the population's deviation; a constant band is only centred."""
    stats = pixels.agg(*[F.avg(b).alias(f"_m_{b}") for b in C.BANDS], *[F.stddev_pop(b).alias(f"_s_{b}") for b in C.BANDS])
    df = with_scalars(pixels, stats)
    z = {f"z_{b}": (F.col(b) - F.col(f"_m_{b}")) / F.when(F.col(f"_s_{b}") > 0, F.col(f"_s_{b}")).otherwise(num(1)) for b in C.BANDS}
    return df.withColumns(z).drop(*[f"_{k}_{b}" for b in C.BANDS for k in "ms"])


def covariance(df: DataFrame, columns: list[str], sample: bool = True) -> np.ndarray:
    """Matrix of pairwise covariances over rows without NULL, in one aggregate."""
    f = F.covar_samp if sample else F.covar_pop
    n = len(columns)
    row = df.dropna(subset=columns).agg(*[f(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    return np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])


def components_of(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors as columns; each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    sign = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(sign == 0, 1, sign)


def project(df: DataFrame, columns: list[str], matrix: np.ndarray, prefix: str) -> DataFrame:
    """<prefix>1.. as products of the columns with the matrix's columns."""
    return df.withColumns({f"{prefix}{k + 1}": sum((F.col(c) * num(matrix[i, k]) for i, c in enumerate(columns)), num(0)) for k in range(matrix.shape[1])})


def pca(pixels: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Scores pc1..pc8 of standardised bands, and the components' shares of variance."""
    z = standardise(pixels)
    values, vectors = components_of(covariance(z, Z, sample=False))
    return project(z, Z, vectors, "pc"), values / max(values.sum(), 1e-300)


def noise_covariance(pixels: DataFrame) -> np.ndarray:
    """Half the covariance of differences between horizontal neighbours that both have data."""
    own = pixels.select("row_id", (F.col("col_id") - 1).alias("col_id"), *[F.col(b).alias(f"n_{b}") for b in C.BANDS])
    diff = pixels.join(own, ["row_id", "col_id"]).select(*[(F.col(f"n_{b}") - F.col(b)).alias(b) for b in C.BANDS])
    return covariance(diff, list(C.BANDS)) / 2


def mnf(pixels: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Components of standardised bands after whitening with the noise of the raw bands: mnf1..mnf8 and their shares of variance."""
    values, vectors = np.linalg.eigh(noise_covariance(pixels))
    white = vectors / np.sqrt(np.maximum(values, 1e-10))
    df = project(standardise(pixels), Z, white, "_w")
    names = [f"_w{k}" for k in range(1, 9)]
    means = df.agg(*[F.avg(c).alias(f"{c}m") for c in names])
    df = with_scalars(df, means).withColumns({c: F.col(c) - F.col(f"{c}m") for c in names})
    values, vectors = components_of(covariance(df, names, sample=False))
    return project(df, names, vectors, "mnf").drop(*names, *[f"{c}m" for c in names]), values / max(values.sum(), 1e-300)


def kmeans(scored: DataFrame, columns: list[str], k: int = 8, seed: int = 42) -> DataFrame:
    """cluster of every row that has the columns; NULL columns give no row."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(scored)
    model = KMeans(k=k, seed=seed, maxIter=50, featuresCol="_v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("_v")


def ordered_classes(clustered: DataFrame, by: str = "nir1") -> DataFrame:
    """Clusters renumbered by the mean of a band, so that a number has a meaning whatever the clustering called it."""
    order = clustered.groupBy("cluster").agg(F.avg(by).alias("_m")).withColumn("rank", (F.row_number().over(W.Window.orderBy("_m", "cluster")) - 1).cast("int"))
    return clustered.join(F.broadcast(order.select("cluster", "rank")), "cluster").drop("cluster").withColumnRenamed("rank", "cluster")


def angles(pixels: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Spectral angle of every pixel to every reference spectrum (few rows with the bands): row_id, col_id, key, angle."""
    r = refs.select(key, *[F.col(b).alias(f"r_{b}") for b in C.BANDS])
    both = pixels.where(F.col(C.BANDS[0]).isNotNull()).select("row_id", "col_id", *C.BANDS).join(F.broadcast(r))
    return both.select("row_id", "col_id", key, spectral_angle([F.col(b) for b in C.BANDS], [F.col(f"r_{b}") for b in C.BANDS]).alias("angle"))


def path_signal(df: DataFrame, weights: dict[str, float] = C.SIGNAL_WEIGHTS) -> Column:
    """Weighted sum of layers that are in 0..1; a missing layer counts as 0."""
    return sum((num(w) * zero_if_null(F.col(c)) for c, w in weights.items()), num(0))
