"""Hyperspectral cubes as pixel rows (cube_id, row, col, bands)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import stats
from ..functions import image as K

ID = "cube_id"
TARGETS = {"nir": 850, "red": 670, "green": 560, "blue": 490}
EPS = 1e-9


def band_rows(pixels: DataFrame) -> DataFrame:
    return pixels.select(ID, "row", "col", F.posexplode("bands").alias("band", "v")).withColumn("v", F.col("v").cast("double"))


def band_stats(pixels: DataFrame) -> DataFrame:
    """(cube_id, band, mean, std, min, max, snr)."""
    g = band_rows(pixels).groupBy(ID, "band").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return g.withColumn("snr", F.col("mean") / (F.col("std") + EPS))


def noise_mad(pixels: DataFrame) -> DataFrame:
    """(cube_id, band, noise_mad): median absolute deviation from the band's median."""
    rows = band_rows(pixels)
    centre = rows.groupBy(ID, "band").agg(F.percentile("v", 0.5).alias("m"))
    return rows.join(centre, [ID, "band"]).groupBy(ID, "band").agg(F.percentile(F.abs(F.col("v") - F.col("m")), 0.5).alias("noise_mad"))


def saturation(pixels: DataFrame) -> DataFrame:
    """(cube_id, band, saturation_frac): the share of a band's values that are the cube's maximum.  The maximum is taken of band maxima, so one aggregation does."""
    by_value = band_rows(pixels).groupBy(ID, "band").agg(F.max(F.struct("v")).alias("top"), F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    most = by_value.groupBy(ID).agg(F.max("m").alias("cube_max"))
    at_top = band_rows(pixels).join(most, ID).groupBy(ID, "band").agg(F.avg((F.col("v") == F.col("cube_max")).cast("int")).alias("saturation_frac"))
    return at_top


def global_stats(pixels: DataFrame) -> DataFrame:
    g = band_rows(pixels).groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    return g.withColumn("dynamic_range", F.col("max") - F.col("min"))


def smoothness_and_dropout(pixels: DataFrame, threshold: float = 0.01) -> DataFrame:
    """(cube_id, n_bands, spectral_smoothness, n_dropout_bands, snr_mean): from band statistics alone."""
    b = band_stats(pixels)
    along = Window.partitionBy(ID).orderBy("band")
    b = b.withColumn("step", F.abs(F.col("mean") - F.lag("mean").over(along))).withColumn("spread", F.stddev_pop("std").over(Window.partitionBy(ID)))
    return b.groupBy(ID).agg(
        F.count(F.lit(1)).alias("n_bands"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("spectral_smoothness"),
        F.count_if(F.col("std") < threshold * (F.col("spread") + EPS)).alias("n_dropout_bands"), F.avg("snr").alias("snr_mean"),
    )


def interband_correlation(pixels: DataFrame) -> DataFrame:
    """(cube_id, inter_band_corr): mean of the off-diagonal band correlations, null with a constant band or a single one.

    The sum of all correlations is the mean square of the summed z-scores of a pixel, so no pair of
    bands is ever formed.
    """
    rows = band_rows(pixels)
    b = rows.groupBy(ID, "band").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    z = rows.join(b, [ID, "band"]).select(ID, "row", "col", "band", F.try_divide(F.col("v") - F.col("mean"), F.when(F.col("std") > 0, F.col("std"))).alias("z"))
    px = z.groupBy(ID, "row", "col").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("bands"), F.count("z").alias("known"))
    n = F.max("bands").cast("double")
    return px.groupBy(ID).agg(F.when((F.min("known") == F.max("bands")) & (n > 1), (F.avg(F.col("s") * F.col("s")) - n) / (n * (n - 1))).alias("inter_band_corr"))


def spatial_maps(pixels: DataFrame) -> DataFrame:
    """(cube_id, row, col, mean, std) over the bands of each pixel; narrow."""
    a = F.transform("bands", lambda v: v.cast("double"))
    p = pixels.select(ID, "row", "col", a.alias("a"), (F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)).alias("mean"))
    return p.select(ID, "row", "col", "mean", F.sqrt(F.aggregate(F.transform("a", lambda v: (v - F.col("mean")) * (v - F.col("mean"))), F.lit(0.0), lambda s, v: s + v) / F.size("a")).alias("std"))


def band_for(target: float, bands: int, wavelengths: list[float] | None = None) -> int:
    if wavelengths is not None and len(wavelengths) >= bands:
        return int(np.argmin(np.abs(np.asarray(wavelengths[:bands]) - target)))
    return int(np.clip((target - 400) / 600 * bands, 0, bands - 1))


INDICES = {
    "ndvi": lambda n, r, g, b: (n - r) / (n + r + EPS),
    "ndwi": lambda n, r, g, b: (g - n) / (g + n + EPS),
    "evi": lambda n, r, g, b: 2.5 * (n - r) / (n + 6 * r - 7.5 * b + 1 + EPS),
    "savi": lambda n, r, g, b: 1.5 * (n - r) / (n + r + 0.5 + EPS),
}


def index_map(pixels: DataFrame, name: str, bands: int, wavelengths: list[float] | None = None, **at: int) -> DataFrame:
    """(cube_id, row, col, value) of a spectral index; ``nir=`` and the like override a band."""
    if name not in INDICES:
        raise ValueError(f"unknown index {name!r}; there are {sorted(INDICES)}")
    n, r, g, b = (F.col("bands")[at.get(k, band_for(t, bands, wavelengths))].cast("double") for k, t in TARGETS.items())
    return pixels.select(ID, "row", "col", INDICES[name](n, r, g, b).alias("value"))


def index_stats(pixels: DataFrame, bands: int, wavelengths: list[float] | None = None) -> DataFrame:
    """(cube_id, index, mean, std), all indices in one pass."""
    maps = [index_map(pixels, k, bands, wavelengths).select(ID, F.lit(k).alias("index"), "value") for k in INDICES]
    n, r, g, b = (F.col("bands")[band_for(t, bands, wavelengths)].cast("double") for t in TARGETS.values())
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("index"), f(n, r, g, b).alias("value")) for k, f in INDICES.items()])).alias("i")
    assert maps
    return pixels.select(ID, each).groupBy(ID, F.col("i.index").alias("index")).agg(F.avg("i.value").alias("mean"), F.stddev_pop("i.value").alias("std"))


def signature(pixels: DataFrame, cube: object, row: int, col: int) -> DataFrame:
    """(band, value) of one pixel."""
    return pixels.where((F.col(ID) == cube) & (F.col("row") == row) & (F.col("col") == col)).select(F.posexplode("bands").alias("band", "value"))


def matching(pixels: DataFrame) -> DataFrame:
    """Pixels of the cubes that have the most frequent number of bands; of equals the one that the smallest cube_id has."""
    cubes = pixels.groupBy(ID).agg(F.max(F.size("bands")).alias("n"))
    modal = cubes.groupBy("n").agg(F.count(F.lit(1)).alias("c"), F.min(ID).alias("first")).orderBy(F.desc("c"), "first").limit(1).select("n")
    return pixels.join(F.broadcast(modal), F.size("bands") == F.col("n"), "left_semi")


def cross_cube_spectrum(pixels: DataFrame) -> DataFrame:
    """(band, mean, std, snr) over the cubes' mean spectra."""
    b = band_stats(matching(pixels))
    return b.groupBy("band").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"), F.avg("snr").alias("snr"))


def mean_spectra(pixels: DataFrame) -> DataFrame:
    """(cube_id, spectrum)."""
    b = band_stats(pixels)
    return b.groupBy(ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "mean"))), lambda s: s["mean"]).alias("spectrum"))


def _moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict = {}
    for f in frames:
        for cube, g in f.groupby("cube_id"):
            x = np.stack(g.bands.to_numpy()).astype(np.float64)
            new = [len(x), x.sum(axis=0), x.T @ x]
            held[cube] = new if cube not in held else [a + b for a, b in zip(held[cube], new)]
    if held:
        yield pd.DataFrame([(k, n, s, q.ravel()) for k, (n, s, q) in held.items()], columns=["cube_id", "n", "s", "q"])


def covariances(pixels: DataFrame) -> DataFrame:
    """(cube_id, n, s, q): count, sums and flattened products of the bands; a row for each partition is all that is shuffled."""
    kind = dict(pixels.dtypes)[ID]
    schema = f"cube_id {kind}, n long, s array<double>, q array<double>"
    parts = pixels.select(ID, F.col("bands").cast("array<double>").alias("bands")).mapInPandas(_moments, schema)

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(f.cube_id.iloc[0], int(f.n.sum()), np.sum(np.stack(f.s), axis=0), np.sum(np.stack(f.q), axis=0))], columns=["cube_id", "n", "s", "q"])

    return parts.groupBy(ID).applyInPandas(add, schema)


def pca_variance(pixels: DataFrame, components: int = 20) -> DataFrame:
    """(cube_id, component, ratio, cumulative): exact, from the covariance matrix."""
    kind = dict(pixels.dtypes)[ID]

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        n, s, b = int(f.n.iloc[0]), np.asarray(f.s.iloc[0]), len(f.s.iloc[0])
        c = np.asarray(f.q.iloc[0]).reshape(b, b) / n - np.outer(s, s) / n**2
        e = np.clip(np.linalg.eigvalsh(c)[::-1], 0, None)
        r = (e / e.sum() if e.sum() > 0 else np.zeros(b))[: min(components, n, b)]
        return pd.DataFrame({"cube_id": f.cube_id.iloc[0], "component": np.arange(len(r)), "ratio": r, "cumulative": np.cumsum(r)})

    return covariances(pixels).groupBy(ID).applyInPandas(solve, f"cube_id {kind}, component int, ratio double, cumulative double")


def pca_scores(pixels: DataFrame, components: int = 3) -> DataFrame:
    """(cube_id, row, col, scores): pixels on the first components; each component's largest loading is positive."""
    kind = dict(pixels.dtypes)[ID]

    def basis(f: pd.DataFrame) -> pd.DataFrame:
        n, s, b = int(f.n.iloc[0]), np.asarray(f.s.iloc[0]), len(f.s.iloc[0])
        v = np.linalg.eigh(np.asarray(f.q.iloc[0]).reshape(b, b) / n - np.outer(s, s) / n**2)[1][:, ::-1][:, :components].T
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
        return pd.DataFrame({"cube_id": [f.cube_id.iloc[0]], "centre": [s / n], "axes": [[list(x) for x in v]]})

    axes = covariances(pixels).groupBy(ID).applyInPandas(basis, f"cube_id {kind}, centre array<double>, axes array<array<double>>")
    centred = F.zip_with(F.col("bands").cast("array<double>"), "centre", lambda a, b: a - b)
    return pixels.join(axes, ID).withColumn("d", centred).select(
        ID, "row", "col", F.transform("axes", lambda ax: F.aggregate(F.zip_with("d", ax, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("scores")
    )


def components_for(variance: DataFrame, share: float = 0.95) -> DataFrame:
    """One row: components after which the mean variance ratio over all cubes reaches the share."""
    m = variance.groupBy("component").agg(F.avg("ratio").alias("ratio"))
    c = m.withColumn("total", F.sum("ratio").over(Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)))
    return c.agg((F.count_if(F.col("total") < share) + 1).alias("n_components"))


def false_colour(pixels: DataFrame, bands: int) -> DataFrame:
    """(cube_id, row, col, r, g, b): bands 2B/3, B/3 and 0, scaled by the extremes of the three together."""
    p = pixels.select(ID, "row", "col", *[F.col("bands")[i].cast("double").alias(c) for c, i in zip("rgb", (2 * bands // 3, bands // 3, 0))])
    ends = p.groupBy(ID).agg(F.min(F.least("r", "g", "b")).alias("lo"), F.max(F.greatest("r", "g", "b")).alias("hi"))
    scaled = lambda c: (F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo") + EPS)
    return p.join(ends, ID).select(ID, "row", "col", *[scaled(c).alias(c) for c in "rgb"])


def describe_indices(pixels: DataFrame, bands: int) -> DataFrame:
    return stats.describe(index_stats(pixels, bands), ["mean", "std"], ["index"])


def gradient(pixels: DataFrame) -> DataFrame:
    """(cube_id, band, gradient): how far the mean spectrum moves from the band before, 0 in the first."""
    before = F.lag("mean").over(Window.partitionBy(ID).orderBy("band"))
    return band_stats(pixels).select(ID, "band", F.coalesce(F.abs(F.col("mean") - before), F.lit(0.0)).alias("gradient"))


TEXTURE = ["glcm_contrast", "glcm_dissimilarity", "glcm_homogeneity", "glcm_asm", "glcm_energy", "glcm_correlation"]


def texture(pixels: DataFrame) -> DataFrame:
    """(cube_id, glcm_...): co-occurrence measures of the first principal component, spread over 64 levels.  A cube's map of scores, one number a pixel, is one group."""
    kind = dict(pixels.dtypes)[ID]

    def measured(f: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(f.row.max()) + 1, int(f.col.max()) + 1))
        m[f.row, f.col] = f.score
        return pd.DataFrame([{"cube_id": f.cube_id.iloc[0]} | K.texture_of(m)])[["cube_id", *TEXTURE]]

    scores = pca_scores(pixels, 1).select(ID, "row", "col", F.col("scores")[0].alias("score"))
    return scores.groupBy(ID).applyInPandas(measured, f"cube_id {kind}, " + ", ".join(f"{k} double" for k in TEXTURE))


def records(pixels: DataFrame, bands: int, wavelengths: list[float] | None = None) -> DataFrame:
    """All metrics of each cube, one row each."""
    size = pixels.groupBy(ID).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.max(F.size("bands")).alias("bands"))
    glob = global_stats(pixels).select(ID, F.col("mean").alias("global_mean"), F.col("std").alias("global_std"), "dynamic_range")
    wide = index_stats(pixels, bands, wavelengths).groupBy(ID).pivot("index", sorted(INDICES)).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    return size.join(glob, ID).join(smoothness_and_dropout(pixels).drop("n_bands"), ID).join(interband_correlation(pixels), ID, "left").join(wide, ID).join(texture(pixels), ID)
