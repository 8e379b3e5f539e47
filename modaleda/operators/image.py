"""Images: metrics over pixel rows (image_id, y, x, r, g, b), and whole records by an Arrow kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import image as K

ID = "image_id"


def gray() -> Column:
    return 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def channel_stats(pixels: DataFrame) -> DataFrame:
    """Mean, deviation and extremes of each channel, brightness, contrast, exposure, in one aggregation."""
    g = gray()
    return pixels.groupBy(ID).agg(
        *[f(c).cast("double").alias(f"{n}_{c}") for c in "rgb" for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))],
        F.avg(g).alias("brightness"), F.stddev_pop(g).alias("contrast"), F.avg((g > 245).cast("int")).alias("overexposed_frac"), F.avg((g < 10).cast("int")).alias("underexposed_frac"),
    )


def entropy(pixels: DataFrame) -> DataFrame:
    """(image_id, entropy_val) in bits over 256 gray levels."""
    n = pixels.groupBy(ID, F.rint(gray()).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(ID)))
    return total.groupBy(ID).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy_val"))


def _near(value: str, along: str, across: str, step: int) -> Column:
    w = Window.partitionBy(ID, across).orderBy(along)
    return F.lag(value, step).over(w) if step > 0 else F.lead(value, -step).over(w)


def sharpness(pixels: DataFrame, blur: float = 50.0) -> DataFrame:
    """(image_id, sharpness, is_blurry): variance of the Laplacian of whole gray levels; beyond the border the picture is mirrored."""
    p = pixels.select(ID, "y", "x", F.rint(gray()).alias("v"))
    up, down, left, right = _near("v", "y", "x", 1), _near("v", "y", "x", -1), _near("v", "x", "y", 1), _near("v", "x", "y", -1)
    p = p.withColumn("up", up).withColumn("down", down).withColumn("left", left).withColumn("right", right)
    vertical = F.coalesce("up", "down", "v") + F.coalesce("down", "up", "v")
    across = F.coalesce("left", "right", "v") + F.coalesce("right", "left", "v")
    s = p.select(ID, (vertical + across - 4 * F.col("v")).alias("l")).groupBy(ID).agg(F.var_pop("l").alias("sharpness"))
    return s.withColumn("is_blurry", F.col("sharpness") < blur)


def blockiness(pixels: DataFrame, size: int = 8) -> DataFrame:
    """(image_id, blockiness): mean over block borders of the mean gray step across each."""
    p = pixels.select(ID, "y", "x", gray().alias("v"))
    p = p.withColumn("dy", F.abs(F.col("v") - _near("v", "y", "x", 1))).withColumn("dx", F.abs(F.col("v") - _near("v", "x", "y", 1)))
    on = lambda c: (F.col(c) % size == 0) & (F.col(c) > 0)
    border = F.array(F.struct(F.lit("y").alias("k"), F.col("y").cast("int").alias("at"), F.when(on("y"), F.col("dy")).alias("d")), F.struct(F.lit("x").alias("k"), F.col("x").cast("int").alias("at"), F.when(on("x"), F.col("dx")).alias("d")))
    lines = p.select(ID, F.explode(border).alias("e")).select(ID, "e.*").where("d is not null").groupBy(ID, "k", "at").agg(F.avg("d").alias("d"))
    return pixels.select(ID).distinct().join(lines.groupBy(ID).agg(F.avg("d").alias("blockiness")), ID, "left").fillna(0.0, ["blockiness"])


def colour(pixels: DataFrame) -> DataFrame:
    """(image_id, saturation_mean, value_mean, hue_mean, is_grayscale_like, color_temp) in the 8-bit convention."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    v, d = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    safe = F.when(d > 0, d).otherwise(1.0)
    h = 60.0 * F.when(v == r, (g - b) / safe).when(v == g, 2.0 + (b - r) / safe).otherwise(4.0 + (r - g) / safe)
    hue = F.when(d > 0, F.when(h < 0, h + 360.0).otherwise(h)).otherwise(0.0) / 2.0
    out = pixels.groupBy(ID).agg(
        F.avg(F.when(v > 0, 255.0 * d / F.when(v > 0, v).otherwise(1.0)).otherwise(0.0)).alias("saturation_mean"), F.avg(v).alias("value_mean"), F.avg(hue).alias("hue_mean"), (F.avg(r) / (F.avg(b) + 1e-6)).alias("warmth")
    )
    temp = F.when(F.col("warmth") > 1.1, "warm").when(F.col("warmth") < 0.9, "cool").otherwise("neutral")
    return out.select(ID, "saturation_mean", "value_mean", "hue_mean", (F.col("saturation_mean") < 15).alias("is_grayscale_like"), temp.alias("color_temp"))


def hue_histogram(pixels: DataFrame, bins: int = 36) -> DataFrame:
    """(bin, count) of the hues of coloured pixels over all images."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    v, d = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    h = 60.0 * F.when(v == r, (g - b) / d).when(v == g, 2.0 + (b - r) / d).otherwise(4.0 + (r - g) / d)
    return pixels.where(d > 0).groupBy(F.least(F.floor(F.when(h < 0, h + 360.0).otherwise(h) / (360.0 / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def normalization(pixels: DataFrame) -> DataFrame:
    """One row: means over images of the channels' mean and deviation in 0-1 (images weigh alike, whatever their size)."""
    s = channel_stats(pixels)
    return s.agg(*[F.avg(F.col(f"{n}_{c}") / 255).alias(f"{n}_{c}") for n in ("mean", "std") for c in "rgb"])


def average_image(pixels: DataFrame) -> DataFrame:
    """(y, x, mean and deviation of each channel) over the images."""
    return pixels.groupBy("y", "x").agg(*[f(c).alias(f"{n}_{c}") for c in "rgb" for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def channel_correlation(pixels: DataFrame) -> DataFrame:
    return pixels.agg(F.corr("r", "g").alias("rg"), F.corr("r", "b").alias("rb"), F.corr("g", "b").alias("gb"))


def cooccurrence(pixels: DataFrame, levels: int = 64) -> DataFrame:
    """(image_id, i, j, n): gray levels of horizontal neighbours, both ways."""
    q = pixels.select(ID, "y", "x", F.floor(gray() / (256 // levels)).cast("int").alias("q")).withColumn("p", _near("q", "x", "y", 1)).where("p is not null")
    both = q.select(ID, F.explode(F.array(F.struct(F.col("p").alias("i"), F.col("q").alias("j")), F.struct(F.col("q").alias("i"), F.col("p").alias("j")))).alias("e"))
    return both.groupBy(ID, "e.i", "e.j").agg(F.count(F.lit(1)).alias("n"))


def cooccurrence_measures(pixels: DataFrame, levels: int = 64) -> DataFrame:
    """(image_id, contrast, dissimilarity, homogeneity, asm, energy) of ``cooccurrence``."""
    c = cooccurrence(pixels, levels)
    p = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(ID)))
    d = F.col("i") - F.col("j")
    out = p.groupBy(ID).agg(F.sum(d * d * F.col("p")).alias("contrast"), F.sum(F.abs(d) * F.col("p")).alias("dissimilarity"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.sum(F.col("p") * F.col("p")).alias("asm"))
    return out.withColumn("energy", F.sqrt("asm"))


def packed(pixels: DataFrame) -> DataFrame:
    """(image_id, height, width, data): pixel rows gathered to bytes, RGB row by row; image sizes bound the lists."""
    rgb = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    g = pixels.groupBy(ID).agg(rgb.alias("p"), (F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
    hexed = F.transform("p", lambda s: F.concat(*[F.lpad(F.hex(s[c].cast("long")), 2, "0") for c in "rgb"]))
    return g.select(ID, "height", "width", F.unhex(F.array_join(hexed, "")).alias("data"))


FIELDS = (
    "height int, width int, channels int, aspect_ratio double, megapixels double, mean_rgb array<double>, std_rgb array<double>, min_rgb array<double>, max_rgb array<double>, "
    "brightness double, contrast double, sharpness double, is_blurry boolean, noise_estimate double, overexposed_frac double, underexposed_frac double, entropy_val double, compression_score double, "
    "mean_hsv array<double>, mean_lab array<double>, saturation_mean double, is_grayscale_like boolean, color_temp string, phash long, ahash long, md5 string, "
    "glcm_contrast double, glcm_dissimilarity double, glcm_homogeneity double, glcm_energy double, glcm_correlation double, glcm_asm double, freq_low double, freq_mid double, freq_high double, is_corrupt boolean, error string"
)


def records(images: DataFrame, key: str = ID, blur: float = 50.0, texture: bool = True) -> DataFrame:
    """One record for each (key, height, width, data) row, data being RGB bytes; one that can't be read is corrupt and says why."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, h, w, data in zip(f[key], f.height, f.width, f.data):
                try:
                    a = np.frombuffer(data, np.uint8).reshape(int(h), int(w), -1)
                    r = K.record(K.to_rgb(a), blur, texture) | {"is_corrupt": False}
                except Exception as e:  # noqa: BLE001 - a bad item must not fail the job; the record carries the reason
                    r = {"is_corrupt": True, "error": f"{type(e).__name__}: {e}"}
                rows.append([i, *[r.get(n) for n in names]])
            yield pd.DataFrame(rows, columns=[key, *names]).astype({"phash": "Int64", "ahash": "Int64", "height": "Int32", "width": "Int32", "channels": "Int32"})

    return images.select(key, "height", "width", "data").mapInPandas(run, f"{key} {dict(images.dtypes)[key]}, {FIELDS}")


def dominant_colours(pixels: DataFrame, k: int = 8, seed: int = 42) -> DataFrame:
    """(r, g, b, share) of k-means clusters of the pixels, the largest first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = pixels.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in "rgb"])).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(v)
    sizes = model.transform(v).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    centres = pixels.sparkSession.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())], "prediction int, r double, g double, b double")
    return sizes.join(F.broadcast(centres), "prediction").select("r", "g", "b", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share")).orderBy(F.desc("share"))


def resized_average(images: DataFrame, height: int = 224, width: int = 224, label: str | None = None) -> DataFrame:
    """(y, x, mean and deviation of each channel) over images brought to one size; of one label, if asked for.

    Sums are made within each partition, so one picture of sums for each of them is all that is shuffled.
    """
    shape = (height, width, 3)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(shape), np.zeros(shape)
        for f in frames:
            for h, w, data in zip(f.height, f.width, f.data):
                a = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3).astype(np.float64)
                a = np.stack([K.linear_resize(a[..., c], height, width) for c in range(3)], axis=2)
                n, s, q = n + 1, s + a, q + a * a
        if n:
            y, x = np.mgrid[0:height, 0:width]
            yield pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "n": n} | {f"{k}{c}": m[..., i].ravel() for k, m in (("s", s), ("q", q)) for i, c in enumerate("rgb")})

    if label is not None:
        images = images.where(F.col("label") == label)
    parts = images.where("data is not null").select("height", "width", "data").mapInPandas(sums, "y int, x int, n long, sr double, sg double, sb double, qr double, qg double, qb double")
    total = parts.groupBy("y", "x").agg(*[F.sum(c).alias(c) for c in parts.columns[2:]])
    mean = lambda c: F.col(f"s{c}") / F.col("n")
    return total.select("y", "x", *[e for c in "rgb" for e in (mean(c).alias(f"mean_{c}"), F.sqrt(F.greatest(F.lit(0.0), F.col(f"q{c}") / F.col("n") - mean(c) * mean(c))).alias(f"std_{c}"))])


def orientation() -> Column:
    return F.when(F.col("aspect_ratio") > 1.05, "landscape").when(F.col("aspect_ratio") < 0.95, "portrait").otherwise("square")
