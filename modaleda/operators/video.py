"""Videos: metrics over gray pixel rows (video_id, frame_idx, y, x, gray), and over whole frames (video_id, frame_idx, height, width, data), RGB bytes, by an Arrow kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import image as K

ID = "video_id"


def sampled(pixels: DataFrame, every: int = 5, most: int | None = 300) -> DataFrame:
    """Pixels of every n-th frame, the first ``most`` of them, or all."""
    if every > 1:
        pixels = pixels.where(F.col("frame_idx") % every == 0)
    return pixels if most is None else pixels.where(F.col("frame_idx") < every * most)


def _near(along: str, across: str, step: int):
    w = Window.partitionBy(ID, "frame_idx", across).orderBy(along)
    return F.lag("gray", step).over(w) if step > 0 else F.lead("gray", -step).over(w)


def frame_stats(pixels: DataFrame) -> DataFrame:
    """(video_id, frame_idx, brightness, contrast, sharpness, diff): the temporal profile; diff is to the frame before, null in the first."""
    p = pixels.withColumn("before", F.lag("gray").over(Window.partitionBy(ID, "y", "x").orderBy("frame_idx")))
    p = p.withColumn("up", _near("y", "x", 1)).withColumn("down", _near("y", "x", -1)).withColumn("left", _near("x", "y", 1)).withColumn("right", _near("x", "y", -1))
    lap = F.coalesce("up", "down", "gray") + F.coalesce("down", "up", "gray") + F.coalesce("left", "right", "gray") + F.coalesce("right", "left", "gray") - 4 * F.col("gray")
    return p.groupBy(ID, "frame_idx").agg(
        F.avg("gray").alias("brightness"), F.stddev_pop("gray").alias("contrast"), F.var_pop(lap).alias("sharpness"), F.avg(F.abs(F.col("gray") - F.col("before"))).alias("diff")
    )


def motion_summary(frames: DataFrame, blur: float = 80.0, motion_blur: float = 80.0, scene: float = 35.0) -> DataFrame:
    """One row for each video from its temporal profile."""
    high = frames.groupBy(ID).agg(F.percentile("diff", 0.75).alias("p75"))
    f = frames.join(high, ID)
    d = F.col("diff")
    cuts = F.count_if(d > scene)
    return f.groupBy(ID).agg(
        F.count(F.lit(1)).alias("sampled_frames"), F.avg("brightness").alias("brightness_mean"), F.stddev_pop("brightness").alias("brightness_std"), F.avg("contrast").alias("contrast_mean"), F.stddev_pop("contrast").alias("contrast_std"),
        F.avg("sharpness").alias("sharpness_mean"), F.stddev_pop("sharpness").alias("sharpness_std"), F.min("sharpness").alias("sharpness_min"), F.avg((F.col("sharpness") < blur).cast("int")).alias("blur_fraction"),
        F.coalesce(F.avg(d), F.lit(0.0)).alias("motion_intensity_mean"), F.coalesce(F.stddev_pop(d), F.lit(0.0)).alias("motion_intensity_std"), cuts.alias("scene_change_count"),
        F.coalesce(F.try_divide(cuts.cast("double"), F.count(d)), F.lit(0.0)).alias("scene_change_rate"),
        F.coalesce(F.try_divide(F.count_if((d > F.col("p75")) & (F.col("sharpness") < motion_blur)).cast("double"), F.count(d)), F.lit(0.0)).alias("motion_blur_fraction"),
    )


def scene_changes(frames: DataFrame, threshold: float = 35.0) -> DataFrame:
    return frames.where(F.col("diff") > threshold).select(ID, "frame_idx", "diff")


def shape(pixels: DataFrame, fps: float = 30.0) -> DataFrame:
    """(video_id, n_frames, fps, duration_sec, height, width, aspect_ratio, megapixels)."""
    s = pixels.groupBy(ID).agg((F.max("frame_idx") + 1).cast("long").alias("n_frames"), (F.max("y") + 1).cast("long").alias("height"), (F.max("x") + 1).cast("long").alias("width"))
    return s.select(ID, "n_frames", F.lit(fps).alias("fps"), (F.col("n_frames") / fps).alias("duration_sec"), "height", "width", (F.col("width") / F.col("height")).alias("aspect_ratio"), (F.col("height") * F.col("width") / 1e6).alias("megapixels"))


DISTANCE_METRICS = ["n_frames", "fps", "duration_sec", "height", "width", "brightness_mean", "contrast_mean", "sharpness_mean", "blur_fraction", "motion_blur_fraction", "motion_intensity_mean", "scene_change_rate"]


def records(pixels: DataFrame, fps: float = 30.0, every: int = 1, most: int | None = None) -> DataFrame:
    return shape(pixels, fps).join(motion_summary(frame_stats(sampled(pixels, every, most))), ID)


def whole_frame_stats(frames: DataFrame) -> DataFrame:
    """frame_stats of RGB frames, with the sums of each channel and its squares in 0-1; only frames are sorted, never pixels."""
    kind = dict(frames.dtypes)[ID]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rows = []
            for v, i, h, w, data, before in zip(f.video_id, f.frame_idx, f.height, f.width, f.data, f.before):
                a = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)
                g = np.rint(K.gray(a))
                diff = None if before is None or len(before) != len(data) else float(np.abs(g - np.rint(K.gray(np.frombuffer(before, np.uint8).reshape(a.shape)))).mean())
                u = a.reshape(-1, 3) / 255.0
                rows.append((v, i, float(g.mean()), float(g.std()), K.laplacian_variance(g), diff, len(u), u.sum(axis=0).tolist(), (u * u).sum(axis=0).tolist()))
            yield pd.DataFrame(rows, columns=["video_id", "frame_idx", "brightness", "contrast", "sharpness", "diff", "n", "s", "q"])

    one = frames.where("data is not null").select(ID, "frame_idx", "height", "width", "data", F.lag("data").over(Window.partitionBy(ID).orderBy("frame_idx")).alias("before"))
    return one.mapInPandas(measured, f"video_id {kind}, frame_idx long, brightness double, contrast double, sharpness double, diff double, n long, s array<double>, q array<double>")


def colour(frames: DataFrame) -> DataFrame:
    """(video_id, mean_r, ..., std_b): mean and deviation of each channel in 0-1 over all pixels, of whole_frame_stats."""
    n = F.sum("n")
    mean = {c: F.sum(F.col("s")[i]) / n for i, c in enumerate("rgb")}
    return frames.groupBy(ID).agg(
        *[m.alias(f"mean_{c}") for c, m in mean.items()], *[F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("q")[i]) / n - mean[c] * mean[c])).alias(f"std_{c}") for i, c in enumerate("rgb")]
    )


def pixel_colour(pixels: DataFrame) -> DataFrame:
    """The same of pixel rows with r, g and b."""
    return pixels.groupBy(ID).agg(*[f(F.col(c) / 255).alias(f"{n}_{c}") for n, f in (("mean", F.avg), ("std", F.stddev_pop)) for c in "rgb"])


def sample_frames(frames: DataFrame, n: int = 6) -> DataFrame:
    """At most n frames of each video, evenly spread from the first to the last."""
    size = frames.groupBy(ID).agg(F.max("frame_idx").alias("__last"))
    steps = F.least(F.col("__last") + 1, F.lit(n)) - 1
    wanted = F.transform(F.sequence(F.lit(0).cast("long"), steps.cast("long")), lambda i: F.when(steps == 0, F.lit(0)).otherwise(F.floor(i * F.col("__last") / steps)).cast("long"))
    wanted = size.select(ID, F.explode(F.array_distinct(wanted)).alias("frame_idx"))
    return frames.join(wanted, [ID, "frame_idx"], "left_semi")
