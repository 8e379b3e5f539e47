"""Array data made from the plain tables: spectral cubes, point clouds, images and videos.

Layouts are long tables, so each stays distributed: (cube_id, row, col, bands), (cloud_id, point_idx, x, y, z, ...),
(image_id, y, x, r, g, b) and (video_id, frame_idx, y, x, gray).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(embeddings: DataFrame) -> DataFrame:
    at = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("at")
    return embeddings.select(F.col("label").alias("id"), at, F.transform("embedding", lambda v: (v.cast("double") + 1) / 2).alias("e"))


def cubes(embeddings: DataFrame) -> DataFrame:
    return _ranked(embeddings).select(F.col("id").alias("cube_id"), F.lit(0).alias("row"), F.col("at").alias("col"), F.col("e").alias("bands"))


def embedding_clouds(embeddings: DataFrame) -> DataFrame:
    e = F.transform("embedding", lambda v: v.cast("double"))
    at = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("point_idx")
    return embeddings.select(F.col("label").alias("cloud_id"), at, *[e[i].alias(n) for i, n in enumerate(("x", "y", "z", "intensity", "r", "g", "b"))])


def lineitem_clouds(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.col("l_returnflag").alias("cloud_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_tax").alias("intensity"))


def _level(v):
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255).cast("int")


def images(embeddings: DataFrame) -> DataFrame:
    e = _ranked(embeddings).select(F.col("id").alias("image_id"), F.col("at").alias("y"), "e", F.posexplode("e").alias("x", "v"))
    return e.select("image_id", "y", "x", *[_level(F.get("e", (F.col("x") + i) % F.size("e"))).alias(c) for i, c in enumerate("rgb")])


def videos(embeddings: DataFrame) -> DataFrame:
    f = _ranked(embeddings).select(F.col("id").alias("video_id"), F.col("at").alias("frame_idx"), F.posexplode("e").alias("i", "v"))
    return f.select("video_id", "frame_idx", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), _level(F.col("v")).alias("gray"))


def colour_videos(embeddings: DataFrame) -> DataFrame:
    """The same with r, g and b: a pixel's colours are its own value and the two after it."""
    f = _ranked(embeddings).select(F.col("id").alias("video_id"), F.col("at").alias("frame_idx"), "e", F.posexplode("e").alias("i", "v"))
    return f.select("video_id", "frame_idx", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), *[_level(F.get("e", (F.col("i") + k) % F.size("e"))).alias(c) for k, c in enumerate("rgb")])
