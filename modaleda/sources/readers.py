"""Folders of files as tables: documents, point clouds, spectral cubes and images.

Files are listed and read by Spark; each is decoded where it is read.  A file that can't be
decoded becomes one row that says why, so that a bad file never fails a job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats

DOCUMENTS = (".txt", ".text", ".md", ".rst", ".log", ".html", ".htm", ".csv", ".tsv", ".json", ".jsonl", ".ndjson")
CLOUDS = (".npy", ".npz", ".txt", ".xyz", ".pts", ".csv", ".ply", ".las", ".laz")
CUBES = (".npy", ".npz", ".hdr")
CUBE_DATA = (".bil", ".bip", ".bsq", ".envi", ".img", ".dat", ".raw")
VIDEOS = (".mp4", ".avi", ".mov", ".mkv", ".webm", ".mpeg", ".mpg", ".m4v", ".npy", ".npz")
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp")
POINTS_A_ROW_GROUP = 50_000


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def plain_path(path: Column) -> Column:
    """Local paths without their scheme, others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def files(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """(path, ext, content) of the files with one of the extensions, whatever their case; a path that isn't there is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return found.select(plain_path(F.col("path")).alias("path"), suffix(F.col("path")).alias("ext"), "content").where(F.col("ext").isin(*extensions))


def labelled(df: DataFrame, labels: dict[str, str] | None, from_parent: bool) -> DataFrame:
    """df with ``label``: its own where it has one, else that of its path in ``labels``, else the folder's name if asked for."""
    own = [F.col("label")] if "label" in df.columns else []
    if labels:
        given = df.sparkSession.createDataFrame(sorted(labels.items()), "path string, __given__ string")
        df = df.join(given, "path", "left")
        own.append(F.col("__given__"))
    if from_parent:
        own.append(F.element_at(F.split("path", "/"), -2))
    return df.withColumn("label", F.coalesce(*own, F.lit(None).cast("string"))).drop("__given__")


def _decoded(rows_of: Callable[[str, str, bytes], Iterator[pd.DataFrame]], columns: list[str]) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, ext, content in zip(f.path, f.ext, f.content):
                try:
                    for out in rows_of(path, ext, content):
                        yield out.assign(path=path, is_corrupt=False, error=None).reindex(columns=columns)
                except Exception as e:  # noqa: BLE001 - the row carries the reason
                    yield pd.DataFrame([dict.fromkeys(columns) | {"path": path, "is_corrupt": True, "error": f"{type(e).__name__}: {e}"}], dtype=object)

    return run


def _mapped(df: DataFrame, fields: str, rows_of: Callable) -> DataFrame:
    schema = f"path string, {fields}, is_corrupt boolean, error string"
    return df.mapInPandas(_decoded(rows_of, [f.split()[0] for f in schema.split(", ")]), schema)


def read_documents(
    spark: SparkSession, path: str | list[str], labels: dict[str, str] | None = None, label_from_parent: bool = False, recursive: bool = True,
    text_field: str | None = None, label_field: str | None = None, encoding: str | None = None,
) -> DataFrame:
    """(path, source_index, encoding, text, is_corrupt, error, label): the documents of text, HTML, CSV, TSV, JSON and JSON-lines files."""

    def rows_of(_: str, ext: str, content: bytes) -> Iterator[pd.DataFrame]:
        used, docs = formats.documents(content, ext, encoding, text_field, label_field)
        if docs:
            index, text, label = zip(*docs)
            yield pd.DataFrame({"source_index": pd.array(index, "Int64"), "encoding": used, "text": text, "label": label})

    return labelled(_mapped(files(spark, path, DOCUMENTS, recursive), "source_index long, encoding string, text string, label string", rows_of), labels, label_from_parent)


def read_clouds(spark: SparkSession, path: str | list[str], labels: dict[str, str] | None = None, label_from_parent: bool = False, recursive: bool = True) -> DataFrame:
    """One row for each point: (path, point_idx, x, y, z, attrs, is_corrupt, error, label)."""

    def rows_of(_: str, ext: str, content: bytes) -> Iterator[pd.DataFrame]:
        a = formats.cloud(content, ext)
        for lo in range(0, len(a), POINTS_A_ROW_GROUP):
            b = a[lo : lo + POINTS_A_ROW_GROUP]
            yield pd.DataFrame({"point_idx": pd.array(np.arange(lo, lo + len(b)), "Int64"), "x": b[:, 0], "y": b[:, 1], "z": b[:, 2], "attrs": list(b[:, 3:].astype(np.float32))})

    return labelled(_mapped(files(spark, path, CLOUDS, recursive), "point_idx long, x double, y double, z double, attrs array<float>", rows_of), labels, label_from_parent)


def read_cubes(spark: SparkSession, path: str | list[str], labels: dict[str, str] | None = None, label_from_parent: bool = False, recursive: bool = True) -> DataFrame:
    """One row for each pixel: (path, row, col, bands, is_corrupt, error, label); an ENVI header is read with the data file of its name."""

    def pixels(a: np.ndarray) -> Iterator[pd.DataFrame]:
        if a.ndim == 2:
            a = a[:, :, None]
        if a.ndim != 3:
            raise ValueError(f"a cube has three dimensions, not {a.ndim}")
        for r in range(a.shape[0]):
            yield pd.DataFrame({"row": pd.array([r] * a.shape[1], "Int32"), "col": pd.array(np.arange(a.shape[1]), "Int32"), "bands": list(a[r].astype(np.float32))})

    def rows_of(_: str, ext: str, content: bytes) -> Iterator[pd.DataFrame]:
        if ext == ".hdr":
            n = int.from_bytes(content[:4], "big")
            if len(content) == 4 + n:
                raise ValueError("the data file of this header is missing")
            yield from pixels(formats.envi(content[4 : 4 + n].decode("latin-1"), content[4 + n :]))
        else:
            yield from pixels(formats.npy(content))

    found = files(spark, path, CUBES + CUBE_DATA, recursive).withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", ""))
    data = found.where(F.col("ext").isin(*CUBE_DATA)).select(F.col("stem").alias("__stem__"), F.col("content").alias("__data__"))
    size = F.unhex(F.lpad(F.hex(F.length("content")), 8, "0"))
    heads = found.where("ext = '.hdr'").join(data, F.col("stem") == F.col("__stem__"), "left")
    whole = heads.select("path", "ext", F.concat(size, F.col("content"), F.coalesce("__data__", F.lit(b""))).alias("content"))
    return labelled(_mapped(found.where(F.col("ext").isin(".npy", ".npz")).select("path", "ext", "content").unionByName(whole), "row int, col int, bands array<float>", rows_of), labels, label_from_parent)


def read_images(spark: SparkSession, path: str | list[str], labels: dict[str, str] | None = None, label_from_parent: bool = False, recursive: bool = True) -> DataFrame:
    """(path, height, width, data, is_corrupt, label): RGB bytes of each image; gray is repeated in all channels, transparency is dropped."""

    @F.pandas_udf("binary")
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for d, c in zip(data, channels):
            if d is None or c not in (1, 3, 4):
                out.append(None)
                continue
            a = np.frombuffer(d, np.uint8).reshape(-1, int(c))
            out.append((np.repeat(a, 3, axis=1) if c == 1 else a[:, 2::-1]).tobytes())
        return pd.Series(out)

    found = spark.read.format("image").option("recursiveFileLookup", recursive).option("dropInvalid", False).load(path)
    found = found.where(suffix(F.col("image.origin")).isin(*IMAGES))
    good = F.col("image.height") > 0
    out = found.select(
        plain_path(F.col("image.origin")).alias("path"), F.when(good, F.col("image.height")).alias("height"), F.when(good, F.col("image.width")).alias("width"),
        F.when(good, rgb("image.data", "image.nChannels")).alias("data"), (~good).alias("is_corrupt"),
    )
    return labelled(out, labels, label_from_parent)


def read_videos(spark: SparkSession, path: str | list[str], labels: dict[str, str] | None = None, label_from_parent: bool = False, recursive: bool = True, every: int = 1, most: int | None = None, fps: float = 30.0) -> DataFrame:
    """One row for each frame: (path, frame_idx, height, width, fps, data, is_corrupt, error, label), RGB bytes.

    Clips are arrays of frames (.npy, .npz), or files that OpenCV can decode where it is installed; without it they are corrupt rows.  Every ``every``-th
    frame is taken, ``most`` of them at most; frame_idx counts all.
    """

    def rows_of(_: str, ext: str, content: bytes) -> Iterator[pd.DataFrame]:
        rate, frames = formats.clip(content, ext, every, most)
        for i, a in frames:
            yield pd.DataFrame({"frame_idx": pd.array([i], "Int64"), "height": pd.array([a.shape[0]], "Int32"), "width": pd.array([a.shape[1]], "Int32"), "fps": rate or fps, "data": [a.tobytes()]})

    return labelled(_mapped(files(spark, path, VIDEOS, recursive), "frame_idx long, height int, width int, fps double, data binary", rows_of), labels, label_from_parent)


def resolved(path: str | list[str], extensions: tuple[str, ...]) -> str | list[str]:
    """The path or paths, if every one that names a file has one of the extensions; sorted, where there are several."""
    import os

    paths = [path] if isinstance(path, str) else list(path)
    bad = [p for p in paths if os.path.splitext(p)[1] and not p.lower().endswith(extensions) and not os.path.isdir(p)]
    if bad:
        raise ValueError(f"no reader for {', '.join(bad)}; there are readers for {', '.join(extensions)}")
    return path if isinstance(path, str) else sorted(paths)
