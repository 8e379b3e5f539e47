"""A data set of one modality: loaded from files or memory, its records, its summary, single items.

    texts = TextDataset.load(spark, "folder", label_from_parent=True)
    texts.summary()["lexical"]["top_words"]
    TextDataset.of(spark, ["first text", "second"], labels=["a", "b"]).record(0)

Items are numbered by path (of arrays: as given).  Records and counts stay distributed, and are made once (a table in
the shared folder); a summary brings aggregates to the driver, lists of names only up to ``LISTED`` (and says how many there are).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import shared, stats
from .functions import image as K
from .operators import cloud, dedup, image, spectral, text, video
from .sources import readers, report

LISTED = 1000


class DatasetError(RuntimeError):
    """Nothing has been loaded."""


def once(df: DataFrame) -> DataFrame:
    """df, made now and kept in the shared folder, for what reads it several times."""
    shared.checkpoints(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, key: str) -> DataFrame:
    """(key, item): the distinct keys, numbered in order without one task for all: counts of ranges are summed up first."""
    keys = once(df.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).select(key, F.spark_partition_id().alias("__p")))
    size = keys.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = size.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))  # a row for each partition
    at = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return keys.withColumn("__i", at).join(F.broadcast(before), "__p").select(key, (F.col("__b") + F.col("__i")).alias("item"))


class Dataset:
    """What all modalities share.  ``rows`` has the payload: one row or more for each item, named by ``key``; corrupt items have one row that says why."""

    key = "name"
    noun = "items"
    payload: list[str] = []
    extensions: tuple[str, ...] = ()

    def __init__(self, rows: DataFrame | None = None, **options):
        self._rows, self.options = rows, options
        self._items: DataFrame | None = None
        self._records: DataFrame | None = None
        self._summary: dict | None = None

    @property
    def rows(self) -> DataFrame:
        if self._rows is None:
            raise DatasetError("nothing is loaded; call load() or of() first")
        return self._rows

    def only(self, label: str) -> Dataset:
        """The items of one label."""
        return type(self)(self.rows.where(F.col("label") == label), **self.options)

    def first(self, n: int) -> Dataset:
        """The first n items in order of their names."""
        names = self.rows.select(self.key).distinct().orderBy(self.key).limit(n)
        return type(self)(self.rows.join(names, self.key, "left_semi"), **self.options)

    def items(self) -> DataFrame:
        """(name, label, ext, is_corrupt, error, item), one row each."""
        if self._items is not None:
            return self._items
        one = self.rows.groupBy(self.key).agg(F.first("label", True).alias("label"), F.max("is_corrupt").alias("is_corrupt"), F.first("error", True).alias("error"))
        self._items = once(one.withColumn("ext", readers.suffix(F.col(self.key))).join(numbered(one, self.key), self.key))
        return self._items

    def valid(self) -> DataFrame:
        return self.rows.where("not is_corrupt")

    def measured(self) -> DataFrame:
        """Metrics of each valid item, by key."""
        raise NotImplementedError

    def records(self) -> DataFrame:
        """One row for each valid item: its number, label and metrics."""
        if self._records is None:
            self._records = once(self.items().where("not is_corrupt").drop("is_corrupt", "error").join(self.measured(), self.key))
        return self._records

    def _name(self, i: int) -> str:
        found = self.items().where(F.col("item") == i).select(self.key).first()
        if found is None:
            raise IndexError(f"there is no item {i}")
        return found[0]

    def record(self, i: int) -> dict:
        """All metrics of one item."""
        found = self.records().where(F.col("item") == i).first()
        if found is None:
            raise IndexError(f"there is no valid item {i}")
        return found.asDict(recursive=True)

    def data(self, i: int) -> DataFrame:
        """The payload rows of one item."""
        return self.rows.where(F.col(self.key) == self._name(i)).select(*self.payload)

    def _listed(self, df: DataFrame, column: str) -> list:
        return [r[0] for r in df.select(column).orderBy(column).limit(LISTED).collect()]

    def _counts(self, df: DataFrame, column: str) -> dict:
        return {str(r[0]): r[1] for r in stats.frequency(df, column).orderBy(F.desc("count"), column).limit(LISTED).collect()}

    def _stats(self, metrics: dict[str, str]) -> dict:
        rows = {r["metric"]: {k: r[k] for k in stats.STATS} for r in stats.describe(self.records(), sorted(set(metrics.values()))).collect()}
        return {name: rows[m] for name, m in metrics.items()}

    def _inventory(self) -> dict:
        items = self.items()
        n = items.agg(F.count(F.lit(1)), F.count_if("is_corrupt")).first()
        good = items.where("not is_corrupt")
        labels = self._counts(good, "label")
        return {
            f"total_{self.noun}": n[0], f"valid_{self.noun}": n[0] - n[1], f"corrupt_{self.noun}": n[1], "corrupt_paths": self._listed(items.where("is_corrupt"), self.key),
            "format_distribution": self._counts(good.where("ext != ''"), "ext"), "label_distribution": labels or None,
        }

    def sections(self) -> dict:
        """The parts of the summary that the modality has."""
        raise NotImplementedError

    def summary(self) -> dict:
        """Nested summary; made once."""
        if self._summary is None:
            inventory = self._inventory()
            labels = inventory["label_distribution"]
            out = {"inventory": inventory}
            if inventory[f"valid_{self.noun}"]:
                extra = self.sections()
                inventory |= extra.pop("inventory", {})
                out |= extra
            else:
                out["error"] = f"No valid {self.noun} found."
            out["labels"] = {"label_distribution": labels, "class_imbalance_ratio": round(max(labels.values()) / min(labels.values()), 6) if labels and len(labels) > 1 else None}
            self._summary = out
        return self._summary

    def to_json(self) -> str:
        return json.dumps(self.summary(), default=str, ensure_ascii=False)

    def write_report(self, path: str) -> None:
        """An HTML page: the summary's numbers, and histograms of the metrics."""
        report.write_summary(path, f"{type(self).__name__}: summary", self.summary(), {m: stats.histogram(self.records(), m, 20) for m in self.charted})

    charted: list[str] = []

    @classmethod
    def _names(cls, n: int, names: Sequence[str] | None) -> list[str]:
        names = list(names) if names is not None else [f"<{cls.noun.rstrip('s')}_{i:06d}>" for i in range(n)]
        if len(names) != n or len(set(names)) != n:
            raise ValueError("there must be one name for each item, and no two alike")
        return names


def _labels(n: int, labels: Sequence[str] | None) -> list[str | None]:
    if labels is None:
        return [None] * n
    if len(labels) != n:
        raise ValueError("there must be one label for each item")
    return list(labels)


class TextDataset(Dataset):
    noun, payload, extensions = "documents", ["text"], readers.DOCUMENTS
    charted = ["word_count", "avg_sentence_length", "lexical_diversity"]

    @classmethod
    def load(cls, spark: SparkSession, path: str | list[str], lowercase: bool = True, min_length: int = 1, short_words: int = 5, long_words: int = 1000, **reading) -> TextDataset:
        df = readers.read_documents(spark, readers.resolved(path, cls.extensions), **reading)
        name = F.when(F.coalesce("source_index", F.lit(0)) == 0, F.col("path")).otherwise(F.concat("path", F.lit("#"), F.col("source_index").cast("string")))
        return cls(df.withColumn("name", name), lowercase=lowercase, min_length=min_length, short_words=short_words, long_words=long_words)

    @classmethod
    def of(cls, spark: SparkSession, texts: Sequence[str | None], labels: Sequence[str] | None = None, names: Sequence[str] | None = None, **options) -> TextDataset:
        """Texts of the driver's memory; a null one is corrupt."""
        rows = [(n, t, lab, "unicode", t is None, "no text" if t is None else None) for n, t, lab in zip(cls._names(len(texts), names), texts, _labels(len(texts), labels))]
        return cls(spark.createDataFrame(rows, "name string, text string, label string, encoding string, is_corrupt boolean, error string"), **options)

    @classmethod
    def of_table(cls, docs: DataFrame, key: str, label: str | None = None, **options) -> TextDataset:
        """Any table with a text column."""
        return cls(docs.select(F.col(key).cast("string").alias("name"), "text", (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"), F.lit("unicode").alias("encoding"), F.col("text").isNull().alias("is_corrupt"), F.lit(None).cast("string").alias("error")), **options)

    def measured(self) -> DataFrame:
        return text.records(self.valid(), keep=["name", "encoding"], **self.options)

    def text(self, i: int) -> str:
        return self.data(i).first()[0]

    def _terms(self, n: int, stopwords: Sequence[str] = ()) -> DataFrame:
        o = self.options
        return text.term_counts(text.token_rows(self.valid(), "name", n=n, lowercase=o.get("lowercase", True), min_length=o.get("min_length", 1), stopwords=stopwords), "name")

    def _top(self, n: int, stopwords: Sequence[str] = ()) -> list:
        return [tuple(r) for r in text.most_common(self._terms(n, stopwords), 50).collect()]

    def sections(self) -> dict:
        rec = self.records()
        lexical = text.lexical_summary(self._terms(1)).first()
        flags = {r["flag"]: r["count"] for r in stats.rates(rec, ["empty", "very_short", "very_long"]).collect()}
        groups = dedup.exact_groups(rec, "name", "normalised_hash")
        same = dedup.duplicate_summary(rec, "name", "normalised_hash").first()
        named = rec.join(groups.select("normalised_hash"), "normalised_hash").select("normalised_hash", "name", F.row_number().over(Window.partitionBy("normalised_hash").orderBy("name")).alias("n")).where(F.col("n") <= LISTED)
        named = named.groupBy("normalised_hash").agg(F.array_sort(F.collect_list("name")).alias("names")).orderBy("names").limit(LISTED)
        return {
            "inventory": {"encoding_distribution": self._counts(rec, "encoding"), "dominant_script_distribution": self._counts(rec, "dominant_script")},
            "length": self._stats({"characters": "char_count", "bytes": "byte_count", "words": "word_count", "sentences": "sentence_count", "paragraphs": "paragraph_count", "lines": "line_count", "avg_word_length": "avg_word_length", "avg_sentence_length": "avg_sentence_length", "sentence_length_std": "sentence_length_std"}),
            "lexical": {f"dataset_{k}": lexical[k] for k in ("total_tokens", "unique_tokens", "type_token_ratio", "hapax_count", "hapax_ratio")}
            | self._stats({"document_lexical_diversity": "lexical_diversity", "document_hapax_ratio": "hapax_ratio", "stopword_ratio": "stopword_ratio"})
            | {"top_words": self._top(1), "top_content_words": self._top(1, text.X.STOPWORDS), "top_bigrams": self._top(2), "top_trigrams": self._top(3)},
            "symbols": self._stats({m: m for m in ("punctuation_rate", "digit_rate", "uppercase_rate", "whitespace_rate", "non_ascii_rate", "emoji_count", "url_count", "email_count", "hashtag_count", "mention_count")}),
            "readability": self._stats({"flesch_reading_ease": "readability_flesch", "flesch_kincaid_grade": "readability_grade"}),
            "quality": {f"{k}_documents": n for k, n in flags.items()} | self._stats({"repeated_line_fraction": "repeated_line_fraction"}) | {"n_exact_duplicate_groups": same["n_groups"], "exact_duplicate_groups": [list(r["names"]) for r in named.collect()], "documents_in_duplicate_groups": same["n_in_groups"], "exact_duplicate_fraction": same["duplicate_fraction"]},
        }


class ImageDataset(Dataset):
    noun, payload, extensions = "images", ["height", "width", "data"], readers.IMAGES
    charted = ["brightness", "contrast", "sharpness", "entropy_val"]

    @classmethod
    def load(cls, spark: SparkSession, path: str | list[str], **reading) -> ImageDataset:
        df = readers.read_images(spark, readers.resolved(path, cls.extensions), **reading)
        return cls(df.select(F.col("path").alias("name"), "height", "width", "data", "label", "is_corrupt", F.when(F.col("is_corrupt"), "the image can't be decoded").alias("error")))

    @classmethod
    def of(cls, spark: SparkSession, arrays: Sequence[np.ndarray], labels: Sequence[str] | None = None, names: Sequence[str] | None = None) -> ImageDataset:
        rows = []
        for n, a, lab in zip(cls._names(len(arrays), names), arrays, _labels(len(arrays), labels)):
            try:
                a = K.to_rgb(a)
                rows.append((n, a.shape[0], a.shape[1], a.tobytes(), lab, False, None))
            except ValueError as e:
                rows.append((n, None, None, None, lab, True, str(e)))
        return cls(spark.createDataFrame(rows, "name string, height int, width int, data binary, label string, is_corrupt boolean, error string"))

    def measured(self) -> DataFrame:
        rec = image.records(self.valid().select(F.col("name").alias(image.ID), "height", "width", "data")).where("not is_corrupt").drop("is_corrupt", "error")
        return rec.withColumnRenamed(image.ID, self.key).withColumn("orientation", image.orientation())

    def image(self, i: int) -> np.ndarray:
        r = self.data(i).first()
        return np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)

    def average(self, height: int = 224, width: int = 224, label: str | None = None) -> DataFrame:
        return image.resized_average(self.valid(), height, width, label)

    def sections(self) -> dict:
        rec = self.records()
        flags = {r["flag"]: r for r in stats.rates(rec, ["is_blurry", "is_grayscale_like"]).collect()}
        flat = rec.select(*[F.col(v)[i].alias(f"{v}_{c}") for v in ("mean_rgb", "std_rgb") for i, c in enumerate("rgb")], ((F.col("mean_rgb")[0] + F.col("mean_rgb")[1] + F.col("mean_rgb")[2]) / 3).alias("mean"))
        means = stats.vector_means(flat, {v: [f"{v}_{c}" for c in "rgb"] for v in ("mean_rgb", "std_rgb")}).orderBy("vector", "component").collect()
        of = lambda v, k: [r[k] for r in means if r["vector"] == v]
        per_image = stats.describe(flat, ["mean"]).first()
        near = dedup.greedy_groups(rec, dedup.hamming_pairs(rec, "item", "phash", 10), "item")
        return {
            "inventory": {"colour_mode_distribution": {"RGB": rec.count()}, "dtype_distribution": {"uint8": rec.count()}},
            "spatial": self._stats({m: m for m in ("height", "width", "aspect_ratio", "megapixels")}) | {"orientation_distribution": self._counts(rec, "orientation")},
            "pixel_stats": {"dataset_mean_rgb": of("mean_rgb", "mean"), "dataset_std_rgb_across_images": of("mean_rgb", "std"), "dataset_pixel_std_rgb": of("std_rgb", "mean"), "per_image_mean_rgb": {k: per_image[k] for k in stats.STATS}},
            "quality": self._stats({"brightness": "brightness", "contrast": "contrast", "sharpness": "sharpness", "noise_estimate": "noise_estimate", "entropy": "entropy_val", "compression_score": "compression_score", "overexposed_frac": "overexposed_frac", "underexposed_frac": "underexposed_frac"}) | {"blurry_count": flags["is_blurry"]["count"], "blurry_fraction": round(flags["is_blurry"]["fraction"], 4)},
            "colour": self._stats({"saturation": "saturation_mean"}) | {"colour_temp_distribution": self._counts(rec, "color_temp"), "grayscale_like_count": flags["is_grayscale_like"]["count"], "grayscale_like_fraction": round(flags["is_grayscale_like"]["fraction"], 4)},
            "texture": self._stats({m: m for m in spectral.TEXTURE}),
            "frequency": self._stats({m: m for m in ("freq_low", "freq_mid", "freq_high")}),
            "duplicates": {"n_exact_duplicate_groups": dedup.exact_groups(rec, "name", "md5").count(), "n_near_duplicate_groups": near.select("seed").distinct().count()},
        }


class SpectralDataset(Dataset):
    noun, payload, extensions = "cubes", ["row", "col", "bands"], readers.CUBES + readers.CUBE_DATA
    charted = ["global_mean", "global_std", "snr_mean"]

    @classmethod
    def load(cls, spark: SparkSession, path: str | list[str], wavelengths: Sequence[float] | None = None, **reading) -> SpectralDataset:
        return cls(readers.read_cubes(spark, readers.resolved(path, cls.extensions), **reading).withColumnRenamed("path", "name"), wavelengths=wavelengths)

    @classmethod
    def of(cls, spark: SparkSession, arrays: Sequence[np.ndarray], labels: Sequence[str] | None = None, names: Sequence[str] | None = None, wavelengths: Sequence[float] | None = None) -> SpectralDataset:
        rows = []
        for n, a, lab in zip(cls._names(len(arrays), names), arrays, _labels(len(arrays), labels)):
            if a.ndim != 3:
                rows.append((n, None, None, None, lab, True, f"a cube has three dimensions, not {a.ndim}"))
            else:
                rows += [(n, r, c, a[r, c].astype(float).tolist(), lab, False, None) for r in range(a.shape[0]) for c in range(a.shape[1])]
        return cls(spark.createDataFrame(rows, "name string, row int, col int, bands array<float>, label string, is_corrupt boolean, error string"), wavelengths=wavelengths)

    def _pixels(self) -> DataFrame:
        return self.valid().select(F.col("name").alias(spectral.ID), "row", "col", "bands")

    def _bands(self) -> int:
        return spectral.matching(self._pixels()).select(F.size("bands")).first()[0]

    def measured(self) -> DataFrame:
        return spectral.records(self._pixels(), self._bands(), self.options.get("wavelengths")).withColumnRenamed(spectral.ID, self.key)

    def index(self, i: int, name: str) -> DataFrame:
        """(row, col, value) of a spectral index of one cube."""
        return spectral.index_map(self._pixels().where(F.col(spectral.ID) == self._name(i)), name, self._bands(), self.options.get("wavelengths")).drop(spectral.ID)

    def sections(self) -> dict:
        rec, pixels = self.records(), self._pixels()
        same = spectral.matching(pixels)
        spectrum = spectral.cross_cube_spectrum(pixels).orderBy("band").collect()
        noise = spectral.noise_mad(same).groupBy("band").agg(F.avg("noise_mad").alias("noise")).orderBy("band").collect()
        variance = spectral.pca_variance(pixels)
        ratios = [r[1] for r in variance.groupBy("component").agg(F.avg("ratio"), F.count(F.lit(1)).alias("n")).where(F.col("n") == rec.count()).orderBy("component").collect()]
        return {
            "inventory": {"band_distribution": self._counts(rec, "bands")},
            "spatial": self._stats({m: m for m in ("height", "width", "bands")}),
            "spectral_stats": self._stats({m: m for m in ("global_mean", "global_std", "dynamic_range")})
            | {"cross_cube_mean_spectrum": [r["mean"] for r in spectrum], "cross_cube_std_spectrum": [r["std"] for r in spectrum], "dataset_mean_snr_per_band": [r["snr"] for r in spectrum], "dataset_mean_noise_per_band": [r["noise"] for r in noise], "dominant_band_count": len(spectrum), "n_matching_cubes": same.select(spectral.ID).distinct().count()},
            "spectral_quality": self._stats({m: m for m in ("snr_mean", "spectral_smoothness", "inter_band_corr", "n_dropout_bands")}),
            "spectral_indices": {i: self._stats({"per_cube_mean": f"{i}_mean", "per_cube_std": f"{i}_std"}) for i in spectral.INDICES},
            "texture": self._stats({m: m for m in spectral.TEXTURE}),
            "pca": {"mean_variance_ratio": ratios, "n_components_95pct_mean": int(np.searchsorted(np.cumsum(ratios), 0.95) + 1)},
        }


class CloudDataset(Dataset):
    noun, payload, extensions = "clouds", ["x", "y", "z", "attrs"], readers.CLOUDS
    charted = ["n_points", "density", "height_mean"]

    @classmethod
    def load(cls, spark: SparkSession, path: str | list[str], **reading) -> CloudDataset:
        return cls(readers.read_clouds(spark, readers.resolved(path, cls.extensions), **reading).withColumnRenamed("path", "name"))

    @classmethod
    def of(cls, spark: SparkSession, arrays: Sequence[np.ndarray], labels: Sequence[str] | None = None, names: Sequence[str] | None = None) -> CloudDataset:
        rows = []
        for n, a, lab in zip(cls._names(len(arrays), names), arrays, _labels(len(arrays), labels)):
            if a.ndim != 2 or a.shape[1] < 3 or not np.isfinite(a[:, :3]).all(axis=1).any():
                rows.append((n, None, None, None, None, None, lab, True, "a cloud has rows of three numbers or more, one of them finite"))
            else:
                rows += [(n, i, *map(float, p[:3]), [float(v) for v in p[3:]], lab, False, None) for i, p in enumerate(a)]
        return cls(spark.createDataFrame(rows, "name string, point_idx long, x double, y double, z double, attrs array<float>, label string, is_corrupt boolean, error string"))

    def measured(self) -> DataFrame:
        extra = {"intensity": 0, "r": 1, "g": 2, "b": 3}
        p = self.valid().select(F.col("name").alias(cloud.ID), "x", "y", "z", *[F.get("attrs", F.lit(i)).cast("double").alias(c) for c, i in extra.items()])
        return cloud.records(p).join(cloud.dimensions(p), cloud.ID).withColumnRenamed(cloud.ID, self.key)

    def cloud(self, i: int) -> np.ndarray:
        return np.array([[r["x"], r["y"], r["z"], *(r["attrs"] or [])] for r in self.data(i).collect()])

    def sections(self) -> dict:
        rec = self.records()
        flags = {r["flag"]: r["count"] for r in stats.rates(rec, ["has_color", "has_intensity"]).collect()}
        vectors = {"bbox_size": [f"span_{c}" for c in "xyz"], "xyz_mean": [f"{c}_mean" for c in "xyz"], "xyz_std": [f"{c}_std" for c in "xyz"], "rgb_mean": [f"{c}_mean" for c in "rgb"], "rgb_std": [f"{c}_std" for c in "rgb"]}
        means = stats.vector_means(rec, vectors).orderBy("vector", "component").collect()
        of = lambda v: [r["mean"] for r in means if r["vector"] == v]
        return {
            "inventory": self._stats({"point_count": "n_points", "dimension_count": "n_dims"}) | {f"{k}_count": n for k, n in flags.items()},
            "geometry": self._stats({m: m for m in ("bbox_volume", "density", "span_x", "span_y", "span_z")}) | {"bbox_size_mean": of("bbox_size"), "xyz_mean_mean": of("xyz_mean"), "xyz_std_mean": of("xyz_std")},
            "height": self._stats({"height_min": "z_min", "height_max": "z_max", "height_mean": "height_mean", "height_std": "height_std"}),
            "quality": self._stats({m: m for m in ("finite_fraction", "duplicate_fraction", "outlier_fraction", "nearest_neighbor_mean", "nearest_neighbor_median", "nearest_neighbor_std")}),
            "shape_descriptors": self._stats({m: m for m in ("linearity", "planarity", "scattering", "curvature")}),
            "attributes": self._stats({m: m for m in ("intensity_mean", "intensity_std")}) | {"rgb_mean_mean": of("rgb_mean"), "rgb_std_mean": of("rgb_std")},
        }


class VideoDataset(Dataset):
    noun, payload, extensions = "videos", ["frame_idx", "height", "width", "data"], readers.VIDEOS
    charted = ["brightness_mean", "motion_intensity_mean", "sharpness_mean"]

    @classmethod
    def load(cls, spark: SparkSession, path: str | list[str], blur: float = 80.0, motion_blur: float = 80.0, scene: float = 35.0, **reading) -> VideoDataset:
        return cls(readers.read_videos(spark, readers.resolved(path, cls.extensions), **reading).withColumnRenamed("path", "name"), blur=blur, motion_blur=motion_blur, scene=scene)

    @classmethod
    def of(cls, spark: SparkSession, arrays: Sequence[np.ndarray], labels: Sequence[str] | None = None, names: Sequence[str] | None = None, fps: float | Sequence[float] = 30.0, **options) -> VideoDataset:
        rates = list(fps) if isinstance(fps, Sequence) else [fps] * len(arrays)
        rows = []
        for n, a, lab, rate in zip(cls._names(len(arrays), names), arrays, _labels(len(arrays), labels), rates):
            if a.ndim not in (3, 4) or not len(a):
                rows.append((n, None, None, None, None, None, lab, True, "a clip has three or four axes, and a frame"))
            else:
                rows += [(n, i, f.shape[0], f.shape[1], float(rate), K.to_rgb(f).tobytes(), lab, False, None) for i, f in enumerate(a)]
        return cls(spark.createDataFrame(rows, "name string, frame_idx long, height int, width int, fps double, data binary, label string, is_corrupt boolean, error string"), **options)

    def _frames(self) -> DataFrame:
        return self.valid().withColumnRenamed("name", video.ID)

    def measured(self) -> DataFrame:
        f = self._frames()
        w, h = F.max("width"), F.max("height")
        shape = f.groupBy(video.ID).agg((F.max("frame_idx") + 1).alias("n_frames"), F.max("fps").alias("fps"), h.alias("height"), w.alias("width"), (w / h).alias("aspect_ratio"), (w * h / 1e6).alias("megapixels"))
        each = video.whole_frame_stats(f)
        rec = shape.withColumn("duration_sec", F.col("n_frames") / F.col("fps")).join(video.motion_summary(each, **self.options), video.ID).join(video.colour(each), video.ID)
        return rec.withColumnRenamed(video.ID, self.key)

    def frames(self, i: int, n: int | None = None) -> np.ndarray:
        """Frames of one clip, all of them or n evenly spread ones."""
        f = self._frames().where(F.col(video.ID) == self._name(i))
        rows = (f if n is None else video.sample_frames(f, n)).orderBy("frame_idx").collect()
        return np.stack([np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3) for r in rows])

    def sections(self) -> dict:
        means = stats.vector_means(self.records(), {"mean": ["mean_r", "mean_g", "mean_b"], "std": ["std_r", "std_g", "std_b"]}).orderBy("vector", "component").collect()
        of = lambda v: [round(r["mean"], 6) for r in means if r["vector"] == v]
        return {
            "spatial": self._stats({m: m for m in ("height", "width", "aspect_ratio", "megapixels")}),
            "temporal": self._stats({"frame_count": "n_frames", "sampled_frames": "sampled_frames", "fps": "fps", "duration_sec": "duration_sec", "temporal_brightness_std": "brightness_std", "temporal_contrast_std": "contrast_std"}),
            "quality": self._stats({m: m for m in ("brightness_mean", "brightness_std", "contrast_mean", "sharpness_mean", "sharpness_min", "blur_fraction")}),
            "motion": self._stats({"frame_diff_mean": "motion_intensity_mean", "motion_intensity_mean": "motion_intensity_mean", "motion_blur_fraction": "motion_blur_fraction", "scene_change_count": "scene_change_count", "scene_change_rate": "scene_change_rate"}),
            "colour": {"rgb_mean_mean": of("mean"), "rgb_std_mean": of("std")},
        }


KINDS: dict[str, type[Dataset]] = {"text": TextDataset, "image": ImageDataset, "hyper": SpectralDataset, "cloud": CloudDataset, "video": VideoDataset}
