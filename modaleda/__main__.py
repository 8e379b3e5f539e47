"""python -m modaleda {text,image,hyper,cloud,video} PATH: the summary of a data set as JSON, and an HTML report."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession

from .core.ship import ship
from .datasets import KINDS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="modaleda", description="Summaries of text, image, spectral, point-cloud and video data sets")
    sub = p.add_subparsers(dest="kind", required=True)
    for kind in KINDS:
        s = sub.add_parser(kind)
        s.add_argument("path", nargs="+")
        s.add_argument("--max", type=int, help="the first so many items by name")
        s.add_argument("--label", help="items of this label alone")
        s.add_argument("--label-from-parent", action="store_true")
        s.add_argument("--report", help="where to write an HTML report")
        s.add_argument("--item", type=int, help="the record of one item instead of the summary")
        if kind == "text":
            for o in ("text-field", "label-field", "encoding"):
                s.add_argument(f"--{o}")
            s.add_argument("--preserve-case", action="store_true")
            s.add_argument("--min-token-length", type=int, default=1)
            s.add_argument("--short-words", type=int, default=5)
            s.add_argument("--long-words", type=int, default=1000)
        if kind == "hyper":
            s.add_argument("--wavelengths", help="a .npy file of the bands' wavelengths")
        if kind == "video":
            s.add_argument("--frame-sample-rate", type=int, default=5)
            s.add_argument("--max-frames-per-video", type=int, default=300)
            s.add_argument("--blur-threshold", type=float, default=80.0)
            s.add_argument("--motion-blur-threshold", type=float, default=80.0)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("modaleda").getOrCreate()
    ship(spark)
    options: dict = {"label_from_parent": a.label_from_parent}
    if a.kind == "text":
        options |= {"text_field": a.text_field, "label_field": a.label_field, "encoding": a.encoding, "lowercase": not a.preserve_case, "min_length": a.min_token_length, "short_words": a.short_words, "long_words": a.long_words}
    if a.kind == "hyper" and a.wavelengths:
        options["wavelengths"] = np.load(a.wavelengths).tolist()
    if a.kind == "video":
        options |= {"every": a.frame_sample_rate, "most": a.max_frames_per_video, "blur": a.blur_threshold, "motion_blur": a.motion_blur_threshold}
    data = KINDS[a.kind].load(spark, a.path if len(a.path) > 1 else a.path[0], **options)
    if a.label is not None:
        data = data.only(a.label)
    if a.max is not None:
        data = data.first(a.max)
    if a.report:
        data.write_report(a.report)
    if a.item is not None:
        import json

        out = json.dumps(data.record(a.item), default=str, ensure_ascii=False)
    else:
        out = data.to_json()
    print(out)
    return out


if __name__ == "__main__":
    main()
