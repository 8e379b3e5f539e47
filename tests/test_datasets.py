"""Data sets of each modality: loading, records, summaries, single items, the command line."""

from __future__ import annotations

import json

import numpy as np
import pytest

from modaleda import datasets
from modaleda.__main__ import main
from modaleda.core import stats
from modaleda.functions import image as K
from modaleda.operators import spectral, video


def rng():
    return np.random.default_rng(11)


def test_texts(spark):
    d = datasets.TextDataset.of(spark, ["One two two. Three!", "a rather short text", "One two two. Three!", None, ""], labels=["a", "b", "a", "b", "a"])
    s = d.summary()
    assert (s["inventory"]["total_documents"], s["inventory"]["valid_documents"], s["inventory"]["corrupt_documents"]) == (5, 4, 1)
    assert s["inventory"]["corrupt_paths"] == ["<document_000003>"] and s["inventory"]["label_distribution"] == {"a": 3, "b": 1}
    assert s["labels"]["class_imbalance_ratio"] == 3.0 and s["lexical"]["dataset_total_tokens"] == 12
    assert s["lexical"]["top_words"][0] == ("two", 4) and ("two two", 2) in s["lexical"]["top_bigrams"]
    assert s["quality"]["exact_duplicate_groups"] == [["<document_000000>", "<document_000002>"]] and s["quality"]["empty_documents"] == 1
    assert s["length"]["words"]["max"] == 4.0 and d.summary() is s
    assert d.record(1)["word_count"] == 4 and d.text(1) == "a rather short text"
    assert d.only("b").items().count() == 2 and [r[0] for r in d.first(2).items().orderBy("item").select("name").collect()] == ["<document_000000>", "<document_000001>"]
    with pytest.raises(IndexError):
        d.record(9)
    with pytest.raises(datasets.DatasetError):
        datasets.TextDataset().summary()
    assert datasets.TextDataset.of(spark, [None]).summary()["error"]


def test_texts_of_a_folder_and_the_command_line(spark, tmp_path, tmp_path_factory, capsys):
    for label, name, t in (("x", "a.txt", "first file here"), ("y", "b.md", "second file")):
        (tmp_path / label).mkdir()
        (tmp_path / label / name).write_text(t)
    report = tmp_path_factory.mktemp("report") / "out.html"
    out = json.loads(main(["text", str(tmp_path), "--label-from-parent", "--report", str(report)], spark))
    assert out["inventory"]["label_distribution"] == {"x": 1, "y": 1} and out["inventory"]["format_distribution"] == {".txt": 1, ".md": 1}
    assert json.loads(capsys.readouterr().out) == out and "<svg" in report.read_text()
    one = json.loads(main(["text", str(tmp_path), "--label-from-parent", "--item", "1"], spark))
    assert one["label"] == "y" and one["word_count"] == 2
    with pytest.raises(ValueError, match="no reader"):
        datasets.TextDataset.load(spark, str(tmp_path / "x" / "a.exe"))


def test_images(spark):
    r = rng()
    arrays = [r.integers(0, 256, (20, 30, 3), dtype=np.uint8) for _ in range(3)] + [np.full((16, 16), 0.5), np.zeros(3)]
    arrays.insert(1, arrays[0])
    d = datasets.ImageDataset.of(spark, arrays, labels=list("aabbab"))
    s = d.summary()
    assert (s["inventory"]["valid_images"], s["inventory"]["corrupt_images"]) == (5, 1)
    assert s["spatial"]["orientation_distribution"] == {"landscape": 4, "square": 1} and s["duplicates"]["n_exact_duplicate_groups"] == 1
    want = np.mean([K.to_rgb(a).reshape(-1, 3).mean(axis=0) for a in arrays[:-1]], axis=0)
    assert s["pixel_stats"]["dataset_mean_rgb"] == pytest.approx(want.tolist())
    assert 0 <= s["quality"]["brightness"]["min"] <= s["quality"]["brightness"]["max"] <= 255 and s["colour"]["grayscale_like_count"] == 1
    assert (d.image(2) == arrays[2]).all()
    avg = {(p.y, p.x): p for p in d.average(8, 8, label="a").collect()}
    small = np.stack([np.stack([K.linear_resize(K.to_rgb(arrays[i])[..., c].astype(float), 8, 8) for c in range(3)], axis=2) for i in (0, 1, 4)])
    assert avg[3, 5].mean_g == pytest.approx(small.mean(axis=0)[3, 5, 1]) and avg[3, 5].std_b == pytest.approx(small.std(axis=0)[3, 5, 2], abs=1e-6)


def test_cubes(spark):
    r = rng()
    arrays = [r.random((6, 5, 8)) for _ in range(3)] + [r.random((4, 4, 12)), np.zeros(4)]
    d = datasets.SpectralDataset.of(spark, arrays, labels=list("aabbb"))
    s = d.summary()
    assert s["inventory"]["band_distribution"] == {"8": 3, "12": 1} and s["inventory"]["corrupt_cubes"] == 1
    assert s["spectral_stats"]["dominant_band_count"] == 8 and s["spectral_stats"]["n_matching_cubes"] == 3
    assert s["spectral_stats"]["cross_cube_mean_spectrum"] == pytest.approx(np.mean([a.reshape(-1, 8).mean(axis=0) for a in arrays[:3]], axis=0).tolist(), abs=1e-6)
    assert set(s["spectral_indices"]) == set(spectral.INDICES) and 0 < s["pca"]["n_components_95pct_mean"] <= 8
    assert d.index(0, "ndvi").count() == 30
    pixels = d._pixels().where("cube_id = '<cube_000000>'")
    got = spectral.texture(pixels).first()
    x = arrays[0].astype(np.float32).astype(float).reshape(-1, 8)
    v = np.linalg.eigh(np.cov(x.T, ddof=0))[1][:, -1]
    v *= np.sign(v[np.abs(v).argmax()])
    want = K.texture_of(((x - x.mean(axis=0)) @ v).reshape(6, 5))
    assert all(got[k] == pytest.approx(w, rel=1e-3) for k, w in want.items())
    g = {p.band: p.gradient for p in spectral.gradient(pixels).collect()}
    m = x.mean(axis=0)
    assert [g[i] for i in range(8)] == pytest.approx(np.abs(np.diff(m, prepend=m[0])).tolist())


def test_clouds(spark):
    r = rng()
    arrays = [r.normal(size=(60, 3)), r.random((50, 7)), np.full((2, 3), np.nan), r.random((40, 4))]
    d = datasets.CloudDataset.of(spark, arrays)
    s = d.summary()
    assert (s["inventory"]["valid_clouds"], s["inventory"]["corrupt_clouds"], s["inventory"]["has_color_count"], s["inventory"]["has_intensity_count"]) == (3, 1, 1, 2)
    assert s["geometry"]["xyz_mean_mean"] == pytest.approx(np.mean([arrays[i][:, :3].mean(axis=0) for i in (0, 1, 3)], axis=0).tolist())
    assert s["inventory"]["point_count"]["max"] == 60 and d.cloud(3).shape == (40, 4) and d.summary()["labels"]["label_distribution"] is None
    e = np.clip(np.linalg.eigvalsh(np.cov(arrays[0].T))[::-1], 0, None)
    assert d.record(0)["linearity"] == pytest.approx((e[0] - e[1]) / e[0]) and d.record(0)["scattering"] == pytest.approx(e[2] / e[0])


def test_videos(spark, tmp_path):
    r = rng()
    clips = [r.integers(0, 256, (7, 12, 16, 3), dtype=np.uint8), np.stack([np.full((12, 16, 3), 250 * (i > 2), dtype=np.uint8) for i in range(6)]), np.zeros(3)]
    d = datasets.VideoDataset.of(spark, clips, labels=["a", "b", "b"], fps=12)
    s = d.summary()
    assert (s["inventory"]["valid_videos"], s["inventory"]["corrupt_videos"]) == (2, 1)
    u = [c.reshape(-1, 3) / 255 for c in clips[:2]]
    assert s["colour"]["rgb_mean_mean"] == pytest.approx(np.mean([x.mean(axis=0) for x in u], axis=0).tolist(), abs=1e-6)
    assert s["colour"]["rgb_std_mean"] == pytest.approx(np.mean([x.std(axis=0) for x in u], axis=0).tolist(), abs=1e-6)
    one = d.record(1)
    assert (one["n_frames"], one["scene_change_count"], one["duration_sec"]) == (6, 1, 0.5)
    assert (d.frames(0) == clips[0]).all() and (d.frames(0, 3) == clips[0][[0, 3, 6]]).all()
    gray = np.rint(K.gray(clips[0]))
    got = {f.frame_idx: f for f in video.whole_frame_stats(d._frames().where("video_id = '<video_000000>'")).collect()}
    assert got[0].diff is None and got[4].diff == pytest.approx(np.abs(gray[4] - gray[3]).mean()) and got[2].sharpness == pytest.approx(K.laplacian_variance(gray[2]))
    np.save(tmp_path / "c.npy", clips[0])
    (tmp_path / "d.mp4").write_bytes(b"no video")
    loaded = datasets.VideoDataset.load(spark, str(tmp_path), every=2, most=3)
    inv = loaded.summary()["inventory"]
    assert (inv["valid_videos"], inv["corrupt_videos"]) == (1, 1) and len(loaded.frames(0)) == 3


def test_clipping_and_rates(spark):
    df = spark.createDataFrame([(float(i), i % 3 == 0) for i in range(101)] + [(None, None)], "v double, f boolean")
    got = {r.v: r.c for r in stats.percentile_clip(df, "v", "c", 10, 90).collect()}
    assert got[None] is None and got[0.0] == 0 and got[50.0] == pytest.approx(0.5) and got[100.0] == 1
    assert [tuple(r) for r in stats.rates(df, ["f"]).collect()] == [("f", 34, 34 / 102)]
    assert stats.percentile_clip(df.where("v = 3"), "v", "c").first().c == 0
