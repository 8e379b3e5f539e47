from __future__ import annotations

import json

import numpy as np
import pytest

from modaleda.functions import image
from modaleda.sources import formats, readers, report
from modaleda.streaming.documents import document_records


@pytest.fixture()
def folder(tmp_path):
    for d in ("cats", "dogs/deep"):
        (tmp_path / d).mkdir(parents=True)
    return tmp_path


def test_documents_of_every_format(spark, folder):
    (folder / "cats/a.TXT").write_bytes("naïve\r\ntext".encode("cp1252"))
    (folder / "cats/b.html").write_text("<p>One &amp; two<script>no</script></p>")
    (folder / "cats/c.csv").write_text("id,Text,label\n1,first,x\n2,second,\n")
    (folder / "dogs/d.json").write_text(json.dumps({"items": [{"text": "j1", "label": 3}, {"text": None}, {"text": "j2"}]}))
    (folder / "dogs/deep/e.jsonl").write_text('{"text": "l1"}\n\n{"text": "l2", "label": "y"}\n')
    (folder / "dogs/f.json").write_text("{not json")
    (folder / "dogs/skip.bin").write_bytes(b"x")
    (folder / "dogs/empty.csv").write_text("")
    rows = readers.read_documents(spark, str(folder), labels={str(folder / "dogs/deep/e.jsonl"): "given"}, label_from_parent=True).collect()
    got = {(r.path.rsplit("/", 1)[1], r.source_index): (r.text, r.label) for r in rows if not r.is_corrupt}
    assert got["a.TXT", 0] == ("naïve\ntext", "cats")
    assert got["b.html", 0] == ("One & two", "cats")
    assert got["c.csv", 0] == ("first", "x") and got["c.csv", 1] == ("second", "cats")
    assert got["d.json", 0] == ("j1", "3") and got["d.json", 2] == ("j2", "dogs") and ("d.json", 1) not in got
    assert {v for k, v in got.items() if k[0] == "e.jsonl"} == {("l1", "given"), ("l2", "y")}
    bad = [r for r in rows if r.is_corrupt]
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["f.json"] and "JSONDecodeError" in bad[0].error


def test_missing_folder_is_an_error(spark, folder):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_documents(spark, str(folder / "nowhere")).collect()


def test_clouds(spark, folder):
    points = np.random.default_rng(3).random((250, 4))
    np.save(folder / "cats/a.npy", points)
    np.savez(folder / "cats/b.npz", p=points[:5, :3])
    (folder / "dogs/c.xyz").write_text("# points\n1 2 3\n4 5 6\n")
    (folder / "dogs/d.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float z\nproperty float x\nproperty float y\nend_header\n3 1 2\n6 4 5\n")
    (folder / "dogs/e.ply").write_text("ply\nformat binary_little_endian 1.0\nend_header\n")
    rows = readers.read_clouds(spark, str(folder), label_from_parent=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert len(by["a.npy"]) == 250 and len(by["a.npy"][0].attrs) == 1 and len(by["b.npz"]) == 5
    for name in ("c.xyz", "d.ply"):
        assert sorted((r.x, r.y, r.z) for r in by[name]) == [(1, 2, 3), (4, 5, 6)] and by[name][0].label == "dogs"
    assert by["e.ply"][0].is_corrupt


@pytest.mark.parametrize("layout", ["bsq", "bil", "bip"])
def test_cubes(spark, folder, layout):
    cube = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    np.save(folder / "cats/a.npy", cube)
    (folder / "cats/b.hdr").write_text(f"ENVI\nsamples = 3\nlines = 2\nbands = 4\ndata type = 4\ninterleave = {layout}\nbyte order = 0\n")
    (folder / "cats/b.img").write_bytes({"bip": cube, "bil": cube.transpose(0, 2, 1), "bsq": cube.transpose(2, 0, 1)}[layout].tobytes())
    (folder / "dogs/c.hdr").write_text("ENVI\n")
    rows = readers.read_cubes(spark, str(folder)).collect()
    for name in ("a.npy", "b.hdr"):
        got = {(r.row, r.col): r.bands for r in rows if r.path.endswith(name)}
        assert got == {(i, j): cube[i, j].tolist() for i in range(2) for j in range(3)}
    assert [r.is_corrupt for r in rows if r.path.endswith("c.hdr")] == [True]


def test_images(spark, folder):
    def bmp(rgb):  # a 24-bit BMP of one row
        body = bytes(b for r, g, bl in rgb for b in (bl, g, r))
        body += b"\0" * (-len(body) % 4)
        head = (54 + len(body)).to_bytes(4, "little") + b"\0" * 4 + (54).to_bytes(4, "little")
        info = (40).to_bytes(4, "little") + len(rgb).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"\1\0\x18\0" + b"\0" * 4 + len(body).to_bytes(4, "little") + b"\0" * 16
        return b"BM" + head + info + body

    (folder / "cats/a.bmp").write_bytes(bmp([(255, 0, 1), (10, 20, 30)]))
    (folder / "dogs/b.png").write_bytes(b"not an image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in readers.read_images(spark, str(folder), label_from_parent=True).collect()}
    assert (rows["a.bmp"].height, rows["a.bmp"].width, bytes(rows["a.bmp"].data), rows["a.bmp"].label) == (1, 2, bytes([255, 0, 1, 10, 20, 30]), "cats")
    assert rows["b.png"].is_corrupt and rows["b.png"].data is None


def test_decoding_and_fields():
    assert formats.decode("é".encode("utf-16"))[0].endswith("é")
    assert formats.pick_field(["ID", "Text"], None, formats.TEXT_FIELDS) == "Text"
    with pytest.raises(KeyError):
        formats.pick_field(["a"], "b", formats.TEXT_FIELDS)


def test_constant_image():
    g = image.gray(np.full((32, 32, 3), 77, np.uint8))
    assert image.laplacian_variance(g) == 0 and image.noise(g) == 0 and image.entropy(g) == 0 and image.blockiness(g) == 0


def test_report(spark):
    df = spark.createDataFrame([("a<b", 2), ("c", 1)], "name string, n long")
    page = report.html_report("T & t", {"Counts": df, "More": df.select("n")}, rows=1)
    assert "T &amp; t" in page and "<svg" in page and "a&lt;b" in page and "The first 1 rows." in page


def test_stream_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One two. Three four five."), (2, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    records = document_records(spark, str(tmp_path / "in"), "doc_id long, text string")
    q = records.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.doc_id for r in spark.table("arrived").collect()} == {1, 2}
