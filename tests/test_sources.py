"""Readers of images, settings and page artifacts, and the result cache."""

import json
import struct

import pytest

from screenrel.functions import settings
from screenrel.sources import files

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 1500, 900) + b"\x08\x02\x00\x00\x00"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 40, 60) + b"\x01\x01\x11\x00"


def test_sizes():
    assert files.image_size(PNG) == (1500, 900) and files.image_size(JPEG) == (60, 40)
    assert files.image_size(b"") is None and files.image_size(JPEG[:12]) is None and files.image_size(b"GIF89a") is None


def test_dataset(spark, tmp_path):
    for name, content in (("a.png", PNG), ("b.JPG", JPEG), ("c.png", b"no"), ("d.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    got = {r["file"]: (r["width"], r["height"], r["regions"], r["error"]) for r in files.dataset_profile(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (1500, 900, 2, None), "b.JPG": (60, 40, 1, None), "c.png": (None, None, None, "not an image")}


def test_settings(tmp_path):
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"cache": {"database": "/x"}, "image": {"grid_rows": 3, "other": 1}}))
    got = settings.load(str(path))
    assert (got.cache.dir, got.cache.enabled, got.image.grid_rows, got.image.grid_cols) == ("/x", True, 3, 2)
    assert settings.load("/no/such/file") == settings.Settings() and settings.chosen(None, "", 4) == 4


def test_colors_crops_and_manifest(spark, tmp_path):
    (tmp_path / "evidence").mkdir()
    (tmp_path / "evidence" / "colors.json").write_text('[{"value":"#FF0000","rgb":[255,0,0],"bbox_global":{"x0":1,"y0":2,"x1":3,"y1":4}},{"rgb":[1,2]}]')
    got = files.scan_colors(spark, str(tmp_path / "evidence" / "colors.json")).orderBy("ord").collect()
    assert [tuple(r)[2:] for r in got] == [("#FF0000", 255, 0, 0, 1, 2, 3, 4), ("", 0, 0, 0, 0, 0, 0, 0)]
    (tmp_path / "crops").mkdir()
    (tmp_path / "crops" / "a.json").write_text('{"components":[{"id":"x","type":"icon","bbox_global":{"x0":0,"y0":0,"x1":9,"y1":9},"confidence":0.5}]}')
    (tmp_path / "crops" / "b.json").write_text("broken")
    (tmp_path / "crops" / "c.txt").write_text("{}")
    assert [(r.crop, r.id, r.type, r.x1) for r in files.scan_crops(spark, str(tmp_path)).collect()] == [("a.json", "x", "icon", 9)]
    (tmp_path / "shot.png").write_bytes(b"x")
    (tmp_path / "manifest.json").write_text('{"image":"shot.png"}')
    assert files.source_image(spark, str(tmp_path)) == f"{tmp_path}/shot.png"
    for bad in ('{"image":"../shot.png"}', '{"image":"none.png"}', "{}"):
        (tmp_path / "manifest.json").write_text(bad)
        with pytest.raises(ValueError):
            files.source_image(spark, str(tmp_path))


def test_result_cache(spark, tmp_path):
    from pyspark.sql import functions as F

    from screenrel.sources.cache import ResultCache, key_of

    store = ResultCache(spark, str(tmp_path / "cache"))
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, value string").withColumn("key", key_of(F.col("name"), F.lit("v1")))
    assert store.status()["entries"] == 0
    store.put(rows)
    store.put(rows.where("name = 'a'").withColumn("value", F.lit("3")))
    wanted = rows.select("key").union(spark.createDataFrame([("zz",)], "key string"))
    assert sorted(r.value or "" for r in store.get(wanted).collect()) == ["", "2", "3"]
    assert sorted(r.present for r in store.has(wanted).collect()) == [False, True, True] and store.status()["entries"] == 2
    store.clear()
    assert store.status()["entries"] == 0 and not ResultCache(spark, str(tmp_path / "cache"), enabled=False).has(wanted).where("present").count()


def test_tokens_and_export(spark, tmp_path):
    (tmp_path / "ocr.json").write_text('[{"text":"a","bbox":[1,2,3,4],"confidence":0.5},{"text":"b","bbox":[1,2]}]')
    assert [tuple(r) for r in files.scan_tokens(spark, str(tmp_path / "ocr.json")).collect()] == [("a", 1, 2, 3, 4, 0.5)]
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "page_id long, id string")
    files.export_pages(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "out")).select("page_id", "id").collect())) == [(1, "x"), (2, "y")]
