"""Sources and sinks of page artifacts: images, tokens, components, colours and crops as JSON, byte windows, and the export of results."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x0:int,y0:int,x1:int,y1:int>"
#: Artifacts that a byte window may be read from.
ARTIFACTS = ("page.json", "page.md", "graph.json", "layout.json", "dom.md", "dom.json", "manifest.json")


def bbox(column: str) -> Column:
    """A box from JSON text, as an object or as an array of exactly four numbers."""
    return F.expr(f"coalesce(case when size(from_json({column}, 'array<int>')) = 4 then named_struct('x0', from_json({column}, 'array<int>')[0], 'y0', from_json({column}, 'array<int>')[1], 'x1', from_json({column}, 'array<int>')[2], 'y1', from_json({column}, 'array<int>')[3]) end, from_json({column}, '{BOX}'))")


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, bytes and format (by magic bytes) of image files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    start = F.hex(F.substring("content", 1, 3))
    kind = F.when(start.startswith("FFD8") & (F.length("content") > 3), "jpeg").when((F.hex(F.substring("content", 1, 4)) == "89504E47") & (F.length("content") > 4), "png").otherwise("unknown")
    return raw.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), kind.alias("format"))


def image_size(content: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG or JPEG file; None for anything else and for files that end too early."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 9 <= len(content) and content[at] == 0xFF:
        kind, length = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame header
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 1 if kind == 0xFF else 2 + length
    return None


def dataset_profile(spark: SparkSession, path: str, side: int = 1280, overlap: float = 0.2) -> DataFrame:
    """File, size, first 12 digits of the sha256 and number of fixed crops of each image of a folder; files that cannot be read have an error. Only headers leave the JVM."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}").load(path)
    heads = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.substring(F.sha2("content", 256), 1, 12).alias("sha256"), F.substring("content", 1, 1 << 20).alias("head"))

    def sized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [image_size(bytes(h)) for h in rows["head"]]
            yield pd.DataFrame({"file": rows["file"], "sha256": rows["sha256"], "width": [f and f[0] for f in found], "height": [f and f[1] for f in found]}, dtype=object)

    step = max(1, int(side * (1 - overlap)))
    sizes = heads.mapInPandas(sized, "file string, sha256 string, width long, height long")
    return sizes.withColumn("regions", F.expr(f"((width - 1) div {step} + 1) * ((height - 1) div {step} + 1)")).withColumn("error", F.when(F.col("width").isNull(), "not an image"))


def scan_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of recognisers that write JSON arrays of text, bbox and confidence; malformed files are skipped."""
    rows = spark.read.option("mode", "DROPMALFORMED").option("multiLine", "true").schema("text string, bbox array<int>, confidence double").json(path)
    return rows.where("size(bbox) = 4").select("text", *[F.col("bbox")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))], "confidence")


def scan_components(spark: SparkSession, path: str) -> DataFrame:
    """Components of page.json files, in the order of each file."""
    value = "struct<value:string,source:string,confidence:double>"
    item = f"struct<id:string,type:{value},text:{value},bbox:string,tier:string,weight:string,confidence:double>"
    rows = spark.read.option("multiLine", "true").option("mode", "DROPMALFORMED").schema(f"components array<{item}>").json(path)
    parts = rows.select(F.input_file_name().alias("page"), F.posexplode("components").alias("ord", "c"))
    return parts.select("page", "ord", "c.id", F.col("c.type.value").alias("type"), F.col("c.text.value").alias("text"), bbox("c.bbox").alias("bbox"), "c.tier", "c.weight", "c.confidence")


def scan_colors(spark: SparkSession, path: str) -> DataFrame:
    """Measured colours of colors.json files, in the order of each file: hex value, channels and box; what is missing is 0."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page"), F.from_json("value", f"array<struct<value:string,rgb:array<double>,bbox_global:{BOX}>>").alias("found"))
    parts = rows.where("found is not null").select("page", F.posexplode("found").alias("ord", "c"))
    channels = [F.when(F.size("c.rgb") == 3, F.col("c.rgb")[k].cast("int")).otherwise(0).alias(c) for k, c in enumerate("rgb")]
    return parts.select("page", "ord", F.coalesce("c.value", F.lit("")).alias("hex"), *channels, *[F.coalesce(F.col(f"c.bbox_global.{c}"), F.lit(0)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def scan_crops(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the crop files in a folder's crops, by file name; files that are no JSON objects are skipped."""
    item = f"struct<id:string,type:string,bbox_global:{BOX},confidence:double>"
    rows = spark.read.option("pathGlobFilter", "*.json").text(f"{folder}/crops", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("crop"), F.from_json("value", f"struct<components:array<{item}>>").alias("v"))
    parts = rows.where("v.components is not null").select("crop", F.posexplode("v.components").alias("ord", "c"))
    return parts.select("crop", "ord", "c.id", "c.type", *[F.col(f"c.bbox_global.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")], "c.confidence", F.lit("crop-vision").alias("source"))


def source_image(spark: SparkSession, folder: str) -> str:
    """The image that a folder's manifest names: as it stands, else under the folder, else beside it; names that go up are refused."""
    names = [r["image"] for r in spark.read.schema("image string").json(f"{folder}/manifest.json", multiLine=True).collect()]  # one file of one object
    if len(names) != 1 or not names[0]:
        raise ValueError("manifest.json has no image field")
    if ".." in names[0].replace("\\", "/").split("/"):
        raise ValueError('the manifest\'s image holds ".."')
    jvm = spark._jvm
    tries = [names[0]] if names[0].startswith("/") else [names[0], f"{folder}/{names[0]}", f"{PurePosixPath(folder).parent}/{names[0]}"]
    for name in tries:
        path = jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path) and not system.getFileStatus(path).isDirectory():
            return name
    raise ValueError(f"no source image {names[0]}")


def artifact_window(spark: SparkSession, folder: str, name: str, offset: int = 0, max_bytes: int = 12000) -> DataFrame:
    """Bytes offset .. offset + max_bytes of an artifact, its size, and whether more follow."""
    if name not in ARTIFACTS or ".." in PurePosixPath(folder).parts:
        raise ValueError(f"no such artifact: {name}")
    raw = spark.read.format("binaryFile").load(f"{folder}/{name}")
    return raw.select(F.expr(f"decode(substring(content, {max(0, offset) + 1}, {max_bytes}), 'UTF-8')").alias("text"), F.col("length").alias("total_bytes"), (F.col("length") > max(0, offset) + max_bytes).alias("truncated"))


def export_pages(df: DataFrame, path: str) -> None:
    """JSON, partitioned by page."""
    df.write.mode("errorifexists").partitionBy("page_id").json(path)
