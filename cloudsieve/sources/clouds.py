"""Cloud files as long point tables: path, point_idx, x, y, z and, where present, gt or pix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import is_finite_point, nearest_index
from ..operators.preprocess import drop_missing
from .formats import parse_pcd, parse_ply, parse_tiff
from .ranges import RANGE_BYTES, contents, extension, file_ranges, numbered, range_lines, range_points

POINT_SCHEMA = "path string, point_idx long, x float, y float, z float"
BINARY_EXTENSIONS = ("pcd", "ply")


def local_path(path):
    """Path without the scheme that file sources put in front."""
    return F.regexp_replace(path, "^file:/*", "/")


def list_files(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """Listing (path, length) of everything that matches; file contents are not read."""
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    try:
        found = reader.load(paths)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"nothing matches {paths}") from None
        raise
    return found.select(local_path(F.col("path")).alias("path"), "length")


def _decode(files: DataFrame, parse, schema: str) -> DataFrame:
    """One Python call per file; a batch never holds more than a few files."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield parse(path, bytes(content))
    return files.select(local_path(F.col("path")).alias("path"), "content").mapInPandas(run, schema)


def _whole_or_cut(spark: SparkSession, paths, range_bytes: int, whole, cut) -> DataFrame:
    """Files up to ``range_bytes`` read whole by Spark, ``whole`` of their contents; larger ones ``cut`` from a listing of ranges."""
    small = whole(spark.read.format("binaryFile").load(paths).where(F.col("length") <= range_bytes))
    large = list_files(spark, paths).where(F.col("length") > range_bytes)
    return small if large.isEmpty() else small.unionByName(cut(numbered(file_ranges(large, range_bytes))))


def read_pcd(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """PCD and PLY files, in byte ranges where larger than ``range_bytes``. A file without points raises."""
    def parse(path, content):
        x = parse_ply(content) if path.lower().endswith(".ply") else parse_pcd(content)
        if not len(x):
            raise ValueError(f"empty point cloud: {path}")
        return pd.DataFrame({"path": path, "point_idx": np.arange(len(x)), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})
    return _whole_or_cut(spark, paths, range_bytes, lambda files: _decode(files, parse, POINT_SCHEMA), range_points)


def read_organised(spark: SparkSession, paths: str | Sequence[str], keep_missing: bool = False) -> DataFrame:
    """Organised xyz images by path, see :func:`organised`."""
    return organised(spark.read.format("binaryFile").load(paths), keep_missing)


def organised(files: DataFrame, keep_missing: bool = False) -> DataFrame:
    """Organised xyz images from (path, content): every pixel is a row with its flat index and the image size.

    Missing pixels (not finite or all zero) are dropped unless asked for.
    """
    def parse(path, content):
        a = parse_tiff(content).astype(np.float32)
        h, w = a.shape[:2]
        x = a.reshape(h * w, -1)[:, :3]
        return pd.DataFrame({"path": path, "point_idx": np.arange(h * w), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2],
                             "pix": np.arange(h * w), "height": h, "width": w})
    out = _decode(files, parse, f"{POINT_SCHEMA}, pix long, height int, width int")
    return out if keep_missing else drop_missing(out)


def read_text(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Text clouds, comma or whitespace separated by file, '#' comments allowed, in byte ranges where larger than ``range_bytes``.

    A fourth column above 0.5 marks anomalous points; without one gt is 0. A field that is no number raises, and so
    does a row of fewer than three fields.
    """
    def whole(files):
        read = files.select(local_path(F.col("path")).alias("path"), F.col("content").cast("string").alias("value"))
        comma = F.contains(F.element_at(F.split("value", "\n"), 1), F.lit(","))
        return read.select("path", F.posexplode(F.split("value", "\n")).alias("point_idx", "value"), comma.alias("comma")).withColumn(
            "point_idx", F.col("point_idx").cast("long"))
    return _numbers(_whole_or_cut(spark, paths, range_bytes, whole, range_lines))


def _numbers(lines: DataFrame) -> DataFrame:
    """Points of lines (path, point_idx, value, comma)."""
    text = F.trim(F.regexp_replace("value", r"#.*$|\r$", ""))
    lines = lines.withColumn("_line", text).where(F.col("_line") != "")
    parts = F.when(F.col("comma"), F.split("_line", r"\s*,\s*")).otherwise(F.split("_line", r"\s+"))
    cells = lines.select("path", "point_idx", parts.alias("_c"))
    def num(i: int, needed: bool = True):
        cell = F.try_element_at("_c", F.lit(i))
        value = cell.try_cast("float")
        bad = value.isNull() if needed else cell.isNotNull() & value.isNull()
        said = F.concat(F.lit(f"field {i} is no number in "), F.col("path"), F.lit(": "), F.coalesce(cell, F.lit("missing")))
        return F.when(bad, F.raise_error(said).cast("float")).otherwise(value)
    flag = F.coalesce(num(4, needed=False), F.lit(0.0))
    return cells.select("path", "point_idx", num(1).alias("x"), num(2).alias("y"), num(3).alias("z"),
                        (flag > 0.5).cast("float").alias("gt"))


def read_listed(listing: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every file of a listing (path, length) by extension, xyz only: path, point_idx, x, y, z.

    The listing stays a table: tasks open the ranges they are dealt, and no other file. Text and images lose rows that are not finite.
    """
    cols = ["path", "point_idx", "x", "y", "z"]
    cloud, image = extension().isin(*BINARY_EXTENSIONS), extension().isin("tif", "tiff")
    files = listing.select("path", "length")
    points = range_points(numbered(file_ranges(files.where(cloud), range_bytes)))
    text = _numbers(range_lines(numbered(file_ranges(files.where(~cloud & ~image), range_bytes)))).where(is_finite_point("x", "y", "z"))
    return points.select(*cols).unionByName(organised(contents(files.where(image))).select(*cols)).unionByName(text.select(*cols))


def read_any(spark: SparkSession, paths: str | Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Any supported cloud file by extension, see :func:`read_listed`."""
    return read_listed(list_files(spark, paths), range_bytes)


def read_masks(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Non-zero pixels of grayscale (or colour, taken as luma) mask images: path, mask_pix, mask.

    Every image keeps a row with pixel -1 and its size, so that empty masks are known too.
    """
    img = spark.read.format("image").load(paths).select(
        local_path(F.col("image.origin")).alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                a = np.frombuffer(bytes(r.data), dtype=np.uint8).reshape(r.height * r.width, r.nChannels).astype(float)
                luma = a[:, 0] if r.nChannels == 1 else a[:, :3] @ [0.114, 0.587, 0.299]
                luma = np.floor(luma + 0.5).astype(int)
                at = np.nonzero(luma)[0]
                yield pd.DataFrame({"path": r.path, "mask_pix": np.concatenate([[-1], at]),
                                    "mask": np.concatenate([[0], luma[at]]), "mask_h": r.height, "mask_w": r.width})
    return img.mapInPandas(run, "path string, mask_pix long, mask int, mask_h int, mask_w int")


def mask_pixel(pix="pix", height="height", width="width", mask_h="mask_h", mask_w="mask_w"):
    """Pixel of a mask under a scan pixel; a mask of another size is read by nearest neighbour."""
    row, column = F.floor(F.col(pix) / F.col(width)), F.pmod(F.col(pix), F.col(width))
    return nearest_index(row, height, mask_h) * F.col(mask_w) + nearest_index(column, width, mask_w)
