"""Benchmark folder layouts: which files are training and test samples, and what their labels are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import ordered_index
from ..functions.expr import file_stem, on_border
from ..operators.cleanup import clean_scan
from ..session import cut_lineage
from . import clouds as C
from .ranges import contents

# Category lists of the public benchmarks in official order, and the few-shot size.
SHAPENET = (
    "ashtray0", "bag0", "bottle0", "bottle1", "bottle3", "bowl0", "bowl1", "bowl2", "bowl3", "bowl4", "bowl5",
    "bucket0", "bucket1", "cap0", "cap3", "cap4", "cap5", "cup0", "cup1", "eraser0", "headset0", "headset1",
    "helmet0", "helmet1", "helmet2", "helmet3", "jar0", "microphone0", "shelf0", "tap0", "tap1",
    "vase0", "vase1", "vase2", "vase3", "vase4", "vase5", "vase7", "vase8", "vase9")
REAL3D = ("airplane", "candybar", "car", "chicken", "diamond", "duck", "fish", "gemstone", "seahorse", "shell",
          "starfish", "toffees")
MVTEC = ("bagel", "cable_gland", "carrot", "cookie", "dowel", "foam", "peach", "potato", "rope", "tire")
CATEGORIES = {"shapenet": SHAPENET, "real3d": REAL3D, "mvtec": MVTEC}
FEW_SHOT = 4
CUT_LAYOUTS = ("train_cut", "train/good/xyz")
CUT_EXTENSIONS = (".asc", ".txt", ".xyz", ".pcd", ".ply", ".tif", ".tiff")


def get_classes(dataset: str) -> list[str]:
    if dataset not in CATEGORIES:
        raise ValueError(f"unknown dataset '{dataset}' (use {', '.join(CATEGORIES)})")
    return list(CATEGORIES[dataset])


def categories(spark: SparkSession, dataset: str) -> DataFrame:
    """Official order as a small table: dataset, category, ord."""
    rows = [(dataset, c, i) for i, c in enumerate(get_classes(dataset))]
    return spark.createDataFrame(rows, "dataset string, category string, ord int")


def attach_mask(points: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ground truth of organised points from their pixel's mask value; no mask row means normal."""
    hit = points.join(mask, list(keys), "left")
    return hit.withColumn("gt", (F.coalesce(F.col("mask"), F.lit(0)) > 0).cast("float")).drop("mask")


def ranked(listing: DataFrame, category: str = "category", path: str = "path", name: str = "cloud_rank") -> DataFrame:
    """Position of every file in its category's sorted listing, from 1."""
    return ordered_index(listing, [category], [path], name, first=1).withColumn(name, F.col(name).cast("int"))


def take_slice(listing: DataFrame, start: int, n: int, rank: str = "cloud_rank") -> DataFrame:
    """Files start .. start + n of every category's sorted listing."""
    return listing.where((F.col(rank) > start) & (F.col(rank) <= start + n))


def _part(i: int):
    return F.element_at(F.split("path", "/"), i)


def _files(spark, root, classes, sub, depth):
    """Listing of <root>/<category>/<sub> with the category, ``depth`` folders above the file."""
    found = C.list_files(spark, _existing(root, classes, sub))
    return found.withColumn("category", _part(-1 - depth))


def _require(listing: DataFrame, classes: Sequence[str], what: str) -> None:
    have = {r["category"] for r in listing.select("category").distinct().collect()}
    lost = [c for c in classes if c not in have]
    if lost:
        raise FileNotFoundError(f"no {what} for {lost}")


def _require_partner(wanted: DataFrame, there: DataFrame, keys: Sequence[str], what: str) -> None:
    """Raise if a listed sample has no file of ground truth: it would be lost, or pass as normal."""
    lost = [r["path"] for r in wanted.join(there.select(*keys).distinct(), list(keys), "left_anti").limit(20).collect()]
    if lost:
        raise FileNotFoundError(f"no {what} for {lost}")


def _existing(root: str, classes: Sequence[str], sub: str) -> str:
    """One glob for all categories, so that a category without files is found missing, not unreadable."""
    return f"{root}/{{{','.join(classes)}}}/{sub}"


def load_train(spark: SparkSession, root: str, dataset: str, classes: Sequence[str] | None = None, n: int = 0) -> DataFrame:
    """Normal prototypes: category, cloud_id, path, cloud_rank, point_idx, x, y, z.

    The organised benchmark has hundreds of training goods: its first four (or ``n``) are used.
    """
    classes = list(classes or get_classes(dataset))
    if dataset == "mvtec":
        return load_train_slice(spark, root, classes, 0, n if n > 0 else FEW_SHOT)
    if dataset not in CATEGORIES:
        raise ValueError(dataset)
    listing = cut_lineage(ranked(_files(spark, root, classes, "train/*.pcd", 2)))
    _require(listing, classes, "training clouds")
    if n > 0:
        listing = take_slice(listing, 0, n)
    points = C.read_pcd(spark, _existing(root, classes, "train/*.pcd"))
    return _name(points.join(listing.select("path", "category", "cloud_rank"), "path"))


def load_train_slice(spark: SparkSession, root: str, classes: Sequence[str], start: int, n: int) -> DataFrame:
    """Training goods start .. start + n of the organised benchmark, background removed."""
    listing = cut_lineage(take_slice(ranked(_files(spark, root, classes, "train/good/xyz/*.tif*", 4)), start, n))
    _require(listing, classes, "training scans")
    points = read_clean_scans(listing)      # only the files of the slice are opened
    return _name(points.join(listing.select("path", "category", "cloud_rank"), "path"))


def load_train_extra(spark: SparkSession, root: str, dataset: str, classes: Sequence[str], start: int, n: int) -> DataFrame:
    """Further normal samples beyond the prototypes; only the organised benchmark has them."""
    if dataset != "mvtec":
        raise ValueError("extra training normals exist only for the organised benchmark")
    return load_train_slice(spark, root, classes, start, n)


def read_clean_scans(listing: DataFrame, border: int = 10) -> DataFrame:
    """Listed organised scans without support plane and stray clusters; pixel indices are kept."""
    p = C.organised(contents(listing))
    p = cut_lineage(p.withColumn("border", on_border("pix", "height", "width", border)))
    return clean_scan(p, ["path"]).drop("border")


def _name(points: DataFrame) -> DataFrame:
    from ..functions.expr import sample_id
    return points.withColumn("cloud_id", sample_id("path"))


def load_test(spark: SparkSession, root: str, dataset: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Test samples: category, cloud_id, path, label, point_idx, x, y, z, gt."""
    classes = list(classes or get_classes(dataset))
    cols = ["category", "path", "label", "point_idx", "x", "y", "z", "gt"]
    if dataset == "shapenet":
        # normal files carry 'positive' in the name; anomalous clouds come with their flags in GT
        listing = cut_lineage(_files(spark, root, classes, "test/*.pcd", 2).where(
            F.contains(_part(-1), F.lit("positive"))))
        _require(listing, classes, "normal test clouds ('positive' in the name)")
        normal = C.read_pcd(spark, _existing(root, classes, "test/*positive*.pcd")).withColumn("gt", F.lit(0.0).cast("float"))
        bad = C.read_text(spark, _existing(root, classes, "GT/*.txt"))
        both = normal.withColumn("label", F.lit(0)).unionByName(bad.withColumn("label", F.lit(1)))
        return _name(both.withColumn("category", _part(-3)).select(*cols))
    if dataset == "real3d":
        listing = _files(spark, root, classes, "test/*.pcd", 2).where(~F.contains(_part(-1), F.lit("temp")))
        listing = cut_lineage(listing.withColumn("good", F.contains(_part(-1), F.lit("good"))).withColumn(
            "stem", file_stem("path")))
        _require(listing, classes, "test clouds")
        normal = C.read_listed(listing.where("good")).withColumn("gt", F.lit(0.0).cast("float"))
        flags = C.read_text(spark, _existing(root, classes, "gt/*.txt")).withColumn(
            "category", _part(-3)).withColumn("stem", file_stem("path")).drop("path")
        named = C.list_files(spark, _existing(root, classes, "gt/*.txt")).withColumn("category", _part(-3)).withColumn(
            "stem", file_stem("path"))
        _require_partner(listing.where("NOT good"), named, ["category", "stem"], "ground truth file")
        bad = flags.join(listing.where("NOT good").select("category", "stem", "path"), ["category", "stem"])
        bad = bad.withColumn("label", F.lit(1)).select(*cols)
        normal = normal.withColumn("label", F.lit(0)).withColumn("category", _part(-3)).select(*cols)
        return _name(normal.unionByName(bad))
    if dataset == "mvtec":
        listing = cut_lineage(_files(spark, root, classes, "test/*/xyz/*.tif*", 4).withColumn("kind", _part(-3)))
        _require(listing, classes, "test scans")
        points = read_clean_scans(listing)
        points = points.join(listing.select("path", "category", "kind"), "path").withColumn("stem", file_stem("path"))
        masks = C.read_masks(spark, _existing(root, classes, "test/*/gt/*.png")).withColumn(
            "category", _part(-5)).withColumn("kind", _part(-3)).withColumn("stem", file_stem("path")).drop("path")
        keys = ["category", "kind", "stem"]
        named = C.list_files(spark, _existing(root, classes, "test/*/gt/*.png")).withColumn("category", _part(-5)).withColumn(
            "kind", _part(-3)).withColumn("stem", file_stem("path"))
        _require_partner(listing.where("kind <> 'good'").withColumn("stem", file_stem("path")), named, keys, "mask")
        size = masks.where("mask_pix < 0").select(*keys, "mask_h", "mask_w")
        points = points.join(size, keys, "left").withColumn("mask_pix", C.mask_pixel())
        hit = attach_mask(points, masks.where("mask_pix >= 0").select(*keys, "mask_pix", "mask"), [*keys, "mask_pix"])
        bad = F.col("kind") != "good"
        hit = hit.withColumn("label", bad.cast("int")).withColumn("gt", F.when(bad, F.col("gt")).otherwise(0.0).cast("float"))
        return _name(hit.select(*cols))
    raise ValueError(dataset)


def _train_cuts(spark: SparkSession, root: str, classes: Sequence[str]) -> DataFrame:
    """Listing (path, category) of single-view scans; one recursive listing serves all categories."""
    found = C.list_files(spark, root, recursive=True)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*CUT_EXTENSIONS)
    tagged = found.where(ext).withColumn("_folder", F.regexp_replace("path", "/[^/]*$", ""))
    order, category, base = None, None, root.rstrip("/")
    for i, sub in enumerate(CUT_LAYOUTS):
        name = F.regexp_extract("_folder", f"([^/]+)/{sub}$", 1)
        here = F.col("_folder") == F.concat(F.lit(f"{base}/"), name, F.lit(f"/{sub}"))
        rank = F.when(name != "", F.when(here, F.lit(f"{i}")).otherwise(F.concat(F.lit(f"{i + len(CUT_LAYOUTS)} "), F.col("_folder"))))
        order = rank if order is None else F.coalesce(order, rank)
        category = F.nullif(name, F.lit("")) if category is None else F.coalesce(category, F.nullif(name, F.lit("")))
    tagged = tagged.withColumn("_o", order).withColumn("category", category).where(F.col("category").isin(*classes))
    first = tagged.groupBy("category").agg(F.min("_o").alias("_o"))
    return tagged.join(first, ["category", "_o"]).select("path", "length", "category")


def find_train_cuts(spark: SparkSession, root: str, category: str) -> DataFrame:
    """Single-view training scans of a category; the first layout that has files wins.

    Layouts: <category>/train_cut, <category>/train/good/xyz, then either anywhere below the root.
    """
    out = _train_cuts(spark, root, [category])
    if out.isEmpty():
        raise FileNotFoundError(f"no training cut clouds for '{category}' under {root}")
    return out


def load_train_cuts(spark: SparkSession, root: str, classes: Sequence[str]) -> DataFrame:
    """Scans of all categories: category, cloud_id, path, cloud_rank, point_idx, x, y, z."""
    listing = cut_lineage(ranked(_train_cuts(spark, root, classes)))
    _require(listing, classes, "training cut clouds")
    return _name(C.read_listed(listing).join(listing.drop("length"), "path"))


def structure_report(spark: SparkSession, root: str, dataset: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Files per category and split folder; a category without training files raises."""
    classes = list(classes or get_classes(dataset))
    found = C.list_files(spark, f"{root}/{{{','.join(classes)}}}", recursive=True)
    rel = F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)
    out = found.withColumn("category", F.split(rel, "/")[0]).withColumn("split", F.split(rel, "/")[1])
    out = out.groupBy("category", "split").agg(F.count(F.lit(1)).alias("n_files"))
    _require(out.where(F.col("split").startswith("train")), classes, "training files")
    return out
