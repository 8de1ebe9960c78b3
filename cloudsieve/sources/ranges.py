"""Cloud files in byte ranges: a file of any size is read by as many tasks as it has ranges.

A listing (path, length) stays a table from end to end: it is cut into rows of one range each, and executors open only the
ranges they are dealt, through the Arrow file systems. Binary points find their number from their place in the file. For
lines of text a first pass counts those that begin in every range of a file with several.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .formats import PointLayout, parse_pcd, pcd_layout, ply_layout

RANGE_BYTES = 64 << 20
PORTION = 4 << 20
HEAD = 64 << 10
# Names that other file systems give to a scheme known to Arrow.
SCHEMES = {"s3a": "s3", "s3n": "s3"}

_POINTS = pa.schema([("path", pa.string()), ("point_idx", pa.int64()), ("x", pa.float32()), ("y", pa.float32()), ("z", pa.float32())])
_LINES = pa.schema([("path", pa.string()), ("point_idx", pa.int64()), ("value", pa.string()), ("comma", pa.bool_())])
_COUNTS = pa.schema([("path", pa.string()), ("_start", pa.int64()), ("_c", pa.int64())])


def opened(path: str) -> pa.NativeFile:
    """Random access to a file by absolute path or URI."""
    scheme, _, rest = path.partition("://")
    files, at = FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{quote(rest)}" if rest else path)
    return files.open_input_file(at)


def extension(path="path"):
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def file_ranges(listing: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per range of every listed file: path, length, _start, _stop, _n (ranges of the file)."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0).cast("long")), F.lit(range_bytes).cast("long"))
    cut = listing.select("path", "length", F.size(starts).alias("_n"), F.explode(starts).alias("_start"))
    return cut.withColumn("_stop", F.least(F.col("_start") + range_bytes, F.col("length")))


def line_portions(f: pa.NativeFile, body: int, start: int, stop: int) -> Iterator[tuple[bytes, int]]:
    """Whole lines that begin in [start, stop), none before ``body``, as (bytes, number of lines) of a few megabytes."""
    at = max(start, body)
    if at >= stop:
        return
    skip = at > body        # one byte earlier tells whether a line begins just here
    at -= skip
    f.seek(at)
    rest, ended = b"", False
    while not ended:
        chunk = f.read(PORTION)
        ended = not chunk
        data = rest + chunk
        if ended and data and not data.endswith(b"\n"):
            data += b"\n"
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
        if skip and len(ends):
            cut, skip = int(ends[0]), False
            data, at, ends = data[cut:], at + cut, ends[1:] - cut
            if at >= stop:
                return
        if not skip and len(ends):
            n = int(np.searchsorted(np.concatenate([[0], ends[:-1]]) + at, stop))
            end = int(ends[n - 1])
            yield data[:end], n
            data, at = data[end:], at + end
            if at >= stop:
                return
        rest = data


def layout_of(f: pa.NativeFile, path: str) -> PointLayout:
    """Layout of a PCD or PLY file from as much of its head as it takes. A file without points raises."""
    find = ply_layout if path.lower().endswith(".ply") else pcd_layout
    size, take = f.size(), HEAD
    while True:
        f.seek(0)
        head = f.read(min(take, size))
        try:
            form = find(head)
            break
        except ValueError:
            if take >= size:
                raise
            take *= 4
    if not form.n:
        raise ValueError(f"empty point cloud: {path}")
    return form


def _filled(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if line.strip()]


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that begin in each range: all of a text file, those with numbers of an ascii cloud; 0 where no line counts."""
    for batch in it:
        rows = batch.to_pylist()
        for r in rows:
            with opened(r["path"]) as f:
                if r["cloud"]:
                    form = layout_of(f, r["path"])
                    r["_c"] = sum(len(_filled(t)) for t, _ in line_portions(f, form.body, r["_start"], r["_stop"])) if form.kind == "ascii" else 0
                else:
                    r["_c"] = sum(n for _, n in line_portions(f, 0, r["_start"], r["_stop"]))
        yield pa.RecordBatch.from_pylist([{k: r[k] for k in _COUNTS.names} for r in rows], _COUNTS)


def numbered(ranges: DataFrame) -> DataFrame:
    """Ranges with ``_first``, the number of lines that begin in the file's earlier ranges, dealt over all tasks."""
    tagged = ranges.withColumn("cloud", extension().isin("pcd", "ply"))
    asked = tagged.where("_n > 1").select("path", "_start", "_stop", "cloud")
    counts = spread(asked, "path", "_start").mapInArrow(_count, "path string, _start long, _c long")
    ahead = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("path", "_start", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).cast("long").alias("_first"))
    out = ranges.join(before, ["path", "_start"], "left").withColumn("_first", F.coalesce("_first", F.lit(0).cast("long")))
    return spread(out, "path", "_start")


def _points(path: str, first: int, xyz: np.ndarray) -> pa.RecordBatch:
    n = len(xyz)
    return pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(n, np.int8))), pa.array(np.arange(first, first + n)),
                                       *[pa.array(np.ascontiguousarray(xyz[:, i])) for i in range(3)]], schema=_POINTS)


def _range_points(path: str, start: int, stop: int, length: int, first: int) -> Iterator[pa.RecordBatch]:
    with opened(path) as f:
        form = layout_of(f, path)
        if form.kind == "ascii":
            for text, _ in line_portions(f, form.body, start, stop):
                lines = _filled(text)[:form.n - first]
                if lines:
                    yield _points(path, first, form.numbers(b"\n".join(lines), len(lines)))
                    first += len(lines)
            if stop == length and first < form.n:
                raise ValueError(f"{path} ends after {first} of {form.n} points")
        elif form.kind == "binary":
            size = form.row.itemsize
            if form.body + form.n * size > length:
                raise ValueError(f"{path} ends before its {form.n} points")
            place = lambda at: min(max(-(-(at - form.body) // size), 0), form.n)
            row, end, step = place(start), place(stop), max(1, PORTION // size)
            f.seek(form.body + row * size)
            while row < end:
                n = min(step, end - row)
                yield _points(path, row, form.xyz(np.frombuffer(f.read(n * size), dtype=form.row)))
                row += n
        elif start == 0:
            # compressed points are one block
            f.seek(0)
            yield _points(path, 0, parse_pcd(f.read()))


def range_points(ranges: DataFrame) -> DataFrame:
    """Points (path, point_idx, x, y, z) of PCD and PLY ranges that are :func:`numbered`."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                yield from _range_points(r["path"], r["_start"], r["_stop"], r["length"], r["_first"])
    return ranges.mapInArrow(run, "path string, point_idx long, x float, y float, z float")


def range_lines(ranges: DataFrame) -> DataFrame:
    """Lines (path, point_idx, value) of text ranges that are :func:`numbered`; ``comma``: the file's first line has one."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                with opened(r["path"]) as f:
                    comma = any(b"," in text.split(b"\n", 1)[0] for text, _ in line_portions(f, 0, 0, min(1, r["length"])))
                    at = r["_first"]
                    for text, n in line_portions(f, 0, r["_start"], r["_stop"]):
                        lines = text.decode("utf-8", "replace").split("\n")[:n]
                        yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), pa.array(np.arange(at, at + n)), pa.array(lines),
                                                          pa.array(np.full(n, comma))], schema=_LINES)
                        at += n
    return ranges.mapInArrow(run, "path string, point_idx long, value string, comma boolean")


def contents(listing: DataFrame) -> DataFrame:
    """Whole files (path, content) of a listing, one at a time in a task; for images and other files that cannot be cut."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column("path").to_pylist():
                with opened(path) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])
    return spread(listing.select("path"), "path").mapInArrow(run, "path string, content binary")
