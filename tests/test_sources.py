import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudsieve.sources import clouds as C
from cloudsieve.sources import formats, layouts, results
from shapes import sphere


def pcd(path, x, kind="ascii"):
    head = ("# .PCD v0.7\nVERSION 0.7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\n"
            f"WIDTH {len(x)}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {len(x)}\nDATA {kind}\n").encode()
    rows = np.column_stack([x, np.zeros(len(x))]).astype("<f4")
    if kind == "ascii":
        body = "\n".join(" ".join(f"{v:.6f}" for v in r) for r in rows).encode()
    elif kind == "binary":
        body = rows.tobytes()
    else:
        raw = np.ascontiguousarray(rows.T).tobytes()
        lit = b"".join(bytes([len(raw[i:i + 32]) - 1]) + raw[i:i + 32] for i in range(0, len(raw), 32))
        body = struct.pack("<II", len(lit), len(raw)) + lit
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(head + body)


def text(path, x, gt, sep):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(sep.join(f"{v:.6f}" for v in (*r, g)) for r, g in zip(x, gt)) + "\n")


def tiff(path, a, packed=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    h, w, s = a.shape
    raw = a.astype("<f4").tobytes()
    raw = zlib.compress(raw) if packed else raw
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 32), (259, 3, 1, 8 if packed else 1), (273, 4, 1, 8),
            (277, 3, 1, s), (278, 4, 1, h), (279, 4, 1, len(raw)), (284, 3, 1, 1), (339, 3, 1, 3)]
    ifd = struct.pack("<H", len(tags)) + b"".join(
        struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, n, v in tags)
    path.write_bytes(b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + ifd + b"\0\0\0\0")


def png(path, a):
    path.parent.mkdir(parents=True, exist_ok=True)
    h, w = a.shape
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    raw = b"".join(b"\0" + a[i].astype(np.uint8).tobytes() for i in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0))
                     + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.mark.parametrize("kind", ["ascii", "binary", "binary_compressed"])
def test_pcd_kinds(tmp_path, kind):
    x = sphere(np.random.default_rng(0), 50).astype(np.float32)
    pcd(tmp_path / "a.pcd", x, kind)
    assert np.allclose(formats.parse_pcd((tmp_path / "a.pcd").read_bytes()), x, atol=1e-5)


def test_lzf_back_references():
    # literal "abc", then a reference 3 back of length 6
    assert formats.unpack_lzf(bytes([2]) + b"abc" + bytes([(4 << 5) | 0, 2]), 9) == b"abcabcabc"


def test_ply_ascii_and_binary():
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    head = "ply\nformat {} 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    assert (formats.parse_ply((head.format("ascii") + "\n".join(" ".join(map(str, r)) for r in x)).encode()) == x).all()
    assert (formats.parse_ply(head.format("binary_little_endian").encode() + x.astype("<f4").tobytes()) == x).all()


def test_text_delimiters_comments_and_flags(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,2,3,1\n4,5,6,0\n")
    (tmp_path / "b.txt").write_text("# head\n1 2 3\n4  5 6\n")
    (tmp_path / "c.txt").write_text("7 8 9 0.7\n")
    got = C.read_text(spark, str(tmp_path / "*.txt")).toPandas()
    got["name"] = got.path.str[-5:]
    assert got.sort_values(["name", "point_idx"])[["x", "y", "z", "gt"]].values.tolist() == [
        [1, 2, 3, 1], [4, 5, 6, 0], [1, 2, 3, 0], [4, 5, 6, 0], [7, 8, 9, 1]]


def test_shapenet_and_real3d_layouts(spark, tmp_path):
    rng = np.random.default_rng(1)
    for i in range(3):
        for d in ("s", "r"):
            pcd(tmp_path / d / "duck" / "train" / f"t{i}.pcd", sphere(rng, 60))
    for i in range(2):
        pcd(tmp_path / "s/duck/test" / f"d{i}_positive.pcd", sphere(rng, 60))
        pcd(tmp_path / "s/duck/test" / f"d{i}_bulge.pcd", sphere(rng, 60))
        text(tmp_path / "s/duck/GT" / f"d{i}_bulge.txt", sphere(rng, 40), np.arange(40) < 7, ",")
        pcd(tmp_path / "r/duck/test" / f"d{i}_good.pcd", sphere(rng, 60))
        pcd(tmp_path / "r/duck/test" / f"d{i}_bulge.pcd", sphere(rng, 60))
        text(tmp_path / "r/duck/gt" / f"d{i}_bulge.txt", sphere(rng, 40), np.arange(40) < 9, " ")
    pcd(tmp_path / "r/duck/test/duck_temp.pcd", sphere(rng, 60))
    for d, dataset, flagged in (("s", "shapenet", 7), ("r", "real3d", 9)):
        t = layouts.load_test(spark, str(tmp_path / d), dataset, ["duck"]).groupBy("cloud_id", "label").agg(
            F.count(F.lit(1)).alias("n"), F.sum("gt").alias("gt")).toPandas()
        assert sorted(t.label) == [0, 0, 1, 1]
        assert (t[t.label == 1]["gt"] == flagged).all() and (t[t.label == 0]["gt"] == 0).all()
        assert (t[t.label == 1].n == 40).all()
        tr = layouts.load_train(spark, str(tmp_path / d), dataset, ["duck"], 2).toPandas()
        assert sorted(tr.cloud_rank.unique()) == [1, 2] and len(tr) == 120
    rep = layouts.structure_report(spark, str(tmp_path / "s"), "shapenet", ["duck"]).toPandas().set_index("split")
    assert rep.n_files.to_dict() == {"train": 3, "test": 4, "GT": 2}
    with pytest.raises(FileNotFoundError):
        layouts.load_train(spark, str(tmp_path / "s"), "shapenet", ["duck", "cup0"])
    with pytest.raises(ValueError):
        layouts.get_classes("none")


def test_train_cut_layouts(spark, tmp_path):
    rng = np.random.default_rng(2)
    text(tmp_path / "deep/er/car/train_cut/1_0.asc", sphere(rng, 30), np.zeros(30), " ")
    assert layouts.find_train_cuts(spark, str(tmp_path), "car").count() == 1
    text(tmp_path / "car/train/good/xyz/0_0.txt", sphere(rng, 30), np.zeros(30), " ")
    text(tmp_path / "car/train/good/xyz/0_1.txt", sphere(rng, 30), np.zeros(30), " ")
    got = layouts.load_train_cuts(spark, str(tmp_path), ["car"])
    assert got.select("cloud_id").distinct().count() == 2 and got.count() == 60
    with pytest.raises(FileNotFoundError):
        layouts.find_train_cuts(spark, str(tmp_path), "duck")


def scan(rng, hole=False):
    """64 x 64 organised scan of a dome on a table, with missing pixels."""
    yy, xx = np.mgrid[0:64, 0:64] / 63.0
    r2 = ((xx - 0.5) ** 2 + (yy - 0.5) ** 2) / 0.3 ** 2
    z = np.where(r2 < 1, 0.2 + 0.2 * np.sqrt(np.maximum(1 - r2, 0)), 0) + 0.0004 * rng.normal(size=(64, 64))
    a = np.dstack([xx + 0.01, yy + 0.01, z + 1]).astype(np.float32)
    a[0, :20] = 0
    mask = (r2 < 0.05) & hole
    a[mask, 2] -= 0.1
    return a, mask


def test_organised_layout_with_masks(spark, tmp_path):
    rng = np.random.default_rng(3)
    for i in range(6):
        tiff(tmp_path / f"bagel/train/good/xyz/{i:03d}.tiff", scan(rng)[0], packed=i == 0)
    for i in range(2):
        tiff(tmp_path / f"bagel/test/good/xyz/{i:03d}.tiff", scan(rng)[0])
        a, m = scan(rng, True)
        tiff(tmp_path / f"bagel/test/hole/xyz/{i:03d}.tiff", a)
        big = np.kron(m, np.ones((2, 2))) if i else m
        png(tmp_path / f"bagel/test/hole/gt/{i:03d}.png", big * 255)
    train = layouts.load_train(spark, str(tmp_path), "mvtec", ["bagel"]).groupBy("cloud_id", "cloud_rank").count().toPandas()
    assert sorted(train.cloud_rank) == [1, 2, 3, 4]
    extra = layouts.load_train_extra(spark, str(tmp_path), "mvtec", ["bagel"], 4, 2)
    assert extra.select("cloud_id").distinct().count() == 2
    t = layouts.load_test(spark, str(tmp_path), "mvtec", ["bagel"]).groupBy("cloud_id", "label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gt").alias("gt"), F.min("z").alias("z")).toPandas().set_index("cloud_id")
    assert t.label.to_dict() == {"good_000.tiff": 0, "good_001.tiff": 0, "hole_000.tiff": 1, "hole_001.tiff": 1}
    hole = int(scan(rng, True)[1].sum())
    assert t["gt"].to_dict() == {"good_000.tiff": 0, "good_001.tiff": 0, "hole_000.tiff": hole, "hole_001.tiff": hole}
    assert (t.z > 1.05).all()


def test_result_files(spark, tmp_path):
    (tmp_path / "base-s1_real3d_20260101-000000.csv").write_text(",o_auroc,note\nduck,0.5,x\n__mean__,0.5,\n")
    (tmp_path / "base-s1_real3d_20260102-000000.csv").write_text(",o_auroc,note\nduck,0.7,x\n__mean__,0.7,\n")
    long = results.read_result_csv(spark, str(tmp_path / "*.csv"), "real3d")
    from cloudsieve.plans.analytics import latest_runs
    got = latest_runs(long).where("metric = 'o_auroc' and category = '__mean__'").toPandas()
    assert got[["tag", "seed", "value"]].values.tolist() == [["base", 1, 0.7]]
    (tmp_path / "a-s2-part0_real3d_scores.json").write_text('{"duck": [{"file": "f", "label": 1, "n_points": 9, "hyb_max": 0.1}]}')
    (tmp_path / "a-s2-part1_real3d_scores.json").write_text(
        '{"duck": [{"file": "f", "label": 1, "n_points": 9, "hyb_max": 0.4}], "car": [{"file": "g", "label": 0, "hyb_max": NaN}]}')
    rec = results.read_records_json(spark, str(tmp_path / "*_scores.json"), ["hyb_max"]).toPandas()
    assert rec[["seed", "category", "file", "score"]].values.tolist() == [[2, "duck", "f", 0.4]]
    results.write_result_csv(spark.createDataFrame([("__mean__", 0.5), ("a", 0.5)], "category string, v double"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    (tmp_path / "sel.json").write_text('{\n "max_nn": 20, "rule": "hyb", "views": "V01", "pooling": "max", "mhr": true}')
    assert results.read_selection(spark, str(tmp_path / "sel.json")).first().rule == "hyb"
    assert "| a | 0.50 |" in results.markdown_table(spark.createDataFrame([("a", 0.5)], "c string, v double"))


def test_log_watch(spark, tmp_path):
    from cloudsieve.streaming.logs import watch
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("start\nTraceback (most recent call last)\nValueError: x\n")
    (logs / "b.log").write_text("fine\n")
    for _ in range(2):
        q = watch(spark, str(logs), "log_progress", str(tmp_path / "cp"), once=True)
        q.awaitTermination(60)
        break
    got = {r.log: (r.n_lines, r.n_errors) for r in spark.table("log_progress").collect()}
    assert got == {"a.log": (3, 2), "b.log": (1, 0)}


def test_samples_without_ground_truth_raise(spark, tmp_path):
    rng = np.random.default_rng(5)
    pcd(tmp_path / "r/duck/test/d0_bulge.pcd", sphere(rng, 60))
    pcd(tmp_path / "r/duck/test/d1_bulge.pcd", sphere(rng, 60))
    text(tmp_path / "r/duck/gt/d0_bulge.txt", sphere(rng, 40), np.arange(40) < 9, " ")
    with pytest.raises(FileNotFoundError, match="d1_bulge"):
        layouts.load_test(spark, str(tmp_path / "r"), "real3d", ["duck"])
    for i in range(2):
        tiff(tmp_path / f"m/bagel/test/hole/xyz/{i:03d}.tiff", scan(rng, True)[0])
    png(tmp_path / "m/bagel/test/hole/gt/000.png", scan(rng, True)[1] * 255)
    with pytest.raises(FileNotFoundError, match="001.tiff"):
        layouts.load_test(spark, str(tmp_path / "m"), "mvtec", ["bagel"])


def test_bad_numbers_raise(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("1 2 3\nnan 2 3\n")
    assert C.read_text(spark, str(tmp_path / "ok.txt")).count() == 2
    for name, line in (("word", "1 2 x"), ("short", "1 2"), ("flag", "1 2 3 yes")):
        (tmp_path / f"{name}.txt").write_text(f"1 2 3 0\n{line}\n")
        with pytest.raises(Exception, match="is no number"):
            C.read_text(spark, str(tmp_path / f"{name}.txt")).collect()


def test_maps_are_written_whole(spark, tmp_path):
    points = spark.range(40_000).selectExpr("'c' AS category", "'s' AS cloud_id", "id AS point_idx", "1.0 AS hyb")
    results.write_maps(points, str(tmp_path / "maps"))
    assert spark.read.parquet(str(tmp_path / "maps")).count() == 40_000
    results.write_maps(points, str(tmp_path / "few"), 100)
    assert spark.read.parquet(str(tmp_path / "few")).count() == 100


@pytest.mark.parametrize("kind", ["ascii", "binary", "binary_compressed"])
def test_large_clouds_are_read_in_ranges(spark, tmp_path, kind):
    x = sphere(np.random.default_rng(7), 700).astype(np.float32)
    pcd(tmp_path / "a b.pcd", x, kind)
    size = (tmp_path / "a b.pcd").stat().st_size
    for step in (977, size - 1):
        got = C.read_pcd(spark, str(tmp_path / "*.pcd"), range_bytes=step)
        parts = got.withColumn("p", F.spark_partition_id()).toPandas().sort_values("point_idx")
        assert parts.point_idx.tolist() == list(range(700))
        assert np.allclose(parts[["x", "y", "z"]].values, x, atol=1e-5)
        assert kind == "binary_compressed" or step > 977 or parts.p.nunique() > 2
    whole = C.read_pcd(spark, str(tmp_path / "*.pcd")).select("path").distinct().first().path
    assert C.read_pcd(spark, str(tmp_path / "*.pcd"), range_bytes=977).select("path").distinct().first().path == whole


def test_large_texts_and_plys_are_read_in_ranges(spark, tmp_path):
    x = np.arange(900, dtype=np.float32).reshape(300, 3)
    lines = ["# head, with a comma"] + [",".join(f"{v:.1f}" for v in (*r, i % 2)) for i, r in enumerate(x)]
    lines.insert(50, "")
    (tmp_path / "crlf.txt").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "plain.txt").write_text("\n".join(" ".join(f"{v:.1f}" for v in r) for r in x) + "\n")
    head = "ply\nformat {} 1.0\nelement vertex 300\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii") + "\n".join(" ".join(map(str, r)) for r in x) + "\n3 0 1 2\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_big_endian").encode() + x.astype(">f4").tobytes() + b"\0" * 400)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for step in (61, 1000):
        assert rows(C.read_text(spark, str(tmp_path / "*.txt"), step)) == rows(C.read_text(spark, str(tmp_path / "*.txt")))
        assert C.read_any(spark, str(tmp_path / "*"), step).count() == 1200
    got = C.read_any(spark, str(tmp_path / "*.ply"), 61).toPandas()
    for _, one in got.groupby("path"):
        assert (one.sort_values("point_idx")[["x", "y", "z"]].values == x).all()


def test_lines_of_ranges_are_a_partition(tmp_path):
    import pyarrow as pa
    from cloudsieve.sources.ranges import line_portions
    rng = np.random.default_rng(8)
    for text in (b"", b"a", b"\n", b"\n\na\n\nbb", *[bytes(rng.choice(list(b"ab\n"), 60)) for _ in range(20)]):
        expected = text.split(b"\n")[:-1] if text.endswith(b"\n") or not text else text.split(b"\n")
        for step in (1, 3, 7, 100):
            f = pa.PythonFile(__import__("io").BytesIO(text), mode="r")
            found = []
            for s in range(0, max(len(text), 1), step):
                for data, n in line_portions(f, 0, s, min(s + step, len(text))):
                    found += data.split(b"\n")[:n]
            assert found == expected, (text, step)


def test_a_short_cloud_raises(spark, tmp_path):
    x = sphere(np.random.default_rng(9), 100)
    for kind in ("ascii", "binary"):
        pcd(tmp_path / f"{kind}.pcd", x, kind)
        data = (tmp_path / f"{kind}.pcd").read_bytes()
        (tmp_path / f"{kind}.pcd").write_bytes(data[:data.rindex(b"\n", 0, -200) + 1] if kind == "ascii" else data[:-200])
        with pytest.raises(Exception, match="ends"):
            C.read_pcd(spark, str(tmp_path / f"{kind}.pcd"), 500).collect()


def lzw(data):
    """Encoder of TIFF's LZW: widths grow when the table does, and it is cleared before codes need 13 bits."""
    codes, known, run, width = [(256, 9)], {bytes([i]): i for i in range(256)}, b"", 9
    size = 258
    for i in range(len(data)):
        b = data[i:i + 1]
        if run + b in known:
            run += b
            continue
        codes.append((known[run], width))
        known[run + b] = size
        size += 1
        run = b
        if size == 4095:
            codes.append((256, 12))
            known, size = {bytes([i]): i for i in range(256)}, 258
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    if run:
        codes.append((known[run], width))
        size += 1
    codes.append((257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_lzw_of_plain_and_repeated_bytes():
    rng = np.random.default_rng(10)
    for data in (b"", b"a", b"a" * 5000, bytes(rng.integers(0, 4, 30_000, dtype=np.uint8)), rng.bytes(9000),
                 *[rng.bytes(n) for n in range(250, 262)]):
        assert formats.unpack_lzw(lzw(data)) == data
    with pytest.raises(ValueError):
        formats.unpack_lzw(bytes([128, 127, 255, 255]))


def tiff_parts(a, order, tile, packed, predictor, planar):
    """TIFF bytes of an image cut into tiles (or strips of ``tile`` rows), each packed on its own."""
    h, w, s = a.shape
    high, wide = tile if isinstance(tile, tuple) else (tile, w)
    sheets = [a[..., i:i + 1] for i in range(s)] if planar == 2 else [a]
    parts = []
    for sheet in sheets:
        for top in range(0, h, high):
            for left in range(0, w, wide):
                part = sheet[top:top + high, left:left + wide]
                if isinstance(tile, tuple):
                    full = np.zeros((high, wide, part.shape[2]), a.dtype)
                    full[:part.shape[0], :part.shape[1]] = part
                    part = full
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=part.dtype.type(0))
                    raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                elif predictor == 3:
                    planes = np.frombuffer(part.astype(">f4").tobytes(), np.uint8).reshape(part.shape[0], -1, 4).transpose(0, 2, 1)
                    planes = planes.reshape(part.shape[0], -1, part.shape[2])
                    raw = np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()
                else:
                    raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
                parts.append({1: bytes, 5: lzw, 8: zlib.compress}[packed](raw))
    places = 8 + np.cumsum([0, *map(len, parts)])
    at = int(places[-1])
    n = len(parts)
    lists = struct.pack(f"{order}{2 * n}I", *map(int, places[:-1]), *map(len, parts))
    first, second = (at, at + 4 * n) if n > 1 else (8, len(parts[0]))
    cut = [(322, 3, 1, wide), (323, 3, 1, high), (324, 4, n, first), (325, 4, n, second)] if isinstance(tile, tuple) else [
        (273, 4, n, first), (278, 4, 1, high), (279, 4, n, second)]
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, 8 * a.itemsize), (259, 3, 1, packed), (277, 3, 1, s), (284, 3, 1, planar),
            (317, 3, 1, predictor), (339, 3, 1, 3 if a.dtype.kind == "f" else 1), *cut]
    head = struct.pack(f"{order}H", len(tags)) + b"".join(struct.pack(f"{order}HHI", t, k, c) + (
        struct.pack(f"{order}HH", v, 0) if k == 3 else struct.pack(f"{order}I", v)) for t, k, c, v in sorted(tags))
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(f"{order}HI", 42, at + len(lists)) + b"".join(parts) + lists + head + b"\0" * 4


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [(16, 32), 7, 100])
def test_tiffs_in_tiles_and_strips(order, tile):
    rng = np.random.default_rng(11)
    for kind, predictors in (("f4", (1, 3)), ("u2", (1, 2)), ("u1", (1, 2))):
        a = (rng.normal(size=(45, 70, 3)) * 50 + 100).clip(0, 255).astype(kind)
        for packed in (1, 5, 8):
            for planar in (1, 2):
                for p in predictors:
                    got = formats.parse_tiff(tiff_parts(a, order, tile, packed, p, planar))
                    assert got.shape == a.shape and (got == a).all(), (kind, packed, planar, p)
