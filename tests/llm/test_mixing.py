import math
import re
from collections import defaultdict

import pytest
from conftest_llm import AWKWARD
from pyspark.sql import functions as F

from cloudsieve.llm import mixing


def plain_targets(sizes):
    """Fill by weight, stop at three times a source's size, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return {**fixed, **{s: level * weight[s] for s in free}}
        fixed.update({s: 3 * sizes[s] for s in over})


def sizes_of(rows):
    return [len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in rows]


@pytest.mark.parametrize("hot", [False, True])
def test_targets_and_taken(frame, hot):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", f"s{i % 7}" if not hot or i % 3 else "big") for i in range(900)]
    rows += [(2000 + i, "w w w", "en", None) for i in range(40)] + [(3000, "", "en", "void"), (3001, None, "en", "void")]
    rows += [(4000, "w " * 11, "en", "tiny")]
    got = mixing.mix_sources(frame(rows)).toPandas()
    got["source"] = got.source.where(got.source.notna(), None)
    sizes = defaultdict(int)
    for r, n in zip(rows, sizes_of(rows)):
        sizes[r[3]] += n
    want = plain_targets(dict(sizes))
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for s, t in want.items():
        part = got[got.source.isna()] if s is None else got[got.source == s]
        assert part.target.iloc[0] == pytest.approx(t, rel=1e-9) and part.source_size.iloc[0] == sizes[s]
        assert abs(part.taken.sum() - t) <= max(0.01 * t, part["size"].max() / 2 + 1)
    again = mixing.mix_sources(frame(list(reversed(rows)))).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))


def test_tilted_rates_meet_constraints(spark):
    masses = spark.createDataFrame([("a", 0.5, 100.0), ("a", 2.0, 50.0), ("b", 1.0, 10.0)], "source string, tilt double, mass double")
    targets = spark.createDataFrame([("a", 150, 250.0), ("b", 10, 30.0)], "source string, source_size long, target double")
    state = {r.source: r.multiplier for r in mixing.entropy_balance(masses, targets).collect()}
    import math
    rate = lambda s, x: min(3.0, math.exp(state[s] * x))
    assert 100 * 0.5 * rate("a", 0.5) + 50 * 2 * rate("a", 2.0) == pytest.approx(250, rel=1e-6)
    assert 10 * rate("b", 1.0) == pytest.approx(30, rel=1e-6)


def test_awkward_rows_and_mixture(frame):
    rows = [(i, t, "en", s) for (i, t), s in zip(AWKWARD, ["b", "a", "b", "a", "c", "c", "a", None, "b", "c", "b", "a", "c", None])]
    docs = frame(rows)
    table = mixing.mix_sources(docs)
    mixed = mixing.mixed(docs)
    assert table.count() == len(rows) and mixed.columns == docs.columns
    assert mixed.count() == table.agg({"copies": "sum"}).first()[0]
    assert mixing.mix_sources(frame([])).count() == 0 and mixing.mixed(frame([])).count() == 0


def test_native_plan(frame):
    plan = mixing.mix_sources(frame(AWKWARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("ratio", [2.118, 2.2, 2.5, 2.9, 2.999999])
def test_targets_just_below_the_cap_are_met(spark, ratio):
    # the first Newton step from 0 is ratio - 1 > ln 3, where all rates are at the cap and nothing is left to move
    rows = spark.range(4000).selectExpr("'a' AS source", "2L + id % 7 AS size", "id AS tag")
    size = rows.agg({"size": "sum"}).first()[0]
    targets = spark.createDataFrame([("a", size, ratio * size)], "source string, source_size long, target double")
    masses = rows.selectExpr("source", "1D AS tilt", "size AS mass")
    state = mixing.entropy_balance(masses, targets).first()
    assert math.exp(state.multiplier) == pytest.approx(ratio, rel=1e-9)


def test_small_sources_beside_a_hot_one(frame):
    rows = [(i, "w " * (3 + i % 5), "en", "a" if i % 3 == 0 else f"s{i % 19:02d}") for i in range(6000)]
    got = mixing.mix_sources(frame(rows)).toPandas().groupby("source").agg(
        size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    ratio = got.target / got["size"]
    assert ((ratio > 1 + math.log(3)) & (ratio < 3)).any()
    assert ((got.taken - got.target).abs() <= 7).all()


def test_tilts_above_and_below_zero_meet_constraints(spark):
    masses = [("a", 0.01, 500.0), ("a", 0.02, 300.0), ("b", 3.0, 70.0), ("b", 0.2, 40.0), ("c", -1.0, 60.0), ("c", 2.0, 80.0)]
    want = {"a": 2.9 * 11, "b": 2.7 * 218, "c": 2.95 * 160 - 0.35 * 60}
    frame = spark.createDataFrame(masses, "source string, tilt double, mass double")
    targets = spark.createDataFrame([(s, 1, t) for s, t in want.items()], "source string, source_size long, target double")
    state = {r.source: r.multiplier for r in mixing.entropy_balance(frame, targets).collect()}
    for s, t in want.items():
        got = sum(m * x * min(3.0, math.exp(min(2.0, state[s] * x))) for n, x, m in masses if n == s)
        assert got == pytest.approx(t, rel=1e-9)


def test_unreachable_target_raises(spark):
    masses = spark.createDataFrame([("a", 1.0, 10.0)], "source string, tilt double, mass double")
    targets = spark.createDataFrame([("a", 10, 31.0)], "source string, source_size long, target double")
    with pytest.raises(ValueError, match="not met"):
        mixing.entropy_balance(masses, targets)


def test_repeated_rows_are_not_paired(frame):
    rows = [(1, "a b c", "en", "s")] * 300 + [(2 + i, "w " * (1 + i % 9), "en", "st"[i % 2]) for i in range(200)]
    docs = frame(rows)
    mixed = mixing.mixed(docs)
    want = {r.doc_id: r.n for r in mixing.mix_sources(docs).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r.n}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    # every row meets one row of counts
    plan = mixed._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any(x.strip(" :+-").startswith("Aggregate") and "_id_hash" in x and "_text_hash" in x for x in plan)
