import random
import re

import numpy as np
import pytest
import xxhash
from conftest_llm import AWKWARD
from pyspark.sql import functions as F

from cloudsieve.llm import simhash


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if int((hashes >> np.uint64(b) & np.uint64(1)).sum()) * 2 > len(hashes))


def plain_components(prints):
    """Union-find over all pairs; index of the first member by position."""
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    values = np.array(prints, np.uint64)
    for k in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[k] ^ values) <= 3):
            a, b = root(k), root(int(j))
            if a != b:
                up[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(prints))]


def test_fingerprint_matches_plain_definition(monkeypatch):
    texts = [t for _, t in AWKWARD] + ["Ein zwei DREI vier", "eins", "a b a b a b a b", "é É ß  x"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


def test_two_words_that_span_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    texts = ["x" * 100 + " tail", "x" * 100 + " other", "one" + " " * 200 + "two", " " * 100 + "a" + " " * 100 + "b" + " " * 100,
             "x" * 100 + " " + "y" * 100 + " z"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]
    assert simhash.fingerprint(texts[0]) != simhash.fingerprint(texts[1])


def test_covering_reaches_every_pair(spark):
    r = random.Random(5)
    pairs = []
    for _ in range(400):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(1, 3)):
            y ^= 1 << b
        pairs.append((x, y))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = spark.createDataFrame([(signed(v),) for p in pairs for v in p], "fp long").distinct()
    at = {}
    for row in simhash.covered(rows).collect():
        at.setdefault(row.fp, (set(), set()))[0 if row.home else 1].add(row.anchor)
    assert all(len(h) == 2 and len(h | c) <= 34 for h, c in at.values())
    for x, y in pairs:
        (hx, cx), (hy, cy) = at[signed(x)], at[signed(y)]
        assert hx & (hy | cy) and hy & (hx | cx)


def test_components_match_brute_force(spark, frame, monkeypatch):
    r = random.Random(9)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) + str(r.randint(0, 99)) for _ in range(60)) for _ in range(20)]
    rows = list(AWKWARD)
    for i in range(300):
        words = r.choice(base).split()
        if i % 2:
            words[r.randrange(60)] = "changed"
        rows.append((1000 - i, " ".join(words)))
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints)
    least = {}
    for (i, _), c in zip(rows, roots):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted([(i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, roots)], key=str)
    got = simhash.near_duplicates(frame(rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted([tuple(x) for x in got], key=str) == want
    # one row of each component stays, repeated rows included
    stay = simhash.one_per_component(frame(rows))
    ids = [x.doc_id for x in stay.collect()]
    assert "fp" in stay.columns and len(ids) == len(set(roots)) and set(ids) >= set(least.values())


def test_sliced_anchor_links_all(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 4)
    prints = [1 << b for b in range(40)] + [(1 << 50) | (1 << b) for b in range(30)] + [0xFFFF << 40]
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = simhash.components(simhash.links(rows), "a", "b").groupBy("root").count().collect()
    roots = plain_components(sorted(prints))
    assert sorted(x["count"] for x in got) == sorted(c for c in (roots.count(x) for x in set(roots)) if c > 1)


@pytest.mark.parametrize("records", [1, 2, 3])
def test_homes_of_one_anchor_in_many_batches(spark, records):
    r = random.Random(records)
    prints = set()
    for _ in range(60):  # pairs whose low halves share a home, so that only their high halves tell them apart
        high, low = r.getrandbits(32), r.getrandbits(32)
        x = high << 32 | low
        y = x
        for b in r.sample(range(32, 64), 3):
            y ^= 1 << b
        prints |= {x, y}
    prints |= {1 << b for b in range(40)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    prints = sorted(prints, reverse=True)
    rows = spark.createDataFrame([(signed(p),) for p in prints], "fp long").coalesce(1)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(records))
        got = simhash.components(simhash.links(rows), "a", "b").groupBy("root").count().collect()
    finally:
        spark.conf.set(name, before)
    roots = plain_components(prints)
    assert sorted(x["count"] for x in got) == sorted(c for c in (roots.count(x) for x in set(roots)) if c > 1)


def test_dense_group_gives_a_forest(spark):
    prints = spark.range(2000).select((F.col("id") % 2048).alias("fp"))
    links = simhash.links(prints).count()
    assert links <= 2000 * 34


def test_empty_table_and_no_ids(frame):
    assert simhash.near_duplicates(frame([])).count() == 0
    assert simhash.one_per_component(frame([])).count() == 0
    assert simhash.one_per_component(frame([(None, "a b c"), (None, "a b c"), (None, "z y x w")])).count() == 2
