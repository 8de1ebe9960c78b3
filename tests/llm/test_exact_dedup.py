import hashlib
import re

import pytest
from conftest_llm import AWKWARD, rows_of

from cloudsieve.llm.exact_dedup import exact_dedup


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm):
        ids = [j for (j, _), m in zip(rows, norm) if m == n]
        known = [j for j in ids if j is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_bytes", [16 << 20, 1000])
def test_groups_and_kept_rows(frame, group_bytes):
    rows = AWKWARD + [(100 + i, "same text\nagain") for i in range(300)] + [(50, "same  text again")]
    got = exact_dedup(frame(rows), group_bytes=group_bytes)
    assert got.columns.count("kept") == 1 and "_part" in got.columns and "text" in got.columns
    got = got.select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(frame):
    assert exact_dedup(frame([])).count() == 0


def test_native_plan(frame):
    plan = exact_dedup(frame(AWKWARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan


def test_all_ids_null(frame):
    got = exact_dedup(frame([(None, "z"), (None, "z"), (None, "y")])).collect()
    assert [r.keep_id for r in got] == [None] * 3 and sum(r.kept for r in got) == 2
    assert rows_of(got, "group_size") == [1, 2, 2]
