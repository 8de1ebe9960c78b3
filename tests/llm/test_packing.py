import zlib

import numpy as np
import pytest
from conftest_llm import AWKWARD

from cloudsieve.llm import packing


def plain_pieces(text, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = [*slow.encode(text or "", add_special_tokens=False).ids, 0]
    first = len(ids) % capacity or capacity
    starts = [0, *range(first, len(ids), capacity)]
    return [(k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)]))]


def test_tokens_equal_both_libraries():
    import public_tokenizers
    from tokenizers import Tokenizer
    slow = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    encode = packing.encoder()
    texts = [t or "" for _, t in AWKWARD] + ["Don't  do\r\n\tthat <|endoftext|>x 123456 ñß漢字 ​ ", " a" * 500]
    texts += ["".join(chr(c) for c in range(a, a + 256)) for a in range(0, 0xD800, 256)]
    assert all(encode(t) == slow.encode(t, add_special_tokens=False).ids for t in texts)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_places_are_gapless_and_pieces_right(frame, capacity):
    rows = AWKWARD + [(100 + i, "eins zwei drei vier " * (i % 9)) for i in range(60)]
    got = packing.pack(frame(rows), capacity=capacity).toPandas()
    want = [(i, *p) for i, t in rows for p in plain_pieces(t, capacity)]
    have = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(got.doc_id.notna(), None)
    have = [tuple(None if x is None else int(x) for x in r) if r[0] is not None else None for r in have.values.tolist()]
    assert sorted(x for x in have if x) == sorted(x for x in want if x[0] is not None) and len(got) == len(want)
    by = got.sort_values(["sequence_id", "offset"])
    end = by.groupby("sequence_id")["length"].cumsum()
    assert ((end - by.length) == by.offset).all() and end.max() <= capacity
    assert by.sequence_id.nunique() <= -(-by.length.sum() // capacity) * 1.1 + 1


def least_sequences(histogram, capacity):
    """Lower bound: pieces over half a sequence need one each, and smaller ones fill what those leave."""
    n = np.arange(capacity + 1)
    best = -(-int(histogram @ n) // capacity)
    for k in range(capacity // 2 + 1):
        large, middle, small = n > capacity - k, (n <= capacity - k) & (n > capacity / 2), (n <= capacity / 2) & (n >= k)
        free = int(histogram[middle].sum()) * capacity - int((histogram * n)[middle].sum())
        more = max(0, -(-(int((histogram * n)[small].sum()) - free) // capacity))
        best = max(best, int(histogram[large | middle].sum()) + more)
    return best


def test_program_covers_and_is_near_the_bound():
    rng = np.random.default_rng(3)
    for _ in range(5):
        histogram = np.bincount(rng.integers(1, 65, 400), minlength=65).astype(np.int64)
        plan = packing.solve(histogram, 64, rounds=200)
        assert (sum(c * t for c, t in plan) == histogram).all()
        assert all(int(c @ np.arange(65)) <= 64 and t > 0 for c, t in plan)
        used = sum(t for _, t in plan)
        assert used <= least_sequences(histogram, 64) + 2 and used <= sum(t for _, t in packing.best_fit(histogram, 64))
    # three of a kind per sequence, which longest-first filling alone cannot improve on
    histogram = np.zeros(65, np.int64)
    histogram[21] = 300
    assert sum(t for _, t in packing.solve(histogram, 64)) == 100
    assert packing.solve(np.zeros(65, np.int64), 64) == []


def test_empty_table(frame):
    assert packing.pack(frame([])).count() == 0
