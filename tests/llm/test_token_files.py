import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest_llm import AWKWARD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloudsieve.llm import token_files as T

PLAIN = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
ENCODE = T.encoder()
ODD = "aAé́̀ΣσςßİıŁ日本'sdlmrtv'’ \t\n\x0b\x1c\x85\xa0  　.,!?-<|>0129٣½\U0001f600‍ﬁK"


def plain(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


COMMON = "".join(map(chr, [*range(9, 14), *range(32, 127), *range(192, 256)])) + "'" * 6 + "stremvldd 09"


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from(COMMON), max_size=40) | st.text(st.sampled_from(ODD), max_size=40) | st.text(max_size=40))
def test_piece_by_piece_ids_equal_the_library(text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == plain(text)[:-1]


@pytest.mark.parametrize("text", ["<|endoftext|> a", "x<|startoftext|>y 's", "we'll 'll", "a" * 200, "ẃ ́w", "ΑΣ Σ ΑΣ."])
def test_special_tokens_and_marks(text):
    assert np.frombuffer(ENCODE(text), "<u4").tolist() == plain(text)[:-1]


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(T, "PIECES", 3)
    text = "one two three four two one é è é two"
    assert np.frombuffer(T.encoder.__wrapped__()(text), "<u4").tolist() == plain(text)[:-1]


def test_every_common_character_alone_and_between_letters():
    for c in COMMON:
        for text in (c, f"a{c}b", f"é{c}{c}s", f"'{c}", f"9{c}9"):
            assert np.frombuffer(ENCODE(text), "<u4").tolist() == plain(text)[:-1], text


def expected(rows):
    """Rows (doc_id, start, n_tokens, crc) of a plain pass in order."""
    enc = []
    for r in rows:
        ids = plain(r[1])
        enc.append((r[0], ids, zlib.crc32(np.array(ids, "<u4").tobytes())))
    enc.sort(key=lambda e: (e[0] is not None, e[0] or 0))
    starts = np.cumsum([0] + [len(e[1]) for e in enc])
    return [(i, int(s), len(ids), crc) for (i, ids, crc), s in zip(enc, starts)], [t for _, ids, _ in enc for t in ids]


@pytest.mark.parametrize("encoding,shard", [("dictionary", 32 << 20), ("delta", 20_000)])
def test_round_trip_spans_and_layout(spark, frame, tmp_path, encoding, shard):
    rows = AWKWARD + [(i, f"word{i} of many, {i * 7}") for i in range(20, 400)] + [(40, "same")] * 30
    files = T.write(frame(rows), str(tmp_path / "t"), encoding=encoding, shard_bytes=shard)
    want, stream = expected(rows)
    got = [tuple(r) for r in T.digest(files).orderBy("start").collect()]
    assert got == want
    a, b = 1_000, len(stream) - 1_234
    for start, stop in ((a, b), (0, 1), (b, b + 3), (0, len(stream) + 5), (5, 5)):
        parts = files.span(start, stop).orderBy("start").collect()
        assert [t for p in parts for t in p["ids"]] == stream[start:stop]
    some = files.documents(100, 110).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in some] == list(range(100, 111)) and some[0]["ids"] == plain("word100 of many, 700")
    plan = files.documents(100, 110).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema", 1)[1].split("\n")[0] and "GreaterThanOrEqual(doc_id,100)" in plan
    for name in glob.glob(str(tmp_path / "t/tokens/*.parquet")):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            columns = [meta.row_group(g).column(i) for i in range(meta.num_columns)]
            assert all(c.has_column_index and c.has_offset_index for c in columns)
            ids = next(c for c in columns if c.path_in_schema == "ids.list.element")
            assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in ids.encodings
            assert "DELTA_BINARY_PACKED" in next(c for c in columns if c.path_in_schema == "n_tokens").encodings


def test_row_groups_follow_the_limit(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "GROUP_BYTES", 64 << 10)
    monkeypatch.setattr(T, "PAGE_BYTES", 4 << 10)
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(map(str, rng.integers(0, 10**6, 300)))) for i in range(600)]
    files = T.write(frame(rows), str(tmp_path / "t"), encoding="delta")
    name, = glob.glob(str(tmp_path / "t/tokens/*.parquet"))
    assert pq.ParquetFile(name).metadata.num_row_groups > 3
    assert T.digest(files).count() == 600


def test_empty_table_and_unknown_encoding(spark, frame):
    files = T.write(frame([]))
    assert T.digest(files).count() == 0 and files.span(0, 10).count() == 0 and files.documents(1, 2).count() == 0
    with pytest.raises(ValueError):
        T.write(frame([]), encoding="plain")
