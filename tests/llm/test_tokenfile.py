import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lagfold.llm import tokenfile
from lagfold.llm.queries import op13_token_file, tokenizer_spec

SPEC = tokenizer_spec("byte_bpe_50k.json")
OWN, THEIRS = tokenfile.Encoder(SPEC), Tokenizer.from_str(SPEC)


def ids(text):
    return [*THEIRS.encode(text or "", add_special_tokens=False).ids, 0]


def same(texts, own=OWN):
    got = own.encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert got.values[got.offsets[k] : got.offsets[k + 1]].tolist() == ids(t), repr(t)


def test_hard_texts():
    hard = ["", None, " ", "\n\n\n", "a  b   c", " \n x\n\n y \t", "it's they'll'd I'M 'S", "x  y", "x  y", "x \n\ny", "　\n　 z", "a\x1c b\x1f\n\nc", "q \n\nr   s  t", "a\x85\n\nb"]
    hard += ["x<|endoftext|>y <|endoftext|> \n<|endoftext|>", "<|endoftext", "日本語 한국어 🙂👍🏽", "a" * 500, "ab" * 40 + " " + "ab" * 40, "\x00 \x00\x00 a\x00", "12345 6,7 ½", "é ﬁ"]
    same(hard)
    for t in hard:
        same([t])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t\x0b\x0c\r\x1c\x1e\x85    ​   　ab1.'s<|é界") | st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_any_texts(texts):
    same(texts)


def test_a_table_that_fills(monkeypatch):
    own = tokenfile.Encoder(SPEC, most=5)
    for k in range(20):
        same([f"w{k} x{k % 3} y", "the same words", f"{k} " * 30], own)


def test_chunks_with_equal_hashes(monkeypatch):
    monkeypatch.setattr(tokenfile.Known, "hash", staticmethod(lambda lanes, size: size.astype(np.uint64)))
    own = tokenfile.Encoder(SPEC)
    for part in (["one two six", "red cat", None, "two"], ["fox one", "longer words here", "six shorter"]):
        same(part, own)


def test_files(spark, tmp_path):
    texts = [f"document {k} " + " ".join(f"some {j * k % 997} words" for j in range(60)) for k in range(500)]
    rows = [(k * 3 % 500, texts[k * 3 % 500], k) for k in range(500)] + [(None, "no id", 0), (7, texts[7], 1), (7, None, 1), (7, "", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for coding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        folder = str(tmp_path / coding)
        tokenfile.write(df, folder, SPEC, coding=coding, row_group_bytes=30_000, page_bytes=2_000)
        got = sorted(tokenfile.read(spark, folder).collect(), key=lambda r: r.start)
        assert [r.id for r in got] == [r[0] for r in want]
        start = 0
        for r in got:
            assert r.start == start
            start += r.n_tokens
        assert sorted((r.id is None, r.id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is None, i or 0, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t, _ in want)
        files = [pq.ParquetFile(os.path.join(folder, f)) for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]
        assert max(f.metadata.num_row_groups for f in files) > 1
        column = next(c for c in (files[0].metadata.row_group(0).column(k) for k in range(5)) if c.path_in_schema.startswith("ids"))
        assert name in column.encodings and column.has_offset_index
        assert sorted((r.start, r.n_tokens) for r in tokenfile.places(spark, folder).collect()) == [(r.start, r.n_tokens) for r in got]
        some = {r.id: r.ids for r in tokenfile.tokens(spark, folder, 100, 110).collect()}
        assert some == {k: ids(texts[k]) for k in range(100, 111)}
        whole = [i for r in sorted(tokenfile.span(spark, folder, 0, start).collect(), key=lambda r: r.start) for i in r.ids]
        part = sorted(tokenfile.span(spark, folder, 333, 1234).collect(), key=lambda r: r.start)
        assert len(whole) == start and [i for r in part for i in r.ids] == whole[333:1234] and part[0].start == 333


def test_pages_are_skipped(spark, tmp_path):
    """Places and counts read no token column; a range of ids reads fewer row groups."""
    df = spark.createDataFrame([(k, "word " * 200) for k in range(2000)], "doc_id long, text string")
    tokenfile.write(df, str(tmp_path / "t"), SPEC)
    plan = tokenfile.places(spark, str(tmp_path / "t"))._jdf.queryExecution().toString()
    assert "ids:array" not in plan.split("== Physical Plan ==")[1]
    plan = tokenfile.tokens(spark, str(tmp_path / "t"), 5, 9)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,5)" in plan


def test_empty_and_query(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    tokenfile.write(df, str(tmp_path / "e"), SPEC)
    assert tokenfile.read(spark, str(tmp_path / "e")).count() == 0
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op13_token_file(spark, sf).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        own, x = ids(r.text), got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
