import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lagfold.llm.bpe import WordBPE, encode
from lagfold.llm.queries import word_bpe_spec
from lagfold.llm.text import Words

SPEC = word_bpe_spec()
OWN, THEIRS = WordBPE(SPEC), Tokenizer.from_str(SPEC)


def same(text):
    got, spelt = OWN.encode(pa.array([text], pa.string()))
    ids, decoded = got.values.astype("<u4").tobytes(), spelt.values.tobytes().decode()
    want = THEIRS.encode(text or "", add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want, text
    assert decoded == THEIRS.decode(want, skip_special_tokens=False), text


def test_hard_texts():
    for t in ["", None, " \n\t ", "Hello WORLD it's they'll'd I'M", "a\x1cb \x85 c d", "x<|endoftext|>y <|startoftext|>", "<|EndOfText|>", "ΣΑΣ ΟΔΥΣΣΕΥΣ İstanbul ǅ", "été ﬁ ½ ２", "aaaaaaaa" * 50, "日本語 한국어 🙂👍🏽", "ab1234.5,6!!??", "'sss 'ss 's", "ththththinininanananrererere"]:
        same(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aehinrst", min_size=1, max_size=40))
def test_dense_merges(text):
    same(text)


def test_texts_together_and_a_small_cache():
    texts = ["Ab cd ab", None, "x<|endoftext|> Y", "ab \u00a0 q\x1cr", "zz " * 50, "", "É é e\u0301"] * 3
    own = WordBPE(SPEC, cache_words=4, group=3)
    for part in (texts[:9], texts[9:]):
        got, spelt = own.encode(pa.array(part, pa.string()))
        for k, t in enumerate(part):
            want = THEIRS.encode(t or "", add_special_tokens=False).ids
            assert got.values[got.offsets[k] : got.offsets[k + 1]].tolist() == want
            assert spelt.values[spelt.offsets[k] : spelt.offsets[k + 1]].tobytes().decode() == THEIRS.decode(want, skip_special_tokens=False)


def test_frame(spark):
    df = spark.createDataFrame([(1, "Ab cd", "x"), (2, None, "y"), (3, "", "z"), (1, "Ab cd", "x")], "doc_id long, text string, n_tokens string")
    rows = encode(df, SPEC, ids=True, decoded=True).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [1, 1, 2, 3] and rows[2].n_tokens == 0 and rows[2].decoded == ""
    assert rows[0].ids_sha256 == hashlib.sha256(np.array(THEIRS.encode("Ab cd", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    assert encode(df.limit(0), SPEC).count() == 0


def test_words_in_the_thue_morse_order():
    for n in (64, 256, 1024, 4096):
        a = "a"
        while len(a) < n:
            a += a.translate(str.maketrans("ab", "ba"))
        same(f"{a} {a.translate(str.maketrans('ab', 'ba'))} {a.upper()}")


def test_marks_of_all_ages():
    marks = [chr(c) for c in range(0x300, 0x1E950) if unicodedata.combining(chr(c))]
    rng = np.random.default_rng(4)
    for _ in range(300):
        same("".join(str(x) for x in rng.choice(marks, 3)) + "aΣ\U00011935\U00011930" + "".join(str(x) for x in rng.choice(marks, 3)))


def test_words_with_equal_hashes(monkeypatch):
    """Words are told apart by their bytes, within a batch and against known words."""
    monkeypatch.setattr(Words, "hashes", lambda self: (self.ends - self.starts).astype(np.uint64))
    own = WordBPE(SPEC)
    for part in (["one two six", "red", None, "two"], ["fox one", "longer", "six shorter"]):
        got, _ = own.encode(pa.array(part, pa.string()))
        for k, t in enumerate(part):
            assert got.values[got.offsets[k] : got.offsets[k + 1]].tolist() == THEIRS.encode(t or "", add_special_tokens=False).ids
