import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import bpe
from latticework.llm.common import tokenizer_file

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FILE = tokenizer_file("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ours(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.rank_encoder(FILE)[0].encode(texts)]


def test_equals_library_on_odd_texts(theirs):
    texts = ["", " ", "  ", "a", "it's we'll you've I'm 'tis 'll '' '", "x  y\n\n z \t", "\n's", " 's  're", "!'s ''s", "a'", "'r", "'re", "1'd2", " x 　　y", "é" * 300, "ab" * 4000, "😀 👩‍👩‍👧 <|endoftext|>", "\r\n\r\n ", "\x1c\x1d a\x85b", "  a  "]
    assert ours(texts) == [theirs.encode_ordinary(t) for t in texts]
    assert ours(list("".join(texts))) == [theirs.encode_ordinary(t) for t in "".join(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abstremvld'' \n\t1.,!é "), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=8))
def test_equals_library(theirs, texts):
    assert ours(texts) == [theirs.encode_ordinary(t) for t in texts]


def test_every_code_point(theirs):
    texts = ["".join(f"a{c}b {c}1 {c}{c}\n" for c in map(chr, range(at, min(at + 512, 0x110000)))) for at in range(0, 0x20000, 512) if not 0xD800 <= at < 0xE000]
    assert ours(texts) == [theirs.encode_ordinary(t) for t in texts]


def test_library_pieces():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    random.seed(3)
    texts = ["", "It's  a <|endoftext|> test\n\n of\tthings 123's", *("".join(random.choices("abst're' \n1.é", k=200)) for _ in range(50))]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.library_encoder(path).encode(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_with_nulls_and_clashing_columns(spark, theirs):
    rows = [(1, "it's  ok", 5), (2, None, 6), (2, "", 7), (None, "x" * 50_000, 8), (1, "it's  ok", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in bpe.round_trip(df).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted(((k, len(i := theirs.encode_ordinary(t or "")), sha(",".join(map(str, i)).encode()), sha((t or "").encode())) for k, t, _ in rows), key=str)
    assert got == want
    back = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes)) for r in back) == sorted((str(k), (t or "").encode()) for k, t, _ in rows)
    assert bpe.round_trip(df.limit(0)).collect() == []


def test_equal_hashes_of_different_pieces_do_no_harm(theirs, monkeypatch):
    whole = bpe.Encoder._hashes
    monkeypatch.setattr(bpe.Encoder, "_hashes", lambda *a: whole(*a) >> np.uint64(58) | np.uint64(1))
    encoder = bpe.Encoder(bpe.Ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken")))
    random.seed(5)
    for _ in range(3):
        texts = [" ".join("".join(random.choices("abcdé1", k=random.randint(1, 6))) for _ in range(80)) for _ in range(10)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [theirs.encode_ordinary(t) for t in texts]
    assert 0 < len(encoder.points) and len(encoder.long) > 100
