"""Byte-level BPE against the tiktoken library, and round trips."""

import base64
import hashlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rolebook.llm import bpe
from rolebook.llm.queries import public_ranks

PATH, PATTERN = public_ranks()
RAW = bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(RAW, PATTERN, kept=50)


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
    return tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(codec, text):
    return codec.encode([text])[0].tolist()


ODD = ["", " ", "a", "it's  I'LL\n\n x", "漢字 \x1c\x85 z", "\U00010ee7a \U00018e27a", "é 🎉🎉 ­", "9" * 5000, "a" * 9000, " \t " * 3000]


@pytest.mark.parametrize("text", ODD)
def test_like_tiktoken(codec, other, text):
    assert ids_of(codec, text) == other.encode_ordinary(text)
    assert codec.decode(ids_of(codec, text)) == text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aAé \n\t'sltº1.= \x1c漢"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_any_text(batch):
    codec, other = _pair()
    ids, at = codec.encode(batch)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [other.encode_ordinary(t) for t in batch]


_made = []


def _pair():
    if not _made:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
        _made.append((bpe.Codec(RAW, PATTERN, kept=200), tiktoken.Encoding("o", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})))
    return _made[0]


def test_split_character(codec):
    ids = ids_of(codec, "\U00012345")
    assert len(ids) > 1
    assert codec.decode(ids[:-1]).startswith("�")
    with pytest.raises(ValueError):
        codec.decode([10**6])


def test_frame(spark, other):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "tie", "x"), (99, None, "y"), (99, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.round_trip(df, PATH, PATTERN).collect()
    want = sorted(
        (-1 if i is None else i, len(e := other.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, e)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t, _ in rows
    )
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in out) == want
    coded = bpe.encode(df, PATH, PATTERN)
    for r in coded.collect():
        assert len(r.ids) == len(r.starts) and (not r.starts or r.starts[0] == 0)
        assert r.starts == sorted(r.starts)
    back = bpe.decode(coded, PATH, PATTERN).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in back) == sorted((-1 if i is None else i, t or "") for i, t, _ in rows)
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).collect() == []
