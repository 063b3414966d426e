import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import bpe
from tests.llm import cases

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab' sé1,\n\t　\U0001f600", max_size=120), st.integers(1, 12))
def test_splitting_changes_nothing(text, size):
    enc = bpe.encoding(RANKS, PATTERN)
    assert bpe.encode(enc, text, size) == enc.encode_ordinary(text)
    assert "".join(p for p, _ in bpe.parts(text, size)) == text


def test_very_long_texts():
    enc = bpe.encoding(RANKS, PATTERN)
    for text in ("x" * 200_000, " " * 300_000 + "a", "a" + "\n" * 200_000, cases.prose(60_000, 5)):
        assert enc.decode_bytes(bpe.encode(enc, text)) == text.encode()
    long = cases.prose(40_000, 6)
    assert bpe.encode(enc, long) == enc.encode_ordinary(long)


def test_table(spark):
    enc = bpe.encoding(RANKS, PATTERN)
    got = bpe.bpe_round_trip(cases.clashing(spark), RANKS, PATTERN, ids=True)
    want = []
    for i, t, *_ in cases.rows():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == sorted(want, key=repr)
    back = bpe.bpe_decode(got, RANKS, PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t, *_ in cases.rows())
    assert bpe.bpe_round_trip(cases.empty(spark), RANKS, PATTERN).collect() == []
