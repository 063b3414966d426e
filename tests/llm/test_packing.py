import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelson.llm import packing
from tests.llm import cases

PATH = P.path("byte_bpe_50k.json")


def placed(plan, counts):
    """(sequence, offset, length) of every piece, by the plan's rows."""
    rows = plan.array().tolist()
    out = []
    for n, c in counts.items():
        own = [r for r in rows if r[0] == n]
        for number in range(c):
            _, begin, each, first, offset = [r for r in own if r[1] <= number][-1]
            k = number - begin
            out.append((first + k // each, offset + k % each * n, n))
    return out


def gapless(places, capacity):
    at = defaultdict(int)
    for s, offset, n in sorted(places):
        assert offset == at[s]
        at[s] += n
    assert max(at.values(), default=0) <= capacity
    return len(at)


def plain_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([7, 12, 30, 64]), st.integers(0, 120))
def test_plan_against_plain_packing(seed, capacity, n):
    r = random.Random(seed)
    top = r.randint(1, capacity)
    lengths = [r.randint(1, top) if r.random() < 0.7 else r.choice([capacity, capacity // 2 or 1, 1]) for _ in range(n)]
    counts = Counter(lengths)
    plan = packing.Plan(counts, capacity)
    places = placed(plan, counts)
    assert Counter(x[2] for x in places) == counts
    used = gapless(places, capacity)
    assert used == plan.sequences and used <= plain_best_fit(lengths, capacity) + 1
    large = [x for x in lengths if x > capacity // 3]
    pairs = Counter(x[0] for x in places if x[2] > capacity // 3)
    assert max(pairs.values(), default=0) <= 2 and len(pairs) == fewest(large, capacity)


def fewest(large, capacity):
    """Sequences for pieces of which two at most fit together: two pointers."""
    large = sorted(large)
    i, j, n = 0, len(large) - 1, 0
    while i <= j:
        i += i < j and large[i] + large[j] <= capacity
        j -= 1
        n += 1
    return n


def test_plan_is_small_for_any_number_of_pieces():
    r = random.Random(3)
    counts = {n: r.randint(1, 10**9) for n in range(1, 2049)}
    plan = packing.Plan(counts, 2048)
    total = sum(n * c for n, c in counts.items())
    assert len(plan.rows) < 200_000 and plan.sequences <= 1.005 * -(-total // 2048)


def test_table(spark, monkeypatch):
    tokens = Tokenizer.from_file(PATH)
    special = "a <|endoftext|> b\n\n  c "
    rows = [*cases.rows(), (300, cases.prose(4000, 5), "en", "s", 0), (301, special, "en", "s", 0), (302, " ".join(["stone"] * 2047), "en", "s", 0), (302, " ".join(["stone"] * 2048), "en", "s", 0)]
    got = [tuple(r) for r in packing.pack(spark.createDataFrame(rows, cases.SCHEMA).repartition(4), PATH, P.PATTERN).collect()]
    want = []
    for doc, text, *_ in rows:
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        at, cuts = 0, []
        while at < len(ids):
            cuts.append((at, min(first if at == 0 else 2048, len(ids) - at)))
            at += cuts[-1][1]
        want += [(doc, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(cuts)]
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    gapless([(r[5], r[6], r[3]) for r in got], 2048)
    assert 50256 in tokens.encode(special, add_special_tokens=False).ids


def test_columns_and_empty(spark):
    out = packing.pack(cases.clashing(spark), PATH, P.PATTERN)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.select("doc_id", "piece").count() >= len(cases.rows())
    assert packing.pack(cases.empty(spark), PATH, P.PATTERN).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab'st1 \n\t\x1c 　é😀-", max_size=80))
def test_ids_are_the_librarys(text):
    ids = packing.loaded(PATH, P.PATTERN)
    assert ids.fast is not None and ids(text) == ids.slow(text)


def test_ids_of_whole_documents():
    import duckdb

    ids = packing.loaded(PATH, P.PATTERN)
    for (text,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE doc_id % 5 = 0").fetchall():
        assert ids(text) == ids.slow(text)


def test_another_kind_of_file_goes_to_the_library():
    ids = packing.Ids(P.path("word_bpe_49k.json"), P.PATTERN)
    assert ids.fast is None and ids("Stone walks") == Tokenizer.from_file(P.path("word_bpe_49k.json")).encode("Stone walks", add_special_tokens=False).ids


def test_cuts():
    assert packing.cut_at(1, 8) == [(0, 1)] and packing.cut_at(8, 8) == [(0, 8)] and packing.cut_at(17, 8) == [(0, 1), (1, 8), (9, 8)]
