import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from keelson.llm import linededup
from tests.llm import cases


def brute(rows, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_perfect_hash():
    r = np.random.default_rng(3)
    hi, lo = r.integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    n = r.integers(1, 1000, 20_000)
    h = linededup.PerfectHash.load(linededup.PerfectHash.build(hi, lo, n, 5000).dump())
    assert sorted(h.index(hi, lo).tolist()) == list(range(20_000))
    assert (h.count(hi, lo) == n).all()
    assert not h.count(r.integers(0, 2**64, 5000, dtype=np.uint64), r.integers(0, 2**64, 5000, dtype=np.uint64)).any()
    capped = linededup.PerfectHash.build(hi, lo, n, 10)
    assert capped.counts.dtype == np.uint8 and (capped.count(hi, lo) == np.minimum(n, 10)).all()
    with pytest.raises(ValueError):
        linededup.PerfectHash.build(hi[[0, 0]], lo[[0, 0]], n[:2], 10)


def test_few_kept_shards_and_small_probes(spark, monkeypatch):
    """A task as the worker runs it, with many shards of which few are kept."""
    rows = cases.rows()
    folder, shards, full = linededup.build_index(linededup.line_counts(cases.docs(spark)), 10, 1, 20)
    assert shards == len(full) > 5
    monkeypatch.setattr(linededup, "CACHE_BYTES", 5000)
    monkeypatch.setattr(linededup, "PROBE_BYTES", 3000)
    schema = linededup.schema_of(doc_id="long", n_lines="long", n_dropped="long", kept_sha256="string")[1]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([(r[1] or "").encode() for r in part], pa.binary())], names=["doc_id", "t"]) for part in (rows[:10], rows[10:], rows[:0])]
    out = list(linededup._Drop(folder, shards, full, 10, 1, False, schema)(iter(batches)))
    assert len(out) > 1 and len(linededup._kept) < 5
    assert sorted((tuple(r.values()) for b in out for r in b.to_pylist()), key=repr) == sorted(brute(rows, 10), key=repr)


@pytest.mark.parametrize("shard_keys", [40, 500_000])
def test_against_brute_force(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(linededup.build_index, "__defaults__", (1, shard_keys))
    got = linededup.drop_common_lines(cases.clashing(spark), min_docs=10, texts=False).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(brute(cases.rows(), 10), key=repr), key
    assert sum(r["n_dropped"] for r in got) >= 13


def test_two_documents_and_columns(spark):
    docs = cases.clashing(spark)
    out = linededup.drop_common_lines_in_place(docs, min_docs=2)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[103]["text"] is None and got[100]["text"].strip() == ""
    want = {i: s for i, _, _, s in brute(cases.rows(), 2)}
    assert all(hashlib.sha256((r["text"] or "").encode()).hexdigest() == want[i] for i, r in got.items())
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)
    assert linededup.drop_common_lines(cases.empty(spark)).collect() == []


def test_index_has_every_line_and_may_have_fewer(spark):
    counts = linededup.line_counts(cases.docs(spark))
    every = {(r["hi"] & (2**64 - 1), r["lo"] & (2**64 - 1)): r["n"] for r in counts.collect()}
    hi, lo = (np.array(x, np.uint64) for x in zip(*every))
    for least in (1, 10):
        folder, shards, full = linededup.build_index(counts, 10, least)
        assert shards == len(full) == 1
        index = linededup.PerfectHash.load(linededup.get_file(folder, "shard-0"))
        want = np.minimum(np.array([*every.values()]), 10)
        assert (index.count(hi, lo) == np.where(want >= least, want, 0)).all()
        assert len(index.counts) == (want >= least).sum()
    one, ten = (sorted(tuple(r) for r in linededup.drop_common_lines(cases.docs(spark).where("doc_id is not null"), least=x).collect()) for x in (1, 10))
    assert one == ten
