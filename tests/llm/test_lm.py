import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from keelson.llm import lm
from tests.llm import cases


def small_net(n=40):
    return lm.Net(np.sort(np.random.default_rng(0).integers(1, 100, n).astype(float))[::-1], classes=5, hidden=6)


def test_probabilities_sum_to_one():
    net = small_net()
    h = np.random.default_rng(1).standard_normal((3, 6)).astype(np.float32)
    total = np.zeros(3)
    for token in range(40):
        total += np.exp(net.output(h, np.full(3, token), False)[0])
    assert np.allclose(total, 1, atol=1e-4)


def test_gradients():
    net = small_net()
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    r = np.random.default_rng(2)
    ids, target = r.integers(0, 40, (4, 3)), r.integers(0, 40, 12)
    fresh = np.zeros((4, 3), bool)
    fresh[0] = True
    fresh[2, 1] = True

    def loss():
        hs, _, kept = net.steps(ids, fresh, np.zeros((3, 6)), True)
        lp, dh, grads = net.output(hs.reshape(12, 6).astype(float), target, True)
        return -lp.sum(), hs, kept, dh, grads

    _, hs, kept, dh, grads = loss()
    grads |= net.backward(dh.reshape(4, 3, 6), ids, fresh, kept)
    for name in ("u", "wc", "wo", "b", "bo", "bc"):
        at = tuple(s // 2 for s in net.p[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()[0]
        net.p[name][at] = old - 1e-3
        down = loss()[0]
        net.p[name][at] = old
        assert math.isclose((up - down) / 2e-3, grads[name][at], rel_tol=2e-2, abs_tol=2e-3), name
    tokens, g = grads["e"]
    t = tokens[0]
    net.p["e"][t, 3] += 1e-3
    up = loss()[0]
    net.p["e"][t, 3] -= 2e-3
    down = loss()[0]
    assert math.isclose((up - down) / 2e-3, g[0, 3], rel_tol=2e-2, abs_tol=2e-3)


def test_state_crosses_windows_and_stops_at_documents():
    net = small_net()
    docs = [np.random.default_rng(i).integers(0, 40, n) for i, n in enumerate((0, 1, 7, 50, 130, 3))]
    alone = [net.read([d], 0, 1, 1000)[0] for d in docs]
    for lanes, steps in ((1, 3), (2, 16), (4, 64), (99, 5)):
        assert np.allclose(net.read(docs, 0, lanes, steps), alone, rtol=1e-4)


def test_pieces_in_learning_cover_every_token(monkeypatch):
    docs = [np.random.default_rng(i).integers(0, 40, n) for i, n in enumerate((0, 7, 15, 16, 17, 130))]
    monkeypatch.setattr(lm, "LEARN_TOKENS", 16)
    net = small_net()
    pieces = net.read(docs, 0, 4, 8, 0.0)  # no step is taken, but documents are cut
    whole = []
    for d in docs:
        seen, to_tell, total = [0, *d], [*d, 0], 0.0
        for a in range(0, len(seen), 16):
            ids = np.array(seen[a : a + 16])[:, None]
            hs, _, _ = net.steps(ids, np.zeros(ids.shape, bool), np.zeros((1, 6), np.float32), False)
            total += net.output(hs[:, 0], np.array(to_tell[a : a + 16]), False)[0].sum()
        whole.append(total)
    assert np.allclose(pieces, whole, rtol=1e-4)


def tokens(text):
    return [*re.findall("[^ \t-\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), ""]


def test_base_score_and_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(i, t) for i, t, *_ in cases.rows() if i and i > 100]
    rows = [(i + 10_000 * (k >= 200), t) for k, (i, t) in enumerate(rows)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {}
    for r in lm.score_documents(table, head=500).collect():
        got.setdefault(r["doc_id"], r)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    base = score = 0.0
    for i, t in rows:
        w = tokens(t)
        r = got[i]
        want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9, abs_tol=1e-9) and r["score"] < 0
        if r["held_out"] and i < 10_000:
            base, score = base + r["base_score"], score + r["score"]
    assert score > base


def test_odd_tables(spark):
    assert lm.score_documents(cases.empty(spark)).collect() == []
    assert lm.score_documents(cases.clashing(spark)).count() == len(cases.rows())
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in one] == [(3, 0, 0)] and one[0]["score"] < 0


def test_a_frequent_word_of_held_out_documents_only_is_split(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    table = spark.createDataFrame([(i, f"only {i}" if held(i) else f"a b c{i % 50}") for i in range(9000)], "doc_id bigint, text string").repartition(6)
    small = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "1k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "shuffle.partitions": "8"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(f"spark.sql.{k}", v)
        scores = lm.score_documents(table)
        got = {r["doc_id"]: r for r in scores.collect()}
        plan = scores._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
    assert "skew=true" in plan
    assert len(got) == 9000 and all((r["n_tokens"], r["n_known"]) == ((3, 1) if held(i) else (4, 4)) for i, r in got.items())


def test_products_in_blocks(monkeypatch):
    r = np.random.default_rng(3)
    a, b, c = r.standard_normal((50, 7)), r.standard_normal((7, 9)), r.standard_normal((50, 4))
    monkeypatch.setattr(lm, "PRODUCT", 100)
    assert np.allclose(lm.product(a, b), a @ b) and np.allclose(lm.inner(a, c), a.T @ c)
    assert lm.product(a[:0], b).shape == (0, 9)


def plain_score(net, words, docs):
    """Gates, states and both softmaxes written out for one token after the other."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    n, out = net.h, []
    for doc in docs:
        h, before, total = np.zeros(n), words.end, 0.0
        for token in [*doc, words.end]:
            x, hu = p["e"][before] + p["b"], h @ p["u"]
            z, r = 1 / (1 + np.exp(-(x[:n] + hu[:n]))), 1 / (1 + np.exp(-(x[n : 2 * n] + hu[n : 2 * n])))
            new = np.tanh(x[2 * n :] + r * hu[2 * n :])
            h = z * h + (1 - z) * new
            c = net.class_of[token]
            a = h @ p["wc"] + p["bc"]
            s, e = net.starts[c], net.starts[c + 1]
            w = p["wo"][s:e] @ h + p["bo"][s:e]
            total += a[c] - np.log(np.exp(a).sum()) + (w[token - s] - np.log(np.exp(w).sum()) if e - s > 1 else 0)
            before = token
        out.append(total)
    return out


def test_words_are_as_split():
    texts = ["  Foo bar\x1cx \t\n baz ", "", "   ", "É\xa0a B", "x", "\x0b\x0cq\r\nUNKNOWN thing"]
    for part in (pa.array(texts), pa.array(["junk", *texts, "z"]).slice(1, 6)):
        flat, ends = lm.flat_words(part)
        starts = [0, *ends[:-1]]
        assert [flat.to_pylist()[a:b] for a, b in zip(starts, ends)] == [t.encode().lower().split() for t in texts]
    assert lm.flat_words(pa.array([], pa.string()))[0].to_pylist() == []


def test_against_a_plain_model():
    counts = [(f"w{i}".encode(), 100 - i) for i in range(30)]
    words = lm.Words(counts, np.full(lm.GROUPS, 3.0), 3000, 40, vocabulary=20)
    net = lm.Net(words.freq, classes=4, hidden=5)
    texts = [b"w1 W2 w3 w25 unknown w1", b"", b"w9", b" ".join(b"w%d" % (i * 7 % 30) for i in range(70))]
    docs = [t for t, *_ in words.read(pa.array([t.decode() for t in texts]))]
    for _ in range(3):
        net.read(docs, words.end, 2, 8, 0.1)
    assert np.allclose(net.read(docs, words.end, 3, 16), plain_score(net, words, docs), rtol=1e-4)


def test_scores_do_not_depend_on_partitions_or_chunks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(3))
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
    scores = [sorted((r["doc_id"], r["score"]) for r in lm.score_documents(docs.repartition(n)).collect()) for n in (2, 7)]
    assert [i for i, _ in scores[0]] == [i for i, _ in scores[1]] and len(scores[0]) == 203
    assert np.allclose([s for _, s in scores[0]], [s for _, s in scores[1]], rtol=1e-6)
    words = lm.Words([(b"a", 5), (b"b", 3)], np.full(lm.GROUPS, 1.0), 8, 2)
    net = lm.Net(words.freq)
    monkeypatch.setattr(lm, "loaded", lambda folder, name: {"words": words, "net": net}[name])
    rows = [(i, np.array([i % 2] * i, lm.ID).tobytes()) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([[r[0] for r in rows], [r[1] for r in rows]], names=["row", "ids"])
    whole = {r: s for b in lm._Score("")(iter([batch])) for r, s in zip(b[0].to_pylist(), b[1].to_pylist())}
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 50)
    parts = [b for b in lm._Score("")(iter([batch]))]
    assert len(parts) > 5 and all(math.isclose(whole[r], s, rel_tol=1e-4) for b in parts for r, s in zip(b[0].to_pylist(), b[1].to_pylist()))


def test_a_long_document_is_scored_in_few_windows(monkeypatch):
    """Windows grow when few lanes are left; scores don't depend on them."""
    r = np.random.default_rng(1)
    net = lm.Net(np.arange(40, 0, -1).astype(float))
    docs = [r.integers(0, 40, n).astype(lm.ID) for n in [2000, *[20] * 64]]
    seen = []
    steps = lm.Net.steps
    monkeypatch.setattr(lm.Net, "steps", lambda self, ids, *a: seen.append(ids.shape) or steps(self, ids, *a))
    got = net.read(docs, 0, 64, 16)
    assert len(seen) < 20 and max(a * b for a, b in seen) <= 64 * 16
    monkeypatch.setattr(lm, "LONGER", 1)
    assert np.allclose(got, net.read(docs, 0, 64, 16), rtol=1e-5) and len(seen) > 120
    a = r.standard_normal((50_000, 24)).astype(np.float32)
    assert np.allclose(lm.row_sums(a), a.sum(axis=1), atol=1e-4)
