import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import quality
from tests.llm import cases

SPACE = "[ \t-\r]"


def brute(text):
    words = re.findall("[^ \t-\r]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é#*<|\n\t\x0b\x1c ", max_size=60))
def test_counts(text):
    assert quality.stats_of(text)[:5] == brute(text)


def test_decision_list_is_learned_and_pruned():
    r = np.random.default_rng(0)
    x = {"n_words": r.uniform(0, 1000, 3000), "symbol_pct": r.uniform(0, 50, 3000)}
    bad = (x["symbol_pct"] > 30) & (x["n_words"] < 500)
    rules = quality.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= rule.mask(x, 3000)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()
    assert quality.learn(x, r.uniform(size=3000) < 0.1) == [] or all(q.precision >= 0.9 for q in quality.learn(x, r.uniform(size=3000) < 0.1))
    assert quality.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []


def test_verdicts(spark):
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(20)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    got = quality.quality_verdicts(cases.clashing(spark), labels).collect()
    assert sorted((r["doc_id"], *r[1:6]) for r in got if r["doc_id"] is not None) == sorted((i, *brute(t or "")) for i, t, *_ in cases.rows() if i is not None)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = quality.kept_documents(cases.clashing(spark), labels)
    assert kept.columns == cases.clashing(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
    none = labels.limit(0)
    assert quality.quality_verdicts(cases.empty(spark), none).collect() == [] == quality.kept_documents(cases.empty(spark), none).collect()


def test_more_distinct_words_than_a_product_of_three_holds():
    n = 2_100_000
    ids = np.concatenate([np.arange(n), [5, 6, 7], np.arange(n, n + 3), [n - 2, n - 1, n, n + 1], [5, 6, 8]])
    keys = list(zip(ids[:-2].tolist(), ids[1:-1].tolist(), ids[2:].tolist()))
    twice = Counter(keys)
    hit = set()
    for i, k in enumerate(keys):
        if twice[k] > 1:
            hit |= {i, i + 1, i + 2}
    assert quality.repeated_words(ids) == len(hit) > 0


def test_one_row_for_each_label_comes_to_the_driver(spark, monkeypatch):
    """A labelled doc_id that repeats teaches once: the row of the least statistics."""
    text = lambda n, mark: " ".join(f"w{i}{mark if i % 2 else ''}" for i in range(n))
    docs = spark.createDataFrame([(i, text(60 + i, "#" if i % 2 else "")) for i in range(40)] + [(7, text(300 + i, "")) for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(40)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "learn", lambda x, bad, **how: seen.append((len(bad), sorted(x["n_words"]))) or [])
    quality.fit(docs, labels)
    assert seen == [(40, [60.0 + i for i in range(40)])]
