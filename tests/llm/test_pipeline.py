from collections import Counter

import corpus_pipeline
from keelson.llm import mixing, quality
from tests.llm import cases
from tests.llm.test_linededup import brute as lines_brute
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_quality import brute as stats_brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        seen.append([tuple(r) for r in docs.collect()])
        assert docs.columns == COLUMNS or name == corpus_pipeline.STAGES[-1][0]
    start = {r["doc_id"]: tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = {r[0] for r in seen[0]}
    for i, r in start.items():
        n, _, _, _, repeated = stats_brute(r[1])
        assert not (i in kept and (n < 50 or 100 * repeated > 50 * n))
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1 and i in start and stats_brute(start[i][1])[0] >= 50]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert all(start[r[0]] == r for r in seen[0])
    lines = {i: n - d for i, n, d, _ in lines_brute([r for r in seen[0]], 10)}
    assert {r[0] for r in seen[1]} == kept and all(r[4] == len(r[1]) for r in seen[1])
    assert all(r[1].count("\n") + 1 == max(1, lines[r[0]]) for r in seen[1])
    assert sorted(r[0] for r in seen[2]) == sorted(i for i, n, c in near_brute(seen[1], 5, 80) if i == c)
    assert Counter(seen[3]) == Counter(seen[2])
    assert sorted(r[0] for r in seen[4]) == sorted(r[0] for r in seen[3])
    ran = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    in_order = lambda rows: [(r[0], *r[3:]) for r in sorted(rows, key=lambda r: r[1:3])]
    assert in_order(ran) == in_order(seen[4])
    # the rows' places are those of the mixture
    third = spark.createDataFrame(seen[2], cases.SCHEMA)
    assert [r[0] for r in in_order(ran)] == [r["doc_id"] for r in mixing.mix(third).orderBy("position").collect()]


def test_odd_tables(spark):
    for docs in (cases.clashing(spark), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    near = corpus_pipeline.near_dedup(spark, cases.docs(spark), SF)
    ids = Counter(r["doc_id"] for r in near.collect())
    assert ids[100] == 1 and 101 not in ids and ids[103] == ids[104] == 1 and ids[None] == 1
    assert quality.rejected([]) is not None
