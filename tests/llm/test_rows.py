import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from keelson.llm import common, neardup, rows
from tests.llm import cases


def test_chosen_rows(spark, tmp_path):
    """The same path for no, few and all rows."""
    path = f"file://{tmp_path}/t"
    spark.range(1000).selectExpr("id", "cast(null as string) as _file").repartition(3).write.parquet(path)
    table = rows.addressed(spark.read.parquet(path).select("id"))
    assert table.select("_file", "_row").distinct().count() == 1000
    for keep in ("false", "id = 5", "id % 7 = 0", "true"):
        picks = table.where(keep).select("_file", "_row")
        folder = rows.choose(picks.union(picks))
        got = sorted(r["id"] for r in table.repartition(5).where(rows.chosen(folder)).collect())
        assert got == sorted(r["id"] for r in table.where(keep).collect())


def test_files_of_many_pages(tmp_path, monkeypatch):
    monkeypatch.setattr(rows, "PAGE", 128)
    monkeypatch.setattr(rows, "KEPT_PAGES", 2)
    folder, draw = f"file://{tmp_path}/bits", random.Random(3)
    picks = sorted({(draw.choice((-5, 0, 7)), draw.randrange(3000)) for _ in range(400)})
    words = Counter()
    for file, row in picks:
        words[file, row // 128, row % 128 // 64] |= 1 << row % 64
    parts = [(*k, v - 2**64 if v >= 2**63 else v) for k, v in sorted(words.items())]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names=["_file", "page", "word", "bits"]) for part in (parts[:50], parts[50:51], parts[51:])]
    (put,) = rows._Put(folder)(iter(batches))
    assert sorted(map(tuple, (r.values() for r in put.to_pylist()))) == sorted({k[:2] for k in words})
    rows.put_list(folder, put.column(0).to_numpy(), put.column(1).to_numpy())
    every = [(f, r) for f in (-5, 0, 7, 9) for r in range(3000)]
    draw.shuffle(every)
    got = rows.mask(folder, np.array([f for f, _ in every]), np.array([r for _, r in every]))
    assert [x for x, m in zip(every, got) if m] == [x for x in every if x in set(picks)]
    assert rows.mask(folder, np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []
    # a page on the list that is gone is an error, and so is a list that is gone; a page that isn't on it has no rows
    gone = next(iter(words))
    (tmp_path / "bits" / rows._name(*gone[:2])).unlink()
    rows._kept.clear()
    with pytest.raises(FileNotFoundError):
        rows.mask(folder, np.array([gone[0]]), np.array([gone[1] * 128]))
    assert not rows.mask(folder, np.array([9]), np.array([0])).any()
    (tmp_path / "bits" / rows.LIST).unlink()
    rows._lists.clear()
    with pytest.raises(FileNotFoundError):
        rows.mask(folder, np.array([9]), np.array([0]))


def test_tables_that_are_no_files_get_places(spark):
    table = rows.addressed(spark.range(100).toDF("id"))
    assert table.columns == ["id", "_file", "_row"] and table.select("_file", "_row").distinct().count() == 100


def test_only_plain_scans_keep_their_places(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(50).write.parquet(path)
    scan = spark.read.parquet(path)
    plain = [scan, scan.where("id > 5").selectExpr("id", "id + 1 as b").repartition(3)]
    other = [scan.selectExpr("id", "explode(array(1, 2)) as x"), scan.join(spark.range(60), "id"), scan.union(scan), scan.distinct(), scan.orderBy("id"), spark.range(9).toDF("id")]
    for tables, written in ((plain, 0), (other, 1)):
        for t in tables:
            with common.folders_made() as made:
                got = rows.addressed(t)
            assert len(made) == written and got.select("_file", "_row").distinct().count() == got.count() == t.count()


def test_rows_that_repeat_are_dropped_where_they_stand(spark):
    docs = spark.createDataFrame([*cases.rows(), *cases.rows()], cases.SCHEMA).repartition(3)
    out = neardup.drop_near_duplicates(docs, 5, 80)
    assert out.columns == docs.columns
    left = Counter(r["doc_id"] for r in out.collect())
    assert left[100] == left[None] == 1 and not {101, 102} & set(left) and left[103] == left[104] == left[105] == 2
    assert neardup.drop_near_duplicates(cases.clashing(spark)).columns == cases.clashing(spark).columns


def test_texts_are_read_twice_also_where_ids_repeat(spark, monkeypatch):
    made = []
    start = neardup._Marks.__init__
    monkeypatch.setattr(neardup._Marks, "__init__", lambda self, *a: (made.append(a), start(self, *a))[1])
    for more in ([], [(100, "another text for the same id " * 9, "en", "a", 0), (None, cases.prose(120, 1), "en", "a", 0)]):
        neardup.near_duplicates(spark.createDataFrame([*cases.rows(), *more], cases.SCHEMA)).collect()
    assert len(made) == 4


def test_hot_keys_are_spread(spark):
    many = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(3000)] + [(9999, None)], "id bigint, k bigint")
    one = spark.createDataFrame([(i, f"v{i}") for i in range(0, 3000, 2)] + [(7, "seven")], "k bigint, v string")
    hot = common.hot_keys(many, "k")
    assert [r["k"] for r in hot.collect()] == [7]
    for how in ("inner", "left"):
        got = common.join_spread(many, one, "k", by="id", hot=hot, how=how)
        want = many.join(one, "k", how)
        assert sorted(map(tuple, got.select("id", "k", "v").collect()), key=repr) == sorted(map(tuple, want.select("id", "k", "v").collect()), key=repr)


def test_folders_are_watched_and_removed(spark):
    with common.folders_made() as made:
        kept = common.written(spark.range(5).toDF("id"), "some")
        common.new_folder(spark, "never-written")
    assert len(made) == 2 and kept.count() == 5
    common.remove_folders(made)
    with pytest.raises(Exception, match="exist"):
        kept.count()
