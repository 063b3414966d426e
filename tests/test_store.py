"""Objects under any key in a store, its listing, and comparison of whole buckets."""

import os
import random

import pytest
from pyspark.sql import functions as F

from keelson.operators import compare
from keelson.sources import listing as L
from keelson.sources import ranged, store

KEYS = ["a", "a/b", "a/b/c", "../outside", ".", "..", "x//y", "x/", "/", "/lead", "sp ace/é%2F+~*", "long/" + "n" * 700 + "/" + "m" * 201, "n" * 200, "~", "+/+", "%", "ü" * 100]


def test_any_key_is_one_object_inside_the_folder(spark, tmp_path):
    (tmp_path / "outside").write_text("mine")
    rows = spark.createDataFrame([(k, bytearray(k.encode() * 2)) for k in KEYS], "key string, body binary")
    folder = f"file://{tmp_path}/bucket"
    assert ranged.store_objects(rows, folder) == len(KEYS)
    assert (tmp_path / "outside").read_text() == "mine" and len({ranged.object_name(k) for k in KEYS}) == len(KEYS)
    paths = {r["key"]: r["p"] for r in rows.select("key", ranged.object_path(folder).alias("p")).collect()}
    assert paths == {k: f"{folder}/{ranged.object_name(k)}" for k in KEYS}
    assert max(len(p) for p in "/".join(map(ranged.object_name, KEYS)).split("/")) <= 255
    read = ranged.read_ranges(rows.select(ranged.object_path(folder).alias("path"), F.lit(0).alias("start"), F.lit(5000).alias("length")))
    assert {bytes(r["body"]) for r in read.collect()} == {k.encode() * 2 for k in KEYS}
    found = store.listed(spark, folder).collect()
    assert {r["entry"]: r["size"] for r in found if r["kind"] == "object"} == {k: 2 * len(k.encode()) for k in KEYS}
    inv = spark.createDataFrame([(k, 1) for k in KEYS], "key string, size bigint")
    assert sorted(r["entry"] for r in found if r["kind"] == "prefix") == sorted(r["prefix"] for r in L.prefixes(inv).collect() if r["prefix"])


def test_a_shared_folder_may_be_a_plain_path(spark, tmp_path):
    rows = spark.createDataFrame([(k, bytearray(k.encode() * 2)) for k in [*KEYS, "what?#%41:x"]], "key string, body binary")
    want = {r["key"]: len(r["body"]) for r in rows.collect()}
    for folder in (f"{tmp_path}/plain", f"{tmp_path}//twice", f"file:{tmp_path}/short", f"{tmp_path}/odd %2B+"):
        assert ranged.store_objects(rows, folder) == len(want)
        found = store.listed(spark, folder).collect()
        assert {r["entry"]: r["size"] for r in found if r["kind"] == "object"} == want
        assert {r["kind"] for r in found} == {"object", "prefix"} and "a/b/" in {r["entry"] for r in found}
        read = ranged.read_ranges(rows.select(ranged.object_path(folder).alias("path"), F.lit(0).alias("start"), F.lit(5000).alias("length")))
        assert {bytes(r["body"]) for r in read.collect()} == {k.encode() * 2 for k in want}
    assert (tmp_path / "plain" / ranged.object_name("a/b")).read_bytes() == b"a/ba/b"


def test_a_failing_prefix_leaves_its_siblings(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(k, bytearray(b"x")) for k in ("a/1", "b/1", "b/c/2", "d")], "key string, body binary")
    ranged.store_objects(rows, f"file://{tmp_path}/bucket")
    os.rename(tmp_path / "bucket/b+", tmp_path / "elsewhere")
    os.symlink(tmp_path / "bucket/loop", tmp_path / "bucket/loop")
    plain = list(store.entries_of(f"file://{tmp_path}/bucket", ""))
    assert ("prefix", "a/", "a+/", None, None) in plain
    got = [b.to_pylist() for b in store._list(f"file://{tmp_path}/bucket")(iter([spark_batch(["b+/", "a+/"])]))]
    assert [r["kind"] for rs in got for r in rs] == ["list_failed", "object"] and got[0][0]["error"]


def spark_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["place"])


def plain(a, b):
    out = []
    for k in {r[0] for r in a} | {r[0] for r in b}:
        x, y = (sorted((r[1:] for r in t if r[0] == k), key=repr) for t in (a, b))
        if x != y:
            out.append((k, "only_source" if not y else "only_target" if not x else "differs"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits,levels", [(12, 2), (3, 1), (2, 3)])
def test_buckets_against_a_plain_comparison(spark, bits, levels):
    r = random.Random(bits)
    a = [(f"k{i}", f"e{r.randrange(3)}", r.randrange(3)) for i in range(300)] + [(None, None, 1), ("twice", "x", 1), ("twice", "x", 1), ("swap", None, 5), ("null", None, None)]
    b = [(k, e if r.random() > 0.05 else None, s) for k, e, s in a if r.random() > 0.05] + [("new", "e", 1), ("twice", "x", 1), ("null", "", None)]
    df = lambda rows: spark.createDataFrame(rows, "key string, etag string, size bigint").repartition(3)
    got = compare.compare_buckets(df(a), df(b), ["etag", "size"], bits, levels).collect()
    assert sorted(((x["key"], x["status"]) for x in got), key=repr) == plain(a, b)
    assert compare.compare_buckets(df(a), df(a), ["etag", "size"], bits, levels).collect() == []
    assert compare.compare_buckets(df(a).limit(0), df(a).limit(0), ["etag", "size"]).collect() == []


def test_only_ranges_that_differ_are_opened(spark):
    a = spark.range(100_000).selectExpr("concat('k', id) as key", "md5(cast(id as string)) as etag", "id as size")
    b = a.withColumn("size", F.when(F.col("key").isin("k17", "k90000"), 1).otherwise(F.col("size"))).where("key <> 'k5'")
    both = [compare.hashed(t, ["etag", "size"]) for t in (a, b)]
    slots = compare.differing(*both, bits=6, levels=3)
    assert 1 <= slots.count() <= 3 and compare.within(both[0], slots, 3, 6).count() < 20
    assert sorted(r["key"] for r in compare.compare_buckets(a, b, ["etag", "size"]).collect()) == ["k17", "k5", "k90000"]


def test_no_more_rows_reach_the_first_shuffle_than_the_table_has(spark):
    """Tree totals: rows are added up by their directory before anything is multiplied by its depth."""
    inv = spark.createDataFrame([(f"{'d/' * (i % 9)}f{i}", 1) for i in range(500)], "key string, size bigint")
    for df in (L.usage(inv), L.prefixes(inv)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = [i for i, line in enumerate(plan) if "Generate" in line]
        grouped = [i for i, line in enumerate(plan) if "Aggregate" in line]
        assert depth and max(depth) < max(grouped)  # the lowest operation over the table is the grouping
