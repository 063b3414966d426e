"""The queries that take whole tables, against brute force in Python at the smallest scale."""

import hashlib

import __spark_entry__
from keelson.plans import fixtures, queries_listing
from keelson.sources import synth

SF = "/root/testdata/sf0.001"
QUERIES = __spark_entry__.queries()


def md5(b):
    return hashlib.md5(b).hexdigest()


def test_relays(spark):
    rows = [r for r in fixtures.view(spark, SF, "f1_inventory").select("key", "body", "size").collect() if "|" not in r["key"]]
    bodies = {r["key"]: r["body"].encode() for r in rows}
    assert len(bodies) == len(rows) > 100
    got = QUERIES["k14_relay_regular_whole"](spark, SF).collect()
    assert len(got) == len(rows) and {r["key"]: r["dst_etag"] for r in got} == {k: md5(b) for k, b in bodies.items()}
    want = {}
    for r in rows:
        if r["size"] > 1:
            b, half = bodies[r["key"]], r["size"] // 2
            want[r["key"]] = md5(b"".join(hashlib.md5(x).digest() for x in (b[:half], b[half:]))) + "-2"
    got = QUERIES["k15_relay_multipart_whole"](spark, SF).collect()
    assert len(got) == len(want) and {r["key"]: r["dst_etag"] for r in got} == want


def test_bodies(spark):
    def v(what):
        return fixtures.view(spark, SF, what)

    keys = queries_listing.sized_keys(v).select("tree", "idx", "key", "size").collect()
    body = {(k["tree"], k["idx"]): "".join(md5(f"{k['key']}:{i}".encode()) for i in range(-(-k["size"] // 32)))[: k["size"]].encode() for k in keys}
    assert len({k["tree"] % 10 for k in keys}) > 1
    got = QUERIES["s20_bodies_whole"](spark, SF).collect()
    assert len(got) == len(keys) and {(r["tree"], r["idx"]): (r["n"], r["body_md5"]) for r in got} == {k: (len(b), md5(b)) for k, b in body.items()}
    got = sorted(r["line"] for r in QUERIES["c8_synthetic_bucket_whole"](spark, SF).collect())
    assert got == sorted(f"bkt{k['tree']}|{k['key']}|{md5(body[k['tree'], k['idx']])}" for k in keys)


def test_keys_of_one_tree_spread(spark):
    """Parameters are read in one task, whatever grows from them; a tree without files has no keys."""
    trees = spark.createDataFrame([(1, "a/", 20, 10, 30), (2, "b", 3, 2, 0)], "tree bigint, prefix string, depth int, width int, files int").coalesce(1)
    parts = [[r["idx"] for r in part] for part in synth.tree_keys(trees).select("idx").rdd.glom().collect()]
    assert sorted(i for part in parts for i in part) == list(range(30 * 201))
    assert sum(bool(part) for part in parts) > 1 and max(map(len, parts)) < 30 * 201 * 0.7
