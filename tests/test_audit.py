"""Manifests, journals, pages, versions, trees, files and streams on small golden inputs."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from keelson.operators import audit as A
from keelson.operators import progress as P
from keelson.operators import sinks as K
from keelson.operators import versions as V
from keelson.operators.anchored import anchored_windows
from keelson.sources import listing as L
from keelson.sources import manifest as M
from keelson.sources import ranged
from keelson.sources import synth as S
from keelson.streaming import streams as T


def test_numbered_lines_over_files(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.txt").write_text("".join(f"line {k} {i}\n" for i in range(50 * (3 - k))))
    rows = M.numbered_lines(spark, f"file://{tmp_path}").collect()
    want = [f"line {k} {i}" for k in range(3) for i in range(50 * (3 - k))]
    assert [r["line"] for r in sorted(rows, key=lambda r: r["line_no"])] == want and {r["line_no"] for r in rows} == set(range(1, 301))


def test_entries_and_rows(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x, 1)), "line_no bigint, line string")
    got = {r["line_no"]: tuple(r)[1:] for r in M.resume_entries(lines("", "p", "p|t", "  ", "p|t|u")).collect()}
    assert got == {1: ("", "", None), 2: ("p", "", None), 3: ("p", "t", None), 4: (None, None, "whitespace-only line"), 5: ("p", "t|u", None)}
    got = sorted(tuple(r) for r in M.retry_entries(lines("a", "a\x1fk\x1fv", "a", "a\x1fk")).collect())
    assert got == [("a", "", "", 1), ("a", "k", "v", 2)]
    assert [tuple(r) for r in M.retry_entries(lines().limit(0)).collect()] == [("", "", "", 0)]
    with pytest.raises(Exception, match="malformed"):
        M.retry_entries(lines("a\x1fk"), strict_lines=True).collect()
    rows = {r["line_no"]: r for r in M.cleanup_rows(lines("b\x1fk%2F\x1fnull", "", "b\x1f%zz\x1fv", "torn", "b\x1fk\x1fv\x1f2020"), F.lit(True)).collect()}
    assert set(rows) == {1, 3, 4, 5} and rows[1]["key"] == "k/" and rows[1]["version_id"] == "null" and rows[3]["reason"] == "bad encoding" and rows[4]["reason"] == "wrong number of fields" and rows[5]["last_modified"] == "2020"
    with pytest.raises(Exception, match="malformed journal line 2"):
        M.journal_events(lines("done|a", "nope")).collect()
    assert M.journal_events(lines("done|a", "curs"), torn_tail=True).count() == 1
    with pytest.raises(Exception, match="malformed line 1"):
        M.strict(M.split_manifest(lines("x"), "b")).collect()


def test_torn_file(spark, tmp_path):
    (tmp_path / "a").write_text("done|x\ncurs")
    (tmp_path / "b").write_text("done|x\n")
    assert M.ends_torn(spark, f"file://{tmp_path}/a") and not M.ends_torn(spark, f"file://{tmp_path}/b")


def test_page_positions(spark):
    def at(pages, terminals):
        p = spark.createDataFrame(pages, "prefix string, seq int, obj_count bigint, next_token string")
        t = spark.createDataFrame(terminals, "prefix string, seq int")
        return [tuple(r) for r in P.positions(P.page_outstanding(p, t)).collect()]

    assert at([("p", 0, 3, "T1")], [("p", 0)] * 3) == [("p", 0, "T1", False)]
    assert at([("p", 0, 3, "T1"), ("p", 1, 1000, "T2")], [("p", 0)] * 3 + [("p", 1)] * 400) == [("p", 0, "T1", False)]
    assert at([("p", 0, 3, "T1"), ("p", 1, 1000, "")], [("p", 0)] * 4 + [("p", 1)] * 1000 + [("q", 0), ("p", 9)]) == [("p", 1, "", True)]
    assert at([("p", 0, 3, "T1"), ("p", 1, 0, "T2")], []) == [("p", -1, "", False)]


def test_version_pages_and_deletion(spark):
    rows = [("b", "k1", "v2", False, "2024-01-02"), ("b", "k1", "v1", True, "2024-01-01"), ("b", "k2", "null", True, "2024-01-05")]
    v = spark.createDataFrame(rows, "bucket string, key string, version_id string, is_delete_marker boolean, last_modified string").withColumn("last_modified", F.col("last_modified").cast("timestamp"))
    tail = V.page_tails(v.withColumns({"prefix": F.lit("p"), "page": F.lit(1)}).where("key = 'k1'")).first()
    assert (tail["tail_key"], tail["tail_version"]) == ("k1", "v1")
    after = {(r["key"], r["version_id"]) for r in L.versions_after(v, "k1", "v2").collect()}
    assert after == {("k1", "v1"), ("k2", "null")}
    markers = v.where("is_delete_marker")
    once = V.deleted(v, markers)
    assert once.count() == 1 == V.deleted(once, markers).count()
    assert {r["state"] for r in V.states(markers, once).collect()} == {"absent"}


def test_traversals_agree(spark):
    keys = ["a", "a/b", "a/b/c", "d/", "d/e", "x//y", "z"]
    inv = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, size bigint")
    assert {r[0] for r in L.prefixes(inv).collect()} == {"", "a/", "a/b/", "d/", "x/", "x//"}
    assert sorted(r["key"] for r in L.two_phase(inv).collect()) == sorted(keys) == sorted(r["key"] for r in L.walk(inv)[0].collect())
    assert {tuple(r) for r in L.one_level(inv, "a/").collect()} == {("object", "a/b"), ("prefix", "a/b/")}
    usage = {r["prefix"]: tuple(r)[1:] for r in L.usage(inv).collect()}
    assert usage[""] == (7, 6, 21) and usage["a/"] == (2, 2, 3) and usage["x//"] == (1, 1, 5)
    pages = sorted(tuple(r) for r in L.pages(inv.select(F.lit("p").alias("prefix"), F.col("key").alias("entry")), 3).collect())
    assert pages == [("p", 1, 3, "a", "a/b/c", True), ("p", 2, 3, "d/", "x//y", True), ("p", 3, 1, "z", "z", False)]


def test_key_tree(spark):
    trees = spark.createDataFrame([(1, "data", 1, 3, 2), (2, "", 2, 2, 1), (3, "data/", 3, 4, 3)], "tree bigint, prefix string, depth int, width int, files int")
    keys = {}
    for r in S.tree_keys(trees).orderBy("tree", "idx").collect():
        keys.setdefault(r["tree"], []).append(r["key"])
    assert keys[1] == [f"data/l1/{d}file_{f}" for d in ("", "d1/", "d2/", "d3/") for f in (1, 2)]
    assert keys[2] == ["l1/file_1", "l1/d1/file_1", "l1/l2/file_1", "l1/l2/d1/file_1", "l1/l2/d2/file_1"]
    assert len(keys[3]) == 39 and len(set(keys[3])) == 39
    body = spark.range(50).select(F.col("id"), S.body(F.lit("k"), F.col("id")).alias("b")).collect()
    assert all(len(r["b"]) == r["id"] for r in body)


def test_ranged_reads_and_copies(spark, tmp_path):
    data = os.urandom(10_000)
    (tmp_path / "src").write_bytes(data)
    probes = spark.createDataFrame([(f"file://{tmp_path}/src", s, n) for s, n in ((0, 10), (9_990, 128), (20_000, 5), (5, 0))], "path string, start bigint, length bigint")
    assert {(r["start"], r["length"]): bytes(r["body"]) for r in ranged.read_ranges(probes).collect()} == {(0, 10): data[:10], (9_990, 128): data[-10:], (20_000, 5): b"", (5, 0): b""}
    copy = spark.createDataFrame([("k", f"file://{tmp_path}/src", f"file://{tmp_path}/to/dst", [0, 4000, 8000], 10_000)], "key string, source string, target string, offsets array<bigint>, size bigint")
    import hashlib

    parts = b"".join(hashlib.md5(p).digest() for p in (data[:4000], data[4000:8000], data[8000:]))
    assert ranged.copy_objects(copy).first()["dst_etag"] == hashlib.md5(parts).hexdigest() + "-3"
    assert (tmp_path / "to/dst").read_bytes() == data


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("o1", "ok_objects", "b|k1"), ("o2", "mp", "b|k2")], "owner_dir string, result string, line string")
    K.write_owner_lines(rows, f"file://{tmp_path}/out")
    (run,) = (tmp_path / "out/runs").iterdir()
    assert sorted(p.name for p in run.iterdir() if p.is_dir()) == ["owner_dir=o1", "owner_dir=o2"]
    assert sorted((r["owner_dir"], r["line"]) for r in K.read_lines(spark, f"file://{tmp_path}/out", "owner_dir string, result string").collect()) == [("o1", "b|k1"), ("o2", "b|k2")]
    assert K.run_folder("/a/b//", datetime.datetime(2024, 1, 2, 3, 4, 5)) == "/a/b_20240102_030405"
    at = datetime.datetime(2024, 1, 2)
    K.archive(rows.select("line"), f"file://{tmp_path}", "in", at)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        K.archive(rows.select("line"), f"file://{tmp_path}", "in", at)


def test_health_and_windows(spark):
    state, log = (0, False, 0), []
    for fault in (1, 1, 1, 0, 1, 0, 0, 1, 1, 0, 1):
        state, change = T.health_step(state, bool(fault), 3, 2)
        log.append(change)
    assert log == ["", "", "isolated", "", "", "", "readmitted", "", "", "", "isolated"]
    base = datetime.datetime(2024, 1, 1)
    calls = [(1, i, base + datetime.timedelta(seconds=s), float(s)) for i, s in enumerate((0, 59, 60, 119, 125, 200))]
    df = spark.createDataFrame(calls, "worker bigint, call_id bigint, ts timestamp, latency_ms double")
    got = sorted(tuple(r) for r in anchored_windows(df).collect())
    assert [(r[1] - base).total_seconds() for r in got] == [0, 60, 125, 200] and [r[2] for r in got] == [2, 2, 1, 1]
    closed = sorted(tuple(r) for r in T.drained(T.anchored_stream(T.as_stream(df, 1))).collect())
    assert closed == got[:-1]


def test_streams_agree_with_batches(spark):
    from keelson.plans.fixtures import view

    calls = view(spark, "/root/testdata/sf0.001", "f5_calls")
    batch = sorted(tuple(r) for r in T.node_health(calls).collect())
    assert batch == sorted(tuple(r) for r in T.drained(T.node_health_stream(T.as_stream(calls, 1))).collect()) and batch


def test_check_in_each_mode(spark):
    body = "x" * 3000
    sign = "1000;chunk-signature=" + "0" * 64 + "\r\n"
    md5 = "0" * 32
    rows = [("b", "whole", md5, 3000, "o", body), ("b", "head", f'"{md5}"', 3085, "o", sign + body), ("b", "mid", f"{md5}-2-0|1500", 3085, "o", body[:1500] + sign + body[1500:]), ("b", "plain-mp", f"{md5}-2", 3000, "o", body), ("b", "a|b", md5, 3, "o", "abc"), ("b", "none", md5, 0, "o", "")]
    inv = spark.createDataFrame(rows, "bucket string, key string, etag_raw string, size bigint, owner_id string, body string")
    at = lambda mode, seg=0: {r["key"]: r["result"] for r in A.check(inv, mode, seg).collect()}
    one = {"whole": "ok_objects", "head": "corrupted_objects", "a|b": "invalid_keys", "none": "ok_objects"}
    assert at("off") == one | {"mid": "mp", "plain-mp": "mp"}
    assert at("offset") == one | {"mid": "corrupted_mp", "plain-mp": "list_parse_failed"}
    assert at("segment", 1500) == one | {"mid": "corrupted_mp", "plain-mp": "ok_mp"}
    line = {r["key"]: r["line"] for r in A.check(inv, "offset").collect()}
    assert line["mid"] == "b|mid|2|0|1500" and line["whole"] == "b|whole"


def test_copies_that_fail_leave_nothing(spark, tmp_path):
    (tmp_path / "src").write_bytes(b"0123456789")
    at = lambda n: f"file://{tmp_path}/{n}"
    rows = [("ok", at("src"), at("a/ok"), [0, 5], 10), ("empty part", at("src"), at("a/e"), [0, 5, 5], 10), ("no last part", at("src"), at("a/l"), [0, 10], 10), ("short", at("src"), at("a/s"), None, 12), ("short part", at("src"), at("a/p"), [0, 20], 30), ("gone", at("none"), at("a/g"), None, 1), ("zero", at("src"), at("a/z"), None, 0)]
    got = {r["key"]: (r["dst_etag"], r["error"]) for r in ranged.copy_objects(spark.createDataFrame(rows, "key string, source string, target string, offsets array<bigint>, size bigint")).collect()}
    assert {k for k, (etag, _) in got.items() if etag} == {"ok", "zero"} and all(e for k, (_, e) in got.items() if k not in ("ok", "zero"))
    assert "length 0" in got["empty part"][1] and "ends at 10" in got["short"][1]
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["ok", "z"]


def test_backup_job(spark, tmp_path):
    import hashlib

    md5 = lambda b: hashlib.md5(b).hexdigest()
    bodies = {"one": b"x" * 10, "two": b"y" * 10, "short": b"z" * 4, "drift": b"d", "tiny": b"t"}
    composite = md5(hashlib.md5(b"y" * 5).digest() * 2) + "-2"
    manifest = spark.createDataFrame([("one", False, None), ("two", True, [0, 5]), ("short", False, None), ("drift", True, [0]), ("gone", False, None), ("tiny", True, [0, 0])], "key string, is_multipart boolean, offsets array<bigint>")
    head = spark.createDataFrame([("one", md5(bodies["one"]), 10), ("two", composite, 10), ("short", md5(b"z" * 10), 10), ("drift", md5(b"d"), 1), ("tiny", md5(b"t") + "-2", 1)], "key string, etag string, size bigint")
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in bodies.items()], "key string, body binary")
    source, target = f"file://{tmp_path}/bucket", f"file://{tmp_path}/copies"
    assert ranged.store_objects(rows, source) == 5
    got = {r["key"]: (r["result"], r["stage"]) for r in A.backup(manifest, head, source, target).collect()}
    assert got == {"one": ("backup_ok", ""), "two": ("backup_ok", ""), "short": ("backup_failed", "upload"), "drift": ("mismatch", ""), "gone": ("backup_failed", "head"), "tiny": ("backup_failed", "upload")}
    assert {p.name: p.read_bytes() for p in (tmp_path / "copies").iterdir()} == {"one": bodies["one"], "two": bodies["two"]}


def test_a_failed_archive_stops_the_job(spark, tmp_path, monkeypatch):
    from keelson.plans import queries_audit

    made = []
    monkeypatch.setattr(queries_audit.A, "backup", lambda *a: made.append(a))
    monkeypatch.setattr(queries_audit, "new_folder", lambda *a: f"file://{tmp_path}/job")
    run = queries_audit.backed_up

    def v(what):
        from keelson.plans.fixtures import view

        return view(spark, "/root/testdata/sf0.001", what)

    v.spark = spark
    run(v)
    assert len(made) == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        run(v)  # the list of that name is there
    assert len(made) == 1


def test_rows_under_entries(spark):
    keys = ["a", "a/1", "a/2", "ab/1", "b", "b/é/x", "", None, "a/2"]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n int")
    got = lambda e: sorted(r["n"] for r in L.resumed(rows, spark.createDataFrame(e, "prefix string, token string")).collect())
    assert got([("a", "a/1"), ("a/", "")]) == [1, 2, 3, 8] and got([("", "b")]) == [5] and got([("b/é/", None)]) == [5] and got([]) == []
    under = lambda e: sorted(r["n"] for r in L.under_entries(rows, spark.createDataFrame([(x,) for x in e], "prefix string")).collect())
    assert under(["a", "a/"]) == [0, 1, 2, 3, 8] and under([""]) == [0, 1, 2, 3, 4, 5, 6, 8]


def test_streaks_and_numbers_across_ranges(spark):
    import random

    draw = random.Random(2)
    rows = [(i, w, draw.choice((200, 500, 500, 0))) for i, w in enumerate(draw.choices((0, 0, 0, 1, 2), k=400))] + [(1000 + i, 3, 500) for i in range(50)]
    calls = spark.createDataFrame(rows, "call_id bigint, worker bigint, http_code int").repartition(7)
    want, run = {}, {}
    for i, w, code in rows:
        want[i] = run.get(w, 0)
        run[w] = 0 if code == 200 else run.get(w, 0) + 1
    got = P.failure_streaks(calls).collect()
    assert {r["call_id"]: r["streak"] for r in got} == want and all(r["slow"] == (r["streak"] >= 3) for r in got)
    places = [r["row_no"] for r in sorted(L.ordered(calls, [F.col("call_id")]).collect(), key=lambda r: r["call_id"])]
    assert places == list(range(1, 451))
