"""Golden cases of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from keelson.functions import rules as R

MD5 = "0123456789abcdef0123456789abcdef"


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("x")).collect()]


def test_etag_class(spark):
    rows = [(MD5,), (MD5 + "-2",), (MD5.upper(),), ("short",), ("",), (MD5 + "\n",)]
    assert values(spark, rows, "e string", R.is_normal_etag(F.col("e"))) == [True] + [False] * 5
    assert values(spark, [('"a"',), ('"',), ("a",), ('""',), ('"a',)], "e string", R.trim_quotes(F.col("e"))) == ["a", '"', "a", "", '"a']


def test_offset_etags(spark):
    cases = [
        (f"{MD5}-3-0|5242880|10485760", 10485760, [0, 5242880, 10485760]), (f"{MD5}-1-0", 0, [0]), (f"{MD5}-1-0", 99, [0]), (f"{MD5}-3", 9, None), (f"{MD5.upper()}-1-0", 9, None), (f"{MD5}-0-0", 9, None), (f"{MD5}--1-0", 9, None),
        (f"{MD5}-2-0", 9, None), (f"{MD5}-1-1", 9, None), (f"{MD5}-2-0|0", 9, None), (f"{MD5}-3-0|5|4", 9, None), (f"{MD5}-2-0|x", 9, None), (f"{MD5}-2-0|-5", 9, None), ("", 9, None), (f"{MD5}-2-0|10", 9, None), (f"{MD5}-2-0| 5", 9, None),
    ]
    many = "|".join(str(i * 5368709120) for i in range(10_000))
    cases.append((f"{MD5}-10000-{many}", 5368709120 * 10_000, [i * 5368709120 for i in range(10_000)]))
    assert values(spark, [c[:2] for c in cases], "e string, n bigint", R.offset_etag(F.col("e"), F.col("n"))) == [c[2] for c in cases]


def test_resolved_offsets(spark):
    size, seg = 12 * 2**20 + 1, 5 * 2**20
    rows = [(MD5, size), (MD5 + "-3", size), (MD5 + "-3", 0), (f"{MD5}-1-0", size)]
    at = lambda mode, s=0: values(spark, rows, "e string, n bigint", R.resolve_offsets(F.col("e"), F.col("n"), mode, s))
    assert at("off") == [None] * 4
    assert at("offset") == [None, None, None, [0]]
    assert at("segment", seg) == [None, [0, seg, 2 * seg], None, [0, seg, 2 * seg]]
    assert at("segment", 0) == [None] * 4


def test_manifest_reasons(spark):
    cases = {
        "mybucket|k1|1|0": None, "other|k|1|0": "bucket mismatch", "mybucket| |1|0": "empty key", "mybucket|k": "too few fields", "mybucket|k|x|0": "partcnt not an integer", "mybucket|k|0": "partcnt must be >= 1", "mybucket|k|2|0": "offset count != partcnt",
        "mybucket|k|2|0|a": "offset not an integer", "mybucket|k|2|0|-5": "offset negative", "mybucket|k|1|7": "offset0 must be 0", "mybucket|k|2|0|0": "offsets must be strictly increasing", " \t": "empty line", "mybucket|k|3|0|5|3": "offsets must be strictly increasing", "mybucket|k|2|0|99999999999999999999": "offset not an integer",
    }
    rows = [(c,) for c in cases]
    assert values(spark, rows, "l string", R.multipart_reason(F.col("l"), "mybucket")) == list(cases.values())
    mixed = values(spark, rows, "l string", R.mixed_reason(F.col("l"), "mybucket"))
    assert mixed == [None if c == "mybucket|k" else r for c, r in cases.items()]


def test_framing(spark):
    h = "0123456789abcdefABCDEF0123456789" * 2
    yes = [f"1000;chunk-signature={h}\r\n", f"ff;chunk-signature={h}\n", f"xx zz1000;chunk-signature={h}\r", *(f"\r\nx-amz-checksum-{a}:AA" for a in ("sha256", "crc32", "crc32c", "sha1", "crc64"))]
    no = [f"1000;chunk-signature={h[:60]}\r\n", f";chunk-signature={h}\r\n", f"10;chunk-sig={h}\r\n", "x-amz-checksum-md5:AA", ""]
    rows = [(b"\xff\xfe" + x.encode(),) for x in yes + no]
    assert values(spark, rows, "b binary", R.has_framing(F.col("b"))) == [True] * len(yes) + [False] * len(no)


def test_probe_plans(spark):
    five = 5242880
    cases = [(9000, False, None, [(0, 128), (8872, 128)]), (2 * five, True, [0, five], [(0, 128), (five - 128, 256), (2 * five - 128, 128)]), (1024, True, [0, 500], [(0, 1024)]), (0, True, [0], [(0, 128)]), (1100, True, [0, 1100], [(0, 128), (972, 128), (972, 128)])]
    got = values(spark, [c[:3] for c in cases], "n bigint, m boolean, o array<bigint>", R.probe_plan(F.col("n"), F.col("m"), F.col("o")))
    assert [[tuple(p) for p in g] for g in got] == [c[3] for c in cases]


def test_journal_lines(spark):
    cases = {"discovered|a/": ("discovered", "a/", ""), "done|": ("done", "", ""), "cursor|a|b/|tok": ("cursor", "a|b/", "tok"), "cursor||t": ("cursor", "", "t"), "cursor|x": None, "other|x": None, "": None, "discovered|a|b": ("discovered", "a|b", "")}
    got = values(spark, [(c,) for c in cases], "l string", R.journal_fields(F.col("l")))
    assert [g and tuple(g) for g in got] == list(cases.values())


def test_states_and_templates(spark):
    rows = [(405, "", True), (200, "", False), (404, "NoSuchKey", False), (0, "NoSuchVersion", False), (500, "InternalError", False), (0, "", False), (204, "", True)]
    assert values(spark, rows, "c int, s string, m boolean", R.head_state(F.col("c"), F.col("s"), F.col("m"))) == ["marker", "not_marker", "absent", "absent", "unclassified", "unclassified", "marker"]
    faults = [(500, ""), (501, ""), (505, ""), (503, "x"), (404, "timeout"), (0, "dial tcp 1.2.3.4"), (0, "Timeout"), (0, "unexpected EOF"), (0, None)]
    assert values(spark, faults, "c int, e string", R.is_node_fault(F.col("c"), F.col("e"))) == [True, False, False, True, False, True, False, True, False]
    line = lambda t: values(spark, [("b", "k")], "b string, k string", R.line_template(t, {"bucket": F.col("b"), "key": F.col("k")}))
    assert line("<bucket>|<key>") == ["b|k"] and line("x<key>y") == ["xky"] and line("plain") == ["plain"]
    for bad in ("", "<nope>", "<key"):
        with pytest.raises(ValueError):
            line(bad)
    owners = [("",), (".",), ("..",), ("a/b",), ("a\\b",), ("me",), (None,)]
    assert values(spark, owners, "o string", R.owner_dir(F.col("o"))) == ["_unknown"] * 5 + ["me", "_unknown"]
    sizes = [(0,), (1023,), (1024,), (1536,), (5 << 20,), (3 << 30,)]
    assert values(spark, sizes, "n bigint", R.human_bytes(F.col("n"))) == ["0B", "1023B", "1.00KiB", "1.50KiB", "5.00MiB", "3.00GiB"]
