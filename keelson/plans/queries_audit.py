"""Queries over checks, manifests, multipart objects and their sinks."""

import datetime

from pyspark.sql import functions as F

from keelson.functions import rules as R
from keelson.operators import audit as A
from keelson.operators import commits as C
from keelson.operators import sinks as K
from keelson.operators.compare import compare_buckets
from keelson.plans.registry import query
from keelson.sources import listing as L
from keelson.sources import manifest as M
from keelson.sources import ranged
from keelson.sources.shared import new_folder
from keelson.streaming import streams as T

NORMAL = "regexp_full_match({}, '[0-9a-f]{{32}}')"
ETAG = "CASE WHEN length(etag_raw) >= 2 AND starts_with(etag_raw, '\"') AND ends_with(etag_raw, '\"') THEN substr(etag_raw, 2, length(etag_raw) - 2) ELSE etag_raw END"
OWNER = "CASE WHEN owner_id IN ('', '.', '..') OR contains(owner_id, '/') OR contains(owner_id, chr(92)) THEN '_unknown' ELSE owner_id END"
SIGN = "'(3[0-9]|4[1-6]|6[1-6])3B6368756E6B2D7369676E61747572653D((3[0-9]|4[1-6]|6[1-6])){64}0[AD]'"
TRAIL = "'782D616D7A2D636865636B73756D2D(736861323536|6372633332|637263333263|73686131|6372633634)3A'"
# pairs of hex digits: a match must begin at an even place
WINDOW = "substring(hex(encode(body)), CAST(2 * s + 1 AS BIGINT), CAST(2 * l AS BIGINT))"
HIT = f"regexp_matches({WINDOW}, '^(..)*' || {SIGN}) OR regexp_matches({WINDOW}, '^(..)*' || {TRAIL})"
#: f1 with etag, kind, windows and what they show
CORE = f""", t AS (SELECT doc_id, bucket, key, size, body, {OWNER} AS owner_dir, {ETAG} AS etag, NOT {NORMAL.format('(' + ETAG + ')')} AS is_multipart FROM f1_inventory),
w AS (SELECT doc_id, 0 AS no, 0 AS s, CASE WHEN size > 0 AND size <= 1024 THEN 1024 ELSE 128 END AS l FROM t UNION ALL SELECT doc_id, 1, greatest(size - 128, 0), least(128, size) FROM t WHERE size > 1024),
h AS (SELECT t.doc_id, bool_or({HIT}) AS bad FROM t JOIN w ON t.doc_id = w.doc_id GROUP BY t.doc_id),
r AS (SELECT t.*, CASE WHEN contains(key, '|') THEN 'invalid_keys' WHEN is_multipart THEN 'mp' WHEN size > 0 AND bad THEN 'corrupted_objects' ELSE 'ok_objects' END AS result, bucket || '|' || key AS line FROM t JOIN h ON t.doc_id = h.doc_id)"""


def routed(v):
    return A.check(v("f1_inventory"))


@query("c1_list_check", CORE + " SELECT bucket, key, owner_dir, is_multipart, result, line FROM r")
def c1(v):
    return routed(v).select("bucket", "key", "owner_dir", "is_multipart", "result", "line")


@query("p1_normal_etag", f"SELECT etag, {NORMAL.format('etag')} AS normal FROM f2_uploads")
def p1(v):
    return v("f2_uploads").select("etag", R.is_normal_etag(F.col("etag")).alias("normal"))


@query("p2_trim_quotes", f"SELECT key, {ETAG} AS etag FROM f1_inventory")
def p2(v):
    return v("f1_inventory").select("key", R.trim_quotes(F.col("etag_raw")).alias("etag"))


OFFS = """, sp AS (SELECT *, string_split(etag, '-') AS a FROM f2_uploads), po AS (SELECT key, size, etag, n AS n_parts, CASE WHEN len(a) >= 3 AND regexp_full_match(a[1], '[0-9a-f]{32}') AND regexp_full_match(a[2], '[+-]?[0-9]+') THEN string_split(array_to_string(a[3:], '-'), '|') END AS t, TRY_CAST(a[2] AS BIGINT) AS n FROM sp),
pn AS (SELECT *, CASE WHEN len(list_filter(t, lambda x: NOT regexp_full_match(x, '[+-]?[0-9]+'))) = 0 THEN list_transform(t, lambda x: CAST(x AS BIGINT)) END AS o FROM po),
ok AS (SELECT key, size, etag, n_parts, CASE WHEN n >= 1 AND len(o) = n AND o[1] = 0 AND o = list_sort(list_distinct(o)) AND o[-1] <= size AND o[1] >= 0 THEN o END AS offs FROM pn)"""


@query("p3_offset_etag", OFFS + " SELECT key, size, CASE WHEN offs IS NULL THEN NULL ELSE array_to_string(offs, '|') END AS offsets FROM ok")
def p3(v):
    offs = R.offset_etag(F.col("etag"), F.col("size"))
    return v("f2_uploads").select("key", "size", F.array_join(F.transform(offs, lambda x: x.cast("string")), "|").alias("offsets"))


@query("p4_resolve_offsets", OFFS + " SELECT key, NOT regexp_full_match(etag, '[0-9a-f]{32}') AS is_multipart, len(offs) AS by_etag, CASE WHEN size > 0 THEN (size + 19999) // 20000 END AS by_segment FROM ok")
def p4(v):
    size = lambda c: F.when(c.isNotNull(), F.size(c).cast("bigint"))
    e, s = F.col("etag"), F.col("size")
    return v("f2_uploads").select("key", (~R.is_normal_etag(e)).alias("is_multipart"), size(R.resolve_offsets(e, s, "offset")).alias("by_etag"), size(R.resolve_offsets(e, s, "segment", 20000)).alias("by_segment"))


@query("p5_segment_offsets", "SELECT key, array_to_string(list_transform(range(0, (size + 9999) // 10000), lambda i: i * 10000), '|') AS offsets FROM f2_uploads WHERE size > 0")
def p5(v):
    return v("f2_uploads").where("size > 0").select("key", F.array_join(F.transform(R.segment_offsets(F.col("size"), 10000), lambda x: x.cast("string")), "|").alias("offsets"))


REASON = """, ln AS (SELECT line_no, line, string_split(line, '|') AS a FROM f6_lines),
rs AS (SELECT line_no, line, a, CASE WHEN trim(line) = '' THEN 'empty line' WHEN len(a) < 2 THEN 'too few fields' WHEN a[1] <> 'bkt' THEN 'bucket mismatch' WHEN len(a) = 2 AND trim(a[2]) = '' THEN 'empty key' WHEN len(a) = 2 THEN NULL
  WHEN trim(a[2]) = '' THEN 'empty key' WHEN NOT regexp_full_match(a[3], '[+-]?[0-9]+') THEN 'partcnt not an integer' WHEN CAST(a[3] AS BIGINT) < 1 THEN 'partcnt must be >= 1' WHEN len(a) <> 3 + CAST(a[3] AS BIGINT) THEN 'offset count != partcnt'
  WHEN len(list_filter(a[4:], lambda x: NOT regexp_full_match(x, '[+]?[0-9]+'))) > 0 THEN CASE WHEN regexp_full_match(list_filter(a[4:], lambda x: NOT regexp_full_match(x, '[+]?[0-9]+'))[1], '-[0-9]+') THEN 'offset negative' ELSE 'offset not an integer' END
  WHEN CAST(a[4] AS BIGINT) <> 0 THEN 'offset0 must be 0' WHEN list_transform(a[4:], lambda x: CAST(x AS BIGINT)) <> list_sort(list_distinct(list_transform(a[4:], lambda x: CAST(x AS BIGINT)))) THEN 'offsets must be strictly increasing' END AS reason FROM ln),
pm AS (SELECT line_no, line, CASE WHEN reason IS NULL THEN a[2] END AS key, CASE WHEN reason IS NULL THEN len(a) > 2 END AS is_multipart, CASE WHEN reason IS NULL AND len(a) > 3 THEN array_to_string(a[4:], '|') END AS offsets, reason FROM rs)"""


def text_offsets(c="offsets"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias("offsets")


@query("p6_multipart_reason", REASON + " SELECT line_no, CASE WHEN trim(line) = '' THEN 'empty line' WHEN len(a) < 3 THEN 'too few fields' ELSE reason END AS reason FROM rs")
def p6(v):
    return v("f6_lines").select("line_no", R.multipart_reason(F.col("line"), "bkt").alias("reason"))


@query("p7_mixed_lines", REASON + " SELECT line_no, key, is_multipart, offsets, reason FROM pm")
def p7(v):
    return M.split_manifest(v("f6_lines"), "bkt").select("line_no", "key", "is_multipart", text_offsets(), "reason")


@query("s10_text_manifest", ", n AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS line_no, 'bkt|k' || o_orderkey || '|' || o_custkey AS line FROM orders) SELECT line_no, line FROM n")
def s10(v):
    spark, path = v.spark, new_folder(v.spark, "manifest")
    lines = v.spark.read.parquet(f"{v.sf_dir}/orders.parquet").select("o_orderkey", F.concat_ws("|", F.lit("bkt"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")), F.col("o_custkey").cast("string")).alias("value"))
    lines.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return M.numbered_lines(spark, path)


RESUME = ", rl AS (SELECT o_orderkey AS line_no, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'p/' || o_custkey WHEN 2 THEN 'p/' || o_custkey || '|t' WHEN 3 THEN '  ' ELSE 'p|t|' || o_custkey END AS line FROM orders)"


def resume_lines(v):
    text = F.expr("CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('p/', o_custkey) WHEN 2 THEN concat('p/', o_custkey, '|t') WHEN 3 THEN '  ' ELSE concat('p|t|', o_custkey) END")
    return v.spark.read.parquet(f"{v.sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("line_no"), text.alias("line"))


@query("s11_resume_list", RESUME + " SELECT line_no, CASE WHEN line <> '  ' THEN string_split(line, '|')[1] END AS prefix, CASE WHEN line <> '  ' THEN CASE WHEN contains(line, '|') THEN substr(line, instr(line, '|') + 1) ELSE '' END END AS token FROM rl")
def s11(v):
    return M.resume_entries(resume_lines(v)).select("line_no", "prefix", "token")


@query("p8_resume_line", RESUME + " SELECT line_no, CASE WHEN line = '  ' THEN 'whitespace-only line' END AS reason FROM rl")
def p8(v):
    return M.resume_entries(resume_lines(v)).select("line_no", "reason")


@query("l5_blank_lines", RESUME + " SELECT count(*) FILTER (WHERE line <> '') AS skipped_contract, count(*) AS root_contract FROM rl")
def l5(v):
    return resume_lines(v).agg(F.count_if(F.col("line") != "").alias("skipped_contract"), F.count("*").alias("root_contract"))


RETRY = ", rt AS (SELECT o_orderkey AS line_no, CASE o_orderkey % 3 WHEN 0 THEN 'c' || o_custkey % 50 WHEN 1 THEN concat_ws(chr(31), 'c' || o_custkey % 50, 'k' || o_custkey % 7, 'v') ELSE 'c' || chr(31) || 'k' END AS line FROM orders), ry AS (SELECT line_no, string_split(line, chr(31)) AS a FROM rt)"


def retry_lines(v):
    text = F.expr("CASE o_orderkey % 3 WHEN 0 THEN concat('c', o_custkey % 50) WHEN 1 THEN concat_ws(char(31), concat('c', o_custkey % 50), concat('k', o_custkey % 7), 'v') ELSE concat('c', char(31), 'k') END")
    return v.spark.read.parquet(f"{v.sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("line_no"), text.alias("line"))


ENTRY = RETRY + " SELECT a[1] AS prefix, coalesce(a[2], '') AS key_marker, coalesce(a[3], '') AS version_marker, min(line_no) AS line_no FROM ry WHERE len(a) IN (1, 3) GROUP BY ALL"


@query("s12_retry_entries", ENTRY)
def s12(v):
    return M.retry_entries(retry_lines(v)).select("prefix", "key_marker", "version_marker", "line_no")


@query("p9_retry_line", RETRY + " SELECT line_no, len(a) IN (1, 3) AS ok FROM ry")
def p9(v):
    return retry_lines(v).select("line_no", F.size(F.split("line", R.SEP)).isin(1, 3).alias("ok"))


@query("a12_distinct_entries", RETRY + " SELECT count(*) AS n, CAST(sum(line_no) AS BIGINT) AS firsts FROM (SELECT min(line_no) AS line_no FROM ry WHERE len(a) IN (1, 3) GROUP BY a)")
def a12(v):
    return M.retry_entries(retry_lines(v)).agg(F.count("*").alias("n"), F.sum("line_no").alias("firsts"))


CLEAN = ", cl AS (SELECT o_orderkey AS line_no, CASE o_orderkey % 4 WHEN 0 THEN concat_ws(chr(31), 'bkt', 'a%2Fb+' || o_custkey, 'null') WHEN 1 THEN concat_ws(chr(31), 'bkt', 'k%7E' || o_custkey, 'v1', '2020') WHEN 2 THEN concat_ws(chr(31), 'bkt', 'bad%zz', 'v') ELSE 'torn' || chr(31) || 'row' END AS line FROM orders), cr AS (SELECT line_no, string_split(line, chr(31)) AS a FROM cl), cd AS (SELECT line_no, a, CASE WHEN len(a) NOT IN (3, 4) THEN 'wrong number of fields' WHEN contains(a[2], '%zz') THEN 'bad encoding' END AS reason FROM cr)"


def cleanup_lines(v):
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat_ws(char(31), 'bkt', concat('a%2Fb+', o_custkey), 'null') WHEN 1 THEN concat_ws(char(31), 'bkt', concat('k%7E', o_custkey), 'v1', '2020') WHEN 2 THEN concat_ws(char(31), 'bkt', 'bad%zz', 'v') ELSE concat('torn', char(31), 'row') END")
    return v.spark.read.parquet(f"{v.sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("line_no"), text.alias("line"))


@query("s13_cleanup_scan", CLEAN + " SELECT reason, count(*) AS n FROM cd GROUP BY reason")
def s13(v):
    return M.cleanup_rows(cleanup_lines(v), F.lit(True)).groupBy("reason").agg(F.count("*").alias("n"))


@query("p10_cleanup_row", CLEAN + " SELECT line_no, CASE WHEN reason IS NULL THEN url_decode(replace(a[2], '+', ' ')) END AS key, CASE WHEN reason IS NULL THEN a[3] END AS version_id, CASE WHEN reason IS NULL THEN coalesce(a[4], '') END AS last_modified, reason FROM cd")
def p10(v):
    return M.cleanup_rows(cleanup_lines(v), F.lit(True)).select("line_no", "key", "version_id", "last_modified", "reason")


@query("p11_output_key", CLEAN + " SELECT line_no, replace(a[2], '%7E', '~') AS out FROM cd WHERE reason IS NULL")
def p11(v):
    return M.cleanup_rows(cleanup_lines(v), F.lit(True)).where("reason IS NULL").select("line_no", M.output_key(F.col("key"), F.col("key_encoded")).alias("out"))


MPW = OFFS + """, pw AS (SELECT key, size, CASE WHEN size > 0 AND size <= 1024 THEN [{'s': 0, 'l': 1024}] ELSE list_concat([{'s': 0, 'l': 128}], CASE WHEN offs IS NULL THEN [] ELSE list_filter(list_transform(offs[2:], lambda o: {'s': CAST(greatest(o - 128, 0) AS INTEGER), 'l': CAST(CASE WHEN size > 0 THEN least(o + 128, size) ELSE o + 128 END - greatest(o - 128, 0) AS INTEGER)}), lambda p: p.l > 0) END,
  CASE WHEN size > 0 THEN [{'s': CAST(greatest(size - 128, 0) AS INTEGER), 'l': CAST(least(128, size) AS INTEGER)}] ELSE [] END) END AS w FROM ok)"""


@query("p14_probe_plan", MPW + " SELECT key, len(w) AS n, array_to_string(list_transform(w, lambda p: p.s || '+' || p.l), ' ') AS probes FROM pw")
def p14(v):
    e, s = F.col("etag"), F.col("size")
    w = R.probe_plan(s, ~R.is_normal_etag(e), R.offset_etag(e, s))
    return v("f2_uploads").select("key", F.size(w).cast("bigint").alias("n"), F.array_join(F.transform(w, lambda p: F.concat_ws("+", p["start"].cast("string"), p["length"].cast("string"))), " ").alias("probes"))


@query("p15_chunk_signature", f"SELECT doc_id, regexp_matches(hex(encode(body)), '^(..)*' || {SIGN}) AS found FROM f1_inventory")
def p15(v):
    return v("f1_inventory").select("doc_id", R.as_latin(F.col("body").cast("binary")).rlike(R.CHUNK_SIGNATURE).alias("found"))


@query("p16_trailer", f"SELECT doc_id, regexp_matches(hex(encode(body)), '^(..)*' || {TRAIL}) AS found FROM f1_inventory")
def p16(v):
    return v("f1_inventory").select("doc_id", R.as_latin(F.col("body").cast("binary")).rlike(R.TRAILER).alias("found"))


@query("p17_owner_dir", f"SELECT doc_id, {OWNER} AS owner_dir FROM f1_inventory")
def p17(v):
    return v("f1_inventory").select("doc_id", R.owner_dir(F.col("owner_id")).alias("owner_dir"))


@query("p18_separator_keys", "SELECT key FROM f1_inventory WHERE contains(key, '|')")
def p18(v):
    return v("f1_inventory").where(R.has_separator(F.col("key"))).select("key")


@query("p33_empty_objects", CORE + " SELECT key, result FROM r WHERE size = 0")
def p33(v):
    return routed(v).where("size = 0").select("key", "result")


@query("p34_unverified_multipart", OFFS + " SELECT key, CASE WHEN offs IS NULL THEN 'list_parse_failed' ELSE 'ok_mp' END AS in_offset_mode, 'mp' AS in_off_mode FROM ok")
def p34(v):
    rows = v("f2_uploads").withColumns({"is_multipart": ~R.is_normal_etag(F.col("etag")), "verdict": F.lit("clean")})
    at = A.route(rows.withColumn("offsets", R.offset_etag(F.col("etag"), F.col("size"))), "offset").withColumnRenamed("result", "in_offset_mode")
    return A.route(at.withColumn("offsets", F.lit(None).cast("array<bigint>")), "off").select("key", "in_offset_mode", F.col("result").alias("in_off_mode"))


@query("p36_verdict_routing", CORE + " SELECT result, is_multipart, count(*) AS n FROM r GROUP BY ALL")
def p36(v):
    return routed(v).groupBy("result", "is_multipart").agg(F.count("*").alias("n"))


@query("p38_length_check", "SELECT doc_id, CAST(least(strlen(body), 128) AS BIGINT) AS got, strlen(body) >= 128 AS whole FROM f1_inventory")
def p38(v):
    head = F.substring(F.col("body").cast("binary"), F.lit(1), F.lit(128))
    return v("f1_inventory").select("doc_id", F.octet_length(head).cast("bigint").alias("got"), (F.octet_length(head) == 128).alias("whole"))


@query("p39_copy_feasible", "SELECT key, bool_and(part_size > 0 AND (part_no = m OR part_size >= 40000)) AS copyable FROM (SELECT *, max(part_no) OVER (PARTITION BY key) AS m FROM f2_parts) GROUP BY key")
def p39(v):
    # the test table's parts are small: the least part is scaled to them
    scaled = v("f2_parts").select("key", "part_no", (F.col("part_size") * F.lit(A.MIN_PART / 40000)).alias("length"))
    return A.copyable(scaled)


@query("l6_success_gates", CORE + " SELECT result, count(*) AS counted, CASE WHEN result IN ('ok_objects', 'ok_mp') THEN 0 ELSE count(*) END AS emitted FROM r GROUP BY result")
def l6(v):
    shown = A.enabled(F.col("result"), mode="offset", file_input=False) | (F.col("result") == "mp")
    return routed(v).groupBy("result").agg(F.count("*").alias("counted"), F.count_if(shown).alias("emitted"))


@query("l7_list_only", CORE + " SELECT count(*) FILTER (WHERE result <> 'invalid_keys') AS list_all, count(*) FILTER (WHERE result <> 'invalid_keys' AND NOT is_multipart) AS list_obj, count(*) FILTER (WHERE result <> 'invalid_keys' AND is_multipart) AS list_mp FROM r")
def l7(v):
    rows = A.tasks(v("f1_inventory")).where(~R.has_separator(F.col("key")))
    return rows.agg(F.count("*").alias("list_all"), F.count_if(~F.col("is_multipart")).alias("list_obj"), F.count_if("is_multipart").alias("list_mp"))


@query("c2_list_only", CORE + " SELECT owner_dir, count(*) AS list_all, count(*) FILTER (WHERE is_multipart) AS list_mp FROM r WHERE result <> 'invalid_keys' GROUP BY owner_dir")
def c2(v):
    return A.tasks(v("f1_inventory")).where(~R.has_separator(F.col("key"))).groupBy("owner_dir").agg(F.count("*").alias("list_all"), F.count_if("is_multipart").alias("list_mp"))


SUMMARY = " SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in (("list_all", "result <> 'invalid_keys'"), ("list_obj", "result <> 'invalid_keys' AND NOT is_multipart"), ("list_mp", "result <> 'invalid_keys' AND is_multipart"), ("ok_obj", "result = 'ok_objects'"), ("corrupt_obj", "result = 'corrupted_objects'"), ("ok_mp", "result = 'ok_mp'"), ("corrupt_mp", "result = 'corrupted_mp'"), ("list_failed", "false"), ("list_parse_failed", "false"), ("check_failed", "false"), ("mp_check_failed", "false"), ("invalid_keys", "result = 'invalid_keys'"))) + " FROM r"


@query("a1_summary", CORE + SUMMARY)
def a1(v):
    return A.summary(routed(v))


@query("a1_written_summary", CORE + SUMMARY)
def a1_written(v):
    """The same counters, taken by the job that writes the results and kept with them."""
    path = new_folder(v.spark, "counted")
    counters = A.summary_counters()
    K.write_lines(routed(v), path, **counters)
    found = C.counters(path)
    return v.spark.createDataFrame([tuple(found[n] for n in counters)], ", ".join(f"{n} bigint" for n in counters))


@query("a3_first_settled_probe", CORE + " SELECT doc_id, CASE WHEN size > 0 AND bad THEN 'corrupted' ELSE 'clean' END AS verdict FROM t JOIN h USING (doc_id)")
def a3(v):
    return A.verdicts(A.tasks(v("f1_inventory"))).select("doc_id", "verdict")


@query("j7_probe_results", CORE + " SELECT is_multipart, count(*) FILTER (WHERE size > 0 AND bad) AS corrupted, count(*) AS n FROM t JOIN h USING (doc_id) GROUP BY is_multipart")
def j7(v):
    return A.verdicts(A.tasks(v("f1_inventory"))).groupBy("is_multipart").agg(F.count_if(F.col("verdict") == "corrupted").alias("corrupted"), F.count("*").alias("n"))


@query("a8_per_owner", CORE + " SELECT coalesce(owner_dir, 'all') AS owner_dir, coalesce(result, 'all') AS result, count(*) AS n FROM r GROUP BY ROLLUP (owner_dir, result)")
def a8(v):
    return routed(v).rollup("owner_dir", "result").agg(F.count("*").alias("n")).select(F.coalesce("owner_dir", F.lit("all")).alias("owner_dir"), F.coalesce("result", F.lit("all")).alias("result"), "n")


@query("a7_composite_etag", "SELECT key, md5(unhex(string_agg(part_md5, '' ORDER BY part_no))) || '-' || count(*) AS etag FROM f2_parts GROUP BY key")
def a7(v):
    return A.composite_etag(v("f2_parts"))


@query("w1_part_ranges", OFFS + ", x AS (SELECT key, size, unnest(offs) AS start, generate_subscripts(offs, 1) AS part_no FROM ok WHERE offs IS NOT NULL) SELECT key, part_no, start, coalesce(lead(start) OVER (PARTITION BY key ORDER BY part_no), size) - start AS length FROM x")
def w1(v):
    rows = v("f2_uploads").withColumn("offsets", R.offset_etag(F.col("etag"), F.col("size"))).where("offsets IS NOT NULL")
    return A.part_ranges(rows).withColumn("part_no", F.col("part_no").cast("bigint"))


@query("w2_strict_increase", "SELECT key, bool_and(coalesce(off > p, true)) AS increasing FROM (SELECT key, off, lag(off) OVER (PARTITION BY key ORDER BY part_no) AS p FROM f2_parts) GROUP BY key")
def w2(v):
    offs = F.transform(F.sort_array(F.collect_list(F.struct("part_no", "off"))), lambda x: x["off"])
    return v("f2_parts").groupBy("key").agg(R.increasing(offs).alias("increasing"))


@query("k8_offset_lines", OFFS + " SELECT key, CASE WHEN offs IS NULL THEN 'bkt|' || key ELSE 'bkt|' || key || '|' || len(offs) || '|' || array_to_string(offs, '|') END AS line FROM ok")
def k8(v):
    offs = R.offset_etag(F.col("etag"), F.col("size"))
    return v("f2_uploads").select("key", R.offset_line(F.lit("bkt"), F.col("key"), offs, F.concat(F.lit("bkt|"), "key")).alias("line"))


@query("k5_parse_diagnostics", OFFS + " SELECT key, CAST(strlen(etag) AS BIGINT) AS etag_len, etag FROM ok WHERE offs IS NULL")
def k5(v):
    return K.parse_failures(v("f2_uploads"))


@query("k7_line_template", "SELECT 'b=bkt k=' || key || ' o=' || owner_id AS line FROM f1_inventory")
def k7(v):
    return v("f1_inventory").select(R.line_template("b=<bucket> k=<key> o=<owner>", {"bucket": F.col("bucket"), "key": F.col("key"), "owner": F.col("owner_id")}).alias("line"))


@query("k1_owner_files", CORE + " SELECT owner_dir, result, line FROM r WHERE result IN ('ok_objects', 'corrupted_objects', 'mp')")
def k1(v):
    path = new_folder(v.spark, "owner-lines")
    K.write_owner_lines(routed(v).where(F.col("result").isin("ok_objects", "corrupted_objects", "mp")), path)
    return K.read_lines(v.spark, path, "owner_dir string, result string")


@query("k2_process_files", CORE + " SELECT result, line FROM r WHERE result = 'invalid_keys'")
def k2(v):
    path = new_folder(v.spark, "lines")
    K.write_lines(routed(v).where("result = 'invalid_keys'"), path)
    return K.read_lines(v.spark, path)


@query("k3_enabled_sets", CORE + ", s AS (SELECT DISTINCT result FROM r) SELECT result, result IN ('list_failed', 'parse_failed', 'invalid_keys', 'corrupted_objects', 'check_failed', 'ok_objects', 'mp') AS off_mode, result IN ('list_failed', 'parse_failed', 'invalid_keys', 'corrupted_objects', 'check_failed', 'corrupted_mp', 'mp_check_failed', 'list_parse_failed') AS offset_mode FROM s")
def k3(v):
    sets = routed(v).select("result").distinct()
    return sets.select("result", A.enabled(F.col("result"), success_log=True).alias("off_mode"), A.enabled(F.col("result"), mode="offset").alias("offset_mode"))


@query("k10_lazy_sets", CORE + " SELECT DISTINCT result FROM r WHERE result IN ('check_failed', 'corrupted_objects')")
def k10(v):
    path = new_folder(v.spark, "lazy-lines")
    K.write_lines(routed(v).where(F.col("result").isin("check_failed", "corrupted_objects")), path)
    return K.read_lines(v.spark, path).select("result").distinct()


@query("k12_md5_manifest", "SELECT 'bkt|' || key || '|' || md5(body) AS line FROM f1_inventory")
def k12(v):
    path = new_folder(v.spark, "md5")
    K.write_manifest(v("f1_inventory").select("bucket", "key", F.md5(F.col("body").cast("binary")).alias("md5")), path)
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query("k13_run_folders", CORE + " SELECT result, count(*) AS n FROM r GROUP BY result")
def k13(v):
    at = datetime.datetime(2024, 1, 2, 3, 4, 5)
    paths = [K.run_folder(new_folder(v.spark, "run") + "/", at + datetime.timedelta(seconds=i)) for i in range(2)]
    for i, p in enumerate(paths):
        K.write_lines(routed(v).where(F.pmod(F.xxhash64("key"), F.lit(2)) == i), p)
    return K.read_lines(v.spark, paths[0]).unionByName(K.read_lines(v.spark, paths[1])).groupBy("result").agg(F.count("*").alias("n"))


@query("k14_relay_regular", "SELECT key, md5(body) AS dst_etag FROM f1_inventory WHERE NOT contains(key, '|')")
def k14(v):
    return relayed_regular(v, v("f1_inventory"))


@query("k14_relay_regular_whole")
def k14_whole(v):
    return relayed_regular(v, v("f1_inventory"))


def relayed_regular(v, rows):
    return relayed(v, rows.where("NOT contains(key, '|')").withColumn("offsets", F.lit(None).cast("array<bigint>")))


PARTS = "substring(hex(encode(body)), CAST(2 * (size // 2) * i + 1 AS BIGINT), CAST(CASE WHEN i = 0 THEN 2 * (size // 2) ELSE 2 * size END AS BIGINT))"


@query("k15_relay_multipart", f", x AS (SELECT key, body, size, unnest([0, 1]) AS i FROM f1_inventory WHERE NOT contains(key, '|')) SELECT key, CASE WHEN size > 1 THEN md5(unhex(string_agg(md5(unhex({PARTS})), '' ORDER BY i))) || '-2' END AS dst_etag FROM x GROUP BY key, size")
def k15(v):
    return relayed(v, halves(v))


@query("k15_relay_multipart_whole")
def k15_whole(v):
    return relayed(v, halves(v).where("size > 1"))


def halves(v):
    """Objects in two parts; of an empty object or of one byte a part has no bytes, and the copy fails."""
    return v("f1_inventory").where("NOT contains(key, '|')").withColumn("offsets", F.array(F.lit(0).cast("bigint"), F.expr("size div 2")))


def relayed(v, rows):
    """Bodies stored as objects of a folder, copied to another."""
    source, target = new_folder(v.spark, "bucket"), new_folder(v.spark, "backup")
    ranged.store_objects(rows, source)
    objects = rows.select("key", ranged.object_path(source).alias("source"), ranged.object_path(target).alias("target"), "offsets", "size")
    return ranged.copy_objects(objects).select("key", "dst_etag")


@query("k16_archive", "SELECT line FROM f6_lines")
def k16(v):
    lines = v("f6_lines").select("line")
    return v.spark.read.text(K.archive(lines, new_folder(v.spark, "archive"), "lines", datetime.datetime(2024, 1, 2))).withColumnRenamed("value", "line")


RANGE = "hex(CAST(unhex(substring(hex(encode(body)), CAST(2 * s + 1 AS BIGINT), CAST(2 * n AS BIGINT))) AS BLOB))"


@query("s15_ranged_read", f", x AS (SELECT key, body, unnest([0, greatest(size - 128, 0)]) AS s, 128 AS n, unnest([0, 1]) AS no FROM f1_inventory) SELECT key, no, CAST(s AS BIGINT) AS start, {RANGE} AS bytes FROM x")
def s15(v):
    """The first and the last 128 bytes of every stored object."""
    rows, folder = v("f1_inventory"), new_folder(v.spark, "bucket")
    ranged.store_objects(rows, folder)
    windows = rows.select("key", ranged.object_path(folder).alias("path"), F.posexplode(F.array(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 128, F.lit(0)))).alias("no", "start"))
    read = ranged.read_ranges(windows.select("path", "start", F.lit(128).alias("length")).distinct())
    return windows.join(read, ["path", "start"]).select("key", F.col("no").cast("int").alias("no"), "start", F.hex("body").alias("bytes"))


DECL = ", d AS (SELECT d.key, d.doc_id, d.is_multipart AS declared, h.etag, h.size FROM f7_declared d LEFT JOIN f7_head h ON d.key = h.key)"


def declared(v):
    return v("f7_declared").select("key", "is_multipart", F.when(F.col("is_multipart"), F.array(F.lit(0).cast("bigint"))).alias("offsets"))


@query("j1_head_enrichment", DECL + " SELECT key, declared, etag, size, CASE WHEN etag IS NULL THEN CASE WHEN declared THEN 'mp_check_failed' ELSE 'check_failed' END END AS failure FROM d")
def j1(v):
    joined = A.head_joined(declared(v).withColumnRenamed("is_multipart", "declared"), v("f7_head"))
    return joined.select("key", "declared", "etag", "size", F.when(~F.col("found"), F.when(F.col("declared"), "mp_check_failed").otherwise("check_failed")).alias("failure"))


@query("j2_type_drift", DECL + " SELECT key, declared, CASE WHEN etag IS NULL THEN declared ELSE contains(etag, '-') END AS now_multipart, etag IS NOT NULL AND declared <> contains(etag, '-') AS drifted FROM d")
def j2(v):
    joined = A.head_joined(declared(v), v("f7_head"))
    now = F.when(F.col("found"), ~R.is_normal_etag(F.col("etag"))).otherwise(F.col("is_multipart"))
    return joined.select("key", F.col("is_multipart").alias("declared"), now.alias("now_multipart"), (F.col("found") & (F.col("is_multipart") != now)).alias("drifted"))


#: The store has lost the second half of the objects of the owner '..'; some multipart ETags are those of two halves.
BACK = DECL + """, s AS (SELECT key, owner_id = '..' AND size > 0 AS short, COMPOSITE(body) AS halves FROM f1_inventory),
b AS (SELECT d.key, CASE WHEN etag IS NULL THEN 'head' WHEN declared <> contains(etag, '-') THEN '' WHEN short OR declared AND size < 2 THEN 'upload' WHEN declared AND etag <> halves THEN 'etag' ELSE '' END AS stage, declared, etag,
  CASE WHEN etag IS NULL THEN 'backup_failed' WHEN declared <> contains(etag, '-') THEN 'mismatch' WHEN short OR declared AND (size < 2 OR etag <> halves) THEN 'backup_failed' ELSE 'backup_ok' END AS result FROM d JOIN s ON d.key = s.key)"""


def planned(v):
    """Every line before its copy is made: what isn't there, and what has another type now."""
    none = v("f7_head").select("key", "etag").limit(0)
    return A.backup_plan(declared(v), v("f7_head"), none)


def backed_up(v):
    """The whole job: the lines are archived, then each object that is there as declared is copied and compared."""
    folder = new_folder(v.spark, "backup-job")
    kept = F.when(F.col("owner_id") == "..", F.substring("body", F.lit(1), F.expr("length(body) div 2"))).otherwise(F.col("body"))
    ranged.store_objects(v("f1_inventory").select("key", kept.alias("body")), f"{folder}/bucket")
    head = v("f7_head")
    lines = declared(v).drop("offsets").join(head.select("key", F.col("size").alias("_n")), "key", "left")
    manifest = lines.select("key", "is_multipart", F.when(F.col("is_multipart"), F.array(F.lit(0).cast("bigint"), F.expr("_n div 2"))).alias("offsets"))
    K.archive(manifest.select(F.concat_ws("|", F.lit("bkt"), "key").alias("line")), f"{folder}/copies", "lines", datetime.datetime(2024, 1, 2))
    return A.backup(manifest, head, f"{folder}/bucket", f"{folder}/copies")


@query("j3_type_gate", BACK + " SELECT key FROM b WHERE result = 'mismatch'")
def j3(v):
    return planned(v).where("result = 'mismatch'").select("key")


@query("j4_copy_etags", BACK + " SELECT key, result FROM b WHERE stage = 'etag' OR result = 'backup_ok'")
def j4(v):
    return backed_up(v).where("stage = 'etag' OR result = 'backup_ok'").select("key", "result")


@query("j4_bucket_audit", """, a AS (SELECT key, md5(body) AS etag, size FROM f1_inventory), b AS (SELECT key, etag, size FROM f7_target)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'only_source' WHEN a.key IS NULL THEN 'only_target' ELSE 'differs' END AS status, a.etag AS source_etag, b.etag AS target_etag, a.size AS source_size, b.size AS target_size
FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.etag <> b.etag OR a.size <> b.size""")
def j4_audit(v):
    """Two whole buckets, opened only where digests of their hash ranges differ."""
    source = v("f1_inventory").select("key", F.md5("body").alias("etag"), "size")
    return compare_buckets(source, v("f7_target"), ["etag", "size"]).select("key", "status", "source_etag", "target_etag", "source_size", "target_size")


@query("p37_backup_routing", BACK + " SELECT result, stage, count(*) AS n FROM b GROUP BY ALL")
def p37(v):
    return backed_up(v).groupBy("result", "stage").agg(F.count("*").alias("n"))


@query("c4_backup", BACK + " SELECT key, result, stage FROM b")
def c4(v):
    return backed_up(v).select("key", "result", "stage")


@query("k6_mismatch_reasons", BACK + " SELECT key, CASE WHEN contains(etag, '-') THEN 'the line is regular, the current ETag is multipart' ELSE 'the line is multipart, the current ETag is a plain MD5' END AS reason FROM b WHERE result = 'mismatch'")
def k6(v):
    return planned(v).where("result = 'mismatch'").select("key", R.mismatch_reason(F.col("is_multipart"), F.col("etag")).alias("reason"))


@query("c3_check_file", CORE + """ SELECT d.key, CASE WHEN e.etag IS NULL THEN CASE WHEN d.is_multipart THEN 'mp_check_failed' ELSE 'check_failed' END WHEN contains(e.etag, '-') THEN CASE WHEN d.is_multipart THEN CASE WHEN r.size > 0 AND r.bad THEN 'corrupted_mp' ELSE 'ok_mp' END ELSE 'mp' END
  WHEN r.size > 0 AND r.bad THEN 'corrupted_objects' ELSE 'ok_objects' END AS result FROM f7_declared d LEFT JOIN f7_head e ON d.key = e.key JOIN (SELECT key, size, bad FROM t JOIN h USING (doc_id)) r ON r.key = d.key""")
def c3(v):
    return A.recheck(declared(v), v("f7_head"), v("f1_inventory")).select("key", "result")


@query("m6_recheck_verdicts", CORE + """ SELECT 'bkt|' || d.key || CASE WHEN d.is_multipart THEN '|1|0' ELSE '' END AS line, CASE WHEN contains(d.key, '|') THEN 'parse_failed' WHEN e.etag IS NULL THEN CASE WHEN d.is_multipart THEN 'mp_check_failed' ELSE 'check_failed' END
  WHEN contains(e.etag, '-') THEN CASE WHEN d.is_multipart THEN CASE WHEN r.size > 0 AND r.bad THEN 'corrupted_mp' ELSE 'ok_mp' END ELSE 'mp' END WHEN r.size > 0 AND r.bad THEN 'corrupted_objects' ELSE 'ok_objects' END AS result
FROM f7_declared d LEFT JOIN f7_head e ON d.key = e.key JOIN (SELECT key, size, bad FROM t JOIN h USING (doc_id)) r ON r.key = d.key""")
def m6_verdicts(v):
    """Failure lines as they come, with the objects' current state and a verdict."""
    path = new_folder(v.spark, "lines")
    v("f7_declared").select(F.concat(F.lit("bkt|"), "key", F.when(F.col("is_multipart"), "|1|0").otherwise("")).alias("value")).write.text(path)
    return T.drained(T.recheck_stream(T.lines_stream(v.spark, path), v("f7_head"), v("f1_inventory"), "bkt"))


FAILS = REASON + ", fl AS (SELECT line_no % 3 AS run_id, line, CASE WHEN reason IS NULL THEN CASE line_no % 7 WHEN 0 THEN 'check_failed' WHEN 1 THEN 'mp_check_failed' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'corrupted_objects' WHEN 4 THEN 'corrupted_mp' ELSE 'ok_objects' END ELSE 'parse_failed' END AS result FROM pm)"


def failures(v):
    rows = M.split_manifest(v("f6_lines"), "bkt")
    name = F.expr("CASE WHEN reason IS NULL THEN CASE line_no % 7 WHEN 0 THEN 'check_failed' WHEN 1 THEN 'mp_check_failed' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'corrupted_objects' WHEN 4 THEN 'corrupted_mp' ELSE 'ok_objects' END ELSE 'parse_failed' END")
    return rows.select((F.col("line_no") % 3).alias("run_id"), "line", name.alias("result"))


@query("u1_union_of_runs", FAILS + " SELECT result, line FROM fl WHERE result <> 'ok_objects'")
def u1(v):
    runs = [failures(v).where(F.col("run_id") == i).where("result <> 'ok_objects'") for i in range(3)]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("result", "line")


@query("u2_retry_input", FAILS + " SELECT DISTINCT line FROM fl WHERE result IN ('check_failed', 'mp_check_failed', 'mismatch')")
def u2(v):
    return failures(v).where(F.col("result").isin("check_failed", "mp_check_failed", "mismatch")).select("line").distinct()


@query("u3_backup_input", FAILS + " SELECT DISTINCT line FROM fl WHERE result IN ('corrupted_objects', 'corrupted_mp')")
def u3(v):
    return failures(v).where(F.col("result").isin("corrupted_objects", "corrupted_mp")).select("line").distinct()


@query("u4_difference", FAILS + " SELECT DISTINCT line FROM fl WHERE result = 'check_failed' AND line NOT IN (SELECT line FROM fl WHERE result = 'ok_objects')")
def u4(v):
    rows = failures(v)
    return rows.where("result = 'check_failed'").select("line").distinct().join(rows.where("result = 'ok_objects'").select("line"), "line", "left_anti")


@query("j8_remaining_work", FAILS + " SELECT line FROM fl WHERE line NOT IN (SELECT line FROM fl WHERE result = 'ok_objects')")
def j8(v):
    rows = failures(v)
    return rows.select("line").join(rows.where("result = 'ok_objects'").select("line").distinct(), "line", "left_anti")


@query("t2_sorted_union", FAILS + " SELECT line, row_number() OVER (ORDER BY line) AS n FROM (SELECT DISTINCT line FROM fl WHERE result <> 'ok_objects')")
def t2(v):
    lines = failures(v).where("result <> 'ok_objects'").select("line").distinct()
    return L.ordered(lines, [F.col("line")]).select("line", F.col("row_no").alias("n"))


@query("a14_convergence", FAILS + " SELECT 2 AS run_id, count(*) FILTER (WHERE result IN ('check_failed', 'mp_check_failed', 'mismatch')) AS open, count(*) FILTER (WHERE result IN ('check_failed', 'mp_check_failed', 'mismatch')) = 0 AS converged FROM fl WHERE run_id = (SELECT max(run_id) FROM fl)")
def a14(v):
    rows = failures(v)
    last = rows.agg(F.max("run_id").alias("run_id"))
    open_ = F.count_if(F.col("result").isin("check_failed", "mp_check_failed", "mismatch"))
    return rows.join(F.broadcast(last), "run_id").groupBy("run_id").agg(open_.alias("open"), (open_ == 0).alias("converged")).withColumn("run_id", F.col("run_id").cast("int"))
