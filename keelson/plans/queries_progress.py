"""Queries over journals, pages, call logs, request logs and streams."""

from pyspark.sql import functions as F

from keelson.functions import rules as R
from keelson.operators import progress as P
from keelson.operators import sinks as K
from keelson.operators.anchored import anchored_windows
from keelson.plans.registry import query
from keelson.sources import listing as L
from keelson.sources import manifest as M
from keelson.streaming import streams as T
from keelson.streaming.tracker import latest, page_events, track

J = """, jl AS (SELECT line_no, CASE WHEN starts_with(line, 'discovered|') THEN 'discovered' WHEN starts_with(line, 'done|') THEN 'done' ELSE 'cursor' END AS kind, line, regexp_extract(line, '^cursor\\|(.*)\\|([^|]*)$', 2) AS tk FROM f4_journal),
je AS (SELECT line_no, kind, CASE WHEN kind = 'cursor' THEN substr(line, 8, length(line) - 8 - length(tk)) ELSE substr(line, instr(line, '|') + 1) END AS prefix, CASE WHEN kind = 'cursor' THEN tk ELSE '' END AS token FROM jl),
js AS (SELECT prefix, coalesce(arg_max(kind, line_no) FILTER (WHERE kind <> 'discovered') = 'done', false) AS done, coalesce(arg_max(token, line_no) FILTER (WHERE kind = 'cursor'), '') AS token FROM je GROUP BY prefix)"""


def events(v):
    return M.journal_events(v("f4_journal"))


@query("p12_journal_line", J + " SELECT line_no, kind, prefix, token FROM je")
def p12(v):
    return events(v)


@query("s14_journal_scan", J + " SELECT kind, count(*) AS n, count(DISTINCT prefix) AS prefixes FROM je WHERE line_no < (SELECT max(line_no) FROM je) GROUP BY kind")
def s14(v):
    return M.journal_events(v("f4_journal"), torn_tail=True).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("prefix").alias("prefixes"))


@query("p13_format_journal", "SELECT line_no, line FROM f4_journal")
def p13(v):
    return events(v).select("line_no", R.journal_line(F.col("kind"), F.col("prefix"), F.col("token")).alias("line"))


@query("a4_journal_fold", J + " SELECT prefix, done, token FROM js")
def a4(v):
    return P.journal_states(events(v))


@query("j9_frontier", J + " SELECT prefix, token FROM js WHERE NOT done")
def j9(v):
    return P.frontier(P.journal_states(events(v)))


PG = """, tm AS (SELECT prefix, seq, count(*) AS n FROM f4_terminals GROUP BY ALL), op AS (SELECT p.prefix, p.seq, p.obj_count, p.next_token, greatest(obj_count - coalesce(n, 0), 0) AS outstanding FROM f4_pages p LEFT JOIN tm ON p.prefix = tm.prefix AND p.seq = tm.seq),
cu AS (SELECT *, sum(CASE WHEN outstanding > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY prefix ORDER BY seq ROWS UNBOUNDED PRECEDING) AS still FROM op),
ps AS (SELECT prefix, CAST(coalesce(max(seq) FILTER (WHERE still = 0), -1) AS INTEGER) AS position, coalesce(arg_max(next_token, seq) FILTER (WHERE still = 0), '') AS token, bool_or(next_token = '') AND coalesce(max(seq) FILTER (WHERE still = 0), -1) = max(seq) AS done FROM cu GROUP BY prefix)"""


def pages(v):
    return P.page_outstanding(v("f4_pages"), v("f4_terminals"))


@query("a13_page_completion", PG + " SELECT prefix, seq, outstanding FROM op")
def a13(v):
    return pages(v).select("prefix", "seq", "outstanding")


@query("w3_completion_position", PG + " SELECT prefix, position FROM ps")
def w3(v):
    return P.positions(pages(v)).select("prefix", F.col("position").cast("int").alias("position"))


@query("w4_continuation_token", PG + " SELECT prefix, token FROM ps")
def w4(v):
    return P.positions(pages(v)).select("prefix", "token")


@query("w5_done_test", PG + " SELECT prefix, done FROM ps")
def w5(v):
    return P.positions(pages(v)).select("prefix", "done")


@query("w6_snapshot", PG + " SELECT 0 AS batch_order, 'discovered|' || prefix AS line FROM ps UNION ALL SELECT 1, 'cursor|' || prefix || '|' || token FROM ps WHERE NOT done AND token <> '' UNION ALL SELECT 2, 'done|' || prefix FROM ps WHERE done")
def w6(v):
    return P.snapshot(P.positions(pages(v)))


@query("c5_resume", J + " SELECT i.key, i.version_id FROM f3_versions i WHERE EXISTS (SELECT 1 FROM (SELECT 'c' || CAST(regexp_extract(prefix, '[0-9]+') AS INTEGER) % 10 || '/' AS p, token AS t FROM js WHERE NOT done) e WHERE starts_with(i.key, e.p) AND i.key > e.p || 'k_5')")
def c5(v):
    left = P.frontier(P.journal_states(events(v)))
    group = F.pmod(F.regexp_extract("prefix", "[0-9]+", 0).cast("int"), F.lit(10)).cast("string")
    entries = left.select(F.concat(F.lit("c"), group, F.lit("/")).alias("prefix")).distinct().withColumn("token", F.concat("prefix", F.lit("k_5")))
    return L.resumed(v("f3_versions"), entries).select("key", "version_id")


@query("a2_call_metrics", "SELECT op, count(*) AS calls, round(avg(latency_ms), 3) AS avg_ms, round(sum(latency_ms) / 1000, 3) AS total_s FROM f5_calls GROUP BY op")
def a2(v):
    return P.call_metrics(v("f5_calls")).select("op", "calls", F.round("avg_ms", 3).alias("avg_ms"), F.round("total_s", 3).alias("total_s"))


FAULT = "CASE WHEN http_code <> 0 THEN http_code BETWEEN 500 AND 599 AND http_code NOT IN (501, 505) ELSE regexp_matches(err, 'dial tcp|connection refused|connection reset|broken pipe|i/o timeout|timeout|EOF|no such host|transport') END"


@query("p24_node_faults", f"SELECT call_id, {FAULT} AS fault FROM f5_calls")
def p24(v):
    return v("f5_calls").select("call_id", R.is_node_fault(F.col("http_code"), F.col("err")).alias("fault"))


@query("p22_head_states", "SELECT call_id, CASE WHEN http_code BETWEEN 200 AND 299 AND delete_marker_header OR http_code = 405 AND delete_marker_header THEN 'marker' WHEN http_code BETWEEN 200 AND 299 THEN 'not_marker' WHEN s3_code IN ('NoSuchKey', 'NoSuchVersion') OR http_code = 404 THEN 'absent' ELSE 'unclassified' END AS state FROM f5_calls")
def p22(v):
    return v("f5_calls").select("call_id", R.head_state(F.col("http_code"), F.col("s3_code"), F.col("delete_marker_header")).alias("state"))


@query("p23_delete_outcomes", "SELECT call_id, CASE WHEN http_code BETWEEN 200 AND 299 OR s3_code IN ('NoSuchVersion', 'NoSuchKey') THEN 'deleted' ELSE 'delete_failed' END AS state FROM f5_calls")
def p23(v):
    return v("f5_calls").select("call_id", R.delete_state(F.col("http_code"), F.col("s3_code")).alias("state"))


LOG = "SELECT call_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS time, CASE WHEN http_code = 0 THEN '-' ELSE 'req-' || call_id END AS req_id, 'bkt' AS bucket, CASE WHEN op <> 'list' THEN 'k/' || call_id END AS key, CASE WHEN op = 'list' THEN 'p' || worker || '/' END AS prefix, CASE WHEN http_code = 0 THEN 'N/A' ELSE CAST(http_code AS VARCHAR) END AS http_code, CASE WHEN s3_code = '' THEN '-' ELSE s3_code END AS s3_code, CASE WHEN err = '' THEN '-' ELSE err END AS err, op || ' failed' AS msg, 'WARN' AS level FROM f5_calls WHERE http_code NOT BETWEEN 200 AND 299"


def logged(v):
    """Failed calls with what their log lines name; calls without a response have no request id."""
    target = F.when(F.col("op") == "list", F.concat(F.lit("p"), "worker", F.lit("/"))).otherwise(F.concat(F.lit("k/"), "call_id"))
    return K.failure_log(v("f5_calls").withColumns({"req_id": F.when(F.col("http_code") == 0, "").otherwise(F.concat(F.lit("req-"), "call_id")), "bucket": F.lit("bkt"), "target": target}))


@query("p25_error_fields", f"SELECT call_id, http_code, s3_code, err FROM ({LOG})")
def p25(v):
    return logged(v).select("call_id", "http_code", "s3_code", "err")


@query("k4_failure_log", LOG)
def k4(v):
    from keelson.sources.shared import new_folder

    path = new_folder(v.spark, "log")
    rows = logged(v)
    K.write_log(rows, path)
    return K.read_log(v.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


STREAK = ", f AS (SELECT call_id, worker, CASE WHEN http_code BETWEEN 200 AND 299 THEN 0 ELSE 1 END AS bad FROM f5_calls), g AS (SELECT *, coalesce(sum(1 - bad) OVER (PARTITION BY worker ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM f), s AS (SELECT call_id, worker, CAST(coalesce(sum(bad) OVER (PARTITION BY worker, grp ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS streak FROM g)"


@query("w7_failure_streaks", STREAK + " SELECT call_id, worker, streak, streak >= 3 AS slow FROM s")
def w7(v):
    return P.failure_streaks(v("f5_calls")).select("call_id", "worker", "streak", "slow")


@query("w11_isolation", f", x AS (SELECT node, call_id, CAST({FAULT} AS INTEGER) AS f FROM f5_calls), y AS (SELECT *, sum(f) OVER (PARTITION BY node ORDER BY call_id ROWS UNBOUNDED PRECEDING) AS n FROM x) SELECT node, CAST(sum(f) AS BIGINT) AS faults, min(call_id) FILTER (WHERE n >= 3 AND f = 1) AS isolated_at FROM y GROUP BY node")
def w11(v):
    return P.isolation(v("f5_calls"))


@query("w12_tick_deltas", ", t AS (SELECT op AS scope, call_id // 100 AS tick, count(*) AS n FROM f5_calls GROUP BY ALL) SELECT scope, tick, n, n - lag(n, 1, 0) OVER (PARTITION BY scope ORDER BY tick) AS delta FROM t")
def w12(v):
    ticks = v("f5_calls").groupBy(F.col("op").alias("scope"), F.expr("call_id div 100").alias("tick")).agg(F.count("*").alias("n"))
    return P.tick_deltas(ticks)


@query("w13_every_nth", ", t AS (SELECT worker, call_id, row_number() OVER (PARTITION BY worker ORDER BY call_id) AS row_no FROM f5_calls) SELECT worker, call_id, row_no FROM t WHERE row_no % 25 = 0")
def w13(v):
    return P.every_nth(v("f5_calls"), "worker", "call_id", 25).select("worker", "call_id", "row_no")


KEYS = "list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: string_split(x, '=')[1])"


@query("p26_list_requests", f"SELECT page_id, method = 'GET' AND length(regexp_replace(trim(path, '/'), '[^/]', '', 'g')) <= 1 AND (contains('&' || query || '&', '&list-type=2&') OR len({KEYS}) > 0 AND len(list_filter({KEYS}, lambda k: k NOT IN ('prefix', 'delimiter', 'encoding-type', 'marker', 'max-keys'))) = 0) AS is_list FROM f9_access")
def p26(v):
    return v("f9_access").select("page_id", R.is_list_request(F.col("method"), F.col("path"), F.col("query")).alias("is_list"))


def calls(v):
    return v("f5_calls").withColumn("ts", F.col("ts").cast("timestamp"))


WIN = "SELECT epoch_us(ts) // 60000000 * 60000000 AS window_us, count(*) AS calls, round(avg(latency_ms), 3) AS avg_ms, round(max(latency_ms), 3) AS max_ms FROM f5_calls GROUP BY ALL"


@query("m1_latency_windows", WIN)
def m1(v):
    found = T.drained(T.latency(T.as_stream(calls(v))), "complete")
    return found.select(F.unix_micros("window_start").alias("window_us"), "calls", F.round("avg_ms", 3).alias("avg_ms"), F.round("max_ms", 3).alias("max_ms"))


@query("m2_anchored_windows", """, c AS (SELECT worker, epoch_us(ts) AS us, latency_ms FROM f5_calls),
a AS (SELECT worker, list_reduce(list_transform(list_sort(list(DISTINCT us)), lambda x: [x]), lambda done, x: CASE WHEN x[1] >= done[-1] + 60000000 THEN list_concat(done, x) ELSE done END) AS starts FROM c GROUP BY worker),
w AS (SELECT worker, unnest(starts) AS s, unnest(list_append(starts[2:], 9000000000000000000)) AS e FROM a)
SELECT w.worker, w.s AS window_us, count(*) AS calls, round(sum(latency_ms), 3) AS total_ms, round(max(latency_ms), 3) AS max_ms FROM c ASOF JOIN w ON c.worker = w.worker AND c.us >= w.s GROUP BY ALL""")
def m2(v):
    return anchored_windows(calls(v), 60).select("worker", F.unix_micros("window_start").alias("window_us"), "calls", F.round("total_ms", 3).alias("total_ms"), F.round("max_ms", 3).alias("max_ms"))


@query("m3_journal_stream", J + " SELECT prefix, done, token FROM js")
def m3(v):
    changes = T.drained(T.journal_frontier(T.as_stream(events(v), order="line_no")), "update")
    last = changes.groupBy("prefix").agg(F.max_by(F.struct("done", "token"), "line_no").alias("s"))
    return last.select("prefix", "s.done", "s.token")


@query("m3_journal_tracker", PG + " SELECT prefix, position, token, done FROM ps")
def m3_tracker(v):
    """Page accounting on a stream of pages and finished objects."""
    events = page_events(v("f4_pages"), v("f4_terminals"))
    return latest(T.drained(track(T.as_stream(events)), "update")).select("prefix", "position", "token", "done")


@query("m4_node_health")
def m4(v):
    return T.drained(T.node_health_stream(T.as_stream(v("f5_calls"), 1)))


@query("m5_checkpointed_batches", "SELECT op, count(*) AS n FROM f5_calls GROUP BY op")
def m5(v):
    from keelson.sources.shared import new_folder

    out = new_folder(v.spark, "progress")
    T.per_batch(T.as_stream(v("f5_calls")), lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}"), new_folder(v.spark, "state"))
    return v.spark.read.parquet(out).groupBy("op").agg(F.count("*").alias("n"))


@query("m6_streaming_recheck", "SELECT CASE WHEN trim(line) = '' THEN 'empty line' WHEN instr(line, '|') = 0 THEN 'too few fields' WHEN NOT starts_with(line, 'bkt|') THEN 'bucket mismatch' ELSE 'other' END AS reason, count(*) AS n FROM f6_lines GROUP BY ALL")
def m6(v):
    from keelson.sources.shared import new_folder

    path = new_folder(v.spark, "lines")
    v("f6_lines").select(F.col("line").alias("value")).write.text(path)
    found = T.drained(T.lines_stream(v.spark, path).select("line", R.mixed_reason(F.col("line"), "bkt").alias("reason")))
    name = F.when(F.col("reason").isin("empty line", "too few fields", "bucket mismatch"), F.col("reason")).otherwise("other")
    return found.groupBy(name.alias("reason")).agg(F.count("*").alias("n"))


@query("m7_marker_feed", "SELECT DISTINCT bucket, key, version_id FROM f3_versions WHERE is_delete_marker")
def m7(v):
    from keelson.sources.shared import new_folder

    rows = v("f3_versions").withColumn("last_modified", F.col("last_modified").cast("timestamp"))
    path = new_folder(v.spark, "markers")
    T.feed_markers(T.as_stream(rows), path, new_folder(v.spark, "state"))
    return T.fed_markers(v.spark, path)


@query("m8_running_counts", "SELECT op, count(*) AS n FROM f5_calls GROUP BY op")
def m8(v):
    return T.drained(T.running_counts(T.as_stream(v("f5_calls")), "op"), "complete")
