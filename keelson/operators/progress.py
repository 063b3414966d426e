"""Progress that can be proved: journals, pages with outstanding objects, resume points; and rules over call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import rules as R
from keelson.sources.listing import in_ranges, numbered


def journal_states(events: DataFrame) -> DataFrame:
    """prefix, done and token: the last of cursor and done decides, the last cursor's token stays."""
    last = lambda c, cond: F.max_by(c, F.when(cond, F.col("line_no")))
    moves = F.col("kind") != "discovered"
    each = events.groupBy("prefix").agg(F.max(F.when(moves, F.col("line_no"))).alias("_m"), last("kind", moves).alias("_k"), F.max(F.when(F.col("kind") == "cursor", F.col("line_no"))).alias("_c"), last("token", F.col("kind") == "cursor").alias("_t"))
    return each.select("prefix", (F.col("_m").isNotNull() & (F.col("_k") == "done")).alias("done"), F.when(F.col("_c").isNotNull(), F.col("_t")).otherwise("").alias("token"))


def frontier(states: DataFrame) -> DataFrame:
    return states.where(~F.col("done")).select("prefix", "token")


def page_outstanding(pages: DataFrame, terminals: DataFrame) -> DataFrame:
    """pages (prefix, seq, obj_count, next_token) with outstanding; terminals of unknown pages are ignored."""
    done = terminals.groupBy("prefix", "seq").agg(F.count("*").alias("_t"))
    return pages.join(done, ["prefix", "seq"], "left").select(*pages.columns, F.greatest(F.col("obj_count") - F.coalesce("_t", F.lit(0)), F.lit(0)).alias("outstanding"))


def positions(outstanding: DataFrame) -> DataFrame:
    """prefix, position (greatest page with all up to it complete, -1 if none), token there, and done.

    The position is the greatest page below the least open one: two grouped extremes, of which tasks combine their own part
    before the shuffle, so no task reads the pages of a prefix in a row."""
    each = outstanding.groupBy("prefix").agg(F.min(F.when(F.col("outstanding") > 0, F.col("seq"))).alias("_open"), F.max("seq").alias("_last"), F.max(F.when(F.col("next_token") == "", 1).otherwise(0)).alias("_ended"))
    full = outstanding.join(each.select(F.col("prefix").alias("_p"), "_open"), F.col("prefix").eqNullSafe(F.col("_p"))).where(F.col("_open").isNull() | (F.col("seq") < F.col("_open")))
    at = full.groupBy(F.col("prefix").alias("_p")).agg(F.max(F.struct("seq", "next_token")).alias("_at"))
    p = F.coalesce(F.col("_at.seq"), F.lit(-1))
    found = each.join(at, F.col("prefix").eqNullSafe(F.col("_p")), "left")
    return found.select("prefix", p.alias("position"), F.coalesce("_at.next_token", F.lit("")).alias("token"), ((F.col("_ended") == 1) & (p == F.col("_last"))).alias("done"))


def snapshot(positions_: DataFrame) -> DataFrame:
    """batch_order, line: discovered prefixes, then cursors with a token that a line can hold, then done ones."""
    ok = (F.col("token") != "") & ~F.col("token").rlike(r"[|\n]")
    line = lambda kind: R.journal_line(F.lit(kind), F.col("prefix"), F.col("token"))
    return (
        positions_.select(F.lit(0).alias("batch_order"), line("discovered").alias("line"))
        .unionByName(positions_.where(~F.col("done") & ok).select(F.lit(1).alias("batch_order"), line("cursor").alias("line")))
        .unionByName(positions_.where("done").select(F.lit(2).alias("batch_order"), line("done").alias("line")))
    )


def call_metrics(calls: DataFrame) -> DataFrame:
    """op, calls, avg_ms (0 if none), total_s."""
    return calls.groupBy("op").agg(F.count("*").alias("calls"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_ms"), (F.sum("latency_ms") / 1000).alias("total_s"))


def failure_streaks(calls: DataFrame, threshold: int = 3) -> DataFrame:
    """calls with streak (failures in a row of the worker before this call) and slow (streak at the threshold).

    The failures before a call, less those up to the last success before it; both are carried from range to range of the
    worker's calls, so that no task holds a worker."""
    failed = ~((F.col("http_code") >= 200) & (F.col("http_code") < 300))
    at = in_ranges(calls.withColumn("_f", failed.cast("int")), ["worker"], [F.col("call_id")])
    within = Window.partitionBy("worker", "_range").orderBy("call_id")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_so_far", F.sum("_f").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("_settled", F.when(F.col("_f") == 0, F.col("_so_far")))  # failures up to a success
    each = at.groupBy("worker", "_range").agg(F.sum("_f").alias("_n"), F.max("_settled").alias("_s"))
    ranges = Window.partitionBy("worker").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_n0", F.coalesce(F.sum("_n").over(ranges), F.lit(0)))
    each = each.withColumn("_s0", F.coalesce(F.max(F.col("_n0") + F.col("_s")).over(ranges), F.lit(0)))
    starts = each.select(F.col("worker").alias("_w"), F.col("_range").alias("_r"), "_n0", "_s0")
    at = at.withColumns({"_c": F.coalesce(F.sum("_f").over(before), F.lit(0)), "_last": F.max("_settled").over(before)})
    at = at.join(starts, F.col("worker").eqNullSafe(F.col("_w")) & (F.col("_range") == F.col("_r")))
    settled = F.coalesce(F.col("_n0") + F.col("_last"), F.col("_s0"))
    streak = (F.col("_n0") + F.col("_c") - settled).cast("bigint")
    return at.select(*calls.columns, streak.alias("streak"), (streak >= threshold).alias("slow"))


def isolation(calls: DataFrame, threshold: int = 3) -> DataFrame:
    """node, faults and isolated_at: the call that is the threshold-th fault of its node."""
    fault = R.is_node_fault(F.col("http_code"), F.col("err"))
    nodes = calls.groupBy("node").agg(F.count_if(fault).alias("faults"))
    # tasks keep their first faults of a node only, before the shuffle
    first = calls.where(fault).select("node", "call_id").withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy("call_id"))).where(F.col("_n") <= threshold)
    at = first.where(F.col("_n") == threshold).select("node", F.col("call_id").alias("isolated_at"))
    return nodes.join(at, "node", "left").select("node", "faults", "isolated_at")


def tick_deltas(ticks: DataFrame) -> DataFrame:
    """ticks (scope, tick, n) with delta since the tick before."""
    at = numbered(ticks, ["scope"], [F.col("tick")])
    last = at.select(F.col("scope").alias("_s"), (F.col("row_no") + 1).alias("_r"), F.col("n").alias("_before"))
    joined = at.join(last, F.col("scope").eqNullSafe(F.col("_s")) & (F.col("row_no") == F.col("_r")), "left")
    return joined.select(*ticks.columns, (F.col("n") - F.coalesce("_before", F.lit(0))).alias("delta"))


def every_nth(rows: DataFrame, scope: str, order: str, n: int) -> DataFrame:
    """The rows whose number within the scope is a multiple of n."""
    return numbered(rows, [scope], [F.col(order)]).where(F.col("row_no") % n == 0)


def latency_windows(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """window_start, calls, avg_ms, max_ms by windows from the epoch on; works on streams too."""
    each = calls.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("calls"), F.avg("latency_ms").alias("avg_ms"), F.max("latency_ms").alias("max_ms"))
    return each.select(F.col("w.start").alias("window_start"), "calls", "avg_ms", "max_ms")
