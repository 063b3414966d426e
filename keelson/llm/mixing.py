"""Mixing sources to target weights (operator 2) by Pfair scheduling, in DataFrame functions only.

A source with a of the period's slots releases its j-th block (from 1) at floor((j - 1) * period / a), due at
ceil(j * period / a). Each slot takes the released block with the earliest deadline, so at every slot a source has had
its share of blocks to within less than one. The schedule of one period repeats, hence a block's slot follows from its
number within its source; only numbering needs a shuffle.

A period has 1000 slots for every 500 sources or part of them, so any number of sources has room; one task makes its
schedule from one row that holds the sources, in time slots * different shares.

Every row gets a place; none is dropped. Where a source runs out its later slots stay empty, and the others go on in the
same order. Null sources count as the source ''. Within a source, rows are in the order of md5(doc_id), then doc_id, then
their place in the files; rows that repeat take places one after the other. Rows are numbered range by range of that
order, also where one doc_id or null holds most of them. Texts aren't looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import SHARE, tucked, untucked, written
from keelson.llm.rows import addressed

#: Rows of a source that one task numbers at a time, about.
NUMBERED = 2_000
#: Slots of a period for every so many sources.
SLOTS, SOURCES = 1000, 500
#: Slots of a plan that is sent to all tasks, some MB.
SENT_SLOTS = 100_000


def shares(sizes: DataFrame, weights: dict[str, float] | None, alpha: float, period: int) -> DataFrame:
    """source and a, its slots of a period: weights (or size ** alpha) scaled, one slot at least, largest remainders first."""
    spark = sizes.sparkSession
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(float(alpha)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "_s string, _w double")
        sizes = sizes.join(given, F.col("source") == F.col("_s"), "left")
        w = F.coalesce("_w", F.lit(0.0))
    every = Window.partitionBy(F.lit(0))  # a row for each source
    quota = F.col("w") / F.sum("w").over(every) * period
    t = sizes.withColumn("w", w).withColumn("quota", quota).withColumn("base", F.greatest(F.lit(1), F.floor("quota")).cast("int"))
    t = t.withColumn("left", (F.lit(period) - F.sum("base").over(every)).cast("int"))
    more = F.row_number().over(every.orderBy((F.col("quota") - F.floor("quota")).desc(), "source"))
    # slots too many: one each from the largest sources of two or more, then further ones in proportion; the last one stays
    spare = t.where("left < 0 and base > 1").select("source", "base", "left", F.explode(F.sequence(F.lit(1), F.col("base") - 1)).alias("k"))
    order = (F.when(F.col("k") > 1, F.col("k") / F.col("base")).otherwise(0.0), F.col("base").desc(), F.col("source"))
    less = spare.withColumn("less", F.row_number().over(every.orderBy(*order))).where("less <= -left").groupBy(F.col("source").alias("_l")).agg(F.count("*").alias("less"))
    t = t.withColumn("more", more).join(F.broadcast(less), F.col("source") == F.col("_l"), "left")
    a = F.col("base") + F.when((F.col("left") > 0) & (F.col("more") <= F.col("left")), 1).otherwise(0) - F.coalesce("less", F.lit(0))
    return t.select("source", a.cast("int").alias("a"))


def schedule(share: DataFrame, period: int) -> DataFrame:
    """source, a, j (from 0) and slot: one period, by earliest deadline among released blocks, of equal ones the first source.

    Sources of one share have the same releases and deadlines, so they take turns: a group of m of them is one queue, whose
    position q is block q div m of source q mod m. A fold over the slots picks a queue at each; there are at most about
    sqrt(2 * period) different shares. One row of arrays holds the sources; slots are collected in chunks."""
    numbered = share.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source")) - 1)  # a row for each source
    groups = numbered.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("i", "source"))).alias("m"))
    packed = groups.agg(F.collect_list(F.struct("a", "m")).alias("g")).where(F.size("g") > 0)
    # the state of the fold is the position of each queue, and what the slots of a chunk took
    block = "acc.done[x] div size(g[x].m)"
    ready = f"{block} < g[x].a and ({block} * {period}L) div g[x].a <= t"
    first = f"named_struct('due', (({block} + 1) * {period}L + g[x].a - 1) div g[x].a, 'i', g[x].m[cast(acc.done[x] % size(g[x].m) as int)].i, 'x', x)"
    pick = f"array_min(transform(filter(sequence(0, size(g) - 1), x -> {ready}), x -> {first})).x"
    step = f"transform(array({pick}), k -> named_struct('done', transform(acc.done, (q, x) -> if(x = k, q + 1, q)), 'took', concat(acc.took, array(named_struct('slot', t, 'x', k, 'q', acc.done[k])))))[0]"
    none = "cast(array() as array<struct<slot:int,x:int,q:bigint>>)"
    chunk = max(1, math.isqrt(period))
    part = f"aggregate(sequence(c * {chunk}, least({period}, (c + 1) * {chunk}) - 1), named_struct('done', whole.done, 'took', {none}), (acc, t) -> {step})"
    joined = f"transform(array({part}), p -> named_struct('done', p.done, 'took', concat(whole.took, array(p.took))))[0]"
    fold = f"flatten(aggregate(sequence(0, {-(-period // chunk) - 1}), named_struct('done', transform(g, x -> 0L), 'took', cast(array() as array<array<struct<slot:int,x:int,q:bigint>>>)), (whole, c) -> {joined}).took)"
    named = "transform(took, y -> named_struct('source', g[y.x].m[cast(y.q % size(g[y.x].m) as int)].source, 'a', g[y.x].a, 'j', cast(y.q div size(g[y.x].m) as int), 'slot', y.slot))"
    took = packed.select("g", F.expr(fold).alias("took")).select(F.explode(F.expr(named)).alias("y"))
    return took.select("y.*")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, block: int = 8, period: int | None = None) -> DataFrame:
    """docs with source_rank (from 0 within the source), slot and position, by which the mixture is ordered. Columns of
    docs that have these names give way to them.

    weights: target weight of each source; None: size ** alpha. block: rows that one slot takes. period: slots after
    which the schedule repeats, to whose fractions weights are rounded; None: SLOTS for every SOURCES sources."""
    placed, own = _placed(docs, weights, alpha, block, period)
    places = ("source_rank", "slot", "position")
    return placed.select(*untucked(own, places), *places)


def mix_in_order(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, block: int = 8, period: int | None = None) -> DataFrame:
    """docs with its own columns, in the order of the mixture: files of a range of positions each, sorted."""
    placed, own = _placed(docs, weights, alpha, block, period)
    placed = placed.select(*own.values(), "position")
    return placed.repartitionByRange("position").sortWithinPartitions("position").select(*untucked(own))


def digits_of(n: int) -> int:
    """How many hexadecimal digits of a hash split n rows into parts of about NUMBERED."""
    digits = 0
    while n > NUMBERED * 16**digits and digits < 8:
        digits += 1
    return digits


def _placed(docs: DataFrame, weights: dict[str, float] | None, alpha: float, block: int, period: int | None) -> tuple[DataFrame, dict[str, str]]:
    rows, own = tucked(docs)
    key = F.coalesce(F.col(own["source"]).cast("string"), F.lit(""))
    id_ = own["doc_id"]
    rows = addressed(rows).withColumns({"_source": key, "_order": F.md5(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary"))})
    sizes = written(rows.groupBy(F.col("_source").alias("source")).agg(F.count("*").alias("n")), "mix-sizes")
    found, most, total = sizes.agg(F.count("*"), F.max("n"), F.sum("n")).first()
    period = period or SLOTS * max(1, -(-found // SOURCES))
    if found > period:
        raise ValueError(f"{found} sources need a period of as many slots at least")
    plan = schedule(shares(sizes, weights, alpha, period), period)
    rows = rows.withColumn("_part", F.substring("_order", 1, digits_of(most or 0)))
    # a part that holds far more than its share of hashes holds a doc_id, or null, with very many rows; such parts are few
    counts = written(rows.groupBy("_source", "_part").agg(F.count("*").alias("_n")), "mix-parts")
    over = counts.where(F.col("_n") > max(8 * NUMBERED, (total or 0) / SHARE))
    large = over.agg(F.max("_n")).first()[0]
    tie = F.lit("")
    if large:
        rows = rows.join(F.broadcast(over.select("_source", "_part", F.lit(True).alias("_over"))), ["_source", "_part"], "left")
        tie = F.when(F.col("_over"), F.concat("_order", F.substring(F.md5(F.concat_ws(",", "_file", "_row").cast("binary")), 1, digits_of(large)))).otherwise("")
        rows = rows.withColumn("_tie", tie)
        counts = rows.groupBy("_source", "_part", "_tie").agg(F.count("*").alias("_n"))
    else:
        rows, counts = rows.withColumn("_tie", tie), counts.withColumn("_tie", tie)
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_part", "_tie").rowsBetween(Window.unboundedPreceding, -1))
    plan = written(plan.select(F.col("source").alias("_ps"), F.col("a").alias("_a"), F.col("j").alias("_j"), F.col("slot").alias("_slot")), "mix-plan")
    share = plan.where("_j = 0").select(F.col("_ps").alias("_as"), F.col("_a").alias("_share"))
    starts = counts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.col("_tie").alias("_t"), F.coalesce(before, F.lit(0)).alias("_before"))
    starts = starts.join(share, F.col("_s") == F.col("_as"))
    within = F.row_number().over(Window.partitionBy("_source", "_part", "_tie").orderBy("_order", id_, "_file", "_row"))
    ranked = rows.withColumn("_within", within).join(starts, (F.col("_source") == F.col("_s")) & (F.col("_part") == F.col("_p")) & (F.col("_tie") == F.col("_t")))
    ranked = ranked.withColumn("source_rank", (F.col("_before") + F.col("_within") - 1).cast("long"))
    ranked = ranked.withColumn("_block", F.expr(f"source_rank div {block}")).withColumn("_jj", F.expr("cast(_block % _share as int)"))
    # a row for each slot: sent around up to so many; beyond, a large source's blocks spread over its slots
    plan = F.broadcast(plan) if period <= SENT_SLOTS else plan
    out = ranked.join(plan, (F.col("_source") == F.col("_ps")) & (F.col("_jj") == F.col("_j")))
    slot = F.expr(f"(_block div _share) * {period} + _slot").cast("long")
    return out.withColumn("slot", slot).withColumn("position", F.expr(f"slot * {block} + source_rank % {block}").cast("long")), own
