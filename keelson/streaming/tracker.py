"""The journal tracker as a stream: pages, their outstanding objects and what of a prefix is provably complete.

Events (prefix, kind, seq, n, token): `seed` (token to start from), `page` (seq, n objects, next token; an empty one ends the
listing) and `terminal` (n objects of page seq are finished). Tasks add up terminals before the shuffle, so a prefix
with most of the events costs one row for each of its pages and tasks. State is kept by prefix: a small head, and a map from
page to outstanding objects and next token, of which pages leave as the position passes them. A prefix that is done
leaves the state as a whole; only its name stays in the output. Terminals of pages or prefixes that aren't known, late
ones and more of them than a page has objects are ignored, so progress is told too low rather than too high."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "prefix string, kind string, seq int, n bigint, token string"
ARROW = pa.schema([("prefix", pa.string()), ("kind", pa.string()), ("seq", pa.int32()), ("n", pa.int64()), ("token", pa.string())])
#: Pages whose terminals a task adds up before it passes the sums on, and rows of a batch of sums.
SUMMED_PAGES, BATCH = 500_000, 10_000
CHANGES = "prefix string, position int, token string, done boolean, version bigint"


def added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terminals of a page as one row for many batches of a task; sums are held of a bounded number of pages."""
    sums: list[pa.Table] = []

    def folded() -> pa.Table:
        total = pa.concat_tables(sums).group_by(["prefix", "seq"], use_threads=False).aggregate([("n", "sum")])
        kind, token = (pa.array([x] * len(total), pa.string()) for x in ("terminal", ""))
        return pa.Table.from_arrays([total["prefix"], kind, total["seq"], total["n_sum"], token], schema=ARROW)

    held = 0
    for batch in batches:
        ends = pc.fill_null(pc.equal(batch.column("kind"), "terminal"), False)
        rows = pa.RecordBatch.from_arrays(batch.columns, schema=ARROW)
        if not pc.all(ends).as_py():
            yield rows.filter(pc.invert(ends))
        sums.append(pa.Table.from_batches([rows.filter(ends)]))
        held += len(sums[-1])
        if held > 2 * SUMMED_PAGES:
            sums = [folded()]
            held = len(sums[0])
            if held > SUMMED_PAGES:
                yield from sums[0].to_batches(BATCH)
                sums, held = [], 0
    if held:
        yield from folded().to_batches(BATCH)


class Tracker(StatefulProcessor):
    """A row of CHANGES for each prefix that a batch has events of; its version counts the prefix's changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "base string, ended boolean, last int, position int, token string, version bigint")
        self.pages = handle.getMapState("pages", "seq int", "outstanding bigint, token string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seeds, pages, ends = [], [], defaultdict(int)
        for part in rows:
            for kind, seq, n, token in zip(part["kind"], part["seq"], part["n"], part["token"]):
                if kind == "terminal":
                    ends[int(seq)] += int(n)
                else:
                    (seeds if kind == "seed" else pages).append((int(seq), int(n), token))
        known = self.head.exists()
        if not known and not seeds and not pages:
            return  # terminals of a prefix that isn't known, or is done
        base, ended, last, position, token, version = self.head.get() if known else ("", False, -1, -1, "", 0)
        base = seeds[-1][2] if seeds else base
        first = last  # pages behind it can't be in the state
        met: dict[int, tuple[int, str] | None] = {}  # pages as they are after this batch; None: not known
        changed: set[int] = set()

        def at(seq: int) -> tuple[int, str] | None:
            if seq not in met:
                met[seq] = self.pages.getValue((seq,)) if position < seq <= first else None
            return met[seq]

        for seq, n, next_token in pages:
            if seq > last or seq > position and at(seq) is None:
                met[seq] = (n, next_token)
                changed.add(seq)
                last, ended = max(last, seq), ended or next_token == ""
        for seq, n in ends.items():
            if seq > position and (page := at(seq)) is not None:
                met[seq] = (max(0, page[0] - n), page[1])
                changed.add(seq)
        passed = position
        while passed < last and (page := at(passed + 1)) is not None and page[0] <= 0:
            passed, token = passed + 1, page[1]
        gone, position = range(position + 1, min(passed, first) + 1), passed
        done = ended and last >= 0 and position == last
        # pages that come and go within a batch are never written
        if done:
            if known:
                self.head.clear()
                self.pages.clear()
        else:
            for seq in gone:
                self.pages.removeKey((seq,))
            for seq in sorted(changed):
                if seq > position:
                    self.pages.updateValue((seq,), met[seq])
            self.head.update((base, ended, last, position, token, version + 1))
        yield pd.DataFrame([(key[0], position, token if position >= 0 else base, done, version + 1)], columns=["prefix", "position", "token", "done", "version"])

    def close(self) -> None:
        pass


def page_events(pages: DataFrame, terminals: DataFrame) -> DataFrame:
    """Events of pages (prefix, seq, obj_count, next_token) and of terminals (prefix, seq)."""
    of = pages.select("prefix", F.lit("page").alias("kind"), F.col("seq").cast("int").alias("seq"), F.col("obj_count").cast("bigint").alias("n"), F.col("next_token").alias("token"))
    return of.unionByName(terminals.select("prefix", F.lit("terminal").alias("kind"), F.col("seq").cast("int").alias("seq"), F.lit(1).cast("bigint").alias("n"), F.lit("").alias("token")))


def with_rocks(spark: SparkSession) -> None:
    """Keyed state of this kind lives in RocksDB, on the executors' disks and in the checkpoint, not in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def track(events: DataFrame) -> DataFrame:
    """Changes of prefixes (prefix, position, token, done, version) from a stream of events; output mode update."""
    with_rocks(events.sparkSession)
    whole = [F.coalesce("seq", F.lit(-1)).alias("seq"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token")]
    thin = events.select("prefix", "kind", *whole).mapInArrow(added_up, EVENTS)
    return thin.groupBy("prefix").transformWithStateInPandas(Tracker(), CHANGES, "Update", "None")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each prefix: prefix, position, token, done. A prefix that is seeded again after it was done starts
    anew; being done once counts."""
    order = F.struct("done", "version")
    each = changes.groupBy("prefix").agg(F.max_by(F.struct("position", "token", "done"), order).alias("s"))
    return each.select("prefix", "s.*")
