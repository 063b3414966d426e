"""Quality rules (operator 8): document statistics and a learned, ordered decision list.

Words are runs of characters other than space and U+0009 to U+000D. Statistics are exact and of whole texts, of any
length; null text counts as empty (no words, n_lines 1). Rows that repeat are each judged; a null doc_id is kept as it is
and has no label. An empty table gives an empty result. `quality_verdicts` looks at doc_id and text only;
`kept_documents` returns all columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import schema_of, text_of, tidy, tucked, untucked, written

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Statistics that rules may test, ratios to two digits of a per cent so that thresholds read well.
FEATURES = ("n_words", "mean_word", "symbol_pct", "dup_line_pct", "repeat_pct", "upper_pct", "digit_pct", "punct_pct", "distinct_pct", "line_words")
STATS_SPARK, STATS_ARROW = schema_of(doc_id="long", n_words="long", word_chars="long", n_symbols="long", n_dup_lines="long", n_repeat_words="long", n_lines="long", n_upper="long", n_digits="long", n_punct="long", n_distinct="long")


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more; each word counts once."""
    n = len(ids)
    if n < 4:
        return 0
    top = int(ids.max()) + 1
    pairs = ids[:-1] * top + ids[1:]
    if top > 2_000_000:  # the product of three would not fit: pairs are numbered first
        pairs = np.unique(pairs, return_inverse=True)[1]
        top = max(top, int(pairs.max()) + 1)
    keys = pairs[:-1] * top + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def stats_of(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines = data.split(b"\n")
    solid = [x for x in lines if x and not x.isspace()]
    codes = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return (
        n,
        len(text) - int(codes[9:14].sum() + codes[32]),
        int(sum(codes[ord(c)] for c in SYMBOLS)),
        len(solid) - len(set(solid)),
        repeated_words(ids),
        len(lines),
        int(codes[65:91].sum()),
        int(codes[48:58].sum()),
        int(codes[33:48].sum() + codes[58:65].sum() + codes[91:97].sum() + codes[123:127].sum()),
        len(seen),
    )


@tidy
def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [stats_of(x) for x in batch.column(1).to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * 10
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], schema=STATS_ARROW)


def document_stats(docs: DataFrame) -> DataFrame:
    """One row of counts for each row of docs (doc_id, text)."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_stats, STATS_SPARK)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    """The columns that rules test, as doubles; a ratio over nothing is 0."""
    ratio = lambda a, b, by=100: F.when(F.col(b) > 0, F.round(by * F.col(a) / F.col(b), 2)).otherwise(F.lit(0.0))
    return stats.withColumns({
        "mean_word": ratio("word_chars", "n_words", 1), "symbol_pct": ratio("n_symbols", "n_words"), "dup_line_pct": ratio("n_dup_lines", "n_lines"), "repeat_pct": ratio("n_repeat_words", "n_words"),
        "upper_pct": ratio("n_upper", "word_chars"), "digit_pct": ratio("n_digits", "word_chars"), "punct_pct": ratio("n_punct", "word_chars"), "distinct_pct": ratio("n_distinct", "n_words"), "line_words": ratio("n_words", "n_lines", 1),
    })


@dataclass
class Rule:
    """Reject where all conditions (feature, '>=' or '<', threshold) hold; from how many rows, at what precision."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)
    covered: int = 0
    precision: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & (F.col(name) >= at if sign == ">=" else F.col(name) < at)
        return out

    def mask(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, bool)
        for name, sign, at in self.conditions:
            out &= x[name] >= at if sign == ">=" else x[name] < at
        return out

    def __str__(self) -> str:
        return " and ".join(f"{a} {b} {c:g}" for a, b, c in self.conditions)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = 0.9, min_cover: int = 5, max_rules: int = 32, max_conditions: int = 3, grid: int = 32) -> list[Rule]:
    """Sequential covering: grow a conjunction by information gain over bad rows on two thirds of the rows, prune it
    by precision on the other third, keep it if it is precise enough on both, take its rows away, and go on."""
    n = len(bad)
    grow = np.arange(n) % 3 != 2
    left = np.ones(n, bool)
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, grid + 1)[1:-1])) if n else np.array([]) for k, v in x.items()}
    for k, v in x.items():  # bad rows are few: their own quantiles too
        if bad.any():
            cuts[k] = np.unique(np.concatenate([cuts[k], np.quantile(v[bad], np.linspace(0, 1, grid + 1))]))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule, here = Rule(), left & grow
        for _ in range(max_conditions):
            p, q = int((here & bad).sum()), int(here.sum())
            if not p or p == q:
                break
            best, gain = None, 0.0
            for name, values in x.items():
                v, b = values[here], bad[here]
                for at in cuts[name]:
                    up = v >= at
                    for sign, m in ((">=", up), ("<", ~up)):
                        pp, qq = int((m & b).sum()), int(m.sum())
                        if pp >= min_cover and qq < q and (g := pp * (np.log2(pp / qq) - np.log2(p / q))) > gain + 1e-9:
                            best, gain = (name, sign, round(float(at), 4)), g
            if best is None:
                break
            rule.conditions.append(best)
            here = left & grow & rule.mask(x, n)
        if not rule.conditions:
            break

        def worth(r: Rule, part: np.ndarray) -> tuple[float, int]:
            m = r.mask(x, n) & left & part
            return (int((m & bad).sum()) + 0.5) / (int(m.sum()) + 1), int((m & bad).sum())

        while len(rule.conditions) > 1:  # prune from the end while the other third does not object
            shorter = Rule(rule.conditions[:-1])
            if worth(shorter, ~grow)[0] < worth(rule, ~grow)[0]:
                break
            rule = shorter
        hit = rule.mask(x, n) & left
        rule.covered = int(hit.sum())
        rule.precision = float((hit & bad).sum() / max(1, hit.sum()))
        exact = (hit & bad & grow).sum() / max(1, (hit & grow).sum())
        held = (hit & bad & ~grow).sum() / max(1, (hit & ~grow).sum())
        if rule.covered < min_cover or exact < min_precision or ((hit & ~grow).any() and held < min_precision):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def rejected(rules: list[Rule]) -> Column:
    """The ordered conditional expression: the number of the first rule that fits, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        out = F.when(rules[i - 1].column(), F.lit(i)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **how: float) -> list[Rule]:
    """Learn rules from the statistics of labelled documents.

    max_labelled bounds what is fitted on: the labels with the least hash of doc_id. So their list can be sent to the
    tasks, and only texts with such a label are counted. Of rows that share a labelled doc_id the one with the least statistics
    teaches, so no more rows than labels come to the driver. Rows whose label is null, or that the base rules reject already,
    teach nothing. No usable label: no rules."""
    lab = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    share = min(1.0, 1.2 * max_labelled / max(1, lab.count()))  # of the hashes, so that few rows more than the bound are sorted
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    taken = written(lab.withColumn("_h", low).where(F.col("_h") < int(share * (1 << 30))).orderBy("_h", "doc_id").limit(max_labelled), "quality-labels")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).join(F.broadcast(taken.select("doc_id")), "doc_id", "left_semi")
    least = with_features(document_stats(texts)).where(~base_failed()).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("_f"))
    rows = least.join(F.broadcast(taken), "doc_id").select("_h", "doc_id", "_f.*", "quality")
    found = rows.toPandas().sort_values(["_h", "doc_id", *FEATURES], kind="stable")
    return learn({k: found[k].to_numpy(float) for k in FEATURES}, found["quality"].to_numpy() == 0, **how)


def quality_verdicts(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **how: float) -> DataFrame:
    """doc_id, the counts, base_failed, rule (which learned rule rejects, else null) and kept, a row for each row of docs."""
    rules = fit(docs, labels, max_labelled, **how)
    out = with_features(document_stats(docs)).withColumns({"base_failed": base_failed(), "rule": rejected(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


@tidy
def _stats_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is the text, and its statistics."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            rows = [stats_of(x or "") for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in zip(*rows))], names=[*batch.schema.names, *STATS_ARROW.names[1:]])


def kept_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, **how: float) -> DataFrame:
    """docs, with its own columns, without the rows that the base rules or the learned rules reject.

    The statistics stand beside the whole rows, so that repeated doc_ids need no join; the decision list is the ordered
    conditional expression over them. Columns of docs are renamed on the way, so that none clashes."""
    rules = fit(docs, labels, max_labelled, **how)
    rows, own = tucked(docs)
    # texts cross to Python and back once
    rows = rows.select(*(n for c, n in own.items() if c != "text"), F.col(own["text"]).cast("string").alias(own["text"]))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"{c} bigint" for c in STATS_ARROW.names[1:]]
    judged = with_features(rows.mapInArrow(_stats_beside, ", ".join(fields)))
    return judged.where(~base_failed() & rejected(rules).isNull()).select(*untucked(own))
