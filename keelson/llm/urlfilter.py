"""URL filters (operator 1): fixed host and path rules, then association rules of URL tokens mined from labels.

Spark's FP-growth finds token combinations among labelled URLs; those whose confidence and support are high enough are
kept, less any that a shorter rule with as high a confidence makes needless. Tokens that nearly the same URLs have (a
site's template) would make a power set of frequent sets: one of them is mined, and the others take its place in the rules
where exact counts of their own allow it. A rule is posted under its rarest token only; URLs look their tokens up there
and then check the whole rule. DataFrame functions only.

What is mined on is bounded: the labelled rows with the least hash (`max_labelled`), and tokens whose support is a share
of these (`min_share`). So the items that FP-growth brings to the driver are bounded too: no more than the tokens of a
URL divided by that share. Rules are joined to the tokens of all rows; tokens that many rows have are dealt to several
tasks, and rows get their verdict back by their address (`rows`), so that urls that repeat, or are null, weigh nothing.

Null urls and those without '://' have an empty host and path, fit no rule and are allowed. Urls of any length are read
whole. Rows that repeat each get the verdict. Labels that are null teach nothing; without labels there are no mined rules.
An empty table gives an empty result. Other columns of pages are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import SHARE, ascii_lower, join_spread, written
from keelson.llm.rows import addressed

#: (verdict, host, path)
Rule = tuple[str, str, str]
BLOCK = "y=block"
#: Tokens are alike if so much of the support, in rows, has one without the other at most.
ALIKE = 0.1


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none does."""
    text = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: the host and its labels, path parts with digits as '#', the last part's ending, query names."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("l="), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p="), F.regexp_replace(ascii_lower(x), "[0-9]+", "#")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("q="), ascii_lower(F.substring_index(x, "=", 1))))
    ending = F.concat(F.lit("e="), F.regexp_extract(ascii_lower(path), r"[^/]\.([^./]+)$", 1))
    every = F.concat(F.array(F.concat(F.lit("h="), host)), labels, parts, F.array(ending), names)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: F.length(x) > 2)))


def token_groups(rows: DataFrame, often: DataFrame, slack: int) -> DataFrame:
    """leader and members: the tokens of `often` (t, c rows each) that are alike to a leader, from rows (items).

    Two tokens are alike if at most `slack` rows have one without the other, either way. A token's leader is the most frequent
    one (of equal ones the least) that is alike to it, itself included. Only pairs whose numbers of rows allow it are counted."""
    counted = rows.select("_row", F.explode("items").alias("t")).join(often.select("t", "c"), "t")
    counted = counted.groupBy("_row").agg(F.collect_list(F.struct("c", "t")).alias("items"))
    near = lambda x: F.filter("items", lambda y: F.abs(x["c"] - y["c"]) <= slack)
    pairs = counted.select(F.explode(F.flatten(F.transform("items", lambda x: F.transform(near(x), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    met = pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))
    alike = met.where((F.col("a.c") - F.col("n") <= slack) & (F.col("b.c") - F.col("n") <= slack))
    led = alike.groupBy(F.col("a.t").alias("t")).agg(F.min_by("b.t", F.struct(-F.col("b.c"), F.col("b.t"))).alias("leader"))
    each = led.select("leader", "t").union(led.select("leader", F.col("leader").alias("t")))
    return each.groupBy("leader").agg(F.collect_set("t").alias("members"))


def in_turn(rules: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rules with each item replaced by each member of its group in turn (groups: key and members), items sorted."""
    each = rules.select("*", F.explode("items").alias("_t"))
    each = each.join(groups.select(F.col(key).alias("_t"), "members"), "_t").groupBy(*rules.columns).agg(F.collect_list("members").alias("_members"))
    ways = F.aggregate("_members", F.array(F.array().cast("array<string>")), lambda done, m: F.flatten(F.transform(done, lambda d: F.transform(m, lambda x: F.concat(d, F.array(x))))))
    return each.withColumn("items", F.explode(ways)).select(F.array_sort(F.array_distinct("items")).alias("items"), *(c for c in rules.columns if c != "items"))


def recounted(items: DataFrame, rows: DataFrame, often: DataFrame) -> DataFrame:
    """items (distinct), n and n_block: how many of rows (block, items) have them all. Posted under the rarest item."""
    items = items.select("items").distinct()
    rarest = items.select("items", F.explode("items").alias("t")).join(often.select("t", "c"), "t").groupBy("items").agg(F.min_by("t", F.struct("c", "t")).alias("t"))
    have = rows.select("block", F.col("items").alias("_have"), F.explode("items").alias("t"))
    found = have.join(rarest, "t").where(F.size(F.array_except("items", "_have")) == 0)
    return found.groupBy("items").agg(F.count("*").alias("n"), F.count(F.when(F.col("block"), 1)).alias("n_block"))


def mined_rules(labelled: DataFrame, min_support: int, min_confidence: float) -> DataFrame:
    """items (sorted), n, n_block and confidence of the rules that stand, from rows (tokens, block).

    All tokens that min_support rows to block have are mined, but in three steps that keep the frequent sets few. Tokens of
    the very same rows are mined as one. Of tokens that are alike (ALIKE of min_support rows differ at most) the leader is
    mined, and the others then take its place in rules where their own exact counts allow it: a rule has no two tokens of
    one group. A token that is to block wherever it is met is a rule of its own and goes no further, since no set that holds
    it is surer."""
    tokens = labelled.withColumn("_row", F.monotonically_increasing_id()).select("_row", "block", F.explode("tokens").alias("t"))
    tokens = written(tokens, "url-tokens")
    n = labelled.count()
    same = [F.bit_xor(F.xxhash64(F.lit(i), F.col("_row"))).alias(f"x{i}") for i in range(2)]  # 128 bits of the set of rows
    often = tokens.groupBy("t").agg(F.count("*").alias("c"), F.count(F.when(F.col("block"), 1)).alias("b"), *same)
    # a token in nearly all rows says nothing
    often = often.where((F.col("b") >= min_support) & (F.col("c") < 0.95 * max(n, 1)))
    equal = often.groupBy("c", "b", "x0", "x1").agg(F.min("t").alias("t"), F.collect_list("t").alias("members"))
    equal = written(equal.select("t", "c", "b", "members"), "url-alike")
    rows = tokens.join(equal.select("t"), "t").groupBy("_row", "block").agg(F.collect_list("t").alias("items"))
    rows = written(rows, "url-rows")
    groups = written(token_groups(rows, equal, int(ALIKE * min_support)), "url-groups")
    mined = groups.join(equal.where("b < c"), F.col("leader") == F.col("t")).select("t")
    known = rows.select("_row", "block", F.explode("items").alias("t")).join(mined, "t").groupBy("_row", "block").agg(F.collect_list("t").alias("items"))
    known = written(known.select("block", "items"), "url-mined")
    counts = known.agg(F.count("*"), F.count(F.when(F.col("block"), 1))).first()
    sure = equal.where("b = c").join(groups, F.col("t") == F.col("leader"))
    rules = sure.select(F.array("t").alias("items"), F.col("c").alias("n"), F.col("b").alias("n_block"), F.lit(1.0).alias("confidence"))
    if counts[1]:
        rules = rules.union(frequent_rules(known, counts[0], min_support, min_confidence))
    found = recounted(in_turn(written(rules, "url-leaders"), groups, "leader"), rows, equal)
    found = found.withColumn("confidence", F.col("n_block") / F.col("n")).where((F.col("n_block") >= min_support) & (F.col("confidence") >= min_confidence))
    return in_turn(found, equal, "t")


def frequent_rules(rows: DataFrame, n: int, min_support: int, min_confidence: float) -> DataFrame:
    """items (sorted), n, n_block and confidence of the rules that stand among n rows (block, items), by FP-growth."""
    marked = rows.select(F.when(F.col("block"), F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
    # FP-growth rounds share * n up: half a row less than the support is the support, whatever the division does
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (min_support - 0.5) / n), minConfidence=1.0).fit(marked).freqItemsets
    sets = written(sets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    alone = sets.where(~F.array_contains("items", BLOCK))
    both = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("n_block"))
    rules = both.join(alone, "items").select("items", F.col("freq").alias("n"), "n_block", (F.col("n_block") / F.col("freq")).alias("confidence"))
    rules = rules.where((F.col("n_block") >= min_support) & (F.col("confidence") >= min_confidence))
    # a rule goes if it less one item is a rule that is as sure
    shorter = rules.where(F.size("items") > 1).select("items", "confidence", F.explode("items").alias("x")).select("items", "confidence", F.array_remove("items", F.col("x")).alias("less"))
    sure = rules.select(F.col("items").alias("less"), F.col("confidence").alias("c"))
    needless = shorter.join(sure, "less").where(F.col("c") >= F.col("confidence")).select("items").distinct()
    return rules.join(needless, "items", "left_anti")


def matches(urls: DataFrame, rules: DataFrame, hot: DataFrame) -> DataFrame:
    """_file, _row and the surest of the rules that its tokens have, from urls (_file, _row, tokens) by an inverted index
    of rules. hot: tokens (t) that many urls have."""
    rules = written(rules, "url-rules")
    each = rules.select("items", "confidence", F.explode("items").alias("t"))
    uses = each.groupBy("t").agg(F.count("*").alias("uses"))
    # posted under the item that the fewest rules use
    index = each.join(uses, "t").groupBy("items", "confidence").agg(F.min_by("t", F.struct("uses", "t")).alias("t"))
    posted = join_spread(urls.select("_file", "_row", "tokens", F.explode("tokens").alias("t")), index, "t", by=["_file", "_row"], hot=hot)
    found = posted.where(F.size(F.array_except("items", "tokens")) == 0)
    best = found.groupBy("_file", "_row").agg(F.max(F.struct("confidence", F.array_join("items", " ").alias("mined"))).alias("_m"))
    return best.select("_file", "_row", F.col("_m.mined").alias("mined"), F.col("_m.confidence").alias("confidence"))


def labelled_urls(rows: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """tokens and block of the labelled rows (page_id, url, host, path), at most about max_labelled, of the least hashes."""
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.col("quality") == 0)
    taught = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(bad, F.lit(False))).alias("block"))
    low = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)).alias("_h")
    known = written(rows.where("host <> ''").join(taught, F.col("page_id") == F.col("_id")).select(low, "url", "host", "path", "block"), "url-labelled")
    share = min(1.0, max_labelled / max(1, known.count()))
    return known.where(F.col("_h") < int(share * (1 << 30))).select(url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), "block")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], min_share: float = 0.002, min_confidence: float = 0.6, max_labelled: int = 100_000, least: int = 10) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the association rule that blocks, if it decides) and confidence.

    labels: doc_id (the page's id), quality and toxic; a page is to block if it is toxic or of quality 0. A rule stands if
    min_share of the labelled rows, and `least` rows at least, have all its tokens and are to block, and min_confidence of
    the rows with all its tokens are to block."""
    at = addressed(pages.select("page_id", "url"))
    rows = at.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    known = labelled_urls(rows, labels, max_labelled)
    n = known.count()
    mined = mined_rules(known, max(least, int(n * min_share)), min_confidence)
    hot = known.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("_c")).where(F.col("_c") > n / SHARE).select("t")
    urls = rows.where("host <> ''").select("_file", "_row", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    hits = matches(urls, mined, hot)
    text, verdict = fixed_rule(rules, F.col("host"), F.col("path"))
    out = rows.join(hits, ["_file", "_row"], "left").withColumns({"rule": text, "_v": verdict})
    own = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("_v", own).alias("verdict"), F.when(F.col("_v").isNull(), F.col("mined")).alias("mined"), F.when(F.col("_v").isNull(), F.col("confidence")).alias("confidence"))
