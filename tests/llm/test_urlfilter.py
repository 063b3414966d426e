import random
import re

from keelson.llm import urlfilter
from keelson.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/1", "http://a.b.example.com/en/", "http://example.com/en", "http://example.com", "http://notexample.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/de/", "http://x.org/en/?u=http://example.com/en/", "http://com/", "a://b://com/\nx", "http://É.com/", "http://user@h.com:80/p"]


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def pages(spark):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, *URLS])] + [(None, "http://x.org/a", None)], "page_id bigint, url string, mined string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def test_fixed_rules(spark):
    got = {r["page_id"]: r for r in urlfilter.judge_urls(pages(spark), labels(spark), URL_RULES).collect()}
    for i, u in enumerate([*URLS, *URLS]):
        host, path, rule, verdict = brute(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdict or "allow"), u
    assert len(got) == 2 * len(URLS) + 1
    assert urlfilter.judge_urls(pages(spark).limit(0), labels(spark), URL_RULES).collect() == []


def test_rules_are_mined_and_matched(spark):
    # bad where both tokens meet; neither alone is
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 7}.org/{'shop' if i % 3 == 0 else 'news'}/{i}") for i in range(600)]
    bad = lambda i: i % 2 == 1 and i % 3 == 0
    known = [(i, 0 if bad(i) else 1, 0) for i in range(400)] + [(None, None, None), (3, None, 1)]
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), labels(spark, known), URL_RULES, least=10).collect()
    assert len(got) == 600 and all((r["verdict"] == "block") == bad(r["page_id"]) for r in got)
    mined = {r["mined"] for r in got if r["mined"]}
    assert mined == {"l=bad p=shop"}
    none = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), labels(spark, [(i, 1, 0) for i in range(400)]), URL_RULES).collect()
    assert {r["verdict"] for r in none} == {"allow"}


def test_long_urls_are_mined_whole(spark):
    # more than ten tokens of each kind of URL are rarer than the two that make it bad together
    def url(i):
        kind = i // 4 % 4
        deep = "/".join(f"d{'abcd'[kind]}{'abcdefghijkl'[k]}" for k in range(12))
        return f"http://{'bad' if i % 2 else 'good'}.site.org/{'shop' if i % 4 > 1 else 'news'}/{deep}/x.html?q{'abcd'[kind]}=1"

    bad = lambda i: i % 4 == 3
    rows = [(i, url(i)) for i in range(720)]
    known = [(i, 0 if bad(i) else 1, 0) for i in range(480)]
    got = urlfilter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), labels(spark, known), URL_RULES, least=20).collect()
    assert len(got) == 720 and all((r["verdict"] == "block") == bad(r["page_id"]) for r in got)


def test_rules_equal_brute_force(spark):
    from collections import Counter
    from itertools import chain, combinations

    draw = random.Random(5)
    rows = []
    for _ in range(60):
        tokens = {t for t in "abcdefghijkl" if draw.random() < 0.6}
        tokens |= {"a2"} if "a" in tokens else set()
        rows.append((sorted(tokens), "a" in tokens and "b" in tokens or draw.random() < 0.2))
    often = Counter(t for items, block in rows if block for t in items)
    every, blocked = Counter(), Counter()
    for items, block in rows:
        kept = [t for t in items if often[t] >= 12 and sum(t in x for x, _ in rows) < 0.95 * len(rows)]
        for rule in chain.from_iterable(combinations(kept, k) for k in range(1, len(kept) + 1)):
            every[rule] += 1
            blocked[rule] += block
    sure = {r: (every[r], blocked[r]) for r in every if blocked[r] >= 12 and blocked[r] / every[r] >= 0.6}
    want = {r: v for r, v in sure.items() if not any(s in sure and sure[s][1] * v[0] >= v[1] * sure[s][0] for s in combinations(r, len(r) - 1))}
    got = urlfilter.mined_rules(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 12, 0.6).collect()
    assert len(got) == len(want) > 3 and {tuple(r["items"]): (r["n"], r["n_block"]) for r in got} == want


def test_ending_is_a_token(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("http://h.org/a/b.HTML?x=1",), ("http://h.org/v1.0/b",), ("http://h.org/.x",)], "url string")
    got = [r[0] for r in rows.select(urlfilter.url_tokens(F.col("url"), urlfilter.host_of(F.col("url")), urlfilter.path_of(F.col("url")))).collect()]
    assert [[t for t in x if t.startswith("e=")] for x in got] == [["e=html"], [], []]


def test_very_long_urls_clashing_columns_and_the_bound(spark):
    long = "http://bad.org/" + "/".join(f"p{i}" for i in range(20_000))
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.org/{i}", "x", "y", 1, 2) for i in range(200)] + [(500, long, "x", "y", 1, 2), (501, None, "x", "y", 1, 2)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, tokens string, mined string, _file int, _row int")
    known = labels(spark, [(i, 1 - i % 2, 0) for i in range(150)])
    for most in (100_000, 80):
        got = {r["page_id"]: r for r in urlfilter.judge_urls(table, known, URL_RULES, max_labelled=most).collect()}
        assert len(got) == 202 and got[500]["verdict"] == "block" and got[501]["verdict"] == "allow"
        assert all((got[i]["verdict"] == "block") == bool(i % 2) for i in range(200))


def plain_rules(rows, support, confidence, alike=0.1):
    """The rules by trying all sets of leaders, with counts made one row after the other."""
    from itertools import combinations, product

    have = {}
    for k, (items, block) in enumerate(rows):
        for t in items:
            have.setdefault(t, set()).add(k)
    bad = {k for k, (_, block) in enumerate(rows) if block}
    often = {t: r for t, r in have.items() if len(r & bad) >= support and len(r) < 0.95 * len(rows)}
    slack = int(alike * support)
    first = {t: min(o for o in often if often[o] == often[t]) for t in often}  # of equal tokens the least
    heads = sorted(set(first.values()))
    near = lambda a, b: len(often[a] - often[b]) <= slack and len(often[b] - often[a]) <= slack
    leader = {t: min((o for o in heads if near(t, o)), key=lambda o: (-len(often[o]), o)) for t in heads}
    members = {head: [t for t in heads if leader[t] == head or t == head] for head in set(leader.values())}
    count = lambda rule: set.intersection(*(often[t] for t in rule))
    stats = lambda rule: (len(count(rule)), len(count(rule) & bad))
    holds = lambda n, b: b >= support and b >= confidence * n
    sure = {}
    for k in range(1, len(members) + 1):
        level = {r: stats(r) for r in combinations(sorted(members), k)}
        sure |= {r: v for r, v in level.items() if holds(*v)}
        if all(b < support for _, b in level.values()):
            break
    stand = [r for r, (n, b) in sure.items() if not any(s in sure and sure[s][1] * n >= b * sure[s][0] for s in combinations(r, len(r) - 1))]
    out = {}
    for rule in stand:
        for way in product(*(members[t] for t in rule)):
            if holds(*stats(way)):
                for each in product(*([t for t in often if first[t] == w] for w in set(way))):
                    out[tuple(sorted(each))] = stats(way)
    return out


def test_tokens_that_are_alike_take_turns(spark):
    draw = random.Random(11)
    for share in (0.85, 0.6):
        rows = []
        for k in range(240):
            bad = draw.random() < 0.3
            tokens = {t for t in "mno" if draw.random() < 0.5}
            if k % 2:  # tokens of one template, each of which some rows lack
                tokens |= {f"t{i}" for i in range(4)} - {f"t{k // 2 % 60}"}
            if k % 3 == 0:
                tokens |= {"u1", "u2"}
            rows.append((sorted(tokens), draw.random() < share if k % 2 and "m" in tokens else bad))
        want = plain_rules(rows, 20, 0.6)
        got = urlfilter.mined_rules(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 20, 0.6).collect()
        assert len(got) == len(want) and {tuple(r["items"]): (r["n"], r["n_block"]) for r in got} == want
        assert {f"t{i}" for i in range(4)} <= {t for r in want for t in r}


def test_twenty_five_shared_tokens_in_seconds(spark):
    import time

    # 25 tokens of one template, each lacked by two rows of its own, and 25 of another that is bad wherever it is met
    def row(k):
        kind, j = k % 4, k // 4
        names = [f"{'ab'[kind]}{i}" for i in range(25) if j % 200 not in (2 * i, 2 * i + 1)] if kind < 2 else [f"z{k % 5}"]
        return [*names, f"h{k % 9}", "shop" if j % 2 else "news"], kind == 1 or kind == 0 and j % 2 == 1

    rows = [row(k) for k in range(800)]
    began = time.time()
    got = {tuple(r["items"]): (r["n"], r["n_block"]) for r in urlfilter.mined_rules(spark.createDataFrame(rows, "tokens array<string>, block boolean"), 20, 0.7).collect()}
    assert time.time() - began < 60
    for i in range(25):
        assert got[f"b{i}",] == (198, 198) and got[f"a{i}", "shop"] == (99, 99)
    for rule, (n, b) in got.items():
        have = [block for items, block in rows if set(rule) <= set(items)]
        assert (len(have), sum(have)) == (n, b) and b >= 20 and b >= 0.7 * n and len({t[0] for t in rule if t[0] in "ab"}) == sum(t[0] in "ab" for t in rule)
