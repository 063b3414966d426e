"""MinHash near-dedup (operator 6) by a signature-coordinate inverted join, with links confirmed on full sets.

A document's set has its distinct shingles of `width` words (A-Z lower-cased, words as runs of characters other than
space and U+0009 to U+000D); with fewer words the whole sequence is its one shingle; without words the set is empty and
linked with nothing. Documents with equal sets are one class. Each class posts its signature under (coordinate, value)
pairs; pairs held by one class only are dropped, the rarest few that a match cannot do without are kept (the prefix).

Groups are never expanded into all pairs. First each posting list links its members to one hub. Lists that still hold
several components are compared by signatures alone in tiles of bounded size. Of long lists, members first go too many of whose
shingles no other member of a long list has: a union without pairs. In tiles, coordinates before the list's own
are skipped over if they would find the pair too and collisions are counted. Only classes with enough collisions in
another component meet again with their full sets, in tiles bounded by shingles; there a prefix of the rarest shingles
leaves pairs that can be alike, the sets decide, and links that join components only come out. A list of n members
ships n * n / TILE_ROWS signatures; comparing them takes time with the square of n, n being what is left of a long list. A pair at the similarity itself is
missed by its signature with a chance under `miss`.

Full sets are made for classes in such lists only, from one row each, chosen where it stands in the scan (`rows`): texts
aren't shuffled, and one plan serves all sizes.

Null text has an empty set; texts of any length are read whole. Rows that share doc_id and text are in one class; rows
that share a doc_id only are judged as documents of their own, and component_id is the least doc_id reached. Null doc_ids
are never a component_id unless nothing else is reached. An empty table gives an empty result. Other columns of docs are
not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import SHARE, hot_keys, join_spread, schema_of, text_of, tidy, tucked, untucked, written
from keelson.llm.graph import components
from keelson.llm.rows import addressed, choose, chosen, mask

P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)
#: Members of a posting list in one side of a tile of signatures; members and shingles in one of a tile of sets.
TILE_ROWS, SET_ROWS, TILE_SHINGLES = 4096, 1024, 500_000
#: Lists of more members drop those that can't be alike to any member of such a list, by their shingles, before tiles.
LONG = 256
MARK_SPARK, MARK_ARROW = schema_of(file="long", at="long", doc_id="long", n_shingles="long", node="long", sig="binary")
SET_SPARK, SET_ARROW = schema_of(node="long", shingles="longs")


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(width, n)
    with np.errstate(over="ignore"):
        x = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            x = (x + h[k : n - size + 1 + k]) * P1
            x ^= x >> np.uint64(32)
        x *= P3
        x ^= x >> np.uint64(29)
    return np.unique(x)


def multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, k, dtype=np.uint64)


def signature(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least 32-bit hash of each coordinate."""
    least = np.full(len(a), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 8192):
            np.minimum(least, (x[None, at : at + 8192] * a[:, None] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def signatures(column: pa.Array, k: int) -> np.ndarray:
    """Signatures of a column of bytes, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, k)


def least_matches(k: int, percent: int, miss: float) -> int:
    """The most coordinates that a pair of this similarity has in common but for a chance under miss."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            return max(1, t)
    return k


class _Marks:
    """Rows (file, at, doc_id, text) to their marks, or, given the folder of chosen rows, these to their sets."""

    def __init__(self, width: int, k: int, folder: str = ""):
        self.width, self.k, self.folder = width, k, folder

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (a, b) = WordHashes(), multipliers(self.k)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                if self.folder:
                    batch = batch.filter(pa.array(mask(self.folder, batch.column(0).to_numpy(), batch.column(1).to_numpy())))
                every = [shingles(text, self.width, known) for text in batch.column(3).to_pylist()]
                nodes = pa.array([int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).astype(np.int64))) if len(x) else None for x in every], pa.int64())
                if self.folder:
                    yield pa.RecordBatch.from_arrays([nodes, pa.array([x.view(np.int64) for x in every], pa.list_(pa.int64()))], schema=SET_ARROW)
                else:
                    sigs = pa.array([signature(x, a, b).tobytes() if len(x) else None for x in every], pa.binary())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in every], pa.int64()), nodes, sigs], schema=MARK_ARROW)


class _Posts:
    """(node, sig) to (node, key): coordinate * 2 ** 32 + value, for every coordinate."""

    def __init__(self, k: int):
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = signatures(batch.column(1), self.k).astype(np.int64) + (np.arange(self.k, dtype=np.int64) << 32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), self.k)), pa.array(keys.ravel())], names=["node", "key"])


class _Alike:
    """Those of (a, b, sa, sb, na, nb) whose signatures collide often enough and whose sizes allow the similarity."""

    def __init__(self, percent: int, matches: int, k: int):
        self.percent, self.matches, self.k = percent, matches, k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
                ok = (signatures(batch.column(2), self.k) == signatures(batch.column(3), self.k)).sum(axis=1) >= self.matches
                ok &= (100 * na >= self.percent * nb) & (100 * nb >= self.percent * na)
                yield batch.select(["a", "b"]).filter(pa.array(ok))


class _Tiles:
    """Rows (key, bi, bj, block, node, comp, n, posted, sig) sorted by key, bi, bj, so that a tile's rows are together.

    Gives (key, node) of rows with enough collisions with a row of another component."""

    names, kinds = ("key", "node"), pa.int64()

    def __init__(self, percent: int, matches: int, k: int):
        self.percent, self.matches, self.k = percent, matches, k

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int]] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for row in zip(*(c.to_pylist() for c in batch.columns[:9]), *(_rows(c) for c in batch.columns[9:])):
                    if held and held[0][:3] != row[:3]:
                        out += self.found(held)
                        held = []
                    held.append(row)
                if len(out) > 5000:
                    yield self.batch(out)
                    out = []
        if held:
            out += self.found(held)
        yield self.batch(out)

    def batch(self, out: list[tuple[int, int]]) -> pa.RecordBatch:
        a, b = zip(*out) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, self.kinds), pa.array(b, self.kinds)], names=self.names)

    def sides(self, rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """A tile's rows of its one and of its other block; of the same block if there is only one."""
        _, bi, bj = rows[0][:3]
        left = [r for r in rows if r[3] == bi]
        return left, left if bi == bj else [r for r in rows if r[3] == bj]

    def near(self, left: list[tuple], right: list[tuple], key: int) -> Iterator[np.ndarray]:
        """Which pairs of other components collide often enough, less those that an earlier list finds: 256 rows of left
        and all of right at a time."""
        side = lambda rs: (np.array([r[5] for r in rs]), np.array([r[6] for r in rs]), np.array([r[7] for r in rs]), np.frombuffer(b"".join([r[8] for r in rs]), "<u4").reshape(-1, self.k))
        (cb, nb, pb, kb) = side(right)
        for at in range(0, len(left), 256):
            ca, na, pa_, ka = side(left[at : at + 256])
            count = np.zeros((len(ca), len(right)), np.uint8)
            earlier = np.zeros((len(ca), len(right)), bool)
            for c in range(self.k):
                same = ka[:, c, None] == kb[None, :, c]
                count += same
                if c < key >> 32:
                    earlier |= same & ((pa_[:, None] & pb[None, :]) >> c & 1).astype(bool)
            ok = ~earlier & (count >= self.matches) & (ca[:, None] != cb[None, :])
            ok &= (100 * na[:, None] >= self.percent * nb[None, :]) & (100 * nb[None, :] >= self.percent * na[:, None])
            if left is right:  # each pair once
                ok &= np.arange(len(right))[None, :] > np.arange(at, at + len(ca))[:, None]
            yield ok

    def found(self, rows: list[tuple]) -> list[tuple[int, int]]:
        left, right = self.sides(rows)
        if not left or not right or len({r[5] for r in rows}) < 2:
            return []
        one, other = [], np.zeros(len(right), bool)
        for near in self.near(left, right, rows[0][0]):
            one.append(near.any(axis=1))
            other |= near.any(axis=0)
        nodes = {left[i][4] for i in np.flatnonzero(np.concatenate(one))} | {right[j][4] for j in np.flatnonzero(other)}
        return [(rows[0][0], n) for n in nodes]


class _SetTiles(_Tiles):
    """The same with shingles as a tenth column; gives links (a, b) between components."""

    names = ("a", "b")

    def found(self, rows: list[tuple]) -> list[tuple[int, int]]:
        left, right = self.sides(rows)
        if not left or not right or len({r[5] for r in rows}) < 2:
            return []
        near = np.concatenate(list(self.near(left, right, rows[0][0])))
        if not near.any():
            return []
        both = left if left is right else left + right
        sizes = np.array([len(r[9]) for r in both])
        words, number, uses = np.unique(np.concatenate([r[9] for r in both]), return_inverse=True, return_counts=True)
        # shingles that one row of the tile has are in no intersection: those that are left must be enough
        shared = sizes - np.add.reduceat((uses[number] == 1).astype(np.int64), np.cumsum(sizes) - sizes)
        one, other = slice(0, len(left)), slice(0, None) if left is right else slice(len(left), None)
        most = np.minimum(shared[one, None], shared[None, other])
        near &= (100 + self.percent) * most >= self.percent * (sizes[one, None] + sizes[None, other])
        if not near.any():
            return []
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(uses, kind="stable")] = np.arange(len(words))
        ids = np.split(rank[number], np.cumsum(sizes)[:-1])
        # of two sets that are alike, the rarest few of each, in one order, have a shingle in common
        first = [np.sort(x)[: n - -(-self.percent * n // 100) + 1] for x, n in zip(ids, sizes.tolist())]
        shift = 0 if left is right else len(left)
        posts = np.concatenate(first[shift:])
        owners = np.repeat(np.arange(len(right)), [len(x) for x in first[shift:]])
        order = np.argsort(posts, kind="stable")
        posts, owners = posts[order], owners[order]
        ca, cb = [r[5] for r in left], [r[5] for r in right]
        flags, root, out = np.zeros(len(words), bool), {}, []

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        for i in np.flatnonzero(near.any(axis=1)):
            meets = np.zeros(len(right), bool)
            for a, b in zip(np.searchsorted(posts, first[i]), np.searchsorted(posts, first[i], "right")):
                meets[owners[a:b]] = True
            own = find(ca[i])
            js = [j for j in np.flatnonzero(near[i] & meets) if find(cb[j]) != own]
            if not js:
                continue
            flags[ids[i]] = True
            others = sizes[shift:][js]
            common = np.add.reduceat(flags[np.concatenate([ids[shift + j] for j in js])].astype(np.int64), np.cumsum(others) - others)
            flags[ids[i]] = False
            for j, n, k in zip(js, others, common):
                if 100 * k >= self.percent * (sizes[i] + n - k) and find(cb[j]) != find(ca[i]):
                    root[find(cb[j])] = find(ca[i])
                    out.append((ca[i], cb[j]))
        return out


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def link_confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, matches: int, k: int) -> DataFrame:
    """Those of pairs (a, b) with enough collisions whose full sets are alike enough. Many a may share a b."""
    sig = lambda c: classes.select(F.col("node").alias(c), F.col("sig").alias(f"s{c}"), F.col("n").alias(f"n{c}"))
    hubs = hot_keys(pairs, "b")
    met = join_spread(pairs.join(sig("a"), "a"), sig("b"), "b", by="a", hot=hubs)
    alike = written(met.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(_Alike(percent, matches, k), "a bigint, b bigint"), "near-alike")
    full = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
    both = join_spread(alike.join(full("a"), "a"), full("b"), "b", by="a", hot=hubs)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("_c", common).where(100 * F.col("_c") >= percent * (F.size("sa") + F.size("sb") - F.col("_c"))).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 32, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    return near_rows(docs, width, percent, k, miss).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_rows(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 32, miss: float = 1e-6) -> DataFrame:
    """_file, _row, doc_id, n_shingles, node (the class, null without words), comp (the classes' component) and
    component_id for each row of docs (doc_id, text), docs as for `addressed`."""
    matches = least_matches(k, percent, miss)
    rows = addressed(docs.select("doc_id", "text"))
    rows = rows.select("_file", "_row", F.col("doc_id").cast("long").alias("doc_id"), text_of(rows).cast("binary").alias("text"))
    marks = written(rows.mapInArrow(_Marks(width, k), MARK_SPARK), "near-marks")
    classes = marks.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.any_value("sig").alias("sig"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"), F.min(F.struct(F.col("file").alias("_file"), F.col("at").alias("_row"))).alias("at"))
    classes = written(classes, "near-classes")
    comps = linked_classes(rows, classes, width, percent, k, matches)
    named = classes.select("node", "first").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("first").alias("component"))
    of_node = written(named.join(least, "comp").select("node", "comp", "component"), "near-names")
    thin = marks.select(F.col("file").alias("_file"), F.col("at").alias("_row"), "doc_id", "n_shingles", "node")
    many = classes.where(F.col("rows") > marks.count() / SHARE).select("node")  # classes of very many copies
    out = join_spread(thin, of_node, "node", by=["_file", "_row"], hot=many, how="left")
    return out.select("_file", "_row", "doc_id", "n_shingles", "node", "comp", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs less all rows of each group of near copies but one: that of the least doc_id, of these the first in the
    files. Rows without words stay. Rows are dropped where they stand, also where doc_ids repeat or are null."""
    rows, own = tucked(docs)
    rows = addressed(rows)
    texts = rows.select(F.col(own["doc_id"]).alias("doc_id"), F.col(own["text"]).alias("text"))
    found = written(near_rows(texts, width, percent).where("node is not null"), "near-rows")
    one = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_file", "_row")).alias("_one"))
    one = one.select(F.col("_one._file").alias("_file"), F.col("_one._row").alias("_row"))
    gone = found.select("_file", "_row").join(one, ["_file", "_row"], "left_anti")
    return rows.where(~chosen(choose(gone))).select(*untucked(own))


def linked_classes(rows: DataFrame, classes: DataFrame, width: int, percent: int, k: int, matches: int) -> DataFrame:
    """node and comp for the classes (node, first, sig, n, at) that are linked with others."""
    posts = classes.select("node", "sig").mapInArrow(_Posts(k), "node bigint, key bigint")
    often = written(posts.groupBy("key").agg(F.count("*").alias("uses")).where("uses > 1"), "near-often")
    ranked = posts.join(often, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("uses", "key"))).alias("r"))
    # of the m keys that others have too, a match holds `matches`, so it holds one of the m - matches + 1 rarest
    kept = ranked.where(F.size("r") >= matches).select("node", F.size("r").alias("m"), F.explode(F.slice("r", 1, F.size("r") - matches + 1)["key"]).alias("key"))
    prefix = written(kept, "near-prefix")
    # a list of one is left over where the other members' prefixes end before it
    lists = prefix.groupBy("key").agg(F.max(F.struct("m", "node")).alias("hub"), F.count("*").alias("size")).where("size > 1").select("key", F.col("hub.node").alias("b"))
    stars = written(prefix.select(F.col("node").alias("a"), "key").join(lists, "key").where("a <> b").select("a", "b").distinct(), "near-stars")
    members = written(stars.select("a").union(stars.select("b")).distinct().select(F.col("a").alias("node")), "near-members")
    one = classes.join(members, "node").select("at._file", "at._row")
    sets = written(rows.mapInArrow(_Marks(width, k, choose(one)), SET_SPARK), "near-sets")
    first = written(link_confirmed(stars, classes, sets, percent, matches, k), "near-links")
    labels = components(first)
    more = written(tile_links(prefix, labels, sets, classes, percent, matches, k), "near-links")
    joined = components(more).select(F.col("node").alias("comp"), F.col("comp").alias("_joined"))
    every = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    return every.join(joined, "comp", "left").select("node", F.coalesce("_joined", "comp").alias("comp"))


def tiles_of(posts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of posts (key, node, ...) for each tile they are in, with bi, bj and block; blocks: key and how many."""
    dealt = posts.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"bi": F.least("block", "o"), "bj": F.greatest("block", "o")}).drop("o", "blocks")


def several(held: DataFrame) -> DataFrame:
    """Lists of held (key, node, comp, n) with more than one component, and sums that tell lists of other members apart."""
    return held.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("size"), F.sum("n").alias("total"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("c0 <> c1")


def lone(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of nodes (node, n) too many of whose shingles no other of nodes has: they are alike to none of them."""
    own = sets.join(nodes, "node").select("node", "n", F.explode("shingles").alias("s"))
    once = own.groupBy("s").agg(F.count("*").alias("_uses"), F.min("node").alias("node"), F.min("n").alias("n")).where("_uses = 1")
    return once.groupBy("node", "n").agg(F.count("*").alias("_own")).where(100 * (F.col("n") - F.col("_own")) < percent * F.col("n")).select("node")


def tile_links(prefix: DataFrame, labels: DataFrame, sets: DataFrame, classes: DataFrame, percent: int, matches: int, k: int) -> DataFrame:
    """Links (a, b) between components, from the posting lists that hold more than one."""
    held = prefix.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(classes.select("node", "n"), "node")
    held = written(held.select("key", "node", "comp", "n"), "near-held")
    long = written(several(held).where(F.col("size") > LONG).select("key"), "near-long")
    drop = held.join(long, "key").join(lone(held.join(long, "key", "left_semi").select("node", "n").distinct(), sets, percent), "node").select("key", "node")
    held = written(held.join(drop, ["key", "node"], "left_anti"), "near-held")
    # of lists with the same members one is enough
    lists = several(held)
    lists = lists.groupBy("size", "total", "who", "c0", "c1").agg(F.min("key").alias("key"))
    lists = written(lists.select("key", F.ceil(F.col("size") / TILE_ROWS).cast("int").alias("blocks")), "near-lists")
    posts = held.join(lists.select("key"), "key")
    # bit c: posted under coordinate c
    posted = posts.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(key, 32) as int))")).alias("posted"))
    signed = classes.join(posted, "node").select("node", "posted", "sig")
    order = ("key", "bi", "bj", "block", "node", "comp", "n", "posted", "sig")
    together = lambda t: t.repartition(F.col("key"), F.col("bi"), F.col("bj")).sortWithinPartitions("key", "bi", "bj", "node")
    met = together(tiles_of(posts, lists).join(signed, "node")).select(*order)
    found = written(met.mapInArrow(_Tiles(percent, matches, k), "key bigint, node bigint").distinct(), "near-found")
    again = written(found.join(held, ["key", "node"]), "near-again")
    blocks = again.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / SET_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias("blocks"))
    full = signed.join(sets, "node")
    met = together(tiles_of(again, blocks).join(full, "node")).select(*order, "shingles")
    return met.mapInArrow(_SetTiles(percent, matches, k), "a bigint, b bigint")
