"""Vector code compression (operator 12): product codes whose codebooks are found by dual-tree Lloyd rounds.

Vectors of integers are cut into PARTS equal parts; each part position has a codebook of ENTRIES entries. Rows are put into
blocks once, with a tree over the block's parts for each position: a node holds the box, number and sum of its parts.
These blocks are a table in the shared folder. In a round, tasks walk each tree level by level against a tree over the
codebook's entries: an entry node goes when its least distance from a part node's box is above the largest one of another, and
an entry when another is nearer all over the box. A part node with one entry left is assigned whole, by its cached
number and sum; the parts in leaves with several entries left are compared with these by integers. So every assignment is
exact, ties to the lower index. Sums of 128 entries are all that comes to the driver.

Rows whose vector is null or holds null, NaN or infinite entries are dropped. The codebooks start from the ENTRIES least
vec_ids, nulls last, of equal ones the least vector; of fewer rows there are fewer entries. Repeated rows each count. Empty
tables give an empty result. Vectors of different lengths or of one that PARTS doesn't divide, and entries from 2 ** 16 on
(their squared distances are no longs), are an error. Null labels are one label. Other columns of rows are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import hot_keys, join_spread, parallel, schema_of, tidy, written
from keelson.llm.vectors import finite, floored, vectors

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE, MOST = 4096, 1 << 28
#: Rows of a block, and parts in a leaf of its trees.
BLOCK, LEAF = 4096, 32
CODE_SPARK, CODE_ARROW = schema_of(vec_id="long", label="string", code="string", error="long")
SUM_SPARK = "part bigint, entry bigint, n bigint, sums array<bigint>"


def levels_of(n: int, leaf: int) -> list[np.ndarray]:
    """Where nodes of n sorted parts begin, and where the last ends, level by level: each node is halved until leaves are
    small."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > leaf:
        last = out[-1]
        out.append(np.sort(np.concatenate([last, (last[:-1] + last[1:]) // 2])))
    return out


def sorted_by_tree(points: np.ndarray, leaf: int) -> np.ndarray:
    """The order that puts the points of each node of `levels_of` together: a node's points are split at the median of
    the widest side of their box."""
    order = np.arange(len(points))
    for bounds in levels_of(len(points), leaf)[:-1]:
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > 1:
                own = points[order[a:b]]
                side = own[:, int((own.max(axis=0) - own.min(axis=0)).argmax())]
                order[a:b] = order[a:b][np.argpartition(side, (b - a) // 2)]
    return order


class Tree:
    """Points in the order of their tree, and each level's bounds, boxes, and sums."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points = points
        self.levels = []
        total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
        for bounds in levels_of(len(points), leaf):
            low, high = np.minimum.reduceat(points, bounds[:-1]), np.maximum.reduceat(points, bounds[:-1])
            self.levels.append((bounds, low, high, total[bounds[1:]] - total[bounds[:-1]]))


def gaps(low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest squared distance between points of each box (low, high) and of each box (lo, hi)."""
    least = np.maximum(0, np.maximum(lo[None] - high[:, None], low[:, None] - hi[None]))
    most = np.maximum(high[:, None] - lo[None], hi[None] - low[:, None])
    return (least * least).sum(axis=2), (most * most).sum(axis=2)


def entries_left(low: np.ndarray, high: np.ndarray, left: np.ndarray, entries: np.ndarray, tree: Tree, order: np.ndarray) -> np.ndarray:
    """Of the entries that nodes (boxes low, high) have left, those that may be nearest to some point in the box."""
    # node pairs: from the root of the entries' tree down, what is farther than another node's farthest goes with all below
    for bounds, lo, hi, _ in tree.levels:
        alive = np.logical_or.reduceat(left[:, order], bounds[:-1], axis=1)
        least, most = gaps(low, high, lo, hi)
        near = np.where(alive, most, np.iinfo(np.int64).max).min(axis=1)
        gone = np.empty_like(left)
        gone[:, order] = np.repeat(least > near[:, None], np.diff(bounds), axis=1)
        left = left & ~gone
    # single entries: the one nearest to the middle against each other one, at the corner that suits the other best
    twice = low + high
    middle = np.where(left, ((twice[:, None] - 2 * entries[None]) ** 2).sum(axis=2), np.iinfo(np.int64).max)
    best = middle.argmin(axis=1)
    own = entries[best]
    corner = np.where(entries[None] > own[:, None], high[:, None], low[:, None])
    theirs, ours = ((corner - entries[None]) ** 2).sum(axis=2), ((corner - own[:, None]) ** 2).sum(axis=2)
    index = np.arange(len(entries))[None]
    return left & ((theirs < ours) | ((theirs == ours) & (index <= best[:, None])))


def assigned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point of a tree, each entry's number and sum of points, and how many points were compared
    one by one."""
    order = sorted_by_tree(entries, 1)
    book = Tree(entries[order], 1)
    code = np.empty(len(tree.points), np.int64)
    count, sums = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    distinct = np.zeros(len(entries), bool)
    distinct[np.unique(entries, axis=0, return_index=True)[1]] = True  # of equal entries the first only can win
    nodes, left = np.zeros(1, np.int64), distinct[None].copy()
    compared = 0
    for depth, (bounds, low, high, total) in enumerate(tree.levels):
        left = entries_left(low[nodes], high[nodes], left, entries, book, order)
        sure = left.sum(axis=1) == 1
        for node, entry in zip(nodes[sure], left[sure].argmax(axis=1)):
            a, b = bounds[node], bounds[node + 1]
            code[a:b] = entry
            count[entry] += b - a
            sums[entry] += total[node]
        nodes, left = nodes[~sure], left[~sure]
        if depth + 1 < len(tree.levels):  # children: the nodes of the next level that begin within this one's bounds
            first = np.searchsorted(tree.levels[depth + 1][0], bounds[nodes])
            after = np.searchsorted(tree.levels[depth + 1][0], bounds[nodes + 1])
            left = np.repeat(left, after - first, axis=0)
            nodes = np.concatenate([np.arange(a, b) for a, b in zip(first, after)]) if len(first) else first
    if len(nodes):
        bounds = tree.levels[-1][0]
        at = np.concatenate([np.arange(a, b) for a, b in zip(bounds[nodes], bounds[nodes + 1])])
        may = np.repeat(left, bounds[nodes + 1] - bounds[nodes], axis=0)
        own = tree.points[at]
        far = np.full((len(entries), len(at)), np.iinfo(np.int64).max)
        for e in np.flatnonzero(may.any(axis=0)):
            some = may[:, e]
            d = own[some] - entries[e]
            far[e, some] = (d * d).sum(axis=1)
        code[at] = nearest = far.argmin(axis=0)
        count += np.bincount(nearest, minlength=len(entries))
        np.add.at(sums, nearest, own)
        compared = len(at)
    return code, count, sums, np.array(compared)


def cut(z: np.ndarray) -> np.ndarray:
    """Rows of integers as (position, row, place in the part)."""
    if z.shape[1] % PARTS or not z.shape[1]:
        raise ValueError(f"vectors of {z.shape[1]} entries can't be cut into {PARTS} equal parts")
    return z.reshape(len(z), PARTS, -1).transpose(1, 0, 2)


class _Blocks:
    """Rows to blocks (ids, labels, n, places, points): for each position the points in the order of its tree, and which row of
    the block each is."""

    def __init__(self, dim: int, rows: int, leaf: int):
        self.dim, self.rows, self.leaf = dim, rows, leaf

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Table, np.ndarray]] = []
        for batch, z in floored(batches, SCALE, MOST, self.dim):
            held.append((pa.Table.from_batches([batch]), z))
            while sum(len(x) for _, x in held) >= self.rows:
                whole, z = self.joined(held)
                yield self.block(whole.slice(0, self.rows), z[: self.rows])
                held = [(whole.slice(self.rows), z[self.rows :])]
        if held and sum(len(x) for _, x in held):
            yield self.block(*self.joined(held))

    @staticmethod
    def joined(held: list[tuple[pa.Table, np.ndarray]]) -> tuple[pa.Table, np.ndarray]:
        return pa.concat_tables([t for t, _ in held]), np.concatenate([z for _, z in held])

    def block(self, rows: pa.Table, z: np.ndarray) -> pa.RecordBatch:
        places, points = [], []
        for part in cut(z):
            order = sorted_by_tree(part, self.leaf)
            places.append(order.astype("<i4"))
            points.append(part[order].astype("<i4"))
        columns = [pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([rows.column(2).to_pylist()], pa.list_(pa.string()))]
        columns += [pa.array([len(z)], pa.int64()), pa.array([np.stack(places).tobytes()], pa.binary()), pa.array([np.stack(points).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "n", "places", "points"])


BLOCK_SPARK = "ids array<bigint>, labels array<string>, n bigint, places binary, points binary"


def trees(places: bytes, points: bytes, n: int, leaf: int) -> Iterator[tuple[int, np.ndarray, Tree]]:
    """Each position of a block, which row each of its points is, and its tree."""
    where = np.frombuffer(places, "<i4").reshape(PARTS, n)
    every = np.frombuffer(points, "<i4").reshape(PARTS, n, -1)
    for k in range(PARTS):
        yield k, where[k], Tree(every[k].astype(np.int64), leaf)


class _Sums:
    """Blocks to each entry's number and sums of parts, one row of a task for each."""

    def __init__(self, books: np.ndarray, leaf: int):
        self.books, self.leaf = books, leaf

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(self.books.shape[:2], np.int64), np.zeros(self.books.shape, np.int64)
        for batch in batches:
            for places, points, n in zip(*(batch.column(c) for c in ("places", "points", "n"))):
                for k, _, tree in trees(places.as_py(), points.as_py(), n.as_py(), self.leaf):
                    _, c, s, _ = assigned(tree, self.books[k])
                    count[k] += c
                    sums[k] += s
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])


HEX = np.array([f"{i:02x}" for i in range(256)])


class _Codes:
    """Blocks to their rows' codes and errors."""

    def __init__(self, books: np.ndarray, leaf: int):
        self.books, self.leaf = books, leaf

    @tidy
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, n, places, points in zip(*batch.columns):
                size = n.as_py()
                codes, error = np.empty((PARTS, size), np.int64), np.zeros(size, np.int64)
                for k, where, tree in trees(places.as_py(), points.as_py(), size, self.leaf):
                    code, *_ = assigned(tree, self.books[k])
                    codes[k, where] = code
                    error[where] += ((tree.points - self.books[k][code]) ** 2).sum(axis=1)
                text = ["".join(row) for row in HEX[codes.T]]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text), pa.array(error)], schema=CODE_ARROW)


def first_books(rows: DataFrame) -> np.ndarray | None:
    """The codebooks' start, (position, entry, place), from the ENTRIES least vec_ids with a whole vector; None without any."""
    least = rows.where(finite("embedding")).orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow()
    if not least.num_rows:
        return None
    column = least.column(0).combine_chunks()
    batch = pa.RecordBatch.from_arrays([pa.nulls(len(column)), column], names=["vec_id", "embedding"])
    return cut(np.concatenate([z for _, z in floored(iter([batch]), SCALE, MOST)]))


class Codes:
    """Blocks in the shared folder, and the codebooks that `fit` has found for them."""

    def __init__(self, blocks: DataFrame, books: np.ndarray):
        self.blocks, self.books = blocks, books

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def fit(rows: DataFrame, rounds: int = ROUNDS, label: str = "label") -> Codes | None:
    """Codebooks of all whole vectors of rows (vec_id, embedding, label), after so many rounds; None without a vector."""
    thin = vectors(rows, label)
    thin = thin.select("vec_id", "embedding", F.concat(F.lit("="), F.col(label).cast("string")).alias("label"))
    books = first_books(thin)
    if books is None:
        return None
    dim = PARTS * books.shape[2]
    blocks = written(thin.mapInArrow(_Blocks(dim, BLOCK, LEAF), BLOCK_SPARK), "code-blocks")
    for _ in range(rounds):
        width = books.shape[2]
        sums = blocks.select("n", "places", "points").mapInArrow(_Sums(books, LEAF), SUM_SPARK)
        each = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
        books = books.copy()
        for r in each.collect():  # a row for each entry
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return Codes(blocks, books)


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each whole vector of rows (vec_id, embedding, label)."""
    found = fit(parallel(rows))
    if found is None:
        return rows.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = found.blocks.mapInArrow(_Codes(found.books, LEAF), CODE_SPARK).select("vec_id", "code", "error", F.coalesce("label", F.lit("")).alias("_label"))
    coded = written(coded, "codes")
    each = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    out = join_spread(coded, each, "_label", by=["vec_id", "code"], hot=hot_keys(coded, "_label"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))
