"""LM scoring (operator 5): word counts of all training documents, and a gated recurrent model over words.

Tokens are words (A-Z lower-cased, runs of characters other than space and U+0009 to U+000D) and one end for each
document. The model reads the end, then the words. Its vocabulary holds the most frequent words; every other word
stands for its group (by its last bytes) and has a share of the group by its count. The output is factored: a softmax
over classes of words of like frequency, then one over the words of the class. Documents are read as whole sequences in
lanes; the state goes on from window to window and is cleared where a document starts.

Learning: one bounded sample warms the parameters up (`warm_docs`, about; it only sets where training starts). Then all
training documents are dealt by a hash of doc_id and text to rounds and shards, whose number follows from the number of
tokens alone. In a round each shard trains on its documents in the order of that hash, and parameters and step sizes are
averaged by tokens; the next round starts there. So the scores don't depend on how many partitions or cores there are.

Texts are read twice: to count words, and to write each document's token ids (2 bytes each), from which the rounds and
the scores are made.

Null text counts as empty: the end is its one token. A null doc_id counts as '' for the fold. Rows that repeat count and
are scored each; rows equal in doc_id and text train in one shard. Texts of any length are read whole. Without any
training document all counts are 0 and the model is the untrained one; an empty table gives an empty result. Other
columns of docs are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import get_file, new_folder, put_file, schema_of, text_of, written

#: The end of a document in tables of words; no word is empty.
END = b""
#: Words whose counts are sent to the executors; others are joined.
HEAD_WORDS = 300_000
VOCABULARY, GROUPS, CLASSES, HIDDEN = 1024, 32, 24, 16
LANES, SCORE_LANES, TRAIN_STEPS, SCORE_STEPS = 256, 1024, 16, 16
#: When few lanes are left in scoring, windows are up to so many times as long.
LONGER = 32
#: Tokens that a task trains on or scores at once.
CHUNK_TOKENS = 1_500_000
#: A shard has about so many training tokens, but there are at most MOST_SHARDS; each is dealt to so many rounds.
SHARD_TOKENS, MOST_SHARDS, ROUNDS = 1_000_000, 16_384, 4
#: In learning, longer documents are read in pieces of so many tokens, in lanes of their own; scores read them whole.
LEARN_TOKENS = 512
#: Multiplications of one matrix product: for larger ones the BLAS starts threads, whose waiting takes other tasks' cores.
PRODUCT = 200_000
#: Words that a task counts before it passes the counts on.
COUNTED_WORDS = 2_000_000
LN10 = float(np.log(10))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (bytes) of all texts, one after the other, and where each text's words end."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, ends = parts.flatten(), parts.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)  # blanks at a text's ends make empty parts
    ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[ends - ends[0]]
    return words.filter(full).cast(pa.binary()), ends[1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n, docs = [], 0, 0

    def flush() -> pa.RecordBatch:
        counts = pc.value_counts(pa.chunked_array(held, pa.binary()))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([counts.field("values"), pa.array([END], pa.binary())]), pa.concat_arrays([counts.field("counts"), pa.array([docs], pa.int64())])], names=["word", "n"])

    for batch in batches:
        held.append(flat_words(batch.column(0))[0])
        n += len(held[-1])
        docs += batch.num_rows
        if n >= COUNTED_WORDS:
            yield flush()
            held, n, docs = [], 0, 0
    yield flush()


def word_counts(train: DataFrame) -> DataFrame:
    """word (bytes; empty: the end) and n, where it is over 0, over all training documents (text)."""
    return train.select("text").mapInArrow(_count, "word binary, n bigint").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def group_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % GROUPS


def group_column(word: Column) -> Column:
    """group_of in Spark."""
    n = F.octet_length(word)
    return (F.crc32(F.when(n > 3, F.substring(word, n - 2, F.lit(3))).otherwise(word)) % GROUPS).cast("int")


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, by blocks of rows."""
    step = max(1, PRODUCT // max(1, b.size))
    if len(a) <= step:
        return a @ b
    out = np.empty((len(a), b.shape[1]), np.result_type(a, b))
    for at in range(0, len(a), step):
        np.matmul(a[at : at + step], b, out=out[at : at + step])
    return out


def row_sums(a: np.ndarray) -> np.ndarray:
    """The sum of each short row: a product does it in fewer steps than the sum along an axis. Two columns, since the BLAS
    starts threads for much smaller products with a vector."""
    return product(a, np.ones((a.shape[1], 2), a.dtype))[:, 0]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, by blocks of rows."""
    step = max(1, PRODUCT // max(1, a.shape[1] * b.shape[1]))
    out = a[:step].T @ b[:step]
    for at in range(step, len(a), step):
        out += a[at : at + step].T @ b[at : at + step]
    return out


class Net:
    """Gated recurrent units and a class-factored softmax, in numpy. Tokens are sorted so that classes are ranges."""

    NAMES = ("e", "b", "u", "wc", "bc", "wo", "bo")

    def __init__(self, freq: np.ndarray, classes: int = CLASSES, hidden: int = HIDDEN, seed: int = 1):
        """freq: how often each token is met, most frequent first."""
        n, self.h = len(freq), hidden
        share = np.cumsum(np.sqrt(freq / freq.sum()))
        of = np.minimum((share / share[-1] * classes * (1 - 1e-9)).astype(int), classes - 1)
        self.starts = np.append(np.flatnonzero(np.diff(of, prepend=-1)), n)
        self.class_of = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)).astype(np.uint8)
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        mass = np.add.reduceat(freq, self.starts[:-1])
        self.p = {"e": small(n, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "u": small(hidden, 3 * hidden), "wc": small(hidden, len(mass)), "bc": np.log(mass / freq.sum()).astype(np.float32), "wo": small(n, hidden), "bo": np.log(freq / mass[self.class_of]).astype(np.float32)}
        self.p["b"][:hidden] = 1.0  # keep the state at first
        self.g = {k: np.full(v.shape, 1e-2, np.float32) for k, v in self.p.items()}

    def vector(self) -> np.ndarray:
        """Parameters, and the sums of squares that their step sizes come from."""
        return np.concatenate([part[k].ravel() for part in (self.p, self.g) for k in self.NAMES])

    def load(self, v: np.ndarray) -> None:
        at = 0
        for part in (self.p, self.g):
            for k in self.NAMES:
                part[k] = v[at : at + part[k].size].reshape(part[k].shape).astype(np.float32)
                at += part[k].size

    def steps(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """States after each of ids (T, B), the last state, and what backward needs. fresh: a document starts here."""
        p, n = self.p, self.h
        x = p["e"][ids]
        x += p["b"]
        out, kept = np.empty((*ids.shape, n), np.float32), []
        any_fresh, few = fresh.any(axis=1).tolist(), ids.shape[1] * p["u"].size <= PRODUCT
        for t in range(len(ids)):
            if any_fresh[t]:
                h = h * ~fresh[t][:, None]
            hu = h @ p["u"] if few else product(h, p["u"])
            zr = x[t, :, : 2 * n] + hu[:, : 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r, un = zr[:, :n], zr[:, n:], hu[:, 2 * n :]
            new = r * un
            new += x[t, :, 2 * n :]
            np.tanh(new, out=new)
            if keep:
                kept.append((h, zr, new, un))
            h = (h - new) * z
            h += new
            out[t] = h
        return out, h, kept

    def output(self, hs: np.ndarray, target: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray | None, dict]:
        """Natural log-probabilities of target after hs (M, H), and if asked for the gradients."""
        p = self.p
        own = self.class_of[target]
        a = product(hs, p["wc"])
        a += p["bc"]
        rows = np.arange(len(target))
        picked = a[rows, own]
        np.exp(a, out=a)
        total = row_sums(a)
        lp = picked - np.log(total)
        grads, dh = {}, None
        if learn:
            a /= total[:, None]
            a[rows, own] -= 1
            grads |= {"wc": inner(hs, a), "bc": a.sum(axis=0)}
            dh = product(a, p["wc"].T)
            grads["wo"], grads["bo"] = np.zeros_like(p["wo"]), np.zeros_like(p["bo"])
        order = np.argsort(own, kind="stable")
        ends = np.searchsorted(own[order], np.arange(len(self.starts)))
        sorted_h, sorted_t = hs[order], target[order]
        sorted_lp = np.zeros(len(order), np.float32)
        for c in range(len(self.starts) - 1):
            i, j, s, e = ends[c], ends[c + 1], self.starts[c], self.starts[c + 1]
            if i == j or e - s == 1:
                continue
            part, at = sorted_h[i:j], sorted_t[i:j] - s
            w = product(part, p["wo"][s:e].T)
            w += p["bo"][s:e]
            mine = w[rows[: j - i], at]
            np.exp(w, out=w)
            total = row_sums(w)
            sorted_lp[i:j] = mine - np.log(total)
            if learn:
                w /= total[:, None]
                w[rows[: j - i], at] -= 1
                grads["wo"][s:e] = inner(w, part)
                grads["bo"][s:e] = w.sum(axis=0)
                dh[order[i:j]] += product(w, p["wo"][s:e])
        lp[order] += sorted_lp
        return lp, dh, grads

    def backward(self, dh: np.ndarray, ids: np.ndarray, fresh: np.ndarray, kept: list) -> dict:
        """Gradients through the steps of one window (truncated there)."""
        p, n = self.p, self.h
        dx, dhu = np.empty((*ids.shape, 3 * n), np.float32), np.empty((*ids.shape, 3 * n), np.float32)
        before = np.empty((*ids.shape, n), np.float32)
        back = np.zeros((ids.shape[1], n), np.float32)
        ut = np.ascontiguousarray(p["u"].T)
        any_fresh = fresh.any(axis=1)
        for t in range(len(ids) - 1, -1, -1):
            h, zr, new, un = kept[t]
            z, r = zr[:, :n], zr[:, n:]
            d = dh[t] + back
            da = d * (1 - z) * (1 - new * new)
            x = dx[t]
            x[:, :n] = d * (h - new)
            x[:, n : 2 * n] = da * un
            x[:, : 2 * n] *= zr * (1 - zr)
            x[:, 2 * n :] = da
            dhu[t, :, : 2 * n] = x[:, : 2 * n]
            dhu[t, :, 2 * n :] = da * r
            before[t] = h
            back = product(dhu[t], ut)
            back += d * z
            if any_fresh[t]:
                back *= ~fresh[t][:, None]
        flat = ids.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(p["e"]) < 65536 else flat, kind="stable")
        tokens, first = np.unique(flat[order], return_index=True)
        per_token = np.add.reduceat(dx.reshape(-1, 3 * n)[order], first, axis=0)
        return {"u": inner(before.reshape(-1, n), dhu.reshape(-1, 3 * n)), "b": per_token.sum(axis=0), "e": (tokens, per_token)}

    def update(self, grads: dict, rate: float, scale: float) -> None:
        """Adagrad on gradients times scale."""
        for k, g in grads.items():
            at = slice(None)
            if k == "e":
                at, g = g
            g = np.clip(g * np.float32(scale), -1, 1)
            self.g[k][at] += g * g
            self.p[k][at] -= np.float32(rate) * g / np.sqrt(self.g[k][at])

    def read(self, docs: list[np.ndarray], end: int, lanes: int, steps: int, rate: float | None = None) -> np.ndarray:
        """Natural log-probability of each document (its tokens without the end), learning on the way if rate is set."""
        most = LEARN_TOKENS if rate is not None else 1 << 62
        pieces = [(i, a, min(len(d) + 1, a + most)) for i, d in enumerate(docs) for a in range(0, len(d) + 1, most)]
        lengths = np.array([b - a for _, a, b in pieces], np.int64)
        heap = [(0, k, []) for k in range(max(1, min(lanes, len(pieces))))]
        for i in np.argsort(-lengths, kind="stable").tolist():
            size, k, own = heapq.heappop(heap)
            own.append(i)
            heapq.heappush(heap, (size + int(lengths[i]), k, own))
        heap.sort(key=lambda x: -x[0])
        sizes = np.array([x[0] for x in heap], np.int64)
        order = [i for x in heap for i in x[2]]
        starts = np.concatenate([[0], np.cumsum(lengths[order])[:-1]]).astype(np.int64)
        total = int(lengths.sum())
        token, target, doc, fresh = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int32), np.zeros(total, bool)
        fresh[starts] = True
        for k, s in zip(order, starts.tolist()):
            i, a, b = pieces[k]
            d, e = docs[i], s + b - a
            # reads the end and then the words; is to tell the words and then the end
            token[s], token[s + 1 : e] = d[a - 1] if a else end, d[a : b - 1]
            part = d[a:b]
            target[s : s + len(part)], target[s + len(part) : e] = part, end
            doc[s:e] = i
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h, out = np.zeros((len(heap), self.h), np.float32), np.zeros(len(docs))
        at = 0
        while at < sizes[0]:
            live = int(np.searchsorted(-sizes, -at, "left"))
            # scores don't depend on where windows end: the few lanes of the longest documents go on in longer ones
            span = steps * min(LONGER, max(1, lanes // live)) if rate is None else steps
            place = at + np.arange(min(span, int(sizes[0]) - at))[:, None]
            index = offsets[None, :live] + place
            whole = place[-1, 0] < sizes[live - 1]  # else some lanes end in this window
            if not whole:
                real = place < sizes[None, :live]
                index = np.where(real, index, offsets[None, :live])
            ids, new = token[index], fresh[index]
            if not whole:
                new &= real
            hs, h, kept = self.steps(ids, new, h[:live], rate is not None)
            flat = index.ravel() if whole else index[real]
            lp, dh, grads = self.output(hs.reshape(-1, self.h) if whole else hs[real], target[flat], rate is not None)
            out += np.bincount(doc[flat], weights=lp, minlength=len(docs))
            if rate is not None:
                full = dh.reshape(hs.shape) if whole else np.zeros(hs.shape, np.float32)
                if not whole:
                    full[real] = dh
                grads |= self.backward(full, ids, new, kept)
                self.update(grads, rate, 1 / live)
            at += span
        return out


class Words:
    """What tasks need to know of words: counts of the head, tokens of the model, shares of groups."""

    def __init__(self, head: list[tuple[bytes, int]], groups: np.ndarray, n: int, v: int, vocabulary: int = VOCABULARY):
        """head: the most frequent words with counts, most frequent first; groups: sum of n + 0.5 of all the words that
        aren't of the vocabulary, by group, with 0.5 for the unknown; n, v: tokens and distinct tokens."""
        self.n, self.v = n, v
        self.known = {w: i for i, (w, _) in enumerate(head)}
        self.known.setdefault(END, len(self.known))
        counts = [c for _, c in head] + [0] * (len(self.known) - len(head))
        self.log_count = np.log10(np.array(counts, float) + 0.5)
        self.has_count = np.array(counts) > 0
        named = [i for w, i in self.known.items() if i < vocabulary or w == END]
        freq = np.concatenate([np.array([counts[i] for i in named], float) + 0.5, groups])
        order = np.argsort(-freq, kind="stable")
        self.freq = freq[order]
        rank = np.argsort(order)
        self.group_token = rank[len(named) :].astype(np.int32)
        words = list(self.known)
        self.head = pa.array(words, pa.binary())
        self.token = np.array([self.group_token[group_of(w)] for w in words], np.int32)
        self.token[named] = rank[: len(named)]
        #: log10 of a word's share of its group; 0 for words of the vocabulary
        self.log_groups = np.log10(groups)
        self.log_share = self.log_count - self.log_groups[[group_of(w) for w in words]]
        self.log_share[named] = 0
        self.end = int(self.token[self.known[END]])
        self.log_total = float(np.log10(n + 0.5 * (v + 1)))

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
        """For each text the model's tokens, its words that aren't of the head, and the head's numbers of the others."""
        words, ends = flat_words(texts)
        head = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy(zero_copy_only=False)
        out = self.token[head] if len(head) else np.zeros(0, np.int32)
        rare = np.flatnonzero(head < 0)
        tail = words.take(pa.array(rare)).to_pylist()
        if tail:
            out[rare] = self.group_token[[zlib.crc32(w[-3:]) % GROUPS for w in tail]]
        bounds = np.searchsorted(rare, ends)
        start = first = 0
        for end, last in zip(ends.tolist(), bounds.tolist()):
            h = head[start:end]
            yield out[start:end], tail[first:last], h[h >= 0]
            start, first = end, last


_loaded: OrderedDict[tuple[str, str], object] = OrderedDict()


def loaded(folder: str, name: str) -> object:
    """An object of the shared folder, kept by the worker."""
    if (folder, name) not in _loaded:
        _loaded[folder, name] = pickle.loads(get_file(folder, name))
        while len(_loaded) > 4:
            _loaded.popitem(last=False)
    return _loaded[folder, name]


TOKENS_SPARK = "doc_id bigint, held_out boolean, hash bigint, row bigint, n_tokens bigint, n_known bigint, base double, share double, tail array<binary>, uses array<bigint>, ids binary"
TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("hash", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("share", pa.float64()), ("tail", pa.list_(pa.binary())), ("uses", pa.list_(pa.int64())), ("ids", pa.binary())])
#: Token ids as they are written.
ID = np.dtype("<u2")


class _Tokens:
    """A document's token ids, and all of its scores that needs no model and no counts of rare words."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = loaded(self.folder, "words")
        end = words.known[END]
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            rows = []
            for doc, held, h, (tokens, tail, head) in zip(*(c.to_pylist() for c in batch.columns[:3]), words.read(batch.column(3))):
                uses = Counter(tail)
                # what is missing of words of the tail is their log10(count + 0.5), in both scores
                share = float(words.log_share[head].sum()) - sum(words.log_groups[group_of(w)] * n for w, n in uses.items())
                known = int(words.has_count[head].sum()) + int(words.has_count[end])
                rows.append((doc, held, h, row, len(tokens) + 1, known, float(words.log_count[head].sum() + words.log_count[end]), share, list(uses), list(uses.values()), tokens.astype(ID).tobytes()))
                row += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), TOKENS_ARROW)], schema=TOKENS_ARROW)


class _Train:
    """Trains on the documents of each shard, in order; returns its parameters in pieces, with its tokens as weight."""

    def __init__(self, folder: str, start: str, lanes: int, passes: int, rate: float):
        self.folder, self.start, self.lanes, self.passes, self.rate = folder, start, lanes, passes, rate

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = loaded(self.folder, "words")
        net, of, docs, held, seen = None, None, [], 0, 0

        def learn() -> None:
            with np.errstate(over="ignore"):
                for _ in range(self.passes):
                    net.read(docs, words.end, self.lanes, TRAIN_STEPS, self.rate)

        def pieces() -> pa.RecordBatch:
            v = net.vector().astype("<f4")
            at = range(0, len(v), PIECE)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([of] * len(at), pa.int64()), pa.array([float(seen)] * len(at), pa.float64()), pa.array([v[i : i + PIECE].tobytes() for i in at], pa.binary())], names=["at", "shard", "w", "v"])

        for batch in batches:
            for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != of:
                    if docs:
                        learn()
                    if of is not None:
                        yield pieces()
                    # a copy of its own: the shared one stays as it is for other shards
                    net, of, docs, held, seen = pickle.loads(pickle.dumps(loaded(self.folder, self.start))), shard, [], 0, 0
                docs.append(np.frombuffer(ids, ID))
                held += len(docs[-1]) + 1
                seen += len(docs[-1]) + 1
                if held >= CHUNK_TOKENS:
                    learn()
                    docs, held = [], 0
        if docs:
            learn()
        if of is not None:
            yield pieces()


#: Parameters of a piece.
PIECE = 8192


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (at, shard, w, v) to their weighted sums by at, one piece at a time."""
    sums: dict[int, np.ndarray] = {}
    weights: Counter[int] = Counter()
    for batch in batches:
        for at, w, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x = np.frombuffer(v, "<f4").astype(float) * w
            sums[at] = sums[at] + x if at in sums else x
            weights[at] += w
    yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array([weights[k] for k in sums], pa.float64()), pa.array([list(x) for x in sums.values()], pa.list_(pa.float64()))], names=["at", "w", "v"])


def trained(rows: DataFrame, folder: str, start: str, lanes: int, passes: int, rate: float) -> np.ndarray | None:
    """The average of what the shards of rows (shard, hash, ids) learn, by their tokens.

    A shard's rows are one run of a partition. The model's size bounds what a sum holds and what comes to the driver."""
    dealt = rows.select("shard", "ids", "hash").sortWithinPartitions("shard", "hash", "ids").select("shard", "ids")
    pieces = dealt.mapInArrow(_Train(folder, start, lanes, passes, rate), "at bigint, shard bigint, w double, v binary")
    each = pieces.repartition("at").sortWithinPartitions("at", "shard").mapInArrow(_sums, "at bigint, w double, v array<double>")
    found = sorted((r["at"], np.array(r["v"]) / r["w"]) for r in each.collect())
    return np.concatenate([v for _, v in found]) if found else None


class _Score:
    """row and the model's log10 probability of its tokens, from (row, ids)."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words = loaded(self.folder, "words")
        net: Net = loaded(self.folder, "net")
        docs, rows, held = [], [], 0

        def score() -> pa.RecordBatch:
            with np.errstate(over="ignore"):
                lp = net.read(docs, words.end, SCORE_LANES, SCORE_STEPS) / LN10
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lp, pa.float64())], names=["row", "lp"])

        for batch in batches:
            for row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs.append(np.frombuffer(ids, ID))
                rows.append(row)
                held += len(docs[-1]) + 1
                if held >= CHUNK_TOKENS:
                    yield score()
                    docs, rows, held = [], [], 0
        if docs:
            yield score()


def head_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The words with the highest counts, at most so many, most frequent first: a limit on counts is found from their
    histogram, so that no task sorts all words."""
    bins = counts.groupBy(F.floor(F.log2("n") * 64).alias("k")).agg(F.count("*").alias("c"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for r in sorted(bins, key=lambda r: -r["k"]):
        total += r["c"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        return []
    rows = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    return sorted(zip(rows["word"].to_pylist(), rows["n"].to_pylist()), key=lambda x: (-x[1], x[0]))


def score_documents(docs: DataFrame, warm_docs: int = 800, head: int = HEAD_WORDS, rate: float = 0.06) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), held_out(docs["doc_id"]).alias("held_out"))
    counts = written(word_counts(rows.where(~F.col("held_out"))), "lm-counts")
    n, v, found = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.sum(F.when(F.octet_length("word") == 0, F.col("n")))).first()
    words = head_and_groups(counts, n, v, found, head)
    folder = new_folder(spark, "lm-model")
    net = Net(words.freq)
    put_file(folder, "words", pickle.dumps(words))
    put_file(folder, "start", pickle.dumps(net))
    read = rows.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("hash"), "text").mapInArrow(_Tokens(folder), TOKENS_SPARK)
    tokens = written(read, "lm-tokens")
    if found:
        net = learned(tokens.where(~F.col("held_out")).select("hash", "ids"), net, folder, n, max(1, found // warm_docs), rate)
    put_file(folder, "net", pickle.dumps(net))
    scored = tokens.select("row", "ids").mapInArrow(_Score(folder), "row bigint, lp double")
    tail = tokens.select("row", F.explode(F.arrays_zip("tail", "uses")).alias("x")).select("row", F.col("x.tail").alias("word"), F.col("x.uses").alias("uses"))
    # a word that many held-out documents have and no other is no word of the head: adaptive execution splits its rows
    joined = tail.join(counts, "word", "left")
    sums = joined.groupBy("row").agg(F.sum(F.col("uses") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("uses")).otherwise(0)).alias("met"))
    more, met = F.coalesce("more", F.lit(0.0)), F.coalesce("met", F.lit(0))
    flat = tokens.select("doc_id", "held_out", "row", "n_tokens", "n_known", "base", "share")
    return flat.join(scored, "row").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + met).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(words.log_total)).alias("base_score"), (F.col("lp") + F.col("share") + more).alias("score"))


def head_and_groups(counts: DataFrame, n: int, v: int, found: int | None, head: int) -> Words:
    """What tasks need to know of words, from the counts of all; found: how often the end is met."""
    top = head_words(counts, head)
    groups = np.full(GROUPS, 0.5)
    for r in counts.groupBy(group_column(F.col("word")).alias("g")).agg(F.sum(F.col("n") + 0.5).alias("s")).collect():
        groups[r["g"]] += r["s"]
    for w, c in [*top[:VOCABULARY], *([(END, found)] if found and END not in {w for w, _ in top[:VOCABULARY]} else [])]:
        groups[group_of(w)] -= c + 0.5
    if found and END not in {w for w, _ in top}:
        top.append((END, found))
    return Words(top, np.maximum(groups, 0.5), n, v)


def learned(tokens: DataFrame, net: Net, folder: str, n: int, every: int, rate: float) -> Net:
    """net after the warm-up on one of `every` documents and ROUNDS rounds over all (hash, ids) of n tokens."""
    warm = tokens.where(F.pmod(F.xxhash64("hash"), F.lit(every)) == 0).select("hash", "ids", F.lit(0).cast("long").alias("shard"))
    v = trained(warm.repartition(1), folder, "start", 64, 2, 0.1)
    if v is not None:
        net.load(v)
    shards = min(MOST_SHARDS, -(-n // SHARD_TOKENS))
    dealt = tokens.select("hash", "ids", F.pmod(F.shiftrightunsigned("hash", 2), F.lit(shards)).alias("shard"))
    for k in range(ROUNDS):
        put_file(folder, f"round-{k}", pickle.dumps(net))
        v = trained(dealt.where(F.pmod("hash", F.lit(ROUNDS)) == k).repartition(shards, "shard"), folder, f"round-{k}", LANES, 1, rate)
        if v is not None:
            net.load(v)
    return net
