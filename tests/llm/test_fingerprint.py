import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import fingerprint as fp
from tests.llm import cases


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ABCD", max_size=30), st.text(alphabet="ABCD", max_size=30))
def test_common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    assert fp.common_length(a, b) == row[-1]


def test_likeness_follows_edits():
    r = random.Random(0)
    for n in (1000, 20_000, 200_000):
        text = cases.prose(n // 7, n)
        mark = fp.fingerprint(text.encode())
        assert fp.likeness(mark, mark) == 1.0
        half = text[: len(text) // 2] + cases.prose(n // 14, n + 1)
        few = list(text)
        for _ in range(3):
            few[r.randrange(len(few))] = "#"
        near = fp.likeness(mark, fp.fingerprint("".join(few).encode()))
        other = fp.likeness(mark, fp.fingerprint(cases.prose(n // 7, n + 2).encode()))
        assert near > 0.8 and fp.likeness(mark, fp.fingerprint(half.encode())) > 0.4 and other < 0.4 and near > other
    assert fp.fingerprint(b"") == "4::" and fp.likeness("4::", mark) == 0.0


def test_segments_change_nothing(monkeypatch):
    data = cases.prose(5000, 1).encode()
    want = fp.fingerprint(data)
    monkeypatch.setattr(fp, "SEGMENT", 1000)
    assert fp.fingerprint(data) == want


M32, M64 = 2**32 - 1, 2**64 - 1


def plain_letters(data, block):
    """Chunk by chunk, a byte after the other, from the definition."""
    table = []
    for x in range(1, 257):
        y = (x * 0x9E3779B97F4A7C15 & M64) ^ (x << 29 & M64)
        table.append(((y ^ y >> 31) * 0xBF58476D1CE4E5B9 & M64) >> 32)
    out, chunk = "", 0

    def letter(chunk):
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[((chunk ^ chunk >> 33) * 0xFF51AFD7ED558CCD & M64) >> 58]

    for i in range(len(data)):
        g = sum(table[data[i - k]] << k for k in range(8) if i >= k) & M32
        mixed = g * 0xD6E8FEB86659FD93 & M64
        chunk = chunk + (mixed ^ mixed >> 32) & M64
        t = g * 0x9E3779B1 & M32
        if (t ^ t >> 15) & (block - 1) == 0:
            out, chunk = out + letter(chunk), 0
    return out + (letter(chunk) if chunk else "")


def plain_fingerprint(data):
    block = 4
    while block * 64 < len(data):
        block *= 2
    while block > 4 and len(plain_letters(data, block)) < 32:
        block //= 2
    return f"{block}:{plain_letters(data, block)}:{plain_letters(data, 2 * block)}"


def plain_likeness(one, two):
    (a, *x), (b, *y) = one.split(":"), two.split(":")
    best = 1.0 if one == two else 0.0
    for i, k in enumerate((int(a), 2 * int(a))):
        for j, m in enumerate((int(b), 2 * int(b))):
            p, q = x[i], y[j]
            if k != m or not p or not q or one == two:
                continue
            need = min(5, max(1, min(len(p), len(q)) // 2))
            if not {p[n : n + need] for n in range(len(p) - need + 1)} & {q[n : n + need] for n in range(len(q) - need + 1)}:
                continue
            row = list(range(len(q) + 1))
            for n, c in enumerate(p, 1):
                last, row = row, [n]
                for o, d in enumerate(q, 1):
                    row.append(last[o - 1] if c == d else 1 + min(last[o], row[-1]))
            best = max(best, 1 - row[-1] / (len(p) + len(q)))
    return best


def test_fingerprints_and_likeness_from_the_definition():
    r = random.Random(8)
    texts = [b"", b"a", b"abc" * 3, bytes(r.choices(range(256), k=900)), *(cases.prose(n, n).encode() for n in (20, 60, 150, 400))]
    texts += [t[: len(t) // 2] + u[: len(u) // 2] for t, u in zip(texts[3:], texts[4:])]
    marks = [fp.fingerprint(t) for t in texts]
    assert marks == [plain_fingerprint(t) for t in texts]
    for a in marks:
        for b in marks:
            assert abs(fp.likeness(a, b) - plain_likeness(a, b)) < 1e-12


def brute(rows):
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = (fp.fingerprint(x.encode()) for x in (t, edited, nxt))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return out


def test_neighbours(spark):
    rows = [(i, t or "") for i, t, *_ in cases.rows() if i is not None and i != 101] + [(i * 10**9, cases.prose(50, i)) for i in range(5, 60)] + [(-4, "first")]
    rows.sort()
    table = spark.createDataFrame([(i, t if i != 103 else None) for i, t in rows], "doc_id bigint, text string").repartition(5)
    for size in (500, 5_000, 10**9):
        got = fp.fingerprints_with_next(table, range_bytes=size).collect()
        assert sorted(tuple(r) for r in got) == sorted(brute(rows))


def test_repeated_ids_null_ids_and_odd_tables(spark):
    docs = cases.clashing(spark)
    assert fp.fingerprints_with_next(docs, range_bytes=2000).count() == len(cases.rows())
    hot = spark.createDataFrame([(7, cases.prose(30, i)) for i in range(200)] + [(i, "a b") for i in range(20)], "doc_id bigint, text string")
    got = fp.fingerprints_with_next(hot, range_bytes=3000).collect()
    assert sorted(r["doc_id"] for r in got) == sorted([7] * 200 + list(range(20)))
    assert fp.fingerprints_with_next(cases.empty(spark)).collect() == []
    one = fp.fingerprints_with_next(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one[0]["near_next"] == 1.0
