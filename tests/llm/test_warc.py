import random
import time

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import warc


def record(i, body=b"<p>body</p>"):
    return warc.record_bytes(i, f"http://example.org/{i}", body, None, False, warc.digest(body))


def ids(found):
    return [x.fields["warc-record-id"] for x in found if not x.reason]


def test_sound_archives():
    plain = [record(i, b"x" * i) for i in range(5)]
    packed = [warc.member(r) for r in plain]
    for parts in (plain, packed, [warc.member(plain[0] + plain[1]), *packed[2:]]):
        found = list(warc.salvage(warc.Source(b"".join(parts))))
        assert [x.reason for x in found] == [""] * 5 and ids(found) == [f"<urn:page:{i}>" for i in range(5)]
    assert list(warc.salvage(warc.Source(b""))) == []


def test_salvage_after_each_kind_of_damage():
    r = random.Random(1)
    bodies = [bytes(r.choices(range(256), k=3000)) for _ in range(4)]
    packed = [warc.member(record(i, b)) for i, b in enumerate(bodies)]
    hurt = bytearray(packed[1])
    hurt[len(hurt) // 2] ^= 255
    wrong = warc.member(record(1, bodies[1]).replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:A"))
    for second in (bytes(hurt), packed[1][:500], b"junk" * 50, packed[1][100:], wrong, b"\x1f\x8b\x08" + b"\0" * 40):
        data = packed[0] + second + packed[2] + packed[3]
        found = list(warc.salvage(warc.Source(data)))
        assert ids(found) == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]
        gaps = [(x.start, x.end) for x in found if x.reason]
        assert gaps == [(len(packed[0]), len(packed[0] + second))]
    plain = [record(i, b) for i, b in enumerate(bodies)]
    for second in (plain[1].replace(b"Content-Length: 3", b"Content-Length: 9", 2), plain[1][:700], plain[1].replace(b"WARC/1.1", b"WARX/1.1")):
        found = list(warc.salvage(warc.Source(plain[0] + second + plain[2] + plain[3])))
        assert ids(found) == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>"]


def places(found):
    """Gaps inside a member."""
    return [(x.inside_start, x.inside_end) for x in found if x.reason and x.inside_start is not None]


def test_salvage_inside_members():
    plain = [record(i, b"text %d " % i * 40) for i in range(5)]
    at = [sum(map(len, plain[:k])) for k in range(6)]
    for hurt in (plain[1].replace(b"text", b"TEXT"), plain[1].replace(b"WARC/1.1", b"WARX/1.1"), plain[1][:200] + plain[1][230:]):
        records = [plain[0], hurt, *plain[2:]]
        found = list(warc.salvage(warc.Source(warc.member(b"".join(records)) + warc.member(record(9)))))
        assert ids(found) == [f"<urn:page:{i}>" for i in (0, 2, 3, 4, 9)]
        assert places(found) == [(at[1], at[1] + len(hurt))]
        inside = [(x.inside_start, x.inside_end) for x in found[:-1]]
        assert inside[0][0] == 0 and all(a[1] == b[0] for a, b in zip(inside, inside[1:]))
        bare = list(warc.salvage(warc.Source(b"".join(records))))
        assert ids(bare) == ids(found)[:-1]


def test_salvage_of_members_that_are_cut_off_or_damaged():
    r = random.Random(5)
    plain = [record(i, bytes(r.choices(range(256), k=400))) for i in range(50)]
    packed = warc.member(b"".join(plain))
    last = warc.member(record(99))
    for data in (packed[: len(packed) * 9 // 10], packed[: len(packed) * 9 // 10] + last, packed[:-4]):
        found = list(warc.salvage(warc.Source(data)))
        got = ids(found)
        n = len(got) - data.endswith(last)
        assert n >= 43 and got[:n] == [f"<urn:page:{i}>" for i in range(n)] and (got[-1] == "<urn:page:99>") == data.endswith(last)
        lost = [x for x in found if x.reason]
        assert lost[0].inside_start == sum(map(len, plain[:n])) and lost[0].inside_end is None
        assert found[0].start == 0 and found[-1].end == len(data)
    hurt = bytearray(packed)
    hurt[len(hurt) // 2] ^= 255
    found = list(warc.salvage(warc.Source(bytes(hurt) + last)))
    assert 20 <= len(ids(found)) < 51 and ids(found)[-1] == "<urn:page:99>"
    assert all(x.block == b"" or x.reason or x.block in b"".join(plain) + record(99) for x in found)
    bare = [x.replace(b"WARC-Block-Digest", b"X-Block-Digest") for x in plain]
    hurt = bytearray(warc.member(b"".join(bare)))
    hurt[-5] ^= 1  # the sum alone: nothing proves the records
    assert ids(warc.salvage(warc.Source(bytes(hurt)))) == []


def test_long_members_are_unpacked_piece_by_piece(monkeypatch):
    most = 0
    more = warc.Member.more

    def watched(self):
        nonlocal most
        more(self)
        most = max(most, len(self.held))

    monkeypatch.setattr(warc.Member, "more", watched)
    data = warc.member(b"".join([record(0), b"\0" * (64 << 20), record(1)]))
    found = list(warc.salvage(warc.Source(data)))
    assert ids(found) == ["<urn:page:0>", "<urn:page:1>"] and len(places(found)) == 1 and most < 8 << 20
    many = [record(i, b"y" * 5000) for i in range(1000)]
    assert len(ids(warc.salvage(warc.Source(warc.member(b"".join(many)))))) == 1000
    monkeypatch.setattr(warc, "MAX_RECORD", 1000)
    assert ids(warc.salvage(warc.Source(warc.member(many[0]) + warc.member(record(1))))) == ["<urn:page:1>"]


def test_headers_of_any_length():
    url = "http://example.org/" + "é%" * 900_000
    data = warc.record_bytes(1, url, b"x", None, False, warc.digest(b"x"))
    for archive in (data, warc.member(data)):
        assert ids(warc.salvage(warc.Source(archive + record(2)))) == ["<urn:page:1>", "<urn:page:2>"]


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400))
def test_bytes_are_all_accounted_for(seed, n):
    r = random.Random(seed)
    data = bytearray(b"".join(warc.member(record(i, bytes(r.choices(range(256), k=50)))) for i in range(5)))
    at = r.randrange(len(data))
    data[at : at + n] = bytes(r.choices(range(256), k=r.randint(0, n)))
    found = list(warc.salvage(warc.Source(bytes(data))))
    assert [x.start for x in found][:1] in ([0], []) and all(a.end == b.start or a.start == b.start for a, b in zip(found, found[1:]))
    assert found[-1].end == len(data)


def test_table(spark):
    rows = [(5, "http://a/\r\nX: y", "same", 0), (3, "http://b", "same", 0), (9, None, "same", 0), (1, "u", None, 0), (2, "u", "", 0), (None, "u", "same", 0), (7, "u", "é" * 50_000, 0), (8, "u", "other", 0)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, _sha int")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.page_round_trip(pages).collect()}
    d = warc.digest
    assert got == {5: (4, d(b"same"), "revisit", 3), 3: (4, d(b"same"), "response", None), 9: (4, d(b"same"), "revisit", 3), None: (4, d(b"same"), "revisit", 3), 1: (0, d(b""), "response", None), 2: (0, d(b""), "revisit", 1), 7: (100_000, d("é".encode() * 50_000), "response", None), 8: (5, d(b"other"), "response", None)}
    assert {r["record_type"] for r in warc.page_round_trip(pages, min_bytes=5).collect()} == {"response"}
    assert warc.page_round_trip(pages.limit(0)).collect() == []
    files = warc.write_archives(pages, file_bytes=100)
    whole = warc.read_archives(files).collect()
    assert len(whole) == len(rows) and files.count() > 1 and "é" * 50_000 in {bytes(r["payload"]).decode() for r in whole}
    folder = files.first()["path"].rpartition("/")[0]
    assert warc.list_archives(spark, folder).count() == files.count()


def test_no_row_is_lost_in_silence(spark, monkeypatch):
    """A reader that takes less than the writer gave fails; at the module's own bound it can't."""
    pages = spark.createDataFrame([(1, "u", "x" * 5000), (2, "u", "y")], "page_id bigint, url string, html string")
    assert warc.page_round_trip(pages).count() == 2 and warc.MAX_RECORD > 1 << 31
    read = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **b: read(*a, **b).where("payload_bytes < 1000"))
    with pytest.raises(RuntimeError, match="did not give back"):
        warc.page_round_trip(pages)


@pytest.mark.parametrize("line", [b"WARC/1.1\r\n", b"WARC/1.1\r\nA: b\r\n", b"WARC/1.1\r\nContent-Length: 900000000\r\n\r\n"])
@pytest.mark.parametrize("pack", [bytes, warc.member])
def test_damaged_runs_cost_no_square(line, pack):
    """Hundreds of thousands of broken headers, then a whole record."""
    data = pack(line * 200_000 + record(7))
    began = time.process_time()
    found = list(warc.salvage(warc.Source(data)))
    assert ids(found) == ["<urn:page:7>"] and time.process_time() - began < 30
