import hashlib
import re
import time

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import pii
from tests.llm import cases

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+ (1029\n", max_size=40))
def test_base(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123 -", min_size=14, max_size=30))
def test_cards(text):
    assert pii.base_spans(text) == brute(text)


FOUND = [
    ("mail john.doe [at] mail3.example [dot] com now", "email", "john.doe [at] mail3.example [dot] com"),
    ("jane dot doe at example dot com", "email", "jane dot doe at example dot com"),
    ("see john (at) example.com.", "email", "john (at) example.com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("ｊohn＠example．com!", "email", "ｊohn＠example．com"),
    ("joh​n@example.com", "email", "joh​n@example.com"),
    ("card ４１１１ 1111 1111 1111 ok", "card", "４１１１ 1111 1111 1111"),
    ("four " + " ".join(["one"] * 15), "card", "four " + " ".join(["one"] * 15)),
    ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
    ("host 192[.]168[.]1[.]1 up", "ip", "192[.]168[.]1[.]1"),
    ("write to hein.19 at mail5.example.com today", "email", "hein.19 at mail5.example.com"),
    ("write to john @ example.com today", "email", "john @ example.com"),
    ("at one nine two dot one six eight dot one dot one it is", "ip", "one nine two dot one six eight dot one dot one"),
    ("host 192 dot 168 dot 1 dot 1 up", "ip", "192 dot 168 dot 1 dot 1"),
]
CLEAN = ["meet me at example.com or version 2.0 at example.com", "see it. at home.com", "one two three at the dot of noon", "she was at work (dot) fine", "zero to one, two or three", "café привет 12.30", "meet at noon. Dot com firms fell.", ""]


def test_disguises_keep_their_places():
    for text, kind, span in FOUND:
        base, every = pii.all_spans(text)
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in base] == [(kind, span)], text
        assert set(base) <= set(every)
    for text in CLEAN:
        assert pii.all_spans(text) == ([], []), text
    assert pii.masked("a b@c.de f", pii.base_spans("a b@c.de f")) == "a <email> f"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["one", "at", " ", "[at]", "dot", "com", "5", "а", "@", ".", "​", "plus", "+", "double", "x", "(dot)", "１"]), max_size=25).map("".join))
def test_added_spans_lie_in_the_text(text):
    base, every = pii.all_spans(text)
    assert base == brute(text) and set(base) <= set(every)
    assert all(0 <= a < b <= len(text) for a, _, b in every)


def unfiltered(text):
    """What is found when every transducer reads every text."""
    mapped, always = pii.Mapped(text), re.compile("")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pii, "AT_SIGN", always)
        m.setattr(pii, "DOT_SIGN", always)
        return every_step(text, mapped)


def every_step(text, mapped):
    for rewrites in (pii.glyphs, pii.spelled, pii.marked):
        mapped.rewrite(*rewrites(mapped.text))
    whole = [(mapped.start[a], k, mapped.end[b - 1], mapped.text[a:b]) for k, f in enumerate(pii.FINDERS) for a, b in f(mapped.text)]
    return [(a, k, b) for a, k, b, m in whole if text[a:b] != m]


def test_prefilters_hide_nothing():
    for text, kind, span in [*FOUND, *DISGUISES]:
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in unfiltered(text)] == [(kind, span)]


def test_names_of_any_length():
    for name in ("a1" * 300, ".".join(["part"] * 100), "x" * 5000 + ".y"):
        text = f"write to {name} at example.com today"
        assert [text[a:b] for a, _, b in pii.hidden_spans(text)] == [f"{name} at example.com"]
    name = " dot ".join(["mailbox" * 12] * 5)
    text = f"see: {name} at example dot com."
    assert [text[a:b] for a, _, b in pii.hidden_spans(text)] == [f"{name} at example dot com"]
    name = " [dot] ".join(["n" * 150] * 3)
    text = f"see: {name} [at] example [dot] com"
    assert [text[a:b] for a, _, b in pii.hidden_spans(text)] == [f"{name} [at] example [dot] com"]


def test_transducers():
    read = pii.LONG_RUN.read("one two 3-double four,5 six seven x", 0)
    assert (read[0], "".join(c for *_, c in read[1])) == (33, "12344567")
    assert pii.LONG_RUN.read("one two three", 0) is None and pii.LONG_RUN.read("one two three four five six seventh", 0) is None
    read = pii.DOTTED_RUN.read("one 2 seven dot zero.0 dot 1 dot 5", 0)
    assert "".join(c for *_, c in read[1]) == "127.0.0.1"
    read = pii.MARKED.read(" (at) mail.example [dot] com. Then", 0)
    assert (read[0], read[1]) == (28, [(0, 6, "@"), (18, 25, ".")])
    assert pii.MARKED.read(" at home", 0) is None
    assert [m["word"] for m in pii.LONG_RUN.symbols.finditer("ONE zero") if m["item"]] == ["ONE", "zero"]


DISGUISES = [
    ("write to john.doe_at_example.com today", "email", "john.doe_at_example.com"),
    ("write to hein.19  at  example.com today", "email", "hein.19  at  example.com"),
    ("write to user [at ] host.com today", "email", "user [at ] host.com"),
    ("write to user (at ) host.com today", "email", "user (at ) host.com"),
    ("\u0130\u0130 write to hein.19 at example.com today", "email", "hein.19 at example.com"),
    ("call +1 415 555 26 double seven now", "phone", "+1 415 555 26 double seven"),
    ("write to john.doe _at_ example.com today", "email", "john.doe _at_ example.com"),
    ("write to john [at ] example.com today", "email", "john [at ] example.com"),
    ("host one two seven dot zero dot zero dot one up", "ip", "one two seven dot zero dot zero dot one"),
    ("host eight dot eight dot eight dot eight up", "ip", "eight dot eight dot eight dot eight"),
    ("host 1 dot 2 dot 3 dot four up", "ip", "1 dot 2 dot 3 dot four"),
]


def test_disguises_need_no_other_sign():
    for text, kind, span in DISGUISES:
        base, every = pii.all_spans(text)
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in every if (a, k, b) not in base] == [(kind, span)], text
    for text in ("One. Two. Three. Four.", "one dot two dot three", "look_at_this and that"):
        assert pii.all_spans(text) == ([], []), text
    assert pii.spelled("five f\u0130ve five \u017feven five five five")[1]


PIECES = ["one", "two", "\u017fix", "f\u0130ve", "hein.19", "a_b", "x", "at", "AT", "dot", "point", "host.com", "com", "[", "]", "(", ")", " ", "  ", "_", "@", ".", "-", ",", "5", "127", "double", "plus", "+", "\u0130", "\u0430", "\uff11", "_at_", " [at ] ", " dot "]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_filtered_and_unfiltered_agree(text):
    assert pii.hidden_spans(text) == unfiltered(text)


def test_table(spark):
    rows = [(i, t) for i, (t, *_) in enumerate(FOUND)] + [(50, None), (51, "a@b.co " * 2000), (52, "9" * 100_000 + "@" * 50_000 + "+1" * 50_000)]
    got = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        base = brute(t or "") if i != 52 else pii.base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(pii.as_text(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x == k for _, x, _ in base) for k in range(4)]
    assert len(pii.find_pii(cases.clashing(spark)).collect()) == len(cases.rows()) and pii.find_pii(cases.empty(spark)).collect() == []


@pytest.mark.parametrize("text", ["a@b.co " * 80_000 + "y.com x [at] y.com " * 80_000, "a.b1 at b.com " * 80_000, "x dot " * 80_000 + "x at y dot com", " " * 200_000 + "a at b.com"])
def test_time_is_linear(text):
    began = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - began < 25  # the square would take some minutes


def plain_spans(text):
    base = pii.base_spans(text)
    added = [s for s in pii.hidden_spans(text) if not any(k == s[1] and a <= s[0] and s[2] <= b for a, k, b in base)]
    return base, sorted({*added, *base})


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.co", "x [at] y.com", " at ", " dot ", "[dot]", "a", "b1", "y.com", "1.2.3.4", "one", "two", " ", ".", "\u0430@b.co", "+1 (716) 555-8176", "@", "  "]), max_size=12))
def test_added_spans_against_every_base_span(parts):
    assert pii.all_spans("".join(parts)) == plain_spans("".join(parts))
