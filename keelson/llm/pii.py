"""Personal data (operator 3): base patterns, and offset-preserving deobfuscation that adds disguised identifiers.

Three finite-state transducers rewrite a text one after the other: homoglyphs to ASCII characters, spelled digits to
digits, at/dot disguises to @ and dots. Each output character keeps the span of the source that it stands for, so that
identifiers found in the result map back. A span that the method adds is always more than what the base patterns see: it
covers a homoglyph, a spelled digit or an at/dot disguise.

Offsets are code points of the source text, end exclusive. Null text counts as empty. Texts and names of any length are
read whole; every matcher is linear in the text. Rows that repeat are each judged; a null doc_id is kept as it is. An
empty table gives an empty result. Other columns of docs are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from keelson.llm.common import schema_of, text_of

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9]*(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping: the run of local characters before an @ starts the match, a domain must follow."""
    least, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        # no later match reaches back over this @: it is no local character
        least = m.end() if m else at + 1
        at = text.find("@", least)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        if run.end() - run.start() < 7 or "." not in run[0]:
            continue
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p) <= 255 or len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in four):
                yield at, at + size
            at += size + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


FINDERS = (emails, ips, cards, phones)


def base_spans(text: str) -> list[Span]:
    """(start, kind's number, end), sorted."""
    return sorted((a, k, b) for k, find in enumerate(FINDERS) for a, b in find(text))


# Letters of other scripts that look like ASCII ones.
CYRILLIC = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3", "ӏ": "l"}
GREEK = {"α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "ϳ": "j"}
LATIN = {"ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ᴏ": "o", "ꜱ": "s"}
MARKS = {"\u2024": ".", "\u3002": ".", "\uff61": ".", "\ufe52": ".", "\ufe6b": "@", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u2212": "-", "\ufe63": "-", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ", "\ufe62": "+"}
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _glyphs() -> dict[str, str]:
    """One character to one ASCII character, or to nothing: the tables above, full-width forms, other scripts' digits,
    and mathematical, circled and superscript letters and digits."""
    out = CYRILLIC | GREEK | LATIN | MARKS | dict.fromkeys(UNSEEN, "")
    out |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for low, high in ((0x1D400, 0x1D800), (0x2460, 0x24EA), (0x2070, 0x209D), (0x1FBF0, 0x1FBFA), (0xB2, 0xB4), (0xB9, 0xBA)):
        for c in map(chr, range(low, high)):
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                out[c] = plain
    for c in map(chr, [*range(0x660, 0x10000)]):
        if c not in out and unicodedata.category(c) == "Nd":
            out[c] = str(unicodedata.digit(c))
    return out


GLYPHS = _glyphs()
#: A quick test: only characters of this class can be in GLYPHS.
MAYBE_GLYPH = re.compile("[\xa0\xad\xb2\xb3\xb9\u0100-\U0010ffff]")
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
TIMES = {"double": 2, "triple": 3}
WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
TIMED, APART = r"(?:(?:double|triple)[ -]+)?", r"(?:[ ,.()-]{0,3}|[ ]+dot[ ]+)"
LABEL = r"[A-Za-z0-9-]+"
OPEN, SHUT = r"[ ]?[\[({<][ ]?", r"[ ]?[\])}>][ ]?"
AT_MARK = rf"(?:{OPEN}(?:at|@){SHUT})"
DOT_MARK = rf"(?:{OPEN}(?:dot|point|\.){SHUT})"
AT_BARE, DOT_BARE = r"(?:[ ]+at[ ]+|[ ]*_at_[ ]*|[ ]+@[ ]+)", r"(?:[ ]+dot[ ]+|[ ]*_dot_[ ]*)"
#: Common top-level names; words alone ("at", "dot") make an address only before one of these.
TOP_LEVEL = frozenset("com net org edu gov mil int info biz io co ai app dev me tv us uk eu de fr es it nl be at ch se no dk fi pl pt ru ua cn jp kr in br mx ar ca au nz za".split())

#: (from, to, c): the character c stands for the characters from to to.
Piece = tuple[int, int, str]


class Transducer:
    """A finite-state transducer with delayed output. Its input symbols are the named groups of a pattern; moves has the
    next state by (state, symbol). It reads as long as it can move and gives what it wrote up to the last place where it
    was in a final state and `ends` allowed an end; None if there is no such place."""

    def __init__(self, symbols: str, moves: dict, final: set, write, ends=lambda text, at: True):
        self.symbols, self.moves, self.final, self.write, self.ends = re.compile(symbols, re.I), moves, final, write, ends

    def read(self, text: str, at: int) -> tuple[int, list[Piece], object] | None:
        """Where the last such place is, what was written until there, and the state."""
        state, out, last = "start", [], None
        while m := self.symbols.match(text, at):
            state = self.moves.get((state, m.lastgroup))
            if state is None:
                break
            out += self.write(m)
            at = m.end()
            if state in self.final and self.ends(text, at):
                last = at, len(out), state
        return last and (last[0], out[: last[1]], last[2])


def no_letter(text: str, at: int) -> bool:
    return not (at < len(text) and text[at].isascii() and text[at].isalpha())


def write_digit(m: re.Match) -> list[Piece]:
    kind = m.lastgroup
    if kind == "item":
        return [(m.start(), m.end(), DIGITS[folded(m["word"])] if m["word"] else m["digit"])] * TIMES.get(folded(m["times"] or ""), 1)
    return [(m.start(), m.end(), "+" if kind == "plus" else ".")] if kind in ("plus", "dot", "point") else []


def digit_transducers() -> tuple[Transducer, Transducer]:
    """Seven or more digits, some spelled, with up to three signs or a spelled dot between; or four numbers of up to three
    digits parted by dots. Symbols that part digits are not written."""
    symbols = rf"(?P<plus>plus[ ,-]+)|(?P<item>(?:(?P<times>double|triple)[ -]+)?(?:(?P<word>{WORD})|(?P<digit>[0-9])))|(?P<dot>[ ]+dot[ ]+)|(?P<point>[.])|(?P<near>[ -])|(?P<sign>[,()])"
    row = {("start", "plus"): "plus", ("start", "item"): (1, 0), ("plus", "item"): (1, 0)}
    for n in range(1, 8):
        row[(n, 0), "dot"] = (n, "dot")
        for apart in (0, 1, 2, 3, "dot"):
            row[(n, apart), "item"] = (min(n + 1, 7), 0)
            row |= {((n, apart), c): (n, apart + 1) for c in ("point", "near", "sign") if apart in (0, 1, 2)}
    dotted = {("start", "item"): (1, 1, 0)}
    for n in range(1, 5):
        dotted |= {((n, 0, 0), "item"): (n, 1, 0)}
        for d in range(1, 4):
            dotted |= {((n, d, apart), "item"): (n, d + 1, 0) for apart in (0, 1) if d < 3}
            dotted[(n, d, 0), "near"] = (n, d, 1)
            dotted |= {((n, d, 0), c): (n + 1, 0, 0) for c in ("dot", "point") if n < 4}
    return Transducer(symbols, row, {(7, 0)}, write_digit, no_letter), Transducer(symbols, dotted, {(4, d, 0) for d in (1, 2, 3)}, write_digit, no_letter)


def write_mark(m: re.Match) -> list[Piece]:
    kind = m.lastgroup
    return [(m.start(), m.end(), "@" if kind in ("mark", "bare") else ".")] if kind in ("mark", "bare", "hidden") else []


def mark_transducer() -> Transducer:
    """From the @ of an address on. The @ is in brackets; or words or blanks alone mark it, or it is plain, and then words
    alone make an address by a disguised dot or by what stands around them. Labels and plain dots are not rewritten."""
    symbols = rf"(?P<mark>{AT_MARK})|(?P<bare>{AT_BARE})|(?P<hidden>{DOT_MARK}|{DOT_BARE})|(?P<label>{LABEL})|(?P<dot>[.])|(?P<plain>@)"
    moves = {("start", "mark"): "mark", ("start", "bare"): "bare", ("start", "plain"): "plain", ("hidden.", "label"): "hidden"}
    for kind in ("mark", "bare", "plain"):
        moves |= {(kind, "label"): f"{kind}1", (f"{kind}1", "dot"): f"{kind}.", (f"{kind}.", "label"): f"{kind}2", (f"{kind}2", "dot"): f"{kind}."}
    for state in ("mark1", "mark2", "bare1", "bare2", "plain1", "plain2", "hidden"):
        moves[state, "hidden"] = "hidden."
    moves["hidden", "dot"] = "hidden."
    return Transducer(symbols, moves, {"mark2", "bare2", "hidden"}, write_mark)


LONG_RUN, DOTTED_RUN = digit_transducers()
MARKED = mark_transducer()
#: Where the transducers may start.
DIGIT_START = re.compile(rf"(?<![A-Za-z])(?:plus|double|triple|{WORD}|[0-9])", re.I)
AT_START = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:(?P<mark>{AT_MARK})|{AT_BARE}|@)", re.I)
#: A dot disguised in brackets, or by a word between numbers.
NAME_DOT = re.compile(rf"(?<=[A-Za-z0-9])(?:{DOT_MARK})(?=[A-Za-z0-9])|(?<=[0-9])(?:{DOT_BARE})(?=[0-9])", re.I)
NAME = LOCAL - {"."}
DOT_AT_END = re.compile(rf"(?:{DOT_MARK})\Z", re.I)
#: No DOT_MARK is longer.
LONGEST_MARK = len(" ( point ) ")


def dot_before(text: str, at: int) -> int:
    """Where the disguised dot that ends at a place starts; -1 if none ends there."""
    if m := DOT_AT_END.search(text, max(0, at - LONGEST_MARK), at):
        return m.start()
    word = at
    while word and text[word - 1] == " ":
        word -= 1
    low = folded(text[max(0, word - 5) : word])
    size = 5 if low == "_dot_" else 3 if low.endswith("dot") and word < at and text[word - 4 : word - 3] == " " else 0
    if not size:
        return -1
    start = word - size
    while start and text[start - 1] == " ":
        start -= 1
    return start


def name_before(text: str, at: int) -> tuple[str, list[Piece]]:
    """The name that ends at a place: its last run of plain characters, and the disguised dots between its parts."""
    end, dots, last = at, [], None
    while True:
        start = end
        while start and text[start - 1] in LOCAL:
            start -= 1
        if last is None:
            last = text[start:end]
        if start == end:  # a dot with no name before it is none of the name's
            return last, dots[-2::-1] if dots else []
        mark = dot_before(text, start)
        if mark < 0:
            return last, dots[::-1]
        dots.append((mark, start, "."))
        end = mark


def name_like(word: str) -> bool:
    """Whether a word has a letter, and a digit, dot or underscore inside: more a mailbox than prose."""
    word = word.strip("._-")
    return any(c.isalpha() for c in word) and any(c in "._" or c.isdigit() for c in word)


class Mapped:
    """A normalised text with, for each of its characters, the source span that it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pieces: list[Piece], runs: list[tuple[int, int]]) -> None:
        """Put pieces for the runs (from, to) of characters that they are from; both in order."""
        if not runs:
            return
        text, start, end, at, k = [], [], [], 0, 0
        for a, b in runs:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            while k < len(pieces) and pieces[k][0] < b:
                x, y, c = pieces[k]
                text.append(c)
                start.append(self.start[x])
                end.append(self.end[y - 1])
                k += 1
            at = b
        text.append(self.text[at:])
        self.text, self.start, self.end = "".join(text), start + self.start[at:], end + self.end[at:]


def has_glyph(text: str) -> bool:
    return not text.isascii() and MAYBE_GLYPH.search(text) is not None and not GLYPHS.keys().isdisjoint(text)


def glyphs(text: str) -> tuple[list[Piece], list[tuple[int, int]]]:
    """The one-state transducer of the table GLYPHS, a character at a time."""
    runs = [(i, i + 1) for i, c in enumerate(text) if c in GLYPHS]
    return [(a, b, GLYPHS[text[a]]) for a, b in runs if GLYPHS[text[a]]], runs


#: What re.I takes for i and s besides what lower() makes of them; lower() would make two characters of the first.
ALSO = {0x130: "i", 0x131: "i", 0x17F: "s"}


def folded(text: str) -> str:
    """In lower case as re.I sees it, each character in its place."""
    return text.lower() if text.isascii() else text.translate(ALSO).lower()


def spelled(text: str) -> tuple[list[Piece], list[tuple[int, int]]]:
    out, runs, least = [], [], 0
    for m in DIGIT_START.finditer(text):
        at = m.start()
        if at < least:
            continue
        read = max((r for r in (LONG_RUN.read(text, at), DOTTED_RUN.read(text, at)) if r), key=lambda r: r[0], default=None)
        if read is None:
            continue
        least, pieces, _ = read
        if all(text[b - 1] in "0123456789" for _, b, c in pieces if c in "0123456789"):  # none is spelled
            continue
        if at and text[at - 1] == "+" and len(pieces) > 1:  # a phone number needs a character after its first digit
            pieces.insert(1, (*pieces[0][:2], "-"))
        out += pieces
        runs.append((at, least))
    return out, runs


#: What stands in every match of AT_START and of NAME_DOT.
AT_SIGN = re.compile(r"[ \[({<_]at[ \])}>_]|@", re.I)
DOT_SIGN = re.compile(r"[ \[({<_](?:dot|point|\.)[ \])}>_]", re.I)


def marked(text: str) -> tuple[list[Piece], list[tuple[int, int]]]:
    out, least = [], 0
    for m in AT_START.finditer(text) if AT_SIGN.search(text) else ():
        if m.start() < least or (read := MARKED.read(text, m.start())) is None:
            continue
        end, pieces, state = read
        name, dots = name_before(text, m.start())
        if not m["mark"] and re.split(r"[^A-Za-z0-9-]+", text[m.start() : end])[-1].lower() not in TOP_LEVEL:
            continue
        if state == "bare2" and "@" not in m[0] and not name_like(name):
            continue
        out += [d for d in dots if d[0] >= least] + pieces
        least = end
    taken = {a for a, _, _ in out}
    out += [(m.start(), m.end(), ".") for m in NAME_DOT.finditer(text) if m.start() not in taken] if DOT_SIGN.search(text) else []
    out.sort()
    clear, last = [], 0
    for p in out:
        if p[0] >= last:
            clear.append(p)
            last = p[1]
    return clear, [p[:2] for p in clear]


NEXT_DIGIT = re.compile(rf"{WORD}{APART}(?:{WORD}|[0-9]|double|triple)")
DIGIT_BEFORE = re.compile(rf"[0-9]{APART}{TIMED}{WORD}")


def may_spell(text: str) -> bool:
    """Whether a spelled digit stands in a run of digits: every run that `spelled` rewrites holds one, not inside a word,
    with a digit before or after it."""
    low = folded(text)
    for word in DIGITS:
        at = low.find(word)
        while at >= 0:
            if not (at and "a" <= low[at - 1] <= "z") and NEXT_DIGIT.match(low, at):
                return True
            at = low.find(word, at + 1)
    return DIGIT_BEFORE.search(low) is not None


def hidden_spans(text: str) -> list[Span]:
    """Identifiers that show in the normalised text only, as spans of the source. Each step looks at what the one before
    it left."""
    mapped = None
    for rewrites in (lambda t: has_glyph(t) and glyphs(t), lambda t: may_spell(t) and spelled(t), marked):
        found = rewrites(mapped.text if mapped else text)
        if found and found[1]:
            mapped = mapped or Mapped(text)
            mapped.rewrite(*found)
    if mapped is None or mapped.text == text:
        return []
    out = []
    for k, find in enumerate(FINDERS):
        for a, b in find(mapped.text):
            start, end = mapped.start[a], mapped.end[b - 1]
            if text[start:end] != mapped.text[a:b]:
                out.append((start, k, end))
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and these with the added ones; nothing is added inside a base span of its kind."""
    base = base_spans(text)
    added = hidden_spans(text)
    if not added:
        return base, base
    # spans of a kind don't overlap, so only the last base span that starts no later can hold an added one
    own = [[(a, b) for a, k, b in base if k == kind] for kind in range(len(KINDS))]
    holder = lambda s: bisect_right(own[s[1]], (s[0], len(text))) - 1
    added = [s for s in added if (at := holder(s)) < 0 or own[s[1]][at][1] < s[2]]
    return base, sorted({*added}.union(base)) if added else base


def as_text(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


PII_SPARK, PII_ARROW = schema_of(doc_id="long", n_email="long", n_ip="long", n_card="long", n_phone="long", base_sha256="string", spans="string", n_added="long")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base, every = all_spans(text)
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(every), len(every) - len(base)))
        cols = zip(*rows) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(PII_ARROW)[1:]))], schema=PII_ARROW)


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts and a digest of the base spans, and all spans with the added ones, for each row of docs (doc_id, text)."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(_find, PII_SPARK)


def masked(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in angle brackets; spans that overlap merge under the first's kind."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join(out) + text[at:]
