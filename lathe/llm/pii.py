"""Operator 7: personal data, disguised or not, at its place in the source text.

Emails, IP addresses, card and phone numbers are found by patterns in the text as it is (base spans). Then transducers
normalise disguises and keep, for every edit, where it came from: look-alike letters and digits of other scripts, invisible
characters, words or brackets for @ and the dot, and numbers spelled digit by digit. The patterns run on the normalised text;
a find that an edit took part in is mapped back to the source. It is added if it overlaps no base span.

The transducers work line by line: none reads over a line break, and a find depends on its own line alone. Numbers of parts
and their lengths have no bounds. All patterns run in time linear in the text, so very long texts are no trouble. Offsets count code points; ends are
exclusive. Null and empty texts have no spans. Repeated rows give repeated rows; an empty table gives an empty table;
other columns of the input are ignored by ``spans_of`` and kept by ``redacted``.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import arrow_map, small_batches, unnamed

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile("[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _HOST.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind: leftmost matches of each kind; failing ones are dropped."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if _NUMBER.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := "".join(_NUMBER.findall(m[0]))) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_NUMBER.findall(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


#: Letters of other scripts and the Latin letters they look like.
_ALIKE = dict(zip("аеорсухіѕјһԁԛԝАВЕКМНОРСТХУІЅЈαορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxisjhdqwABEKMHOPCTXYISJaopvikABEZHIKMNOPTYX", strict=True))
#: Invisible characters.
_INVISIBLE = "­​‌‍⁠﻿"
#: Names of the digits 0 to 9 by language.
_DIGITS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_SPELLED = {w: str(i) for names in _DIGITS for i, w in enumerate(names.split())}
_LETTERS = str.maketrans(_ALIKE | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {chr(c): str(unicodedata.digit(chr(c))) for first in (0x660, 0x6F0, 0x966) for c in range(first, first + 10)})

_ODD = re.compile(f"[{''.join(map(re.escape, map(chr, _LETTERS)))}{_INVISIBLE}]")
_BRACKETS = re.compile(r"[\[({<][ \t]*+(?:(?P<at>at|arroba|@|chez)|dot|punkt|punto|point|\.)[ \t]*+[\])}>]", re.I)
#: Last parts of host names that tell an address in plain words from prose.
_TOPS = frozenset("com net org edu gov info biz io dev app eu de fr es uk us ch nl it pl ru ca jp se dk fi cz pt gr ie hu ro br mx ar cl cn kr tw hk sg au nz za tr il ua co".split())
#: On lower-case text: what may stand for @, and a host name whose dots may be words or stand alone.
_ANCHOR = re.compile(r" (?:at|@) |@")
_CHAIN = re.compile(r"[a-z0-9-]++(?:(?: dot | \. |\.)[a-z0-9-]++)++")
_JOINT = re.compile(r" dot | \. |\.")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
#: Words that prose has before "at" and the name of a site.
_BEFORE_AT = frozenset(
    "a an the and or but is are was were be been it its he she they we i you us me him her them this that these those here there "
    "look looks looked looking site sites page pages website home online web blog more information info details available found find "
    "see visit read shop buy hosted live up out now only not over also back data code docs documentation help support contact start "
    "starts join order orders download downloads posted published listed works work worked working employed anywhere free all both "
    "article articles news story version copy archive list email mail write ask call go get stay sign register registered meet "
    "click seen located based learn report reports project sold on off down in away again directly everything something".split()
)


def _any_of(words: Iterable[str]) -> str:
    """A pattern of these words that looks at each letter once."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    some = "|".join(re.escape(first) + _any_of(rest) for first, rest in by.items() if first)
    return (f"(?:{some})?+" if "" in by else f"(?:{some})") if some else ""


_WORDS, _POINT = _any_of(_SPELLED), r"(?:dot|point|punkt|punto)"
#: On lower-case text: every run of spelled numbers has this in it.
_TWO_NUMBERS = re.compile(rf"\b{_WORDS}[ \t,-]{{1,3}}(?:{_WORDS}|{_POINT}|[0-9])")
_RUN = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ \t]*+)?(?:{_WORDS}|[0-9]++)(?!\w)(?:[ \t,-]{{1,3}}(?:{_WORDS}|[0-9]++|{_POINT})(?!\w))+")
_TOKEN = re.compile(r"\w+|\+|[ \t,-]+")


class Edited:
    """A text and the edits that made it; gives places of the text before them."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        self.edits, out, at, shift = [], [], 0, 0
        for a, b, new in edits:
            out += [text[at:a], new]
            self.edits.append((a + shift, a + shift + len(new), a, b))
            shift, at = shift + len(new) - (b - a), b
        self.text = "".join([*out, text[at:]])
        self._firsts = [e[0] for e in self.edits]

    def before(self, place: int, end: bool) -> int:
        """The source place of a start, or of an exclusive end."""
        i = bisect_right(self._firsts, place - end) - 1
        if i < 0:
            return place
        first, last, a, b = self.edits[i]
        if place - end < last:
            return b if end else a
        return place - last + b


Edit = tuple[int, int, str]


def _lower(text: str) -> str:
    """Lower case, and as long as the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _in_brackets(text: str) -> Iterator[Edit]:
    """(at), [dot] and the like, with the blanks around them."""
    done = 0
    for m in _BRACKETS.finditer(text):
        start, end = m.span()
        while start > done and text[start - 1] in " \t":
            start -= 1
        while end < len(text) and text[end] in " \t":
            end += 1
        done = end
        yield start, end, "@" if m["at"] else "."


def _in_words(text: str) -> Iterator[Edit]:
    """Addresses such as "jane dot roe at example dot com": at, then a host name, then what stands before."""
    low, done = _lower(text), 0
    for m in _ANCHOR.finditer(low):
        host = _CHAIN.match(low, m.end())
        if m.start() < done or not host:
            continue
        joints = [*_JOINT.finditer(low, host.start(), host.end()), None]
        last = next((i for i in range(len(joints) - 1, 0, -1) if low[joints[i - 1].end() : joints[i].start() if joints[i] else host.end()] in _TOPS), 0)
        if not last:
            continue
        end = joints[last].start() if joints[last] else host.end()
        if end < len(text) and text[end] in _LABEL and text[end] != "-":
            continue
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start == m.start() or not text[m.start() - 1].isalnum():
            continue
        points: list[Edit] = []
        while low.endswith(" dot ", done, start) and start - 5 > done and text[start - 6] in _LABEL:
            points.append((start - 5, start, "."))
            start -= 5
            while start > done and text[start - 1] in _LABEL:
                start -= 1
        plain, tail = " " not in low[m.end() : end], text[joints[last - 1].end() : end]
        if plain and (m[0] == "@" or m[0] == " at " and (low[start : m.start()] in _BEFORE_AT or not (tail.islower() or tail.isupper()))):
            continue
        done = end
        yield from reversed(points)
        if m[0] != "@":
            yield m.start(), m.end(), "@"
        yield from ((j.start(), j.end(), ".") for j in joints[:last] if j[0] != ".")


def _in_digits(text: str) -> Iterator[Edit]:
    """Numbers spelled digit by digit, three words or more. Where only some gaps have commas, those end a number."""
    low, done = _lower(text), 0
    for found in _TWO_NUMBERS.finditer(low):
        if found.start() < done:
            continue
        first, done = low.rfind("\n", 0, found.start()) + 1, low.find("\n", found.start())
        done = done if done >= 0 else len(low)
        for run in _RUN.finditer(low, first, done):
            parts = [*_TOKEN.finditer(low, *run.span())]
            gaps = ["," in p[0] for p in parts if p[0][0] in " \t,-"]
            ends = [i for i, p in enumerate(parts) if "," in p[0]] if any(gaps) and not all(gaps) else []
            for a, b in zip([0, *(i + 1 for i in ends)], [*ends, len(parts)], strict=True):
                if sum(p[0] in _SPELLED for p in parts[a:b]) >= 3:
                    yield parts[a].start(), parts[b - 1].end(), "".join(map(_digits, (p[0] for p in parts[a:b])))


def _digits(token: str) -> str:
    if token in _SPELLED:
        return _SPELLED[token]
    return token if token.isdigit() else "+" if token in ("plus", "+") else "." if token[0] in "dp" else ""


def _edits(text: str) -> list[Edited]:
    """The texts of the transducers that edit anything, one after the other."""
    made = []
    for edits in (_hidden, _in_brackets, _in_words, _in_digits):
        if found := list(edits(text)):
            made.append(Edited(text, found))
            text = made[-1].text
    return made


def _hidden(text: str) -> Iterator[Edit]:
    return iter(()) if text.isascii() else ((m.start(), m.end(), "") for m in re.finditer(f"[{_INVISIBLE}]+", text))


def find_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base) in the order of ``base_spans``."""
    base = base_spans(text)
    out = [(*x, True) for x in base]
    alike = text if text.isascii() or not _ODD.search(text) else text.translate(_LETTERS)  # as long as the text
    made = _edits(alike)
    if made or alike != text:
        last = made[-1].text if made else alike
        taken = sorted((a, b) for a, b, _ in base)
        for a, b, kind in base_spans(last):
            start, end = a, b
            for step in reversed(made):
                start, end = step.before(start, False), step.before(end, True)
            i = bisect_right(taken, (end, -1)) - 1
            if text[start:end] != last[a:b] and not (i >= 0 and max(y for _, y in taken[max(0, i - len(KINDS)) : i + 1]) > start):
                out.append((start, end, kind, False))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_SPANS = "spans array<struct<start: long, end: long, kind: string, base: boolean>>"


def spans_of(docs: DataFrame) -> DataFrame:
    """doc_id, spans of each row."""
    small_batches(docs.sparkSession)

    def rows(part: pa.RecordBatch) -> dict:
        found = [find_spans(x or "") for x in part.column(1).to_pylist()]
        return {"doc_id": part.column(0), "spans": [[dict(zip(("start", "end", "kind", "base"), s, strict=True)) for s in x] for x in found]}

    return arrow_map(docs.select("doc_id", "text"), rows, f"doc_id long, {_SPANS}", "text")


def replaced(text: str, spans: list) -> str:
    """The text with ``<KIND>`` for each span; of overlapping spans the first one's name stands for all."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns, with spans replaced in the texts, and n_chars (where it is a column) counted anew for those."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(names.index("text")).to_pylist()
            new = [x if not x else replaced(x, find_spans(x)) for x in old]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(new, batch.column(names.index("text")).type)
            if "n_chars" in names:
                counted = zip(batch.column(names.index("n_chars")).to_pylist(), old, new, strict=True)
                columns[names.index("n_chars")] = pa.array([n if a == b else len(b) for n, a, b in counted], batch.column(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return unnamed(docs).mapInArrow(run, docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts and a digest of the base spans, and all spans as text."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = spans_of(docs)
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda x: x == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
