"""Personal data, also in disguise, with spans in the characters of the source text.

Plain patterns are searched first. Then transducers rewrite what hides an identifier
(look-alike characters, spelled digits, "at" and "dot" in words) and keep, for each character
that they write, the source characters it stands for; the same patterns run on the
rewritten text, and their spans are mapped back.
"""

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start inside a run of digits whose first digit gave none.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Latin letters, each with the letters of other alphabets that look like it.
_ALIKE = """
aаαɑ AАΑᎪ BВΒᏴ cсϲᴄ CСϹᏟ dԁ DᎠ eеҽ EЕΕᎬ gɡց GԌᏀ hһհ HНΗᎻ iіιɩı IІΙӀ jјϳյ JЈͿᎫ kκ KКΚᏦ lӏ LԼᏞ MМΜᎷ nո NΝ
oоοօᴏ OОΟՕ pрρ PРΡᏢ qԛզ QԚ rг RᎡᏒ sѕ SЅՏᏚ TТΤᎢ uυսᴜ UՍ vνѵᴠ VѴᏙ wԝᴡ WԜᎳ xхχ XХΧ yуγү YУΥҮ zᴢ ZΖᏃ
"""
LOOK_ALIKES = {other: group[0] for group in _ALIKE.split() for other in group[1:]}
_DASHES = frozenset("‐‑‒–—―−﹣")
_BLANKS = frozenset("      　")
_UNSEEN = frozenset("­​‌‍⁠﻿")
# Names of the digits 0 to 9 in the corpus's four languages.
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve")
_VALUE = {name: str(i) for names in DIGIT_NAMES for i, name in enumerate(names.split())}
_VALUE |= {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}
_NAME = "|".join(sorted(_VALUE, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:{_NAME}|\+?[0-9]+)(?:[ ,.()\-]{{1,3}}(?:{_NAME}|[0-9]+))+(?!\w)", re.I)
_ANY_NAME = re.compile(rf"(?<!\w)(?:{_NAME})(?!\w)", re.I)
_PART = re.compile(rf"{_NAME}|\+|[0-9]", re.I)
#: Digits that a spelled run has at least; shorter ones are prose.
SPELLED_DIGITS = 4
# Whole tokens of digits and letters that look like 0 and 1.
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[0-9]*[OolI])(?=[OolI]*[0-9])[0-9OolI]{2,}+(?![A-Za-z0-9])")
_AS_DIGIT = {"O": "0", "o": "0", "l": "1", "I": "1"}
_AT, _DOT = "at|arobase|arroba", "dot|point|punkt|punto"
_CODED = re.compile(r"&#0*+64;|&#x0*+40;|&commat;|(&#0*+46;|&#x0*+2e;|&period;)|(?<=[A-Za-z0-9])\s{1,3}@\s{1,3}(?=[A-Za-z0-9])", re.I)
_BRACKETED = re.compile(rf"\s*[\[({{<]\s*(?:({_AT}|@)|({_DOT}|\.))\s*[\])}}>]\s*", re.I)
_WORDED_AT, _WORDED_DOT = rf"[\s_]{{1,3}}(?:{_AT})[\s_]{{1,3}}", rf"[\s_]{{1,3}}(?:{_DOT})[\s_]{{1,3}}"
_WORDED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}?({_WORDED_AT}|@)[A-Za-z0-9-]{{1,63}}((?:(?:{_WORDED_DOT}|\.)[A-Za-z0-9-]{{1,63}})+)"
    r"(?![A-Za-z0-9-])", re.I)
# English words that stand before "at" and a site, and are no mailbox.
_BEFORE_SITE = frozenset(
    "and are available based be been blog buy find found from have here hosted is it join listed live located look looked looking looks "
    "me meet more now of on online or order page posted published read register see seen shop site them there these things this "
    "up us was website were work worked working works".split())
_SIGN = re.compile(rf"{_WORDED_DOT}|\.", re.I)
_SIGN_WORD = re.compile(rf"[\s_](?:{_AT}|{_DOT})[\s_]", re.I)


def emails(text: str) -> list[Span]:
    found, floor = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
        floor = match.end() if match else at + 1
        at = text.find("@", floor)
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def addresses(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15] if "+" in text else []


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, leftmost and non-overlapping within the kind."""
    if not _DIGIT.search(text):
        return {"email": emails(text), "ip": [], "card": [], "phone": []}
    return {"email": emails(text), "ip": addresses(text), "card": cards(text), "phone": phones(text)}


def look_alike(char: str) -> str | None:
    """What a character beyond ASCII stands for, None for itself."""
    if char in _UNSEEN:
        return ""
    if char in LOOK_ALIKES:
        return LOOK_ALIKES[char]
    if char in _DASHES:
        return "-"
    if char in _BLANKS:
        return " "
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", char)
    return plain if len(plain) == 1 and plain.isascii() and not plain.isspace() else None


class Rewritten:
    """A text and, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts: np.ndarray | None = None
        self.ends: np.ndarray | None = None

    def apply(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """Replace spans; each new character stands for a span of the present text."""
        if not edits:
            return
        if self.starts is None:
            self.starts = np.arange(len(self.text))
            self.ends = self.starts + 1
        pieces, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            pieces += [self.text[at:a], "".join(c for c, _, _ in new)]
            starts += [self.starts[at:a], np.array([self.starts[i] for _, i, _ in new], np.int64)]
            ends += [self.ends[at:a], np.array([self.ends[j - 1] for _, _, j in new], np.int64)]
            at = b
        self.text = "".join([*pieces, self.text[at:]])
        self.starts = np.concatenate([*starts, self.starts[at:]])
        self.ends = np.concatenate([*ends, self.ends[at:]])

    def source(self, span: Span) -> Span:
        return int(self.starts[span[0]]), int(self.ends[span[1] - 1])


def _look_alike_edits(text: str, known: dict[str, str | None]) -> list:
    if text.isascii():
        return []
    strange = {c for c in set(text) if ord(c) > 127}
    for c in strange - known.keys():
        known[c] = look_alike(c)
    strange = {c for c in strange if known[c] is not None}
    if not strange:
        return []
    found = re.finditer("[" + "".join(map(re.escape, sorted(strange))) + "]", text)
    return [(m.start(), m.end(), [(c, m.start(), m.end()) for c in known[m.group()]]) for m in found]


def _spelled_edits(text: str) -> list:
    if not _ANY_NAME.search(text):
        return []
    edits = []
    for m in _SPELLED.finditer(text):
        new, named = [], False
        for p in _PART.finditer(m.group()):
            named |= len(p.group()) > 1
            new.append((_VALUE.get(p.group().lower(), p.group()), m.start() + p.start(), m.start() + p.end()))
        if named and sum(c.isdigit() for c, _, _ in new) >= SPELLED_DIGITS:
            edits.append((m.start(), m.end(), new))
    return edits


def _mixed_edits(text: str) -> list:
    return [(m.start(), m.end(), [(_AS_DIGIT.get(c, c), i, i + 1) for i, c in enumerate(m.group(), m.start())])
            for m in _MIXED.finditer(text)]


def _address_edits(text: str) -> list:
    edits = [(m.start(), m.end(), [("@" if m.group(1) else ".", m.start(), m.end())]) for m in _BRACKETED.finditer(text)]
    edits += [(m.start(), m.end(), [("." if m.group(1) else "@", m.start(), m.end())]) for m in _CODED.finditer(text)]
    edits.sort(key=lambda e: e[:2])
    out = []
    for e in edits:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _worded_edits(seen: Rewritten) -> list:
    """Signs in words, where "@" or a bracketed, coded or worded sign beside them says that they are signs.

    A dot as it is proves nothing ("at example.com"), nor does "at" with "point" ("at this point in").
    """
    text, edits = seen.text, []
    if not _SIGN_WORD.search(text):
        return []
    for m in _WORDED.finditer(text):
        at, dots, plain = m.group(1).strip().strip("_").lower(), [], False
        if at == "at" and text[m.start():m.start(1)].lower() in _BEFORE_SITE:
            continue
        sure = at != "at"
        for d in _SIGN.finditer(m.group(2)):
            word, a, b = d.group().strip().strip("_").lower(), m.start(2) + d.start(), m.start(2) + d.end()
            # Behind a domain that is whole, the words of other languages are prose.
            if word == "." and seen.starts is not None and seen.ends[a] - seen.starts[a] > 1:
                sure = True
            elif word == ".":
                plain = True
            elif word == "dot" or (not plain and (sure or word != "point")):
                sure = True
                dots.append((a, b, [(".", a, b)]))
            else:
                break
        if sure:
            edits += [(*m.span(1), [("@", *m.span(1))])] * (at != "@") + dots
    return edits


def spans_of(text: str, known: dict[str, str | None]) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain spans, further spans found behind disguises) of each kind."""
    base = plain_spans(text)
    seen = Rewritten(text)
    seen.apply(_look_alike_edits(seen.text, known))
    seen.apply(_mixed_edits(seen.text))
    seen.apply(_spelled_edits(seen.text))
    seen.apply(_address_edits(seen.text))
    seen.apply(_worded_edits(seen))
    more: dict[str, list[Span]] = {k: [] for k in KINDS}
    if seen.starts is not None:
        for kind, found in plain_spans(seen.text).items():
            taken, i = base[kind], 0
            for span in map(seen.source, found):
                while i < len(taken) and taken[i][1] <= span[0]:
                    i += 1
                # One that a plain span holds only in part is a find of its own.
                if i == len(taken) or taken[i][0] > span[0] or taken[i][1] < span[1]:
                    more[kind].append(span)
    return base, more


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, str | None] = {}
    kinds = {k: i for i, k in enumerate(KINDS)}
    for batch in batches:
        ends, rows = [0], []
        for text in batch.column(1):
            base, more = spans_of(text.as_py() or "", known)
            both = [(kinds[k], a, b, i == 0) for i, found in enumerate((base, more)) for k in KINDS for a, b in found[k]]
            rows += sorted(both)
            ends.append(len(rows))
        spans = pa.StructArray.from_arrays(
            [pa.array([KINDS[r[0]] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_())],
            names=["kind", "start", "end", "plain"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, plain) for every row of ``docs`` (doc_id, text).

    Positions are code points of the source text, end exclusive, sorted by kind (email, ip, card,
    phone) and start. ``plain`` marks what the patterns find in the text as it is; a
    disguised find is left out only if it lies within a plain one of its kind, so both are listed
    where the plain one is a fragment. Null and empty texts have
    no spans. Rows are independent: nulls in doc_id and repeated rows pass through, an empty table gives no
    rows, other columns are not read. Spans of one kind that start together are ordered by their end. Very long texts are
    searched whole, as every search is linear in the text's length.

    A disguise is undone within these bounds: a mailbox of up to 64 and domain labels of up to 63 characters where a sign is a
    word (as mail allows), up to three blanks around a sign or between digits in words, runs of digits in words of
    ``SPELLED_DIGITS`` or more, and "at" only where a second sign, and no word that leads to a site ("look at"), is beside it.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _find, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,plain:boolean>>")


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by <kind>; spans that overlap give one, of the kind that starts first (the longest of those)."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))))
    end = F.aggregate(
        ordered, F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], -s["last"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                         F.lit("<"), s["kind"], F.lit(">"))).alias("out")))
    return F.concat(end["out"], F.substring(text, (end["at"] + 1).cast("int"), F.lit(2**31 - 1)))
