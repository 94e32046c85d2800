"""Personal data in texts: patterns propose spans, validators confirm them, nearby words adjust their scores.

Four kinds have base patterns whose confirmed matches always stay: e-mail addresses, IPv4
addresses, card numbers (Luhn) and phone numbers with a country code. Further patterns
propose what those miss: addresses written with "at" and "dot", IPv6 addresses, card numbers
next to other digits or with other separators, phone numbers without a country code, IBANs
(mod 97) and social security numbers. A further proposal stays if its score reaches
``THRESHOLD`` and it overlaps no base span and no better one. Words near a span raise or
lower its score; a proposal that is weak by itself needs them.

Texts are searched one by one in Arrow batches, whole and without a shuffle. Every pattern
takes time in proportion to the text: runs of characters are taken at once and never given
back, so long runs of digits or letters are no trap.

Defined results: null and empty texts have no spans; positions are code points; spans are in
order of their kind, then start; rows of equal ids, or without one, each get their row; an
empty table gives an empty table; columns other than the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import portions

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: From this score a proposal that is no base match stays.
THRESHOLD = 0.5
#: What a helpful or a misleading word nearby adds, and how many characters before and after count as near.
HELPS, MISLEADS = 0.35, -0.35
BEFORE, AFTER = 50, 20
CHUNK_BYTES = 16 << 20
SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"

_WORDS = {
    "email": ("e-?mails?|mail|contact|write|courriel|correo|kontakt", "example"),
    "ip": ("ip|ipv4|ipv6|address|host|server|client|login|adresse|servidor|serveur", "version|release|section|chapter|kapitel"),
    "card": ("cards?|credit|debit|visa|mastercard|amex|payment|karte|kreditkarte|carte|tarjeta", "order|tracking|serial|isbn|invoice|token|hash"),
    "phone": ("phone|telephone|tel|call|mobile|cell|fax|telefon|handy|rufnummer|téléphone|portable|teléfono|móvil", "order|isbn|serial|invoice|version|id"),
    "iban": ("iban|account|bank|transfer|konto|compte|cuenta", "token|key|hash|secret|commit"),
    "ssn": ("ssn|social security|taxpayer", "order|serial|part|isbn|invoice"),
}


def _any(words: str) -> re.Pattern:
    return re.compile(rf"(?<![^\W_])(?:{words})(?![^\W_])", re.IGNORECASE)


CONTEXT = {kind: (_any(good), _any(bad)) for kind, (good, bad) in _WORDS.items()}


@dataclass(frozen=True, slots=True)
class Span:
    kind: str
    start: int
    end: int
    score: float
    base: bool


def _digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of those before."""
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(map(int, digits[-1::-2])) % 10 == -sum(double[int(x)] for x in digits[-2::-2]) % 10


def mod97(code: str) -> bool:
    """Whether an IBAN's check digits fit: with its first four characters last and letters as 10 to 35 it leaves 1."""
    return int("".join(str(int(x, 36)) for x in code[4:] + code[:4])) % 97 == 1


def _octets(match: re.Match) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in match.group().split("."))


def _card(match: re.Match) -> bool:
    digits = _digits(match.group()) if match.end() - match.start() <= 37 else ""
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone(match: re.Match) -> bool:
    return 9 <= len(_digits(match.group())) <= 15


#: The base patterns. The first two also take runs that lead to no match, with no last group, so that none is looked at twice.
BASE: list[tuple[str, re.Pattern, Callable[[re.Match], bool], float]] = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?"), lambda m: True, 0.9),
    ("ip", re.compile(r"[0-9]++((?:\.[0-9]++){3})?"), _octets, 0.6),
    ("card", re.compile(r"([0-9](?:[\x20-]?[0-9])++)"), _card, 0.85),
    ("phone", re.compile(r"(\+[0-9][\x20().0-9-]+[0-9])"), _phone, 0.75),
]


def _ipv6(match: re.Match) -> float:
    try:
        IPv6Address(match.group())
    except AddressValueError:
        return 0.0
    return 0.7 if sum(map(bool, match.group().split(":"))) > 3 else 0.3


def _grouped_card(match: re.Match) -> float:
    """A card that stands beside other digits, which spoil the base match."""
    digits = _digits(match.group())
    return (0.6 if digits[0] in "3456" else 0.5) if luhn(digits) else 0.0


def _national(match: re.Match) -> float:
    n = len(_digits(match.group()))
    return 0.0 if not 7 <= n <= 15 else 0.5 if match.group()[0] in "+(" and 10 <= n <= 13 else 0.25


def _iban(match: re.Match) -> float:
    code = match.group().replace(" ", "")
    return 0.8 if 15 <= len(code) <= 34 and mod97(code) else 0.0


_NOT_IN_NUMBER = r"(?<![0-9A-Za-z])(?<![0-9][.,:/-])"
_NUMBER_ENDS = r"(?![0-9A-Za-z])(?![.,:/-][0-9])"
#: The further patterns, what their texts must hold to be searched at all, and the score that the validator gives; 0 refuses.
FURTHER: list[tuple[str, str, re.Pattern, Callable[[re.Match], float]]] = [
    ("email", "(", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?\(at\)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}", re.IGNORECASE), lambda m: 0.6),
    ("email", "[", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?\[at\]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}", re.IGNORECASE), lambda m: 0.6),
    ("ip", ":", re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:.])"), _ipv6),
    ("card", "0", re.compile(r"(?<![0-9])[0-9]{4}([\x20\xa0./-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"), _grouped_card),
    ("card", "0", re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])"), _grouped_card),
    ("phone", "0", re.compile(_NOT_IN_NUMBER + r"(?:\+[0-9]{1,3}[\x20-]?)?(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,8}(?:[\x20./-][0-9]{2,6}){0,4}" + _NUMBER_ENDS), _national),
    ("iban", "0", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"), _iban),
    ("ssn", "-", re.compile(_NOT_IN_NUMBER + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + _NUMBER_ENDS), lambda m: 0.3),
]
_DIGIT = re.compile("[0-9]")


def _score(text: str, kind: str, start: int, end: int, given: float) -> float:
    """A span's score with the words around it."""
    near = text[max(0, start - BEFORE) : start] + "\n" + text[end : end + AFTER]
    good, bad = CONTEXT[kind]
    found = given + (HELPS if good.search(near) else 0.0) + (MISLEADS if bad.search(near) else 0.0)
    return min(1.0, max(0.0, round(found, 6)))


def base_spans(text: str) -> list[Span]:
    """The confirmed matches of the base patterns, leftmost first for each kind; what fails is dropped and not tried again."""
    found, numbers = [], _DIGIT.search(text) is not None
    for (kind, pattern, confirms, given), asked in zip(BASE, ("@" in text, numbers and "." in text, numbers, numbers and "+" in text), strict=True):
        if asked:
            for m in pattern.finditer(text):
                if m.group(1) is not None and confirms(m):
                    found.append(Span(kind, m.start(), m.end(), _score(text, kind, m.start(), m.end(), given), True))
    return found


def spans(text: str) -> list[Span]:
    """All personal data of a text: base matches, and further proposals that score enough."""
    found = base_spans(text)
    numbers = _DIGIT.search(text) is not None
    proposed = []
    for kind, needs, pattern, validate in FURTHER:
        if numbers if needs == "0" else needs in text:
            for m in pattern.finditer(text):
                given = validate(m)
                score = _score(text, kind, m.start(), m.end(), given) if given else 0.0
                if score >= THRESHOLD:
                    proposed.append(Span(kind, m.start(), m.end(), score, False))
    if proposed:
        found = _without_overlaps(found, proposed)
    return sorted(found, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def _without_overlaps(kept: list[Span], proposed: list[Span]) -> list[Span]:
    """``kept`` and the proposals, best first, that overlap nothing so far. Taken spans are held by the blocks of text that they touch."""
    taken: dict[int, list[Span]] = {}

    def blocks(s: Span) -> range:
        return range(s.start >> 6, ((s.end - 1) >> 6) + 1)

    def add(s: Span) -> None:
        for at in blocks(s):
            taken.setdefault(at, []).append(s)

    found = list(kept)
    for s in kept:
        add(s)
    for s in sorted(proposed, key=lambda s: (-s.score, s.start, KINDS.index(s.kind))):
        if not any(x.start < s.end and s.start < x.end for at in blocks(s) for x in taken.get(at, ())):
            found.append(s)
            add(s)
    return found


def _mapped(docs: DataFrame, id_col: str, text_col: str, column: Callable[[list[str]], pa.Array], name: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1, CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0), column(batch.column(1).to_pylist())], names=[id_col, name])

    rows = docs.select(docs[id_col], F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {name} {kind}")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``, an array of kind, start, end (exclusive), score and whether it is a base match, for each row."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))

    def column(texts: list[str]) -> pa.Array:
        return pa.array([[(s.kind, s.start, s.end, s.score, s.base) for s in spans(x)] for x in texts], kind)

    return _mapped(docs, id_col, text_col, column, "spans", SPANS)


def masked_text(text: str) -> str:
    """The text with each span as its kind in brackets; of spans that overlap, the first that begins names them."""
    parts, at = [], 0
    for s in sorted(spans(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            parts += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text`` without personal data for each row."""
    return _mapped(docs, id_col, text_col, lambda texts: pa.array(map(masked_text, texts), pa.string()), "text", "string")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
