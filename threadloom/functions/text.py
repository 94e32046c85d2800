"""Text columns: tokens, compact forms, occurrence counts, labels and ids."""

from __future__ import annotations

import unicodedata

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

PREVIEW_CHARS = 160
KIND_LABELS = {
    "user_message": "user",
    "agent_message": "assistant",
    "command_execution": "command",
    "file_change": "file",
    "reasoning_summary": "reasoning",
    "thread_name": "thread name",
    "thread_preview": "thread preview",
}


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into one ASCII letter and marks, and those letters."""
    plain = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and all(map(unicodedata.combining, marks)):
            plain[chr(code)] = base
    marks = "".join(map(chr, range(0x300, 0x370)))  # what has no counterpart is left out
    return "".join(plain) + marks, "".join(plain.values())


_ACCENTED, _PLAIN = _accents()
#: Words: what is alphabetic (vowel signs are) or a number.
_WORD = r"[\p{IsAlphabetic}\p{N}]+"
_TOKEN = regex.compile(r"[\p{Alphabetic}\p{N}]+")


def fold_accents(text: Column) -> Column:
    """Latin letters without their accents, be these part of the letter or marks after it."""
    return F.translate(text, _ACCENTED, _PLAIN)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def has_text(text: Column) -> Column:
    """Whether there is anything but white space."""
    return F.rlike(text, F.lit(r"(?U)\S"))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; null: none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def query_tokens(query: str) -> list[str]:
    """The tokens of a query, on the driver."""
    return _TOKEN.findall(query.lower())


def compact_line(text: Column) -> Column:
    """White space made single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact_preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """``compact_line`` cut to ``chars`` characters and three dots."""
    line = compact_line(text)
    return F.when(F.length(line) > chars, F.concat(F.substring(line, 1, chars), F.lit("..."))).otherwise(line)


def compact_text(text: Column) -> Column:
    """The trimmed non-empty lines joined by slashes."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != ""), " / ")


def substring_count(text: Column, needle: Column) -> Column:
    """How often ``needle`` (not empty) occurs without overlap, A-Z in either case alike."""
    low, part = ascii_lower(text), ascii_lower(needle)
    return ((F.length(low) - F.length(F.replace(low, part, F.lit("")))) / F.length(part)).cast("long")


def regex_count(text: Column, pattern: str) -> Column:
    """How often a pattern matches; one at least, as for a text that is known to match."""
    return F.greatest(F.regexp_count(text, F.lit(pattern)), F.lit(1)).cast("long")


def token_count(text: Column, query: list[str]) -> Column:
    """How many of the text's tokens are among the query's."""
    return F.size(F.filter(tokens(text), lambda t: t.isin(query))).cast("long")


def term_count(text: Column, pattern: str) -> Column:
    """How often a text that is known to match holds the pattern's words; if none of them is a word of the text, how often the pattern itself, and one at least."""
    words, needle = query_tokens(pattern), pattern.strip()
    whole = F.greatest(substring_count(text, F.lit(needle)), F.lit(1)) if needle else F.lit(1)
    return (F.coalesce(F.nullif(token_count(text, words), F.lit(0)), whole) if words else whole).cast("long")


def contains_phrase(haystack: Column, query: list[str]) -> Column:
    """Whether the query's tokens follow one another in an array of tokens."""
    return F.contains(F.concat(F.lit(" "), F.array_join(haystack, " "), F.lit(" ")), F.lit(" " + " ".join(query) + " "))


def contains_all(haystack: Column, query: list[str]) -> Column:
    """Whether an array of tokens holds all of the query's."""
    return F.size(F.array_except(F.array(*map(F.lit, query)), haystack)) == 0 if query else F.lit(False)


def markdown_cell(text: Column) -> Column:
    """Text for a cell of a markdown table."""
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def kind_label(kind: Column) -> Column:
    """The word shown for an item's kind; other kinds are shown as they are."""
    label = None
    for name, shown in KIND_LABELS.items():
        label = (F if label is None else label).when(kind == name, shown)
    return label.otherwise(kind)


def rfc3339(ts: Column, suffix: str = "Z") -> Column:
    """A UTC timestamp with no, three or six digits of fraction, as far as they are needed."""
    micros = F.unix_micros(ts) % 1_000_000
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    digits = F.when(micros == 0, "").when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0")))
    return F.concat(whole, digits.otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit(suffix))
