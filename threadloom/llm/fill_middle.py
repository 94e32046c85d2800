"""Fill-in-middle: documents cut at line ends into prefix, middle and suffix, and put in another order.

Where lines end is kept as a learned rank index: straight segments through the offsets of
all boundaries, each within an error bound, and the small residuals that remain. A cut is
the segment's prediction corrected by its residual, which is exact; a segment needs three
numbers and a boundary a residual of one or two bytes.

What a document becomes depends on its id alone, so reruns and retries agree. Documents are
handled one by one in Arrow batches, without a shuffle; form and restoring are column
functions.

Defined results: null and empty texts are ``plain`` with no units and an empty output;
documents that hold a marker are ``plain`` and unchanged; a null id is hashed like an empty
one; rows of equal ids each get their row; a text without line feeds is one unit; an empty
table gives an empty table; columns other than the two named are not read, so no names clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import portions

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: How far a segment's prediction may be from a boundary, in code points.
ERROR = 100
#: Bytes of text whose results form one Arrow batch.
CHUNK_BYTES = 16 << 20


@dataclass
class RankIndex:
    """Offsets of boundaries by their rank, as segments and residuals."""

    starts: list[int]
    bases: list[int]
    slopes: list[float]
    residuals: np.ndarray

    def __len__(self) -> int:
        return len(self.residuals)

    def predict(self, rank: int) -> int:
        at = bisect_right(self.starts, rank) - 1
        return self.bases[at] + round(self.slopes[at] * (rank - self.starts[at]))

    def offset(self, rank: int) -> int:
        """The exact offset of a boundary."""
        return self.predict(rank) + int(self.residuals[rank])


def fit(offsets: list[int], error: int = ERROR) -> RankIndex:
    """Index ascending ``offsets``: segments as long as one slope from their first point stays within ``error``."""
    starts, bases, slopes, predicted = [], [], [], []
    first, n = 0, len(offsets)
    while first < n:
        base, low, high, last = offsets[first], 0.0, float("inf"), first + 1
        while last < n:
            run, rise = last - first, offsets[last] - base
            least, most = (rise - error) / run, (rise + error) / run
            if least > high or most < low:
                break
            low, high, last = max(low, least), min(high, most), last + 1
        slope = (low + high) / 2 if last > first + 1 else 0.0
        starts.append(first)
        bases.append(base)
        slopes.append(slope)
        predicted += [base + round(slope * run) for run in range(last - first)]
        first = last
    residuals = np.array(offsets, np.int64) - np.array(predicted, np.int64)
    return RankIndex(starts, bases, slopes, residuals.astype(np.min_scalar_type(-error - 2)))


def boundaries(text: str) -> list[int]:
    """Where units begin and the last one ends, in code points; a unit is a line with its line feed, or what follows the last."""
    found, at = [0], text.find("\n")
    while at >= 0:
        found.append(at + 1)
        at = text.find("\n", at + 1)
    if found[-1] < len(text):
        found.append(len(text))
    return found


def cuts(index: RankIndex, first: int, second: int) -> tuple[int, int]:
    """Offsets where prefix and middle end: the boundaries that two numbers choose, in order."""
    return tuple(sorted((index.offset(first % len(index)), index.offset(second % len(index)))))


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document, from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, error: int = ERROR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n`` (units)``, form, prefix_chars, middle_chars, output`` for each row.

    Of the documents ``rate`` percent are transformed, ``spm_rate`` percent of these with the
    suffix first (``spm``) and the others with the prefix first (``psm``); the rest is
    ``plain``, with null for the sizes of its parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 1, CHUNK_BYTES):
                units, heads, middles, outputs = [], [], [], []
                for text, form, one, two in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                    index = fit(boundaries(text), error)
                    units.append(len(index) - 1)
                    a, b = (None, None) if form == "plain" else cuts(index, one, two)
                    heads.append(a)
                    middles.append(None if a is None else b - a)
                    if form == "psm":
                        text = "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
                    elif form == "spm":
                        text = "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
                    outputs.append(text)
                columns = [pa.array(units, pa.int64()), batch.column(2), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    one, two, three, four = draws(docs[id_col], seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (three % 100 >= rate)
    form = F.when(plain, "plain").when(four % 100 < spm_rate, "spm").otherwise("psm")
    rows = docs.select(docs[id_col], text.alias("__text"), form.alias("__form"), one.alias("__one"), two.alias("__two"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The exact text of an output. A transformed text holds no marker of its own, so its three parts can be told apart."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    return F.when(form == "psm", psm).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
