"""Fill-in-middle transformation: two cuts per text, rendered as prefix-suffix-middle or suffix-prefix-middle.

A text is a run of units: code points, words (each with the white space
character behind it) or lines (each with its newline). A wavelet matrix over
the classes of its bytes (``wavelet.py``) answers how many units begin or end
before a byte; the counts give the number of units and, by bisection on ranks,
the bytes of both cuts. Texts are handled in slices of about 1 MB (or one
text), so memory follows the longest text; nothing is shuffled, and a lost
executor costs its own tasks.

The draws h1 to h4 are the first four 8-digit groups of the hex SHA-256 of
``seed:doc_id``, so they depend on neither order nor partitions.

Defined results: null text is the empty text, which stays plain; a null doc_id
counts as the empty string; rows that repeat a doc_id get the same draws;
texts that hold a sentinel stay plain. All columns of the input but ``text``
come back in the struct ``row``, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrays import string_slices
from .common import in_struct
from .wavelet import BLANK, CLASS_OF, INSIDE, NEWLINE, WaveletMatrix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
STARTS = frozenset(range(8)) - {INSIDE}
#: Per unit the classes of its bound and whether the bound is the first byte of a unit (else its last).
UNITS = {"char": (STARTS, True), "word": (frozenset({BLANK, NEWLINE}), False), "line": (frozenset({NEWLINE}), False)}


def draws(doc_id: Column, seed: int) -> list[Column]:
    """h1 to h4 of each document, from 0 to 2**32 - 1."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cuts(matrix: WaveletMatrix, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text between the offsets: the number of units, both cuts as bytes, and the code points before and between them."""
    bound, leading = UNITS[unit]
    begin, end = offsets[:-1], offsets[1:]
    before = matrix.count(bound, begin)
    n = matrix.count(bound, end) - before
    if not leading:  # the rest behind the last bound is a unit, too
        n = n + ((end > begin) & (matrix.count(bound, np.maximum(end - 1, begin)) == matrix.count(bound, end)))
    first, second = h1 % (n + 1), h2 % (n + 1)

    def byte(units: np.ndarray) -> np.ndarray:
        if leading:  # k units end where the next one begins
            at = matrix.locate(bound, before + units + 1, begin, end)
            return np.where(units == n, end, at - 1)
        return np.where(units == n, end, matrix.locate(bound, before + units, begin, end))

    a, b = byte(np.minimum(first, second)), byte(np.maximum(first, second))
    chars = [matrix.count(STARTS, x) for x in (begin, a, b)]
    return n, a, b, chars[1] - chars[0], chars[2] - chars[1]


def _cut(unit: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            for row, end, offsets, data in string_slices(batch.column(4)):
                matrix = WaveletMatrix(CLASS_OF[data])
                n, a, b, before, between = cuts(matrix, offsets, h1[row:end], h2[row:end], unit)
                held, forms = data.tobytes(), batch.column(3).slice(row, end - row).to_pylist()
                outputs = []
                for i, form in enumerate(forms):
                    text, p, q = held[offsets[i] : offsets[i + 1]], int(a[i] - offsets[i]), int(b[i] - offsets[i])
                    if form == "psm":
                        text = b"".join((PREFIX.encode(), text[:p], SUFFIX.encode(), text[q:], MIDDLE.encode(), text[p:q]))
                    elif form == "spm":
                        text = b"".join((SUFFIX.encode(), text[q:], PREFIX.encode(), text[:p], MIDDLE.encode(), text[p:q]))
                    outputs.append(text)
                plain = np.array([form == "plain" for form in forms], dtype=bool)
                columns = [pa.array(n), pa.array(forms), pa.array(before, mask=plain), pa.array(between, mask=plain), pa.array(outputs, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *columns], names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, unit: str = "char", plain_share: int = 10, spm_share: int = 20, seed: int = 1) -> DataFrame:
    """Per row of ``docs``: row (its other columns), n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output.

    ``plain_share`` of a hundred texts stay as they are; of the rest, ``spm_share`` of a hundred begin with the suffix.
    """
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h3 % 100 >= 100 - plain_share)
    form = F.when(plain, "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    rows = docs.select(in_struct(docs, but="text").alias("row"), h1.alias("h1"), h2.alias("h2"), form.alias("form"), text.alias("text"))
    fields = StructType([rows.schema["row"], *StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary").fields])
    out = rows.mapInArrow(_cut(unit), fields)
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: sentinels stand in no text that was cut, so they part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
