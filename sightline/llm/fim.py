"""Fill-in-middle transformation by rotating blocks of a byte buffer in place.

A text is cut into prefix, middle and suffix at line ends. The sentinels are inserted into a bytearray that holds
the text in its own order; neighbouring blocks then change places by a rotation made of three reversals.
The same rotation, with the lengths exchanged, brings them back, so the text is restored byte for byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import narrowed

PREFIX_FIRST, SUFFIX_FIRST, PLAIN = "psm", "spm", "plain"
MARKS = ("<P>", "<S>", "<M>")

_OUTPUT = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"


def rotate(buffer: bytearray, begin: int, cut: int, end: int) -> None:
    """Exchange the neighbouring blocks [begin, cut) and [cut, end): reverse each, then both as one."""
    for a, b in ((begin, cut), (cut, end), (begin, end)):
        buffer[a:b] = buffer[a:b][::-1]


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document, the same in every run."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[at:at + 4], "big") for at in (0, 4, 8, 12)]


def line_ends(text: bytes) -> list[int]:
    """Byte offsets at which the text may be cut: its begin, and the end of each line."""
    ends = [0, *[m.end() for m in re.finditer(b"\n", text)]]
    return ends if ends[-1] == len(text) else [*ends, len(text)]


def arrange(text: bytes, first: int, second: int, form: str, marks: Sequence[bytes]) -> bytes:
    """The text with its parts, cut at two offsets, marked and put in the order of ``form``."""
    prefix, suffix, middle = marks
    buffer = bytearray(text)
    # From the last place to the first, so that offsets before stay true.
    buffer[second:second] = suffix
    buffer[first:first] = middle
    buffer[0:0] = prefix
    middle_at = len(prefix) + first
    suffix_at = middle_at + len(middle) + second - first
    rotate(buffer, middle_at if form == PREFIX_FIRST else 0, suffix_at, len(buffer))
    return bytes(buffer)


def rearrange(output: bytes, form: str, marks: Sequence[bytes]) -> bytes:
    """The text that ``arrange`` was given, from its output and form alone."""
    prefix, suffix, middle = marks
    buffer = bytearray(output)
    if form == PREFIX_FIRST:
        begin, cut = buffer.index(suffix), buffer.index(middle)
    else:
        begin, cut = 0, buffer.index(prefix)
    rotate(buffer, begin, cut, len(buffer))
    for mark in (suffix, middle, prefix):
        at = buffer.index(mark)
        del buffer[at:at + len(mark)]
    return bytes(buffer)


def _checked(marks: Sequence[str]) -> list[bytes]:
    """The marks in UTF-8; refused if one could be read across the border of another and a text that has none."""
    if len(marks) != 3 or len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different sentinels are needed, for prefix, suffix and middle")
    first = {m[0] for m in marks}
    if any(c in first for m in marks for c in m[1:]) or any(a.startswith(b) for a in marks for b in marks if a != b):
        raise ValueError("no sentinel may begin with another, nor hold a first character of any after its own")
    return [m.encode() for m in marks]


def transformed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, percent: int = 100,
    suffix_first_percent: int = 50, marks: Sequence[str] = MARKS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    ``n`` counts lines; the two cuts, whether the text is transformed (``percent`` of documents) and whether its suffix
    comes first (``suffix_first_percent`` of those) are drawn by hashing ``seed`` and the identifier, so equal
    identifiers draw alike; a null one counts as an empty string. ``output`` is the text with ``marks`` (prefix, suffix,
    middle) before its parts, as ``form`` orders them. A text that is null, empty or holds a mark stays as it is: form
    plain, no lengths. One narrow pass over whole texts, one text in memory besides its batch.
    """
    wanted = _checked(marks)

    def made(doc_id: int | None, text: bytes) -> tuple:
        ends = line_ends(text)
        n = len(ends) - 1
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or any(m in text for m in wanted) or h3 % 100 >= percent:
            return n, PLAIN, None, None, text
        first, second = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
        form = SUFFIX_FIRST if h4 % 100 < suffix_first_percent else PREFIX_FIRST
        sizes = len(text[:first].decode()), len(text[first:second].decode())
        return n, form, *sizes, arrange(text, first, second, form, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            rows = [made(i.as_py(), t.as_py() or b"") for i, t in zip(batch.column(0), texts)]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = narrowed(docs, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _OUTPUT).withColumn("output", F.col("output").cast("string"))


def restored(rows: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """``rows`` of ``transformed`` with a column ``restored``: the original text, from ``output`` and ``form`` alone.

    A null or unmarked ``output`` and form plain come back as they are.
    """
    wanted = _checked(marks)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("_output"), batch.column("form"))
            texts = [
                out.as_py() if form.as_py() in (None, PLAIN) or not out.is_valid else rearrange(out.as_py(), form.as_py(), wanted)
                for out, form in pairs
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(texts, pa.binary())], names=[*names, "restored"]
            )

    schema = rows.schema.add("restored", "binary")
    given = rows.withColumn("_output", F.col("output").cast("binary"))
    return given.mapInArrow(run, schema).withColumn("restored", F.col("restored").cast("string"))
