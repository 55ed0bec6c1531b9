"""Secret scanning with built-in expressions only.

Base rules are patterns; their matches and the text between them are taken apart by ``split`` and
``regexp_extract_all``, which gives positions. The method's own rule slides a window over every long
string of one character class and keeps Shannon entropy by incremental counts: one character enters,
one leaves, and the sum of c*log2(c) changes by the two counts touched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.common import narrowed

# The base rules. (kind, pattern, group that is measured, its least length)
BASE_RULES = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)

# Same matches as the rules above, found faster: a run that is too short for these is too short for the rule.
_SHORTCUTS = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


@dataclass(frozen=True)
class EntropyClass:
    """Strings of one alphabet, and the entropy in bits that a window of them must reach."""

    name: str
    pattern: str
    alphabet: str
    min_bits: float


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    EntropyClass("hexadecimal", r"(?<![A-Za-z0-9+/_-])[0-9A-Fa-f]{24,}(?![A-Za-z0-9+/_-])", _DIGITS + "abcdefABCDEF", 2.9),
    EntropyClass(
        "base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_-])",
        _LOWER + _LOWER.upper() + _DIGITS + "+/_-=", 3.9,
    ),
    # Smaller alphabets reach less; two digits at least tell their strings from words.
    EntropyClass(
        "base32", r"(?<![A-Za-z0-9+/_-])(?=[A-Z]*[2-7][A-Z]*[2-7])[A-Z2-7]{24,}={0,6}(?![A-Za-z0-9+/_-])", _LOWER.upper() + "234567=", 3.55,
    ),
    EntropyClass(
        "lower36", r"(?<![A-Za-z0-9+/_-])(?=[a-z]*[0-9][a-z]*[0-9])[a-z0-9]{24,}(?![A-Za-z0-9+/_-])", _LOWER + _DIGITS, 3.6,
    ),
)
WINDOW = 20

# Candidates that match one of these are not secrets: paths and words joined by signs, identifiers in
# canonical form, placeholders, counting sequences and strings of one case of letters. A part between signs that
# is long enough is judged by itself too, so that a placeholder beside a secret does not hide it.
ALLOW = (
    r"^[A-Za-z]+$",
    r"^[A-Za-z]+([-_/+][A-Za-z]+)+$",
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|xxxx|0123456789|abcdefghij",
)


def window_entropy(candidate: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of any ``window`` neighbouring characters.

    With counts c of the window's characters it is log2(w) - sum(c * log2(c)) / w. The sum is carried
    from window to window; only the counts of the character that enters and of the one that leaves
    are touched. Null for a string shorter than the window; characters outside ``alphabet`` share a count.
    """
    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    places = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c))
    # Entering character, and the one that leaves, -1 while the window fills.
    steps = F.transform(
        places, lambda p, i: F.struct(p.alias("enters"), F.coalesce(F.get(places, i - window), F.lit(-1)).alias("leaves"))
    )
    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0).alias("filled"),
        F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("least"),
    )

    def step(state: Column, x: Column) -> Column:
        entered = F.get(state["counts"], x["enters"])
        total = state["total"] + F.get(weights, entered + 1) - F.get(weights, entered)
        left = F.get(state["counts"], x["leaves"]) + (x["leaves"] == x["enters"]).cast("int")
        total = F.when(x["leaves"] < 0, total).otherwise(total + F.get(weights, left - 1) - F.get(weights, left))
        counts = F.transform(
            state["counts"], lambda c, i: c + (i == x["enters"]).cast("int") - (i == x["leaves"]).cast("int")
        )
        filled = state["filled"] + 1
        least = F.when(filled >= window, F.least(state["least"], total))
        return F.struct(counts.alias("counts"), filled.alias("filled"), total.alias("total"), least.alias("least"))

    return F.aggregate(steps, start, step, lambda state: F.lit(math.log2(window)) - state["least"] / window)


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _matches(text: Column, pattern: str, kind: str, rank: int, wanted: Column, group: int = 0) -> Column:
    """Spans of the pattern's matches, leftmost and not overlapping, whose ``group`` satisfies ``wanted``.

    The pieces of text around the matches give the positions, in code points.
    """
    found = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)),
        lambda whole, part: F.struct(F.length(whole).alias("length"), wanted(part).alias("wanted")),
    )
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["found"]["length"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        spans = F.when(x["found"]["wanted"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    pairs = F.zip_with(gaps, found, lambda gap, x: F.struct(gap.alias("gap"), x.alias("found")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda state: state["spans"])).otherwise(
        F.array().cast(_SPANS)
    )


def scanned(
    docs: DataFrame, text_col: str = "text", classes: Sequence[EntropyClass] = CLASSES, allow: Sequence[str] = ALLOW,
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with two columns more, ``base`` and ``added``: arrays of (start, rank, kind, end) in order of start,
    then kind; ends are exclusive, positions in code points. Columns that have these names are replaced.

    ``base`` are the matches of the base rules. ``added`` are strings of one character class in which some
    window reaches the class's entropy and which no allow-list pattern matches, or that have such a part between
    signs, unless a base span holds them. A null text counts as empty and has no spans. One narrow pass: nothing is shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = [
        _matches(text, _SHORTCUTS.get(kind, pattern), kind, rank, lambda part, least=least: F.length(part) >= least, group)
        for rank, (kind, pattern, group, least) in enumerate(BASE_RULES)
    ]

    def suspicious(c: EntropyClass):
        def secret(string: Column) -> Column:
            allowed = F.lit(False)
            for pattern in allow:
                allowed = allowed | string.rlike(pattern)
            return ~allowed & (F.coalesce(window_entropy(string, c.alphabet, window), F.lit(0.0)) >= c.min_bits)

        def test(candidate: Column) -> Column:
            parts = F.filter(F.split(candidate, "[-_/+]"), lambda p: (F.length(p) >= window) & (F.length(p) < F.length(candidate)))
            return secret(candidate) | F.exists(parts, secret)

        return test

    added = [
        _matches(text, c.pattern, f"entropy_{c.name}", len(BASE_RULES) + i, suspicious(c)) for i, c in enumerate(classes)
    ]
    found = F.array_sort(F.concat(*added)) if added else F.array().cast(_SPANS)
    out = docs.withColumns({"base": F.array_sort(F.concat(*base)), "added": found})
    return out.withColumn("added", F.filter(
        "added", lambda s: ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    ))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: ``doc_id, base, added``, as ``scanned`` finds them."""
    return scanned(narrowed(docs, doc_id=id_col, text=text_col), "text", **options).drop("text")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        more = F.when(s["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), more.alias("out"))

    return F.when(
        F.size(spans) > 0,
        F.aggregate(
            spans, start, step,
            lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))),
        ),
    ).otherwise(text)
