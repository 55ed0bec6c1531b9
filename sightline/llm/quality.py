"""Quality rules with built-in expressions only: counts within a text, and lines that a host repeats across documents.

Lines are normalised and hashed; for every host the distinct documents that hold a line are counted. Lines above the
host's limit are removed, and a document that loses most of its words by that is depleted and rejected.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.common import narrowed, written
from sightline.operators import storage

# Fixed values of the base rules: white space, signs, least words, hundredths of words in repeated windows.
_WHITE, SYMBOLS = "\t\n\x0b\x0c\r ", "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3

# A line is removed if more documents of its host hold it than this, and more than these thousandths of them.
LINE_DOCS, LINE_PERMILLE = 10, 10
# Hundredths of the words of its distinct lines that a document must keep.
LEAST_LEFT = 50


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return."""
    return F.array_remove(F.split(text, f"[{_WHITE}]+"), "")


def lines_with_words(text: Column) -> Column:
    """The lines, cut at line feeds, that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.ltrim(line, F.lit(_WHITE)) != "")


def run_hash(*words: Column) -> Column:
    """A number that equal runs of words share; runs that share it need not be equal."""
    return F.xxhash64(*words)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a run of ``window`` words that occurs twice or more in the list.

    Runs are sorted by hash, with their places, and neighbours of one hash are compared word by word; should any of them
    differ, all runs that share their hash with another are sorted as text instead. Where all hashes differ, no run occurs
    twice. In order of place, a marked run adds the words up to the next marked one, ``window`` at most. ``words`` is read for
    every run, so it should be a column that holds them already.
    """
    def run(at: Column) -> list[Column]:
        return [F.get(words, at + k) for k in range(window)]

    def following(items: Column) -> Column:
        return F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))

    def neighbours(runs: Column) -> Column:
        """Pairs of places whose runs are equal and neighbours when sorted."""
        return _let(F.sort_array(runs), lambda s: F.filter(
            F.zip_with(s, following(s), lambda x, y: F.when(x["run"] == y["run"], F.array(x["at"], y["at"]))),
            lambda pair: pair.isNotNull(),
        ))

    def marked(pairs: Column) -> Column:
        return F.sort_array(F.array_distinct(F.flatten(pairs)))

    def differ(pair: Column) -> Column:
        return reduce(or_, [x != y for x, y in zip(run(pair[0]), run(pair[1]))])

    def confirmed(pairs: Column) -> Column:
        as_text = F.transform(marked(pairs), lambda at: F.struct(F.concat_ws(" ", *run(at)).alias("run"), at.alias("at")))
        return F.when(F.exists(pairs, differ), neighbours(as_text)).otherwise(pairs)

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, following(places), lambda x, y: F.least(F.lit(window), y - x))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def hashed(x: Column, at: Column) -> Column:
        return run_hash(x, *run(at)[1:])

    starts = F.slice(words, 1, F.greatest(F.size(words) - (window - 1), F.lit(0)))
    alike = neighbours(F.transform(starts, lambda x, at: F.struct(hashed(x, at).alias("run"), at.alias("at"))))
    return (
        F.when(F.size(words) <= window, F.lit(0))
        .when(F.size(F.array_distinct(F.transform(starts, hashed))) == F.size(starts), F.lit(0))
        .otherwise(_let(marked(_let(alike, confirmed)), covered))
    )


def rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) and ``base_failed``.

    Characters are code points. A duplicate line holds a word and equals an earlier line; a null or empty text has no
    words and fails. One narrow pass. Columns that have these names are replaced.
    """
    text, words = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col("_words")
    out = docs.withColumn("_words", words_of(text)).withColumns({
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
        "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint"),
        "n_dup_lines": _let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_words(words).cast("bigint"),
    }).drop("_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def normalised_lines(text: Column) -> Column:
    """Distinct lines that hold a word: A-Z lower-cased, runs of digits as one 0, runs of white space as one space, trimmed."""
    upper = "".join(map(chr, range(65, 91)))
    # Where all characters are ASCII, the plain lower case changes A-Z alone and goes by bytes.
    ascii_only = F.octet_length(text) == F.length(text)
    plain = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
    plain = F.regexp_replace(F.regexp_replace(plain, "[0-9]+", "0"), f"[{_WHITE.replace(chr(10), '')}]+", " ")
    return F.array_remove(F.array_distinct(F.transform(F.split(plain, "\n"), lambda line: F.trim(line))), "")


def host_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``host, d1, d2, line, words, total``: every distinct line of every distinct text of a host, hashed, with its words
    and those of all distinct lines of the text.

    Texts of one host that are equal count as one document, so mere copies do not make a line frequent. The two hashes of the
    text stand for it. A null host counts as an empty one.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"), *text_key(text),
        normalised_lines(text).alias("_lines"),
    )
    counted = rows.withColumn("_lines", F.transform("_lines", lambda line: F.struct(
        F.xxhash64(line).alias("line"), (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words")
    )))
    total = F.aggregate("_lines", F.lit(0), lambda sum_, x: sum_ + x["words"])
    exploded = counted.select("host", "d1", "d2", total.alias("total"), F.explode("_lines").alias("x"))
    rows = exploded.select("host", "x.line", "d1", "d2", "x.words", "total")
    return rows.groupBy("host", "line", "d1", "d2").agg(F.first("words").alias("words"), F.first("total").alias("total"))


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("second"), text).alias("d2")]


def frequent_lines(lines: DataFrame, line_docs: int = LINE_DOCS, line_permille: int = LINE_PERMILLE) -> DataFrame:
    """``host, line`` of the lines that more than ``line_docs`` documents of the host hold, and more than ``line_permille``
    thousandths of its documents that have lines.
    """
    sizes = lines.select("host", "d1", "d2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    held = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > line_docs)
    return held.join(storage.sized(sizes), "host").where(1000 * F.col("held") > line_permille * F.col("size")).select("host", "line")


def depleted(
    lines: DataFrame, line_docs: int = LINE_DOCS, line_permille: int = LINE_PERMILLE, least_left: int = LEAST_LEFT,
) -> DataFrame:
    """``host, d1, d2`` of the texts that keep less than ``least_left`` hundredths of the words of their distinct lines
    when the host's frequent lines are removed.
    """
    frequent = storage.sized(written(frequent_lines(lines, line_docs, line_permille), "frequent-lines"))
    lost = lines.join(frequent, ["host", "line"]).groupBy("host", "d1", "d2").agg(
        F.sum("words").alias("removed"), F.first("total").alias("total")
    )
    return lost.where(100 * (F.col("total") - F.col("removed")) < least_left * F.col("total")).select("host", "d1", "d2")


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    line_docs: int = LINE_DOCS, line_permille: int = LINE_PERMILLE, least_left: int = LEAST_LEFT,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    ``kept`` is false where the base rules fail (see ``rules``) or the text is depleted (see ``depleted``). A null text counts as
    empty, a null host as an empty one; repeated rows and null identifiers come back as they are. Texts are read twice and never
    shuffled: once for their lines, whose hashes are shuffled, once for the rules. Runs jobs when called.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col, host=host_col)
    lines = written(host_lines(rows, "host", "text"), "host-lines")
    gone = written(depleted(lines, line_docs, line_permille, least_left), "depleted")
    text = F.coalesce(F.col("text"), F.lit(""))
    ruled = rules(rows).withColumn("host", F.coalesce(F.col("host").cast("string"), F.lit(""))).select("*", *text_key(text))
    found = ruled.drop("text").join(storage.sized(gone.withColumn("gone", F.lit(True))), ["host", "d1", "d2"], "left")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("gone").isNull()).alias("kept"),
    )
