"""A corpus pipeline: language, exact copies, near copies, secrets, packing.

Each stage takes all that the one before kept and is written and read again between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm import exact_dedup, langid, minhash, packing, secret_scan
from sightline.llm.common import fold, table, written
from sightline.operators.ordering import join_null_safe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# A document whose mean probability of every language is lower than this is rejected, as is one without a letter.
MIN_LANGUAGE_SCORE = 0.25
SEQUENCE_TOKENS = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches: those without a letter go, those whose mean probability of every
    language is under MIN_LANGUAGE_SCORE. Probabilities of n languages add up to 1, so that bound
    rejects by score only where more than four are taught; a higher one would cost clean documents (README). Where no row
    has a language to teach, only texts without a letter go.
    """
    model = langid.teach(docs.where(fold("doc_id", 4) != 2))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.identified(docs, model, carried=COLUMNS[1:])
    accepted = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(accepted).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier, once if its row is repeated or if none has an identifier."""
    kept = exact_dedup.exact_groups(docs, keep="smallest").where("kept").select("doc_id", "text_sha256").distinct()
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    same = join_null_safe(docs.select(*COLUMNS, digest.alias("text_sha256")), kept, ["doc_id", "text_sha256"], "left_semi")
    return same.dropDuplicates(["doc_id", "text_sha256"]).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on shingles of five words: the smallest identifier.
    Documents without an identifier stay.
    """
    copies = minhash.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span that the scan finds masked; ``n_chars`` follows the text."""
    spans = F.array_sort(F.concat("base", "added"))
    masked = secret_scan.scanned(docs, "text").withColumn("_masked", secret_scan.redacted(F.col("text"), spans))
    changed = F.size("base") + F.size("added") > 0
    return masked.select(
        "doc_id", F.when(changed, F.col("_masked")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.length("_masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most SEQUENCE_TOKENS tokens, one row per piece."""
    return packing.pack(docs, capacity=SEQUENCE_TOKENS)


STAGES = [
    ("language ID", language_id), ("exact dedup", exact_copies), ("near dedup", near_copies),
    ("secret scans", secrets), ("best-fit packing", packed),
]

# A trained model decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
