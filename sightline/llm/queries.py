"""The corpus operators as registered queries, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm import (
    alignment, ann, bpe, exact_dedup, fim, langid, minhash, packing, quality, secret_scan, substrings, toxicity, warc,
)
from sightline.llm.common import fold, table
from sightline.operators import storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@_query()
def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


@_query()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


@_query()
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


@_query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query("""
    WITH sized AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
                   FROM pages),
         firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS least
                    FROM sized)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN least < page_id OR (page_id IS NULL AND least IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN least < page_id OR page_id IS NULL THEN least END AS refers_to
    FROM firsts
""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = storage.new_path(spark, "warc")
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records = warc.read_records(index, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("""
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           coalesce(doc_id = max(doc_id) OVER same, max(doc_id) OVER same IS NULL) AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@_query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 5) == 0
    found = toxicity.scored(docs, toxicity.teach(docs, labels.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query()
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    found = langid.identified(docs, langid.teach(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query()
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(table(spark, sf_dir, "documents"), least=200)


@_query()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind, *_ in secret_scan.BASE_RULES],
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


@_query()
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


@_query(f"""
    WITH texts AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
                          row_number() OVER () AS row FROM documents),
         worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
                    FROM texts),
         runs AS (SELECT row, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS run
                  FROM (SELECT row, words, unnest(range(1, len(words) - 1)) AS i FROM worded)),
         twice AS (SELECT row, i FROM runs QUALIFY count(*) OVER (PARTITION BY row, run) > 1),
         repeated AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY row),
         ruled AS (SELECT row, doc_id, host, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                          length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                          len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
                   FROM worded LEFT JOIN repeated USING (row)),
         failing AS (SELECT *, n_words < {quality.LEAST_WORDS}
                               OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM ruled),
         split AS (SELECT DISTINCT host, text, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), chr(10))) AS raw FROM texts),
         normal AS (SELECT DISTINCT host, text,
                           trim(regexp_replace(regexp_replace(raw, '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
                    FROM split),
         lined AS (SELECT *, len(string_split(line, ' ')) AS words FROM normal WHERE line <> ''),
         sizes AS (SELECT host, count(DISTINCT text) AS size FROM lined GROUP BY host),
         frequent AS (SELECT host, line FROM lined JOIN sizes USING (host) GROUP BY host, line, size
                      HAVING count(*) > {quality.LINE_DOCS} AND 1000 * count(*) > {quality.LINE_PERMILLE} * size),
         totals AS (SELECT host, text, sum(words) AS total FROM lined GROUP BY host, text),
         gone AS (SELECT host, text FROM lined JOIN frequent USING (host, line) JOIN totals USING (host, text)
                  GROUP BY host, text, total HAVING 100 * (total - sum(words)) < {quality.LEAST_LEFT} * total)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND gone.text IS NULL AS kept
    FROM failing LEFT JOIN gone ON failing.host = gone.host AND failing.text = gone.text
""")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


@_query("""
    WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h,
                        regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
         drawn AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
                          ('0x' || h[25:32])::BIGINT AS h4 FROM cut),
         parts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS first, greatest(h1 % (n + 1), h2 % (n + 1)) AS second,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                               THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
         texts AS (SELECT *, coalesce(array_to_string(units[1:first], ''), '') AS p,
                          coalesce(array_to_string(units[first + 1:second], ''), '') AS m,
                          coalesce(array_to_string(units[second + 1:], ''), '') AS s FROM parts)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM texts
""")
def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restored(fim.transformed(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
