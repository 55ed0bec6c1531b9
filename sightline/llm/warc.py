"""WARC archives written and read through an index.

Writing leaves an index: archive, offset, length, URL and digest of every record. Nothing reads an archive
from its start; the wanted index rows are sorted by place, and neighbouring byte ranges are merged into
few large reads. Payloads move at most once, to meet the list of those that revisit another.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sightline.llm.common import narrowed
from sightline.operators import storage
from sightline.operators.ordering import join_null_safe

# Bytes after which a task begins another archive; payloads shorter than MIN_REVISIT are always stored; gzip level.
ARCHIVE_BYTES, MIN_REVISIT, LEVEL = 256 << 20, 100, 5
# Ranges closer than GAP bytes are read at once, up to READ bytes at a time.
GAP, READ = 64 << 10, 4 << 20
# Bytes of archives that a task reads, about.
TASK_BYTES = 32 << 20

CRLF = "\r\n"
RECORD_END = b"\r\n\r\n"


def _uri(page_id: Column) -> Column:
    """A record's identifier: a name-based one in the form of a UUID, made from the page's own, else from its payload and URL."""
    nameless = F.concat(F.lit("payload:"), F.col("payload_digest"), F.lit(":"), F.coalesce("url", F.lit("")))
    digest = F.md5(F.coalesce(F.concat(F.lit("page:"), page_id.cast("string")), nameless))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(target: Column) -> Column:
    """The header block of a record, up to and with its blank line; fields without a value are left out."""
    refers = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uri(F.col("page_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z" + CRLF),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(refers, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF),
            line("WARC-Refers-To", _uri(F.col("refers_to"))),
            line("X-Refers-To-Page", F.col("refers_to")),
        )).otherwise(F.lit("")),
        F.coalesce(line("X-Page", F.col("page_id")), F.lit("")),
        line("X-Payload-Length", F.col("payload_bytes")),
        F.lit("Content-Type: text/html" + CRLF),
        line("Content-Length", F.when(refers, F.lit(0)).otherwise(F.col("payload_bytes"))),
        F.lit(CRLF),
    )


def _revisits(rows: DataFrame, min_revisit: int) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload another page stores. No payload is moved."""
    long = rows.where(F.col("payload_bytes") >= min_revisit).select("page_id", "payload_digest")
    stored = long.groupBy("payload_digest").agg(
        F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last"), F.bool_or(F.col("page_id").isNull()).alias("_nameless")
    ).where("refers_to < _last or _nameless and refers_to is not null").drop("_last", "_nameless")
    again = long.join(stored, "payload_digest").where("page_id is null or refers_to < page_id")
    return again.dropDuplicates(["page_id", "payload_digest"])


_INDEX = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "archive string, offset bigint, length bigint"
)


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT,
) -> DataFrame:
    """Write a record per page to archives in ``folder`` and return the index, one row per record:
    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive, offset, length``.

    Archives are ``.warc.gz``, each record a gzip member of its own. Of equal payloads (by SHA-256) with at least
    ``min_revisit`` bytes the one with the smallest identifier is stored, the others revisit it. A null payload
    is empty, control characters and spaces in a URL become one space, and a repeated row is a record of its own. A page without
    an identifier revisits the one that is stored, and is itself stored where no page with that payload has an identifier.
    A task writes archives under fresh names and the index names only those of attempts that Spark committed, so a lost
    executor costs its tasks and leaves files that nothing refers to. An empty table gives an empty index.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = narrowed(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("bigint").alias("page_id"), F.regexp_replace("url", "[\\x00-\\x20]+", " ").alias("url"), "html",
        F.octet_length(payload).cast("bigint").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    )
    records = (
        join_null_safe(rows, _revisits(rows, min_revisit), ["page_id", "payload_digest"], "left")
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
        .withColumn("content", F.when(F.col("refers_to").isNull(), payload))
        .withColumn("header", _header(F.col("url")))
        .select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "header", "content")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        out, name, size = None, "", 0
        try:
            for batch in batches:
                names, offsets, lengths = [], [], []
                for header, content in zip(batch.column("header").to_pylist(), batch.column("content").to_pylist()):
                    if out is None or size >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(header.encode() + (content or b"") + RECORD_END, LEVEL, mtime=0)
                    out.write(member)
                    names.append(name)
                    offsets.append(size)
                    lengths.append(len(member))
                    size += len(member)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:6], pa.array(names, pa.string()), pa.array(offsets, pa.int64()),
                     pa.array(lengths, pa.int64())],
                    names=[c.split()[0] for c in _INDEX.split(", ")],
                )
        finally:
            if out is not None:
                out.close()

    return storage.save_table(records.mapInArrow(run, _INDEX), f"{folder}/index")


_RECORD = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, url string"


def merged_ranges(places: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, int, int]]:
    """Reads (offset, length, first place, place after the last) that cover sorted (offset, length) places."""
    first, begin, end = 0, None, None
    for i, (offset, length) in enumerate(places):
        if begin is not None and (offset - end > gap or max(end, offset + length) - begin > most):
            yield begin, end - begin, first, i
            first, begin = i, None
        if begin is None:
            begin, end = offset, offset + length
        end = max(end, offset + length)
    if begin is not None:
        yield begin, end - begin, first, len(places)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and content of one record; raises on a malformed one."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split(CRLF)
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != RECORD_END:
        raise ValueError("a record's length differs from its index")
    return fields, rest[:n]


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records at the index rows' places: ``page_id, record_type, refers_to, payload_bytes, payload_digest, url``
    and, if asked for, ``payload`` (empty for a revisit).

    Only the byte ranges of the given rows are read, in order of place; a stored payload's size and digest are
    taken from its bytes and must agree with its header. There are as many tasks as the wanted bytes fill; a job adds
    them up when called.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        opened, at = None, None
        for batch in batches:
            archives, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
            begin = 0
            while begin < len(archives):
                end = begin
                while end < len(archives) and archives[end] == archives[begin]:
                    end += 1
                if at != archives[begin]:
                    at = archives[begin]
                    opened = store.open_input_file(f"{root}/{at}")
                places = list(zip(offsets[begin:end], lengths[begin:end]))
                for start, size, i, j in merged_ranges(places):
                    block, rows = opened.read_at(size, start), []
                    for offset, length in places[i:j]:
                        fields, content = parse_record(gzip.decompress(block[offset - start:offset - start + length]))
                        digest = fields["warc-payload-digest"].partition(":")[2]
                        stored = fields["warc-type"] == "response"
                        if stored and hashlib.sha256(content).hexdigest() != digest:
                            raise ValueError(f"payload of record {fields['warc-record-id']} does not match its digest")
                        rows.append((
                            int(fields["x-page"]) if "x-page" in fields else None, fields["warc-type"],
                            None if stored else int(fields["x-refers-to-page"]),
                            len(content) if stored else int(fields["x-payload-length"]), digest,
                            fields.get("warc-target-uri"), content,
                        )[:len(types)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                begin = end

    schema = _RECORD + ", payload binary" * with_payload
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    # Ranges of places, so that a task reads a stretch of few archives in order. The rows to shuffle are tiny beside the
    # bytes they lead to, so the number of tasks is given.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    wanted = index.select("archive", "offset", "length").repartitionByRange(tasks, "archive", "offset")
    return wanted.sortWithinPartitions("archive", "offset").mapInArrow(run, schema)
