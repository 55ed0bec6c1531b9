"""Removal of long byte strings that occur more than once in a corpus, by suffix sorting.

Every run of ``least`` bytes has an anchor: the gram of GRAM bytes in it with the smallest hash. Equal runs have
equal anchors, so all that can be equal meets by the anchor's hash. Neighbouring runs share anchors; the
stretch of text that holds all runs of one anchor stands for them. Stretches that are equal as a whole are
repeated throughout and are collapsed before anything is compared. The distinct stretches of an anchor are
sorted by their suffixes, in two stages, and a run is repeated if it is the common prefix of two
neighbours. Nothing but anchors and such stretches is shuffled: texts are written once, as they were read, and
later steps come back to a task's file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import narrowed, written
from sightline.llm.shingles import _INVERSE, _PRIME, _powers, mixed
from sightline.llm.suffixes import repeated_starts
from sightline.llm.words import portions
from sightline.operators import storage

GRAM = 32
# Distinct stretches of one anchor that are sorted together; of more, pieces meet by longer anchors, their cores.
TOGETHER = 1024
# Stretches that a block of anchors holds on average; runs of a piece of a crowded anchor's stretch.
BLOCK, GRAIN = 1024, 16


def anchors(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """For every anchor, in order: text, first run's place in it, further runs, hash of the anchor, hash of its stretch."""
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(texts), np.uint8)
    gram = min(GRAM, least)
    width = least - gram + 1
    n = len(data)
    owner = np.repeat(np.arange(len(texts)), lengths)
    runs = np.flatnonzero(ends[owner] - np.arange(n) >= least) if n else np.zeros(0, np.int64)
    if not len(runs):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_PRIME, n), out=sums[1:])
    back = _powers(_INVERSE, n + 1)
    grams = mixed((sums[gram:] - sums[:n + 1 - gram]) * back[:n + 1 - gram])
    # The smallest hash in each window of ``width`` grams, and the first place that has it: minima from both
    # sides of blocks as long as the window.
    keyed = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(keyed) // width) + 1
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(keyed)] = keyed
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back_min = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(back_min[runs], ahead[runs + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    opens = np.ones(len(runs), bool)
    opens[1:] = (runs[1:] != runs[:-1] + 1) | (place[1:] != place[:-1])
    at = np.flatnonzero(opens)
    first, last = runs[at], runs[np.append(at[1:], len(runs)) - 1]
    size = (last - first + least).astype(np.uint64)
    stretch = mixed((sums[last + least] - sums[first]) * back[first] + size * np.uint64(0x632BE59BD9B4E019))
    text = owner[first]
    return text, first - (ends - lengths)[text], last - first, grams[place[at]].view(np.int64), stretch.view(np.int64)


def anchor_place(stretch: bytes, least: int) -> int:
    """Where in a stretch its anchor begins."""
    gram = min(GRAM, least)
    data = np.frombuffer(stretch, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.append(np.uint64(0), np.cumsum(data * _powers(_PRIME, len(data)), dtype=np.uint64))
    grams = mixed((sums[gram:] - sums[:-gram]) * _powers(_INVERSE, len(data) + 1)[:len(data) + 1 - gram])
    shared = slice(max(0, len(data) - least), least - gram + 1)  # the grams that all runs of the stretch have
    return shared.start + int(np.argmin(grams[shared] >> np.uint64(32)))


def _rows(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_TEXTS = "doc_id bigint, part int, row int, raw binary"
_ANCHORS = "part int, row int, first int, more int, gram bigint, stretch bigint"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(row, row + n, dtype=np.int32)),
             batch.column(1)],
            names=["doc_id", "part", "row", "raw"],
        )
        row += n


class _Files:
    """The texts of one task's file, in order, from the shared folder."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, root = fs.FileSystem.from_uri(folder)
        self.files: dict[int, list[str]] = {}
        for f in sorted(self.store.get_file_info(fs.FileSelector(root)), key=lambda f: f.base_name):
            if found := re.match(r"part-(\d+)", f.base_name):
                self.files.setdefault(int(found[1]), []).append(f.path)

    def batches(self, part: int) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for path in self.files.get(part, []):
            with self.store.open_input_file(path) as file:
                yield from pq.ParquetFile(file).iter_batches(256, columns=["doc_id", "row", "raw"], use_threads=False)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The rows of each part, one after another, from rows that are sorted by it."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        rows = batch.to_pandas()
        while len(rows):
            same = rows[rows["part"] == rows["part"].iat[0]]
            if held and held[0]["part"].iat[0] != same["part"].iat[0]:
                yield pd.concat(held)
                held = []
            held.append(same)
            rows = rows.iloc[len(same):]
    if held:
        yield pd.concat(held)


def _runs_of(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of neighbouring numbers in an ascending array."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist()))


def repeated(
    docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and with ``with_text`` also
    ``spans array<struct<begin, end>>`` and ``kept`` (bytes).

    Removed is every byte in a run of ``least`` UTF-8 bytes that begins anywhere else in the table too, in the same
    document or in another; runs are judged on the input. A null text is empty. Rows with one identifier
    are documents of their own. Runs jobs when called.
    """
    if least < 8:
        raise ValueError("runs have 8 bytes at least")
    spark = docs.sparkSession
    raw = F.coalesce(F.col("raw"), F.lit("")).cast("binary")
    rows = narrowed(docs, doc_id=id_col, raw=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), raw.alias("raw"))
    folder = storage.new_path(spark, "texts")
    rows.mapInArrow(_numbered, _TEXTS).write.option("compression", "zstd").parquet(folder)
    texts = spark.read.schema(_TEXTS).parquet(folder)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("raw").to_pylist()
            part, row = (batch.column(c).to_numpy() for c in ("part", "row"))
            for a, b in portions(own, 1 << 19):
                text, first, more, gram, stretch = anchors(own[a:b], least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[a:b][text], pa.int32()), pa.array(row[a:b][text], pa.int32()), pa.array(first, pa.int32()),
                     pa.array(more, pa.int32()), pa.array(gram), pa.array(stretch)],
                    names=["part", "row", "first", "more", "gram", "stretch"],
                )

    found = written(texts.select("part", "row", "raw").mapInArrow(anchored, _ANCHORS), "anchors")
    # Written, so that the join below reads two plain shuffles, whose hot anchors adaptive execution splits.
    shared = written(found.groupBy("gram").agg(
        F.count(F.lit(1)).alias("n"), (F.min("stretch") != F.max("stretch")).alias("differ")
    ).where("n > 1").drop("n"), "shared-anchors")
    met = written(found.join(shared, "gram"), "met")
    kinds = met.where("differ").groupBy("gram", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("part", "row", "first", "more")).alias("at")
    )
    kinds = written(kinds.select("gram", "stretch", "n", "at.*"), "kinds")
    # At most one anchor for every TOGETHER rows is crowded.
    crowds = storage.sized(
        kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("_kinds")).where(F.col("_kinds") > TOGETHER)
        .select("gram", F.lit(True).alias("crowded"))
    )
    whole = met.where("not differ").select("part", "row", "first", "more").unionByName(
        met.where("differ").join(kinds.where("n > 1").select("gram", "stretch"), ["gram", "stretch"], "left_semi")
        .select("part", "row", "first", "more")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        for asked in _by_part(batches):
            asked = asked.sort_values("row", kind="stable")
            row_of, table = asked["row"].to_numpy(), pa.RecordBatch.from_pandas(asked, preserve_index=False)
            for batch in files.batches(int(asked["part"].iat[0])):
                numbers, raw = batch.column("row").to_numpy(), batch.column("raw").to_pylist()
                a, b = np.searchsorted(row_of, [numbers[0], numbers[-1] + 1])
                own = asked.iloc[a:b]
                stretches = [
                    raw[row][first:first + more + least]
                    for row, first, more in zip(own["row"] - numbers[0], own["first"], own["more"])
                ]
                yield table.slice(a, b - a).append_column("bytes", pa.array(stretches, pa.binary()))

    parts = max(1, texts.select("part").distinct().count())
    sides = kinds.join(crowds, "gram", "left").select(
        "part", "row", "first", "more", "gram", "n", F.coalesce("crowded", F.lit(False)).alias("crowded")
    )
    stretches = written(
        sides.repartitionByRange(parts, "part").sortWithinPartitions("part", "row")
        .mapInArrow(cut, "part int, row int, first int, more int, gram bigint, n bigint, crowded boolean, bytes binary"),
        "stretches",
    )
    blocks = max(1, -(-kinds.count() // BLOCK))

    def sort(block: pd.DataFrame) -> pd.DataFrame:
        out = []
        block = block.sort_values("gram", kind="stable")
        # Whole anchors at a time, some BLOCK stretches.
        gram = block["gram"].to_numpy()
        begins = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        cuts = begins[np.append(True, np.diff(begins // BLOCK) > 0)]
        for a, b in zip(cuts, [*cuts[1:], len(block)]):
            own = block.iloc[a:b]
            starts = repeated_starts(own["bytes"].tolist(), least)
            for part, row, first, n, places in zip(own["part"], own["row"], own["first"], own["n"], starts):
                if n == 1:  # of more, all is known to be repeated
                    out += [(part, row, first + i, j - i) for i, j in _runs_of(places)]
        return pd.DataFrame(out, columns=["part", "row", "first", "more"]).astype("int32")

    sorted_out = (
        stretches.where("not crowded")
        .groupBy(F.pmod("gram", F.lit(blocks)).alias("block"))
        .applyInPandas(sort, "part int, row int, first int, more int")
    )

    # The stretches of a crowded anchor are cut into pieces of GRAIN runs, counted from the anchor, so that equal runs
    # lie in like pieces. All runs of a piece hold its core, and equal runs lie in pieces of equal cores: the core is the
    # piece's anchor, as long as a run but for GRAIN - 1 bytes. Equal pieces are repeated throughout; a core that one
    # distinct piece has alone is done with; the others are sorted by their suffixes like stretches.
    def pieced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, row, first, more, data in zip(*(batch.column(c).to_pylist() for c in range(5))):
                shift = anchor_place(data, least) % GRAIN or GRAIN
                cuts = [0, *range(shift, more + 1, GRAIN), more + 1]
                for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    cell = shift + (k - 1) * GRAIN
                    core = hashlib.md5(data[cell + GRAIN - 1:cell + least]).digest()[:8]
                    out.append((part, row, first + i, j - i - 1, int.from_bytes(core, "little", signed=True), data[i:j - 1 + least]))
            yield _rows(out, [pa.int32()] * 4 + [pa.int64(), pa.binary()], ["part", "row", "first", "more", "core", "bytes"])

    def singled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, part, row, first, more, data in zip(*(batch.column(c).to_pylist() for c in range(6))):
                out += [(n, part, row, first + i, data[i:i + least]) for i in range(more + 1)]
            yield _rows(out, [pa.int64()] + [pa.int32()] * 3 + [pa.binary()], ["n", "part", "row", "first", "bytes"])

    pieces = stretches.where("crowded").select("part", "row", "first", "more", "bytes").mapInArrow(
        pieced, "part int, row int, first int, more int, core bigint, bytes binary"
    ).withColumn("digest", F.unhex(F.md5("bytes")))
    pieces = written(pieces, "pieces")
    distinct = written(pieces.groupBy("core", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("part", "row", "first", "more", "bytes")).alias("at")
    ).select("core", "digest", "n", "at.*"), "distinct-pieces")
    cores = written(distinct.groupBy("core").agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1"), "cores")
    differing = written(
        distinct.join(cores, "core").select("part", "row", "first", "more", F.col("core").alias("gram"), "n", "_kinds", "bytes"),
        "differing-pieces",
    )
    # As many runs as TOGETHER whole stretches have.
    together = F.col("_kinds") * GRAIN <= TOGETHER * (least - min(GRAM, least) + 1)
    piece_blocks = max(1, -(-differing.count() // BLOCK))
    sorted_pieces = (
        differing.where(together).drop("_kinds").groupBy(F.pmod("gram", F.lit(piece_blocks)).alias("block"))
        .applyInPandas(sort, "part int, row int, first int, more int")
    )
    # More distinct pieces of one core than a task should sort: each of their runs is counted.
    single = differing.where(~together).select("n", "part", "row", "first", "more", "bytes").mapInArrow(
        singled, "n bigint, part int, row int, first int, bytes binary"
    ).withColumn("run", F.unhex(F.md5("bytes"))).drop("bytes")
    counted = single.groupBy("run").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("run")
    crowded = (
        pieces.join(distinct.where("n > 1").select("core", "digest"), ["core", "digest"], "left_semi")
        .select("part", "row", "first", "more")
        .unionByName(sorted_pieces)
        .unionByName(
            single.where("n = 1").join(counted, "run", "left_semi").select("part", "row", "first", F.lit(0).alias("more"))
        )
    )
    spans = written(whole.unionByName(sorted_out).unionByName(crowded), "spans")
    every = texts.select("part").distinct().select(
        "part", F.lit(-1).alias("row"), F.lit(0).alias("first"), F.lit(0).alias("more")
    )

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        for known in _by_part(batches):
            known = known.sort_values(["row", "first"], kind="stable")
            row_of, begin = known["row"].to_numpy(), known["first"].to_numpy().astype(np.int64)
            end = begin + known["more"].to_numpy() + least
            for batch in files.batches(int(known["part"].iat[0])):
                numbers = batch.column("row").to_numpy()
                bounds = np.searchsorted(row_of, np.append(numbers, numbers[-1] + 1))
                out = []
                for i, data in enumerate(batch.column("raw").to_pylist()):
                    own = _merged(begin[bounds[i]:bounds[i + 1]], end[bounds[i]:bounds[i + 1]])
                    kept, at = [], 0
                    for a, b in own:
                        kept.append(data[at:a])
                        at = b
                    left = b"".join(kept) + data[at:] if own else data
                    out.append((len(data), len(data) - len(left), len(own), hashlib.sha256(left).hexdigest(), own, left))
                columns = [pa.array(c, t) for c, t in zip(list(zip(*out))[:len(types)], types)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if with_text:
        schema += ", spans array<struct<begin: bigint, end: bigint>>, kept binary"
        types += [pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary()]
        names += ["spans", "kept"]
    return (
        spans.unionByName(every).repartitionByRange(parts, "part").sortWithinPartitions("part", "row")
        .mapInArrow(judged, schema)
    )


def _merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans of the union of spans that are sorted by where they begin."""
    if not len(begin):
        return []
    reach = np.maximum.accumulate(end)
    opens = np.append(True, begin[1:] > reach[:-1])
    closes = np.append(np.flatnonzero(opens)[1:] - 1, len(begin) - 1)
    return list(zip(begin[opens].tolist(), reach[closes].tolist()))
