"""Near duplicates by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one class. A class has a signature of TREES * DEPTH minimum
hashes; each tree sorts the classes by its own DEPTH of them, and classes that share a prefix are
neighbours. Depth follows the region: a prefix starts at MIN_DEPTH values and takes one more
wherever more than CROWD classes share it. Inside a region neighbours are compared by sketches; what may
be similar becomes a candidate link, and the candidates' components are then checked on full
shingle sets. Two documents of similarity s share a prefix of d values in one of t trees with probability
1 - (1 - s^d)^t: 0.99999 for 0.8, three values and sixteen trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import narrowed, written
from sightline.llm.components import components
from sightline.llm.shingles import shingle_sets
from sightline.llm.words import portions
from sightline.operators import storage

TREES, DEPTH, MIN_DEPTH = 16, 6, 3
# Classes that may share a region or a tile; best partners kept of each class in a region.
CROWD, PARTNERS = 1024, 8
# Rows of the forest that a task compares, about.
ROWS_PER_TASK = 8192
# Candidates may be this far under the threshold by their sketches: some 3.5 standard errors.
SLACK = 0.14

_SIGNED = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, sig array<int>"


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum, under each multiplicative hash, of a non-empty set's 64-bit shingles."""
    least = None
    for at in range(0, len(shingles), 1024):
        hashed = (shingles[at:at + 1024, None] * factors >> np.uint64(32)).astype(np.uint32).min(axis=0)
        least = hashed if least is None else np.minimum(least, hashed)
    return least


def _factors(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signed(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """Size, digest and signature of every document's shingle set; the signature is null for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(seed)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts):
                sets = shingle_sets(texts[a:b], words)
                digest = [(s.sum(dtype=np.uint64), (s * (s >> np.uint64(17))).sum(dtype=np.uint64)) for s in sets]
                sums = np.array(digest, np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sums[:, 0]), pa.array(sums[:, 1]),
                        pa.array([signature(s, factors).view(np.int32) if len(s) else None for s in sets], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "n_shingles", "s1", "s2", "sig"],
                )

    return docs.mapInArrow(run, _SIGNED)


def _regions(classes: DataFrame) -> DataFrame:
    """(tree, region, chunk, rep) of every class in a region with others.

    Prefixes are counted at each depth. A region that stays crowded at full depth is dealt out in blocks of half a
    crowd, and every two blocks are a chunk, so that any two of its classes meet.
    """
    prefix = [
        F.xxhash64(F.col("tree"), F.lit(d), F.slice("sig", F.col("tree") * DEPTH + 1, d)).alias(f"p{d}")
        for d in range(MIN_DEPTH, DEPTH + 1)
    ]
    entries = classes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "rep", "tree", *prefix
    )

    def shared(rows: DataFrame, d: int) -> DataFrame:
        # Written, so that the join reads two plain shuffles, whose hot prefixes adaptive execution splits.
        sizes = rows.groupBy(f"p{d}").agg(F.count(F.lit(1)).alias("size"))
        return rows.join(written(sizes.where("size > 1"), "prefixes"), f"p{d}")

    left, settled = written(shared(entries, MIN_DEPTH), "regions"), []
    for d in range(MIN_DEPTH, DEPTH):
        settled.append(left.where(F.col("size") <= CROWD).select("rep", "tree", F.col(f"p{d}").alias("region"), "size"))
        left = shared(left.where(F.col("size") > CROWD).drop("size"), d + 1)
    settled.append(left.select("rep", "tree", F.col(f"p{DEPTH}").alias("region"), "size"))
    rows = settled[0]
    for more in settled[1:]:
        rows = rows.unionByName(more)
    blocks = F.ceil(2 * F.col("size") / CROWD).cast("int")
    own = F.pmod(F.xxhash64("rep", "tree", "region"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda k: k != own)
    chunk = F.when(F.col("size") <= CROWD, F.array(F.lit(0))).otherwise(
        F.transform(others, lambda k: F.least(k, own) * blocks + F.greatest(k, own))
    )
    return rows.select("rep", "tree", "region", F.explode(chunk).alias("chunk"))


def _likely(sketch: np.ndarray, least: float) -> np.ndarray:
    """Pairs (i < j) of a region's rows that their sketches call similar: the best partners of each row, and
    as many more as connect whatever the sketches connect.
    """
    n = len(sketch)
    alike = np.empty((n, n), np.float32)
    for at in range(0, n, 64):
        alike[at:at + 64] = (sketch[at:at + 64, None] == sketch).mean(axis=2, dtype=np.float32)
    close = np.triu(alike >= least, 1)
    if n <= PARTNERS + 1 or not close.any():
        return np.argwhere(close)
    np.fill_diagonal(alike, 0)
    best = np.argsort(-alike, axis=1, kind="stable")[:, :PARTNERS]
    i, k = np.nonzero(np.take_along_axis(alike, best, axis=1) >= least)
    j = best[i, k]
    pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1), axis=0)
    label = np.arange(n)
    for i, j in pairs.tolist():
        if label[i] != label[j]:
            label[label == label[j]] = label[i]
    more = []
    for i, j in np.argwhere(close & (label[:, None] != label)).tolist():
        if label[i] != label[j]:
            label[label == label[j]] = label[i]
            more.append((i, j))
    return np.concatenate([pairs, np.array(more, int).reshape(-1, 2)])


def _candidates(least: float):
    """Candidate pairs (a, b) from rows (group, rep, sketch) sorted by group; a group never exceeds CROWD rows by much."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flushed(upto_last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            group, rep, sketch = (np.concatenate(x) for x in zip(*held))
            cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            ends = np.append(cuts[1:], len(group))
            last = len(cuts) if upto_last else len(cuts) - 1
            found = [cuts[k] + _likely(sketch[cuts[k]:ends[k]], least) for k in range(last)]
            held = [] if upto_last else [(group[cuts[-1]:], rep[cuts[-1]:], sketch[cuts[-1]:])]
            pairs = rep[np.concatenate(found).astype(int)] if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))] if len(pairs)
                else [pa.array([], pa.int64())] * 2, names=["a", "b"],
            )

        for batch in batches:
            if batch.num_rows:
                raw = b"".join(batch.column("sketch").to_pylist())
                sketch = np.frombuffer(raw, np.uint8).reshape(batch.num_rows, -1)
                held.append((batch.column("group").to_numpy(), batch.column("rep").to_numpy(), sketch))
                yield from flushed(False)
        if held:
            yield from flushed(True)

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, seed: int = 5,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of bytes other than space and tab to carriage return, A-Z lower-cased; a document's set has its distinct
    runs of ``words`` words, or its whole sequence if shorter. Documents link if the intersection of their sets has at
    least ``percent`` hundredths of the union; ``component_id`` is the smallest identifier reachable by links, and
    that document is kept. Null and empty texts have no shingles and no links. An identifier
    stands for one text: repeated rows come back as often. A row without an identifier cannot be linked; it comes back
    with the size of its set and a null ``component_id``, and is kept. Runs jobs when called.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = written(_signed(rows, words, seed), "signatures")
    key = ["n_shingles", "s1", "s2"]
    sets = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    own = F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")
    classed = written(signed.join(sets, key, "left").select("doc_id", "n_shingles", own), "classes")
    one_each = signed.where("sig is not null").join(
        classed.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi"
    ).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "sig")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column("sig").flatten().to_numpy().reshape(-1, TREES * DEPTH).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in sig], pa.binary())],
                                             names=["rep", "sketch"])

    regions = written(_regions(one_each), "forest")
    least = percent / 100 - SLACK
    # Comparing takes longer than reading: a task has a bounded number of rows, however few bytes they are.
    tasks = max(1, -(-regions.count() // ROWS_PER_TASK))
    close = (
        regions.join(one_each.mapInArrow(sketches, "rep bigint, sketch binary"), "rep")
        .select(F.xxhash64("tree", "region", "chunk").alias("group"), "rep", "sketch")
        .repartition(tasks, "group").sortWithinPartitions("group", "rep")
    )
    candidates = written(close.mapInArrow(_candidates(least), "a bigint, b bigint").distinct(), "candidates")
    links = _confirmed(rows, candidates, words, percent)
    labels = components(links).withColumnsRenamed({"id": "rep", "component_id": "_component"})
    component = F.coalesce("_component", "rep", "doc_id")
    return classed.join(labels, "rep", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _confirmed(rows: DataFrame, candidates: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes, checked on full shingle sets, that connect all that is linked.

    The classes of a component of candidates meet in one task with their sets, each sent once, and every two that are not yet
    connected are compared. A component of more than CROWD classes meets in tiles of about that size, and its candidates
    that lie in different tiles are checked pair by pair. What is then still in several parts meets again, every two tiles
    in a task, until any two classes of the component are connected or have been compared.
    """
    tiled = components(candidates).withColumnRenamed("id", "rep")
    sizes = tiled.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))
    tiles = F.ceil(F.col("size") / CROWD)
    tiled = written(
        tiled.join(sizes, "component_id").withColumn(
            "tile", F.pmod(F.xxhash64(F.lit("tile"), "rep"), tiles).cast("int")
        ).select("rep", "component_id", "tile", tiles.cast("int").alias("tiles")), "tiles",
    )

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts):
                packed = [s.tobytes() for s in shingle_sets(texts[a:b], words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())],
                                                 names=["rep", "shingles"])

    wanted = storage.sized(tiled.select(F.col("rep").alias("doc_id")))
    sets = rows.join(wanted, "doc_id", "left_semi").mapInArrow(shingled, "rep bigint, shingles binary")
    sets = written(sets.dropDuplicates(["rep"]), "shingles")

    def within(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep")
        reps, own = group["rep"].to_numpy(), [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        parent, links = list(range(len(reps))), []

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for j in range(len(reps)):
            for i in range(j):
                if root(i) != root(j) and _similar(own[i], own[j], percent):
                    parent[root(i)] = root(j)
                    links.append((reps[i], reps[j]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    inside = tiled.drop("tiles").join(sets, "rep").groupBy("component_id", "tile").applyInPandas(within, "a bigint, b bigint")
    tile_of = tiled.select("rep", "tile")
    apart = (
        candidates.join(tile_of.withColumnsRenamed({"rep": "a", "tile": "_ta"}), "a")
        .join(tile_of.withColumnsRenamed({"rep": "b", "tile": "_tb"}), "b").where("_ta <> _tb").select("a", "b")
        .join(sets.withColumnsRenamed({"rep": "a", "shingles": "sa"}), "a")
        .join(sets.withColumnsRenamed({"rep": "b", "shingles": "sb"}), "b")
    )

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            ok = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = written(inside.unionByName(apart.mapInArrow(checked, "a bigint, b bigint")), "near-links")
    large = tiled.where("tiles > 1")
    if large.isEmpty():
        return links
    parts = components(links).select(F.col("id").alias("rep"), F.col("component_id").alias("_part"))
    large = written(large.join(parts, "rep", "left").withColumn("part", F.coalesce("_part", "rep")).drop("_part"), "parts")
    split = large.groupBy("component_id").agg(F.count_distinct("part").alias("n")).where("n > 1").select("component_id")
    if split.isEmpty():
        return links

    def between(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep").reset_index(drop=True)
        parent = {x: x for x in group["part"]}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        reps, part = group["rep"].to_numpy(), group["part"].tolist()
        own = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        ahead, behind = np.flatnonzero(group["tile"] == group["low"]), np.flatnonzero(group["tile"] == group["high"])
        links = []
        for i in ahead.tolist():
            for j in behind.tolist():
                if root(part[i]) != root(part[j]) and _similar(own[i], own[j], percent):
                    parent[root(part[i])] = root(part[j])
                    links.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    other = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: k != F.col("tile"))
    more = (
        large.join(split, "component_id", "left_semi").withColumn("other", F.explode(other))
        .withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
        .join(sets, "rep").select("component_id", "low", "high", "tile", "rep", "part", "shingles")
        .groupBy("component_id", "low", "high").applyInPandas(between, "a bigint, b bigint")
    )
    return written(links.unionByName(more), "near-links")
