"""Toxicity scores by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and the beginnings of its longer words, hashed to
buckets. Beside a weight, each bucket has a short vector, and the products of the vectors of every
two terms of a document add to its score: a term may count only beside another, which weights
alone cannot say. The pairwise sum takes time linear in the terms. Trained in numpy on a
bounded, seeded sample of labelled documents, over the buckets that tell something of it either alone or beside
another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.llm.common import narrowed
from sightline.llm.words import portions

# Labelled documents that training sees, about; buckets of the hash (a power of two), length of the vectors.
TRAIN_DOCS, BUCKET_BITS, FACTORS = 20_000, 18, 4
# Beginnings of words, in bytes, that are terms of their own.
PREFIXES = (4, 5, 6)
# A bucket is learnt if this many sampled documents have it, and if either its share of toxic ones differs from
# all documents' by this many standard errors, or that of the documents with both it and another bucket does.
MIN_DOCS, MIN_Z = 4, 4.0
# Chance that any pair at all is taken for telling where none is; buckets of either side that a task pairs, documents at once.
PAIR_CHANCE, PAIR_BLOCK, PAIR_DOCS = 0.01, 2048, 4096
EPOCHS, BATCH, RATE, DECAY = 30, 128, 0.02, 1e-4

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def terms(texts: list[str], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of every text: their numbers, text after text, and where each text's begin (with the end).

    Words are runs of letters of any script, cut from the bytes of all texts at once; hashes of their
    parts are differences of one running polynomial sum, shifted back to place 0.
    """
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, int)
    letter = np.zeros(256, bool)
    letter[ord("a"):ord("z") + 1] = letter[128:] = True
    inside = letter[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_PRIME, len(data)), out=sums[1:])
    back = _powers(_INVERSE, len(data) + 1)
    of = np.searchsorted(ends, starts, "right").astype(np.uint64)
    keys = []
    for kind, length in enumerate((None, *PREFIXES)):
        longer = slice(None) if length is None else stops - starts > length
        first = starts[longer]
        last = stops[longer] if length is None else first + length
        h = (sums[last] - sums[first]) * back[first] + np.uint64(kind + 1)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        keys.append(of[longer] << np.uint64(bits) | h >> np.uint64(64 - bits))
    found = np.unique(np.concatenate(keys))
    begins = np.searchsorted(found, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(bits))
    return (found & np.uint64((1 << bits) - 1)).astype(np.int32), begins


class FactorizationMachine:
    """Log odds = bias + sum(w) + sum over pairs of <v_i, v_j>, over the learnt buckets that a document has."""

    def __init__(self, buckets: np.ndarray, bits: int = BUCKET_BITS, factors: int = FACTORS, seed: int = 7):
        self.place = np.full(1 << bits, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets))
        self.bits, self.bias = bits, 0.0
        self.w = np.zeros(len(buckets))
        self.v = np.random.default_rng(seed).normal(0, 0.02, (len(buckets), factors))

    def known(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Learnt terms only: their places, and the document of each."""
        places = self.place[ids]
        of = np.repeat(np.arange(len(begins) - 1, dtype=np.int32), np.diff(begins))
        learnt = places >= 0
        return places[learnt], of[learnt]

    def log_odds(self, places: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of ``n`` documents, and their summed vectors."""
        v = self.v[places]
        sums = np.stack([np.bincount(of, v[:, k], n) for k in range(v.shape[1])], axis=1)
        squares = np.bincount(of, (v * v).sum(axis=1), n)
        return self.bias + np.bincount(of, self.w[places], n) + ((sums * sums).sum(axis=1) - squares) / 2, sums

    def scores(self, texts: list[str]) -> np.ndarray:
        odds, _ = self.log_odds(*self.known(*terms(texts, self.bits)), len(texts))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def train(self, places: np.ndarray, of: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        """Adam on cross-entropy with weight decay; ``places`` and ``of`` (ascending) as from ``known``."""
        rng, n, m = np.random.default_rng(seed), len(y), len(self.w)
        bounds = np.searchsorted(of, np.arange(n + 1))
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        moments = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.v), np.zeros_like(self.v)]
        step, total = 0, epochs * -(-n // BATCH)
        for _ in range(epochs):
            shuffled = rng.permutation(n)
            for at in range(0, n, BATCH):
                own = shuffled[at:at + BATCH]
                sizes = bounds[own + 1] - bounds[own]
                p = places[np.repeat(bounds[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
                doc = np.repeat(np.arange(len(own)), sizes)
                odds, sums = self.log_odds(p, doc, len(own))
                error = (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - y[own]) / len(own)
                e, step = error[doc], step + 1
                gw = np.bincount(p, e, m) + DECAY * self.w
                gv = np.stack(
                    [np.bincount(p, e * (sums[doc, k] - self.v[p, k]), m) for k in range(self.v.shape[1])], axis=1
                ) + DECAY * self.v
                rate = RATE * (1 - 0.9 * step / total)
                self.bias -= rate * float(error.sum())
                for x, g, a, b in ((self.w, gw, *moments[:2]), (self.v, gv, *moments[2:])):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)


def _surprise(t: np.ndarray, n: np.ndarray, p) -> np.ndarray:
    """Minus the logarithm of a bound (Chernoff's) on the chance of ``t`` or more of ``n`` at probability ``p``; 0 if ``t`` is not more."""
    q = t / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = t * np.log(q / p) + np.where(t < n, (n - t) * np.log((1 - q) / (1 - p)), 0.0)
    return np.where(q > p, gain, 0.0)


def _most(n_own: int, n_all: int, share: float, least: float) -> np.ndarray:
    """For t = 0..n_own: the largest n up to ``n_all`` at which t of n is still a surprise of ``least``; -1 if none is."""
    t = np.arange(n_own + 1)
    low, high = t - 1, np.full(n_own + 1, n_all)
    while (low < high).any():
        middle = (low + high + 1) // 2
        enough = (middle > 0) & (_surprise(t, np.maximum(middle, 1), share) >= least)
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    return np.where(low < t, -1, low)


def _telling_pairs(spark: SparkSession, flat: np.ndarray, begins: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of every pair whose documents with both are toxic, or not, more often than all, than those with only the
    first and than those with only the second, beyond what the number of pairs makes likely by chance.

    Every two buckets that enough documents have are counted, in blocks that Spark's tasks share. Counting
    stops early for a pair once the other class has too many of it for any surprise.
    """
    n_all, have = len(y), np.bincount(flat, minlength=1 << bits)
    least = float(np.log(max(1, int((have >= MIN_DOCS).sum())) ** 2 / PAIR_CHANCE))
    found = [np.zeros(0, np.int64)]
    for own in (y > 0, y <= 0):
        share = own.mean() if n_all else 0.0
        if not 0 < share < 1:
            continue
        n_own = int(own.sum())
        row = np.empty(n_all, np.int32)  # documents of this class come first, the others in a seeded order
        row[np.concatenate([np.flatnonzero(own), np.random.default_rng(7).permutation(np.flatnonzero(~own))])] = np.arange(n_all)
        inside = np.bincount(flat[np.repeat(own, np.diff(begins))], minlength=1 << bits)
        most = _most(n_own, n_all, share, least)
        enough = int(np.argmax(most >= 0)) if (most >= 0).any() else n_own + 1
        buckets = np.flatnonzero((have >= MIN_DOCS) & (inside >= enough))
        if len(buckets) < 2:
            continue
        place = np.full(1 << bits, -1, np.int32)
        place[buckets] = np.arange(len(buckets))
        cuts = np.concatenate([[0], np.cumsum(have[buckets])])
        docs, filled = np.empty(cuts[-1], np.min_scalar_type(n_all)), cuts[:-1].copy()  # bucket after bucket
        for k in range(0, n_all, PAIR_DOCS):
            several = begins[k:k + PAIR_DOCS + 1]
            of = np.repeat(row[k:k + PAIR_DOCS], np.diff(several))
            at = place[flat[several[0]:several[-1]]]
            at, of = at[at >= 0], of[at >= 0]
            order = np.argsort(at, kind="stable")
            counts = np.bincount(at, minlength=len(buckets))
            docs[np.arange(len(at)) + np.repeat(filled - np.cumsum(counts) + counts, counts)] = of[order]
            filled += counts
        n_have, n_inside, n_blocks = have[buckets], inside[buckets], -(-len(buckets) // PAIR_BLOCK)

        def block(k: int) -> np.ndarray:
            first, last = k * PAIR_BLOCK, min((k + 1) * PAIR_BLOCK, len(n_have))
            out = np.zeros((n_all, last - first), np.uint8)
            out[docs[cuts[first]:cuts[last]], np.repeat(np.arange(last - first), n_have[first:last])] = 1
            return out

        def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.zeros((a.shape[1], b.shape[1]), np.float32)
            for k in range(0, len(a), PAIR_DOCS):
                out += a[k:k + PAIR_DOCS].astype(np.float32).T @ b[k:k + PAIR_DOCS].astype(np.float32)
            return out.astype(np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    i = int((np.sqrt(8 * k + 1) - 1) // 2)
                    j = k - i * (i + 1) // 2
                    a, b = block(i), block(j)
                    inner = both(a[:n_own], b[:n_own])
                    some = both(a[n_own:2 * n_own], b[n_own:2 * n_own])
                    left = (inner >= enough) & (inner + some <= most[inner])
                    if i == j:
                        left = np.tril(left, -1)
                    rest = [np.ascontiguousarray(np.packbits(x[n_own:], axis=0).T) for x in (a, b)]
                    xs, zs = np.nonzero(left)
                    good = np.zeros(len(xs), bool)
                    for f in range(0, len(xs), 8192):
                        x, z = xs[f:f + 8192], zs[f:f + 8192]
                        t = inner[x, z]
                        n = t + np.bitwise_count(rest[0][x] & rest[1][z]).sum(axis=1, dtype=np.int64)
                        x, z = x + i * PAIR_BLOCK, z + j * PAIR_BLOCK
                        alone = [(n_inside[o] - t + share) / (n_have[o] - n + 1) for o in (x, z)]
                        p = np.maximum(np.maximum(alone[0], alone[1]), share)
                        good[f:f + 8192] = _surprise(t, n, np.minimum(p, 1 - 1e-9)) >= least
                    telling = np.unique(np.concatenate([xs[good] + i * PAIR_BLOCK, zs[good] + j * PAIR_BLOCK]))
                    yield pa.RecordBatch.from_arrays([pa.array(telling.astype(np.int64))], names=["place"])

        n_tasks = n_blocks * (n_blocks + 1) // 2
        places = spark.range(0, n_tasks, 1, n_tasks).mapInArrow(run, "place bigint").distinct().collect()
        found.append(buckets[[r["place"] for r in places]] if places else found[0])
    return np.unique(np.concatenate(found))


def teach(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train_docs: int = TRAIN_DOCS, bits: int = BUCKET_BITS, factors: int = FACTORS, seed: int = 7,
) -> FactorizationMachine:
    """Train on about ``train_docs`` documents that ``labels`` marks 0 or 1, picked by a hash of the identifier.

    A document labelled more than once counts as toxic if any label is. Rows without a label or text are left
    out. Without labelled rows every score is 0. Runs two jobs, and up to two that count pairs of buckets; the sample's
    identifiers are broadcast and its terms collected, both bounded by ``train_docs``.
    """
    marked = narrowed(labels, doc_id=id_col, label=label_col).where("label is not null and doc_id is not null")
    n = marked.count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = marked.where(draw < min(1.0, train_docs / max(1, n))).groupBy("doc_id").agg(F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in portions(texts):
                ids, begins = terms(texts[a:b], bits)
                packed = [ids[i:j].tobytes() for i, j in zip(begins[:-1], begins[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(packed, pa.binary())],
                    names=["doc_id", "label", "terms"],
                )

    rows = (
        narrowed(docs, doc_id=id_col, text=text_col).where("text is not null")
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", F.col("label").cast("int").alias("label"), "text")
        .mapInArrow(run, "doc_id bigint, label int, terms binary")
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["terms"])))
    ids = [np.frombuffer(r["terms"], np.int32) for r in rows]
    y = np.array([r["label"] for r in rows], float)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    begins = np.cumsum([0, *[len(i) for i in ids]])
    del rows, ids  # the sample's terms are held once
    have = np.bincount(flat, minlength=1 << bits)
    toxic = np.bincount(flat[np.repeat(y > 0, np.diff(begins))], minlength=1 << bits)
    share = y.mean() if len(y) else 0.0
    spread = np.sqrt(np.maximum(have * share * (1 - share), 1e-9))
    alone = np.flatnonzero((have >= MIN_DOCS) & (np.abs(toxic - have * share) / spread >= MIN_Z))
    model = FactorizationMachine(np.union1d(alone, _telling_pairs(docs.sparkSession, flat, begins, y, bits)), bits, factors, seed)
    if len(y):
        model.train(*model.known(flat, begins), y, seed=seed)
    else:
        model.bias = -40.0
    return model


def scored(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every whole text: the probability of being toxic, and 1 from 0.5 on.

    A null text counts as empty and gets the score of a document without terms. One narrow pass; the model,
    some megabytes whatever the tables hold, travels with the tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts):
                scores = model.scores(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    rows = narrowed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, "doc_id bigint, score double, predicted int")
