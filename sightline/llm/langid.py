"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes from both ends, labels every byte with a distribution over the
languages it was taught, and a document's probabilities are the mean over all its bytes. It is trained in
numpy by backpropagation through time on a bounded, seeded sample of labelled documents. Whole texts are
scored: long ones in stretches that are read with some context on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from sightline.llm.common import narrowed
from sightline.llm.words import portions

# Sampled documents per language, stretches taken from each, languages at most; the bounds of the training set.
PER_LANGUAGE, STRETCHES, MAX_LANGUAGES = 600, 2, 64
TRAIN_BYTES, HIDDEN, EPOCHS, BATCH, RATE = 128, 8, 8, 128, 0.02
# Steps of training at least: a small sample is seen more often, in smaller batches.
MIN_STEPS, MIN_BATCH = 250, 16
# Bytes labelled per stretch, and bytes of context on either side.
CORE, CONTEXT = 240, 16
PAD = 256
UNDETERMINED = "und"


def _direction(rng: np.random.Generator, hidden: int, classes: int) -> dict[str, np.ndarray]:
    scale = 1 / np.sqrt(hidden)
    p = {
        "E": rng.normal(0, 0.3, (3 * hidden, 257)), "U": rng.normal(0, scale, (2 * hidden, hidden)),
        "C": rng.normal(0, scale, (hidden, hidden)), "O": rng.normal(0, scale, (classes, hidden)),
    }
    p["E"][:hidden] -= 0.5  # gates start rather closed, so that states last
    p["E"][:, PAD] = 0
    p["E"][:hidden, PAD] = -30  # padding leaves the state as it is
    return {k: v.astype(np.float32) for k, v in p.items()}


class ByteGru:
    """Update gate z, reset gate r, candidate c: h' = h + z * (c - h), in either direction. Arrays are
    (features, batch); gate inputs are kept halved, as a sigmoid is 0.5 + 0.5 * tanh(half its input).
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.sides = [_direction(rng, hidden, len(labels)) for _ in range(2)]
        self.bias = np.zeros((len(labels), 1), np.float32)

    def _run(self, p: dict[str, np.ndarray], x: np.ndarray, order: range, keep: bool) -> tuple[np.ndarray, list]:
        """Logits of every step, (steps, classes, batch), and what backpropagation needs."""
        steps, batch, n = *x.shape, self.hidden
        h, gates, c = np.zeros((n, batch), np.float32), np.empty((2 * n, batch), np.float32), np.empty((n, batch), np.float32)
        inputs, reset = np.empty((3 * n, batch), np.float32), np.empty((n, batch), np.float32)
        logits, trace = np.empty((steps, len(self.labels), batch), np.float32), []
        for t in order:
            np.take(p["E"], x[t], axis=1, out=inputs, mode="clip")
            np.matmul(p["U"], h, out=gates)
            gates += inputs[:2 * n]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[n:], h, out=reset)
            np.matmul(p["C"], reset, out=c)
            c += inputs[2 * n:]
            np.tanh(c, out=c)
            if keep:
                trace.append((t, h.copy(), gates.copy(), c.copy(), reset.copy()))
            c -= h
            c *= gates[:n]
            h += c
            np.matmul(p["O"], h, out=logits[t])
            if keep:
                trace[-1] += (h.copy(),)
        return logits, trace

    def probabilities(self, x: np.ndarray, keep: bool = False):
        """Distribution at every byte of ``x`` (steps, batch): (steps, classes, batch)."""
        ahead, trace_a = self._run(self.sides[0], x, range(len(x)), keep)
        back, trace_b = self._run(self.sides[1], x, range(len(x) - 1, -1, -1), keep)
        ahead += back
        ahead += self.bias
        ahead -= ahead.max(axis=1, keepdims=True)
        np.exp(ahead, out=ahead)
        ahead /= ahead.sum(axis=1, keepdims=True)
        return (ahead, trace_a, trace_b) if keep else ahead

    def _gradients(self, p: dict[str, np.ndarray], x: np.ndarray, trace: list, error: np.ndarray) -> dict[str, np.ndarray]:
        n, g = self.hidden, {k: np.zeros_like(v) for k, v in p.items()}
        dh = np.zeros((n, x.shape[1]), np.float32)
        inputs = np.empty((len(trace), 3 * n, x.shape[1]), np.float32)
        for i in range(len(trace) - 1, -1, -1):
            t, h, gates, c, reset, after = trace[i]
            z, r = gates[:n], gates[n:]
            g["O"] += error[t] @ after.T
            dh += p["O"].T @ error[t]
            dc = dh * z * (1 - c * c)
            dreset = p["C"].T @ dc
            # Twice the sigmoid's slope, as its input is kept halved.
            dgates = 2 * gates * (1 - gates) * np.concatenate([dh * (c - h), dreset * h])
            g["C"] += dc @ reset.T
            g["U"] += dgates @ h.T
            dh = dh * (1 - z) + dreset * r + p["U"].T @ dgates
            inputs[i, :2 * n], inputs[i, 2 * n:] = dgates, dc
        bytes_read = x[[step[0] for step in trace]].ravel()
        for row in range(3 * n):
            g["E"][row] = np.bincount(bytes_read, inputs[:, row].ravel(), 257)
        g["E"][:, PAD] = 0
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = 7):
        """``x`` (steps, sequences) of bytes, ``y`` the label's number of each sequence; Adam on cross-entropy."""
        rng, n = np.random.default_rng(seed), x.shape[1]
        batch = min(batch, max(MIN_BATCH, n // MIN_BATCH))
        epochs = max(epochs, -(-MIN_STEPS // -(-n // batch)))
        params = [(self.sides[0], k) for k in "EUCO"] + [(self.sides[1], k) for k in "EUCO"] + [(vars(self), "bias")]
        first = [np.zeros_like(o[k]) for o, k in params]
        second = [np.zeros_like(o[k]) for o, k in params]
        step, total = 0, epochs * -(-n // batch)
        for _ in range(epochs):
            shuffled = rng.permutation(n)
            for at in range(0, n, batch):
                own = shuffled[at:at + batch]
                xs = x[:, own]
                error, ahead, back = self.probabilities(xs, keep=True)
                real = (xs != PAD)[:, None, :]
                error[:, y[own], np.arange(len(own))] -= 1
                error *= real / max(1, real.sum())
                grads = [self._gradients(p, xs, trace, error) for p, trace in zip(self.sides, (ahead, back))]
                flat = [g[k] for g in grads for k in "EUCO"] + [error.sum(axis=(0, 2))[:, None]]
                step += 1
                for i, ((owner, k), g) in enumerate(zip(params, flat)):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.01 * (g * g - second[i])
                    move = (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
                    owner[k] -= (rate * (1 - 0.9 * step / total) * move).astype(np.float32)

    def pooled(self, texts: list[bytes], most: int = 4096) -> np.ndarray:
        """Mean distribution over the bytes of each text, (texts, classes); rows of zeros for empty ones."""
        stretches = []  # text, first byte read, first byte labelled, end of labels, end
        for i, raw in enumerate(texts):
            n = len(raw)
            for a in range(0, n, CORE):
                b = min(a + CORE, n)
                stretches.append((i, max(0, a - CONTEXT), a, b, min(n, b + CONTEXT)))
        sums = np.zeros((len(texts), len(self.labels)))
        stretches.sort(key=lambda s: s[4] - s[1])
        for at in range(0, len(stretches), most):
            group = stretches[at:at + most]
            x = np.full((len(group), group[-1][4] - group[-1][1]), PAD, np.intp)
            weight = np.zeros(x.shape, np.float32)
            for row, (i, begin, a, b, end) in enumerate(group):
                x[row, :end - begin] = np.frombuffer(texts[i], np.uint8)[begin:end]
                weight[row, a - begin:b - begin] = 1
            found = np.einsum("tcb,bt->bc", self.probabilities(np.ascontiguousarray(x.T)), weight)
            np.add.at(sums, [s[0] for s in group], found)
        return sums / np.maximum(1, [len(t) for t in texts])[:, None]


def teach(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
    hidden: int = HIDDEN, epochs: int = EPOCHS, max_languages: int = MAX_LANGUAGES, seed: int = 7,
) -> ByteGru | None:
    """Train on the labelled rows of ``docs`` (text and language not null): some ``per_language`` documents of each of the
    ``max_languages`` most frequent languages, picked by a hash of the identifier, with STRETCHES stretches of
    TRAIN_BYTES bytes from each. None without a labelled row. Runs two jobs; what is collected is bounded.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col, lang=lang_col).where("lang is not null and length(text) > 0")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    raw, n = F.encode("text", "utf-8"), F.octet_length("text")
    room = F.greatest(n - TRAIN_BYTES, F.lit(0)) + 1
    picked = rows.where(draw < share[F.col("lang")]).select(
        "doc_id", "lang",
        *[
            F.substring(raw, F.pmod(F.xxhash64(F.lit(seed + k + 1), "doc_id"), room).cast("int") + 1, F.lit(TRAIN_BYTES))
            .alias(f"s{k}") for k in range(STRETCHES)
        ],
    )
    sample = sorted(picked.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["s0"]))
    labels = sorted({r["lang"] for r in sample} or {r["lang"] for r in counts})
    model = ByteGru(labels, hidden, seed)
    if not sample:
        return model
    x = np.full((TRAIN_BYTES, STRETCHES * len(sample)), PAD, np.intp)
    for i, r in enumerate(sample):
        for k in range(STRETCHES):
            piece = np.frombuffer(bytes(r[f"s{k}"]), np.uint8)
            x[:len(piece), STRETCHES * i + k] = piece
    y = np.repeat([labels.index(r["lang"]) for r in sample], STRETCHES)
    model.train(x, y, epochs, seed=seed)
    return model


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode's categories of letters; superscripts, fractions and letter numbers are not."""
    return any(map(str.isalpha, text))


def identified(
    docs: DataFrame, model: ByteGru | None, id_col: str = "doc_id", text_col: str = "text", carried: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text: the language with the largest mean probability over its bytes.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if ``model`` is None.
    Ties go to the language that sorts first. The columns named in ``carried`` follow, so that no join has to bring them back.
    One narrow pass; memory is bounded by one portion of texts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions([t or "" for t in texts]):
                own = [t if model and t and has_letter(t) else "" for t in texts[a:b]]
                pooled = model.pooled([t.encode() for t in own]) if model else np.zeros((b - a, 1))
                best = pooled.argmax(axis=1)
                names = [model.labels[k] if t else UNDETERMINED for t, k in zip(own, best)]
                scores = np.clip(pooled[np.arange(b - a), best], 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(names), pa.array(scores, pa.float64()),
                     *[c.slice(a, b - a) for c in batch.columns[2:]]],
                    names=["doc_id", "lang_pred", "score", *carried],
                )

    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`") for c in carried]
    )
    found = StructType().add("doc_id", "long").add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, StructType(found.fields + rows.schema.fields[2:]))
