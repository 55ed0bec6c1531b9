"""BPE encoding by reuse of content-defined chunks, and decoding.

A rolling hash over the last bytes cuts every text where its low bits are zero, so a passage that several
documents share is cut alike in all of them. A task encodes each distinct chunk once and keeps its
ids. A cut may fall inside a word, so where two chunks join, a window that reaches two words into either is
encoded again by the tokenizers library; it is accepted when it ends on both sides with the very
ids that the chunks have there, and widened to the whole of both chunks otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import narrowed
from sightline.llm.words import WordEncoder, portions, split_words, vocabulary_path

# Bytes that the rolling hash sees; a chunk has 2**CUT_BITS bytes on average.
HASH_SPAN, CUT_BITS = 32, 10
# Words on either side of a join that are encoded again; the outer one must agree.
FLANK = 2


def _gear() -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_cuts(data: np.ndarray, table: np.ndarray, bits: int = CUT_BITS) -> np.ndarray:
    """Places (of the byte after) at which the rolling hash of the last 32 bytes ends in ``bits`` zeros."""
    h = table[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    # The high bits depend on the whole span.
    cuts = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1
    cuts = cuts[(cuts >= HASH_SPAN) & (cuts < len(data))]
    return cuts[(data[cuts] & 0xC0) != 0x80]  # never inside a character


class _Chunk:
    """An encoded chunk: text of its outer words, ids and decoded text of the rest."""

    __slots__ = ("text", "head", "tail", "first", "last", "ids", "decoded")


class ChunkEncoder:
    """Encodes whole texts chunk by chunk; ``most_chunks`` bounds the chunks remembered."""

    def __init__(self, path: str, most_chunks: int = 20_000):
        self.words, self.table, self.most, self.chunks = WordEncoder(path), _gear(), most_chunks, {}
        self.windows: dict[str, bytes] = {}
        vocabulary = self.words.tokenizer.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token.encode()

    def decode(self, ids: bytes) -> bytes:
        """As the library decodes without a decoder: the tokens, joined by spaces."""
        return b" ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def cut(self, texts: list[str]) -> list[list[str]]:
        encoded = [t.encode() for t in texts]
        lengths = np.array([len(b) for b in encoded])
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(encoded), np.uint8)
        cuts = chunk_cuts(data, self.table) if len(data) >= HASH_SPAN else np.empty(0, int)
        of = np.searchsorted(ends, cuts, "right")
        inside = cuts - (ends - lengths)[of] >= HASH_SPAN if len(cuts) else np.empty(0, bool)
        cuts, of = cuts[inside], of[inside]
        bounds = np.searchsorted(of, np.arange(len(texts) + 1))
        out = []
        for i, raw in enumerate(encoded):
            places = (cuts[bounds[i]:bounds[i + 1]] - (ends[i] - lengths[i])).tolist()
            out.append([raw[a:b].decode() for a, b in zip([0, *places], [*places, len(raw)])])
        return out

    def _encoded(self, text: str, words: list[str]) -> _Chunk:
        known, c = self.words.known, _Chunk()
        c.text = text
        if len(words) < 2 * FLANK + 1:
            c.ids = None
            return c
        # The second word ends before the third begins: both lie between white space in this chunk.
        before = text.find(words[1], text.find(words[0]) + len(words[0])) + len(words[1])
        after = text.rfind(words[-2], 0, text.rfind(words[-1]))
        c.head, c.tail = text[:before], text[after:]
        c.first, c.last = known[words[1]], known[words[-2]]
        c.ids = b"".join([known[w] for w in words[FLANK:-FLANK]])
        c.decoded = self.decode(c.ids)
        return c

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text) of each text."""
        cut = self.cut(texts)
        if len(self.chunks) > self.most:
            self.chunks, self.windows = {}, {}
        new = {c: split_words(c) for chunks in cut for c in chunks if c not in self.chunks}
        self.words.learn(set().union(*new.values()))
        for text, words in new.items():
            self.chunks[text] = self._encoded(text, words)
        # A plan for each text: finished chunks, and between them windows of text with the ids they must end in.
        plans, windows = [], set()
        for chunks in cut:
            plan, text, agreed, left = [], "", b"", None
            for c in map(self.chunks.__getitem__, chunks):
                if c.ids is None:
                    text += c.text
                    continue
                plan += [(text + c.head, agreed, c.first, left, c), c]
                text, agreed, left = c.tail, c.last, c
            plan.append((text, agreed, b"", left, None))
            windows.update(step[0] for step in plan if type(step) is tuple)
            plans.append(plan)
        fresh = [w for w in windows if w not in self.windows]
        for w, ids in zip(fresh, self.words.library_ids(fresh)):
            self.windows[w] = np.array(ids, "<u4").tobytes()
        return [self._joined(plan, text) for plan, text in zip(plans, texts)]

    def _joined(self, plan: list, text: str) -> tuple[bytes, bytes]:
        ids, decoded = [], []
        for step in plan:
            if type(step) is _Chunk:
                ids.append(step.ids)
                decoded.append(step.decoded)
                continue
            window, left, right = self.windows[step[0]], step[1], step[2]
            if not (window.startswith(left) and window.endswith(right) and len(window) >= len(left) + len(right)):
                whole = np.array(self.words.library_ids([text])[0], "<u4").tobytes()  # no agreement: the whole text
                return whole, self.decode(whole)
            ids.append(window)
            decoded.append(self.decode(window))
        return b"".join(ids), b" ".join([d for d in decoded if d])


def encoded(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, and with
    ``with_ids`` also ``ids array<int>`` and ``decoded``.

    Ids are those of the tokenizers library on the whole text without added special tokens, for any
    text; a null text counts as empty and has none. The vocabulary file must exist on every executor. One narrow pass:
    memory is bounded by one batch and the remembered words and chunks.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path)
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in portions(texts):
                pairs = encoder.encode(texts[a:b])
                columns = [
                    doc_ids.slice(a, b - a), pa.array([len(ids) // 4 for ids, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in pairs]),
                    pa.array([hashlib.sha256(text).hexdigest() for _, text in pairs]),
                ]
                if with_ids:
                    columns += [
                        pa.array([np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in pairs], pa.list_(pa.int32())),
                        pa.array([text.decode() for _, text in pairs], pa.string()),
                    ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    rows = narrowed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    more = ", ids array<int>, decoded string" if with_ids else ""
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + more)
