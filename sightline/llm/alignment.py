"""Alignment of two tokenizers over the same texts, and corpus-wide counts of the ids that they put at one place.

Every text is encoded by both; a token is an interval of bytes. All intervals of a portion of texts are sorted by
start, the running maximum of their ends is kept, and a group ends where the next start reaches it: there
both tokenizers have a token border. Within a group, overlapping tokens are expanded to links.

A portion lists its distinct id pairs once, with the number of its documents that link them. Spark adds
the lists up, finds each id's best partners and sends every portion the totals of its own pairs, where
its documents look them up by place. So what is shuffled follows the distinct pairs of portions, not links.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sightline.llm.common import narrowed, written
from sightline.llm.words import _byte_letters, portions, vocabulary_path

# Characters of the texts that share a list of pairs, of those whose tokens and links are held at once, texts that are encoded
# at once, words whose ids a task remembers.
PORTION, STRETCH, TOGETHER, REMEMBERED = 4 << 20, 1 << 18, 128, 200_000
# A space between two characters that are not white space: a border of both tokenizers, where they allow it.
_BORDER = re.compile(r" (?<=\S )(?=\S)")
# An id pair is a * PAIR + b.
PAIR = 1 << 31

_ROWS = (
    "portion bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "links binary, pairs array<bigint>, documents array<bigint>"
)
_RESULT = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string"
)


def coalesced(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The group of each interval: groups break where a start reaches the largest end so far."""
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.append(False, starts[order][1:] >= reach[:-1])) if len(order) else 0
    return group


def overlapping(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of tokens whose bytes overlap, given the borders of two gapless token rows over the same bytes."""
    first = np.searchsorted(b[1:], a[:-1], "right")
    n = np.searchsorted(b[:-1], a[1:], "left") - first
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first, n)


class Aligner:
    """Both tokenizers with the bytes of their tokens.

    Words repeat, so their ids are remembered. A space between two words begins a token of A by the pattern of
    byte-level splitting, and of B if no piece of its model goes on with a space; where a tokenizer file promises neither,
    or a word does not come back byte for byte, whole texts are encoded.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(pieces)
        ]
        splitter = self.a.pre_tokenizer
        self.by_words = (
            self.a.normalizer is None and isinstance(splitter, pre_tokenizers.ByteLevel)
            and splitter.use_regex and not splitter.add_prefix_space
            and all(t.special for t in self.a.get_added_tokens_decoder().values())
            and not any("▁" in piece.lstrip("▁") for piece in pieces)
        )
        self.tokens = bytes_a, bytes_b
        self.length_a, self.length_b = (np.array([len(t) for t in tokens], np.int64) for tokens in self.tokens)
        # Ids as text, after the sign that parts them from what is before: another of the side, another group, the other side.
        self.said = [f"{sign}{i}" for sign in ",;" for i in range(len(bytes_a))]
        self.said += [f"{sign}{i}" for sign in ",|" for i in range(len(bytes_b))]
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def _library(self, texts: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """Ids of A and B as 32-bit numbers, or None where a tokenizer does not give back the text after a space."""
        spaced = [" " + t for t in texts]
        tokens_a, tokens_b = self.tokens
        for raw, a, b in zip(
            spaced, self.a.encode_batch_fast(spaced, add_special_tokens=False), self.b.encode(texts, num_threads=1)
        ):
            ids, raw = a.ids, raw.encode()
            same = b"".join([tokens_a[i] for i in ids]) == raw and b"".join([tokens_b[i] for i in b]) == raw
            yield (np.array(ids, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if same and len(raw) > 1 else None

    def _learned(self, words: set[str]) -> dict[str, tuple[bytes, bytes] | None]:
        """What is known of words, with these among them: encoded as one text and cut at their borders, if that comes back."""
        joined = [w for w in words if self.by_words and w and not (w[0].isspace() or w[-1].isspace())]
        whole = next(self._library([" ".join(joined)])) if joined else None
        if whole:
            ends = np.cumsum([len(w.encode()) + 1 for w in joined])
            sides = []
            for ids, length in zip(whole, (self.length_a, self.length_b)):
                places = 4 * (np.searchsorted(np.cumsum(length[np.frombuffer(ids, "<u4")]), ends) + 1)
                sides.append([ids[x:y] for x, y in zip([0, *places.tolist()], places.tolist())])
            self.known.update(zip(joined, zip(*sides)))
        rest = list(words.difference(joined) if whole else words)
        self.known.update(zip(rest, self._library(rest)))
        return self.known

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of A and B of each text as 32-bit numbers; none where a tokenizer does not give it back."""
        out: list[tuple[bytes, bytes] | None] = []
        for at in range(0, len(texts), TOGETHER):
            part = texts[at:at + TOGETHER]
            words = [_BORDER.split(t) if self.by_words else [t] for t in part]
            new = set().union(*words) - self.known.keys()
            if len(self.known) + len(new) > REMEMBERED or not self.by_words:
                self.known, new = {}, set().union(*words)
            known = self._learned(new)
            for text, split in zip(part, words):
                ids = [known[w] for w in split]
                if None in ids:
                    out.append(next(self._library([text])) if len(split) > 1 else None)
                else:
                    out.append((b"".join([a for a, _ in ids]), b"".join([b for _, b in ids])))
        return [ids or (b"", b"") for ids in out]

    def groups(self, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> list[str]:
        """Every token of A, then B, as said after its sign, in the order of groups and sides. ``group`` is that of A's, then B's."""
        side = np.append(np.zeros(len(a), np.int64), np.ones(len(b), np.int64))
        leads = np.append(np.diff(group[:len(a)], prepend=-1) > 0, np.diff(group[len(a):], prepend=-1) > 0)
        place = np.append(a, b) + np.where(side == 1, 2 * len(self.tokens[0]), 0)
        place += np.where(leads, np.where(side == 1, len(self.tokens[1]), len(self.tokens[0])), 0)
        said = self.said
        return [said[i] for i in place[np.lexsort((side, group))].tolist()]

    def align(self, texts: list[str], with_groups: bool = True) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, links, groups) of each text, then the distinct pairs of all and the
        number of texts that link each. ``links`` are places in the pairs and how often the text links them.

        Tokens and links are held for STRETCH characters at a time; of those before, only distinct links stay.
        """
        found = [self._stretch(texts[x:y], with_groups) for x, y in portions(texts, STRETCH)]
        pairs = np.unique(np.concatenate([own for _, own in found]))
        rows, documents = [], np.zeros(len(pairs), np.int64)
        for stretch, own in found:
            at = np.searchsorted(pairs, own)
            for *said, place, times in stretch:
                documents[at[place]] += 1
                rows.append((*said[:5], packed(at[place], times), *said[5:]))
        return rows, pairs, documents

    def _stretch(self, texts: list[str], with_groups: bool) -> tuple[list[tuple], np.ndarray]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, groups, places, times) of each text, then the pairs that places are in."""
        encoded = self.encode(texts)
        n_a, n_b = (np.array([len(ids[k]) // 4 for ids in encoded], np.int64) for k in (0, 1))
        a, b = (np.frombuffer(b"".join([ids[k] for ids in encoded]), "<u4").astype(np.int64) for k in (0, 1))
        # Texts lie one after the other; text borders are borders of both, so no group or link crosses them.
        border_a, border_b = np.append(0, np.cumsum(self.length_a[a])), np.append(0, np.cumsum(self.length_b[b]))
        group = coalesced(np.append(border_a[:-1], border_b[:-1]), np.append(border_a[1:], border_b[1:]))
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        upto = np.append(-1, group[:len(a)])[end_a]
        i, j = overlapping(border_a, border_b)
        of = np.searchsorted(end_a, i, "right")
        n_links = np.bincount(of, minlength=len(texts))
        said = self.groups(a, b, group)
        pairs, place = np.unique(a[i] * PAIR + b[j], return_inverse=True)
        linked, times = np.unique(of * len(pairs) + place, return_counts=True)
        of, place = np.divmod(linked, max(1, len(pairs)))
        cuts, at = np.searchsorted(of, np.arange(len(texts) + 1)), np.append(0, end_a + end_b)
        rows, before = [], -1
        for k in range(len(texts)):
            x, y = cuts[k], cuts[k + 1]
            groups = "".join(said[at[k]:at[k + 1]])[1:]
            rows.append((
                int(n_a[k]), int(n_b[k]), int(upto[k] - before), int(n_links[k]),
                hashlib.sha256(groups.encode()).hexdigest() if n_a[k] else "", groups if with_groups else None,
                place[x:y].astype(np.int32), times[x:y].astype(np.int32),
            ))
            before = upto[k]
        return rows, pairs


def packed(place: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending places and how often each, small: steps from place to place, byte by byte of their numbers."""
    numbers = np.append(np.diff(place, prepend=0), times).astype("<u4")
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(links: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(links), np.uint8).reshape(4, -1)
    numbers = np.ascontiguousarray(raw.T).view("<u4").ravel().astype(np.int64)
    half = len(numbers) // 2
    return np.cumsum(numbers[:half]), numbers[half:]


def _aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool) -> DataFrame:
    """A row per document with its links, and one per portion with the pairs that those point to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, portion = Aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for x, y in portions(texts, PORTION):
                rows, pairs, documents = aligner.align(texts[x:y], with_groups)
                numbers = [pa.array([r[k] for r in rows] + [None], pa.int64()) for k in range(4)]
                none = [None] * len(rows)
                columns = [
                    pa.array([portion] * (len(rows) + 1), pa.int64()),
                    pa.concat_arrays([batch.column(0).slice(x, y - x), pa.nulls(1, pa.int64())]), *numbers,
                    pa.array([*[r[4] for r in rows], None]), pa.array([*[r[5] for r in rows], None], pa.binary()),
                    pa.array([*none, pairs], pa.list_(pa.int64())), pa.array([*none, documents], pa.list_(pa.int64())),
                ]
                if with_groups:
                    columns.append(pa.array([*[r[6] for r in rows], None], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                portion += 1

    names = ["portion", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "documents"]
    names += ["groups"] * with_groups
    return docs.mapInArrow(run, _ROWS + (", groups string" if with_groups else ""))


def _answered(with_groups: bool):
    """Documents of a portion and the totals of its pairs, in any order, to result rows."""
    def run(rows: pa.Table, totals: pa.Table) -> pa.Table:
        place = totals.column("place").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place] = totals.column("count").to_numpy()
        best[place] = totals.column("best").to_numpy().astype(np.int64)
        n_best, count_sum = [], []
        for links in rows.column("links"):
            at, times = unpacked(links.as_py())
            n_best.append(int((best[at] * times).sum()))
            count_sum.append(int((count[at] * times).sum()))
        out = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        for name in ["groups_sha256"] + ["groups"] * with_groups:
            out = out.append_column(name, rows.column(name))
        return out

    return run


def pair_totals(pairs: DataFrame) -> DataFrame:
    """``pair, count, best`` of rows (pair, documents): documents over all, and whether no pair of the same A id has more.

    An A id has as many pairs as there are B ids at most, so the second step's groups are bounded by the vocabulary.
    """
    totals = pairs.groupBy("pair").agg(F.sum("documents").alias("count"))
    totals = written(totals.withColumn("a", F.expr(f"pair div {PAIR}")), "pair-totals")
    most = totals.groupBy("a").agg(F.max("count").alias("most"))
    return totals.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None,
    with_groups: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and
    with ``with_groups`` also ``groups``.

    Tokenizer A (a tokenizers file, byte-level BPE) encodes a space and the text, B (a sentencepiece model with byte
    fallback) the text, to which it adds the space itself; special tokens' strings are plain text. ``groups`` has the
    ids of each group of A and B as ``a1,a2|b1;a3|b2``. A link is a token of A and one of B whose bytes overlap; the count of
    an id pair is the number of rows of ``docs`` that link it; ``n_best`` are links whose count is the highest of
    their A id, ties included, ``count_sum`` adds the counts of all links.

    A text that is null, empty or not given back byte for byte by both (B may normalise) has no tokens: zeros and an
    empty string. A row is a document, whatever its identifier, so repeated rows count as often; a null identifier stays.
    Both files must exist on every executor. Runs a job when called, and writes links to the shared folder.
    """
    paths = path_a or vocabulary_path("byte_bpe_50k.json"), path_b or vocabulary_path("piece_bpe_32k.model")
    rows = narrowed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    rows = written(_aligned(rows, *paths, with_groups), "aligned")
    pairs = rows.where("pairs is not null").select(
        "portion", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "pair")
    ).select("portion", "place", F.col("pair.pairs").alias("pair"), F.col("pair.documents").alias("documents"))
    answers = pairs.join(pair_totals(pairs), "pair").select(F.col("portion").alias("of"), "place", "count", "best")
    given = rows.where("links is not null").drop("pairs", "documents")
    return given.groupBy("portion").cogroup(answers.groupBy("of")).applyInArrow(
        _answered(with_groups), _RESULT + (", groups string" if with_groups else "")
    )
