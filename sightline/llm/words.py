"""Encoding with a word-level BPE tokenizer, one distinct word at a time.

The tokenizer drops white space and encodes what lies between independently, so a text's ids are its
words' ids in order. Words repeat; their ids are remembered in a bounded memory. A new word of plain
letters, with or without punctuation after it, is two pieces that the library's BPE model encodes
directly; any other new word goes through the library's whole pipeline.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

# Python counts these separators as white space, the tokenizer does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
# Letters that lower-case and normalise one by one, then at most one run of signs that stays whole.
_PLAIN = re.compile("^(?:([a-zA-ZÀ-ÖØ-öø-ÿĀ-į]+)([.,;:!?*$%&#|()]*)$)?", re.MULTILINE)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes a byte as a letter: itself if it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_words(text: str) -> list[str]:
    """What white space, as the tokenizer has it, leaves of a text."""
    if _SEPARATORS.search(text):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes. ``most`` bounds the words remembered."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.known, self.pieces = most, {}, {}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.id_bytes = [i.to_bytes(4, "little") for i in range(largest + 1)]

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of a run of plain letters or signs."""
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(letters)])

    def learn(self, words: set[str]) -> None:
        """Make sure that every word is known. Forgets all others when too many are."""
        new = words.difference(self.known)  # looks up each word; a difference from keys() goes through all keys
        if len(self.known) + len(new) > self.most:
            self.known, self.pieces, new = {}, {}, words
        known, pieces, letters_of, odd = self.known, self.pieces, self.letters, []
        get, tokenize, id_bytes = pieces.get, self.model.tokenize, self.id_bytes
        new = list(new)
        # One search of a list of lines: no word has a line feed in it, and one that is not plain matches as an empty start.
        for word, (letters, signs) in zip(new, _PLAIN.findall("\n".join(new)) if new else ()):
            if not letters:
                odd.append(word)
                continue
            letters = letters.lower()
            ids = get(letters)
            if ids is None:
                spelt = letters if letters.isascii() else letters.encode().decode("latin-1").translate(letters_of)
                ids = pieces[letters] = b"".join([id_bytes[t.id] for t in tokenize(spelt)])
            if signs:
                if signs not in pieces:
                    pieces[signs] = self._piece(signs)
                ids += pieces[signs]
            known[word] = ids
        for word, ids in zip(odd, self.library_ids(odd)):
            known[word] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [split_words(t) for t in texts]
        self.learn(set().union(*split))
        known = self.known
        return [b"".join(map(known.__getitem__, words)) for words in split]


def portions(texts: list[str], most: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Ranges of neighbouring texts with some ``most`` characters each, one text at least."""
    begin, held = 0, 0
    for at, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield begin, at + 1
            begin, held = at + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
