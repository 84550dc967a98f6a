"""Token ids of the word-end BPE vocabulary, pre-token by pre-token.

The vocabulary file's pipeline is: NFC, white space to one blank, lower case; split into
contractions, letter runs, single digits and runs of other characters; map bytes to characters;
merge with a word-end mark.  Merges never cross a pre-token, so a text's ids are its
pre-tokens' ids in a row.  Prose repeats its words, so each worker remembers the ids of those
it has seen (bounded tables) and gives only new ones to the library's merge model.  Strings of
added tokens are cut out of a text first, as the library does.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.models import BPE

from quorumlab.llm.memo import Memo, loaded

#: Remembered words and pre-tokens per worker (about 100 MB at most).
MEMO_WORDS, MEMO_PIECES = 350_000, 150_000

# The split pattern of the vocabulary file, and the mark of a word's end.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Characters on whose class and case all Unicode versions agree.  Texts with any other go to
#: the library as they are.
UNUSUAL = re.compile(
    "[^\t-\r\x20-\x7e\xa0-\u024f\u0300-\u0377\u0384-\u038a\u038c-\u0527\u0620-\u06d3\u0904-\u0963"
    "\u2010-\u2027\u2030-\u205e\u20a0-\u20b9\u2100-\u214f\u2190-\u21ff\u3000-\u3029\u3041-\u3096\u30a0-\u30ff"
    "\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f320\U0001f600-\U0001f640]"
)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    table = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


class WordBpe:
    """Ids and counts for one vocabulary file; one instance per worker process."""

    def __init__(self, path: str, words: int = MEMO_WORDS):
        with open(path, encoding="utf-8") as file:
            self.text = file.read()
        self.words, self.pieces = words, words * MEMO_PIECES // MEMO_WORDS
        spec = json.loads(self.text)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.model = BPE(
            vocab=self.vocab, merges=[tuple(m) for m in spec["model"]["merges"]], end_of_word_suffix=WORD_END, cache_capacity=0
        )
        self._library: Tokenizer | None = None
        self.find = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")")
        self.characters = byte_characters()
        self.bytes_to_characters = {b: c for b, c in enumerate(self.characters)}
        self.piece_ids = Memo(self.merge, self.pieces)
        self.word_ids = Memo(self._word, self.words)
        self._counts: tuple[Memo, Memo] | None = None
        self._single: list[str] | None = None

    @property
    def library(self) -> Tokenizer:
        """The library's whole pipeline, for texts with unusual characters."""
        if self._library is None:
            self._library = Tokenizer.from_str(self.text)
            self._library.no_padding()
            self._library.no_truncation()
        return self._library

    @property
    def word_counts(self) -> Memo:
        """Tokens of a blank-free word.  Proven single tokens are there from the start."""
        if self._counts is None:
            single = self.single_tokens()
            pieces = Memo(lambda piece: len(self.merge(piece)) // 4, self.pieces, single)
            words = Memo(lambda word: sum(map(pieces.__getitem__, self.find(word))), self.words, single)
            self._counts = words, pieces
        return self._counts[0]

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.piece_ids.__getitem__, self.find(word)))

    def spelled(self, piece: str) -> str:
        """The pre-token in the vocabulary's byte characters."""
        return piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.bytes_to_characters)

    def merge(self, piece: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(self.spelled(piece))], "<u4").tobytes()

    def single_tokens(self) -> list[str]:
        """Pre-tokens that are proven to encode alone as one token.

        A vocabulary string qualifies if it ends a word, stands for valid UTF-8, survives
        normalisation and splitting unchanged as one pre-token, and the merges, run on its
        characters, end in that one token.
        """
        if self._single is None:
            backward = {c: b for b, c in enumerate(self.characters)}
            found = []
            for spelled, token in self.vocab.items():
                if not spelled.endswith(WORD_END) or spelled == WORD_END:
                    continue
                try:
                    piece = bytes(backward[c] for c in spelled.removesuffix(WORD_END)).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if normalised(piece) == piece and self.find(piece) == [piece]:
                    if [t.id for t in self.model.tokenize(self.spelled(piece))] == [token]:
                        found.append(piece)
            self._single = found
        return self._single

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if UNUSUAL.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = self.word_ids.__getitem__
        return b"".join(
            self.added[part].to_bytes(4, "little") if i % 2 else b"".join(map(ids, normalised(part).split()))
            for i, part in enumerate(self._parts(text))
        )

    def count(self, text: str | None) -> int:
        """The number of ids of a text: single tokens by look-up, merges for the rest."""
        if not text:
            return 0
        if UNUSUAL.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        counts = self.word_counts.__getitem__
        parts = self._parts(text)
        return len(parts) // 2 + sum(sum(map(counts, normalised(part).split())) for part in parts[::2])

    def _parts(self, text: str) -> list[str]:
        """The text cut at added tokens' strings, which stand at the odd places."""
        return self.cut.split(text) if "<|" in text else [text]


def normalised(text: str) -> str:
    """NFC and lower case, character by character (no final-sigma rule)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


@loaded(4)
def load(path: str, words: int = MEMO_WORDS) -> WordBpe:
    """``words`` bounds what is remembered: fewer take less memory and more time, for the same ids."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordBpe(path, words)
