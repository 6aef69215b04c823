"""Token ids of whole texts by a public tokenizer file.

The pre-tokenizer of the file never joins characters across white space, and its normalizer works on each
character or combining run alone.  So a text's ids are the ids of its words put together, and a word met
before is looked up instead of encoded again.
"""

from __future__ import annotations

import os

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Words and word stems kept per Python worker; a full table starts anew.  Results don't depend on it.
CACHE_WORDS = 400_000
#: End-of-document id of the contracts.
END_ID = 1

_ENCODERS: dict[str, WordEncoder] = {}
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"


def default_path() -> str:
    """The word-level BPE file of the installed collection of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: Latin-1's own, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Little-endian unsigned 32-bit ids of each word, by word."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.stems: dict[str, bytes] = {}
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode_word(self, word: str) -> bytes:
        """Any text without white space inside."""
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def stem(self, stem: str) -> bytes:
        """Lower-case letters below U+0180: normalizer and splitter leave them as they are, the model is enough."""
        found = self.stems.get(stem)
        if found is None:
            plain = stem if stem.isascii() else "".join(map(self.letters.__getitem__, stem.encode()))
            found = np.array([t.id for t in self.model.tokenize(plain)], "<u4").tobytes()
            if len(self.stems) >= CACHE_WORDS:
                self.stems.clear()
            self.stems[stem] = found
        return found

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(_PUNCTUATION)
        low = stem.lower()
        if low.isalpha() and (stem.isascii() or max(stem) < "ƀ"):
            ids = self.stem(low)
            if len(stem) < len(word):
                ids += self[word[len(stem):]]
        else:
            ids = self.encode_word(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


def encoder(path: str) -> WordEncoder:
    """One per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def document_ids(words: WordEncoder, text: str | None, end_id: int = END_ID) -> np.ndarray:
    """Ids of a whole text with the end-of-document id; a null text is empty."""
    return np.frombuffer(words.encode(text) + int(end_id).to_bytes(4, "little"), "<u4")
