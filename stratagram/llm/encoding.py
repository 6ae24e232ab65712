"""Token ids of whole texts through the public word-BPE vocabulary.

The vocabulary's rules never look across white space: normalisation (NFC,
white-space folding, lower case) and pre-tokenisation both act inside runs of
other characters.  So a text's ids are the ids of its white-space separated
pieces, one after another, and each distinct piece need be encoded only once
per worker.  The split uses blank, tab, line feed and carriage return alone;
whatever other white space a piece holds is left to the tokenizers library.
"""

from __future__ import annotations

import os
import re
from array import array

VOCABULARY = "word_bpe_49k.json"
#: Pieces a worker remembers; beyond it the memory starts anew.  Results don't depend on it.
REMEMBERED = 400_000
#: Longer pieces aren't remembered.
LONGEST_REMEMBERED = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts of these characters alone are cut here as the vocabulary's own rule cuts them: each
#: has a one-character lower case and composes with no other.  Other texts go piece by piece.
_SIMPLE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t\n\r a-z0-9ß-öø-ÿ]+").findall


class _Remembered(dict):
    """piece -> ids as bytes; ``learn`` says what an unknown piece's are."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self.learn(piece)
        if len(piece) <= LONGEST_REMEMBERED:
            self[piece] = ids
        return ids


class Encoder:
    """Whole text -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path = path or vocabulary_path()
        self.tokenizer = Tokenizer.from_file(self.path)
        model, encode = self.tokenizer.model, self.tokenizer.encode

        def library(piece: str) -> bytes:
            return array("I", encode(piece, add_special_tokens=False).ids).tobytes()

        def word(w: str) -> bytes:
            # A word of ASCII is its own spelling in the vocabulary's byte alphabet.
            return array("I", [t.id for t in model.tokenize(w)]).tobytes() if w.isascii() else library(w)

        self.words, self.pieces = _Remembered(word), _Remembered(library)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        for known in (self.words, self.pieces):
            if len(known) > REMEMBERED:
                known.clear()
        word, piece = self.words.__getitem__, self.pieces.__getitem__
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif _SIMPLE(text) and "<|" not in text:
                out.append(b"".join(map(word, _WORDS(text.lower()))))
            else:
                out.append(b"".join(map(piece, filter(None, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder; one is kept per vocabulary file while the worker lives."""
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
