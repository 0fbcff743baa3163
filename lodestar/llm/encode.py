"""Fast exact encoding with a word-splitting byte-pair tokenizer of the tokenizers library.

The vocabulary's pre-tokenizer drops white space and never joins characters across it, and its
normaliser lower-cases, so a text's ids are the ids of its words between ASCII white space, one after
the other. Words are encoded by the library once each while they stay in a bounded cache. Words of
lower-case Latin letters, digits and ASCII punctuation without apostrophes are left alone by the
normaliser, and their pre-tokens are runs of letters, single digits and runs of punctuation: those go
to the library's model directly. Every other word goes through the library's whole pipeline.
"""

from __future__ import annotations

import re
from array import array

#: Words that the cache holds before it starts anew.
CACHE_WORDS = 700_000
_PIECE = rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+"
_PIECES = re.compile(_PIECE)
_SIMPLE = re.compile(rb"(?:" + _PIECE + rb")+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class WordEncoder(dict):
    """Word -> its little-endian unsigned 32-bit ids; ``encode_batch`` does whole texts (UTF-8). No special tokens are added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = dict(enumerate(byte_letters()))

    def __missing__(self, word: bytes) -> bytes:
        if not _SIMPLE.fullmatch(word) or b"<|" in word:
            ids = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        elif len(pieces := _PIECES.findall(word)) > 1:
            ids = b"".join(map(self.__getitem__, pieces))
        else:
            text = word.decode("latin-1")
            ids = array("I", [t.id for t in self.tokenize(text if text.isascii() else text.translate(self.letters))]).tobytes()
        self[word] = ids
        return ids

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; an empty text has none."""
        out, get = [], self.__getitem__
        for t in texts:
            if len(self) > CACHE_WORDS:
                self.clear()
            out.append(b"".join(map(get, (t if b"<|" in t else t.lower()).split())))
        return out


_OPEN: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _OPEN:
        _OPEN[path] = WordEncoder(path)
    return _OPEN[path]
