"""Token ids of whole texts by the tokenizers library, with the pieces that recur encoded once.

The byte-level splitting rule never lets a token cross (a) the place before a single blank between two visible
characters or (b) either side of a single line feed between two visible characters. A text whose white space is only
of these two kinds is therefore encoded piece by piece, with a bounded memory of pieces; any other text is encoded as
it is. Both ways give the same ids; a test compares them.
"""

from __future__ import annotations

import os

import numpy as np
import regex

_RARE = ["  ", "\n\n", " \n", "\n ", "<|", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f"]
_STOPS = (".", ",", "!", "?")
_OTHER_BLANK = regex.compile(r"[^\S \n]")
#: Fixed value: the splitting pattern of the byte-level vocabulary file.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_LOADED: dict[str, Encoder] = {}


def _byte_letters() -> list[str]:
    """The printable character by which the vocabulary file writes each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def plain(text: str) -> bool:
    """Whether all white space is single blanks and line feeds between visible characters."""
    if not text or text[0].isspace() or text[-1].isspace() or any(x in text for x in _RARE):
        return False
    return text.isascii() or not _OTHER_BLANK.search(text)


class Pieces(dict):
    """Ids of pieces, learnt when first asked for.

    A piece follows a blank, unless it begins with a line feed; ``lead`` is the blank, or "" for the first of a line.
    Beyond ``most`` pieces those learnt before are set aside; what is asked for again then comes back from there, and
    the rest goes when these are set aside in turn.
    """

    def __init__(self, tokenizer, lead: str, most: int, heads: Pieces | None = None):
        super().__init__()
        self.tokenizer, self.tokens, self.lead, self.most = tokenizer, tokenizer.model.tokenize, lead, most
        self.heads, self.before = heads, {}
        self.letters = dict(enumerate(_byte_letters()))
        self.stops = {x: np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in _STOPS}
        self.feed = np.array(tokenizer.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        if (known := self.before.get(piece)) is not None:
            self[piece] = known
            return known
        if piece[:1] == "\n":
            value = self[piece] = self.feed + self.heads[piece[1:]]
            return value
        text = self.lead + piece
        if piece.isalpha() and piece.isascii():
            ids = [t.id for t in self.tokens(text.replace(" ", "Ġ"))]
        elif piece[-1:] in _STOPS and piece[:-1].isalpha():
            value = self[piece] = self[piece[:-1]] + self.stops[piece[-1]]
            return value
        elif piece.isalpha() and max(piece) < "ɐ":
            ids = [t.id for t in self.tokens(text.encode().decode("latin-1").translate(self.letters))]
        elif piece.isascii() or max(piece) < "ɐ":
            ids = [t.id for w in _WORDS.findall(text) for t in self.tokens(w.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        value = self[piece] = np.array(ids, "<u4").tobytes()
        return value


class Encoder:
    """Encodes lists of texts to little-endian uint32 ids."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.heads = Pieces(self.tokenizer, "", most // 8)
        self.rest = Pieces(self.tokenizer, " ", most, self.heads)
        probe = "Ab cd, e's\nfg é12 #\n§x"
        self.by_piece = self.tokenizer.get_vocab_size() > 256 and self._pieces(probe) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, text: str) -> bytes:
        head, *rest = text.replace("\n", " \n").split(" ")
        return self.heads[head] + b"".join(map(self.rest.__getitem__, rest))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the same as encoding each whole text."""
        return [self._pieces(t) if self.by_piece and plain(t) else self._whole(t) for t in texts]


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker; a bare file name means a public tokenizer."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path if "/" in path else vocabulary(path))
    return _LOADED[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
