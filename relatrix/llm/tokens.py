"""Token ids of whole texts by the tokenizers library, with a per-worker memory of text pieces.

Byte-level BPE first splits a text by a fixed pattern and never joins ids over such a split. A single
space between two visible characters always starts a new split, so the text is cut there and every piece is
encoded once and then remembered; the ids equal those of one call on the whole text (see the tests). A piece's
leading letters are a split of their own and are shared by all pieces that begin with them.
Pieces with characters outside Latin scripts, and texts that hold a special token's string, go to the
library's ``encode`` whole. The memory is bounded.
"""

from __future__ import annotations

import os
import re
from array import array

import regex

#: Fixed value: the pattern by which this vocabulary's pre-tokenizer splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile("[\x20-\x7e\n\xa1-ɏ]+")
_JOINTS = re.compile(r"(?<=\S) (?=\S)")
_SPLIT = regex.compile(PATTERN)
#: Latin letters; the numbers among these characters are not letters of the pattern.
_LETTERS = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+")
#: Fixed value: how the byte-level alphabet spells a space.
SPACE_LETTER = "\u0120"
_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible bytes stand for themselves, the others for letters from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """Piece of text after a space -> its ids, space included, as little-endian unsigned 32-bit bytes.

    A piece that begins or ends with white space (none, if spaces meet) maps to None: such a text is cut with care.
    """

    LIMIT = 800_000  # pieces a worker remembers (some 150 bytes each); frequent ones come early, later ones are encoded each time
    LONGEST = 64  # longer pieces are not remembered

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.tails: dict[str, bytes] = {}  # ids of what follows a piece's leading letters
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if not (cut := _LETTERS.match(piece)):
            return self._keep(self, piece, self._split(" " + piece) if _PLAIN.fullmatch(piece) else self.whole(" " + piece))
        at = cut.end()
        if at == len(piece):
            return self._keep(self, piece, self._plain(SPACE_LETTER + (piece if piece.isascii() else self._spell(piece))))
        head, tail = piece[:at], piece[at:]
        if (after := self.tails.get(tail)) is None:
            if not _PLAIN.fullmatch(tail):  # marks beyond Latin may belong to the word
                return self._keep(self, piece, self.whole(" " + piece))
            after = self._keep(self.tails, tail, self._split(tail))
        if ids := self.get(head):  # only pieces of words seen before are worth a place of their own
            return self._keep(self, piece, ids + after)
        return self[head] + after

    def _keep(self, where: dict, key: str, ids: bytes) -> bytes:
        if len(where) < self.LIMIT and len(key) <= self.LONGEST:
            where[key] = ids
        return ids

    def _split(self, text: str) -> bytes:
        return b"".join([self._plain(w if w.isalpha() and w.isascii() else self._spell(w)) for w in _SPLIT.findall(text)])

    def _plain(self, spelled: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(spelled)]).tobytes()

    def _spell(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text, 4 bytes each; null is empty."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            rest = list(map(self.__getitem__, rest))
            if None not in rest:
                return b"".join([self.whole(first), *rest])
        first, *rest = _JOINTS.split(text)  # no piece begins or ends with white space now, or has none beside
        return b"".join([self.whole(first), *[self[x] or self.whole(" " + x) for x in rest]])


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
