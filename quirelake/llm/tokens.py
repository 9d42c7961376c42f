"""Token ids of whole texts by a public word-level BPE, white-space piece by piece.

The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those
of its pieces in turn. A worker keeps a bounded memory of pieces between tasks; only new ones reach
the tokenizer. Ids travel as bytes: a text's are those of its pieces, joined.
"""

from __future__ import annotations

import json
import re
import sys
import types
from array import array

import regex
from tokenizers import Tokenizer

#: Pieces of a generation; a worker remembers two, and carries what it uses over to the younger one.
MEMORY = 400_000
#: Characters that Python takes for white space and the tokenizer doesn't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Pieces whose normal form and lower case need no tables: printable ASCII and Latin letters.
_PLAIN = re.compile("[\x21-\x7e¡-įı-ɏ]+").fullmatch
#: Signs that end many words and are tokens of their own after letters.
_ENDS = frozenset(",.;:!?)")


def worker_memory() -> dict:
    """What a Python worker keeps from task to task; functions bring their own module globals along with each task."""
    return sys.modules.setdefault("_quirelake_worker", types.ModuleType("_quirelake_worker")).__dict__


def kept_tokenizer(path: str) -> PieceTokenizer:
    """The worker's tokenizer of this file, with the pieces it has met so far."""
    kept = worker_memory().setdefault("tokenizers", {})
    if path not in kept:
        kept.clear()
        kept[path] = PieceTokenizer(path)
    return kept[path]


def _byte_letters() -> list[str]:
    """The letters that byte-level vocabularies write bytes as."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


def _split_rule(tokenizer: Tokenizer) -> str:
    """The expression whose matches are the words; ValueError for a tokenizer that isn't of this kind."""
    rules = json.loads(tokenizer.to_str())
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (rules["normalizer"] or {}).get("normalizers", [])]
    cuts = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]:
        if (cuts[0]["behavior"], cuts[0]["invert"], cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == ("Removed", True, False, False):
            return cuts[0]["pattern"]["Regex"]
    raise ValueError("this needs a tokenizer that lower-cases, splits words by one expression and drops white space")


class PieceTokenizer(dict):
    """Pieces to the bytes of their ids; ``encoded`` gives what ``Tokenizer.encode(text, add_special_tokens=False).ids`` gives."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.tokenizer, self.memory, self.older = Tokenizer.from_file(path), memory, {}
        self.split = regex.compile(_split_rule(self.tokenizer)).findall
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def packed(self, ids: list[int]) -> bytes:
        found = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def _learn(self, piece: str) -> bytes:
        if not _PLAIN(piece) or ("<" in piece and self._holds_added(piece)):
            return self.packed(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if piece.isalpha():
            parts = (piece.lower(),)
        elif piece[-1] in _ENDS and piece[:-1].isalpha():
            return self[piece[:-1]] + self[piece[-1]]
        else:
            parts = self.split(piece.lower())
        ids = []
        for part in parts:
            if not part.isascii():
                part = "".join([self.letters[b] for b in part.encode()])
            ids += [t.id for t in self.model.tokenize(part)]
        return self.packed(ids)

    def __missing__(self, piece: str) -> bytes:
        found = self.older.pop(piece, None)
        if found is None:
            found = self._learn(piece)
        if len(self) >= self.memory:
            self.older = dict(self)
            self.clear()
        self[piece] = found
        return found

    def _holds_added(self, text: str) -> bool:
        text = text.lower()
        return any(t in text for t in self.added)

    def pieces(self, text: str) -> list[str]:
        """White-space pieces; a text with an added token's string goes to the tokenizer whole."""
        if any(c in text for c in NOT_SPACE) or ("<" in text and self._holds_added(text)):
            return [text]
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.split()
        return text.lower().split()  # these letters are lower-cased one by one, whatever stands beside them

    def encoded(self, text: str | None) -> bytes:
        """The ids of a text, little-endian, ``width`` bytes each."""
        return b"".join(map(self.__getitem__, self.pieces(text or "")))
