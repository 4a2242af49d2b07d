"""Encoding with public tokenizer files, with a bounded memo of pre-tokens.

For vocabularies that pre-tokenise lower-cased words, digits and marks apart, a
text's ids are its pre-tokens' ids in order.  The library encodes each distinct
pre-token once; texts with characters for which Python and the library could
differ (outside ASCII print, Latin letters and common quotes) or with special
strings go to the library whole.  Other files always do, to be encoded; to be
counted, their texts are cut by the file's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

#: The normaliser and pre-tokeniser that the memo is right for.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Anything but tab, line ends, ASCII print, Latin-1 and Latin Extended-A letters and marks, dashes, quotes and the euro sign.
UNSAFE = re.compile("[^\t\n\r -~¡-¬®-±´-¸º»¿-įı-ſ‐-‧€]")
#: Pre-tokens of such texts, lower-cased: letters, contractions, digits one by one, marks.
_LETTERS = "a-zªµºß-öø-ſ"
PIECES = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \t\n\r0-9{_LETTERS}]+")
#: The printable stand-ins that byte-level models take for bytes, by a rule: print stays, the rest moves up from U+0100.
_PRINT = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_STAND_IN = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINT)))}


#: Characters of a long text whose pre-tokens are held at a time.
SEGMENT = 1 << 16


def segments(text: str) -> Iterator[str]:
    """A text in parts that end before a blank, which no pre-token spans."""
    at = 0
    while len(text) - at > SEGMENT and (end := text.find(" ", at + SEGMENT)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:]


class Encoder:
    """encode(text) gives a text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, memo: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library, self.by_piece, self.own_pieces = model.encode, False, False
        else:
            from tokenizers import Tokenizer

            self.tok = tok = Tokenizer.from_file(path)
            self.model = tok.model
            tok.no_padding()
            tok.no_truncation()
            self.library = lambda text: tok.encode(text, add_special_tokens=False).ids
            form = json.loads(tok.to_str())
            pre = form["pre_tokenizer"] or {}
            first = (pre.get("pretokenizers") or [{}])[0]
            self.by_piece = form["normalizer"] == NORMALIZER and first.get("pattern") == {"Regex": SPLIT} and first.get("invert") is True and not form["model"].get("dropout")
            plain = all(not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] and form["normalizer"]) for x in form["added_tokens"])
            self.own_pieces = bool(pre) and plain and not form["model"].get("dropout")
            self.specials = re.compile("|".join(re.escape(x["content"]) for x in form["added_tokens"]) or r"(?!)")
            #: The only checks that cost something run after this one.
            self.hint = "<|" if all("<|" in x["content"] for x in form["added_tokens"]) else ""
        self.memo = _Memo(self._piece if self.by_piece else self.library, memo)

    def plain(self, text: str) -> bool:
        """Whether the text's pre-tokens, found here, are the library's."""
        return self.by_piece and not UNSAFE.search(text) and not (self.hint in text and self.specials.search(text))

    def encode(self, text: str) -> bytes:
        if self.plain(text):
            return b"".join(b"".join(map(self.memo.__getitem__, PIECES.findall(part))) for part in segments(text.lower()))
        return np.asarray(self.library(text), "<u4").tobytes()

    def pieces(self, text: str) -> tuple[Iterable[str], int]:
        """(pre-tokens in order, number of tokens that belong to none): special strings, or all ids of files without pre-tokens.

        A pre-token is what the model takes: of most files a text in stand-ins for bytes.
        """
        if self.plain(text):
            return chain.from_iterable(map(PIECES.findall, segments(text.lower()))), 0
        if not (self.by_piece or self.own_pieces):
            return [], len(self.library(text))
        found, specials, at = [], 0, 0
        for m in self.specials.finditer(text):
            if m[0]:
                found += self._split(text[at : m.start()])
                specials, at = specials + 1, m.end()
        return found + self._split(text[at:]), specials

    def _split(self, text: str) -> list[str]:
        if self.tok.normalizer is not None:
            text = self.tok.normalizer.normalize_str(text)
        found = self.tok.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in found] if self.by_piece else [piece for piece, _ in found]

    def _piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, from the library's model itself."""
        stood = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_STAND_IN)
        return [t.id for t in self.model.tokenize(stood)]

    def count(self, piece: str) -> int:
        return len(self._piece(piece) if self.by_piece else self.model.tokenize(piece))


class _Memo(dict):
    """piece -> ids; emptied when full, so that memory stays bounded."""

    def __init__(self, library, most: int):
        self.library, self.most = library, most

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self.library(piece)
        self[piece] = ids = struct.pack(f"<{len(found)}I", *found)
        return ids


def forget() -> None:
    """Empties the memos of this worker's encoders."""
    for e in _encoders.values():
        e.memo.clear()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
