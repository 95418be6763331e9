"""Encoding texts with the `tokenizers` library, with a memory of the pieces between spaces and line ends.

A byte-level BPE tokenizer splits a text into pre-tokens before it merges.  A space or line end that is followed
by something other than white space always begins a pre-token, and so does a full stop or comma between a letter or
digit and a cut, so a text can be cut there and its pieces encoded once each.  All pieces that a batch adds are
encoded together and told apart by the byte lengths of their tokens.

Strings of added tokens (such as `<|endoftext|>`) become those tokens, as the library does it by itself; texts that hold one are
encoded whole by the library.  With `added_as_text` their characters are encoded like any others.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces in each of the two generations that one process remembers, unless it is told otherwise; about 160 bytes each.
#: Fewer cost time and not results.
REMEMBERED = 500_000
#: Longer pieces are encoded each time they occur.
LONG_PIECE = 48
#: Pieces that are joined to one text; the library takes longer over long texts.
JOINED = 500

#: What may be taken for white space after a space or line end, by any definition.
_WHITE = "\\s\u180e"
_ODD_SPACE, _ODD_LINE = re.compile(f" (?:[{_WHITE}]|$)"), re.compile(f"\n(?:[{_WHITE}]|$)")
_CUT = re.compile(f"(?=[ \n][^{_WHITE}])")
#: Letters and digits whose kind doesn't depend on the version of Unicode end here.
_PLAIN_END = "\u0250"

_encoders: dict[tuple[str, bool], Encoder] = {}


def pieces_of(text: str) -> list[str]:
    """A text cut before each space or line end that something else than white space follows."""
    if _ODD_SPACE.search(text) or _ODD_LINE.search(text) or "\0" in text:
        return _CUT.split(text)
    return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")


class Encoder:
    """Whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, added_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (added_as_text and t.special)]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.byte_length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.byte_length[i] = len(token)
        self.ends = {c: np.array(self._ids([c])[0], "<u4").tobytes() for c in ".,"}
        self.remembered = REMEMBERED
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces that begin with a space or line end."""
        texts = ["".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)]
        ids = np.concatenate([np.array(e, "<u4") for e in self._ids(texts)])
        ends = np.cumsum(self.byte_length[ids])
        wanted = np.cumsum([len(p.encode()) for p in pieces])
        cuts = np.searchsorted(ends, wanted) + 1
        if not np.array_equal(ends[cuts - 1], wanted):
            raise ValueError("a token of this vocabulary crosses a cut")
        raw, at, out = ids.tobytes(), 0, []
        for cut in (cuts * 4).tolist():
            out.append(raw[at:cut])
            at = cut
        return out

    def _missing(self, pieces) -> list[str]:
        """Those of some distinct pieces that aren't remembered; those of the older generation are from now on."""
        known, older, out = self.known, self.older, []
        for p in [p for p in pieces if p not in known]:
            ids = older.get(p)
            if ids is None:
                out.append(p)
            else:
                known[p] = ids
        return out

    def _learn(self, pieces: list[str]) -> None:
        known, ends = self.known, self.ends
        stopped = {p for p in pieces if p[-1] in ends and len(p) > 2 and p[-2] < _PLAIN_END and p[-2].isalnum()}
        new = {p for p in pieces if p not in stopped} if stopped else set(pieces)
        new.update(self._missing({p[:-1] for p in stopped}))
        if new:
            known.update(zip(new, self._encode_pieces(list(new)), strict=True))
        for p in stopped:
            known[p] = known[p[:-1]] + ends[p[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self.added is not None and self.added.search(t)]
        if not whole:
            return self._encode(texts)
        held = set(whole)
        others = iter(self._encode([t for i, t in enumerate(texts) if i not in held]))
        of_library = iter(self._ids([texts[i] for i in whole]))
        return [np.array(next(of_library), "<u4").tobytes() if i in held else next(others) for i in range(len(texts))]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cut = [pieces_of(t) for t in texts]
        firsts = self._ids([pieces.pop(0) for pieces in cut])
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        missing = self._missing(set().union(*cut))
        self._learn(missing)
        get = self.known.__getitem__
        out = [np.array(f, "<u4").tobytes() + b"".join(map(get, pieces)) for f, pieces in zip(firsts, cut, strict=True)]
        for piece in missing:
            if len(piece) > LONG_PIECE:
                del self.known[piece]
        return out


def encoder(path: str, remembered: int = REMEMBERED, added_as_text: bool = False) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    key = path, added_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(path, added_as_text)
    _encoders[key].remembered = remembered
    return _encoders[key]


def batches(texts: list[str], size: int = 2_000_000):
    """Ranges of texts of about `size` characters together."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
