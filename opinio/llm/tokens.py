"""Token ids of whole texts, with the pieces of a text that cannot influence each other encoded once.

Natural text repeats its words. A text is cut at places where the tokenizer's own pre-tokenizer always cuts, each
distinct piece goes to the tokenizer once, and the ids are joined. A text with a piece for which that is not
certain goes to the tokenizer whole. Ids travel as bytes: little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import functools
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_PIECES = 800_000
SLICE_CHARS = 4_000_000  # texts whose pieces are told apart together; a longer text goes by itself, piece by piece
_MARKS = ".,;:!?"  # after a letter, such a mark starts a piece of its own in either kind of tokenizer
_PLAIN = re.compile(r"\n?\S+").fullmatch


def _packed(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class _Pieces(dict):
    """Bytes of the ids by piece. When full, the entries become the old generation and only what is used again
    returns, so memory stays bounded; a piece that is gone is encoded anew. None: the piece has white space that the
    fast path does not cut, so its text goes to the tokenizer whole."""

    def __init__(self, encode):
        super().__init__()
        self.old: dict[str, bytes | None] = {}
        self.encode = encode

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.old[piece] if piece in self.old else self.encode(piece)
        if len(self) >= CACHED_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids of ``tokenizers`` without special tokens, as bytes; ``None`` counts as empty.

    ``spaces`` says how the tokenizer treats a space between words: ``leading`` (byte-level BPE, the space belongs
    to the next word) or ``dropped`` (BPE with word ends). With ``special_as_text`` strings of special tokens in a
    text are ordinary text; without, they are what the library makes of them by default, one id each.
    """

    def __init__(self, path: str, spaces: str, special_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        # What an added token starts with. Such tokens may span pieces, so a text in which one may occur is encoded whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.hints = {c[:2] if c[:2].isascii() and not any(x.isalnum() or x.isspace() for x in c[:2]) else "" for c in added}
        self.width = self.tokenizer.get_vocab_size()
        self.leading = spaces == "leading"
        self.pieces = _Pieces(self._spaced if self.leading else self._dropped)
        self.marks = {m: self._whole(m) for m in _MARKS}

    def _ends_apart(self, piece: str) -> bool:
        """Whether the piece's last character is a mark that the pre-tokenizer cuts off. After a letter that is not
        ASCII it is asked: normalising may turn the letter into one with a combining mark."""
        if piece[-1:] not in self.marks or not piece[-2:-1].isalpha():
            return False
        if piece[-2].isascii():
            return True
        plain = self.tokenizer.normalizer.normalize_str(piece) if self.tokenizer.normalizer else piece
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)[-1][1] == (len(plain) - 1, len(plain))

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _dropped(self, piece: str) -> bytes:
        if self._ends_apart(piece):
            return self.pieces[piece[:-1]] + self.marks[piece[-1]]
        return self._whole(piece)

    def _spaced(self, piece: str) -> bytes | None:
        if not _PLAIN(piece):
            return None
        if self._ends_apart(piece):
            return self.pieces[piece[:-1]] + self.marks[piece[-1]]
        return self._whole(piece if piece[0] == "\n" else " " + piece)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(h in text for h in self.hints):
            return self._whole(text)
        look = self.pieces.__getitem__
        if not self.leading:
            return b"".join(map(look, text.replace("\n", " ").split(" ")))
        cut = text.replace("\n", " \n").split(" ")
        cut[0] = "\n" + cut[0]  # a text starts like a line; the line feed, one id of its own, is left out
        found = list(map(look, cut))
        return self._whole(text) if None in found else b"".join(found)[4:]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The same for many texts, in order: the pieces of a slice are told apart by Arrow, each distinct one is looked
        up once, and the ids are gathered by index."""
        waiting, chars = [], 0
        for text in texts:
            if not text or len(text) > SLICE_CHARS or any(h in text for h in self.hints):
                yield from self._slice(waiting)
                waiting, chars = [], 0
                yield self.encode(text)
                continue
            if chars + len(text) > SLICE_CHARS:
                yield from self._slice(waiting)
                waiting, chars = [], 0
            waiting.append(text)
            chars += len(text)
        yield from self._slice(waiting)

    def _slice(self, texts: list[str]) -> Iterator[bytes]:
        if not texts:
            return
        line = " \n" if self.leading else " "
        head = "\n" if self.leading else ""
        cut = pc.split_pattern(pa.array([head + t.replace("\n", line) for t in texts], pa.large_string()), " ")
        bounds = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        found = list(map(self.pieces.__getitem__, coded.dictionary.to_pylist()))
        odd = np.fromiter((f is None for f in found), dtype=np.int64, count=len(found))
        if odd.any():
            found = [f or b"" for f in found]
        at = coded.indices.to_numpy()
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        width = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        first = np.cumsum(width) - width
        n, start = width[at], first[at]
        whole = np.add.reduceat(odd[at], bounds[:-1]) > 0
        if self.leading:  # the line feed before each text
            opening = bounds[:-1][~whole]
            n[opening] -= 1
            start[opening] += 1
        ends = np.cumsum(n)
        ids = flat[np.repeat(start - (ends - n), n) + np.arange(ends[-1])].tobytes()
        borders = np.concatenate([[0], ends])[bounds] * 4
        for i, text in enumerate(texts):
            yield self._whole(text) if whole[i] else ids[borders[i] : borders[i + 1]]


@functools.cache
def encoder(path: str, spaces: str) -> Encoder:
    """One encoder per worker process and tokenizer file, with the library's default for special tokens."""
    return Encoder(path, spaces, special_as_text=False)
