"""Byte-level BPE ids of whole texts, by the ``tokenizers`` library.

The tokenizer's split never joins across a single space or line end between two other characters,
so a text is the sequence of its pieces between those, and each distinct piece has to be encoded
once only; a text with other white space, a zero character or a special token's string is encoded
whole. New pieces are encoded many at a time, as one text; the bytes that each token stands for tell
where a piece's ids end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import sys

import numpy as np

from .common import ship

END = 0
RUN = 1000  # new pieces in one text
ship(__name__)


class Numbers(dict):
    """Piece -> its number, given out in the order of first sight; ``new`` has those not yet encoded."""

    def __init__(self):
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


def tokenizer_of(path: str):
    """The tokenizer of a file and the number of bytes of each token, kept for a Python worker's
    later tasks at the library's module, as functions that are sent by value have none of their own."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_read_files", {})
    if path not in kept:
        read = tokenizers.Tokenizer.from_file(path)
        sizes = np.zeros(read.get_vocab_size(), np.int64)  # a byte-level token has a character a byte
        for token, i in read.get_vocab().items():
            sizes[i] = len(token)
        kept[path] = read, sizes
    return kept[path]


class Encoder:
    """Encodes texts; keeps the ids of distinct pieces in up to about ``most`` bytes, then starts
    afresh."""

    def __init__(self, path: str, most: int = 160 << 20):
        self.tokenizer, self.bytes = tokenizer_of(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.held = 0
        self.numbers = Numbers()  # number 0, the empty piece, has no ids: length -1
        self.lengths, self.starts = np.array([-1], np.int32), np.zeros(1, np.int32)
        self.ids = np.empty(0, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def learn(self) -> None:
        """Encode new pieces; one that begins or ends with white space (beyond its own line end)
        or is nothing but that has no ids of its own: length -1."""
        pieces, new = self.numbers.new, np.full(len(self.numbers.new), -1, np.int32)
        parts, at = [], []
        for i, p in enumerate(pieces):
            core = p[1:] if p[0] in "\n\0" else p
            if core and "\0" not in core and not core[0].isspace() and not core[-1].isspace():
                # a text's first piece is read behind a line end, which is an id of its own
                parts.append(p if p[0] == "\n" else "\n" + core if p[0] == "\0" else " " + p)
                at.append(i)
        runs = [parts[i:i + RUN] for i in range(0, len(parts), RUN)]
        flats, at = [], np.array(at, np.int64)
        for k, e in enumerate(self.tokenizer.encode_batch_fast(["".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, self.ids.dtype)
            ends = np.cumsum(np.fromiter((len(p.encode()) for p in runs[k]), np.int64, len(runs[k])))
            upto = np.searchsorted(np.cumsum(self.bytes[ids]), ends, "right")
            here = at[k * RUN:k * RUN + len(upto)]
            new[here] = np.diff(upto, prepend=0)
            first = [j for j, i in enumerate(here.tolist()) if pieces[i][0] == "\0"]
            if first:  # without the line end that was put before it
                starts = np.concatenate(([0], upto[:-1]))[first]
                ids = np.delete(ids, starts)
                new[here[first]] -= 1
            flats.append(ids)
        self.held += sum(map(sys.getsizeof, pieces)) + 120 * len(pieces)  # with its number, places and ids
        pieces.clear()
        flat = np.concatenate([*flats, self.ids[:0]])
        ends = len(self.ids) + np.cumsum(np.maximum(new, 0))
        self.lengths = np.concatenate((self.lengths, new))
        self.starts = np.concatenate((self.starts, (ends - np.maximum(new, 0)).astype(np.int32)))
        self.ids = np.concatenate((self.ids, flat))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text with the end id behind them (null: the end id alone)."""
        places = []
        for t in texts:
            if not t or "\0" in t or any(s in t for s in self.special):
                places.append(None)
            else:
                pieces = ("\0" + t).replace("\n", " \n").split(" ")
                places.append(np.fromiter(map(self.numbers.__getitem__, pieces), np.int32, len(pieces)))
        if self.numbers.new:
            self.learn()
        out = []
        for t, at in zip(texts, places):
            n = None if at is None else self.lengths[at]
            if n is not None and n.min() >= 0:
                ends = np.cumsum(n)
                ids = np.zeros(int(ends[-1]) + 1, np.uint32)
                ids[:-1] = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends + n, n)]
            else:
                ids = np.append(self.whole(t) if t else np.empty(0, np.uint32), np.uint32(END))
            out.append(ids)
        if self.held > self.most:
            self.clear()
        return out


def encoder(path: str, most: int = 160 << 20) -> Encoder:
    """The worker's encoder of this file, kept for its later tasks: a task alone would learn the same
    pieces anew. What it holds is bounded in bytes, by what the last task asked for."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path, most)
    kept[path].most = most
    return kept[path]


def in_parts(texts: Iterable[str | None], chars: int = 1 << 21) -> Iterator[list[str | None]]:
    """The texts in parts of about so many characters, at least one text each."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit numbers."""
    import zlib

    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
