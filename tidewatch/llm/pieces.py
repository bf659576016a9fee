"""Texts as distinct pieces: cut a slice of texts at spaces, work once for each different piece."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that may follow a cut: not white space, and no lead byte of a character that is white space.
_MAY_FOLLOW = np.ones(256, bool)
_MAY_FOLLOW[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Bytes that end no white space: neither that of ASCII nor the last byte of a longer one.
_SOLID = np.ones(256, bool)
_SOLID[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: Second bytes, after 0xC3, of letters (U+00C0 to U+00FF without the two arithmetic signs).
_SECOND = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])
_PUNCTUATION = np.array([b == 10 or 33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def offsets_of(parts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return out


def inside(data: bytes, words: list[bytes]) -> np.ndarray:
    """Places in ``data`` that lie within an occurrence of a word, after its first byte."""
    out = []
    for w in words:
        at = data.find(w)
        while at >= 0:
            out.append(np.arange(at + 1, at + len(w)))
            at = data.find(w, at + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def piece_starts(flat: np.ndarray, docs: np.ndarray, never: np.ndarray | None = None) -> np.ndarray:
    """Starts of the pieces of texts that lie one after another in ``flat`` (``docs``: their offsets).

    A piece begins with its text, at each space that a visible character follows, at ASCII punctuation
    or a line's end after a Latin letter, and at a visible character after a line's end that stands alone.
    Patterns of byte-level BPE begin a match at each of these, so the matches of a text are those of its
    pieces. They also set apart the last of several white spaces before a visible character, so longer
    white space that ends with a line stays with what follows. No piece of a text begins at places of ``never``.
    """
    begins = np.zeros(len(flat), bool)
    if len(flat):
        visible = _MAY_FOLLOW[flat]
        begins[:-1] = (flat[:-1] == 32) & visible[1:]
        letter = _LETTER[flat[:-1]]
        letter[1:] |= (flat[:-2] == 0xC3) & _SECOND[flat[1:-1]]
        begins[1:] |= letter & _PUNCTUATION[flat[1:]]
        begins[2:] |= (_SOLID[flat[:-2]] | letter[:-1]) & (flat[1:-1] == 10) & visible[2:]
        begins[docs[1:-1] - 1] &= flat[docs[1:-1] - 1] != 32  # what follows a text's last space is another text
        if never is not None:
            begins[never] = False
        begins[docs[:-1][np.diff(docs) > 0]] = True
    return np.flatnonzero(begins)


def binary_array(data: bytes, starts: np.ndarray) -> pa.Array:
    """Zero-copy pieces ``data[starts[i]:starts[i + 1]]``, the last to the end of data."""
    offs = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(data)])


def mapped(data: bytes, starts: np.ndarray, docs: np.ndarray, work: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
    """Replace every piece by what ``work`` makes of it, and join those of each document."""
    coded = binary_array(data, starts).dictionary_encode()
    made = pa.array(work(coded.dictionary.to_pylist()), pa.binary())
    out = made.take(coded.indices)
    first = np.searchsorted(starts, docs)  # the first piece of each document, and the end
    if not len(out):
        return [b""] * (len(docs) - 1)
    offs = np.frombuffer(out.buffers()[1], np.int32)[out.offset :][: len(out) + 1][first]
    whole = out.buffers()[2]
    whole = whole.to_pybytes() if whole is not None else b""
    return [whole[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a binary column that hold ``most`` bytes together, a row at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def gathered(batches: Iterable[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their binary column ``column`` holds ``most`` bytes: short rows come in small batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class Remembered:
    """Results of ``work`` for pieces seen lately: when ``most`` are new, those not asked for since go."""

    def __init__(self, work: Callable[[list[bytes]], list[bytes]], most: int):
        self.work, self.most = work, most
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __len__(self) -> int:
        return len(self.new) + len(self.old)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """``pieces`` are different from each other."""
        new, old = self.new, self.old
        out = [new.get(p) for p in pieces]
        missing = [i for i, x in enumerate(out) if x is None]
        fresh = []
        for i in missing:
            p = pieces[i]
            x = old.get(p)
            if x is None:
                fresh.append(i)
            else:
                out[i] = new[p] = x
        if fresh:
            asked = [pieces[i] for i in fresh]
            made = self.work(asked)
            new.update(zip(asked, made, strict=True))
            for i, x in zip(fresh, made, strict=True):
                out[i] = x
        if len(new) > self.most:
            self.new, self.old = {}, new
        return out
