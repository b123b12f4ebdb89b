"""Words of many texts as arrays: every distinct word once, and its number at each place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE, BREAK = ord(" "), ord(".")


class WordArrays:
    """Words of some texts, numbered in ``dictionary``.

    ``table`` maps every byte: to ``SPACE`` where it separates words, to ``ends_piece`` where it also ends a piece (None:
    pieces are texts). ``text`` and ``piece`` tell where each word stands (pieces end with texts), ``first`` the first word of a text.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray, ends_piece: int | None = BREAK):
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        raw = table[np.frombuffer(b"".join(texts), np.uint8)]
        gap = np.zeros(len(raw), bool) if ends_piece is None else raw == ends_piece
        inside = (raw != SPACE) & ~gap
        head = np.zeros(len(raw) + 1, bool)
        head[0], head[ends] = True, True
        edge = np.zeros(1, bool)
        start = np.flatnonzero(inside & (~np.concatenate((edge, inside))[:-1] | head[:-1]))
        stop = np.flatnonzero(inside & (~np.concatenate((inside, edge))[1:] | head[1:])) + 1
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(stop - start, out=offsets[1:])
        packed = [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]
        coded = pa.Array.from_buffers(pa.binary(), len(start), packed).dictionary_encode()
        self.ids, self.dictionary = coded.indices.to_numpy(), coded.dictionary
        self.text = np.searchsorted(ends, start, "right")
        self.piece = np.cumsum(gap)[start] + self.text
        self.first = np.searchsorted(self.text, np.arange(len(texts)))
        self.size = np.bincount(self.text, minlength=len(texts))


def chunks(batches, held_bytes: int):
    """Lists of rows of record batches, about ``held_bytes`` of text each; the text is the second column, as bytes."""
    rows, held = [], 0
    for batch in batches:
        others = [batch.column(k).to_pylist() if k != 1 else None for k in range(batch.num_columns)]
        for i, text in enumerate(batch.column(1)):
            data = text.as_buffer().to_pybytes()
            rows.append(tuple(data if o is None else o[i] for o in others))
            held += len(data)
            if held >= held_bytes:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows
