"""Runs of chosen bytes in a batch of texts, as Arrow strings over one buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def strings(buffer: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of the given sizes, one after the other in ``buffer``."""
    places = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=places[1:])
    return pa.Array.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(buffer))])


class RunStrings:
    """Maximal runs of bytes flagged ``inside``; no run goes beyond its text.

    ``strings`` holds them one after the other (the flagged bytes are their buffer), ``text`` the
    text of each, ``first`` the index of each text's first run (one more entry than texts) and
    ``starts``/``ends`` their byte positions.
    """

    def __init__(self, data: np.ndarray, inside: np.ndarray, offsets: np.ndarray) -> None:
        begins, finish = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        finish[:-1] &= ~inside[1:]
        bounds = offsets[:-1][np.diff(offsets) > 0]
        begins[bounds] = inside[bounds]
        finish[bounds[1:] - 1] = inside[bounds[1:] - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        places = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=places[1:])
        self.places = places
        self.buffer = data[inside]
        self.strings = strings(self.buffer, self.ends - self.starts)
