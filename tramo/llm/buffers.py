"""Texts of an Arrow column as one array of bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts together, and where each begins (and the last one ends); a null text is empty."""
    texts = pc.fill_null(texts if texts.type == pa.string() else texts.cast(pa.string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return flat, at.astype(np.int64) - at[0]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of inside begin and end; none goes over the beginning of a text."""
    n = len(inside)
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        cut = at[(at > 0) & (at < n)]
        before[cut], after[cut - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def owners(starts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each position lies in."""
    return np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))
