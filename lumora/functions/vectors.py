"""Vectors as bytes for a shuffle; nothing is lost."""

from __future__ import annotations

import numpy as np

#: Vectors whose numbers are whole multiples of 1 / STEP travel as short integers.
STEP = 1024


def planes(x: np.ndarray) -> list[bytes]:
    """The bytes of all numbers of a vector apart: four of each, or two where it is made of few multiples of 1 / STEP."""
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = x * np.float32(STEP)
        whole = ((np.abs(scaled) < 1 << 15) & (scaled == np.rint(scaled))).all(axis=1)
    apart = lambda rows, width: [r.tobytes() for r in np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), x.shape[1], width).transpose(0, 2, 1))]
    # the sign is the lowest bit, so that small numbers leave the second byte zero
    k = scaled[whole].astype(np.int16)
    short, full = iter(apart((k << 1) ^ (k >> 15), 2)), iter(apart(np.ascontiguousarray(x[~whole]), 4))
    return [next(short if w else full) for w in whole]


def numbers(raw: list[bytes], dims: int) -> np.ndarray:
    """What ``planes`` was given."""
    whole = np.array([len(r) == 2 * dims for r in raw], bool)
    apart = lambda width: np.ascontiguousarray(np.frombuffer(b"".join(r for r in raw if len(r) == width * dims), np.uint8).reshape(-1, width, dims).transpose(0, 2, 1))
    x = np.empty((len(raw), dims), np.float32)
    k = apart(2).view(np.uint16).reshape(-1, dims)
    x[whole] = ((k >> 1).astype(np.int16) ^ -(k & 1).astype(np.int16)) / np.float32(STEP)
    x[~whole] = apart(4).view(np.float32).reshape(-1, dims)
    return x
