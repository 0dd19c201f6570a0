"""Arrays of numbers as short byte strings, for rows that carry many of them through a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A difference that does not fit in a byte is announced by this one.
WIDE = 255


def squeeze(raw: bytes) -> bytes:
    """``raw`` compressed, after its length."""
    return np.array([len(raw)], "<i8").tobytes() + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unsqueeze(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int(np.frombuffer(raw[:8], "<i8")[0]), codec="zstd", asbytes=True)


def small_in(x: np.ndarray) -> bytes:
    """Non-negative numbers, nearly all of them below 255: a byte each, the others in full behind them."""
    large = x[x >= WIDE].astype("<i8")
    return squeeze(np.array([len(x)], "<i8").tobytes() + np.minimum(x, WIDE).astype(np.uint8).tobytes() + large.tobytes())


def small_out(raw: bytes) -> np.ndarray:
    raw = unsqueeze(raw)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    x = np.frombuffer(raw[8 : 8 + n], np.uint8).astype(np.int64)
    x[x == WIDE] = np.frombuffer(raw[8 + n :], "<i8")
    return x


def sorted_in(x: np.ndarray) -> bytes:
    """Ascending non-negative numbers below 2**63, by their differences: a plane for each byte, as upper bytes mostly vanish."""
    gaps = np.diff(x.astype(np.int64), prepend=np.int64(0))
    width = max(1, -(-int(gaps.max(initial=0)).bit_length() // 8))
    planes = gaps.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    return squeeze(np.array([len(x), width], "<i8").tobytes() + np.ascontiguousarray(planes.T).tobytes())


def sorted_out(raw: bytes) -> np.ndarray:
    raw = unsqueeze(raw)
    n, width = np.frombuffer(raw[:16], "<i8").tolist()
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(raw[16:], np.uint8).reshape(width, n).T
    return np.cumsum(gaps.reshape(-1).view("<i8"), dtype=np.int64)
