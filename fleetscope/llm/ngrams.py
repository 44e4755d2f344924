"""Hashed byte n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

from fleetscope.llm.common import flat

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LETTERS = np.where((np.arange(256) >= 128) | ((np.arange(256) >= 65) & (np.arange(256) <= 90)) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), _LOWER, 32).astype(np.uint8)
WORD_BYTES = np.where((np.arange(256) >= 48) & (np.arange(256) <= 57), _LOWER, LETTERS).astype(np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def laid_out(texts: list[bytes], fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each between spaces, and the text number of each byte."""
    data, offsets = flat([b" " + x + b" " for x in texts])
    return fold[data], np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))


def hashed(codes: np.ndarray, size: int, buckets: int, salt: int) -> np.ndarray:
    """Bucket of the ``size`` bytes from each place on."""
    n = len(codes) - size + 1
    packed = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size):
        packed = (packed << np.uint64(8)) | codes[k : k + len(packed)].astype(np.uint64)
    return (((packed + np.uint64(salt << 56)) * _MIX) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int32)
