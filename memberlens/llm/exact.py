"""Whole numbers from components: floor(scale * x), in floats where sums of products stay exact, else in Python's own."""

from __future__ import annotations

import numpy as np


def padded(vector) -> np.ndarray:
    """As doubles; one zero for an empty vector."""
    return np.asarray(vector, np.float64) if len(vector) else np.zeros(1)


def floors(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(values * scale)


def fits(largest: float, query: np.ndarray) -> bool:
    """Whether no sum of products of the query with components up to ``largest`` leaves the exact range of doubles."""
    with np.errstate(over="ignore"):
        return largest * float(np.abs(query).max(initial=0)) * len(query) < 2**53


def exact(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in Python's whole numbers, also where the product is beyond a double."""
    whole = [int(f) if np.isfinite(f) else int(x) * scale for x, f in zip(values.ravel().tolist(), floors(values, scale).ravel().tolist())]
    return np.array(whole, object).reshape(values.shape)
