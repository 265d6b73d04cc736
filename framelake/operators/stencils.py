"""Separable stencils on one frame, with a rule for what lies beyond its border."""

from __future__ import annotations

import numpy as np

#: Smoothing weights of small blocks, a fixed table; larger ones are a bell curve.
SMALL_BELLS = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}


def beyond(places: np.ndarray, n: int, border: str) -> np.ndarray:
    """The place of 0..n-1 that stands for each: the nearest one (repeat), or mirrored at the outermost one (reflect)."""
    if border == "repeat" or n == 1:
        return np.clip(places, 0, n - 1)
    if border != "reflect":
        raise ValueError(f"unknown border {border!r}; repeat or reflect")
    folded = np.abs(places) % (2 * n - 2)
    return np.minimum(folded, 2 * n - 2 - folded)


def along(a: np.ndarray, weights: np.ndarray, axis: int, border: str) -> np.ndarray:
    """Each place's neighbours on the axis, weighted and summed; the weights' middle is the place itself."""
    n, reach = a.shape[axis], len(weights) // 2
    return sum(w * a.take(beyond(np.arange(n) + k - reach, n, border), axis) for k, w in enumerate(weights) if w)


def separable(a: np.ndarray, down: np.ndarray, across: np.ndarray, border: str) -> np.ndarray:
    return along(along(a, down, 0, border), across, 1, border)


def odd(size: int, least: int) -> int:
    """A block's size: the next odd one, at least `least`."""
    if size < least:
        raise ValueError(f"a block's size must be at least {least}")
    return size + 1 - size % 2


def bell(size: int) -> np.ndarray:
    if size in SMALL_BELLS:
        return np.array(SMALL_BELLS[size])
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    curve = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return curve / curve.sum()


def derivative_weights(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer smoothing and derivative weights of a Sobel kernel: binomials, one factor being a difference; size 1 differs without smoothing."""
    if size == 1:
        return np.array([1]), np.array([-1, 0, 1])
    smooth = np.array([1])
    for _ in range(size - 2):
        smooth = np.convolve(smooth, [1, 1])
    return np.convolve(smooth, [1, 1]), np.convolve(smooth, [-1, 1])


def gradients(a: np.ndarray, size: int = 3) -> np.ndarray:
    """Squared Sobel magnitude; borders are mirrored."""
    smooth, slope = derivative_weights(size)
    a = a.astype(np.int64)
    gx, gy = separable(a, smooth, slope, "reflect"), separable(a, slope, smooth, "reflect")
    return gx * gx + gy * gy
