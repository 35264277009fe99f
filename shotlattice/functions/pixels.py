"""Measures of images given as arrays; they run in Arrow batches beside the data."""

from __future__ import annotations

import numpy as np


def palette(rgb: np.ndarray, top: int = 8) -> list[tuple[int, float, tuple[float, float, float]]]:
    """Colour cells (8 levels a channel) by pixel share: (cell, share, mean colour), the first ``top`` by (share, cell)."""
    flat = rgb.reshape(-1, 3).astype(int)
    cell = (flat // 32) @ np.array([64, 8, 1])
    n = np.bincount(cell, minlength=512)
    means = np.stack([np.bincount(cell, flat[:, c], 512) for c in range(3)], 1) / np.maximum(n, 1)[:, None]
    order = np.argsort(-n, kind="stable")[:top]
    return [(int(c), float(n[c] / len(flat)), tuple(map(float, means[c]))) for c in order if n[c]]


def classical(rgb: np.ndarray) -> dict[str, float]:
    """Brightness, contrast (root mean square and of extremes), saturation, colourfulness and left-right symmetry, all for values 0 to 1."""
    x = rgb.astype(float) / 255
    gray = x @ np.array([0.299, 0.587, 0.114])
    hi, lo = x.max(axis=2), x.min(axis=2)
    rg, yb = x[..., 0] - x[..., 1], (x[..., 0] + x[..., 1]) / 2 - x[..., 2]
    extremes = gray.max() + gray.min()
    return {
        "brightness": float(gray.mean()),
        "contrast_rms": float(gray.std()),
        "contrast_michelson": float((gray.max() - gray.min()) / extremes) if extremes else 0.0,
        "saturation": float(np.divide(hi - lo, hi, out=np.zeros_like(hi), where=hi > 0).mean()),
        "colourfulness": float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())),
        "symmetry": float(1 - np.abs(gray - gray[:, ::-1]).mean()),
    }


def histograms(rgb: np.ndarray, bins: int = 16) -> np.ndarray:
    """Share of pixels by channel and bin."""
    flat = rgb.reshape(-1, 3).astype(int) * bins // 256
    return np.stack([np.bincount(flat[:, c], minlength=bins) for c in range(3)]) / len(flat)


def sharpness(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian."""
    g = gray.astype(float)
    inner = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(inner.var()) if inner.size else 0.0


def bars(gray: np.ndarray, dark: float = 16) -> float:
    """The larger share of dark lines at both ends, by rows or by columns; 1 for a dark image."""

    def ends(means):
        lit = np.flatnonzero(means >= dark)
        return 1.0 if not len(lit) else (lit[0] + len(means) - 1 - lit[-1]) / len(means)

    return float(max(ends(gray.mean(axis=1)), ends(gray.mean(axis=0))))


def normals(depth: np.ndarray) -> np.ndarray:
    """Unit surface normals of a depth map."""
    dy, dx = np.gradient(depth.astype(float))
    n = np.stack([-dx, -dy, np.ones_like(dx)], -1)
    return n / np.linalg.norm(n, axis=-1, keepdims=True)


def masked(shape: tuple[int, int], boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """True outside the boxes."""
    out = np.ones(shape, bool)
    for x1, y1, x2, y2 in boxes:
        out[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] = False
    return out
