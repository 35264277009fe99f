"""Measures of images that stand in columns: an array of pixel numbers (red, green, blue, row by row) and the width. They run in Arrow batches, row by row of the table, without a shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import pixels as X

MEASURES = ("brightness", "contrast_rms", "contrast_michelson", "saturation", "colourfulness", "symmetry", "sharpness", "bars", "level")


def _image(values, width: int) -> np.ndarray:
    return np.asarray(values, float).reshape(-1, int(width), 3)


def _mapped(df: DataFrame, key: str, rgb: str, width: str, fields: str, measure) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches):
        names = [f.split(" ")[0] for f in fields.split(", ")]
        for batch in batches:
            rows = [(k, *r) for k, v, w in zip(batch[key], batch[rgb], batch[width]) if v is not None and len(v) for r in measure(_image(v, w))]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, rgb, width).mapInPandas(run, f"{key} {kind}, {fields}")


def measures(df: DataFrame, key: str, rgb: str, width: str, dark: float = 16) -> DataFrame:
    """One row an image: brightness, contrasts, saturation, colourfulness, symmetry, sharpness, black bars, and ``level``, how far its brightness as a height faces the viewer on average. Images without pixels have none."""

    def measure(x):
        gray = x @ np.array([0.299, 0.587, 0.114])
        found = X.classical(x) | {"sharpness": X.sharpness(gray), "bars": X.bars(gray, dark)}
        found["level"] = float(X.normals(gray)[..., 2].mean()) if min(gray.shape) > 1 else 1.0
        return [tuple(found[m] for m in MEASURES)]

    return _mapped(df, key, rgb, width, ", ".join(f"{m} double" for m in MEASURES), measure)


def palettes(df: DataFrame, key: str, rgb: str, width: str, top: int = 8) -> DataFrame:
    """An image's colour cells by share, the ``top`` largest (by cell on ties), with their mean colours."""

    def measure(x):
        return [(cell, share, *colour, rank) for rank, (cell, share, colour) in enumerate(X.palette(x, top), 1)]

    return _mapped(df, key, rgb, width, "cell int, share double, red double, green double, blue double, rank int", measure)


def histograms(df: DataFrame, key: str, rgb: str, width: str, bins: int = 16) -> DataFrame:
    """An image's shares of pixels by channel (0 red, 1 green, 2 blue) and bin; empty bins are left out."""

    def measure(x):
        return [(int(c), int(b), float(h[c, b])) for h in [X.histograms(x, bins)] for c, b in zip(*np.nonzero(h))]

    return _mapped(df, key, rgb, width, "channel int, bin int, share double", measure)


def uncovered(df: DataFrame, key: str, rgb: str, width: str, boxes: str) -> DataFrame:
    """The share of an image that lies outside its boxes (x1, y1, x2, y2)."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for batch in batches:
            rows = [(k, float(X.masked((len(v) // 3 // w, w), [tuple(map(int, b)) for b in bs]).mean())) for k, v, w, bs in zip(batch[key], batch[rgb], batch[width], batch[boxes])]
            yield pd.DataFrame(rows, columns=[key, "share"])

    return df.select(key, rgb, width, boxes).mapInPandas(run, f"{key} {kind}, share double")
