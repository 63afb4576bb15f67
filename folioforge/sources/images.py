"""Grey and colour rasters (binary PGM and PPM) as rows, their size rule, and variants for recognition.

"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The longest side allowed, and the one that small images are enlarged to.
LONGEST, SHORT_TARGET = 4000, 1500
_HEAD = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")
RASTER = "path string, width int, height int, pixels binary, error string"


def decode(content: bytes) -> np.ndarray:
    """Grey values, height x width."""
    m = _HEAD.match(content)
    if not m or int(m[4]) > 255:
        raise ValueError("not a binary PGM or PPM of eight bits")
    w, h, channels = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
    data = np.frombuffer(content, np.uint8, w * h * channels, m.end()).reshape(h, w, channels)
    return np.round(data @ (np.array([0.299, 0.587, 0.114]) if channels == 3 else np.ones(1))).astype(np.uint8)


def sized(x: np.ndarray, longest: int = LONGEST, target: int = SHORT_TARGET) -> np.ndarray:
    """[S10] Scaled down to the longest side allowed, or up so that the longer side reaches the target; nearest pixel."""
    side = max(x.shape)
    k = longest / side if side > longest else target / side if side < target else 1
    rows, cols = (np.minimum((np.arange(max(1, round(n * k))) / k).astype(int), n - 1) for n in x.shape)
    return x[rows][:, cols]


def images(table: DataFrame, longest: int = LONGEST, target: int = SHORT_TARGET) -> DataFrame:
    """[S10] RASTER rows of (path, content), sized; a file that isn't a raster has an error and no pixels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    x = sized(decode(content or b""), longest, target)
                    row = (path, x.shape[1], x.shape[0], x.tobytes(), None)
                except ValueError as e:
                    row = (path, None, None, None, str(e)[:200])
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds)], ["path", "width", "height", "pixels", "error"])

    return table.select("path", "content").mapInArrow(run, RASTER)


def stretched(x: np.ndarray) -> np.ndarray:
    lo, hi = np.percentile(x, (2, 98))
    return np.clip((x.astype(float) - lo) * 255 / max(hi - lo, 1), 0, 255).astype(np.uint8)


def smoothed(x: np.ndarray) -> np.ndarray:
    """The median of each pixel and its four neighbours."""
    p = np.pad(x, 1, mode="edge")
    return np.median(np.stack([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]), axis=0).astype(np.uint8)


def threshold(x: np.ndarray) -> np.ndarray:
    """Black and white at the level that parts the grey values best."""
    n = np.bincount(x.ravel(), minlength=256).astype(float)
    w, s = np.cumsum(n), np.cumsum(n * np.arange(256))
    between = np.zeros(256)
    ok = (w > 0) & (w < w[-1])
    between[ok] = (s[-1] * w[ok] - s[ok] * w[-1]) ** 2 / (w[ok] * (w[-1] - w[ok]))
    return np.where(x > between.argmax(), 255, 0).astype(np.uint8)


VARIANTS = {"original": lambda x: x, "contrast": stretched, "smooth": smoothed, "binary": threshold, "inverted": lambda x: 255 - x}


def variants(rasters: DataFrame) -> DataFrame:
    """Each raster in every variant: path, variant, ord, width, height, pixels. What recognises them is chosen by best_variant()."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, w, h, data in zip(*(batch.column(c).to_pylist() for c in ("path", "width", "height", "pixels"))):
                x = np.frombuffer(data, np.uint8).reshape(h, w)
                made = [(path, name, k, w, h, f(x).tobytes()) for k, (name, f) in enumerate(VARIANTS.items())]
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], ["path", "variant", "ord", "width", "height", "pixels"])

    return rasters.where(F.col("pixels").isNotNull()).select("path", "width", "height", "pixels").mapInArrow(run, "path string, variant string, ord int, width int, height int, pixels binary")


def empty_grids(x: np.ndarray, dark: int = 128, share: float = 0.8) -> tuple[int, int] | None:
    """[M15] Columns and rows of a drawn grid without content: rules are rows and columns that are mostly dark; null unless the cells are blank."""
    ink = x < dark
    def lines(v: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(v)
        return at[np.concatenate([[True], np.diff(at) > 1])] if len(at) else at

    across, down = ink.mean(1) >= share, ink.mean(0) >= share
    rows, cols = lines(across), lines(down)
    if len(rows) < 2 or len(cols) < 2:
        return None
    inside = ink[~across][:, ~down]
    return (len(cols) - 1, len(rows) - 1) if inside.mean() < 0.005 else None


def has_ink(x: np.ndarray, dark: int = 128, least: float = 0.002) -> bool:
    """[M19] Whether a crop shows more than blankness or ruling."""
    ink = x < dark
    rest = ink[ink.mean(1) <= 0.7][:, ink.mean(0) <= 0.7]
    return bool(rest.size and rest.mean() >= least)
