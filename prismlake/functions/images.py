"""Image kernels on arrays of height x width x 3 bytes (K1, K2, K4, C5, C6). They run inside pandas UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


RESULT = T.StructType([T.StructField("value", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])


def cubic(distance: np.ndarray) -> np.ndarray:
    """Cubic convolution with a = -0.5."""
    x = np.abs(distance)
    near, far = (1.5 * x - 2.5) * x * x + 1, ((-0.5 * x + 2.5) * x - 4) * x + 2
    return np.where(x <= 1, near, np.where(x < 2, far, 0.0))


def resized(width: int, height: int, shortest: int) -> tuple[int, int]:
    """The size whose shorter side is ``shortest``."""
    short = min(width, height)
    return max(shortest, shortest * width // short), max(shortest, shortest * height // short)


def _taps(size: int, offset: int, source: int, scaled: int) -> np.ndarray:
    """size x source weights of a resized and cropped axis; taps beyond the edge fall on it."""
    at = (np.arange(size) + offset + 0.5) * (source / scaled) - 0.5
    index = np.floor(at).astype(int)[:, None] + np.arange(-1, 3)
    weight = cubic(at[:, None] - index)
    weight /= weight.sum(axis=1, keepdims=True)
    out = np.zeros((size, source))
    np.add.at(out, (np.arange(size)[:, None], np.clip(index, 0, source - 1)), weight)
    return out


def center_crop(pixels: np.ndarray, size: int = 256, mean: Sequence[float] = (0, 0, 0), std: Sequence[float] = (1, 1, 1)) -> np.ndarray:
    """K1: shortest side to ``size``, bicubic, centre crop, to channel-first normalised floats."""
    height, width = pixels.shape[:2]
    if not height or not width:
        raise ValueError("the image is empty")
    scaled = resized(width, height, size)
    left, top = (int(np.round((s - size) / 2)) for s in scaled)
    rows, columns = _taps(size, top, height, scaled[1]), _taps(size, left, width, scaled[0])
    out = np.einsum("yh,hwc,xw->cyx", rows, pixels.astype(float), columns, optimize=True)
    out = np.clip(out, 0, 255) / 255
    return ((out - np.reshape(mean, (3, 1, 1))) / np.reshape(std, (3, 1, 1))).astype(np.float32)


def detector_input(pixels: np.ndarray, size: int = 640) -> np.ndarray:
    """K2: longest side to ``size`` (bilinear), top left, the rest as black, to channel-first floats."""
    height, width = pixels.shape[:2]
    scale = size / max(width, height)
    w, h = (min(max(int(x * scale), 1), size) for x in (width, height))

    def axis(n: int, source: int) -> np.ndarray:
        at = np.clip((np.arange(n) + 0.5) * (source / n) - 0.5, 0, source - 1)
        low = np.minimum(np.floor(at).astype(int), max(source - 2, 0))
        out = np.zeros((n, source))
        np.add.at(out, (np.arange(n), low), 1 - (at - low))
        np.add.at(out, (np.arange(n), np.minimum(low + 1, source - 1)), at - low)
        return out

    small = np.einsum("yh,hwc,xw->cyx", axis(h, height), pixels.astype(float), axis(w, width), optimize=True)
    out = np.full((3, size, size), -127.5 / 128, np.float32)
    out[:, :h, :w] = (np.floor(small + 0.5) - 127.5) / 128
    return out


def face_input(pixels: np.ndarray, similarity: Sequence[float], size: int = 112) -> np.ndarray:
    """K4: the face that ``align`` found, sampled bilinearly; beyond the image is black."""
    a, b, tx, ty = similarity
    y, x = np.mgrid[0:size, 0:size]
    source = (x - tx + 1j * (y - ty)) / (a + 1j * b)
    height, width = pixels.shape[:2]
    framed = np.zeros((height + 2, width + 2, 3))
    framed[1:-1, 1:-1] = pixels
    low = np.floor(source.real) + 1j * np.floor(source.imag)
    part = source - low
    out = np.zeros((size, size, 3))
    for dx in (0, 1):
        for dy in (0, 1):
            px = np.clip(low.real + dx, -1, width).astype(int) + 1
            py = np.clip(low.imag + dy, -1, height).astype(int) + 1
            share = (part.real if dx else 1 - part.real) * (part.imag if dy else 1 - part.imag)
            out += framed[py, px] * share[..., None]
    return ((out - 127.5) / 127.5).transpose(2, 0, 1).astype(np.float32)


def kernel(decode: Callable[[bytes], np.ndarray], apply: Callable[[np.ndarray], np.ndarray]):
    """A column function of image bytes: the kernel's values, or the reason why there are none.

    ``decode`` and ``apply`` stand for whatever codec and model a deployment has (K5, K6); both are loaded once
    for each task.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for blobs in batches:
            rows = []
            for blob in blobs:
                try:
                    rows.append((np.asarray(apply(decode(blob)), np.float32).reshape(-1), None))
                except Exception as error:
                    rows.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["value", "error"])

    return run


def raw_rgb(blob: bytes) -> np.ndarray:
    """The binary PPM format (P6, 8 bit), which needs no codec."""
    head = re.match(rb"P6\s+(\d+)\s+(\d+)\s+255\s", blob)
    if not head:
        raise ValueError("not a binary 8-bit PPM image")
    width, height = int(head[1]), int(head[2])
    data = np.frombuffer(blob, np.uint8)[head.end() :]
    if len(data) != 3 * width * height or not width * height:
        raise ValueError("the image is cut off or empty")
    return data.reshape(height, width, 3)
