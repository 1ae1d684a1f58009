"""A 64-bit perceptual hash of images: 32x32 grey values, the low frequencies of a cosine transform against their median."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE, LOW = 32, 8


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey values of an array height x width x channels in blue, green, red(, alpha) order."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.uint8)
    b, g, r = (pixels[:, :, k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def _weights(old: int, new: int, reach: float = 3.0) -> np.ndarray:
    """Lanczos weights, new x old, each row of sum 1; a smaller image widens the window."""
    scale = max(old / new, 1.0)
    centres = (np.arange(new) + 0.5) * old / new
    x = (np.arange(old)[None, :] + 0.5 - centres[:, None]) / scale
    w = np.where(np.abs(x) < reach, np.sinc(x) * np.sinc(x / reach), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The image at size x size; values are rounded to bytes after each of the two passes."""
    to_bytes = lambda a: np.clip(np.floor(a + 0.5), 0, 255)
    wide = to_bytes(image.astype(float) @ _weights(image.shape[1], size).T)
    return to_bytes(_weights(image.shape[0], size) @ wide)


def hash_of(image: np.ndarray) -> str:
    """16 hexadecimal digits: the 8x8 lowest coefficients row by row, 1 where one reaches the median of all but the first."""
    values = resize(image)
    k = np.arange(SIZE)
    waves = np.cos(np.outer(k[:LOW], 2 * k + 1) * (np.pi / (2 * SIZE))) * np.sqrt(np.where(k[:LOW, None] == 0, 1, 2) / SIZE)
    low = (waves @ values @ waves.T).ravel()
    bits = low >= np.median(low[1:])
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def perceptual_hash(image: Column) -> Column:
    """The hash of a column of Spark's `image` source (a struct with height, width, nChannels, data); null if it isn't decoded."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            shapes = zip(b["height"], b["width"], b["nChannels"], b["data"], strict=True)
            yield pd.Series([hash_of(grey(np.frombuffer(d, dtype=np.uint8).reshape(h, w, c))) if h > 0 and d is not None else None for h, w, c, d in shapes], dtype=object)

    return run(F.struct(image["height"].alias("height"), image["width"].alias("width"), image["nChannels"].alias("nChannels"), image["data"].alias("data")))
