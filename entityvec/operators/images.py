"""Image checks and pixel fingerprints; the codec is injected, the work is Spark's."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Decoder = Callable[[bytes], np.ndarray]

FINGERPRINT_SIZE = 16
_FIXED_POINT_BITS = 22
#: Pictures whose fingerprints a Python worker holds at a time.
SLICE_ROWS = 512


def has_jpeg_markers(content: Column) -> Column:
    """Start and end markers only; says nothing about what lies between."""
    n = F.length(content)
    return F.coalesce(
        (n >= 4) & (F.hex(F.substring(content, 1, 2)) == "FFD8")
        & (F.hex(F.substring(content, n - 1, F.lit(2))) == "FFD9"), F.lit(False))


def validate_images(df: DataFrame, content: str = "content",
                    decode: Decoder | None = None) -> DataFrame:
    """Add ``ok`` and ``check``: ``decoded`` with a decoder, else ``markers`` only.

    ``content`` may be the struct of Spark's ``image`` source, which has tried to decode the file already.
    """
    if isinstance(df.schema[content].dataType, T.StructType):
        picture = F.col(content)
        ok = F.coalesce((picture["height"] > 0) & (picture["width"] > 0) & picture["data"].isNotNull(), F.lit(False))
        return df.withColumn("ok", ok).withColumn("check", F.lit("decoded"))
    if decode is None:
        return (df.withColumn("ok", has_jpeg_markers(F.col(content)))
                .withColumn("check", F.lit("markers")))

    @F.pandas_udf("boolean")
    def decodes(series: pd.Series) -> pd.Series:
        return series.map(lambda b: _decoded(b, decode) is not None)

    return df.withColumn("ok", decodes(content)).withColumn("check", F.lit("decoded"))


def _decoded(content, decode: Decoder):
    try:
        return np.asarray(decode(content))
    except Exception:
        return None


def resize_weights(source: int, target: int) -> np.ndarray:
    """Rows of triangle-filter weights (target x source), as 22-bit integers.

    When shrinking, the filter is widened by the scale so that every pixel counts.
    """
    scale = source / target
    reach = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    low = np.maximum((centre - reach + 0.5).astype(int), 0)
    high = np.minimum((centre + reach + 0.5).astype(int), source)
    at = np.arange(source)
    w = np.maximum(1.0 - np.abs((at + 0.5)[None, :] - centre[:, None]) / reach, 0.0)
    w[(at[None, :] < low[:, None]) | (at[None, :] >= high[:, None])] = 0.0
    w /= w.sum(1, keepdims=True)
    return np.floor(w * (1 << _FIXED_POINT_BITS) + 0.5).astype(np.int64)


def _blend(pixels: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    total = np.tensordot(weights, pixels.astype(np.int64), axes=(1, axis))
    out = (total + (1 << (_FIXED_POINT_BITS - 1))) >> _FIXED_POINT_BITS
    return np.moveaxis(np.clip(out, 0, 255), 0, axis)


def resize_bilinear(rgb: np.ndarray, size: int) -> np.ndarray:
    """Height x width x 3 bytes to size x size x 3, columns first, rounded after each pass."""
    out = rgb
    if rgb.shape[1] != size:
        out = _blend(out, resize_weights(rgb.shape[1], size), 1)
    if rgb.shape[0] != size:
        out = _blend(out, resize_weights(rgb.shape[0], size), 0)
    return out.astype(np.uint8)


def as_rgb(pixels: np.ndarray) -> np.ndarray:
    """Grey, grey+alpha, RGB or RGBA arrays to RGB."""
    if pixels.ndim == 2:
        pixels = pixels[:, :, None]
    if pixels.shape[2] < 3:
        return np.repeat(pixels[:, :, :1], 3, axis=2)
    return pixels[:, :, :3]


def _slices(batches: Iterator) -> Iterator:
    for batch in batches:
        # A batch without rows is answered, too.
        for lo in range(0, max(len(batch), 1), SLICE_ROWS):
            yield batch.iloc[lo:lo + SLICE_ROWS]


def pixel_fingerprint(df: DataFrame, content: str = "content", size: int = FINGERPRINT_SIZE,
                      decode: Decoder | None = None, output: str = "fingerprint") -> DataFrame:
    """Add ``fingerprint`` (size*size*3 values 0..255, row by row, RGB) and ``decoded``.

    ``content`` is bytes when ``decode`` (bytes to RGB array) is given, else the struct of
    Spark's ``image`` source. An image that cannot be decoded gives zeros.
    """
    length = size * size * 3

    def one(pixels) -> tuple[np.ndarray, bool]:
        if pixels is None or 0 in pixels.shape:
            return np.zeros(length, np.int32), False
        return resize_bilinear(as_rgb(pixels), size).reshape(-1).astype(np.int32), True

    schema = "fingerprint array<int>, decoded boolean"
    if decode is not None:
        @F.pandas_udf(schema)
        def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for s in _slices(series):
                yield pd.DataFrame([one(_decoded(b, decode)) for b in s],
                                   columns=["fingerprint", "decoded"])
        made = run.asNondeterministic()(F.col(content))
    else:
        @F.pandas_udf(schema)
        def run(series: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for s in _slices(series):
                yield pd.DataFrame([one(_stored_pixels(*r)) for r in s.itertuples(index=False)],
                                   columns=["fingerprint", "decoded"])
        made = run.asNondeterministic()(F.struct(*[F.col(content)[n].alias(n)
                              for n in ("height", "width", "nChannels", "data")]))
    out = df.withColumn("_fp", made)
    return (out.withColumn(output, F.col("_fp.fingerprint"))
            .withColumn("decoded", F.col("_fp.decoded")).drop("_fp"))


def _stored_pixels(height, width, channels, data):
    """Pixels of the ``image`` source, which stores blue first; None if not decodable."""
    if data is None or height is None or height <= 0:
        return None
    pixels = np.frombuffer(data, np.uint8).reshape(int(height), int(width), int(channels))
    return pixels[:, :, 2::-1] if channels >= 3 else pixels
