"""Images whole: one row for each channel of an image, many images of a shape transformed at once as one array.

Taken by images of at most ``WHOLE`` pixels; larger ones go as scan lines, see ``scanlines``. Where the pixels of an image
share a partition, nothing is shuffled. The arithmetic is that of the scan lines, term by term in the same order.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Fixed value: slope of the cubic convolution kernel.
SLOPE = -0.75
#: Pixels of a channel that a task gathers; sides have 16 bits.
WHOLE = 1 << 16
#: Pixels that are transformed at once: their arrays stay in the cache.
MADE = 1 << 17
#: Images of one shape ``(image, y, x)`` and what their rows say -> tag and images after the change.
Change = Callable[..., Iterator[tuple[str | None, np.ndarray]]]


def split(pixels: DataFrame, images: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
    """Pixels of the images to take whole and of those to take as lines; None where there are none.

    Sizes come from ``images``, an image that it lacks counts as small; without it they are read off the pixels.
    """
    if any(pixels.schema[c].dataType != IntegerType() for c in ("y", "x", "v")):
        return None, pixels
    if images is None:
        images = pixels.groupBy("image_id").agg(*[(F.max(c).cast("bigint") + 1).alias(side) for c, side in (("x", "width"), ("y", "height"))])
    fits = F.col("width").cast("bigint") * F.col("height").cast("bigint") <= WHOLE
    large = images.where(~F.coalesce(fits, F.lit(False))).select("image_id")
    if large.isEmpty():
        return pixels, None
    return pixels.join(large, "image_id", "left_anti"), pixels.join(large, "image_id", "left_semi")


def gathered(pixels: DataFrame) -> DataFrame:
    """Place and value of all pixels of a channel, as one number each; a place out of range or a null is missing there."""
    keys = [c for c in pixels.columns if c not in ("y", "x", "v")]
    place = F.shiftleft(F.col("y").cast("bigint"), 16).bitwiseOR(F.col("x").cast("bigint"))
    cell = F.shiftleft(place, 32).bitwiseOR(F.col("v").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    held = F.when(F.col("y").between(0, 0xFFFF) & F.col("x").between(0, 0xFFFF), cell)
    return pixels.groupBy(*keys).agg(F.collect_list(held).alias("_cells"), F.count("*").alias("_n"))


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch some images at a time, about ``MADE`` pixels."""
    ends = np.cumsum(pc.list_value_length(batch.column("_cells")).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + MADE, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _placed(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values image by image in order of their places, where each image starts, and the heights and widths."""
    cells = piece.column("_cells")
    flat = cells.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    broken = (sizes != piece.column("_n").to_numpy(zero_copy_only=False)) | (sizes == 0)
    if not broken.any():
        y, x = (flat >> np.uint64(48)).astype(np.int64), ((flat >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
        heights, widths = (np.maximum.reduceat(a, starts) + 1 for a in (y, x))
        broken = heights * widths != sizes
    if not broken.any():
        at = np.repeat(starts, sizes) + y * np.repeat(widths, sizes) + x
        empty = np.bincount(at, minlength=len(flat)) == 0
        broken = np.logical_or.reduceat(empty, starts)
    if broken.any():
        image = piece.column("image_id")[int(np.flatnonzero(broken)[0])].as_py()
        raise ValueError(f"broken line of pixels in image {image}")
    values = np.empty(len(flat), dtype=np.int32)
    values[at] = flat.astype(np.uint32).view(np.int32)
    return values, starts, heights, widths


def changed(images: DataFrame, change: Change, told: Sequence[str] = (), tag: str | None = None) -> DataFrame:
    """Lines ``(..., y, vals)`` of gathered images after ``change``, which is told the columns ``told`` of an image; with ``tag`` a column of that name."""
    keys = [c for c in images.columns if c not in ("_cells", "_n", *told)]

    def lines(batches):
        for batch in batches:
            for piece in _pieces(batch):
                values, starts, heights, widths = _placed(piece)
                named = piece.select(keys)
                alike = defaultdict(list)
                for row, kind in enumerate(zip(heights.tolist(), widths.tolist(), *[piece.column(c).to_pylist() for c in told])):
                    alike[kind].append(row)
                for (h, w, *rest), rows in alike.items():
                    stack = values[starts[rows][:, None] + np.arange(h * w)].reshape(-1, h, w)
                    own = named.take(pa.array(rows))
                    for name, out in change(stack, *rest):
                        yield _lines(own, keys, name, tag, out)

    schema = StructType([
        *[images.schema[c] for c in keys], StructField("y", IntegerType()), *([StructField(tag, StringType())] if tag else []),
        StructField("vals", ArrayType(IntegerType())),
    ])
    return images.mapInArrow(lines, schema)


def _lines(own: pa.RecordBatch, keys: list[str], name: str | None, tag: str | None, out: np.ndarray) -> pa.RecordBatch:
    k, h, w = out.shape
    each = pa.array(np.repeat(np.arange(k), h))
    columns = [own.column(c).take(each) for c in keys]
    offsets = pa.array(np.arange(k * h + 1, dtype=np.int32) * np.int32(w))
    vals = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(out, dtype=np.int32).ravel()))
    tags = [pa.array([name] * (k * h), type=pa.string())] if tag else []
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(np.arange(h, dtype=np.int32), k)), *tags, vals], names=[*keys, "y", *([tag] if tag else []), "vals"])


# ---- changes of arrays (image, y, x) ------------------------------------------

def whole_numbers(images: np.ndarray) -> np.ndarray:
    return np.floor(images + 0.5).astype(np.int32)


def brighter(images: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    """Single precision, clipped to 0..255 and truncated."""
    level = images.astype(np.float32) * np.float32(alpha) + np.float32(beta)
    return np.minimum(np.float32(255), np.maximum(np.float32(0), level)).astype(np.int32)


def _summed(images: np.ndarray, axis: int, taps: list[tuple[np.ndarray, np.ndarray | float]]) -> np.ndarray:
    total = None
    for index, weight in taps:
        weight = weight if np.isscalar(weight) or axis == 2 else weight[:, None]
        term = weight * np.take(images, index, axis=axis)
        total = term if total is None else total + term
    return total


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    period = max(2 * (n - 1), 1)
    folded = i % period
    return np.minimum(folded, period - folded if n > 1 else 0)


def blurred(images: np.ndarray, weights: Sequence[float]) -> np.ndarray:
    """Separable kernel with mirrored borders, rounded once at the end."""
    half = len(weights) // 2
    for axis in (2, 1):
        n = images.shape[axis]
        images = _summed(images, axis, [(_mirrored(np.arange(n) + (k - half), n), float(w)) for k, w in enumerate(weights)])
    return whole_numbers(images)


def _linear(i, n, m):
    place = np.minimum(np.maximum((i + 0.5) * (n / m) - 0.5, 0.0), float(n - 1))
    low = np.floor(place)
    return [(low, 1 - (place - low)), (np.minimum(low + 1, n - 1), place - low)]


def _cubic(i, n, m):
    place = (i + 0.5) * (n / m) - 0.5
    low = np.floor(place)
    f = place - low
    near = lambda t: ((SLOPE + 2) * t - (SLOPE + 3)) * t * t + 1
    far = lambda t: ((SLOPE * t - 5 * SLOPE) * t + 8 * SLOPE) * t - 4 * SLOPE
    held = lambda k: np.clip(k, 0, n - 1)
    return [(held(low - 1), far(f + 1)), (held(low), near(f)), (held(low + 1), near(1 - f)), (held(low + 2), far(2 - f))]


def _area(i, n, m):
    if n <= m:
        return _linear(i, n, m)
    ratio = n / m
    low, high = i * ratio, np.minimum((i + 1) * ratio, float(n))
    first = np.floor(low)
    last = np.minimum(np.maximum(np.ceil(high - 1e-9) - 1, first), n - 1)
    part = lambda s: np.where(s <= last, np.maximum(np.minimum(s + 1, high) - np.maximum(s, low), 0.0) / ratio, 0.0)
    return [(np.minimum(s, n - 1), part(s)) for s in (first + k for k in range(int((last - first).max()) + 1))]


TAPS = {
    "nearest": lambda i, n, m: [(np.minimum(np.floor(i * (n / m)), n - 1), 1.0)],
    "linear": _linear, "cubic": _cubic, "area": _area,
}


def resized(images: np.ndarray, new_w: int, new_h: int, interpolation: str) -> np.ndarray:
    """Resized along x, then along y, rounded once at the end; a cubic kernel is cut to 0..255."""
    if new_w < 1 or new_h < 1:
        raise ValueError("an image has no pixel left after its resize")
    for axis, m in ((2, new_w), (1, new_h)):
        taps = TAPS[interpolation](np.arange(m), images.shape[axis], m)
        images = _summed(images, axis, [(index.astype(np.int64), weight) for index, weight in taps])
    return whole_numbers(np.clip(images, 0.0, 255.0) if interpolation == "cubic" else images)


def after_chain(images: np.ndarray, names: Sequence[str], kernel: Sequence[float], level: tuple[float, float], size: tuple[int, int], target, scale: float | None, interpolation: str) -> np.ndarray:
    """A chain of changes; ``size`` is the width and height that resizing goes by."""
    for name in names:
        if name == "vertical_flip":
            images = images[:, ::-1]
        elif name == "change_brightness":
            images = brighter(images, *level)
        elif name == "gaussian_blur":
            images = blurred(images, kernel)
        elif name == "resize":
            size = (int(target[0]), int(target[1])) if target is not None else tuple(round(side * scale) for side in size)
            images = resized(images, *size, interpolation)
    return images


# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
