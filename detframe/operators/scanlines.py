"""Images as scan lines: one row per line of one channel, its values in an array.

A line is ``(image_id, y, c, ..., vals)``. What works along x needs no other line. What works along y deals the lines into
bands of ``BAND`` lines, and a line goes to its neighbour bands too where these reach across the border; so a transform
shuffles lines once, whatever its kernel, and no task holds more of an image than a band with its borders.

Every transform is a list of taps: the sources of a target place, with their weights, summed in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Lines of a band.
BAND = 64
#: Taps of target place ``i`` on an axis of ``n`` values, ``m`` after the transform: a list where their number is fixed, else an array.
Taps = Callable[[Column, Column, Column], list[tuple[Column, Column]] | Column]


def lines_of(pixels: DataFrame) -> DataFrame:
    """Gather pixels ``(..., y, x, c, v)`` to lines. A line with a hole, a pixel twice or a null raises."""
    keep = [c for c in pixels.columns if c not in ("x", "v")]
    cell, place, value = _packed() if all(pixels.schema[c].dataType == IntegerType() for c in ("x", "v")) else _paired()
    cells = F.array_sort(F.collect_list(cell))
    lines = pixels.groupBy(*keep).agg(cells.alias("_cells"), F.count("*").alias("_n"))
    whole = (place(F.element_at("_cells", -1)) == F.col("_n") - 1) & (place(F.col("_cells")[0]) == 0)
    sound = whole & (F.size(F.array_distinct(F.transform("_cells", place))) == F.col("_n"))
    sound = sound & F.forall("_cells", lambda s: place(s).isNotNull() & value(s).isNotNull())
    # a line of nulls alone has no cells
    sound = (F.size("_cells") == F.col("_n")) & sound
    vals = F.transform("_cells", lambda s: value(s).cast("double"))
    broken = F.raise_error(F.concat(F.lit("broken line of pixels in image "), F.col("image_id").cast("string"))).cast("array<double>")
    return lines.select(*keep, F.when(F.coalesce(sound, F.lit(False)), vals).otherwise(broken).alias("vals"))


def _paired() -> tuple[Column, Callable[[Column], Column], Callable[[Column], Column]]:
    """Place and value of a pixel as a struct, and how each is read."""
    return F.struct("x", "v"), lambda s: s["x"], lambda s: s["v"]


def _packed() -> tuple[Column, Callable[[Column], Column], Callable[[Column], Column]]:
    """The same for whole numbers, place above value in one number: a quarter of the bytes to gather, the same order. A null in
    either leaves a hole."""
    low = lambda s: F.shiftright(F.shiftleft(s, 32), 32).cast("int")
    bits = F.col("v").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(F.col("x").cast("bigint"), 32).bitwiseOR(bits), lambda s: F.shiftright(s, 32).cast("int"), low


def pixels_of(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spread lines to pixels; a value is rounded half up to a whole number."""
    keep = [c for c in lines.columns if c != "vals"]
    spread = lines.select(*keep, F.posexplode("vals").alias("x", "v"))
    return spread.withColumn("v", rounded(F.col("v"))).select(*columns)


def rounded(v: Column) -> Column:
    return F.floor(v + 0.5).cast("int")


def within_bytes(vals: Column) -> Column:
    """What a cubic kernel adds beyond 0 and 255 is cut; no other taps leave the range of their sources."""
    return F.transform(vals, lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), v)))


def _tap(index: Column, weight: Column) -> tuple[Column, Column]:
    return index.cast("int").alias("i"), weight.cast("double").alias("w")


def tap_array(taps: list[tuple[Column, Column]] | Column) -> Column:
    return F.array(*[F.struct(*t) for t in taps]) if isinstance(taps, list) else taps


def mirrored(i: Column, n: Column) -> Column:
    """Index reflected at the edges without repeating the edge, also for lines shorter than the kernel."""
    period = F.greatest((n - 1) * 2, F.lit(1))
    folded = F.pmod(i, period)
    return F.least(folded, F.when(n > 1, period - folded).otherwise(F.lit(0)))


def kernel_taps(weights: Sequence[float]) -> Taps:
    half = len(weights) // 2
    return lambda i, n, m: [_tap(mirrored(i + F.lit(k - half), n), F.lit(w)) for k, w in enumerate(weights)]


def nearest_taps(i: Column, n: Column, m: Column) -> Column:
    return [_tap(F.least(F.floor(i * (n / m)), n - 1), F.lit(1.0))]


def linear_taps(i: Column, n: Column, m: Column) -> Column:
    """Linear between pixel centres, edges held."""
    place = F.least(F.greatest((i + 0.5) * (n / m) - 0.5, F.lit(0.0)), (n - 1).cast("double"))
    low = F.floor(place)
    return [_tap(low, 1 - (place - low)), _tap(F.least(low + 1, n - 1), place - low)]


# Fixed value: slope of the cubic convolution kernel.
SLOPE = -0.75


def cubic_taps(i: Column, n: Column, m: Column) -> Column:
    """Cubic convolution over four places, edges repeated."""
    place = (i + 0.5) * (n / m) - 0.5
    low = F.floor(place)
    f = place - low
    near = lambda t: ((SLOPE + 2) * t - (SLOPE + 3)) * t * t + 1
    far = lambda t: ((SLOPE * t - 5 * SLOPE) * t + 8 * SLOPE) * t - 4 * SLOPE
    held = lambda k: F.least(F.greatest(k, F.lit(0)), n - 1)
    return [_tap(held(low - 1), far(f + 1)), _tap(held(low), near(f)), _tap(held(low + 1), near(1 - f)), _tap(held(low + 2), far(2 - f))]


def area_taps(i: Column, n: Column, m: Column) -> Column:
    """Mean of the sources a target covers; an axis that grows is taken as linear."""
    ratio = n / m
    low, high = i * ratio, F.least((i + 1) * ratio, n.cast("double"))
    first, last = F.floor(low), F.greatest(F.ceil(high - 1e-9) - 1, F.floor(low))
    part = lambda s: F.greatest(F.least(s + 1, high) - F.greatest(s.cast("double"), low), F.lit(0.0)) / ratio
    covered = F.transform(F.sequence(first, F.least(last, n.cast("bigint") - 1)), lambda s: F.struct(*_tap(s, part(s))))
    return F.when(n > m, covered).otherwise(tap_array(linear_taps(i, n, m)))


INTERPOLATIONS: dict[str, Taps] = {"nearest": nearest_taps, "linear": linear_taps, "cubic": cubic_taps, "area": area_taps}


def along_x(vals: Column, m: Column, taps: Taps) -> Column:
    """The line with ``m`` values."""
    n = F.size(vals)

    def value(i: Column) -> Column:
        found = taps(i, n, m)
        if isinstance(found, list):
            terms = [weight * F.get(vals, index) for index, weight in found]
            return sum(terms[1:], terms[0])
        return F.aggregate(found, F.lit(0.0), lambda total, t: total + t["w"] * F.get(vals, t["i"]))

    return F.transform(F.sequence(F.lit(0), m - 1), value)


def _sum_of(rows: Column, first: Column, taps: Column) -> Column:
    """Weighted sum of whole lines; ``first`` is the place of the first of ``rows``."""
    zero = F.transform(F.get(rows, F.lit(0)), lambda _: F.lit(0.0))
    add = lambda total, t: F.zip_with(total, F.get(rows, (t["i"] - first).cast("int")), lambda a, b: a + t["w"] * b)
    return F.aggregate(taps, zero, add)


def _bands(low: Column, high: Column) -> Column:
    of = lambda y: F.floor(y / F.lit(BAND)).cast("int")
    return F.sequence(F.greatest(of(low), F.lit(0)), F.greatest(of(high), F.lit(0)))


def kernel_bands(y: Column, size: int) -> Column:
    """Bands that need line ``y`` for a kernel of ``size``; a reflection is never farther off than the kernel reaches."""
    return _bands(y - size // 2, y + size // 2)


def resize_bands(y: Column, n: Column, m: Column) -> Column:
    """Bands of the resized image that may need line ``y``: its targets lie within two sources and half a target of their centre."""
    ratio = n / m
    reach = ratio / 2 + 2.5
    place = lambda at: F.least(F.greatest(F.floor(at / ratio - 0.5), F.lit(0)), m - 1)
    return _bands(place(y + 0.5 - reach), place(y + 0.5 + reach) + 1)


def banded(lines: DataFrame, bands: Column, targets: Callable[[Column, Column], Column], taps: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """One shuffle: lines to their bands, each band gives its target lines.

    ``targets(band, places)`` is the array of the line numbers a band gives, ``places`` those it has got;
    ``taps(y, places, last)`` what a target is summed from. Columns besides ``y`` and ``vals`` tell images apart.
    """
    keys = [c for c in lines.columns if c not in ("y", "vals")]
    dealt = lines.withColumn("_band", F.explode(bands))
    held = dealt.groupBy(*keys, "_band").agg(F.array_sort(F.collect_list(F.struct("y", "vals"))).alias("_lines"))
    parts = held.select(
        *keys, "_band", F.transform("_lines", lambda s: s["y"]).alias("_places"), F.transform("_lines", lambda s: s["vals"]).alias("_rows"))
    first, last = F.col("_places")[0], F.element_at("_places", -1)
    made = F.transform(
        targets(F.col("_band"), F.col("_places")),
        lambda y: F.struct(y.alias("y"), _sum_of(F.col("_rows"), first, tap_array(taps(y, F.col("_places"), last))).alias("vals")))
    out = parts.select(*keys, F.explode(made).alias("_line"))
    return out.select(*[F.col("_line.y").cast("int").alias("y") if c == "y" else F.col("_line.vals").alias("vals") if c == "vals" else F.col(c) for c in lines.columns])


def own_lines(band: Column, places: Column) -> Column:
    """The lines a band has got that are its own."""
    return F.filter(places, lambda y: F.floor(y / F.lit(BAND)) == band)


def resized_lines(band: Column, m: Column) -> Column:
    """The line numbers of a band in an image of ``m`` lines; none beyond its end."""
    ends = F.sequence(band * BAND, F.greatest(F.least((band + 1) * BAND, m) - 1, band * BAND))
    return F.filter(ends, lambda y: y < m)


def blur_lines(lines: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Separable kernel with mirrored borders. A band sees the end of its image in the lines it gets: beyond its border they only lack there."""
    taps = kernel_taps(weights)
    wide = lines.withColumn("vals", along_x(F.col("vals"), F.size("vals"), taps))
    return banded(wide, kernel_bands(F.col("y"), len(weights)), own_lines, lambda y, _, last: taps(y, last + 1, last + 1))


def resize_lines(lines: DataFrame, height: Column, new_w: Column, new_h: Column, interpolation: str = "linear") -> DataFrame:
    """Lines of the resized image; the columns that give the sizes must be the same for all lines of an image."""
    taps = interpolation_taps(interpolation)
    wide = lines.withColumn("vals", along_x(F.col("vals"), new_w, taps))
    done = banded(
        wide, resize_bands(F.col("y"), height, new_h), lambda band, _: resized_lines(band, new_h), lambda y, *_: taps(y, height, new_h))
    return done.withColumn("vals", within_bytes(F.col("vals"))) if interpolation == "cubic" else done


def interpolation_taps(name: str) -> Taps:
    if name not in INTERPOLATIONS:
        raise ValueError(f"interpolation must be one of {', '.join(INTERPOLATIONS)}")
    return INTERPOLATIONS[name]
