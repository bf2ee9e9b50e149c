"""Image augmentation over a pixel table ``(image_id, y, x, c, v)``, and boxes under a condition.

Flips and brightness are column arithmetic. Blur, resize, chains of transforms and conditions
gather small images whole (``wholeimages``) and others as scan lines (``scanlines``), once, and work on these.
With ``as_lines`` they return lines ``(image_id, y, c, ..., vals)`` instead of pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from detframe.functions.conditions import CONDITIONS, condition_array
from detframe.functions.geometry import center_to_xywh, target_size
from detframe.operators import wholeimages as whole
from detframe.operators.scanlines import (
    along_x, banded, blur_lines, interpolation_taps, kernel_bands, kernel_taps, lines_of, own_lines, pixels_of, resize_bands, resize_lines, resized_lines, rounded, tap_array, within_bytes,
)

# Kernels used for automatic sigma at small sizes.
SMALL_KERNELS = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625],
                 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}


def hflip(pixels: DataFrame, images: DataFrame) -> DataFrame:
    sized = pixels.join(images.select("image_id", "width"), "image_id")
    return sized.withColumn("x", F.col("width") - 1 - F.col("x")).drop("width")


def vflip(pixels: DataFrame, images: DataFrame) -> DataFrame:
    sized = pixels.join(images.select("image_id", "height"), "image_id")
    return sized.withColumn("y", F.col("height") - 1 - F.col("y")).drop("height")


def _brighter(v: Column, alpha: Column, beta: Column) -> Column:
    value = (v.cast("float") * alpha.cast("float")).cast("float") + beta.cast("float")
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), value.cast("float"))).cast("int")


def brightness(pixels: DataFrame, alpha: float = 1.0, beta: float = 30) -> DataFrame:
    """``v * alpha + beta`` in single precision, clipped to 0..255 and truncated."""
    return pixels.withColumn("v", _brighter(F.col("v"), F.lit(float(alpha)), F.lit(float(beta))))


def gaussian_kernel(size: int, sigma: float = 0.0) -> list[float]:
    """Normalised weights; an even size is raised by one, sigma 0 is derived from the size."""
    if size <= 0:
        raise ValueError("kernel size must be positive")
    size += 1 - size % 2
    if sigma <= 0 and size in SMALL_KERNELS:
        return SMALL_KERNELS[size]
    spread = sigma if sigma > 0 else 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * spread * spread)) for i in range(size)]
    return [r / sum(raw) for r in raw]


def _by_size(pixels: DataFrame, images: DataFrame | None, small: Callable, large: Callable, as_lines: bool, extra: Sequence[str] = ()) -> DataFrame:
    """Images changed whole by ``small``, where they are small, and as lines by ``large``."""
    few, many = whole.split(pixels, images)
    parts = [small(whole.gathered(few))] if few is not None else []
    if many is not None:
        parts.append(large(lines_of(many)).withColumn("vals", F.transform("vals", rounded)))
    columns = [*pixels.columns, *extra]
    shown = [*["vals" if c == "v" else c for c in columns if c != "x"]]
    lines = [p.select(shown) for p in parts]
    out = lines[0] if len(lines) == 1 else lines[0].unionByName(lines[1])
    return out if as_lines else pixels_of(out, columns)


def blur(pixels: DataFrame, kernel_size: int = 5, sigma: float = 0.0, images: DataFrame | None = None, as_lines: bool = False) -> DataFrame:
    """Gaussian blur with mirrored borders, rounded once at the end. Without ``images`` the pixels are read once more for their sizes."""
    kernel = gaussian_kernel(kernel_size, sigma)

    def small(found):
        return whole.changed(found, lambda a: [(None, whole.blurred(a, kernel))])

    return _by_size(pixels, images, small, lambda lines: blur_lines(lines, kernel), as_lines)


def resize(pixels: DataFrame, images: DataFrame, target=None, scale: float | None = None, interpolation: str = "linear", as_lines: bool = False) -> DataFrame:
    """Resize to a given size or by a scale, rounded once at the end; ``interpolation`` is nearest, linear, cubic or area."""
    interpolation_taps(interpolation)
    new_w, new_h = target_size(F.col("width"), F.col("height"), target, scale)
    sizes = images.select("image_id", F.col("height").alias("_h"), new_w.alias("_new_w"), new_h.alias("_new_h"))

    def small(found):
        return whole.changed(found.join(sizes.drop("_h"), "image_id"), lambda a, w, h: [(None, whole.resized(a, w, h, interpolation))], ["_new_w", "_new_h"])

    def large(lines):
        return resize_lines(lines.join(sizes, "image_id"), F.col("_h"), F.col("_new_w"), F.col("_new_h"), interpolation)

    return _by_size(pixels, images, small, large, as_lines)


def by_condition(pixels: DataFrame, images: DataFrame, conditions=CONDITIONS, as_lines: bool = False) -> DataFrame:
    """The pixels under every condition, with a ``condition`` column."""
    condition_array(conditions)  # refuses unknown kinds
    kernels = {tag: gaussian_kernel(size, sigma or 0.0) for tag, _, kind, size, sigma, *_ in conditions if kind == "gaussian_blur"}

    def every(found):
        for tag, _, kind, _, _, alpha, beta in conditions:
            if kind == "gaussian_blur":
                yield tag, whole.blurred(found, kernels[tag])
            elif kind == "brightness":
                yield tag, whole.brighter(found, alpha, beta)
            else:
                yield tag, found[:, ::-1] if kind == "vertical_flip" else found

    def large(lines):
        plain = [c for c in conditions if c[2] != "gaussian_blur"]
        each = lines.join(images.select("image_id", "height"), "image_id").withColumn("_k", F.explode(condition_array(plain)))
        kind, bright = F.col("_k.type"), lambda v: _brighter(v, F.col("_k.alpha"), F.col("_k.beta")).cast("double")
        out = each.select(
            "image_id", F.when(kind == "vertical_flip", F.col("height") - 1 - F.col("y")).otherwise(F.col("y")).cast("int").alias("y"), "c",
            F.when(kind == "brightness", F.transform("vals", bright)).otherwise(F.col("vals")).alias("vals"), F.col("_k.condition").alias("condition"),
        )
        for tag, kernel in kernels.items():
            out = out.unionByName(blur_lines(lines, kernel).withColumn("condition", F.lit(tag)))
        return out

    own = pixels.select("image_id", "y", "x", "c", "v")
    return _by_size(own, images, lambda found: whole.changed(found, every, tag="condition"), large, as_lines, ["condition"])


# The transforms a random chain may use; resize only on request.
CHAIN = ("vertical_flip", "gaussian_blur", "change_brightness")


def augment_plan(images: DataFrame, seed: int, max_transforms: int = 3, include_resize: bool = False) -> DataFrame:
    """Per image an ordered chain of 1..max transforms, drawn from its seeded hash; keys that are no numbers count by their crc32."""
    names = [*CHAIN, "resize"] if include_resize else list(CHAIN)
    most = min(max(1, max_transforms), len(names))
    numeric = isinstance(images.schema["image_id"].dataType, NumericType)
    number = F.col("image_id") if numeric else F.crc32(F.col("image_id").cast("string"))

    def draw(slot: int) -> Column:
        # Later slots read other bits, so chains do not repeat in a fixed cycle. Both factors stay below 2**31, whatever the id.
        low = F.pmod(F.pmod(number, F.lit(2147483648)) + 1, F.lit(2147483648))
        base = low * F.lit((slot + 7) * 1103515245 % 2147483648).cast("bigint") + F.lit(seed * 12345)
        return F.floor(base % F.lit(2147483648) / F.lit(1024))

    entries = F.array_sort(F.array(*[F.struct(draw(i).alias("k"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)]))
    length = (F.lit(1) + draw(len(names)) % most).cast("int")
    return images.select("image_id", F.transform(F.slice(entries, F.lit(1), length), lambda e: e["n"]).alias("chain"))


def apply_plan(
    pixels: DataFrame, images: DataFrame, plan: DataFrame, kernel_size: int = 5, sigma: float = 0.0, alpha: float = 1.0, beta: float = 30, resize_to=None, scale: float | None = None,
    interpolation: str = "linear", as_lines: bool = False,
) -> DataFrame:
    """Run each image's chain. An image taken whole goes through it in one task; scan lines go stage by stage, to the end of the
    longest: one shuffle of lines for a stage that blurs or resizes, none for others, and nothing stored between stages.

    A plan that resizes needs ``resize_to`` or ``scale``, and a plan with any other name is refused: no image may fall between.
    """
    names = F.array(*[F.lit(n) for n in (*CHAIN, "resize")])
    longest, resizes, odd = plan.agg(
        F.coalesce(F.max(F.size("chain")), F.lit(0)), F.coalesce(F.max(F.array_contains("chain", "resize")), F.lit(False)),
        F.max(F.array_join(F.array_except("chain", names), ",")),
    ).first()
    if odd:
        raise ValueError(f"unknown transforms in the plan: {odd}")
    if resizes and resize_to is None and scale is None:
        raise ValueError("the plan resizes images: give resize_to or scale")
    interpolation_taps(interpolation)
    sizes = images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    kernel = gaussian_kernel(kernel_size, sigma)

    def small(found):
        chains = plan.select("image_id", F.coalesce(F.array_join("chain", ">"), F.lit("")).alias("_chain"))

        def run(a, w, h, chain):
            yield None, whole.after_chain(a, chain.split(">"), kernel, (alpha, beta), (w, h), resize_to, scale, interpolation)

        return whole.changed(found.join(sizes, "image_id").join(chains, "image_id"), run, ["_w", "_h", "_chain"])

    def large(lines):
        needs = plan.select(F.posexplode("chain").alias("stage", "op")).groupBy("stage").agg(F.max(F.col("op").isin("gaussian_blur", "resize")).alias("moves"))
        moving = {r["stage"] for r in needs.where("moves").collect()}
        level = (F.lit(float(alpha)), F.lit(float(beta)))
        state = lines.join(sizes, "image_id").join(plan.select("image_id", F.col("chain").alias("_chain")), "image_id")
        for stage in range(longest):
            state = _chain_stage(state, F.get("_chain", F.lit(stage)), stage in moving, kernel, level, resize_to if resizes else None, scale if resizes else None, interpolation)
        return state.drop("_w", "_h", "_chain")

    return _by_size(pixels, images, small, large, as_lines)


def _chain_stage(state: DataFrame, op: Column, moving: bool, kernel: list[float], level, resize_to, scale, interpolation: str) -> DataFrame:
    """One step of every image's chain over lines; images whose step needs no neighbours pass through as they are."""
    y, vals, height = F.col("y"), F.col("vals"), F.col("_h")
    tagged = state.withColumn("_op", F.coalesce(op, F.lit("")))
    kind = F.col("_op")
    flipped = F.when(kind == "vertical_flip", height - 1 - y).otherwise(y).cast("int")
    bright = F.transform(vals, lambda v: _brighter(v, *level).cast("double"))
    if not moving:
        return tagged.withColumns({"y": flipped, "vals": F.when(kind == "change_brightness", bright).otherwise(vals)}).drop("_op")
    sizing = resize_to is not None or scale is not None
    new_w, new_h = target_size(F.col("_w"), height, resize_to, scale) if sizing else (F.col("_w"), height)
    smooth, fit = kernel_taps(kernel), interpolation_taps(interpolation)
    ahead = tagged.withColumns({
        "_new_w": F.when(kind == "resize", new_w).otherwise(F.col("_w")), "_new_h": F.when(kind == "resize", new_h).otherwise(height),
        "y": flipped,
        "vals": F.when(kind == "change_brightness", bright).when(kind == "gaussian_blur", along_x(vals, F.size(vals), smooth))
        .when(kind == "resize", along_x(vals, new_w, fit)).otherwise(vals),
    })
    bands = (
        F.when(kind == "gaussian_blur", kernel_bands(y, len(kernel))).when(kind == "resize", resize_bands(y, height, F.col("_new_h")))
        .otherwise(kernel_bands(y, 1))
    )
    targets = lambda band, places: F.when(kind == "resize", resized_lines(band, F.col("_new_h"))).otherwise(own_lines(band, places))
    taps = lambda at, _, last: (
        F.when(kind == "gaussian_blur", tap_array(smooth(at, height, height))).when(kind == "resize", tap_array(fit(at, height, F.col("_new_h"))))
        .otherwise(tap_array(kernel_taps([1.0])(at, height, height)))
    )
    done = banded(ahead, bands, targets, taps)
    if interpolation == "cubic":
        done = done.withColumn("vals", F.when(kind == "resize", within_bytes(vals)).otherwise(vals))
    steady = done.withColumns({"_w": F.col("_new_w"), "_h": F.col("_new_h"), "vals": F.transform("vals", lambda v: rounded(v).cast("double"))})
    return steady.drop("_op", "_new_w", "_new_h")


def boxes_after_plan(boxes: DataFrame, images: DataFrame, plan: DataFrame, resize_to=None, scale: float | None = None) -> DataFrame:
    """Pixel boxes carried through each image's chain: flipped and resized where the image is; blur and brightness leave them.

    The state (box and image size) is folded over the chain, so any number of steps takes one pass.
    """
    new_size = lambda w, h: target_size(w, h, resize_to, scale)
    state = "struct<x:double,y:double,w:double,h:double,width:int,height:int>"
    sized = boxes.join(images.select("image_id", "width", "height"), "image_id").join(plan, "image_id")

    def step(s: Column, name: Column) -> Column:
        flipped = F.struct(s["x"].alias("x"), (s["height"] - s["y"] - s["h"]).alias("y"), s["w"].alias("w"), s["h"].alias("h"), s["width"].alias("width"), s["height"].alias("height"))
        out = F.when(name == "vertical_flip", flipped.cast(state))
        if resize_to is not None or scale is not None:
            wide, high = new_size(s["width"], s["height"])
            fx, fy = wide / s["width"], high / s["height"]
            grown = F.struct(*[(s[c] * f).alias(c) for c, f in (("x", fx), ("y", fy), ("w", fx), ("h", fy))], wide.cast("int").alias("width"), high.cast("int").alias("height"))
            out = out.when(name == "resize", grown.cast(state))
        else:
            out = out.when(name == "resize", F.raise_error(F.lit("the plan resizes images: give resize_to or scale")).cast(state))
        return out.otherwise(s)

    first = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")], F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    done = sized.withColumn("_box", F.aggregate("chain", first.cast(state), step))
    return done.select(*[F.col(f"_box.{c}").alias(c) if c in ("x", "y", "w", "h") else F.col(c) for c in boxes.columns])


def ground_truth_by_condition(normalised: DataFrame, images: DataFrame, conditions=CONDITIONS, clip: bool = True) -> DataFrame:
    """Pixel boxes under every condition: flipped where the image is, sides clipped to the image."""
    sized = normalised.join(images.select("image_id", "width", "height"), "image_id")
    boxes = center_to_xywh(sized, F.col("width"), F.col("height")).withColumn("_k", F.explode(condition_array(conditions)))
    y = F.when(F.col("_k.type") == "vertical_flip", F.col("height") - F.col("y") - F.col("h")).otherwise(F.col("y"))
    boxes = boxes.withColumns({"y": y, "condition": F.col("_k.condition"), "condition_order": F.col("_k.condition_order")})
    if clip:
        limits = {"x": "width", "y": "height", "w": "width", "h": "height"}
        boxes = boxes.withColumns({
            c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(side).cast("double")) for c, side in limits.items()
        })
    return boxes.drop("_k", "width", "height")
