"""Pixels, frames and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.fixtures import HEIGHT, WIDTH, spark_sql  # noqa: F401
from checks.queries_boxes import as_big
from checks.registry import cte_nms, duck, query
from detframe.operators import augment
from detframe.session import work_dir
from detframe.sources import frames as frame_source
from detframe.sources import numbered
from detframe.sources.schemas import FRAME_DETECTIONS, FRAMES
from detframe.streaming import frames as stream

# Pixel images of the fixture are 12 wide and 8 high.
PW, PH = 12, 8


def sizes(f):
    return f("fx_images").select("image_id", F.lit(PW).alias("width"), F.lit(PH).alias("height"))


def lines(pixels, *keys):
    """One text per pixel row, so results stay small to compare; a row is as long as its image is wide."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"].cast("string"))
    return as_big(pixels.groupBy("image_id", *keys, "y", "c").agg(F.array_join(cells, ",").alias("vals")), "y", "c")


def texts(lines, *keys):
    """The same for what comes as lines already."""
    return as_big(lines.select("image_id", *keys, "y", "c", F.array_join(F.col("vals").cast("array<string>"), ",").alias("vals")), "y", "c")


def duck_lines(source: str, keys: str = "") -> str:
    return (
        f"select image_id, {keys} cast(y as bigint) y, cast(c as bigint) c, string_agg(cast(v as string), ',' order by x) vals from ({source}) group by all"
    )


BRIGHT = "cast(trunc(least(cast(255 as float), greatest(cast(0 as float), cast(v as float) * cast({a} as float) + cast({b} as float)))) as int)"


@query("pixels_hflip", duck(duck_lines(f"select image_id, y, {PW} - 1 - x x, c, v from fx_pixels"), ["fx_pixels"]))
def _(f):
    return lines(augment.hflip(f("fx_pixels"), sizes(f)))


@query("pixels_vflip", duck(duck_lines(f"select image_id, {PH} - 1 - y y, x, c, v from fx_pixels"), ["fx_pixels"]))
def _(f):
    return lines(augment.vflip(f("fx_pixels"), sizes(f)))


@query("pixels_brightness", duck(duck_lines(f"select image_id, y, x, c, {BRIGHT.format(a=1.15, b=35)} v from fx_pixels"), ["fx_pixels"]))
def _(f):
    return lines(augment.brightness(f("fx_pixels"), 1.15, 35))


def mirror(i: str, n: int) -> str:
    folded = f"((({i}) % {2 * (n - 1)} + {2 * (n - 1)}) % {2 * (n - 1)})"
    return f"least({folded}, {2 * (n - 1)} - {folded})"


def duck_blur(size: int, source: str = "fx_pixels", tag: str = "b") -> list[str]:
    """Separable blur: each pixel takes its mirrored neighbours along one axis, then along the other."""
    weights = augment.gaussian_kernel(size)
    half = size // 2
    values = ", ".join(f"({k - half}, cast({w!r} as double))" for k, w in enumerate(weights))
    return [
        f"{tag}k(d, wt) as (values {values})",
        f"{tag}x as materialized (select p.image_id, p.y, p.x, p.c, sum(k.wt * q.v) v from {source} p, {tag}k k, {source} q where q.image_id = p.image_id and q.y = p.y and q.c = p.c "
        f"and q.x = {mirror('p.x + k.d', PW)} group by all)",
        f"{tag} as materialized (select p.image_id, p.y, p.x, p.c, cast(floor(round(sum(k.wt * q.v), 9) + 0.5) as int) v from {tag}x p, {tag}k k, {tag}x q where q.image_id = p.image_id and q.x = p.x and q.c = p.c "
        f"and q.y = {mirror('p.y + k.d', PH)} group by all)",
    ]


@query("pixels_blur", duck(duck_lines("select * from b"), ["fx_pixels"], duck_blur(5)))
def _(f):
    return texts(augment.blur(f("fx_pixels"), 5, images=sizes(f), as_lines=True))


def duck_place(i: str, n: int, m: int) -> str:
    return f"least(greatest(({i} + 0.5) * cast({n} as double) / {m} - 0.5, 0), {n - 1})"


# Half size: 6 x 4.
RESIZED = [
    f"gx as (select cast(unnest(range({PW // 2})) as int) nx)", f"gy as (select cast(unnest(range({PH // 2})) as int) ny)",
    f"px as (select nx, cast(floor({duck_place('nx', PW, PW // 2)}) as int) lo, {duck_place('nx', PW, PW // 2)} - floor({duck_place('nx', PW, PW // 2)}) fr from gx)",
    f"py as (select ny, cast(floor({duck_place('ny', PH, PH // 2)}) as int) lo, {duck_place('ny', PH, PH // 2)} - floor({duck_place('ny', PH, PH // 2)}) fr from gy)",
    f"rx as materialized (select a.image_id, a.y, p.nx x, a.c, a.v * (1 - p.fr) + b.v * p.fr v from px p join fx_pixels a on a.x = p.lo join fx_pixels b on b.image_id = a.image_id and b.y = a.y and b.c = a.c and b.x = least(p.lo + 1, {PW - 1}))",
    f"ry as (select a.image_id, p.ny y, a.x, a.c, cast(floor(a.v * (1 - p.fr) + b.v * p.fr + 0.5) as int) v from py p join rx a on a.y = p.lo join rx b on b.image_id = a.image_id and b.x = a.x and b.c = a.c and b.y = least(p.lo + 1, {PH - 1}))",
]


@query("pixels_resize", duck(duck_lines("select * from ry"), ["fx_pixels"], RESIZED))
def _(f):
    return texts(augment.resize(f("fx_pixels"), sizes(f), scale=0.5, as_lines=True))


BY_CONDITION = (
    "select 'original' condition, image_id, y, x, c, v from fx_pixels union all select 'gaussian_blur_k9', image_id, y, x, c, v from b union all "
    f"select 'vertical_flip', image_id, {PH} - 1 - y, x, c, v from fx_pixels union all select 'brightness_increase', image_id, y, x, c, {BRIGHT.format(a=1.15, b=35)} from fx_pixels union all "
    f"select 'brightness_decrease', image_id, y, x, c, {BRIGHT.format(a=0.85, b=-35)} from fx_pixels"
)


@query("pixels_by_condition", duck(duck_lines(BY_CONDITION, "condition,"), ["fx_pixels"], duck_blur(9)))
def _(f):
    return texts(augment.by_condition(f("fx_pixels"), sizes(f), as_lines=True), "condition")


def draw(slot: int) -> str:
    return f"cast(floor((((image_id + 1) * {(slot + 7) * 1103515245} + {7 * 12345}) % 2147483648) / cast(1024 as double)) as bigint)"


PLAN = (
    "plan as materialized (select image_id, list_transform(list_sort([struct_pack(k := " + draw(0) + ", i := 0, n := 'vertical_flip'), struct_pack(k := " + draw(1)
    + ", i := 1, n := 'gaussian_blur'), struct_pack(k := " + draw(2) + ", i := 2, n := 'change_brightness')])[1:1 + " + draw(3) + " % 3], lambda e: e.n) chain from fx_images)"
)


@query("augment_plan", duck("select image_id, array_to_string(chain, '>') chain from plan", ["fx_images"], [PLAN]))
def _(f):
    return augment.augment_plan(f("fx_images"), 7).withColumn("chain", F.array_join("chain", ">"))


def duck_stage(n: int) -> list[str]:
    before = "fx_pixels" if n == 1 else f"st{n - 1}"
    return [
        f"in{n} as materialized (select p.*, coalesce(l.chain[{n}], '') op from {before} p join plan l using (image_id))",
        f"blurme{n} as materialized (select image_id, y, x, c, v from in{n} where op = 'gaussian_blur')",
        *duck_blur(5, f"blurme{n}", f"bl{n}"),
        f"st{n} as materialized (select image_id, y, x, c, v from bl{n} union all select image_id, case when op = 'vertical_flip' then {PH} - 1 - y else y end, x, c, "
        f"case when op = 'change_brightness' then {BRIGHT.format(a=1.0, b=30)} else v end from in{n} where op <> 'gaussian_blur')",
    ]


@query("pixels_augmented", duck(duck_lines("select * from st3"), ["fx_pixels"], [PLAN, *duck_stage(1), *duck_stage(2), *duck_stage(3)]))
def _(f):
    return texts(augment.apply_plan(f("fx_pixels"), sizes(f), augment.augment_plan(f("fx_images"), 7), as_lines=True))


# ---- frames -----------------------------------------------------------------

RATE = 60
NUMBERED = "num as (select row_number() over (order by ts, frame_number) - 1 n, camera_id from fx_frames)"


@query("frames_source", duck("select n frame_number, camera_id from num", ["fx_frames"], [NUMBERED]))
def _(f):
    return frame_source.numbered(f("fx_frames").select(F.col("frame_number").alias("event"), "ts", "camera_id"), "ts", "event").select(
        "frame_number", "camera_id")


@query("frame_sampling", duck(f"select n frame_number, n // {RATE} frame_count, camera_id from num where n % {RATE} = 0", ["fx_frames"], [NUMBERED]))
def _(f):
    plain = f("fx_frames").select(F.col("frame_number").alias("event"), "ts", "camera_id")
    numbered = frame_source.numbered(plain, "ts", "event")
    return frame_source.every_nth(numbered, RATE).select("frame_number", "frame_count", "camera_id")


LOG = (
    "select image_id frame_number, cast(pos as bigint) pos, row_number() over (partition by image_id order by score desc, pos desc) - 1 \"order\", cast(class_id as bigint) class_id, x, y, w, h, score from kept"
)
KEPT_REALS = "x y w h score"


def nested(f):
    """Frames as the detector emits them: one row with its raw boxes, empty where it saw nothing."""
    box = F.struct("pos", "class_id", "x", "y", "w", "h", "score")
    boxes = f("fx_raw").groupBy("image_id").agg(F.collect_list(box).alias("dets"))
    empty = F.array().cast("array<struct<pos:int,class_id:int,x:double,y:double,w:double,h:double,score:double>>")
    return f("fx_images").join(boxes, "image_id", "left").select(F.col("image_id").alias("frame_number"), F.coalesce("dets", empty).alias("dets"))


def frame_folder(f) -> str:
    from detframe.session import materialize

    return materialize(nested(f), "frames").inputFiles()[0].rsplit("/", 1)[0]


def dets_stream(f):
    return frame_source.frame_stream(f.spark, frame_folder(f), FRAME_DETECTIONS)


def event_stream(f):
    source = frame_source.frame_stream(
        f.spark, f.sf_dir, "event_id bigint, ts timestamp, user_id bigint", pathGlobFilter="events.parquet")
    return source.select(F.col("event_id").alias("frame_number"), "ts", F.col("user_id").alias("camera_id"), F.col("event_id").alias("image_id"))


@query("detection_log", duck(LOG.replace("cast(pos as bigint) pos, ", ""), ["fx_det"], cte_nms([0.4]), KEPT_REALS))
def _(f):
    return as_big(stream.detection_log(stream.suppressed_frames(nested(f))), "order", "class_id")


COUNTS = "select i.image_id frame_number, count(k.pos) detections from fx_images i left join kept k using (image_id) group by 1"


@query("frame_detection_counts", duck(COUNTS, ["fx_det", "fx_images"], cte_nms([0.4])))
def _(f):
    return stream.frame_counts(stream.suppressed_frames(nested(f)))


def numbered_events(f, drop_rate=1):
    source = numbered.numbered_stream(f.spark, f"{f.sf_dir}/events.parquet", "event_id bigint, user_id bigint", drop_rate, "event_id")
    return source.select(F.col("event_id").alias("frame_number"), "frame_count", F.col("user_id").alias("camera_id"))


@query("stream_frames", duck("select frame_number, camera_id from fx_frames", ["fx_frames"]))
def _(f):
    return stream.run_to_table(numbered_events(f).drop("frame_count"), "frames")


@query("stream_frame_sampling", duck(
    f"select frame_number, frame_number // {RATE} frame_count, camera_id from fx_frames where frame_number % {RATE} = 0", ["fx_frames"]))
def _(f):
    return stream.run_to_table(numbered_events(f, RATE), "sampled")


@query("stream_nms", duck(COUNTS, ["fx_det", "fx_images"], cte_nms([0.4])))
def _(f):
    return stream.run_to_table(stream.frame_counts(stream.suppressed_frames(dets_stream(f))), "nms")


@query("stream_detection_log", duck(LOG.replace("cast(pos as bigint) pos, ", ""), ["fx_det"], cte_nms([0.4]), KEPT_REALS))
def _(f):
    return as_big(stream.run_log(stream.suppressed_frames(dets_stream(f))), "order", "class_id")


@query("stream_log_replay", duck(LOG.replace("cast(pos as bigint) pos, ", ""), ["fx_det"], cte_nms([0.4]), KEPT_REALS))
def _(f):
    # the same frames again after the state of the stream is lost: nothing is logged twice
    kept, path = stream.suppressed_frames(dets_stream(f)), f"{work_dir(f.spark)}/detframe/logs/{uuid.uuid4().hex}"
    stream.run_log(kept, path=path)
    return as_big(stream.run_log(kept, path=path), "order", "class_id")


@query("stream_frame_total", duck("select count(*) frames from fx_frames", ["fx_frames"]))
def _(f):
    return stream.run_total(event_stream(f))


__all__ = ["FRAMES"]
