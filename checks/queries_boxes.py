"""Scans, decoding, geometry, box pairs and suppression."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from checks.fixtures import NUM_CLASSES
from checks.registry import cte_nms, duck, iou, query, score_text
from detframe.functions import buckets, geometry, scores
from detframe.functions.scoring import batch_score
from detframe.operators import augment, decode, pairs, sampling, suppress
from detframe.session import work_dir
from detframe.sources import labels

BIG = "cast({0} as bigint) {0}"
T20 = "(select cast(unnest(range(20)) as int) i)"


def as_big(df, *names):
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# ---- label text -------------------------------------------------------------

def files(f):
    return f("fx_labels").withColumnRenamed("image_id", "stem")


def parsed(f):
    return labels.parse_labels(f("fx_labels"), NUM_CLASSES)


LINES = (
    "lines as (select image_id, unnest(string_split(label_text, chr(10))) line, "
    "generate_subscripts(string_split(label_text, chr(10)), 1) - 1 pos from fx_labels)"
)
PARTS = "parts as (select image_id, pos, string_split_regex(trim(line), '\\s+') p from lines)"
PARSED = (
    "parsed as materialized (select image_id, pos, cast(cast(p[1] as double) as int) class_id, cast(p[2] as double) cx, "
    "cast(p[3] as double) cy, cast(p[4] as double) w, cast(p[5] as double) h from parts where len(p) >= 5 "
    "and cast(cast(p[1] as double) as int) between 0 and 19)"
)
LABEL_CTES = [LINES, PARTS, PARSED]


@query("scan_labels", duck(
    "select image_id, cast(pos as bigint) pos, cast(class_id as bigint) class_id, cx, cy, w, h from parsed",
    ["fx_labels"], LABEL_CTES, "cx cy w h"))
def _(f):
    return as_big(parsed(f), "pos", "class_id")


def folder_of(f, rows, name: str, suffix: str) -> str:
    """A new folder with one file for each row (``image_id``, ``body``)."""
    folder = f"{work_dir(f.spark)}/detframe/{name}-{uuid.uuid4().hex}"
    system, root = arrow_fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)

    def write(batches):
        here, at = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for image_id, body in zip(*(batch.column(n).to_pylist() for n in ("image_id", "body"))):
                with here.open_output_stream(f"{at}/{image_id}.{suffix}") as out:
                    out.write(body)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows.select("image_id", F.col("body").cast("binary").alias("body")).mapInArrow(write, "n long").agg(F.sum("n")).first()
    return folder


@query("read_label_files", duck(
    "select image_id, cast(pos as bigint) pos, cast(class_id as bigint) class_id, cx, cy, w, h from parsed",
    ["fx_labels"], LABEL_CTES, "cx cy w h"))
def _(f):
    # one file for each image, empty ones included, written to the shared folder and read back
    folder = folder_of(f, f("fx_labels").withColumn("body", F.coalesce("label_text", F.lit(""))), "label-files", "txt")
    files = labels.read_label_files(f.spark, folder).withColumn("image_id", F.col("stem").cast("bigint")).drop("path", "stem")
    return as_big(labels.parse_labels(files, NUM_CLASSES), "pos", "class_id")


@query("read_image_sizes", duck("select image_id, cast(width as bigint) width, cast(height as bigint) height from fx_images", ["fx_images"]))
def _(f):
    # the first bytes of a bitmap hold its sizes, least byte first
    number = lambda c: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(c, 8 * k).bitwiseAND(255)), 2, "0")) for k in range(4)])
    body = F.concat(F.lit(b"BM" + bytes(16)), number(F.col("width")), number(F.col("height")))
    folder = folder_of(f, f("fx_images").withColumn("body", body), "image-files", "bmp")
    sizes = labels.image_sizes(f.spark, folder)
    return as_big(sizes.select(F.col("stem").cast("bigint").alias("image_id"), "width", "height"), "width", "height")


@query("scan_labels_strict", duck(
    "select image_id, cast(pos as bigint) pos, cast(cast(cast(p[1] as double) as int) as bigint) class_id, cast(p[2] as double) cx, "
    "cast(p[3] as double) cy, cast(p[4] as double) w, cast(p[5] as double) h from parts where len(p) >= 5",
    ["fx_labels"], [LINES, PARTS], "cx cy w h"))
def _(f):
    # The one short line this data adds is taken out first; the reader fails on it.
    clean = f("fx_labels").withColumn("label_text", F.regexp_replace("label_text", r"\n1 0\.5(?=\n|$)", "\n"))
    return as_big(labels.parse_labels_strict(clean), "pos", "class_id")


LISTED = [
    "listed as (select image_id, regexp_extract(image_file, '^(.*)[.]', 1) stem from fx_images)",
    "labelled as (select i.image_id label_id, i.stem from listed i where exists "
    "(select 1 from fx_gt g where g.image_id = i.image_id))",
]


def _sides(f):
    stem = F.regexp_extract("image_file", r"^(.*)[.]", 1)
    images = f("fx_images").select("image_id", stem.alias("stem"))
    have = f("fx_gt").select("image_id").distinct()
    return images, images.join(have, "image_id", "left_semi").withColumnRenamed("image_id", "label_id")


@query("index_pairs", duck("select stem, image_id, label_id from listed join labelled using (stem)", ["fx_images", "fx_gt"], LISTED))
def _(f):
    return labels.pair_by_stem(*_sides(f))[0]


@query("missed_labels_count", duck(
    "select count(*) images from listed where stem not in (select stem from labelled)", ["fx_images", "fx_gt"], LISTED))
def _(f):
    return labels.pair_by_stem(*_sides(f))[1].agg(F.count("*").alias("images"))


@query("missing_labels", duck(
    "select stem, image_id from listed where stem not in (select stem from labelled)", ["fx_images", "fx_gt"], LISTED))
def _(f):
    return labels.pair_by_stem(*_sides(f))[1]


@query("class_dim", duck(
    "select cast(row_number() over (order by name) - 1 as bigint) class_id, name class_name from "
    "(select distinct 'class_' || lpad(cast(class_id as string), 2, '0') name from fx_gt)", ["fx_gt"]))
def _(f):
    # The class list as text, one name per line with blank lines between, built from the classes in use.
    name = F.concat(F.lit("class_"), F.lpad(F.col("class_id").cast("string"), 2, "0"))
    names = f("fx_gt").select(name.alias("n")).distinct().agg(F.sort_array(F.collect_list("n")).alias("names"))
    text = names.select(F.array_join("names", "\n\n").alias("label_text"))
    return as_big(labels.class_list(text), "class_id")


@query("image_dims_join", duck(
    "select image_id, cast(pos as bigint) pos, cast(p.class_id as bigint) class_id, cx*640 - (w*640)/2 x, cy*480 - (h*480)/2 y, w*640 w, h*480 h "
    "from parsed p join fx_images i using (image_id)", ["fx_labels", "fx_images"], LABEL_CTES, "x y w h"))
def _(f):
    return as_big(labels.label_boxes(parsed(f), f("fx_images")), "pos", "class_id")


# ---- decoding ---------------------------------------------------------------

RAW_ROW = (
    "select image_id, pos, [cast((x+w/2)/640 as float), cast((y+h/2)/480 as float), cast(w/640 as float), cast(h/480 as float), "
    "cast(score as float)] || list_transform(cs, lambda s: cast(s as float)) v from fx_raw"
)


def raw_rows(f):
    head = [(F.col("x") + F.col("w") / 2) / 640, (F.col("y") + F.col("h") / 2) / 480, F.col("w") / 640, F.col("h") / 480, F.col("score")]
    v = F.concat(F.array(*[h.cast("float") for h in head]), F.col("cs").cast("array<float>"))
    return f("fx_raw").select("image_id", "pos", v.alias("v"))


DECODED = (
    "decoded as materialized (select image_id, pos, list_position(v[6:], list_max(v[6:])) - 1 class_id, "
    "cast(trunc(cast(v[1]*cast(640 as float) as float)) as int) cx, cast(trunc(cast(v[2]*cast(480 as float) as float)) as int) cy, "
    "cast(trunc(cast(v[3]*cast(640 as float) as float)) as int) w, cast(trunc(cast(v[4]*cast(480 as float) as float)) as int) h, "
    "cast(v[5] as double) score from rawrow where len(v) > 5 and v[5] > cast(0.5 as float))"
)


@query("decode_predictions", duck(
    "select image_id, cast(pos as bigint) pos, cast(class_id as bigint) class_id, trunc(cx - w/cast(2 as double)) x, "
    "trunc(cy - h/cast(2 as double)) y, cast(w as double) w, cast(h as double) h, score from decoded",
    ["fx_raw"], [f"rawrow as ({RAW_ROW})", DECODED], "x y w h score"))
def _(f):
    sized = raw_rows(f).join(f("fx_images").select("image_id", "width", "height"), "image_id")
    return as_big(decode.decode_predictions(sized, 0.5).drop("cs"), "pos", "class_id")


@query("flatten_predictions", duck(
    "select image_id, cast(pos % 3 as bigint) layer, cast(row_number() over (partition by image_id, pos % 3 order by pos) - 1 as bigint) entry, "
    "cast(v[1] as double) b0, cast(v[2] as double) b1, cast(v[3] as double) b2, cast(v[4] as double) b3, cast(v[5] as double) objectness, "
    "cast(v[6] as double) first_score, cast(v[25] as double) last_score, cast(25 as bigint) width from rawrow",
    ["fx_raw"], [f"rawrow as ({RAW_ROW})"], "b0 b1 b2 b3 objectness first_score last_score"))
def _(f):
    per_layer = raw_rows(f).groupBy("image_id", (F.col("pos") % 3).alias("layer")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("e"))
    # Three layers per image, each a list of rows.
    at = [F.max(F.when(F.col("layer") == i, F.col("e.v"))) for i in range(3)]
    empty = F.array().cast("array<array<float>>")
    layered = per_layer.groupBy("image_id").agg(F.array(*[F.coalesce(a, empty) for a in at]).alias("layers"))
    flat = decode.flatten_predictions(layered, 25)
    out = flat.withColumns({"first_score": F.get("cs", F.lit(0)), "last_score": F.get("cs", F.lit(19)),
                            "width": F.size("cs").cast("bigint")}).drop("cs")
    return as_big(out, "layer", "entry")


def _arith_model():
    """A scorer made of arithmetic on the image row, in place of a network."""
    import numpy as np
    import pandas as pd

    def run(batch):
        ids = batch["image_id"].to_numpy()
        rows = []
        for pos in range(3):
            base = (ids * 31 + pos * 17) % 100
            cols = [(base + k * 7) % 100 / 100 for k in range(8)]
            values = np.stack(cols, axis=1).astype("float32")
            rows.append(pd.DataFrame({"image_id": ids, "layer": 0, "pos": pos, "v": list(values)}))
        return pd.concat(rows)

    return run


@query("batch_score", duck(
    "select image_id, cast(p.pos as bigint) pos, cast(k.k as bigint) k, cast(cast(((image_id*31+p.pos*17)%100 + k.k*7)%100/cast(100 as double) as float) as double) v "
    "from fx_images, (select unnest(range(3)) pos) p, (select unnest(range(8)) k) k", ["fx_images"], (), "v"))
def _(f):
    out = batch_score(f("fx_images").select("image_id", "width", "height"), _arith_model)
    return as_big(out.select("image_id", "pos", F.posexplode("v").alias("k", "v")), "pos", "k").withColumn("v", F.col("v").cast("double"))


# ---- geometry ---------------------------------------------------------------

NORM = "select image_id, pos, class_id, (x+w/2)/640 cx, (y+h/2)/480 cy, w/640 w, h/480 h from fx_gt"


def norm_boxes(f):
    return f("fx_gt").select(
        "image_id", "pos", "class_id", ((F.col("x") + F.col("w") / 2) / 640).alias("cx"),
        ((F.col("y") + F.col("h") / 2) / 480).alias("cy"), (F.col("w") / 640).alias("w"), (F.col("h") / 480).alias("h"))


@query("gt_pixel_boxes", duck(
    f"select image_id, cast(pos as bigint) pos, cx*640 - w*640/2 x, cy*480 - h*480/2 y, w*640 w, h*480 h from ({NORM})",
    ["fx_gt"], (), "x y w h"))
def _(f):
    sized = norm_boxes(f).drop("class_id").join(f("fx_images").select("image_id", "width", "height"), "image_id")
    return as_big(geometry.center_to_xywh(sized, F.col("width"), F.col("height")).drop("width", "height"), "pos")


@query("gt_norm_boxes", duck(
    f"select image_id, cast(pos as bigint) pos, cx - w/2 x, cy - h/2 y, w, h from ({NORM})", ["fx_gt"], (), "x y w h"))
def _(f):
    return as_big(geometry.center_to_xywh(norm_boxes(f).drop("class_id")), "pos")


CORNERS = "select image_id, pos, class_id, x x1, y y1, x+w x2, y+h y2 from fx_gt"


@query("boxes_xyxy", duck(f"select image_id, cast(pos as bigint) pos, x1, y1, x2, y2 from ({CORNERS})", ["fx_gt"], (), "x1 y1 x2 y2"))
def _(f):
    return as_big(geometry.xywh_to_xyxy(f("fx_gt")).drop("class_id"), "pos")


SAME_POS = "from fx_det d join fx_gt g on d.image_id = g.image_id and d.pos = g.pos"


@query("iou_pairs_xywh", duck(f"select d.image_id, cast(d.pos as bigint) pos, {iou('d.', 'g.')} iou {SAME_POS}", ["fx_det", "fx_gt"], (), "iou"))
def _(f):
    g = f("fx_gt").select("image_id", "pos", *[F.col(c).alias(f"g_{c}") for c in geometry.BOX])
    both = f("fx_det").join(g, ["image_id", "pos"])
    return as_big(both.select("image_id", "pos", geometry.iou_xywh(geometry.box_cols(), geometry.box_cols("g_")).alias("iou")), "pos")


@query("iou_pairs_xyxy", duck(
    f"select image_id, cast(pos as bigint) pos, {iou('d_', 'g_', 'xyxy')} iou from (select d.image_id, d.pos, d.x d_x1, d.y d_y1, "
    f"d.x+d.w d_x2, d.y+d.h d_y2, g.x g_x1, g.y g_y1, g.x+g.w g_x2, g.y+g.h g_y2 {SAME_POS})", ["fx_det", "fx_gt"], (), "iou"))
def _(f):
    names = ("x1", "y1", "x2", "y2")
    a = geometry.xywh_to_xyxy(f("fx_det")).select("image_id", "pos", *[F.col(c).alias(f"d_{c}") for c in names])
    b = geometry.xywh_to_xyxy(f("fx_gt")).select("image_id", "pos", *[F.col(c).alias(f"g_{c}") for c in names])
    value = geometry.iou_xyxy([F.col(f"d_{c}") for c in names], [F.col(f"g_{c}") for c in names])
    return as_big(a.join(b, ["image_id", "pos"]).select("image_id", "pos", value.alias("iou")), "pos")


for axis, column in (("horizontal", "cx"), ("vertical", "cy")):
    other = "cy" if column == "cx" else "cx"
    low, high, side = ("x1", "x2", 640) if column == "cx" else ("y1", "y2", 480)
    rest = ("y1", "y2") if column == "cx" else ("x1", "x2")

    @query(f"box_{axis[0]}flip", duck(
        f"select image_id, cast(pos as bigint) pos, 1 - {column} {column}, {other}, {side} - {high} {low}, {side} - {low} {high}, {rest[0]}, {rest[1]} "
        "from (select image_id, pos, (x+w/2)/640 cx, (y+h/2)/480 cy, x x1, y y1, x+w x2, y+h y2 from fx_gt)",
        ["fx_gt"], (), "cx cy x1 y1 x2 y2"))
    def _(f, axis=axis):
        yolo = geometry.flip_boxes(norm_boxes(f), axis).select("image_id", "pos", "cx", "cy")
        sized = geometry.xywh_to_xyxy(f("fx_gt")).join(f("fx_images").select("image_id", "width", "height"), "image_id")
        corners = geometry.flip_boxes(sized, axis, "xyxy").select("image_id", "pos", "x1", "y1", "x2", "y2")
        return as_big(yolo.join(corners, ["image_id", "pos"]), "pos")


@query("box_resize", duck(
    f"select image_id, cast(pos as bigint) pos, x1*0.5 x1, x2*0.5 x2, y1*0.5 y1, y2*0.5 y2 from ({CORNERS})", ["fx_gt"], (), "x1 y1 x2 y2"))
def _(f):
    sized = geometry.xywh_to_xyxy(f("fx_gt")).join(f("fx_images").select("image_id", "width", "height"), "image_id")
    return as_big(geometry.resize_boxes(sized, scale=0.5, box_format="xyxy").select("image_id", "pos", "x1", "y1", "x2", "y2"), "pos")


# ---- scores and names -------------------------------------------------------

@query("class_name_lookup", duck(
    "select image_id, cast(pos as bigint) pos, cast(d.class_id + d.pos % 3 as bigint) class_id, coalesce(k.class_name, 'unknown') class_name "
    "from fx_det d left join fx_classes k on k.class_id = d.class_id + d.pos % 3", ["fx_det", "fx_classes"]))
def _(f):
    # Some ids are pushed past the end of the class list.
    det = f("fx_det").select("image_id", "pos", (F.col("class_id") + F.col("pos") % 3).alias("class_id"))
    return as_big(scores.add_class_name(det, f("fx_classes")), "pos", "class_id")


@query("combined_confidence", duck(
    "select image_id, cast(pos as bigint) pos, coalesce(cs[class_id + 1], 0) class_score, coalesce(cs[class_id + 1], 0) * score combined from fx_det",
    ["fx_det"], (), "class_score combined"))
def _(f):
    cls, cs = F.col("class_id"), F.col("cs")
    return as_big(f("fx_det").select("image_id", "pos", scores.class_score(cs, cls).alias("class_score"),
                                     scores.combined_confidence(F.col("score"), cs, cls).alias("combined")), "pos")


@query("conform_scores", duck(
    "select image_id, cast(pos as bigint) pos, cast(len(short) as bigint) n_short, list_sum(short) sum_short, cast(25 as bigint) n_long, "
    "list_sum(cs) sum_long, cast(0 as double) last_long from (select *, cs[1:15] short from fx_det)", ["fx_det"], (), "sum_short sum_long last_long"))
def _(f):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    both = f("fx_det").select("image_id", "pos", scores.conform(F.col("cs"), 15).alias("s"), scores.conform(F.col("cs"), 25).alias("l"))
    return as_big(both.select("image_id", "pos", F.size("s").alias("n_short"), total(F.col("s")).alias("sum_short"),
                              F.size("l").alias("n_long"), total(F.col("l")).alias("sum_long"), F.get("l", F.lit(24)).alias("last_long")),
                  "pos", "n_short", "n_long")


for mode, label in (("class_scores", "class"), ("combined", "combined"), ("objectness", "objectness")):

    @query(f"eval_scores_{label}", duck(
        f"select image_id, cast(pos as bigint) pos, cast(k.i as bigint) class_id, sc[k.i + 1] score from "
        f"(select d.image_id, d.pos, {score_text(mode)} sc from fx_det d) z, {T20} k", ["fx_det"], (), "score"))
    def _(f, mode=mode):
        vector = scores.evaluation_vector(F.col("score"), F.col("cs"), F.col("class_id"), NUM_CLASSES, mode)
        return as_big(f("fx_det").select("image_id", "pos", F.posexplode(vector).alias("class_id", "score")), "pos", "class_id")


@query("score_filter", duck("select image_id, cast(pos as bigint) pos, score from fx_raw where score > 0.5", ["fx_raw"], (), "score"))
def _(f):
    return as_big(f("fx_raw").where(scores.above(F.col("score"), 0.5)).select("image_id", "pos", "score"), "pos")


@query("overlay_rows", duck(
    "select image_id, cast(pos as bigint) pos, printf('%s: %.2f', k.class_name, score) label, cast(x as bigint) \"left\", cast(y as bigint) top, "
    "cast(x as bigint) + cast(w as bigint) \"right\", cast(y as bigint) + cast(h as bigint) bottom, greatest(cast(y as bigint) - 10, 20) label_y "
    "from fx_det join fx_classes k using (class_id)", ["fx_det", "fx_classes"]))
def _(f):
    return as_big(decode.overlay_rows(f("fx_det"), f("fx_classes")), "pos", "left", "top", "right", "bottom", "label_y")


@query("clean_names", duck(
    "select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') clean from part"))
def _(f):
    return f.table("part").select("p_partkey", buckets.clean_name(F.col("p_name")).alias("clean"))


@query("parse_class_lists", duck(
    "select image_id, cast(n as bigint) n, first_item from (select image_id, case when image_id % 4 = 3 then 1 when image_id % 4 = 2 then 0 else count(distinct class_id) end n, "
    "case when image_id % 4 = 3 then 'class_' || lpad(cast(min(class_id) as string), 2, '0') when image_id % 4 = 2 then null else "
    "'class_' || lpad(cast(min(class_id) as string), 2, '0') end first_item from fx_gt group by image_id)", ["fx_gt"]))
def _(f):
    # The four spellings a list column takes: JSON, single quotes, blank, one bare name.
    name = F.concat(F.lit("class_"), F.lpad(F.col("class_id").cast("string"), 2, "0"))
    names = f("fx_gt").select("image_id", name.alias("n")).distinct().groupBy("image_id").agg(F.sort_array(F.collect_list("n")).alias("names"))
    kind, json = F.col("image_id") % 4, F.to_json("names")
    text = F.when(kind == 0, json).when(kind == 1, F.translate(json, '"', "'")).when(kind == 2, F.lit(" ")).otherwise(F.get("names", F.lit(0)))
    parsed_list = names.select("image_id", buckets.parse_list(text).alias("items"))
    return parsed_list.select("image_id", F.size("items").cast("bigint").alias("n"), F.get("items", F.lit(0)).alias("first_item"))


@query("json_export", duck(
    "select image_id, cast(to_json(list(distinct class_id order by class_id)) as string) ids from fx_gt group by image_id", ["fx_gt"]))
def _(f):
    from detframe.sources.tables import lists_to_json

    return lists_to_json(f("fx_gt").groupBy("image_id").agg(F.sort_array(F.collect_set("class_id")).alias("ids")))


# ---- pairs and suppression --------------------------------------------------

# All ordered pairs of an image's boxes from its list, so that a relation is read once.
PAIRED = "select image_id, a, unnest(l) b from (select image_id, l, unnest(l) a from (select image_id, list(struct_pack({columns})) l from {table} group by image_id))"


@query("gt_box_pairs", duck(
    f"select image_id, cast(a.pos as bigint) l_pos, cast(b.pos as bigint) r_pos, iou from (select image_id, a, b, {iou('a.', 'b.')} iou from "
    f"({PAIRED.format(columns='pos := pos, x := x, y := y, w := w, h := h', table='fx_gt')}) where a.pos < b.pos) where iou > 0", ["fx_gt"], (), "iou"))
def _(f):
    return as_big(pairs.box_pairs(f("fx_gt")).select("image_id", "l_pos", "r_pos", "iou"), "l_pos", "r_pos")


DUPLICATES = (
    f"select image_id, a.class_id class_id, a.pos l_pos, b.pos r_pos, iou from (select image_id, a, b, {iou('a.', 'b.')} iou from "
    f"({PAIRED.format(columns='pos := pos, class_id := class_id, x := x, y := y, w := w, h := h', table='fx_raw')}) "
    "where a.class_id = b.class_id and a.pos < b.pos) where iou > 0.5"
)


@query("duplicate_pairs", duck(
    f"select image_id, cast(class_id as bigint) class_id, cast(l_pos as bigint) l_pos, cast(r_pos as bigint) r_pos, iou from ({DUPLICATES})",
    ["fx_raw"], (), "iou"))
def _(f):
    out = pairs.duplicate_pairs(f("fx_raw")).select("image_id", "class_id", "l_pos", "r_pos", "iou")
    return as_big(out, "class_id", "l_pos", "r_pos")


@query("best_gt_per_prediction", duck(
    "select d.image_id, cast(d.pos as bigint) pos, cast(b.gt_pos as bigint) gt_pos, b.iou from (select image_id, pos, arg_max(gt_pos, (iou, -gt_pos)) gt_pos, max(iou) iou from "
    f"(select d.image_id, d.pos, g.pos gt_pos, {iou('d.', 'g.')} iou from fx_det d join fx_gt g on d.image_id = g.image_id) "
    "where iou >= 0.5 group by image_id, pos) b join fx_det d on d.image_id = b.image_id and d.pos = b.pos", ["fx_det", "fx_gt"], (), "iou"))
def _(f):
    return as_big(pairs.best_ground_truth(f("fx_det"), f("fx_gt")).select("image_id", "pos", "gt_pos", "iou"), "pos", "gt_pos")


for name, t in (("nms_0_4", 0.4), ("nms_0_5", 0.5)):

    @query(name, duck(
        "select image_id, cast(pos as bigint) pos, cast(class_id as bigint) class_id, x, y, w, h, score from kept",
        ["fx_det"], cte_nms([t]), "x y w h score"))
    def _(f, t=t):
        return as_big(suppress.suppress(f("fx_raw"), t).drop("cs"), "pos", "class_id")


@query("nms_sweep", duck(
    "select t nms_threshold, image_id, cast(pos as bigint) pos, cast(class_id as bigint) class_id, cs[class_id + 1] class_score, cs[class_id + 1] * score combined from kept",
    ["fx_det"], cte_nms(suppress.SWEEP_THRESHOLDS), "nms_threshold class_score combined"))
def _(f):
    swept = suppress.suppress_sweep(f("fx_raw"))
    cs, cls = F.col("cs"), F.col("class_id")
    out = swept.select("nms_threshold", "image_id", "pos", "class_id", scores.class_score(cs, cls).alias("class_score"),
                       scores.combined_confidence(F.col("score"), cs, cls).alias("combined"))
    return as_big(out, "pos", "class_id")


@query("detection_totals", duck("select count(distinct image_id) images, count(*) detections from kept", ["fx_det"], cte_nms([0.4])))
def _(f):
    kept = suppress.suppress(f("fx_raw"), 0.4)
    by_image = kept.groupBy("image_id").agg(F.count("*").alias("n"))
    return by_image.agg(F.count("*").alias("images"), F.sum("n").alias("detections"))


@query("subset_semi", duck(
    "select image_id, cast(pos as bigint) pos from fx_det where image_id in (select image_id from fx_gt)", ["fx_det", "fx_gt"]))
def _(f):
    return as_big(f("fx_det").join(f("fx_gt").select("image_id"), "image_id", "left_semi").select("image_id", "pos"), "pos")


@query("dedup_images", duck(
    "select l_orderkey, min(l_linenumber) l_linenumber from lineitem group by l_orderkey"))
def _(f):
    return sampling.deduplicate(f.table("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("first_n_images", duck("select image_id, image_file from fx_images order by image_file limit 100", ["fx_images"]))
def _(f):
    return f("fx_images").select("image_id", "image_file").orderBy("image_file").limit(100)


@query("model_union", duck(
    "select model, count(*) predictions, sum(score) total from (select 'model1' model, score from fx_raw union all select 'model2', score from fx_raw2) group by model",
    ["fx_raw", "fx_raw2"], (), "total"))
def _(f):
    one, two = (f(n).withColumn("model", F.lit(m)) for n, m in (("fx_raw", "model1"), ("fx_raw2", "model2")))
    return one.unionByName(two).groupBy("model").agg(F.count("*").alias("predictions"), F.sum("score").alias("total"))


# ---- ground truth under conditions -------------------------------------------

@query("gt_by_condition", duck(
    "select c.condition, cast(c.ord as bigint) condition_order, image_id, cast(pos as bigint) pos, least(greatest(px, 0), 640) x, "
    "least(greatest(case when c.condition = 'vertical_flip' then 480 - py - ph else py end, 0), 480) y, least(greatest(pw, 0), 640) w, least(greatest(ph, 0), 480) h from "
    f"(select image_id, pos, cx*640 - w*640/2 px, cy*480 - h*480/2 py, w*640 pw, h*480 ph from ({NORM})), "
    "(values ('original', 0), ('gaussian_blur_k9', 1), ('vertical_flip', 2), ('brightness_increase', 3), ('brightness_decrease', 4)) c(condition, ord)",
    ["fx_gt"], (), "x y w h"))
def _(f):
    out = augment.ground_truth_by_condition(norm_boxes(f), f("fx_images")).drop("class_id")
    return as_big(out, "pos", "condition_order")
