"""Label files, class lists and image listings as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from detframe.functions.geometry import center_to_xywh
from detframe.sources.files import PARTITION_BYTES, PARTITION_FILES, ImageHeaders, LabelFiles, read_files


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def read_label_files(spark: SparkSession, folder: str, most_bytes: int = PARTITION_BYTES, most_files: int = PARTITION_FILES) -> DataFrame:
    """One row per label file: ``path, stem, label_text``. An empty file keeps its row; partitions follow bytes and number of files."""
    return read_files(spark, LabelFiles, folder, "*.txt", most_bytes, most_files)


def list_images(spark: SparkSession, folder: str, glob: str = "*.jpg") -> DataFrame:
    """Image paths and stems; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path")
    return files.withColumn("stem", _stem(F.col("path")))


def image_headers(spark: SparkSession, folder: str, glob: str = "*", most_files: int = PARTITION_FILES) -> DataFrame:
    """``path, stem, width, height`` of every matching file by its first bytes; unreadable files have null sizes."""
    return read_files(spark, ImageHeaders, folder, glob, most_files=most_files)


def image_sizes(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Height and width of every readable image; unreadable files are left out (:func:`unreadable_images` counts them)."""
    return image_headers(spark, folder, glob).where("width is not null")


def unreadable_images(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """One row: ``unreadable``, the files of a folder that hold no image."""
    return image_headers(spark, folder, glob).agg(F.count_if(F.col("width").isNull()).alias("unreadable"))


def pair_by_stem(images: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with a label, images without one)."""
    return images.join(labels, "stem"), images.join(labels, "stem", "left_anti")


def _lines(files: DataFrame) -> DataFrame:
    lines = F.split(F.col("label_text"), "\r\n|\r|\n")
    rows = files.select(*[c for c in files.columns if c != "label_text"], F.posexplode(lines).alias("pos", "line"))
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    return rows.withColumn("parts", F.when(bare != "", F.split(bare, r"\s+")).otherwise(F.array().cast("array<string>")))


def parse_labels(files: DataFrame, num_classes: int) -> DataFrame:
    """Label text to one row per box: line position, class and normalised ``cx, cy, w, h``.

    Lines with fewer than five fields and classes out of range are skipped.
    """
    part = [F.get("parts", F.lit(i)) for i in range(5)]
    numbers = [p.cast("double").alias(n) for p, n in zip(part[1:], ("cx", "cy", "w", "h"))]
    keep = [c for c in files.columns if c != "label_text"]
    rows = _lines(files).where(F.size("parts") >= 5)
    # held against the range before it becomes an integer, so that no number is too large
    number = F.when(part[0].cast("double").between(-0.999, num_classes - 0.001), part[0].cast("double")).cast("int")
    boxes = rows.select(*keep, "pos", number.alias("class_id"), *numbers)
    return boxes.where(F.col("class_id").between(0, num_classes - 1))


def parse_labels_strict(files: DataFrame) -> DataFrame:
    """Every non-blank line must hold a class and at least four numbers, and nothing but numbers; anything else fails the job."""
    keep = [c for c in files.columns if c != "label_text"]
    rows = _lines(files).where(F.size("parts") > 0)
    wrong = (F.size("parts") < 5) | F.exists("parts", lambda p: p.try_cast("double").isNull())
    text = F.concat(F.lit("label line without five or more numbers: "), F.col("line"))
    part = [F.when(wrong, F.raise_error(text).cast("string")).otherwise(F.get("parts", F.lit(i))) for i in range(5)]
    numbers = [p.cast("double").alias(n) for p, n in zip(part[1:], ("cx", "cy", "w", "h"))]
    return rows.select(*keep, "pos", part[0].cast("double").cast("int").alias("class_id"), *numbers)


def label_boxes(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Normalised centre boxes to pixel boxes; images of unknown size drop out."""
    sized = boxes.join(images.select("image_id", "width", "height"), "image_id")
    return center_to_xywh(sized, F.col("width"), F.col("height")).drop("width", "height")


def class_list(lines: DataFrame, keep_blank: bool = False) -> DataFrame:
    """Class names from a one-row ``label_text``: position is the id. Blank lines are dropped unless kept."""
    names = F.transform(F.split("label_text", "\r\n|\r|\n"), lambda s: F.trim(s))
    if not keep_blank:
        names = F.filter(names, lambda s: s != "")
    return lines.select(F.posexplode(names).alias("class_id", "class_name"))


def read_classes(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select(F.col("value").alias("label_text"))
    return class_list(text, keep_blank)
