"""Detection relations derived from the driver tables, for tests, queries and the bench.

The driver tables hold no boxes, so boxes come from ``lineitem`` (an image is
four consecutive order keys), frames from ``events`` and pixels from the
images. The SQL text is the same for Spark and DuckDB but for two phrases.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from detframe.session import bucketed, work_dir

NUM_CLASSES = 20
WIDTH, HEIGHT = 640, 480
# Images whose pixels make a partition: some hundred MB where their rows are sorted.
PIXEL_IMAGES = 4_096

_SCORES = "(case when i=class_id then 500+px%500 else (px+i*37)%100 end)/cast(1000 as double)"
SPARK = {
    "CS": f"transform(sequence(0,19), i -> {_SCORES})",
    "AGG": "listagg(line, chr(10)) within group (order by pos)",
}
DUCK = {
    "CS": f"list_transform(range(20), lambda i: {_SCORES})",
    "AGG": "string_agg(line, chr(10) order by pos)",
}

_RAW = """select image_id, pos, class_id, x, y, w, h, score, {CS} cs from (
  select image_id, pos, px, cast(case when px%7=0 then (sk+1)%20 else sk%20 end as int) class_id,
    cast((pk*37)%300+(px%11)*4 as double) x, cast((sk*53+pk*11)%300+(px%13)*3 as double) y,
    cast(40+q*2 as double) w, cast(40+px%100 as double) h, <<SCORE>>/cast(1000 as double) score
  from fx_base where px%3<>0 and image_id%10<>3) z"""

SQL = {
    "fx_base": """select cast(floor(l_orderkey/4) as bigint) image_id,
  cast(row_number() over (partition by cast(floor(l_orderkey/4) as bigint)
       order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as int) pos,
  l_partkey pk, l_suppkey sk, cast(l_quantity as bigint) q, cast(round(l_extendedprice*100) as bigint) px
from lineitem""",
    "fx_images": """select distinct image_id, concat('img_', lpad(cast(image_id as string), 8, '0'), '.jpg') image_file,
  cast(640 as int) width, cast(480 as int) height
from fx_base""",
    "fx_gt": """select image_id, pos, cast(sk%20 as int) class_id,
  cast((pk*37)%300 as double) x, cast((sk*53+pk*11)%300 as double) y,
  cast(40+q*2 as double) w, cast(40+px%100 as double) h
from fx_base where px%5<>0 and pos < (image_id*7919)%26""",
    "fx_raw": _RAW.replace("<<SCORE>>", "(px%1000)"),
    "fx_raw2": _RAW.replace("<<SCORE>>", "((px*7)%1000)"),
    "fx_det": "select * from fx_raw where score > cast(0.5 as double)",
    "fx_labels": """select i.image_id, concat(
    coalesce(t.body, ''),
    case when i.image_id%11=0 then chr(10) || '1 0.5' else '' end,
    case when i.image_id%13=0 then chr(10) || '25 0.500 0.500 0.100 0.100' else '' end) label_text
from fx_images i left join (
  select image_id, {AGG} body from (
    select image_id, pos, concat_ws(' ', cast(class_id as string),
      '0.' || lpad(cast(least(999, cast(floor((x+w/2)*1000/640) as int)) as string), 3, '0'),
      '0.' || lpad(cast(least(999, cast(floor((y+h/2)*1000/480) as int)) as string), 3, '0'),
      '0.' || lpad(cast(cast(floor(w*1000/640) as int) as string), 3, '0'),
      '0.' || lpad(cast(cast(floor(h*1000/480) as int) as string), 3, '0')) line
    from fx_gt) u group by image_id) t on i.image_id = t.image_id""",
    "fx_frames": "select event_id frame_number, ts, user_id camera_id, event_id image_id from events",
    "fx_pixels": """select i.image_id, cast(y.v as int) y, cast(x.v as int) x, cast(c.v as int) c,
  cast((i.image_id*7 + y.v*13 + x.v*29 + c.v*53) % 256 as int) v
from fx_images i
cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) y(v)
cross join (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) x(v)
cross join (values (0),(1),(2)) c(v)""",
    "fx_classes": "select cast(i as int) class_id, concat('class_', lpad(cast(i as string), 2, '0')) class_name from <<RANGE>>",
}
NEEDS = {
    "fx_base": [], "fx_images": ["fx_base"], "fx_gt": ["fx_base"], "fx_raw": ["fx_base"], "fx_raw2": ["fx_base"],
    "fx_det": ["fx_raw"], "fx_labels": ["fx_images", "fx_gt"], "fx_frames": [], "fx_pixels": ["fx_images"], "fx_classes": [],
}

# Boxes are stored once, bucketed by image as a user's would be, and the relations that only rename them are read through.
BY_IMAGE = ("fx_base", "fx_images")
VIEWS = ("fx_gt", "fx_raw", "fx_raw2", "fx_det")


def duck_sql(name: str) -> str:
    text = SQL[name].replace("{CS}", DUCK["CS"]).replace("{AGG}", DUCK["AGG"])
    return text.replace("<<RANGE>>", "(select unnest(range(20)) i)")


def spark_sql(name: str) -> str:
    text = SQL[name].replace("{CS}", SPARK["CS"]).replace("{AGG}", SPARK["AGG"])
    return text.replace("<<RANGE>>", "(select explode(sequence(0, 19)) i)")


def with_clause(*names: str) -> list[str]:
    """DuckDB ``name as (...)`` items for the relations and all they need, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    # A relation read more than once is computed once.
    return [f"{n} as materialized ({duck_sql(n)})" for n in ordered]


class Fixtures:
    """Derived relations of one data folder; those that are stored are written once to the shared folder and then scanned."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name == "fx_classes":
            return self.spark.sql(spark_sql(name))
        if name == "fx_pixels":
            return self._pixels()
        if name in VIEWS:
            return self._build(name)
        tag = hashlib.sha256(self.sf_dir.encode()).hexdigest()[:12]
        root = work_dir(self.spark)
        path = f"{root}/detframe/{self.spark.sparkContext.applicationId}/fixtures-{tag}/{name}"
        if name in BY_IMAGE:
            table = f"{name}_{tag}"
            if not self.spark.catalog.tableExists(table):
                bucketed(self._build(name), table, path, "image_id")
            return self.spark.table(table)
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        fs = jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(jvm_path):
            self._build(name).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _pixels(self) -> DataFrame:
        """Pixels are made where they are read, with those of an image in one partition: 288 rows follow from one row of an image."""
        images = self("fx_images")
        parts = images.count() // PIXEL_IMAGES + 1
        text = spark_sql("fx_pixels").replace("from fx_images", "from {fx_images}")
        return self.spark.sql(text, fx_images=images.repartition(parts, "image_id"))

    def _build(self, name: str) -> DataFrame:
        text = spark_sql(name)
        inputs = {need: self(need) for need in NEEDS[name]}
        for base in ("lineitem", "events"):
            if f"from {base}" in text:
                inputs[base] = self.table(base)
        if name == "fx_base":  # dealt as the buckets are, so that the window needs no other shuffle
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            inputs["lineitem"] = inputs["lineitem"].repartition(parts, F.expr("cast(floor(l_orderkey/4) as bigint)"))
        for need in inputs:
            text = text.replace(f"from {need}", f"from {{{need}}}").replace(f"join {need}", f"join {{{need}}}")
        return self.spark.sql(text, **inputs)


def fx(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir)


__all__ = ["DUCK", "F", "Fixtures", "HEIGHT", "NUM_CLASSES", "SPARK", "SQL", "WIDTH", "duck_sql", "fx", "with_clause"]
