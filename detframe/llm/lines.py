"""Line dedup: repeated runs of lines by prefix doubling over line numbers; every copy after the first goes.

The texts are one long sequence of line numbers, a document's end being a break. Suffixes are ranked by their first line, then by
2, 4, 8 ... lines, each round from pairs of the ranks before. Suffixes that share a rank are neighbours in the suffix array whose
longest common prefix is that long; a rank held once is dropped. A run is deleted where the same lines stand earlier (smaller
doc_id, then earlier row, then earlier line) and where it has ``MIN_WORDS`` words. Each such run, however long, is the union of
the shortest ones within it that reach ``MIN_WORDS``, which have ``MIN_WORDS`` lines at most; so the doubling ends after
log2(MIN_WORDS) rounds whatever the corpus, and overlapping deletions merge into the maximal runs.

Lines are compared without blanks at their ends; a line without words belongs to the line before it. Words of a line are its parts
between white space of any kind and length; a line of signs that only Unicode counts as blank has one.

Defined cases: null text has no lines and stays null; null doc_ids come first; of equal rows the earlier in the table stays; a
document that loses all its lines is left with an empty text (``dedup``) or goes (``drop_emptied``); an empty table stays empty;
further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detframe.llm.common import stored

MIN_WORDS = 20
BLANKS = " \t\r\x0b\x0c"


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, with signs in front until no column has that name."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def lines_of(rows: DataFrame) -> DataFrame:
    """Lines with words: ``row``, ``doc_id``, ``pos`` (from 0, without gaps), ``words``, ``key``. No shuffle."""
    bare = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    found = rows.select("row", "doc_id", F.posexplode(F.filter(bare, lambda x: x != "")).alias("pos", "line"))
    # one at least, as windows of so many lines as words are enough then
    words = F.greatest(F.regexp_count("line", F.lit(r"(?U)\S+")), F.lit(1))
    return found.select("row", "doc_id", "pos", words.alias("words"), F.unhex(F.md5("line")).alias("key"))


def ranks(pairs: DataFrame, *key: str) -> DataFrame:
    """A number for each key held twice or more, growing in the order of the keys; stored, so that all readers see the same numbers."""
    held = pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select(*key)
    return stored(held.orderBy(*key).select(*key, F.monotonically_increasing_id().alias("rank")), "ranks")


def _reach(words: Column, least: int) -> Column:
    """How many of the words' lines it takes to have ``least`` words; null if all are too few."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    found = F.aggregate(words, start, lambda a, w: F.when(a["sum"] >= least, a).otherwise(F.struct((a["sum"] + w).alias("sum"), (a["n"] + 1).alias("n"))))
    return F.when(found["sum"] >= least, found["n"])


def later_copies(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs that stand earlier too: ``row``, ``start``, ``size`` (lines), each just long enough for ``min_words`` words."""
    numbered = lines.join(ranks(lines, "key"), "key").drop("key")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("row").orderBy("pos"))
    side_by_side = Window.partitionBy("row", "island").orderBy("pos")
    ahead, behind = side_by_side.rowsBetween(0, min_words - 1), side_by_side.rowsBetween(-(min_words - 1), 0)
    level = stored(
        numbered.withColumn("island", island)
        .withColumn("ahead", _reach(F.collect_list("words").over(ahead), min_words))
        .withColumn("behind", _reach(F.reverse(F.collect_list("words").over(behind)), min_words))
        .drop("words"),
        "suffixes",
    )
    runs = None
    length = 1
    while True:
        # rank -1: the suffix shares its first `length` lines with no other
        known = F.coalesce("rank", F.lit(-1).cast("long"))
        seen = level.withColumn("next", F.collect_list(known).over(ahead)).withColumn("before", F.reverse(F.collect_list(known).over(behind)))
        size = F.col("ahead")
        forward = seen.filter((size >= length) & (size < 2 * length)).select(
            "doc_id", "row", F.col("pos").alias("start"), size.alias("size"), F.col("next")[0].alias("a"), F.get("next", size - length).alias("b")
        )
        size = F.col("behind")
        backward = seen.filter((size >= length) & (size < 2 * length)).select(
            "doc_id", "row", (F.col("pos") - size + 1).alias("start"), size.alias("size"), F.get("before", size - 1).alias("a"), F.get("before", F.lit(length - 1)).alias("b")
        )
        own = stored(forward.unionByName(backward).filter("a >= 0 and b >= 0"), "runs")
        runs = own if runs is None else runs.unionByName(own)
        if 2 * length > min_words:
            break
        pairs = level.withColumn("second", F.lead("rank", length).over(side_by_side)).withColumnRenamed("rank", "first")
        named = ranks(pairs.filter("first is not null and second is not null"), "first", "second")
        level = stored(pairs.join(named, ["first", "second"], "left").drop("first", "second"), "suffixes")
        length *= 2
    place = F.struct("doc_id", "row", "start")
    # stored by itself, so that the join's rows of one common run can be split over tasks
    first = stored(runs.groupBy("size", "a", "b").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("held")).filter("held > 1").drop("held"), "first")
    return runs.join(first, ["size", "a", "b"]).filter(place > F.col("earliest")).select("row", "start", "size")


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the given lines (counted among those with words) and the wordless lines that follow them."""
    left, pos, keep = [], -1, True
    for line in text.split("\n"):
        if line.strip(BLANKS):
            pos += 1
            keep = pos not in gone
        if keep:
            left.append(line)
    return "\n".join(left)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, texts without later copies, and ``removed``: maximal runs taken out, as (first line, lines)."""
    row = free_name(docs.columns, "row_number")
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    copies = later_copies(stored(lines_of(kept.select(F.col(row).alias("row"), "doc_id", "text")), "lines"), min_words)
    gone = copies.groupBy("row").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    runs, removed, own = free_name(docs.columns, "runs"), free_name(docs.columns, "removed"), free_name(docs.columns, "own_row")
    joined = kept.join(gone.select(F.col("row").alias(own), F.col("runs").alias(runs)), F.col(row) == F.col(own), "left").drop(own, row)
    place = docs.columns.index("text")
    span = pa.list_(pa.struct([("first", pa.int32()), ("lines", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(place).to_pylist(), []
            for k, own_runs in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                merged = []
                for first, end in sorted((r["start"], r["start"] + r["size"]) for r in own_runs or ()):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([first, end])
                if merged:
                    texts[k] = without_lines(texts[k], {p for first, end in merged for p in range(first, end)})
                spans.append([{"first": a, "lines": b - a} for a, b in merged])
            columns = [*batch.columns[:-1], pa.array(spans, span)]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], removed])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, f"{schema}, `{removed}` array<struct<first: int, lines: int>>")


def drop_emptied(deduped: DataFrame) -> DataFrame:
    """The columns of the documents, without those that lost their whole text."""
    removed = deduped.columns[-1]
    return deduped.filter((F.size(removed) == 0) | F.col("text").rlike(r"\S")).drop(removed)
