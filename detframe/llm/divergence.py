"""How far the sources of a language differ in their words, over the terms that enough documents hold.

The kept terms are found by iceberg refinement of byte prefixes: documents are counted for each prefix of ``FIRST_LEVEL`` bytes, then
only prefixes that ``LEAST_DOCS`` documents hold are extended to twice the length, and so on. A term that ends within a level is decided there by
its own count; when no longer prefix is left, all kept terms are known. Which prefixes go on is told to the tasks in a bit set of
fixed size (``FILTER_BITS``): a chance hit only lets a prefix be counted that its exact count then drops.

Pairs of sources are compared in blocks of terms and tiles of sources, so a task holds a bounded matrix whatever the table; terms
that no source of a tile holds are added as one product.

Defined cases: null text, lang and source are ''; every row is a document of its own, repeated ids included; a language without
kept terms has pairs of value 0 and no terms; a language with one source has no pairs; an empty table gives no rows; further
columns are left out. Ties follow the bytes of the item.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from detframe.llm.common import byte_texts, column, stored

LEAST_DOCS, TOP_TERMS = 10, 10
FIRST_LEVEL, FILTER_BITS = 4, 1 << 25
#: Bytes of text put into one batch of term lists; terms in a block and sources in a tile of the comparison.
TOGETHER, BLOCK_TERMS, TILE_SOURCES = 8 << 20, 4096, 64
UNIT = 1_000_000_000
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")

#: Terms of a document end to end, with their lengths and counts as 32-bit integers: a row is three byte strings, not thousands of entries.
TERMS = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("terms", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary())])


def document_terms(docs: DataFrame) -> DataFrame:
    """``lang``, ``source`` and, in ascending order, the different terms of each document with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first = byte_texts(column(batch, "text")), 0
            while first < len(texts):
                last, size, made = first, 0, ([], [], [])
                while last < len(texts) and size < TOGETHER:
                    found = Counter(TERM.findall(texts[last].lower()))
                    own = sorted(found)
                    made[0].append(b"".join(own))
                    made[1].append(np.fromiter(map(len, own), "<i4", len(own)).tobytes())
                    made[2].append(np.fromiter(map(found.__getitem__, own), "<i4", len(own)).tobytes())
                    size += len(texts[last])
                    last += 1
                part = batch.slice(first, last - first)
                names = [pa.array(byte_texts(column(part, n)), pa.binary()) for n in ("lang", "source")]
                yield pa.RecordBatch.from_arrays([*names, *(pa.array(x, pa.binary()) for x in made)], schema=TERMS)
                first = last

    return docs.select("text", "lang", "source").mapInArrow(run, "lang binary, source binary, terms binary, sizes binary, counts binary")


def _mark(lang: Column, term: Column) -> Column:
    return F.crc32(F.concat(lang, F.lit(b"\x00"), term)) % FILTER_BITS


def filter_bits(found: DataFrame) -> np.ndarray:
    """The bit set of ``found`` (``lang``, ``term``); at most FILTER_BITS / 64 rows of two numbers reach the driver."""
    marks = found.select(_mark(F.col("lang"), F.col("term")).alias("mark"))
    words = marks.groupBy(F.shiftright("mark", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(mark % 64 as int))) as bits"))
    made, rows = np.zeros(FILTER_BITS // 64, np.uint64), words.toArrow()
    made[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return made


def _joined(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column end to end, and how many each row has."""
    values = column(batch, name)
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8), np.diff(ends)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Document number, length and bytes of every term of a batch."""
    data, _ = _joined(batch, "terms")
    packed, held = _joined(batch, "sizes")
    sizes = packed.view(np.int32)
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
    terms = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return np.repeat(np.arange(len(held)), held // 4), sizes, terms


def _codes(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Different values, and the place of each value among them."""
    found = values.dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64)


def _held(bits: np.ndarray, langs: pa.Array, lang: np.ndarray, term: pa.Array) -> np.ndarray:
    """Which terms of which languages (places in ``langs``) are in the bit set: each different one is looked up once a batch."""
    terms, code = _codes(term)
    pairs, place = _codes(pa.array(lang * len(terms) + code))
    begun = [zlib.crc32(x + b"\x00") for x in langs.to_pylist()]
    first, second = np.divmod(pairs.to_numpy(), max(1, len(terms)))
    words = terms.take(pa.array(second)).to_pylist()
    marks = np.fromiter((zlib.crc32(w, begun[x]) % (64 * len(bits)) for x, w in zip(first.tolist(), words)), np.int64, len(words))
    return ((bits[marks >> 6] >> (marks & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)[place]


def prefix_counts(terms: DataFrame, level: int, bits=None) -> DataFrame:
    """Documents for each ``lang``, ``term`` (cut to ``level`` bytes) and ``ended`` (the term is no longer than that).

    ``bits`` holds the prefixes of half the length that go on; shorter terms were decided there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, sizes, term = _flat(batch)
            langs, own = _codes(column(batch, "lang"))
            if bits is not None:
                longer = np.flatnonzero(sizes > level // 2)
                owner, sizes, term = owner[longer], sizes[longer], term.take(pa.array(longer))
                goes_on = np.flatnonzero(_held(bits.value, langs, own[owner], pc.binary_slice(term, 0, level // 2)))
                owner, sizes, term = owner[goes_on], sizes[goes_on], term.take(pa.array(goes_on))
            if not len(sizes):
                continue
            keys, code = _codes(pc.binary_slice(term, 0, level))
            full = (own[owner] * len(keys) + code) * 2 + (sizes <= level)
            # terms of a document ascend, so equal prefixes are neighbours and one of them counts
            first = np.concatenate([[True], (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])])
            met = pa.array(full[first]).value_counts()
            pair, ended = np.divmod(met.field("values").to_numpy(), 2)
            yield pa.RecordBatch.from_arrays([
                langs.take(pa.array(pair // len(keys))), keys.take(pa.array(pair % len(keys))), pa.array(ended == 1), met.field("counts").cast(pa.int64()),
            ], ["lang", "term", "ended", "docs"])

    counted = terms.select("lang", "terms", "sizes").mapInArrow(run, "lang binary, term binary, ended boolean, docs long")
    return counted.groupBy("lang", "term", "ended").agg(F.sum("docs").alias("docs"))


def kept_terms(terms: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang`` and ``term`` of every term that at least ``least`` documents of the language hold."""
    context = terms.sparkSession.sparkContext
    level, bits, kept = FIRST_LEVEL, None, None
    while True:
        alive = stored(prefix_counts(terms, level, bits).filter(F.col("docs") >= least), "prefixes")
        ended = alive.filter("ended").select("lang", "term")
        kept = ended if kept is None else kept.unionByName(ended)
        longer = alive.filter("not ended")
        if longer.isEmpty():
            return kept
        bits = context.broadcast(filter_bits(longer))
        level *= 2


def group_counts(terms: DataFrame, kept: DataFrame) -> DataFrame:
    """Occurrences ``n`` of the kept terms in each ``lang`` and ``source``; groups without any are not listed."""
    bits = terms.sparkSession.sparkContext.broadcast(filter_bits(kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, _, term = _flat(batch)
            counts = _joined(batch, "counts")[0].view(np.int32)
            langs, lang = _codes(column(batch, "lang"))
            sources, source = _codes(column(batch, "source"))
            held = np.flatnonzero(_held(bits.value, langs, lang[owner], term))
            owner, counts = owner[held], counts[held]
            terms_met, code = _codes(term.take(pa.array(held)))
            full = (lang[owner] * len(sources) + source[owner]) * len(terms_met) + code
            summed = pa.table({"full": full, "n": counts.astype(np.int64)}).group_by("full").aggregate([("n", "sum")])
            group, place = np.divmod(summed["full"].to_numpy(), max(1, len(terms_met)))
            yield pa.RecordBatch.from_arrays([
                langs.take(pa.array(group // len(sources))), sources.take(pa.array(group % len(sources))), terms_met.take(pa.array(place)),
                summed["n_sum"].combine_chunks(),
            ], ["lang", "source", "term", "n"])

    counted = terms.mapInArrow(run, "lang binary, source binary, term binary, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return counted.join(kept, ["lang", "term"])


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, also of decimals."""
    return F.call_function("div", a, b)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), exact for any count."""
    wide = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    return _div(wide, (total + 2 * terms).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _pair_sums(table: pa.Table, width: int) -> pa.Table:
    """Sums over the terms of a block for each pair of sources of two tiles, and how many terms any of them holds."""
    lang, left, right = table.column("lang")[0], table.column("left")[0].as_py(), table.column("right")[0].as_py()
    member, term, share = (table.column(n).to_numpy() for n in ("member", "code", "p"))
    mark = term < 0
    order = np.argsort(member[mark], kind="stable")
    members, absent = member[mark][order], share[mark][order]
    codes, place = np.unique(term[~mark], return_inverse=True)
    made = np.repeat(absent[:, None], len(codes), 1)
    made[np.searchsorted(members, member[~mark]), place] = share[~mark]
    tile = members // width
    out: list[tuple[int, int, int]] = []
    for k in np.flatnonzero(tile == left):
        others = np.flatnonzero((tile == right) & (members > members[k]))
        if others.size:
            p, q = made[k][None, :], made[others]
            out += zip([members[k]] * others.size, members[others], ((p - q) ** 2 // (p + q)).sum(1))
    a, b, value = (np.array(x, np.int64) for x in (zip(*out) if out else ((), (), ())))
    return pa.table({"lang": pa.array([lang.as_py()] * len(a), pa.binary()), "a": a, "b": b, "value": value, "present": np.full(len(a), len(codes), np.int64)})


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: all other sources of the language, and the terms a source holds more of than its language."""
    terms = stored(document_terms(docs), "terms")
    kept = stored(kept_terms(terms, least), "kept")
    counts = stored(group_counts(terms, kept), "counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = terms.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "v"])
    member = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stored(every.withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(F.lit(1)).cast("long")).withColumn("member", member.cast("long")), "groups")
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "member", "term", "n", "v", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"))

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n")).join(groups.groupBy("lang").agg(F.sum("total").alias("all_total"), F.max("v").alias("v")), "lang")
    usual = whole.select("lang", "term", _share(F.col("all_n"), F.col("all_total"), F.col("v")).alias("q"))
    marked = shares.join(usual, ["lang", "term"]).filter("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = marked.withColumn("rank", rank).filter(F.col("rank") <= top)

    # a block of terms and two tiles of sources meet in one group
    blocks = max(1, -(-(sizes.agg(F.max("v")).first()[0] or 0) // BLOCK_TERMS))
    tiles = -(-((groups.agg(F.max("member")).first()[0] or 0) + 1) // TILE_SOURCES)
    # a term's number tells it apart within its block: the rank of its bytes among the block's terms
    numbered = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    numbered = numbered.withColumn("code", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")).cast("long"))
    cells = shares.join(numbered, ["lang", "term"]).select("lang", "member", "block", "code", "p")
    empty = groups.select("lang", "member", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).cast("long").alias("code"), F.col("p0").alias("p"))
    own = F.floor(F.col("member") / TILE_SOURCES).cast("int")
    met = cells.unionByName(empty).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = met.select("lang", "member", "block", "code", "p", F.least(own, "other").alias("left"), F.greatest(own, "other").alias("right"))
    width = TILE_SOURCES
    summed = met.groupBy("lang", "left", "right", "block").applyInArrow(lambda t: _pair_sums(t, width), "lang binary, a long, b long, value long, present long")
    sums = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    side = lambda name: groups.select("lang", F.col("member").alias(name), F.col("source").alias(f"{name}_source"), F.col("p0").alias(f"{name}_p0"))
    both = sums.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).join(sizes, "lang", "left").fillna(0, ["v"])
    value = F.col("value") + (F.col("v") - F.col("present")) * _gap(F.col("a_p0"), F.col("b_p0"))
    ends = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    pairs = both.select("lang", value.alias("value"), ends.alias("e")).select("lang", "e.source", "e.item", "value").withColumn("rank", rank)

    shaped = lambda df, part: df.select(
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.lit(part).alias("part"),
        F.col("item").cast("string").alias("item"), F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"),
    )
    return shaped(pairs, "pair").unionByName(shaped(best, "term"))
