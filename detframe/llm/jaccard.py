"""Jaccard join of word n-gram sets by chosen paths.

A run gives every set ``x`` the tokens whose hash, under the run's own function, falls below 1 / (threshold * |x|): about
1 / threshold of them, and two sets at the threshold share one with a chance of 1 - 1/e at least. Sets that chose a token meet in
its bucket. A bucket above ``BUCKET`` sets is split again by tokens that are chosen under a function of the path so far; small
ones are compared. Runs are repeated until a pair at the threshold is missed with a chance below 1 - ``RECALL``.

Texts with equal sets are one node from the start. In a bucket, sets are compared by one-permutation sketches with leaders: what is
very like a leader need not lead itself, and everything at all like it (``LOOSE``) is tied to it. The ties only say which sets to
hold against each other: within a group of ties every pair is compared exactly, in tiles of ``TILE`` sets, and counted where it
stands; no list of pairs is written. So a pair is found if any chain of ties joins it, not only if it met in a bucket.

A bucket that stays large after the last split (many near copies) is worked on in random blocks. The leaders of the blocks go on to
the next round; when they no longer get fewer, they are compared tile by tile.

Defined cases: null and wordless texts have no set, hence no links and a class of their own; a text of fewer words than an n-gram
is one n-gram; rows with null doc_ids take part, and a class without any id has a null id; further columns are left out (``links``)
or kept (``keep_first``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import byte_texts, column, rows, stored
from detframe.llm.components import components
from detframe.llm.lines import free_name

WORDS, THRESHOLD = 5, 0.8
RECALL = 0.999999
BUCKET, TILE, BINS = 2048, 2048, 128
LOOSE, TIGHT = 0.35, 0.75
#: Wanted texts up to which they are sent to all tasks (32 bytes each); beyond it both sides are shuffled.
SENT_TEXTS = 1_000_000
KEPT_WORDS = 500_000

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def runs_needed(recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold was missed by all with a chance below 1 - recall."""
    return math.ceil(math.log(1 - recall) / -1.0)


def mixed(values: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hashes of values under functions given by seeds; both broadcast."""
    x = (values ^ (seeds * np.uint64(0x94D049BB133111EB))) * _MIX
    x ^= x >> np.uint64(31)
    x *= _STEP
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_known = _Words()


def tokens_of(text: bytes) -> np.ndarray:
    """Sorted hashes of the different word n-grams of a text, lower case for A-Z."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    found = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        found = found * _STEP + hashes[k : k + n]
    return np.unique(mixed(found, np.uint64(1)))


def sketch_of(tokens: np.ndarray) -> bytes:
    """For each of ``BINS`` ranges of hashes a byte of the smallest one there, 0 where there is none."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
    first = np.searchsorted(tokens, edges)
    low = tokens[np.minimum(first, tokens.size - 1)]
    held = (first < tokens.size) & (low >> np.uint64(57) == np.arange(BINS, dtype=np.uint64))
    return np.where(held, 1 + (low & np.uint64(0xFFFF)) % np.uint64(255), 0).astype(np.uint8).tobytes()


def chosen(tokens: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens each function chooses, as (function, token) pairs in order; long sets are read in stretches."""
    limit = np.uint64(min(2**64 - 1, int(2**64 / (THRESHOLD * tokens.size))))
    parts = []
    for k in range(0, tokens.size, 16_384):
        part = tokens[k : k + 16_384]
        which, place = np.nonzero(mixed(part[None], seeds[:, None]) < limit)
        parts.append((which, part[place]))
    which, found = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.argsort(which, kind="stable")
    return which[order], found[order]


def paths_of(tokens: np.ndarray, runs: int) -> tuple[list[int], list[list[int]]]:
    """Bucket keys of the first split, and for each of them those of the second."""
    seeds = np.arange(2, 2 + runs, dtype=np.uint64)
    run, first = chosen(tokens, seeds)
    keys = mixed(first, seeds[run] + np.uint64(1000))
    if not keys.size:
        return [], []
    parent, second = chosen(tokens, keys)
    below = mixed(second, keys[parent] + np.uint64(1)).view(np.int64)
    return keys.view(np.int64).tolist(), [x.tolist() for x in np.split(below, np.searchsorted(parent, np.arange(1, keys.size)))]


SETS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.binary()), ("sketch", pa.binary()),
    ("keys", pa.list_(pa.int64())), ("deeper", pa.list_(pa.list_(pa.int64()))),
])


def token_sets(docs: DataFrame, runs: int) -> DataFrame:
    """Stored: for each row the hash of its set (``node``; null: no words), its sketch and its paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {name: [] for name in ("node", "sketch", "keys", "deeper")}
            for text in byte_texts(column(batch, "text")):
                tokens = tokens_of(text)
                if tokens.size:
                    keys, deeper = paths_of(tokens, runs)
                    values = (xxhash.xxh3_128_digest(tokens.tobytes()), sketch_of(tokens), keys, deeper)
                else:
                    values = (None, None, [], [])
                for name, value in zip(out, values):
                    out[name].append(value)
            same = {name: column(batch, name).to_pylist() for name in ("row", "doc_id", "text_hash")}
            yield rows(SETS, **same, **out)

    return stored(docs.select("row", "doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        run, "row long, doc_id long, text_hash long, node binary, sketch binary, keys array<long>, deeper array<array<long>>"
    ), "sets")


def likeness(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    either = np.count_nonzero(one | others, axis=1)
    return np.count_nonzero((one == others) & (one > 0), axis=1) / np.maximum(either, 1)


def led(sketches: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Leaders of a bucket, and for each set the first set of all that ties lead to.

    What the ties join is joined by one tie for each set, so a bucket never has more of them than sets.
    """
    free, leaders, root = np.ones(len(sketches), bool), [], np.arange(len(sketches))
    for k in range(len(sketches)):
        if free[k]:
            leaders.append(k)
            like = likeness(sketches[k], sketches)
            free[like >= TIGHT] = False
            met = np.unique(root[(like >= LOOSE) | (np.arange(len(root)) == k)])
            root[np.isin(root, met)] = met[0]
    return leaders, root


TIES = pa.schema([("key", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def compare(records: DataFrame) -> DataFrame:
    """Ties (``a``, ``b``) of all groups of (``key``, ``block``), fewer than sets; a leader also comes with ``b`` null. A task holds one group at a time."""

    def ties_of(key, nodes, sketches):
        unique, first = np.unique(np.array(nodes, "S16"), return_index=True)
        nodes = [nodes[k] for k in first]
        if len(nodes) < 2:
            return rows(TIES, key=[key] * len(nodes), a=nodes, b=[None] * len(nodes))
        leaders, root = led(np.stack([np.frombuffer(sketches[k], np.uint8) for k in first]))
        tied = np.flatnonzero(root != np.arange(len(root))).tolist()
        a = [nodes[root[x]] for x in tied] + [nodes[x] for x in leaders]
        return rows(TIES, key=[key] * len(a), a=a, b=[nodes[x] for x in tied] + [None] * len(leaders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, nodes, sketches = None, [], []
        for batch in batches:
            for key, block, node, sketch in zip(*(column(batch, n).to_pylist() for n in ("key", "block", "node", "sketch"))):
                if (key, block) != current and nodes:
                    yield ties_of(current[0], nodes, sketches)
                    nodes, sketches = [], []
                current = (key, block)
                nodes.append(node)
                sketches.append(sketch)
        if nodes:
            yield ties_of(current[0], nodes, sketches)

    dealt = records.select("key", "block", "node", "sketch").repartition("key", "block").sortWithinPartitions("key", "block", "node")
    return dealt.mapInArrow(run, "key long, a binary, b binary")


def buckets(records: DataFrame) -> DataFrame:
    """Records (``key``, ``node``) of buckets with two sets or more, with the bucket's size."""
    sizes = stored(records.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "sizes")
    return records.join(sizes, "key")


def ties(nodes: DataFrame) -> DataFrame:
    """Stored ties of all buckets."""
    first = stored(buckets(nodes.select("node", F.explode(F.arrays_zip("keys", "deeper")).alias("p")).select("node", F.col("p.keys").alias("key"), F.col("p.deeper").alias("deeper"))), "buckets")
    sketches = nodes.select("node", "sketch")
    small = first.filter(F.col("size") <= BUCKET).select("key", "node", F.lit(0).alias("block"))
    split = stored(buckets(first.filter(F.col("size") > BUCKET).select("node", F.explode("deeper").alias("key"))), "buckets")
    small = small.unionByName(split.filter(F.col("size") <= BUCKET).select("key", "node", F.lit(0).alias("block")))
    found = stored(compare(small.join(sketches, "node")).filter("b is not null").select("a", "b"), "ties")
    large, turn = split.filter(F.col("size") > BUCKET).select("key", "node", "size"), 0
    while not large.isEmpty():
        # random blocks of a large bucket; what leads a block goes on, other blocks' leaders with it
        block = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("size") / BUCKET)).cast("int")
        now = stored(compare(large.select("key", "node", block.alias("block")).join(sketches, "node")), "ties")
        left = stored(buckets(now.filter("b is null").select("key", F.col("a").alias("node"))), "leaders")
        last = compare(left.filter(F.col("size") <= BUCKET).select("key", "node", F.lit(0).alias("block")).join(sketches, "node"))
        found = found.unionByName(now.filter("b is not null").select("a", "b")).unionByName(stored(last.filter("b is not null").select("a", "b"), "ties"))
        more = left.filter(F.col("size") > BUCKET).select("key", "node", "size")
        if more.count() > 0.7 * large.count():  # they hardly get fewer: every two blocks of a bucket meet in a tile
            blocks = F.ceil(2 * F.col("size") / BUCKET).cast("int")
            tiles = more.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            tile = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
            rest = compare(tiles.select("key", "node", tile.alias("block")).join(sketches, "node"))
            return found.unionByName(stored(rest.filter("b is not null").select("a", "b"), "ties"))
        large, turn = more, turn + 1
    return found


EXACT = pa.schema([("node", pa.binary()), ("n_links", pa.int64()), ("root", pa.binary())])


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """Tokens in common of each set on the left with each on the right; all their tokens are in ``known`` (sorted)."""
    counts = np.zeros((len(left), len(right)), np.float32)
    sizes = np.array([x.size for x in left + right])
    number = np.searchsorted(known, np.concatenate(left + right))
    owner = np.repeat(np.arange(sizes.size), sizes)
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    width = 2048
    for begin in range(0, known.size, width):
        a, b = np.searchsorted(number, [begin, begin + width])
        part = np.zeros((sizes.size, min(width, known.size - begin)), np.float32)
        part[owner[a:b], number[a:b] - begin] = 1
        counts += part[: len(left)] @ part[len(left) :].T
    return counts


def tile_links(nodes: list[bytes], tokens: list[np.ndarray], sides: list[int]) -> pa.RecordBatch:
    """Links of each set of a tile within it, and the smallest node its links lead to. Sides 0 and 1: only pairs across count; all 0: all pairs."""
    sizes = np.array([x.size for x in tokens], np.float32)
    known, times = np.unique(np.concatenate(tokens), return_counts=True)
    known = known[times > 1]  # a token of one set alone is shared with none
    tokens = [x[np.isin(x, known, assume_unique=True)] for x in tokens]
    side = np.array(sides)
    n = len(nodes)
    linked = np.zeros((n, n), bool)
    for begin in range(0, n, 512):
        end = min(n, begin + 512)
        common = shared_counts(tokens[begin:end], tokens, known)
        # J >= 4/5 as integers: 5 * common >= 4 * union
        linked[begin:end] = 10 * common >= 10 * THRESHOLD * (sizes[begin:end, None] + sizes[None] - common) - 1e-3
    np.fill_diagonal(linked, False)
    if side.any():
        linked &= side[:, None] != side[None]
    order = sorted(range(n), key=nodes.__getitem__)
    label = np.empty(n, np.int64)
    label[order] = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None], n).min(1, initial=n))
        if (least == label).all():
            break
        label = least
    return rows(EXACT, node=nodes, n_links=linked.sum(1), root=[nodes[order[x]] for x in label])


def exact_links(docs: DataFrame, sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Stored: links of every set that is tied to another, counted tile by tile, and where they lead."""
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    placed = groups.join(sizes, "root").select("node", F.col("root").alias("grp"), F.ceil(F.col("size") / TILE).cast("int").alias("blocks"))
    nodes = sets.filter("node is not null").groupBy("node").agg(F.min("text_hash").alias("text_hash"))
    wanted = stored(placed.join(nodes, "node"), "wanted")
    sent = F.broadcast(wanted) if wanted.count() <= SENT_TEXTS else wanted
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(sent, "text_hash").dropDuplicates(["node", "text_hash"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tokens_of(x).tobytes() for x in byte_texts(column(batch, "text"))]
            keep = pa.array([xxhash.xxh3_128_digest(x) == n for x, n in zip(found, column(batch, "node").to_pylist())], pa.bool_())
            arrays = [column(batch, n) for n in ("node", "grp", "blocks")] + [pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "grp", "blocks", "tokens"]).filter(keep)

    members = texts.select("text", "node", "grp", "blocks").mapInArrow(again, "node binary, grp binary, blocks int, tokens binary")
    # a group of g blocks has g (g + 1) / 2 tiles; each set goes to g of them
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "tokens"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done():
            nodes, tokens, sides = zip(*held)
            return tile_links(list(nodes), [np.frombuffer(x, np.uint64) for x in tokens], list(sides))

        for batch in batches:
            for grp, i, j, side, node, tokens in zip(*(column(batch, n).to_pylist() for n in ("grp", "i", "j", "side", "node", "tokens"))):
                if (grp, i, j) != current and held:
                    yield done()
                    held = []
                current = (grp, i, j)
                held.append((node, tokens, side))
        if held:
            yield done()

    dealt = tiles.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")
    return stored(dealt.mapInArrow(run, "node binary, n_links long, root binary"), "links")


def links(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """For rows with ``row``, ``doc_id`` and ``text``: ``class_id`` (smallest doc_id of all that links lead to), ``first_doc`` and
    ``first_row`` (its first row in the order of ids and rows), ``n_links`` (other sets at the threshold or above), ``copies``
    (rows with an equal set, itself too)."""
    sets = token_sets(docs, runs_needed(recall))
    known = sets.filter("node is not null")
    nodes = stored(known.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.first("deeper").alias("deeper")), "nodes")
    groups = stored(components(ties(nodes)), "groups")
    exact = exact_links(docs, sets, groups)
    counts = exact.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = components(exact.select(F.col("node").alias("a"), F.col("root").alias("b")))
    own = known.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row")).alias("first"), F.min("doc_id").alias("least"))
    placed = stored(
        own.join(counts, "node", "left").join(roots, "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "copies", "first", "least"),
        "classes",
    )
    classes = placed.groupBy("root").agg(F.min("first").alias("first"), F.min("least").alias("class_id"))
    by_node = placed.drop("first", "least").join(classes, "root").select("node", "class_id", "first", "n_links", "copies")
    linked = known.select("row", "doc_id", "node").join(by_node, "node").select(
        "row", "doc_id", "class_id", F.col("first.doc_id").alias("first_doc"), F.col("first.row").alias("first_row"), "n_links", "copies"
    )
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = sets.filter("node is null").select(
        "row", "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("first_doc"), F.col("row").alias("first_row"), none.alias("n_links"), one.alias("copies")
    )
    return linked.unionByName(alone)


def keep_first(docs: DataFrame) -> DataFrame:
    """The first row of every class, all columns as they are."""
    row, own = free_name(docs.columns, "row_number"), free_name(docs.columns, "own_row")
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = links(kept.select(F.col(row).alias("row"), "doc_id", "text"))
    first = found.filter(F.col("row") == F.col("first_row")).select(F.col("row").alias(own))
    return kept.join(first, F.col(row) == F.col(own), "left_semi").drop(row)
