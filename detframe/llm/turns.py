"""Repair of conversations whose turns do not alternate: the cheapest edits by weighted interval parsing.

The roles of a repaired conversation are ``(s?(ua)+)?``: nothing, or user and assistant in turn, after at most one system row. The
grammar is in Chomsky normal form: its symbols are pairs of places (p, q) of that pattern, and (p, r) -> (p, q)(q, r). A cell of
the table holds, for each symbol, the least (cost, audit) with which the rows of its span lead from p to q; the cell of no rows
holds what inserted rows alone can do (the insertion closure). Spans are filled by ascending length over all their splits.

Rows are sorted over the cluster by conversation and turn, and each task cuts what it holds into blocks of ``BLOCK`` rows of one
conversation and parses them, so one giant conversation is parsed by many tasks. As the symbols are pairs of places,
any split of a longer span gives the same cell, so the blocks of a conversation are then joined two by two, by ascending length.
Only these cells, never texts, meet in the task of a conversation. Equal costs never have audits of which one begins the other
(the longer would cost more), so the least audit of a span is made of the least audits of its parts.

Defined cases: null role and text are one space; a null conv_id is a conversation of its own; null turns come first; rows of
equal turn follow role and a hash of the text; equal rows stand side by side and all but the first are duplicates; a kept row keeps its
role as it is; a conversation without rows gives zeros and the hash of nothing; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import column, rows, stored

BLOCK = 32
INSERT, DELETE, REROLE, TRUNCATED = 3, 4, 3, 3
BLANKS, STOPS = " \t\n\v\f\r", ".!?"
#: Parses a worker keeps by the rows' roles and faults.
KEPT_PARSES = 200_000

# places of the pattern: before anything, after the system row, after a user row, after an assistant row
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (BEGIN, ASSISTANT)
Cell = dict[tuple[int, int], tuple[int, str]]


def joined(left: Cell, right: Cell, into: Cell | None = None) -> Cell:
    """The binary rule: everything the two spans can do one after the other, the least of each symbol."""
    out = {} if into is None else into
    for (p, q), (cost, audit) in left.items():
        for r in range(4):
            more = right.get((q, r))
            if more is not None:
                found = (cost + more[0], audit + more[1])
                if (p, r) not in out or found < out[p, r]:
                    out[p, r] = found
    return out


def _closure() -> Cell:
    """What inserted rows alone can do: fewest first, until nothing gets cheaper."""
    step: Cell = {(p, q): (INSERT, "I") for (p, role), q in NEXT.items() if role != "s"}
    found: Cell = {(p, p): (0, "") for p in range(4)}
    while True:
        longer = joined(found, step, dict(found))
        if longer == found:
            return found
        found = longer


CLOSURE = _closure()


@lru_cache(maxsize=4096)
def terminal(initial: str, fault: str, copies: int) -> Cell:
    """The cell of one row and the later copies of it; ``fault``: '' none, 't' truncated, 'd' to be deleted."""
    gone = copies if fault == "d" else copies - 1
    tail, late = (DELETE * gone, "D" * gone), TRUNCATED * (fault == "t")
    cell: Cell = {(p, p): (tail[0] + DELETE * (copies - gone), "D" * copies) for p in range(4)}
    if fault != "d":
        for (p, role), q in NEXT.items():
            ways = [(late, "K")] if role == initial else []
            ways += [(REROLE + late, "R")] if role != "s" else []
            if ways:
                cost, audit = min(ways)
                cell[p, q] = (cost + tail[0], audit + tail[1])
    return joined(joined(CLOSURE, cell), CLOSURE)


@lru_cache(maxsize=KEPT_PARSES)
def parsed(symbols: tuple[tuple[str, str, int], ...]) -> Cell:
    """The table over the rows of a block, spans by ascending length, every split of each; the cell of the whole block."""
    n = len(symbols)
    cells: dict[tuple[int, int], Cell] = {(i, i + 1): terminal(*x) for i, x in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for k in range(i + 1, i + length):
                joined(cells[i, k], cells[k, i + length], cell)
            cells[i, i + length] = cell
    return cells[0, n]


def combined(spans: list[Cell]) -> Cell:
    """Cells of neighbouring spans joined two by two, level by level."""
    while len(spans) > 1:
        spans = [joined(*spans[k : k + 2]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)]
    return spans[0]


def best(cell: Cell) -> tuple[int, str]:
    return min(cell[BEGIN, q] for q in FINAL if (BEGIN, q) in cell)


def damage(turns: DataFrame) -> DataFrame:
    """Rows with planted faults by crc32('conv_id:turn') % 20: 0 dropped, 1 emptied, 2 without ``.!?``, 3 doubled, 4 by the user."""
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("kind"),
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


#: Order of the rows of all conversations: null ids and null turns first.
ORDER = ["has_id", "id", "has_turn", "at", "role", "digest"]
LIGHT = [("has_id", "boolean"), ("id", "long"), ("has_turn", "boolean"), ("at", "long"), ("role", "string"), ("digest", "binary")]


def _keyed(turns: DataFrame) -> DataFrame:
    space = F.lit(" ")
    named = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    zero = F.lit(0).cast("long")
    return named.select(
        F.col("conv_id").isNotNull().alias("has_id"), F.coalesce(F.col("conv_id").cast("long"), zero).alias("id"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), zero).alias("at"),
        "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text",
    )


def faulty(turns: DataFrame) -> DataFrame:
    """Different rows with their number of ``copies`` and whether the first is blank, truncated or a repetition; no texts."""
    keyed = _keyed(turns)
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    flagged = keyed.select(*ORDER, (last == "").alias("blank"), (~last.isin(*STOPS)).alias("open"))
    met = stored(flagged.groupBy(*ORDER).agg(F.count("*").alias("copies"), F.first("blank").alias("blank"), F.first("open").alias("open")), "turns")
    said = ["has_id", "id", "role", "digest"]
    first = met.groupBy(*said).agg(F.min(F.struct("has_turn", "at")).alias("first"))
    seen = met.join(first, said).withColumn("repeated", F.struct("has_turn", "at") != F.col("first")).drop("first")
    return seen.select(*ORDER, "copies", "blank", "open", "repeated")


BLOCKS_SQL = (
    "has_id boolean, id long, shard int, block long, n long, blanks long, repeats long, truncated long, illegal long, first_initial string, "
    "last_initial string, turns long, low long, high long, pairs array<int>, costs array<long>, audits array<string>, "
    "members array<struct<has_turn:boolean,at:long,role:string,digest:binary,copies:long>>"
)
MEMBER = pa.struct([("has_turn", pa.bool_()), ("at", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("copies", pa.int64())])
BLOCKS = pa.schema([
    ("has_id", pa.bool_()), ("id", pa.int64()), ("shard", pa.int32()), ("block", pa.int64()), *((n, pa.int64()) for n in ("n", "blanks", "repeats", "truncated", "illegal")),
    ("first_initial", pa.string()), ("last_initial", pa.string()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()),
    ("pairs", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("members", pa.list_(MEMBER)),
])
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _block_row(key: tuple, shard: int, number: int, members: list[dict]) -> dict:
    symbols, faults, illegal, before = [], [0, 0, 0], 0, None
    for m in members:
        copies = m["copies"]
        blank, again = (copies, 0) if m["blank"] else (0, copies if m["repeated"] else copies - 1)
        cut_off = int(not m["blank"] and not m["repeated"] and m["open"])
        faults = [a + b for a, b in zip(faults, (blank, again, cut_off))]
        initial = m["role"][:1]
        illegal += copies - 1 + (before is not None and (before, initial) not in LEGAL)
        before = initial
        symbols.append((initial if initial in "sua" else "", "d" if m["blank"] or m["repeated"] else "t" * cut_off, copies))
    cell = parsed(tuple(symbols))
    known = sorted({m["at"] for m in members if m["has_turn"]})
    return dict(zip(BLOCKS.names, (
        *key, shard, number, sum(m["copies"] for m in members), *faults, illegal, members[0]["role"][:1], before, len(known), known[0] if known else None,
        known[-1] if known else None, [4 * p + q for p, q in cell], [c for c, _ in cell.values()], [a for _, a in cell.values()],
        [{f.name: m[f.name] for f in MEMBER} for m in members],
    )))


def blocks(seen: DataFrame) -> DataFrame:
    """Blocks of neighbouring rows of one conversation with the cell of their span, in order of (``shard``, ``block``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, key, members, made = TaskContext.get().partitionId(), 0, None, [], []
        for batch in batches:
            for m in batch.to_pylist():
                own = (m["has_id"], m["id"])
                if members and (own != key or len(members) == BLOCK):
                    made.append(_block_row(key, shard, number, members))
                    number, members = number + 1, []
                key = own
                members.append(m)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=BLOCKS)
                made = []
        if members:
            yield pa.RecordBatch.from_pylist([_block_row(key, shard, number, members)], schema=BLOCKS)

    ordered = seen.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return stored(ordered.mapInArrow(run, BLOCKS_SQL), "blocks")


SUMMARY_SQL = (
    "has_id boolean, id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "spans array<struct<shard:int,block:long,place:int,audit:string>>"
)
SPAN = pa.struct([("shard", pa.int32()), ("block", pa.int64()), ("place", pa.int32()), ("audit", pa.string())])
SUMMARY = pa.schema([
    ("has_id", pa.bool_()), ("id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    ("audit", pa.string()), ("spans", pa.list_(SPAN)),
])


def _walk(place: int, audit: str) -> int:
    """The place of the pattern after an audit; a kept or changed row follows from where it stands."""
    for letter in audit:
        if letter != "D":
            place = USER if place in (BEGIN, SYSTEM, ASSISTANT) else ASSISTANT
    return place


def _summary(key: tuple, parts: list[dict]) -> dict:
    cost, audit = best(combined([{divmod(x, 4): (c, a) for x, c, a in zip(p["pairs"], p["costs"], p["audits"])} for p in parts]))
    totals = [sum(p[n] for p in parts) for n in ("blanks", "repeats", "truncated")]
    illegal = sum(p["illegal"] for p in parts) + sum((a["last_initial"], b["first_initial"]) not in LEGAL for a, b in zip(parts, parts[1:]))
    known = [p for p in parts if p["turns"]]
    turns = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0
    spans, at, place = [], 0, BEGIN
    for number, p in enumerate(parts):
        begin, left = at, p["n"]
        while left:  # rows of the block, with what is inserted before each
            left -= audit[at] != "I"
            at += 1
        if number + 1 == len(parts):
            at = len(audit)
        own = audit[begin:at]
        spans.append({"shard": p["shard"], "block": p["block"], "place": place, "audit": own})
        first = next((x for x in own if x != "D"), "")
        if place == BEGIN and first == "K":  # only a kept system row leads elsewhere than a user row
            kept = own.index("K")
            place = _walk(SYSTEM if _nth_initial(p, own[: kept + 1]) == "s" else USER, own[kept + 1 :])
        else:
            place = _walk(place, own)
    return dict(zip(SUMMARY.names, (*key, gaps, *totals, illegal, cost, audit, spans)))


def _nth_initial(part: dict, audit: str) -> str:
    """The role initial of the row that the last letter of ``audit`` (the rows' letters so far) belongs to."""
    left = sum(x != "I" for x in audit)
    for m in part["starts"]:
        left -= m[1]
        if left <= 0:
            return m[0]
    return ""


def conversations(parts: DataFrame) -> DataFrame:
    """One row for each conversation with rows: its faults, the cheapest repair, and the audit of each of its blocks."""
    light = parts.withColumn("starts", F.transform("members", lambda m: F.struct(F.substring(m["role"], 1, 1).alias("i"), m["copies"].alias("n")))).drop("members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, made = None, [], []
        for batch in batches:
            for p in batch.to_pylist():
                p["starts"] = [(s["i"], s["n"]) for s in p["starts"]]
                if own and (p["has_id"], p["id"]) != key:
                    made.append(_summary(key, own))
                    own = []
                key = (p["has_id"], p["id"])
                own.append(p)
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=SUMMARY)
                made = []
        if own:
            yield pa.RecordBatch.from_pylist([_summary(key, own)], schema=SUMMARY)

    ordered = light.repartition("has_id", "id").sortWithinPartitions("has_id", "id", "shard", "block")
    return stored(ordered.mapInArrow(run, SUMMARY_SQL), "conversations")


EDITS_SQL = "has_id boolean, id long, has_turn boolean, at long, role string, digest binary, shard int, block long, nth int, place int, audit string"
EDITS = pa.schema([
    ("has_id", pa.bool_()), ("id", pa.int64()), ("has_turn", pa.bool_()), ("at", pa.int64()), ("role", pa.string()), ("digest", pa.binary()),
    ("shard", pa.int32()), ("block", pa.int64()), ("nth", pa.int32()), ("place", pa.int32()), ("audit", pa.string()),
])
REPAIRED_SQL = "conv_id long, shard int, block long, nth int, step int, turn long, role string, text string, edit string"


def repaired(turns: DataFrame, parts: DataFrame, summary: DataFrame) -> DataFrame:
    """The rows of the repaired conversations, ordered by (``shard``, ``block``, ``nth``, ``step``), with the edit each comes from (K, R or I)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for b in batch.to_pylist():
                at, place, audit = 0, b["place"], b["audit"]
                for nth, m in enumerate(b["members"]):
                    begin, left = at, m["copies"]
                    while left:
                        left -= audit[at] != "I"
                        at += 1
                    if nth + 1 == len(b["members"]):
                        at = len(audit)
                    own = audit[begin:at]
                    out.append(dict(zip(EDITS.names, (b["has_id"], b["id"], m["has_turn"], m["at"], m["role"], m["digest"], b["shard"], b["block"], nth, place, own))))
                    for letter in own:
                        if letter != "D":
                            place = SYSTEM if letter == "K" and place == BEGIN and m["role"][:1] == "s" else USER if place != USER else ASSISTANT
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=EDITS)

    chosen = summary.select(F.explode("spans").alias("s")).select("s.*")
    edits = parts.select("has_id", "id", "shard", "block", "members").join(chosen, ["shard", "block"]).mapInArrow(split, EDITS_SQL)
    edits = edits.filter(F.col("audit").rlike("[^D]"))  # rows that only go away need no text
    texts = _keyed(turns).groupBy(*ORDER).agg(F.first("text").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("conv_id", "shard", "block", "nth", "step", "turn", "role", "text", "edit")}
            for e in batch.to_pylist():
                place = e["place"]
                for step, letter in enumerate(e["audit"]):
                    if letter == "D":
                        continue
                    system = letter == "K" and place == BEGIN and e["role"][:1] == "s"
                    place = SYSTEM if system else USER if place != USER else ASSISTANT
                    role = e["role"] if letter == "K" else "user" if place == USER else "assistant"
                    known = letter != "I"
                    for name, value in zip(out, (
                        e["id"] if e["has_id"] else None, e["shard"], e["block"], e["nth"], step, e["at"] if known and e["has_turn"] else None, role, e["text"] if known else "", letter,
                    )):
                        out[name].append(value)
            yield rows(EMITTED, **out)

    return edits.join(texts, ORDER).mapInArrow(emit, REPAIRED_SQL)


EMITTED = pa.schema([
    ("conv_id", pa.int64()), ("shard", pa.int32()), ("block", pa.int64()), ("nth", pa.int32()), ("step", pa.int32()), ("turn", pa.int64()),
    ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()),
])
HASHES = pa.schema([("has_id", pa.bool_()), ("id", pa.int64()), ("repaired_sha256", pa.string())])


def fingerprints(repaired_rows: DataFrame) -> DataFrame:
    """sha256 of the ``role:text`` lines of each repaired conversation; rows stream through in order, none are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv_id, role, text in zip(*(column(batch, n).to_pylist() for n in ("conv_id", "role", "text"))):
                own = (conv_id is not None, conv_id or 0)
                if own != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield rows(HASHES, **dict(zip(HASHES.names, map(list, zip(*done)))))
        if key is not None:
            yield rows(HASHES, has_id=[key[0]], id=[key[1]], repaired_sha256=[state.hexdigest()])

    ordered = repaired_rows.repartition("conv_id").sortWithinPartitions("conv_id", "shard", "block", "nth", "step")
    return ordered.mapInArrow(run, "has_id boolean, id long, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row for each conversation with its faults, cost and audit; the repaired rows)."""
    parts = blocks(faulty(turns))
    summary = conversations(parts)
    return summary, repaired(turns, parts, summary)


def digest(conversation_ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each different id of ``conversation_ids``, those without rows included."""
    summary, mended = repair(turns)
    every = conversation_ids.select(F.col("conv_id").isNotNull().alias("has_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("id")).distinct()
    found = every.join(summary.drop("spans"), ["has_id", "id"], "left").join(fingerprints(mended), ["has_id", "id"], "left")
    numbers = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(
        F.when(F.col("has_id"), F.col("id")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )
