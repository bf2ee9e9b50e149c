"""Piece encoding with seeded merge dropout, and its exact inverse.

A word's characters are merged in the order of the model's scores, from an agenda of neighbouring pairs; the n-th pair whose turn
comes is skipped when the keyed hash of (seed, document, place of the word in the text, n) falls below ``dropout``. Every occurrence
of a word thus has draws of its own, and the same seed gives the same ids again on any cluster. Without dropout the ids are the
library's own.

A segmentation follows from the word and from which of its pairs were skipped, so a worker keeps it under these two and answers
with it only where an occurrence's own draws skip exactly the same pairs: the ids are those of an agenda run for each occurrence.

Characters without a piece become their bytes, and so does a written U+2581, which stands for a blank inside pieces; decoding gives
back every text byte for byte.

Defined cases: null and empty texts give no ids; a null doc_id counts as 0 in the key; equal rows get equal ids; a word of any length
is merged with a heap; further columns are left out.
"""

from __future__ import annotations

import gc
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from detframe.llm.common import byte_texts, column, rows

DROPOUT, SEED = 0.1, 17
#: Sample keys of occurrences, to list some segmentations of a word; encoding has a key for each occurrence.
VARIANTS = 4
#: Segmentations that a worker keeps.
KEPT_WORDS = 800_000
LONG_WORD = 48
#: Draws made for all occurrences of a text at once; further ones are made when they are needed.
DRAWS = 24
MORE = 1 << DRAWS
#: Agendas run together in one array, those that wait for it at most, and bytes of the texts whose agendas wait together.
TOGETHER, ASKED, TEXTS = 16_384, 1 << 16, 1 << 20
#: Rank of two neighbours that are no piece.
UNPAIRED = 2**31 - 1
#: What stands for a character without a piece.
UNKNOWN = 0xFFFF
BLANK = "▁"
_WORD = re.compile(f"{BLANK}+[^{BLANK}]*")
_NONE = 1 << 62
_STEP, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_FULL = 2**64 - 1
_coders: dict[tuple, "PieceCoder"] = {}


class PieceCoder:
    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.seed, self.limit = seed, min(2**64 - 1, int(dropout * 2**64))
        self.rank: dict[str, int] = {}
        self.ids: dict[str, bytes] = {}
        self.meant: list[bytes] = []
        self.bytes: list[bytes] = [b""] * 256
        order = sorted(range(model.get_piece_size()), key=lambda k: (-model.get_score(k), k))
        places, last = {}, None
        for k in order:  # equal scores share a rank, so that the left one of two pairs comes first
            last = (model.get_score(k), last[1] + (model.get_score(k) != last[0])) if last else (model.get_score(k), 0)
            places[k] = last[1]
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                value = int(piece[3:5], 16)
                self.bytes[value] = k.to_bytes(2, "little")
                self.meant.append(bytes([value]))
            elif model.is_control(k) or model.is_unknown(k):
                self.meant.append(b"")
            else:
                self.rank[piece], self.ids[piece] = places[k], k.to_bytes(2, "little")
                self.meant.append(piece.replace(BLANK, " ").encode())
        self._tables(order)
        self.plain: dict[str, bytes] = {}
        #: Word, and word with the pairs that are skipped -> draws that its agenda asks for after the last skip, ids
        self.kept: dict[str | tuple[str, int], tuple[int, bytes]] = {}

    def _tables(self, order: list[int]) -> None:
        """What :meth:`_merged_many` looks up: the piece of a character, and rank and piece of two neighbours."""
        number = {piece: int.from_bytes(own, "little") for piece, own in self.ids.items()}
        self.signs = np.full(0x110000, -1, np.int32)
        pairs = {}
        for piece, k in number.items():
            if len(piece) == 1:
                self.signs[ord(piece)] = k
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = (self.rank[piece], k)
        #: Whether a character without a piece stands in no longer piece either, so that it is never merged.
        self.closed = all(self.signs[ord(x)] >= 0 for piece in number for x in piece)
        self.slots = 1 << max(4, (2 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - (self.slots.bit_length() - 1))
        self.pair = np.full(self.slots, -1, np.int64)
        self.outcome = np.full((self.slots, 2), UNPAIRED, np.int32)
        keys, found = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        at = self._slot(keys)
        while len(keys):  # open addressing: who comes first to a free slot stays, others go on to the next
            _, first = np.unique(at, return_index=True)
            first = first[self.pair[at[first]] < 0]
            self.pair[at[first]], self.outcome[at[first]] = keys[first], found[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, found, at = keys[left], found[left], (at[left] + 1) & (self.slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(_STEP)) >> self.shift).astype(np.int64)

    def _outcomes(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of neighbours; the rank of a pair that is no piece is ``UNPAIRED``."""
        keys = left.astype(np.int64) << 16 | right
        at = self._slot(keys)
        held = self.pair[at]
        other = np.flatnonzero((held != keys) & (held >= 0))
        while len(other):
            at[other] = (at[other] + 1) & (self.slots - 1)
            held = self.pair[at[other]]
            other = other[(held != keys[other]) & (held >= 0)]
        found = self.outcome[at]
        return found[:, 0], found[:, 1]

    def occurrences(self, key: int, first: int, count: int) -> np.ndarray:
        """Keys of the words ``first`` and following of the text of document ``key``."""
        x = np.arange(first, first + count, dtype=np.uint64) + np.uint64(xxhash.xxh64_intdigest(b"%d %d" % (self.seed, key)))
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))

    def draws(self, keys: np.ndarray) -> np.ndarray:
        """The first ``DRAWS`` draws of each occurrence as bits, 1 for a skip; ``MORE`` is set."""
        x = keys.reshape(-1, 1) + np.arange(1, DRAWS + 1, dtype=np.uint64) * np.uint64(_STEP)
        x ^= x >> np.uint64(32)
        x *= np.uint64(_MIX)
        x ^= x >> np.uint64(32)
        x *= np.uint64(_MIX)
        x ^= x >> np.uint64(32)
        bits = np.zeros((len(keys), 4), np.uint8)
        bits[:, : DRAWS // 8] = np.packbits(x < np.uint64(self.limit), axis=1, bitorder="little")
        return bits.view("<u4").ravel() | np.uint32(MORE)

    def skip(self, key: int, n: int) -> bool:
        """Draw ``n`` (from 0) of an occurrence."""
        x = (key + (n + 1) * _STEP) & _FULL
        x = ((x ^ (x >> 32)) * _MIX) & _FULL
        x = ((x ^ (x >> 32)) * _MIX) & _FULL
        return (x ^ (x >> 32)) < self.limit

    def merged(self, word: str, key: int) -> list[str]:
        """Pieces of a word at the occurrence ``key``. Its first sign is a blank; other blanks before the first letter were in the text too."""
        if len(word) > LONG_WORD:
            return self._merged_long(list(word), key)
        return self._merged(word, key, int(self.draws(np.array([key], np.uint64))[0]) if self.limit else 0)[0]

    def _merged(self, word: str, key: int, drawn: int) -> tuple[list[str], int, int]:
        """Pieces, the pairs that were skipped (bit n for the n-th), and how many had their turn."""
        signs, rank = list(word), self.rank.get
        waiting = [rank(a + b, _NONE) for a, b in zip(signs, signs[1:])]
        skipped, n = 0, -1
        while waiting:
            best = min(waiting)
            if best == _NONE:
                break
            k = waiting.index(best)
            n += 1
            if drawn >> n & 1 if n < DRAWS else self.skip(key, n):
                skipped |= 1 << n
                waiting[k] = _NONE
                continue
            signs[k : k + 2] = [signs[k] + signs[k + 1]]
            del waiting[k]
            if k:
                waiting[k - 1] = rank(signs[k - 1] + signs[k], _NONE)
            if k < len(waiting):
                waiting[k] = rank(signs[k] + signs[k + 1], _NONE)
        return signs, skipped, n + 1

    def _merged_long(self, signs: list[str], key: int) -> list[str]:
        """The same with a heap: pairs by rank, then from the left; a pair that is no longer as it was is passed over."""
        n, rank = len(signs), self.rank.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        parts: list[str | None] = list(signs)
        agenda: list[tuple[int, int, str, str]] = []
        turn = -1

        def propose(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (r := rank(parts[a] + parts[b])) is not None:
                heapq.heappush(agenda, (r, a, parts[a], parts[b]))

        for k in range(n - 1):
            propose(k, k + 1)
        while agenda:
            r, a, left, right = heapq.heappop(agenda)
            b = after[a] if parts[a] == left else -1
            if b < 0 or parts[b] != right:
                continue
            turn += 1
            if self.limit and self.skip(key, turn):
                continue
            parts[a], parts[b] = left + right, None
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            propose(before[a], a)
            propose(a, after[a])
        return [x for x in parts if x is not None]

    def word(self, word: str, key: int) -> bytes:
        """Ids of a word at the occurrence ``key``, as little-endian unsigned 16-bit integers."""
        return self._ids(self.merged(word, key))

    def _ids(self, pieces: list[str]) -> bytes:
        found = list(map(self.ids.get, pieces))
        if None in found:
            # U+FFFF keeps the place of a written U+2581, see encode
            as_bytes = (b"".join([self.bytes[b] for b in x.replace("￿", BLANK).encode("utf-8", "surrogatepass")]) for x in pieces)
            found = [other if x is None else x for x, other in zip(found, as_bytes)]
        return b"".join(found)

    def _settle(self, asked: list[tuple]) -> None:
        """Ids of the occurrences that no kept segmentation answers, by agendas of their own, put into their places.

        They are kept where an agenda skips just the pairs of the path that led to it.
        """
        text = "".join([a[0] for a in asked])
        signs, sizes = self.signs[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], np.array([len(a[0]) for a in asked])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        apart = sizes > LONG_WORD
        odd = np.minimum.reduceat(signs, starts) < 0
        if not self.closed:
            apart |= odd
        for k in np.flatnonzero(apart).tolist():
            word, key, _, _, out, place = asked[k]
            out[place] = self._ids(self.merged(word, key))
        signs[signs < 0] = UNKNOWN
        order = np.flatnonzero(~apart)
        order = order[np.argsort(sizes[order], kind="stable")]
        for start in range(0, len(order), TOGETHER):
            chosen = order[start : start + TOGETHER]
            columns = np.arange(sizes[chosen[-1]])
            grid = np.where(columns < sizes[chosen, None], signs[np.minimum(starts[chosen, None] + columns, len(signs) - 1)], -1)
            mine = [asked[k] for k in chosen.tolist()]
            parts, skips, turns = self._merged_many(grid, [a[1] for a in mine], np.array([a[2] for a in mine]))
            alive = parts >= 0
            data = parts[alive].astype("<u2").tobytes()
            upto = (np.cumsum(alive.sum(axis=1)) * 2).tolist()
            ids = [data[x:y] for x, y in zip([0, *upto], upto)]
            for k in np.flatnonzero(odd[chosen]).tolist():  # characters without a piece become bytes
                word = mine[k][0]
                found = ((place, part) for place, part in enumerate(parts[k].tolist()) if part >= 0)
                ids[k] = b"".join([self._ids([word[place]]) if part == UNKNOWN else part.to_bytes(2, "little") for place, part in found])
            whole = turns <= DRAWS
            masks = np.where(whole, 1 << np.where(whole, turns, 0), 0).tolist()
            for (word, _, _, path, out, place), own, skipped, mask in zip(mine, ids, skips.tolist(), masks):
                out[place] = own
                if skipped == path and mask:
                    self.kept[(word, path) if path else word] = (mask - (1 << path.bit_length()), own)
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()

    def _merged_many(self, grid: np.ndarray, keys: list[int], drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """:meth:`_merged` for many words at once, one turn of each at a time: pieces, skipped pairs (of the first ``DRAWS``), turns.

        A row of ``grid`` holds the pieces of a word's characters, then -1. A piece stands at the place of its first character, -1 elsewhere.
        """
        count, width = grid.shape
        last = width  # a place beyond the word, where writes do no harm
        parts = np.concatenate([grid, np.full((count, 1), -1, grid.dtype)], axis=1)
        waiting = np.full((count, width + 1), UNPAIRED, np.int32)
        row, at = np.nonzero(grid[:, 1:] >= 0)
        waiting[row, at] = self._outcomes(grid[row, at], grid[row, at + 1])[0]
        after = np.tile(np.minimum(np.arange(1, width + 2), last), (count, 1))
        before = np.tile(np.where(np.arange(width + 1) > 0, np.arange(width + 1) - 1, last), (count, 1))
        skips, turns = np.zeros(count, np.int64), np.zeros(count, np.int64)
        rows, n = np.arange(count), 0
        while len(rows):
            best = waiting[rows].argmin(axis=1)
            going = waiting[rows, best] < UNPAIRED
            rows, best = rows[going], best[going]
            turns[rows] += 1
            if n < DRAWS:
                skip = (drawn[rows] >> n & 1).astype(bool)
                skips[rows[skip]] |= 1 << n
            else:
                skip = np.fromiter((self.skip(keys[k], n) for k in rows.tolist()), bool, len(rows))
            waiting[rows[skip], best[skip]] = UNPAIRED
            r, a = rows[~skip], best[~skip]
            b = after[r, a]
            beyond = after[r, b]
            parts[r, a] = self._outcomes(parts[r, a], parts[r, b])[1]
            parts[r, b] = -1
            waiting[r, b] = UNPAIRED
            after[r, a] = beyond
            before[r, beyond] = a
            for left, right in ((a, beyond), (before[r, a], a)):
                x, y = parts[r, left], parts[r, right]
                both = (x >= 0) & (y >= 0)
                rank = np.full(len(r), UNPAIRED, np.int32)
                rank[both] = self._outcomes(x[both], y[both])[0]
                waiting[r, left] = rank
            n += 1
        return parts, skips, turns

    def encode(self, text: str, key: int) -> bytes:
        """Ids of a text; ``key`` names the document."""
        return self.encode_all([text], [key])[0]

    def encode_all(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """Ids of several texts; agendas that no kept segmentation spares are run together."""
        asked: list[tuple] = []
        collecting = gc.isenabled()
        gc.disable()  # no cycles are made here, and each search for them goes through all that is kept
        try:
            made = [self._parts(text, key, asked) for text, key in zip(texts, keys)]
            if asked:
                self._settle(asked)
        finally:
            if collecting:
                gc.enable()
        return [b"".join(parts) for parts in made]

    def _parts(self, text: str, key: int, asked: list[tuple]) -> list:
        out: list = []
        if not text:
            return out
        if BLANK in text or "￿" in text:
            self._encode_marked(text, key, out, asked)
            return out
        if "  " in text or text[0] == " ":  # the blank that stands before every text makes a run with its own
            words = _WORD.findall(BLANK + text.replace(" ", BLANK))
        else:
            words = [BLANK + x for x in text.split(" ")]
        self._joined(words, key, 0, out, asked)
        return out

    def _joined(self, words: list[str], key: int, first: int, out: list, asked: list[tuple]) -> None:
        """Add to ``out`` the ids of the words that stand from place ``first`` on in the text of document ``key``.

        What has to be settled by an agenda of its own is left open and noted in ``asked``, which is settled when it is long.
        """
        if not self.limit:
            out += map(self._plain, words)
            return
        keys = self.occurrences(key, first, len(words))
        kept = self.kept
        for word, node, key, drawn in zip(words, list(map(kept.get, words)), keys.tolist(), self.draws(keys).tolist()):
            path = 0
            while node is not None:
                hit = drawn & node[0]
                if not hit:
                    out.append(node[1])
                    break
                path |= hit & -hit
                node = kept.get((word, path))
            else:
                asked.append((word, key, drawn, path, out, len(out)))
                out.append(None)
        if len(asked) >= ASKED:
            self._settle(asked)
            asked.clear()

    def _plain(self, word: str) -> bytes:
        found = self.plain.get(word)
        if found is None:
            if len(self.plain) >= KEPT_WORDS:
                self.plain.clear()
            found = self.plain[word] = self.word(word, 0)
        return found

    def _encode_marked(self, text: str, key: int, out: list, asked: list[tuple]) -> None:
        """A written U+2581 or U+FFFF is written as its bytes; what lies between is encoded as in one text."""
        parts = re.split(f"([{BLANK}￿])", BLANK + text.replace(" ", "\x00")) if "\x00" not in text else None
        if parts is None:  # no free sign to stand for the blank: byte by byte
            out += [self.ids[BLANK], *[self.bytes[b] for b in text.encode("utf-8", "surrogatepass")]]
            return
        place = 0
        for k, part in enumerate(parts[1:]):
            if k == 0:
                out += [self.ids[BLANK]]
                continue
            if part in (BLANK, "￿"):
                out += [self.bytes[b] for b in part.encode()]
            elif part:
                words = re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", part.replace("\x00", BLANK))
                self._joined(words, key, place, out, asked)
                place += len(words)

    def decode(self, ids: bytes) -> str:
        """The text of ids, whatever merges were skipped."""
        return b"".join(map(self.meant.__getitem__, np.frombuffer(ids, "<u2").tolist()))[1:].decode("utf-8", "surrogatepass")


def coder(path: str, dropout: float, seed: int) -> PieceCoder:
    key = (path, dropout, seed)
    if key not in _coders:
        _coders[key] = PieceCoder(*key)
    return _coders[key]


def _encoded(own: PieceCoder, doc_ids: list, texts) -> Iterator[tuple]:
    """``doc_id, text, ids`` of a batch, whose texts are encoded some at a time."""
    some, length = [], 0
    for k, (doc_id, data) in enumerate(zip(doc_ids, texts), 1):
        some.append((doc_id, data.decode("utf-8", "replace")))
        length += len(data)
        if length >= TEXTS or k == len(doc_ids):
            ids = own.encode_all([text for _, text in some], [doc_id or 0 for doc_id, _ in some])
            yield from ((doc_id, text, x) for (doc_id, text), x in zip(some, ids))
            some, length = [], 0


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("lossless", pa.bool_())])


def encode(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, keep_ids: bool = False) -> DataFrame:
    """Ids of every whole text, read back at once: ``n_tokens``, checksum of the ids as 16-bit integers, whether the text came
    back as it was; with ``keep_ids`` the ids too. No shuffle."""
    schema = pa.schema([*ENCODED, *([pa.field("ids", pa.binary())] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, dropout, seed)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in schema.names}
            doc_ids = column(batch, "doc_id").to_pylist()
            for doc_id, text, ids in _encoded(own, doc_ids, byte_texts(column(batch, "text"))):
                for name, value in zip(schema.names, (doc_id, len(ids) // 2, zlib.crc32(ids), own.decode(ids) == text, ids)):
                    out[name].append(value)
            yield rows(schema, **out)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids binary" * keep_ids)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` from rows with ``doc_id`` and ``ids``; a null id array stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, 0.0, 0)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
