"""Exact removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

Documents are put in batches in the order of their ids. A batch's suffix array holds the suffixes at the minimisers of its
SPAN-byte windows, in byte order: each window has just one minimiser, found from the window's bytes alone, so equal
windows have equal ones wherever they stand. Neighbouring windows with one minimiser are a stretch. The arrays are dealt to
parts by their first GRAM bytes; in each part the batches come in order, and levels of one size are merge-scanned
into one of twice the size, in which equal suffixes meet. Two visits find the repeats:

1. by the first GRAM bytes of a suffix: which ones more than one document has;
2. for those, by the whole stretch. Where all stretches of a gram are equal, a document that comes later loses all of its
   windows; where they differ, common prefixes along the suffix array, and along the array of what stands before the
   minimisers, tell which windows are equal, and so which documents have each window first.

All comparisons are of the bytes themselves; hashes only choose minimisers and deal parts. A gram with very many different
stretches is dealt by window instead, so that no part gets them all. Batches live in a bucketed table, so the
answers, two bits per window, meet their batch without moving its text again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import SpanHash, bytes_of, mix, read, row_blocks, stage

SPAN, GRAM = 50, 20
REACH = SPAN - GRAM + 1
#: Bytes that a stretch's record takes: SPAN from the minimiser on, then what stands before it, nearest first.
RECORD = SPAN + REACH - 1
#: Stands where a stretch has no byte: never found in UTF-8.
PAD = 0xFF
#: Bytes of text in a batch, and for a part, on average.
BATCH_BYTES, PART_BYTES = 4 << 20, 8 << 20
#: A gram with more different stretches than this, summed over batches, is dealt by window.
HOT = 20_000
#: Buckets of the batches' table at most; beyond it a bucket holds several batches.
BUCKETS = 20_000
NO_ID = (1 << 63) - 1
_PLACE = np.uint64((1 << 24) - 1)
_NEVER = np.int64(NO_ID)


def minimisers(data: np.ndarray, off: np.ndarray, hashes: SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of neighbouring windows with one minimiser: row, first start, last start, minimiser's place."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none
    # Places are kept in 24 bits: longer arrays are scanned in overlapping parts.
    step = (1 << 24) - SPAN
    if n > step + SPAN:
        parts = []
        for a in range(0, n - SPAN + 1, step):
            b = min(n, a + step + SPAN - 1)
            parts.append([x + a for x in _stretches(data[a:b], hashes, a)])
        first, last, at = (np.concatenate(x) for x in zip(*parts))
    else:
        first, last, at = _stretches(data, hashes, 0)
    # Windows that cross rows are no windows: cut the stretches at row ends.
    row = np.searchsorted(off, first, "right") - 1
    rows, f, l, m = [row], [first], [last], [at]
    while True:  # a stretch has REACH windows at most, so it meets few rows unless these are tiny
        end = off[row + 1]
        more = last >= end
        if not more.any():
            break
        row, first, last, at = row[more] + 1, end[more], last[more], at[more]
        row = np.searchsorted(off, first, "right") - 1
        rows.append(row), f.append(first), l.append(last), m.append(at)
    row, first, last, at = (np.concatenate(x) for x in (rows, f, l, m))
    last = np.minimum(last, off[row + 1] - SPAN)
    fine = last >= first
    row, first, last, at = row[fine], first[fine], last[fine], at[fine]
    by = np.argsort(first, kind="stable")
    return row[by], first[by], last[by], at[by]


def _stretches(data: np.ndarray, hashes: SpanHash, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    p = np.arange(base, base + n - GRAM + 1)
    key = hashes(p, p + GRAM) & ~_PLACE | np.arange(len(p), dtype=np.uint64)
    width = 1
    while width * 2 <= REACH:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (REACH - width)], key[REACH - width :])
    at = (key & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.append(first[1:], len(at)) - 1, at[first]


class Suffixes:
    """The sparse suffix array of a batch, unsorted: stretches with their rows, places and records."""

    def __init__(self, ids: np.ndarray, texts: pa.Array):
        self.data, self.off = bytes_of(texts)
        self.ids = ids
        found = []
        for a, b in row_blocks(self.off):
            base = self.off[a]
            h = SpanHash(self.data[base : self.off[b]])
            row, first, last, at = minimisers(self.data[base : self.off[b]], self.off[a : b + 1] - base, h)
            found.append((row + a, first + base, last + base, at + base, h(at, at + GRAM), h(first, last + SPAN)))
        cat = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 6
        self.row, self.first, self.last, self.at = cat[:4]
        # Minimisers have small hashes: mixed once more, their grams spread evenly over the parts.
        self.gram, self.whole = mix(cat[4]), cat[5].astype(np.uint64)
        self.doc = ids[self.row] if len(self.row) else np.zeros(0, np.int64)

    def cut(self, at: np.ndarray, n: int) -> np.ndarray:
        """The n bytes from each place on, as strings of fixed length; past the end, PAD."""
        data = np.concatenate([self.data, np.full(n, PAD, np.uint8)])
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, n)[at]).view(f"S{n}").ravel() if len(at) else np.zeros(0, f"S{n}")

    def records(self, first: np.ndarray, last: np.ndarray, at: np.ndarray) -> np.ndarray:
        """RECORD bytes for each stretch: from its minimiser to its end, and from there back to its start, filled up with PAD."""
        out = np.empty((len(at), RECORD), np.uint8)
        data = np.concatenate([np.full(REACH, PAD, np.uint8), self.data, np.full(SPAN, PAD, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(data, RECORD)[at + 1]  # REACH - 1 bytes before the minimiser, SPAN from it on
        out[:, :SPAN] = around[:, REACH - 1 :]
        out[:, SPAN:] = around[:, REACH - 2 :: -1]
        out[:, :SPAN][np.arange(SPAN) >= (last + SPAN - at)[:, None]] = PAD
        out[:, SPAN:][np.arange(REACH - 1) >= (at - first)[:, None]] = PAD
        return out.view(f"S{RECORD}").ravel()


@dataclass
class Level:
    """A sorted suffix array without repeats, a value for each suffix, and where the suffixes of each of its batches are."""

    keys: np.ndarray
    values: np.ndarray
    places: list[tuple[int, np.ndarray]]

    def merged(self, newer: Level, join: Callable) -> Level:
        """The merge scan: equal suffixes of the two become one, its value join(older value, newer value)."""
        keys = np.concatenate([self.keys, newer.keys])
        order = np.argsort(keys, kind="stable")  # two sorted runs: a timsort merges them in one pass
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        to = np.empty(len(keys), np.int64)
        to[order] = np.cumsum(new) - 1
        a, b = to[: len(self.keys)], to[len(self.keys) :]
        values = np.empty((int(new.sum()), *self.values.shape[1:]), self.values.dtype)
        values[b] = newer.values
        met = np.zeros(len(values), bool)
        met[b] = True
        both = met[a]
        values[a[~both]] = self.values[~both]
        values[a[both]] = join(self.values[both], values[a[both]])
        return Level(keys[new], values, [(r, a[p]) for r, p in self.places] + [(r, b[p]) for r, p in newer.places])


class Family:
    """Levels whose sizes grow geometrically; batches are added in order."""

    def __init__(self, join: Callable):
        self.join, self.levels = join, []

    def add(self, batch: int, keys: np.ndarray, values: np.ndarray) -> None:
        """keys are sorted and differ."""
        level = Level(keys, values, [(batch, np.arange(len(keys)))])
        while self.levels and len(self.levels[-1].keys) <= len(level.keys):
            level = self.levels.pop().merged(level, self.join)
        self.levels.append(level)

    def whole(self) -> Level:
        while len(self.levels) > 1:
            newer = self.levels.pop()
            self.levels.append(self.levels.pop().merged(newer, self.join))
        return self.levels[0]


def joined_grams(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of grams: the number of different stretches, negative where a single document has the gram."""
    return np.minimum(np.abs(a) + np.abs(b), 1 << 29)


def common(a: np.ndarray) -> np.ndarray:
    """Common prefix length of each row of bytes and the one before it; of the first, 0."""
    out = np.zeros(len(a), np.int64)
    for k in range(1, len(a), 1 << 16):
        same = a[k : k + (1 << 16)] == a[k - 1 : min(len(a), k + (1 << 16)) - 1]
        out[k : k + (1 << 16)] = np.where(same.all(1), a.shape[1], same.argmin(1))
    return out


def first_seen(keys: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For sorted different records with the least id of each: places, and per window the least id of all that have it.

    Window k starts k bytes before the minimiser. Two records have an equal one if they have k bytes before and SPAN - k
    from the minimiser on in common. Records come in parts that don't cut a gram; what is no window has the largest id.
    """
    n = len(keys)
    rec = keys.view(np.uint8).reshape(n, RECORD)
    lcp = common(rec[:, :SPAN])
    heads = np.flatnonzero(lcp < GRAM)
    sizes = np.diff(np.append(heads, n))
    k = np.arange(REACH)
    # Records that share their gram with no other.
    alone = heads[sizes == 1]
    for a in range(0, len(alone), 1 << 16):
        at = alone[a : a + (1 << 16)]
        yield at, np.where(windows_of(rec[at]), low[at, None], _NEVER)
    several = np.repeat(sizes > 1, sizes)
    starts = np.append(heads[sizes > 1], n)
    a = 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + (1 << 16), "right")) - 1)
        at = starts[a] + np.flatnonzero(several[starts[a] : starts[b]])
        part, ids = rec[at], low[at]
        fits = windows_of(part)
        ahead = np.where(np.diff(at, prepend=at[0] - 1) == 1, lcp[at], 0)
        ahead[0] = 0
        back = np.ascontiguousarray(part[:, SPAN:])
        order = np.argsort(back.view(f"S{REACH - 1}").ravel(), kind="stable")
        behind = common(back[order])
        out = np.full((len(at), REACH), _NEVER)
        right, left = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for j in k:
            own = np.flatnonzero(fits[:, j])
            if not len(own):
                continue
            right = np.cumsum(ahead < SPAN - j)
            left[order] = np.cumsum(behind < j)
            key = right[own] * (len(at) + 1) + left[own]
            by = np.argsort(key, kind="stable")
            new = np.append(True, key[by][1:] != key[by][:-1])
            least = np.minimum.reduceat(ids[own][by], np.flatnonzero(new))
            out[own[by], j] = least[np.cumsum(new) - 1]
        yield at, out
        a = b


def windows_of(rec: np.ndarray) -> np.ndarray:
    """Which windows each record has."""
    ahead, behind = (rec[:, :SPAN] != PAD).sum(1), (rec[:, SPAN:] != PAD).sum(1)
    k = np.arange(REACH)
    return (k <= behind[:, None]) & (SPAN - k <= ahead[:, None])


def packed(flags: np.ndarray) -> np.ndarray:
    """Rows of REACH flags as one number each."""
    return np.packbits(np.pad(flags, ((0, 0), (0, 32 - REACH))), axis=1, bitorder="little").view(np.uint32).ravel()


_ZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squash(x: np.ndarray) -> bytes:
    return _ZSTD[0].compress(np.ascontiguousarray(x).tobytes())


def unsquash(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(_ZSTD[1].decompress(b), dtype)


class Entries:
    """For numbers of records, one per entry: the entries of given records."""

    def __init__(self, record: np.ndarray, records: int):
        self.by = np.argsort(record, kind="stable")
        self.bounds = np.searchsorted(record[self.by], np.arange(records + 1))

    def of(self, records: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries and the places of their records among those given, some at a time."""
        count = self.bounds[records + 1] - self.bounds[records]
        done = np.cumsum(count)
        total = int(done[-1]) if len(done) else 0
        for a in range(0, total, most):
            x = np.arange(a, min(a + most, total))
            which = np.searchsorted(done, x, "right")
            yield self.by[self.bounds[records[which]] + x - (done - count)[which]], which


ANSWERS = "batch int, turn int, part int, bits binary"
RUNS = "part int, batch int, first long, keys binary, extra binary"


def answered(runs: DataFrame, turn: int) -> DataFrame:
    """The answers of one visit, one row per batch and part."""

    def scan(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        order = np.argsort(table.column("batch").to_numpy(), kind="stable").tolist()
        column = {c: table.column(c) for c in ("batch", "first", "keys", "extra")}
        rows = []
        if turn == 1:
            family = Family(joined_grams)
            for k in order:
                family.add(column["batch"][k].as_py(), unsquash(column["keys"][k].as_py(), f"S{GRAM}"), unsquash(column["extra"][k].as_py(), "<i4"))
            level = family.whole()
            open_, hot = level.values > 0, level.values > HOT
            for batch, at in level.places:
                rows.append((batch, turn, part, np.packbits(np.stack([open_[at], hot[at]])).tobytes()))
        else:
            family, first = Family(np.minimum), {}
            for k in order:
                b = column["batch"][k].as_py()
                first[b] = column["first"][k].as_py()
                family.add(b, unsquash(column["keys"][k].as_py(), f"S{RECORD}"), unsquash(column["extra"][k].as_py(), "<i8"))
            level = family.whole()
            # Which entries of the batches a record stands for; the batches' answers lie one after the other.
            of = np.concatenate([at for _, at in level.places])
            edges = np.cumsum([0, *(len(at) for _, at in level.places)])
            firsts = np.repeat(np.array([first[b] for b, _ in level.places], np.int64), np.diff(edges))
            below, upto = np.zeros(len(of), np.uint32), np.zeros(len(of), np.uint32)
            entries = Entries(of, len(level.keys))
            for at, low in first_seen(level.keys, level.values):
                for entry, which in entries.of(at):
                    edge = firsts[entry][:, None]
                    below[entry], upto[entry] = packed(low[which] < edge), packed(low[which] <= edge)
            rows = [(b, turn, part, squash(np.stack([below[x:y], upto[x:y]]))) for (b, _), x, y in zip(level.places, edges[:-1].tolist(), edges[1:].tolist())]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["batch", "turn", "part", "bits"])

    return runs.groupBy("part").applyInArrow(scan, ANSWERS)


def dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    """A part for each hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Batch:
    """A batch and the answers so far; recomputes what it asked, in the same order."""

    def __init__(self, texts: pa.Table, answers: pa.Table, parts: int):
        texts = texts.sort_by("did").combine_chunks()
        self.ids, self.parts = texts.column("did").to_numpy(), parts
        column = texts.column("_text")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.s = Suffixes(self.ids, column)
        self.answers = {(t, p): b for t, p, b in zip(*(answers.column(c).to_pylist() for c in ("turn", "part", "bits")))} if len(answers) else {}

    def ask_grams(self) -> None:
        """grams: the different ones in order of part and bytes; gram_of: each stretch's place among them."""
        s = self.s
        keys, hashes, place = s.cut(s.at, GRAM), s.gram, np.zeros(len(s.at), np.int64)
        order = np.lexsort((keys, dealt(hashes, self.parts)))
        keys = keys[order]
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        place[order] = np.cumsum(new) - 1
        self.grams, self.gram_of, self.gram_part = keys[new], place, dealt(hashes[order][new], self.parts)

    def gram_values(self) -> np.ndarray:
        """The number of each gram's different stretches here, negative if one document has it alone."""
        lo, hi = np.full(len(self.grams), _NEVER), np.full(len(self.grams), -(1 << 62))
        np.minimum.at(lo, self.gram_of, self.s.doc)
        np.maximum.at(hi, self.gram_of, self.s.doc)
        pairs = np.unique(mix(self.s.whole) + self.gram_of.astype(np.uint64), return_index=True)[1]
        n = np.bincount(self.gram_of[pairs], minlength=len(self.grams))
        return np.where(lo == hi, -n, n).astype("<i4")

    @staticmethod
    def slices(parts: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Each part that has something, and where."""
        heads = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(parts) else np.zeros(0, np.int64)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(parts)]):
            yield int(parts[a]), slice(a, b)

    def ask_records(self) -> None:
        """records: the different ones of all open stretches in order of part and bytes; record_of, and the stretches' places and rows.

        A stretch of a hot gram stands for each of its windows, dealt by that window.
        """
        s = self.s
        self.ask_grams()
        open_, hot = np.zeros(len(self.grams), bool), np.zeros(len(self.grams), bool)
        for part, at in self.slices(self.gram_part):
            bits = np.unpackbits(np.frombuffer(self.answers[1, part], np.uint8), count=2 * (at.stop - at.start)).astype(bool)
            open_[at], hot[at] = bits.reshape(2, -1)
        which = np.flatnonzero(open_[self.gram_of] & ~hot[self.gram_of]) if len(self.gram_of) else self.gram_of
        many = np.flatnonzero(hot[self.gram_of]) if len(self.gram_of) else self.gram_of
        n = s.last[many] - s.first[many] + 1
        start = np.arange(int(n.sum())) + np.repeat(s.first[many] - (np.cumsum(n) - n), n)
        self.at = np.concatenate([s.at[which], start])
        self.row = np.concatenate([s.row[which], np.repeat(s.row[many], n)])
        keys = s.records(np.concatenate([s.first[which], start]), np.concatenate([s.last[which], start]), self.at)
        part = np.concatenate([dealt(s.gram[which], self.parts), dealt(mix(self.window_hashes(start)), self.parts)])
        order = np.lexsort((keys, part))
        keys, part = keys[order], part[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])) if len(keys) else np.zeros(0, bool)
        self.record_of = np.zeros(len(keys), np.int64)
        self.record_of[order] = np.cumsum(new) - 1
        self.records, self.record_part = keys[new], part[new]
        self.low = np.full(len(self.records), _NEVER)
        np.minimum.at(self.low, self.record_of, self.ids[self.row] if len(self.row) else np.zeros(0, np.int64))

    def window_hashes(self, start: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint64)
        by = np.argsort(start, kind="stable")
        for a, b in row_blocks(self.s.off) if len(start) else ():
            lo, hi = np.searchsorted(start[by], (self.s.off[a], self.s.off[b]))
            if hi > lo:
                p = start[by[lo:hi]] - self.s.off[a]
                out[by[lo:hi]] = SpanHash(self.s.data[self.s.off[a] : self.s.off[b]])(p, p + SPAN)
        return out

    def removed(self) -> np.ndarray:
        """A byte mask of what goes."""
        self.ask_records()
        edge = np.zeros(len(self.s.data) + 1, np.int32)
        n = len(self.records)
        if n:
            below, upto = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
            for part, at in self.slices(self.record_part):
                below[at], upto[at] = unsquash(self.answers[2, part], "<u4").reshape(2, -1)
            doc = self.ids[self.row]
            seen = np.where(doc > self.ids[0], upto[self.record_of], below[self.record_of])
            # And what this batch's own documents have first.
            keys, to = np.unique(self.records, return_inverse=True)
            least = np.full(len(keys), _NEVER)
            np.minimum.at(least, to, self.low)
            entries = Entries(to[self.record_of], len(keys))
            for at, low in first_seen(keys, least):
                for entry, which in entries.of(at):
                    seen[entry] |= packed(low[which] < doc[entry][:, None])
            for a in range(0, len(seen), 1 << 17):
                bits = np.unpackbits(seen[a : a + (1 << 17)].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :REACH]
                who, k = np.nonzero(bits)
                start = self.at[a + who] - k
                edge += np.bincount(start, minlength=len(edge)).astype(np.int32) - np.bincount(start + SPAN, minlength=len(edge)).astype(np.int32)
        return np.cumsum(edge)[:-1] > 0


def table_name() -> str:
    return f"folioforge_batches_{uuid.uuid4().hex}"


def remove_repeats(docs: DataFrame, name: str | None = None) -> DataFrame:
    """doc_id, n_bytes, spans (array of start and end, the maximal removed runs) and kept (the bytes left).

    A byte goes if a SPAN-byte string that covers it also starts in a document with a smaller doc_id, judged on the input. Null
    text counts as empty; a null doc_id as the largest id, returned as null. Rows that share an id don't remove
    from each other, and may be in several batches. A text of any length is one row of one batch, which holds it whole. Columns
    other than doc_id and text are not looked at; an empty table gives no rows. The
    batches' table (name, or one of its own) stays in the warehouse for what is computed from the result later.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), F.coalesce("text", F.lit("")).alias("_text"))
    total = base.agg(F.sum(F.octet_length("_text")).alias("b")).first().b or 0
    batches, parts = max(1, -(-total // BATCH_BYTES)), max(1, -(-total // PART_BYTES))
    name = name or table_name()
    # By text too, so that the rows of one id, null ids for one, need not share a batch.
    (base.repartitionByRange(batches, "did", F.xxhash64("_text")).withColumn("batch", F.spark_partition_id())
     .write.bucketBy(min(batches, BUCKETS), "batch").sortBy("batch").format("parquet").saveAsTable(name))
    table = spark.table(name)
    answers = spark.createDataFrame([], ANSWERS)

    def visit(turn: int, so_far: DataFrame) -> DataFrame:
        def ask(texts: pa.Table, got: pa.Table) -> pa.Table:
            rows = []
            if len(texts):
                b = Batch(texts, got, parts)
                if turn == 1:
                    b.ask_grams()
                    keys, values, part = b.grams, b.gram_values(), b.gram_part
                else:
                    b.ask_records()
                    keys, values, part = b.records, b.low, b.record_part
                number, first = texts.column("batch")[0].as_py(), int(b.ids[0])
                rows = [(p, number, first, squash(keys[at]), squash(values[at])) for p, at in b.slices(part)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["part", "batch", "first", "keys", "extra"])

        runs = table.groupBy("batch").cogroup(so_far.groupBy("batch")).applyInArrow(ask, RUNS)
        return stage(answered(runs, turn), f"answers{turn}")

    for turn in (1, 2):
        answers = answers.unionAll(visit(turn, answers))

    def cut(texts: pa.Table, got: pa.Table) -> pa.Table:
        out = "doc_id n_bytes spans kept".split()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        rows = []
        if len(texts):
            b = Batch(texts, got, parts)
            mask = b.removed()
            for did, a, e in zip(b.ids.tolist(), b.s.off[:-1].tolist(), b.s.off[1:].tolist()):
                own = mask[a:e]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                rows.append((None if did == NO_ID else did, e - a, [{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])], b.s.data[a:e][~own].tobytes()))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), span, pa.binary()))], out)

    return table.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    name = table_name()
    try:
        return stage(remove_repeats(read(spark, sf_dir, "documents"), name).select(
            "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "removed")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


QUERIES = {"op5_suffix_array_dedup": op5_suffix_array_dedup}
#: Every 50-byte string by the least id that has it; hex digits stand for bytes, so that places in a string are places of bytes.
ORACLE = {"op5_suffix_array_dedup": f"""
    WITH d AS (SELECT doc_id, coalesce(doc_id, {NO_ID}) AS did, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
    -- In pieces of 500 starts: a substring of a long string costs as much as the string is long.
    c AS (SELECT r, did, q, substring(h, CAST(2 * q + 1 AS BIGINT), {2 * (500 + SPAN - 1)}) AS h FROM (SELECT r, did, h, unnest(range(0, len(h) // 2 - {SPAN - 1}, 500)) AS q FROM d WHERE len(h) >= {2 * SPAN}) q),
    w AS (SELECT r, did, q + p AS p, substring(h, CAST(2 * p + 1 AS BIGINT), {2 * SPAN}) AS s FROM (SELECT r, did, q, h, unnest(range(len(h) // 2 - {SPAN - 1})) AS p FROM c) q),
    f AS (SELECT s, min(did) AS first FROM w GROUP BY s),
    g AS (SELECT w.r, w.p, max(w.p) OVER (PARTITION BY w.r ORDER BY w.p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w JOIN f ON w.s = f.s WHERE w.did > f.first),
    i AS (SELECT r, p, sum(CASE WHEN before + {SPAN} >= p THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run FROM g),
    s AS (SELECT r, run, min(p) AS a, max(p) + {SPAN} AS b, lag(max(p) + {SPAN}, 1, 0) OVER (PARTITION BY r ORDER BY run) AS last FROM i GROUP BY r, run),
    k AS (SELECT d.r, sum(b - a) AS n, count(*) AS m, string_agg(substring(h, CAST(2 * last + 1 AS BIGINT), CAST(2 * (a - last) AS BIGINT)), '' ORDER BY a) || substring(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS kept FROM s JOIN d ON d.r = s.r GROUP BY d.r)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(m, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r"""}
