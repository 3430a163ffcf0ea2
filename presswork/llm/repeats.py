"""Suffix-array deduplication: find and cut byte strings that occur more than once.

The index is a logarithmic family of sparse suffix arrays. A suffix is kept where its head (the
first `gram` bytes) has the smallest hash of a `length`-byte window; the choice depends on the
window's bytes alone, so equal windows keep equal suffixes and no repeat of `length` bytes can be
missed. Each batch of documents gets its sorted array of heads, is merge-scanned (a sorted join)
against every level, and is put in at level 0; two levels of equal size merge into the next one.

The scan gives the heads that occur again. Exact ends come from the texts: all windows around one
kept suffix form a run. Runs whose whole extent recurs are cut whole; the others are
compared in blocks of windows and, at the edges of a match, window by window. All counts are
aggregates with map-side combining and all joins are on content hashes, so neither a passage that
a third of the documents share nor a long group of copies meets in one task.

Hashes have 64 bits; strings are compared by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import common, textops

#: Windows that share one block of the edge search.
BLOCK = 16
#: Windows of one part of a long text; bits that hold a place in a slice of texts, which has no more bytes than that.
PART_BYTES = textops.SLICE_BYTES
POSITION_BITS = 28
#: Runs whose windows are hashed at once.
RUNS_AT_ONCE = 2_000


class Runs:
    """Runs of windows of one slice of texts, by kept suffix."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, powers: textops.Powers, length: int, gram: int) -> None:
        self.data, self.length, self.gram = data, length, gram
        self.start = self.stop = self.at = self.row = np.zeros(0, np.int64)
        self.head = self.extent = np.zeros(0, np.uint64)
        self.n = len(data)
        if self.n < length:
            return
        self.cum, self.down = textops.prefix_hash(data, textops.CODES, powers)
        with np.errstate(over="ignore"):
            heads = textops.mix((self.cum[gram:] - self.cum[:-gram]) * self.down[: self.n - gram + 1])
        mask = np.uint64((1 << POSITION_BITS) - 1)
        width = length - gram + 1
        key = (heads & ~mask) | (mask - np.arange(len(heads), dtype=np.uint64))
        key = np.concatenate((key, np.full(width + (-len(key)) % width, np.iinfo(np.uint64).max, np.uint64)))
        tiles = key.reshape(-1, width)
        before = np.minimum.accumulate(tiles, axis=1).ravel()
        after = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = self.n - length + 1
        least = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
        kept = (mask - (least & mask)).astype(np.int64)
        first, last = offsets[:-1], offsets[1:] - length + 1
        whole = last > first
        inside = np.zeros(windows + 2, np.int32)
        inside[first[whole]] += 1
        inside[last[whole]] -= 1
        inside = np.cumsum(inside)[:windows] > 0
        new = np.ones(windows, bool)
        new[1:] = (kept[1:] != kept[:-1]) | ~inside[:-1]
        end = np.ones(windows, bool)
        end[:-1] = new[1:] | ~inside[1:]
        self.start, self.stop = np.flatnonzero(new & inside), np.flatnonzero(end & inside)
        self.at = kept[self.start]
        self.head = heads[self.at]
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        with np.errstate(over="ignore"):
            shape = (self.at - self.start).astype(np.uint64) * np.uint64(1000003) + (self.stop - self.start).astype(np.uint64)
            self.extent = textops.mix(self.hash(self.start, self.stop + length) + textops.mix(shape))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textops.span_hash(self.cum, self.down, start, end)


def _each_slice(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, bytes, offsets, place of the bytes in the row's text): some rows, or a part of a single longer one. Parts overlap so far that
    each window of `length` bytes is in one of them."""
    for batch in batches:
        data, offsets = textops.column_bytes(batch["text"])
        for i, j in textops.slices(offsets):
            begin, end = offsets[i], offsets[j]
            for at in range(begin, max(begin + 1, end - length + 1), PART_BYTES) if j == i + 1 else (begin,):
                to = min(end, at + PART_BYTES + length - 1) if j == i + 1 else end
                yield batch.slice(i, j - i), data[at:to], np.array([0, to - at]) if j == i + 1 else offsets[i : j + 1] - begin, int(at - begin)


def _heads(length: int, gram: int, batches: int) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textops.Powers()
        for batch, data, offsets, _ in _each_slice(rows, length):
            r = Runs(data, offsets, powers, length, gram)
            of = (common.spark_xxhash64(batch["key"].to_numpy()) % np.uint64(batches)).astype(np.int32)[r.row]
            for k in range(batches):
                head, n = np.unique(r.head[of == k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(head), k, np.int32)), pa.array(textops.signed(head)), pa.array(n.astype(np.int64))], ["batch", "head", "n"])

    return run


def _runs(length: int, gram: int, again: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textops.Powers()
        for batch, data, offsets, base in _each_slice(batches, length):
            r = Runs(data, offsets, powers, length, gram)
            k = np.flatnonzero(common.in_bitmap(again, textops.signed(r.head)))
            zero = offsets[r.row[k]] - base
            yield pa.RecordBatch.from_arrays(
                [batch["key"].take(pa.array(r.row[k])), pa.array(textops.signed(r.head[k])), pa.array(textops.signed(r.extent[k]))]
                + [pa.array((x[k] - zero).astype(np.int32)) for x in (r.at, r.start, r.stop)],
                ["key", "head", "extent", "at", "first", "last"],
            )

    return run


RUN_SCHEMA = "key long, head long, extent long, at int, first int, last int"


def _blocks(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textops.Powers()
        for batch, data, offsets, base in _each_slice(batches, length):
            runs = batch["runs"]
            row = np.repeat(np.arange(batch.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
            at, first, last, copies = (runs.flatten().field(c).to_numpy().astype(np.int64) for c in ("at", "first", "last", "n"))
            end = offsets[row + 1] - length
            at, first, last = (x - base + offsets[row] for x in (at, first, last))
            own = (first >= offsets[row]) & (last <= end)  # of a part of a long text: the runs that begin in it
            own &= (first < PART_BYTES) if batch.num_rows == 1 else True
            at, first, last, copies, row = (x[own] for x in (at, first, last, copies, row))
            if not len(row):
                continue
            cum, down = textops.prefix_hash(data, textops.CODES, powers)
            for k in range(0, len(row), RUNS_AT_ONCE):
                yield blocks(cum, down, batch["key"], offsets, base, *(x[k : k + RUNS_AT_ONCE] for x in (at, first, last, copies, row)))

    def blocks(cum, down, keys, offsets, base, at, first, last, copies, row) -> pa.RecordBatch:  # noqa: ANN001, PLR0913
        size = last - first + 1
        of = np.repeat(np.arange(len(size)), size)
        window = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of]
        number = (at[of] - window) // BLOCK
        cuts = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (number[1:] != number[:-1]))))
        ends = np.concatenate((cuts[1:], [len(of)]))
        core = at[of[cuts]] - BLOCK * number[cuts]
        inner = textops.span_hash(cum, down, core, core - BLOCK + 1 + length)
        whole = textops.span_hash(cum, down, window[cuts], window[ends - 1] + length)
        zero = offsets[row[of[cuts]]] - base
        windows = textops.binary_array(textops.span_hash(cum, down, window, window + length), np.append(cuts, len(of)))
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(row[of[cuts]])), pa.array(copies[of[cuts]]), pa.array(textops.signed(inner)), pa.array(textops.signed(whole))]
            + [pa.array((x - zero).astype(np.int32)) for x in (window[cuts], window[ends - 1])]
            + [windows],
            ["key", "n", "core", "whole", "first", "last", "windows"],
        )

    return run


BLOCK_SCHEMA = "key long, n long, core long, whole long, first int, last int, windows binary"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = textops.column_bytes(batch["windows"])
        size = np.diff(offsets) // 8
        at = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(at)) - np.repeat(offsets[:-1] // 8, size) + np.repeat(batch["first"].to_numpy(), size)
        h = np.frombuffer(data.tobytes(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(at)), batch["n"].take(pa.array(at)), pa.array(place.astype(np.int32)), pa.array(h)], ["key", "n", "first", "window"])


class SuffixIndex:
    """Levels of sorted suffix heads; level k holds 2**k batches."""

    def __init__(self, length: int, gram: int) -> None:
        self.length, self.gram = length, gram
        self.levels: dict[int, DataFrame] = {}
        self.found: list[DataFrame] = []

    def heads(self, texts: DataFrame, batches: int) -> DataFrame:
        """(batch, head, n) of the kept suffixes of (key, text) rows, dealt into `batches` by their keys."""
        return common.stored(texts.select("key", "text").mapInArrow(_heads(self.length, self.gram, batches), "batch int, head long, n long"))

    def add(self, heads: DataFrame) -> None:
        """Index a batch (head, n); the heads it shares with itself or with a level go to `found`."""
        batch = common.stored(heads.groupBy("head").agg(F.sum("n").alias("n")).sortWithinPartitions("head"))
        self.found.append(batch.where("n > 1").select("head"))
        array = batch.select("head")
        for level in self.levels.values():
            self.found.append(array.join(level, "head"))
        size = 0
        while size in self.levels:
            array, size = self.levels.pop(size).union(array).distinct(), size + 1
        self.levels[size] = common.stored(array.sortWithinPartitions("head")) if size else array

    def repeated(self) -> DataFrame:
        """Distinct heads that occur at more than one place."""
        out = self.found[0]
        for more in self.found[1:]:
            out = out.union(more)
        return out.distinct()


def repeated_spans(docs: DataFrame, key: str, text: str = "text", length: int = 400, batches: int = 4) -> DataFrame:
    """(key, first, last) ranges of window starts whose `length` bytes also start anywhere else.

    `key` must be unique and not null. `batches` arrays are indexed one after another.
    """
    gram = length // 2
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    index = SuffixIndex(length, gram)
    heads = index.heads(texts, batches)
    for k in range(batches):
        index.add(heads.where(F.col("batch") == k))
    again = common.bitmap(common.stored(index.repeated()), "head")
    runs = common.stored(texts.mapInArrow(_runs(length, gram, again), RUN_SCHEMA))

    extents = runs.groupBy("head", "extent").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last", "at")).alias("one"))
    extents = common.stored(extents)
    whole = runs.join(extents.where("n > 1").select("head", "extent"), ["head", "extent"]).select("key", "first", "last")

    several = extents.groupBy("head").agg(F.count("*").alias("extents")).where("extents > 1").select("head")
    edge = common.stored(extents.join(several, "head").select("one.*", "n"))
    near = texts.where(common.may_be_in(common.bitmap(edge, "key"), "key"))
    asked = edge.groupBy("key").agg(F.collect_list(F.struct("at", "first", "last", "n")).alias("runs"))
    blocks = common.stored(near.join(asked, "key").mapInArrow(_blocks(length), BLOCK_SCHEMA))

    shared = blocks.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core")
    blocks = common.stored(blocks.join(shared, "core"))
    copies = blocks.groupBy("whole").agg(F.count("*").alias("c"), F.min(F.struct("key", "n", "first", "windows")).alias("one"))
    copies = common.stored(copies)
    same = blocks.join(copies.where("c > 1").select("whole"), "whole").select("key", "first", "last")
    windows = common.stored(copies.select("one.*", "c").select("key", F.when(F.col("c") > 1, 2).otherwise(F.col("n")).alias("n"), "first", "windows").mapInArrow(_windows, "key long, n long, first int, window long"))
    twice = windows.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").select("window")
    single = windows.where("n = 1").join(twice, "window").select("key", "first", F.col("first").alias("last"))
    return whole.unionByName(same).unionByName(single)


def _cut(length: int, characters: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textops.column_bytes(batch["text"])
            out: list[list] = [[], [], [], []]
            spans = batch["spans"].fill_null(pa.array([[]], batch["spans"].type)[0]) if batch["spans"].null_count else batch["spans"]
            bounds = np.concatenate(([0], np.cumsum(spans.value_lengths().to_numpy(zero_copy_only=False))))
            firsts, lasts = (spans.flatten().field(c).to_numpy() for c in ("first", "last"))
            for row in range(batch.num_rows):
                own = data[offsets[row] : offsets[row + 1]]
                first, last = firsts[bounds[row] : bounds[row + 1]], lasts[bounds[row] : bounds[row + 1]]
                gone = np.bincount(first, minlength=len(own) + 1)
                gone -= np.bincount(np.minimum(len(own), last.astype(np.int64) + length), minlength=len(own) + 1)
                cut = np.cumsum(gone)[:-1] > 0
                begins = np.flatnonzero(cut & ~np.concatenate(([False], cut[:-1]))) if len(own) else []
                stays = ~cut
                if characters:  # a character goes with any of its bytes
                    char = np.cumsum((own & 0xC0) != 0x80)
                    stays = np.bincount(char[cut], minlength=int(char[-1]) + 1 if len(char) else 1)[char] == 0
                for to, x in zip(out, (len(own), int(cut.sum()), len(begins), own[stays].tobytes()), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch["key"], *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()), batch["rest"]], ["key", "n_bytes", "n_removed", "n_spans", "kept", "rest"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, batches: int = 4, carry: tuple[str, ...] = (), characters: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary, rest) of every row with a key.

    Every byte that a `length`-byte string covers which also starts anywhere else, in the same text
    or another, is removed; all strings are judged on the input. A null text counts as empty, texts
    under `length` bytes are kept as they are; rest is a struct of the columns named in `carry`, others are
    ignored. With `characters`, `kept` is also without the other bytes of characters that were cut in part. Rows that repeat a key are one document, the smallest text of them; rows whose key is null
    are left out. An empty table gives an empty one.
    """
    rest = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    docs = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), rest.alias("rest")).where("key is not null")
    if docs.groupBy("key").count().where("count > 1").limit(1).count():
        docs = common.stored(docs.groupBy("key").agg(F.min(F.struct("text", "rest")).alias("one")).select("key", "one.text", "one.rest"))
    spans = common.stored(repeated_spans(docs, "key", "text", length, batches))
    by_key = spans.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    may = common.may_be_in(common.bitmap(spans.select("key").distinct(), "key"), "key")
    schema = f"key long, n_bytes long, n_removed long, n_spans long, kept binary, rest {docs.schema['rest'].dataType.simpleString()}"
    cut = docs.where(may).join(by_key, "key", "left").mapInArrow(_cut(length, characters), schema)
    none = F.lit(0).cast("long")
    left = docs.where(~may).select("key", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"), "rest")
    return cut.unionByName(left)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return remove_repeats(docs).select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, bytes], length: int) -> dict[int, bytes]:
    """What must be left of each text, for tests on small inputs."""
    seen: dict[bytes, int] = {}
    for t in texts.values():
        for i in range(len(t) - length + 1):
            digest = hashlib.blake2b(t[i : i + length]).digest()
            seen[digest] = seen.get(digest, 0) + 1
    out = {}
    for k, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[i : i + length]).digest()] > 1:
                gone[i : i + length] = True
        out[k] = bytes(np.frombuffer(t, np.uint8)[~gone]) if t else b""
    return out
