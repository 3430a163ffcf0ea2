"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Only the lengths matter to the packer, and there are at most `limit` of them, so the plan is made
on the histogram of piece lengths (a table of fixed size): a sequence is filled greedily with the
longest piece that fits, then its smallest piece gives way to two unpacked ones that fill the
widened gap better, and the same pattern is repeated while pieces of its lengths last. Pieces
find their place in the plan by their rank among those of equal length; ranks are counted in
salted groups, and places are looked up in the plan itself, so a length that most pieces share meets in no task.
A piece alone in its sequence keeps it: nothing that is left fits beside it, now or later.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm import common, textops

#: Words a Python worker remembers; then it starts anew.
CACHE_WORDS = 1_500_000
#: Groups that a length is ranked in, at least, and rows a group is aimed at.
LEAST_SALTS = 256
GROUP_ROWS = 200_000
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?"]] = True


class WordCache:
    """Token ids of words already met, by 64-bit hash of the word."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        """hashes are sorted, new and as many as words."""
        for i in range(0, len(words), 20_000):
            got = [e.ids for e in self.tokenizer.encode_batch(words[i : i + 20_000], add_special_tokens=False)]
            size = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for ids in got for x in ids), np.uint32, int(size.sum()))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros(len(self.ids), np.uint32)))
            self.ids[self.used : self.used + len(flat)] = flat
            h = hashes[i : i + len(got)]
            to = np.searchsorted(self.hash, h)
            self.begin = np.insert(self.begin, to, self.used + np.cumsum(size) - size)
            self.size = np.insert(self.size, to, size)
            self.hash = np.insert(self.hash, to, h)
            self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by row) of texts. The tokenizer drops white space and never merges across it,
        nor across a letter and the stop that ends a word, so words can be encoded one by one."""
        start, end, row = textops.words(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        letter = LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        stop = (end - start > 1) & STOP[data[end - 1]]
        stop[stop] &= letter[end[stop] - 2]
        tails = np.flatnonzero(stop)
        all_start = np.concatenate((start, end[tails] - 1))
        all_end = np.concatenate((np.where(stop, end - 1, end), end[tails]))
        order = np.argsort(all_start, kind="stable")
        start, end, row = all_start[order], all_end[order], np.concatenate((row, row[tails]))[order]
        h, first, back = np.unique(textops.word_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.hash) + len(h) > CACHE_WORDS:
            self.clear()
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        new = np.ones(len(h), bool) if not len(self.hash) else self.hash[at] != h
        if new.any():
            raw = data.tobytes()
            self.add(h[new], [raw[start[i] : end[i]].decode() for i in first[new]])
        at = np.searchsorted(self.hash, h)[back]
        size = self.size[at]
        ends = np.cumsum(size)
        source = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(self.begin[at], size)
        per_row = np.bincount(row, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        return self.ids[source], np.concatenate(([0], np.cumsum(per_row)))


def _pieces(path: str, limit: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = textops.worker_state()
        caches = state.__dict__.setdefault("word_caches", {})
        if path not in caches:
            caches[path] = WordCache(path)
        cache = caches[path]
        for batch in batches:
            data, offsets = textops.column_bytes(batch["text"])
            for i, j in textops.slices(offsets, 4 * textops.SLICE_BYTES // 2):
                ids, off = cache.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out: list[list] = [[], [], [], [], []]
                last = np.array([end_id], np.uint32)
                for r in range(j - i):
                    own = np.concatenate((ids[off[r] : off[r + 1]], last))
                    for k, at in enumerate(range(0, len(own), limit)):
                        part = own[at : at + limit]
                        for to, x in zip(out, (i + r, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(out[0])), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["key", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: np.ndarray, limit: int) -> list[tuple[list[int], int]]:
    """Best-two-fit on a histogram: counts[n] pieces of length n. Returns (lengths of a sequence, times)."""
    counts = counts.astype(np.int64).copy()
    out = []
    longest = len(counts) - 1

    def best(most: int, left: np.ndarray) -> int:
        """Longest piece of at most `most` that is left, or 0."""
        most = min(most, longest)
        found = np.flatnonzero(left[1 : most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    while (first := best(limit, counts)) > 0:
        left = counts.copy()
        bin_, gap = [first], limit - first
        left[first] -= 1
        while gap and (n := best(gap, left)):
            times = int(min(left[n], gap // n))
            bin_ += [n] * times
            left[n] -= times
            gap -= n * times
        if gap and len(bin_) > 1:
            small = bin_[-1]
            room, sizes = gap + small, np.flatnonzero(left)
            sizes = sizes[sizes < room]
            if len(sizes):
                # for each piece the longest partner that still fits; a partner of equal length needs two pieces
                at = np.searchsorted(sizes, room - sizes, side="right") - 1
                ok = at >= 0
                same = ok & (sizes[at] == sizes) & (left[sizes] < 2)
                at = np.where(same, at - 1, at)
                ok = at >= 0
                total = np.where(ok, sizes + sizes[np.maximum(at, 0)], 0)
                k = int(total.argmax())
                if total[k] > small:
                    bin_ = bin_[:-1] + [int(sizes[k]), int(sizes[at[k]])]
        lengths, need = np.unique(bin_, return_counts=True)
        times = int((counts[lengths] // need).min())
        counts[lengths] -= need * times
        out.append((sorted(bin_, reverse=True), times))
    return out


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048, end_id: int = 0, salts: int | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A document is its token ids and `end_id`; a null or empty text is `end_id` alone. Only documents
    over `limit` tokens are cut, into pieces of `limit`. Rows that repeat a key are packed as often as
    they occur, null keys too; other columns are ignored; an empty table gives an empty one.
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    pieces = common.stored(texts.mapInArrow(_pieces(tokenizer, limit, end_id), "key long, piece int, start long, length long, ids_crc32 long"))
    counts = np.zeros(limit + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `limit` rows
        counts[r.length] = r.n
    # ranks are taken within a length and a salt: the commonest length is parted into as many groups as keep each within GROUP_ROWS
    salts = salts or max(LEAST_SALTS, -(-int(counts.max()) // GROUP_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.lit(salts)).cast("int"))
    groups = common.stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))  # at most limit * salts rows
    # of each length: first rank, sequences, first sequence, offset; equal neighbours in a sequence are one entry. At most some `limit` patterns
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    rank = np.zeros(limit + 1, np.int64)
    sequence = 0
    for lengths, times in plan(counts, limit):
        at = 0
        for n, same in groupby(lengths):
            reps = len(list(same))
            slots.setdefault(n, []).append((int(rank[n]), times, sequence, at))
            rank[n] += times * reps
            at += n * reps
        sequence += times
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = salted.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at"))
    return ranked.mapInArrow(_placed(slots), "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _placed(slots: dict[int, list[tuple[int, int, int, int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {n: tuple(np.array(x, np.int64) for x in zip(*entries, strict=True)) for n, entries in slots.items()}
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                rank0, times, sequence0, offset0 = known[n]
                at = np.searchsorted(rank0, rank[rows], side="right") - 1
                # an entry holds so many sequences, then the next place in the same ones
                behind = rank[rows] - rank0[at]
                sequence[rows], offset[rows] = sequence0[at] + behind % times[at], offset0[at] + behind // times[at] * n
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("key", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)], ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def word_tokenizer() -> str:
    """Path of the public tokenizer the query packs for; every executor has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_two_fit(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), word_tokenizer()).withColumnRenamed("key", "doc_id")
