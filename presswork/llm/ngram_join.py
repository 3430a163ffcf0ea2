"""N-gram Jaccard self-join: documents whose word-shingle sets have a similarity of 0.75 or more.

A document's shingles are hashed into groups; the group counts are a point, and the overlap of two
documents is at most the sum of their coordinate minima. Points of documents that share a rare
shingle are packed into a count-vector R-tree, whose boxes (coordinate maxima) bound every pair of
nodes, level by level, before any pair of points is looked at; surviving pairs are verified on the texts.

In as many dimensions as text needs, boxes alone don't part a whole corpus, so the tree's top level
is exact instead: with a similarity t, two documents must share one of the first n - ceil(t n) + 1
shingles of each in any fixed order, and the order taken here is from rare to frequent (by a
fixed-size count sketch), so that a passage which many documents share comes last.

1. equal sets collapse into one class; 2. a shingle of two classes goes to its tree at once; if there are more,
each is compared with the hub of the shingle first, the class with the smallest share of rarer shingles, and the links found are joined into components; 3. every shingle whose owners are in several components
searches its tree for links between different components. A pair's overlap is bounded by the coordinate minima and,
under its first common shingle, by what either has behind that one. Links inside a component are not needed to know it, so a group of
thousands of near copies costs a few comparisons for each of its members. Sets are compared as 64-bit hashes of
shingles, and equal sets by 128 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import common, textops

#: Coordinates of a point; counts are held in a byte and 255 stands for any higher count.
GROUPS = 256
#: The bound of a coordinate held as 255; a text that a row can hold has fewer shingles in a group.
ANY_COUNT = 1 << 23
#: Neighbouring coordinates that are added up for the boxes and the first test of a pair.
MERGED = 4
SKETCH_BITS = 23
SKETCH_PARTS = 256
#: Most rows of one block of a shingle's group, and entries of a node of the tree.
BLOCK_ROWS = 512
FAN = 8
#: Pairs of nodes that are looked at at once.
PAIRS = 4096
#: Pairs that are verified beside one copy of their hub's text, about; and kinds of rows there.
TOGETHER = 256
ASKED, HUB, OTHER = range(3)


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, distinct shingles, offsets by row) of a few megabytes of text at a time."""
    powers = textops.Powers()
    for batch in batches:
        data, offsets = textops.column_bytes(batch["text"])
        for i, j in textops.slices(offsets):
            h, row, _ = textops.shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], powers, size)
            yield batch.slice(i, j - i), *textops.distinct_by_row(h, row, j - i)


def _set_keys(u: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, as two longs."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (textops.mix(u + np.uint64(7)), textops.mix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
        n = (off[1:] - off[:-1]).astype(np.uint64)
        a, b = (textops.signed(textops.mix(s[off[1:]] - s[off[:-1]] + n)) for s in sums)
    return a, b


def _points(u: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows = len(off) - 1
    cell = np.repeat(np.arange(rows), np.diff(off)) * GROUPS + (u >> np.uint64(40)).astype(np.int64) % GROUPS
    return np.minimum(np.bincount(cell, minlength=rows * GROUPS), 255).astype(np.uint8).reshape(rows, GROUPS)


PROFILE_SCHEMA = "key long, n long, k1 long, k2 long, point binary, part int, counts binary"


def _profile(size: int) -> Callable:
    def emit(sketch: np.ndarray) -> pa.RecordBatch:
        n = SKETCH_PARTS
        counts = pa.array([zlib.compress(p.tobytes(), 1) for p in sketch.reshape(n, -1)], pa.binary())
        sketch[:] = 0
        return pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), counts], ["key", "n", "k1", "k2", "point", "part", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint16)
        held = 0
        for rows, u, off in _slices(batches, size):
            n = rows.num_rows
            if held + n > 60_000:  # a count is at most the number of rows
                yield emit(sketch)
                held = 0
            slot, count = np.unique((u & np.uint64(len(sketch) - 1)).astype(np.uint32), return_counts=True)
            sketch[slot] += count.astype(np.uint16)
            held += n
            k1, k2 = _set_keys(u, off)
            yield pa.RecordBatch.from_arrays(
                [rows["key"], pa.array(np.diff(off)), pa.array(k1), pa.array(k2), pa.array([p.tobytes() for p in _points(u, off)], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                ["key", "n", "k1", "k2", "point", "part", "counts"],
            )
        if held:
            yield emit(sketch)

    return run


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            c = np.frombuffer(zlib.decompress(counts), np.uint16).astype(np.uint32)
            total[part] = total[part] + c if part in total else c
    if total:
        counts = [zlib.compress(c.tobytes(), 1) for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(counts, pa.binary())], ["part", "counts"])


def _prefixes(size: int, percent: int, sketch: np.ndarray, buckets: int) -> Callable:
    frequent = 2 * float(sketch.mean()) + 64

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], hot: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        token, k1, place = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        if not len(token):
            return
        bucket = ((k1.view(np.uint64) if hot else textops.mix(token)) >> np.uint64(20)).astype(np.int64) % buckets
        order = np.lexsort((k1, token, bucket))
        token, k1, place, bucket = (x[order] for x in (token, k1, place, bucket))
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (k1[1:] != k1[:-1])
        token, k1, place, bucket = (x[fresh] for x in (token, k1, place, bucket))
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        packed = [textops.binary_array(x, cuts) for x in (token, k1, place)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([hot] * (len(cuts) - 1)), *packed], ["bucket", "hot", "tokens", "owners", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cold: list = []
        hot: list = []
        waiting, seen = 0, set()
        for _, u, off in _slices(batches, size):
            k1, _ = _set_keys(u, off)
            n = np.diff(off)
            fresh = np.zeros(len(n), bool)
            for i, k in enumerate(k1.tolist()):
                if n[i] and k not in seen:
                    seen.add(k)
                    fresh[i] = True
            if len(seen) > 200_000:
                seen.clear()
            row = np.repeat(np.arange(len(n)), n)
            est = sketch[(u & np.uint64(len(sketch) - 1)).astype(np.int64)]
            order = (est.astype(np.uint64) << np.uint64(48)) | (textops.mix(u) >> np.uint64(16))
            first = n - (percent * n + 99) // 100 + 1
            chosen = [off[i] + np.argpartition(order[off[i] : off[i + 1]], first[i] - 1)[: first[i]] for i in np.flatnonzero(fresh)]
            chosen = [x[np.argsort(order[x])] for x in chosen]
            use = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in chosen]) if chosen else np.zeros(0, np.int32)
            often = est[use] > frequent
            cold.append((u[use[~often]], k1[row[use[~often]]], place[~often]))
            if often.any():
                hot.append((u[use[often]], k1[row[use[often]]], place[often]))
            waiting += len(use)
            if waiting > 1_000_000:
                yield from flush(cold, False)
                yield from flush(hot, True)
                waiting = 0
        yield from flush(cold, False)
        yield from flush(hot, True)

    return run


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows (token, owner, place of the token among the owner's) of tokens with several owners; the batches are sorted by bucket.

    A hot token is dealt by its owners, so a bucket holds all copies of a row but not all owners: tokens of one owner stay.
    """

    def settle(held: list, alone: bool) -> Iterator[pa.RecordBatch]:
        if held:
            token, owner, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((owner, token))
            token, owner, place = token[order], owner[order], place[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner, place = token[new], owner[new], place[new]
            if not alone:
                same = token[1:] == token[:-1]
                several = np.zeros(len(token), bool)
                several[1:] |= same
                several[:-1] |= same
                token, owner, place = token[several], owner[several], place[several]
            for i in range(0, len(token), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (textops.signed(token), owner, place)], ["token", "owner", "place"])

    cold: list = []
    hot_rows: list = []
    at = None
    for batch in batches:
        for bucket, hot, tokens, owners, places in zip(*(batch[c].to_pylist() for c in ("bucket", "hot", "tokens", "owners", "places")), strict=True):
            if bucket != at:
                yield from settle(cold, False)
                yield from settle(hot_rows, True)
                at = bucket
            (hot_rows if hot else cold).append((np.frombuffer(tokens, np.uint64), np.frombuffer(owners, np.int64), np.frombuffer(places, np.int32)))
    yield from settle(cold, False)
    yield from settle(hot_rows, True)


class Tree:
    """A count-vector R-tree over points in order of size: a node's box has its coordinate maxima, least and largest size,
    largest possible overlap and its component if it has one only."""

    def __init__(self, points: np.ndarray, n: np.ndarray, most: np.ndarray, comp: np.ndarray, percent: int) -> None:
        coarse = points.reshape(len(n), -1, MERGED).sum(axis=2, dtype=np.int32)
        self.order = np.lexsort((coarse[:, coarse.var(axis=0).argmax()], n))
        self.points, self.percent = points[self.order], percent
        n, comp = n[self.order], comp[self.order]
        self.levels = [(coarse[self.order], n, n, most[self.order], comp, comp)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            least, largest = np.minimum.reduceat, np.maximum.reduceat
            self.levels.append(tuple(f(x, at) for f, x in zip((largest, least, largest, largest, least, largest), self.levels[-1], strict=True)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a point of node i and one of node j can be similar enough: coordinate minima, summed, bound the overlap."""
        box, low, high, most, first, last = self.levels[level]
        ok = (100 * high[i] >= self.percent * low[j]) & (100 * high[j] >= self.percent * low[i])
        ok &= (first[i] != last[i]) | (first[j] != last[j]) | (first[i] != first[j])
        need = self.percent * (low[i] + low[j])
        ok &= (100 + self.percent) * np.minimum(most[i], most[j]) >= need
        k = np.flatnonzero(ok)
        ok[k] = (100 + self.percent) * np.minimum(box[i[k]], box[j[k]]).sum(axis=1, dtype=np.int64) >= need[k]
        return ok

    def pairs(self, side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points of different components (and, if given, different sides) that the bounds allow."""
        side = None if side is None else side[self.order]
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        children = np.arange(FAN)
        while stack:
            level, i, j = stack.pop()
            if len(i) > PAIRS:
                stack += [(level, i[k : k + PAIRS], j[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]
                continue
            if level == 0:
                other = i < j if side is None else (i < j) & (side[i] != side[j])
                i, j = i[other], j[other]
            ok = self.may_link(level, i, j)
            i, j = i[ok], j[ok]
            if level == 0:
                overlap = np.minimum(self.points[i], self.points[j]).sum(axis=1, dtype=np.int64)
                n = self.levels[0][1]
                ok = (100 + self.percent) * overlap >= self.percent * (n[i] + n[j])
                yield self.order[i[ok]], self.order[j[ok]]
            elif len(i):
                below = len(self.levels[level - 1][0])
                i, j = np.broadcast_arrays((i[:, None] * FAN + children)[:, :, None], (j[:, None] * FAN + children)[:, None, :])
                real = (i < below) & (j < below) & (i <= j)
                stack.append((level - 1, i[real], j[real]))


def _between(percent: int) -> Callable:
    """Candidate pairs within runs of equal (token, lo, hi) rows."""

    def settle(held: list[pa.RecordBatch], seen: set) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        side = None if lo == hi else t["block"].to_numpy() == lo
        if t.num_rows < 2 or side is not None and (side.all() or not side.any()):
            return
        owner, n, most, comp = (t[c].to_numpy() for c in ("owner", "n", "most", "component"))
        points = np.frombuffer(b"".join(t["point"].to_pylist()), np.uint8).reshape(-1, GROUPS).astype(np.int32)
        points[points == 255] = ANY_COUNT
        for i, j in Tree(points, n, most, comp, percent).pairs(side):
            pairs = [(a, b) if a < b else (b, a) for a, b in zip(owner[i].tolist(), owner[j].tolist(), strict=True)]
            pairs = [p for p in pairs if p not in seen]
            seen.update(pairs)
            if len(seen) > 200_000:
                seen.clear()
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        seen: set = set()
        for batch in batches:
            token, lo, hi = (batch[c].to_numpy() for c in ("token", "lo", "hi"))
            if not len(token):
                continue
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for a, b in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(token)])), strict=True):
                mine = (token[a], lo[a], hi[a])
                if held and mine != at:
                    yield from settle(held, seen)
                    held = []
                at = mine
                held.append(batch.slice(a, b - a))
        if held:
            yield from settle(held, seen)

    return run


def _verify(size: int, percent: int) -> Callable:
    """Links among rows (key, chunk, kind, hub, other, text), sorted by the first three: the hubs that a chunk asks for, the texts of the key,
    and the other ends of its pairs. The sets of a chunk's hubs are held, others are looked at one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = textops.Powers()

        def told(text: str) -> tuple[int, np.ndarray]:
            """The class of a text and its set."""
            raw = text.encode()
            own = np.unique(textops.shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), powers, size)[0])
            return int(_set_keys(own, np.array([0, len(own)]))[0][0]), own

        at, wanted, held = None, set(), {}
        for batch in batches:
            found = []
            for key, chunk, kind, hub, other, text in zip(*(batch[c].to_pylist() for c in ("key", "chunk", "kind", "hub", "other")), batch["text"], strict=True):
                if (key, chunk) != at:
                    at, wanted, held = (key, chunk), set(), {}
                if kind == ASKED:
                    wanted.add(hub)
                elif kind == HUB:  # rows that repeat a key bring several texts, of which some are meant
                    if len(held) < len(wanted):
                        own_class, own = told(text.as_py())
                        if own_class in wanted:
                            held[own_class] = own
                elif hub in held:
                    x, (own_class, y) = held[hub], told(text.as_py())
                    common_n = len(np.intersect1d(x, y, assume_unique=True))
                    if own_class == other and 100 * common_n >= percent * (len(x) + len(y) - common_n):
                        found.append((hub, other))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _led(pairs: DataFrame) -> DataFrame:
    """(key, hub, key_other, other, chunk) of pairs of class ids with their keys: the key of more pairs leads, and its pairs are dealt to chunks of some TOGETHER."""
    degree = common.stored(pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree")))
    both = pairs.join(degree.toDF("key_a", "degree_a"), "key_a").join(degree.toDF("key_b", "degree_b"), "key_b")
    side = lambda x, y: F.struct(F.col(f"key_{x}").alias("key"), F.col(x).alias("hub"), F.col(f"degree_{x}").alias("degree"), F.col(f"key_{y}").alias("key_other"), F.col(y).alias("other"))
    leads = (F.col("degree_a") > F.col("degree_b")) | ((F.col("degree_a") == F.col("degree_b")) & (F.col("key_a") < F.col("key_b")))
    chunk = F.pmod(F.xxhash64("hub", "other"), F.ceil(F.col("degree") / TOGETHER)).cast("int")
    return both.select(F.when(leads, side("a", "b")).otherwise(side("b", "a")).alias("led")).select("led.*").select("key", "hub", "key_other", "other", chunk.alias("chunk"))


def _links(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b of class ids, with their keys) that are similar enough, judged on the texts.

    A leader's text goes once to each of its chunks, not to each pair, so a text that is near very many others is neither repeated for all
    of them nor met by all in one task.
    """
    led = common.stored(_led(pairs))
    only = lambda keys: texts.where(common.may_be_in(common.bitmap(keys.distinct(), "key"), "key"))
    none = F.lit(None).cast("long")
    asked = led.select("key", "chunk", F.lit(ASKED).alias("kind"), "hub", none.alias("other"), F.lit(None).cast("string").alias("text")).distinct()
    more = led.where("chunk > 0").select("key", "chunk").distinct()
    first = only(led.select("key")).select("key", F.lit(0).alias("chunk"), "text")
    hubs = first.union(only(more.select("key")).join(more, "key").select("key", "chunk", "text")).select("key", "chunk", F.lit(HUB).alias("kind"), none.alias("hub"), none.alias("other"), "text")
    others = only(led.select(F.col("key_other").alias("key"))).toDF("key_other", "text").join(led, "key_other").select("key", "chunk", F.lit(OTHER).alias("kind"), "hub", "other", "text")
    rows = asked.union(hubs).union(others).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "kind")
    return common.stored(rows.mapInArrow(_verify(size, percent), "a long, b long"))


def _with_components(shared: DataFrame, links: DataFrame) -> DataFrame:
    """(token, owner, component so far) of all rows of `shared`."""
    inner = common.components(links).withColumnRenamed("node", "owner")
    return common.stored(shared.join(inner, "owner", "left").select("token", "owner", "place", F.coalesce("component", "owner").alias("component")))


def _distinct_groups(shared: DataFrame) -> DataFrame:
    """The rows of one token for each distinct set of owners, the first in the order of all: what follows depends on the sets and the places.

    Sets are told apart by sums of two hashes, each in halves that can't overflow; the rows have to be distinct.
    """
    halves = [h for x in (F.xxhash64("owner"), F.xxhash64("owner", F.lit(1))) for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit((1 << 32) - 1)))]
    groups = shared.groupBy("token").agg(F.count("*").alias("rows"), F.min("place").alias("first"), *[F.sum(h).alias(f"x{i}") for i, h in enumerate(halves)])
    kept = groups.where("rows > 1").groupBy("rows", "x0", "x1", "x2", "x3").agg(F.min_by("token", F.struct("first", "token")).alias("token"))
    return shared.join(kept.select("token"), "token", "left_semi")


def _hub_pairs(shared: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the hub of each token with more than two owners and every other owner of it: the hub is the owner that has the
    smallest share of rarer shingles, as the text that near copies were made from has."""
    rows = shared.join(members.select("owner", "n"), "owner").withColumn("most", F.col("n") - F.col("place"))
    hubs = rows.groupBy("token").agg(F.max(F.struct(F.col("most") / F.col("n"), "owner", "n", "most")).alias("hub"), F.count("*").alias("rows")).where("rows > 2")
    both = rows.join(hubs.select("token", "hub"), "token").where("owner <> hub.owner").where((100 + percent) * F.least("most", "hub.most") >= percent * (F.col("n") + F.col("hub.n")))
    return both.select(F.least("hub.owner", "owner").alias("a"), F.greatest("hub.owner", "owner").alias("b")).distinct()


def _blocks(now: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the tokens whose owners are in several components, dealt into pairs of blocks (lo, hi) that hold each pair of owners
    of different components once. Owners in a token's largest component have negative blocks and meet the others only."""
    sizes = now.groupBy("token", "component").agg(F.count("*").alias("rows"))
    top = sizes.groupBy("token").agg(F.count("*").alias("several"), F.max(F.struct("rows", "component")).alias("top"), F.sum("rows").alias("rows")).where("several > 1")
    inner, outer = (F.greatest(F.lit(1), F.ceil(x / BLOCK_ROWS)).cast("int") for x in (F.col("top.rows"), F.col("rows") - F.col("top.rows")))
    rows = now.join(top.select("token", F.col("top.component").alias("main"), inner.alias("inner"), outer.alias("outer")), "token")
    hashed = F.xxhash64("owner")
    inside = F.col("component") == F.col("main")
    rows = rows.withColumn("block", F.when(inside, -1 - F.pmod(hashed, F.col("inner"))).otherwise(F.pmod(hashed, F.col("outer"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.when(inside, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(-F.col("inner"), F.col("outer") - 1))))
    rows = rows.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "owner", "place", "component")
    return rows.join(members.select("owner", "n", "point"), "owner").withColumn("most", F.col("n") - F.col("place"))


def shingle_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id) of every row with a key.

    Two rows link when 100 * intersection >= percent * union of their sets of distinct `size`-word
    shingles (A-Z lower-cased; fewer words: the whole sequence); component_id is the smallest key
    reachable. A null text, or one without words, has an empty set and links with nothing. Rows that
    repeat a key count as one each and share the component found for the key's set; rows with a null
    key are left out. Other columns are ignored; an empty table gives an empty one.
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("key is not null")
    profile = common.stored(texts.mapInArrow(_profile(size), PROFILE_SCHEMA))
    rows = profile.where("part is null").select("key", "n", "k1", "k2", "point")
    classes = common.stored(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("point").alias("point")))
    parts = profile.where("part is not null").select("part", "counts").repartition("part").mapInArrow(_add_sketches, "part int, counts binary")
    sketch = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.uint16)
    for r in parts.collect():  # SKETCH_PARTS rows of a fixed size, 32 MB together at most
        sketch[r.part] = np.minimum(np.frombuffer(zlib.decompress(r.counts), np.uint32), 65535)
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, total * (100 - percent) // 100 // 100_000)

    held = texts.mapInArrow(_prefixes(size, percent, sketch.ravel(), buckets), "bucket int, hot boolean, tokens binary, owners binary, places binary")
    shared = common.stored(held.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared_tokens, "token long, owner long, place int"))
    members = common.stored(shared.select("owner").distinct().join(classes.select(F.col("k1").alias("owner"), "key", "n", "point"), "owner"))
    near = common.stored(texts.where(common.may_be_in(common.bitmap(members, "key"), "key")))
    shared = common.stored(_distinct_groups(shared))

    links = _links(common.stored(_bounded(_hub_pairs(shared, members, percent), members, percent)), near, size, percent)
    now = _with_components(shared, links)
    across = _blocks(now, members).repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(_between(percent), "a long, b long").distinct()
    keys = members.select("owner", "key")
    across = common.stored(across.join(keys.toDF("a", "key_a"), "a").join(keys.toDF("b", "key_b"), "b"))
    links = links.union(_links(across, near, size, percent))

    smallest = common.components(links).join(classes.select(F.col("k1").alias("node"), "key"), "node")
    least = smallest.groupBy("component").agg(F.min("key").alias("component_id"))
    by_class = smallest.join(least, "component").select(F.col("node").alias("k1"), "component_id")
    named = classes.join(by_class, "k1", "left").select("k1", "k2", F.coalesce("component_id", "key").alias("component_id"))
    full = rows.where("n > 0").join(named, ["k1", "k2"]).select("key", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("key", "n", "key"))


def _bounded(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs, with the keys of their classes, whose sizes and points allow the similarity."""
    side = members.select("owner", "key", "n", "point")
    both = pairs.join(side.toDF("a", "key_a", "n_a", "point_a"), "a").join(side.toDF("b", "key_b", "n_b", "point_b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, GROUPS).astype(np.int32) for c in ("point_a", "point_b"))
            least = np.minimum(x, y)
            least[least == 255] = ANY_COUNT
            yield batch.select(["a", "b", "key_a", "key_b"]).filter(pa.array((100 + percent) * least.sum(axis=1, dtype=np.int64) >= percent * (n_a + n_b)))

    return both.mapInArrow(near, "a long, b long, key_a long, key_b long")


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    return shingle_components(common.table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def brute_force(texts: dict[int, str | None], size: int = 5, percent: int = 75) -> dict[int, tuple[int, int]]:
    """(set size, component) by key, comparing all pairs; for tests on small inputs."""
    import re

    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    top = {k: k for k in sets}

    def root(k: int) -> int:
        while top[k] != k:
            k = top[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}
