"""Conversation structure repair: the cheapest edits that make a conversation's roles `(s?(ua)+)?`.

A conversation is a lattice: its nodes are (rows read, state of the pattern), its arcs the edits Keep, Rerole, Delete and Insert with whole
costs. The auction algorithm for shortest paths holds a price for every node, never above an arc's cost plus the price of its head.
It extends a path along an arc where both are equal (a tight arc), or raises the price of the path's last node and contracts the
path. Among tight arcs the one with the least letter is taken, and prices only rise, so the path that reaches the end is the cheapest
and, among the cheapest, the least by its letters.

Long conversations are cut into blocks of rows, the last block first: a block's auction ends at the converged prices of the block behind
it, so the work of a row doesn't grow with the conversation. Spark sorts the rows of each conversation; tasks read them as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm import common

#: States of the pattern: nothing yet, after the system's row, after a user's, after a pair. The role and the state that come next.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT = (2, 2, 3, 2)
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Row codes: role 0 s, 1 u, 2 a, 3 other; 4 more for a truncated row, 8 more for one that has to go.
ROLES = {"s": 0, "u": 1, "a": 2}
AFTER = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
BLOCK = 16
WHITE = " \t\n\x0b\x0c\r"
Arc = tuple[str, int, int]


def lattice(codes: bytes, ahead: tuple[int, ...] | None) -> list[list[Arc]]:
    """Arcs (letter, cost, head) of nodes 4 * rows read + state, in order of their letters. The last node is the sink. Behind the rows
    either the conversation ends (`ahead` is None) or each state costs what its price is in the next block."""
    sink = 4 * len(codes) + 4
    arcs: list[list[Arc]] = []
    for i, code in enumerate(codes):
        extra, role = TRUNCATED if code & 4 else 0, code & 3
        for s in range(4):
            here: list[Arc] = [("D", DELETE, 4 * i + 4 + s), ("I", INSERT, 4 * i + NEXT[s])]
            if not code & 8:
                if role in AFTER[s]:
                    here.append(("K", KEEP + extra, 4 * i + 4 + AFTER[s][role]))
                here.append(("R", REROLE + extra, 4 * i + 4 + NEXT[s]))
            arcs.append(here)
    for s in range(4):
        if ahead is not None:
            arcs.append([("", ahead[s], sink)])
        else:
            arcs.append(([("", 0, sink)] if s in ENDS else []) + [("I", INSERT, 4 * len(codes) + NEXT[s])])
    return [*arcs, []]


def auction(arcs: list[list[Arc]], prices: list[int], start: int) -> list[Arc]:
    """The arcs of the cheapest path from `start` to the sink, the least by letters among equals. `prices` must be feasible (zeros are); they are
    raised in place, stay feasible for another start, and the price of `start` ends as its distance."""
    sink, path, i = len(arcs) - 1, [], start
    tails: list[int] = []
    while i != sink:
        best = None
        for arc in arcs[i]:
            value = arc[1] + prices[arc[2]]
            if best is None or value < least:
                best, least = arc, value
        if prices[i] < least:  # contraction
            prices[i] = least
            if path:
                path.pop()
                i = tails.pop()
        else:  # extension along the tight arc of the least letter
            path.append(best)
            tails.append(i)
            i = best[2]
    return path


@lru_cache(maxsize=1 << 16)
def _distances(codes: bytes, ahead: tuple[int, ...] | None) -> tuple[int, ...]:
    """Converged prices of the four states ahead of a block."""
    arcs = lattice(codes, ahead)
    prices = [0] * len(arcs)
    for s in range(4):
        auction(arcs, prices, s)
    return tuple(prices[:4])


@lru_cache(maxsize=1 << 16)
def _trace(codes: bytes, ahead: tuple[int, ...] | None, start: int) -> tuple[int, str, int]:
    """(cost within the block, letters, state behind the block) of the path from a state."""
    arcs = lattice(codes, ahead)
    path = auction(arcs, [0] * len(arcs), start)
    last = path[-2][2] if len(path) > 1 else start
    return sum(a[1] for a in path[:-1]), "".join(a[0] for a in path), last & 3


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation's row codes; an empty one costs nothing and has no edit."""
    starts = range(0, len(codes), BLOCK)
    blocks = [codes[a : a + BLOCK] for a in starts] or [b""]
    ahead: list[tuple[int, ...] | None] = [None] * len(blocks)
    for k in range(len(blocks) - 1, 0, -1):
        d = _distances(blocks[k], ahead[k])
        ahead[k - 1] = tuple(x - min(d) for x in d)  # only differences matter
    cost, state, letters = 0, 0, []
    for block, behind in zip(blocks, ahead, strict=True):
        more, part, state = _trace(block, behind, state)
        cost += more
        letters.append(part)
    return cost, "".join(letters)


def ordered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """(conv_id, place, turn, role, text, copies, digest): rows by conversation and turn (null first), ties by role and text, stored with their place."""
    n = F.lit(1) if copies is None else copies
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"), n.cast("int").alias("copies"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "copies")
    return common.stored(rows.select("conv_id", F.monotonically_increasing_id().alias("place"), "turn", "role", "text", "copies", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))


def audit(rows: DataFrame) -> DataFrame:
    """One row per conversation of ordered(): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    A row is blank without a character but white space, duplicate if role and text were seen earlier, truncated if its last such character is none
    of .!? (the first that holds counts). Rows of no copies only name their conversation. A null conversation is one too, nulls in role and text
    are one space, an empty table gives an empty one; texts don't move here.
    """
    solid = F.rtrim("text", F.lit(WHITE))
    compact = rows.select("conv_id", "place", "turn", "role", "copies", "digest", (solid == "").alias("blank"), (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("open"))
    # the first of equal rows, by its place: a join without a hot key
    first = compact.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    marked = compact.join(first, "place", "left").select("conv_id", "place", "turn", F.substring("role", 1, 1).alias("initial"), "copies", "blank", "open", F.coalesce("first", F.lit(False)).alias("first"))
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_audit, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


class _Conversation:
    """What one conversation's rows add up to: a byte a row and a few counts."""

    def __init__(self) -> None:
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = None

    def add(self, turn: int | None, initial: str, copies: int, blank: bool, is_open: bool, first: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.high:  # turns come in order
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        role, again = ROLES.get(initial, 3), copies if not first else copies - 1
        if blank:
            self.blank += copies
            self.codes += bytes((role | 8,)) * copies
        else:
            self.duplicate += again
            self.truncated += first and is_open
            self.codes += bytes((role | (4 if is_open else 0),)) * (copies - again) + bytes((role | 8,)) * again
        self.illegal += (self.last is not None and self.last + initial not in ("su", "ua", "au")) + (copies - 1)
        self.last = initial

    def result(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, *cheapest(bytes(self.codes))


AUDIT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, got = object(), None
    for batch in batches:
        done = []
        for conv, turn, initial, copies, blank, is_open, first in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "copies", "blank", "open", "first")), strict=True):
            if conv != now:
                if got:
                    done.append((now, *got.result()))
                now, got = conv, _Conversation()
            got.add(turn, initial, copies, blank, is_open, first)
        yield from _batch(done, AUDIT)
    if got:
        yield from _batch([(now, *got.result())], AUDIT)


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def repair(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, edit, role, text): the repaired conversations' rows in order within each partition, edit K, R or I. A conversation
    is read as a stream behind its audit, so a task holds one batch and one audit, whatever its length."""
    plans = audits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"))
    both = rows.where("copies > 0").select("conv_id", "place", "role", "text", "copies").union(plans)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_repair, "conv_id long, edit string, role string, text string")


REPAIRED = pa.schema([("conv_id", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, plan, at, state = None, "", 0, 0
    for batch in batches:
        out: list[tuple] = []

        def insert() -> None:
            nonlocal at, state
            while at < len(plan) and plan[at] == "I":
                out.append((conv, "I", NEXT_ROLE[state], ""))  # noqa: B023
                at, state = at + 1, NEXT[state]

        for c, place, role, text, copies in zip(*(batch[x].to_pylist() for x in ("conv_id", "place", "role", "text", "copies")), strict=True):
            if place < 0:
                conv, plan, at, state = c, text, 0, 0
                insert()
                continue
            for _ in range(copies):
                edit, at = plan[at], at + 1
                if edit == "K":
                    state = AFTER[state][ROLES[role[0]]]
                    out.append((conv, edit, role, text))
                elif edit == "R":
                    out.append((conv, edit, NEXT_ROLE[state], text))
                    state = NEXT[state]
                insert()
        yield from _batch(out, REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    now, got = object(), None
    for batch in batches:
        done = []
        for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if conv != now:
                if got:
                    done.append((now, got.hexdigest()))
                now, got = conv, hashlib.sha256()
            else:
                got.update(b"\n")
            got.update(f"{role}:{text}".encode())
        yield from _batch(done, schema)
    if got:
        yield from _batch([(now, got.hexdigest())], schema)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations with the faults that crc32 of `conv_id:turn` deals out; a null there is one space.
    A dropped row has no copies."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(named.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id", "turn", F.when(fault == 0, "").when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def op11_auction_repair(spark, sf_dir: str) -> DataFrame:
    rows = ordered(damaged(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), copies=F.col("copies"))
    audits = common.stored(audit(rows))
    digests = repair(rows, audits).mapInArrow(_digests, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "of")
    told = audits.join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return told.select(*AUDIT.names, F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _sql_edits(i: str) -> str:
    """One step of the oracle's recursion: the cheapest (cost, letters, text) of each state ahead of a row, from those behind it."""
    to = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    own = []
    for s in range(4):
        options = [f"{{'c': f{s}.c + 3, 'l': 'D' || f{s}.l, 't': f{s}.t}}"]
        for initial, t in to[s].items():
            options.append(f"CASE WHEN NOT gone AND initial = '{initial}' THEN {{'c': f{t}.c + open, 'l': 'K' || f{t}.l, 't': chr(10) || role || ':' || text || f{t}.t}} END")
        t = NEXT[s]
        options.append(f"CASE WHEN NOT gone THEN {{'c': f{t}.c + 2 + open, 'l': 'R' || f{t}.l, 't': chr(10) || '{NEXT_ROLE[s]}:' || text || f{t}.t}} END")
        own.append(f"list_min([{', '.join(options)}]) AS g{s}")
    inserted = []
    for s in range(4):
        a, b = NEXT[s], NEXT[NEXT[s]]
        inserted.append(
            f"list_min([g{s}, {{'c': g{a}.c + 2, 'l': 'I' || g{a}.l, 't': chr(10) || '{NEXT_ROLE[s]}:' || g{a}.t}}, "
            f"{{'c': g{b}.c + 4, 'l': 'II' || g{b}.l, 't': chr(10) || '{NEXT_ROLE[s]}:' || chr(10) || '{NEXT_ROLE[a]}:' || g{b}.t}}]) AS f{s}"
        )
    return f"SELECT conv, n, {i}, {', '.join(inserted)} FROM (SELECT conv, n, {i}, {', '.join(own)} FROM step)"


#: A dynamic program from the last row to the first, in place of the auction.
SQL = rf"""
    WITH RECURSIVE named AS (
        SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
    ), dealt AS (
        SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(unicode(c) AS BIGINT))),
            lambda h, c: list_reduce(list_prepend(xor(h, c), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS fault FROM named
    ), damaged AS (
        SELECT conv, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM dealt, (SELECT unnest([1, 2]) AS copy) WHERE fault <> 0 AND (copy = 1 OR fault = 3)
    ), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS place, left(role, 1) AS initial FROM damaged
    ), marked AS (
        SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS unended,
            lag(initial) OVER (PARTITION BY conv ORDER BY place) AS before, count(*) OVER (PARTITION BY conv) AS n FROM numbered
    ), told AS (
        SELECT conv, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
            count(*) FILTER (unended AND NOT again AND NOT blank) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY 1
    ), walk AS (
        SELECT conv, n, n + 1 AS i, {{'c': 0, 'l': '', 't': ''}} AS f0, {{'c': 4, 'l': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS f1, {{'c': 2, 'l': 'I', 't': chr(10) || 'assistant:'}} AS f2, {{'c': 0, 'l': '', 't': ''}} AS f3
        FROM (SELECT DISTINCT conv, n FROM marked)
        UNION ALL
        SELECT * FROM ({_sql_edits('i').replace('FROM step', "FROM (SELECT w.conv, w.n, w.i - 1 AS i, f0, f1, f2, f3, blank OR again AS gone, initial, role, text, CAST(unended AS INT) AS open FROM walk w JOIN marked m ON m.conv = w.conv AND m.place = w.i - 1) step")})
    ), best AS (SELECT conv, f0 FROM walk WHERE i = 1)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(coalesce(f0.c, 0) AS BIGINT) AS cost, coalesce(f0.l, '') AS audit, sha256(coalesce(f0.t[2:], '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv, conv_id FROM named) LEFT JOIN told USING (conv) LEFT JOIN best USING (conv)"""
