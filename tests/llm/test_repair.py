"""The auction against a search over all edits; hostile conversations; DuckDB on the given tables."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from presswork.llm import repair

SF = "/root/testdata/sf0.01"


def search(codes):
    """(cost, letters) by Dijkstra on (cost, letters)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, letters, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        if i == len(codes) and s in (0, 3):
            return cost, letters
        done.add((i, s))
        turn = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}[s]
        heapq.heappush(heap, (cost + 2, letters + "I", i, turn[1]))
        if i < len(codes):
            c = codes[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, s))
            if not c & 8:
                more = 1 if c & 4 else 0
                role = "sua?"[c & 3]
                if role == turn[0] or (role == "s" and s == 0):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, 1 if role == "s" else turn[1]))
                heapq.heappush(heap, (cost + 2 + more, letters + "R", i + 1, turn[1]))


@pytest.mark.parametrize("block", [1, 3, 16])
def test_auction_is_cheapest_and_least(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for n in [0, 1, 1, 2, 2, 3, 3, *(rng.randrange(40) for _ in range(120)), 300]:
        codes = bytes(rng.choice((0, 1, 2, 3, 1, 2, 5, 6, 9, 10)) for _ in range(n))
        assert repair.cheapest(codes) == search(codes)


def test_prices_are_feasible_and_tight_on_the_path():
    codes = bytes((3, 2, 1, 9, 6, 5, 0, 2))
    arcs = repair.lattice(codes, None)
    prices = [0] * len(arcs)
    path = repair.auction(arcs, prices, 0)
    assert all(prices[i] <= cost + prices[j] for i, out in enumerate(arcs) for _, cost, j in out)
    assert prices[0] == sum(a[1] for a in path) == search(codes)[0]


def expected(rows):
    """Rows (conv_id, turn, role, text) to the contract's rows."""
    out, white = {}, " \t\n\x0b\x0c\r"
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", r[3] or " ")):
            role, text = " " if role is None else role, " " if text is None else text
            fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            after += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, codes = [], []
        for k, (_, role, text) in enumerate(after):
            solid = text.strip(white)
            fault = "b" if not solid else "d" if (role, text) in [x[1:] for x in after[:k]] else "" if solid[-1] in ".!?" else "t"
            faults.append(fault)
            codes.append("sua".find(role[:1]) % 4 if role else 3)
            codes[-1] |= 8 if fault and fault in "bd" else 4 if fault == "t" else 0
        initials = [r[1][:1] for r in after]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = search(codes)
        said, s, rest = [], 0, iter(after)
        for e in audit:
            role, text = next(rest)[1:] if e != "I" else ("", "")
            if e == "D":
                continue
            to = "assistant" if s == 2 else "user"
            said.append(f"{role if e == 'K' else to}:{text}")
            s = 1 if e == "K" and role[0] == "s" else 3 if s == 2 else 2
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash")).withColumn("copies", F.lit(9))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    return {r.conv_id: tuple(r)[1:] for r in repair.op11_auction_repair(spark, str(tmp_path)).collect()}


def test_hostile_conversations(spark, tmp_path):
    rng = random.Random(11)
    texts = ["Fine.", "cut", "", " \n", None, "ok?", " ", "Ä!\t", "a\nb.", "x" * 5000]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "useless"]
    rows = [(c if c else None, rng.choice([None, *range(-2, 9)]), rng.choice(roles[: 3 if c % 2 else 8]), rng.choice(texts)) for c in range(40) for _ in range(rng.randrange(1, 14))]
    rows += [(100, t, "user" if t % 2 else "assistant", f"t{t % 50}.") for t in range(700)] + [(101, 1, "user", "again.")] * 300
    assert run(spark, rows, tmp_path) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == {}


def test_repaired_rows(spark):
    rows = [(1, 1, "assistant", "Hi."), (1, 2, "user", "What?"), (2, 1, "user", "A."), (2, 2, "assistant", "B.")]
    ordered = repair.ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {}
    for r in repair.repair(ordered, repair.audit(ordered)).collect():
        got.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert got[2] == [("K", "user", "A."), ("K", "assistant", "B.")]
    assert "".join(r[1][0] for r in got[1]) in ("ua", "uaua") and ("I", "user", "") in got[1]


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = repair.op11_auction_repair(spark, SF)
    want = con.execute(repair.SQL)
    assert [c[0] for c in want.description] == df.columns
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(want.fetchall())
    plain = expected(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    assert {r[0]: r[1:] for r in got} == plain
