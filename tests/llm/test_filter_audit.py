"""The audit against a plain count over all orders, hostile rows, and DuckDB on the given tables."""

from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from presswork.llm import filter_audit as fa

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, mask int, s string"
LONG = " ".join(f"w{i}" for i in range(250))


def plain(rows, labels):
    """Rows (doc_id, text, source) and labels to the audit's rows, order by order."""
    import re

    docs = []
    for key, text, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": key is not None and any(k is not None and k < key and (x or "") == t for k, x, _ in rows),
        }
        mine = [x for x in labels if x[0] is not None and x[0] == key]
        docs.append((source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, share = [], {}
    for part in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = here
            for k, f in enumerate(order):
                gone, kept = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                redundant = sum(d[1][f] for d in here) - len(gone)
                unique = sum(d[1][f] and sum(d[1].values()) == 1 for d in here)
                out.append([part, "".join(order), k + 1, len(kept), len(gone), redundant, unique, sum(d[2] for d in gone), sum(d[3] for d in gone)])
                share[part, f] = share.get((part, f), 0) + len(gone)
                left = kept
    return sorted((*r, share[r[0], r[1][r[2] - 1]]) for r in out)


def got(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in fa.audit(*fa.outcome_counts(docs, marks)).collect())


def test_hostile_rows(spark):
    rows = [
        (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (None, LONG, "a"), (None, None, None), (4, None, "b"), (5, "", "b"), (5, "", "b"), (6, "Ä € #", "b"), (7, "A B", ""),
        (8, "x " * 100_000, "a"), (9, "\t\x0b a\x85b\xa0c \n", "a"), (-3, LONG, "b"), (10, "%" + LONG, None), (10, "%" + LONG, "a"), (11, LONG.upper(), "a"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (8, 1, 1), (None, 1, 1), (6, None, None), (99, 1, 1)]
    assert got(spark, rows, labels) == plain(rows, labels)


def test_empty_table(spark):
    assert got(spark, [], [(1, 1, 1)]) == []


@pytest.mark.parametrize("n", [1, 3, 5])
def test_potential_gives_shapley(spark, n):
    values = [0] + [(s * 7919 + s * s * 31) % 101 for s in range(1, 1 << n)]
    p = spark.range(1).select(fa.potential(F.array(*[F.lit(v).cast("long") for v in values]), n).alias("p")).first().p
    for i in range(n):
        total = 0
        for order in permutations(range(n)):
            before = sum(1 << x for x in order[: order.index(i)])
            total += values[before | 1 << i] - values[before]
        assert p[-1] - p[(1 << n) - 1 - (1 << i)] == total


def test_query_and_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = fa.op12_filter_audit(spark, SF)
    want = con.execute(fa.SQL)
    assert [c[0] for c in want.description] == df.columns and [t for _, t in df.dtypes] == ["string", "string", "int", *["bigint"] * 7]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == sorted(want.fetchall()) and len(rows) == 600 * len({r[0] for r in rows})
