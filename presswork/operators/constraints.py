"""Constraints as data (inventory S23): unique, not-null, enum and foreign-key checks of many tables as one report.

Every row states, for each constraint it takes part in, a key and its role; one aggregate by (constraint, key) and one by constraint judge them all. So
the number of shuffles doesn't depend on the number of constraints, and a hot key is added up before it moves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.sources.fixtures import DDL_TYPES


@dataclass(frozen=True)
class Check:
    """One constraint: kind is unique, required, enum or foreign; `values` are an enum's, `parent` and `parent_columns` a foreign key's."""

    kind: str
    table: str
    columns: tuple[str, ...]
    values: tuple[str, ...] = ()
    parent: str = ""
    parent_columns: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.table}:{'+'.join(self.columns)}:{self.kind}"


def _key(columns: tuple[str, ...]) -> Column:
    """Null if any column is: SQL compares no nulls."""
    some_null = reduce(Column.__or__, [F.col(c).isNull() for c in columns])
    return F.when(~some_null, F.to_json(F.array(*[F.col(c).cast("string") for c in columns])))


def stated(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """(check_name, kind, key, child, parent): what the rows of all tables state, one pass over each table."""
    parts = []
    for name, df in tables.items():
        says = []
        row = lambda c, key, child, parent: F.struct(F.lit(c.name).alias("check_name"), F.lit(c.kind).alias("kind"), key.alias("key"), child.cast("long").alias("child"), parent.cast("long").alias("parent"))
        one, no, nothing = F.lit(1), F.lit(0), F.lit(None).cast("string")
        for c in checks:
            if c.table == name:
                if c.kind == "required":
                    says.append(row(c, nothing, F.when(F.col(c.columns[0]).isNull(), 1).otherwise(0), no))
                elif c.kind == "enum":
                    says.append(row(c, nothing, F.when(~F.col(c.columns[0]).isin(*c.values), 1).otherwise(0), no))
                else:
                    says.append(row(c, _key(c.columns), F.when(_key(c.columns).isNull(), 0).otherwise(1), no))
            if c.kind == "foreign" and c.parent == name:
                says.append(row(c, _key(c.parent_columns), no, one))
        if says:
            parts.append(df.select(F.inline(F.array(*says))))
    return reduce(DataFrame.union, parts)


def violations(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """(check_name, broken) for every check: rows that are null, outside an enum or without a parent, and keys that are there twice."""
    by_key = stated(tables, checks).groupBy("check_name", "kind", "key").agg(F.sum("child").alias("child"), F.sum("parent").alias("parent"))
    broken = F.when(F.col("kind") == "unique", (F.col("child") > 1).cast("long")).when(F.col("kind") == "foreign", F.when(F.col("parent") == 0, F.col("child")).otherwise(0)).otherwise(F.col("child"))
    found = by_key.groupBy("check_name").agg(F.sum(broken).alias("broken"))
    every = found.sparkSession.createDataFrame([(c.name,) for c in checks], "check_name string")  # a check of empty tables too
    return every.join(found, "check_name", "left").select("check_name", F.coalesce("broken", F.lit(0)).cast("long").alias("broken"))


#: The constraints of the domain's tables.
DDL = [
    Check("unique", "checked_sources", ("domain",)), *[Check("required", "checked_sources", (c,)) for c in ("name", "domain", "type")],
    Check("enum", "checked_sources", ("type",), DDL_TYPES), Check("unique", "checked_sources", ("id",)),
    Check("unique", "checked_topics", ("slug",)), Check("required", "checked_topics", ("slug",)), Check("required", "checked_topics", ("name",)),
    Check("unique", "checked_articles", ("canonical_url",)), *[Check("required", "checked_articles", (c,)) for c in ("canonical_url", "title", "published_at")],
    Check("foreign", "checked_articles", ("source_id",), (), "checked_sources", ("id",)),
    Check("unique", "checked_links", ("topic_id", "article_id")), Check("foreign", "checked_links", ("topic_id",), (), "checked_topics", ("id",)), Check("foreign", "checked_links", ("article_id",), (), "checked_articles", ("id",)),
    Check("unique", "checked_site_links", ("source_id", "topic_id")), Check("foreign", "checked_site_links", ("source_id",), (), "checked_sources", ("id",)), Check("foreign", "checked_site_links", ("topic_id",), (), "checked_topics", ("id",)),
]


def _sql(c: Check) -> str:
    columns = ", ".join(c.columns)
    if c.kind == "required":
        rows = f"SELECT 1 FROM {c.table} WHERE {columns} IS NULL"
    elif c.kind == "enum":
        rows = f"SELECT 1 FROM {c.table} WHERE {columns} NOT IN ({', '.join(repr(x) for x in c.values)})"
    elif c.kind == "unique":
        rows = f"SELECT 1 FROM {c.table} WHERE {' AND '.join(f'{x} IS NOT NULL' for x in c.columns)} GROUP BY {columns} HAVING count(*) > 1"
    else:
        rows = f"SELECT 1 FROM {c.table} WHERE {columns} IS NOT NULL AND {columns} NOT IN (SELECT {c.parent_columns[0]} FROM {c.parent})"
    return f"SELECT '{c.name}' AS check_name, (SELECT count(*) FROM ({rows})) AS broken"


NAMES = sorted({c.table for c in DDL})
QUERIES = {"s23_constraints": (lambda v: violations({n: getattr(v, n) for n in NAMES}, DDL), " UNION ALL ".join(map(_sql, DDL)))}
