from collections import defaultdict

from presswork.llm import mixing


def _targets(sizes):
    """Water filling by repetition, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * unit > 2 * sizes[s]}
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets_copies_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(5000 + i, "w " * (i % 50), "en", None, i) for i in range(300)] + [(6000, None, None, "zz", 1), (6001, "", None, "Ä", 1), (None, "no key", None, "src1", 3)], docs.schema)
    docs = docs.union(extra).withColumn("_rank", docs["n_chars"])
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and "lang" in rows[0].asDict()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r._size == len([w for w in (r.text or "").replace("\n", " ").split(" ") if w]) and 0 <= r._copies <= 2
        sizes[r.source] += r._size
        taken[r.source] += r._size * r._copies
        target[r.source] = r._target
    for s, want in _targets(sizes).items():
        assert abs(target[s] - want) < 1e-6 * max(1, want), s
        assert abs(taken[s] - want) <= 0.02 * want + 60, (s, taken[s], want)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((str(r.doc_id), r._copies) for r in rows) == sorted((str(r.doc_id), r._copies) for r in again)


def test_preference_and_empty(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "one two three four", "a" if i < 400 else "b", i % 2) for i in range(800)], "doc_id long, text string, source string, good int")
    rows = mixing.mix(docs, share=0.5, preference=F.col("good") * 3 + 1).collect()
    assert sum(r._copies for r in rows if r.good) > 2 * sum(r._copies for r in rows if not r.good)
    assert abs(sum(r._copies * r._size for r in rows) - 1600) <= 8
    assert mixing.mix(docs.limit(0)).collect() == []


def test_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    names = ("low", "weight", "target", "pick", "mean_like", "_source", "certain", "size", "like", "row", "s", "a.b", "_rank", "_size")
    docs = spark.createDataFrame([(i, "a b c " * (i % 7), "xy"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    got = mixing.mix(docs.withColumns({n: F.lit(n) for n in names})).collect()
    plain = {r.doc_id: r._copies for r in mixing.mix(docs).collect()}
    assert len(got) == 60 and all(r[n] == n for r in got for n in names[:-1]) and {r.doc_id: r._copies for r in got} == plain
    assert all(r._size == 3 * (r.doc_id % 7) for r in got)


def test_a_very_long_text_and_ties(spark):
    docs = spark.createDataFrame([(1, "w " * 1_000_000, "a")] + [(i, "one two", "b") for i in range(2, 400)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 399 and all(0 <= r._copies <= 2 for r in rows) and {r._size for r in rows} == {1_000_000, 2}


def plain_draw(rows, target, most, seed=8):
    """Copies of one source's (key, size, like, uniform), drawn one by one in Pareto's order."""
    total = sum(r[1] for r in rows)
    mean = sum(r[1] * r[2] for r in rows) / total
    even, above = target / total, max(r[2] for r in rows) / mean - 1
    tilt = min(even, (most - even) / above) if above > 1e-12 else even
    copies, left, order = {}, target, []
    for key, size, like, u in rows:
        expected = min(most, max(0.0, even + tilt * (like / mean - 1)))
        copies[key] = int(expected)
        left -= copies[key] * size
        part = expected - int(expected)
        if part > 0:
            order.append((u / (1 - u) / (part / (1 - part)), key, size))
    order.sort()
    rest = []
    for i, (_, key, size) in enumerate(order):
        if size > left:
            rest = order[i:]
            break
        copies[key] += 1
        left -= size
    near = [(abs(size - left), place, key) for place, (_, key, size) in enumerate(rest) if size and abs(size - left) < left]
    if near:
        copies[min(near)[2]] += 1
    return copies


def test_unequal_odds_against_a_plain_draw(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * (i * 37 % 311), "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, preference=mixing.fuller("text")).collect()
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(8), F.col("doc_id").cast("string"), F.lit(None).cast("string")), 11).cast("double") + 0.5) / float(1 << 53)
    draws = {r.doc_id: (r.u, r.like) for r in docs.select("doc_id", uniform.alias("u"), mixing.fuller("text").alias("like")).collect()}
    for s in "abc":
        mine = [r for r in rows if r.source == s]
        want = plain_draw([(r.doc_id, r._size, draws[r.doc_id][1], draws[r.doc_id][0]) for r in mine], mine[0]._target, 2.0)
        assert {r.doc_id: r._copies for r in mine} == want
    full, short = ([r._copies for r in rows if (r._size >= 200) == f] for f in (True, False))
    assert sum(full) / len(full) > sum(short) / len(short) + 0.1


def test_targets_hold_at_the_cap_and_at_nothing(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 300), "a" if i < 50 else "b" if i < 60 else "c") for i in range(600)], "doc_id long, text string, source string")
    for share in (0.0, 0.3, 1.5, 2.0):
        rows = mixing.mix(docs, preference=mixing.fuller("text"), share=share).collect()
        for s in "abc":
            mine = [r for r in rows if r.source == s]
            assert abs(sum(r._copies * r._size for r in mine) - mine[0]._target) <= 300 and all(r._copies <= 2 for r in mine), (s, share)
