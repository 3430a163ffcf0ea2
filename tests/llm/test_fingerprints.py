import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from presswork.llm import fingerprints as fp


def _weights(t, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def _jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_edited_texts_and_estimates(spark):
    rows = [(r.doc_id * 3, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(700, None), (701, ""), (702, "éàü 漢字 x"), (703, "𝔘𝔘𝔘𝔘 tail of it"), (704, "one"), (705, rows[0][1])]
    got = {r.doc_id: r for r in fp.compare_edited(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, id int")).collect()}
    texts = sorted((k, t or "") for k, t in rows)
    off = []
    for i, (k, t) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), k
        off += [got[k].near_edited - _jaccard(_weights(t), _weights(edited)), got[k].near_next - _jaccard(_weights(t), _weights(after))]
    assert abs(sum(off) / len(off)) < 0.02 and sorted(map(abs, off))[int(len(off) * 0.99)] < 0.13
    assert got[705].fingerprint == got[0].fingerprint and got[700].fingerprint == got[701].fingerprint
    assert set(got[700].fingerprint) == {"0"} and all(len(r.fingerprint) == 4 * fp.BINS for r in got.values())


def _estimate(spark, a, b, size=5):
    got = {r.k: r.signature for r in fp.fingerprints(spark.createDataFrame([(1, a), (2, b)], "k long, text string"), "k", size=size).collect()}
    return spark.createDataFrame([(got[1], got[2])], "a array<long>, b array<long>").select(fp.likeness(F.col("a"), F.col("b"))).first()[0]


def _numbered(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_collision_rate_follows_weighted_jaccard(spark):
    base = [f"w{i}" for i in range(400)]
    cases = [
        (" ".join(w for i, w in enumerate(base) for _ in range(1 + i % 4)), " ".join(w for i, w in enumerate(base) for _ in range(1 + (i * 7 % 4)) if i % 5), 1),
        ("a " * 1004 + _numbered("x", 100), "a " * 1004 + _numbered("y", 100), 5),  # one heavy term
        ("a " * 700 + _numbered("x", 100), "a " * 350 + _numbered("x", 100), 5),  # of unlike weights
        ((_numbered("l", 10) + " ") * 150 + _numbered("x", 200), (_numbered("l", 10) + " ") * 150 + _numbered("y", 200), 5),  # a repeated line
    ]
    for a, b, size in cases:
        assert abs(_estimate(spark, a, b, size) - _jaccard(_weights(a, size), _weights(b, size))) < 0.13


def test_very_long_text_and_weights(spark):
    words = ["z"] * 300_000 + [f"v{i}" for i in range(100_000)] + ["q", "r"] * 50
    df = spark.createDataFrame([(" ".join(words),)], "text string").select(fp.word_array(F.col("text")).alias("words"))
    terms = df.select(fp.term_hashes("words", 1).alias("terms"))
    got = fp.weighted(terms, "terms").select("weight")
    assert sorted(got.groupBy("weight").count().collect()) == [(1, 100_000), (50, 2), (300_000, 1)]
    long = " ".join(words)
    assert _estimate(spark, long, long + " end of it") > 0.95


def test_other_columns_and_repeats_in_fingerprints(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 6, "x"), (None, None, 7, "y"), (2, "", 8, None)], "doc_id long, text string, signature int, content string")
    got = fp.fingerprints(df)
    assert got.columns == ["doc_id", "signature", "fingerprint"] and sorted((r.doc_id or 0, set(r.fingerprint) != {"0"}) for r in got.collect()) == [(0, False), (1, True), (1, True), (2, False)]
    assert fp.fingerprints(df.limit(0)).collect() == []
    wide = df.withColumns({c: F.lit(1) for c in ("id", "spread", "head", "first", "previous", "edited", "bin", "near")})
    assert len(fp.compare_edited(wide).collect()) == 4


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "x y z w v u t"), (None, "q")], "doc_id long, text string")
    rows = fp.compare_edited(df).collect()
    assert len(rows) == 4 and all(0 <= r.near_next <= 1 for r in rows)
    assert fp.compare_edited(df.limit(0)).collect() == []
    assert [r.near_next for r in fp.compare_edited(df.limit(1)).collect()] == [1.0]
