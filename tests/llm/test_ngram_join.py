import random

import numpy as np
import pytest

from presswork.llm import ngram_join


def _check(spark, docs):
    df = spark.createDataFrame([(k, v, 0) for k, v in docs.items()], "doc_id long, text string, n int")
    got = {r.key: (r.n_shingles, r.component_id) for r in ngram_join.shingle_components(df).collect()}
    assert got == ngram_join.brute_force(docs)
    return got


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    docs: dict = {}
    for g in range(40):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 80))]
        for c in range(rng.randint(1, 6)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab).upper()
            docs[len(docs)] = " ".join(words) + rng.choice(["", " ", "\n"])
    passage = " ".join(vocab[:50])
    for _ in range(40):
        docs[len(docs)] = passage + " " + " ".join(rng.choice(vocab) + str(rng.random()) for _ in range(rng.randint(0, 60)))
    docs |= {500: "", 501: None, 502: "One two", 503: "one TWO", 504: " \n ", 505: "x", 506: "é x y", 507: "É x y", 508: "", 509: docs[3], -4: docs[5]}
    got = _check(spark, docs)
    assert got[503] == (1, 502) and got[508] == (0, 508) and got[507] == (1, 507)


def test_real_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    _check(spark, {r.doc_id: r.text for r in rows})


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.shingle_components(df).collect())) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert ngram_join.shingle_components(df.limit(0)).collect() == []


@pytest.mark.parametrize("others", [1, 0])
def test_families_copied_over_an_even_number_of_partitions(spark, others):
    words = [[f"w{f}x{i}" for i in range(60)] for f in range(3)]
    variants = [" ".join(w[:59] + [last]) for w in words for last in ("left", "right")]
    # 40 copies in each partition, so that the families' common shingles count as frequent
    rows = [(part * 1000 + copy * 10 + v, text) for part in range(2) for copy in range(40) for v, text in enumerate(variants)]
    rows += [(part * 1000 + 900, f"another text of part {part}") for part in range(2) for _ in range(others)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(sorted(rows), 2), "doc_id long, text string")
    got = {r["key"]: r["component_id"] for r in ngram_join.shingle_components(docs).collect()}
    assert got == {k: k if k % 1000 == 900 else k % 10 // 2 * 2 for k, _ in rows}


@pytest.mark.parametrize("n", [3_000_000, 200_000_000])
def test_saturated_points_bound_nothing(n):
    points, sizes = np.full((2, ngram_join.GROUPS), ngram_join.ANY_COUNT, np.int32), np.array([n, n])
    (i, j), = ngram_join.Tree(points, sizes, sizes, np.array([1, 2]), 75).pairs(None)
    assert (i.tolist(), j.tolist()) == ([0], [1])


def test_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 3, (30, ngram_join.GROUPS))
    points = np.maximum(0, centers[rng.integers(0, 30, 900)] + rng.integers(-1, 2, (900, ngram_join.GROUPS)) * (rng.random((900, ngram_join.GROUPS)) < 0.08)).astype(np.int32)
    n, comp, side = points.sum(axis=1), rng.integers(0, 100, 900), rng.random(900) < 0.5
    overlap = np.stack([np.minimum(points, p).sum(axis=1) for p in points])
    want = (175 * overlap >= 75 * (n[:, None] + n[None, :])) & (comp[:, None] != comp[None, :])
    for sides in (None, side):
        ok = np.triu(want if sides is None else want & (side[:, None] != side[None, :]), 1)
        got = {(min(a, b), max(a, b)) for i, j in ngram_join.Tree(points, n, n, comp, 75).pairs(sides) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == set(zip(*(x.tolist() for x in np.nonzero(ok)), strict=True)) and len(got) > 1000


def test_long_words_that_polynomials_confuse(spark):
    words = {}
    for n in (1024, 4096):
        for a, b in ("ab", "ba", "AB"):
            words[len(words)] = "".join(b if i.bit_count() % 2 else a for i in range(n))
    docs = dict(words) | {100 + k: f"one two {w} four five" for k, w in words.items()} | {200 + k: f"one two three {w} {w}" for k, w in words.items()}
    got = _check(spark, docs)
    assert got[1] == (1, 1) and got[2] == (1, 0) and got[101] == (1, 101)


def test_a_hub_of_many_near_copies(spark, monkeypatch):
    """Chunks of a few pairs: the hub's text goes to each, rows that repeat a key keep their own classes."""
    monkeypatch.setattr(ngram_join, "TOGETHER", 4)
    base = [f"w{i}" for i in range(80)]
    docs = {0: " ".join(base)} | {k: " ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(1, 70)}
    docs |= {k: " ".join([*base[:20], *(f"far{k}x{i}" for i in range(60))]) for k in range(100, 110)}
    got = _check(spark, docs)
    assert got[69] == (76, 0) and got[100] == (76, 100)
    pairs = spark.createDataFrame([(5, k, 0, 1 + k % 7) for k in range(10, 80)] + [(k, 6, 1 + k % 7, 0) for k in range(10, 30)], "a long, b long, key_a long, key_b long")
    led = ngram_join._led(pairs).collect()
    assert len(led) == 90 and max(r.chunk for r in led) > 10 and {r.key for r in led} == {0}
    assert {(r.hub, r.other) for r in led} == {(5, k) for k in range(10, 80)} | {(6, k) for k in range(10, 30)}


def test_repeated_keys_with_different_texts(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (1, " ".join(base[:39])), (1, "another text under the key one"), (2, " ".join(base[1:])), (2, ""), (3, "another text under the key ONE"), (None, " ".join(base))]
    got = sorted(map(tuple, ngram_join.shingle_components(spark.createDataFrame(rows, "key long, text string"), key="key").collect()))
    assert got == [(1, 2, 1), (1, 35, 1), (1, 36, 1), (2, 0, 2), (2, 35, 1), (3, 2, 1)]


def test_a_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(400_000))
    _check(spark, {1: text, 2: text + " tail", 3: "short " + text[:300_000], 4: "x" * 3_000_000, 5: "X" * 3_000_000})


def test_word_hashes_part_words():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("ab") for _ in range(n)) for n in range(1, 90) for _ in range(60)} | {"a\0", "a", "a\0\0"})
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    end = np.append(np.flatnonzero(data == 32), len(data))
    start = np.append(0, end[:-1] + 1)
    hashes = ngram_join.textops.word_hashes(data, start, end)
    assert len(set(hashes.tolist())) == len(words)
    assert (ngram_join.textops.word_hashes(data[start[7] :], start[7:] - start[7], end[7:] - start[7]) == hashes[7:]).all()
