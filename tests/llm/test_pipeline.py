from collections import Counter

import pytest

from presswork.llm import ngram_join, repeats

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
    start, told, joined, cut, mixed, packed = ({} if df is None else df.collect() for df in seen)
    assert all(df.columns == docs.columns for df in seen[:-1])
    assert len(told) >= 0.95 * len(start) and all(any(c.isalpha() for c in r.text) for r in told)
    want = ngram_join.brute_force({r.doc_id: r.text for r in told})
    assert {r.doc_id for r in joined} == {k for k, (_, c) in want.items() if k == c}
    left = repeats.brute_force({r.doc_id: r.text.encode() for r in joined}, 400)
    assert {r.doc_id: r.text for r in cut} == {k: v.decode(errors="ignore") for k, v in left.items()}
    assert all(r.n_chars == len(r.text) for r in cut)
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in cut} and max(copies.values()) <= 2
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    assert all(0 <= r.offset and r.offset + r.length <= 2048 for r in packed)


def test_texts_under_null_and_repeated_ids_stay(spark):
    texts = [" ".join(f"{name}{i}" for i in range(30)) for name in "abcd"]
    rows = [(1, texts[0]), (5, texts[0]), (5, texts[1]), (5, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[0])]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = Counter({(1, texts[0]): 1, (5, texts[1]): 1, (5, texts[2]): 1, (None, texts[3]): 1})
    joined = corpus_pipeline.join_near_copies(spark, docs, SF)
    assert Counter((r.doc_id, r.text) for r in joined.collect()) == want
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.cut_repeats(spark, joined, SF).collect()) == want


def test_odd_rows_empty_tables_and_other_columns(spark):
    part = "0123456789 abcdefghij " * 30
    rows = [(1, None, None, None, None), (2, "", "en", "web", 0), (3, part + "x" * 9 + "é� end of this one", "en", "web", 9), (4, "keep � this one as it is, " + part + "ê tail", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    assert cut[1] == cut[2] == "" and cut[4].startswith("keep � this") and cut[4].endswith("ê tail") and "0123456789" not in cut[3] and "é� end" in cut[3]
    wide = docs.withColumns({c: docs.n_chars for c in ("_row", "key", "low", "component_id", "kept", "rest")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide, SF).collect() is not None, name
        assert stage(spark, docs.limit(0), SF).collect() == [], name
