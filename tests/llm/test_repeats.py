import random

from presswork.llm import repeats


def _text(rng, n, alphabet="abcdefgh é"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_matches_brute_force(spark):
    rng = random.Random(5)
    shared = [_text(rng, 90), _text(rng, 45), _text(rng, 61)]
    docs = {i: "".join(rng.choice([_text(rng, rng.randint(0, 70)), rng.choice(shared), rng.choice(shared)[: rng.randint(20, 60)]]) for _ in range(rng.randint(0, 6))) for i in range(120)}
    docs |= {200: "x" * 150, 201: "ab" * 70, 202: docs[3], 203: docs[3], 204: "", 205: "y" * 40, 206: "y" * 39}
    df = spark.createDataFrame([(k, v, 1) for k, v in docs.items()] + [(300, None, 2), (None, "x" * 80, 3)], "doc_id long, text string, key int")
    got = {r.key: (bytes(r.kept), r.n_bytes, r.n_removed) for r in repeats.remove_repeats(df, length=40, batches=3).collect()}
    want = repeats.brute_force({k: v.encode() for k, v in docs.items()}, 40)
    assert got.pop(300) == (b"", 0, 0)
    assert set(got) == set(want)
    for k, kept in want.items():
        assert got[k] == (kept, len(docs[k].encode()), len(docs[k].encode()) - len(kept)), k


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "q" * 10), (1, "q" * 10), (2, "r" * 50)], "doc_id long, text string")
    assert {(r.key, r.n_removed, r.n_spans) for r in repeats.remove_repeats(df, length=40).collect()} == {(1, 0, 0), (2, 50, 1)}
    assert repeats.remove_repeats(df.limit(0), length=40).collect() == []


def test_long_texts_are_cut_into_parts_without_loss(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", 97)
    monkeypatch.setattr(repeats.textops, "SLICE_BYTES", 97)
    rng = random.Random(9)
    shared = [_text(rng, 300), _text(rng, 45), "z" * 130]
    docs = {i: "".join(rng.choice([_text(rng, rng.randint(0, 90)), *shared]) for _ in range(rng.randint(1, 8))) for i in range(40)}
    got = {r.key: bytes(r.kept) for r in repeats.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), length=40).collect()}
    assert got == repeats.brute_force({k: v.encode() for k, v in docs.items()}, 40)


def test_a_very_long_text(spark):
    text = "".join(random.Random(1).choices("abcdefghij ", k=3_000_000))
    rows = [(1, text), (2, text[1_400_000:1_401_000] + "!")]
    got = {r.key: (r.n_removed, r.n_spans) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1000, 1), 2: (1000, 1)}


def test_characters_cut_in_part_go_whole(spark):
    a, b = "é" + "q" * 40 + "ê", "è" + "q" * 40 + "ë"  # the two share the first byte of their first characters' and of their last ones' codes
    rows = [(1, "x" + a + "�"), (2, "y" + b + "�!")]
    got = {r.key: bytes(r.kept).decode() for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=20, characters=True).collect()}
    assert got == {1: "xé�", 2: "yè�!"}
