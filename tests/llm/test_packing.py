import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from presswork.llm import packing

pytest.importorskip("public_tokenizers")


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_tokenizer())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = [None, "", " ", "It's we'll 'tis don't, 12 3.4 a…. x?! <|endoftext|> a<|startoftext|>, été, ÉTÉ. naïve; ×. a×, 5÷. é, a b 　c", "!!", "word " * 5000, "a", "a", "ﬁx İ ß. ΣΑΣ, ς."]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [(1001, ""), (None, "nobody's")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), packing.word_tokenizer(), salts=4).collect()
    want = []
    for k, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], np.uint32)
        want += [(k, i, at, len(p := ids[at : at + 2048]), zlib.crc32(p.tobytes())) for i, at in enumerate(range(0, len(ids), 2048))]
    order = lambda x: tuple(-5 if v is None else v for v in x)
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


def test_plan_uses_every_piece_once_and_packs_tightly():
    rng = random.Random(1)
    counts = np.zeros(101, np.int64)
    for _ in range(5000):
        counts[min(100, int(rng.expovariate(1 / 30)) + 1)] += 1
    used = np.zeros(101, np.int64)
    n = 0
    for lengths, times in packing.plan(counts, 100):
        assert sum(lengths) <= 100
        for x in lengths:
            used[x] += times
        n += times
    assert (used == counts).all() and n <= -(-int((counts * np.arange(101)).sum()) // 100) * 1.01 + 1
    assert packing.plan(np.array([0, 0, 0, 2, 2]), 8) == [([4, 4], 1), ([3, 3], 1)]


def test_two_small_pieces_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = 1, 1, 2
    assert packing.plan(counts, 10)[0] == ([6, 2, 2], 1)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.word_tokenizer()).collect() == []


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [64, 65, 1024, 4096])
def test_long_words_that_polynomials_confuse(spark, n):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.word_tokenizer())
    texts = [thue_morse(n), thue_morse(n, "b", "a"), f"x {thue_morse(n)} y", f"x {thue_morse(n, 'b', 'a')} y"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.word_tokenizer(), salts=2).collect()
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], np.uint32)
        assert sorted((r.piece, r.ids_crc32) for r in got if r.key == k) == [(i, zlib.crc32(ids[at : at + 2048].tobytes())) for i, at in enumerate(range(0, len(ids), 2048))]
