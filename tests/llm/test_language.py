import zlib

from pyspark.sql import functions as F

from presswork.llm import language


def test_held_out_accuracy(spark):
    got = language.op5_compression_language(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 10000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    letters = [r for r in got if r.text and any(c.isalpha() for c in r.text)]
    assert all((r.lang_pred == "und") == (r not in letters) for r in got[:300])
    held = [r for r in letters if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in letters) <= 0.01 * len(letters)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !?", None), (4, "the cat sat on the mat and the dog " * 3, "en"), (5, "der Hund und die Katze sind nicht im Haus " * 3, "de"), (None, "the dog and the cat", None)], "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert sorted(model) == ["de", "en"]
    got = {r.doc_id: (r._lang, r._rejected) for r in language.classify(docs.withColumn("_lang", docs.lang), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", True) and got[5] == ("de", False) and got[None][0] == "en"
    assert language.classify(docs.limit(0), model).collect() == []
    assert {r._lang for r in language.classify(docs, {}).collect()} == {"und"}


def test_long_clean_texts_keep_their_margin(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    by: dict = {}
    for r in docs.where("text is not null and lang is not null").orderBy("doc_id").collect():
        by.setdefault(r.lang, []).append(r.text)
    long = [(k, ("\n".join(v) * 40)[:n]) for k, v in by.items() for n in (100_000, 3_000_000)]
    got = language.classify(spark.createDataFrame(long, "lang string, text string"), language.learn(docs)).drop("text").collect()
    assert len(got) == 8 and all(r._lang == r.lang and not r._rejected and r._margin >= 0.05 for r in got)


def test_headers_short_texts_and_many_languages(spark, monkeypatch):
    header, body = "the same notice opens every document of this kind. " * 10, "oro mavi selun tarek " * 40
    rows = [(1, header + body, "aa"), (2, header, "bb"), (3, "ja nee", "cc"), (4, "q" * 30, "dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = language.learn(docs)
    assert sorted(whole) == ["aa", "bb", "cc", "dd"] and b"selun" in whole["aa"] and whole["cc"] == b"ja nee"
    asked = docs.union(spark.createDataFrame([(5, "selun tarek oro mavi selun tarek", None)], docs.schema))
    want = {r.doc_id: (r._lang, r._margin) for r in language.classify(asked, whole).collect()}
    assert want[5][0] == "aa"
    monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", 3)
    assert language.learn(docs) == whole
    again = {r.doc_id: (r._lang, r._margin) for r in language.classify(asked, whole).collect()}
    assert again == want


def test_scores_match_plain_compression(spark):
    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.learn(docs)
    coders = {k: zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False) for k, v in model.items()}
    got = language.classify(docs.withColumnRenamed("text", "body").withColumn("text", F.lit(1)), model, text="body")
    for r in got.collect():
        if r.body and any(c.isalpha() for c in r.body):
            raw = r.body.lower().encode()
            size = sorted((sum(len(c.compress(raw[i : i + language.BLOCK_BYTES])) for i in range(0, len(raw), language.BLOCK_BYTES)), k) for k, c in coders.items())
            assert r._lang == size[0][1] and abs(r._margin - (1 - size[0][0] / size[1][0])) < 0.01
        else:
            assert r._lang == "und" and r._rejected


def test_a_language_of_two_texts_that_repeat_is_learnt(spark):
    rows = [(i, ("η γάτα κάθεται πάνω στο χαλί και κοιτάζει " * 3, "ο σκύλος τρέχει μέσα στον κήπο κάθε πρωί " * 3)[i % 2], "el") for i in range(40_000)]
    rows += [(50_000 + i, f"the cat number {i} sat on the mat and looked at the dog", "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert sorted(model) == ["el", "en"] and "γάτα" in model["el"].decode() and "σκύλος" in model["el"].decode()
    got = language.classify(docs.where("doc_id >= 39998 and doc_id < 50003"), model).collect()
    assert all(r._lang == r.lang and not r._rejected for r in got)
