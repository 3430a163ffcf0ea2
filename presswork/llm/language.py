"""Language identification by compression: the language whose dictionary makes a text smallest.

Every language gets a zstandard raw-content dictionary from a bounded sample of its documents. A
text is compressed with each dictionary, in consecutive blocks that cover the whole of it; the
smallest sum wins, and a text whose runner-up is hardly larger is rejected. A dictionary saves a
bounded number of bytes in each block, so the margin doesn't fall as a text gets longer.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import common
from presswork.llm.textops import worker_state

#: Bounds of the sample a model is learnt from; a text's characters come from so many places spread over it.
SAMPLE_DOCS = 400
DICT_BYTES = 96_000
DOC_CHARS = 400
PLACES = 4
#: Languages that are learnt, or held as coders, at once.
LANGUAGES_AT_ONCE = 500
#: Bytes of text that are compressed at once.
BLOCK_BYTES = 16_384
UNKNOWN = "und"


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary by language, from at most `sample_docs` different documents of each, at most DOC_CHARS
    of one document (from PLACES places spread over it) and `dict_bytes` in all. Rows with a null text or language teach nothing.
    Documents are drawn by a hash of their text, so reruns and row orders agree; every language with a text is
    learnt, however often its texts repeat."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null and text <> ''")
    draw = (F.shiftrightunsigned(F.xxhash64("text", F.lit(5)), 11).cast("double") / float(1 << 53)).alias("draw")
    # shares of different texts, as copies share a draw; twice the bound leaves room for the estimate's error
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(draw).alias("texts")).orderBy("lang").collect()
    part = DOC_CHARS // PLACES
    starts = [(F.lit(1) + F.floor((F.length("text") - part) * k / (PLACES - 1))).cast("int") for k in range(PLACES)]
    spread = F.when(F.length("text") <= DOC_CHARS, F.col("text")).otherwise(F.concat_ws(" ", *[F.substr("text", x, F.lit(part)) for x in starts]))
    model: dict[str, bytes] = {}
    for i in range(0, len(counts), LANGUAGES_AT_ONCE):
        share = F.create_map(*[x for r in counts[i : i + LANGUAGES_AT_ONCE] for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * sample_docs / max(1, r["texts"]))))])
        sample = rows.withColumn("draw", draw).where(F.col("draw") < F.element_at(share, F.col("lang"))).select("lang", "draw", spread.alias("text"))
        # copies of a text count once; a language has one row of so many texts
        sample = sample.groupBy("lang", "draw").agg(F.min("text").alias("text")).groupBy("lang")
        sample = sample.agg(F.slice(F.sort_array(F.collect_list(F.struct("draw", "text"))), 1, sample_docs).alias("drawn")).collect()
        model |= {r["lang"]: _dictionary([x["text"] for x in r["drawn"]], dict_bytes) for r in sample}
    return dict(sorted(model.items()))


def _dictionary(texts: list[str], dict_bytes: int) -> bytes:
    got: list[str] = []
    for t in texts:
        if t not in got[-8:]:
            got.append(t)
    return " ".join(got).lower().encode()[:dict_bytes]


def _classify(model: dict[str, bytes], level: int):
    """A function of a text column; other columns of a row don't go to Python."""

    def judge(texts: pa.Array) -> pa.Array:
        import zstandard

        def coders_of(at: int) -> list:
            coders = []
            for raw in raws[at : at + LANGUAGES_AT_ONCE]:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
            return coders

        names, raws = list(model), list(model.values())
        state = worker_state()
        if getattr(state, "model", None) != (level, LANGUAGES_AT_ONCE, model):  # workers are used again
            state.model, state.coders = (level, LANGUAGES_AT_ONCE, model), coders_of(0) if len(raws) <= LANGUAGES_AT_ONCE else None
        least: list[list] = [[] for _ in range(len(texts))]  # the two smallest (size, language) of each row
        for at in range(0, len(raws), LANGUAGES_AT_ONCE):
            coders = state.coders or coders_of(at)
            for row, t in enumerate(texts):
                t = t.as_py()
                if not t or not any(c.isalpha() for c in t):
                    continue
                raw = memoryview(t.lower().encode())
                blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
                least[row] = sorted(least[row] + [(sum(len(c.compress(b)) for b in blocks), at + i) for i, c in enumerate(coders)])[:2]
        best = pa.array([names[x[0][1]] if x else UNKNOWN for x in least], pa.string())
        margin = pa.array([0.0 if not x else 1.0 if len(x) == 1 else 1 - x[0][0] / x[1][0] for x in least], pa.float64())
        return pa.StructArray.from_arrays([best, margin], ["lang", "margin"])

    return F.arrow_udf(judge, "struct<lang:string,margin:double>")


def classify(docs: DataFrame, model: dict[str, bytes], text: str = "text", min_margin: float = 0.004, level: int = 6) -> DataFrame:
    """The input's columns and _lang, _margin (0 to 1: how much smaller than the runner-up), _rejected.

    A null text, or one without a letter, is `und` and rejected; so is every text if no language was learnt.
    Others get the best language, and are rejected if the margin is under `min_margin`. Columns named like
    the three are replaced; repeated rows are judged alike.
    """
    own = [c for c in docs.columns if c not in ("_lang", "_margin", "_rejected")]
    judged = docs.select(*[F.col(f"`{c}`") for c in own], _classify(model, level)(F.col(text)).alias("_margin"))
    out = judged.select(*[F.col(f"`{c}`") for c in own], F.col("_margin.lang").alias("_lang"), F.col("_margin.margin").alias("_margin"))
    return out.withColumn("_rejected", (F.col("_lang") == UNKNOWN) | (F.col("_margin") < min_margin))


def op5_compression_language(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_margin").alias("score"), F.col("_rejected").alias("rejected"))
