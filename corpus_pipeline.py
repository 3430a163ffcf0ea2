"""A corpus pipeline of five stages: each works on all documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm import common, language, mixing, ngram_join, packing, repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: no letter (so null and empty texts too), or hardly any margin between two languages; long texts are judged whole, repeated
    rows alike. Languages are learnt from these documents. Here and below, an empty table gives an empty one, and columns beyond COLUMNS are left out."""
    judged = language.classify(docs.select(*COLUMNS), language.learn(docs))
    return judged.where(~F.col("_rejected")).select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, so that texts under a null or repeated id are told apart; stored, so that it stays."""
    return common.stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (a null id comes last, of rows that repeat id and text one). Null and empty texts
    are near nothing, so they all stay; whole texts are compared, however long."""
    rows = _numbered(docs)
    groups = common.stored(ngram_join.shingle_components(rows, key="_row").select(F.col("key").alias("_row"), "component_id"))
    ids = groups.join(rows.select("_row", "doc_id"), "_row")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("one"))
    dropped = common.stored(groups.select("_row").join(first.select("one._row"), "_row", "left_anti"))
    return common.without(rows, dropped, "_row").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that occur elsewhere are cut out; a character cut in part goes. A null text becomes an empty one; no row goes, repeated ids are
    told apart by row."""
    kept = repeats.remove_repeats(_numbered(docs), key="_row", carry=("doc_id", "lang", "source"), characters=True)
    return kept.select("rest.doc_id", F.col("kept").cast("string").alias("text"), "rest.lang", "rest.source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is a source of its own, a null text has no word."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2,048; a null text is its end token alone, repeated rows are packed as often as they occur, long ones in pieces."""
    return packing.pack(docs, packing.word_tokenizer()).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language", identify_language),
    ("ngram_join", join_near_copies),
    ("suffix_dedup", cut_repeats),
    ("pareto_mix", mix_sources),
    ("best_two_fit", pack_sequences),
]

#: Language models, 400-byte repeats and tokenizers have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows stored for the next; an empty table gives no sequence."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
