"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document's terms are its word shingles, weighted by how often they occur. A term of weight S is dealt
out unit by unit: unit j goes to bin (start + j * stride) mod BINS, start and odd stride drawn from the term, so
the units of the lighter of two weights lie where those of the heavier do, and minima and
maxima of weights, summed over the bins, are those of the documents. In a bin, a term that has W units there and
gamma-distributed r, c and uniform b (drawn from term and place) has the score ln c - r (t - b) - r with
t = floor(ln W / r + b); the term with the smallest score is the bin's sample, together with t. The
share of bins that agree, among those that are not empty in both, estimates the generalised Jaccard similarity.

Terms are rows of generated code, not lambdas over arrays: hashes are sorted inside their document, each run
of equal ones gives a term and its weight, and the smallest score of a bin is a hash aggregate in the
partition that already holds the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswork.llm import common

#: Samples of a signature (a power of two), bits of a sample's identity, and of a score, which stands above it in a long.
BINS = 128
ID_BITS = 16
SCORE_BITS = 40
LANES = 64 // ID_BITS


def word_array(text: Column) -> Column:
    """The lower-cased words of a text."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def term_hashes(words: str, size: int) -> Column:
    """Sorted hashes of all runs of `size` words; with fewer words the whole sequence as one, without words none."""
    w, n = F.col(words), F.size(words)
    runs = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))
    return F.sort_array(F.when(n < size, F.slice(F.array(F.xxhash64(w)), 1, F.least(n, F.lit(1)))).otherwise(F.slice(runs, 1, n - (size - 1))))


def run_ends(terms: str) -> Column:
    """Places of the last of each run of equal values in a sorted array."""
    return F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda p: F.coalesce(F.get(F.col(terms), p + 1) != F.get(F.col(terms), p), F.lit(True)))


def weighted(rows: DataFrame, terms: str, *other: str) -> DataFrame:
    """(other columns, term, weight): the distinct values of a sorted array and how often each occurs; an empty array has one null term."""
    ends = rows.select(*other, terms, F.when(F.size(terms) > 0, run_ends(terms)).alias("ends"))
    # outer: else Spark would push a filter on the array's size below all projections and compute it twice
    each = ends.select(*other, terms, "ends", F.posexplode_outer("ends").alias("k", "end"))
    return each.select(*other, F.get(F.col(terms), F.col("end")).alias("term"), (F.col("end") - F.coalesce(F.get("ends", F.col("k") - 1), F.lit(-1))).alias("weight"))


def _uniform(h: str, shift: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) / float(1 << 21)


def dealt(rows: DataFrame, term: str, weight: str) -> DataFrame:
    """Each term's bins (`bin`) and what it offers there (`sample`: score above identity; a bin keeps the smallest)."""
    units = rows.withColumn("unit", F.explode_outer(F.sequence(F.lit(0), F.least(F.col(weight), F.lit(BINS)) - 1)))
    start, stride = F.col(term).bitwiseAND(F.lit(BINS - 1)), F.shiftrightunsigned(term, 32).bitwiseAND(F.lit(BINS - 1)).bitwiseOR(F.lit(1))
    units = units.withColumn("bin", (start + F.col("unit") * stride).bitwiseAND(F.lit(BINS - 1)).cast("int"))
    units = units.withColumn("held", F.floor((F.col(weight) - 1 - F.col("unit")) / BINS) + 1)
    drawn = units.withColumn("one", F.xxhash64(term, "unit")).withColumn("two", F.xxhash64("one"))
    drawn = drawn.withColumn("r", -F.log(_uniform("one", 0) * _uniform("one", 21))).withColumn("b", _uniform("one", 42))
    drawn = drawn.withColumn("t", F.when(F.col("held") == 1, F.lit(0).cast("long")).otherwise(F.floor(F.log("held") / F.col("r") + F.col("b"))))
    score = F.log(-F.log(_uniform("two", 0) * _uniform("two", 21))) - F.col("r") * (F.col("t") - F.col("b")) - F.col("r")
    level = F.greatest(F.lit(0), F.least(F.lit((1 << SCORE_BITS) - 1), ((score + 512) * float(1 << (SCORE_BITS - 10))).cast("long")))
    identity = F.pmod(F.shiftrightunsigned("two", 64 - ID_BITS) + F.col("t") * 40503, F.lit((1 << ID_BITS) - 1)) + 1
    return drawn.withColumn("sample", F.shiftleft(level, ID_BITS).bitwiseOR(identity))


def signatures(rows: DataFrame, by: list[str], texts: list[str], size: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """(by, carry, signature0, signature1 ..., near: likeness of the first two or null) from the `texts` columns of each row.

    A signature is an array<bigint> of LANES samples each, empty bins being 0. Rows equal in `by` have to be equal, and `carry` names other
    columns of theirs that are long. If the rows are dealt by some of `by` already, nothing is moved.
    """
    parted = rows.select(*by, *carry, F.explode(F.array(*[F.struct(F.lit(k).alias("which"), F.col(t).alias("text")) for k, t in enumerate(texts)])).alias("one"))
    words = parted.select(*by, *carry, "one.which", word_array(F.col("one.text")).alias("words"))
    terms = words.select(*by, *carry, "which", term_hashes("words", size).alias("terms"))
    samples = dealt(weighted(terms, "terms", *by, *carry, "which"), "term", "weight")
    held = [F.min(c).alias(c) for c in carry]
    # a slot is a long of the signature: LANES bins; identities are 1 and more, so 0 is an empty bin
    samples = samples.select(*by, *carry, "which", "sample", F.shiftright("bin", LANES.bit_length() - 1).alias("slot"), F.col("bin").bitwiseAND(F.lit(LANES - 1)).alias("lane"))
    each = [(k, i) for k in range(len(texts)) for i in range(LANES)]
    least = [F.min(F.when((F.col("which") == k) & (F.col("lane") == i), F.col("sample"))).alias(f"s{k}_{i}") for k, i in each]
    slots = samples.groupBy(*by, "slot").agg(*held, *least)
    lane = lambda k, i: F.coalesce(F.shiftleft(F.col(f"s{k}_{i}").bitwiseAND(F.lit((1 << ID_BITS) - 1)), ID_BITS * i), F.lit(0).cast("long"))
    slots = slots.select(*by, *carry, "slot", *[reduce(Column.bitwiseOR, [lane(k, i) for i in range(LANES)]).alias(f"p{k}") for k in range(len(texts))])
    empty = F.lit(0).cast("long")
    long_of = lambda k: F.array(*[F.coalesce(F.max(F.when(F.col("slot") == i, F.col(f"p{k}"))), empty) for i in range(BINS // LANES)]).alias(f"signature{k}")
    either, differ = (F.sum(_used(getattr(F.col("p0"), how)(F.col("p1")))) if len(texts) > 1 else F.lit(None) for how in ("bitwiseOR", "bitwiseXOR"))
    near = F.when(either == 0, F.lit(1.0)).otherwise(F.try_divide((either - differ).cast("double"), either.cast("double")))
    return slots.groupBy(*by).agg(*held, *[long_of(k) for k in range(len(texts))], near.alias("near"))


def _used(x: Column) -> Column:
    """How many lanes of a long are not 0."""
    for shift in (8, 4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(sum(((1 << (ID_BITS - shift)) - 1) << (ID_BITS * k) for k in range(LANES)))))
    return F.bit_count(x.bitwiseAND(F.lit(sum(1 << (ID_BITS * k) for k in range(LANES)))))


def likeness(a: Column, b: Column) -> Column:
    """Estimated generalised Jaccard similarity of two signatures; 1 if both texts have no term."""
    # lanes that are used and differ, above lanes that are used in either
    pairs = F.zip_with(a, b, lambda x, y: F.shiftleft(_used(x.bitwiseXOR(y)), 16) + _used(x.bitwiseOR(y)))
    either = lambda s: s.bitwiseAND(F.lit(65535)).cast("double")
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x, lambda s: F.when(either(s) == 0, F.lit(1.0)).otherwise(F.try_divide(either(s) - F.shiftright(s, 16), either(s))))


def fingerprint(samples: Column) -> Column:
    """The signature as a string of 16 hex digits a long."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(key, signature array<bigint>, fingerprint string) of every row; texts move once, by key.

    Equal texts have equal fingerprints. A null text counts as empty; texts without words have a signature of zeros. Null keys are
    kept; rows that repeat key and text give a row each; other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("content", F.xxhash64("text", F.lit(1)))
    rows = rows.repartition("id", "content")
    found = signatures(rows, ["id", "content"], ["text"], size).select(F.col("id").alias("found_id"), F.col("content").alias("found_content"), "signature0")
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("content") == F.col("found_content"))
    out = rows.select("id", "content").join(found, same, "left").select(F.col("id").alias(key), F.col("signature0").alias("signature"))
    return out.withColumn("fingerprint", fingerprint(F.col("signature")))


def neighbours(ids: DataFrame) -> DataFrame:
    """(id, previous, n_previous) from distinct (id, n): the next smaller id of each id but the first, which has null.

    Ids are dealt by range and ordered inside each part; the parts' own ends are a row a part.
    """
    part = common.stored(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("id")
    one = part.withColumn("previous", F.lag(F.struct("id", "n")).over(inside))
    ends = part.groupBy("part").agg(F.max(F.struct("id", "n")).alias("end"))
    # one row for each part: its place in order needs a window over parts only
    carry = ends.withColumn("carry", F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("part"))).select("part", "carry")
    both = one.join(carry, "part").withColumn("previous", F.coalesce("previous", "carry"))
    return both.select("id", F.col("previous.id").alias("previous"), F.col("previous.n").alias("n_previous"))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has the last quarter replaced by as many first code points of the next text,
    ascending key, after the last the first. A null text is empty. Rows that repeat a key have the same
    next text, and the one of their texts with the smallest hash comes next to others; a row whose key is null, or a table of
    a single key, is compared with itself. Other columns are ignored. An empty table gives an empty one.
    """
    content = F.xxhash64("text", F.lit(1))
    # rows without a key are spread by their text; real keys have spread 0
    base = docs.select(F.col(key).cast("long").alias("given"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select(F.coalesce("given", F.lit(0)).alias("id"), F.coalesce(F.when(F.col("given").isNull(), F.pmod(content, F.lit(1 << 20)) + 1), F.lit(0).cast("long")).alias("spread"), "text")
    ids = common.stored(base.where("spread = 0").groupBy("id", "spread").agg(F.max(F.length("text")).alias("n"), F.min(content).alias("first")))
    ends = ids.agg(F.max(F.struct("id", "n")).alias("last"))  # one row
    order = neighbours(ids.select("id", "n")).crossJoin(F.broadcast(ends)).select("id", F.coalesce("previous", "last.id").alias("previous"), F.coalesce("n_previous", "last.n").alias("n_previous"))
    order = common.stored(order.join(ids.select("id", "spread", "first"), "id"))
    # the texts move once: both joins read the same exchange of them (their keys can't be null, so Spark adds no filter to one)
    nexts = base.join(order, ["id", "spread"])
    head = F.substring(F.col("text"), F.lit(1), F.floor(F.col("n_previous") / 4).cast("int"))
    heads = nexts.groupBy(F.col("previous").alias("id"), "spread").agg(F.min(F.struct(content.alias("content"), head.alias("head")))["head"].alias("head"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.when(F.col("head").isNull(), F.substring(F.col("text"), n - quarter + 1, quarter)).otherwise(F.substring(F.col("head"), F.lit(1), quarter)))
    both = base.join(heads, ["id", "spread"], "left").select("id", "spread", F.monotonically_increasing_id().alias("row"), content.alias("content"), "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    digest = both.withColumn("digest", F.sha2(F.encode("edited", "UTF-8"), 256))
    parts = [f"digest{k}" for k in range(4)]
    digest = digest.select("*", *[F.conv(F.substring("digest", 16 * k + 1, 16), 16, -10).cast("long").alias(p) for k, p in enumerate(parts)])
    found = common.stored(signatures(digest, ["id", "spread", "row"], ["text", "edited"], size, ("content", "n_chars", *parts)))
    after = found.where("spread = 0").select("id", F.col("content").alias("first"), F.col("signature0").alias("signature_next")).join(order, ["id", "first"])
    after = after.select(F.col("previous").alias("id"), "spread", "signature_next").dropDuplicates(["id", "spread"])
    out = found.join(after, ["id", "spread"], "left")
    return out.select(
        F.when(F.col("spread") == 0, F.col("id")).alias(key), "n_chars", F.concat(*[F.lpad(F.lower(F.hex(p)), 16, "0") for p in parts]).alias("edited_sha256"),
        fingerprint(F.col("signature0")).alias("fingerprint"), fingerprint(F.col("signature1")).alias("edited_fingerprint"),
        F.col("near").alias("near_edited"), likeness(F.col("signature0"), F.coalesce("signature_next", "signature0")).alias("near_next"),
    )


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_edited(common.table(spark, sf_dir, "documents"))
