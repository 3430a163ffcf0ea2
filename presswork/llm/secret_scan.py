"""Secret scans: patterns of known shape, and strings that a primed zstandard can't compress where a secret would stand.

Three patterns give the base spans. Every other long string of key characters with a letter and a digit, behind a word such as key, token or
bearer, is a candidate. Its marginal cost is the size of its surroundings with it minus their size without it, both compressed with a raw-content
dictionary of the corpus's identifiers. Names, paths and words that stand nearby are cheap; a random string costs about its own length and is reported.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import common

#: The three patterns of the contract. One of hex or access is long enough in a whole run or not at all, so its length can stand in the
#: pattern; an assignment that is too short still takes its characters away from later ones.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Candidates: runs of key characters of at least so many; words that make a place sensitive, so many characters ahead of one.
KEY_CHARS = "A-Za-z0-9+/_.=-"
LEAST = 20
CANDIDATE = re.compile(rf"(?<![{KEY_CHARS}])[{KEY_CHARS}]{{{LEAST},}}")
SENSITIVE = re.compile(r"secret|token|passw|passphrase|pwd|credential|authoriz|authent|bearer|private|api.?key|access.?key|signing|signature|jwt|session|cookie|webhook", re.I | re.A)
AHEAD, BEHIND = 96, 48
#: A candidate is reported if it costs at least so many bytes a character.
NOVEL = 0.72
LEVEL = 6
#: Pieces of identifiers (and words) in the dictionary: the most frequent ones, in at most so many bytes.
PIECE = "[A-Za-z][a-z]{3,31}"
MOST_PIECES = 8_000
DICT_BYTES = 64_000
#: Words of code that are in every dictionary.
CODE = "import return function const public static string authorization authentication configuration connection password passphrase credentials secret token bearer session cookie signature private_key public_key api_key access_key client_secret client_id"

SPANS = "array<struct<kind:string,start:int,end:int,novelty:double>>"


def identifiers(docs: DataFrame, text: str = "text") -> bytes:
    """The dictionary: the pieces of identifiers and words (a letter and three or more small ones) that occur most often over all texts, the commonest last.

    Counted by Spark over whole texts, combined before the shuffle. A histogram of the counts (a few hundred rows) tells from which count on the
    MOST_PIECES first are found, so no more than about these go on to be sorted. They hold no digit, and a candidate needs one, so a secret that is copied often can't hide itself. Nulls and an empty table add nothing.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(PIECE), F.lit(0))
    step = F.floor(8 * F.log2("count")).cast("int").alias("step")
    counts = common.stored(docs.select(F.explode(found).alias("word")).groupBy("word").count().withColumn("step", step))
    have, least = 0, 0
    for r in counts.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        have, least = have + r["n"], r["step"]
        if have >= MOST_PIECES:
            break
    most = counts.where(F.col("step") >= least).orderBy(F.desc("count"), "word").limit(MOST_PIECES).collect()
    words, size = [], len(CODE)
    for r in most:
        size += len(r["word"]) + 1
        if size > DICT_BYTES:
            break
        words.append(r["word"])
    return " ".join([*reversed(words), CODE]).encode()


@lru_cache(maxsize=2)
def _coder(raw: bytes):  # noqa: ANN202
    import zstandard

    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def novelty(text: str, start: int, end: int, raw: bytes) -> float:
    """Marginal compressed bytes a character of text[start:end] between its surroundings, from which its own copies are taken out."""
    candidate = text[start:end]
    before, behind = (x.replace(candidate, "") for x in (text[max(0, start - AHEAD) : start], text[end : end + BEHIND]))
    size = lambda s: len(_coder(raw).compress(s.encode()))
    return (size(before + candidate + behind) - size(before + behind)) / len(candidate.encode())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns: leftmost, not overlapping within a kind, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def spans(text: str, raw: bytes) -> list[tuple[int, int, str, float | None]]:
    """All spans by start, then kind: the base ones, and candidates that lie in none of them and are novel."""
    base = base_spans(text)
    out: list[tuple[int, int, str, float | None]] = [(*s, None) for s in base]
    for m in CANDIDATE.finditer(text):
        start, end = m.start() + len(m[0]) - len(m[0].lstrip(".-")), m.end() - len(m[0]) + len(m[0].rstrip(".-"))
        found = text[start:end]
        if len(found) < LEAST or not (any("0" <= c <= "9" for c in found) and any(c.isalpha() for c in found)):
            continue
        if any(a <= start and end <= b for a, b, _ in base) or not SENSITIVE.search(text, max(0, start - AHEAD), start):
            continue
        new = novelty(text, start, end, raw)
        if new >= NOVEL:
            out.append((start, end, "novel", new))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame, raw: bytes, text: str = "text") -> DataFrame:
    """The input's columns and _spans: an array of (kind, start, end, novelty), in code points, end exclusive, by start and then kind.

    A null or empty text has no span. Rows are judged one by one, so repeated rows agree, whatever their number; a column named _spans is replaced, others may
    have any name. Only the text goes to Python, whole; a text has to fit a task. Equal candidates of one text are judged each at its own place.
    """

    def judge(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            s = t.as_py()
            out.append([{"kind": k, "start": a, "end": b, "novelty": n} for a, b, k, n in spans(s, raw)] if s else [])
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())])))

    own = [F.col(f"`{c}`") for c in docs.columns if c != "_spans"]
    return docs.select(*own, F.arrow_udf(judge, SPANS)(F.col(f"`{text}`")).alias("_spans"))


def op13_secret_novelty(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, identifiers(docs)).select("doc_id", "_spans")
    of = lambda *kinds: F.filter("_spans", lambda s: s["kind"].isin(*kinds))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(told(of(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"), told(F.col("_spans")).alias("spans"), counts[3])
