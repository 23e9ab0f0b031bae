"""Secret scan with DataFrame functions only: fixed patterns, and character Markov models of random and ordinary strings.

The base kinds are found leftmost and without overlap by splitting the text at its matches, so positions follow from
the lengths of the pieces. The method's own kind, ``markov``, takes long tokens whose log-likelihood ratio between two
first-order character chains (random strings against ordinary identifiers, trained from labelled samples) is high, and
keeps those that overlap no base span.

Defined results: a null or empty text has no spans. Repeated rows stay repeated. A null doc_id stays null. An empty
table gives no rows. Extra columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST = 6

#: Tokens the chains judge, and the alphabet of the chains; every other character is one further state.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9+/_=-]{4,}"
LONG = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1
#: Training: documents sampled for ordinary words and labelled secrets, further random strings, pseudo-count of a character, weight of the characters' own frequencies.
SAMPLE, RANDOM, PSEUDO, LEAN = 2000, 400, 0.5, 10.0
#: A token is a secret if its ratio is above this many nats in all and above this a step.
TOTAL, MEAN = 12.0, 0.6


def cut(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, gap, size, value): each match with the length of the text between it and the one before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    found = F.zip_with(gaps, matches, lambda g, m: F.struct(F.lit(kind).alias("kind"), F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("value")))
    none = F.array().cast("array<struct<kind:string,gap:bigint,size:bigint,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def steps(token: Column) -> Column:
    """The numbers of a token's character transitions, from 1."""
    states = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    states = F.filter(states, lambda s: s.isNotNull())
    n = F.greatest(F.size(states) - 1, F.lit(0))
    return F.zip_with(F.slice(states, 1, n), F.slice(states, 2, n), lambda a, b: a * STATES + b + 1)


def random_strings(spark: SparkSession, n: int = RANDOM) -> DataFrame:
    """Labelled samples of random strings: digests written in hexadecimal, base 64 and upper-case letters and digits."""
    digest = F.sha2(F.concat(F.lit("random string "), F.col("id").cast("string")), 512)
    base64 = F.base64(F.unhex(digest))
    upper = F.regexp_replace(F.upper(base64), "[^A-Z0-9]", "")
    return spark.range(n).select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(base64, 1, 40), F.substring(upper, 1, 24))).alias("token"))


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio of every transition, from a bounded sample of documents (smallest hashes of doc_id).

    Random: values of base spans in the sample and random_strings(). Ordinary: the sample's words outside base spans that
    are too short to be judged themselves.
    """
    ids = F.broadcast(docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` ids
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text")
    secrets = texts.select(F.explode(F.concat(F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: v), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))).alias("token")).where(F.length("token") >= 12)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = texts.select(F.explode(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0))).alias("token"))
    words = words.where(F.length("token") < LONG)
    labelled = secrets.union(random_strings(docs.sparkSession)).select(F.lit(1).alias("random"), "token").union(words.groupBy("token").count().select(F.lit(0), "token"))
    seen = labelled.select("random", F.explode(steps(F.col("token"))).alias("s")).groupBy("random", "s").count().collect()
    counts = [[0.0] * (STATES * STATES) for _ in range(2)]
    for r in seen:
        counts[r["random"]][r["s"] - 1] += r["count"]

    def chain(c: list[float]) -> list[float]:
        """Log-probabilities; rarely seen states lean towards how common the next character is anywhere."""
        common = [PSEUDO + sum(c[b::STATES]) for b in range(STATES)]
        total = sum(common)
        rows = [sum(c[a * STATES : (a + 1) * STATES]) for a in range(STATES)]
        return [math.log((v + LEAN * common[k % STATES] / total) / (rows[k // STATES] + LEAN)) for k, v in enumerate(c)]

    return [a - b for a, b in zip(chain(counts[1]), chain(counts[0]), strict=True)]


def ratio(token: Column, model: Column) -> Column:
    return F.aggregate(steps(token), F.lit(0.0), lambda total, s: total + F.element_at(model, s))


def scan(docs: DataFrame, model: list[float], total: float = TOTAL, mean: float = MEAN) -> DataFrame:
    """Per document: doc_id and ``found``, its spans (start, rank, kind, end) in order; base kinds and ``markov``."""
    text = F.coalesce("text", F.lit(""))
    parts = F.concat(cut(text, "assign", ASSIGN), cut(text, "access", ACCESS), cut(text, "hex", HEX), cut(text, "markov", TOKEN))
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())  # numbered before the spans fan out
    rows = rows.select("doc_id", "row", F.posexplode_outer(parts).alias("at", "m")).select("row", "doc_id", "at", "m.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("at")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    score = ratio(F.col("value"), F.lit(model))
    right = F.when(F.col("kind") == "assign", F.length(F.regexp_extract("value", ASSIGN, 2)) >= ASSIGN_LEAST).when(F.col("kind") == "markov", (score > total) & (score > mean * (F.col("size") - 1))).otherwise(F.col("kind").isNotNull())
    rows = rows.withColumn("right", right)
    base = F.col("right") & (F.col("kind") != "markov")
    by_start = Window.partitionBy("row").orderBy("start", "end")
    last = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"last": last, "following": following})
    apart = (F.coalesce("last", F.lit(-1)) <= F.col("start")) & (F.coalesce("following", F.col("end")) >= F.col("end"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.when(F.col("right") & ((F.col("kind") != "markov") | apart), F.struct("start", rank.alias("rank"), "kind", "end"))
    return rows.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("found")).select("doc_id", "found")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    found = scan(docs, train(docs))
    base = F.filter("found", lambda s: s["kind"] != "markov")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"), counts[3])
