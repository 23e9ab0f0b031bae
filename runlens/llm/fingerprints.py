"""SimHash document fingerprints and Hamming search, with DataFrame functions only.

Terms are pairs of neighbouring lower-cased words (the single word of a one-word text); a term weighs as often as it
occurs. Each term's 64-bit hash votes on every bit; two bits share one long counter, so a document needs 32 sums in
one hash aggregate. The search cuts fingerprints into blocks: two fingerprints within the radius agree on all but
``radius`` blocks, so one of the permuted tables, each keyed by a choice of whole blocks, holds both under one key.

Defined results: a null or empty text has fingerprint zero. Equal texts have equal fingerprints. Repeated rows stay
repeated; ties of doc_id are ordered by text. A null doc_id comes first. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import join_counted, settle

BITS, RADIUS, BLOCKS = 64, 3, 5
#: Documents in a bucket of the ordered pass, and the most buckets (their bounds go to the driver).
BUCKET, MOST_BUCKETS = 2000, 10_000


def terms(text: Column) -> Column:
    """Hashes of the text's terms, repeats included."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def votes(term: Column) -> list[Column]:
    """32 sums; sum j counts bit j in its low half and bit j + 32 in its high half."""
    return [F.sum(F.shiftright(term, j).bitwiseAND(F.lit(1)) + F.shiftright(term, j).bitwiseAND(F.lit(1 << 32))).alias(f"v{j}") for j in range(32)] + [F.count(term).alias("n")]


def ballot() -> Column:
    """The fingerprint from votes(): a bit is 1 if it is set in over half of the terms."""
    bits = []
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(f"v{j}", 32)
        bits += [F.when(2 * low > F.col("n"), F.lit(1 << j)).otherwise(F.lit(0)), F.when(2 * high > F.col("n"), F.lit((1 << j + 32) - (1 << 64 if j == 31 else 0))).otherwise(F.lit(0))]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return F.coalesce(bits[0].cast("long"), F.lit(0).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def text_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def buckets(docs: DataFrame) -> tuple[Column, DataFrame]:
    """Ordered buckets of doc_id: the bucket's number, and rows (first, before, wrap) that name each bucket's first id."""
    n = docs.count()
    count = min(MOST_BUCKETS, max(1, n // BUCKET))
    cuts = docs.select(F.percentile_approx("doc_id", [k / count for k in range(1, count)] or [0.5], 100 * count)).first()[0] or []
    cuts, step = sorted({*cuts}), max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[::step], [cuts[k : k + step] for k in range(0, len(cuts), step)]
    at = F.lit(0)
    if cuts:
        group = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda c: c <= F.col("doc_id")))
        nested = F.array(*(F.array(*map(F.lit, x)) for x in fine))
        inside = F.size(F.filter(F.element_at(nested, F.greatest(group, F.lit(1))), lambda c: c <= F.col("doc_id")))
        at = F.when(F.col("doc_id").isNull() | (group == 0), 0).otherwise((group - 1) * step + inside)
    at = at.cast("int")
    found = sorted((r.b, r.first) for r in docs.groupBy(at.alias("b")).agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("first")).collect())
    rows = [(first, found[k - 1][0], k == 0) for k, (_, first) in enumerate(found)]
    return at, docs.sparkSession.createDataFrame(rows, f"first {docs.schema['doc_id'].dataType.simpleString()}, before int, wrap boolean")


def edited(docs: DataFrame) -> DataFrame:
    """Per document: the fingerprints of its text, of its edited text and of the next document, with likenesses.

    Edited: the last floor(n / 4) code points give way to the first as many (or all) of the next document, ascending
    doc_id, after the last the first. One shuffle of texts by bucket; each bucket also gets the next bucket's first row.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at, firsts = buckets(own.select("doc_id"))
    guests = F.broadcast(firsts)  # at most MOST_BUCKETS rows
    placed = own.withColumn("bucket", at).join(guests, own["doc_id"].eqNullSafe(guests["first"]), "left")
    places = F.array_compact(F.array(F.struct("bucket", F.lit(False).alias("guest"), F.lit(False).alias("wrap")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest"), "wrap"))))
    placed = placed.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.*")
    order = ["wrap", F.col("doc_id").asc_nulls_first()]
    following = Window.partitionBy("bucket").orderBy(*order, "text")
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    after = F.coalesce("after", F.lit(""))
    rows = placed.withColumns({"after": F.lead("text").over(following), "row": F.row_number().over(following)})
    rows = rows.select("bucket", "row", "doc_id", "guest", "wrap", n.cast("long").alias("n_chars"), "text", F.when(~F.col("guest"), F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring(after, F.lit(1), k))).alias("changed"))
    keys = ["bucket", "row", "doc_id", "guest", "wrap", "n_chars", "edited_sha256"]
    sides = rows.withColumn("edited_sha256", F.sha2(F.col("changed"), 256)).select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("x")), F.struct(F.lit(1).alias("side"), F.col("changed").alias("x")))).alias("s"))
    counted = sides.where("s.x is not null").select(*keys, "s.side", F.explode_outer(terms(F.col("s.x"))).alias("t")).groupBy(*keys, "side").agg(*votes(F.col("t"))).select(*keys, "side", ballot().alias("fp"))
    both = counted.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"))
    next_fp = F.lead("fp").over(Window.partitionBy("bucket").orderBy("row"))
    return both.withColumn("next_fp", next_fp).where(~F.col("guest")).select("doc_id", "n_chars", "edited_sha256", "fp", text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def block_masks(radius: int, blocks: int) -> list[int]:
    """Of each permuted table, the bits of its key."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    return [sum(c) for c in itertools.combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks for a table of ``n`` fingerprints: keys have at least as many bits as n has, so a key holds about one by chance."""
    return next((b for b in range(radius + 2, radius + 6) if BITS * (b - radius) // b >= n.bit_length()), radius + 5)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def within(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Rows (query, fp, bits): all fingerprints of ``fps`` within ``radius`` bits of each of ``queries`` (distinct, column fp).

    A pair that agrees on several tables' keys is reported by the first of them alone, so nothing needs to be made distinct.
    """
    masks = [signed(m) for m in block_masks(radius, blocks)]
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("t", "key")
    left = queries.select(F.col("fp").alias("query"), keys)
    right = fps.select("fp", keys)
    apart = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(masks)))
    return left.join(right, ["t", "key"]).where((F.bit_count(apart) <= radius) & (first == F.col("t"))).select("query", "fp", F.bit_count(apart).alias("bits"))


def fingerprinted(docs: DataFrame, every: int = 50, radius: int = RADIUS) -> DataFrame:
    """edited() with class_id (smallest doc_id of an equal fingerprint) and, for ids divisible by ``every``, n_within:
    the number of other documents within ``radius`` bits. Both come from one permuted-table search over distinct fingerprints."""
    own = settle(edited(docs), "edited")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.max((F.col("doc_id") % every == 0).cast("int")).alias("asks"))
    classes = settle(classes, "classes")
    near = within(classes.where("asks = 1").select("fp"), classes.select("fp"), radius, blocks_for(classes.count(), radius))
    found = near.join(classes.select("fp", "copies"), "fp").groupBy(F.col("query").alias("fp")).agg((F.sum("copies") - 1).alias("n_within"))
    known = classes.select("fp", "class_id", "copies").join(found, "fp", "left")
    asked = F.when(F.col("doc_id") % every == 0, F.col("n_within")).alias("n_within")
    total = classes.agg(F.sum("copies")).first()[0] or 0
    return join_counted(own, settle(known, "known"), "fp", "copies", total).select(*(c for c in own.columns if c != "fp"), "class_id", asked)
