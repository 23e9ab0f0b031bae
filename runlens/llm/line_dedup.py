"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

A line's ID is a 128-bit hash of the trimmed line; blank lines are no lines. Suffixes never cross documents. Round k
ranks every suffix by its first 2 ** k lines from the ranks of its two halves, in order; suffixes whose prefix occurs
once are discarded, as no longer prefix of theirs can repeat. Doubling goes on until no pair of ranks repeats. Suffixes
of one rank are a longest-common-prefix interval of depth 2 ** k, those of one pair of overlapping ranks one of a depth
between; every member but the first in (doc_id, row, line) order begins a later copy. A repeated run counts if it has at
least ``words`` words. Since a line has a word at least, longer runs than ``words`` lines consist of qualifying runs of
``words`` lines: what is deleted follows from the depths up to ``words``, the maximal runs from all.

Of equal documents only the first has suffixes: every run of a later one is also a run of the first, so a later one is a
single run from its first line to its last.

Lines of later copies are deleted, the rest is kept as it was, joined by line breaks. ``runs`` lists the maximal runs:
per depth, windows that follow one another and whose first occurrences do so too are one run, and of runs within
another only the outer stays.

Defined results: null texts stay null, empty ones empty. Repeated rows are copies of the first. A null doc_id comes
first. An empty table gives no rows. All columns are kept, but for columns named n_lines, gone or runs, which the
results replace. Rows are numbered once, in a settled copy, so their numbers hold when executors are lost or scans are
cut otherwise. Very common lines and runs are joined by broadcast, so no task holds all places of one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import join_counted, settle

WORDS = 5
SPACE = " \t\r\x0b\x0c"


def numbered(docs: DataFrame) -> DataFrame:
    """A settled copy: ``row`` numbers the rows, the columns are named c0, c1, ... so that no name can clash."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    text = F.col(f"c{docs.columns.index('text')}")
    return settle(plain.withColumns({"row": F.monotonically_increasing_id(), "d1": F.xxhash64(text), "d2": F.xxhash64(F.lit(1), text)}), "numbered")


def words_of(x: Column) -> Column:
    """Words of a trimmed text; with single blanks alone they need no pattern."""
    plain = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    odd = reduce(lambda a, b: a | b, (x.contains(c) for c in ("  ", "\t", "\r", "\x0b", "\x0c")))
    return F.when(odd, F.size(F.split(x, r"\s+"))).otherwise(plain)


def equal_documents(docs: DataFrame) -> DataFrame:
    """Rows (row, source) from rows (row, doc_id, d1, d2): the documents that are equal to an earlier one, and the id of the first."""
    place = F.struct("doc_id", "row")
    first = settle(docs.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1"), "same")
    return settle(join_counted(docs, first, ["d1", "d2"], "copies", docs.count()).where(place > F.col("first")).select("row", F.col("first.doc_id").alias("source")), "later")


def lines(docs: DataFrame) -> DataFrame:
    """Rows (row, doc_id, at, line, h1, h2, words) from rows (row, doc_id, text): the non-blank lines, numbered from 0 (``at``); ``line`` counts blank ones too."""
    split = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(SPACE)).alias("x")))
    full = F.filter(split, lambda s: s["x"] != "")
    rows = docs.select("row", "doc_id", F.posexplode(full).alias("at", "s"))
    return rows.select("row", "doc_id", "at", "s.line", F.xxhash64("s.x").alias("h1"), F.xxhash64(F.lit(1), "s.x").alias("h2"), words_of(F.col("s.x")).alias("words"))


def own() -> Column:
    return F.struct(F.col("doc_id"), F.col("row"), F.col("at"))


def ranked(pairs: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """Names that keep the order of (x, y), for pairs that occur at least twice, with their first occurrence and number (``copies``)."""
    repeated = pairs.groupBy(x, y).agg(F.count("*").alias("copies"), F.min(own()).alias(f"first{name}")).where("copies > 1")
    return settle(repeated.repartitionByRange(x, y).sortWithinPartitions(x, y).withColumn(name, F.monotonically_increasing_id()), "ranks")


def shifted(column: str, by: int) -> Column:
    """The column's value ``by`` lines further on in the same document, null if that line has none."""
    return F.first(column).over(Window.partitionBy("row").orderBy("at").rangeBetween(by, by))


def later_copies(docs: DataFrame, equal: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (row, gone, runs) from rows (row, doc_id, text): the lines of each that are later copies, in order, and its maximal runs.

    Rows in ``equal`` have no part in it.
    """
    table = settle(lines(docs).join(equal, "row", "left_anti"), "lines")
    total = table.count()
    level0 = ranked(table, "h1", "h2", "r0")
    active = join_counted(table, level0, ["h1", "h2"], "copies", total).select("row", "doc_id", "at", "line", "words", "r0", "firstr0")
    top = max(0, words.bit_length() - 1)
    for k in range(top):
        active = settle(active.withColumn("half", shifted(f"r{k}", 1 << k)), "suffixes")
        both = active.where(F.col(f"r{k}").isNotNull() & F.col("half").isNotNull()).withColumnsRenamed({f"r{k}": "x", "half": "y"})
        names = ranked(both, "x", "y", f"r{k + 1}").withColumnsRenamed({"x": f"r{k}", "y": "half"})
        known = join_counted(active.select("row", "at", f"r{k}", "half").where("half is not null"), names, [f"r{k}", "half"], "copies", total).select("row", "at", f"r{k + 1}", f"firstr{k + 1}")
        active = active.drop("half").join(known, ["row", "at"], "left")
    # intervals of depth l: one rank for powers of two, else two overlapping ones
    depth = {n: n.bit_length() - 1 for n in range(1, words + 1)}
    ahead = {f"y{n}": shifted(f"r{k}", n - (1 << k)) for n, k in depth.items() if n != 1 << k}
    held = {f"w{n}": F.sum("words").over(Window.partitionBy("row").orderBy("at").rangeBetween(0, n - 1)) for n in depth}
    active = settle(active.withColumns(ahead | held), "prefixes")
    runs = [F.when((F.col(f"w{n}") >= words) & (F.col(f"firstr{k}") < own()), F.struct(F.lit(n).alias("n"), F.col(f"firstr{k}").alias("first"))) for n, k in depth.items() if n == 1 << k]
    copies = active.select("row", "at", F.explode(F.array_compact(F.array(*runs))).alias("c")).select("row", "at", "c.*")
    other = [F.when((F.col(f"w{n}") >= words) & F.col(f"r{k}").isNotNull() & F.col(f"y{n}").isNotNull(), F.struct(F.lit(n).alias("n"), F.col(f"r{k}").alias("x"), F.col(f"y{n}").alias("y"))) for n, k in depth.items() if n != 1 << k]
    if other:
        pairs = settle(active.select("row", "doc_id", "at", F.explode(F.array_compact(F.array(*other))).alias("p")).select("row", "doc_id", "at", "p.*"), "pairs")
        first = settle(pairs.groupBy("n", "x", "y").agg(F.count("*").alias("copies"), F.min(own()).alias("first")).where("copies > 1"), "firsts")
        copies = copies.unionByName(join_counted(pairs, first, ["n", "x", "y"], "copies", total).where(F.col("first") < own()).select("row", "at", "n", "first"))
    deeper = deepened(active.select("row", "doc_id", "at", F.col(f"r{top}").alias("r")).where("r is not null"), top, total)
    copies = settle(reduce(DataFrame.unionByName, deeper, copies), "copies")
    covered = copies.where(F.col("n") <= words).select("row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("at")).distinct()
    gone = active.select("row", "at", "line").join(covered, ["row", "at"], "left_semi").groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    return gone.join(maximal(copies, active), "row", "left")


def deepened(active: DataFrame, k: int, total: int) -> list[DataFrame]:
    """Doubling from depth 2 ** k, rows (row, doc_id, at, r), until no pair repeats: per depth, rows (row, at, n, first) of its later copies."""
    out = []
    while True:
        both = settle(active.withColumn("y", shifted("r", 1 << k)).where("y is not null").withColumnRenamed("r", "x"), "suffixes")
        names = ranked(both, "x", "y", "r")
        if names.isEmpty():
            return out
        active = settle(join_counted(both, names, ["x", "y"], "copies", total).select("row", "doc_id", "at", "r", "firstr"), "deeper")
        k += 1
        out.append(active.where(F.col("firstr") < own()).select("row", "at", F.lit(1 << k).alias("n"), F.col("firstr").alias("first")))
        active = active.drop("firstr")


def maximal(copies: DataFrame, active: DataFrame) -> DataFrame:
    """Rows (row, runs) of copies (row, at, n, first): the maximal runs in order, each (line, lines, doc_id of its first occurrence)."""
    step = Window.partitionBy("row", "n", "first.row", F.col("at") - F.col("first.at")).orderBy("at")
    chained = copies.withColumn("chain", F.col("at") - F.row_number().over(step)).groupBy("row", "n", F.col("first.row").alias("source"), (F.col("at") - F.col("first.at")).alias("shift"), "chain")
    found = chained.agg(F.min("at").alias("at"), (F.count("*") - 1 + F.col("n")).cast("int").alias("lines"), F.first("first.doc_id").alias("doc_id"))
    # a run is within another if one that starts no later ends no earlier
    order = Window.partitionBy("row").orderBy("at", F.desc("lines"), F.desc("n"), "source", "shift")
    reach = F.max(F.col("at") + F.col("lines")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    outer = found.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("at") + F.col("lines") > F.col("reach")))
    placed = outer.join(active.select("row", "at", "line"), ["row", "at"])
    return placed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("line", "lines", "doc_id"))).alias("runs"))


def dedup_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents with their later copies of repeated line runs deleted, plus ``n_lines``, ``gone`` (line numbers from 0) and ``runs``."""
    rows = numbered(docs)
    place = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    key = F.col(place["doc_id"])
    equal = equal_documents(rows.select("row", key.alias("doc_id"), "d1", "d2").where(F.col(place["text"]).isNotNull()))
    found = later_copies(rows.select("row", key.alias("doc_id"), F.col(place["text"]).alias("text")), equal.select("row"), words)
    found = found.withColumns({"equal": F.lit(False), "source": F.lit(None).cast(equal.schema["source"].dataType)}).unionByName(equal.withColumn("equal", F.lit(True)), allowMissingColumns=True)
    # hashing the few lines of each partition spares sorting whole texts
    joined = rows.join(found.hint("shuffle_hash"), "row", "left")
    split = F.split(place["text"], "\n")
    full = F.filter(F.transform(split, lambda x, i: F.when(F.btrim(x, F.lit(SPACE)) != "", i)), lambda i: i.isNotNull())
    enough = F.size(F.filter(F.split(place["text"], r"\s+"), lambda w: w != "")) >= words
    joined = joined.withColumn("gone", F.when(F.col("equal"), F.when(enough, full)).otherwise(F.col("gone")))
    none = F.array().cast(found.schema["runs"].dataType)
    whole = F.when(F.col("gone").isNotNull(), F.array(F.struct(F.get("gone", F.lit(0)).alias("line"), F.size("gone").alias("lines"), F.col("source").alias("doc_id"))))
    joined = joined.withColumn("runs", F.when(F.col("equal"), whole).otherwise(F.col("runs")))
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "gone")
    kept = F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col(place["text"])).otherwise(kept)
    columns = [(text if c == "text" else F.col(own)).alias(c) for c, own in place.items() if c not in ("n_lines", "gone", "runs")]
    breaks = F.length(place["text"]) - F.length(F.replace(F.col(place["text"]), F.lit("\n"), F.lit("")))
    return joined.select(*columns, F.coalesce(breaks + 1, F.lit(0)).alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), F.coalesce("runs", none).alias("runs"))
