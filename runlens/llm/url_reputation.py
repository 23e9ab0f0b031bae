"""URL filter with DataFrame functions only: fixed rules first, then empirical-Bayes host reputation.

Outcomes are those of the pages themselves: a page whose text is that of a labelled document (letters and digits of the
article, without and with its heading) is as good or bad as that document. Outcomes are counted by host, registered
domain and public suffix. Each level is shrunk towards the one above by a beta-binomial prior: the corpus gives the
prior of a suffix, a suffix that of its domains, a domain that of its hosts. Mean and strength of the priors both come
from the data: the strength of a level is the one under which its counts would vary as much as they do (moments of the
one-way analysis of variance). A page is blocked if its host's bad rate lies above ``LIMIT`` with a posterior
probability of at least ``SURE``, summed from the beta density on a grid, so a host needs evidence, not a few bad pages.

Defined results: a null url, or one without ``://``, has empty host and path and is judged by the corpus prior. A host
without outcomes gets its domain's posterior, and so on up. Repeated rows are judged alike and stay repeated, and each
counts. Of copies of a labelled text, one bad label makes it bad. With no outcomes at all nothing is blocked by the
method. Extra columns are ignored. Public suffixes are the last label of a host, or its last two where ``SUFFIXES``
lists them; the full public list has thousands of entries and would be a parameter of the same form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules, (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
# Public suffixes of two labels; any other suffix is the last label.
SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.au", "org.uk")
#: A prior's strength in pages: at least, at most, and where a level has too few groups to tell; the corpus's own prior.
WEAKEST, STRONGEST, UNKNOWN, BASE = 2.0, 1000.0, 20.0, (1.0, 9.0)
#: Bad rate above which a host is blocked, how probable that must be, and cells of the grid.
LIMIT, SURE, GRID = 0.5, 0.95, 512


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Suffix and one more label."""
    return F.when(F.substring_index(host, ".", -2).isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a parent of it and begins the path: (rule, verdict), or null."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in reversed(longest):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def letters(text: Column) -> Column:
    """What identifies a text: its letters and digits."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def said(html: Column, heading: bool) -> Column:
    """letters() of the first article, else of the whole page; every pattern runs in linear time."""
    inner = F.when(F.contains(html, F.lit("<article")), F.substring_index(F.concat(F.lit("<article"), F.expr("substring(html, locate('<article', html) + 8)")), "</article>", 1)).otherwise(html)
    if not heading:
        inner = F.regexp_replace(inner, "<h1[^<>]*>[^<]*</h1>", "")
    return letters(F.regexp_replace(F.regexp_replace(inner, "<[^<>]*>", " "), "&[#A-Za-z0-9]+;", ""))


def outcomes(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (host, n, bad) of every host: how many of its pages hold the text of a labelled document, and how many of a bad one."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("bad"))
    known = documents.where("doc_id is not null").select("doc_id", letters(F.col("text")).alias("x")).where("x <> ''").select("doc_id", F.xxhash64("x").alias("key"))
    known = known.join(marks, "doc_id").groupBy("key").agg(F.max("bad").alias("bad"))
    own = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.select("host", F.xxhash64(said(F.col("html"), False)).alias("a"), F.xxhash64(said(F.col("html"), True)).alias("b"))
    counted = own.groupBy("host", "a", "b").agg(F.count("*").alias("pages"))  # copies of one text are one row
    found = counted.join(known.toDF("a", "bad_a"), "a", "left").join(known.toDF("b", "bad_b"), "b", "left").withColumn("is_bad", F.coalesce("bad_a", "bad_b"))
    return found.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("is_bad").isNotNull(), F.col("pages"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("is_bad") * F.col("pages")), F.lit(0)).alias("bad"))


def strength(groups: str, above: str) -> Column:
    """Strength of the prior of a level from the sums of its groups (``k`` of them, ``a`` the sum of bad² / n) and of those above (also ``q``: n - the groups' evenness)."""
    free = F.col(f"k_{groups}") - F.col(f"k_{above}")
    between = (F.col(f"a_{groups}") - F.col(f"a_{above}")) / free
    size = (F.col("n") - F.col(f"q_{above}")) / free
    within = (F.col("bad") - F.col(f"a_{groups}")) / (F.col("n") - F.col(f"k_{groups}"))
    share = (between - within) / (between + (size - 1) * within)
    known = (free > 0) & (F.col("n") > F.col(f"k_{groups}")) & (between + (size - 1) * within > 0)
    return F.when(known, F.when(share > 0, F.least(F.greatest((1 - share) / share, F.lit(WEAKEST)), F.lit(STRONGEST))).otherwise(STRONGEST)).otherwise(UNKNOWN)


def spread(rows: DataFrame, key: str, n: str, bad: str, inner: str | None) -> DataFrame:
    """One row: number of groups with outcomes, sum of bad² / n, and sum of (sum of the inner groups' n²) / n."""
    own = rows.where(F.col(n) > 0)
    aims = [F.count("*").alias(f"k_{key}"), F.coalesce(F.sum(F.col(bad) * F.col(bad) / F.col(n)), F.lit(0.0)).alias(f"a_{key}")]
    return own.agg(*aims, F.coalesce(F.sum(F.col(inner) / F.col(n)), F.lit(0.0)).alias(f"q_{key}")) if inner else own.agg(*aims)


def tail(a: Column, b: Column, limit: float) -> Column:
    """Probability that a rate with posterior Beta(a, b) lies above ``limit``: the density over even steps of asin(sqrt(rate))."""
    x, y, step = 2 * a - 1, 2 * b - 1, math.pi / 2 / GRID
    top = F.when((x > 0) & (y > 0), (x * F.log(x / (x + y)) + y * F.log(y / (x + y))) / 2).otherwise(0.0)  # keeps exp() in range

    def total(first: int) -> Column:
        def weight(k: Column) -> Column:
            angle = (k + 0.5) * F.lit(step)
            return F.exp(x * F.log(F.sin(angle)) + y * F.log(F.cos(angle)) - top)

        return F.aggregate(F.sequence(F.lit(first), F.lit(GRID - 1)), F.lit(0.0), lambda s, k: s + weight(k))

    return total(first_cell(limit)) / total(0)


def first_cell(limit: float) -> int:
    """The first cell of the grid whose middle lies above ``limit``."""
    return math.ceil(math.asin(math.sqrt(limit)) / (math.pi / 2 / GRID) - 0.5)


def reputation(counts: DataFrame, limit: float = LIMIT, base: tuple[float, float] = BASE) -> DataFrame:
    """Rows (host, bad_rate, bad_tail) for every host of counts (host, n, bad): posterior mean, and probability of a rate above ``limit``."""
    hosts = counts.withColumns({"suffix": suffix_of(F.col("host")), "domain": domain_of(F.col("host")), "n2": F.col("n") * F.col("n")})
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"), F.sum("n2").alias("hn2")).withColumn("dn2", F.col("dn") * F.col("dn"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"), F.sum("dn2").alias("dn2")).withColumn("sn2", F.col("sn") * F.col("sn"))
    corpus = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("n"), F.coalesce(F.sum("sb"), F.lit(0)).alias("bad"), F.sum("sn2").alias("sn2"))
    corpus = corpus.withColumns({"k_corpus": F.when(F.col("n") > 0, 1).otherwise(0), "a_corpus": F.when(F.col("n") > 0, F.col("bad") * F.col("bad") / F.col("n")).otherwise(0.0), "q_corpus": F.when(F.col("n") > 0, F.col("sn2") / F.col("n")).otherwise(0.0)})
    sums = [spread(hosts, "host", "n", "bad", None), spread(domains, "domain", "dn", "db", "hn2"), spread(suffixes, "suffix", "sn", "sb", "dn2")]
    for one in sums:
        corpus = corpus.crossJoin(F.broadcast(one))  # each is one row
    rate = (F.col("bad") + base[0]) / (F.col("n") + base[0] + base[1])
    priors = F.broadcast(corpus.select(rate.alias("rate"), strength("host", "domain").alias("hs"), strength("domain", "suffix").alias("ds"), strength("suffix", "corpus").alias("ss")))
    suffixes = suffixes.crossJoin(priors).select("suffix", ((F.col("sb") + F.col("ss") * F.col("rate")) / (F.col("sn") + F.col("ss"))).alias("s_rate"), "hs", "ds")
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("db") + F.col("ds") * F.col("s_rate")) / (F.col("dn") + F.col("ds"))).alias("d_rate"), "hs")
    a, b = F.col("bad") + F.col("hs") * F.col("d_rate"), F.col("n") - F.col("bad") + F.col("hs") * (1 - F.col("d_rate"))
    return hosts.join(domains, "domain").select("host", "n", a.alias("a"), b.alias("b")).select("host", F.col("n").alias("outcomes"), (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"), tail(F.col("a"), F.col("b"), limit).alias("bad_tail"))


def judge(pages: DataFrame, counts: DataFrame, rules=RULES, limit: float = LIMIT, sure: float = SURE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_rate, outcomes; ``counts`` are rows (host, n, bad) of every host, as outcomes() gives them."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = urls.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).join(reputation(counts, limit), "host")
    own = F.when(F.col("bad_tail") >= sure, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"), F.col("outcomes").cast("long").alias("outcomes"))


def oracle() -> str:
    """The same judgement as DuckDB SQL."""
    two = ", ".join(f"'{s}'" for s in SUFFIXES)
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, v) for h, p, v in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + f" WHEN bad_tail >= {SURE} THEN 'block' ELSE 'allow' END"
    last = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
    plain = lambda x: f"regexp_replace({x}, '[^\\pL\\pN]+', '', 'g')"
    bare = lambda x: plain(f"regexp_replace(regexp_replace({x}, '<[^<>]*>', ' ', 'g'), '&[#A-Za-z0-9]+;', '', 'g')")
    inner = "CASE WHEN contains(h, '<article') THEN split_part(substr(h, strpos(h, '<article')), '</article>', 1) ELSE h END"

    def strong(g: str, up: str) -> str:
        free, between = f"(k_{g} - k_{up})", f"((a_{g} - a_{up}) / (k_{g} - k_{up}))"
        within = f"((y - a_{g}) / (n - k_{g}))"
        below = f"({between} + ((n - q_{up}) / {free} - 1) * {within})"
        share = f"(({between} - {within}) / {below})"
        return f"CASE WHEN {free} > 0 AND n > k_{g} AND {below} > 0 THEN CASE WHEN {share} > 0 THEN least(greatest((1 - {share}) / {share}, {WEAKEST}), {STRONGEST}) ELSE {STRONGEST} END ELSE {UNKNOWN} END"

    x, y, angle = "(2 * a - 1)", "(2 * b - 1)", f"((k + 0.5) * pi() / 2 / {GRID})"
    top = f"CASE WHEN {x} > 0 AND {y} > 0 THEN ({x} * ln({x} / ({x} + {y})) + {y} * ln({y} / ({x} + {y}))) / 2 ELSE 0 END"
    total = lambda first: f"list_sum([exp({x} * ln(sin({angle})) + {y} * ln(cos({angle})) - top) FOR k IN range({first}, {GRID})])"
    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(html, '') AS h FROM pages),
m AS (SELECT doc_id, max(1 - quality) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
k AS (SELECT {plain("text")} AS x, max(bad) AS bad FROM documents JOIN m USING (doc_id) GROUP BY 1 HAVING x <> ''),
w AS (SELECT host, {inner} AS i FROM u),
o AS (SELECT host, coalesce(p.bad, q.bad) AS bad FROM w LEFT JOIN k p ON p.x = {bare("regexp_replace(i, '<h1[^<>]*>[^<]*</h1>', '', 'g')")} LEFT JOIN k q ON q.x = {bare("i")}),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
  CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix,
  CASE WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain FROM o GROUP BY host),
d AS (SELECT suffix, domain, sum(n) AS dn, sum(bad) AS db, sum(n * n) AS hn2 FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(dn) AS sn, sum(db) AS sb, sum(dn * dn) AS dn2 FROM d GROUP BY ALL),
c AS (SELECT coalesce(sum(sn), 0) AS n, coalesce(sum(sb), 0) AS y, CASE WHEN n > 0 THEN 1 ELSE 0 END AS k_corpus, CASE WHEN n > 0 THEN y * y / n ELSE 0 END AS a_corpus, CASE WHEN n > 0 THEN sum(sn * sn) / n ELSE 0 END AS q_corpus,
  (SELECT count(*) FROM h WHERE n > 0) AS k_host, (SELECT coalesce(sum(bad * bad / n), 0) FROM h WHERE n > 0) AS a_host,
  (SELECT count(*) FROM d WHERE dn > 0) AS k_domain, (SELECT coalesce(sum(db * db / dn), 0) FROM d WHERE dn > 0) AS a_domain, (SELECT coalesce(sum(hn2 / dn), 0) FROM d WHERE dn > 0) AS q_domain,
  (SELECT count(*) FROM s WHERE sn > 0) AS k_suffix, (SELECT coalesce(sum(sb * sb / sn), 0) FROM s WHERE sn > 0) AS a_suffix, (SELECT coalesce(sum(dn2 / sn), 0) FROM s WHERE sn > 0) AS q_suffix FROM s),
z AS (SELECT (y + {BASE[0]}) / (n + {sum(BASE)}) AS rate, {strong("host", "domain")} AS hs, {strong("domain", "suffix")} AS ds, {strong("suffix", "corpus")} AS ss FROM c),
sr AS (SELECT suffix, (sb + ss * rate) / (sn + ss) AS s_rate FROM s, z),
dr AS (SELECT domain, (db + ds * s_rate) / (dn + ds) AS d_rate FROM d JOIN sr USING (suffix), z),
p AS (SELECT host, n AS outcomes, CAST(bad + hs * d_rate AS DOUBLE) AS a, CAST(n - bad + hs * (1 - d_rate) AS DOUBLE) AS b FROM h JOIN dr USING (domain), z),
g AS (SELECT *, {top} AS top FROM p),
t AS (SELECT host, outcomes, a / (a + b) AS bad_rate, {total(first_cell(LIMIT))} / {total(0)} AS bad_tail FROM g)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, round(bad_rate, 6) AS bad_rate, CAST(outcomes AS BIGINT) AS outcomes FROM u JOIN t USING (host)
"""
