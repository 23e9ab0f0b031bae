"""Language ID of web pages by Bayesian evidence fusion.

Four kinds of evidence are fused as a product: the likelihood of the page's visible text under byte-pair models (trained
from a bounded sample of documents with a known language, tempered because neighbouring pairs are not independent); the
language that the markup declares; the address suffix, with the language code that begins the path, if any; and the
host's prior, smoothed from corpus to suffix to registered domain to host. How far declarations and addresses can be
trusted, and the priors, are learned by grouped aggregation from the text's own soft labels over all pages.

Defined results: a null or empty html has no text evidence, a missing declaration and a null url are values like any
other. Repeated rows stay repeated. Without training documents there are no languages and lang is null. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import settle, text_blocks
from runlens.llm.html_text import ATTRIBUTE, NAME, REST
from runlens.llm.url_reputation import domain_of, host_of, path_of, suffix_of

#: Training documents of a language (twice as many at most, but for luck), languages at most (the commonest), pseudo-count of a byte pair, most nats per byte pair kept of the text's evidence, strength of a prior in pages, pseudo-pages of an evidence table.
SAMPLE, LANGUAGES, PSEUDO, TEMPER, STRENGTH, SMOOTH = 1000, 200, 0.05, 0.1, 10.0, 1.0
#: Bytes after which a text's evidence grows as the square root.
FULL = 200
#: What is no text, by how it begins, and how it ends.
HIDDEN = {"script": re.compile(r"</script(?=[\s/>])", re.I), "style": re.compile(r"</style(?=[\s/>])", re.I), "head": re.compile(r"</head(?=[\s/>])|<body(?=[\s/>])", re.I)}
CODE = re.compile(r"[a-z]{2,3}(?![a-z])", re.I)


def read(page: str) -> tuple[str, str]:
    """The language that the first html tag declares (``lang``, else ``xml:lang``), and the page's text; in linear time.

    Comments declare nothing and hold no text; a script, style or head that never ends hides nothing.
    """
    declared, text, at, last, missing = None, [], 0, page.rfind(">"), set()
    while True:
        found = page.find("<", at)
        if found < 0 or found > last:
            text.append(page[at:])
            return declared or "", "".join(text)
        text.append(page[at:found])
        if page.startswith("<!--", found):
            end = page.find("-->", found + 4)
            at = len(page) if end < 0 else end + 3
            text.append(" ")
            continue
        end = page.find(">", found)
        name = NAME.match(page, found + 1)
        at = end + 1 if name or page[found + 1] in "!?" else found + 1
        text.append(" " if at == end + 1 else "<")
        tag = name[0].lower() if name else ""
        if tag == "html" and declared is None:
            rest = REST.match(page, name.end())
            own = {n.lower(): (a or b or c) for n, a, b, c in reversed(ATTRIBUTE.findall(rest[0][:-1] if rest else page[name.end() : end]))}
            code = CODE.match((own.get("lang") or own.get("xml:lang") or "").strip())
            declared, at = code[0].lower() if code else "", rest.end() if rest else at
        elif tag in HIDDEN and tag not in missing:
            close = HIDDEN[tag].search(page, at)
            if close is None:
                missing.add(tag)
            else:
                at = close.start()


def pair_counts(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode(), np.uint8).astype(np.int32)
    return np.bincount(data[:-1] * 256 + data[1:], minlength=1 << 16) if len(data) > 1 else np.zeros(1 << 16, np.int64)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of each byte pair in each of them, from the documents of each language whose hashes of doc_id are smallest.

    Hashes are compared with a bound per language, one in as many as the language has documents too many, so no order is needed.
    """
    known = docs.where("lang is not null and doc_id is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    one_in = F.broadcast(sizes.select("lang", F.greatest(F.floor(F.col("n") / sample), F.lit(1)).alias("one_in")))  # at most LANGUAGES rows

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for block in text_blocks(batches, "text"):
            for lang, text in zip(block.column("lang").to_pylist(), block.column("text").to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + pair_counts(text or "")
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "pair", "n"])

    rows = known.join(one_in, "lang").where(F.pmod(F.xxhash64("doc_id"), F.col("one_in")) == 0).select("lang", "text").mapInArrow(run, "lang string, pair int, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in rows})
    counts = np.full((len(langs), 1 << 16), PSEUDO)
    for r in rows:
        counts[langs.index(r.lang), r.pair] += r.n
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def evidence(pages: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """Rows (page_id, host, address, declared, likelihood): log-likelihoods of the text, relative to the best language."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # 256 KB a language

    def run(batches):
        for block in text_blocks(batches, "html"):
            declared, scores = [], []
            for page in block.column("html").to_pylist():
                page = page or ""
                language, text = read(page)
                declared.append(language)
                counts = pair_counts(" ".join(text.split()))
                at = np.flatnonzero(counts)
                n = counts[at].sum()
                own = sent.value[:, at] @ counts[at] if n else np.zeros(len(langs))
                own = own * TEMPER * min(1.0, np.sqrt(FULL / n) if n else 0)
                scores.append((own - own.max() if len(own) else own).astype(float).tolist())
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in ("page_id", "host", "address")), pa.array(declared), pa.array(scores, pa.list_(pa.float64()))], names=["page_id", "host", "address", "declared", "likelihood"])

    host, path = host_of(F.col("url")), path_of(F.col("url"))
    code = F.regexp_extract(path, r"^/([a-z]{2})(?:/|$)", 1)
    rows = pages.select("page_id", host.alias("host"), F.concat_ws(":", suffix_of(host), code).alias("address"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, host string, address string, declared string, likelihood array<double>")


def softmax(logs: list) -> list:
    top = reduce(lambda a, b: F.greatest(a, b), logs) if len(logs) > 1 else logs[0]
    parts = [F.exp(x - top) for x in logs]
    total = reduce(add, parts)
    return [p / total for p in parts]


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, host, declared, address, lang, probability, text_lang (by text alone)."""
    langs, model = train(docs)
    own = settle(evidence(pages, langs, model), "evidence")
    if not langs:
        none = F.lit(None).cast("string")
        return own.select("page_id", "host", "declared", "address", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"))
    n = range(len(langs))
    likely = [F.get("likelihood", F.lit(k)) for k in n]
    soft = own.select("host", "address", "declared", *(p.alias(f"p{k}") for k, p in zip(n, softmax(likely), strict=True)))
    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in n]
    hosts = soft.groupBy("host").agg(*sums, F.count("*").alias("n"))
    hosts = settle(hosts.withColumns({"suffix": suffix_of(F.col("host")), "domain": domain_of(F.col("host"))}), "hosts")
    total = hosts.agg(*sums, F.sum("n").alias("n")).first()
    prior = [((total[k] or 0) + 1) / ((total["n"] or 0) + len(langs)) for k in n]

    def smoothed(rows: DataFrame, key: str, up: str) -> DataFrame:
        """Shares by ``key``, shrunk towards columns ``up``0, 1, ..."""
        return rows.select(key, *((F.col(f"p{k}") + STRENGTH * F.col(f"{up}{k}")).__truediv__(F.col("n") + STRENGTH).alias(f"{key[0]}{k}") for k in n))

    both = [*sums, F.sum("n").alias("n")]
    suffixes = smoothed(hosts.groupBy("suffix").agg(*both).withColumns({f"c{k}": F.lit(prior[k]) for k in n}), "suffix", "c")
    domains = smoothed(hosts.groupBy("suffix", "domain").agg(*both).join(suffixes, "suffix"), "domain", "s")
    priors = smoothed(hosts.select("host", "domain", "n", *(f"p{k}" for k in n)).join(domains, "domain"), "host", "d")

    def trusted(key: str) -> DataFrame:
        """log P(value | language) of an evidence column."""
        table = soft.groupBy(key).agg(*sums, F.count("*").alias("n"))
        size = max(1, total["n"] or 0)
        return table.select(key, *(F.log((F.col(f"p{k}") + SMOOTH * F.col("n") / size) / ((total[k] or 0) + SMOOTH)).alias(f"{key[0]}e{k}") for k in n))

    fused = own.join(priors, "host").join(trusted("declared"), "declared").join(trusted("address"), "address")
    posterior = F.array(*softmax([F.log(f"h{k}") + likely[k] + F.col(f"de{k}") + F.col(f"ae{k}") for k in n]))
    best = F.array_max("p")
    names = F.array(*map(F.lit, langs))
    text_best = F.get(names, (F.array_position("likelihood", F.array_max("likelihood")) - 1).cast("int"))
    return fused.withColumn("p", posterior).select("page_id", "host", "declared", "address", F.get(names, (F.array_position("p", best) - 1).cast("int")).alias("lang"), F.round(best, 6).alias("probability"), text_best.alias("text_lang"))
