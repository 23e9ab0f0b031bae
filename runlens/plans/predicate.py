"""The run filter language: comparisons joined by and, or, not and parentheses, as a Spark column.

Logic has two values: a comparison with a missing field is false, also ``!=``, so ``not`` of it is true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.fmt import float_text, float_text_udf
from runlens.operators.catalog import finite

NUMBER = re.compile(r"[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$", re.I)
TOKEN = re.compile(r"[ \t]*(?:(==|!=|>=|<=|>|<|~|\(|\))|'([^']*)'|\"([^\"]*)\"|([\w/.+-]+)|(.))")
TEXTS = ("run", "name", "status")
OPERATORS = frozenset(("==", "!=", ">", ">=", "<", "<=", "~"))


@dataclass
class Token:
    kind: str
    value: str


@dataclass
class Comparison:
    field: str
    op: str
    kind: str
    value: object


@dataclass
class Node:
    op: str
    parts: list


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    text = text.rstrip(" \t")
    while at < len(text):
        m = TOKEN.match(text, at)
        at = m.end()
        if m[1]:
            out.append(Token("op", m[1]))
        elif m[2] is not None or m[3] is not None:
            out.append(Token("text", m[2] if m[2] is not None else m[3]))
        elif m[4]:
            out.append(Token("keyword" if m[4] in ("and", "or", "not") else "number" if NUMBER.match(m[4]) else "word", m[4]))
        else:
            raise ValueError({"=": "use `==`", "!": "use `!=` or `not`", "'": "a string is not closed", '"': "a string is not closed"}.get(m[5], f"unexpected character {m[5]!r}"))
    return out


def parse(text: str) -> Comparison | Node:
    """The syntax tree; ValueError says what is wrong."""
    left = tokens(text)

    def take(kind: str | None = None, value: str | None = None) -> Token | None:
        if left and (kind is None or left[0].kind == kind) and (value is None or left[0].value == value):
            return left.pop(0)
        return None

    def chain(word: str, below):
        parts = [below()]
        while take("keyword", word):
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(word, parts)

    def unary():
        if take("keyword", "not"):
            return Node("not", [unary()])
        if take("op", "("):
            inner = either()
            if not take("op", ")"):
                raise ValueError("`)` is missing")
            return inner
        name = take("word") or take("text")
        if name is None:
            raise ValueError("a field name is missing")
        op = take("op")
        if op is None or op.value not in OPERATORS:
            raise ValueError(f"an operator is missing after {name.value}")
        value = take("number") or take("text") or take("word")
        if value is None:
            raise ValueError(f"a value is missing after {op.value}")
        if value.kind == "number":
            return Comparison(name.value, op.value, "number", float(value.value))
        if value.kind == "word" and value.value in ("true", "false"):
            return Comparison(name.value, op.value, "bool", value.value == "true")
        return Comparison(name.value, op.value, "text", value.value)

    def both():
        return chain("and", unary)

    def either():
        return chain("or", both)

    tree = either()
    if left:
        raise ValueError(f"unexpected {left[0].value!r}")
    return tree


def fields(tree: Comparison | Node) -> list[str]:
    return [tree.field] if isinstance(tree, Comparison) else list(dict.fromkeys(f for p in tree.parts for f in fields(p)))


def value_of(num: Column | None = None, text: Column | None = None, flag: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct((num if num is not None else none).cast("double").alias("num"), (text if text is not None else none).cast("string").alias("str"), (flag if flag is not None else none).cast("boolean").alias("bool"))


def resolve(runs: DataFrame, hparams: DataFrame, series: DataFrame, names: list[str]) -> DataFrame:
    """``runs`` with a column ``field_k`` (num, str, bool; null where missing) for each name.

    In order: run or name, status, a hyperparameter, the series of that tag, the only series that ends in /name. However
    many names there are, hyperparameters and series are read, aggregated by run and joined once.
    """
    named = {k: name for k, name in enumerate(names) if name not in TEXTS}
    out = runs
    if named:
        last, tag = finite(F.col("last.value")), F.col("tag")
        sought, exact, ending = [], [], []
        for k, name in named.items():
            value, is_tag, ends = value_of(F.col("num"), F.col("str"), F.col("bool")), tag == name, tag.endswith("/" + name)
            sought.append(F.first(F.when(F.col("key") == name, value), ignorenulls=True).alias(f"h{k}"))
            exact += [F.max(F.when(is_tag, True)).alias(f"is_tag{k}"), F.max(F.when(is_tag, last)).alias(f"exact{k}")]
            ending.append(F.when(F.count(F.when(ends, 1)) == 1, F.max(F.when(ends, last))).alias(f"ending{k}"))
        fits = reduce(lambda a, b: a | b, ((tag == name) | tag.endswith("/" + name) for name in named.values()))
        out = out.join(hparams.where(F.col("key").isin(*named.values())).groupBy("run").agg(*sought), "run", "left")
        out = out.join(series.where(fits).groupBy("run").agg(*exact, *ending), "run", "left")
    made = {}
    for k, name in enumerate(names):
        if k in named:
            number = F.when(F.col(f"is_tag{k}"), F.col(f"exact{k}")).otherwise(F.col(f"ending{k}"))
            made[f"field_{k}"] = F.when(F.col(f"h{k}").isNotNull(), F.col(f"h{k}")).when(number.isNotNull(), value_of(number))
        else:
            made[f"field_{k}"] = value_of(text=F.col("status" if name == "status" else "run"))
    return out.select(*runs.columns, *(c.alias(n) for n, c in made.items()))


def text_of(c: Comparison, field: Column) -> Column:
    """The field as text; only fields that may be numbers need the Python function."""
    if c.field in TEXTS:
        return field["str"]
    return F.coalesce(field["str"], F.when(field["bool"].isNotNull(), field["bool"].cast("string")), float_text_udf(field["num"]))


def compare(c: Comparison, field: Column) -> Column:
    literal = float_text(c.value) if c.kind == "number" else str(c.value).lower() if c.kind == "bool" else c.value
    if c.op == "~":
        return F.coalesce(text_of(c, field).contains(literal), F.lit(False))
    if c.op in ("==", "!="):
        if c.kind == "number":
            same = F.when(field["num"].isNotNull(), (field["num"] == c.value) & ~F.isnan(field["num"]) & F.lit(c.value == c.value)).otherwise(text_of(c, field) == literal)
        elif c.kind == "bool":
            same = F.when(field["bool"].isNotNull(), field["bool"] == c.value).otherwise(text_of(c, field) == literal)
        else:
            same = text_of(c, field) == literal
        return F.coalesce(same if c.op == "==" else ~same, F.lit(False))
    if c.kind != "number" or c.value != c.value:
        return F.lit(False)
    n = field["num"]
    order = {">": n > c.value, ">=": n >= c.value, "<": n < c.value, "<=": n <= c.value}[c.op]
    return F.coalesce(order & ~F.isnan(n), F.lit(False))


def condition(tree: Comparison | Node, names: list[str]) -> Column:
    if isinstance(tree, Comparison):
        return compare(tree, F.col(f"field_{names.index(tree.field)}"))
    parts = [condition(p, names) for p in tree.parts]
    if tree.op == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if tree.op == "and" else out | p
    return out


def filter_runs(runs: DataFrame, hparams: DataFrame, series: DataFrame, text: str) -> DataFrame:
    """The runs that pass; a text that does not parse is looked for in the run's name."""
    try:
        tree = parse(text)
    except ValueError:
        return runs.where(F.col("run").contains(text))
    names = fields(tree)
    return resolve(runs, hparams, series, names).where(condition(tree, names)).select(runs.columns)
