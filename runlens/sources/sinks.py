"""Result tables as CSV, JSON lines and aligned text."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions.fmt import float_text, float_text_udf


def csv_text(df: DataFrame) -> DataFrame:
    """All columns as text, doubles in their shortest form, ready for df.write.csv with header and quotes where needed."""
    return df.select(*(float_text_udf(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).cast("string").alias(f.name) for f in df.schema))


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON text a row; null where a value is missing or not finite."""
    finite = [F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*finite), {"ignoreNullFields": "false"}).alias("value"))


def render(rows: list[list], header: list[str]) -> str:
    """Aligned text of a small result: two blanks between columns, numbers to the right, no blanks at line ends."""
    cells = [["" if v is None else float_text(v) if isinstance(v, float) else str(v) for v in r] for r in rows]
    width = [max(map(len, c)) for c in zip(header, *cells, strict=True)]
    held = [[r[k] for r in rows if r[k] is not None and r[k] != ""] for k in range(len(header))]
    right = [bool(c) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in c) for c in held]
    return "\n".join("  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(line, width, right, strict=True)).rstrip() for line in [header, *cells])


def json_text(value: object) -> str:
    return "null" if isinstance(value, float) and not math.isfinite(value) else json.dumps(value, ensure_ascii=False)
