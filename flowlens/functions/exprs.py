"""General column expressions: cleaning, maps and ratios."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def snake(name: str) -> str:
    """``Flow Bytes/s`` -> ``flow_bytes_per_s``."""
    return "_".join(re.findall("[0-9a-z]+", name.replace("/", " per ").lower()))


def snake_expr(c: Column) -> Column:
    """The same rule on a string column."""
    spaced = F.lower(F.replace(F.trim(c), F.lit("/"), F.lit(" per ")))
    return F.regexp_replace(F.regexp_replace(spaced, "[^0-9a-z]+", "_"), "^_+|_+$", "")


def finite(c: Column) -> Column:
    """NaN and infinities become null; nothing is imputed."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(math.inf)), d)


def repair_epoch_us(c: Column) -> Column:
    """Seconds glued to microseconds whose leading zeros were lost -> epoch microseconds."""
    digits = F.length(F.greatest(c, F.lit(1)).cast("string"))
    power = F.pow(F.lit(10.0), F.greatest(digits - 10, F.lit(0))).cast("bigint")
    return F.floor(c / power).cast("bigint") * F.lit(1_000_000) + c % power


def literal_map(values: Mapping[str, object]) -> Column:
    """A small fixed mapping as a map literal."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def lookup(c: Column, values: Mapping[str, object], default: Column | None = None) -> Column:
    """Value of ``c`` in a fixed mapping, else ``default`` (null)."""
    found = F.try_element_at(literal_map(values), F.coalesce(c, F.lit("")))
    return found if default is None else F.coalesce(found, default)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def fixed(x: Column, decimals: int) -> Column:
    """Fixed-point text without thousands commas; ties follow the exact binary value."""
    return F.replace(F.format_number(x, decimals), F.lit(","), F.lit(""))


def failed(rules: Iterable[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in order; each rule is (name, broken-condition)."""
    checks = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules])
    return F.filter(checks, lambda x: x.isNotNull())


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of ``k`` out of ``n``; (0, 1) when n is 0."""
    kd, nd = k.cast("double"), n.cast("double")
    safe = F.when(nd > 0, nd)
    p = kd / safe
    scale = 1 + (z * z) / safe
    centre = (p + (z * z) / (2 * safe)) / scale
    half = F.lit(z) * F.sqrt(p * (1 - p) / safe + (z * z) / (4 * safe * safe)) / scale
    low = F.when(nd > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0))
    high = F.when(nd > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(1.0))
    return low, high


def is_attack_truth(c: Column) -> Column:
    """Ground-truth text that counts as an attack (outliers are neither)."""
    return ~F.lower(F.coalesce(c, F.lit("unknown"))).isin("benign", "unknown", "", "outlier")


def is_outlier_truth(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("unknown"))) == "outlier"
