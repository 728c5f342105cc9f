"""Secrets in texts: key patterns, and strings whose characters look random; DataFrame functions only.

Three base kinds come from patterns. Beyond them, every candidate string (a run of key characters with
letters and digits) is read through a sliding window. The window's Shannon entropy is kept up by counts:
when a character enters or leaves, only its own count changes, so the sum of c * log2(c) moves by the
difference of two terms. A candidate whose best window passes the limit of its character class is
reported unless the allow-list names it or a base span already covers it.

Positions are code points, ends exclusive. Matches of a pattern and the gaps between them are taken apart
with the same leftmost scan, so their lengths add up to the positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their order in results.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are always taken whole, so a shorter run can be passed over in the pattern
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Character classes in the order tried: the string must match the pattern, its best window must reach the limit in bits.
CLASSES = (
    ("hex", r"^[0-9a-fA-F-]+$", 3.0),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.6),
)
#: Strings that look random and are no secrets: plain numbers, words joined by signs, dates, UUIDs, digests named as such.
ALLOWED = (
    r"^[0-9_=+/-]+$",
    r"^[A-Za-z_=+/-]+$",
    r"^([A-Za-z]+[_/=+-])*[A-Za-z]*[0-9]{1,4}$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(sha(1|256|384|512)|md5)[-=]",
)
WINDOW = 20


def _located(text: Column, pattern: str, group: int | None = None) -> Column:
    """All leftmost matches as ``struct(start, end, found, part)``; part is the group's text."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    part = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1 if group is None else group + 1))
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(whole.alias("found"), part.alias("part"), F.slice(gaps, 1, F.size(whole)).alias("gap"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string,part:string>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.length(row["gap"])
        end = start + F.length(row["found"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), row["found"].alias("found"), row["part"].alias("part")))).alias("out"))

    return F.aggregate(rows, first, step, lambda acc: acc["out"])


def _term(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy (bits per character) of any ``window`` consecutive characters."""
    def step(acc: Column, enters: Column) -> Column:
        held = acc["held"]
        full = F.size(held) >= window
        leaves = F.try_element_at(held, F.lit(1))

        def count(char: Column) -> Column:
            return F.size(F.filter(held, lambda x: x == char))

        c_in = count(enters) - F.when(full & (enters == leaves), 1).otherwise(0)
        c_out = count(leaves)
        total = (acc["total"] + _term(c_in + 1) - _term(c_in)
                 - F.when(full, _term(c_out) - _term(c_out - 1)).otherwise(F.lit(0.0)))
        after = F.concat(F.when(full, F.slice(held, 2, window - 1)).otherwise(held), F.array(enters))
        bits = F.log2(F.lit(float(window))) - total / F.lit(float(window))
        return F.struct(after.alias("held"), total.alias("total"),
                        F.when(F.size(held) >= window - 1, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["best"])


def _any(text: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def find_secrets(docs: DataFrame, allowed: Sequence[str] = ALLOWED, window: int = WINDOW) -> DataFrame:
    """``doc_id, text, base, added``: arrays of ``struct(kind, start, end)``, base by start and kind, added by start.

    Null texts count as empty; empty texts have no spans. Every row is scanned whole and returned, rows with equal
    ids or texts too; other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"))
    nothing = F.array().cast("array<struct<start:int,end:int,found:string,part:string>>")
    rows = rows.withColumns({
        "_assign": F.when(F.col("text").rlike(ASSIGN), _located(F.col("text"), ASSIGN, 1)).otherwise(nothing),
        "_access": F.when(F.col("text").rlike(ACCESS), _located(F.col("text"), ACCESS)).otherwise(nothing),
        "_hex": F.when(F.col("text").rlike(HEX), _located(F.col("text"), HEX)).otherwise(nothing),
        "_strings": F.when(F.col("text").rlike(CANDIDATE), _located(F.col("text"), CANDIDATE)).otherwise(nothing),
    })

    def spans(name: str, order: int, keep) -> Column:
        return F.transform(F.filter(name, keep), lambda x: F.struct(
            x["start"].alias("start"), F.lit(order).alias("rank"), x["end"].alias("end")))

    base = F.array_sort(F.concat(
        spans("_assign", 0, lambda x: F.length(x["part"]) >= 6),
        spans("_access", 1, lambda x: F.length(x["found"]) >= 20),
        spans("_hex", 2, lambda x: F.length(x["found"]) >= 24)))
    rows = rows.withColumn("_base", base)

    def random_looking(x: Column) -> Column:
        found, covered = x["found"], F.exists("_base", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))
        limit = F.lit(99.0)
        for _, pattern, bits in reversed(CLASSES):
            limit = F.when(found.rlike(pattern), F.lit(bits)).otherwise(limit)
        return F.when(covered | _any(found, allowed), F.lit(False)).otherwise(window_entropy(found, window) >= limit)

    rows = rows.withColumn("_added", F.when(F.size("_strings") > 0, spans("_strings", 3, random_looking)).otherwise(
        F.array().cast("array<struct<start:int,rank:int,end:int>>")))

    def named(name: str) -> Column:
        kinds = F.array(*[F.lit(k) for k in KINDS])
        return F.transform(name, lambda x: F.struct(
            F.element_at(kinds, x["rank"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank")))

    return rows.select("doc_id", "text", named("_base").alias("base"), named("_added").alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _ordered(spans: Column) -> Column:
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return by_start


def secret_digest(docs: DataFrame, **how) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text, per row of ``docs``."""
    found = find_secrets(docs, **how)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(_ordered(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", **how) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mask``; ``n_chars`` follows where it exists.

    Null texts stay null. All other columns stay as they are.
    """
    scanned = docs.withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_all", F.col("text").alias("text"))
    found = find_secrets(scanned.select(F.col("_all").alias("doc_id"), "text"), **how)
    spans = _ordered(F.concat("base", "added"))
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fresh = x["start"] >= acc["at"]
        return F.struct(
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"))

    clean = F.aggregate(spans, first, step, lambda acc: F.concat(
        acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    hit = F.size("base") + F.size("added") > 0
    found = found.select(F.col("doc_id").alias("_all"), hit.alias("_hit"), F.when(hit, clean).alias("_clean"))
    columns = []
    for c in docs.columns:
        kept = F.col("_all").getField(c)
        if c == "text":
            kept = F.when(F.col("_hit"), F.col("_clean")).otherwise(kept)
        elif c == "n_chars":
            kept = F.when(F.col("_hit"), F.length("_clean").cast(docs.schema[c].dataType)).otherwise(kept)
        columns.append(kept.alias(c))
    return found.select(*columns)
