"""Cleaning: names, labels, non-finite values, timestamps, ports, identities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions.detection import mitre_id, mitre_name, risk_level, risk_score, severity_of
from flowlens.functions.exprs import finite, lookup, repair_epoch_us, snake

DAY_US = 86_400_000_000


def snake_columns(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; two columns ending up equal is an error."""
    names = [snake(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names collide after renaming: {clash}")
    return df.toDF(*names)


def map_family(
    df: DataFrame, label: str = "label", attempted: str | None = None,
    mapping: Mapping[str, str] = K.LABEL_FAMILY, strict: bool = False,
) -> DataFrame:
    """Add ``family`` from a raw label; attempted rows count as BENIGN.

    Labels outside the mapping give null, or an error listing them when ``strict``.
    """
    base = F.regexp_replace(F.col(label), F.lit(K.ATTEMPTED_SUFFIX + "$"), F.lit(""))
    fam = lookup(base, mapping)
    if strict:
        unknown = unmapped_labels(df, label, mapping)
        if some := [r[0] for r in unknown.limit(50).collect()]:
            raise ValueError(f"{unknown.count()} unmapped labels, such as: {sorted(some)}")
    if attempted:
        fam = F.when(F.col(attempted), F.lit("BENIGN")).otherwise(fam)
    return df.withColumn("family", fam)


def unmapped_labels(df: DataFrame, label: str = "label", mapping: Mapping[str, str] = K.LABEL_FAMILY) -> DataFrame:
    """Distinct labels (suffix removed) the mapping does not know."""
    base = F.regexp_replace(F.col(label), F.lit(K.ATTEMPTED_SUFFIX + "$"), F.lit(""))
    return df.select(base.alias("label")).where(lookup(F.col("label"), mapping).isNull()).distinct()


def nonfinite_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in cols})


def repair_timestamps(df: DataFrame, raw: str, out: str = "ts_us") -> DataFrame:
    """Add repaired epoch microseconds and whether the value changed."""
    fixed = repair_epoch_us(F.col(raw))
    return df.withColumn(out, fixed).withColumn("repaired", fixed != F.col(raw))


def near_file_date(ts_us: Column, file_date: Column, days: int = 2) -> Column:
    """True when the time lies within ``days`` of the file's date."""
    expected = F.unix_micros(file_date.cast("timestamp"))
    return F.abs(ts_us - expected) <= F.lit(days * DAY_US)


def drop_far_timestamps(df: DataFrame, ts_us: str, file_date: str, days: int = 2) -> DataFrame:
    return df.where(near_file_date(F.col(ts_us), F.col(file_date), days))


def timestamp_report(df: DataFrame, raw: str, file_date: str, days: int = 2) -> DataFrame:
    """One row: rows read, times repaired, rows dropped because even the repaired time is far from the file's date."""
    fixed = repair_timestamps(df, raw, "_us")
    return fixed.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("repaired").alias("repaired"),
        F.count_if(~near_file_date(F.col("_us"), F.col(file_date), days)).alias("dropped"))


def fill_ports(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Blank ports become -1 at ingest."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1)).cast("int") for c in cols})


def clamp_ports(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Negative ports become 0 on export."""
    return df.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in cols})


def derive_period(df: DataFrame, ts: str, out: str = "period") -> DataFrame:
    return df.withColumn(out, F.date_format(ts, "yyyy-MM"))


def flow_identity(df: DataFrame, day: str, row: str, ts: str, slice_cols: Sequence[str]) -> DataFrame:
    """Add flow_id, ISO observed_at and seconds since the first flow of the slice."""
    first = df.groupBy(*slice_cols).agg(F.min(ts).alias("_first"))
    joined = df.join(first, list(slice_cols))
    seconds = (F.unix_micros(ts) - F.unix_micros("_first")) / F.lit(1e6)
    return joined.withColumns({
        "flow_id": F.concat_ws("-", F.col(day).cast("string"), F.col(row).cast("string")),
        "observed_at": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        "t_rel_s": F.round(seconds, 6),
    }).drop("_first")


def normalise_family(family: Column, raw_verdict: Column) -> Column:
    """Free-text family -> family; unknown text falls back by verdict."""
    strange = F.lower(F.coalesce(raw_verdict, F.lit(""))).isin("anomaly", "novel_anomaly")
    quiet = F.lower(F.coalesce(raw_verdict, F.lit(""))) == "benign"
    text = F.trim(family)
    named = F.coalesce(
        lookup(F.lower(text), K.FAMILY_ALIASES),
        F.when(text.isin(K.FAMILIES), text),
        F.when(strange, F.lit("Unknown")).otherwise(F.lit("Malicious")),
    )
    absent = F.when(strange, "Unknown").when(quiet, "BENIGN").otherwise("Malicious")
    return F.when(family.isNull(), absent).otherwise(named)


def normalise_verdict(raw_verdict: Column, family: Column) -> Column:
    """Free-text verdict -> verdict; unknown or absent text follows the family."""
    text = F.when(family == "Unknown", K.NOVEL_VERDICT).otherwise(K.KNOWN_VERDICT)
    absent = (
        F.when(family == "Unknown", K.NOVEL_VERDICT)
        .when(family == "BENIGN", K.BENIGN_VERDICT).otherwise(K.KNOWN_VERDICT)
    )
    known = lookup(F.lower(F.trim(raw_verdict)), K.VERDICT_ALIASES)
    return F.when(raw_verdict.isNull(), absent).otherwise(F.coalesce(known, text))


FEATURE_ITEMS = "array<struct<feature:string,value:double,shap_value:double,baseline_median:double>>"


def normalise_incident_rows(df: DataFrame) -> DataFrame:
    """Loose incident rows (text columns) -> typed rows with every field in its domain.

    Input: incident_id, attack_family, verdict, status, mitre_id, mitre_name, max_confidence, severity,
    flow_count, risk_score, risk_level, src_ip, dst_ip, dst_port, first_seen, last_seen,
    top_features_json, brief_json, all strings (null = absent).
    """
    unit = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    out = df.withColumn("attack_family", normalise_family(F.col("attack_family"), F.col("verdict")))
    out = out.withColumn("verdict", normalise_verdict(F.col("verdict"), F.col("attack_family")))
    fam = F.col("attack_family")
    out = out.withColumns({
        "status": F.when(F.col("status").isin(K.STATUSES), F.col("status")).otherwise("new"),
        "mitre_id": F.coalesce(F.nullif(F.col("mitre_id"), F.lit("")), mitre_id(fam)),
        "mitre_name": F.coalesce(F.nullif(F.col("mitre_name"), F.lit("")), mitre_name(fam)),
        "max_confidence": unit(F.coalesce(F.col("max_confidence").try_cast("double"), F.lit(0.85))),
        "severity": F.coalesce(unit(F.col("severity").try_cast("double")), severity_of(fam)),
        "flow_count": F.greatest(F.lit(1), F.coalesce(F.col("flow_count").try_cast("int"), F.lit(1))),
        "src_ip": F.coalesce("src_ip", F.lit("0.0.0.0")),
        "dst_ip": F.coalesce("dst_ip", F.lit("0.0.0.0")),
        "dst_port": F.coalesce(F.col("dst_port").try_cast("int"), F.lit(0)),
        "first_seen": F.try_to_timestamp("first_seen"),
        "last_seen": F.try_to_timestamp("last_seen"),
        "top_features": F.slice(F.from_json("top_features_json", FEATURE_ITEMS), 1, 10),
        "brief": F.from_json("brief_json", "struct<text:string,source:string>"),
    })
    given = F.col("risk_score").try_cast("int")
    score = F.coalesce(
        F.when(given.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), given))),
        risk_score(F.col("verdict"), F.col("max_confidence"), F.col("severity"), F.col("flow_count")),
    )
    out = out.withColumn("risk_score", score)
    level = F.when(F.col("risk_level").isin(K.LEVELS), F.col("risk_level")).otherwise(risk_level(F.col("risk_score")))
    return out.withColumn("risk_level", level).drop("top_features_json", "brief_json")


def parse_features(df: DataFrame, features_json: str, names: Sequence[str]) -> DataFrame:
    """One double column per wanted feature from a JSON object; extra keys are ignored."""
    m = F.from_json(F.col(features_json), "map<string,double>")
    parsed = df.withColumn("_features", m)
    return parsed.withColumns({n: F.try_element_at("_features", F.lit(n)) for n in names}).drop("_features")
