"""Three-sentence incident briefs and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions.detection import confidence_band
from flowlens.functions.exprs import failed, lookup

# opening verb and closing lead per band: unfamiliar, malicious, known family (fixed values)
OPENING = {
    "novel": ("High-confidence anomalous activity observed", "Probable novel activity", "Possible novel activity"),
    "malicious": (
        "Confirmed malicious network activity", "Likely malicious network activity",
        "Possible malicious network activity"),
    "known": ("Active", "Likely", "Possible"),
    "known_verb": ("activity detected", "activity observed", "activity detected"),
}
CLOSING = ("Immediate action required: ", "Recommended action: ", "Worth reviewing before escalating: ")
NOVEL_EVIDENCE = "No known attack family matched, but the traffic sits far outside normal behaviour"
MALICIOUS_EVIDENCE = (
    "The traffic was flagged as malicious per threat intelligence with unclassified exploit structure")
NO_FEATURES = "telemetry exhibited statistical deviation from normal traffic baselines"


def _by_band(band: Column, words: tuple[str, str, str]) -> Column:
    return F.when(band == "high", words[0]).when(band == "medium", words[1]).otherwise(words[2])


def _feature_text(f: Column) -> Column:
    name = F.replace(f["feature"], F.lit("_"), F.lit(" "))
    val, median = f["value"], f["baseline_median"]
    r = F.try_divide(val, median)
    whole = lambda x: F.format_number(F.rint(x), 0)
    one = lambda x: F.format_number(x, 1)
    against = (
        F.when(r >= 3.0, F.concat(name, F.lit(" is ~"), whole(r), F.lit("x higher than typical")))
        .when((r <= 0.33) & (val > 0), F.concat(
            name, F.lit(" is ~"), whole(F.try_divide(F.lit(1.0), r)), F.lit("x lower than typical")))
        .when(val == 0, F.concat(name, F.lit(" is zero (typical baseline "), one(median), F.lit(")")))
        .otherwise(F.concat(name, F.lit(" is "), one(val), F.lit(" vs baseline "), one(median)))
    )
    return (
        F.when(median > 0, against)
        .when((median == 0) & (val > 0), F.concat(name, F.lit(" is elevated ("), one(val), F.lit(" vs normal 0)")))
        .otherwise(F.concat(name, F.lit(" is "), one(val)))
    )


def feature_summary(top_features: Column) -> Column:
    """Wording of the first two deviations."""
    texts = F.transform(F.slice(top_features, 1, 2), _feature_text)
    empty = top_features.isNull() | (F.size(top_features) == 0)
    return F.when(empty, F.lit(NO_FEATURES)).otherwise(
        F.concat(F.lit(": "), F.array_join(texts, " and ")))


def render_brief(df: DataFrame, top_features: str = "top_features", out: str = "brief") -> DataFrame:
    """Add the brief text of each incident.

    Needs verdict, attack_family, max_confidence, flow_count, src_ip, dst_ip, dst_port,
    mitre_id and an array of (feature, value, baseline_median).
    """
    fam, band = F.col("attack_family"), confidence_band(F.col("max_confidence"))
    flows = F.concat(F.format_number("flow_count", 0), F.when(F.col("flow_count") == 1, " flow").otherwise(" flows"))
    route = F.concat(
        F.lit(" from "), F.col("src_ip"), F.lit(" to "), F.col("dst_ip"), F.lit(":"), F.col("dst_port").cast("string"),
        F.lit(" across "), flows, F.lit(". "))
    summary = feature_summary(F.col(top_features))
    action = lookup(fam, K.PLAYBOOK, F.lit(K.DEFAULT_PLAYBOOK))
    novel = (F.col("verdict") == K.NOVEL_VERDICT) | (fam == "Unknown")
    technique = F.coalesce(F.concat(F.lit(" (MITRE "), F.col("mitre_id"), F.lit(")")), F.lit(""))
    first = (
        F.when(novel, _by_band(band, OPENING["novel"]))
        .when(fam == "Malicious", _by_band(band, OPENING["malicious"]))
        .otherwise(F.concat(
            _by_band(band, OPENING["known"]), F.lit(" "), fam, technique, F.lit(" "),
            _by_band(band, OPENING["known_verb"])))
    )
    evidence = (
        F.when(novel, NOVEL_EVIDENCE).when(fam == "Malicious", MALICIOUS_EVIDENCE)
        .otherwise(F.concat(F.lit("The traffic matches "), fam, F.lit(" behavioral patterns")))
    )
    cautious = F.concat(
        F.lit("Worth reviewing: check what "), F.col("src_ip"), F.lit(" is doing on port "),
        F.col("dst_port").cast("string"), F.lit(" before escalating."))
    last = (
        F.when(novel & (band == "low"), cautious)
        .when(novel, F.concat(F.lit(CLOSING[1]), action))
        .otherwise(F.concat(_by_band(band, CLOSING), action))
    )
    return df.withColumn(out, F.concat(first, route, evidence, summary, F.lit(". "), last))


def forbidden_terms(text: Column) -> Column:
    """Invented-detail terms found anywhere in the text."""
    low = F.lower(text)
    return failed([(t, low.contains(t)) for t in K.FORBIDDEN_TERMS])


def validate_briefs(df: DataFrame, brief: str = "brief", top_features: str = "top_features") -> DataFrame:
    """Add ``failures``: names of the checks a brief does not pass."""
    again = render_brief(df, top_features, "_again")
    text, low = F.col(brief), F.lower(F.col(brief))
    band, fam = confidence_band(F.col("max_confidence")), F.col("attack_family")
    assertive = low.contains("active ") | low.contains("immediate action required")
    novel = (F.col("verdict") == K.NOVEL_VERDICT) | (fam == "Unknown")
    named, guessed = F.lit(False), F.lit(False)
    for f in K.NAMED_FAMILIES_LOWER:
        named = named | low.contains(f)
        guessed = guessed | low.contains(f"active {f}") | low.contains(f"likely {f}")
    count = F.col("flow_count")
    rules = [
        ("forbidden_term", F.size(forbidden_terms(text)) > 0),
        ("src_ip", ~low.contains(F.lower("src_ip"))),
        ("dst_port", ~low.contains(F.col("dst_port").cast("string"))),
        ("flow_count", ~(text.contains(F.format_number(count, 0)) | text.contains(count.cast("string")))),
        ("band_high", (band == "high") & (low.contains("possible") | low.contains("worth reviewing before escalating"))),
        ("band_low", (band == "low") & (assertive | ~(low.contains("possible") | low.contains("worth reviewing")))),
        ("band_medium", (band == "medium") & assertive),
        ("novel_rule", novel & (~low.contains("no known attack family matched") | guessed)),
        ("malicious_rule", ~novel & (fam == "Malicious") & (
            ~(low.contains("threat intelligence") | low.contains("malicious")) | named)),
        ("playbook", ~(low.contains(F.lower(lookup(fam, K.PLAYBOOK, F.lit("")))) | low.contains("check what"))),
        ("not_reproducible", text != F.col("_again")),
    ]
    return again.withColumn("failures", failed(rules)).drop("_again")
