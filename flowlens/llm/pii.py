"""Personal data: base patterns, and identifiers that only their context gives away (bootstrapped extraction).

Base entities are the seeds. The words around each mention make lexical patterns; all identifier-like words
of the corpus (with a digit or an at sign) are instances in the slots of the same patterns. In rounds, Spark scores
the graph of patterns and instances. A pattern is as good as the share of trusted instances among everything that stands
in its slot anywhere in the corpus, plain words included, so that "the _" is worth nothing however many identifiers follow
an article; one match more that is not trusted keeps rare patterns low. An unseen instance is as good as its contexts
together; instances above the limit are trusted in the next round, until a round adds none. In the end, mentions of
trusted unseen instances in a trusted pattern become spans of the kind ``context``.

Shapes of values are no evidence: numbers that fail their check digit look like those that pass.

All tables of the graph hold one row per mention or fewer; they are grouped and joined, never gathered. Plain words are
counted in a second pass over the texts, and only beside words of patterns with enough instances: tasks get the places of
these words in at most ``BUCKETS`` hash buckets, and a join takes out what is not such a pattern.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.storage import stored

# The kinds in their order and what they are made of.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never starts inside a run of digits
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGIT = re.compile(r"[0-9]")

LEAST_SEEDS = 5  # trusted instances of a trusted pattern
LEAST_SCORE = 0.5  # of a trusted pattern
TRUST = 0.75  # of a trusted instance, over all its contexts
BUCKETS = 1 << 17  # of the filter that tells tasks which words to count
ALONE, FIRST, SECOND, LEFT, RIGHT, PLAIN = 1, 2, 4, 8, 16, 32  # places of a word in patterns; not like an identifier
SLOTS_HELD = 200_000  # counters a task holds before it hands them on

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    """Every match has one at sign, the local part before it reaches back as far as its characters do."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at)
        if domain and start < at:
            yield "email", start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All base spans by kind, then start; positions are code points."""
    out = list(_emails(text))
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def _short(word: str) -> str:
    """Words keep their identity; very long ones are known by their hash."""
    return word if len(word) <= 64 else hashlib.sha256(word.encode()).hexdigest()


def _near(word: str) -> str:
    """A context word in the form used in patterns."""
    return _short(_DIGIT.sub("0", word.lower()).strip(".,;:!?\"'()"))


def _like_identifier(word: str) -> bool:
    return "@" in word or _DIGIT.search(word) is not None


def _patterns(before: list[str], after: list[str]) -> list[str]:
    """Patterns of a slot from up to two words before it and the word after it."""
    out = [f"{before[-1]} _"] if before else []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


def mentions(text: str, base: list[Span]) -> list[dict]:
    """Base entities and identifier-like words outside them, each with its patterns."""
    if not base and not _like_identifier(text):
        return []
    taken = sorted((s, e, k) for k, s, e in base)
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    slots, i = [], 0  # (first word, last word, start, end, kind)
    for w, (start, end) in enumerate(words):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if not (i < len(taken) and taken[i][0] < end):
            inner = text[start:end].strip(".,;:!?\"'()")
            if _like_identifier(inner):
                at = text.index(inner, start)
                slots.append((w, w, at, at + len(inner), None))
    first = 0
    for start, end, kind in taken:
        while first + 1 < len(words) and words[first][1] <= start:
            first += 1
        last = first
        while last + 1 < len(words) and words[last + 1][0] < end:
            last += 1
        slots.append((first, last, start, end, kind))
    out = []
    for a, b, start, end, kind in slots:
        before = [_near(text[s:e]) for s, e in words[max(0, a - 2):a]]
        after = [_near(text[s:e]) for s, e in words[b + 1:b + 2]]
        out.append({"start": start, "end": end, "value": _short(text[start:end].lower()), "kind": kind,
                    "patterns": _patterns(before, after)})
    return out


_FOUND = "row_key long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, " \
         "mentions array<struct<start:int,end:int,value:string,kind:string,patterns:array<string>>>"
_MENTION = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("kind", pa.string()),
                               ("patterns", pa.list_(pa.string()))]))


def scan_personal_data(docs: DataFrame) -> DataFrame:
    """Per row: counts, base spans as text and their hash, and the mentions for the graph."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                counts, shas, bases, found = [], [], [], []
                for text in part.column("text"):
                    text = text.as_py() or ""
                    spans = base_spans(text)
                    kinds = [k for k, _, _ in spans]
                    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                    counts.append([kinds.count(k) for k in KINDS])
                    shas.append(hashlib.sha256(joined.encode()).hexdigest())
                    bases.append(joined)
                    found.append(mentions(text, spans))
                yield pa.RecordBatch.from_arrays([
                    part.column("row_key"), part.column("doc_id"), *[pa.array([c[j] for c in counts], pa.int64()) for j in range(4)],
                    pa.array(shas), pa.array(bases), pa.array(found, _MENTION)],
                    names=["row_key", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"])

    return docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text").mapInArrow(scan, _FOUND)


def count_plain_words(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, plain``: how often a word that is not like an identifier stands in the slot of each of ``patterns``."""
    parts = F.split("pattern", " ")
    last = F.element_at(parts, -1) == "_"  # the slot is the last word; else the middle one
    none = F.array().cast("array<struct<role:int,word:string>>")

    def place(role: int, i: int) -> Column:
        return F.struct(F.lit(role).alias("role"), parts[i].alias("word"))

    places = F.when(F.size(parts) == 2, F.array(place(ALONE, 0))).otherwise(F.concat(
        F.when(last, F.array(place(FIRST, 0), place(SECOND, 1))).otherwise(none),
        F.when(parts[1] == "_", F.array(place(LEFT, 0), place(RIGHT, 2))).otherwise(none)))
    bucket = F.crc32(F.col("part.word").cast("binary")) % BUCKETS
    roles = patterns.select(F.explode(places).alias("part")).groupBy(bucket.alias("bucket")).agg(F.bit_or("part.role").alias("roles"))
    wanted = {r.bucket: r.roles for r in roles.collect()}  # at most BUCKETS pairs of numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, pairs, around = Counter(), Counter(), Counter()
        forms: dict[str, tuple[str, int]] = {}

        def form(word: str) -> tuple[str, int]:
            near = _near(word)
            forms[word] = near, wanted.get(zlib.crc32(near.encode()) % BUCKETS, 0) | (0 if _like_identifier(word) else PLAIN)
            return forms[word]

        def totals() -> pa.RecordBatch:
            found = Counter()
            for counter, pattern in ((alone, "{} _"), (pairs, "{0[0]} {0[1]} _"), (around, "{0[0]} _ {0[1]}")):
                for key, n in counter.items():
                    found[pattern.format(key)] += n
                counter.clear()
            forms.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["pattern", "plain"])

        for batch in batches:
            for text in batch.column("text"):
                seen = [forms.get(w) or form(w) for w in _WORD.findall(text.as_py() or "")]
                near, flags = [n for n, _ in seen], [f for _, f in seen]
                alone.update(a for a, x, y in zip(near, flags, flags[1:]) if x & ALONE and y & PLAIN)
                pairs.update((a, b) for a, b, x, y, z in zip(near, near[1:], flags, flags[1:], flags[2:]) if x & FIRST and y & SECOND and z & PLAIN)
                around.update((a, c) for a, c, x, y, z in zip(near, near[2:], flags, flags[1:], flags[2:]) if x & LEFT and y & PLAIN and z & RIGHT)
                if len(pairs) + len(around) + len(forms) > SLOTS_HELD:
                    yield totals()
        yield totals()

    counted = docs.select("text").mapInArrow(scan, "pattern string, plain long")
    return counted.groupBy("pattern").agg(F.sum("plain").alias("plain")).join(patterns.select("pattern"), "pattern", "left_semi")


def bootstrap(edges: DataFrame, plain: DataFrame, seeds: int = LEAST_SEEDS, least: float = LEAST_SCORE,
              trust: float = TRUST) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns and trusted unseen instances from ``pattern, value, context, seed, n`` and ``pattern, plain``.

    A pattern is trusted with at least ``seeds`` distinct trusted instances and a score, trusted mentions over all mentions,
    plain words and one, of at least ``least``. A context of an instance is as good as the best of its trusted patterns; an
    unseen instance is trusted when one minus the product of (1 - score) over its contexts reaches ``trust``. Trust only
    grows from round to round, so the rounds end.
    """
    found, known = edges.sparkSession.createDataFrame([], "value string"), 0
    slots = stored(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")), "slots")
    while True:
        marked = slots.join(found.withColumn("_new", F.lit(True)), "value", "left")
        good = F.col("seed") | F.coalesce("_new", F.lit(False))
        scored = marked.groupBy("pattern").agg(
            F.count_if(good).alias("support"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("n"))
        scored = scored.where(F.col("support") >= seeds).join(plain, "pattern", "left")
        score = F.col("hits") / (F.col("n") + F.coalesce("plain", F.lit(0)) + 1)
        patterns = stored(scored.select("pattern", score.alias("score")).where(F.col("score") >= least), "patterns")
        contexts = edges.where(~F.col("seed")).join(patterns, "pattern").groupBy("value", "context").agg(F.max("score").alias("score"))
        doubt = contexts.groupBy("value").agg(F.sum(F.log1p(-F.col("score"))).alias("_doubt"))
        found = stored(doubt.where(F.exp("_doubt") <= 1 - trust).select("value"), "instances")
        now = found.count()
        if now == known:
            return patterns, found
        known = now


def personal_data(docs: DataFrame, seeds: int = LEAST_SEEDS, least: float = LEAST_SCORE, trust: float = TRUST) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): counts, hash of the base spans, and all spans.

    Null texts count as empty; empty texts have no spans. Each row is scanned whole by itself; rows with equal ids are
    kept apart by their texts. An empty table gives an empty result; other columns are ignored.
    """
    seen = stored(scan_personal_data(docs), "personal")
    placed = seen.select("row_key", F.explode("mentions").alias("m")).select(
        "row_key", "m.start", "m.end", "m.value", F.col("m.kind").isNotNull().alias("seed"),
        F.xxhash64("m.patterns").alias("context"), F.explode("m.patterns").alias("pattern"))
    edges = stored(placed.groupBy("pattern", "value", "context").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "graph")
    many = stored(
        edges.groupBy("pattern", "value").agg(F.sum("n").alias("n")).groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("n"))
        .where(F.col("values") >= seeds).select("pattern", "n"), "candidates")
    # were all instances trusted, the score would still be too low beside so many plain words
    plain = many.join(count_plain_words(docs, many), "pattern", "left").select("pattern", "n", F.coalesce("plain", F.lit(0)).alias("plain"))
    plain = stored(plain.where(F.col("n") >= least * (F.col("n") + F.col("plain") + 1)).select("pattern", "plain"), "plain")
    edges = stored(edges.join(plain.select("pattern"), "pattern", "left_semi"), "edges")
    patterns, found = bootstrap(edges, plain, seeds, least, trust)
    hits = placed.where(~F.col("seed")).join(found, "value", "left_semi").join(patterns.select("pattern"), "pattern", "left_semi")
    hits = hits.select("row_key", "start", "end").distinct().groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_hits"))
    rows = seen.drop("mentions").join(hits, "row_key", "left")
    added = F.transform(F.coalesce("_hits", F.array().cast("array<struct<start:int,end:int>>")),
                        lambda x: F.concat_ws(":", F.lit("context"), x["start"], x["end"]))
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base"))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.array_join(F.concat(base, added), ",").alias("spans"), F.size(added).cast("long").alias("n_context"))
