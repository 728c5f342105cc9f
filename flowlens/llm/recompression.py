"""Repeated passages across documents, found by recompression.

A text is rewritten in rounds. Each round first names maximal runs of equal symbols, then pairs: a symbol is left
or right by a bit of its name, and a left symbol followed by a right one becomes one new symbol. Names are 64-bit hashes
of what they stand for, so they are the same in all tasks and documents, and inside equal passages the rewriting
is the same wherever it does not look at words beyond their ends. Every symbol carries the span of words that it was
decided by (its support).

A window of words takes as its anchor the symbol of the highest round whose support lies inside it, of several the one
with the smallest name; single words are round 0 and always lie inside. The anchor depends on the window's words
alone: equal windows have equal anchors. Spark groups the anchors of all documents; windows whose anchor occurs only once
are unique, all others are compared by a 96-bit hash of their words. So every repeat is found, and nothing else.

Before each of the two shuffles a task settles what its own rows already tell, and sends one row per name or window
on; a passage that a third of all documents share costs one row per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.storage import stored
from flowlens.llm.words import Words, grams, mix, words_of

WINDOW = 20
ROUNDS = 2
_U = np.uint64
_MUL = _U(0x9FB21C651E98DF25)
_SALT = 0x2545F4914F6CDD1D
_NO_ID = -(1 << 63)  # stands for a null doc_id, the smallest
_MARK = (1 << 32) - 1


class _Symbols:
    """Symbols of a piece: name, text, words [begin, end) and support [low, high)."""

    def __init__(self, name, text, begin, end, low, high):
        self.name, self.text, self.begin, self.end, self.low, self.high = name, text, begin, end, low, high

    def _around(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Low of the symbol before ``first`` and high of the one after ``last``; beyond a text's edge, out of reach."""
        before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(self.name) - 1)
        has_before = (first > 0) & (self.text[before] == self.text[first])
        has_after = (last < len(self.name) - 1) & (self.text[after] == self.text[last])
        low = np.where(has_before, self.low[before], self.begin[first] - 1)
        high = np.where(has_after, self.high[after], self.end[last] + 1)
        return np.minimum(low, self.low[first]), np.maximum(high, self.high[last])

    def runs(self, salt: int) -> _Symbols:
        n = len(self.name)
        new = np.ones(n, dtype=bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [n]]) - 1
        count = (last - first + 1).astype(_U)
        name = self.name[first]
        name = np.where(count > 1, mix(name * _MUL + mix(count + _U(salt))), name)
        low, high = self._around(first, last)
        return _Symbols(name, self.text[first], self.begin[first], self.end[last], low, high)

    def pairs(self, salt: int) -> _Symbols:
        n = len(self.name)
        right = (mix(self.name ^ _U(salt)) & _U(1)).astype(bool)
        joins = np.zeros(n, dtype=bool)
        joins[:-1] = ~right[:-1] & right[1:] & (self.text[:-1] == self.text[1:])
        taken = np.zeros(n, dtype=bool)
        taken[1:] = joins[:-1]
        first = np.flatnonzero(~taken)
        paired = joins[first]
        last = first + paired
        name = np.where(paired, mix(self.name[first] * _MUL + mix(self.name[last] + _U(salt))), self.name[first])
        low, high = self._around(first, last)
        # a pair was decided by its two symbols, a single left one by it and the next, a single right one by it and the last
        low = np.where(~paired & right[first], low, self.low[first])
        high = np.where(~paired & ~right[first], high, self.high[last])
        return _Symbols(name, self.text[first], self.begin[first], self.end[last], low, high)


def anchors(w: Words, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (word number in the piece), anchor name and the anchor's own place of every window of the piece."""
    n, text = len(w.hashes), w.text_of_word()
    best = np.full(n, np.iinfo(np.uint64).max, dtype=_U)
    fits = np.zeros(n, dtype=bool)
    if n >= window:
        fits[:n - window + 1] = text[:n - window + 1] == text[window - 1:]
    at = np.arange(n)
    level = _Symbols(w.hashes, text, at, at + 1, at, at + 1)
    run = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(w.hashes, dtype=_U)])
    tried = []
    for r in range(rounds + 1):
        if r:
            level = level.runs(2 * r + 1).pairs(mix_salt(r))
        if not len(level.name):
            break
        low, high = level.low, level.high
        inside = high - low <= window
        # the words of the support are part of the name, so that few supports share one
        reach = np.clip(high, 0, n)
        name = mix(level.name * _MUL ^ (run[reach] - run[np.clip(low, 0, n)]))
        order = (_U(rounds - r) << _U(60)) | (name >> _U(4))
        first = np.maximum(high - window, w.offsets[level.text])
        keep = inside & (first <= low)
        first, last, order, begin = first[keep], low[keep], order[keep], level.begin[keep]
        tried.append((first, last, order, begin))
        for step in range(window):
            here = np.flatnonzero(first + step <= last)
            if not len(here):
                break
            np.minimum.at(best, first[here] + step, order[here])
    # the same name may stand at several places of a window; the leftmost is its anchor
    place = np.full(n, n)
    for first, last, order, begin in tried:
        for step in range(window):
            here = np.flatnonzero(first + step <= last)
            if not len(here):
                break
            here = here[order[here] == best[first[here] + step]]
            np.minimum.at(place, first[here] + step, begin[here])
    start = np.flatnonzero(fits)
    return start, best[start], place[start]


def mix_salt(r: int) -> int:
    return int(mix(np.array([r], dtype=_U))[0])


def row_key() -> Column:
    """Tells rows of one doc_id apart by their text; negative for rows without a doc_id, so that they come first."""
    least, most = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    h = F.xxhash64("doc_id", "text")
    return F.when(F.col("doc_id").isNull(), h.bitwiseOR(least)).otherwise(h.bitwiseAND(most))


def _ranks(*columns: np.ndarray) -> np.ndarray:
    """Place of every row in the order of the columns; equal rows share one."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def word_sequences(docs: DataFrame) -> DataFrame:
    """``doc_id, key, row, n_words, sha``: the hash of all words joined by one space, per row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas = [], []
            for text in batch.column("text"):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(counts, pa.int64()), pa.array(shas, pa.string())],
                                             names=["doc_id", "key", "n_words", "sha"])

    return docs.select("doc_id", "key", "text").mapInArrow(read, "doc_id long, key long, n_words long, sha string").withColumn(
        "row", F.monotonically_increasing_id())


def anchor_runs(docs: DataFrame, window: int, rounds: int) -> DataFrame:
    """``name, span, place``: runs of windows with one anchor.

    A mark, the 32 low bits of its key, stands for the row; half of it is above ``span``, half below ``place``. Rows that
    share a mark only get more windows compared. ``span`` holds the first window (30 bits, as a text has 2^31 bytes at
    most), the number of windows (16 bits) and whether the run is sure (1 bit). ``place`` tells different occurrences
    apart; it is the same in exact copies. A name seen at two places in one batch is
    settled: its runs are ``sure`` and spread by a name of their own, and a single row with place 0 goes on under the
    name, to tell the other batches.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _longs(batch, "key")
            ranks = _ranks(_longs(batch, "doc_id"), keys)
            marks = np.zeros(len(ranks), dtype=np.int64)
            marks[ranks] = keys & _MARK
            parts = []
            for w in words_of(batch.column("text")):
                start, name, anchor = anchors(w, window, rounds)
                if not len(start):
                    continue
                text = w.text_of_word()[start]
                new = np.ones(len(start), dtype=bool)
                new[1:] = (name[1:] != name[:-1]) | (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
                first = np.flatnonzero(new)
                run = np.diff(np.concatenate([first, [len(start)]]))
                text, own = text[first], start[first]
                sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(mix(w.hashes * _MUL + np.arange(len(w.hashes), dtype=_U)
                                       - w.offsets[w.text_of_word()].astype(_U)), dtype=_U)])
                whole = mix(sums[w.offsets[1:]] - sums[w.offsets[:-1]])
                own = own - w.offsets[text]
                place = (mix(whole[text] + own.astype(_U) * _MUL) >> _U(17)) | _U(1)
                parts.append((name[first], ranks[w.first + text], own, run, place))
            if not parts:
                continue
            name, doc, own, run, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((doc, place, name))
            name, doc, own, run, place = name[order], doc[order], own[order], run[order], place[order]
            keep = np.ones(len(name), dtype=bool)
            keep[1:] = (name[1:] != name[:-1]) | (place[1:] != place[:-1])  # of copies the first will do
            name, doc, own, run, place = name[keep], doc[keep], own[keep], run[keep], place[keep]
            new = np.ones(len(name), dtype=bool)
            new[1:] = name[1:] != name[:-1]
            sure = ~new
            sure[:-1] |= ~new[1:]
            told = name[new & sure]
            zero = np.zeros(len(told), dtype=np.int64)
            mark, place = marks[doc], place.astype(np.int64)
            span = mark >> 16 << 47 | own << 17 | run << 1 | sure
            place = place << 16 | mark & 0xFFFF
            # a settled row needs no meeting point any more: any name will do
            name = np.where(sure, mix(mark.astype(_U) * _MUL + own.astype(_U)), name)
            # back in document order, so that rows of one document stand together
            back = np.lexsort((own, doc))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([name[back], told]).view(np.int64)), pa.array(np.concatenate([span[back], zero])),
                pa.array(np.concatenate([place[back], zero]))], names=["name", "span", "place"])

    return docs.select("doc_id", "key", "text").mapInArrow(
        read, "name long, span long, place long")


def _marked(count: int, offsets: np.ndarray, which: np.ndarray, start: np.ndarray, run: np.ndarray, reach: int) -> np.ndarray:
    """Words covered by runs of windows: text ``which``, first window ``start``, ``run`` windows of ``reach`` words."""
    edge = np.zeros(count + 1, dtype=np.int64)
    top = offsets[which + 1]
    np.add.at(edge, np.minimum(offsets[which] + start, top), 1)
    np.add.at(edge, np.minimum(offsets[which] + start + run + reach - 1, top), -1)
    return np.cumsum(edge[:-1]) > 0


def _runs_of(batch: pa.RecordBatch, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = batch.column("runs").slice(first, last - first)
    which = np.repeat(np.arange(last - first), [len(r) for r in own])
    inner = own.flatten()
    return which, inner.field("start").to_numpy(zero_copy_only=False), inner.field("run").to_numpy(zero_copy_only=False)


def window_rows(texts: DataFrame, window: int) -> DataFrame:
    """``a, b, doc_id, sub, start, run``: the 96-bit hash of every marked window.

    Of equal windows in one batch the first goes on to meet those of other batches; the rest are certainly repeats and
    are passed as runs; only those have a ``run`` of 1 or more.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, subs, parts = _longs(batch, "doc_id"), _longs(batch, "sub"), []
            ranks = _ranks(ids, subs)
            some = np.zeros(len(ranks), dtype=np.int64)  # a row of each rank
            some[ranks] = np.arange(len(ranks))
            for w in words_of(batch.column("text")):
                last = w.first + len(w.offsets) - 1
                which, start, run = _runs_of(batch, w.first, last)
                marked = _marked(len(w.hashes), w.offsets, which, start, run, 1)
                text = w.text_of_word()
                many = max(0, len(w.hashes) - window + 1)
                at = np.flatnonzero(marked[:many] & (text[:many] == text[window - 1:]))
                if len(at):
                    parts.append((grams(w.hashes, window)[at], grams(w.hashes, window, _SALT)[at] >> _U(32), ranks[w.first + text[at]], at - w.offsets[text[at]]))
            if not parts:
                continue
            a, b, doc, start = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((start, doc, b, a))
            a, b, doc, start = a[order], b[order], doc[order], start[order]
            first = np.ones(len(a), dtype=bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            # in two equal rows the same start is no earlier one
            later = (doc != doc[lead]) | (start != start[lead])
            later_doc, later_start = doc[later], start[later]
            order = np.lexsort((later_start, later_doc))
            later_doc, later_start = later_doc[order], later_start[order]
            new = np.ones(len(later_doc), dtype=bool)
            new[1:] = (later_doc[1:] != later_doc[:-1]) | (later_start[1:] > later_start[:-1] + 1)
            begin = np.flatnonzero(new)
            # equal rows name a start more than once
            run = later_start[np.append(begin[1:], len(new))[:len(begin)] - 1] - later_start[begin] + 1
            spread = mix(later_doc[begin].astype(_U) * _MUL + later_start[begin].astype(_U))
            row = some[np.concatenate([doc[first], later_doc[begin]])]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([a[first], spread]).view(np.int64)), pa.array(np.concatenate([b[first], spread >> _U(32)]).view(np.int64)),
                pa.array(ids[row]), pa.array(subs[row]), pa.array(np.concatenate([start[first], later_start[begin]])),
                pa.array(np.concatenate([np.zeros(first.sum(), dtype=np.int64), run]))], names=["a", "b", "doc_id", "sub", "start", "run"])

    return texts.mapInArrow(read, "a long, b long, doc_id long, sub long, start long, run long")


def cut_texts(texts: DataFrame, window: int) -> DataFrame:
    """``doc_id, key, n_removed, kept_sha256``: what is left without the words that the runs of repeated windows cover."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column("text")):
                n = len(w.offsets) - 1
                which, start, run = _runs_of(batch, w.first, w.first + n)
                gone = _marked(len(w.hashes), w.offsets, which, start, run, window)
                shas, counts = [], []
                data = w.data.tobytes()
                for j in range(n):
                    lo, hi = w.offsets[j], w.offsets[j + 1]
                    stay = np.flatnonzero(~gone[lo:hi]) + lo
                    counts.append(hi - lo - len(stay))
                    kept = b" ".join([data[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)])
                    shas.append(hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(w.first, n), batch.column("key").slice(w.first, n), pa.array(counts, pa.int64()),
                    pa.array(shas, pa.string())], names=["doc_id", "key", "n_removed", "kept_sha256"])

    return texts.mapInArrow(read, "doc_id long, key long, n_removed long, kept_sha256 string")


def repeated_windows(docs: DataFrame, firsts: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, sub, start, run``: runs of windows in the rows ``firsts`` (``doc_id, key, sub``) that also start earlier.

    Rows are ordered by doc_id and ``sub``.
    """
    by_name = Window.partitionBy("name")
    met = anchor_runs(docs, window, rounds).withColumns({
        "_least": F.min("place").over(by_name), "_most": F.max("place").over(by_name)})
    sure = F.col("span").bitwiseAND(1) == 1
    differ = F.shiftright("_least", 16) < F.shiftright("_most", 16)
    shared = met.where((F.shiftright("place", 16) > 0) & (sure | differ)).withColumn(
        "mark", F.shiftleft(F.shiftright("span", 47), 16).bitwiseOR(F.col("place").bitwiseAND(F.lit(0xFFFF))))
    span = F.struct(F.shiftright("span", 17).bitwiseAND(F.lit((1 << 30) - 1)).alias("start"), F.shiftright("span", 1).bitwiseAND(F.lit(0xFFFF)).alias("run"))
    runs = shared.groupBy("mark").agg(F.collect_list(span).alias("runs"))
    runs = firsts.withColumn("mark", F.col("key").bitwiseAND(F.lit(_MARK))).join(runs, "mark")
    rows = window_rows(docs.join(runs, ["doc_id", "key"]).select("doc_id", "sub", "text", "runs"), window)
    by_window = Window.partitionBy("a", "b")
    rows = rows.withColumn("_first", F.min("doc_id").over(by_window))
    rows = rows.withColumn("_sub", F.min(F.when(F.col("doc_id") == F.col("_first"), F.col("sub"))).over(by_window))
    return rows.where(
        (F.col("run") > 0) | (F.col("doc_id") > F.col("_first")) | (F.col("sub") > F.col("_sub"))).select("doc_id", "sub", "start", F.greatest("run", F.lit(1)).alias("run"))


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``): ``doc_id, n_words, n_removed, kept_sha256``.

    Removed is every word covered by a window whose words also start earlier (smaller doc_id, or earlier in the same
    text). Null and empty texts have no words; texts shorter than a window lose nothing. A null doc_id is the smallest.
    Different texts that share a doc_id, or have none, are documents of their own, ordered by :func:`row_key`. Equal rows
    are one document if they have a doc_id (all get its result), and copies of the first if they have none. An empty
    table gives an empty result; other columns are ignored.
    """
    plain = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), row_key().alias("key"), "text")
    seen = stored(word_sequences(plain), "sequences")
    firsts = seen.groupBy("sha").agg(F.min(F.struct("doc_id", "key", "row")).alias("_first"))
    own, first = F.struct("doc_id", "key"), F.struct("_first.doc_id", "_first.key")
    seen = seen.join(firsts, "sha").withColumn("_copy", (own > first) | ((F.col("key") < 0) & (F.col("row") > F.col("_first.row")) & (own == first)))
    firsts = firsts.select("_first.doc_id", "_first.key")
    shared = firsts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    firsts = stored(firsts.join(shared, "doc_id", "left").select(
        "doc_id", "key", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.col("key")).alias("sub")), "firsts")
    removed = repeated_windows(plain, firsts, window, rounds)
    removed = removed.groupBy("doc_id", "sub").agg(F.collect_list(F.struct("start", "run")).alias("runs"))
    removed = removed.join(firsts, ["doc_id", "sub"])
    cut = cut_texts(plain.join(removed, ["doc_id", "key"]).select("doc_id", "key", "text", "runs"), window).distinct()
    cut = cut.withColumnsRenamed({"n_removed": "_n", "kept_sha256": "_sha"})
    # a later copy of a whole text is repeated from its first word to its last
    whole = F.col("_copy") & (F.col("n_words") >= window)
    rows = seen.join(cut, ["doc_id", "key"], "left")
    return rows.select(
        F.when(F.col("key") >= 0, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("_n", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).when(F.col("_copy"), F.col("sha")).otherwise(F.coalesce("_sha", "sha")).alias("kept_sha256"))
