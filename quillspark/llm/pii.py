"""Personal data: fixed patterns as seeds, and contextual patterns bootstrapped from them.

1. One pass finds e-mail addresses, IP addresses, card and phone numbers (the
   seeds), keys and tokens by their form (seeds of a fifth kind, ``secret``), every
   other token that has a digit or ``@`` or is long, and every run of digit groups
   with single spaces between them (candidates). Each occurrence has lexical
   patterns: the two words before it, the words on both sides, and the word before
   it with all that stands in between, such as ``token = "``.
2. Spark scores the graph of patterns and instances in rounds. A round's patterns
   have at least ``MIN_SUPPORT`` distinct instances of a kind, seeds or candidates
   that the round before gave ``MIN_TRUST``. For those that are new, a pass over the
   corpus counts how often each occurs at all, whatever stands in it, so a context
   of ordinary words gets little trust. A pattern's trust for a kind is the summed
   score of its instances over its occurrences; a candidate's score is one minus the
   product of its patterns' doubts.
3. There are at least ``ROUNDS`` rounds, and more while they add patterns or instances.
4. Patterns over ``MIN_TRUST`` give their kind to the candidates in them that reach it,
   and confirm the secrets in them; by its form alone no secret is reported. Of these
   spans, one that lies within another one is left out.

Seeds of the first four kinds always stay. Matching is linear in the text's length.

Defined results: a null text is empty and has no spans; repeated rows get the same
spans, and each counts; a candidate trusted for several kinds gets the best, then the
first listed; a very long text is scanned whole, as one row; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import arrow_schema, batch, written

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
ROUNDS = 3
MIN_TRUST = 0.6
MIN_SUPPORT = 3
#: Pattern hashes sent to all tasks at a time (8 bytes each); more are counted in further passes.
SENT_PATTERNS = 2_000_000

# The patterns of the contract, with runs that can't give back what they took.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens of this length are candidates whatever they hold.
LONG_TOKEN = 20
_IDENTIFIER = re.compile(rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+(?:[0-9@][^\x20\x09-\x0D]*+|(?<=[^\x20\x09-\x0D]{{{LONG_TOKEN}}}))")
_SECRET = re.compile(r"(?=(?:[A-Za-z_+/=-]*+[0-9]){6})(?=(?:[0-9_+/=-]*+[A-Za-z]){6})[A-Za-z0-9_+/=-]{24,}+")
_GROUP = re.compile(r"[0-9().+-]*+")
_TRIM = "\"'`.,;:!?()[]{}<>*#$%&|="


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and len(p.lstrip("0") or "0") <= 3 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def _pattern(side: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of a lexical pattern: 0 the two words before a slot, 1 those on both sides, 2 the word before and the gap."""
    return tk.mix(first * tk.ORDER_VALUE[2 * side] + second * tk.ORDER_VALUE[2 * side + 1]).view(np.int64)


def _context_words(piece: tk.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the context words of a slice begin, each text's first word, their hashes (A-Z folded), and those of the gaps behind them."""
    starts, ends, first = tk.spans(piece, tk.IS_PUNCTUATION)
    prefix = tk.prefix_hash(piece.data, tk.BYTE_VALUE_LOWER)
    return starts, first, tk.span_hash(prefix, starts, ends), tk.span_hash(prefix, ends[:-1], starts[1:])


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_OCCURRENCE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))])
_SCANNED = "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, occurrences array<struct<start:long,end:long,kind:int,instance:long,patterns:array<long>>>"
_SCANNED_ARROW = pa.schema([*arrow_schema("doc_id long,text_hash long,n_email long,n_ip long,n_card long,n_phone long,base_sha256 string"), ("base", pa.list_(_SPAN)), ("occurrences", pa.list_(_OCCURRENCE))])


def _written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """The base spans of a text; and all occurrences, candidates too (kind -1), without their patterns."""
    base = base_spans(text)
    occurrences = [{"start": s, "end": e, "kind": k, "instance": _hash(KINDS[k], text[s:e].lower())} for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    j, reach = 0, 0
    run: list[int] = []  # start and end of each digit group of the open run

    def close() -> None:
        if len(run) > 2 and run[-1] - run[0] >= 4:
            occurrences.append({"start": run[0], "end": run[-1], "kind": -1, "instance": _hash("", text[run[0] : run[-1]].lower())})
        run.clear()

    for m in _IDENTIFIER.finditer(text):
        while j < len(taken) and taken[j][0] < m.end():
            reach = max(reach, taken[j][1])
            j += 1
        if reach > m.start():
            close()
            continue
        token = m[0].strip(_TRIM)
        s = m.start() + m[0].index(token)
        if not token or not _GROUP.fullmatch(token):
            close()
        else:
            if run and not (text[run[-1] : s] in (" ", ") ", " (", ") (")):
                close()
            run += (s, s + len(token))
        if _SECRET.fullmatch(token):
            occurrences.append({"start": s, "end": s + len(token), "kind": SECRET, "instance": _hash(ALL_KINDS[SECRET], token.lower())})
        elif len(token) >= 4:
            occurrences.append({"start": s, "end": s + len(token), "kind": -1, "instance": _hash("", token.lower())})
    close()
    return base, occurrences


def _add_patterns(occurrences: list[dict], text: str, starts: np.ndarray, words: np.ndarray, gaps: np.ndarray) -> None:
    """Give each occurrence its patterns; ``starts`` are byte offsets of the text's context words, ``gaps`` stand behind them."""
    marks = sorted({o[x] for o in occurrences for x in ("start", "end")})
    at, done, to_byte = 0, 0, {}
    for mark in marks:
        at += len(text[done:mark].encode())
        done = mark
        to_byte[mark] = at
    for o in occurrences:
        left = int(np.searchsorted(starts, to_byte[o["start"]]))
        right = int(np.searchsorted(starts, to_byte[o["end"]]))
        o["patterns"] = []
        if left >= 2:
            o["patterns"].append(int(_pattern(0, words[left - 2 : left - 1], words[left - 1 : left])[0]))
        if left >= 1 and right < len(words):
            o["patterns"].append(int(_pattern(1, words[left - 1 : left], words[right : right + 1])[0]))
        if 1 <= left < len(words):
            o["patterns"].append(int(_pattern(2, words[left - 1 : left], gaps[left - 1 : left])[0]))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Seeds and candidates of every row of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in tk.slices(b.column(1)):
                starts, first, words, gaps = _context_words(piece)
                rows: list[list] = [[] for _ in _SCANNED_ARROW]
                size = piece.last - piece.first
                for r, (doc, text) in enumerate(zip(b.column(0).slice(piece.first, size).to_pylist(), b.column(1).slice(piece.first, size).to_pylist(), strict=True)):
                    text = text or ""
                    base, occurrences = _scan_text(text)
                    if occurrences:
                        _add_patterns(occurrences, text, starts[first[r] : first[r + 1]] - piece.offsets[r], words[first[r] : first[r + 1]], gaps[first[r] : first[r + 1]])
                    by_kind = [sum(k == x for _, k, _ in base) for x in range(len(KINDS))]
                    digest = hashlib.sha256(_written_out(base).encode()).hexdigest()
                    row = [doc, _hash(text), *by_kind, digest, [{"start": s, "kind": k, "end": e} for s, k, e in base], occurrences]
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, _SCANNED_ARROW.types, strict=True)], schema=_SCANNED_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, _SCANNED)


def pattern_counts(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """``(pattern, total)``: how often each of ``patterns`` occurs in the corpus, whatever stands in it."""
    spark = docs.sparkSession
    passes = -(-patterns.count() // SENT_PATTERNS) or 1
    out = None
    for k in range(passes):
        part = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == k)
        sent = spark.sparkContext.broadcast(np.sort(part.toArrow().column(0).to_numpy()))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known = sent.value
            total = np.zeros(len(known), np.int64)
            for b in batches:
                for piece in tk.slices(b.column(0)):
                    _, first, words, gaps = _context_words(piece)
                    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                    for side, step, second in ((0, 1, words[1:]), (1, 2, words[2:]), (2, 1, gaps)):
                        if len(known) and len(words) > step:
                            seen = _pattern(side, words[:-step], second)[row[:-step] == row[step:]]
                            at = np.minimum(np.searchsorted(known, seen), len(known) - 1)
                            total += np.bincount(at[known[at] == seen], minlength=len(known))
            yield batch("pattern long,total long", known[total > 0], total[total > 0])

        counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "pattern long, total long")
        out = counted if out is None else out.unionByName(counted)
    return out.groupBy("pattern").agg(F.sum("total").alias("total"))


def trusted(graph: DataFrame, counted: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Trust of patterns ``(pattern, kind, trust)`` and scores of candidates ``(instance, kind, score)``.

    ``graph`` has a row for each pattern, instance and kind (-1 for a candidate) with its occurrences ``n``;
    ``counted`` gives the totals of patterns. After ``rounds`` rounds the first that adds nothing is the last.
    """
    seeds = graph.where("kind >= 0").select("pattern", "instance", "kind", F.lit(1.0).alias("score"), "n")
    open_ends = graph.where("kind < 0").select("pattern", "instance", "n")
    known, totals = (graph.sparkSession.createDataFrame([], x) for x in ("pattern long", "pattern long, total long"))
    accepted = graph.sparkSession.createDataFrame([], "instance long, kind int")
    weighed, k = seeds, 0
    while True:
        k += 1
        sums = written(weighed.groupBy("pattern", "kind").agg(F.sum(F.col("score") * F.col("n")).alias("s"), F.sum("n").alias("own"), F.count("*").alias("support")).where(F.col("support") >= MIN_SUPPORT))
        added = written(sums.select("pattern").distinct().join(known, "pattern", "left_anti"))
        grown = not added.isEmpty()
        if grown:
            known, totals = known.unionByName(added), totals.unionByName(written(counted(added)))
        trust = written(sums.join(totals, "pattern", "left").select("pattern", "kind", F.least(F.col("s") / F.greatest(F.col("own"), F.coalesce("total", F.lit(0))), F.lit(0.999)).alias("trust")))
        scores = written(open_ends.join(trust, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("trust"))))).alias("score")))
        sure = scores.where(F.col("score") >= MIN_TRUST)
        more = written(sure.select("instance", "kind").join(accepted, ["instance", "kind"], "left_anti"))
        if k >= rounds and not grown and more.isEmpty():
            return trust, scores
        accepted = accepted.unionByName(more)
        weighed = seeds.unionByName(open_ends.join(sure, "instance").select("pattern", "instance", "kind", "score", "n"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: counts and digest of the fixed patterns' spans, and all spans with those the method adds."""
    found = written(scanned(docs, id_col, text_col))
    occurrences = found.select("doc_id", "text_hash", F.explode("occurrences").alias("o")).select("doc_id", "text_hash", "o.start", "o.end", "o.kind", "o.instance", F.explode("o.patterns").alias("pattern"))
    graph = written(occurrences.groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")))
    # A pattern with fewer instances of all kinds together can't have MIN_SUPPORT of one.
    possible = graph.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= MIN_SUPPORT).select("pattern")
    graph = written(graph.join(possible, "pattern", "left_semi"))
    trust, scores = trusted(graph, lambda patterns: pattern_counts(docs, patterns, text_col))
    good = trust.where(F.col("trust") >= MIN_TRUST)
    sure = scores.where(F.col("score") >= MIN_TRUST)
    found_here = occurrences.where("kind < 0").drop("kind").join(good, "pattern").join(sure, ["instance", "kind"])
    confirmed = occurrences.where(F.col("kind") == SECRET).join(good, ["pattern", "kind"]).withColumn("score", F.lit(1.0))
    new = found_here.unionByName(confirmed)
    best = new.groupBy("doc_id", "text_hash", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    before = Window.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = best.withColumn("reach", F.max("end").over(before)).where(F.col("reach").isNull() | (F.col("end") > F.col("reach")))
    added = outer.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    joined = found.drop("occurrences").withColumnsRenamed({"doc_id": "d", "text_hash": "h"}).join(added, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<start:long,kind:int,end:long>>"))))
    named = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ALL_KINDS)), x["kind"] + 1), x["start"], x["end"]))
    return joined.select(F.col("d").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(named, ",").alias("spans"), F.size(F.coalesce("added", F.array())).cast("long").alias("n_added"), F.size(spans).cast("long").alias("n_spans"))
