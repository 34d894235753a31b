"""Which of many phrases occur in a text, in one pass over it (CLS-1..4, JON-9, SEC-29).

A phrase occurs where it stands between other characters than ``a-z0-9``; one with CJK characters occurs anywhere. So
each run of ``a-z0-9`` in a phrase is a whole run of the text, and the phrase from its first run to its last one is one
of the text's n-grams of runs with what stands between them. A pass for each number of runs lists those n-grams, and a
look-up in one hash set keeps the wanted ones: the work follows the text's length, not the number of phrases.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Phrases that become part of the expression; more of them are joined with the texts' n-grams instead.
SENT_PHRASES = 20_000
_RUN = re.compile("[a-z0-9]+")
_CJK = re.compile(T.CJK_RUN)


@dataclass
class _Kinds:
    """Phrases by the way in which they are found."""

    runs: dict[int, set[str]] = field(default_factory=dict)  # number of runs: n-grams that are phrases themselves
    framed: list[tuple[str, str, int]] = field(default_factory=list)  # (phrase, its n-gram, number of runs) with more at either end
    cjk: dict[int, set[str]] = field(default_factory=dict)  # number of characters: phrases of CJK characters alone
    other: list[str] = field(default_factory=list)


def core(phrase: str) -> tuple[str, int]:
    """A phrase from its first run to its last one, and the number of runs."""
    runs = list(_RUN.finditer(phrase))
    return (phrase[runs[0].start() : runs[-1].end()], len(runs)) if runs else ("", 0)


def _kinds(phrases: Sequence[str]) -> _Kinds:
    out = _Kinds()
    for p in dict.fromkeys(phrases):
        if _CJK.search(p):
            if _CJK.fullmatch(p):
                out.cjk.setdefault(len(p), set()).add(p)
            else:
                out.other.append(p)
            continue
        low = p.lower()
        middle, n = core(low)
        if not n:
            out.other.append(p)
        elif middle == low:
            out.runs.setdefault(n, set()).add(low)
        else:
            out.framed.append((low, middle, n))
    return out


def run_grams(text: Column, n: int) -> Column:
    """Every n consecutive runs of ``a-z0-9`` of a lower-case text with what stands between them, in order."""
    if n == 1:
        return F.regexp_extract_all(text, F.lit("[a-z0-9]++"), F.lit(0))
    return F.regexp_extract_all(text, F.lit(r"(?<![a-z0-9])(?=([a-z0-9]++" + "[^a-z0-9]++[a-z0-9]++" * (n - 1) + "))"), F.lit(1))


def cjk_grams(text: Column, n: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?=([㐀-鿿]{{{n}}}))"), F.lit(1))


def _wanted(grams: Column, among: set[str]) -> Column:
    return F.array_distinct(F.filter(grams, lambda g: g.isin(*sorted(among))))


def _confirmed(pairs: Column, have: Column, low: Column) -> Column:
    return F.transform(F.filter(pairs, lambda x: F.array_contains(have, x["m"]) & F.regexp(low, x["r"])), lambda x: x["p"])


def _of_kind(grams: Column, kind: str) -> Column:
    return F.transform(F.array_distinct(grams), lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))


def occurring(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur in a text, each once: in lower case, or as given if they have CJK characters. Null has none."""
    kinds, low = _kinds(phrases), F.lower(text)
    framed: dict[int, dict[str, list[str]]] = {}
    for phrase, middle, n in kinds.framed:
        framed.setdefault(n, {}).setdefault(middle, []).append(phrase)
    parts = [_wanted(run_grams(low, n), found) for n, found in sorted(kinds.runs.items())]
    for n, middles in sorted(framed.items()):
        # only where the n-gram occurs, the whole phrase is looked for
        pairs = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(p).alias("p"), F.lit(T.phrase_pattern(p)).alias("r")) for m, ps in sorted(middles.items()) for p in ps))
        have = _wanted(run_grams(low, n), set(middles))
        parts.append(_confirmed(pairs, have, low))
    parts += [_wanted(cjk_grams(text, n), found) for n, found in sorted(kinds.cjk.items())]
    parts += [F.when(T.phrase_present(text, p), F.array(F.lit(p if _CJK.search(p) else p.lower()))).otherwise(F.array().cast("array<string>")) for p in kinds.other]
    none = F.array().cast("array<string>")
    return F.coalesce(F.concat(*parts), none) if parts else none


def as_found(phrase: str) -> str:
    """A phrase as ``occurring`` names it."""
    return phrase if _CJK.search(phrase) else phrase.lower()


def matches(texts: DataFrame, id_col: str, text_col: str, phrases: DataFrame, phrase_col: str = "phrase", sent: int = SENT_PHRASES) -> DataFrame:
    """``(id, phrase)``: the phrases of a table that occur in each text, each once for a row of ``texts``; blank ones are none.

    Up to ``sent`` phrases are part of the scan. Beyond that the texts' distinct n-grams are joined with the phrases'
    n-grams, and only phrases with more at either end are looked for again.
    """
    wanted = phrases.select(F.trim(phrase_col).alias("phrase")).where("phrase <> ''").distinct()
    few = [r["phrase"] for r in wanted.limit(sent + 1).collect()]
    if len(few) <= sent:
        spelled = texts.sparkSession.createDataFrame([(p, as_found(p)) for p in few], "phrase string, found string")
        hits = texts.select(id_col, F.explode(occurring(F.col(text_col), few)).alias("found"))
        return hits.join(F.broadcast(spelled), "found").select(id_col, "phrase") if few else hits.select(id_col, F.col("found").alias("phrase"))
    cjk = F.col("phrase").rlike(T.CJK_RUN)
    low = F.lower("phrase")
    runs = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    middle = F.regexp_extract(low, "(?s)[a-z0-9](?:.*[a-z0-9])?", 0)
    pure = F.col("phrase").rlike(f"^{T.CJK_RUN}$")
    keyed = wanted.select("phrase", F.when(cjk & pure, F.concat(F.lit("c"), F.length("phrase"))).when(~cjk & (F.size(runs) > 0), F.concat(F.lit("r"), F.size(runs))).otherwise("x").alias("kind"), F.when(cjk, F.col("phrase")).otherwise(middle).alias("gram"), (~cjk & (middle != low)).alias("framed"))
    kinds = sorted(r["kind"] for r in keyed.select("kind").distinct().collect())
    grams = [_of_kind(run_grams(F.lower(text_col), int(k[1:])) if k[0] == "r" else cjk_grams(F.col(text_col), int(k[1:])), k) for k in kinds if k != "x"]
    rows = texts.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("__row"))
    pattern = F.concat(F.lit("(^|[^a-z0-9])\\Q"), low, F.lit("\\E([^a-z0-9]|$)"))
    out = []
    if grams:
        hits = rows.select(id_col, "__row", F.explode(F.concat(*grams)).alias("g")).select(id_col, "__row", "g.kind", "g.gram").join(keyed, ["kind", "gram"])
        out.append(hits.where("NOT framed").select(id_col, "phrase"))
        framed = hits.where("framed").select("__row", "phrase")
        out.append(rows.join(framed, "__row").where(F.regexp(F.lower(text_col), pattern)).select(id_col, "phrase"))
    # phrases without a run or of mixed scripts have no n-gram; they are rare
    rest = [r["phrase"] for r in keyed.where("kind = 'x'").limit(sent + 1).collect()]
    if len(rest) > sent:
        raise ValueError(f"more than {sent} phrases without a run of a-z0-9")
    if rest:
        spelled = texts.sparkSession.createDataFrame([(p, as_found(p)) for p in rest], "phrase string, found string")
        out.append(texts.select(id_col, F.explode(occurring(F.col(text_col), rest)).alias("found")).join(F.broadcast(spelled), "found").select(id_col, "phrase"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def holding(texts: DataFrame, text: Column, terms: DataFrame, term_col: str = "term", width: int = 3) -> DataFrame:
    """``texts`` with the columns of ``terms`` for each term that is a part of the text, boundaries or not.

    Texts list their distinct substrings of the terms' smallest lengths up to ``width``; each term is
    looked for only in texts that have its beginning.
    """
    keyed = terms.where(F.col(term_col) != "").withColumn("__key", F.substring(term_col, 1, width))
    grams = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, width + 1)]
    lengths = {r[0] for r in keyed.select(F.least(F.length("__key"), F.lit(width))).distinct().collect()}
    own = texts.withColumn("__key", F.explode(F.array_distinct(F.concat(*(grams[n - 1] for n in sorted(lengths)), F.array().cast("array<string>")))))
    return own.join(F.broadcast(keyed), "__key").where(text.contains(F.col(term_col))).drop("__key")
