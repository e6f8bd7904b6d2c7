"""License detection with ordered signatures, in DataFrame expressions only.

Each text is brought to words once. A signature is tried only where its keyword occurs, and gives the word interval of
every match. A match is dropped if its interval lies inside that of a match of the same or a better tier; of equal
intervals the one earlier in the order stays. All of this happens inside the row, without a shuffle.

Defined cases: a null or empty text has no words and a score of 0; repeated rows are scanned each; other columns are
kept out of the result, whatever their names.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm import license_rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What separates words once A-Z is lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_WEIGHT = 0.9


def spaced_words(text: Column) -> Column:
    """Lower-cased words, each between two spaces of its own; empty without words."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS, " "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))



@cache
def _literal() -> str:
    """The rules as a constant array, for use in SQL."""
    def quote(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    rows = [
        f"struct({r.order} AS rank, {quote(r.label)} AS label, {r.tier} AS tier, {r.weight}D AS weight, {quote(r.keyword)} AS keyword, {quote(r.regex)} AS regex)"
        for r in license_rules.rules()
    ]
    return f"array({', '.join(rows)})"


# Intervals of one rule: walks over its matches, adding up the words of the pieces between them.
_MATCHES = """
transform(filter({rules}, r -> array_contains(keys, r.keyword)), r ->
  aggregate(
    zip_with(split(spaced, r.regex), regexp_extract_all(spaced, r.regex, 0), (g, h) -> struct(g AS gap, h AS hit)),
    struct(0 AS at, CAST(array() AS array<struct<lo:int,hi:int,rank:int,label:string,tier:int,weight:double>>) AS found),
    (s, x) -> if(x.hit IS NULL, s, struct(
      s.at + {gap} + {hit} AS at,
      concat(s.found, array(struct(s.at + {gap} AS lo, s.at + {gap} + {hit} AS hi, r.rank AS rank, r.label AS label, r.tier AS tier, r.weight AS weight))) AS found)),
    s -> s.found))
"""

# Intervals in the order (start, longest first, rank); ends[t] is the furthest end of those of tier t or better so far.
_KEEP = """
aggregate(
  array_sort(found, (x, y) -> CASE
    WHEN x.lo <> y.lo THEN x.lo - y.lo WHEN x.hi <> y.hi THEN y.hi - x.hi ELSE x.rank - y.rank END),
  struct(array(0, 0, 0) AS ends, CAST(array() AS array<struct<lo:int,hi:int,rank:int,label:string,tier:int,weight:double>>) AS kept),
  (s, x) -> struct(
    transform(s.ends, (e, t) -> if(t + 1 >= x.tier, greatest(e, x.hi), e)) AS ends,
    if(x.hi <= s.ends[x.tier - 1], s.kept, concat(s.kept, array(x))) AS kept),
  s -> s.kept)
"""


def _count(expression: str) -> str:
    return f"CAST((length({expression}) - length(replace({expression}, ' ', ''))) DIV 2 AS INT)"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, base, detections) per row.

    ``base``: (label, start) of every place of a base phrase. ``detections``: the signatures that stay, with their
    word interval [lo, hi), label, tier (1 is the strongest) and weight.
    """
    keys = sorted({r.keyword for r in license_rules.rules()})
    listed = "array(" + ", ".join(f"'{k}'" for k in keys) + ")"
    base = []
    for label, phrase in license_rules.BASE.items():
        regex, n = license_rules.regex(phrase), len(phrase.split())
        pieces = f"split(spaced, '{regex}')"
        walk = (
            f"aggregate(slice({pieces}, 1, size({pieces}) - 1), struct(0 AS at, CAST(array() AS array<int>) AS found),"
            f" (s, x) -> struct(s.at + {_count('x')} + {n} AS at, concat(s.found, array(s.at + {_count('x')})) AS found), s -> s.found)"
        )
        places = f"transform({walk}, p -> struct('{label}' AS label, p AS start))"
        base.append(f"if(contains(spaced, '{regex}'), {places}, CAST(array() AS array<struct<label:string,start:int>>))")
    rows = docs.select(F.col(id_col).alias("id"), spaced_words(F.col(text_col).cast("string")).alias("spaced"))
    rows = rows.select(
        "id", "spaced", F.expr(_count("spaced")).cast("long").alias("n_words"),
        F.expr(f"filter({listed}, k -> contains(spaced, k))").alias("keys"), F.expr(f"concat({', '.join(base)})").alias("base"),
    )
    matches = _MATCHES.format(rules=_literal(), gap=_count("x.gap"), hit=_count("x.hit"))
    rows = rows.select("id", "n_words", "base", F.expr(f"if(size(keys) = 0, NULL, flatten({matches}))").alias("found"))
    none = "CAST(array() AS array<struct<lo:int,hi:int,rank:int,label:string,tier:int,weight:double>>)"
    return rows.select("id", "n_words", "base", F.expr(f"coalesce({_KEEP}, {none})").alias("detections"))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number, first and last place of base phrases, labels, and the best weight as score."""
    found = scan(docs, id_col, text_col)
    starts = "transform(base, b -> CAST(b.start AS BIGINT))"
    base = "transform(base, b -> b.label)"
    labels = f"array_union({base}, transform(detections, d -> d.label))"
    best = f"array_max(concat(transform(detections, d -> d.weight), transform(base, b -> {BASE_WEIGHT}D)))"
    return found.selectExpr(
        "id", "n_words", "CAST(size(base) AS BIGINT) AS n_base", f"array_min({starts}) AS first_word", f"array_max({starts}) AS last_word",
        f"array_join(array_sort(array_distinct({base})), ',') AS base_labels", f"array_join(array_sort({labels}), ',') AS labels",
        f"coalesce({best}, 0D) AS score",
    )
