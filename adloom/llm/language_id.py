"""Language of documents and pages by fusing evidence in Bayes' rule.

posterior(L) ~ P(text | L) * P(declared language | L) * prior(L | host)

* Text: a naive Bayes model of hashed letter trigrams, fitted on a bounded sample of rows with a declared language. Neighbouring
  trigrams overlap and long texts would drown all else, so a trigram counts a third, and at most ``TEXT_CAP`` of them.
* Declared language: right with the rate measured over all rows, otherwise any of the other languages.
* Prior: expected numbers of texts per language, from the text alone, are summed by host, by domain, by address suffix and
  over all rows. Each level is smoothed towards the one above it, and every row's own share is left out of its prior.

Sums are kept in thousandths as integers, so they do not depend on the order of summation. The tables joined are one row
per host; the text itself is never shuffled.

Defined cases: a null text, or one without letters, is ``und`` and not kept; a null host or declaration is no evidence; repeated
rows count each; declared tags count by their primary part (en of en-US); a text of any length is read whole; equal posteriors go to
the language first in the alphabet; without labelled rows every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.llm.shared import stored

FIT_ROWS = 2000  # expected number of rows per language that the text model is fitted on
LEAST_ROWS = 5  # declared rows that a language needs to be known, however many others there are
BUCKETS = 1 << 14
TEXT_CAP, TEXT_SHARE = 300, 1 / 3
STRENGTH = 5.0  # rows that the level above counts for
THOUSAND = 1000
_ALPHA = None


def _letters() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _ALPHA


def trigrams(text: str) -> tuple[np.ndarray, int]:
    """Bucket of every letter trigram, words apart by one blank; and the number of letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    symbols = np.concatenate(([32], np.where(letter, points, 32)[keep], [32])).astype(np.uint64)
    h = symbols[:-2] * np.uint64(0x9E3779B97F4A7C15) + symbols[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + symbols[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(50)).astype(np.int64), int(letter.sum())


def primary(column: str) -> Column:
    """The language of a declared tag such as ``en`` or ``en-US``, in lower case; NULL if it is none."""
    return F.nullif(F.lower(F.regexp_extract(F.col(column).cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit(""))


def fit_text_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log-probability of every bucket in each. The sample is chosen by a hash of the text."""
    rows = labelled.select(primary(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = sorted(x for x, n in counts.items() if n >= LEAST_ROWS)
    if not known:
        return [], np.zeros((0, BUCKETS))
    share = F.create_map(*[F.lit(v) for x in known for v in (x, min(1.0, FIT_ROWS / counts[x]))])
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text)[0], minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    found = sample.select("lang", "text").mapInArrow(work, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = np.full((len(known), BUCKETS), 0.5)
    for r in found.toLocalIterator():  # at most languages * BUCKETS rows
        model[known.index(r["lang"]), r["bucket"]] += r["n"]
    return known, np.log(model / model.sum(1, keepdims=True))


def text_evidence(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """``rows`` with ``letters`` and ``ll``, the log-likelihood per language; the text itself is dropped."""
    kept = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", letters long, ll array<double>"
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            letters, ll = [], []
            for text in batch.column(len(kept)):
                at, n = trigrams(text.as_py() or "")
                letters.append(n)
                mean = table[:, at].mean(1) if at.size and n else np.zeros(table.shape[0])
                ll.append(mean * min(at.size, TEXT_CAP) * TEXT_SHARE)
            columns = [*batch.columns[: len(kept)], pa.array(letters, pa.int64()), pa.array(ll, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "letters", "ll"])

    return rows.select(*kept, "text").mapInArrow(work, schema)


def _softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def host_priors(evidence: DataFrame, n: int) -> DataFrame:
    """Expected texts per language (thousandths) of every host, with those of its domain, its suffix and of all. Stored."""
    names = [f"e{i}" for i in range(n)]
    hosts = evidence.groupBy("host", "domain", "suffix").agg(*[F.sum(x).alias(f"host_{x}") for x in names])
    hosts = stored(hosts, "hosts")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"host_{x}").alias(f"domain_{x}") for x in names])
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"host_{x}").alias(f"suffix_{x}") for x in names])
    every = hosts.agg(*[F.sum(f"host_{x}").alias(f"all_{x}") for x in names]).first()
    joined = hosts.join(domains, "domain").join(suffixes, "suffix")
    return stored(joined.withColumns({f"all_{x}": F.lit(every[f"all_{x}"] or 0) for x in names}), "priors")


def identify(
    rows: DataFrame, languages: list[str], model: np.ndarray, least: float = 0.5
) -> DataFrame:
    """Adds lang, posterior, text_lang and kept to rows (any key columns, text, declared, host, domain, suffix)."""
    keys = [c for c in rows.columns if c not in ("text", "declared", "host", "domain", "suffix")]
    if not languages:
        return rows.select(*keys, F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit("und").alias("text_lang"), F.lit(False).alias("kept"))
    n = len(languages)
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "domain", "suffix")})
    found = text_evidence(rows, model)
    ll = [F.col("ll")[i] for i in range(n)]
    expected = [F.when(F.col("letters") > 0, F.round(p * THOUSAND)).otherwise(0).cast("long") for p in _softmax(ll)]
    found = stored(found.withColumns({f"e{i}": e for i, e in enumerate(expected)}), "evidence")

    given = [F.col("declared") == x for x in languages]
    right = sum((F.when(g, F.col(f"e{i}")).otherwise(0) for i, g in enumerate(given)), F.lit(0))
    told = (F.col("declared").isin(*languages)) & (F.col("letters") > 0)
    rate = found.where(told).agg(F.sum(right).alias("right"), F.count(F.lit(1)).alias("n")).first()
    trust = ((rate["right"] or 0) / THOUSAND + 9) / ((rate["n"] or 0) + 10)

    joined = found.join(host_priors(found, n), ["host", "domain", "suffix"])
    share = [F.lit(1.0 / n)] * n
    for level in ("all", "suffix", "domain", "host"):
        own = [(F.col(f"{level}_e{i}") - F.col(f"e{i}")) / THOUSAND for i in range(n)]
        total = sum(own[1:], own[0])
        step = {f"{level}_p{i}": (o + STRENGTH * s) / (total + STRENGTH) for i, (o, s) in enumerate(zip(own, share, strict=True))}
        joined = joined.withColumns(step)
        share = [F.col(x) for x in step]
    wrong = (1 - trust) / max(1, n - 1)
    declared = [F.when(F.col("declared").isin(*languages), F.when(g, F.lit(float(np.log(trust)))).otherwise(float(np.log(max(wrong, 1e-6))))).otherwise(0.0) for g in given]
    scores = {f"s{i}": ll[i] + declared[i] + F.log(share[i]) for i in range(n)}
    kept_ll = {f"l{i}": x for i, x in enumerate(ll)}
    joined = stored(joined.withColumns({**scores, **kept_ll}).select(*keys, "letters", *scores, *kept_ll), "language-scores")
    ll = [F.col(x) for x in kept_ll]
    joined = joined.withColumns({f"q{i}": p for i, p in enumerate(_softmax([F.col(s) for s in scores]))})

    def best(values: list[Column]) -> Column:
        top = F.greatest(*values) if n > 1 else values[0]
        out = F.lit(languages[-1])
        for x, v in list(zip(languages, values, strict=True))[-2::-1]:
            out = F.when(v == top, F.lit(x)).otherwise(out)
        return F.when(F.col("letters") > 0, out).otherwise("und")

    q = [F.col(f"q{i}") for i in range(n)]
    posterior = F.when(F.col("letters") > 0, F.round(F.greatest(*q) if n > 1 else q[0], 6)).otherwise(0.0)
    return joined.select(
        *keys, best(q).alias("lang"), posterior.alias("posterior"), best(ll).alias("text_lang"), ((F.col("letters") > 0) & (posterior >= least)).alias("kept")
    )


def from_documents(docs: DataFrame, *keys: Column) -> DataFrame:
    """Evidence of documents: their declared language, and the source in place of a host."""
    source = F.col("source").cast("string")
    return docs.select(
        *keys, primary("lang").alias("declared"), source.alias("host"), source.alias("domain"), F.lit("").alias("suffix"), F.col("text").cast("string").alias("text")
    )


def from_pages(pages: DataFrame, *keys: Column) -> DataFrame:
    """Evidence of web pages: text of all articles (or of the page), language of the markup, host, domain and suffix of the address."""
    html = F.col("html").cast("string")
    article = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<(article|main)\b[^>]*>(.*?)</\1>"), F.lit(2)), " ")
    body = F.regexp_replace(F.when(article != "", article).otherwise(html), r"(?is)<(script|style|head|nav)\b[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), "&#?[A-Za-z0-9]+;", " ")
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.select(
        *keys, declared.alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), text.alias("text")
    )
