"""Language of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over the languages of a labelled corpus:
the text (a character trigram model), the language the markup declares, the suffix of
the address, and the language habits of the host.

1. The text model counts hashed trigrams per language over all labelled documents.
2. Posteriors from text alone give, by grouped aggregation over all pages, how often a
   declaration or a suffix goes with each language, and each host's and domain's
   language counts.
3. A page's prior is its host's counts without the page itself, smoothed towards its
   domain's, which are smoothed towards the corpus's. Prior, text, declaration and
   suffix are multiplied.

Scale: the model holds ``GRAMS`` numbers a language, and every label is a language. Up
to ``LANGUAGES`` of them are in memory at a time; more take a further pass over the
pages each, which are written again with what was found so far. Declarations and suffixes are
cut to short codes and their table joins like any other. Hosts are aggregated with
map-side sums over a few numbers per page and joined back without being grouped, so a
host with a third of all pages is split by adaptive execution. Page texts are read
once for every ``LANGUAGES`` languages and never shuffled.

Cases: null or empty html has no text evidence, and the rest decides; a null or odd
address has an empty host, domain and suffix, which stands for all such pages; pages without any
evidence get the corpus's most common language; repeated pages each count; without
labelled documents there are no languages, and no rows; other columns are dropped.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _LOWER, Scratch, mix, text_bytes, with_columns

GRAMS = 1 << 16
LANGUAGES = 64  # in one block of the model
WEIGHT = 0.2  # trigrams overlap and repeat, so their evidence counts in part
STRENGTH = 4.0  # pages that the wider level is worth
_DROPPED = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3})\b""")


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of bytes within each text, in lower case, and the text each is in."""
    data, bounds = text_bytes(texts)
    codes = _BYTE[_LOWER[data]]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolled = mix(codes[:-2] + codes[1:-1] * np.uint64(3) + codes[2:] * np.uint64(9))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    inside = owner[:-2] == owner[2:]
    return (rolled[inside] % np.uint64(GRAMS)).astype(np.int64), owner[:-2][inside]


def _counted(texts: pa.Array) -> list[pa.Array]:
    ids, owner = grams(texts)
    keys, counts = np.unique(owner * GRAMS + ids, return_counts=True)
    bounds = pa.array(np.searchsorted(keys, np.arange(len(texts) + 1) * GRAMS), pa.int32())
    return [pa.ListArray.from_arrays(bounds, pa.array(keys % GRAMS, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(counts, pa.int64()))]


def visible(page: str) -> str:
    """The text of a page without markup, scripts and styles."""
    return html.unescape(_TAG.sub(" ", _DROPPED.sub(" ", page)))


def train(docs: DataFrame, scratch: Scratch, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray, DataFrame]:
    """Languages, log-shares of languages, and counts of trigrams per language (lang, g, n)."""
    labelled = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    counted = with_columns(labelled, "text", "g array<int>, n array<bigint>", _counted).drop("text")
    sums = counted.select("lang", F.explode(F.arrays_zip("g", "n")).alias("x")).groupBy("lang", "x.g").agg(F.sum("x.n").alias("n"))
    shares = np.array([sizes[x] for x in names], float)
    return names, np.log(shares / max(shares.sum(), 1.0)), scratch.store(sums, "langid-grams")


def block(sums: DataFrame, names: list[str]) -> np.ndarray:
    """Log-probabilities of trigrams, a column per language."""
    table, place = np.full((GRAMS, len(names)), 0.5), {x: k for k, x in enumerate(names)}
    for row in sums.filter(F.col("lang").isin(names)).toLocalIterator(prefetchPartitions=True):  # at most GRAMS rows a language
        table[row.g, place[row.lang]] += row.n
    return np.log(table / table.sum(axis=0))


def evidence(pages: DataFrame, table: np.ndarray, page_html: str = "html") -> DataFrame:
    """Add ``declared`` and ``more``, the text's log-likelihood per language of a block."""
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def work(values: pa.Array) -> list[pa.Array]:
        table = shared.value
        raw = [x or "" for x in values.to_pylist()]
        declared = [m.group(1).lower() if (m := _DECLARED.search(x)) else None for x in raw]
        ids, owner = grams(pa.array([visible(x) for x in raw], pa.large_string()))
        sums = [np.bincount(owner, table[ids, k], len(raw)) for k in range(table.shape[1])]
        return [pa.array(declared, pa.string()), pa.array(list(WEIGHT * np.column_stack(sums)), pa.list_(pa.float64()))]

    return with_columns(pages, page_html, "declared string, more array<double>", work)


def _softmax(logs: Column) -> Column:
    raised = F.transform(F.array(F.array_max(logs)), lambda top: F.transform(logs, lambda x: F.exp(x - top)))[0]
    return F.transform(F.array(raised), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]


def identify(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", page_html: str = "html") -> DataFrame:
    """page_id, host, suffix, declared, language, probability."""
    spark = pages.sparkSession
    learned, scratch = Scratch(spark), Scratch(spark)
    names, shares, sums = train(docs, learned)
    ids = dict(pages.select(F.col(page_id).alias("page_id")).dtypes)["page_id"]
    if not names:
        return spark.createDataFrame([], f"page_id {ids}, host string, suffix string, declared string, language string, probability double")
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    found = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), F.col(page_html).alias("html"), F.array().cast("array<double>").alias("loglik"))
    for lo in range(0, len(names), LANGUAGES):
        found = found if not lo else scratch.store(found, "langid-pages")
        scratch.free(keep=1)
        found = evidence(found, block(sums, names[lo : lo + LANGUAGES])).withColumn("loglik", F.concat("loglik", "more")).drop("more")
    found = found.drop("html")
    found = found.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    found = found.withColumn("text_only", _softmax(F.transform("loglik", lambda x, i: x + F.array(*map(F.lit, shares.tolist()))[i])))
    found = scratch.store(found, "langid-evidence")

    def counts(keys: list[str], name: str) -> DataFrame:
        sums = [F.sum(F.col("text_only")[k]) for k in range(len(names))]
        return found.groupBy(*keys).agg(F.array(*sums).alias(name))

    whole = found.agg(F.array(*[F.coalesce(F.sum(F.col("text_only")[k]), F.lit(0.0)) for k in range(len(names))])).first()[0]
    total = sum(whole)
    base = F.array(*[F.lit((w + s) / (total + 1.0)) for w, s in zip(whole, np.exp(shares).tolist(), strict=True)])
    all_ = F.array(*map(F.lit, whole))
    rows = found
    for key in ("host", "domain", "declared", "suffix"):
        side = counts([key], f"__{key}").withColumnRenamed(key, "__key")
        rows = rows.join(side, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")

    def level(counted: str, wider: Column) -> Column:
        n = F.aggregate(counted, F.lit(0.0), lambda a, b: a + b) - 1.0
        return F.transform(counted, lambda x, i: (F.greatest(x - F.col("text_only")[i], F.lit(0.0)) + STRENGTH * wider[i]) / (F.greatest(n, F.lit(0.0)) + STRENGTH))

    def tie(counted: str) -> Column:
        """How a declaration or suffix speaks for each language: its share of that language's other pages over its share of all."""
        n = F.aggregate(counted, F.lit(0.0), lambda a, b: a + b)
        return F.transform(counted, lambda x, i: F.log((F.greatest(x - F.col("text_only")[i], F.lit(0.0)) + STRENGTH * n / (total + 1.0)) / (all_[i] + STRENGTH) * (total + 1.0) / n))

    rows = rows.withColumn("__prior", level("__domain", base)).withColumn("__prior", level("__host", F.col("__prior")))
    rows = rows.withColumn("__tie", tie("__declared")).withColumn("__tie2", tie("__suffix"))
    logs = F.transform("loglik", lambda x, i: x + F.log(F.col("__prior")[i]) + F.when(F.col("declared").isNull(), 0.0).otherwise(F.col("__tie")[i]) + F.col("__tie2")[i])
    rows = rows.withColumn("__post", _softmax(logs))
    best = F.array_position("__post", F.array_max("__post")).cast("int")
    return rows.select("page_id", "host", "suffix", "declared", F.element_at(F.array(*map(F.lit, names)), best).alias("language"), F.array_max("__post").alias("probability"))
