"""Toxicity by a chain of linear classifiers.

Categories are predicted in order. Each is a logistic regression on tokens (whole
words, and the first six bytes of longer ones, each as "occurs" and "occurs
again") plus the log-odds of all earlier categories. The earlier probabilities that a
later model is trained on are out of fold: a row gets them from models that did not
see it, so training looks like use.

Fitting reads at most about ``FIT_ROWS`` labelled rows, drawn by a hash of doc_id; all
labelled rows are used when there are fewer. Token counts per category and the choice
of ``TOKENS`` tokens are Spark aggregates; the driver gets only the chosen tokens of
the sampled rows. Scoring is one pass over all documents with the model broadcast
(``TOKENS`` weights a category), without a shuffle.

Cases: a null or empty text has no tokens and gets the base rate; labels without a
doc_id, and null values of a category, are left out of its model; several label rows
of one document count once, the largest value wins; without labels of both values a
model predicts their (smoothed) share; without any labels nothing is toxic; input
columns named like results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import _BYTE, LETTERS, Scratch, mix, ranges_hash, with_columns, words

FIT_ROWS = 20_000
TOKENS = 4096
FOLDS = 3
BITS = 22
PREFIX = 6
LIMIT = 0.5
CLEAR = 10.8  # of chi-square: a token's tie to a category that chance gives once in a thousand


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The token of every word and long word's beginning, and the text it is in."""
    found = words(texts, LETTERS)
    owner = np.repeat(np.arange(len(texts)), np.diff(found.first))
    long = found.ends - found.starts > PREFIX
    begun = mix(ranges_hash(_BYTE[found.data], found.starts[long], found.starts[long] + PREFIX) + np.uint64(1))
    ids = np.concatenate([found.hashes(), begun]) >> np.uint64(64 - BITS)
    return ids.astype(np.int64), np.concatenate([owner, owner[long]])


def _features(texts: pa.Array) -> list[pa.Array]:
    """Each text's distinct tokens, as 2 * token, plus 1 if it occurs again."""
    ids, owner = tokens(texts)
    keys, counts = np.unique((owner << BITS) | ids, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1) << BITS)
    values = 2 * (keys & ((1 << BITS) - 1)) + (counts > 1)
    return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))]


@dataclass
class Linear:
    """Weights of the chosen tokens (occurs, occurs again), of earlier log-odds, and the constant."""

    token: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    categories: list[str]
    chosen: np.ndarray
    models: list[Linear] = field(default_factory=list)


class Rows:
    """A sparse 0/1 matrix by rows, with dense columns beside it."""

    def __init__(self, columns: list[np.ndarray], width: int) -> None:
        self.n, self.width = len(columns), width
        sizes = np.array([len(c) for c in columns], np.int64)
        self.columns = np.concatenate(columns).astype(np.int64) if columns else np.zeros(0, np.int64)
        self.rows = np.repeat(np.arange(self.n), sizes)

    def take(self, rows: np.ndarray) -> Rows:
        new = Rows([], self.width)
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        kept = place[self.rows] >= 0
        new.n, new.columns, new.rows = len(rows), self.columns[kept], place[self.rows[kept]]
        return new

    def dot(self, model: Linear, earlier: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, model.token[self.columns], self.n) + earlier @ model.earlier + model.bias


def fit_linear(x: Rows, earlier: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 200) -> Linear:
    """Logistic regression with a quadratic penalty, by accelerated gradients scaled per column."""
    w, e = np.zeros(x.width), np.zeros(earlier.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 1e-6
    model = Linear(w, e, float(np.log(rate / (1 - rate))))
    if not 0 < y.sum() < len(y):
        return model
    per_row = np.bincount(x.rows, minlength=x.n) + np.abs(earlier).sum(axis=1) + 1.0
    scale_w = 0.25 * np.bincount(x.columns, per_row[x.rows], x.width) + penalty
    scale_e = 0.25 * (np.abs(earlier) * per_row[:, None]).sum(axis=0) + penalty
    scale_b = 0.25 * per_row.sum()
    at, t = model, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x.dot(at, earlier), -40, 40))) - y
        new = Linear(
            at.token - (np.bincount(x.columns, error[x.rows], x.width) + penalty * at.token) / scale_w,
            at.earlier - (earlier.T @ error + penalty * at.earlier) / scale_e,
            at.bias - error.sum() / scale_b,
        )
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        k = (t - 1) / t_new
        at = Linear(*[getattr(new, a) + k * (getattr(new, a) - getattr(model, a)) for a in ("token", "earlier", "bias")])
        model, t = new, t_new
    return model


def fit_chain(x: Rows, labels: np.ndarray, fold: np.ndarray, chain: Chain) -> Chain:
    """Fit one model a category; ``labels`` holds nan where a label is missing."""
    earlier = np.zeros((x.n, 0))
    for k in range(labels.shape[1]):
        known = ~np.isnan(labels[:, k])
        odds = np.zeros(x.n)
        for f in range(FOLDS):
            rows, out = np.flatnonzero(known & (fold != f)), np.flatnonzero(fold == f)
            part = fit_linear(x.take(rows), earlier[rows], labels[rows, k])
            odds[out] = x.take(out).dot(part, earlier[out])
        rows = np.flatnonzero(known)
        chain.models.append(fit_linear(x.take(rows), earlier[rows], labels[rows, k]))
        earlier = np.column_stack([earlier, np.clip(odds, -10, 10) / 10])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, n_tokens: int = TOKENS) -> Chain:
    """Fit a chain; ``categories`` maps each category, in order, to an expression on labels that is 1, 0 or null."""
    scratch = Scratch(docs.sparkSession)
    names = list(categories)
    own = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(*[F.max(F.expr(e).cast("double")).alias(f"y{k}") for k, e in enumerate(categories.values())])
    own = own.withColumn("__h", F.xxhash64("__id", F.lit(3)))
    n = own.count()
    share = min(1.0, fit_rows / n) if n else 0.0
    if share < 1:
        own = own.filter(F.col("__h") < int(-(2**63) + share * (2**64 - 2)))
    joined = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(own), "__id")
    ys = [f"y{k}" for k in range(len(names))]
    one = F.min(F.struct(F.xxhash64("text"), "text")).getField("text")
    joined = joined.groupBy("__id", "__h", *ys).agg(one.alias("text"))  # one row a doc_id, so at most about fit_rows rows
    sample = scratch.store(with_columns(joined, "text", "tokens array<int>", _features).drop("text"), "toxicity-sample")
    flat = sample.select(*[f"y{k}" for k in range(len(names))], F.explode("tokens").alias("t")).withColumn("again", F.col("t") % 2).withColumn("token", F.floor(F.col("t") / 2))
    sums, scores = [F.count("*").alias("n"), F.sum("again").alias("n_again")], []
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(f"y{k}").alias(f"y{k}") for k in range(len(names))]).first()
    for k in range(len(names)):
        rate = (totals[f"y{k}"] or 0.0) / max(totals["n"], 1)
        sums += [F.sum(f"y{k}").alias(f"p{k}"), F.sum(F.col(f"y{k}") * F.col("again")).alias(f"q{k}")]
        if 0 < rate < 1:
            for hit, seen in ((f"p{k}", "n"), (f"q{k}", "n_again")):
                gap = F.coalesce(F.col(hit), F.lit(0.0)) - F.lit(rate) * F.col(seen)
                scores.append(gap * gap / (F.col(seen) * F.lit(rate * (1 - rate)) + 1.0))
    chosen: list[int] = []
    if scores:
        best = flat.groupBy("token").agg(*sums).filter("n >= 3").select("token", F.greatest(*scores, F.lit(0.0)).alias("s"))
        chosen = sorted(r.token for r in best.filter(F.col("s") > CLEAR).orderBy(F.desc("s"), "token").limit(n_tokens).collect())
    chain = Chain(names, np.array(chosen, np.int64))

    def compact(lists: pa.Array) -> pa.Array:
        place = _places(chain.chosen)
        values = lists.flatten().to_numpy().astype(np.int64)
        at = place[values >> 1]
        lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        owner = np.repeat(np.arange(len(lists)), lengths)[at >= 0]
        bounds = np.searchsorted(owner, np.arange(len(lists) + 1))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array((2 * at + (values & 1))[at >= 0], pa.int32()))

    columns = F.arrow_udf(compact, ArrayType(IntegerType()))(F.col("tokens"))
    rows = sample.select(columns.alias("columns"), *[f"y{k}" for k in range(len(names))], F.pmod("__h", F.lit(FOLDS)).alias("fold")).toArrow()
    ys = [rows.column(f"y{k}").to_numpy().astype(float) for k in range(len(names))]
    x = Rows([np.array(c, np.int64) for c in rows.column("columns").to_pylist()], 2 * len(chosen))
    return fit_chain(x, np.column_stack(ys), rows.column("fold").to_numpy().astype(np.int64), chain)


def _places(chosen: np.ndarray) -> np.ndarray:
    """Where each token stands among the chosen ones, or -1."""
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    return place


def predict(texts: pa.Array, chain: Chain, place: np.ndarray) -> np.ndarray:
    """Probabilities, one column per category."""
    ids, owner = tokens(texts)
    at = place[ids]
    keys, counts = np.unique((owner[at >= 0] << BITS) | at[at >= 0], return_counts=True)
    x = Rows([], 2 * len(chain.chosen))
    x.n, x.rows, x.columns = len(texts), keys >> BITS, 2 * (keys & ((1 << BITS) - 1)) + (counts > 1)
    earlier, out = np.zeros((x.n, 0)), []
    for model in chain.models:
        odds = x.dot(model, earlier)
        out.append(1 / (1 + np.exp(-np.clip(odds, -40, 40))))
        earlier = np.column_stack([earlier, np.clip(odds, -10, 10) / 10])
    return np.column_stack(out)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Add p_<category> for every category of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    held: dict[str, np.ndarray] = {}

    def work(texts: pa.Array) -> list[pa.Array]:
        if "place" not in held:
            held["place"] = _places(shared.value.chosen)
        return [pa.array(c, pa.float64()) for c in predict(texts, shared.value, held["place"]).T]

    return with_columns(docs, text, ", ".join(f"`p_{c}` double" for c in chain.categories), work)


# What the labels table offers, from the milder to the graver; the last decides.
CATEGORIES = {"poor": "1 - quality", "toxic": "toxic"}


def judge(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, limit: float = LIMIT, text: str = "text") -> DataFrame:
    """Add p_<category> and ``rejected``: the last category's probability is at least ``limit``."""
    scored = score(docs, train(docs, labels, categories, text=text), text)
    return scored.withColumn("rejected", F.col(f"p_{list(categories)[-1]}") >= limit)
