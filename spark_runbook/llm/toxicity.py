"""Toxicity by a classifier chain.

Categories are predicted in order; each linear model sees the hashed features of the document and the log-odds of the categories
before it. While training, those are out-of-fold predictions, so a later model learns how far an earlier one can be trusted on
documents it hasn't seen. Features are the presence of words and of five-byte word beginnings (A-Z as a-z); the most telling ones
are picked by a likelihood ratio over the labelled sample.

The models are fitted on a sample of at most ``SAMPLE`` labelled documents (all of them if there are fewer), chosen by a hash of the id; every
document is scored, over its whole text. The sample's features and the models are all that the driver holds.

Defined results: null and empty texts are scored by the intercepts; several labels of one id count as their maximum; a category without
positive or without negative labels is predicted as its constant; null ids are scored, not trained on; repeated rows are scored one by one; empty
tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, renamed, small_batches, text_or_empty
from .shingles import _VALUE, chunks, hashed_runs, joined, mix, powers

SAMPLE, FEATURES, FOLDS = 20_000, 2048, 4
#: Features that chance alone may explain aren't used: half of the likelihood ratio statistic.
LEAST_GAIN = 8.0
PREFIX = 5
#: A threshold that no score reaches.
NEVER = 2.0
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the distinct hashes of its words and word beginnings."""
    data, first = joined(texts)
    word, start, n = hashed_runs(data, _WORD)
    s = start[n > PREFIX]
    begin = np.zeros(len(s), np.uint64)
    with np.errstate(over="ignore"):
        for k, p in enumerate(powers(PREFIX)[0]):
            begin += _VALUE[data[s + k]] * p
    word, begin = mix(word, 3), mix(begin, 4)
    a, b = np.searchsorted(start, first), np.searchsorted(s, first)
    return [np.unique(np.concatenate([word[a[i] : a[i + 1]], begin[b[i] : b[i + 1]]])) for i in range(len(texts))]


@dataclass
class Sparse:
    """Rows of column numbers (all values 1) and some dense columns behind them."""

    rows: np.ndarray
    cols: np.ndarray
    n: int
    width: int
    dense: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n) + self.dense @ w[self.width :]

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.cols, g[self.rows], self.width), self.dense.T @ g])

    def take(self, keep: np.ndarray) -> Sparse:
        at = np.cumsum(keep) - 1
        m = keep[self.rows]
        return Sparse(at[self.rows[m]], self.cols[m], int(keep.sum()), self.width, self.dense[keep])

    def plus(self, column: np.ndarray) -> Sparse:
        return Sparse(self.rows, self.cols, self.n, self.width, np.column_stack([self.dense, column]))


def fit_logistic(x: Sparse, y: np.ndarray, l2: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights by L-BFGS on the penalised log-loss; the last dense column is the intercept's and isn't penalised."""
    size = x.width + x.dense.shape[1]
    pen = np.full(size, l2)
    pen[x.width] = 0  # the intercept is the first dense column

    def value(w):
        z = x.dot(w)
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(pen * w * w), x.back(1 / (1 + np.exp(-z)) - y) + pen * w

    w = np.zeros(size)
    if len(y) == 0 or y.min() == y.max():
        w[x.width] = 12.0 if len(y) and y[0] else -12.0
        return w
    f, g = value(w)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, a = g.copy(), []
        for s, t in reversed(memory):
            a.append(s @ d / (s @ t))
            d -= a[-1] * t
        if memory:
            s, t = memory[-1]
            d *= (s @ t) / (t @ t)
        for (s, t), b in zip(memory, reversed(a), strict=True):
            d += s * (b - t @ d / (s @ t))
        step = 1.0 if memory else 1.0 / max(1.0, np.abs(g).sum())
        while True:
            new = w - step * d
            fn, gn = value(new)
            if fn <= f - 1e-4 * step * (g @ d) or step < 1e-8:
                break
            step /= 2
        if (s := new - w) @ (t := gn - g) > 1e-12:
            memory = [*memory[-9:], (s, t)]
        done = f - fn < 1e-6 * max(1, abs(f))
        w, f, g = new, fn, gn
        if done:
            break
    return w


@dataclass
class Chain:
    categories: list[str]
    ids: np.ndarray  # sorted feature hashes
    weights: list[np.ndarray]  # features, intercept, log-odds of the categories before
    thresholds: list[float]

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities, one row a text, one column a category."""
        feats = features(texts)
        at = [np.searchsorted(self.ids, f) for f in feats]
        hit = [np.flatnonzero(self.ids[np.minimum(a, len(self.ids) - 1)] == f) if len(self.ids) else np.zeros(0, int) for a, f in zip(at, feats, strict=True)]
        cols = np.concatenate([a[h] for a, h in zip(at, hit, strict=True)]).astype(np.int64)
        rows = np.repeat(np.arange(len(texts)), [len(h) for h in hit])
        x = Sparse(rows, cols, len(texts), len(self.ids), np.ones((len(texts), 1)))
        out = []
        for w in self.weights:
            z = x.dot(w)
            out.append(1 / (1 + np.exp(-z)))
            x = x.plus(np.clip(z, -8, 8))
        return np.column_stack(out)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1; ties go to the middle of the gap. Where no cut does better than calling everything positive, the scores tell nothing, and nothing is called so."""
    if not len(y) or y.max() == 0:
        return NEVER
    o = np.argsort(-p)
    tp = np.cumsum(y[o])
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[o][:-1] == p[o][1:]] = -1  # equal scores fall on one side
    i = int(np.argmax(f1))
    if f1[i] <= f1[-1]:
        return NEVER
    return float((p[o][i] + p[o][i + 1]) / 2)


def train_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, width: int = FEATURES, folds: int = FOLDS) -> Chain:
    """categories: name to a 0/1 column of labels, in the chain's order."""
    small_batches(docs.sparkSession)
    names = list(categories)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(c.cast("int")).alias(n) for n, c in categories.items()))
    total = known.count()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    if total > sample:
        known = known.where(order < int((1 << 30) * (sample / total) * 0.98))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")  # at most about `sample` labels

    @give_back
    def featurise(batches):
        for b in batches:
            for first, texts in chunks(b.column(1)):
                fs = [f.view(np.int64) for f in features(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(fs)), *(b.column(2 + i).slice(first, len(fs)) for i in range(len(names))), pa.array(fs, pa.list_(pa.int64()))], names=["doc_id", *names, "f"])

    fields = ", ".join(["doc_id long", *(f"`{n}` int" for n in names), "f array<long>"])
    made = rows.select("doc_id", "text", *names).mapInArrow(featurise, fields)

    made = cut(made)
    sums = made.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first()
    per = made.select(*names, F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("c"), *(F.sum(n).alias(n) for n in names)).where("c >= 3")

    def gain(n: str) -> Column:  # likelihood ratio of the feature and the category
        total, yes = float(sums["n"]), float(sums[n])
        cell = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
        a, c = F.col(n).cast("double"), F.col("c").cast("double")
        return cell(a, c * yes / total) + cell(c - a, c * (total - yes) / total) + cell(yes - a, (total - c) * yes / total) + cell(total - yes - c + a, (total - c) * (total - yes) / total)

    live = [n for n in names if 0 < (sums[n] or 0) < sums["n"]]
    ids = np.zeros(0, np.uint64)
    if live:
        best = [r["f"] for n in live for r in per.select("f", gain(n).alias("g")).where(F.col("g") >= LEAST_GAIN).orderBy(F.desc("g"), "f").limit(width // len(live)).collect()]
        ids = np.unique(np.array(best, np.int64).view(np.uint64))
    fold_of = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(folds)).cast("int").alias("fold")

    def number(batches):
        for b in batches:
            out = []
            for f in b.column(0):
                f = f.values.to_numpy().view(np.uint64)
                at = np.searchsorted(ids, f)
                out.append(at[ids[np.minimum(at, len(ids) - 1)] == f].astype("<i4").tobytes() if len(ids) else b"")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *b.columns[1:]], names=["f", *names, "fold"])

    # the sample, as column numbers of the chosen features
    local = made.select("f", *names, fold_of).mapInArrow(number, ", ".join(["f binary", *(f"`{n}` int" for n in names), "fold int"])).toPandas()
    cols = np.frombuffer(b"".join(local["f"]), "<i4").astype(np.int64)
    x = Sparse(np.repeat(np.arange(len(local)), [len(f) // 4 for f in local["f"]]), cols, len(local), len(ids), np.ones((len(local), 1)))
    local = local.drop(columns="f")
    fold, weights, cuts = local["fold"].to_numpy(), [], []
    for n in names:
        y = local[n].to_numpy(np.float64)
        held = np.zeros(len(local))
        for k in range(folds):
            away = fold != k
            held[~away] = x.take(~away).dot(fit_logistic(x.take(away), y[away]))
        weights.append(fit_logistic(x, y))
        cuts.append(best_threshold(1 / (1 + np.exp(-held)), y))
        x = x.plus(np.clip(held, -8, 8))
    return Chain(names, ids, weights, cuts)


def score_documents(docs: DataFrame, chain: Chain, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, with p_<category> and is_<category>."""
    small_batches(docs.sparkSession)
    keep = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @give_back
    def run(batches):
        c = shared.value
        for b in batches:
            last = b.num_columns - 1
            for first, texts in chunks(b.column(last)):
                p = c.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(first, len(texts)) for i in range(last)), *(pa.array(p[:, i]) for i in range(p.shape[1])), *(pa.array(p[:, i] >= t) for i, t in enumerate(c.thresholds))],
                    names=[*keep, *(f"p_{n}" for n in c.categories), *(f"is_{n}" for n in c.categories)],
                )

    added = [f"p_{n}" for n in chain.categories] + [f"is_{n}" for n in chain.categories]
    keep = [c for c in keep if c not in added]
    src = docs.select(*keep, text_or_empty(text_col).alias("__text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in src.dtypes[:-1]), *(f"`p_{n}` double" for n in chain.categories), *(f"`is_{n}` boolean" for n in chain.categories)])
    return src.mapInArrow(run, schema)


def document_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain of the labels table: low quality, then toxic."""
    return train_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}, sample)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; same columns, whatever their names."""
    plain, (i, t), restore = renamed(docs, "doc_id", "text")
    return restore(score_documents(plain, document_chain(docs, labels), keep=plain.columns, id_col=i, text_col=t).where(~F.col("is_toxic")))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_documents(docs, document_chain(docs, labels))
    return out.select("doc_id", F.round("p_low_quality", 6).alias("p_low_quality"), F.round("p_toxic", 6).alias("p_toxic"), "is_low_quality", F.col("is_toxic").alias("toxic"))
