"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Statistics of each text are plain columns. Shallow boosted trees over the statistics of a labelled sample give paths, each
path is a conjunctive rule, lasso logistic regression keeps few of them with a weight each, and the weighted rules become
one column expression, so that scoring never leaves the JVM and needs no shuffle.

Only fitting is bounded: at most SAMPLE_ROWS labelled documents, chosen by hash of doc_id; their statistics cover whole
texts. The penalty is the largest whose held-out loss is within a tenth of the best one's.

Defined results: null texts have the statistics of an empty text; without both classes among the labels every document
scores 1; a doc_id with several labels counts by its lowest quality; null labels are ignored. Repeated rows score
alike, and a probability equal to the threshold is kept. Very long texts count whole. Extra columns are carried through untouched, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashed_classifier import labelled_sample

SAMPLE_ROWS = 4000
THRESHOLD = 0.5
TREES, DEPTH, BINS = 40, 3, 32
STATISTICS = ("chars", "words", "word_chars", "upper", "digits", "symbols", "points", "distinct_words", "repeated", "lines", "line_chars", "distinct_lines")


def with_statistics(docs: DataFrame, columns: list[str], out: str) -> DataFrame:
    """The columns named and a struct of statistics. The generator keeps Catalyst from repeating the costly parts in every rule."""
    text, n, found, lines = (common.fresh(docs, c) for c in ("t_", "n_", "w_", "l_"))
    base = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    base = base.select(*columns, text, F.length(text).alias(n), F.split(F.trim(text), r"\s+").alias(found), F.split(text, "\n").alias(lines))
    chars, count = F.greatest(F.col(n), F.lit(1)).cast("double"), F.size(found).cast("double")

    def share(pattern: str) -> Column:
        return (F.col(n) - F.length(F.regexp_replace(text, pattern, ""))) / chars

    stats = {
        "chars": F.col(n).cast("double"),
        "words": count,
        "word_chars": F.col(n) / count,
        "upper": share(r"\p{Lu}+"),
        "digits": share("[0-9]+"),
        "symbols": share(r"[!#$%&*+<=>@^_`{|}~\\/\[\]]+"),
        "points": share("[.,;:?]+"),
        "distinct_words": F.size(F.array_distinct(found)) / count,
        "repeated": share(r"(?<!\S)(\S+)(?= \1(?!\S))"),
        "lines": F.size(lines).cast("double"),
        "line_chars": F.col(n) / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }
    struct = F.struct(*[stats[k].alias(k) for k in STATISTICS])
    return base.withColumn(out, F.explode(F.array(struct))).select(*columns, out)


Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: Rule, depth: int, rules: set[Rule], out: np.ndarray) -> None:
    """Grow one node on the rows, note the path of every node, and write the leaf values to out."""
    if path:
        rules.add(path)
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-3, None)
    if depth and len(rows) >= 20:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            gs = np.cumsum(np.bincount(bins[rows, j], grad[rows], len(c) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins[rows, j], hess[rows], len(c) + 1))[:-1]
            ns = np.cumsum(np.bincount(bins[rows, j], minlength=len(c) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < 5) | (len(rows) - ns < 5)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, k))
    if best[1] is None:
        out[rows] = -g / (h + 1)
        return
    j, k = best[1]
    left = bins[rows, j] <= k
    for low, part in ((True, rows[left]), (False, rows[~left])):
        _tree(x, cuts, bins, grad, hess, part, (*path, (j, low, float(cuts[j][k]))), depth - 1, rules, out)


def _simplify(rule: Rule) -> Rule:
    """At most one bound a side of each statistic."""
    tight: dict[tuple[int, bool], float] = {}
    for j, low, cut in rule:
        tight[j, low] = cut if (j, low) not in tight else (min if low else max)(tight[j, low], cut)
    return tuple(sorted((j, low, cut) for (j, low), cut in tight.items()))


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3) -> list[Rule]:
    """The distinct paths of boosted trees."""
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        inner = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(values) > BINS else (values[:-1] + values[1:]) / 2
        cuts.append(inner[inner < values[-1]] if len(values) > 1 else inner[:0])
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    rng, score, rules = np.random.default_rng(seed), np.zeros(len(y)), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        if len(rows) < 20:
            rows = np.arange(len(y))
        grad, hess, out = weight * (p - y), weight * p * (1 - p), np.zeros(len(y))
        grown: set[Rule] = set()
        _tree(x, cuts, bins, grad, hess, rows, (), DEPTH, grown, out)
        rules |= {_simplify(r) for r in grown}
        score += 0.3 * out
    return sorted(rules)


def applies(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float64)
    for k, rule in enumerate(rules):
        for j, low, cut in rule:
            out[:, k] *= (x[:, j] <= cut) if low else (x[:, j] > cut)
    return out


def lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: tuple[np.ndarray, float], steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    w, bias = start[0].copy(), start[1]
    weight = weight / weight.sum()
    v, vb, t = w.copy(), bias, 1.0
    a = np.c_[r, np.ones(len(r))] * np.sqrt(weight)[:, None]
    q = np.ones(a.shape[1])
    for _ in range(20):  # the largest curvature bounds the step
        q = a.T @ (a @ q)
        q /= np.linalg.norm(q) + 1e-12
    step = 1 / (0.25 * float(q @ (a.T @ (a @ q))) * 1.05 + 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(r @ v + vb, -50, 50)))
        g = weight * (p - y)
        new = v - step * (r.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = vb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = new, nb, nt
    return w, float(bias)


@dataclass
class Model:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def probability(self, stat: str) -> Column:
        """The rules as one column expression over the struct of statistics."""
        z = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights):
            hit = F.lit(True)
            for j, low, cut in rule:
                value = F.col(f"{stat}.{STATISTICS[j]}")
                hit = hit & (value <= F.lit(cut) if low else value > F.lit(cut))
            z = z + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(applies(self.rules, x) @ np.array(self.weights) + self.bias)))


def fit(x: np.ndarray, quality: np.ndarray) -> Model | None:
    """The sparse rule model of the rows given, None without both classes. Every fourth row only chooses the penalty."""
    y = (np.asarray(quality) > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    held = np.arange(len(y)) % 4 == 0 if len(y) >= 40 else np.zeros(len(y), bool)
    if y[~held].min() == y[~held].max():
        held[:] = False
    judge = held if held.any() else ~held
    pos = y[~held].mean()
    weight = np.where(y > 0, 0.5 / pos, 0.5 / (1 - pos))
    rules = tree_rules(x[~held], y[~held], weight[~held])
    if not rules:
        return None
    r = applies(rules, x)
    path, at = [], (np.zeros(len(rules)), 0.0)
    for penalty in np.geomspace(0.1, 1e-4, 10):
        at = lasso(r[~held], y[~held], weight[~held], penalty, at)
        z = r[judge] @ at[0] + at[1]
        path.append((float(np.average(np.logaddexp(0, z) - y[judge] * z, weights=weight[judge])), at))
    best = min(p[0] for p in path)
    w, bias = next(p[1] for p in path if p[0] <= best * 1.1 + 1e-4)
    some = np.flatnonzero(np.abs(w) > 1e-6)
    return Model([rules[k] for k in some], [float(w[k]) for k in some], bias)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    sample = with_statistics(labelled_sample(docs, labels, rows), ["doc_id", "quality"], "s").select("doc_id", "quality", "s.*").toPandas()
    sample = sample.sort_values(["doc_id", *STATISTICS], kind="stable").sample(frac=1.0, random_state=11)
    return fit(sample[list(STATISTICS)].to_numpy(float), sample["quality"].to_numpy())


def score(docs: DataFrame, model: Model | None, out: str, columns: list[str] | None = None) -> DataFrame:
    """docs (or only the columns named) with the probability of good quality in the column out."""
    columns = columns or docs.columns
    if model is None:
        return docs.select(*columns, F.lit(1.0).alias(out))
    stat = common.fresh(docs, "s_")
    return with_statistics(docs, columns, stat).select(*columns, model.probability(stat).alias(out))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose probability of good quality is at least the threshold; all columns stay."""
    out = common.fresh(docs, "p_quality")
    return score(docs, train(docs, labels), out).filter(F.col(out) >= threshold).select(*docs.columns)


def opquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, p_quality, keep) of the documents that the classifier keeps."""
    docs = common.need(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, "p_quality", ["doc_id"]).filter(F.col("p_quality") >= THRESHOLD).withColumn("keep", F.lit(True))
