"""Quality classification by a sparse rule ensemble.

Boosted shallow trees over text statistics are grown on a bounded sample of labelled rows. Every path from a root to a
node is a conjunctive rule; a lasso logistic regression weighs the rules, and the few with non-zero weight are compiled
into one Spark column expression. Scoring is thus a projection: no Python, no shuffle.

Defined results. A null text counts as an empty one; its statistics are 0 and it has a score like any other text. Very
long texts are read whole. Labels that are null are not learned from; repeated rows of labels, or of one document,
count once. Without labelled rows of both classes the score is the share of ones among them, 0.5 if there is none.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import thinned
from strandline.llm.line_rules import let, words_of


STATISTICS = (
    "log_chars", "log_words", "word_length", "symbols", "bars", "exclaims", "stops", "digits", "upper", "distinct",
    "distinct_root", "line_words", "same_lines",
)


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 12_000  # labelled rows at most: the bound of the training sample
    trees: int = 24
    depth: int = 3
    bins: int = 32
    rate: float = 0.3
    min_leaf: int = 20  # rows of a node, fewer in samples of under 800
    penalty: float = 0.002  # of the lasso, on the mean log loss
    steps: int = 600


def statistics(text: Column) -> Column:
    """Numbers of a text, a struct of doubles, all by built-in expressions; the text is split once."""
    t = F.coalesce(text, F.lit(""))
    parts = F.struct(t.alias("t"), words_of(t).alias("words"), F.split(t, "\n").alias("lines"))
    return let(parts, lambda x: _statistics(x["t"], x["words"], x["lines"]))


def _statistics(t: Column, words: Column, lines: Column) -> Column:
    n = F.length(t)
    n_words, n_lines = F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
    share = lambda found: found / F.greatest(n, F.lit(1))
    without = lambda chars: n - F.length(F.translate(t, chars, ""))
    distinct = F.size(F.array_distinct(words))
    found = {
        "log_chars": F.log1p(n.cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": n / n_words,
        "symbols": share(without("#*$%&<>@~^=+_{}[]\\")),
        "bars": share(without("|")),
        "exclaims": share(without("!?")),
        "stops": share(without(".,;:")),
        "digits": share(without("0123456789")),
        "upper": share(n - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))),
        "distinct": distinct / n_words,
        "distinct_root": distinct / F.sqrt(n_words.cast("double")),
        "line_words": F.size(words) / n_lines,
        "same_lines": 1 - F.size(F.array_distinct(lines)) / n_lines,
    }
    assert tuple(found) == STATISTICS
    return F.struct(*[c.cast("double").alias(k) for k, c in found.items()])


#: One test of a rule: statistic, whether it must be at most the bound (else above it), bound.
Test = tuple[str, bool, float]


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[float, list[Test]]] = field(default_factory=list)

    def column(self, stats: Column) -> Column:
        """The score as a Spark expression over a struct of statistics."""
        total = F.lit(self.bias)
        for weight, tests in self.rules:
            holds = F.lit(True)
            for name, at_most, bound in tests:
                holds = holds & ((stats[name] <= bound) if at_most else (stats[name] > bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, names: list[str], x: np.ndarray) -> np.ndarray:
        """The same score in numpy, for tests."""
        total = np.full(len(x), self.bias)
        for weight, tests in self.rules:
            total += weight * _holds(tests, names, x)
        return 1 / (1 + np.exp(-total))


def _holds(tests: list[Test], names: list[str], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, at_most, bound in tests:
        col = x[:, names.index(name)]
        out &= (col <= bound) if at_most else (col > bound)
    return out


def _grow(x, edges, names, gradient, hessian, settings: Settings) -> tuple[list[list[Test]], np.ndarray]:
    """A tree on the gradients: the path to each of its nodes, and each row's leaf value."""
    paths, value = [], np.zeros(len(x))
    todo: list[tuple[np.ndarray, list[Test]]] = [(np.arange(len(x)), [])]
    while todo:
        rows, path = todo.pop()
        g, h = gradient[rows], hessian[rows]
        best = (1e-6, None)
        if len(path) < settings.depth and len(rows) >= 2 * settings.min_leaf:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for j, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                side = np.searchsorted(cuts, x[rows, j], side="left")  # value <= cuts[k] for all k >= side
                gs, hs, ns = (np.bincount(side, w, len(cuts) + 1)[:-1].cumsum() for w in (g, h, np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(ns < settings.min_leaf) | (len(rows) - ns < settings.min_leaf)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, float(cuts[k])))
        if best[1] is None:
            value[rows] = -settings.rate * g.sum() / (h.sum() + 1)
            continue
        j, cut = best[1]
        low = x[rows, j] <= cut
        for at_most, part in ((True, rows[low]), (False, rows[~low])):
            deeper = [*path, (names[j], at_most, cut)]
            paths.append(deeper)
            todo.append((part, deeper))
    return paths, value


def fit(names: list[str], x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Ensemble:
    """Rules and weights from statistics x (rows by names) and labels y (0 or 1)."""
    if not len(y):
        return Ensemble(0.0)
    settings = replace(settings, min_leaf=max(2, min(settings.min_leaf, len(y) // 40)))
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return Ensemble(bias)
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, settings.bins + 1)[1:-1], method="lower"))
        edges.append(values[values < x[:, j].max()])
    margin, paths = np.full(len(y), bias), {}
    for _ in range(settings.trees):
        p = 1 / (1 + np.exp(-margin))
        found, value = _grow(x, edges, names, p - y, p * (1 - p), settings)
        margin = margin + value
        paths |= {tuple(sorted(path)): path for path in found}
    rules = list(paths.values())
    z = np.column_stack([_holds(tests, names, x) for tests in rules]).astype(float)
    weights, bias = _lasso(z, y, bias, settings)
    return Ensemble(bias, [(float(w), r) for w, r in zip(weights, rules, strict=True) if w])


def _lasso(z: np.ndarray, y: np.ndarray, bias: float, settings: Settings) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression by accelerated proximal gradient."""
    n = len(y)
    step = 4 / (np.linalg.norm(np.column_stack([z, np.ones(n)]), 2) ** 2 / n)
    w = v = np.zeros(z.shape[1])
    b = u = bias
    t = 1.0
    for _ in range(settings.steps):
        error = 1 / (1 + np.exp(-(z @ v + u))) - y
        moved = v - step * (z.T @ error) / n
        w_next = np.sign(moved) * np.maximum(np.abs(moved) - step * settings.penalty, 0)
        b_next = u - step * error.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Ensemble:
    """An ensemble from docs (doc_id, text) and labels (doc_id, quality): a bounded sample, the same for the same rows."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    picked = (
        known.where(thinned(F.col("doc_id"), settings.sample_rows, known.count()))
        .select("doc_id", F.col("quality").cast("int").alias("_y"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "_y")
        .limit(settings.sample_rows)
    )
    # sample_rows pairs of two numbers at most, whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    stats = rows.select("doc_id", "_y", statistics(F.col("text")).alias("_s")).groupBy("doc_id", "_y").agg(F.min("_s").alias("_s"))
    found = stats.select("doc_id", "_y", "_s.*").toPandas()  # sample_rows at most
    found = found.sort_values(["doc_id", "_y", *STATISTICS]).reset_index(drop=True)
    return fit(list(STATISTICS), found[list(STATISTICS)].to_numpy(float), found["_y"].to_numpy(float), settings)


def score(text: Column, model: Ensemble) -> Column:
    """The score of a text under the model, between 0 and 1."""
    return let(statistics(text), model.column)


def classify(docs: DataFrame, model: Ensemble, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep with score and predicted."""
    scored = docs.select(*keep, score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
