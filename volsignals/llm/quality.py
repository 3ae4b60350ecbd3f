"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; the paths from their roots
are rules, conjunctions of comparisons of statistics. A logistic model with an L1 penalty weighs
the rules, most weights become zero, and what is left is compiled into one Spark column. The
statistics are Spark columns too, so that scoring is one pass without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volsignals.llm.common import whole_text

#: Labelled rows that the model is fitted on, those with the smallest hash of their id.
SAMPLE = 20_000
#: Trees, their depth, cuts tried per statistic, smallest leaf, shrinkage, L1 penalty.
TREES, DEPTH, CUTS, LEAF, SHRINK, PENALTY = 24, 3, 32, 20, 0.3, 2e-4
#: Score from which on a document is kept.
KEEP_FROM = 0.3
#: One of so many parts, by CRC-32 of the id, is never learned from.
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == 0


def statistics() -> list[Column]:
    """Statistics of ``_text``, whose words are ``_words``; an empty text has 0 in each."""
    t, words = F.col("_text"), F.col("_words")
    n_bytes, n_words = F.octet_length(t), F.size(words)
    repeats = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))

    def share(count: Column, of: Column) -> Column:
        return count / F.greatest(of, F.lit(1))

    def sign(c: str) -> Column:
        return n_bytes - F.octet_length(F.replace(t, F.lit(c), F.lit("")))

    def matches(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern))

    named = {
        "log_bytes": F.log1p(n_bytes.cast("double")),
        "log_words": F.log1p(n_words.cast("double")),
        "word_bytes": share(n_bytes, n_words),
        "line_words": share(n_words, sign("\n") + 1),
        "exclamations": share(sign("!"), n_words),
        "bars": share(sign("|"), n_words),
        "stops": share(sign("."), n_words),
        "symbols": share(matches(r"[#$%&*+<=>@^_`~{}\[\]\\]"), n_words),
        "digits": share(matches("[0-9]"), n_bytes),
        "capitals": share(matches("[A-Z]"), n_bytes),
        "distinct": share(F.size(F.array_distinct(words)), n_words),
        "repeats": share(repeats, n_words),
    }
    return [c.cast("double").alias(n) for n, c in named.items()]


def measured(rows: DataFrame, text: Column, *kept: Column) -> DataFrame:
    """The kept columns and the statistics; words are a column first, as lambdas look back in it."""
    words = F.filter(F.split(F.col("_text"), r"\s+"), lambda w: w != "")
    own = rows.select(*kept, whole_text(text).alias("_text"))
    names = own.columns[:-1]
    return own.withColumn("_words", words).select(*names, *statistics())


STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "line_words", "exclamations", "bars", "stops",
    "symbols", "digits", "capitals", "distinct", "repeats",
]

#: A rule: comparisons (statistic, below or equal?, cut) that all hold.
Rule = tuple[tuple[int, bool, float], ...]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(
    x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray,
    path: Rule, found: list[Rule], update: np.ndarray,
) -> None:
    """Splits ``rows`` where the second-order gain is largest; adds every path to ``found``."""
    if path:
        found.append(path)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    if len(path) < DEPTH:
        for j, own in enumerate(cuts):
            if not len(own):
                continue
            k = np.searchsorted(own, x[rows, j], side="left")  # value <= own[i] for k <= i
            n = np.bincount(k, minlength=len(own) + 1).cumsum()[:-1]
            left_g = np.bincount(k, g[rows], len(own) + 1).cumsum()[:-1]
            left_h = np.bincount(k, h[rows], len(own) + 1).cumsum()[:-1]
            gain = (
                left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1)
                - total_g**2 / (total_h + 1)
            )
            gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (j, float(own[i])))
    if best[1] is None:
        update[rows] = -SHRINK * total_g / (total_h + 1)
        return
    j, cut = best[1]
    low = x[rows, j] <= cut
    _grow(x, cuts, g, h, rows[low], (*path, (j, True, cut)), found, update)
    _grow(x, cuts, g, h, rows[~low], (*path, (j, False, cut)), found, update)


def rules_of(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Paths of boosted trees, each once."""
    cuts = []
    for j in range(x.shape[1]):
        seen = np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)))
        cuts.append((seen[:-1] + seen[1:]) / 2)
    z, found = np.zeros(len(y)), []
    for _ in range(TREES):
        p = _sigmoid(z)
        update = np.zeros(len(y))
        _grow(x, cuts, p - y, p * (1 - p) + 1e-6, np.arange(len(y)), (), found, update)
        z += update
    return list(dict.fromkeys(found))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, cut in rule:
        out &= (x[:, j] <= cut) if low else (x[:, j] > cut)
    return out


def lasso(m: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights of the columns of ``m`` by accelerated proximal gradient."""
    n, k = m.shape
    rate = 4 * n / (np.linalg.norm(m, 2) ** 2 + n)
    w, b = np.zeros(k), 0.0
    v, c, t = w, b, 1.0
    for _ in range(steps):
        r = _sigmoid(m @ v + c) - y
        new = v - rate * (m.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        new_b = c - rate * r.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: list[float]
    base: float

    def column(self) -> Column:
        """The score as one Spark expression over the statistics' columns."""
        z = F.lit(self.base)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            parts = [F.col(STATISTICS[j]) <= c if low else F.col(STATISTICS[j]) > c for j, low, c in rule]
            every = parts[0]
            for p in parts[1:]:
                every = every & p
            z = z + F.when(every, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z += weight * holds(rule, x)
        return _sigmoid(z)


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Without rows of both labels, the score is their share (0.5 without any)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    constant = RuleModel([], [], float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return constant
    rules = rules_of(x, y)
    if not rules:
        return constant
    weights, base = lasso(np.column_stack([holds(r, x) for r in rules]).astype(float), y)
    kept = [i for i in range(len(rules)) if weights[i]]
    return RuleModel([rules[i] for i in kept], [float(weights[i]) for i in kept], float(base))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleModel:
    """Fit on up to ``sample`` labelled documents that are not held out.

    ``labels``: doc_id, quality; rows with another label than 0 or 1 don't count, and of several
    labels of one id the mean decides. Only the sample's documents are measured.
    """
    marked = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("_label"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = measured(own, F.col("text"), F.col("_label"), F.col("doc_id"))
    rows = rows.orderBy("doc_id", *STATISTICS).select(*STATISTICS, "_label")
    data = rows.limit(2 * sample).toPandas().to_numpy(float)
    return fit(data[:, :-1].reshape(-1, len(STATISTICS)), data[:, -1])


def scored(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) added; other columns of any name stay as they are."""
    own = [f"_own{i}" for i in range(len(docs.columns))]
    kept = [F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)]
    back = [F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True) if c != "score"]
    return measured(docs, F.col("text"), *kept).select(*back, model.column().alias("score"))


def kept(docs: DataFrame, model: RuleModel) -> DataFrame:
    """The rows of ``docs`` that score ``KEEP_FROM`` or more, with the columns of ``docs``."""
    own = [f"_own{i}" for i in range(len(docs.columns))]
    columns = [F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own, strict=True)]
    # a generator keeps the optimizer from moving the filter, and with it a copy of every
    # statistic for each of its uses, below the projection that computes them once
    rated = measured(docs, F.col("text"), *columns).select(*own, F.explode(F.array(model.column())).alias("_score"))
    good = rated.filter(F.col("_score") >= KEEP_FROM)
    return good.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1: keep).

    Null and empty texts get the score of a text whose statistics are 0. Repeated rows get the
    same score each. Empty ``labels``: every score is 0.5. Ids, sources, languages and labels are
    no inputs of a score.
    """
    model = train(docs, labels, sample)
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"),
    )
