"""Quality classifier: a sparse rule ensemble.

Small trees are grown on statistics of labelled texts; the path to each of their nodes is a conjunctive rule. A
logistic regression with a lasso penalty weighs the rules and drops most. What is left is compiled to one
column expression over the statistics, so scoring is a scan without Python and without shuffle.

The model is fitted on the driver on at most ``max_rows`` labelled texts' statistics (a dozen numbers each); the
rows are those of the smallest hash of their id, so the sample is the same wherever it runs. Scoring covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import WORDS
from .text_stats import matches, with_counts, with_words

FEATURES = ("log_words", "word_length", "upper", "digit", "mark", "symbol", "stroke", "distinct", "echo", "dup_lines", "common")
MAX_ROWS = 20_000
TREES, DEPTH, CUTS, PENALTY, STEPS, SEED = 16, 3, 32, 2e-3, 400, 7
ACCEPT = 0.7

Rule = tuple[tuple[int, float, bool], ...]  # (feature, threshold, above)


def with_features(df: DataFrame) -> DataFrame:
    """df (``text``) with one double column per name of FEATURES, prefixed ``_f_``. A null text counts as empty."""
    counted = with_counts(with_words(df))
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    letters = F.col("_letters")
    made = {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": F.col("word_chars") / words,
        "upper": matches(letters, r"\p{Lu}+") / chars,
        "digit": matches(letters, r"\p{Nd}+") / chars,
        "mark": matches(letters, "[.,;:!?]+") / words,
        "symbol": F.col("n_symbols") / chars,
        "stroke": matches(letters, r"[^\p{L}\p{M}\p{N}.,;:?'\"()\-]+") / chars,
        "distinct": F.size(F.array_distinct("_words")) / words,
        "echo": F.size(F.filter("_words", lambda w, i: w == F.get("_words", i - 1))) / words,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)).cast("double"),
        "common": F.size(F.filter("_words", lambda w: w.isin(WORDS))) / words,
    }
    return counted.withColumns({f"_f_{k}": made[k].cast("double") for k in FEATURES}).drop("_text", "_words", "_lines", "_letters", "n_words", "word_chars", "n_symbols", "n_dup_lines")


@dataclass
class RuleModel:
    """Weights of rules and an intercept; without rules the score is constant."""

    intercept: float = 0.0
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """The score as an expression over the columns of with_features."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for feature, threshold, above in rule:
                c = F.col(f"_f_{FEATURES[feature]}")
                holds = holds & ((c > threshold) if above else (c <= threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[Rule]:
    """Rules of one tree on a resample of rows and two thirds of the features: the paths to all its nodes but the root."""
    rows = rng.integers(0, len(y), len(y))
    allowed = rng.permutation(x.shape[1])[: max(1, 2 * x.shape[1] // 3)]
    rules: list[Rule] = []

    def split(rows: np.ndarray, path: Rule) -> None:
        target = y[rows]
        share = target.mean() if len(rows) else 0.0
        if path:
            rules.append(path)
        if len(path) == DEPTH or len(rows) < 20 or share in (0.0, 1.0):
            return
        best = (1e-4, None, None)
        for f in allowed.tolist():
            values = x[rows, f]
            for t in np.unique(np.quantile(values, np.linspace(0.02, 0.98, CUTS))).tolist():
                above = values > t
                n = int(above.sum())
                if 5 <= n <= len(rows) - 5:
                    p, q = target[above].mean(), target[~above].mean()
                    gain = share * (1 - share) - (n * p * (1 - p) + (len(rows) - n) * q * (1 - q)) / len(rows)
                    if gain > best[0]:
                        best = (gain, f, t)
        if best[1] is not None:
            above = x[rows, best[1]] > best[2]
            split(rows[above], (*path, (best[1], best[2], True)))
            split(rows[~above], (*path, (best[1], best[2], False)))

    split(rows, ())
    return rules


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, t, above in rule:
        out &= (x[:, f] > t) == above
    return out


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """The ensemble for statistics x and labels y; with one class or none, a constant near that class."""
    if not len(y) or y.min() == y.max():
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rng = np.random.default_rng(SEED)
    rules = list(dict.fromkeys(r for _ in range(TREES) for r in grow(x, y, rng)))
    r = np.stack([holds(rule, x) for rule in rules], axis=1).astype(float)
    # classes weigh the same, so that a rare one counts
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(r.shape[1]), 0.0
    z, c, t = w.copy(), b, 1.0
    step = 4 / (np.linalg.norm(np.sqrt(weight)[:, None] * r, 2) ** 2 + 1)
    for _ in range(STEPS):  # accelerated proximal gradient
        error = weight * (1 / (1 + np.exp(-(r @ z + c))) - y)
        new_w = z - step * (r.T @ error)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * PENALTY, 0)
        new_b, new_t = c - step * error.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(float(b), [rules[i] for i in kept], w[kept].tolist())


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleModel:
    """Fit on docs (``doc_id, text``) and labels (``doc_id, quality`` of 0 or 1; others and nulls don't count).

    Labels of held-out ids are left aside; a doc labelled twice counts as 1 only if all its labels are. At most
    max_rows labels are used, which bounds what is broadcast and collected; of rows that repeat an id, that of the
    least features is learnt from.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(sample), "_id")
    each = with_features(texts).groupBy("_id").agg(F.min("_y").alias("_y"), F.min(F.struct(*[f"_f_{k}" for k in FEATURES])).alias("_f"))
    rows = each.select("_id", "_y", "_f.*").toPandas().sort_values("_id")
    return fit_rules(rows.iloc[:, 2:].to_numpy(dtype=float), rows["_y"].to_numpy(dtype=float))


def score(df: DataFrame, model: RuleModel) -> DataFrame:
    """df (``text``) with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ACCEPT on), for every row, null and empty texts too.

    Columns of these two names are replaced; all others and repeated rows pass through.
    """
    row = F.struct(*[F.col(c) for c in df.columns if c not in ("score", "predicted")])  # whole, so that no name of it can clash
    scored = with_features(df.select(row.alias("_row"), "text")).withColumn("score", model.column())
    return scored.select("_row.*", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
