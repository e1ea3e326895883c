"""Operator 2: a quality classifier of sparse rules, scored as Spark columns.

Statistics of a text are columns. Shallow boosted trees are grown over a bounded
sample of labelled rows; every path from a root becomes a rule, a conjunction of
bounds on statistics; a logistic model with lasso penalty keeps few of them. The
kept rules are compiled into one column expression, so scoring reads each text
once, without Python and without a shuffle.

Only the model's fit is bounded: at most ``MOST_ROWS`` labelled rows, those with
the smallest hashes of doc_id, come to the driver as statistics. All documents are
scored over their whole texts.

Null and empty texts are scored like any text of length 0. Labels that are null
or neither 0 nor 1 are left out; of several labels of one document the smallest
counts. Without labels, or with one class only, every score is the share of label
1 (0.5 without any). Equal rows get equal scores, one row each. Empty table: no
rows. Other columns, clashing names included, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Most labelled rows used in a fit; they come to the driver, 8 bytes a statistic.
MOST_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 40, 3, 32, 0.2, 8
#: Strength of the lasso, as a share of the smallest that keeps no rule.
LASSO = 0.003
STEPS = 300
#: Score from which a document is taken as good.
GOOD = 0.3


def _share(text: str, without: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(without)) / n).otherwise(0.0)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and one double column per statistic."""
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    parts = base.withColumns({"_words": F.split("_text", r"[ \t\n\x0B\f\r]+"), "_lines": F.split("_text", "\n")})
    n = F.greatest(F.length("_text"), F.lit(1))
    words, lines = F.size("_words"), F.size("_lines")
    stats = {
        "s_chars": F.log1p(F.length("_text").cast("double")),
        "s_word_length": F.length("_text") / words,
        "s_words_distinct": F.size(F.array_distinct("_words")) / words,
        "s_lines_distinct": F.size(F.array_distinct("_lines")) / lines,
        "s_line_length": F.log1p(F.length("_text") / lines),
        "s_upper": _share("_text", F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        "s_digits": _share("_text", F.translate("_text", "0123456789", "")),
        "s_symbols": _share("_text", F.translate("_text", "#$%&*@^~=<>{}[]\\/_+", "")),
        "s_pipes": _share("_text", F.replace(F.col("_text"), F.lit("|"), F.lit(""))),
        "s_exclaim": _share("_text", F.replace(F.col("_text"), F.lit("!"), F.lit(""))),
        "s_stops": _share("_text", F.replace(F.col("_text"), F.lit("."), F.lit(""))),
        "s_commas": _share("_text", F.replace(F.col("_text"), F.lit(","), F.lit(""))),
        "s_first_word": F.length(F.element_at("_words", 1)) / n,
    }
    return parts.select(*keep, *(c.cast("double").alias(name) for name, c in stats.items()))


STATISTICS = (
    "s_chars", "s_word_length", "s_words_distinct", "s_lines_distinct", "s_line_length", "s_upper", "s_digits",
    "s_symbols", "s_pipes", "s_exclaim", "s_stops", "s_commas", "s_first_word",
)


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, at_most, bound) means statistic <= bound, else > bound."""

    bounds: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = None
        for name, at_most, bound in self.bounds:
            one = F.col(name) <= bound if at_most else F.col(name) > bound
            out = one if out is None else out & one
        return out

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, at_most, bound in self.bounds:
            v = x[:, STATISTICS.index(name)]
            out &= v <= bound if at_most else v > bound
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for weight, rule in self.rules:
            z = z + F.when(rule.column(), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))


def _grow(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: list, step: np.ndarray) -> None:
    """One tree of a boosting round: its paths go to ``out``, its leaf values to ``step``."""
    best = (1e-6, None)
    total, mass = slope[rows].sum(), weight[rows].sum()
    if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        for j, bounds in enumerate(cuts):
            if not len(bounds):
                continue
            code = codes[rows, j]
            size = len(bounds) + 1
            left = np.cumsum(np.bincount(code, slope[rows], size))[:-1]
            held = np.cumsum(np.bincount(code, weight[rows], size))[:-1]
            count = np.cumsum(np.bincount(code, minlength=size))[:-1]
            gain = left**2 / (held + 1) + (total - left) ** 2 / (mass - held + 1) - total**2 / (mass + 1)
            gain[(count < LEAST_ROWS) | (len(rows) - count < LEAST_ROWS)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, k))
    if path:
        out.append(path)
    if best[1] is None:
        step[rows] = total / (mass + 1)
        return
    j, k = best[1]
    low = codes[rows, j] <= k
    for side, at_most in ((rows[low], True), (rows[~low], False)):
        _grow(x, codes, cuts, slope, weight, side, (*path, (STATISTICS[j], at_most, float(cuts[j][k]))), depth + 1, out, step)


def _paths(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct rules of boosted trees, each tree over a fixed half of the rows."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    random = np.random.default_rng(0)
    z, out = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(random.random(len(y)) < 0.5)
        if len(rows) < 2 * LEAST_ROWS:
            rows = np.arange(len(y))
        step, found = np.zeros(len(y)), []
        _grow(x, codes, cuts, y - p, p * (1 - p), rows, (), 0, found, step)
        z += RATE * np.clip(step, -4, 4)
        out += found
    return [Rule(p) for p in dict.fromkeys(out)]


def _lasso(a: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty by accelerated proximal steps; the intercept is free."""
    n = len(y)
    mean = a.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    b = (a - mean) / scale
    base = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    start = np.log(base / (1 - base))
    penalty = LASSO * np.abs(b.T @ (y - base)).max() / n
    rate = 4 * n / max(float(np.linalg.eigvalsh(b.T @ b)[-1]), n)
    w = old = np.zeros(b.shape[1])
    c = old_c = start
    for t in range(1, STEPS + 1):
        move = (t - 1) / (t + 2)
        v, u = w + move * (w - old), c + move * (c - old_c)
        old, old_c = w, c
        error = 1 / (1 + np.exp(-(b @ v + u))) - y
        g = v - rate * (b.T @ error) / n
        w = np.sign(g) * np.maximum(np.abs(g) - rate * penalty, 0)
        c = u - rate * error.mean()
    weights = w / scale
    return float(c - mean @ weights), weights


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The sparse rule model of statistics ``x`` and labels ``y``."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 2 * LEAST_ROWS:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(float(np.log(share / (1 - share))), ())
    rules = _paths(x, y)
    if not rules:
        return Model(float(np.log(share / (1 - share))), ())
    intercept, weights = _lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64), y)
    return Model(intercept, tuple((float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of doc_id as text is a multiple of 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Fit on at most ``most_rows`` labelled documents that are not held out."""
    wanted = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_y"))
        .where(F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("_y").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    )
    # The sample's size is bounded by most_rows, whatever the tables hold.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")
    rows = with_statistics(sample, ["doc_id", "_y"]).orderBy("doc_id", *STATISTICS).limit(most_rows).collect()
    x = np.array([[r[s] for s in STATISTICS] for r in rows], np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r["_y"] for r in rows], np.float64))


def score(docs: DataFrame, model: Model, good: float = GOOD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    scored = scored.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= good).cast("int"))


def keep_good(docs: DataFrame, model: Model, good: float = GOOD) -> DataFrame:
    """The documents, all columns, that score at least ``good``."""
    packed = docs.select(F.struct("*").alias("_all"), "text")
    # Generated, not projected: a filter on a projection would work the statistics out once a rule.
    scored = with_statistics(packed, ["_all"]).select("_all", F.inline(F.array(F.struct(model.score().alias("_score")))))
    return scored.where(F.col("_score") >= good).select("_all.*")
