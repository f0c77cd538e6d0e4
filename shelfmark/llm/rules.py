"""Operator 12: quality by a sparse ensemble of rules.

Statistics of a whole text are Spark columns (shares of signs, capitals and digits,
word and line shapes, repetition, ...). On a bounded sample of labelled rows, small trees
are grown one after another on the logistic loss, each on half of the sample; every path from a
root to a node is a rule, a conjunction of thresholds on statistics. A logistic
regression with an L1 penalty weighs the rules; the penalty is the largest whose
loss on held-out rows of the sample lies within one standard error of the best, so few rules are left. They
are compiled into one Spark column: scoring needs no Python and no shuffle.

The sample: ``per_class`` documents of each class, chosen by hash; only their
statistics reach the driver, so long texts need no bound.

Defined results: a null or empty text has the statistics of an empty text (all 0)
and is scored by them. Labels repeated for an id count once, good if any is. With
no labelled documents, or labels of one class, every score is the share of good labels
(0 without labels). Repeated rows give repeated results; extra columns pass through
``score``, which replaces a column named score.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_CLASS = 2_000
TREES, DEPTH, LEAST_ROWS, RATE = 40, 3, 10, 0.3
CUTS = 32
PENALTIES = 24
FOLDS = 5

#: Signs that seldom stand in prose, and ends of sentences (fixed values), as patterns.
SIGNS = r"[#$%&*+<=>@\[\\\]^_`{|}~]+"
ENDS = "[.!?…]+"
#: Two or more ASCII signs in a row.
RUNS = r"[!-/:-@\[-`{-~]{2,}"


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where there is nothing."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with helper columns, and the statistics of ``text`` as columns over them.

    The helpers' names are new, so columns of any names pass through. Letters a-z and
    white space are most of many texts: what is left without them is short, and signs are counted there.
    """
    tag = f"_{uuid.uuid4().hex[:8]}_"
    c = lambda name: F.col(tag + name)
    fewer = lambda name, pattern: F.length(c(name)) - F.length(_without(c(name), pattern))
    steps = [
        {"text": F.coalesce(F.col(f"`{text}`"), F.lit(""))},
        {
            "words": F.array_remove(F.split(c("text"), r"[ \t-\r]+"), ""), "lines": F.array_remove(F.split(c("text"), r"[\n\r]+"), ""),
            "rest": _without(c("text"), r"[a-z \t-\r]+"), "runs": fewer("text", RUNS), "n": F.length(c("text")),
        },
        {"solid": F.length(F.concat_ws("", c("words"))), "sizes": F.transform(c("words"), F.length), "kinds": F.size(F.array_distinct(c("words"))), "other_lines": F.array_distinct(c("lines"))},
        {
            "many": F.size(c("words")), "longest": F.coalesce(F.array_max(c("sizes")), F.lit(0)), "short": F.size(F.filter(c("sizes"), lambda n: n <= 3)),
            "rows": F.size(c("lines")), "other_rows": F.size(c("other_lines")), "line_chars": F.length(F.concat_ws("", c("lines"))), "other_chars": F.length(F.concat_ws("", c("other_lines"))),
            "capitals": fewer("rest", r"\p{Lu}+"), "digits": fewer("rest", r"[0-9]+"), "signs": fewer("rest", SIGNS), "calls": fewer("rest", "!+"), "ends": fewer("rest", ENDS),
            "letters": c("solid") - F.length(_without(c("rest"), r"\p{L}+")),
        },
    ]
    rows = docs
    for step in steps:
        rows = rows.withColumns({tag + name: column for name, column in step.items()})
    many, solid, kinds = c("many"), c("solid"), c("kinds")
    return rows, {
        "log_words": F.log1p(many.cast("double")),
        "word_length": _share(solid, many),
        "longest_word": c("longest").cast("double"),
        "letter_share": _share(c("letters"), solid),
        "capital_share": _share(c("capitals"), c("letters")),
        "digit_share": _share(c("digits"), solid),
        "sign_share": _share(c("signs"), solid),
        "sign_run_share": _share(c("runs"), solid),
        "call_share": _share(c("calls"), solid),
        "sentence_words": _share(many, c("ends")),
        "short_share": _share(c("short"), many),
        "distinct_share": _share(kinds, many),
        "words_per_root": F.when(many > 0, kinds / F.sqrt(many.cast("double"))).otherwise(F.lit(0.0)),
        "line_words": _share(many, c("rows")),
        "repeated_lines": _share(c("rows") - c("other_rows"), c("rows")),
        "repeated_line_chars": _share(c("line_chars") - c("other_chars"), c("line_chars")),
        "space_share": _share(c("n") - solid, c("n")),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: (statistic, whether it must be above, threshold)."""

    bounds: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        """Whether each row of statistics satisfies the rule."""
        out = np.ones(len(x), bool)
        for name, above, cut in self.bounds:
            v = x[:, names.index(name)]
            out &= v > cut if above else v <= cut
        return out

    def column(self, of: dict[str, Column]) -> Column:
        """The rule as a Spark condition."""
        out = F.lit(True)
        for name, above, cut in self.bounds:
            out = out & (of[name] > F.lit(cut) if above else of[name] <= F.lit(cut))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{name} {'>' if above else '<='} {cut:.6g}" for name, above, cut in self.bounds)


@dataclass
class Model:
    """Weighted rules; without any every score is ``share``, the share of good labels."""

    share: float
    intercept: float = 0.0
    rules: tuple[tuple[Rule, float], ...] = ()
    names: tuple[str, ...] = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Score of each row of statistics, as the column computes it."""
        if not self.names:
            return np.full(len(x), self.share)
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule.holds(x, list(self.names))
        return 1 / (1 + np.exp(-z))

    def column(self, of: dict[str, Column]) -> Column:
        """The score as a Spark column over statistics."""
        if not self.names:
            return F.lit(float(self.share))
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            z = z + F.when(rule.column(of), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds of each statistic: midpoints between neighbouring values, at quantiles if there are many."""
    out = []
    for v in x.T:
        seen = np.unique(v)
        middle = (seen[1:] + seen[:-1]) / 2
        if len(middle) > CUTS:
            middle = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1], method="inverted_cdf"))
            middle = middle[middle < seen[-1]]
        out.append(middle)
    return out


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], depth: int) -> list[tuple]:
    """Paths (bounds, rows, value) of all nodes of one tree, which fits ``gradient / weight`` by Newton steps; leaves last say their value."""
    below = [(x[:, f, None] <= cut).astype(float) for f, cut in enumerate(cuts)]
    out, todo = [], [((), np.arange(len(x)))]
    while todo:
        bounds, rows = todo.pop()
        g, w = gradient[rows], weight[rows]
        best = (1e-9, -1, -1)
        if len(bounds) < depth and len(rows) >= 2 * LEAST_ROWS:
            whole = g.sum() ** 2 / (w.sum() + 1)
            for f, b in enumerate(below):
                if not b.shape[1]:
                    continue
                in_, gl, wl = b[rows].sum(0), g @ b[rows], w @ b[rows]
                gain = gl**2 / (wl + 1) + (g.sum() - gl) ** 2 / (w.sum() - wl + 1) - whole
                gain[(in_ < LEAST_ROWS) | (len(rows) - in_ < LEAST_ROWS)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        out.append((bounds, rows, g.sum() / (w.sum() + 1), best[1] < 0))
        if best[1] >= 0:
            _, f, i = best
            left = below[f][rows, i] > 0
            todo += [((*bounds, (f, False, float(cuts[f][i]))), rows[left]), ((*bounds, (f, True, float(cuts[f][i]))), rows[~left])]
    return out


def paths(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, seed: int = 12) -> list[Rule]:
    """Distinct rules from the paths of boosted trees; rules that hold for the same rows count once, the shorter one."""
    rng, cuts = np.random.default_rng(seed), _cuts(x)
    z = np.full(len(x), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[bytes, Rule] = {}
    for t in range(trees):
        p = _sigmoid(z)
        half = rng.permutation(len(x))[: max(2 * LEAST_ROWS, len(x) // 2)]
        for bounds, _, value, leaf in grow(x[half], (y - p)[half], (p * (1 - p))[half], cuts, 1 + t % DEPTH):
            rule = Rule(tuple((names[f], above, cut) for f, above, cut in bounds))
            holds = rule.holds(x, names)
            if leaf:
                z += RATE * np.clip(value, -4, 4) * holds
            if bounds and 0 < holds.sum() < len(x):
                key = (holds if holds[0] else ~holds).tobytes()  # a rule and its contrary say the same
                if key not in found or len(found[key].bounds) > len(rule.bounds):
                    found[key] = rule
    return list(found.values())


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: tuple[np.ndarray, float], steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L1-penalised logistic regression, by accelerated proximal gradient steps."""
    w, b = start[0].copy(), start[1]
    size = 4.0 / (np.linalg.norm(np.concatenate((r, np.ones((len(r), 1))), 1), 2) ** 2 / len(r) + 1e-12)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        d = (_sigmoid(r @ vw + vb) - y) / len(y)
        step = vw - size * (r.T @ d)
        new, nb = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0), vb - size * d.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        done = np.abs(new - w).max(initial=0) + abs(nb - b) < 1e-6
        w, b, t = new, nb, t2
        if done:
            break
    return w, b


def _losses(r: np.ndarray, y: np.ndarray, w: np.ndarray, b: float) -> np.ndarray:
    p = np.clip(_sigmoid(r @ w + b), 1e-9, 1 - 1e-9)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def train(x: np.ndarray, y: np.ndarray, names: list[str], share: float, seed: int = 12) -> Model:
    """Rules and weights from rows of statistics and their labels (0 or 1)."""
    if not len(y) or y.min() == y.max():
        return Model(share)
    rules = paths(x, y, names, seed=seed)
    if not rules:
        return Model(share)
    held = np.random.default_rng(seed + 1).permutation(len(y)) % FOLDS == 0
    r = np.stack([rule.holds(x, names) for rule in rules], 1).astype(float)
    most = np.abs(r.T @ (y - y.mean())).max() / len(y)
    penalties = most * np.geomspace(1, 1e-3, PENALTIES)
    prior = float(np.log(y.mean() / (1 - y.mean())))
    fitted, losses, errors = (np.zeros(r.shape[1]), prior), [], []
    for p in penalties:  # from the heaviest on, each from the last one's weights
        fitted = lasso(r[~held], y[~held], p, fitted)
        loss = _losses(r[held], y[held], *fitted)
        losses.append(loss.mean())
        errors.append(loss.std() / np.sqrt(max(1, held.sum())))
    best = int(np.argmin(losses))
    chosen = next(i for i, loss in enumerate(losses) if loss <= losses[best] + errors[best])
    w, b = lasso(r, y, penalties[chosen], (np.zeros(r.shape[1]), prior), 2_000)
    b += float(np.log(share / (1 - share)) - prior) if 0 < share < 1 else 0.0  # the sample holds the classes in other shares
    kept = tuple((rules[i], float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-4))
    return Model(share, float(b), kept, tuple(names))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows; the caller has left out the held-out ones from ``labels`` (doc_id, quality)."""
    one = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    many = {r["quality"]: r["count"] for r in one.groupBy("quality").count().collect()}  # two rows at most
    share = many.get(1, 0) / max(1, sum(many.values()))
    h = F.xxhash64("doc_id", F.lit(12))
    known = docs.select("doc_id").distinct().join(one, "doc_id")
    # A class's share of the hash range holds its sample, then some: windows see few rows however many are labelled.
    few = F.pmod(h, F.lit(1 << 20)) < F.when(F.col("quality") == 1, F.lit(_range(per_class, many.get(1, 0)))).otherwise(F.lit(_range(per_class, many.get(0, 0))))
    picked = known.filter(few).withColumn("r", F.row_number().over(Window.partitionBy("quality").orderBy(h, "doc_id"))).filter(F.col("r") <= per_class)
    rows, stats = statistics(docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "quality")), "doc_id"))  # 2 * per_class rows
    names = list(stats)
    got = rows.select("doc_id", "quality", *[stats[n].alias(n) for n in names]).distinct().orderBy("doc_id", *names).limit(4 * per_class).collect()
    x = np.array([[r[n] for n in names] for r in got], float).reshape(len(got), len(names))
    return train(x, np.array([r["quality"] for r in got], float), names, share)


def _range(per_class: int, count: int) -> int:
    """Of 2^20 hash values, so many that hold ``per_class`` of ``count`` rows with a wide margin."""
    return min(1 << 20, int((1 << 20) * (1.5 * per_class + 200) / max(1, count)) + 1)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) to every row, replacing a column of that name."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
    rows, stats = statistics(docs, text)
    return rows.select(*kept, model.column(stats).alias("score"))
