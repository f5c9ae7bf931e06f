"""Quality classifier: a sparse rule ensemble over text statistics, compiled to column expressions.

Shallow trees are grown in numpy on random parts of a bounded sample of labelled rows; every path from a root becomes a
conjunctive rule; a logistic regression with an L1 penalty keeps few of them, and the kept rules and weights become one
column expression, which Spark evaluates over all documents.

Defined cases: a null or empty text has no words and gets a score like any other; where no rule can be made (no labels,
one class only, too few labelled rows to part, or rows with equal statistics) every score is the smoothed share of label
1, 0.5 without labels; repeated rows give equal scores, and labels repeated with other values count as they stand; a null
key is not held out and never learned from; only the key and text are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded_sample, written

#: Labelled rows that the rules are fitted on, at most: those with the least hashes of their keys.
SAMPLE_ROWS = 20_000
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>~^=_\\{}[]@"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text that take few passes; each is a double, and 0 for an empty text."""
    words = F.filter(F.split(F.col("_t"), r"\s+"), lambda w: w != "")
    n, w = F.greatest(F.length("_t"), F.lit(1)), F.greatest(F.size("_w"), F.lit(1))
    lines = F.split("_t", "\n")
    count = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    upper = F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", ""))
    return {"_t": F.coalesce(text.cast("string"), F.lit("")), "_w": words, "_l": lines} | {
        "chars": F.length("_t"),
        "words": F.size("_w"),
        "word_length": F.length(F.translate("_t", " \t\r\n", "")) / w,
        "symbols": count(SYMBOLS) / n,
        "symbols_a_word": count(SYMBOLS) / w,
        "bangs_a_word": count("!?") / w,
        "stops_a_word": count(".,;:") / w,
        "digits": count("0123456789") / n,
        "upper": upper / n,
        "distinct_words": F.size(F.array_distinct("_w")) / w,
        "lines": F.size("_l"),
        "distinct_lines": F.size(F.array_distinct("_l")) / F.greatest(F.size("_l"), F.lit(1)),
        "words_a_line": F.size("_w") / F.greatest(F.size("_l"), F.lit(1)),
        "bars_a_word": count("|") / w,
    }


def with_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    stats = statistics(F.col(text))
    df = docs.select(F.col(key), stats.pop("_t").alias("_t"))
    df = df.withColumn("_w", stats.pop("_w")).withColumn("_l", stats.pop("_l"))
    return df.select(key, *[c.cast("double").alias(f"s_{k}") for k, c in stats.items()])


Rule = tuple[tuple[int, float, bool], ...]  # (feature, threshold, over it?)


def tree_paths(x: np.ndarray, y: np.ndarray, depth: int, features: np.ndarray, least: int) -> list[Rule]:
    """Every path from the root of one tree, grown by the largest drop in squared error, splits at quantiles."""
    out: list[Rule] = []

    def grow(rows: np.ndarray, path: Rule) -> None:
        if path:
            out.append(path)
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-9, None)
        total, n = y[rows].sum(), len(rows)
        for f in features:
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            s, c = v[order], np.cumsum(y[rows][order])
            k = np.unique(np.linspace(least, n - least, 32).astype(int))
            k = k[(k > 0) & (k < n)]
            k = k[s[k - 1] < s[k]]
            if len(k):
                gain = c[k - 1] ** 2 / k + (total - c[k - 1]) ** 2 / (n - k) - total**2 / n
                if gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), (int(f), float((s[k[i] - 1] + s[k[i]]) / 2)))
        if best[1]:
            f, t = best[1]
            over = x[rows, f] > t
            grow(rows[~over], (*path, (f, t, False)))
            grow(rows[over], (*path, (f, t, True)))

    grow(np.arange(len(x)), ())
    return out


def covered(x: np.ndarray, rule: Rule) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, t, over in rule:
        hit &= (x[:, f] > t) == over
    return hit


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient."""
    n, k = r.shape
    w = z = np.zeros(k + 1)
    a = np.concatenate([np.ones((n, 1)), r], 1)
    v = np.ones(k + 1)
    for _ in range(20):  # the largest eigenvalue of a'a, for the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate, t = 4 * n / max(1e-9, float(v @ (a.T @ (a @ v)))), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - rate * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, z = new, new + (before - 1) / t * (new - w)
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.001, seed: int = 11) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept, and (weight, rule) of the rules kept."""
    share = (y.sum() + 1) / (len(y) + 2)
    alone = float(np.log(share / (1 - share))), []
    if len(y) == 0 or y.min() == y.max():
        return alone
    r = np.random.default_rng(seed)
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        rows = r.choice(len(x), max(1, min(len(x), max(200, len(x) // 2))), replace=False) if len(x) > 200 else np.arange(len(x))
        features = r.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        rules |= dict.fromkeys(tree_paths(x[rows], y[rows], depth, features, max(5, len(rows) // 200)))
    found, hits, seen = [], [], set()
    for rule in rules:
        hit = covered(x, rule)
        mark = hit.tobytes()
        if hit.any() and not hit.all() and mark not in seen:
            seen.add(mark)
            found.append(rule)
            hits.append(hit)
    if not found:
        return alone
    intercept, w = lasso_logistic(np.array(hits, np.float64).T, y, penalty)
    return intercept, [(float(v), q) for v, q in zip(w, found, strict=True) if abs(v) > 1e-4]


def compiled(intercept: float, rules: list[tuple[float, Rule]], names: list[str]) -> Column:
    """The ensemble as one column: a logistic function of the weights of the rules that hold."""
    total = F.lit(intercept)
    for weight, rule in rules:
        holds = F.lit(True)
        for f, t, over in rule:
            holds = holds & ((F.col(names[f]) > t) if over else (F.col(names[f]) <= t))
        total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """One row per document row: key, held_out, score, predicted. Rows with crc32(key) % 5 = 0 are never learned from."""
    out_of = F.crc32(F.col(key).cast("string")) % 5 == 0
    stats = written(with_statistics(docs, key, text), "quality-statistics")
    names = [c for c in stats.columns if c.startswith("s_")]
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    train = stats.join(known.filter(F.crc32(F.col("_key").cast("string")) % 5 != 0), F.col(key) == F.col("_key"))
    sample = bounded_sample(train.select("_key", "_label", *names), "_key", rows, "_label").toPandas()
    intercept, rules = fit_rules(sample[names].to_numpy(np.float64), sample["_label"].to_numpy(np.float64))
    scored = stats.select(key, F.coalesce(out_of, F.lit(False)).alias("held_out"), compiled(intercept, rules, names).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
