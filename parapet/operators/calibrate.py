"""Calibration: replaying labelled runs under many settings.

A run's verdict depends only on its bag of (weight key, default score, category, veto). Runs are
first collapsed to distinct bags with counts, so that trials meet few rows whatever the corpus.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parapet import rules
from parapet.operators.policy import verdict
from parapet.schema import SCORE
from parapet.shared import written
from parapet.ship import ship

#: Where a search looks for thresholds.
ALLOW_RANGE, BLOCK_RANGE = (0.10, 0.60), (0.40, 0.95)
#: Distinct bags of findings that a search takes to each task, at most.
BAGS = 500_000
COUNTS = ("benign_allow", "benign_warn", "benign_block", "malicious_allow", "malicious_warn", "malicious_block")


def split(runs: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Runs (label, sha256, ...) with part: of each label the first floor(n * fraction) by seeded hash validate, the others train.

    The cut is found by counting hash ranges first, so that no task orders a label's runs alone.
    """
    turn = F.xxhash64(F.lit(seed), F.col("sha256"))
    ranged = runs.withColumn("turn", turn).withColumn("bucket", F.shiftright(F.col("turn"), 52))
    per = ranged.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("label").orderBy("bucket")
    whole = Window.partitionBy("label")
    cuts = per.withColumn("before", F.sum("n").over(up_to) - F.col("n")).withColumn("take", F.floor(F.sum("n").over(whole) * F.lit(fraction))).select("label", "bucket", "before", "take")
    inner = F.row_number().over(Window.partitionBy("label", "bucket").orderBy("turn", "sha256"))
    return ranged.withColumn("nth", inner).join(cuts, ["label", "bucket"]).withColumn("part", F.when(F.col("before") + F.col("nth") <= F.col("take"), F.lit("val")).otherwise(F.lit("train"))).drop("turn", "bucket", "nth", "before", "take")


def collapsed(runs: DataFrame, signals: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    """Distinct bags of signals with how many runs have each: columns of `by`, bag, runs.

    runs: pkg_id and `by`; runs without signals have an empty bag.
    """
    item = F.struct(rules.weight_key(F.col("rule")).alias("key"), F.col("score").cast(SCORE).alias("score"), rules.category(F.col("rule")).alias("category"), F.col("veto").alias("veto"))
    bags = signals.groupBy("pkg_id").agg(F.array_sort(F.collect_list(item)).alias("bag"))
    whole = runs.select("pkg_id", *by).join(bags, "pkg_id", "left")
    empty = F.array().cast(f"array<struct<key:string,score:{SCORE},category:string,veto:boolean>>")
    return whole.withColumn("bag", F.coalesce("bag", empty)).groupBy(*by, "bag").agg(F.count("*").alias("runs"))


def replayed(bag: Column, weights: Column, allow: Column, block: Column, least: Column) -> Column:
    """struct(score, verdict) of a bag under weights (map of key to score); keys without weight keep their score."""
    score = F.aggregate(bag, F.lit("0").cast(SCORE), lambda a, x: (a + F.coalesce(weights[x["key"]].cast(SCORE), x["score"])).cast(SCORE))
    score = F.least(F.lit("1").cast(SCORE), score)
    veto = F.exists(bag, lambda x: x["veto"])
    kinds = F.size(F.array_distinct(F.transform(bag, lambda x: x["category"])))
    return F.struct(F.when(veto, F.lit("1").cast(SCORE)).otherwise(score).alias("score"), verdict(veto, score, kinds, allow.cast(SCORE), block.cast(SCORE), least).alias("verdict"))


def evaluate(bags: DataFrame, trials: DataFrame, by: tuple[str, ...] = ("trial",)) -> DataFrame:
    """The confusion matrix of each trial (trial, allow, block, min_categories, weights map).

    Trials are a search's settings: they go to every task if they are small, which their size decides.
    Every bag meets every trial by purpose; a bag stands for all runs alike.
    """
    both = bags.join(trials)
    out = both.withColumn("r", replayed(F.col("bag"), F.col("weights"), F.col("allow"), F.col("block"), F.col("min_categories")))
    n = lambda label, v: F.sum(F.when((F.col("label") == label) & (F.col("r.verdict") == v), F.col("runs")).otherwise(F.lit(0).cast("long"))).alias(f"{label}_{v}")
    return out.groupBy(*by).agg(*[n(label, v) for label in ("benign", "malicious") for v in ("allow", "warn", "block")])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def rates(matrix: DataFrame) -> DataFrame:
    """Seven rates of a confusion matrix; 0 where nothing is to divide by."""
    ba, bw, bb, ma, mw, mb = (F.col(c) for c in COUNTS)
    benign, malicious = ba + bw + bb, ma + mw + mb
    return matrix.select(
        "*",
        ratio(bb, benign).alias("hard_fp"),
        ratio(bw, benign).alias("soft_fp"),
        ratio(mw + mb, malicious).alias("catch"),
        ratio(mb, malicious).alias("block_recall"),
        ratio(mw, malicious).alias("warn_recall"),
        ratio(mb, bb + mb).alias("block_precision"),
        ratio(mw, bw + mw).alias("warn_precision"),
    )


def objective(hard_cap: float = 0.01, soft_cap: float = 0.10) -> Column:
    """What a trial is worth, of the columns of rates(); a soft cap of 0 is none."""
    hard, soft, caught = F.col("hard_fp"), F.col("soft_fp"), F.col("catch")
    over = (soft > soft_cap) if soft_cap > 0 else F.lit(False)
    return F.when(hard > hard_cap, -1 - hard + 0.01 * caught).when(over, -0.5 - soft + 0.01 * caught).otherwise(caught - 0.1 * soft)


def feasible(rated: DataFrame, hard_cap: float = 0.01, soft_cap: float = 0.10) -> DataFrame:
    """B16."""
    return rated.filter((F.col("hard_fp") <= hard_cap) & ((F.col("soft_fp") <= soft_cap) if soft_cap > 0 else F.lit(True)))


def best(rated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The trial of the largest objective (column worth), the first of equals."""
    row = F.struct(*[F.col(c) for c in rated.columns])
    return rated.groupBy(*by).agg(F.max_by(row, F.struct(F.col("worth"), -F.col("trial"))).alias("row")).select("row.*")


def pareto(rated: DataFrame, most: int = 12) -> DataFrame:
    """Trials that none beats in catch, hard and soft false positives; one for each matrix, the first `most` by catch."""
    points = rated.select("catch", "hard_fp", "soft_fp").distinct()
    o = points.select(*[F.col(c).alias(f"o_{c}") for c in points.columns])
    ties = (F.col("o_catch") >= F.col("catch")) & (F.col("o_hard_fp") <= F.col("hard_fp")) & (F.col("o_soft_fp") <= F.col("soft_fp"))
    better = (F.col("o_catch") > F.col("catch")) | (F.col("o_hard_fp") < F.col("hard_fp")) | (F.col("o_soft_fp") < F.col("soft_fp"))
    free = points.join(o, ties & better, "left_anti")
    first = rated.join(free, ["catch", "hard_fp", "soft_fp"]).groupBy(*COUNTS).agg(F.min_by(F.struct(*[F.col(c) for c in rated.columns if c not in COUNTS]), "trial").alias("row"))
    return first.select(*COUNTS, "row.*").orderBy(F.desc("catch"), "soft_fp", "hard_fp", F.desc("block_recall"), "trial").limit(most)


def judged(runs: DataFrame, signals: DataFrame, weights: Column, config) -> DataFrame:
    """Each run (pkg_id, label, category, ...) with its replayed score, verdict and rules."""
    p = config.policy
    item = F.struct(rules.weight_key(F.col("rule")).alias("key"), F.col("score").cast(SCORE).alias("score"), rules.category(F.col("rule")).alias("category"), F.col("veto").alias("veto"))
    bags = signals.groupBy("pkg_id").agg(F.collect_list(item).alias("bag"), F.array_sort(F.collect_list("rule")).alias("rules"))
    whole = runs.join(bags, "pkg_id", "left")
    empty = F.array().cast(f"array<struct<key:string,score:{SCORE},category:string,veto:boolean>>")
    r = replayed(F.coalesce("bag", empty), weights, F.lit(p.allow_threshold), F.lit(p.block_threshold), F.lit(p.min_categories))
    return whole.withColumn("r", r).select(*runs.columns, F.col("r.score").alias("score"), F.col("r.verdict").alias("verdict"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


def named_category(category: Column) -> Column:
    return F.when(F.coalesce(category, F.lit("")) == "", F.lit("(uncategorised)")).otherwise(category)


def per_category(results: DataFrame) -> DataFrame:
    """The confusion matrix of each category."""
    n = lambda label, v: F.count_if((F.col("label") == label) & (F.col("verdict") == v)).alias(f"{label}_{v}")
    return results.groupBy(named_category(F.col("category")).alias("category")).agg(*[n(label, v) for label in ("benign", "malicious") for v in ("allow", "warn", "block")])


def misclassified(results: DataFrame, kind: str) -> DataFrame:
    """Kind hard_fp, soft_fp or missed: benign blocked, benign warned, malicious allowed; the highest score first."""
    label, v = {"hard_fp": ("benign", "block"), "soft_fp": ("benign", "warn"), "missed": ("malicious", "allow")}[kind]
    return results.filter((F.col("label") == label) & (F.col("verdict") == v)).orderBy(F.desc("score"), "pkg_id")


def rule_histogram(results: DataFrame) -> DataFrame:
    """Occurrences of each rule, repeats counted; runs without any under (no rules)."""
    each = F.explode(F.when(F.size("rules") == 0, F.array(F.lit("(no rules)"))).otherwise(F.col("rules"))).alias("rule")
    return results.select(each).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def miss_report(results: DataFrame, allow: float, most: int) -> DataFrame:
    """Of each category the `most` allowed malicious runs nearest to the threshold, and how far they are."""
    missed = results.filter("label = 'malicious' AND verdict = 'allow'").withColumn("category", named_category(F.col("category")))
    nth = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "pkg_id"))
    return missed.withColumn("margin", F.lit(str(allow)).cast(SCORE) - F.col("score")).withColumn("nth", nth).filter(F.col("nth") <= most)


def silent_rules(results: DataFrame) -> DataFrame:
    """Category, rule: rules that fire on some malicious run, but on none that the category misses.

    A category without misses has no rows; runs without a category stand under (uncategorised),
    where no rule counts as firing.
    """
    bad = results.filter("label = 'malicious'")
    fires = bad.select(F.explode("rules").alias("rule")).distinct()
    missed = bad.filter("verdict = 'allow'")
    kinds = missed.select(named_category(F.col("category")).alias("category")).distinct()
    on_misses = missed.select(F.col("category"), F.explode("rules").alias("rule")).distinct()
    return kinds.join(fires).join(on_misses, ["category", "rule"], "left_anti")


def statistics(matrix: DataFrame) -> DataFrame:
    """Counts, rates and all false positives."""
    return rates(matrix).withColumn("total_fp", F.col("benign_warn") + F.col("benign_block"))


def _draws(seed: int, *names) -> np.random.Generator:
    """Random numbers of their own for each (seed, names), whatever the order of drawing."""
    return np.random.default_rng([seed, *(int.from_bytes(str(n).encode(), "big") % (1 << 63) for n in names)])


def random_trials(base: dict[str, float], n: int, branch: int, seed: int, sigma: float = 0.25, allow: tuple[float, float] = ALLOW_RANGE, block: tuple[float, float] = BLOCK_RANGE, step: float = 0.05) -> list[dict]:
    """N settings: each weight near its base by a normal cut to 0..1 (uniform after 8 misses), thresholds uniform, block above allow."""
    out = []
    for trial in range(n):
        weights = {}
        for key in sorted(base):
            g = _draws(seed, branch, trial, key)
            tries = g.normal(base[key], sigma, 8)
            fit = tries[(tries >= 0) & (tries <= 1)]
            weights[key] = float(fit[0]) if len(fit) else float(g.random())
        g = _draws(seed, branch, trial)
        a, b = float(g.uniform(*allow)), float(g.uniform(*block))
        out.append({"trial": trial, "min_categories": branch, "allow": a, "block": b if b > a else a + step, "weights": weights})
    return out


class Bags:
    """Collapsed bags as arrays, for the many evaluations of a descent."""

    def __init__(self, rows: list[dict], keys: list[str]):
        place = {k: i for i, k in enumerate(keys)}
        self.keys = keys
        self.counts = np.zeros((len(rows), len(keys)))
        self.fixed, self.veto, self.kinds, self.runs, self.bad = (np.zeros(len(rows)) for _ in range(5))
        for i, r in enumerate(rows):
            for x in r["bag"]:
                if x["key"] in place:
                    self.counts[i, place[x["key"]]] += 1
                else:
                    self.fixed[i] += float(x["score"])
            self.veto[i] = any(x["veto"] for x in r["bag"])
            self.kinds[i] = len({x["category"] for x in r["bag"]})
            self.runs[i], self.bad[i] = r["runs"], r["label"] == "malicious"

    def matrix(self, weights: np.ndarray, allow: np.ndarray, block: np.ndarray, least: int) -> np.ndarray:
        """B6 for settings as rows: the six COUNTS of each."""
        score = np.round(np.minimum(1, self.counts @ weights.T + self.fixed[:, None]), 9)
        blocked = (self.veto[:, None] > 0) | (score >= block)
        warned = ~blocked & (score >= allow) & ((least <= 1) | (self.kinds[:, None] >= least))
        out = np.zeros((score.shape[1], 6))
        for k, label in enumerate((self.runs * (1 - self.bad), self.runs * self.bad)):
            out[:, 3 * k + 1], out[:, 3 * k + 2] = label @ warned, label @ blocked
            out[:, 3 * k] = label.sum() - out[:, 3 * k + 1] - out[:, 3 * k + 2]
        return out


def worth(matrix: np.ndarray, hard_cap: float, soft_cap: float) -> np.ndarray:
    """B7 and B8 of rows of COUNTS."""
    benign, malicious = matrix[:, :3].sum(1), matrix[:, 3:].sum(1)
    share = lambda x, n: np.divide(x, n, out=np.zeros(len(x)), where=n > 0)
    hard, soft, caught = share(matrix[:, 2], benign), share(matrix[:, 1], benign), share(matrix[:, 4] + matrix[:, 5], malicious)
    out = caught - 0.1 * soft
    if soft_cap > 0:
        out = np.where(soft > soft_cap, -0.5 - soft + 0.01 * caught, out)
    return np.where(hard > hard_cap, -1 - hard + 0.01 * caught, out)


class Log:
    """The settings that a search of one branch has tried, in order, with their matrices on both parts."""

    def __init__(self, train: Bags, val: Bags, least: int, hard_cap: float, soft_cap: float):
        self.train, self.val, self.least, self.caps = train, val, least, (hard_cap, soft_cap)
        self.rows: list[tuple] = []

    def tried(self, phase: str, w: np.ndarray, allow: np.ndarray, block: np.ndarray) -> np.ndarray:
        """What settings (rows of w) are worth on the validation part; they are logged."""
        val = self.val.matrix(w, allow, block, self.least)
        value = worth(val, *self.caps)
        self.rows += zip([phase] * len(w), w, allow, block, value, val, self.train.matrix(w, allow, block, self.least))
        return value


def descend(log: Log, phase: str, w: np.ndarray, allow: float, block: float, top: float, passes: int = 10, step: float = 0.05) -> float:
    """One coordinate after another over a grid, taking strict improvements, until a pass brings none; what the last is worth.

    All values of a coordinate are evaluated at once, as only it varies; of equal ones the first counts.
    """
    grid = np.round(np.arange(0, 1 + step / 2, step), 10)
    for _ in range(passes):
        before = top
        for k in range(len(w)):
            tries = np.repeat(w[None], len(grid), 0)
            tries[:, k] = grid
            tries = tries[grid != w[k]]
            got = log.tried(phase, tries, np.full(len(tries), allow), np.full(len(tries), block))
            if got.max() > top:
                top, w = got.max(), tries[got.argmax()]
        for name, bounds in (("allow", ALLOW_RANGE), ("block", BLOCK_RANGE)):
            tries = np.round(np.arange(bounds[0], bounds[1] + step / 2, step), 10)
            tries = tries[tries < block] if name == "allow" else tries[tries > allow]
            if len(tries):
                a, b = (tries, np.full(len(tries), block)) if name == "allow" else (np.full(len(tries), allow), tries)
                got = log.tried(phase, np.repeat(w[None], len(tries), 0), a, b)
                if got.max() > top:
                    top, allow, block = got.max(), float(a[got.argmax()]), float(b[got.argmax()])
        if top <= before:
            break
    return float(top)


TRIALS = "min_categories int, nth int, phase string, allow double, block double, worth double, weights map<string,double>, " + ", ".join(f"{p}{c} long" for p in ("", "train_") for c in COUNTS)


def search(train: DataFrame, val: DataFrame, config, trials: int = 700, branches: tuple[int, ...] = (1, 2, 3), seed: int = 1, passes: int = 10, hard_cap: float = 0.01, soft_cap: float = 0.10) -> DataFrame:
    """The log of one independent search for each number of categories, each in a task of its own.

    train, val: collapsed runs (label, bag, runs) of the parts of split(); their number is that of
    distinct findings, not of runs, and is checked (BAGS). Trials are ranked by what they are worth on
    the validation part; COUNTS are its matrix, train_... that of the training part.
    """
    spark = train.sparkSession
    base = rules.default_weights(config)
    parts = []
    for bags in (train, val):
        rows = bags.limit(BAGS + 1).collect()
        if len(rows) > BAGS:
            raise ValueError(f"over {BAGS} distinct bags of findings: evaluate() takes any number")
        parts.append([r.asDict(recursive=True) for r in rows])
    held = spark.sparkContext.broadcast(parts)
    p = config.policy

    def branch(key, frames):
        import pandas as pd

        least, keys = int(key[0]), list(base)  # canonical order
        log = Log(*(Bags(x, keys) for x in held.value), least, hard_cap, soft_cap)
        starts = []
        if trials:
            own = random_trials(base, trials, least, seed)
            w, allow, block = np.array([[t["weights"][k] for k in keys] for t in own]), np.array([t["allow"] for t in own]), np.array([t["block"] for t in own])
            value = log.tried("random", w, allow, block)
            top = int(value.argmax())
            starts.append(("from random", w[top], float(allow[top]), float(block[top]), float(value[top])))
        w = np.array([base[k] for k in keys])
        value = log.tried("baseline", w[None], np.array([p.allow_threshold]), np.array([p.block_threshold]))
        starts.append(("from baseline", w, p.allow_threshold, p.block_threshold, float(value[0])))
        for phase, w, a, b, top in starts:
            descend(log, phase, w, a, b, top, passes)
        out = []
        for nth, (phase, w, a, b, value, on_val, on_train) in enumerate(log.rows):
            row = {"min_categories": least, "nth": nth, "phase": phase, "allow": float(a), "block": float(b), "worth": float(value), "weights": dict(zip(keys, map(float, w)))}
            out.append(row | {c: int(n) for c, n in zip(COUNTS, on_val)} | {f"train_{c}": int(n) for c, n in zip(COUNTS, on_train)})
        return pd.DataFrame(out)

    kinds = spark.createDataFrame([(int(x),) for x in sorted({max(0, x) for x in branches})], "min_categories int")
    ship(spark)
    log = written(kinds.groupBy("min_categories").applyInPandas(branch, TRIALS), "trials")
    # a search's trials: at most some ten thousand rows
    return log.withColumn("trial", F.row_number().over(Window.orderBy("min_categories", "nth")) - 1).drop("nth")


def top_names(hits: DataFrame, n: int) -> DataFrame:
    """The n names with the largest weekly count (the largest of each name), in order of the names; ties go to the first name."""
    return hits.groupBy("name").agg(F.max("weekly").alias("weekly")).orderBy(F.desc("weekly"), "name").limit(n).orderBy("name")


def not_imported(wanted: DataFrame, known: DataFrame, refresh: bool = False) -> DataFrame:
    """B23."""
    return wanted if refresh else wanted.join(known.select("name"), "name", "left_anti")


def distinct_content(samples: DataFrame) -> DataFrame:
    """Of samples (position, sha256, ...) with equal content the first."""
    names = [c for c in samples.columns if c not in ("sha256", "position")]
    return samples.groupBy("sha256").agg(F.min(F.struct("position", *names)).alias("row")).select("sha256", "row.*")
