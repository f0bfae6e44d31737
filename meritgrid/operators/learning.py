"""Learning the exponents of the formula from judged pairs, and deciding whether to use them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meritgrid.functions.positions import numbered, running_sums, settled
from meritgrid.operators.ranking import EXPONENT_BOUNDS

# Where the fit starts and when its result may be used.
START = (0.7, 1.0, 0.4)
TINY = 1e-12
LEAST_PAIRS, WIDEST_HALF_CI = 20, 0.2
LARGE_CHANGE = 0.05
DOWNSTREAM_PAIRS, DOWNSTREAM_FACTOR = 50, 2
#: Pairs of a stratum that are listed rather than drawn.
LISTED = 200_000


def judged_pairs(judgments: DataFrame) -> DataFrame:
    """(query, winner, loser) for every relevant and irrelevant candidate of one query."""
    good = judgments.where(F.col("relevant")).select("query", F.col("uuid").alias("winner"))
    bad = judgments.where(~F.col("relevant")).select("query", F.col("uuid").alias("loser"))
    return good.join(bad, "query")


def _strata(placed: DataFrame, n: int, widest: float) -> DataFrame:
    """(p, score, k, low, high): of the row at position p of (p, score), the positions of those behind it whose score is
    higher by 2^k - 1 or more, but not by 2^(k + 1) - 1. What stands below so many scores is counted in one order of
    scores and bounds."""
    steps = [k for k in range(1, 1024) if 2.0**k - 1 <= widest]
    bounds = placed.select("p", F.explode(F.array(*(F.struct(F.lit(k).alias("k"),
        (F.col("score") + (2.0**k - 1)).alias("v")) for k in steps))).alias("b")) if steps else None
    first = placed.select("p", "score", F.lit(0).alias("k"), (F.col("p") + 1).alias("low"))
    if bounds is None:
        return first.withColumn("high", F.lit(n + 1).cast("long")).where("low < high")
    asked = bounds.select(F.col("b.v").alias("v"), F.lit(0).alias("kind"), "p", F.col("b.k").alias("k"))
    both = asked.unionByName(placed.select(F.col("score").alias("v"), F.lit(1).alias("kind"), "p", F.lit(0).alias("k")))
    below = running_sums(both, ["v", "kind"], {"n_below": F.col("kind").cast("long")}).where("kind = 0")
    lows = below.select("p", "k", (F.col("n_below") + 1).alias("low")).join(placed, "p").select("p", "score", "k", "low").unionByName(first)
    high = F.coalesce(F.lead("low").over(W.partitionBy("p").orderBy("k")), F.lit(n + 1)).cast("long")
    return lows.withColumn("low", F.greatest("low", F.col("p") + 1)).withColumn("high", high).where("low < high")


def sampled_pairs(candidates: DataFrame, judged: DataFrame, n_pairs: int, seed: int = 42) -> DataFrame:
    """(a, b, weight) of `n_pairs` pairs not judged so far, or of all if there are fewer, for judging next: a sample
    without replacement of all pairs of (uuid, score), where a pair weighs 1 / (1 + difference of score).

    Every pair rings after an exponential time at the rate of its weight, and the first to ring are the sample. Pairs
    are counted by strata in which 1 + difference is between two powers of two, from positions alone. Strata of few
    pairs (or few beside the pairs asked for and judged) are listed with their times. The others ring as a whole, at the
    rate that all their pairs would have with the stratum's largest weight, each time for a pair that is drawn alike
    and is given the ring with odds of one half or more; time goes on until enough pairs have rung. Rows without a
    score are in no pair."""
    scored = candidates.select("uuid", F.col("score").cast("double").alias("score")).where("uuid is not null and score is not null and not isnan(score)")
    placed = settled(numbered(scored, ["score", "uuid"], "p", "_n").select("p", "uuid", "score"))
    n, least, most = placed.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).first()
    done = settled(judged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rows = settled(_strata(placed, n, (most - least) if n else 0.0).withColumn("c", F.col("high") - F.col("low")))
    sizes = {r["k"]: r["n"] for r in rows.groupBy("k").agg(F.sum("c").alias("n")).collect()}
    few = max(LISTED, 4 * (n_pairs + done.count()))
    uniform = lambda *key: (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2**53)) + 0.5) / float(2**53)

    def rung(pairs: DataFrame, *more: str) -> DataFrame:
        """Pairs (p, q) as (a, b, w)."""
        x, y = placed.select("p", F.col("uuid").alias("x"), F.col("score").alias("sx")), placed.select(F.col("p").alias("q"),
            F.col("uuid").alias("y"), F.col("score").alias("sy"))
        weight = 1.0 / (1.0 + F.abs(F.col("sy") - F.col("sx")))
        return pairs.join(x, "p").join(y, "q").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), weight.alias("w"), *more)

    short = [k for k, size in sizes.items() if size <= few]
    listed = rung(rows.where(F.col("k").isin(short)).select("p", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("q")))
    found = settled(listed.join(done, ["a", "b"], "left_anti").select("a", "b", "w", (-F.log(uniform("a", "b")) / F.col("w")).alias("time")))
    long = sorted(k for k, size in sizes.items() if size > few)
    if long:
        wide = settled(running_sums(rows.where(F.col("k").isin(long)), ["k", "p"], {"start": F.col("c")}))
        width = max(1, sum(sizes[k] for k in long) // max(1, wide.count()))
        bases = dict(zip(long, np.cumsum([0, *(sizes[k] for k in long)])[:-1].tolist(), strict=True))
        spans = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("c") - 1) / width))
        spread = settled(wide.select("p", "low", "start", "c", F.explode(spans).alias("span")))
        rates = {k: sizes[k] * 2.0**-k for k in long}
        step = 2.0 * n_pairs / sum(size * 2.0**-k for k, size in sizes.items())
        rng, began = np.random.default_rng(seed), 0.0
        while found.where(F.col("time") <= began).count() < n_pairs:
            parts = []
            for k in long:
                drawn = candidates.sparkSession.range(int(rng.poisson(rates[k] * step))).select(
                    (F.lit(began) + uniform("id", F.lit(k), F.lit(began), F.lit("time")) * step).alias("time"),
                    (F.floor(uniform("id", F.lit(k), F.lit(began), F.lit("pair")) * sizes[k]) + bases[k]).alias("t"),
                    uniform("id", F.lit(k), F.lit(began), F.lit("odds")).alias("odds"),
                    F.lit(2.0**k).alias("scale"),
                )
                parts.append(drawn)
            draws = reduce(DataFrame.unionByName, parts).withColumn("span", F.floor(F.col("t") / width))
            hit = draws.join(spread, "span").where(F.col("t").between(F.col("start"), F.col("start") + F.col("c") - 1))
            pairs = rung(hit.select("p", (F.col("low") + F.col("t") - F.col("start")).alias("q"), "time", "odds", "scale"), "time", "odds", "scale")
            given = pairs.where(F.col("odds") < F.col("w") * F.col("scale")).join(done, ["a", "b"], "left_anti").select("a", "b", "w", "time")
            found = settled(found.unionByName(given).groupBy("a", "b").agg(F.first("w").alias("w"), F.min("time").alias("time")))
            began, step = began + step, 2 * step
        found = found.where(F.col("time") <= began)
    return found.orderBy("time", "a", "b").limit(n_pairs).select("a", "b", F.round("w", 6).alias("weight"))


def triangular_pairs(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(group, a, b), a < b, of every two members of small groups."""
    return rows.select(group, F.col(key).alias("a")).join(rows.select(group, F.col(key).alias("b")), group).where("a < b")


def adjacent_pairs(rows: DataFrame, group: str, signal: str, key: str) -> DataFrame:
    """(group, winner, loser): each member and the next one by falling signal, ties by key."""
    order = W.partitionBy(group).orderBy(F.desc(signal), key)
    return rows.select(group, F.col(key).alias("winner"), F.lead(key).over(order).alias("loser")).where("loser is not null")


@dataclass(frozen=True)
class Fit:
    exponents: tuple[float, float, float]
    half_widths: tuple[float, float, float]
    converged: bool
    n_pairs: int


def _safe_log(c: str) -> Column:
    return F.log(F.greatest(F.coalesce(F.col(c), F.lit(0.5)), F.lit(1e-9)))


def fit_exponents(pairs: DataFrame, rounds: int = 50) -> Fit:
    """Plackett-Luce for pairs (wq, wt, wr, lq, lt, lr): a winner is preferred with the odds of the scores.

    That is logistic regression on the differences of the logarithms without an intercept. Each round is one
    aggregation of a gradient and a 3 x 3 matrix over all pairs, so nothing but ten numbers reaches the driver;
    steps are projected to the bounds. Half-widths are 1.96 standard errors from the Fisher information."""
    d = pairs.select(*((_safe_log(f"w{c}") - _safe_log(f"l{c}")).alias(c) for c in "qtr"))
    n = d.count()
    if n == 0:
        return Fit(START, (float("inf"),) * 3, False, 0)
    d = d.persist()
    low, high = (np.array([b[i] for b in EXPONENT_BOUNDS.values()]) for i in (0, 1))
    at, done, matrix = np.array(START), False, np.eye(3)
    try:
        for _ in range(rounds):
            z = sum((F.col(c) * float(v) for c, v in zip("qtr", at, strict=True)), F.lit(0.0))
            p = 1 / (1 + F.exp(-z))
            w = p * (1 - p)
            cells = [(a, b) for i, a in enumerate("qtr") for b in "qtr"[i:]]
            row = d.agg(
                *(F.sum((1 - p) * F.col(c)).alias(f"g{c}") for c in "qtr"),
                *(F.sum(w * F.col(a) * F.col(b)).alias(f"h{a}{b}") for a, b in cells),
            ).first()
            gradient = np.array([row[f"g{c}"] for c in "qtr"])
            matrix = np.array([[row["h" + "".join(sorted((a, b), key="qtr".index))] for b in "qtr"] for a in "qtr"]) + 1e-9 * np.eye(3)
            free = ~((at <= low) & (gradient < 0) | (at >= high) & (gradient > 0))
            step = np.zeros(3)
            if free.any():
                step[free] = np.linalg.solve(matrix[np.ix_(free, free)], gradient[free])
            new = np.clip(at + step, low, high)
            done = bool(np.abs(new - at).max() < 1e-6)
            at = new
            if done:
                break
    finally:
        d.unpersist()
    half = 1.96 * np.sqrt(np.maximum(np.diag(np.linalg.inv(matrix)), 0))
    return Fit(tuple(map(float, at)), tuple(map(float, half)), done, n)


def negative_log_likelihood(pairs: DataFrame, exponents: tuple[float, float, float]) -> DataFrame:
    """One row, the fit's objective at given exponents over pairs (wq, wt, wr, lq, lt, lr): the sum of -ln of the share
    that the winner has of both scores."""
    def score(side: str) -> Column:
        parts = [F.pow(F.greatest(F.coalesce(f"{side}{c}", F.lit(0.0)), F.lit(TINY)), F.lit(float(e))) for c, e in zip("qtr", exponents, strict=True)]
        return parts[0] * parts[1] * parts[2]

    win, lose = score("w"), score("l")
    return pairs.agg(F.coalesce(F.sum(-F.log(win / (win + lose + TINY) + TINY)), F.lit(0.0)).alias("nll"), F.count(F.lit(1)).alias("n_pairs"))


def cold_start(fit: Fit) -> str:
    """Whether a first fit may be used: the first rule that it fails, or ready."""
    if not fit.converged:
        return "not_converged"
    if fit.n_pairs < LEAST_PAIRS:
        return "too_few_pairs"
    return "ci_too_wide" if max(fit.half_widths) > WIDEST_HALF_CI else "ready"


def merged_judgments(audit: DataFrame, feedback: DataFrame, downstream: DataFrame) -> DataFrame:
    """All pairs to refit on; those from outcomes count double once there are fifty of them."""
    times = DOWNSTREAM_FACTOR if downstream.limit(DOWNSTREAM_PAIRS).count() >= DOWNSTREAM_PAIRS else 1
    repeated = downstream.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_t")
    return audit.unionByName(feedback).unionByName(repeated)


def deployment(old: tuple[float, ...], fit: Fit) -> str:
    if cold_start(fit) != "ready":
        return "blocked"
    return "auto" if max(abs(a - b) for a, b in zip(old, fit.exponents, strict=True)) < LARGE_CHANGE else "manual"


def refit_due(last: Column, now: Column, days: int) -> Column:
    return last.isNull() | (F.datediff(now, last) >= days)


def trained_thresholds(pairs: DataFrame, ratio: str) -> dict[str, float]:
    """Review and auto-link thresholds from known matches: the values at int(.05 n) and int(.9 n), a tenth apart at
    least."""
    from meritgrid.functions.positions import numbered

    placed = numbered(pairs.select(ratio, F.xxhash64(ratio).alias("_h")), [ratio, "_h"], "_p", "_n")
    at = lambda q: F.max(F.when(F.col("_p") == F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1) + 1, F.col(ratio)))
    row = placed.agg(at(0.05).alias("review"), at(0.9).alias("auto")).first()
    auto = row["auto"] if row["auto"] > row["review"] else row["review"] + 0.1
    return {"review": row["review"], "auto_link": auto}


def refit(pairs: DataFrame, folder: str, specialty: str, day: str) -> dict[str, object]:
    """One cycle for a specialty: fits merged judgments, decides, and writes the next version of its latest vector on file:
    at once where the exponents hardly change, into `staging` where someone has to look first, not at all where the fit
    is not ready. What was decided, and the path written."""
    from meritgrid.operators.routing import EXPONENTS, newest_file, read_vector, write_vector

    current = read_vector(newest_file(folder, specialty))
    old = tuple(float(current["exponents"].get(k, v)) for k, v in zip(EXPONENTS, START, strict=True))
    fit = fit_exponents(pairs)
    action = deployment(old, fit)
    path = None if action == "blocked" else write_vector(current, fit.exponents, folder, day, staging=action == "manual")
    return {"action": action, "path": path, "version_before": int(current["version"]), "old": old, "fit": fit}
