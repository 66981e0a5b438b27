"""Sampling of posteriors on executors: chains that go on where they stopped, and particles under rising temperature."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.plans.session import checkpointed, send_package

LogDensity = Callable[[np.ndarray], float]

CHAIN = "chain long, step long, x array<double>, log_density double, scale double, accepted long, tried long"


def jump_factor(rate: float, target: float = 0.25, sharpness: float = 16.0, width: float = 0.1) -> float:
    """What a jump's scale is multiplied with after a rate of acceptance: one at the target, and between
    1 - width / 2 and 1 + width / 2, along a logistic curve."""
    return 1 - width / 2 + width / (1 + math.exp(-sharpness * (rate - target)))


def random_blocks(size: int, blocks: int, random: np.random.Generator) -> list[np.ndarray]:
    """Places 0 to size - 1 in so many random blocks of sizes at most one apart."""
    if not 1 <= blocks <= size:
        raise ValueError(f"{size} parameters do not make {blocks} blocks")
    return [np.sort(b) for b in np.array_split(random.permutation(size), blocks)]


@dataclass(frozen=True)
class Walk:
    """A random walk over a log density.

    covariance: of the proposals at scale 1. blocks: random groups of parameters that are proposed one
    after the other in each step, each from its part of the covariance. adapt_every: tries after which
    the scale is multiplied by jump_factor of the rate since the last time (0: never). low and high
    bound the parameters; a proposal outside is not evaluated and not accepted.
    """

    log_density: LogDensity
    covariance: np.ndarray
    scale: float = 1.0
    blocks: int = 1
    adapt_every: int = 0
    target: float = 0.25
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def inside(self, x: np.ndarray) -> bool:
        return (self.low is None or bool((x >= self.low).all())) and (self.high is None or bool((x <= self.high).all()))

    def step(self, x: np.ndarray, value: float, scale: float, random: np.random.Generator) -> tuple[np.ndarray, float, int]:
        """(parameters, log density, accepted proposals) after one step."""
        accepted = 0
        for block in random_blocks(len(x), self.blocks, random):
            root = np.linalg.cholesky(self.covariance[np.ix_(block, block)])
            there = x.copy()
            there[block] += scale * root @ random.normal(size=len(block))
            height = math.log(random.uniform())
            new = self.log_density(there) if self.inside(there) else -math.inf
            if height < new - value:
                x, value, accepted = there, float(new), accepted + 1
        return x, value, accepted


def segment_of(state: dict, walk: Walk, steps: int, seed: int) -> Iterator[tuple]:
    """Rows of CHAIN for the next steps of one chain. A step's random numbers depend on the seed, the
    chain and the step alone, and all else that it needs is in the row before."""
    x, value, scale, accepted, tried = np.array(state["x"], dtype=float), state["log_density"], state["scale"], state["accepted"], state["tried"]
    for step in range(state["step"] + 1, state["step"] + 1 + steps):
        x, value, got = walk.step(x, value, scale, np.random.default_rng([seed, state["chain"], step]))
        accepted, tried = accepted + got, tried + walk.blocks
        if walk.adapt_every and tried >= walk.adapt_every:
            scale, accepted, tried = scale * jump_factor(accepted / tried, walk.target), 0, 0
        yield state["chain"], step, x.tolist(), value, scale, accepted, tried


class ChainStore:
    """Chains of one walk in a folder that driver and executors share.

    Every segment of steps is a Parquet table of its own, from_<step>, that Spark commits as a whole,
    so a new session finds the last whole one and goes on from its last rows. A lost task makes its
    chains' rows again, the same ones. Stopped and resumed chains equal unbroken ones draw for draw,
    whatever the segments.
    """

    def __init__(self, spark: SparkSession, path: str, walk: Walk, seed: int = 0):
        self.spark, self.path, self.walk, self.seed = spark, path.rstrip("/"), walk, seed
        send_package(spark)

    def segments(self) -> list[int]:
        """The first steps of the whole segments, in order."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        whole = [int(n[5:]) for n in names if n.startswith("from_") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(whole)

    def draws(self) -> DataFrame:
        """All rows so far; step 0 is the start."""
        return self.spark.read.schema(CHAIN).parquet(*(f"{self.path}/from_{s}" for s in self.segments()))

    def last(self, begun: int) -> DataFrame:
        rows = self.spark.read.schema(CHAIN).parquet(f"{self.path}/from_{begun}")
        return rows.join(F.broadcast(rows.agg(F.max("step").alias("step"))), "step", "left_semi")

    def start(self, starts: np.ndarray) -> None:
        """Chains begin at the rows of starts; where they have begun already nothing is done."""
        if self.segments():
            return
        walk, points = self.walk, np.atleast_2d(np.asarray(starts, dtype=float))
        rows = self.spark.createDataFrame([(c, 0, x, 0.0, float(walk.scale), 0, 0) for c, x in enumerate(points.tolist())], CHAIN)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(log_density=[float(walk.log_density(np.asarray(x))) for x in f["x"]])

        rows.mapInPandas(run, CHAIN).write.mode("overwrite").parquet(f"{self.path}/from_0")

    def run(self, steps: int, segment: int = 1000) -> DataFrame:
        """Chains of so many steps in all, in segments of at most so many; what is there is not made again."""
        begun = self.segments()
        if not begun:
            raise ValueError("the chains have no start")
        walk, seed = self.walk, self.seed
        done = self.last(begun[-1]).agg(F.max("step")).first()[0]
        at = begun[-1]
        while done < steps:
            n = min(segment, steps - done)
            states = self.last(at)

            def run(frames: Iterator[pd.DataFrame], n: int = n) -> Iterator[pd.DataFrame]:
                for f in frames:
                    for state in f.to_dict("records"):
                        yield pd.DataFrame(segment_of(state, walk, n, seed), columns=["chain", "step", "x", "log_density", "scale", "accepted", "tried"])

            at = done + 1
            states.repartition("chain").mapInPandas(run, CHAIN).write.mode("overwrite").parquet(f"{self.path}/from_{at}")
            done += n
        return self.draws().where(F.col("step") <= steps)


def chain_summary(draws: DataFrame, burn: int = 0) -> DataFrame:
    """(parameter, mean, sd, r_hat, n): moments over all chains after burn steps, and by how much the
    spread of all exceeds that inside chains."""
    rows = draws.where(F.col("step") > burn).select("chain", F.posexplode("x").alias("parameter", "v"))
    own = rows.groupBy("chain", "parameter").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"), F.sum("v").alias("t"), F.sum(F.col("v") * F.col("v")).alias("t2"))
    total = own.groupBy("parameter").agg(F.sum("n").alias("n"), F.avg("n").alias("_l"), F.avg("s2").alias("_w"), F.var_samp("m").alias("_b"), F.sum("t").alias("_t"), F.sum("t2").alias("_t2"))
    mean = F.col("_t") / F.col("n")
    return total.select(
        "parameter",
        mean.alias("mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("_t2") / F.col("n") - mean * mean)).alias("sd"),
        F.sqrt((F.col("_l") - 1) / F.col("_l") + F.col("_b") / F.col("_w")).alias("r_hat"),
        "n",
    )


PARTICLE = "id long, x array<double>, log_likelihood double, log_weight double"
#: Temperatures that are tried for the next step in one aggregation, and rounds of it.
TRIED, ROUNDS = 24, 3


@dataclass(frozen=True)
class Tempered:
    """particles: id, x, log_likelihood and log_weight (all equal). steps: (temperature, effective share, acceptance)."""

    particles: DataFrame
    log_evidence: float
    steps: list[tuple[float, float, float]]


def weight_sums(particles: DataFrame, rises: Sequence[float]) -> list[tuple[float, float]]:
    """For each rise of the temperature: (log of the mean weight, effective share of the particles)."""
    new = [F.col("log_weight") + F.lit(float(r)) * F.col("log_likelihood") for r in rises]
    tops = particles.agg(F.count(F.lit(1)), *(F.max(c) for c in new)).first()
    n, tops = tops[0], [t if t is not None and math.isfinite(t) else 0.0 for t in tops[1:]]
    sums = particles.agg(*(F.sum(F.exp((c - t) * k)) for c, t in zip(new, tops, strict=True) for k in (1, 2))).first()
    return [(t + math.log(a / n) if a else -math.inf, a * a / b / n if b else 0.0) for t, a, b in zip(tops, sums[0::2], sums[1::2], strict=True)]


def next_temperature(particles: DataFrame, now: float, share: float) -> float:
    """The highest temperature, at most 1, that leaves the effective share; each aggregation tries many."""
    low, high = now, 1.0
    for _ in range(ROUNDS):
        tried = [low + (high - low) * i / TRIED for i in range(1, TRIED + 1)]
        fits = [s >= share for _, s in weight_sums(particles, [t - now for t in tried])]
        if fits[-1]:
            return high
        at = next(i for i, ok in enumerate(fits) if not ok)
        low, high = tried[at - 1] if at else low, tried[at]
    return low if low > now else high


def resampled(particles: DataFrame, shift: float) -> DataFrame:
    """As many particles as before, each as often as its weight asks for (systematic resampling).

    Running sums of weights are made inside ranges of ids, and only the ranges' sums meet; particle k
    of the new ones is the first whose running share passes (k + shift) / n. New ids are dealt anew, so
    the copies of a heavy particle are spread over tasks before they move.
    """
    top = particles.agg(F.max("log_weight")).first()[0]
    made = checkpointed(particles.withColumn("_w", F.exp(F.col("log_weight") - F.lit(float(top)))).repartitionByRange("id").withColumn("_range", F.spark_partition_id()))
    sizes = made.groupBy("_range").agg(F.sum("_w").alias("_s"), F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # a row a range
    sizes = sizes.select("_range", (F.sum("_s").over(upto) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_total"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    inside = Window.partitionBy("_range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    rows = made.withColumn("_inside", F.sum("_w").over(inside)).join(F.broadcast(sizes), "_range")
    high = F.least(F.lit(1.0), (F.col("_before") + F.col("_inside")) / F.col("_total"))
    w = Window.partitionBy("_range").orderBy("id")
    low = F.coalesce(F.lag(high).over(w), F.col("_before") / F.col("_total"))
    first, last = (F.least(F.col("_n"), F.ceil(F.round(c * F.col("_n") - F.lit(shift), 9))) for c in (low, high))
    rows = rows.select("x", "log_likelihood", first.alias("_first"), last.alias("_last")).where("_last > _first")
    return rows.select(F.explode(F.sequence(F.col("_first"), F.col("_last") - 1)).alias("id"), "x", "log_likelihood", F.lit(0.0).alias("log_weight"))


def moved(particles: DataFrame, root: np.ndarray, temperature: float, log_likelihood: LogDensity, log_prior: LogDensity, moves: int, seed: int, step: int) -> DataFrame:
    """Every particle after so many Metropolis moves at a temperature, and `accepted`. One job, whatever the moves."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, x, value, weight in f[["id", "x", "log_likelihood", "log_weight"]].itertuples(index=False):
                random, x, accepted = np.random.default_rng([seed, step, i]), np.array(x, dtype=float), 0
                height = log_prior(x)
                for _ in range(moves):
                    there = x + root @ random.normal(size=len(x))
                    limit = math.log(random.uniform())
                    prior = log_prior(there)
                    if not math.isfinite(prior):
                        continue
                    new = float(log_likelihood(there))
                    if limit < temperature * (new - value) + prior - height:
                        x, value, height, accepted = there, new, prior, accepted + 1
                out.append((i, x.tolist(), value, weight, accepted))
            yield pd.DataFrame(out, columns=["id", "x", "log_likelihood", "log_weight", "accepted"])

    return particles.repartition("id").mapInPandas(run, f"{PARTICLE}, accepted long")


def spread_root(particles: DataFrame, dimensions: int) -> np.ndarray:
    """A root of the particles' weighted covariance, from one aggregation of products."""
    top = particles.agg(F.max("log_weight")).first()[0]
    w = F.exp(F.col("log_weight") - F.lit(float(top)))
    x = [F.get("x", F.lit(i)) for i in range(dimensions)]
    pairs = [(i, j) for i in range(dimensions) for j in range(i, dimensions)]
    got = list(particles.agg(F.sum(w), *(F.sum(w * c) for c in x), *(F.sum(w * x[i] * x[j]) for i, j in pairs)).first())
    mean, cov = np.array(got[1 : 1 + dimensions]) / got[0], np.zeros((dimensions, dimensions))
    for (i, j), v in zip(pairs, got[1 + dimensions :], strict=True):
        cov[i, j] = cov[j, i] = v / got[0] - mean[i] * mean[j]
    values, vectors = np.linalg.eigh(cov)
    return vectors * np.sqrt(np.clip(values, 1e-12 * max(values.max(), 1e-300), None))


def tempered_particles(
    spark: SparkSession,
    log_likelihood: LogDensity,
    draw_prior: Callable[[np.random.Generator], np.ndarray],
    log_prior: LogDensity,
    particles: int = 2000,
    share: float = 0.5,
    moves: int = 3,
    seed: int = 0,
    most_steps: int = 200,
) -> Tempered:
    """Particles of a posterior, drawn from the prior and led to it by rising temperatures.

    Each temperature is the highest that leaves an effective share of the particles; they are then
    resampled and moved by random walks as wide as their own spread. Particles live in tables only:
    weights, running sums and covariances are aggregations, and what reaches the driver does not
    grow with their number. Random numbers depend on seed, step and id alone and every step is
    checkpointed, so a lost task makes the same particles again.
    """
    send_package(spark)
    dimensions = len(np.atleast_1d(draw_prior(np.random.default_rng([seed, 0, 0]))))

    def born(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = [np.atleast_1d(draw_prior(np.random.default_rng([seed, 0, int(i)]))) for i in f["id"]]
            yield pd.DataFrame({"id": f["id"], "x": [v.tolist() for v in x], "log_likelihood": [float(log_likelihood(v)) for v in x], "log_weight": 0.0})

    rows = checkpointed(spark.range(particles).mapInPandas(born, PARTICLE))
    now, evidence, told = 0.0, 0.0, []
    for step in range(1, most_steps + 1):
        then = next_temperature(rows, now, share)
        ((mean, effective),) = weight_sums(rows, [then - now])
        evidence += mean
        weighted = rows.withColumn("log_weight", F.col("log_weight") + F.lit(then - now) * F.col("log_likelihood"))
        root = spread_root(weighted, dimensions) * 2.38 / math.sqrt(dimensions)
        fresh = resampled(weighted, float(np.random.default_rng([seed, step, 1 << 40]).uniform()))
        after = checkpointed(moved(fresh, root, then, log_likelihood, log_prior, moves, seed, step))
        taken = after.agg(F.sum("accepted")).first()[0]
        rows, now = after.drop("accepted"), then
        told.append((then, effective, taken / (particles * max(moves, 1))))
        if now >= 1:
            return Tempered(rows, evidence, told)
    raise ArithmeticError(f"temperature {now:.3g} after {most_steps} steps")
