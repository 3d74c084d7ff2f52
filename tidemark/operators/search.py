"""Search for strategies: Pareto fronts, genetic programming over formulas, and parameter sweeps.

A generation is one Spark job: all its formulas are columns of one plan, stacked to long form and reduced to objectives by one
aggregation. Only objectives (one row a formula) come to the driver, where selection and variation work on small lists.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.core import YEAR, change, div
from tidemark.operators.backtest import backtest, halves, metrics
from tidemark.plans import dsl
from tidemark.plans.dsl import Node
from tidemark.plans.strategy import Strategy
from tidemark.sources.store import stored

OBJECTIVES = ("sharpe", "drawdown", "turnover", "simplicity")


# ---- fronts ----------------------------------------------------------------------------------------------------------------
def pareto_front(df: DataFrame, objectives: list[str], key: str = "id", most_broadcast: int = 20_000) -> DataFrame:
    """Rows that no other row beats in one objective without losing in another (more is better).

    Each partition's own front comes first (a row off it is off the whole front). While the partitions' fronts have at most `most_broadcast`
    rows, they are broadcast and every partition drops what they beat. Larger ones, as opposed objectives give, are dealt by ranges of the
    first objective and meet each other block by block: a row can only be beaten from its own range or a higher one.
    """
    import pandas as pd

    def front_of(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[~_beaten(rows[objectives].to_numpy(float))]

    def local(batches):
        front = None
        for rows in batches:
            rows = rows if front is None else pd.concat([front, rows])
            front = front_of(rows)
        if front is not None:
            yield front

    candidates = stored(df.mapInPandas(local, df.schema), "fronts")
    others = candidates.select(*[F.col(o).cast("double") for o in objectives]).distinct()
    n = others.count()
    if n <= most_broadcast:
        held = df.sparkSession.sparkContext.broadcast(others.toPandas().to_numpy(float).reshape(n, len(objectives)))

        def keep(batches):
            for rows in batches:
                yield rows[~_beaten(rows[objectives].to_numpy(float), held.value)]

        return candidates.mapInPandas(keep, df.schema)
    n_blocks = -(-n // most_broadcast)
    edges = F.array(*[F.lit(float(e)) for e in others.approxQuantile(objectives[0], [i / n_blocks for i in range(1, n_blocks)], 0.001)])
    block = lambda c: F.size(F.filter(edges, lambda e: F.col(c).cast("double") >= e))
    tagged = candidates.withColumn("_row", F.monotonically_increasing_id()).withColumn("_block", block(objectives[0]))
    tagged = stored(tagged, "front-blocks")
    asking = tagged.select("_row", F.explode(F.sequence("_block", F.lit(n_blocks - 1))).alias("_block"), F.pmod("_row", F.lit(n_blocks)).cast("int").alias("_part"), F.lit(True).alias("_asks"), *[F.col(o).cast("double") for o in objectives])
    there = others.select(F.lit(-1).cast("long").alias("_row"), block(objectives[0]).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_part"), F.lit(False).alias("_asks"), *objectives)

    def beaten(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["_asks"]]
        return own.loc[_beaten(own[objectives].to_numpy(float), rows.loc[~rows["_asks"], objectives].to_numpy(float)), ["_row"]]

    gone = asking.unionByName(there).groupBy("_block", "_part").applyInPandas(beaten, "_row long").distinct()
    return tagged.join(gone, "_row", "left_anti").select(*df.columns)


def _beaten(x: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
    """Whether each row of x is beaten by a row of `by` (of x itself, if not given)."""
    out, by = np.zeros(len(x), dtype=bool), x if by is None else by
    for i in range(len(x)):
        out[i] = ((by >= x[i]).all(axis=1) & (by > x[i]).any(axis=1)).any()
    return out


def pareto_ranks(x: np.ndarray) -> np.ndarray:
    """0 for the front, 1 for the front without it, and so on."""
    rank, left, n = np.full(len(x), -1), np.arange(len(x)), 0
    while len(left):
        front = ~_beaten(x[left])
        rank[left[front]] = n
        left, n = left[~front], n + 1
    return rank


def crowding(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Distance to the neighbours within the front, infinite at its ends."""
    out = np.zeros(len(x))
    for r in np.unique(rank):
        own = np.flatnonzero(rank == r)
        for k in range(x.shape[1]):
            order = own[np.argsort(x[own, k], kind="stable")]
            span = x[order[-1], k] - x[order[0], k]
            out[order[[0, -1]]] = np.inf
            if span > 0 and len(order) > 2:
                out[order[1:-1]] += (x[order[2:], k] - x[order[:-2], k]) / span
    return out


def crowding_distances(df: DataFrame, objectives: list[str], front: str = "rank") -> DataFrame:
    """The same for tables: neighbours by windows within each front."""
    total = F.lit(0.0)
    for o in objectives:
        w = Window.partitionBy(front).orderBy(o)
        span = F.max(o).over(Window.partitionBy(front)) - F.min(o).over(Window.partitionBy(front))
        gap = F.lead(o).over(w) - F.lag(o).over(w)
        total = total + F.when(gap.isNull(), float("inf")).otherwise(F.coalesce(div(gap, span), F.lit(0.0)))
    return df.withColumn("crowding", total)


def reference_points(objectives: int, divisions: int) -> np.ndarray:
    """Points of a simplex lattice: all ways to share out `divisions` equal parts among the objectives."""
    bars_at = itertools.combinations(range(divisions + objectives - 1), objectives - 1)
    edges = [(-1, *at, divisions + objectives - 1) for at in bars_at]
    return np.array([[b - a - 1 for a, b in itertools.pairwise(e)] for e in edges]) / divisions


def population_stats(df: DataFrame, objectives: list[str], key: str = "id", rank: str = "rank") -> DataFrame:
    """size, distinct ids, rows on the front, and least, greatest and mean of each objective."""
    figures = [f(o).alias(f"{n}_{o}") for o in objectives for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    return df.agg(F.count(F.lit(1)).alias("size"), F.count_distinct(key).alias("unique"), F.count_if(F.col(rank) == 0).alias("front"), *figures)


def injected(population: list[Node], fitness: list[float], n: int, rng: random.Random) -> list[Node]:
    """population with its n worst trees (a quarter at most) replaced by new random ones that it does not hold yet."""
    n = min(n, len(population) // 4)
    order = sorted(range(len(population)), key=lambda i: -fitness[i])
    kept = [population[i] for i in order[: len(population) - n]]
    have, tries = {t.hash for t in kept}, 0
    while len(kept) < len(population) and tries < 100 * n:
        tries += 1
        tree = dsl.random_tree(rng)
        if tree.hash not in have:
            have.add(tree.hash)
            kept.append(tree)
    return kept


def top(df: DataFrame, by: str, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), key).limit(n)


def distinct_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the first by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


# ---- fitness ---------------------------------------------------------------------------------------------------------------
def formula_fitness(bars: DataFrame, trees: list[Node], cost: float = 0.001, batch: int = 50) -> DataFrame:
    """tree_id, formula, segment (train or test), sharpe, drawdown, turnover, trades, simplicity of each tree over all symbols.

    A formula's value is turned into a position by its z score over its own past: above 0.5 long, below -0.5 short.
    """
    out = None
    for start in range(0, len(trees), batch):
        part = trees[start : start + batch]
        wide = halves(bars.withColumn("_ret", F.coalesce(change("close"), F.lit(0.0))))
        values = [dsl.compile_formula(t).alias(f"_f{i}") for i, t in enumerate(part)]
        wide = wide.select("symbol", "ts", "segment", "_ret", *values)
        each = F.explode(F.array(*[F.struct(F.lit(t.hash).alias("tree_id"), F.lit(str(t)).alias("formula"), F.lit(-t.complexity).alias("simplicity"), F.col(f"_f{i}").alias("v")) for i, t in enumerate(part)]))
        rows = wide.select("symbol", "ts", "segment", "_ret", each.alias("t")).select("symbol", "ts", "segment", "_ret", "t.*")
        own = Window.partitionBy("tree_id", "symbol").orderBy("ts")
        past = own.rowsBetween(Window.unboundedPreceding, 0)
        z = F.when(F.count("v").over(past) >= 20, div(F.col("v") - F.avg("v").over(past), F.stddev_samp("v").over(past)))
        rows = rows.withColumn("pos", F.when(z > 0.5, 1).when(z < -0.5, -1).otherwise(0))
        before = F.coalesce(F.lag("pos").over(own), F.lit(0))
        rows = rows.withColumn("turn", F.abs(F.col("pos") - before)).withColumn("r", before * F.col("_ret") - cost * F.col("turn"))
        inside = Window.partitionBy("tree_id", "symbol", "segment").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("eq", F.sum("r").over(inside)).withColumn("dd", F.col("eq") - F.max("eq").over(inside))
        found = rows.groupBy("tree_id", "formula", "simplicity", "segment").agg(
            F.coalesce(div(F.avg("r"), F.stddev_samp("r")) * float(math.sqrt(YEAR)), F.lit(0.0)).alias("sharpe"), F.min("dd").alias("drawdown"), (-10 * F.avg("turn")).alias("turnover"), F.sum("turn").alias("trades")
        )
        out = found if out is None else out.unionByName(found)
    return out


def selection_pbo(fitness: DataFrame) -> DataFrame:
    """Probability that the choice of the best formula on the train segment is overfitted, from rows of formula_fitness(): one choice."""
    from tidemark.operators.validation import pbo

    wide = fitness.groupBy("tree_id").agg(F.max(F.when(F.col("segment") == "train", F.col("sharpe"))).alias("in_sample"), F.max(F.when(F.col("segment") == "test", F.col("sharpe"))).alias("out_sample"))
    return pbo(wide.na.drop().select(F.lit(0).alias("combo_id"), F.col("tree_id").alias("strategy_id"), "in_sample", "out_sample"))


# ---- variation -------------------------------------------------------------------------------------------------------------
def crossover(a: Node, b: Node, rng: random.Random) -> tuple[Node, Node]:
    """Both trees with one subtree of the same type exchanged; unchanged if there is none."""
    places = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if i and j and x.kind == y.kind]
    if not places:
        return a, b
    i, j = rng.choice(places)
    return a.put(i, b.at(j)), b.put(j, a.at(i))


def crossover_uniform(a: Node, b: Node, rng: random.Random, chance: float = 0.5) -> tuple[Node, Node]:
    """Where both trees have operators of one signature in the same place, their names may be exchanged, and so on below."""
    if a.value is not None or b.value is not None or len(a.args) != len(b.args) or dsl.SIGNATURES.get(a.name) != dsl.SIGNATURES.get(b.name):
        return (b, a) if a.kind == b.kind and rng.random() < chance else (a, b)
    pairs = [crossover_uniform(x, y, rng, chance) for x, y in zip(a.args, b.args, strict=True)]
    names = (b.name, a.name) if rng.random() < chance else (a.name, b.name)
    return Node(names[0], tuple(p[0] for p in pairs)), Node(names[1], tuple(p[1] for p in pairs))


def mutate(tree: Node, rng: random.Random) -> Node:
    """Another subtree, number, operator of the same signature, or column, in the shares .3, .3, .2, .2."""
    nodes, pick = list(tree), rng.random()
    if pick < 0.3:
        i = rng.randrange(len(nodes))
        return tree.put(i, dsl.random_tree(rng, nodes[i].kind, 3))
    if pick < 0.6:
        places = [i for i, n in enumerate(nodes) if n.value is not None]
        if not places:
            return tree
        i = rng.choice(places)
        old = nodes[i]
        if old.kind == dsl.WINDOW:
            return tree.put(i, Node("constant", value=float(min(252, max(2, old.value + rng.randint(-5, 5))))))
        return tree.put(i, Node("constant", value=round(min(10.0, max(-10.0, old.value * (1 + rng.uniform(-0.2, 0.2)))) or 0.1, 4)))
    if pick < 0.8:
        places = [(i, o) for i, n in enumerate(nodes) if n.args for o, s in dsl.SIGNATURES.items() if o != n.name and s == dsl.SIGNATURES[n.name]]
        if not places:
            return tree
        i, name = rng.choice(places)
        return tree.put(i, Node(name, nodes[i].args))
    places = [i for i, n in enumerate(nodes) if not n.args and n.value is None]
    return tree.put(rng.choice(places), Node(rng.choice(dsl.TERMINALS))) if places else tree


def tournament(rank: np.ndarray, crowd: np.ndarray, rng: random.Random, size: int = 2) -> int:
    return min(rng.sample(range(len(rank)), min(size, len(rank))), key=lambda i: (rank[i], -crowd[i]))


def lexicase(x: np.ndarray, rng: random.Random, epsilon: float = 1e-6) -> int:
    """One individual: objectives in random order, each keeping those within epsilon of the best."""
    left = list(range(len(x)))
    for k in rng.sample(range(x.shape[1]), x.shape[1]):
        best = max(x[i, k] for i in left)
        left = [i for i in left if x[i, k] >= best - epsilon]
    return rng.choice(left)


@dataclass
class Discovery:
    """What discover() found: the last population with its ranks, the factor zoo, and the figures of each generation."""

    population: list[Node]
    fitness: dict[str, dict]
    ranks: dict[str, int]
    zoo: list[dict] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)

    def weights(self) -> dict[str, float]:
        return {z["tree_id"]: 1 / len(self.zoo) for z in self.zoo}

    def strategies(self) -> list[Strategy]:
        """The zoo as strategies that name their formula."""
        return [Strategy(f"formula-{z['tree_id']}", formula=z["formula"], id=z["tree_id"]) for z in self.zoo]

    def pbo(self, spark: SparkSession) -> DataFrame | None:
        """selection_pbo() over all formulas that have figures on both segments; None for fewer than two."""
        rows = [(t, s, float(f[s]["sharpe"])) for t, f in self.fitness.items() if "train" in f and "test" in f for s in ("train", "test")]
        return selection_pbo(spark.createDataFrame(rows, "tree_id string, segment string, sharpe double")) if len(rows) >= 4 else None


def discover(bars: DataFrame, size: int = 20, generations: int = 3, seed: int = 42, warm: list[str] | None = None, max_size: int = 40, min_sharpe: float = 0.0, max_complexity: float = 1.0, on_generation: Callable[[dict], None] | None = None, own: dict[str, Callable[[dict], float]] | None = None) -> Discovery:
    """Elitist search by fronts and crowding; formulas that hold on the test segment make the zoo, the best 100 by ratio.

    own: objectives of your own by name, functions of a formula's figures on the train segment (more is better), which join the four.
    """
    own = own or {}
    rng = random.Random(seed)
    population = {t.hash: t for t in [dsl.parse(f) for f in warm or []] + dsl.random_population(size, seed)}
    fitness: dict[str, dict] = {}
    found = Discovery([], fitness, {})

    def score(trees: list[Node]) -> None:
        new = [t for t in trees if t.hash not in fitness]
        for r in formula_fitness(bars, new).collect() if new else []:
            fitness.setdefault(r["tree_id"], {"formula": r["formula"]})[r["segment"]] = r.asDict()

    def objectives(trees: list[Node]) -> np.ndarray:
        out = []
        for t in trees:
            f = fitness.get(t.hash, {}).get("train")
            active = f is not None and (f["trades"] or 0) >= 5
            out.append([*(f[o] for o in OBJECTIVES), *(float(o(f)) for o in own.values())] if active else [-999.0] * (len(OBJECTIVES) + len(own)))
        return np.array(out, dtype=float)

    for generation in range(generations + 1):
        trees = list(population.values())
        score(trees)
        x = objectives(trees)
        rank = pareto_ranks(x)
        crowd = crowding(x, rank)
        order = sorted(range(len(trees)), key=lambda i: (rank[i], -crowd[i], trees[i].hash))[:size]
        trees, x, rank, crowd = [trees[i] for i in order], x[order], rank[order], crowd[order]
        found.history.append({"generation": generation, "best_sharpe": float(x[:, 0].max()), "front": int((rank == 0).sum()), "unique": len(trees)})
        if on_generation:
            on_generation(found.history[-1])
        population = {t.hash: t for t in trees}
        found.population, found.ranks = trees, {t.hash: int(r) for t, r in zip(trees, rank, strict=True)}
        if generation == generations:
            break
        tries = 0
        while len(population) < 2 * size and tries < 20 * size:
            tries += 1
            a, b = (trees[tournament(rank, crowd, rng)] for _ in range(2))
            if rng.random() < 0.9:
                a, b = crossover(a, b, rng)
            for child in (a, b):
                child = mutate(child, rng) if rng.random() < 0.3 else child
                if child.size <= max_size and child.hash not in population:
                    population[child.hash] = child
    for t in found.population:
        f = fitness.get(t.hash, {})
        if "train" in f and "test" in f and f["test"]["sharpe"] >= min_sharpe and t.complexity <= max_complexity and (f["train"]["trades"] or 0) >= 5:
            found.zoo.append({"tree_id": t.hash, "formula": str(t), "train_sharpe": f["train"]["sharpe"], "test_sharpe": f["test"]["sharpe"]})
    found.zoo = sorted(found.zoo, key=lambda z: -z["train_sharpe"])[:100]
    return found


# ---- parameters ------------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Parameter:
    """A range or a list of choices."""

    name: str
    low: float = 0.0
    high: float = 1.0
    step: float | None = None
    log: bool = False
    whole: bool = False
    choices: tuple = ()

    def sample(self, rng: random.Random):
        if self.choices:
            return rng.choice(self.choices)
        value = math.exp(rng.uniform(math.log(self.low), math.log(self.high))) if self.log else rng.uniform(self.low, self.high)
        return round(value) if self.whole else value

    def grid(self, n: int = 10) -> list:
        if self.choices:
            return list(self.choices)
        if self.step:
            values = [self.low + i * self.step for i in range(int((self.high - self.low) / self.step + 1e-9) + 1)]
        else:
            values = (np.geomspace if self.log else np.linspace)(self.low, self.high, n).tolist()
        return list(dict.fromkeys(round(v) if self.whole else v for v in values))


def grid_points(space: list[Parameter], n: int = 10) -> list[dict]:
    if len({p.name for p in space}) != len(space):
        raise ValueError("parameter names must differ")
    return [dict(zip([p.name for p in space], values, strict=True)) for values in itertools.product(*[p.grid(n) for p in space])]


def random_points(space: list[Parameter], n: int, seed: int = 42) -> list[dict]:
    rng = random.Random(seed)
    return [{p.name: p.sample(rng) for p in space} for _ in range(n)]


def sweep(bars: DataFrame, make: Callable[..., Strategy], points: list[dict], objective: str = "sharpe_ratio") -> DataFrame:
    """strategy_id, parameters, symbol and metrics of every point, all in one job, the best first. Points that make no strategy are left out."""
    strategies, named = [], []
    for n, p in enumerate(points):
        try:
            strategies.append(_named(make(**p), f"point-{n}"))
        except (TypeError, ValueError):
            continue
        named.append((f"point-{n}", {k: str(v) for k, v in p.items()}))
    table = bars.sparkSession.createDataFrame(named, "strategy_id string, parameters map<string,string>")
    found = metrics(backtest(bars, strategies)).join(F.broadcast(table), "strategy_id")
    return found.orderBy(F.col(objective).desc_nulls_last(), "strategy_id", "symbol")


def _density(x: float, seen: list[float], low: float, high: float) -> float:
    """Parzen estimate with one normal curve a point and one over the whole range."""
    width = max((high - low) / max(2.0, len(seen) ** 0.5 + 1), 1e-12)
    curve = lambda m, s: math.exp(-(((x - m) / s) ** 2) / 2) / s
    return (sum(curve(m, width) for m in seen) + curve((low + high) / 2, high - low + 1e-12)) / (len(seen) + 1)


def _proposed(space: list[Parameter], done: list[tuple[dict, float]], rng: random.Random, tries: int = 24) -> dict:
    """A point by tree-structured Parzen estimators: of some drawn near the best quarter, the one least like the rest, parameter by parameter."""
    ranked = sorted(done, key=lambda d: -d[1])
    n_good = max(1, len(ranked) // 4)
    good, bad = ([p for p, _ in part] for part in (ranked[:n_good], ranked[n_good:]))
    out = {}
    for p in space:
        if p.choices:
            share = lambda rows, c: (sum(r[p.name] == c for r in rows) + 1) / (len(rows) + len(p.choices))  # noqa: B023, E731
            out[p.name] = max(p.choices, key=lambda c: (share(good, c) / share(bad, c), rng.random()))  # noqa: B023
            continue
        scale = math.log if p.log else float
        low, high = scale(p.low), scale(p.high)
        near, far = ([scale(r[p.name]) for r in rows] for rows in (good, bad))
        width = (high - low) / max(2.0, len(near) ** 0.5 + 1)
        drawn = [min(high, max(low, rng.gauss(rng.choice(near), width))) for _ in range(tries)]
        best = max(drawn, key=lambda x: _density(x, near, low, high) / _density(x, far, low, high))  # noqa: B023
        value = math.exp(best) if p.log else best
        if p.step:
            value = p.low + round((value - p.low) / p.step) * p.step
        out[p.name] = round(value) if p.whole else value
    return out


def optimise(bars: DataFrame, make: Callable[..., Strategy], space: list[Parameter], trials: int = 30, batch: int = 10, sampler: str = "tpe", objective: str = "sharpe_ratio", seed: int = 42, on_batch: Callable[[list], None] | None = None) -> list[tuple[dict, float]]:
    """Points with their objective (mean over symbols), the best first. Each batch of points is one job; `tpe` draws the next batch from what
    the ones before have shown, `random` and `grid` do not."""
    if sampler not in ("tpe", "random", "grid"):
        raise ValueError(f"unknown sampler: {sampler}")
    rng, done = random.Random(seed), []
    waiting = grid_points(space)[:trials] if sampler == "grid" else []
    while len(done) < trials and (sampler != "grid" or waiting):
        n = min(batch, trials - len(done))
        if sampler == "grid":
            points, waiting = waiting[:n], waiting[n:]
        elif sampler == "random" or not done:
            points = [{p.name: p.sample(rng) for p in space} for _ in range(n)]
        else:
            points = [_proposed(space, done, rng) for _ in range(n)]
        found = sweep(bars, make, points, objective).groupBy("strategy_id").agg(F.avg(objective).alias("v")).collect()
        value = {r["strategy_id"]: r["v"] for r in found}
        done += [(p, float(v) if (v := value.get(f"point-{i}")) is not None else -math.inf) for i, p in enumerate(points)]
        if on_batch:
            on_batch(done)
    return sorted(done, key=lambda d: -d[1])


def evolve(bars: DataFrame, templates: dict[str, tuple[Callable[..., Strategy], list[Parameter]]], size: int = 20, generations: int = 3, objective: str = "sharpe_ratio", seed: int = 42, elite: int = 2) -> list[tuple[Strategy, float]]:
    """Templates' parameters by a genetic algorithm: tournaments of three, parameters crossed within a template, one in five drawn anew.

    A generation is one job; strategies that were seen before are not run again.
    """
    rng, values = random.Random(seed), {}

    def born(name: str, params: dict) -> tuple[str, dict, Strategy]:
        s = templates[name][0](**params)
        return name, params, _named(s, s.fingerprint())

    def random_one() -> tuple[str, dict, Strategy]:
        name = rng.choice(sorted(templates))
        return born(name, {p.name: p.sample(rng) for p in templates[name][1]})

    people = [random_one() for _ in range(size)]
    for generation in range(generations + 1):
        new = {s.id: s for _, _, s in people if s.id not in values}
        if new:
            found = metrics(backtest(bars, list(new.values()))).groupBy("strategy_id").agg(F.avg(objective).alias("v")).collect()
            values |= dict.fromkeys(new, -math.inf) | {r["strategy_id"]: float(r["v"]) for r in found if r["v"] is not None}
        people = sorted({s.id: (n, p, s) for n, p, s in people}.values(), key=lambda x: -values[x[2].id])
        if generation == generations:
            break
        children = people[:elite]
        while len(children) < size:
            a, b = (max(rng.sample(people, min(3, len(people))), key=lambda x: values[x[2].id]) for _ in range(2))
            params = {k: rng.choice((a[1][k], b[1][k])) for k in a[1]} if a[0] == b[0] else dict(a[1])
            for p in templates[a[0]][1]:
                if rng.random() < 0.2:
                    params[p.name] = p.sample(rng)
            children.append(born(a[0], params))
        people = children
    return [(s, values[s.id]) for _, _, s in people]


def _named(strategy: Strategy, name: str) -> Strategy:
    return replace(strategy, id=name)


def factory(templates: dict[str, tuple[Callable[..., Strategy], list[Parameter]]], n: int, seed: int = 42) -> list[Strategy]:
    """n different strategies, drawn from templates with random parameters; equal ones (by fingerprint) appear once."""
    rng, out = random.Random(seed), {}
    for _ in range(10 * n):
        make, space = templates[rng.choice(sorted(templates))]
        s = make(**{p.name: p.sample(rng) for p in space})
        out.setdefault(s.fingerprint(), _named(s, s.fingerprint()))
        if len(out) == n:
            break
    return list(out.values())


__all__ = ["discover", "evolve", "factory", "optimise", "pareto_front", "sweep"]
