"""The typed expression language: formulas of 34 operators over bar columns, compiled to one Column.

A formula reads `ts_mean(sub(close, open), 20)`. Types: series, window (2 to 252), scalar (-10 to 10), boolean (a series of 0 and 1).
Compilation checks types and raises; the result is one nested Column, whose windows Catalyst puts in order by itself.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.core import change, div, finite, full, lag, last

SERIES, WINDOW, SCALAR, BOOLEAN = "series", "window", "scalar", "boolean"
#: Columns that a formula can name. Fixed values.
TERMINALS = ("open", "high", "low", "close", "volume", "returns", "vwap", "adj_close")
_S, _SS, _SW, _SSW = (SERIES,), (SERIES, SERIES), (SERIES, WINDOW), (SERIES, SERIES, WINDOW)
#: Argument types and result type of each operator. Fixed values.
SIGNATURES: dict[str, tuple[tuple[str, ...], str]] = {
    "add": (_SS, SERIES), "sub": (_SS, SERIES), "mul": (_SS, SERIES), "div": (_SS, SERIES),
    "abs": (_S, SERIES), "neg": (_S, SERIES), "log": (_S, SERIES), "sqrt": (_S, SERIES), "sign": (_S, SERIES), "power": ((SERIES, SCALAR), SERIES),
    "delay": (_SW, SERIES), "delta": (_SW, SERIES), "ts_mean": (_SW, SERIES), "ts_std": (_SW, SERIES), "ts_min": (_SW, SERIES), "ts_max": (_SW, SERIES), "ts_sum": (_SW, SERIES),
    "ts_rank": (_SW, SERIES), "ts_argmax": (_SW, SERIES), "ts_argmin": (_SW, SERIES), "ts_corr": (_SSW, SERIES), "ts_cov": (_SSW, SERIES),
    "rank": (_S, SERIES), "scale": (_S, SERIES), "zscore": (_S, SERIES),
    "gt": (_SS, BOOLEAN), "lt": (_SS, BOOLEAN), "gte": (_SS, BOOLEAN), "lte": (_SS, BOOLEAN), "eq": (_SS, BOOLEAN),
    "and_": ((BOOLEAN, BOOLEAN), BOOLEAN), "or_": ((BOOLEAN, BOOLEAN), BOOLEAN), "not_": ((BOOLEAN,), BOOLEAN), "if_else": ((BOOLEAN, SERIES, SERIES), SERIES),
}


def accepts(wanted: str, given: str) -> bool:
    """Booleans are series of 0 and 1, and numbers stand for constant series."""
    return wanted == given or wanted == SERIES and given in (BOOLEAN, SCALAR) or wanted == BOOLEAN and given == SERIES or wanted == SCALAR and given == WINDOW


def returning(kind: str) -> list[str]:
    return [n for n, (_, out) in SIGNATURES.items() if out == kind]


def accepting(kind: str) -> list[str]:
    return [n for n, (args, _) in SIGNATURES.items() if any(accepts(a, kind) for a in args)]


@dataclass(frozen=True)
class Node:
    """An operator with its arguments, a column, or a number."""

    name: str
    args: tuple[Node, ...] = ()
    value: float | None = None

    @property
    def kind(self) -> str:
        if self.value is not None:
            return WINDOW if float(self.value).is_integer() and 2 <= self.value <= 252 else SCALAR
        return SIGNATURES[self.name][1] if self.name in SIGNATURES else SERIES

    def __str__(self) -> str:
        if self.value is not None:
            return f"{self.value:g}"
        return f"{self.name}({', '.join(map(str, self.args))})" if self.args else self.name

    def __iter__(self):
        """All nodes, the root first."""
        yield self
        for a in self.args:
            yield from a

    @property
    def size(self) -> int:
        return sum(1 for _ in self)

    @property
    def depth(self) -> int:
        return 1 + max((a.depth for a in self.args), default=0)

    @property
    def hash(self) -> str:
        return hashlib.md5(str(self).encode()).hexdigest()[:12]

    @property
    def complexity(self) -> float:
        return self.size / 50 + self.depth / 8 + 0.1 * sum(n.name in ("ts_corr", "ts_cov", "ts_rank") for n in self)

    def at(self, index: int) -> Node:
        return list(self)[index]

    def put(self, index: int, new: Node) -> Node:
        """The tree with its index-th node (root first) replaced."""
        if index == 0:
            return new
        index -= 1
        args = list(self.args)
        for i, a in enumerate(args):
            if index < a.size:
                args[i] = a.put(index, new)
                return replace(self, args=tuple(args))
            index -= a.size
        raise IndexError("no such node")


_TOKEN = re.compile(r"\s*([A-Za-z_]\w*|-?\d+(?:\.\d+)?(?:[eE]-?\d+)?|[(),])")


def parse(formula: str) -> Node:
    tokens, at = [], 0
    formula = formula.strip()
    while at < len(formula):
        found = _TOKEN.match(formula, at)
        if not found:
            raise ValueError(f"cannot read {formula[at:]!r}")
        tokens.append(found[1])
        at = found.end()
    place = 0

    def one() -> Node:
        nonlocal place
        if place >= len(tokens):
            raise ValueError("the formula ends too early")
        token = tokens[place]
        place += 1
        if re.fullmatch(r"-?\d.*", token):
            return Node("constant", value=float(token))
        if place < len(tokens) and tokens[place] == "(":
            if token not in SIGNATURES:
                raise ValueError(f"unknown operator: {token}")
            place += 1
            args = [one()]
            while place < len(tokens) and tokens[place] == ",":
                place += 1
                args.append(one())
            if place >= len(tokens) or tokens[place] != ")":
                raise ValueError("a bracket is not closed")
            place += 1
            return check(Node(token, tuple(args)))
        if token not in TERMINALS:
            raise ValueError(f"unknown column: {token}")
        return Node(token)

    tree = one()
    if place != len(tokens):
        raise ValueError(f"left over: {tokens[place:]}")
    return tree


def check(node: Node) -> Node:
    wanted = SIGNATURES[node.name][0]
    if len(wanted) != len(node.args):
        raise ValueError(f"{node.name} takes {len(wanted)} arguments")
    for w, a in zip(wanted, node.args, strict=True):
        if not accepts(w, a.kind) or w == WINDOW and a.value is None:
            raise ValueError(f"{node.name} cannot take {a} as {w}")
    return node


def _flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("double")


def _ranked(x: Column, n: int) -> Column:
    held = F.collect_list(x).over(last(n))
    return F.when(x.isNotNull() & (F.size(held) >= 2), div(F.size(F.filter(held, lambda v: v < x)).cast("double"), F.size(held) - 1))


def _since(x: Column, n: int, best) -> Column:
    held = F.collect_list(x).over(last(n))
    return F.when(x.isNotNull(), (F.size(held) - F.array_position(held, best(held))).cast("double"))


def _pair(x: Column, y: Column, n: int, correlation: bool) -> Column:
    """Correlation or sample covariance of rows that have both, of two and of half the window at least.

    Made of population moments, as the sample forms raise for a frame of one row under ANSI rules.
    """
    x, y, over = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y), last(n)
    rows, together = F.count(x).over(over), F.covar_pop(x, y).over(over)
    value = div(together, F.stddev_pop(x).over(over) * F.stddev_pop(y).over(over)) if correlation else div(together * rows, rows - 1)
    return F.when(rows >= max(2, n // 2), value)


def _build(node: Node) -> Column | float:
    if node.value is not None:
        return node.value
    if not node.args:
        named = {"returns": change("close"), "vwap": (F.col("high") + F.col("low") + F.col("close")) / 3, "adj_close": F.col("close")}
        return named.get(node.name, F.col(node.name))
    wanted, _ = SIGNATURES[node.name]
    args = [_build(a) if w in (SERIES, BOOLEAN) else a.value for w, a in zip(wanted, node.args, strict=True)]
    args = [F.lit(float(a)) if w in (SERIES, BOOLEAN) and isinstance(a, (int, float)) else a for w, a in zip(wanted, args, strict=True)]
    x, y, z = [*args, None, None][:3]
    n = int(args[-1]) if wanted[-1] == WINDOW else 0
    tops = {
        "add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y, "div": lambda: div(x, y), "abs": lambda: F.abs(x), "neg": lambda: -x,
        "log": lambda: F.when(x.isNotNull(), F.log(F.greatest(x, F.lit(1e-10)))), "sqrt": lambda: F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0)))),
        "sign": lambda: F.signum(x), "power": lambda: finite(F.pow(x, F.lit(float(y)))),
        "delay": lambda: lag(x, n), "delta": lambda: x - lag(x, n), "ts_mean": lambda: F.avg(x).over(last(n)), "ts_std": lambda: F.stddev_samp(x).over(last(n)),
        "ts_min": lambda: F.min(x).over(last(n)), "ts_max": lambda: F.max(x).over(last(n)), "ts_sum": lambda: F.sum(x).over(last(n)),
        "ts_rank": lambda: _ranked(x, n), "ts_argmax": lambda: _since(x, n, F.array_max), "ts_argmin": lambda: _since(x, n, F.array_min),
        "ts_corr": lambda: _pair(x, y, n, True), "ts_cov": lambda: _pair(x, y, n, False), "rank": lambda: _ranked(x, 252),
        "scale": lambda: full(x, 252, div(x, F.sum(F.abs(x)).over(last(252))), 20),
        "zscore": lambda: full(x, 252, div(x - F.avg(x).over(last(252)), F.stddev_samp(x).over(last(252))), 20),
        "gt": lambda: _flag(x > y), "lt": lambda: _flag(x < y), "gte": lambda: _flag(x >= y), "lte": lambda: _flag(x <= y), "eq": lambda: _flag(x == y),
        "and_": lambda: _flag((x > 0) & (y > 0)), "or_": lambda: _flag(F.coalesce(x > 0, F.lit(False)) | F.coalesce(y > 0, F.lit(False))), "not_": lambda: _flag(x <= 0),
        "if_else": lambda: F.when(x > 0, y).otherwise(z),
    }
    return tops[node.name]()


def compile_formula(formula: str | Node) -> Column:
    """A Column of the formula's values; not finite numbers become NULL."""
    built = _build(parse(formula) if isinstance(formula, str) else formula)
    return finite((F.lit(built) if isinstance(built, float) else built).cast("double"))


def evaluate(df: DataFrame, formulas: dict[str, str | Node]) -> DataFrame:
    """df with one column for each formula, all in one plan."""
    return df.select("*", *[compile_formula(f).alias(n) for n, f in formulas.items()])


def cross_section_rank(x: Column | str) -> Column:
    """Rank of x among the symbols of one time, from 0 to 1."""
    from pyspark.sql import Window

    return F.percent_rank().over(Window.partitionBy("ts").orderBy(x))


def random_tree(rng: random.Random, kind: str = SERIES, depth: int = 4, grow: bool | None = None) -> Node:
    """A random tree; grow may stop early, full goes to the depth, and by default one of both is picked."""
    grow = rng.random() < 0.5 if grow is None else grow
    if kind == WINDOW:
        return Node("constant", value=float(rng.randint(2, 252)))
    if kind == SCALAR:
        return Node("constant", value=round(rng.uniform(-10, 10), 4))
    names = returning(BOOLEAN if kind == BOOLEAN else SERIES)
    if depth <= 1 or grow and rng.random() < 0.3 and kind == SERIES:
        if kind == BOOLEAN:
            return Node(rng.choice(["gt", "lt"]), (Node(rng.choice(TERMINALS)), Node(rng.choice(TERMINALS))))
        return Node(rng.choice(TERMINALS))
    name = rng.choice(names)
    return Node(name, tuple(random_tree(rng, k, depth - 1, grow) for k in SIGNATURES[name][0]))


def random_population(size: int, seed: int, depth: int = 4) -> list[Node]:
    rng, found = random.Random(seed), {}
    for _ in range(10 * size):
        tree = random_tree(rng, depth=depth)
        found.setdefault(tree.hash, tree)
        if len(found) == size:
            break
    return list(found.values())
