"""Score distributions: the chances of scores (i, j) from 0-0 to 8-8, and what is read off them.

A match carries its distribution as one struct: the chances of each side's goals (two arrays), the rates and rho for the four
low scores that depend on each other, and the sums and scales of the three regions (home win, draw, away win).  Region sums
come from running sums of one side's chances and corrections of the low scores, so making, projecting and reading off a
distribution touches no cell; a cell is one product.  Only exploded rows (81 a match) hold all cells, and they need no shuffle.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind

SIZE = 9
REGIONS = ("h", "d", "a")


def poisson(k: int, rate: Column) -> Column:
    return F.exp(-rate + k * F.log(rate)) / math.factorial(k)


def tau(i: int, j: int, lam: Column, mu: Column, rho: Column) -> Column | float:
    """Dependence of low scores."""
    return {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}.get((i, j), 1.0)


def chances(rate: Column, size: int = SIZE) -> Column:
    """Array of the Poisson chances of 0 to size - 1 goals."""
    return F.array(*[F.exp(-rate) * F.pow(rate, F.lit(k)) / math.factorial(k) for k in range(size)])


def cells(lam: Column, mu: Column, rho: Column | None = None, size: int = SIZE) -> Column:
    """The distribution of scores, normalised; name it by withColumn before reading it off more than once."""
    base = F.struct(chances(lam, size).alias("x"), chances(mu, size).alias("y"), lam.alias("l"), mu.alias("u"), (rho if rho is not None else F.lit(0.0)).alias("r"))

    def sums(b):
        x, y = ([b[side][k] for k in range(2)] for side in "xy")
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", *REGIONS)])

        def add(s, k):
            p, q = F.get(b["x"], k), F.get(b["y"], k)
            return F.struct((s["x"] + p).alias("x"), (s["y"] + q).alias("y"), (s["h"] + p * s["y"]).alias("h"), (s["d"] + p * q).alias("d"), (s["a"] + q * s["x"]).alias("a"))

        def regions(c):
            low = {s: x[s[0]] * y[s[1]] * (tau(*s, b["l"], b["u"], b["r"]) - 1) for s in ((0, 0), (0, 1), (1, 0), (1, 1))}
            return F.struct((c["h"] + low[1, 0]).alias("h"), (c["d"] + low[0, 0] + low[1, 1]).alias("d"), (c["a"] + low[0, 1]).alias("a"))

        part = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), zero, add)
        share = lambda s: {r: s[r] / (s["h"] + s["d"] + s["a"]) for r in REGIONS}
        return bind(bind(part, regions), lambda s: _distribution(b, {r: 1 / (s["h"] + s["d"] + s["a"]) for r in REGIONS}, share(s)))

    return bind(base, sums)


def _distribution(b: Column, scale: dict[str, Column], sums: dict[str, Column]) -> Column:
    return F.struct(*[b[k].alias(k) for k in "xylur"], *[c.alias(f"by_{r}") for r, c in scale.items()], *[c.alias(r) for r, c in sums.items()])


def outcome(grid: Column) -> dict[str, Column]:
    return {r: grid[r] for r in REGIONS}


def projected(grid: Column, target: dict[str, Column]) -> Column:
    """The distribution rescaled so that its regions sum to `target`; an empty region stays empty."""
    def rescaled(g):
        kept = {r: F.when(g["of"][r] > 0, g["to"][r]).otherwise(0.0) for r in REGIONS}
        whole = kept["h"] + kept["d"] + kept["a"]
        scale = {r: F.when(g["of"][r] > 0, g["of"][f"by_{r}"] * g["to"][r] / g["of"][r] / whole).otherwise(0.0) for r in REGIONS}
        return _distribution(g["of"], scale, {r: kept[r] / whole for r in REGIONS})

    return bind(F.struct(grid.alias("of"), F.struct(*[target[r].alias(r) for r in REGIONS]).alias("to")), rescaled)


def cell(grid: Column, i: int, j: int) -> Column:
    """The chance of one score."""
    p = grid["x"][i] * grid["y"][j] * grid[f"by_{'h' if i > j else 'd' if i == j else 'a'}"]
    return p * tau(i, j, grid["l"], grid["u"], grid["r"]) if i < 2 and j < 2 else p


def score_rows(df: DataFrame, *keep: str, name: str = "grid", size: int = SIZE) -> DataFrame:
    """(keep.., i, j, p): a row a score; the scores are exploded first, so each row's chance is plain arithmetic."""
    g, i, j = F.col(name), F.col("i"), F.col("j")
    rows = df.select(*keep, name, F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("_k"))
    rows = rows.select(*keep, name, F.expr(f"cast(_k div {size} as int)").alias("i"), F.expr(f"_k % {size}").alias("j"))
    low = F.when((i > 1) | (j > 1), 1.0)
    for s in ((0, 0), (0, 1), (1, 0), (1, 1)):
        low = low.when((i == s[0]) & (j == s[1]), tau(*s, g["l"], g["u"], g["r"]))
    by = F.when(i > j, g["by_h"]).when(i == j, g["by_d"]).otherwise(g["by_a"])
    return rows.select(*keep, "i", "j", (F.get(g["x"], i) * F.get(g["y"], j) * low * by).alias("p"))


def rounded_chance(p: Column, digits: int = 6) -> Column:
    """round(p, digits) of a chance: arithmetic gives the same but near a half, where the decimal that is written decides."""
    y = p * 10.0**digits
    return F.when(F.abs(y - F.rint(y)) < 0.499, F.rint(y) / 10.0**digits).otherwise(F.round(p, digits)) + F.lit(0.0)


def over(grid: Column, line: float = 2.5) -> Column:
    """Chance of more goals than the line: one less the few scores up to it."""
    few = [(i, j) for i in range(int(line) + 1) for j in range(int(line) + 1 - i)]
    return 1 - sum((cell(grid, *s) for s in few[1:]), cell(grid, *few[0]))


def _half_up(p: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark rounds: by the decimal that is written for a number, halves up."""
    y = p * 10.0**digits
    out = np.rint(y) / 10.0**digits
    for at in zip(*np.nonzero(np.abs(y - np.rint(y)) > 0.499)):
        out[at] = float(Decimal(repr(float(p[at]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def top_scores(grid: Column, k: int, digits: int | None = None, size: int = SIZE) -> Column:
    """The k likeliest scores (i, j, p), ties in row order; chances are rounded to `digits` before they are compared, if given.

    For single rows; `likeliest` is for tables, as an expression a cell makes methods that the JVM won't compile."""
    down = lambda p: -(F.round(p, digits) if digits is not None else p)
    every = F.array(*[F.struct(down(cell(grid, i, j)).alias("down"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(size) for j in range(size)])
    return F.transform(F.slice(F.sort_array(every), 1, k), lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"), (-c["down"]).alias("p")))


def likeliest(k: int, digits: int | None = None, name: str = "grid", size: int = SIZE) -> Column:
    """The same of the distribution in the column `name`: a batch's cells are one array.  Spark can't pass it on unnamed."""
    i, j = np.divmod(np.arange(size * size), size)
    by = np.where(i > j, 0, np.where(i == j, 1, 2))

    def run(x: pa.Array, y: pa.Array, l: pa.Array, u: pa.Array, r: pa.Array, h: pa.Array, d: pa.Array, a: pa.Array) -> pa.Array:  # noqa: E741
        n = len(l)
        doubles = lambda v: v.to_numpy(zero_copy_only=False).astype(float)
        x, y = (np.stack([doubles(pc.list_element(v, at)) for at in range(size)], axis=1) for v in (x, y))
        l, u, r = map(doubles, (l, u, r))  # noqa: E741
        p = x[:, i] * y[:, j] * np.stack([doubles(v) for v in (h, d, a)], axis=1)[:, by]
        for s in ((0, 0), (0, 1), (1, 0), (1, 1)):
            p[:, s[0] * size + s[1]] *= tau(*s, l, u, r)
        p = p if digits is None else _half_up(p, digits)
        left, rows = np.where(np.isnan(p), -1 - np.arange(size * size), p), np.arange(n)
        best = np.zeros((n, k), np.int64)
        for at in range(k):  # the first of equals
            best[:, at] = left.argmax(axis=1)
            left[rows, best[:, at]] = -np.inf
        found = best.ravel()
        values = pa.array(p[rows[:, None], best].ravel(), from_pandas=True)
        cells_ = pa.StructArray.from_arrays([pa.array(i[found].astype(np.int32)), pa.array(j[found].astype(np.int32)), values], ["i", "j", "p"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), cells_)

    return F.arrow_udf(run, "array<struct<i:int,j:int,p:double>>")(*[F.col(name)[c] for c in ("x", "y", "l", "u", "r", "by_h", "by_d", "by_a")])


def over_line(rate: Column, line: float) -> Column:
    """Chance that a Poisson count exceeds the line."""
    return 1 - sum((poisson(k, rate) for k in range(1, int(line) + 1)), poisson(0, rate))


def from_gap(gap: Column) -> tuple[Column, Column]:
    """Goal rates of both sides from a rating gap."""
    sup = (gap + 65) / 190
    goals = 2.6 + F.least(0.55 * F.abs(sup), F.lit(0.9))
    clip = lambda x: F.greatest(F.least(x, F.lit(5.0)), F.lit(0.2))
    return clip((goals + sup) / 2), clip((goals - sup) / 2)


def rho_likelihood(m: DataFrame, lam: str, mu: str, rhos: list[float]) -> DataFrame:
    """(rho, nll): the part of the negative log-likelihood that depends on rho, for each of a list, in one pass.

    Only scores up to 1-1 depend on rho.  The rows are summed before they are grouped.
    """
    low = m.where("hg <= 1 and ag <= 1")
    l, u, r = F.col(lam), F.col(mu), F.col("rho")
    t = F.when((F.col("hg") == 0) & (F.col("ag") == 0), tau(0, 0, l, u, r)).when(F.col("hg") == 0, tau(0, 1, l, u, r)).when(F.col("ag") == 0, tau(1, 0, l, u, r)).otherwise(tau(1, 1, l, u, r))
    return low.select("hg", "ag", lam, mu, F.explode(F.array(*map(F.lit, rhos))).alias("rho")).groupBy("rho").agg(F.sum(-F.log(F.greatest(t, F.lit(1e-6)))).alias("nll"))


def fit_rho(m: DataFrame, lam: str = "lam", mu: str = "mu", rounds: int = 3) -> float:
    """The rho in [-0.2, 0.2] of least negative log-likelihood, on a grid refined `rounds` times."""
    lo, hi = -0.2, 0.2
    for _ in range(rounds):
        step = (hi - lo) / 20
        rows = rho_likelihood(m, lam, mu, [lo + k * step for k in range(21)]).collect()  # 21 rows
        best = min(rows, key=lambda r: (r["nll"], r["rho"]))["rho"] if rows else 0.0
        lo, hi = max(best - step, -0.2), min(best + step, 0.2)
    return best
