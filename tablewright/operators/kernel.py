"""Support vector regression: epsilon-insensitive loss on random cosine features of a Gaussian kernel.

The objective is ``|w|^2 / 2 + C * sum of weight * max(0, |y - f(x)| - epsilon)``.  The corners of the loss are rounded over
a width that shrinks to a small share of epsilon; for each width Newton steps are taken, whose gradient and curvature are
sums over the rows, computed inside tasks and added up by one aggregate.  Step lengths are judged by the objective itself,
for all candidates in one pass.  Only sums of the size of the features squared reach the driver.  Rows that fit one task are
solved inside it by the same steps.

Once a corner is narrow, rows far from the edges of the tube pull with all their weight or not at all, and the rest of the way is
solved over the rows near the edges alone: fewer with every width, until one task holds them.  A last pass over all rows makes
sure that no row left out has come to an edge; else the steps over all rows go on.  Many rows start from the solution over a
bounded sample, which is close enough to tell which rows are far; what counts in the end is every row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import one_row

#: Rows that one task solves alone.
HERE_ROWS = 65_536
#: Rows that a task keeps in the last steps, where only those near the edges of the tube matter.
FEW_ROWS = 4_096
#: Shares of a Newton step that are tried in one pass.
STEPS = 0.5 ** np.arange(40)
#: The rounded corner ends at this share of epsilon, and starts at the spread of the target and falls by this factor.
NARROW, FALL = 1e-2, 0.1
#: Above that, rows near the edges are worth a table of their own up to this share of all rows.
SOME = 0.25
#: A step in vain that promised more than this share of the objective is tried again, of so many corners' length at most.
ROUNDING, FAR = 1e-9, 1e3
#: How often rows near the edges are looked up anew, before the steps go over all rows.
LEADS = 4
#: Share of rows that come to an edge from which on the rows near the edges are no guide.
ASTRAY = 0.05
#: How closely the wider corners are solved, which only lead the way.
LEAD_TOL = 1e-3


@dataclass
class Kernel:
    """Random cosine features, and after fitting the weights on them."""

    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    intercept: float = 0.0

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.phase)) * np.cos(x @ self.directions + self.phase)

    def column(self, features: Sequence[Column]) -> Column:
        """The prediction, on Arrow batches."""
        known = self

        @F.pandas_udf("double")
        def value(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            return pd.Series(known.lift(x) @ known.weights + known.intercept)

        return value(*features)


def draw_kernel(rows: DataFrame, names: Sequence[str], gamma: str | float, width: int, seed: int) -> Kernel:
    """``gamma`` is "scale" (one over features times variance of all values), "auto" (one over features) or a number."""
    if gamma == "scale":
        flat = rows.select(F.explode(F.array(*names)).alias("x"))
        spread = one_row(flat, F.var_pop("x").alias("v"))["v"] or 1.0
        value = 1.0 / (len(names) * spread)
    elif gamma == "auto":
        value = 1.0 / len(names)
    else:
        value = float(gamma)
    rng = np.random.default_rng(seed)
    return Kernel(rng.normal(scale=np.sqrt(2 * value), size=(len(names), width)), rng.uniform(0, 2 * np.pi, width))


def rounded_loss(r: np.ndarray, epsilon: float, corner: float) -> np.ndarray:
    over = np.maximum(np.abs(r) - epsilon, 0.0)
    return np.where(over < corner, over * over / (2 * corner), over - corner / 2)


def slope(r: np.ndarray, epsilon: float, corner: float) -> np.ndarray:
    """Its derivative: the share of C that a row takes, with sign."""
    return np.sign(r) * np.clip((np.abs(r) - epsilon) / corner, 0.0, 1.0)


def _lifted(kernel: Kernel, x: np.ndarray) -> np.ndarray:
    return np.column_stack([kernel.lift(x), np.ones(len(x))])


@dataclass(frozen=True)
class Rule:
    """What is minimised, and how closely."""

    C: float
    epsilon: float
    tol: float
    rounds: int


class Held:
    """Rows that one task holds, lifted once."""

    limit = FEW_ROWS

    def __init__(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.z, self.y, self.weight = z, y, weight

    def summed(self, compute, size: int) -> np.ndarray:
        return compute(self.z, self.y, self.weight)

    def near(self, theta: np.ndarray, reach: float, few: bool, pull: np.ndarray, later: Sequence[float], rule: Rule) -> np.ndarray:
        here = np.abs(np.abs(self.y - self.z @ theta) - rule.epsilon) <= reach
        return solve(Held(self.z[here], self.y[here], self.weight[here]), theta, later, rule, pull)


class Spread:
    """Rows of a table: sums are taken inside tasks and added up by one aggregate."""

    def __init__(self, rows: DataFrame, names: Sequence[str], kernel: Kernel, limit: int):
        self.rows, self.names, self.kernel, self.limit = rows, list(names), kernel, limit

    def summed(self, compute, size: int) -> np.ndarray:
        """Sum over all rows of the vectors that ``compute(z, y, weight)`` gives for batches."""
        names, kernel = self.names, self.kernel

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(size)
            for batch in batches:
                if len(batch):
                    total += compute(_lifted(kernel, batch[names].to_numpy(float)), batch["_label"].to_numpy(float), batch["_weight"].to_numpy(float))
            yield pd.DataFrame({"i": np.arange(size, dtype=np.int32), "v": total})

        found = np.zeros(size)
        for row in self.rows.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # size numbers
            found[row["i"]] = row["v"]
        return found

    def near(self, theta: np.ndarray, reach: float, few: bool, pull: np.ndarray, later: Sequence[float], rule: Rule) -> np.ndarray:
        names, kernel = self.names, self.kernel

        def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                r = batch["_label"].to_numpy(float) - _lifted(kernel, batch[names].to_numpy(float)) @ theta
                yield batch[np.abs(np.abs(r) - rule.epsilon) <= reach]

        some = self.rows.mapInPandas(picked, self.rows.schema)
        if few:
            return _alone(some, names, kernel, theta, later, rule, pull)  # at most ``limit`` rows
        kept = some.persist()
        try:
            return solve(Spread(kept, names, kernel, self.limit), theta, later, rule, pull)
        finally:
            kept.unpersist()


def _alone(rows: DataFrame, names: Sequence[str], kernel: Kernel, theta: np.ndarray, corners: Sequence[float], rule: Rule, pull: np.ndarray) -> np.ndarray:
    """The solution over rows that fit one task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*names, "_label", "_weight"])
        held = Held(_lifted(kernel, frame[list(names)].to_numpy(float)), frame["_label"].to_numpy(float), frame["_weight"].to_numpy(float))
        return pd.DataFrame({"theta": [solve(held, theta, corners, rule, pull).tolist()]})

    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "theta array<double>").first()
    return np.array(found["theta"]) if found else theta


def corners_of(spread: float, epsilon: float) -> list[float]:
    widest = max(spread, epsilon, 1e-9)
    last = max(NARROW * epsilon, 1e-9 * widest)
    corners, corner = [], widest
    while corner > last:
        corners.append(corner)
        corner *= FALL
    return [*corners, last]


def newton(rows: Held | Spread, theta: np.ndarray, corner: float, rule: Rule, pull: np.ndarray, tol: float) -> np.ndarray:
    """The minimum for one width of the corner.  ``pull`` is the gradient of what is linear around ``theta``."""
    size, C, epsilon = len(theta), rule.C, rule.epsilon
    upper = np.triu_indices(size)
    plain = np.append(np.ones(size - 1), 0.0)  # the intercept is free
    for _ in range(rule.rounds):

        def derivatives(z, y, weight, theta=theta) -> np.ndarray:
            r = y - z @ theta
            over = np.abs(r) - epsilon
            inside = (over > 0) & (over < corner)
            bent = z[inside] * np.sqrt(weight[inside] / corner)[:, None]
            return np.concatenate([-(z.T @ (weight * slope(r, epsilon, corner))), (bent.T @ bent)[upper]])

        found = rows.summed(derivatives, size + len(upper[0]))
        gradient = plain * theta + pull + C * found[:size]
        curve = np.zeros((size, size))
        curve[upper] = C * found[size:]
        curve = curve + np.triu(curve, 1).T + np.diag(plain)
        curve[-1, -1] += 1e-9 * (1.0 + curve[-1, -1])
        step = np.linalg.solve(curve, -gradient)
        downhill = float(-gradient @ step)
        if downhill <= tol * tol * (1.0 + 0.5 * theta[:-1] @ theta[:-1]):
            break

        def tried(step: np.ndarray, downhill: float, theta=theta) -> tuple[np.ndarray | None, float]:
            """The best share of a step, none if no share goes down; and the objective before."""

            def losses(z, y, weight) -> np.ndarray:
                r, move = y - z @ theta, z @ step
                return np.array([(weight * rounded_loss(r - t * move, epsilon, corner)).sum() for t in (0.0, *STEPS)])

            at = np.array([theta, *[theta + t * step for t in STEPS]])
            values = 0.5 * (at[:, :-1] ** 2).sum(axis=1) + (at - theta) @ pull + C * rows.summed(losses, len(STEPS) + 1)
            good = values[1:] <= values[0] - 1e-4 * STEPS * downhill
            return (theta + STEPS[int(np.argmin(np.where(good, values[1:], np.inf)))] * step if good.any() else None), float(values[0])

        better, now = tried(step, downhill)
        if better is None and downhill > ROUNDING * (1.0 + abs(now)):
            # no row in the corner bends the way: a step of a bounded length
            short = np.linalg.solve(curve + np.eye(size) * (np.linalg.norm(gradient) / (FAR * corner)), -gradient)
            better, _ = tried(short, float(-gradient @ short))
        if better is None:
            break  # rounding decides from here on
        theta = better
    return theta


def settled(rows: Held | Spread, theta: np.ndarray, corner: float, later: Sequence[float], rule: Rule, pull: np.ndarray, least: float = 0.0) -> np.ndarray | None:
    """The end of the path from the rows near the edges of the tube; none if they are too many or too many others come to lie there.

    Where a few others do, the rows near the edges are looked up anew around the solution without them."""
    for _ in range(LEADS):
        theta, crossed = _near_edges(rows, theta, corner, later, rule, pull, least)
        if not crossed:
            return theta
        if crossed > ASTRAY:
            break
    return None


def _near_edges(rows: Held | Spread, theta: np.ndarray, corner: float, later: Sequence[float], rule: Rule, pull: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """The end of the path from the rows near the edges, and the share of the others that come to lie there (all, if too many are near).

    A row far outside the tube pulls with its whole weight, a row far inside does not pull: what they add to the objective is
    linear, until one of them crosses.  That is looked up for every row before the result counts.  ``least`` is a share of the
    rows that is taken even where it is more than one task holds."""
    reaches = 4.0 * corner * 2.0 ** np.arange(24)
    epsilon, size, places = rule.epsilon, len(theta), len(reaches) + 1

    def over(z: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = y - z @ at
        return r, np.abs(r) - epsilon

    def rings(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Between one reach and the next: how many rows, and the pull of those outside the tube."""
        r, out = over(z, y, theta)
        ring = np.searchsorted(reaches, np.abs(out))
        heavy = np.zeros((len(y), places))
        heavy[np.arange(len(y)), ring] = np.where(out > 0, weight * np.sign(r), 0.0)
        return np.concatenate([np.bincount(ring, minlength=places), (heavy.T @ z).ravel()])

    found = rows.summed(rings, places * (1 + size))
    counts, pulls = np.cumsum(found[:places]), found[places:].reshape(places, size)
    some = counts[:-1] <= max(rows.limit, least * counts[-1])
    some = some if some.any() else counts[:-1] <= SOME * counts[-1]
    if not some.any():
        return theta, 1.0
    last = int(np.flatnonzero(some)[-1])
    reach, few = float(reaches[last]), bool(counts[last] <= rows.limit)
    later = [c for c in later if c <= reach / 8] or later[-1:]  # theta is closer than that already
    more = -rule.C * pulls[last + 1 :].sum(axis=0)
    found = rows.near(theta, reach, few, pull + more, later, rule)

    def crossed(z: np.ndarray, y: np.ndarray, _: np.ndarray) -> np.ndarray:
        (r, out), (new_r, new_out) = over(z, y, theta), over(z, y, found)
        kept = np.where(out > reach, (np.sign(r) == np.sign(new_r)) & (new_out >= later[-1]), (out >= -reach) | (new_out <= 0))
        return np.array([float((~kept).sum())])

    return found, float(rows.summed(crossed, 1)[0]) / counts[-1]


def solve(rows: Held | Spread, theta: np.ndarray, corners: Sequence[float], rule: Rule, pull: np.ndarray) -> np.ndarray:
    """Weights and intercept, along falling widths of the corner; wide ones only lead the way."""
    many = rows.limit < (len(rows.y) if isinstance(rows, Held) else np.inf)
    for at, corner in enumerate(corners):
        later = corners[at + 1 :]
        theta = newton(rows, theta, corner, rule, pull, max(rule.tol, LEAD_TOL) if later else rule.tol)
        done = settled(rows, theta, corner, later, rule, pull) if many and later else None
        if done is not None:
            return done
    return theta


def fit_svr(
    rows: DataFrame, names: Sequence[str], C: float, epsilon: float, gamma: str | float = "scale", width: int = 100, seed: int = 0, tol: float = 1e-6,
    rounds: int = 60, here: int = HERE_ROWS,
) -> Kernel:
    """Fit on ``names``, ``_label`` and ``_weight``.  ``width`` is the number of cosine features.

    At the end every row inside the tube has no share in the weights, every row outside it the share C, and rows on its
    edge, within NARROW * epsilon, something between: the optimality conditions up to the rounding.
    """
    names = list(names)
    rows = rows.select(*names, "_label", "_weight").filter("_weight > 0")
    kernel = draw_kernel(rows, names, gamma, width, seed)
    facts = one_row(rows, F.count("*").alias("n"), F.avg("_label").alias("m"), F.stddev_pop("_label").alias("s"))
    theta = np.append(np.zeros(width), float(facts["m"] or 0.0))
    corners, rule, pull = corners_of(float(facts["s"] or 0.0), epsilon), Rule(C, epsilon, tol, rounds), np.zeros(width + 1)
    if facts["n"] <= here:
        theta = _alone(rows, names, kernel, theta, corners, rule, pull)
    else:
        every = Spread(rows, names, kernel, here)
        share = here / facts["n"]
        drawn = F.pmod(F.xxhash64(*names, "_label", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))  # the same rows however they lie
        lead = rows.filter(drawn).groupBy(*names, "_label").agg((F.sum("_weight") / F.lit(share)).alias("_weight"))
        first = _alone(lead, names, kernel, theta, corners, rule, pull)  # about ``here`` rows, or fewer
        done = settled(every, first, corners[0] * FALL**4, corners[1:], rule, pull, SOME) if len(corners) > 1 else None
        theta = solve(every, theta, corners, rule, pull) if done is None else done
    kernel.weights, kernel.intercept = theta[:-1], float(theta[-1])
    return kernel
