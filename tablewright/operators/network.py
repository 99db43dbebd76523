"""Networks of rectified units for numbers and classes, trained by mini-batches inside tasks.

Equal rows become one weighted point, points are dealt by hash into slices, and a slice is one row of packed arrays.  A round
is one pass: every slice starts from the shared state, takes Adam steps over its own mini-batches, and the states come back
as sums weighted by the slice's rows, added up in the tasks before they are shuffled.  The driver sees one state per round.
One slice is solved inside its task by the same rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import one_row

#: Points of a slice, points of a mini-batch.
SLICE_POINTS, BATCH = 65_536, 200
#: Adam's decay of the two moments, and what keeps its division defined.
FIRST, SECOND, TINY = 0.9, 0.999, 1e-8
#: Rounds without a gain of TOLERANCE end the training.
TOLERANCE, PATIENCE = 1e-4, 10
#: One point in so many decides when a network for numbers stops; it takes no part in the steps.
HELD = 5


@dataclass(frozen=True)
class Training:
    """Sizes and rates; ``alpha`` is the weight decay, divided by the points of a batch."""

    sizes: tuple[int, ...]
    classes: bool
    alpha: float
    rate: float
    rounds: int
    seed: int

    @property
    def shapes(self) -> list[tuple[int, int]]:
        return list(zip(self.sizes[:-1], self.sizes[1:], strict=True))

    @property
    def size(self) -> int:
        return sum(a * b + b for a, b in self.shapes)

    def start(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.concatenate([rng.uniform(-1, 1, a * b + b) * np.sqrt(6.0 / (a + b)) for a, b in self.shapes])


def layers(theta: np.ndarray, shapes: Sequence[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights and biases of every layer, as views of one vector."""
    made, at = [], 0
    for a, b in shapes:
        made.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return made


def forward(theta: np.ndarray, rule: Training, x: np.ndarray) -> list[np.ndarray]:
    """What every layer gives; the last one chances (classes) or numbers."""
    made = [x]
    parts = layers(theta, rule.shapes)
    for i, (weights, bias) in enumerate(parts):
        z = made[-1] @ weights + bias
        if i < len(parts) - 1:
            z = np.maximum(z, 0.0)
        elif rule.classes:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
        made.append(z)
    return made


def loss_and_gradient(theta: np.ndarray, rule: Training, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss of a batch with its weight decay, and the slope in every weight and bias."""
    n = len(x)
    made = forward(theta, rule, x)
    out = made[-1]
    if rule.classes:
        at = np.arange(n), y.astype(int)
        loss = -(share * np.log(np.maximum(out[at], 1e-300))).sum() / n
        back = out.copy()
        back[at] -= 1.0
    else:
        back = out - y[:, None]
        loss = 0.5 * (share[:, None] * back**2).sum() / n
    back = back * share[:, None] / n
    slope = np.empty_like(theta)
    own, into = layers(theta, rule.shapes), layers(slope, rule.shapes)
    for i in range(len(own) - 1, -1, -1):
        into[i][0][:] = made[i].T @ back + rule.alpha / n * own[i][0]
        into[i][1][:] = back.sum(axis=0)
        if i:
            back = (back @ own[i][0].T) * (made[i] > 0)
    decay = sum((weights**2).sum() for weights, _ in own)
    return loss + 0.5 * rule.alpha * decay / n, slope


@dataclass
class State:
    """Shared weights, Adam's moments and the number of steps taken."""

    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: float = 0.0

    def packed(self) -> np.ndarray:
        return np.concatenate([self.theta, self.first, self.second, [self.steps]])

    @staticmethod
    def unpacked(flat: np.ndarray) -> State:
        size = (len(flat) - 1) // 3
        return State(flat[:size].copy(), flat[size : 2 * size].copy(), flat[2 * size : 3 * size].copy(), float(flat[-1]))


#: Behind the summed state: weight, loss, and of held points weight, label, its square, squared error.
FACTS = 6


def slice_round(state: State, rule: Training, number: int, turn: int, x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray) -> np.ndarray:
    """One slice's part of a round: its state times its weight, and the facts that decide when to stop."""
    now = State.unpacked(state.packed())
    facts = np.zeros(FACTS)
    if held.any():
        off = y[held] - forward(now.theta, rule, x[held])[-1][:, 0]
        facts[2:] = w[held].sum(), w[held] @ y[held], w[held] @ y[held] ** 2, w[held] @ off**2
    x, y, w = x[~held], y[~held], w[~held]
    n, total = len(x), w.sum()
    if not n:
        return np.concatenate([now.packed() * 0.0, facts])
    share = w * (n / total)
    order = np.random.default_rng([rule.seed, number, turn]).permutation(n)
    for begin in range(0, n, BATCH):
        at = order[begin : begin + BATCH]
        loss, slope = loss_and_gradient(now.theta, rule, x[at], y[at], share[at])
        facts[1] += loss * len(at) / n * total
        now.steps += 1
        now.first = FIRST * now.first + (1 - FIRST) * slope
        now.second = SECOND * now.second + (1 - SECOND) * slope**2
        rate = rule.rate * np.sqrt(1 - SECOND**now.steps) / (1 - FIRST**now.steps)
        now.theta = now.theta - rate * now.first / (np.sqrt(now.second) + TINY)
    facts[0] = total
    return np.concatenate([now.packed() * total, facts])


def train(rule: Training, summed: Callable[[State, int], np.ndarray]) -> tuple[np.ndarray, int]:
    """Rounds until nothing is gained.  ``summed(state, turn)`` adds up ``slice_round`` over all slices.

    Classes stop by the training loss and keep the last weights; numbers stop by the share of the held points' variance that
    is explained, and keep the best weights.
    """
    state = State(rule.start(), np.zeros(rule.size), np.zeros(rule.size))
    best, kept, idle, turn = -np.inf, state.theta, 0, 0
    for turn in range(1, rule.rounds + 1):
        found = summed(state, turn)
        weight, loss, held, label, square, error = found[-FACTS:]
        if not weight:
            break
        if rule.classes or not held:
            score = -loss / weight
        else:  # the held points judge the state the round started with
            spread = square - label * label / held
            score = 1.0 - error / spread if spread > 0 else -error
        idle = 0 if score > best + TOLERANCE else idle + 1
        if score > best:
            best, kept = score, state.theta
        state = State.unpacked(found[:-FACTS] / weight)
        if idle >= PATIENCE:
            break
    return (state.theta if rule.classes else kept), turn


@dataclass
class Network:
    """A trained network; numbers are learned with mean 0 and deviation 1 and given back in their own unit."""

    rule: Training
    theta: np.ndarray
    middle: float = 0.0
    spread: float = 1.0
    rounds: int = field(default=0, compare=False)

    def outputs(self, features: Sequence[Column]) -> Column:
        """Chances of the classes, or one number, as an array; on Arrow batches."""
        known = self

        @F.pandas_udf("array<double>")
        def score(*cols: pd.Series) -> pd.Series:
            out = forward(known.theta, known.rule, np.column_stack([c.to_numpy(dtype=float) for c in cols]))[-1]
            return pd.Series(list(out if known.rule.classes else known.middle + known.spread * out))

        return score(*features)


def _slices(points: DataFrame, names: Sequence[str], slices: int, hold: bool) -> DataFrame:
    """Points dealt by hash: one row of packed arrays a slice."""
    names = list(names)
    key = F.xxhash64(*names, "_label")
    held = (F.pmod(key, F.lit(HELD)) == 0) if hold else F.lit(False)
    dealt = points.withColumn("_held", held).withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*names, "_label"])
        whole = frame[[*names, "_label", "_weight", "_held"]].to_numpy(float)
        return pd.DataFrame({"slice": [int(frame["_slice"].iloc[0])], "block": [np.ascontiguousarray(whole).tobytes()]})

    return dealt.groupBy("_slice").applyInPandas(pack, "slice long, block binary")


def _opened(block: bytes, width: int, middle: float, spread: float) -> tuple[np.ndarray, ...]:
    whole = np.frombuffer(block).reshape(-1, width + 3)
    return whole[:, :width], (whole[:, width] - middle) / spread, whole[:, width + 1], whole[:, width + 2] > 0


def fit_network(rows: DataFrame, names: Sequence[str], rule: Training, here: int = SLICE_POINTS) -> Network:
    """Fit on ``names``, ``_label`` (a number, or the place of the class) and ``_weight``.

    Rows without a positive weight take no part.  ``here`` is the number of points of a slice; with several slices a round
    averages what they learned, so results differ a little from one slice, and are the same for every layout of the rows.
    No rows: the network stays as it was drawn.
    """
    names, width = list(names), len(names)
    known = rows.filter("_weight > 0").select(*[(F.col(c) + F.lit(0.0)).alias(c) for c in (*names, "_label")], "_weight")
    points = known.groupBy(*names, "_label").agg(F.sum("_weight").alias("_weight")).persist()
    packed = None
    try:
        weight, label = F.col("_weight"), F.col("_label")
        facts = one_row(points, F.count("*").alias("n"), (F.sum(weight * label) / F.sum(weight)).alias("m"))
        if not facts["n"]:
            return Network(rule, rule.start())
        middle, spread = 0.0, 1.0
        if not rule.classes:
            middle = float(facts["m"])
            around = one_row(points, (F.sum(weight * (label - F.lit(middle)) ** 2) / F.sum(weight)).alias("v"))["v"]
            spread = float(around) ** 0.5 or 1.0
        count = -(-facts["n"] // here)
        packed = _slices(points, names, count, not rule.classes and facts["n"] >= 2 * HELD).persist()
        if count == 1:

            def alone(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in blocks:
                    for number, block in zip(frame["slice"], frame["block"], strict=True):
                        parts = _opened(block, width, middle, spread)
                        theta, rounds = train(rule, lambda state, turn, n=number, p=parts: slice_round(state, rule, n, turn, *p))
                        yield pd.DataFrame({"theta": [theta.tolist()], "rounds": [rounds]})

            found = packed.mapInPandas(alone, "theta array<double>, rounds int").first()
            return Network(rule, np.array(found["theta"]), middle, spread, found["rounds"])
        size = 3 * rule.size + 1 + FACTS

        def summed(state: State, turn: int) -> np.ndarray:
            def part(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros(size)
                for frame in blocks:
                    for number, block in zip(frame["slice"], frame["block"], strict=True):
                        total += slice_round(state, rule, number, turn, *_opened(block, width, middle, spread))
                yield pd.DataFrame({"i": np.arange(size, dtype=np.int32), "v": total})

            made = np.zeros(size)
            for row in packed.mapInPandas(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # one state
                made[row["i"]] = row["v"]
            return made

        theta, rounds = train(rule, summed)
        return Network(rule, theta, middle, spread, rounds)
    finally:
        for held in (points, packed):
            if held is not None:
                held.unpersist()
