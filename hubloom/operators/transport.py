"""Cheapest way to serve demand from hubs with capacity, for a batch of plans at once.

Any number of hubs. Every state starts at its cheapest hub; what a hub has too much of moves
along the cheapest path over hubs to one with room. The cost of an edge is that of the cheapest
state to move from one hub to the next, so the graph has as many nodes as hubs however many
states there are. Moving along cheapest paths keeps a plan the cheapest for the loads it has.

The functions run inside tasks, on the rows Spark hands them; plans don't meet each other.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# Executors need not have this package: the functions travel with their module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Paths must be shorter by this much per unit to be preferred, which keeps rounding out of it.
STEP = 1e-12
# Numbers looked at together (plans x states x hubs x hubs).
CHUNK = 1 << 21


def edges(costs: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest cost (plan, from, to) of moving a unit between hubs, and the state to move."""
    cost = np.where(units[:, :, :, None] > 0, costs[:, :, None, :] - costs[:, :, :, None], np.inf)
    state = cost.argmin(1)
    return np.take_along_axis(cost, state[:, None], 1)[:, 0], state


def shortest(edge: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest paths (plan, hub) from hubs that cost `start`, and the hub before each; -1 at a start."""
    distance, before = start.copy(), np.full(start.shape, -1)
    for _ in range(start.shape[1] - 1):
        through = distance[:, :, None] + edge
        hub = through.argmin(1)
        shorter = np.take_along_axis(through, hub[:, None], 1)[:, 0]
        better = shorter < distance - STEP
        if not better.any():
            break
        distance, before = np.where(better, shorter, distance), np.where(better, hub, before)
    return distance, before


def cheapest_units(costs: np.ndarray, demand: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Units (plan, state, hub) of least cost, for costs (plan, state, hub), demand and capacity.

    Plans whose demand exceeds all capacity come out with hubs over capacity.
    """
    plans, states, hubs = costs.shape
    units = np.zeros(costs.shape)
    np.put_along_axis(units, costs.argmin(2)[:, :, None], demand[:, :, None], 2)
    room = caps - units.sum(1)
    todo = np.flatnonzero((room < 0).any(1) & (room > 0).any(1))
    for _ in range(100 + 20 * states * hubs * hubs):
        if not len(todo):
            return units
        edge, state = edges(costs[todo], units[todo])
        source = room[todo].argmin(1)
        row = np.arange(len(todo))
        start = np.full((len(todo), hubs), np.inf)
        start[row, source] = 0.0
        distance, before = shortest(edge, start)
        target = np.where(room[todo] > 0, distance, np.inf).argmin(1)
        reached = np.isfinite(distance[row, target]) & (room[todo, target] > 0)
        amount = np.minimum(-room[todo, source], room[todo, target])
        steps = []  # the path, from its end
        walk, at = row[reached], target[reached]
        while len(walk):
            previous = before[walk, at]
            moved = state[walk, previous, at]
            amount[walk] = np.minimum(amount[walk], units[todo[walk], moved, previous])
            steps.append((walk, moved, previous, at))
            on = previous != source[walk]
            walk, at = walk[on], previous[on]
            if len(steps) > hubs:
                raise RuntimeError("a path over the hubs does not end")
        for walk, moved, previous, at in steps:
            units[todo[walk], moved, previous] -= amount[walk]
            units[todo[walk], moved, at] += amount[walk]
        go = row[reached]
        room[todo[go], source[go]] += amount[go]
        room[todo[go], target[go]] -= amount[go]
        left = room[todo]
        todo = todo[reached & (left < 0).any(1) & (left > 0).any(1)]
    raise RuntimeError("the placement has not settled")


def hub_prices(costs: np.ndarray, units: np.ndarray) -> np.ndarray:
    """What one more unit of capacity at each hub (plan, hub) saves in plans of least cost."""
    edge, _ = edges(costs, units)
    return -shortest(edge, np.zeros((len(costs), costs.shape[2])))[0]


def value_pieces(costs: np.ndarray, demand: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Least cost of one plan as its capacity goes from `low` to `high`: (from, to, cost, cost) by piece.

    The cost is convex and linear in pieces. Where the lines of two points meet, it is either
    on both, which makes a breakpoint, or below neither, which gives another line; all open
    meetings are valued together, round by round. Starts where the plan becomes feasible.
    """
    gain, short = float((high - low).sum()), float(demand.sum() - low.sum())
    first = max(0.0, short / gain) if gain > 0 else (0.0 if short <= 0 else 2.0)
    if first > 1.0:
        return []
    points: dict[float, tuple[float, float]] = {}

    def value(fractions: list[float]) -> None:
        caps = low + np.array(fractions)[:, None] * (high - low)
        repeated = np.broadcast_to(costs, (len(fractions), *costs.shape))
        units = cheapest_units(repeated, np.broadcast_to(demand, (len(fractions), len(demand))), caps)
        slope = -(hub_prices(repeated, units) * (high - low)).sum(1)
        points.update(zip(fractions, zip((units * costs).sum((1, 2)).tolist(), slope.tolist())))

    def line(point: float, at: float) -> float:
        return points[point][0] + points[point][1] * (at - point)

    def on(point: float, at: float) -> bool:
        """Whether the line of `point` still holds at the valued point `at`."""
        return abs(line(point, at) - points[at][0]) <= 1e-9 * max(1.0, abs(points[at][0]))

    value(sorted({first, 1.0}))
    pieces: list[tuple[float, float, float]] = []  # from, to, slope
    todo = [(first, 1.0)] if first < 1.0 else []
    while todo:
        met = {}
        for a, b in todo:
            if on(a, b) or on(b, a):
                pieces.append((a, b, points[a if on(a, b) else b][1]))
            else:
                (cost_a, slope_a), (_, slope_b) = points[a], points[b]
                met[a, b] = min(max(a + (line(b, a) - cost_a) / (slope_a - slope_b), a), b)
        new = sorted(set(met.values()) - points.keys())
        if new:
            value(new)
        todo = []
        for (a, b), at in met.items():
            if on(a, at) or on(b, at):
                pieces += [(a, at, points[a][1]), (at, b, points[b][1])]
            else:
                todo += [(a, at), (at, b)]
    joined: list[tuple[float, float, float]] = []
    for a, b, slope in sorted(pieces):
        if joined and abs(joined[-1][2] - slope) <= 1e-7 * max(1.0, abs(slope)):
            joined[-1] = (joined[-1][0], b, slope)
        elif b > a:
            joined.append((a, b, slope))
    return [(a, b, points[a][0], points[b][0]) for a, b, _ in joined] or [(first, 1.0, points[first][0], points[1.0][0])]


def _rows(lists: pa.Array) -> list[np.ndarray]:
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _shaped(costs: list[np.ndarray], demand: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Costs (plan, state, hub) and demand of the rows, in ranges of bounded size and equal shapes."""
    sizes = [(len(d), len(c)) for c, d in zip(costs, demand)]
    first = 0
    while first < len(sizes):
        states, flat = sizes[first]
        limit = max(1, CHUNK // max(1, flat * flat // max(1, states)))
        last = first + 1
        while last < len(sizes) and last - first < limit and sizes[last] == sizes[first]:
            last += 1
        hubs = flat // max(1, states)
        yield np.stack(costs[first:last]).reshape(last - first, states, hubs), np.stack(demand[first:last]), slice(first, last)
        first = last


def _once(function):
    """Keeps the planner from evaluating `function` again where its result is filtered on."""
    return function.asNondeterministic()


def placed_units(costs: Column, demand: Column, caps: Column) -> Column:
    """Units of least cost as array<double>, by state and within it by hub, like `costs`."""
    @arrow_udf("array<double>")
    def solve(costs: pa.Array, demand: pa.Array, caps: pa.Array) -> pa.Array:
        limits, out = _rows(caps), []
        for cost, wanted, part in _shaped(_rows(costs), _rows(demand)):
            out += list(cheapest_units(cost, wanted, np.stack(limits[part])).reshape(len(cost), -1))
        return pa.array(out, pa.list_(pa.float64()))

    return _once(solve)(costs, demand, caps)


def cost_pieces(costs: Column, demand: Column, low: Column, high: Column) -> Column:
    """`value_pieces` as an array of (from_frac, to_frac, from_cost, to_cost)."""
    names = ("from_frac", "to_frac", "from_cost", "to_cost")

    @arrow_udf(f"array<struct<{','.join(f'{n}:double' for n in names)}>>")
    def solve(costs: pa.Array, demand: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        out = []
        for cost, wanted, a, b in zip(_rows(costs), _rows(demand), _rows(low), _rows(high)):
            pieces = value_pieces(cost.reshape(len(wanted), -1), wanted, a, b)
            out.append([dict(zip(names, piece)) for piece in pieces])
        return pa.array(out, pa.list_(pa.struct([(n, pa.float64()) for n in names])))

    return _once(solve)(costs, demand, low, high)
