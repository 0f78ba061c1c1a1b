"""Searches for parameters on the driver: particles, fireflies, ants on a tour, and the first two in turn."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Bounds = dict[str, tuple[float, float]]


def _setup(bounds: Bounds, n: int, seed: int):
    r = np.random.default_rng(seed)
    low, high = (np.array(x, dtype=float) for x in zip(*bounds.values(), strict=True))
    return r, low, high, low + r.random((n, len(low))) * (high - low)


def particles(cost: Callable[[dict], float], bounds: Bounds, n: int = 20, rounds: int = 50, inertia: float = 0.7, own: float = 1.5, shared: float = 1.5, seed: int = 0, start=None) -> tuple[dict, float]:
    """Each particle is drawn to its own best place and to the best of all."""
    r, low, high, x = _setup(bounds, n, seed)
    if start is not None:
        x[0] = [start[k] for k in bounds]
    f = lambda row: cost(dict(zip(bounds, row.tolist(), strict=True)))
    v, best, worth = np.zeros_like(x), x.copy(), np.array([f(p) for p in x])
    for _ in range(rounds):
        top = best[worth.argmin()]
        v = inertia * v + own * r.random(x.shape) * (best - x) + shared * r.random(x.shape) * (top - x)
        x = np.clip(x + v, low, high)
        now = np.array([f(p) for p in x])
        better = now < worth
        best[better], worth[better] = x[better], now[better]
    return dict(zip(bounds, best[worth.argmin()].tolist(), strict=True)), float(worth.min())


def fireflies(cost: Callable[[dict], float], bounds: Bounds, n: int = 15, rounds: int = 40, pull: float = 1.0, fade: float = 1.0, jitter: float = 0.2, seed: int = 0, start=None) -> tuple[dict, float]:
    """Each moves towards brighter ones, less the farther they are."""
    r, low, high, x = _setup(bounds, n, seed)
    if start is not None:
        x[0] = [start[k] for k in bounds]
    f = lambda row: cost(dict(zip(bounds, row.tolist(), strict=True)))
    worth = np.array([f(p) for p in x])
    best, least = x[worth.argmin()].copy(), worth.min()
    for k in range(rounds):
        for i in range(n):
            for j in np.flatnonzero(worth < worth[i]):
                d = ((x[i] - x[j]) / (high - low)) ** 2
                x[i] = np.clip(x[i] + pull * np.exp(-fade * d.sum()) * (x[j] - x[i]) + jitter * 0.95**k * (r.random(len(low)) - 0.5) * (high - low), low, high)
            worth[i] = f(x[i])
            if worth[i] < least:
                best, least = x[i].copy(), worth[i]
    return dict(zip(bounds, best.tolist(), strict=True)), float(least)


def hybrid(cost: Callable[[dict], float], bounds: Bounds, seed: int = 0) -> tuple[dict, float]:
    at, _ = fireflies(cost, bounds, seed=seed)
    return particles(cost, bounds, seed=seed, start=at)


def ant_tour(distance, ants: int = 20, rounds: int = 60, trail: float = 1.0, sight: float = 3.0, decay: float = 0.5, seed: int = 0) -> tuple[list[int], float]:
    """A short round trip over all places of a distance matrix."""
    d = np.asarray(distance, dtype=float)
    n, r = len(d), np.random.default_rng(seed)
    mark, look = np.ones((n, n)), 1 / (d + np.eye(n))
    best, least = list(range(n)), float("inf")
    for _ in range(rounds):
        tours = []
        for _ in range(ants):
            at = int(r.integers(n))
            tour, left = [at], set(range(n)) - {at}
            while left:
                to = np.array(sorted(left))
                p = mark[at, to] ** trail * look[at, to] ** sight
                at = int(r.choice(to, p=p / p.sum()))
                tour.append(at)
                left.remove(at)
            length = float(d[tour, np.roll(tour, -1)].sum())
            tours.append((length, tour))
            if length < least:
                best, least = tour, length
        mark *= decay
        for length, tour in tours:
            mark[tour, np.roll(tour, -1)] += 1 / length
    return best, least
