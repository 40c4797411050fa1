"""Algorithms that step: streamlines, radial diffusion, ensemble updates. Each group or batch of seeds is one task's work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bilinear(field: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Field[y, x] at fractional indices; the outermost cells extend."""
    i = np.clip(np.floor(x).astype(int), 0, field.shape[1] - 2)
    j = np.clip(np.floor(y).astype(int), 0, field.shape[0] - 2)
    dx, dy = x - i, y - j
    return (field[j, i] * (1 - dx) + field[j, i + 1] * dx) * (1 - dy) + (field[j + 1, i] * (1 - dx) + field[j + 1, i + 1] * dx) * dy


def _trace(u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int, ds: float, rk4: bool) -> np.ndarray:
    """Positions of all seeds at all steps along the unit field, in indices; NaN after leaving the grid."""

    def way(px, py):
        a, b = bilinear(u, px, py), bilinear(v, px, py)
        n = np.hypot(a, b)
        n = np.where(n > 0, n, 1)
        return a / n, b / n

    out = np.full((steps + 1, 2, len(x)), np.nan)
    out[0] = x, y
    alive = np.ones(len(x), bool)
    for k in range(steps):
        a1, b1 = way(x, y)
        if rk4:
            a2, b2 = way(x + ds / 2 * a1, y + ds / 2 * b1)
            a3, b3 = way(x + ds / 2 * a2, y + ds / 2 * b2)
            a4, b4 = way(x + ds * a3, y + ds * b3)
            a1, b1 = (a1 + 2 * a2 + 2 * a3 + a4) / 6, (b1 + 2 * b2 + 2 * b3 + b4) / 6
        x, y = x + ds * a1, y + ds * b1
        alive &= (x >= 0) & (y >= 0) & (x <= u.shape[1] - 1) & (y <= u.shape[0] - 1)
        if not alive.any():
            break
        out[k + 1] = np.where(alive, x, np.nan), np.where(alive, y, np.nan)
    return out


def streamlines(seeds: DataFrame, grid_x: np.ndarray, grid_y: np.ndarray, field_x: np.ndarray, field_y: np.ndarray, steps: int = 1000, ds: float = 0.1, method: str = "rk4") -> DataFrame:
    """(seed, step, x, y) of the lines of a field on a regular grid from ``seeds`` (seed, x, y); ``ds`` in cells.

    The grid travels with the job, so it is for grids of some MB; seeds are dealt over the tasks and advance in step.
    """
    hx, hy = float(grid_x[1] - grid_x[0]), float(grid_y[1] - grid_y[0])
    u, v = field_x / hx, field_y / hy

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                p = _trace(u, v, (b["x"].to_numpy() - grid_x[0]) / hx, (b["y"].to_numpy() - grid_y[0]) / hy, steps, ds, method == "rk4")
                k, s = np.nonzero(~np.isnan(p[:, 0]))
                yield pd.DataFrame({"seed": b["seed"].to_numpy()[s], "step": k, "x": p[k, 0, s] * hx + grid_x[0], "y": p[k, 1, s] * hy + grid_y[0]})

    return seeds.select("seed", "x", "y").mapInPandas(job, "seed long, step int, x double, y double")


def tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of tridiagonal systems along the first axis; further axes are systems side by side."""
    c, d = np.zeros(right.shape), np.zeros(right.shape)
    c[0], d[0] = up[0] / mid[0], right[0] / mid[0]
    for i in range(1, len(mid)):
        m = mid[i] - low[i] * c[i - 1]
        c[i], d[i] = up[i] / m, (right[i] - low[i] * d[i - 1]) / m
    for i in range(len(mid) - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def diffuse(f: np.ndarray, l_grid: np.ndarray, dll: np.ndarray, dt: float) -> np.ndarray:
    """One Crank-Nicolson step of L2 d/dL (D / L2 df/dL) with fixed ends; columns of ``f`` and ``dll`` are runs side by side."""
    grid = l_grid.reshape(-1, *(1,) * (f.ndim - 1))
    h = l_grid[1] - l_grid[0]
    half = (dll[1:] + dll[:-1]) / 2 / ((grid[1:] + grid[:-1]) / 2) ** 2
    up, low = np.zeros(f.shape), np.zeros(f.shape)
    up[1:-1] = grid[1:-1] ** 2 * half[1:] * dt / (2 * h * h)
    low[1:-1] = grid[1:-1] ** 2 * half[:-1] * dt / (2 * h * h)
    right = f.copy()
    right[1:-1] += up[1:-1] * (f[2:] - f[1:-1]) - low[1:-1] * (f[1:-1] - f[:-2])
    return tridiagonal(-low, 1 + up + low, -up, right)


def radial_diffusion(runs: DataFrame, kp: DataFrame, dt_days: float) -> DataFrame:
    """(run, step, l, psd): each run's profile stepped through its Kp series.

    ``runs`` holds (run, l, psd) on an even grid; ``kp`` holds (run, step, kp). Runs are apart, steps within one are not: a
    run's profile and series are a row, and the runs of a batch that share a grid and their steps are solved side by side.
    """
    listed = lambda df, by, c: df.groupBy(F.col("run").cast("long").alias("run")).agg(F.array_sort(F.collect_list(F.struct(by, c))).alias("_s"))
    profiles = listed(runs.select("run", F.col("l").cast("double").alias("l"), F.col("psd").cast("double").alias("psd")), "l", "psd").select("run", F.col("_s.l").alias("l"), F.col("_s.psd").alias("psd"))
    series = listed(kp.select("run", F.col("step").cast("int").alias("step"), F.col("kp").cast("double").alias("kp")), "step", "kp").select("run", F.col("_s.step").alias("step"), F.col("_s.kp").alias("kp"))

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alike: dict[tuple, list[int]] = {}
            for i, (grid, steps) in enumerate(zip(batch["l"], batch["step"], strict=True)):
                alike.setdefault((grid.tobytes(), steps.tobytes()), []).append(i)
            for at in alike.values():
                some = batch.iloc[at]
                grid, steps = np.asarray(some["l"].iloc[0], float), some["step"].iloc[0]
                f = np.stack([np.asarray(p, float) for p in some["psd"]], 1)
                k = np.stack([np.asarray(x, float) for x in some["kp"]], 1)
                for j, step in enumerate(steps):
                    f = diffuse(f, grid, 10 ** (0.506 * k[j] - 9.325) * grid[:, None] ** 10, dt_days)
                    yield pd.DataFrame({"run": some["run"].to_numpy().repeat(len(grid)), "step": int(step), "l": np.tile(grid, len(at)), "psd": f.T.ravel()})

    return profiles.join(series, "run").mapInPandas(job, "run long, step int, l double, psd double")


def ensemble_update(a: np.ndarray, observed: np.ndarray, ha: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Ensemble Kalman analysis: states (n, members), observations (m, members) perturbed, their model values, error spread (m)."""
    members = a.shape[1]
    da, dh = a - a.mean(1, keepdims=True), ha - ha.mean(1, keepdims=True)
    cov = dh @ dh.T / (members - 1) + np.diag(spread**2)
    return a + da @ dh.T / (members - 1) @ np.linalg.pinv(cov) @ (observed - ha)


def assimilate(states: DataFrame, observations: DataFrame, seed: int = 0) -> DataFrame:
    """(run, member, l, psd) after an ensemble update by each run's observations.

    ``states`` holds (run, member, l, psd); ``observations`` holds (run, l, psd, spread) and is matched to the nearest grid
    point.
    """
    rows = states.select("run", "member", "l", "psd", F.lit(None).cast("double").alias("spread"))
    rows = rows.unionByName(observations.select("run", F.lit(-1).alias("member"), "l", "psd", "spread"))

    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        model, obs = pdf[pdf.member >= 0], pdf[pdf.member < 0].sort_values("l")
        table = model.pivot_table(index="l", columns="member", values="psd")
        if len(obs):
            grid = table.index.to_numpy()
            at = np.abs(grid[None] - obs.l.to_numpy()[:, None]).argmin(1)
            spread = obs.spread.to_numpy()
            rng = np.random.default_rng(seed)
            noisy = obs.psd.to_numpy()[:, None] + spread[:, None] * rng.standard_normal((len(obs), table.shape[1]))
            table = pd.DataFrame(ensemble_update(table.to_numpy(), noisy, table.to_numpy()[at], spread), table.index, table.columns)
        out = table.stack().rename("psd").reset_index()
        out.insert(0, "run", pdf.run.iloc[0])
        return out[["run", "member", "l", "psd"]]

    return rows.groupBy("run").applyInPandas(job, "run long, member int, l double, psd double")


def interpolate_grid(points: DataFrame, grid: DataFrame, x0: float, dx: float, nx: int, y0: float, dy: float, ny: int) -> DataFrame:
    """(points, value): bilinear values of a grid (i, j, value) at ``points`` (id, x, y), by an equality join on its corners.

    Points outside use the outermost cell; a point of which a corner is missing has no row.
    """
    cell = lambda c, o, h, n: F.least(F.greatest(F.floor((F.col(c) - o) / h), F.lit(0)), F.lit(n - 2)).cast("int")
    p = points.withColumns({"_i": cell("x", x0, dx, nx), "_j": cell("y", y0, dy, ny)})
    p = p.withColumns({"_u": (F.col("x") - x0) / dx - F.col("_i"), "_v": (F.col("y") - y0) / dy - F.col("_j")})
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("c")
    p = p.select("id", "_i", "_j", "_u", "_v", corner).withColumns({"i": F.col("_i") + F.col("c.a"), "j": F.col("_j") + F.col("c.b")})
    w = F.when(F.col("c.a") == 1, F.col("_u")).otherwise(1 - F.col("_u")) * F.when(F.col("c.b") == 1, F.col("_v")).otherwise(1 - F.col("_v"))
    return p.join(grid.select("i", "j", "value"), ["i", "j"]).groupBy("id").agg(F.sum(w * F.col("value")).alias("value"), F.count("value").alias("_n")).where("_n = 4").drop("_n")


def leaf_of(points: DataFrame, leaves: DataFrame, cell: float) -> DataFrame:
    """``points`` (id, x, y) with the leaf (leaf, x0, x1, y0, y1) they are in; leaves are sent to the cells they touch."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))
    at = leaves.withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))
    p = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    hit = p.join(at, ["_cx", "_cy"]).where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return hit.select("id", "x", "y", "leaf")


def step_matrix(l_grid: np.ndarray, dll: np.ndarray, dt: float) -> np.ndarray:
    """The matrix of one diffusion step, which an ensemble's members share: column k is the step from a unit at grid point k."""
    return np.stack([diffuse(unit, l_grid, dll, dt) for unit in np.eye(len(l_grid))], 1)
