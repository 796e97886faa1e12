"""Spin models of one window each: pseudolikelihood fits, samplers and their checks.

A window's units fit in one group by construction (its length is fixed), and
windows are independent, so each runs as one grouped function with its own seed:
results don't depend on the partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spin_matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``(units, T x n matrix of +-1)`` of long rows ``unit, t, s``."""
    wide = pdf.pivot(index="t", columns="unit", values="s").sort_index().sort_index(axis=1)
    return wide.columns.to_numpy(), wide.to_numpy(np.float64)


def fit_node(s: np.ndarray, i: int, c: float = 50.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Couplings and field of one spin: ridge logistic regression on the others by Newton steps.

    The slope is half the logistic coefficient, as spins are +-1; the intercept isn't penalised.
    """
    x = np.delete(s, i, axis=1)
    x = np.column_stack([x, np.ones(len(x))])
    y = (s[:, i] > 0).astype(float)
    ridge = np.append(np.full(x.shape[1] - 1, 1.0 / c), 0.0)
    if y.min() == y.max():  # the likelihood has no maximum; a tiny ridge gives a finite field
        ridge[-1] = 1e-3
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        gradient = x.T @ (p - y) + ridge * b
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        b -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return np.insert(b[:-1] / 2, i, 0.0), b[-1] / 2


def fit_window(s: np.ndarray, c: float = 50.0) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric couplings with zero diagonal, and fields."""
    rows = [fit_node(s, i, c) for i in range(s.shape[1])]
    j = np.array([r[0] for r in rows])
    return (j + j.T) / 2, np.array([r[1] for r in rows])


def pseudo_log_loss(s: np.ndarray, j: np.ndarray, h: np.ndarray) -> float:
    p = 1 / (1 + np.exp(-np.clip(2 * (s @ j.T + h), -40, 40)))
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return float(-np.where(s > 0, np.log(p), np.log(1 - p)).mean())


MODEL = "win_id int, i int, j int, coupling double, field double, log_loss double, base_loss double"


def ising_fit(spins: DataFrame, c: float = 50.0, holdout: float = 0.2) -> DataFrame:
    """Per window ``(i, j, coupling)``, with the field in rows i = j, and losses on the held-out tail.

    ``base_loss`` is that of independent units with the training frequencies.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        units, s = spin_matrix(pdf)
        keep = len(s) - max(1, round(holdout * len(s)))
        j, h = fit_window(s[:keep], c)
        p = np.clip((s[:keep] > 0).mean(axis=0), 1e-6, 1 - 1e-6)
        base = float(-np.where(s[keep:] > 0, np.log(p), np.log(1 - p)).mean())
        loss = pseudo_log_loss(s[keep:], j, h)
        rows = [(pdf.win_id.iloc[0], units[a], units[b], j[a, b], h[a] if a == b else np.nan, loss, base) for a in range(len(units)) for b in range(a, len(units))]
        return pd.DataFrame(rows, columns=["win_id", "i", "j", "coupling", "field", "log_loss", "base_loss"])

    return spins.groupBy("win_id").applyInPandas(one, MODEL)


def sparse_node(s: np.ndarray, i: int, c: float, l1_ratio: float, rounds: int = 100, close: float = 1e-9) -> tuple[np.ndarray, float]:
    """Couplings and field of one spin with an elastic-net penalty ``(l1 |b| + (1 - l1) b^2 / 2) / c``; the intercept isn't penalised.

    Proximal Newton steps: the log-likelihood is replaced by its parabola, which is minimised one coefficient
    at a time with soft thresholds, so what isn't needed is exactly zero; a step that doesn't help is halved.
    """
    x = np.delete(s, i, axis=1)
    y = (s[:, i] > 0).astype(float)
    n, d = x.shape
    hard, soft = l1_ratio / c, (1 - l1_ratio) / c
    flat = 1e-3 if y.min() == y.max() else 0.0  # as in ``fit_node``

    def loss(b, b0):
        z = x @ b + b0
        return float((np.logaddexp(0, z) - y * z).sum() + hard * np.abs(b).sum() + soft * (b @ b) / 2 + flat * b0 * b0 / 2)

    b, b0 = np.zeros(d), 0.0
    now = loss(b, b0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b + b0, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        slope, slope0 = x.T @ (p - y), (p - y).sum() + flat * b0
        gram, lean = (x * w[:, None]).T @ x, x.T @ w
        new, new0 = b.copy(), b0
        for _ in range(1000):
            before = np.append(new, new0)
            for k in range(d):
                rest = slope[k] + gram[k] @ (new - b) + lean[k] * (new0 - b0) - gram[k, k] * new[k]
                new[k] = -np.sign(rest) * max(0.0, abs(rest) - hard) / (gram[k, k] + soft)
            new0 = b0 - (slope0 + lean @ (new - b)) / (w.sum() + flat)
            if np.abs(np.append(new, new0) - before).max() < 1e-12:
                break
        part = 1.0
        while part > 1e-6 and loss(b + part * (new - b), b0 + part * (new0 - b0)) > now + 1e-12:
            part /= 2
        moved = max(np.abs(part * (new - b)).max(initial=0), abs(part * (new0 - b0)))
        b, b0 = (new, new0) if part == 1.0 else (b + part * (new - b), b0 + part * (new0 - b0))
        now = loss(b, b0)
        if moved < close:
            break
    return np.insert(b / 2, i, 0.0), b0 / 2


def sparse_fit(spins: DataFrame, c: float = 50.0, l1_ratio: float = 0.5) -> DataFrame:
    """``(win_id, i, j, coupling, field)`` with an elastic-net penalty, as ``ising_fit`` gives them: i <= j, the field where i = j.

    Every node of every window is a task's group; both directions of a pair are averaged by a join.
    """
    nodes = spins.select("win_id", F.col("unit").alias("node")).distinct()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        units, s = spin_matrix(pdf)
        at = int(np.flatnonzero(units == pdf.node.iloc[0])[0])
        row, field = sparse_node(s, at, c, l1_ratio)
        return pd.DataFrame({"win_id": pdf.win_id.iloc[0], "i": units[at], "j": units, "b": row, "field": np.where(np.arange(len(units)) == at, field, np.nan)})

    fits = nodes.join(spins, "win_id").groupBy("win_id", "node").applyInPandas(one, "win_id int, i int, j int, b double, field double")
    low, high = F.least("i", "j"), F.greatest("i", "j")
    return fits.groupBy("win_id", low.alias("i"), high.alias("j")).agg(F.when(F.first("i") == F.first("j"), 0.0).otherwise(F.sum("b") / 2).alias("coupling"), F.max(F.nanvl("field", F.lit(None).cast("double"))).alias("field"))


def matrices(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    units = np.unique(pdf.i)
    place = {u: n for n, u in enumerate(units)}
    j, h = np.zeros((len(units),) * 2), np.zeros(len(units))
    for r in pdf.itertuples():
        a, b = place[r.i], place[r.j]
        if a == b:
            h[a] = r.field
        else:
            j[a, b] = j[b, a] = r.coupling
    return units, j, h


def log_exp_gamma(x: np.ndarray, gamma: float, floor: float = 1e-6) -> np.ndarray:
    return x if abs(gamma) < 1e-12 else np.log(np.maximum(1 + gamma * x, floor)) / gamma


#: How far inside the pole of the deformed exponential fields are clipped, and where plain ones are.
CLIP, PLAIN_LIMIT = 1e-6, 50.0


def field_limit(gamma: float) -> float:
    return PLAIN_LIMIT if abs(gamma) < 1e-12 else 1 / abs(gamma) - CLIP


def sigma_gamma(x: np.ndarray, gamma: float) -> np.ndarray:
    """The deformed sigmoid; at gamma 0 the plain one of x."""
    gap = x if abs(gamma) < 1e-12 else log_exp_gamma(x, gamma) - log_exp_gamma(-x, gamma)
    return 1 / (1 + np.exp(-np.clip(gap, -700, 700)))


def gibbs(j: np.ndarray, h: np.ndarray, samples: int, burn: int, thin: int, seed: int, gamma: float = 0.0) -> np.ndarray:
    """``samples`` rows of 0/1 by sequential sweeps over the spins, with the clipped field ``2 (h + J s)``."""
    rng = np.random.default_rng(seed)
    n, most = len(h), field_limit(gamma)
    s = rng.choice([-1.0, 1.0], n)
    out = np.zeros((samples, n), np.int8)
    for sweep in range(burn + samples * thin):
        draws = rng.random(n)
        for i in range(n):
            s[i] = 1.0 if draws[i] < sigma_gamma(np.clip(2 * (h[i] + j[i] @ s), -most, most), gamma) else -1.0
        k = sweep - burn + 1
        if k > 0 and k % thin == 0:
            out[k // thin - 1] = s > 0
    return out


def surrogates(model: DataFrame, samples: int, gamma: float = 0.0, thin: int = 10, seed: int = 4242) -> DataFrame:
    """``(win_id, unit, t, c)`` drawn from each window's model, seeded by the window."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        units, j, h = matrices(pdf)
        win = int(pdf.win_id.iloc[0])
        drawn = gibbs(j, h, samples, 5 * len(units), thin, seed + win, gamma)
        t, n = np.nonzero(np.ones_like(drawn))
        return pd.DataFrame({"win_id": win, "unit": units[n], "t": t, "c": drawn[t, n].astype(int)})

    return model.groupBy("win_id").applyInPandas(one, "win_id int, unit int, t int, c int")


def surrogates_checked(real: np.ndarray, j: np.ndarray, h: np.ndarray, gamma: float, seed: int, tries: int = 3, thin: int = 2, mean_most: float = 0.02, cov_most: float = 0.10) -> tuple[np.ndarray, float, float, bool]:
    """Draws until the moments agree (mean and covariance within the bounds), doubling the burn-in; the last try stays."""
    burn = 5 * len(h)
    for k in range(tries):
        drawn = gibbs(j, h, len(real), burn, thin, seed + k, gamma)
        m, c = moment_errors(real, 2.0 * drawn - 1)
        ok = m <= mean_most and c <= cov_most
        if ok:
            break
        burn *= 2
    return drawn, m, c, ok


def moment_errors(real: np.ndarray, drawn: np.ndarray) -> tuple[float, float]:
    """Largest mean difference and relative Frobenius difference of covariances, of +-1 rows."""
    a, b = np.cov(real.T, bias=True), np.cov(drawn.T, bias=True)
    return float(np.abs(real.mean(axis=0) - drawn.mean(axis=0)).max()), float(np.linalg.norm(a - b) / (np.linalg.norm(a) + 1e-12))


def curved_node(s: np.ndarray, i: int, gamma: float, start: np.ndarray, lam_j: float = 1e-2, lam_h: float = 1e-3, rounds: int = 500) -> np.ndarray:
    """Couplings and field (last) of one spin under the deformed sigmoid of ``2 (h + J s)``, by limited-memory quasi-Newton steps.

    Beyond the clip the loss of a sample doesn't change, so its slope is zero there.
    """
    x = np.column_stack([np.delete(s, i, axis=1), np.ones(len(s))])
    y = s[:, i] > 0
    ridge = np.append(np.full(x.shape[1] - 1, lam_j), lam_h)
    most = field_limit(gamma)

    def value(b):
        whole = 2 * (x @ b)
        f = np.clip(whole, -most, most)
        p = sigma_gamma(f, gamma)
        log_odds = 1.0 if abs(gamma) < 1e-12 else 2 / np.maximum(1 - (gamma * f) ** 2, CLIP)
        gradient = x.T @ ((p - y) * log_odds * 2 * (np.abs(whole) < most)) + 2 * ridge * b
        return -np.log(np.where(y, p, 1 - p) + 1e-24).sum() + (ridge * b * b).sum(), gradient

    b = start.copy()
    loss, g = value(b)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, held = g.copy(), []
        for d, e in reversed(memory):
            a = (d @ q) / (d @ e)
            q -= a * e
            held.append(a)
        if memory:
            d, e = memory[-1]
            q *= (d @ e) / (e @ e)
        else:
            q /= max(1.0, np.abs(q).max())
        for (d, e), a in zip(memory, reversed(held)):
            q += (a - (e @ q) / (d @ e)) * d
        step = 1.0
        while True:
            new, grad = value(b - step * q)
            if new <= loss - 1e-4 * step * (g @ q) or step < 1e-8:
                break
            step /= 2
        change, d, e = loss - new, -step * q, grad - g
        if change <= 0:
            break
        b, loss, g = b + d, new, grad
        if d @ e > 1e-10:
            memory = [*memory, (d, e)][-8:]
        if change <= 1e-9 * max(abs(loss), 1):
            break
    return b


def curved_window(s: np.ndarray, gamma: float, j: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric couplings and fields of all spins, from a start ``j, h``."""
    rows = [curved_node(s, i, gamma, np.append(np.delete(j[i], i), h[i])) for i in range(len(h))]
    whole = np.array([np.insert(r[:-1], i, 0.0) for i, r in enumerate(rows)])
    return (whole + whole.T) / 2, np.array([r[-1] for r in rows])


def held_out_scores(s: np.ndarray, gamma: float, j: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Log loss, Brier score and calibration error in ten bins: means over the spins."""
    most = field_limit(gamma)
    p, y = sigma_gamma(np.clip(2 * (s @ j.T + h), -most, most), gamma), s > 0
    loss, brier = -np.log(np.where(y, p, 1 - p) + 1e-24).mean(), ((y - p) ** 2).mean()
    cell = np.clip((p * 10).astype(int), 0, 9)
    ece = np.mean([sum(abs(y[cell[:, i] == k, i].mean() - p[cell[:, i] == k, i].mean()) * (cell[:, i] == k).mean() for k in np.unique(cell[:, i])) for i in range(s.shape[1])])
    return np.array([loss, brier, ece])


GAMMAS = (-0.4, -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4)
CURVED = "win_id int, gamma double, cv_log_loss double, cv_brier double, ece10 double, clip_rate double, j_norm double, tv_ratio double, tv_violation boolean, units array<int>, couplings array<double>, fields array<double>"


def curved_fit(spins: DataFrame, gammas: tuple[float, ...] = GAMMAS, folds: int = 5, tv_limit: float = 0.5) -> DataFrame:
    """One row per window and gamma: the model (couplings by rows), held-out scores, share of clipped fields, change of couplings along gamma.

    Gammas run in order inside a window, the first from the window's Ising fit,
    each other from the one before (a sequential dependency).
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        units, s = spin_matrix(pdf)
        n, m = s.shape
        bounds = [k * n // folds for k in range(folds + 1)]
        j, h = fit_window(s)
        rows = []
        for g, gamma in enumerate(sorted(gammas)):
            before = j
            j, h = curved_window(s, gamma, j, h)
            tv = float(np.abs(j - before).sum() / (np.abs(before).sum() + 1e-12)) if g else 0.0
            fields, most = 2 * (s @ j.T + h), field_limit(gamma)
            clip = float((np.abs(fields) >= most).mean()) if abs(gamma) >= 1e-12 else 0.0
            scores = np.mean([held_out_scores(s[a:b], gamma, *curved_window(np.delete(s, slice(a, b), axis=0), gamma, j, h)) for a, b in zip(bounds, bounds[1:])], axis=0)
            rows.append((pdf.win_id.iloc[0], gamma, *scores.tolist(), clip, float(np.linalg.norm(j)), tv, tv > tv_limit, units.tolist(), j.reshape(-1).tolist(), h.tolist()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CURVED.split(", ")])

    return spins.groupBy("win_id").applyInPandas(one, CURVED)


DRAWN = "win_id int, gamma double, unit int, t int, c int, m_err double, c_rel_err double, accepted boolean"


def curved_surrogates(spins: DataFrame, fitted: DataFrame, seed: int = 4242) -> DataFrame:
    """Checked draws from every window's models, as many as the window has bins, with the moment errors in each row."""

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        units, real = spin_matrix(left)
        out = []
        for g, r in enumerate(right.sort_values("gamma").itertuples()):
            n, win = len(r.fields), int(r.win_id)
            drawn, m, c, ok = surrogates_checked(real, np.reshape(r.couplings, (n, n)), np.array(r.fields), r.gamma, seed + 1000 * g + win)
            t, u = np.nonzero(np.ones_like(drawn))
            out.append(pd.DataFrame({"win_id": win, "gamma": r.gamma, "unit": units[u], "t": t, "c": drawn[t, u].astype(int), "m_err": m, "c_rel_err": c, "accepted": ok}))
        return pd.concat(out)

    return spins.groupBy("win_id").cogroup(fitted.select("win_id", "gamma", "couplings", "fields").groupBy("win_id")).applyInPandas(one, DRAWN)


def select_gamma(grid: DataFrame, quality: DataFrame, medians: DataFrame, baseline: DataFrame, clip_limit: float = 0.05, loss_slack: float = 1.01) -> DataFrame:
    """Per window: the smallest positive gamma that is admissible, sane and closes the difference.

    ``grid(win_id, gamma, cv_log_loss, clip_rate)``, ``quality(win_id, gamma, accepted)``,
    ``medians(win_id, gamma, median)``, ``baseline(win_id, p05)``. Admissible: few
    clipped fields and an accepted surrogate. Sane: a loss within the slack of
    that at gamma 0 (of the least gamma if 0 isn't there). Closed: a median
    difference of at most the shuffled 5th percentile. If no gamma is all of
    that: the admissible positive gamma of least loss if losses never rise along
    the positive gammas (two at least), 0 if there is none; else 0 without closure.
    """
    w = Window.partitionBy("win_id")
    up = F.col("gamma") > 0
    rows = grid.select("win_id", "gamma", "cv_log_loss", "clip_rate").join(quality, ["win_id", "gamma"]).join(medians, ["win_id", "gamma"], "left").join(baseline, "win_id", "left")
    zero = F.coalesce(F.max(F.when(F.abs("gamma") < 1e-12, F.col("cv_log_loss"))).over(w), F.first("cv_log_loss").over(w.orderBy("gamma")))
    rows = rows.withColumn("ll0", zero).withColumn("_rise", F.when(up, F.col("cv_log_loss") - F.lag(F.when(up, F.col("cv_log_loss"))).over(w.orderBy("gamma"))))
    admissible = (F.col("clip_rate") <= clip_limit) & F.col("accepted")
    ok = up & admissible & (F.col("cv_log_loss") <= loss_slack * F.col("ll0")) & (F.col("median") <= F.col("p05"))
    sums = rows.groupBy("win_id").agg(
        F.min(F.when(ok, F.col("gamma"))).alias("first"), F.min(F.when(up & admissible, F.struct("cv_log_loss", "gamma")))["gamma"].alias("best"),
        ((F.count_if(up) >= 2) & (F.coalesce(F.max("_rise"), F.lit(0.0)) <= 1e-12)).alias("monotonic"), F.first("p05").alias("p05"), F.first("ll0").alias("ll0"),
    )
    star = F.coalesce("first", F.when(F.col("monotonic"), F.col("best")), F.lit(0.0))
    return sums.select("win_id", star.alias("gamma_star"), F.col("first").isNotNull().alias("ho_closure"), (F.col("first").isNull() & ~F.col("monotonic")).alias("no_closure"), "p05", "ll0")


def coupling_summary(model: DataFrame) -> DataFrame:
    """Per window: mean and largest absolute value of the couplings that aren't zero, and the largest singular value of their matrix."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        _, j, _ = matrices(pdf)
        up = np.abs(j[np.triu_indices(len(j), 1)])
        up = up[up > 0]
        norm = float(np.linalg.svd(j, compute_uv=False)[0]) if len(j) else np.nan
        return pd.DataFrame([(pdf.win_id.iloc[0], up.mean() if len(up) else np.nan, up.max() if len(up) else np.nan, norm)], columns=["win_id", "mean_abs_j", "max_abs_j", "j_spectral_norm"])

    return model.groupBy("win_id").applyInPandas(one, "win_id int, mean_abs_j double, max_abs_j double, j_spectral_norm double")


def choose_c(spins: DataFrame, folds: int = 5, windows: int = 3, grid: tuple[float, ...] = tuple(np.geomspace(5.0, 200.0, 6))) -> DataFrame:
    """``(win_id, c, loss)``: of each of the first windows, the C with the least held-out loss over blocks of time (the first of equals)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        _, s = spin_matrix(pdf)
        bounds = [k * len(s) // folds for k in range(folds + 1)]
        losses = [np.mean([pseudo_log_loss(s[a:b], *fit_window(np.delete(s, slice(a, b), axis=0), c)) for a, b in zip(bounds, bounds[1:])]) for c in grid]
        best = int(np.argmin(losses))
        return pd.DataFrame([(pdf.win_id.iloc[0], float(grid[best]), float(losses[best]))], columns=["win_id", "c", "loss"])

    first = spins.select("win_id").distinct().orderBy("win_id").limit(windows)
    return spins.join(F.broadcast(first), "win_id", "left_semi").groupBy("win_id").applyInPandas(one, "win_id int, c double, loss double")


def same_bounds(model: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows whose bounds in a stored model differ from those of the table, or that it doesn't have; empty if all agree."""
    ours, theirs = windows.select("win_id", "start_bin", "end_bin"), model.select("win_id", F.col("start_bin").alias("model_start"), F.col("end_bin").alias("model_end"))
    wrong = F.col("model_start").isNull() | (F.col("start_bin") != F.col("model_start")) | (F.col("end_bin") != F.col("model_end"))
    return ours.join(theirs.distinct(), "win_id", "left").where(wrong)
