"""Nested choice of a classifier: group folds, grid, calibration, threshold, and what it does on null sources.

Whole groups go to the test rows of one outer fold each; of the other groups the first
part of an inner split is for validation, the rest for training. Medians, means and deviations
come from training rows only. A ridge-penalised logistic regression is fitted for every fold and every C
at once: each Newton step is one pass over the rows, in which tasks sum gradients and curvatures of
all models, so the driver holds only coefficients. The best C by average precision on the validation
rows is calibrated there by a logistic curve of its scores, fitted the same way, and the threshold
with the best F1 on the calibrated validation rows is kept for the test rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import metrics
from weftline.sources.stored import stored

#: Grid of the inverse penalty.
GRID = (0.01, 0.1, 1.0, 10.0)
STEPS, CLOSE = 50, 1e-9


def roles(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """``(fold, group, role)``: ``test``, ``val`` or ``train`` of every group in every outer fold. Joined with rows it is the split manifest."""
    sizes = metrics.group_sizes(rows, group)
    outer = metrics.dealt(sizes, folds)
    out = []
    for fold in range(min(folds, len(sizes))):
        rest = [s for s in sizes if outer[s[0]] != fold]
        inner = metrics.dealt(rest, min(5, max(1, len(rest))))
        out += [(fold, g, "test" if outer[g] == fold else "val" if inner[g] == 0 else "train") for g, _ in sizes]
    kind = dict(rows.dtypes)[group]
    return rows.sparkSession.createDataFrame(out, f"fold int, `{group}` {kind}, role string")


def scales(split: DataFrame, features: list[str]) -> DataFrame:
    """``(fold, m_*, a_*, s_*)``: median, mean and deviation of each feature, of training rows after missing values are medians; of none, 0, 0 and 1."""
    train = split.where("role = 'train'")
    clean = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
    medians = train.groupBy("fold").agg(*[F.coalesce(F.percentile(clean(c), F.lit(0.5)), F.lit(0.0)).alias(f"m_{c}") for c in features])
    filled = train.select("fold", *features).join(medians, "fold")
    value = lambda c: F.coalesce(clean(c), F.col(f"m_{c}"))
    moments = [F.avg(value(c)).alias(f"a_{c}") for c in features] + [F.stddev_pop(value(c)).alias(f"s_{c}") for c in features]
    spread = filled.groupBy("fold").agg(*moments)
    spread = spread.select("fold", *[f"a_{c}" for c in features], *[F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0).alias(f"s_{c}") for c in features])
    return medians.join(spread, "fold")


def scaled(rows: DataFrame, scale: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with ``x``, their standardised features by fold; features that the rows lack are missing values."""
    for c in features:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    value = lambda c: F.coalesce(F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")), F.col(f"m_{c}"))
    keep = [c for c in rows.columns if c not in features]
    return rows.join(scale, "fold").select(*keep, F.array(*[(value(c) - F.col(f"a_{c}")) / F.col(f"s_{c}") for c in features]).alias("x"))


def newton(rows: DataFrame, penalties: list[float], folds: list[int]) -> dict[int, np.ndarray]:
    """Logistic regressions of ``(fold, x, y, w)``: for every fold a row of coefficients, the last the intercept, for each penalty.

    Minimises ``penalty / 2 |b|^2 + sum w log-loss``, the intercept penalised too; ``y`` may lie between 0 and 1.
    """
    first = rows.select(F.size("x")).first()
    d = (first[0] if first else 0) + 1
    place = {f: k for k, f in enumerate(folds)}
    beta = np.zeros((len(folds), len(penalties), d))
    lam = np.array(penalties)

    def sums(held: np.ndarray):
        def run(batches):
            out = np.zeros((len(folds), len(penalties), d * d + d + 1))
            for batch in batches:
                fold = batch["fold"].to_numpy()
                x = np.column_stack([batch["x"].flatten().to_numpy().reshape(batch.num_rows, d - 1), np.ones(batch.num_rows)])
                y, w = batch["y"].to_numpy().astype(float), batch["w"].to_numpy()
                for f in np.unique(fold):
                    own = fold == f
                    xf, yf, wf = x[own], y[own], w[own]
                    for c in range(len(penalties)):
                        z = xf @ held[place[f], c]
                        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                        out[place[f], c, :d] += xf.T @ (wf * (p - yf))
                        out[place[f], c, d : d + d * d] += ((xf * (wf * p * (1 - p))[:, None]).T @ xf).reshape(-1)
                        out[place[f], c, -1] += (wf * (np.logaddexp(0, z) - yf * z)).sum()
            for f in range(len(folds)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(out[f].size, f, np.int32)), pa.array(np.arange(out[f].size, dtype=np.int32)), pa.array(out[f].reshape(-1))], names=["fold", "pos", "s"]
                )

        flat = np.zeros((len(folds), len(penalties), d * d + d + 1))
        table = rows.select("fold", "x", "y", "w").mapInArrow(run, "fold int, pos int, s double").groupBy("fold", "pos").agg(F.sum("s").alias("s")).toArrow()  # a row a coefficient or curvature
        flat.reshape(len(folds), -1)[table["fold"].to_numpy(), table["pos"].to_numpy()] = table["s"].to_numpy()
        return flat

    step, forward, last = np.zeros_like(beta), np.zeros_like(beta), np.full(beta.shape[:2], np.inf)
    for _ in range(STEPS):
        flat = sums(beta)
        loss = flat[..., -1] + lam * (beta**2).sum(axis=2) / 2
        worse = loss > last + 1e-9 * np.abs(last)
        slope = flat[..., :d] + lam[:, None] * beta
        curve = flat[..., d : d + d * d].reshape(*beta.shape, d) + (lam[:, None, None] + 1e-12) * np.eye(d)
        fresh = -np.linalg.solve(curve, slope[..., None])[..., 0]
        # A step that made the loss larger is taken back by half, and then by half of that; the others go on.
        step = np.where(worse[..., None], -np.abs(step) / 2 * forward, fresh)
        forward = np.where(worse[..., None], forward, np.sign(fresh))
        last = np.where(worse, last, loss)
        beta = beta + step
        if not worse.any() and np.abs(step).max(initial=0) < CLOSE:
            break
    return {f: beta[k] for f, k in place.items()}


def _scored(rows: DataFrame, beta: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` once for each coefficient row of their fold, with its number ``c`` and linear ``score``."""
    table = F.create_map(*[v for f, b in beta.items() for v in (F.lit(f), F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in b]))])
    spread = rows.select("*", F.posexplode(F.element_at(table, F.col("fold"))).alias("c", "_b"))
    dot = F.aggregate(F.zip_with("x", F.slice("_b", F.lit(1), F.size("x")), lambda p, q: p * q), F.element_at("_b", -1), lambda s, v: s + v)
    return spread.withColumn("score", dot).drop("_b")


def platt(validation: DataFrame, folds: list[int]) -> dict[int, np.ndarray]:
    """``(slope, intercept)`` by fold of ``(fold, y, score)``: logistic curves to targets drawn a little from 0 and 1 by the class sizes."""
    n = validation.groupBy("fold").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    target = F.when(F.col("y") == 1, (F.col("pos") + 1) / (F.col("pos") + 2)).otherwise(1 / (F.col("neg") + 2))
    rows = validation.join(n, "fold").select("fold", F.array("score").alias("x"), target.alias("y"), F.lit(1.0).alias("w"))
    return {f: b[0] for f, b in newton(rows, [0.0], folds).items()}


def probability(score: DataFrame, curve: dict[int, np.ndarray]) -> DataFrame:
    """``score`` with ``p``, its calibrated probability."""
    table = lambda k: F.element_at(F.create_map(*[v for f, c in curve.items() for v in (F.lit(f), F.lit(float(c[k])))]), F.col("fold"))
    return score.withColumn("p", 1 / (1 + F.exp(-(table(0) * F.col("score") + table(1)))))


class Choice:
    """Per outer fold: the best C, its coefficients on standardised features, calibration and threshold.

    ``rows`` are ``(id.., group, y, features..)``; rows without a class are left out. A fold whose training or validation rows hold one class only is skipped;
    without any fold there are no predictions to ask for.
    """

    def __init__(self, rows: DataFrame, group: str, features: list[str], folds: int = 5, grid: tuple[float, ...] = GRID):
        rows = rows.where(F.col("y").isNotNull())
        self.features, self.group = features, group
        self.manifest = roles(rows, group, folds)
        split = stored(rows.join(F.broadcast(self.manifest), group), "split")
        seen = split.where("role <> 'test'").groupBy("fold").agg(*[F.count_if((F.col("role") == r) & (F.col("y") == v)).alias(f"{r}{v}") for r in ("train", "val") for v in (0, 1)]).collect()
        self.folds = sorted(r["fold"] for r in seen if all(r[f"{k}{v}"] for k in ("train", "val") for v in (0, 1)))
        self.scale = stored(scales(split.where(F.col("fold").isin(self.folds)), features), "scale")
        self.rows = stored(scaled(split.where(F.col("fold").isin(self.folds)), self.scale, features), "scaled")
        self.beta, self.best, self.val, self.threshold, self.grid = {}, {}, {}, {}, grid
        if not self.folds:
            return
        size = {r["fold"]: r for r in seen}
        weight = F.create_map(*[v for f in self.folds for v in (F.lit(f), F.array(*[F.lit((size[f]["train0"] + size[f]["train1"]) / (2 * size[f][f"train{v}"])) for v in (0, 1)]))])
        train = self.rows.where("role = 'train'").withColumn("w", F.element_at(F.element_at(weight, F.col("fold")), F.col("y").cast("int") + 1))
        every = newton(train, [1 / c for c in grid], self.folds)
        tried = stored(_scored(self.rows.where("role = 'val'"), every).select("fold", "c", F.col("y").cast("int").alias("y"), F.col("score")), "tried")
        ranked = metrics.average_precision(tried.select("fold", "c", "y", (1 / (1 + F.exp(-F.col("score")))).alias("p")), ["fold", "c"])
        for r in ranked.orderBy("fold", F.desc(F.round("pr_auc", 12)), "c").collect():  # a row a fold and C
            if r["fold"] not in self.best:
                self.best[r["fold"]], self.val[r["fold"]] = r["c"], r["pr_auc"]
        self.beta = {f: every[f][self.best[f]] for f in self.folds}
        chosen = F.create_map(*[v for f in self.folds for v in (F.lit(f), F.lit(self.best[f]))])
        own = stored(tried.where(F.col("c") == F.element_at(chosen, F.col("fold"))), "chosen")
        self.curve = platt(own, self.folds)
        found = metrics.best_f1(probability(own, self.curve).select("fold", "y", "p"), ["fold"]).collect()
        self.threshold = {r["fold"]: r["threshold"] for r in found}

    def predicted(self, rows: DataFrame | None = None) -> DataFrame:
        """``(.., fold, y, p)`` of the test rows; or of other ``rows`` with the same groups, as test rows of their groups' folds."""
        if rows is None:
            given = self.rows.where("role = 'test'")
        else:
            test = self.manifest.where("role = 'test'").where(F.col("fold").isin(self.folds)).drop("role")
            given = scaled(rows.where(F.col("y").isNotNull()).join(F.broadcast(test), self.group), self.scale, self.features)
        return probability(_scored(given, {f: b[None] for f, b in self.beta.items()}), self.curve).drop("c", "x")

    def coefficients(self, spark) -> DataFrame:
        """``(fold, feature, coefficient)``, on standardised features."""
        rows = [(f, name, float(v)) for f in self.folds for name, v in zip([*self.features, "intercept"], self.beta[f])]
        return spark.createDataFrame(rows, "fold int, feature string, coefficient double")

    def chosen(self, spark) -> DataFrame:
        """``(fold, c, val_pr_auc, threshold)``."""
        return spark.createDataFrame([(f, self.grid[self.best[f]], float(self.val[f]), float(self.threshold[f])) for f in self.folds], "fold int, c double, val_pr_auc double, threshold double")

    def tested(self, spark) -> DataFrame:
        """Per fold: the choice, and areas, Brier score, precision, recall and F1 at the threshold on the test rows; null where the test rows don't tell."""
        if not self.folds:
            return spark.createDataFrame([], "fold int, c double, val_pr_auc double, threshold double, n long, brier double, precision double, recall double, f1 double, pr_auc double, roc_auc double")
        p = stored(self.predicted().select("fold", F.col("y").cast("int").alias("y"), "p"), "predicted")
        pick = F.broadcast(self.chosen(spark))
        hit = F.col("p") >= F.col("threshold")
        tp, fp, fn = F.count_if(hit & (F.col("y") == 1)), F.count_if(hit & (F.col("y") == 0)), F.count_if(~hit & (F.col("y") == 1))
        at = p.join(pick, "fold").groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), metrics.brier().alias("brier"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")
        )
        return pick.join(at, "fold", "left").join(metrics.average_precision(p, ["fold"]), "fold", "left").join(metrics.roc_auc(p, ["fold"]), "fold", "left")

    def nulls(self, sources: dict[str, DataFrame]) -> DataFrame:
        """``(fold, source, pr_auc)``: average precision of the trained model on the test rows of surrogate features, null where a fold has no positives."""
        out = None
        for name, rows in sources.items():
            one = metrics.average_precision(self.predicted(rows).select("fold", F.col("y").cast("int").alias("y"), "p"), ["fold"]).select("fold", F.lit(name).alias("source"), "pr_auc")
            out = one if out is None else out.unionByName(one)
        return out
