"""Evaluation over held-out seasons and over season-to-season pairs by algebra on the moments of one aggregate.

One job gives the moments of (features, target, next season's target) in cells of season, fold, cohorts, whether a next
season is there, and which features are missing. Training sets, test sets, cohorts, complete cases and feature subsets
are unions of cells, and predictions are linear, so every fit, its penalty search and all metrics but absolute errors follow
without another look at rows. What comes back grows with the cells, not with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linear import ALPHAS, Fit, Moments, ridge_search, solve, total

#: Places of the targets among a cell's moments: this season's, the next one's, and from ``OTHERS`` on further ones.
NOW, NEXT, OTHERS = 0, 1, 2


@dataclass
class Cell:
    """Moments of the rows of one season, fold, set of cohorts and pattern of missing features."""

    season: int
    fold: int
    cohorts: int
    next_cohorts: int
    missing: int
    targets: tuple[bool, ...]
    n: float
    mean: np.ndarray
    centred: np.ndarray


@dataclass
class Cells:
    features: list[str]
    cohorts: list[str]
    cells: list[Cell]

    def moments(self, cell: Cell, features: Sequence[str], target: int = NOW) -> Moments | None:
        """A cell's moments for some features and one of the targets; None where one of them is missing there."""
        at = [self.features.index(f) for f in features]
        if any(cell.missing >> i & 1 for i in at) or not cell.targets[target]:
            return None
        at.append(len(self.features) + target)
        return Moments(cell.n, cell.mean[at], cell.centred[np.ix_(at, at)], list(features))

    def seasons(self) -> list[int]:
        return sorted({c.season for c in self.cells})

    def folds(self, features: Sequence[str], weight: Callable[[Cell], float], target: int = NOW) -> dict[int, Moments]:
        """Moments by fold of the complete rows, each counted as often as ``weight`` says of its cell."""
        out: dict[int, Moments] = {}
        for c in self.cells:
            w = float(weight(c))
            m = self.moments(c, features, target) if w else None
            if m is not None:
                m = m if w == 1 else Moments(m.n * w, m.mean, m.centred * w, m.names)
                out[c.fold] = out[c.fold] + m if c.fold in out else m
        return out

    def in_cohort(self, cell: Cell, name: str) -> bool:
        return bool(cell.cohorts >> self.cohorts.index(name) & 1)


def cells(panel: DataFrame, features: Sequence[str], target: str, entity: str = "entity", season: str = "season", cohorts: Mapping[str, Column] | None = None, fold: Column | None = None, others: Sequence[str] = ()) -> Cells:
    """The cells of a panel of one row an (entity, season); one job, one exchange by entity.

    ``cohorts`` names conditions on a row; a missing value is outside. A row's next season is the one that follows it in number.
    ``others`` are further targets of the same season.
    """
    features, cohorts = list(features), dict(cohorts or {})
    w = Window.partitionBy(entity).orderBy(season)
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(cohorts.values())), F.lit(0))
    rows = panel.select(entity, season, *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y"), *[F.col(o).cast("double").alias(f"o{i}") for i, o in enumerate(others)], bits.alias("c"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"))
    follows = F.lead(season).over(w) == F.col(season) + 1
    rows = rows.withColumns({"z": F.when(follows, F.lead("y").over(w)), "d": F.when(follows, F.lead("c").over(w)).otherwise(0)})
    missing = sum((F.when(F.col(f"x{i}").isNull(), 1 << i).otherwise(0) for i in range(len(features))), F.lit(0))
    keys = {"season": F.col(season), "fold": F.col("fold"), "c": F.col("c"), "d": F.col("d"), "missing": missing, **{f"has_{t}": F.col(t).isNotNull() for t in ("y", "z", *(f"o{i}" for i in range(len(others))))}}
    targets = ["y", "z", *(f"o{i}" for i in range(len(others)))]
    names = [*(f"x{i}" for i in range(len(features))), *targets]
    p, size = len(features), len(names)
    pairs = [(i, j) for i in range(size) for j in range(i, size) if i < p or i == j]
    sums = [F.avg(v).alias(f"m{i}") for i, v in enumerate(names)] + [F.covar_pop(names[i], names[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = []
    for r in rows.groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.count("*").alias("n"), *sums).collect():
        centred = np.zeros((size, size))
        for i, j in pairs:
            centred[i, j] = centred[j, i] = (r[f"p{i}_{j}"] or 0.0) * r["n"]
        mean = np.array([r[f"m{i}"] or 0.0 for i in range(size)])
        out.append(Cell(r["season"], r["fold"], r["c"], r["d"], r["missing"], tuple(r[f"has_{t}"] for t in targets), float(r["n"]), mean, centred))
    return Cells(features, list(cohorts), out)


def projected(m: Moments, fit: Fit) -> Moments:
    """The moments of (prediction, target)."""
    a = np.zeros((2, len(fit.features) + 1))
    a[0, :-1], a[1, -1] = fit.coefficients, 1.0
    return Moments(m.n, a @ m.mean + np.array([fit.intercept, 0.0]), a @ m.centred @ a.T, ["pred"])


def told(m: Moments | None) -> dict[str, float | None]:
    """Count, correlation, error and bias (observed less predicted) from moments of (prediction, target)."""
    if m is None:
        return {"n": 0, "r": None, "rmse": None, "bias": None}
    pp, py, yy = m.centred[0, 0], m.centred[0, 1], m.centred[1, 1]
    bias = float(m.mean[1] - m.mean[0])
    r = float(py / np.sqrt(pp * yy)) if pp > 0 and yy > 0 else None
    return {"n": int(m.n), "r": r, "rmse": float(np.sqrt(max(0.0, (pp - 2 * py + yy) / m.n) + bias**2)), "bias": bias}


def train(folds: dict[int, Moments], alpha: float | None = None, alphas: Sequence[float] = ALPHAS) -> Fit:
    """The fit on all folds, with the penalty they choose or a given one."""
    return ridge_search(folds, alphas) if alpha is None and len(folds) > 1 else solve(total(list(folds.values())), 1.0 if alpha is None else alpha)


#: What predicts a held-out season: given which seasons may be looked at and the season, the fit of each test cell, or None for too few rows.
Model = Callable[[Callable[[int], bool], int], "Callable[[Cell], Fit] | None"]


def one_fit(data: Cells, features: Sequence[str], alpha: float | None = None, least_train: int = 50, weight: Callable[[int, int], float] | None = None) -> Model:
    """One fit for all rows; ``weight`` may weigh a season by itself and the season to predict."""

    def model(keep, season):
        if sum(m.n for m in data.folds(features, lambda c: keep(c.season)).values()) < max(1, least_train):
            return None
        fit = train(data.folds(features, lambda c: keep(c.season) and (weight(c.season, season) if weight else 1)), alpha)
        return lambda cell: fit

    return model


def by_cohort(data: Cells, features: Sequence[str], cohort: str, alpha: float | None = None, least_train: int = 50, least_cohort: int = 30, others_too: bool = True) -> Model:
    """A fit for the rows of a cohort and one for the others, or for these (``others_too`` off) and for too small a part the fit on all rows."""
    whole = one_fit(data, features, alpha, least_train)

    def model(keep, season):
        base = whole(keep, season)
        if base is None:
            return None
        fits = {}
        for side in (True, False) if others_too else (True,):
            folds = data.folds(features, lambda c: keep(c.season) and data.in_cohort(c, cohort) == side)  # noqa: B023
            if sum(m.n for m in folds.values()) >= least_cohort:
                fits[side] = train(folds, alpha)
        return lambda cell: fits.get(data.in_cohort(cell, cohort)) or base(cell)

    return model


def components(data: Cells, features: Sequence[str], weights: Sequence[float], alphas: Sequence[float | None] | None = None, least_train: int = 50) -> Model:
    """A fit for each of the further targets, put together by the scoring rule's weights."""
    alphas = list(alphas or [None] * len(weights))

    def model(keep, season):
        fits = []
        for i, alpha in enumerate(alphas):
            folds = data.folds(features, lambda c: keep(c.season), OTHERS + i)
            if sum(m.n for m in folds.values()) < max(1, least_train):
                return None
            fits.append(train(folds, alpha))
        c = sum(w * f.coefficients for w, f in zip(weights, fits))
        out = Fit(list(features), c, float(sum(w * f.intercept for w, f in zip(weights, fits))), float("nan"), c)
        return lambda cell: out

    return model


def corrected(data: Cells, base: Sequence[str], more: Sequence[str], alpha: float, base_alpha: float | None = None, least_train: int = 50) -> Model:
    """A base fit and a second one, with its own penalty, on what the base missed in earlier transitions from season to season.

    What is missed is linear in target and features, so its moments follow from those of the cells.
    """
    features = list(dict.fromkeys([*base, *more]))
    first = one_fit(data, base, base_alpha, least_train)

    def missed(cell: Cell, fit: Fit) -> Moments | None:
        m = data.moments(cell, features, NEXT)
        if m is None:
            return None
        a = np.zeros((len(more) + 1, len(features) + 1))
        for i, f in enumerate(more):
            a[i, features.index(f)] = 1
        a[-1, -1] = 1
        for f, c in zip(fit.features, fit.coefficients):
            a[-1, features.index(f)] -= c
        shift = np.zeros(len(more) + 1)
        shift[-1] = -fit.intercept
        return Moments(m.n, a @ m.mean + shift, a @ m.centred @ a.T, list(more))

    def model(keep, season):
        now = first(keep, season)
        if now is None:
            return None
        found = []
        for earlier in (s for s in data.seasons() if s < season):
            then = first(lambda s: s < earlier, earlier)  # noqa: B023
            if then is not None:
                found += [m for c in data.cells if c.season == earlier - 1 and (m := missed(c, then(c))) is not None]

        fit = now(None)
        c = np.zeros(len(features))
        for f, x in zip(fit.features, fit.coefficients):
            c[features.index(f)] += x
        intercept = fit.intercept
        if sum(m.n for m in found) >= max(1, least_train):
            second = solve(total(found), alpha)
            for f, x in zip(second.features, second.coefficients):
                c[features.index(f)] += x
            intercept += second.intercept
        out = Fit(features, c, float(intercept), float(alpha), c)
        return lambda cell: out

    return model


def evaluate(data: Cells, features: Sequence[str], mode: str = "out_of_season", alpha: float | None = None, least_test: int = 10, least_train: int = 50, model: Model | None = None, seasons: Sequence[int] | None = None) -> list[dict]:
    """A row a season that was evaluated, and last one with season None over all predictions together.

    ``out_of_season``: every season by a model of all others. ``cross_season``: a season's target from the features of the season
    before, by a model of all seasons before it; cohorts are those of the predicted season. Too small a test or training set is
    passed over. ``model`` takes the place of one ridge fit; ``features`` are then all that it uses. ``seasons`` are those to hold out.
    """
    ahead = mode == "cross_season"
    model = model or one_fit(data, features, alpha, least_train)
    out, pooled, pooled_cohorts = [], [], {c: [] for c in data.cohorts}
    for season in data.seasons() if seasons is None else seasons:
        tests = [(c, data.moments(c, features, NEXT if ahead else NOW)) for c in data.cells if c.season == (season - 1 if ahead else season)]
        tests = [(c, m) for c, m in tests if m is not None]
        if sum(m.n for _, m in tests) < max(1, least_test):
            continue
        fit_of = model((lambda s: s < season) if ahead else (lambda s: s != season), season)  # noqa: B023
        if fit_of is None:
            continue
        fits = {id(c): fit_of(c) for c, _ in tests}
        seen = [(c, projected(m.only(fits[id(c)].features), fits[id(c)])) for c, m in tests]
        alphas = {f.alpha for f in fits.values() if not np.isnan(f.alpha)}
        row = {"season": season, "alpha": alphas.pop() if len(alphas) == 1 else None, **told(total([m for _, m in seen]))}
        for i, name in enumerate(data.cohorts):
            own = [m for c, m in seen if (c.next_cohorts if ahead else c.cohorts) >> i & 1]
            pooled_cohorts[name] += own
            row[f"bias_{name}"] = told(total(own) if own else None)["bias"]
        pooled += [m for _, m in seen]
        out.append(row)
    last = {"season": None, "alpha": None, **told(total(pooled) if pooled else None)}
    last |= {f"bias_{name}": told(total(own) if own else None)["bias"] for name, own in pooled_cohorts.items()}
    return [*out, last]


def eliminate(data: Cells, features: Sequence[str], score, least_features: int = 4, least_rows: int = 100, alpha: float | None = None, least_test: int = 10, least_train: int = 50) -> list[dict]:
    """Backward elimination by the smallest absolute standardized coefficient, each set scored across seasons.

    ``score`` takes the pooled row of ``evaluate``. Complete rows are counted anew for every set. It stops where
    ``least_features`` features or fewer than ``least_rows`` complete rows are left; ``best`` marks the set with the highest
    score, the larger one among equals.
    """
    left, out = list(features), []
    while len(left) > least_features:
        folds = data.folds(left, lambda c: 1)
        n = sum(m.n for m in folds.values())
        if n < max(1, least_rows):
            break
        pooled = evaluate(data, left, "cross_season", alpha, least_test, least_train)[-1]
        dropped = left[int(np.abs(train(folds, alpha).standardized).argmin())]
        out.append({"step": len(out), "features": ",".join(left), "n_rows": int(n), "dropped": dropped, **{k: v for k, v in pooled.items() if k not in ("season", "alpha")}, "score": score(pooled)})
        left.remove(dropped)
    scores = [r["score"] for r in out if r["score"] is not None]
    best = next((r["step"] for r in out if scores and r["score"] == max(scores)), None)
    return [{**r, "best": r["step"] == best} for r in out]
