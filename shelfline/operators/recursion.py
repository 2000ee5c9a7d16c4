"""Recursive forecasts: each day's features come from the days forecast before it.

Chaining one DataFrame per day would build plans hundreds of joins deep. A series is one row with its
history array, so the recursion runs inside the task: the tree ensemble is read once from the fitted
model as flat arrays (its size is set by the model, not the data) and evaluated with numpy for a whole
Arrow batch of series per day. No shuffle is involved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lead_with_first, tile_history
from .models import Fitted

_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"Predict: (\S+)")
_TREE = re.compile(r"Tree \d+ \(weight (\S+)\)")


@dataclass
class Trees:
    """One row per node over all trees: feature (-1 = leaf), threshold, children, value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root, weight in zip(self.roots, self.weights):
            node = np.full(len(x), root)
            for _ in range(self.depth):
                feature = self.feature[node]
                inner = feature >= 0
                if not inner.any():
                    break
                goes_left = x[rows, np.maximum(feature, 0)] <= self.threshold[node]
                node = np.where(inner, np.where(goes_left, self.left[node], self.right[node]), node)
            total += weight * self.value[node]
        return total


def read_trees(fitted: Fitted) -> Trees:
    """Flat arrays from the model's printed form. All features must be continuous."""
    model = fitted.model.stages[-1]
    nodes: list[list[float]] = []
    roots, weights = [], []
    waiting: list[int] = []  # split nodes whose right child comes next

    def attach(index: int) -> None:
        if waiting:
            parent = waiting[-1]
            if nodes[parent][2] < 0:
                nodes[parent][2] = index
            else:
                nodes[parent][3] = index
                waiting.pop()

    for line in model.toDebugString.splitlines():
        if tree := _TREE.search(line):
            weights.append(float(tree[1]))
            roots.append(len(nodes))
            waiting.clear()
        elif split := _SPLIT.search(line):
            nodes.append([float(split[1]), float(split[2]), -1, -1, 0.0])
            attach(len(nodes) - 1)
            waiting.append(len(nodes) - 1)
        elif leaf := _LEAF.search(line):
            nodes.append([-1, 0.0, -1, -1, float(leaf[1])])
            attach(len(nodes) - 1)
        elif " in {" in line:
            raise ValueError("recursive scoring needs continuous features only")
    table = np.asarray(nodes)
    return Trees(
        table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int),
        table[:, 4], np.asarray(roots), np.asarray(weights), int(model.getMaxDepth()) + 1,
    )


def _matrix(arrays: pd.Series, width: int) -> np.ndarray:
    return np.vstack([np.asarray(a, dtype=float)[-width:] for a in arrays])


def recursive_demand(series: DataFrame, fitted: Fitted, keys: list[str], days: int) -> DataFrame:
    """(keys, offset, date, predicted_demand) for ``days`` days from ``start_date``.

    ``series`` has history, start_date, unit_price, price_index_28, orders_lag_1, customers_lag_1;
    the last four stay constant over the horizon. Short histories are repeated up to 28 days.
    """
    trees, columns = read_trees(fitted), list(fitted.features)
    constants = ("unit_price", "price_index_28", "orders_lag_1", "customers_lag_1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            past = np.hstack([_matrix(pdf["history"], 28), np.zeros((len(pdf), days))])
            start = pd.to_datetime(pdf["start_date"]).to_numpy().astype("datetime64[D]")
            fixed = {c: pdf[c].to_numpy(dtype=float) for c in constants}
            for step in range(days):
                now = 28 + step
                date = pd.DatetimeIndex(start + np.timedelta64(step, "D"))
                week, month = past[:, now - 7 : now], past[:, now - 28 : now]
                values = {
                    "demand_lag_1": past[:, now - 1], "demand_lag_7": past[:, now - 7],
                    "demand_lag_14": past[:, now - 14], "rolling_mean_7": week.mean(axis=1),
                    "rolling_mean_28": month.mean(axis=1), "rolling_std_7": week.std(axis=1, ddof=1),
                    "day_of_week": date.dayofweek.to_numpy(float), "month": date.month.to_numpy(float),
                    "is_weekend": (date.dayofweek >= 5).astype(float), **fixed,
                }
                x = np.column_stack([values[c] for c in columns])
                past[:, now] = np.maximum(np.expm1(trees.predict(x)), 0.0)
            yield _long(pdf, keys, past[:, 28:], start)

    table = series.select(*keys, tile_history(F.col("history")).alias("history"), "start_date", *constants)
    schema = ", ".join(f"{k} {dict(series.dtypes)[k]}" for k in keys)
    return table.mapInPandas(run, f"{schema}, offset int, date date, predicted_demand double")


def _long(pdf: pd.DataFrame, keys: list[str], values: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    n, days = values.shape
    offset = np.tile(np.arange(days), n)
    out = {k: np.repeat(pdf[k].to_numpy(), days) for k in keys}
    dates = np.repeat(start, days) + offset.astype("timedelta64[D]")
    return pd.DataFrame(
        {**out, "offset": offset.astype("int32"), "date": pd.Series(dates).dt.date,
         "predicted_demand": values.ravel()}
    )


def recursive_revenue(series: DataFrame, fitted: Fitted, keys: list[str], age_offset: int = 0) -> DataFrame:
    """(keys, offset, date, predicted_revenue) over each row's own calendar.

    ``series`` has history (array), first_date, calendar: array of (date, is_operating_day,
    active_discounts). A closed day scores 0 and enters the history as such. Means and deviations
    are rounded to 2, ratios and angles to 4 decimals, as in training.
    """
    trees, columns = read_trees(fitted), list(fitted.features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                history = [float(v) for v in row.history]
                out = []
                for offset, day in enumerate(row.calendar):
                    date = pd.Timestamp(day["date"])
                    value = 0.0
                    if day["is_operating_day"]:
                        x = _revenue_row(history, date, pd.Timestamp(row.first_date), day["active_discounts"], age_offset)
                        value = max(0.0, round(float(trees.predict(np.asarray([[x[c] for c in columns]]))[0]), 2))
                    history.append(value)
                    out.append((*[getattr(row, k) for k in keys], offset, date.date(), value))
                yield pd.DataFrame(out, columns=[*keys, "offset", "date", "predicted_revenue"])

    ok = F.exists("history", lambda v: v > 0)
    table = series.where(ok).select(
        *keys, lead_with_first(F.col("history")).alias("history"), "first_date", "calendar"
    )
    schema = ", ".join(f"{k} {dict(series.dtypes)[k]}" for k in keys)
    return table.mapInPandas(run, f"{schema}, offset int, date date, predicted_revenue double")


def _revenue_row(history: list[float], date: pd.Timestamp, first: pd.Timestamp, discounts, age_offset: int) -> dict:
    past = np.asarray(history)
    mean = {w: past[-w:].mean() for w in (7, 14, 28)}
    before = past[-14:-7].mean()
    angle, year = 2 * np.pi * date.dayofweek / 7, 2 * np.pi * (date.month - 1) / 12
    return {
        "day_of_week": date.dayofweek, "day_of_month": date.day, "month": date.month,
        "week_of_year": date.isocalendar()[1], "is_weekend": int(date.dayofweek >= 5),
        "is_month_start": int(date.is_month_start), "is_month_end": int(date.is_month_end),
        "day_of_week_sin": round(np.sin(angle), 4), "day_of_week_cos": round(np.cos(angle), 4),
        "month_sin": round(np.sin(year), 4), "month_cos": round(np.cos(year), 4),
        **{f"revenue_lag_{k}": past[-k] for k in (1, 7, 14, 28)},
        **{f"rolling_mean_{w}": round(m, 2) for w, m in mean.items()},
        **{f"rolling_std_{w}": round(past[-w:].std(ddof=1), 2) for w in (7, 28)},
        "weekly_momentum_ratio": round(mean[7] / before, 4) if before > 0 else 1.0,
        "branch_age_days": (date - first).days + age_offset,
        "branch_historical_avg_sales": round(past.mean(), 2),
        "is_operating_day": 1, "active_discount_count": int(discounts),
    }
