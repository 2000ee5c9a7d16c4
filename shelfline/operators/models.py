"""Regression models on Spark ML: training protocol, selection, batch scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, require_columns
from ..sources.schemas import SALES_FEATURES, STOCK_FEATURES, UNIT_DEMAND_FEATURES, UNIT_DEMAND_LEVELS
from . import metrics, splits

SEED = 42
IDENTIFIERS = {
    "date", "store_id", "product_id", "product_name", "customers", "units_sold", "log_units_sold",
    "demand", "log_demand", "organization_id", "split",
}


@dataclass
class Fitted:
    """A model with its contract and the metrics of its evaluation."""

    model: PipelineModel
    features: list[str]
    log_target: bool
    metrics: DataFrame | None = None
    details: dict = field(default_factory=dict)


def regressor(kind: str = "boosted", **params):
    """One of the candidate learners, with the label in ``label``."""
    common = {"featuresCol": "features", "labelCol": "label", "predictionCol": "raw"}
    if kind == "boosted":
        return GBTRegressor(**common, seed=SEED, **{"maxIter": 120, "stepSize": 0.08, "maxDepth": 6, **params})
    if kind == "forest":
        return RandomForestRegressor(**common, seed=SEED, **{"numTrees": 60, "maxDepth": 8, **params})
    if kind == "linear":
        return LinearRegression(**common, **{"regParam": 0.01, **params})
    raise ValueError(f"Unsupported model type: {kind}")


def pipeline(features: Sequence[str], learner, levels: dict[str, list[str]] | None = None) -> Pipeline:
    """Index text columns by fixed levels (unseen -> an extra level), assemble, learn.

    ``levels`` come from the contract, so no pass over the data is needed to find them.
    """
    levels = levels or {}
    stages = []
    inputs = []
    for name in features:
        if name in levels:
            indexed = f"{name}__level"
            stages.append(
                StringIndexerModel.from_labels(
                    levels[name], inputCol=name, outputCol=indexed, handleInvalid="keep"
                )
            )
            inputs.append(indexed)
        else:
            inputs.append(name)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=[*stages, learner])


def resolve_columns(df: DataFrame, features: Sequence[str] | None = None) -> tuple[str, list[str]]:
    """Target and features by the columns present: all non-identifier columns for unit demand."""
    if "units_sold" in df.columns:
        target = "units_sold"
        chosen = list(features or [c for c in df.columns if c not in IDENTIFIERS])
    else:
        target, chosen = "demand", list(features or UNIT_DEMAND_FEATURES)
    require_columns(df, chosen, "feature")
    return target, chosen


def score(fitted: Fitted, df: DataFrame, name: str = "predicted", open_flag: str | None = None) -> DataFrame:
    """Non-negative predictions on the natural scale; closed rows score zero."""
    require_columns(df, fitted.features, "required feature")
    raw = F.expm1("raw") if fitted.log_target else F.col("raw")
    value = clip(raw, 0.0)
    if open_flag and open_flag in df.columns:
        value = F.when(F.col(open_flag) == 0, 0.0).otherwise(value)
    scratch = ["features", "raw", *[c for c in (f"{f}__level" for f in fitted.features)]]
    return fitted.model.transform(df).withColumn(name, value).drop(*scratch)


def fit(
    train: DataFrame, features: Sequence[str], target: str, learner, log_target: bool = True,
    levels: dict[str, list[str]] | None = None,
) -> Fitted:
    label = F.log1p(F.col(target)) if log_target else F.col(target).cast("double")
    model = pipeline(features, learner, levels).fit(train.withColumn("label", label))
    return Fitted(model, list(features), log_target)


def fit_next_day_demand(
    table: DataFrame, max_iter: int = 250, step: float = 0.06, depth: int = 5
) -> Fitted:
    """Next-day demand per product: fit on train and validation dates, judge on test dates against
    last week's value. Also serves pricing with other parameters (300, 0.05)."""
    cut = splits.fraction_cutoffs(table).select("validation_end").first()[0]
    train, test = table.where(F.col("date") <= cut), table.where(F.col("date") > cut)
    fitted = fit(
        train, STOCK_FEATURES, "quantity",
        regressor("boosted", maxIter=max_iter, stepSize=step, maxDepth=depth),
    )
    scored = score(fitted, test).select(
        F.col("quantity").alias("actual"), "predicted", clip(F.col("demand_lag_7"), 0.0).alias("baseline")
    )
    fitted.metrics = metrics.fva_metrics(scored).withColumn(
        "residual_std", scored.agg(F.stddev_pop(F.col("predicted") - F.col("actual"))).scalar()
    )
    return fitted


def fit_daily_revenue(
    table: DataFrame, max_iter: int = 500, step: float = 0.05, depth: int = 5, min_trees: int = 50
) -> Fitted:
    """Branch revenue: early stopping on the validation dates picks the number of trees, then a refit
    on train and validation with it (at least ``min_trees``); the last 30 dates are the test."""
    cuts = splits.tail_cutoffs(table).first()
    if cuts["train_end"] is None:
        raise ValueError(f"Not enough dates to split: {cuts['n_dates']}")
    day = F.col("date")
    known = table.where(day <= cuts["validation_end"]).withColumn("held", day > cuts["train_end"])
    test = table.where(day > cuts["validation_end"])
    stopping = regressor("boosted", maxIter=max_iter, stepSize=step, maxDepth=depth,
                         validationIndicatorCol="held", validationTol=0.0)
    first = fit(known, SALES_FEATURES, "daily_revenue", stopping, log_target=False)
    trees = max(first.model.stages[-1].getNumTrees, min(min_trees, max_iter))
    fitted = fit(
        known, SALES_FEATURES, "daily_revenue",
        regressor("boosted", maxIter=trees, stepSize=step, maxDepth=depth), log_target=False,
    )
    scored = score(fitted, test, open_flag="is_operating_day").select(
        F.col("daily_revenue").alias("actual"), "predicted"
    )
    scale = metrics.seasonal_scale(known, "daily_revenue", "date", ["organization_id", "branch_id"])
    fitted.metrics = metrics.forecasting_metrics(scored, scale=scale)
    fitted.details = {"trees": trees}
    return fitted


CANDIDATES: dict[str, dict] = {"boosted": {}, "forest": {}, "linear": {}}


def bake_off(
    table: DataFrame, candidates: dict[str, dict] | None = None, features: Sequence[str] | None = None,
    levels: dict[str, list[str]] | None = None,
) -> tuple[Fitted, DataFrame]:
    """(winner, one metrics row per candidate): candidates learn on open training days, the smallest
    validation WAPE wins, and the test part is scored once, by the winner."""
    spark = table.sparkSession
    target, chosen = resolve_columns(table, features)
    levels = levels or {c: v for c, v in UNIT_DEMAND_LEVELS.items() if c in chosen}
    cuts = splits.count_cutoffs(table).first()
    day = F.col("date")
    train = table.where((day <= cuts["train_end"]) & (F.col("is_open") == 1))
    held = table.where((day > cuts["train_end"]) & (day <= cuts["validation_end"]))
    rows, models = [], {}
    for kind, params in (candidates or CANDIDATES).items():
        models[kind] = fit(train, chosen, target, regressor(kind, **params), levels=levels)
        scored = score(models[kind], held, open_flag="is_open")
        row = metrics.regression_metrics(scored, target, "predicted").first()
        rows.append((kind, row["mae"], row["rmse"], row["wape"]))
    best = min(rows, key=lambda r: (r[3], r[0]))[0]
    test = score(models[best], table.where(day > cuts["validation_end"]), open_flag="is_open")
    models[best].metrics = test.select(
        "date", F.col(target).cast("double").alias("actual"), "predicted",
        *[c for c in ("demand_lag_7", "is_open") if c in test.columns],
    )
    report = spark.createDataFrame(
        [(k, m, r, w, k == best) for k, m, r, w in rows],
        "model string, mae double, rmse double, wape double, chosen boolean",
    )
    return models[best], report


def forecast_context(
    requests: DataFrame, contexts: DataFrame | None = None
) -> DataFrame:
    """Requests expanded to one row per horizon day with that day's operating context.

    A day's context is the one given for its date, else the one at its position, else the default:
    closed on Sundays, no promotion, regular price.
    """
    step = F.col("step")
    days = requests.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("horizon") - 1))).withColumn(
        "date", F.date_add("forecast_date", step)
    )
    day = F.col("date")
    names = ("is_open", "is_promo", "unit_price", "state_holiday", "school_holiday")
    request_price = F.coalesce("unit_price", "base_unit_price")
    default = {
        "is_open": F.when(F.weekday(day) == 6, 0).otherwise(1), "is_promo": F.lit(0),
        "unit_price": request_price, "state_holiday": F.lit("0"), "school_holiday": F.lit(0),
    }
    if contexts is not None:
        packed = F.struct(*names)
        by_date = contexts.where("forecast_date is not null").select(
            "request_id", F.col("forecast_date").alias("date"), packed.alias("_by_date")
        )
        by_step = contexts.select("request_id", F.col("position").alias("step"), packed.alias("_by_step"))
        days = days.join(by_date, ["request_id", "date"], "left").join(by_step, ["request_id", "step"], "left")
        context = F.coalesce("_by_date", "_by_step")
        given = context.isNotNull()
        values = {
            n: F.when(given, F.coalesce(context[n], request_price) if n == "unit_price" else context[n]).otherwise(default[n])
            for n in names
        }
    else:
        values = default
    out = days.withColumns({**values, "day_of_week": F.weekday(day)})
    return out.drop("_by_date", "_by_step")


def forecast_units(fitted: Fitted, requests: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Daily units per request (2 decimals), zero on closed days."""
    scored = score(fitted, forecast_context(requests, contexts), "units", "is_open")
    return scored.select(
        "request_id", "product_id", "store_id", F.col("date").alias("forecast_date"), "horizon", "day_of_week",
        "is_open", "is_promo", F.round("unit_price", 2).alias("unit_price"), F.round("units", 2).alias("predicted_units"),
    )


def forecast_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("request_id", "product_id", "store_id", "horizon").agg(
        F.min("forecast_date").alias("forecast_date"),
        F.round(F.sum("predicted_units"), 2).alias("total_predicted_units"),
    )
