"""Registered model queries (I, J5, K). No SQL oracle: the driver checks rows only.

Learners run with the reference's settings (``models``' defaults and search spaces) and learn from
all training rows, like everything else (features, splits, folds, class weights, encoders,
scalers, scores, metrics).
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.features import high_rating
from shelfspark.operators import engineer as C
from shelfspark.operators import evaluate as J
from shelfspark.operators import models as I
from shelfspark.operators import prep as H
from shelfspark.operators import scoring as K
from shelfspark.operators.attribution import attribution_ranking, booster_of, tree_contributions
from shelfspark.operators.search import best_of
from shelfspark.plans.queries_more import FIXTURE_REF_DATE
from shelfspark.plans.registry import register
from shelfspark.plans.reuse import written
from shelfspark.schemas import CATEGORICAL, POST_CATEGORICAL, POST_NUMERIC, PRE_NUMERIC
from shelfspark.session import hashed_joins, scratch_path
from shelfspark.sources.catalog import ALL_COLUMNS, catalog_view
from shelfspark.sources.store import require_latest_model

#: Rows that a registered query learns from: all. Trials may set a number (the first in hash order).
TRAIN_ROWS: int | None = None
_TRAIN_PARTITIONS = 4  # for a bounded number of rows

#: Catalogue columns that the features of a stage are made of.
SOURCE = {
    "pre": ["product_id", "category", "brand", "city", "seller", "packaging_type", "offer_type", "price", "final_price",
            "profit_margin_pct", "weight_g", "shelf_life_days", "date_added", "expiry_date", "rating"],
    "post": [c for c in ALL_COLUMNS if c != "product_name"],
}


def _catalog(spark, sf, stage: str) -> DataFrame:
    """The stage's catalogue columns, written once. They take less room than the features, which
    every reader makes anew."""
    with hashed_joins(spark):
        return written(catalog_view(spark, sf, SOURCE[stage]))


def _features(spark, sf, stage="pre", keep=("product_id",)) -> DataFrame:
    return (C.engineer_pre_launch if stage == "pre" else C.engineer_post_launch)(_catalog(spark, sf, stage), FIXTURE_REF_DATE, keep=keep)


def _split(features: DataFrame, label: str = "label") -> DataFrame:
    """All rows of a written table with their split: a comparison with its class's threshold that every
    reader makes anew, so the rows are not written a second time."""
    return H.stratified_split(features, label, "product_id", 0.8, 42, reread=True)


def _learned_from():
    """What picks the learning rows: nothing, so that all learn, unless a trial sets ``TRAIN_ROWS``."""
    if TRAIN_ROWS is None:
        return None
    return lambda rows: written(H.first_rows(rows, TRAIN_ROWS, reread=True).repartition(_TRAIN_PARTITIONS))


def _post_model(rows: DataFrame) -> PipelineModel:
    """The post-launch model with its production settings, learned from all training rows."""
    train = H.with_class_weights(rows.where(F.col("split") == "train"), "label")
    return I.fit_pipeline(train, POST_CATEGORICAL, POST_NUMERIC, I.boosted(**I.POST_LAUNCH_PARAMS), learn=_learned_from(), persist=False)


@register("model_comparison", None)
def q_model_comparison(spark, sf):
    rows = _split(_features(spark, sf, "pre"))
    train = H.with_class_weights(rows.where(F.col("split") == "train"), "label")
    n = float(train.agg(F.sum("weight")).first()[0])
    named = {"logistic": I.logistic(1.0, n), "forest": I.forest(), "boosted": I.boosted()}
    preds = I.compare_estimators(train, rows.where(F.col("split") == "test"), named, CATEGORICAL, PRE_NUMERIC, learn=_learned_from(), persist=False)
    return J.compare_models(preds)


@register("post_launch_scores", None)
def q_post_scores(spark, sf):
    rows = _split(_features(spark, sf, "post"))
    return K.decide(K.score(_post_model(rows), rows.where(F.col("split") == "test"), keep=("product_id", "label")))


@register("linear_regression_metrics", None)
def q_linear(spark, sf):
    # least squares has no settings to cut and one pass: it learns from all training rows
    feats = C.engineer_pre_launch(catalog_view(spark, sf), FIXTURE_REF_DATE, keep=("product_id", "rating"))
    s = H.random_split(feats, "product_id", 0.8, 42)
    model = I.fit_pipeline(s.where(F.col("split") == "train"), CATEGORICAL, PRE_NUMERIC,
                           I.linear_regression("rating"))
    pred = model.transform(s.where(F.col("split") == "test"))
    return J.regression_metrics(pred, "rating", "prediction")


@register("logistic_grid_search", None)
def q_grid(spark, sf):
    """The reference's search: its C values and both solvers' objectives, five folds, its iteration
    cap. A fold's fits learn from all rows of the other folds."""
    rows, enc = _numbered(spark, sf)
    return I.logistic_search(rows, TRAIN_ROWS, reread=True, encode=lambda part: _vectors(part, enc))


def _numbered(spark, sf) -> tuple[DataFrame, PipelineModel]:
    """Weighted pre-launch rows with their fold, and the encoder and scaler fitted on all of them. The
    catalogue columns and the place in the fold's order are written once."""
    cat = catalog_view(spark, sf, SOURCE["pre"]).withColumn("label", high_rating())
    with hashed_joins(spark):
        cat = H.assign_folds(cat, "label", "product_id", I.SEARCH_FOLDS, 42, write=True)
    rows = H.with_class_weights(C.engineer_pre_launch(cat, FIXTURE_REF_DATE, keep=("product_id", "fold")), "label")
    return rows, I.fit_pipeline(rows, CATEGORICAL, PRE_NUMERIC, None, persist=False)


def _vectors(rows: DataFrame, enc: PipelineModel) -> DataFrame:
    return I.with_values(rows, enc).select("product_id", I.VALUES, array_to_vector(I.VALUES).alias("features"),
                                           F.col("label").cast("double"), "weight", "fold")


def _folded(spark, sf) -> DataFrame:
    """Pre-launch rows as weighted, scaled values with their fold. They are made anew by the two passes that
    bin them."""
    return _vectors(*_numbered(spark, sf))


@register("boosted_grid_search", None)
def q_boosted_grid(spark, sf):
    """All 81 maps over five folds: mean macro-F1 of every map over all held-out rows, ranked."""
    return I.tune(_folded(spark, sf), "boosted", train_rows=TRAIN_ROWS)[0]


@register("boosted_random_search", None)
def q_boosted_random(spark, sf):
    """20 maps drawn from the grid; the best one's parameters."""
    ranked, grid = I.tune(_folded(spark, sf), "boosted", random_maps=I.RANDOM_SEARCH_MAPS, train_rows=TRAIN_ROWS)
    return best_of(ranked, grid)


@register("post_launch_attribution", None)
def q_attribution(spark, sf):
    """The 15 features with the largest mean absolute contribution over all test rows."""
    rows = _split(_features(spark, sf, "post"))
    prep, booster = booster_of(_post_model(rows))
    test = prep.transform(rows.where(F.col("split") == "test"))
    return attribution_ranking(tree_contributions(booster, test), I.feature_names(POST_CATEGORICAL, POST_NUMERIC), top=15)


@register("production_runs", None)
def q_production(spark, sf):
    """Both production models are trained on all rows, saved and recorded;
    the newest run of each is loaded and scored on all rows."""
    cat = written(catalog_view(spark, sf))
    base = scratch_path(spark, f"production-{uuid.uuid4().hex}")
    I.production_training(cat, f"{base}/models", f"{base}/runs", "catalogue_models", FIXTURE_REF_DATE, learn=_learned_from(), persist=False)
    out = None
    for stage in ("pre", "post"):
        name = f"{stage}_launch_model"
        model = require_latest_model(spark, f"{base}/runs", "catalogue_models", name)
        feats = (C.engineer_pre_launch if stage == "pre" else C.engineer_post_launch)(cat, FIXTURE_REF_DATE)
        one = J.classification_metrics(model.transform(feats), "label").select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("post_launch_importance", None)
def q_importance(spark, sf):
    return J.feature_importance(_post_model(_split(_features(spark, sf, "post"))).stages[-1], I.feature_names(POST_CATEGORICAL, POST_NUMERIC))


@register("scenario_scores", None)
def q_scenario(spark, sf):
    # The catalogue is joined and written once, with the outcome of each row's request checks: these name every
    # feature several times, which the scoring plan must not repeat, and requests take more room than its columns.
    with hashed_joins(spark):
        cat = catalog_view(spark, sf, SOURCE["post"])
        asked = _scenario(cat.withColumn("row", F.struct(*cat.columns)), keep=("row",))
        cat = written(C.conform(asked, "post", keep=("row",)).select("row.*", "success"))
    requests = C.cast_requests(_scenario(cat.where("success")), "post")
    return K.decide(K.score(_post_model(_split(C.engineer_post_launch(cat, FIXTURE_REF_DATE))), requests))


def _scenario(cat: DataFrame, keep=("product_id",)) -> DataFrame:
    return C.scenario_features(cat, "2001-09-01", "post", FIXTURE_REF_DATE, keep=keep)


@register("stream_scores", None)
def q_stream(spark, sf):
    """K3: post-launch request rows (from the catalogue) arrive as Parquet files under
    the shared checkpoint folder; a Structured Streaming query (availableNow) scores
    them into a sink, which is returned."""
    from shelfspark.schemas import POST_CONTRACT
    from shelfspark.streaming.scoring import start_scoring

    feats = _split(_features(spark, sf, "post"))
    model = _post_model(feats)
    base = scratch_path(spark, f"stream-scores-{uuid.uuid4().hex}")
    requests = feats.select("product_id", *[f.name for f in POST_CONTRACT.fields])
    requests.write.parquet(f"{base}/requests")
    schema = spark.read.parquet(f"{base}/requests").schema
    q = start_scoring(spark, model, f"{base}/requests", schema, f"{base}/scores", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/scores")


@register("kpi_cards", None)
def q_kpi_cards(spark, sf):
    """L1-L4 over the catalogue: the KPI card texts and two takeaway sentences, one row.

    No oracle: Java and C format half-way binary values differently, and text is
    display only (the numbers behind it are checked by kpi_totals and the takeaways).
    """
    from shelfspark.functions import display as L
    from shelfspark.operators import insights as E
    from shelfspark.operators import kpi as D
    # written: each of the four figures would join the catalogue anew
    df = written(catalog_view(spark, sf, ["final_price", "sold_quantity", "rating", "delivery_status", "category",
                                          "date_added", "brand"]))
    t = D.kpi_totals(df)
    cards = t.select(L.money("total_revenue", "Cr").alias("total_revenue"),
                     L.thousands("total_units").alias("total_units"),
                     L.stars("avg_rating").alias("avg_rating"),
                     L.percent("on_time_pct", 0).alias("on_time"),
                     L.percent("delayed_pct", 0).alias("delayed"))
    cat_text = L.takeaway_text(E.revenue_by_takeaway(E.revenue_by(df, "category"), "category"), "category")
    month_text = L.takeaway_text(E.monthly_takeaway(E.monthly_trend(df)), "monthly")
    brands = E.pareto(df).where("is_head").agg(L.name_text("brand").alias("head_brands"))
    return cards.select("*", cat_text.select("takeaway").scalar().alias("category_takeaway"),
                        month_text.select("takeaway").scalar().alias("monthly_takeaway"),
                        brands.select("head_brands").scalar().alias("head_brands"))
