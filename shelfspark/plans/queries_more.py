"""Registered queries: profiling (B), feature tables (C), dialogue log (G),
training preparation (H) and evaluation of rule baselines (J)."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions import display as L
from shelfspark.functions.features import high_rating, parsed_date
from shelfspark.operators import dialogue as G
from shelfspark.operators import engineer as C
from shelfspark.operators import evaluate as J
from shelfspark.operators import models as I
from shelfspark.operators import prep as H
from shelfspark.operators import profile as B
from shelfspark.operators import scoring as K
from shelfspark.operators.kpi import prepare
from shelfspark.plans.registry import cat, register, with_catalog
from shelfspark.schemas import (
    CATALOG, CATEGORICAL, CONTRACT_INTS, NUMERIC_COLUMNS, POST_CATEGORICAL, POST_CONTRACT, POST_NUMERIC,
    PRE_NUMERIC, contract_schema,
)
from shelfspark.plans.reuse import written
from shelfspark.sources.catalog import catalog_view, line_column, table
from shelfspark.session import hashed_joins, scratch_path
from shelfspark.sources.files import append_dialogue, compact_dialogue, read_catalog, read_dialogue, to_records
from shelfspark.sources.store import compact_runs, latest_run, log_run, read_runs, require_latest_model, save_model
from shelfspark.streaming.scoring import start_scoring

FIXTURE_REF_DATE = "1995-01-01"  # start of the test orders: ages are >= 0
ALL = [f.name for f in CATALOG.fields]


# ------------------------------------------------------------------ B
@register("catalog_preview", with_catalog("SELECT * FROM catalog ORDER BY product_id LIMIT 5", prep=False))
def q_preview(spark, sf):
    # product_id comes from lineitem alone: take the 5 rows there, then join them to the dimensions
    top = B.preview(table(spark, sf, "lineitem").withColumn("__pid", line_column("product_id")), 5, "__pid")
    return B.preview(catalog_view(spark, sf, fact=top.drop("__pid")), 5, "product_id")


@register("catalog_shape", with_catalog(f"SELECT count(*) AS n_rows, CAST({len(ALL)} AS BIGINT) AS n_cols FROM catalog",
                                        prep=False))
def q_shape(spark, sf):
    return B.shape(catalog_view(spark, sf))


@register("schema_profile", with_catalog("\nUNION ALL\n".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{f.name}' AS \"column\", '{f.dataType.simpleString()}' AS dtype, "
    f"count({f.name}) AS non_null FROM catalog" for i, f in enumerate(CATALOG.fields)), prep=False))
def q_schema_profile(spark, sf):
    return B.schema_profile(catalog_view(spark, sf))


@register("null_counts", with_catalog("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL) AS BIGINT) AS n_null FROM catalog" for c in ALL), prep=False))
def q_null_counts(spark, sf):
    return B.null_counts(catalog_view(spark, sf))


@register("describe_numeric", with_catalog("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean,
  stddev_samp(CAST({c} AS DOUBLE)) AS std, min(CAST({c} AS DOUBLE)) AS min,
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, max(CAST({c} AS DOUBLE)) AS max FROM catalog"""
    for c in NUMERIC_COLUMNS), prep=False), rounded=["mean", "std", "q25", "q50", "q75"])
def q_describe(spark, sf):
    return B.describe_numeric(catalog_view(spark, sf, NUMERIC_COLUMNS), NUMERIC_COLUMNS)


@register("class_distribution", with_catalog("""SELECT CAST(coalesce(rating >= 3.8, false) AS INTEGER) AS label,
  count(*) AS n, count(*) * 100.0e0 / sum(count(*)) OVER () AS pct FROM catalog GROUP BY 1""", prep=False),
          rounded=["pct"])
def q_class_distribution(spark, sf):
    return B.class_distribution(cat(spark, sf, "rating"))


@register("price_histogram", with_catalog(""", v AS (SELECT final_price AS x FROM catalog WHERE final_price IS NOT NULL
  AND NOT isnan(final_price)),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
c AS (SELECT CAST(coalesce(least(floor((x - lo) / ((hi - lo) / 30)), 29), 0) AS INTEGER) AS bin, count(*) AS n
  FROM v, b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / 30) AS bin_lo,
  CASE WHEN i = 29 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 30) END AS bin_hi,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM generate_series(0, 29) AS g(i) CROSS JOIN b LEFT JOIN c ON c.bin = g.i""", prep=False),
          rounded=["bin_lo", "bin_hi"])
def q_price_histogram(spark, sf):
    return B.histogram(cat(spark, sf, "final_price"), "final_price", 30)


@register("rating_histogram", with_catalog(""", v AS (SELECT rating AS x FROM catalog WHERE rating IS NOT NULL AND NOT isnan(rating)),
s AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM v),
w AS (SELECT *, (hi - lo) / (log2(n) + 1) AS sturges, 2 * iqr / pow(n, 1 / 3.0) AS spread FROM s),
b AS (SELECT lo, hi, CASE WHEN hi = lo THEN 1 ELSE
  CAST(greatest(1, ceil((hi - lo) / (CASE WHEN spread > 0 THEN least(sturges, spread) ELSE sturges END))) AS INTEGER) END AS k FROM w),
c AS (SELECT CAST(coalesce(least(floor((x - lo) / ((hi - lo) / k)), k - 1), 0) AS INTEGER) AS bin, count(*) AS n FROM v, b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, lo + i * ((hi - lo) / k) AS bin_lo,
  CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * ((hi - lo) / k) END AS bin_hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM b CROSS JOIN LATERAL (SELECT unnest(range(k)) AS i) AS g LEFT JOIN c ON c.bin = g.i""", prep=False), rounded=["bin_lo", "bin_hi"])
def q_rating_histogram(spark, sf):
    """B7 with automatic bins."""
    return B.auto_histogram(cat(spark, sf, "rating"), "rating")


@register("date_span", with_catalog("SELECT min(date_added) AS min_value, max(date_added) AS max_value FROM catalog",
                                    prep=False))
def q_date_span(spark, sf):
    return B.value_span(cat(spark, sf, "date_added"), "date_added")


@register("distinct_brands", with_catalog("SELECT DISTINCT brand FROM catalog WHERE brand IS NOT NULL", prep=False))
def q_distinct_brands(spark, sf):
    return B.distinct_values(cat(spark, sf, "brand"), "brand")


# ------------------------------------------------------------------ C
def _days(a: str, b: str) -> str:
    return f"CAST(floor(date_diff('second', {a}, {b}) / 86400) AS INTEGER)"


REF = f"TIMESTAMP '{FIXTURE_REF_DATE} 00:00:00'"
FEATURE_SQL = f""", f0 AS (SELECT *, {_days('date_added', 'expiry_date')} AS days_to_expiry,
  {_days(REF, 'date_added')} AS days_since_added, CAST(month(date_added) AS INTEGER) AS month_added,
  sold_quantity / (sold_quantity + stock + 1) AS sell_through_rate,
  stock / (reorder_level + 1) AS stock_pressure,
  CAST(CASE WHEN delivery_status = 'Delayed' THEN 1 ELSE 0 END AS INTEGER) AS is_delayed
  FROM prep),
f AS (SELECT product_id, category, brand, city, seller, packaging_type, offer_filled AS offer_type,
  price, final_price, discount_pct, profit_margin_pct, weight_g, shelf_life_days, num_reviews, delivery_time_min,
  stock, sold_quantity, reorder_level, demand_index, days_to_expiry, days_since_added, month_added,
  sell_through_rate, stock_pressure, final_price * sold_quantity AS revenue_proxy, is_delayed,
  demand_index * num_reviews AS demand_x_reviews, demand_index * sell_through_rate AS popularity_score,
  (1 - is_delayed) / (delivery_time_min + 1) * 100 AS delivery_score,
  sold_quantity / (final_price + 1) AS value_score,
  profit_margin_pct * sell_through_rate / 100 AS margin_efficiency,
  (price - final_price) * sell_through_rate AS discount_effectiveness,
  CASE WHEN days_since_added + 1 = 0 THEN NULL ELSE num_reviews / (days_since_added + 1) * 100 END AS review_density,
  days_to_expiry / (shelf_life_days + 1) AS freshness_score,
  sell_through_rate / (stock_pressure + 0.01e0) AS inventory_health,
  price - final_price AS discount_amount, final_price / (weight_g + 1) AS price_per_gram,
  CAST(is_organic AS INTEGER) AS is_organic,
  CAST(coalesce(rating >= 3.8, false) AS INTEGER) AS label
  FROM f0)"""


@register("pre_launch_features", with_catalog(FEATURE_SQL + "\nSELECT " + ", ".join(
    ["product_id"] + CATEGORICAL + PRE_NUMERIC + ["label"]) + " FROM f"))
def q_pre_features(spark, sf):
    return C.engineer_pre_launch(catalog_view(spark, sf), FIXTURE_REF_DATE)


@register("post_launch_features", with_catalog(FEATURE_SQL + "\nSELECT " + ", ".join(
    ["product_id"] + POST_CATEGORICAL + POST_NUMERIC + ["label"]) + " FROM f"))
def q_post_features(spark, sf):
    return C.engineer_post_launch(catalog_view(spark, sf), FIXTURE_REF_DATE)


def _conform_sql() -> str:
    casts, checks = [], []
    for fld in POST_CONTRACT.fields:
        c = fld.name
        t = "INTEGER" if c in CONTRACT_INTS else ("VARCHAR" if isinstance(fld.dataType, T.StringType) else "DOUBLE")
        casts.append(f"TRY_CAST({c} AS {t}) AS {c}")
        checks.append(c)
    ok = " AND ".join(f"{c} IS NOT NULL" for c in checks)
    names = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in checks)
    return (FEATURE_SQL + f""",
k AS (SELECT product_id, {', '.join(casts)} FROM f)
SELECT *, {ok} AS success,
  CASE WHEN {ok} THEN NULL ELSE 'invalid or missing: ' || concat_ws(', ', {names}) END AS error FROM k""")


@register("conform_post_features", with_catalog(_conform_sql()))
def q_conform(spark, sf):
    return C.conform(C.engineer_post_launch(catalog_view(spark, sf), FIXTURE_REF_DATE), "post")


SCENARIO_AS_OF = "2001-09-01"
AS_OF = f"TIMESTAMP '{SCENARIO_AS_OF} 00:00:00'"
SCENARIO_SQL = f""", s0 AS (SELECT *, price * (1 - discount_pct / 100) AS fp,
  {_days(REF, AS_OF)} AS days, sold_quantity / (sold_quantity + stock + 1) AS st,
  stock / (reorder_level + 1) AS sp,
  CAST(CASE WHEN delivery_status = 'Delayed' THEN 1 ELSE 0 END AS INTEGER) AS dl FROM prep),
s AS (SELECT product_id, category, brand, city, seller, packaging_type, offer_filled AS offer_type,
  price, fp AS final_price, discount_pct, profit_margin_pct, weight_g, shelf_life_days, num_reviews,
  delivery_time_min, stock, sold_quantity, reorder_level, demand_index,
  shelf_life_days AS days_to_expiry, days AS days_since_added, CAST(month({AS_OF}) AS INTEGER) AS month_added,
  st AS sell_through_rate, sp AS stock_pressure, fp * sold_quantity AS revenue_proxy, dl AS is_delayed,
  demand_index * num_reviews AS demand_x_reviews, demand_index * st AS popularity_score,
  (1 - dl) / (delivery_time_min + 1) * 100 AS delivery_score, sold_quantity / (fp + 1) AS value_score,
  profit_margin_pct * st / 100 AS margin_efficiency, (price - fp) * st AS discount_effectiveness,
  CASE WHEN days + 1 = 0 THEN NULL ELSE num_reviews / (days + 1) * 100 END AS review_density,
  shelf_life_days / (shelf_life_days + 1) AS freshness_score, st / (sp + 0.01e0) AS inventory_health,
  price - fp AS discount_amount, fp / (weight_g + 1) AS price_per_gram, CAST(is_organic AS INTEGER) AS is_organic
  FROM s0)"""


@register("post_launch_scenario_features", with_catalog(SCENARIO_SQL + "\nSELECT " + ", ".join(
    ["product_id"] + POST_CATEGORICAL + POST_NUMERIC) + " FROM s"))
def q_scenario_features(spark, sf):
    return C.scenario_features(catalog_view(spark, sf), SCENARIO_AS_OF, "post", FIXTURE_REF_DATE)


@register("pre_launch_scenario_features", with_catalog(SCENARIO_SQL + "\nSELECT " + ", ".join(
    ["product_id"] + CATEGORICAL + PRE_NUMERIC) + " FROM s"))
def q_pre_scenario_features(spark, sf):
    return C.scenario_features(catalog_view(spark, sf), SCENARIO_AS_OF, "pre", FIXTURE_REF_DATE)


# ------------------------------------------------------------------ G
PAIRS_SQL = """, nx AS (SELECT conv_id, turn, role, text,
  lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, lead(turn) OVER w AS next_turn
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, text AS question, next_text AS answer, next_turn AS answer_turn
  FROM nx WHERE role = 'user' AND next_role = 'assistant')"""


def _log(spark, sf):
    return G.conversation_log(table(spark, sf, "conversations"))


@register("dialogue_log", """SELECT role, text AS content,
  row_number() OVER (ORDER BY conv_id % 2, conv_id, turn) - 1 AS position FROM conversations""")
def q_dialogue_log(spark, sf):
    """A2, A3: the turns appended in two batches (one of them twice), merged, and read back."""
    path = scratch_path(spark, f"dialogue-log-{uuid.uuid4().hex}")
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", F.col("text").alias("content"),
                                                                    F.lit(None).cast("string").alias("code_executed"), F.lit(None).cast("string").alias("timestamp"))
    for batch, odd in (("1_even", 0), ("2_odd", 1), ("1_even", 0)):
        append_dialogue(turns.where(F.col("conv_id") % 2 == odd), path, ["conv_id", "turn"], batch)
    compact_dialogue(spark, path)
    return read_dialogue(spark, path).select("role", "content", "position")


CSV_FILE_ROWS = 500_000


@register("catalog_from_csv", with_catalog("SELECT * FROM catalog", prep=False))
def q_catalog_from_csv(spark, sf):
    """A1: the catalogue written as CSV text and read back."""
    path = scratch_path(spark, f"catalog-csv-{uuid.uuid4().hex}")
    with hashed_joins(spark):
        view = catalog_view(spark, sf)
        text = view.select(*[F.col(c).cast("string") for c in view.columns])
        # a compressed file is read by one task, so files are bounded
        text.write.option("header", True).option("compression", "gzip").option("maxRecordsPerFile", CSV_FILE_ROWS).csv(path)
    return read_catalog(spark, path).select(*view.columns)


@register("dialogue_pairs", "WITH " + PAIRS_SQL.lstrip(", ") + "\nSELECT * FROM pairs")
def q_pairs(spark, sf):
    return G.pair_exchanges(_log(spark, sf))


FLAT_TS = "2024-01-01T00:00:00+00:00"


@register("dialogue_flat", "WITH " + PAIRS_SQL.lstrip(", ") + f"""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS exchange_id, 0 AS seq, 'user' AS role,
  coalesce(question, '') AS content, CAST(NULL AS VARCHAR) AS code_executed, '{FLAT_TS}' AS timestamp FROM pairs
UNION ALL
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 1, 'assistant',
  coalesce(nullif(answer, ''), ''), CAST(NULL AS VARCHAR), '{FLAT_TS}' FROM pairs""")
def q_flat(spark, sf):
    ex = G.pair_exchanges(_log(spark, sf)).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("exchange_id"),
        "question", F.col("answer").alias("summary"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("code_executed"))
    return G.flatten_exchanges(ex, FLAT_TS)


@register("dialogue_drop_pair", "WITH " + PAIRS_SQL.lstrip(", ") + """,
kth AS (SELECT turn, answer_turn FROM pairs WHERE conv_id = 0 ORDER BY turn LIMIT 1 OFFSET 1),
gone AS (SELECT turn FROM kth UNION ALL SELECT answer_turn FROM kth)
SELECT conv_id, turn, role, text AS content FROM conversations
WHERE NOT (conv_id = 0 AND turn IN (SELECT turn FROM gone))""")
def q_drop_pair(spark, sf):
    return G.drop_exchange(_log(spark, sf), 0, 1)


def _screen_sql() -> str:
    code = ("CASE WHEN regexp_matches(text, '(?s)```python\\s*(.*?)```') "
            "THEN regexp_replace(regexp_extract(text, '(?s)```python\\s*(.*?)```', 1), '^\\s+|\\s+$', '', 'g') "
            "ELSE regexp_replace(regexp_replace(text, '```\\w*', '', 'g'), '^\\s+|\\s+$', '', 'g') END")
    n = " + ".join(f"CAST(regexp_matches(code, '{p}') AS INTEGER)" for p in G.UNSAFE_PATTERNS)
    return f"""WITH a AS (SELECT conv_id, turn, {code} AS code FROM conversations WHERE role = 'assistant'),
s AS (SELECT conv_id, turn, code, {n} AS n_unsafe FROM a)
SELECT conv_id, turn, CAST(length(code) AS INTEGER) AS code_chars, n_unsafe, n_unsafe > 0 AS unsafe,
  CASE WHEN n_unsafe > 0 THEN 'error' WHEN code IS NULL OR code = '' THEN 'chat' ELSE 'text' END AS outcome FROM s"""


@register("answer_screen", _screen_sql())
def q_screen(spark, sf):
    return G.screen_answers(_log(spark, sf))


FENCED_SQL = """(SELECT conv_id, turn, role, CASE conv_id % 4
  WHEN 0 THEN 'Run this:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'
  WHEN 1 THEN '```python' || chr(10) || 'import os' || chr(10) || text || '``` and ```python' || chr(10) || 'x```'
  WHEN 2 THEN '```python' || chr(10) || '  ' || chr(10) || '```' ELSE '```' || text || '```' END AS text FROM conversations)"""


@register("answer_screen_fenced", _screen_sql().replace("FROM conversations", f"FROM {FENCED_SQL} AS f").replace(
    "ELSE 'text' END", "WHEN turn % 3 = 0 AND turn > 3 THEN 'table' ELSE 'text' END"))
def q_screen_fenced(spark, sf):
    """G5, G6 on answers with code fences (also empty, unsafe, repeated and unnamed ones) and tables,
    derived from ``conversations``."""
    nl, text = "\n", F.col("content")
    kind = F.col("conv_id") % 4
    fenced = (F.when(kind == 0, F.concat(F.lit(f"Run this:{nl}```python{nl}"), text, F.lit(f"{nl}```{nl}Done.")))
              .when(kind == 1, F.concat(F.lit(f"```python{nl}import os{nl}"), text, F.lit(f"``` and ```python{nl}x```")))
              .when(kind == 2, F.lit(f"```python{nl}  {nl}```")).otherwise(F.concat(F.lit("```"), text, F.lit("```"))))
    log = _log(spark, sf).withColumns({"content": fenced, "display_table": F.col("turn") % 3 == 0,
                                       "n_result_rows": F.greatest(F.col("turn") - 3, F.lit(0))})
    return G.screen_answers(log)


# ------------------------------------------------------------------ H
def _labelled(spark, sf):
    return cat(spark, sf, "product_id", "rating").select("product_id", high_rating().alias("label"))


LABEL_SQL = """, lab AS (SELECT product_id, CAST(coalesce(rating >= 3.8, false) AS INTEGER) AS label FROM catalog)"""


@register("label_codes", with_catalog(", ".join([""] + [
    f"d_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM "
    f"(SELECT DISTINCT coalesce({c}, 'No Offer') AS v FROM catalog))" if c == "offer_type" else
    f"d_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code FROM "
    f"(SELECT DISTINCT {c} AS v FROM catalog))" for c in CATEGORICAL]) + "\nSELECT product_id, " + ", ".join(
    [f"d_{c}.code AS {c}_code" for c in CATEGORICAL]) + " FROM prep " + " ".join(
    [f"JOIN d_{c} ON d_{c}.v = " + ("prep.offer_filled" if c == "offer_type" else f"prep.{c}") for c in CATEGORICAL])))
def q_label_codes(spark, sf):
    df = prepare(cat(spark, sf, "product_id", *CATEGORICAL))
    return H.label_encode(df, CATEGORICAL).select("product_id", *[f"{c}_code" for c in CATEGORICAL])


@register("stratified_split", with_catalog(LABEL_SQL + """
SELECT product_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(product_id || ':42'), product_id)
  <= round(0.8 * count(*) OVER (PARTITION BY label)) THEN 'train' ELSE 'test' END AS split FROM lab""", prep=False))
def q_stratified_split(spark, sf):
    return H.stratified_split(_labelled(spark, sf), "label", "product_id", 0.8, 42)


@register("random_split", with_catalog(LABEL_SQL + """
SELECT product_id, label, CASE WHEN substr(md5(product_id || ':42'), 1, 8) < 'cccccccc' THEN 'train' ELSE 'test' END
  AS split FROM lab""", prep=False))
def q_random_split(spark, sf):
    return H.random_split(_labelled(spark, sf), "product_id", 0.8, 42)


@register("class_weights", with_catalog(LABEL_SQL + """
, c AS (SELECT label, count(*) AS n FROM lab GROUP BY label)
SELECT label, n, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS weight FROM c""", prep=False),
          rounded=["weight"])
def q_class_weights(spark, sf):
    return H.class_weights(_labelled(spark, sf), "label")


@register("stratified_folds", with_catalog(LABEL_SQL + """
SELECT product_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(product_id || ':42'), product_id) - 1)
  % 5 AS INTEGER) AS fold FROM lab""", prep=False))
def q_folds(spark, sf):
    return H.assign_folds(_labelled(spark, sf), "label", "product_id", 5, 42)


# ------------------------------------------------------------------ J (rule baselines, exact in SQL)
@register("baseline_regression_metrics", with_catalog(""", m AS (SELECT category, avg(rating) AS p FROM catalog
  WHERE category IS NOT NULL GROUP BY category),
e AS (SELECT rating AS label, p AS prediction FROM catalog JOIN m USING (category))
SELECT sqrt(avg((prediction - label) * (prediction - label))) AS rmse, avg(abs(prediction - label)) AS mae FROM e""",
    prep=False), rounded=["rmse", "mae"])
def q_regression_metrics(spark, sf):
    df = cat(spark, sf, "category", "rating").where(F.col("category").isNotNull())
    means = df.groupBy("category").agg(F.avg("rating").alias("prediction"))
    pred = df.join(means, "category").select(F.col("rating").alias("label"), "prediction")
    return J.regression_metrics(pred)


RULE_SQL = """, pr AS (SELECT CAST(coalesce(rating >= 3.8, false) AS INTEGER) AS label,
  CAST(delivery_status = 'On-Time' AS INTEGER) AS on_time_rule,
  CAST(delivery_time_min < 35 AS INTEGER) AS fast_rule FROM catalog)"""


def _metrics_sql(src: str, pred: str, keys: str = "") -> str:
    tp, fp = f"count_if(label = 1 AND {pred} = 1)", f"count_if(label <> 1 AND {pred} = 1)"
    fn, tn = f"count_if(label = 1 AND {pred} <> 1)", f"count_if(label <> 1 AND {pred} <> 1)"
    return f"""SELECT {keys}tp, fp, fn, tn FROM (SELECT {keys}CAST({tp} AS DOUBLE) AS tp, CAST({fp} AS DOUBLE) AS fp,
  CAST({fn} AS DOUBLE) AS fn, CAST({tn} AS DOUBLE) AS tn FROM {src}{' GROUP BY ' + keys.rstrip(', ') if keys else ''})"""


def _metrics_select(keys: str = "") -> str:
    p1 = "coalesce(CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END, 0.0e0)"
    r1 = "coalesce(CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END, 0.0e0)"
    p0 = "coalesce(CASE WHEN tn + fn = 0 THEN NULL ELSE tn / (tn + fn) END, 0.0e0)"
    r0 = "coalesce(CASE WHEN tn + fp = 0 THEN NULL ELSE tn / (tn + fp) END, 0.0e0)"
    f1 = f"coalesce(CASE WHEN {p1} + {r1} = 0 THEN NULL ELSE 2 * {p1} * {r1} / ({p1} + {r1}) END, 0.0e0)"
    f0 = f"coalesce(CASE WHEN {p0} + {r0} = 0 THEN NULL ELSE 2 * {p0} * {r0} / ({p0} + {r0}) END, 0.0e0)"
    return (f"SELECT {keys}(tp + tn) / (tp + tn + fp + fn) AS accuracy, {p1} AS precision, {r1} AS recall, "
            f"{f1} AS f1, ({f1} + {f0}) / 2 AS macro_f1")


METRICS = ["accuracy", "precision", "recall", "f1", "macro_f1"]


def _rule_preds(spark, sf):
    df = cat(spark, sf, "rating", "delivery_status", "delivery_time_min")
    return df.select(high_rating().alias("label"),
                     (F.col("delivery_status") == "On-Time").cast("int").alias("on_time_rule"),
                     (F.col("delivery_time_min") < 35).cast("int").alias("fast_rule"))


@register("baseline_classification_metrics", with_catalog(RULE_SQL + ", cnt AS (" + _metrics_sql("pr", "on_time_rule")
                                                          + ")\n" + _metrics_select() + " FROM cnt", prep=False),
          rounded=METRICS)
def q_classification_metrics(spark, sf):
    return J.classification_metrics(_rule_preds(spark, sf), "label", "on_time_rule")


@register("baseline_confusion_matrix", with_catalog(RULE_SQL + """
SELECT 1 AS label, 1 AS prediction, CAST(count_if(label = 1 AND on_time_rule = 1) AS BIGINT) AS n FROM pr
UNION ALL SELECT 0, 1, CAST(count_if(label <> 1 AND on_time_rule = 1) AS BIGINT) FROM pr
UNION ALL SELECT 1, 0, CAST(count_if(label = 1 AND on_time_rule <> 1) AS BIGINT) FROM pr
UNION ALL SELECT 0, 0, CAST(count_if(label <> 1 AND on_time_rule <> 1) AS BIGINT) FROM pr""", prep=False))
def q_confusion(spark, sf):
    return J.confusion_matrix(_rule_preds(spark, sf), "label", "on_time_rule")


@register("baseline_model_comparison", with_catalog(RULE_SQL + """,
u AS (SELECT 'on_time_rule' AS model, label, on_time_rule AS prediction FROM pr
      UNION ALL SELECT 'fast_rule', label, fast_rule FROM pr),
cnt AS (""" + _metrics_sql("u", "prediction", "model, ") + ")\n" + _metrics_select("model, ") + " FROM cnt",
    prep=False), rounded=METRICS)
def q_model_comparison(spark, sf):
    p = _rule_preds(spark, sf)
    # both models' predictions from one scan (an exploded pair per row, not a union of two scans)
    u = p.select("label", F.inline(F.array(
        F.struct(F.lit("on_time_rule").alias("model"), F.col("on_time_rule").alias("prediction")),
        F.struct(F.lit("fast_rule").alias("model"), F.col("fast_rule").alias("prediction")))))
    return J.compare_models(u, "model", "label", "prediction")


# ------------------------------------------------------------------ operators on fixed inputs from the catalogue
PROB = "demand_index / 100.0e0"


@register("rule_decisions", with_catalog(f"""SELECT product_id, {PROB} AS probability, {PROB} >= 0.45e0 AS is_high,
  CAST(floor({PROB} * 100) AS INTEGER) AS score,
  CASE WHEN floor({PROB} * 100) >= 70 OR floor({PROB} * 100) <= 30 THEN 'High confidence' ELSE 'Moderate confidence' END AS confidence
FROM catalog WHERE demand_index IS NOT NULL""", prep=False))
def q_rule_decisions(spark, sf):
    """K2 on a probability that SQL can compute as well."""
    df = cat(spark, sf, "product_id", "demand_index").where(F.col("demand_index").isNotNull())
    return K.decide(df.select("product_id", (F.col("demand_index") / 100.0).alias("probability")))


@register("catalog_records", with_catalog("""SELECT '{"product_id":' || to_json(product_id) || coalesce(',"offer_type":' || to_json(offer_type), '')
  || ',"stock":' || CAST(stock AS VARCHAR) || '}' AS record FROM catalog""", prep=False))
def q_records(spark, sf):
    """A4: absent values are left out of a record."""
    return to_records(cat(spark, sf, "product_id", "offer_type", "stock"))


@register("parsed_dates", with_catalog("""SELECT product_id,
  CASE WHEN sold_quantity % 5 = 0 THEN NULL ELSE CAST(CAST(date_added AS DATE) AS TIMESTAMP) END AS parsed FROM catalog""", prep=False))
def q_parsed_dates(spark, sf):
    """Dates as text, some of them no dates."""
    df = cat(spark, sf, "product_id", "date_added", "sold_quantity")
    text = F.when(F.col("sold_quantity") % 5 == 0, F.lit("soon")).otherwise(F.date_format("date_added", "yyyy-MM-dd"))
    return df.select("product_id", parsed_date(text).alias("parsed"))


@register("unseen_codes", with_catalog(""", codes AS (SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT category FROM catalog WHERE year(date_added) < 1996))
SELECT product_id, coalesce(code, -1) AS category_code FROM (SELECT product_id,
  CASE WHEN sold_quantity = 7 THEN 'never seen' ELSE category END AS category FROM catalog) LEFT JOIN codes USING (category)""", prep=False))
def q_unseen_codes(spark, sf):
    """H2: codes learned from the rows before 1996, applied to all; unseen values are -1."""
    df = cat(spark, sf, "product_id", "category", "date_added", "sold_quantity")
    model = H.ordinal_encode(df.where(F.year("date_added") < 1996), ["category"])
    seen = df.withColumn("category", F.when(F.col("sold_quantity") == 7, "never seen").otherwise(F.col("category")))
    return model.transform(seen).select("product_id", "category_code")


SCALED = ["price", "stock", "demand_index"]


@register("scaled_features", with_catalog("SELECT product_id, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM catalog)) / (SELECT stddev_pop({c}) FROM catalog) AS {c}" for c in SCALED) + " FROM catalog", prep=False),
    rounded=SCALED)
def q_scaled(spark, sf):
    """H3 with population deviations."""
    df = cat(spark, sf, "product_id", *SCALED)
    vec = I.fit_pipeline(df, [], SCALED, None).transform(df)
    return vec.select("product_id", *[vector_to_array("features")[i].alias(c) for i, c in enumerate(SCALED)])


@register("rule_contributions", with_catalog("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, avg(abs({w} * (({c} - (SELECT avg({c}) FROM catalog)) / (SELECT stddev_pop({c}) FROM catalog)))) AS mean_abs
FROM catalog""" for c, w in zip(SCALED, ("0.5e0", "-2.0e0", "0.25e0"))), prep=False), rounded=["mean_abs"])
def q_contributions(spark, sf):
    """Contributions of a linear rule with fixed weights."""
    df = cat(spark, sf, *SCALED)
    vec = I.fit_pipeline(df, [], SCALED, None).transform(df)
    return J.linear_contributions(vec, [0.5, -2.0, 0.25], SCALED)


@register("display_texts", with_catalog("""SELECT category, '₹' || printf('%.2f', units * 0.25e0) || ' Crs' AS money,
  printf('%.1f', units % 64 * 0.5e0) || '%' AS percent, '★ ' || printf('%.2f', units % 20 * 0.25e0) AS stars, format('{:,}', units) AS thousands
FROM (SELECT category, sum(sold_quantity)::BIGINT AS units FROM catalog GROUP BY category)""", prep=False))
def q_display_texts(spark, sf):
    """L1, L2 on numbers whose digits are exact (quarters and halves)."""
    u = F.col("units")
    t = cat(spark, sf, "category", "sold_quantity").groupBy("category").agg(F.sum("sold_quantity").alias("units"))
    return t.select("category", L.money(u * 0.25e7).alias("money"), L.percent(u % 64 * 0.5).alias("percent"),
                    L.stars(u % 20 * 0.25).alias("stars"), L.thousands(u).alias("thousands"))


@register("seller_names", with_catalog("SELECT city, string_agg(DISTINCT packaging_type, ', ' ORDER BY packaging_type) AS names FROM catalog GROUP BY city",
                                       prep=False))
def q_names(spark, sf):
    """L3: one text of sorted names per group."""
    return cat(spark, sf, "city", "packaging_type").distinct().groupBy("city").agg(L.name_text("packaging_type").alias("names"))


@register("conform_bad_rows", with_catalog("""SELECT product_id, sold_quantity % 3 <> 0 AND offer_type IS NOT NULL AS success,
  CASE WHEN sold_quantity % 3 <> 0 AND offer_type IS NOT NULL THEN NULL ELSE 'invalid or missing: ' ||
    concat_ws(', ', CASE WHEN offer_type IS NULL THEN 'offer_type' END, CASE WHEN sold_quantity % 3 = 0 THEN 'sold_quantity' END) END AS error
FROM catalog""", prep=False))
def q_conform_bad(spark, sf):
    """Null offers, and fractions where the contract has whole numbers."""
    contract = T.StructType([T.StructField("offer_type", T.StringType()), T.StructField("sold_quantity", T.IntegerType())])
    df = cat(spark, sf, "product_id", "offer_type", "sold_quantity")
    half = F.when(F.col("sold_quantity") % 3 == 0, 0.5).otherwise(0.0)
    return C.conform(df.withColumn("sold_quantity", F.col("sold_quantity") + half), contract).select("product_id", "success", "error")


# ------------------------------------------------------------------ I1, A5-A7, K1-K3 with exact results
@register("linear_fit", with_catalog(""", v AS (SELECT discount_pct AS x, rating AS y FROM catalog WHERE discount_pct IS NOT NULL AND rating IS NOT NULL),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, stddev_pop(x) AS s, avg(x) AS m FROM v)
SELECT any_value(b * s) AS weight, any_value(a + b * m) AS intercept, sqrt(avg((a + b * x - y) * (a + b * x - y))) AS rmse,
  avg(abs(a + b * x - y)) AS mae FROM v, f""", prep=False), rounded=["weight", "intercept", "rmse", "mae"])
def q_linear_fit(spark, sf):
    """Least squares on one standardised feature, learned from and scored on all rows."""
    rows = cat(spark, sf, "discount_pct", "rating").dropna()
    model = I.fit_pipeline(rows, [], ["discount_pct"], I.linear_regression("rating"))
    line = model.stages[-1]
    scores = J.regression_metrics(model.transform(rows), "rating", "prediction")
    return scores.select(F.lit(float(line.coefficients[0])).alias("weight"), F.lit(float(line.intercept)).alias("intercept"), "rmse", "mae")


FIXED_WEIGHTS, FIXED_INTERCEPT = [0.5, -0.75, 0.25], 0.125
_FIXED_SQL = ", m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED) + """ FROM catalog),
z AS (SELECT product_id, sold_quantity % 5 <> 0 AS success, 1 / (1 + exp(-(0.125e0 + """ + " + ".join(
    f"{w}e0 * (({c} - m_{c}) / s_{c})" for c, w in zip(SCALED, FIXED_WEIGHTS)) + """))) AS p FROM catalog, m),
d AS (SELECT product_id, success, CAST(p > 0.5 AS INTEGER) AS prediction, p AS probability, p >= 0.45 AS is_high,
  CAST(floor(p * 100) AS INTEGER) AS score, CASE WHEN floor(p * 100) >= 70 OR floor(p * 100) <= 30 THEN 'High confidence'
  ELSE 'Moderate confidence' END AS confidence FROM z)
"""


def _fixed_model(spark, catalog):
    """The hand-set model behind a scaler fitted on the catalogue, saved, recorded as the newest
    of two runs of its name, and loaded through the run table."""
    prep = I.fit_pipeline(catalog, [], SCALED, None)
    base = scratch_path(spark, f"fixed-model-{uuid.uuid4().hex}")
    for k, weights in enumerate(([1.0, 1.0, 1.0], FIXED_WEIGHTS)):
        model = PipelineModel(stages=[*prep.stages, I.fixed_logistic(spark, weights, FIXED_INTERCEPT)])
        log_run(spark, f"{base}/runs", "rules", "fixed", {"weights": weights}, {}, save_model(model, f"{base}/{k}"))
    return require_latest_model(spark, f"{base}/runs", "rules", "fixed")


@register("fixed_model_scores", with_catalog(_FIXED_SQL + "SELECT * EXCLUDE (success) FROM d", prep=False), rounded=["probability"])
def q_fixed_scores(spark, sf):
    """A model with hand-set weights is saved, recorded, loaded and scores all rows."""
    df = cat(spark, sf, "product_id", *SCALED)
    return K.decide(K.score(_fixed_model(spark, df), df))


@register("fixed_model_stream", with_catalog(_FIXED_SQL + """SELECT product_id, CASE WHEN success THEN prediction ELSE -1 END AS prediction,
  CASE WHEN success THEN probability ELSE -1 END AS probability, success AND is_high AS is_high, CASE WHEN success THEN score ELSE -1 END AS score,
  CASE WHEN success THEN confidence END AS confidence, success, CASE WHEN NOT success THEN 'invalid or missing: stock' END AS error FROM d""", prep=False),
          rounded=["probability"])
def q_fixed_stream(spark, sf):
    """K3: the hand-set model scores requests as a stream of files; a fifth of them lacks a value."""
    df = written(cat(spark, sf, "product_id", "sold_quantity", *SCALED))
    requests = df.withColumn("stock", F.when(F.col("sold_quantity") % 5 != 0, F.col("stock"))).select("product_id", *SCALED)
    base = scratch_path(spark, f"fixed-stream-{uuid.uuid4().hex}")
    requests.write.parquet(f"{base}/requests")
    start_scoring(spark, _fixed_model(spark, df.select(*SCALED)), f"{base}/requests", requests.schema, f"{base}/scores",
                  f"{base}/checkpoint", contract_schema([], SCALED)).awaitTermination()
    return spark.read.parquet(f"{base}/scores").fillna(-1).fillna(False)


@register("run_table", with_catalog("""SELECT category AS name, avg(sold_quantity) AS mean_units, category = max(category) OVER () AS is_latest
FROM catalog WHERE category IS NOT NULL GROUP BY category""", prep=False), rounded=["mean_units"])
def q_run_table(spark, sf):
    """One run for every category (its mean as the metric), half of them merged into a
    snapshot, one of them sent twice; the newest run of the experiment is the last category's."""
    means = cat(spark, sf, "category", "sold_quantity").dropna(subset=["category"]).groupBy("category").agg(F.avg("sold_quantity").alias("m"))
    path = scratch_path(spark, f"run-table-{uuid.uuid4().hex}")
    found = means.orderBy("category").collect()  # a run record is the driver's: one row per category
    for k, r in enumerate(found):
        for _ in range(2 if k == 0 else 1):
            log_run(spark, path, "means", r["category"], {"k": k}, {"mean_units": r["m"]}, run_id=f"run_{k}")
        if k == len(found) // 2:
            compact_runs(spark, path)
    runs = read_runs(spark, path)
    newest = latest_run(runs, "means").select("name").scalar()
    return runs.select("name", F.col("metrics")["mean_units"].alias("mean_units"), (F.col("name") == newest).alias("is_latest"))
