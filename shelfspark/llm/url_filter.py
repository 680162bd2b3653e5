"""URL filter: host and path rules, and a character language-model ratio for the rest.

DataFrame functions only. Two variable-order Markov models, one of allowed and one of
blocked URLs, are learned from the URLs that the rules decide. A character's probability
behind a context mixes the context's own counts with the next shorter context's
probability, in the weight of its number of different followers (Witten-Bell); contexts
never seen leave it to the shorter one. A URL's score is the mean over its characters of
the log ratio of both models; the cutoff is calibrated on decided URLs set aside.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.common import pinned
from shelfspark.session import spread

#: Fixed rules (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_START, _END = "\x02", "\x03"


@dataclass(frozen=True)
class Model:
    """Longest context; every ``calibrate``-th decided URL (by hash) sets the cutoff; the
    cutoff's grid (steps per unit of mean log ratio)."""

    order: int = 4
    calibrate: int = 5
    grid: int = 1000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_number(host: Column, path: Column, rules=RULES) -> Column:
    """Position in ``rules`` of the longest rule that fits the host or a parent domain, and
    whose path starts the URL's path; null if none does. Of equally long rules the first."""
    out = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1]) + len(rules[i][2]), -i)):
        _, h, p = rules[i]
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(i)).otherwise(out)
    return out


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """One row per character of ``shown``: the character behind its ``order`` predecessors."""
    padded = F.concat(F.lit(_START * order), "shown", F.lit(_END))
    places = F.sequence(F.lit(1), F.char_length(padded) - order)
    return urls.withColumn("gram", F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(order + 1)))))


def _log_ratios(wanted: DataFrame, seen: DataFrame, order: int, alphabet: int) -> DataFrame:
    """(gram, ratio) for each wanted gram, from (gram, allow, block) counts."""
    out = wanted.withColumns({"p_allow": F.lit(1.0 / alphabet), "p_block": F.lit(1.0 / alphabet)})
    for k in range(order + 1):
        part = F.substring("gram", order + 1 - k, k + 1)
        counts = seen.groupBy(part.alias("part")).agg(F.sum("allow").alias("c_allow"), F.sum("block").alias("c_block"))
        followers = counts.groupBy(F.substring("part", 1, k).alias("context")).agg(
            F.sum("c_allow").alias("n_allow"), F.sum("c_block").alias("n_block"),
            F.count_if(F.col("c_allow") > 0).alias("t_allow"), F.count_if(F.col("c_block") > 0).alias("t_block"))
        out = (out.withColumns({"part": part, "context": F.substring("gram", order + 1 - k, k)})
               .join(counts, "part", "left").join(followers, "context", "left"))
        # Witten-Bell: (c + t * shorter) / (n + t); nothing seen: the shorter context's
        out = out.select("gram", *[
            F.coalesce(F.try_divide(F.coalesce(f"c_{v}", F.lit(0)) + F.col(f"t_{v}") * F.col(f"p_{v}"),
                                    F.col(f"n_{v}") + F.col(f"t_{v}")), F.col(f"p_{v}")).alias(f"p_{v}")
            for v in ("allow", "block")])
    # whole nanos, so that sums don't depend on the order of rows
    return out.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * 1e9).cast("bigint").alias("ratio"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model: Model = Model()) -> DataFrame:
    """(id, host, path, rule, verdict, score, cutoff), one row per row of ``pages``.

    ``verdict`` is the rule's; without one, ``allow`` if the score reaches the cutoff, else
    ``block``. What is scored is host, path and the rest behind ``://`` (the whole URL
    without it, nothing for null). Different URLs are learned from and scored once,
    whatever number of rows hold them. The cutoff makes the fewest errors, both classes
    weighing alike, on decided URLs kept out of the models; of equal cutoffs the one
    nearest 0, then the higher. Without decided URLs of both classes set aside it is 0;
    without any to learn from all scores are 0. A URL without characters scores 0. Null
    ids and repeated rows stay as they are; other columns are not read.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    urls = rows.groupBy("url").agg(F.lit(1).alias("one")).drop("one").withColumns({"host": host_of(url), "path": path_of(url)})
    urls = urls.withColumns({
        "shown": F.coalesce(F.when(url.contains("://"), F.concat("host", F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([\s\S]*)$", 1)))
                            .otherwise(url), F.lit("")),
        "rule_at": rule_number(F.col("host"), F.col("path"), rules),
        "aside": F.pmod(F.xxhash64("url"), F.lit(model.calibrate)) == 0,
    })
    verdict = F.element_at(F.array(*[F.lit(v) for v, _, _ in rules]), F.col("rule_at") + 1)
    urls = pinned(urls.withColumn("decided", F.when(F.col("rule_at").isNotNull(), verdict)))
    learn = F.col("decided").isNotNull() & ~F.col("aside")
    # URLs are dealt out again, as their few bytes become many grams; grams are counted before they are shuffled; lower orders come from these counts
    all_grams = pinned(_grams(spread(urls.select("shown", "decided", learn.alias("learn"))), model.order).groupBy("gram").agg(
        F.count_if(F.col("learn") & (F.col("decided") == "allow")).alias("allow"),
        F.count_if(F.col("learn") & (F.col("decided") == "block")).alias("block")))
    letters = all_grams.select(F.substring("gram", model.order + 1, 1)).distinct().count()
    ratios = _log_ratios(all_grams.select("gram"), all_grams.where("allow + block > 0"), model.order, letters + 1)
    mean = F.sum("ratio").cast("double") / F.count(F.lit(1)) / 1e9
    scores = (_grams(spread(urls.select("url", "shown").where("url IS NOT NULL")), model.order).join(ratios, "gram")
              .groupBy("url").agg(F.round(mean, 9).alias("score")))
    scored = pinned(urls.join(scores, "url", "left").select(
        "url", "host", "path", "rule_at", "decided", "aside",
        F.when(F.col("shown") == "", 0.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score")))
    cutoff = _cutoff(scored.where("aside AND decided IS NOT NULL"), model.grid)
    named = F.element_at(F.array(*[F.lit(h + p) for _, h, p in rules]), F.col("rule_at") + 1)
    judged = scored.withColumn("cutoff", F.lit(cutoff)).select(
        "url", "host", "path", F.when(F.col("rule_at").isNotNull(), named).alias("rule"),
        F.coalesce("decided", F.when(F.col("score") >= F.col("cutoff"), "allow").otherwise("block")).alias("verdict"),
        "score", "cutoff")
    out = rows.withColumnRenamed("url", "of").join(judged, F.col("of").eqNullSafe(F.col("url")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score", "cutoff")


def _cutoff(aside: DataFrame, grid: int) -> float:
    """The calibrated cutoff, one number. Works on counts per grid step of the score: bounded
    by the range of the score (a mean log ratio), whatever the number of URLs."""
    step = F.floor(F.col("score") * grid).cast("bigint")
    bins = aside.groupBy(step.alias("step")).agg(F.count_if(F.col("decided") == "allow").alias("allow"),
                                                 F.count_if(F.col("decided") == "block").alias("block"))
    everything = Window.partitionBy(F.lit(0))
    lower = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    errors = bins.select("step", F.coalesce(F.sum("allow").over(lower), F.lit(0)).alias("lost"),
                         (F.sum("block").over(everything) - F.coalesce(F.sum("block").over(lower), F.lit(0))).alias("passed"),
                         F.sum("allow").over(everything).alias("n_allow"), F.sum("block").over(everything).alias("n_block"))
    best = (errors.where("n_allow > 0 AND n_block > 0")
            .orderBy(F.col("lost") * F.col("n_block") + F.col("passed") * F.col("n_allow"), F.abs("step"), F.desc("step"))
            .select("step").first())
    return best["step"] / grid if best else 0.0
