"""Quotation linking: reply trees of messages from the passages they quote.

DataFrame functions only. Quote prefixes (``>``, nested) are parsed line by line, quoted
passages are normalised and hashed, and looked up among the hashes of earlier messages'
own words in the same conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.common import pinned
from shelfspark.plans.windows import next_row, running_count

_PREFIX = r"^((?:[ \t]?>)+)[ \t]?"
#: A line that announces a quote ("On ..., ... wrote:"), right above one.
ATTRIBUTION = r"^\s*(on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
_BUCKET = 4096


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(text: Column) -> Column:
    """array of (level, content) per line: level is the number of quote marks before it."""
    marks = lambda line: F.regexp_extract(line, _PREFIX, 1)
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda line: F.struct(
        F.length(F.translate(marks(line), " \t", "")).alias("level"), F.regexp_replace(line, _PREFIX, "").alias("content")))


def split_messages(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """(conv, turn, role, body, passages): own words and quoted passages of every message.

    A passage is a run of lines of one level of at least 1; ``body`` is the level-0 lines
    without attribution lines right above a quote, without white space at both ends.
    """
    df = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"),
                         parsed(F.col(text)).alias("lines"), F.col(text).isNull().alias("none"))
    n = F.size("lines")
    level = lambda i: F.get("lines", i)["level"]
    df = df.withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (level(i) != level(i - 1))))
    df = df.withColumn("passages", F.filter(F.transform("starts", lambda s, k: F.struct(
        level(s).alias("level"),
        F.array_join(F.transform(F.slice("lines", s + 1, F.coalesce(F.get("starts", k + 1), n) - s), lambda x: x["content"]), "\n")
        .alias("passage"))), lambda p: p["level"] > 0))
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(
        F.lower(x["content"]).rlike(ATTRIBUTION) & (F.coalesce(level(i + 1), F.lit(0)) > 0)))
    body = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["content"]), "\n"), r"^\s+|\s+$", "")
    return df.select("conv", "turn", "role", F.when(~F.col("none"), body).alias("body"), "passages")


def _units(whole: Column) -> Column:
    """What can be quoted of a text: the whole, and its paragraphs (separated by blank lines),
    lines and sentences (up to ``.``, ``!`` or ``?``, also across lines), white space folded."""
    paragraphs = F.transform(F.split(whole, r"\n\s*\n"), normalised)
    sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, r"(?<=[.!?]) ")))
    parts = F.array_distinct(F.concat(paragraphs, F.transform(F.split(whole, "\n"), normalised), sentences))
    one = F.array(F.struct(F.lit(True).alias("is_whole"), normalised(whole).alias("unit")))
    return F.filter(F.concat(one, F.transform(parts, lambda x: F.struct(F.lit(False).alias("is_whole"), x.alias("unit")))),
                    lambda u: u["unit"] != "")


def _last_original(quotes: DataFrame, originals: DataFrame) -> DataFrame:
    """Add ``original``: the last earlier turn of the same conversation that holds the unit.

    An as-of join: quotes and originals of one (conversation, hash) run past each other in
    turn order, in buckets of turns; the last original of earlier buckets comes from a table
    with one row per bucket. So a line that everybody says and quotes makes no pairs.
    """
    key = ["conv", "hash", "size", "is_whole"]
    bucket = F.floor(F.col("turn") / _BUCKET).alias("bucket")
    both = (originals.select(*key, "turn", bucket, F.col("turn").alias("own"), F.lit(None).cast("int").alias("level"))
            .distinct().unionByName(quotes.select(*key, "turn", bucket, F.lit(None).cast("bigint").alias("own"), "level").distinct()))
    before = Window.partitionBy(*key, "bucket").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max("own").over(before)).where("level IS NOT NULL")
    per_bucket = both.groupBy(*key, "bucket").agg(F.max("own").alias("last"))
    earlier = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.withColumn("far", F.max("last").over(earlier)).select(*key, "bucket", "far")
    return (near.join(carried, [*key, "bucket"]).select("conv", "turn", "level", "is_whole", "size", F.coalesce("near", "far").alias("original"))
            .where("original IS NOT NULL"))


def link_quotes(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """(conv, turn, role, body, parent_turn, root_turn, depth, position), one row per message.

    ``parent_turn``: the earlier message whose words the outermost quotes hold: one quoted as
    a whole before one quoted in part (paragraph, line or sentence), then the longest part,
    then the latest message. Null without a resolved quote. ``root_turn`` follows the parents
    up, ``depth`` counts them. ``position`` numbers the messages of a conversation by tree
    (order of roots) and reply order: a message, then each reply (by turn) with all that
    answers it; without quotes it is the order of turns.

    Null text: null body, no quotes. Messages without a conversation or turn quote nothing
    and are not quoted. Repeated (conversation, turn) rows share their parent and stand
    side by side, by role and body. Other columns are not read.
    """
    base = pinned(split_messages(messages, conv, turn, text, role))
    placed = base.where("conv IS NOT NULL AND turn IS NOT NULL")
    unit = lambda df: df.select("*", F.col("u.is_whole").alias("is_whole"), F.xxhash64("u.unit").alias("hash"),
                                F.length("u.unit").alias("size"))
    # only a conversation with a quote has originals to look up
    quoting = placed.where(F.size("passages") > 0).select("conv").distinct()
    originals = unit(placed.where("body <> ''").join(quoting, "conv", "left_semi").select("conv", "turn", F.explode(_units(F.col("body"))).alias("u")))
    quoted = placed.where(F.size("passages") > 0).select("conv", "turn", F.explode("passages").alias("p")).select(
        "conv", "turn", F.col("p.level").alias("level"), F.explode(_units(F.col("p.passage"))).alias("u"))
    found = _last_original(unit(quoted), originals)
    parents = pinned(found.groupBy("conv", "turn").agg(
        F.max(F.struct((-F.col("level")).alias("outer"), "is_whole", "size", "original"))["original"].alias("parent_turn")))
    up = _roots(parents)
    joined = base.join(up, ["conv", "turn"], "left").join(_reply_order(up), ["conv", "turn"], "left")
    full = joined.select("conv", "turn", "role", "body", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"),
                         F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), F.coalesce(-F.col("behind"), F.lit(0)).alias("place"))
    order = [F.col(c).asc_nulls_first() for c in ("root_turn", "place", "turn", "role", "body")]
    placed_all = running_count(full, order, partition=["conv"], out="position").drop("place")
    return placed_all.withColumnsRenamed({"conv": conv, "turn": turn, "role": role})


def _roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, parent_turn, root_turn, depth): each round follows twice as many links."""
    now = parents.withColumns({"root_turn": F.col("parent_turn"), "depth": F.lit(1).cast("bigint")})
    while True:
        above = now.select("conv", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("depth").alias("more"))
        step = pinned(now.join(above, ["conv", "root_turn"], "left").select(
            "conv", "turn", "parent_turn", F.coalesce("higher", "root_turn").alias("root_turn"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")))
        now = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return now


def _reply_order(up: DataFrame) -> DataFrame:
    """(conv, turn, behind) of the messages in reply trees: how many messages of its tree, itself
    included, do not come before it when every reply's subtree stands behind the reply.

    The walk around a tree enters and leaves each message once; every step names the next,
    and each round follows twice as many steps, so neither depth nor width of a tree matters.
    """
    siblings = next_row(up.select("conv", "parent_turn", "turn"), ["conv", "parent_turn"], "turn", [])
    first = up.groupBy("conv", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    roots = up.select("conv", F.col("root_turn").alias("turn")).distinct().select(
        "conv", F.lit(None).cast("bigint").alias("parent_turn"), "turn", F.lit(None).cast("bigint").alias("next_turn"))
    nodes = siblings.select("conv", "parent_turn", "turn", "next_turn").unionByName(roots).join(first, ["conv", "turn"], "left")
    to = lambda turn, leaves: F.struct(turn.alias("turn"), F.lit(leaves).alias("leaves"))
    child, sibling, parent, own = (F.col(c) for c in ("child", "next_turn", "parent_turn", "turn"))
    steps = nodes.select("conv", F.explode(F.array(
        F.struct(to(own, False).alias("at"), F.when(child.isNotNull(), to(child, False)).otherwise(to(own, True)).alias("next"),
                 F.lit(1).cast("bigint").alias("behind")),
        F.struct(to(own, True).alias("at"), F.when(sibling.isNotNull(), to(sibling, False)).when(parent.isNotNull(), to(parent, True)).alias("next"),
                 F.lit(0).cast("bigint").alias("behind")))).alias("s")).select("conv", "s.*")
    now = pinned(steps)
    while now.where("next IS NOT NULL").limit(1).count():
        further = now.select("conv", F.col("at").alias("next"), F.col("next").alias("then"), F.col("behind").alias("more"))
        now = pinned(now.join(further, ["conv", "next"], "left").select(
            "conv", "at", F.col("then").alias("next"), (F.col("behind") + F.coalesce("more", F.lit(0))).alias("behind")))
    return now.where("NOT at.leaves").select("conv", F.col("at.turn").alias("turn"), "behind")
