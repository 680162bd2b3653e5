"""G: question-answer log operators (pairing, flattening, deletion, code screening)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.common import first_nonempty, strip_ws
from shelfspark.plans.windows import next_row

# Patterns that make generated code unsafe to run (any match blocks it).
UNSAFE_PATTERNS = [
    r"\bimport\s+os\b", r"\bimport\s+sys\b", r"\bimport\s+subprocess\b",
    r"\bimport\s+shutil\b", r"\bopen\s*\(", r"\bos\s*\.", r"\bsys\s*\.",
    r"\bsubprocess\s*\.", r"\bshutil\s*\.", r"\beval\s*\(",
    r"__import__\s*\(", r"\.write\s*\(", r"\.unlink\s*\(",
    r"\.remove\s*\(", r"\brmdir\b", r"\brmtree\b",
]
# Fenced block patterns and the blocked-code message.
FENCED_PYTHON = r"(?s)```python\s*(.*?)```"
ANY_FENCE = r"```\w*"
BLOCKED_MESSAGE = "Blocked: generated code contains unsafe operations."


def conversation_log(conversations: DataFrame) -> DataFrame:
    """The ``conversations`` table as a dialogue log: (conv_id, turn, role, content)."""
    return conversations.select("conv_id", "turn", "role", F.col("text").alias("content"))


def pair_exchanges(log: DataFrame, part: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each user row paired with the assistant row right after it; others skipped.

    The reference's greedy scan (pair and skip two, else skip one) can never use
    an assistant row twice, so it equals "user row whose next row is an
    assistant row". The next row is found with a bucketed window (``next_row``),
    so one very long conversation is still split over many tasks.
    """
    nxt = next_row(log.select(part, order, "role", "content"), [part], order, ["role", "content"])
    return (nxt.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
            .select(part, F.col(order).alias("turn"), F.col("content").alias("question"),
                    F.col("next_content").alias("answer"), F.col(f"next_{order}").alias("answer_turn")))


def flatten_exchanges(exchanges: DataFrame, ts, key: str = "exchange_id") -> DataFrame:
    """G1: one exchange -> a user row and an assistant row sharing a timestamp.

    Assistant text is the summary, else the error, else ""; the user row has no code.
    """
    t = ts if isinstance(ts, Column) else F.lit(str(ts))
    rows = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("user").alias("role"),
                 F.coalesce(F.col("question"), F.lit("")).alias("content"),
                 F.lit(None).cast("string").alias("code_executed")),
        F.struct(F.lit(1).alias("seq"), F.lit("assistant").alias("role"),
                 first_nonempty("summary", "error").alias("content"),
                 F.col("code_executed").cast("string").alias("code_executed")))
    return exchanges.select(F.col(key), F.inline(rows)).withColumn("timestamp", t)


def drop_exchange(log: DataFrame, conv_id, k: int, part: str = "conv_id", order: str = "turn") -> DataFrame:
    """Remove the ``k``-th (0-based) user/assistant pair of one conversation.

    Unlike deleting rows 2k and 2k+1 blindly, this removes exactly the two rows of
    pair ``k`` as found by ``pair_exchanges``; only ``k + 1`` pairs are ranked.
    """
    pairs = pair_exchanges(log.where(F.col(part) == F.lit(conv_id)), part, order)
    first = pairs.orderBy("turn").limit(k + 1).agg(F.max(F.struct("turn", "answer_turn")).alias("p"),
                                                   F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    target = first.select(F.explode(F.array(F.col("p.turn"), F.col("p.answer_turn"))).alias(order)) \
        .withColumn(part, F.lit(conv_id))
    return log.join(F.broadcast(target), [part, order], "left_anti")  # at most two rows


def unsafe_matches(c) -> Column:
    """Array of the unsafe patterns found in a code column."""
    code = F.col(c) if isinstance(c, str) else c
    return F.filter(F.array(*[F.when(code.rlike(p), F.lit(p)) for p in UNSAFE_PATTERNS]),
                    lambda x: x.isNotNull())


def flag_unsafe_code(df: DataFrame, c: str = "code") -> DataFrame:
    """``unsafe`` flag and the number of matched patterns."""
    m = unsafe_matches(c)
    return df.withColumn("unsafe_patterns", m).withColumn("unsafe", F.size(m) > 0)


def code_block(c) -> Column:
    """G5 (Column form): the first fenced python block (dot matches newline), else the
    text with fences removed; trimmed of surrounding whitespace and newlines."""
    text = F.col(c) if isinstance(c, str) else c
    return F.when(text.rlike(FENCED_PYTHON), strip_ws(F.regexp_extract(text, FENCED_PYTHON, 1))) \
        .otherwise(strip_ws(F.regexp_replace(text, ANY_FENCE, "")))


def extract_code(df: DataFrame, c: str = "content", out: str = "code") -> DataFrame:
    """Add the extracted code of text column ``c`` as ``out``."""
    return df.withColumn(out, code_block(c))


def answer_outcome(df: DataFrame) -> DataFrame:
    """Outcome of an answer record (error, summary, code, display_table, n_result_rows).

    An error wins; a table is returned only when asked for and not empty; a
    chat-only answer has no code.
    """
    err = F.nullif(F.col("error"), F.lit(""))
    return df.withColumn(
        "outcome",
        F.when(err.isNotNull(), "error")
        .when(F.col("code").isNull() | (F.col("code") == ""), "chat")
        .when(F.coalesce(F.col("display_table"), F.lit(False)) & (F.col("n_result_rows") > 0), "table")
        .otherwise("text"))


def screen_answers(log: DataFrame) -> DataFrame:
    """G4+G5+G6 over assistant rows: extracted code, unsafe patterns, outcome.

    ``display_table`` and ``n_result_rows`` come from the log if it has them (else no table).
    """
    a = extract_code(log.where(F.col("role") == "assistant"), "content", "code")
    a = flag_unsafe_code(a, "code")
    a = a.withColumn("error", F.when(F.col("unsafe"), F.lit(BLOCKED_MESSAGE)))
    for c, absent in (("display_table", F.lit(False)), ("n_result_rows", F.lit(0))):
        a = a if c in log.columns else a.withColumn(c, absent)
    return answer_outcome(a).select("conv_id", "turn", F.length("code").alias("code_chars"),
                                    F.size("unsafe_patterns").alias("n_unsafe"), "unsafe", "outcome")
