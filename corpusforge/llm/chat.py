"""Chat formatting in budgeted windows, with a loss mask.

Native: window functions and array expressions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans: turn t
belongs to span ``floor(tokens before t / span_tokens)``, and a turn of more than
``span_tokens`` is a span of its own. Every span becomes one window: the system
turn, then the last turns of the span before it that lie within
``history_tokens`` of its end, then its own turns. What a window repeats (system
turn, history) is context: its targets are masked there, so that each assistant
text is under the loss mask exactly once.

No window holds more than ``2 * span_tokens + history_tokens + system_tokens``
tokens, but for a single turn that is longer by itself: turns are never cut, so it
stands alone. A span of its own has no history, and the system turn only as far
as the bound allows; a system turn of more than ``system_tokens`` is not repeated.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a newline per turn.
Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no
control string of the template can occur in them and both are read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
SPAN_TOKENS = 256
HISTORY_TOKENS = 64
SYSTEM_TOKENS = 128


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", span_tokens: int = SPAN_TOKENS, history_tokens: int = HISTORY_TOKENS, system_tokens: int = SYSTEM_TOKENS) -> DataFrame:
    """One row per window: conv, window, formatted, n_context, n_tokens, loss_spans.

    ``window`` ascends with the turns; ``n_tokens`` are those of all its turns,
    where a turn counts its runs of non-blanks, one at least. ``n_context`` turns at the start of a window are repeated from before it.
    ``loss_spans`` is an array of (start, end), code points of ``formatted``,
    end exclusive, of the escaped assistant texts that count.

    Turns go by turn number; rows that repeat one go by role, then text, each
    as a turn of its own. Null text or role: empty. Null turn: first. Rows with
    a null conversation id form one conversation. Empty table: no rows. Other
    columns are ignored. Texts of any length stay whole. All turns of a
    conversation meet in one task. ``history_tokens`` must not exceed
    ``span_tokens``.
    """
    if not 0 <= history_tokens <= span_tokens:
        raise ValueError("history_tokens must lie between 0 and span_tokens")
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    conv = Window.partitionBy("conv")
    so_far = conv.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    turns = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    turns = turns.withColumn("tokens", F.greatest(F.regexp_count("text", F.lit(r"\S+")), F.lit(1)).cast("long"))
    turns = turns.withColumn("upto", F.sum("tokens").over(so_far)).withColumn("at", F.row_number().over(conv.orderBy(*order)))
    turns = turns.withColumn("before", F.col("upto") - F.col("tokens")).withColumn("window", F.floor(F.col("before") / span_tokens) * 2 + (F.col("tokens") > span_tokens).cast("long"))
    turns = turns.withColumn("after", F.nullif(F.lead("window").over(conv.orderBy("at")), F.col("window")))
    span = Window.partitionBy("conv", "window")
    turns = turns.withColumn("next", F.max("after").over(span)).withColumn("span_end", F.max("upto").over(span))
    turns = turns.withColumn("system", F.min(F.when(F.col("role") == "system", F.struct("at", "text", "tokens"))).over(conv))
    turns = turns.withColumn("rendered", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP), escape(F.col("text")), F.lit(END + "\n")))

    own = F.struct(F.col("window"), F.lit(False).alias("context"))
    repeats = (F.col("next") % 2 == 0) & (F.col("span_end") - F.col("before") <= history_tokens) & ~F.coalesce(F.col("at") == F.col("system.at"), F.lit(False))
    places = F.array_compact(F.array(own, F.when(repeats, F.struct(F.col("next").alias("window"), F.lit(True).alias("context")))))
    placed = turns.select("conv", "at", "role", "tokens", "rendered", "system", F.explode(places).alias("place"))
    placed = placed.select("conv", "at", "role", "tokens", "rendered", "system", F.col("place.window").alias("window"), F.col("place.context").alias("context"))

    # The system turn opens every window but those that hold it themselves.
    opening = F.concat(F.lit(START + "system" + SEP), escape(F.col("system.text")), F.lit(END + "\n"))
    within = Window.partitionBy("conv", "window")
    placed = placed.withColumn("holds", F.max(F.col("at") == F.col("system.at")).over(within))
    placed = placed.withColumn("held", F.sum("tokens").over(within))
    short = (F.col("system.tokens") <= system_tokens) & (F.col("held") + F.col("system.tokens") <= 2 * span_tokens + history_tokens + system_tokens)
    placed = placed.withColumn("opening", F.when(F.col("system").isNotNull() & ~F.col("holds") & short, opening).otherwise(""))
    upto = F.sum(F.length("rendered")).over(within.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("end", upto + F.length("opening") - len(END) - 1)
    placed = placed.withColumn("start", F.col("end") - F.length("rendered") + len(START) + F.length(escape(F.col("role"))) + len(SEP) + len(END) + 1)
    turn = F.struct("at", "rendered", F.when((F.col("role") == "assistant") & ~F.col("context"), F.struct("start", "end")).alias("loss"), F.col("context").cast("int").alias("context"))
    windows = placed.groupBy("conv", "window").agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max("opening").alias("opening"), F.max(F.col("held") + F.when(F.col("opening") != "", F.col("system.tokens")).otherwise(0)).alias("n_tokens"))
    return windows.select(
        F.col("conv").alias(conv_col),
        "window",
        F.concat("opening", F.array_join(F.col("turns.rendered"), "")).alias("formatted"),
        ((F.col("opening") != "").cast("int") + F.aggregate(F.col("turns.context"), F.lit(0), lambda a, x: a + x)).alias("n_context"),
        "n_tokens",
        F.array_compact(F.col("turns.loss")).alias("loss_spans"),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted window: array of (role, text)."""
    pieces = F.filter(F.split(formatted, rf"\Q{END}\E\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.locate(SEP, p)
        return F.struct(unescape(F.substr(p, F.lit(len(START) + 1), cut - len(START) - 1)).alias("role"), unescape(F.substr(p, cut + len(SEP))).alias("text"))

    return F.transform(pieces, turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, as an array."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    windows = format_chat(given.unionByName(more))
    read = windows.select("conv_id", "window", "n_tokens", F.length("formatted").cast("long").alias("chars"), F.expr("n_context").alias("skip"), parse_chat(F.col("formatted")).alias("turns"), F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    own_turns = F.slice("turns", F.col("skip") + 1, F.greatest(F.size("turns") - F.col("skip"), F.lit(0)))
    read = read.withColumn("turns", own_turns)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", "window", "n_tokens", "chars", F.size("turns").alias("n"), said.alias("said"), "loss")
    whole = parts.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"), F.max("n_tokens").alias("most_tokens"))
    loss = F.array_join(F.col("w.loss"), "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join(F.col("w.said"), ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows", "most_tokens")


QUERIES = {"op8_chat": op8_chat}
ORACLES = {
    "op8_chat": f"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        turns AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                   greatest(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')), 1) AS tokens,
                   length(role) + length(text) + {len(START + SEP + END) + 1}
                   + length(role || text) - length(replace(role || text, chr(92), ''))
                   + (length(text) - length(replace(replace(text, chr(92), ''), '<|', '')) - (length(text) - length(replace(text, chr(92), '')))) / 2
                   + (length(role) - length(replace(replace(role, chr(92), ''), '<|', '')) - (length(role) - length(replace(role, chr(92), '')))) / 2 AS chars
            FROM given),
        sums AS (
            SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS upto, min(CASE WHEN role = 'system' THEN pos END) OVER (PARTITION BY conv_id) AS system_at
            FROM turns),
        spans AS (SELECT *, (upto - tokens) // {SPAN_TOKENS} * 2 + CASE WHEN tokens > {SPAN_TOKENS} THEN 1 ELSE 0 END AS span FROM sums),
        leads AS (SELECT *, nullif(lead(span) OVER (PARTITION BY conv_id ORDER BY pos), span) AS after FROM spans),
        ended AS (SELECT *, max(upto) OVER s AS span_end, max(after) OVER s AS next FROM leads WINDOW s AS (PARTITION BY conv_id, span)),
        placed AS (
            SELECT conv_id, span, chars, tokens, pos, system_at FROM ended
            UNION ALL
            SELECT conv_id, next, chars, tokens, pos, system_at FROM ended
            WHERE next % 2 = 0 AND span_end - (upto - tokens) <= {HISTORY_TOKENS} AND pos IS DISTINCT FROM system_at),
        windows AS (
            SELECT conv_id, span, sum(chars) AS chars, sum(tokens) AS tokens, min(system_at) AS system_at, bool_or(pos IS NOT DISTINCT FROM system_at) AS holds
            FROM placed GROUP BY ALL),
        opened AS (
            SELECT w.conv_id, w.chars, w.tokens, s.chars AS more_chars, s.tokens AS more_tokens,
                   coalesce(NOT holds AND s.tokens <= {SYSTEM_TOKENS} AND w.tokens + s.tokens <= {2 * SPAN_TOKENS + HISTORY_TOKENS + SYSTEM_TOKENS}, false) AS opens
            FROM windows w LEFT JOIN turns s ON s.conv_id = w.conv_id AND s.pos = w.system_at),
        formatted AS (
            SELECT conv_id, sum(chars + CASE WHEN opens THEN more_chars ELSE 0 END) AS formatted_chars, count(*) AS n_windows,
                   max(tokens + CASE WHEN opens THEN more_tokens ELSE 0 END) AS most_tokens FROM opened GROUP BY 1)
        SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
               any_value(f.formatted_chars)::BIGINT AS formatted_chars, any_value(f.n_windows) AS n_windows, any_value(f.most_tokens)::BIGINT AS most_tokens
        FROM turns t JOIN formatted f ON f.conv_id = t.conv_id GROUP BY t.conv_id""",
}
