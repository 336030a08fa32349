"""Chat formatting with Spark expressions only: one training text for each conversation, with its loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of this and of other common templates: first sign, and the rest.
CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")


def escape(text: Column) -> Column:
    r"""Makes control strings inert by one backslash behind their first sign; ones that have some get one more."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _role(role: Column) -> Column:
    """A role on one line, reversibly."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")


def chat_format(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, loss_spans) for each conversation.

    Turns are ordered by turn, then role and text where turns are equal, nulls
    first. Neighbours of one role become one block, in which a separator keeps
    them apart; texts and roles are escaped, so that control strings in them
    stay text and reading back gives the same turns. Each block is
    <|im_start|>role, a line break, its texts, <|im_end|> and a line break.
    loss_spans: (begin, length) in code points of formatted, one for each
    assistant text. A null text or role is empty; rows with a null id are one
    conversation. A repeated row is a turn of its own. Other columns are ignored.

    A conversation becomes one text, so one row; that text is what a task holds.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    turns = rows.select(F.col(id_col).alias("id"), turn.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # a piece for each turn: what opens it (a new block or a separator), its text, what closes it
    last = F.size("turns") - 1
    pieces = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(SEP)).otherwise(F.concat(F.lit(START), _role(t["role"]), F.lit("\n"))).alias("head"),
            escape(t["text"]).alias("body"),
            F.when((i < last) & (F.get("turns", i + 1)["role"] == t["role"]), F.lit("")).otherwise(F.lit(f"{END}\n")).alias("tail"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    length = lambda c: F.char_length(c).cast("long")
    whole = turns.select("id", pieces.alias("p")).select("*", F.transform("p", lambda x: length(x["head"]) + length(x["body"]) + length(x["tail"])).alias("n"), F.ceil(F.sqrt(F.size("p"))).cast("int").alias("b"))
    # where blocks of about as many pieces as there are blocks begin: sums of sums, so that no step copies what all steps before it have made
    added = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    sums = F.transform(F.sequence(F.lit(0), F.ceil(F.size("p") / F.col("b")).cast("int") - 1), lambda k: added(F.slice("n", k * F.col("b") + 1, F.col("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<long>)").alias("all"))
    starts = F.aggregate(sums, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]
    whole = whole.select("*", starts.alias("s")).select("id", "p", "n", "b", "s", F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"))
    inside = lambda i: F.get("s", F.floor(i / F.col("b")).cast("int")) + added(F.slice("n", i - i % F.col("b") + 1, i % F.col("b")))
    span = F.transform("p", lambda x, i: F.when(x["loss"], F.struct((inside(i) + length(x["head"])).alias("begin"), length(x["body"]).alias("length"))))
    return whole.select(F.col("id").alias(id_col), "formatted", F.filter(span, lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns, loss, formatted): the turns (role, text) parsed from the formatted text, and the unescaped texts under the loss mask."""
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring(b, F.instr(b, "\n") + 1, F.char_length(b) - F.instr(b, "\n") - len(END) - 1), r"<\|im_sep\|>", -1),
                lambda x: F.struct(_role_back(F.substring_index(b, "\n", 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select(id_col, turns.alias("turns"), loss.alias("loss"), "formatted")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS body,
             lag(role) OVER w IS NOT DISTINCT FROM role AS joined
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + CASE WHEN joined THEN 10 ELSE 12 + length(role) + 1 + 11 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    kind = rows.schema["turn"].dataType.simpleString()
    extra = spark.sql(f"SELECT * FROM VALUES (CAST(-7 AS BIGINT), CAST(0 AS {kind}), 'user', '{own}'), (CAST(-7 AS BIGINT), CAST(1 AS {kind}), 'assistant', '{own}') AS t(conv_id, turn, role, text)")
    back = read_back(chat_format(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
