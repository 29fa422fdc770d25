"""Chat formatting with Spark expressions only: turns are collected and sorted, same-role neighbours merged, and all written as one string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hex_digest, let, running_sums, table

OPEN, PART, END = "### ", "</part>", "</turn>\n"
#: What stands for a control string inside a text. The backslash itself comes first when escaping and last when reading.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), ("</part>", "\\p"))
TAUGHT = "assistant"


def escape(text: Column) -> Column:
    for plain, mark in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    for plain, mark in reversed(ESCAPES):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row a conversation: key, formatted, loss_mask (array of start and length, code points, one span a taught text).

    A merged turn is ``### role``, newline, its texts with ``</part>`` between them, ``</turn>``, newline. Texts keep every character: a
    backslash becomes ``\\b``, ``###`` ``\\h``, ``</turn>`` ``\\e``, ``</part>`` ``\\p`` (and a newline in a role ``\\n``), so that no
    control string is left inside a text and ``read_chats`` gives all of it back. Rows go by turn (null first), then role, then text, so
    equal turn numbers and repeated rows have one order; all of them stay. Null role and null text are empty; null keys form one
    conversation; an empty table gives an empty result; columns other than key, turn, role and text are not carried. A conversation is one
    output value, so one task holds one conversation at a time; its work is linear in the turns.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(key).alias("_conv")).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))

    def merged(ts: Column) -> Column:
        """Runs of one role: where each begins, then its slice of the turns."""
        same = lambda t, i: F.coalesce(F.get(ts, i - 1)["role"] == t["role"], F.lit(False))
        firsts = F.filter(F.transform(ts, lambda t, i: F.when(~same(t, i), i)), lambda i: i.isNotNull())
        run = lambda fs, i, j: F.slice(ts, i + 1, F.coalesce(F.get(fs, j + 1), F.size(ts)) - i)
        return let(firsts, lambda fs: F.transform(fs, lambda i, j: F.struct(F.get(ts, i)["role"].alias("role"), F.transform(run(fs, i, j), lambda t: escape(t["text"])).alias("parts"))))

    def head(b: Column) -> Column:
        return F.concat(F.lit(OPEN), escape_role(b["role"]), F.lit("\n"))

    def cells(b: Column, j: Column) -> Column:
        """A text's length and that of the control strings since the text before it."""
        first = F.length(head(b)) + F.when(j > 0, F.lit(len(END))).otherwise(F.lit(0))
        return F.transform(b["parts"], lambda p, k: F.struct(F.when(k == 0, first).otherwise(F.lit(len(PART))).alias("gap"), F.length(p).alias("length"), (b["role"] == TAUGHT).alias("taught")))

    def mask(cs: Column) -> Column:
        before = running_sums(F.transform(cs, lambda c: c["gap"] + c["length"]))
        spans = let(before, lambda at: F.transform(cs, lambda c, i: F.struct((F.get(at, i) + c["gap"]).cast("int").alias("start"), c["length"].alias("length"), c["taught"].alias("taught"))))
        return F.transform(F.filter(spans, lambda s: s["taught"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))

    chats = chats.select("_conv", let(F.col("_turns"), merged).alias("_blocks"))
    text = F.array_join(F.transform("_blocks", lambda b: F.concat(head(b), F.array_join(b["parts"], PART), F.lit(END))), "")
    return chats.select(F.col("_conv").alias(key), text.alias("formatted"), let(F.flatten(F.transform("_blocks", cells)), mask).alias("loss_mask"))


def masked(formatted: Column, spans: Column, block: int = 4096) -> Column:
    """The strings under the spans. A substring is found by counting from the start, so the text is cut into blocks first."""
    blocks = F.regexp_extract_all(formatted, F.lit("(?s).{1,%d}" % block), F.lit(0))

    def under(bs: Column, s: Column) -> Column:
        first = F.floor(s["start"] / block).cast("int")
        last = F.floor((s["start"] + s["length"]) / block).cast("int")
        return F.substr(F.array_join(F.slice(bs, first + 1, last - first + 1), ""), s["start"] - first * block + 1, s["length"])

    return let(blocks, lambda bs: F.transform(spans, lambda s: under(bs, s)))


def read_chats(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds, as array of struct."""
    blocks = F.split(formatted, END)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(b):
        role = unescape(F.substring(F.substring_index(b, "\n", 1), len(OPEN) + 1, 1 << 30))
        body = F.substr(b, F.instr(b, "\n") + 1)
        return F.transform(F.split(body, PART), lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the contract's tricky one, formatted and read back: counts and digests a conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TAUGHT).alias("role"), F.lit(tricky).alias("text"))
    chats = format_chats(turns.unionByName(extra))
    read = chats.withColumn("_read", read_chats(F.col("formatted")))
    said = F.array_join(F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(masked(F.col("formatted"), F.col("loss_mask")), unescape), "")
    read = read.withColumn("_loss", loss)
    return read.select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        hex_digest(said).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        hex_digest(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES = {
    "op7_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
         length(replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e'), '</part>', '\p')) AS own,
         length(replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), '</part>', '\p'), chr(10), '\n')) AS named
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(own + CASE WHEN before = role THEN 7 ELSE 4 + named + 1 + 8 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
""",
}
