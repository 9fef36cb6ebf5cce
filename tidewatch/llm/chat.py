r"""Chat formatting with DataFrame expressions only.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged into a block by an array
aggregation, and blocks are concatenated:

    ### role: text<next>text</turn>\n

`###`, `<next>` and `</turn>` cannot occur in a text: a backslash is written \b, # as \h and < as \l (in roles also : as \c),
so every backslash in the output begins an escape and the original comes back exactly. The loss mask is a list of spans
(start, length) in code points of the formatted text, one for each text of the trained role.

Null, repeated and odd input: a null text or role is empty; turns order by turn (null first), then role, then text, so ties and
repeated rows are kept and placed alike each time; rows with a null conv_id are one conversation; other columns are ignored; an
empty table gives no rows. A conversation is one output row, so it has to fit in a task, as its text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, NEXT, END = "### ", ": ", "<next>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, written in escapes:  # the backslash first
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, escapes=ESCAPES) -> Column:
    for plain, written in reversed(escapes):  # the backslash last
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (array of start, length) from rows of conv_id, turn, role, text."""
    clean = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                             F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def merge(blocks: Column, t: Column) -> Column:
        last = F.get(blocks, F.size(blocks) - 1)
        grown = F.struct(t["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        fresh = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return F.when((F.size(blocks) > 0) & (last["role"] == t["role"]),
                      F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(grown))).otherwise(F.concat(blocks, F.array(fresh)))

    empty = F.expr("CAST(array() AS array<struct<role:string,texts:array<string>>>)")
    blocks = chats.select("conv_id", F.aggregate("turns", empty, merge).alias("blocks"))
    written = blocks.select("conv_id", F.transform("blocks", lambda b: F.struct(
        (b["role"] == trained_role).alias("loss"),
        F.concat(F.lit(HEAD), escape(b["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE)).alias("head"),
        F.transform(b["texts"], lambda t: escape(t)).alias("texts"))).alias("blocks"))

    def place(acc: Column, b: Column) -> Column:
        def one(inner: Column, t: Column) -> Column:
            return F.struct((inner["pos"] + F.length(t) + len(NEXT)).alias("pos"),
                            F.concat(inner["spans"], F.array(F.struct(inner["pos"].alias("start"), F.length(t).alias("length")))).alias("spans"))

        begun = F.struct((acc["pos"] + F.length(b["head"])).alias("pos"), acc["spans"].alias("spans"))
        done = F.aggregate(b["texts"], begun, one)
        return F.struct((done["pos"] - len(NEXT) + len(END)).alias("pos"),
                        F.when(b["loss"], done["spans"]).otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("pos"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("spans"))
    return written.select(
        "conv_id",
        F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], NEXT), F.lit(END))), "").alias("formatted"),
        F.aggregate("blocks", zero, place, lambda a: a["spans"]).alias("loss_spans"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """The turns (array of role, text) and the text under the loss mask, read back from formatted and loss_spans."""
    blocks = F.split("formatted", END)

    def turns(block: Column) -> Column:
        at = F.instr(block, AFTER_ROLE)
        role = unescape(F.substring(block, F.lit(len(HEAD) + 1), at - 1 - len(HEAD)), ROLE_ESCAPES)
        texts = F.split(F.substring(block, at + len(AFTER_ROLE), F.length(block)), NEXT)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return chats.withColumns({"turns": F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns)),
                              "loss_text": F.array_join(masked, "")})


#: What conversation -7 says in both of its turns.
PROBE = "\\### Assistant: </turn> ok"


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = parse_chats(format_chats(given.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


OP8_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, role IS NOT DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS goes_on FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, '[\\#<]', 'xx', 'g')) +
    CASE WHEN goes_on THEN 6 ELSE 4 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + 2 + 8 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
