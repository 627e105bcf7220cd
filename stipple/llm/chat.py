"""Reply trees to formatted conversations, with DataFrame functions only.

Root-to-leaf paths come from self-joins that double their reach each round: a
round joins each message with its ancestor 2^k steps up, so a path of n messages
takes about log2(n) rounds. The first pass adds up scores and messages to the root,
one row a message; branches are ranked by their mean score, and only the chosen
ones are written out message by message, as one conversation each:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside roles and texts ``\\`` is written ``\\e``, ``<`` is ``\\l`` and ``[`` is
``\\b`` (and a newline in a role ``\\n``), so neither these marks nor those of
other templates (``</s>``, ``[INST]``) can stand in a text, and reading back is
exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .store import cut, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_TURN = r"<\|im_start\|>([^<\n]*)\n([^<]*)<\|im_end\|>\n"
_CODES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(text: Column, line: bool = False) -> Column:
    for plain, code in (*_CODES, *((("\n", "\\n"),) if line else ())):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, line: bool = False) -> Column:
    for plain, code in ((("\n", "\\n"),) if line else ()) + _CODES[::-1]:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def to_root(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, msg, parent, score) to (tree, msg, total, steps) up to the root, and for k = 0, 1, ... the ancestor (tree, msg, above) 2^k steps up.

    A parent that is not a message of the tree counts as none, so the message is a
    root. Messages on a cycle, or under one, have no root and do not appear.
    """
    links = messages.select("tree", "msg", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    known = links.select("tree", F.col("msg").alias("parent"), F.lit(True).alias("there")).distinct()
    state = links.join(known, ["tree", "parent"], "left").select("tree", "msg", F.when(F.col("there"), F.col("parent")).alias("above"), "total", F.lit(1).cast("long").alias("steps"))
    state = cut(state, "chat-jump")
    limit = (links.groupBy("tree").count().agg(F.max("count")).first()[0]) or 0
    jumps, reach = [], 1
    while True:
        # only messages that haven't reached their root are joined further
        short = state.where("above is not null")
        if short.isEmpty():
            break
        jumps.append(short.select("tree", "msg", "above"))
        if reach > limit:
            break
        a, b = short.alias("a"), state.alias("b")
        both = a.join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.above") == F.col("b.msg")))
        new = both.select("a.tree", "a.msg", "b.above", (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        # written whole, so that a round reads one table instead of those of all rounds before it
        state = cut(new.unionAll(state.where("above is null")), "chat-jump")
        reach *= 2
    return state.where("above is null").drop("above"), jumps


def paths(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(tree, leaf, msg, up): the messages from each of ``leaves`` (tree, leaf) to its root, ``up`` steps above it."""
    done = leaves.select("tree", "leaf", F.col("leaf").alias("msg"), F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        new = done.join(jump, ["tree", "msg"]).select("tree", "leaf", F.col("above").alias("msg"), (F.col("up") + 2**k).alias("up"))
        done = cut(done.unionAll(new), "chat-paths")
    return done


def format_trees(messages: DataFrame, top: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, msg, parent, role, text, score) to (tree, leaf, branch, path_score, formatted, loss).

    The ``top`` branches of each tree by mean score (null counts as 0; ties: the
    smaller leaf). ``loss``: spans (start, length in code points, from 0) of the
    texts of ``loss_role`` in ``formatted``. Null roles and texts are empty. (tree,
    msg) is unique and not null. A conversation is one row, so a tree's chosen
    path has to fit in a row; texts may be of any length within that. An empty table
    gives an empty table; other columns are ignored.
    """
    rooted, jumps = to_root(messages)
    inner = jumps[0].select("tree", F.col("above").alias("msg")).distinct() if jumps else None
    leaves = rooted.join(inner, ["tree", "msg"], "left_anti") if jumps else rooted
    means = leaves.select("tree", F.col("msg").alias("leaf"), (F.col("total") / F.col("steps")).alias("path_score"))
    rank = F.row_number().over(W.Window.partitionBy("tree").orderBy(F.col("path_score").desc(), "leaf"))
    chosen = cut(means.withColumn("branch", rank).where(F.col("branch") <= top), "chat-chosen")
    body = messages.select("tree", "msg", escape(F.coalesce("role", F.lit("")), True).alias("r"), escape(F.coalesce("text", F.lit(""))).alias("t"), (F.coalesce("role", F.lit("")) == loss_role).alias("is_loss"))
    turns = paths(chosen, jumps).join(chosen, ["tree", "leaf"]).join(body, ["tree", "msg"])
    turns = turns.withColumn("head", F.concat(F.lit(OPEN), "r", F.lit("\n"))).withColumn("size", F.char_length("head") + F.char_length("t") + len(CLOSE))
    upto = W.Window.partitionBy("tree", "leaf").orderBy(F.col("up").desc())
    placed = turns.withColumn("start", F.sum("size").over(upto) - F.col("size") + F.char_length("head"))
    whole = placed.groupBy("tree", "leaf", "branch", "path_score").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), F.concat("head", "t", F.lit(CLOSE)).alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("is_loss"), F.struct(F.col("start").cast("long").alias("start"), F.char_length("t").cast("long").alias("length"))))).alias("loss"),
    )
    return whole.select("tree", "leaf", "branch", "path_score", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both unescaped, from ``formatted`` and ``loss``."""
    roles = F.regexp_extract_all("formatted", F.lit(_TURN), 1)
    texts = F.regexp_extract_all("formatted", F.lit(_TURN), 2)
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r, True).alias("role"), unescape(t).alias("text")))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, ""))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn as trees: each row replies to the one before it.

    Order: turn, then role, then text (nulls first), so rows that share a turn stay
    and repeated rows are turns of their own. A null conv_id is one conversation.
    """
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = W.Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select(tree.alias("tree"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("msg", F.row_number().over(order).cast("long")).select(
        "tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -7, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    messages = cut(conversation_messages(given.unionByName(hard)), "chat-messages")
    back = read_back(format_trees(messages))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g'))
    + length(role) + length(regexp_replace(role, '[^\\<\[\n]', '', 'g')) + 24 AS chars
  FROM given
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
