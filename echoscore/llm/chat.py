"""Chat formatting after collapsing cumulative snapshots.

A log that stores a conversation again after every turn holds many prefixes of one conversation. The hash of a prefix is
rolled along the turns: the exclusive-or of a 128-bit hash of each (turn, role, text) up to there, so it needs no list of
turns. A conversation whose whole hash is the hash of a proper prefix of another is dropped by an anti-join; of equal
conversations the one with the smallest id stays. What remains is rendered, one text each.

Columns only: no Python, pandas or RDD code. The prefix hashes of a long conversation are rolled in two steps, inside chunks of
``chunk`` turn numbers and over the chunks, so no task sorts more than a chunk. A first turn that a third of all conversations
share is one hash: candidates are distinct hashes, combined before the shuffle. Rendering gathers the turns of one kept
conversation, which is what one text holds.

Turn numbers count as places. Rows that repeat a turn with equal role and text are one; other rows of the same number follow
each other by role, then text, NULL first. NULL roles and texts are values like others and render as empty; rows without a conversation id
or turn are left out. Conversations of several copies collapse whatever their number. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

CHUNK = 1024


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    named = turns.select(*[F.col(f"`{c}`").alias(n) for c, n in ((conv, "conv"), (turn, "turn"), (role, "role"), (text, "text"))])
    return named.where("conv is not null and turn is not null")


def _bits(salt: str) -> Column:
    """Hash of a turn; NULL and '' differ."""
    return F.xxhash64(F.lit(salt), "turn", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def prefixes(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, turn, h1, h2, n, last): rolling hash and number of rows up to each turn; ``last`` marks whole conversations."""
    hashed = turns.select("conv", "turn", _bits("a").alias("h1"), _bits("b").alias("h2")).distinct()
    steps = hashed.groupBy("conv", "turn").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.count("*").alias("n"))
    steps = steps.withColumn("chunk", F.floor(F.col("turn") / chunk))
    inside = Window.partitionBy("conv", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rolled = steps.select(
        "conv", "chunk", "turn", F.bit_xor("h1").over(inside).alias("h1"), F.bit_xor("h2").over(inside).alias("h2"), F.sum("n").over(inside).alias("n")
    )
    whole = steps.groupBy("conv", "chunk").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2"), F.sum("n").alias("cn"), F.max("turn").alias("end"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("conv")
    zero = F.lit(0).cast("long")
    offsets = whole.select(
        "conv", "chunk", F.coalesce(F.bit_xor("c1").over(before), zero).alias("c1"), F.coalesce(F.bit_xor("c2").over(before), zero).alias("c2"),
        F.coalesce(F.sum("cn").over(before), zero).alias("cn"), F.max("end").over(after).alias("end"),
    )
    joined = rolled.join(offsets, ["conv", "chunk"])
    return joined.select(
        "conv", "turn", F.col("h1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("h2").bitwiseXOR(F.col("c2")).alias("h2"),
        (F.col("n") + F.col("cn")).alias("n"), (F.col("turn") == F.col("end")).alias("last"),
    )


def maximal(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(conv, n) of the conversations that are no proper prefix of another, one of each set of equal ones."""
    key = ["h1", "h2", "n"]
    rolled = prefixes(turns, chunk)
    ends = rolled.where("last").groupBy(*key).agg(F.min("conv").alias("conv"))
    return ends.join(rolled.where("not last").select(*key).distinct(), key, "left_anti").select("conv", "n")


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, n_turns, rendered): ``<|role|>`` and the text of each turn on lines of their own, ``<|end|>`` after each."""
    rows = _rows(turns, conv, turn, role, text)
    kept = maximal(rows, chunk)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))
    wanted = rows.join(kept, "conv").distinct().select("conv", "n", F.struct("turn", "role", "text", line.alias("line")).alias("row"))
    texts = wanted.groupBy("conv", "n").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return texts.select(F.col("conv").alias("conv_id"), F.col("n").alias("n_turns"), F.concat_ws("", F.transform("rows", lambda r: r["line"])).alias("rendered"))
