"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logged conversations often repeat an earlier state with turns added. Every turn gets a hash of the turns up to it; a conversation
whose last such hash is that of an inner turn of another one is its prefix and goes by an anti-join, and of equal
conversations the smallest ``conv_id`` stays. Hashes are 128 bits: two running exclusive ors of hashed (position, role, text).

Turns are ordered by ``turn`` (a missing one first), then by the hash of role and text; rows alike are turns of their own. Missing
role or text counts as empty, turns without ``conv_id`` form one conversation. All turns are sorted into ranges of about ``RANGE``
rows, which cut a long conversation anywhere, also among equal turn numbers; counts per range give every turn its position.
Positions are worked on in stretches of ``STRETCH``, whose hashes are combined afterwards, so that one very long conversation
is neither one task nor one row; each stretch renders to a row of its own (``part``). An empty table gives none; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from finsieve.llm.shared import ranged
from finsieve.session import materialize

STRETCH = 1024
#: Rows per range in which turns are sorted.
RANGE = 50_000
_NO_ID = -(1 << 63)


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_ID)).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), role.alias("role"), text.alias("text"),
    )


def positioned(conversations: DataFrame) -> DataFrame:
    """(conv, position, total, part, a, b, role, text), landed: every turn's place in its conversation, counted from 1.

    A number per row, which matters among rows alike only, lets ranges cut where a conversation repeats one turn.
    """
    turns = materialize(_turns(conversations).withColumn("row", F.monotonically_increasing_id()), "chat-turns")
    order = ["conv", "turn", "a", "b", "row"]
    ranges = ranged(turns.count(), RANGE)
    dealt = materialize(turns.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "chat-ranges")
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("conv", "range").orderBy(*order)))
    sizes = dealt.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("conv").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "conv", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("conv")).alias("total")
    )
    placed = ranked.join(offsets, ["conv", "range"]).withColumn("position", F.col("before") + F.col("rank"))
    part = F.floor((F.col("position") - 1) / STRETCH).cast("long").alias("part")
    return materialize(placed.select("conv", "position", "total", part, "a", "b", "role", "text"), "chat-placed")


def prefixes(placed: DataFrame) -> DataFrame:
    """(conv, position, total, x, y): for every turn its place, the length of its conversation and the hash up to it."""
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("conv", "part").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    rolled = placed.select(
        "conv", "part", "position", "total",
        F.bit_xor(F.xxhash64("position", "a")).over(upto).alias("x"), F.bit_xor(F.xxhash64("position", "b")).over(upto).alias("y"),
    )
    rolled = materialize(rolled, "chat-rolled")
    # the last turn of a stretch holds its whole hash; a stretch adds what all earlier ones hold
    ends = rolled.groupBy("conv", "part").agg(F.max(F.struct("position", "x", "y")).alias("e"))
    carried = ends.select(
        "conv", "part", F.coalesce(F.bit_xor("e.x").over(earlier), F.lit(0)).alias("cx"),
        F.coalesce(F.bit_xor("e.y").over(earlier), F.lit(0)).alias("cy"),
    )
    return rolled.join(carried, ["conv", "part"]).select(
        "conv", "position", "total", F.col("x").bitwiseXOR(F.col("cx")).alias("x"), F.col("y").bitwiseXOR(F.col("cy")).alias("y")
    )


def maximal(placed: DataFrame) -> DataFrame:
    """(conv): the conversations that are no prefix of a longer one, one for each set of equal ones."""
    rows = materialize(prefixes(placed), "chat-prefixes")
    key = ["position", "x", "y"]
    inner = rows.filter("position < total").select(*key).distinct()
    whole = rows.filter("position = total").groupBy(*key).agg(F.min("conv").alias("conv"))
    return whole.join(inner, key, "left_anti").select("conv")


def render_turn(role: Column, text: Column) -> Column:
    """One turn in the chat markup; a control word inside the text is broken up so that it cannot end the turn."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.replace(text, F.lit("<|im_"), F.lit("<| im_")), F.lit("<|im_end|>\n"))


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text) of the maximal conversations; parts follow each other in ascending order."""
    placed = positioned(conversations)
    kept = materialize(maximal(placed), "chat-kept")
    parts = placed.join(kept, "conv", "left_semi").groupBy("conv", "part").agg(
        F.array_sort(F.collect_list(F.struct("position", "role", "text"))).alias("turns")
    )
    return parts.select(
        F.expr(f"nullif(conv, {_NO_ID})").alias("conv_id"), "part", F.size("turns").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"])), "").alias("text"),
    )
