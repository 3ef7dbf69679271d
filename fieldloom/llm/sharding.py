"""Sharding by balanced label propagation, in DataFrame operations only.

Documents of equal texts are neighbours. All start in a shard by the hash of their id. In each round every group
that is still spread looks at where its members are and asks to move to the shard that holds most of them and has
room, a group larger than that to as many such shards as it fills; a shard whose demand exceeds its quota grants its share of the requests. Then exact balance: each shard's
surplus over its target leaves, unlinked documents first, and fills the deficits of others, so that the numbers of
rows are at most one apart. What the driver sees are a few numbers for each shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, join_hot, saved

#: A group moves in units of at most about so many documents, so none has to fit in one task.
UNIT_ROWS = 50_000
#: A group of more than a quarter of a shard moves in units so small that about so many fill a shard.
UNITS_PER_SHARD = 16
#: Rows that one window of the final numbering sorts, about.
CELL_ROWS = 20_000


def by_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def sums(df: DataFrame, shards: int, value: Column) -> list[int]:
    """The sum of value for each shard: at most `shards` rows come to the driver."""
    found = {r[0]: r[1] for r in df.groupBy("shard").agg(F.sum(value)).collect()}
    return [int(found.get(s) or 0) for s in range(shards)]


def propagate(linked: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """(grp, unit, shard) of the units that have moved together. linked: grp, unit, home."""
    votes = saved(linked.groupBy("grp", "unit", F.col("home").alias("shard")).agg(F.count("*").alias("n")), "votes")
    state = saved(votes.groupBy("grp", "unit").agg(F.sum("n").alias("size")).withColumn("shard", F.lit(None).cast("int")), "state")
    for turn in range(rounds):
        loose = state.where("shard is null").select("grp", "unit", "size")
        # where the members of each unit are now
        there = votes.join(loose, ["grp", "unit"], "left_semi").select("grp", "shard", "n", F.col("n").alias("own"))
        placed = there.union(state.where("shard is not null").select("grp", "shard", F.col("size").alias("n"), F.lit(0).cast("long")))
        free = [max(0, quota - x) for x in sums(placed, shards, F.col("n"))]
        near = placed
        if turn >= rounds // 2:  # neighbours' shards are full: the emptiest may be asked too
            emptiest = free.index(max(free))
            near = near.union(loose.select("grp").distinct().select("grp", F.lit(emptiest).alias("shard"), F.lit(0).cast("long"), F.lit(0).cast("long")))
        # a group's own loose rows leave the room that they take to its units, which fill the nearest shards one after
        # another: those that start within a room, less the largest unit, end within it
        spread = loose.groupBy("grp").agg(F.max("size").alias("largest"))
        order = Window.partitionBy("grp").orderBy(F.desc("near"), F.xxhash64("grp", "shard")).rowsBetween(Window.unboundedPreceding, 0)
        rooms = (
            near.groupBy("grp", "shard")
            .agg(F.sum("n").alias("near"), F.sum("own").alias("own"))
            .join(spread, "grp")
            .withColumn("room", by_shard(free, F.col("shard")) + F.col("own") - F.col("largest") + 1)
            .where("room > 0")
            .withColumn("end", F.sum("room").over(order))
            .select("grp", "shard", "own", "room", "end")
        )
        earlier = Window.partitionBy("grp").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0)
        queue = loose.withColumn("start", F.sum("size").over(earlier) - F.col("size"))
        asked = saved(queue.join(rooms, "grp").where("start >= end - room and start < end").select("grp", "unit", "size", "shard", "own"), "asked")
        needs = asked.groupBy("grp", "shard").agg(F.greatest(F.lit(0), F.sum("size") - F.first("own")).alias("need"))
        demand = sums(needs, shards, F.col("need"))
        grant = [10**6 if d <= f else 10**6 * f // d for f, d in zip(free, demand)]
        granted = asked.where(F.pmod(F.xxhash64("grp", "unit", F.lit(turn)), F.lit(10**6)) < by_shard(grant, F.col("shard"))).select("grp", "unit", F.col("shard").alias("moved"))
        step = saved(state.join(granted, ["grp", "unit"], "left").select("grp", "unit", "size", F.coalesce("shard", "moved").alias("shard")), "state")
        left = step.where("shard is null").isEmpty()
        forget(state)
        forget(asked)
        state = step
        if left:
            break
    return state.where("shard is not null").select("grp", "unit", "shard")


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, linked) for every row of docs, by the law `rows`.

    Numbers of rows of any two shards are at most one apart; slots are gapless from 0 in each shard. Size is the
    text's UTF-8 bytes plus 8. Where two shards hold as many of a group, a hash of both decides. Null texts link with nothing; empty texts are equal texts. Null ids and repeated rows
    are placed like others. grown_shard belongs to the law `key` and is null. Only the two columns named are read; an
    empty table gives an empty table.
    """
    text = F.col(text_col).cast("string")
    base = saved(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("grp"),
            F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(shards)).cast("int").alias("home"),
        ),
        "sizes",
    )
    n = base.count()
    quota = -(-n // shards)
    unit_rows = max(1, min(UNIT_ROWS, quota // UNITS_PER_SHARD))
    whole = max(1, min(UNIT_ROWS, quota // 4))
    groups = saved(base.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").withColumn("members", F.col("n")), "groups")
    unit = F.when(F.col("members") <= whole, F.lit(0).cast("long")).when(F.col("members") > whole, F.pmod(F.xxhash64("uid"), F.ceil(F.col("members") / unit_rows)))
    # null texts have no group and meet none
    with_text = join_hot(base.where("grp is not null"), groups, ["grp"], n, "left")
    without = base.where("grp is null").withColumn("members", F.lit(None).cast("long"))
    marked = saved(with_text.unionByName(without).withColumn("unit", unit).drop("members"), "linked")
    moved = propagate(marked.where("unit is not null"), shards, quota, rounds)
    cells = max(1, -(-n // (shards * CELL_ROWS)))
    placed = saved(
        marked.where("unit is not null").join(moved, ["grp", "unit"], "left").unionByName(marked.where("unit is null").withColumn("shard", F.lit(None).cast("int"))).select(
            "uid",
            "doc_id",
            "size",
            "text_crc32",
            F.col("unit").isNotNull().alias("linked"),
            F.coalesce("shard", "home").alias("shard"),
            F.pmod(F.when(F.col("unit").isNull(), F.xxhash64("uid")).otherwise(F.xxhash64("grp", "unit")), F.lit(cells)).alias("cell"),
        ),
        "placed",
    )
    held = sums(placed, shards, F.lit(1))
    target = [n // shards + (s < n % shards) for s in range(shards)]
    surplus = [max(0, h - t) for h, t in zip(held, target)]
    lack = [max(0, t - h) for h, t in zip(held, target)]
    leaving_before = [sum(surplus[:s]) for s in range(shards)]
    filled_before = [sum(lack[:s]) for s in range(shards)]
    # rank in the shard: those before in earlier cells, counted, and the place in the own cell
    key = ["shard", "linked", "cell"]
    counts = placed.groupBy(*key).agg(F.count("*").alias("in_cell"))
    earlier = F.sum("in_cell").over(Window.partitionBy("shard").orderBy("linked", "cell").rowsBetween(Window.unboundedPreceding, -1))
    ranked = placed.join(counts.withColumn("earlier", F.coalesce(earlier, F.lit(0))), key).withColumn("rank", F.col("earlier") + F.row_number().over(Window.partitionBy(*key).orderBy("uid")) - 1)
    out = F.col("rank") < by_shard(surplus, F.col("shard"))
    turn = by_shard(leaving_before, F.col("shard")) + F.col("rank")  # of all that leave
    goes_to = F.lit(None).cast("int")
    for s in range(shards):
        goes_to = F.when((turn >= filled_before[s]) & (turn < filled_before[s] + lack[s]), s).otherwise(goes_to)
    new = ranked.withColumn("to", F.when(out, goes_to))
    slot = F.when(out, by_shard(held, F.col("to")) + turn - by_shard(filled_before, F.col("to"))).otherwise(F.col("rank") - by_shard(surplus, F.col("shard")))
    return new.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.coalesce("to", "shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked")
