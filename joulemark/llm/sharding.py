"""Sharding by balanced label propagation, in DataFrame operations only.

Links join documents of equal text. Every document starts with a shard drawn by a hash; in each iteration joins bring
every linked document the shard most of its neighbours hold, and it moves there if the shard's quota takes it. In the
end all shards are levelled exactly: documents without links (and what a full shard cannot hold) fill the gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, written

#: MORE: rounds after the iterations in which what is still refused asks for any shard.
SHARDS, ITERATIONS, MORE = 40, 3, 9
#: Parts in which quotas and ranks are tallied: at most so many for each shard, whatever the size of the table.
PARTS, FREE_PARTS = 2048, 16384


def _ranked(df: DataFrame, keys: list[str], parts: int, order: list[str], by: str = "row") -> DataFrame:
    """df with rank: gapless from 0 among the rows of equal keys. Parts of a key's rows are numbered by themselves and
    moved on by the sizes of the parts before, a table of at most parts rows for each key."""
    df = df.withColumn("_part", F.pmod(F.xxhash64(by, F.lit(7)), F.lit(parts)))
    sizes = df.groupBy(*keys, "_part").count()
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = written(sizes.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before")), "shard-parts")
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    out = df.withColumn("_own", own)
    return out.join(F.broadcast(sizes), [*keys, "_part"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def chunks_placed(chunks: list, capacity: int, shards: int) -> dict:
    """Shard of each chunk of the large groups (digest, chunk, n), the next to the last where that takes it, else the emptiest. Those that no shard takes are absent."""
    out, used, at = {}, [0] * shards, 0
    for digest, chunk, n in sorted(chunks):
        if used[at] + n > capacity:
            at = min(range(shards), key=lambda s: (used[s], s))
        if used[at] + n <= capacity:
            out[digest, chunk], used[at] = at, used[at] + n
    return out


def propagate(groups: DataFrame, room: list[int], iterations: int = ITERATIONS, more: int = MORE) -> DataFrame | None:
    """groups (digest, chunk, n, held), held being (shard, count) of its documents, and the rows that each shard still takes
    -> digest, chunk, shard of the groups placed, or None. A group asks for the shard most of its documents hold, of those with
    room for it; one that is refused asks again, and in the end any shard, drawn in proportion to the room."""
    placed, room = None, [max(0, x) for x in room]
    for k in range(iterations + more):
        if not sum(room) or groups.isEmpty():
            break
        rooms = F.array(*[F.lit(x).cast("long") for x in room])
        near = F.array_max(F.transform(F.filter("held", lambda x: F.get(rooms, x["shard"]) >= F.col("n")), lambda x: F.struct(x["count"], (-x["shard"]).alias("least"))))
        ends = F.array(*[F.lit(sum(room[: s + 1])).cast("long") for s in range(len(room))])
        drawn = F.pmod(F.xxhash64("digest", "chunk", F.lit(k)), F.lit(sum(room)))
        drawn = F.size(F.filter(ends, lambda x: x <= drawn))
        want = F.coalesce(-near["least"], drawn) if k < iterations else drawn
        asking = groups.withColumn("want", want.cast("int")).withColumn("part", F.pmod(F.xxhash64("digest", "chunk", F.lit(k + 100)), F.lit(PARTS)))
        asked = asking.groupBy("want", "part").agg(F.sum("n").alias("asked"))
        running = F.sum("asked").over(Window.partitionBy("want").orderBy("part"))
        taken = written(asked.select("want", "part", (running <= F.get(rooms, F.col("want"))).alias("taken")), "shard-quota")
        asking = written(asking.join(F.broadcast(taken), ["want", "part"]), "shard-asked")
        moves = asking.where("taken").select("digest", "chunk", F.col("want").alias("shard"))
        placed = moves if placed is None else placed.unionByName(moves)
        for r in asking.where("taken").groupBy("want").agg(F.sum("n").alias("n")).collect():  # a row for each shard
            room[r["want"]] -= r["n"]
        groups = asking.where("not taken").select("digest", "chunk", "n", "held")
    return placed


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, shard, slot. Law: the shards' row counts differ by one at most.

    Null text counts as empty (size 16). Rows that repeat, or lack a doc_id, are sharded like any other. A group of equal
    texts larger than a quarter of a shard is linked in chunks of that size, which are placed first, next to each other. An empty
    table gives an empty result; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    keys = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keys = written(keys, "shard-keys")
    total = keys.count()
    capacity = max(1, total // shards)
    chunk = max(1, capacity // 4)
    groups = written(keys.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    all_ = lookup(keys, groups, "digest")
    chunks = F.ceil(F.col("n") / chunk).cast("long")
    linked = all_.where("n is not null").withColumn("chunk", F.pmod(F.xxhash64("row"), chunks)).withColumn("large", chunks > 1)
    linked = written(linked.select("row", "doc_id", "size", "text_crc32", "digest", "chunk", "large"), "shard-linked")
    large = linked.where("large").groupBy("digest", "chunk").count().collect()  # a few for each shard: chunks are parts of one
    large = {k: int(v) for k, v in chunks_placed([(bytes(r[0]), r[1], r[2]) for r in large], capacity, shards).items()}, {(bytes(r[0]), r[1]): r[2] for r in large}
    room = [capacity] * shards
    for k, s in large[0].items():
        room[s] -= large[1][k]
    votes = linked.where("not large").groupBy("digest", "chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int").alias("shard")).count()
    votes = votes.groupBy("digest", "chunk").agg(F.sum("count").alias("n"), F.collect_list(F.struct("shard", "count")).alias("held"))
    places = spark.createDataFrame([(*k, s) for k, s in large[0].items()], "digest binary, chunk long, shard int")
    moves = propagate(written(votes, "shard-groups"), room)
    linked = linked.join(F.broadcast(places.withColumnRenamed("shard", "_large")), ["digest", "chunk"], "left")
    if moves is None:
        linked = linked.withColumn("shard", F.col("_large"))
    else:
        small = moves.count() <= 200_000
        linked = linked.join(F.broadcast(moves) if small else moves, ["digest", "chunk"], "left").withColumn("shard", F.coalesce("_large", "shard"))
    linked = written(linked.drop("_large", "large"), "shard-moved")

    parts = max(1, min(PARTS, total // (shards * 64)))
    placed = written(_ranked(linked.where("shard is not null"), ["shard"], parts, ["digest", "chunk", "row"]), "shard-placed")
    target = F.lit(total // shards) + (F.col("shard") < F.lit(total % shards)).cast("long")
    fits = F.col("rank") < target
    # what no shard took goes side by side into the gaps
    left = linked.where("shard is null").unionByName(placed.where(~fits).select(linked.columns)).withColumn("lot", F.xxhash64("digest", "chunk"))
    single = all_.where("n is null").select("row", "doc_id", "size", "text_crc32", F.col("row").alias("lot"))
    free = single.unionByName(left.select(single.columns))
    held = {r["shard"]: r["n"] for r in placed.where(fits).groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    gaps = [0]
    for s in range(shards):
        gaps.append(gaps[-1] + total // shards + (s < total % shards) - held.get(s, 0))
    free = _ranked(free.withColumn("_all", F.lit(0)), ["_all"], max(1, min(FREE_PARTS, total // 64)), ["lot", "row"], "lot")
    starts = F.array(*[F.lit(x).cast("long") for x in gaps])
    number = (F.size(F.filter(starts, lambda x: x <= F.col("rank"))) - 1).cast("int")
    filled = F.array(*[F.lit(held.get(s, 0)).cast("long") for s in range(shards + 1)])
    free = free.withColumn("shard", number).withColumn("slot", F.col("rank") - F.element_at(starts, F.col("shard") + 1) + F.element_at(filled, F.col("shard") + 1))
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    return placed.where(fits).withColumnRenamed("rank", "slot").select(names).unionByName(free.select(names)).withColumn("slot", F.col("slot").cast("long"))
