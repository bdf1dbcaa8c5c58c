"""Operator 9: sharding by sampled splitters, under the law of equal bytes.

Records are put in the order of a hash of their text (the key), so equal texts stand together. A
sample of the keys, drawn with chances in proportion to size, gives quantile boundaries, a fixed
number for each shard, that cut this order into ranges of about equal bytes. Overfull ranges are
subdivided into equal intervals of their keys (cells); where a single key alone overfills a cell, a
large group of equal texts, its rows get cells of their own, by the hash of a row number.

Large groups, fewer than `PER_SHARD` / 2 a shard, are placed first, the largest to the emptiest shard.
One that fits in no shard is parted, and only such a one. All other records fill what room is left,
in the order of their keys; a shard's edge that falls into a group moves to the group's end, so no
other group is parted either. Exact byte sums of all cells and running sums inside each give every
record its place. Shards differ by the size of one such group, 1/64 of a shard, at most.

Defined results: a null text has no bytes, size 1 and the checksum 0, and equals an empty text; null
ids, identical rows and very long texts are records like any other (a record is never cut); fewer
records than shards leave shards empty, an empty table all; further columns are ignored, whatever
their names (`write_shards` keeps them).

Texts are read once and never shuffled: sizes, checksums and hashes go to the shared checkpoint
folder. Cells hold `range_rows` records on average; the table of cells is that much smaller than the
input, and is joined by a shuffle where it is not small. What comes to the driver or stands in a plan
as literals is bounded by the number of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import cut, free_name, table, tasks

SHARDS = 8
PER_SHARD, MOST = 128, 4096  # ranges for each shard, and at most so many
SMALL = 100_000  # rows of a table that is still broadcast


def _constant(values: list, kind: str) -> Column:
    """The values as one constant array, a single node of the plan however many they are."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _place(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most the value, found by bisection."""
    if not bounds:
        return F.lit(0)
    every, bits = _constant(bounds, "long"), _constant([1 << k for k in reversed(range(len(bounds).bit_length()))], "int")
    found = F.aggregate(bits, F.lit(0), lambda at, bit: F.when((at + bit <= len(bounds)) & (F.get(every, at + bit - 1) <= value), at + bit).otherwise(at))
    # a row number, compared with nothing it could fail, keeps the optimizer from copying the search into other places
    return F.when(F.monotonically_increasing_id() >= 0, found)


def splitters(base: DataFrame, total: int, ranges: int, per_range: int = 24, seed: int = 7) -> list[int]:
    """At most `ranges - 1` boundaries: quantiles of a size-weighted sample of the keys.

    About `per_range` keys are drawn for each range; a row that is longer than the distance of two
    draws counts as often as it would be drawn.
    """
    if ranges < 2 or not total:
        return []
    share = F.lit(ranges * per_range / total) * F.col("size")
    draw = (F.pmod(F.xxhash64("at", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)) < share
    sample = base.where(draw).select("key", F.least(F.greatest(F.lit(1), F.floor(share)), F.lit(ranges * per_range)).cast("int").alias("times"))
    # the quantiles are taken where the sample lies; only the boundaries come to the driver
    cuts = [(i + 1) / ranges for i in range(ranges - 1)]
    found = sample.select(F.explode(F.array_repeat("key", "times")).alias("key")).agg(F.percentile_approx("key", _constant(cuts, "double"), F.lit(max(10_000, 4 * ranges))).alias("q")).first().q
    return sorted(set(found or []))


def plan(groups: list[tuple[int, int]], total: int, shards: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """Where the large groups (key, bytes) go: (key, first byte, end, shard) of each piece, and the room left in each shard.

    The largest goes first, to the shard with the most room; one that fits nowhere fills up shards in turn.
    """
    edges = [total * s // shards for s in range(shards + 1)]
    room = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    pieces = []
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        at = 0
        while at < size:
            s = max(range(shards), key=lambda s: (room[s], -s))
            take = min(size - at, room[s]) if room[s] > 0 else size - at
            pieces.append((key, at, at + take, s))
            room[s] -= take
            at += take
    return pieces, [max(0, r) for r in room]


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("at")]


def _assigned(base: DataFrame, shards: int, range_rows: int) -> DataFrame:
    """`base` (doc_id, size, text_crc32, key, at; its lineage cut) with shard and slot."""
    spark = base.sparkSession
    n, total = base.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MOST, shards * PER_SHARD)
    fine = max(total / max(shards * PER_SHARD, -(-n // range_rows)), 1.0)  # bytes of a cell
    large = 2 * total / (shards * PER_SHARD)  # a group of more is placed by itself
    placed = base.withColumn("range", _place(splitters(base, total, ranges), F.col("key")))
    spans = placed.groupBy("range").agg(F.sum("size").alias("b"), F.min("key").cast("double").alias("lo"), F.max("key").cast("double").alias("hi"))
    spans = spans.select("range", "lo", ((F.col("hi") - F.col("lo")) * 1.0001 + 1).alias("width"), F.when(F.col("b") > 2 * fine, F.ceil(F.col("b") / fine)).otherwise(1).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(spans), "range")  # at most MOST rows
    placed = placed.withColumn("part", F.floor((F.col("key").cast("double") - F.col("lo")) / F.col("width") * F.col("parts")).cast("int"))
    placed = cut(placed.drop("lo", "width", "parts"))

    over = placed.groupBy("range", "part").agg(F.sum("size").alias("b")).where(F.col("b") > large).drop("b")  # fewer than shards * PER_SHARD
    inside = placed.join(F.broadcast(over), ["range", "part"], "left_semi").groupBy("key").agg(F.sum("size").alias("b")).where(F.col("b") > large)
    groups = [(r.key, r.b) for r in inside.collect()]  # each more than 2 / PER_SHARD of a shard
    pieces, room = plan(groups, total, shards)
    hot = spark.createDataFrame([(k, max(1, int(-(-b // fine)))) for k, b in groups], "key long, cells int")
    placed = placed.join(F.broadcast(hot), "key", "left")
    own = F.col("cells").isNotNull()
    placed = placed.withColumn("cell", F.struct("range", "part", own.alias("own"), F.when(own, F.col("key")).otherwise(0).alias("hot"), F.when(own, F.pmod(F.xxhash64("at", F.lit(1)), F.col("cells"))).otherwise(0).cast("int").alias("sub"))).drop("range", "part", "cells")

    # the bytes in front of each cell: of its group for the large ones, of all other cells for the rest
    cells = placed.groupBy("cell").agg(F.sum("size").alias("cb"))
    before = Window.partitionBy("cell.range", "cell.own", "cell.hot").orderBy("cell.part", "cell.sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut(cells.withColumn("b0", F.coalesce(F.sum("cb").over(before), F.lit(0))))
    n_cells = cells.count()
    first = cells.where(~F.col("cell.own")).groupBy("cell.range").agg(F.sum("cb").alias("rb"))
    first = first.select("range", F.coalesce(F.sum("rb").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("r0"))  # at most MOST rows
    cells = cells.join(F.broadcast(first), F.col("cell.range") == F.col("range"), "left").select("cell", (F.col("b0") + F.when(F.col("cell.own"), 0).otherwise(F.col("r0"))).alias("b0"))
    few = lambda df: F.broadcast(df) if n_cells <= SMALL else df.hint("merge")
    rows = placed.join(few(cells), "cell").repartition(tasks(spark), "cell")

    order = Window.partitionBy("cell").orderBy("key", "doc_id", "at")
    group = Window.partitionBy("cell", "key")
    rows = rows.withColumn("begin", F.col("b0") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.withColumn("g0", F.min("begin").over(group)).withColumn("gb", F.sum("size").over(group))
    cut_at = [sum(room[: s + 1]) for s in range(shards - 1)]
    rows = rows.withColumn("rest", _place(cut_at, F.floor(F.col("g0") + F.col("gb") / 2).cast("long")))
    spread = spark.createDataFrame(pieces, "_key long, lo long, hi long, to int")
    middle = F.floor(F.col("begin") + F.col("size") / 2)
    rows = rows.join(F.broadcast(spread), F.col("cell.own") & (F.col("key") == F.col("_key")) & (middle >= F.col("lo")) & (middle < F.col("hi")), "left")  # as many as groups and shards
    rows = cut(rows.select("doc_id", "size", "text_crc32", "key", "at", "cell", F.coalesce("to", "rest").cast("int").alias("shard")))

    there = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    there = there.select("shard", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s0"))
    nth = F.row_number().over(Window.partitionBy("cell", "shard").orderBy("key", "doc_id", "at"))
    numbered = rows.withColumn("nth", nth - 1)
    return numbered.join(few(there), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "at", "shard", (F.col("s0") + F.col("nth")).cast("long").alias("slot"))


def shard_records(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    placed = _assigned(cut(docs.select(*_narrow(docs, id_col, text_col))), shards, range_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 4, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Every row once, as Parquet under `path`: one folder a shard, `files` files in each. Gives the folders' column name.

    Rows are numbered in a written copy, and that number, which repeated rows do not share, carries the
    shard. The folders' column is `shard`, or that with underscores where the input has such a column.
    """
    name = free_name(docs, "shard")
    copy = cut(docs.select(F.struct(*docs.columns).alias("row"), *_narrow(docs, id_col, text_col)))
    placed = _assigned(copy.drop("row"), shards, 20_000).select("at", F.col("shard").alias(name))
    rows = copy.select("row", "at").join(placed.hint("merge"), "at")
    rows = rows.repartition(shards * files, name, F.pmod(F.xxhash64("at"), F.lit(files))).select("row.*", name)
    rows.write.mode("overwrite").partitionBy(name).parquet(path)
    return name


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_records(table(spark, sf_dir, "documents"))


QUERIES = {"op9_sharding": op9_sharding}
