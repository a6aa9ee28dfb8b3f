"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, as DataFrame operations only.

Every shard owns VIRTUAL_NODES points of a hash ring; a key belongs to the arc that ends in the next point clockwise.
A shard has room for its capacity and no more; the keys of an arc that find its owner full go on clockwise to the
next point whose owner has room. With the capacities used here (floor or ceiling of rows / shards, which sum up to
all rows) every shard fills exactly, so counts are at most one apart: the law ``rows``.

Plan: hash -> rank of the row within its arc (a window over ~6,000 arcs, each a narrow slice of the ring) -> a table
of (arc, ranks from-to, shard, first slot) made from the arc counts -> equality join on the arc. Only the counts of
the arcs (shards * virtual nodes numbers, whatever the input) reach the driver, and only that bounded table is
broadcast. The text itself is never shuffled.

Nulls: a null key or text hashes like a value of its own; a null text has size 8 and the checksum of the empty text.
Equal rows are interchangeable: they are counted before the shuffle, ranked as one run and expanded afterwards.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbarium.llm.common import literal_rows, staged, table

SHARDS = 24
VIRTUAL_NODES = 256
#: The ring in cells; a point or key lies in the cell of its hash's highest bits.
RING_BITS = 16
#: Rows that one task expands out of a run of equal rows.
RUN = 4096


def _position(*columns):
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - RING_BITS).cast("int")


def ring(spark, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise."""
    points = spark.range(shards * virtual_nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
    found = points.select(_position(F.lit("node"), "shard", "node").alias("cell"), "shard", "node").collect()
    return [(r.cell, r.shard) for r in sorted(found, key=lambda r: (r.cell, r.shard, r.node))]


def spread(counts: dict[int, int], owners: list[int], capacities: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): who takes which ranks of each arc.

    The first pass gives each arc's rows to its owner while there is room, clockwise; the second carries on what
    overflowed, arc by arc, to the next owners with room.
    """
    room, filled, out, over = list(capacities), [0] * len(capacities), [], []

    def take(arc: int, start: int, end: int, shard: int) -> int:
        n = min(room[shard], end - start)
        if n > 0:
            out.append((arc, start, start + n, shard, filled[shard]))
            room[shard] -= n
            filled[shard] += n
        return start + max(n, 0)

    for arc in sorted(counts):
        if (at := take(arc, 0, counts[arc], owners[arc])) < counts[arc]:
            over.append((arc, at))
    for arc, at in over:
        step = 1
        while at < counts[arc]:
            at = take(arc, at, counts[arc], owners[(arc + step) % len(owners)])
            step += 1
    return out


def assign(keys: DataFrame, shards: int = SHARDS, by: list[str] | None = None, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """keys with shard int and slot long (gapless from 0 in each shard). by: the columns that place a row on the ring.

    keys must be narrow: what identifies a row and what is wanted of it, not its text.
    """
    spark = keys.sparkSession
    by = by or keys.columns
    points = ring(spark, shards, virtual_nodes)
    arcs = literal_rows(spark, [(i, cell) for i, (cell, _) in enumerate(points)], "__arc int,__point int")
    # the arc of each cell: that of the first point at or after it, around the ring
    cells = spark.range(1 << RING_BITS).select(F.col("id").cast("int").alias("__cell"))
    last = Window.orderBy("__point").rowsBetween(Window.unboundedPreceding, -1)
    spans = arcs.groupBy("__point").agg(F.min("__arc").alias("__arc")).select("__arc", "__point", F.coalesce(F.max("__point").over(last), F.lit(-1)).alias("__before"))
    bounds = spans.select("__arc", F.expr("explode(sequence(__before + 1, __point))").alias("__cell"))
    lookup = cells.join(F.broadcast(bounds), "__cell", "left").select("__cell", F.coalesce("__arc", F.lit(0)).alias("__arc"))

    runs = keys.groupBy(*keys.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.xxhash64(*by))
    placed = staged(runs.withColumn("__cell", _position(F.lit("key"), "__h")).join(F.broadcast(lookup), "__cell").drop("__cell"), "ring")
    counts = {r["__arc"]: r["n"] for r in placed.groupBy("__arc").agg(F.sum("__n").alias("n")).collect()}
    total = sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    parts = literal_rows(spark, spread(counts, [s for _, s in points], sizes), "__arc int,__from long,__to long,shard int,__slot long")

    before = Window.partitionBy("__arc").orderBy("__h", *keys.columns).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    single = ranked.where("__n = 1").withColumn("__rank", F.col("__first"))
    runs_of = ranked.where("__n > 1").withColumn("__at", F.expr(f"explode(sequence(0L, __n - 1, {RUN}L))"))
    many = runs_of.repartition("__h", "__at").withColumn("__rank", F.expr(f"explode(sequence(__first + __at, __first + least(__at + {RUN}L, __n) - 1))")).drop("__at")
    rows = single.unionByName(many)
    out = rows.join(F.broadcast(parts), (rows["__arc"] == parts["__arc"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    return out.select(*[rows[c] for c in keys.columns], "shard", (F.col("__slot") + F.col("__rank") - F.col("__from")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents over 24 shards by the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign(keys, SHARDS, by=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
