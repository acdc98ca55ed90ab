"""Sharding (operator 6): a hierarchical weighted hash tree.

Each leaf (a shard) draws, for every key, an exponential waiting time from a
hash of (key, path of the leaf), divided by its weight.  The draw of an inner
node is the least draw below it, which is the weighted hash draw for the sum of
the weights below; a row descends region, rack, shard and takes the child with
the least draw on each level.  A changed weight changes the draws of that leaf
and its ancestors alone, so rows move only into or out of that subtree, and a
new shard takes rows only into itself.

Placing is one map without a shuffle; only the slots need one.  The law of the
query is ``key``: doc_id and the number of shards decide.

Edge cases: a null text has size 8 and CRC 0; a null key is hashed like any
other key; equal keys share a shard; repeated rows get slots of their own;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glenfare.llm.common import stored, table

REGIONS, RACKS, SHARDS_PER_RACK = 2, 3, 4
#: Rows that one slot bucket holds, about.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(n_shards: int) -> list[Leaf]:
    """``n_shards`` shards dealt over the racks in blocks; each further block
    opens racks again from the first, so a leaf's place never changes."""
    per_region = RACKS * SHARDS_PER_RACK
    return [Leaf(s // per_region % REGIONS, s // SHARDS_PER_RACK % RACKS, s) for s in range(n_shards)]


def draw(key: Column, leaf: Leaf) -> Column:
    """Waiting time of ``leaf`` for ``key``: -ln(u) / weight, u in (0, 1)."""
    h = F.xxhash64(key, F.lit(leaf.region), F.lit(leaf.rack), F.lit(leaf.shard))
    u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / leaf.weight


def least(draws: list[Column]) -> Column:
    return F.least(*draws) if len(draws) > 1 else draws[0]


def place(df: DataFrame, key: Column, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    """``df`` with ``out``: the shard that the key descends to."""
    leaves = [x for x in leaves if x.weight > 0]
    d = {x.shard: F.col(f"_draw_{x.shard}") for x in leaves}
    racks: dict[tuple[int, int], list[Leaf]] = {}
    for x in leaves:
        racks.setdefault((x.region, x.rack), []).append(x)
    regions: dict[int, list[tuple[int, int]]] = {}
    for r in racks:
        regions.setdefault(r[0], []).append(r)
    rack_draw = {r: F.col(f"_rack_{r[0]}_{r[1]}") for r in racks}
    region_draw = {g: F.col(f"_region_{g}") for g in regions}

    def choose(options: list[tuple[Column, Column]], below: Column) -> Column:
        """The value of the option whose draw is ``below``; the last needs no test."""
        out = options[-1][1]
        for value, result in reversed(options[:-1]):
            out = F.when(value == below, result).otherwise(out)
        return out

    def in_rack(r) -> Column:
        return choose([(d[x.shard], F.lit(x.shard)) for x in racks[r]], rack_draw[r])

    def in_region(g) -> Column:
        return choose([(rack_draw[r], in_rack(r)) for r in regions[g]], region_draw[g])

    step = df.withColumns({f"_draw_{x.shard}": draw(key, x) for x in leaves})
    step = step.withColumns({f"_rack_{r[0]}_{r[1]}": least([d[x.shard] for x in xs]) for r, xs in racks.items()})
    step = step.withColumns({f"_region_{g}": least([rack_draw[r] for r in rs]) for g, rs in regions.items()})
    shard = choose([(region_draw[g], in_region(g)) for g in regions], least(list(region_draw.values())))
    return step.withColumn(out, shard.cast("int")).select(*df.columns, out)


def with_slots(df: DataFrame, shard: str = "shard", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` (narrow rows) with ``slot``, gapless from 0 within each shard.

    Equal rows are counted before the shuffle, so a hot key is one row; a
    shard is split into hash buckets whose starts are running sums of counts,
    so no task sorts a whole shard."""
    cols = df.columns
    n = max(1, -(-df.count() // bucket_rows))
    same = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_bucket", F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")))
    sizes = same.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("_s"), F.col("_bucket").alias("_b"),
                          F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_bucket").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    first = F.col("_start") + F.col("_before")
    return (ranked.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
            .select(*cols, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot")))


def op6_sharding(spark: SparkSession, sf_dir: str, n_shards: int = 24) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).cast("long").alias("text_crc32"))
    placed = place(place(docs, F.col("doc_id"), tree(n_shards)), F.col("doc_id"), tree(n_shards + 1), "grown_shard")
    return with_slots(stored(placed, "shards")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                                     "grown_shard")


QUERIES = {"op6_sharding": op6_sharding}
