"""Problem 9: documents packed into containers of a fixed token capacity.

Shortest-pack-first over the histogram of lengths: lengths are placed from
the longest down, each into the open pattern with the most room (the shortest
pack), and only *counts of patterns* are updated, so planning costs the
same for a thousand or a billion documents. Patterns then meet documents
again by (length, rank).

Only an item above the capacity is split: full containers first, its
remainder is packed like any other item. Items of size 0 take no room and
are spread over the containers. Equal rows of one key count as one item.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.runtime import cut

BUCKET_ROWS = 200_000
SLOTS_BROADCAST = 1_000_000


class Run(NamedTuple):
    """count containers in a row, numbered from first, all of one pattern."""

    pattern: tuple[tuple[int, int], ...]  # (length, times)
    count: int


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Shortest-pack-first. histogram: length (1..capacity) -> items. State is bounded by capacity, not by items."""
    open_: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))  # room -> pattern -> containers
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            room = next((r for r in range(capacity - 1, length - 1, -1) if open_.get(r)), None)
            if room is None:
                per = max(1, capacity // length)
                full, rest = divmod(left, per)
                if full:
                    open_[capacity - per * length][((length, per),)] += full
                if rest:
                    open_[capacity - rest * length][((length, rest),)] += 1
                left = 0
                continue
            pattern, count = next(iter(open_[room].items()))
            per = min(room // length, max(1, left))
            use = min(count, max(1, left // per))
            open_[room][pattern] -= use
            if not open_[room][pattern]:
                del open_[room][pattern]
            open_[room - per * length][pattern + ((length, per),)] += use
            left -= per * use
    return [Run(p, n) for room in sorted(open_) for p, n in open_[room].items() if n]


def _slots(runs: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, container_from, per): items of a length take consecutive ranks."""
    taken: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for pattern, count in runs:
        for length, per in pattern:
            out.append((length, taken[length], taken[length] + per * count, first, per))
            taken[length] += per * count
        first += count
    return out


def ranked(items: DataFrame, group: str, order: list[str], buckets: int = 64) -> DataFrame:
    """0-based rank of every row within its group, without one task per group: ranks in hash buckets plus bucket offsets."""
    from pyspark.sql import Window

    b = items.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    offsets = counts.withColumn("__off", F.sum("__n").over(Window.partitionBy(group).orderBy("__b")) - F.col("__n")).drop("__n")
    rn = b.withColumn("__rn", F.row_number().over(Window.partitionBy(group, "__b").orderBy(*order)) - 1)
    return rn.join(offsets, [group, "__b"]).withColumn("rank", F.col("__rn") + F.col("__off")).drop("__b", "__rn", "__off")


def _last_at_most(rank):
    """Index of the last of the sorted slots that starts at or before rank: binary search."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size("slots") + 1)).cast("int"))

    def halve(a, _):
        mid = F.floor((a["lo"] + a["hi"] + 1) / 2).cast("int")
        below = F.get("slots", mid)["rank_from"] <= rank
        return F.struct(F.when(below, mid).otherwise(a["lo"]).alias("lo"), F.when(below, a["hi"]).otherwise(F.greatest(a["lo"], mid - 1)).alias("hi"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), (F.size("slots") - 1).alias("hi")), halve, lambda a: a["lo"])


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece_no, start_token, n_tokens, container_id) covering every item exactly once."""
    spark = sizes.sparkSession
    items = sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")).distinct()
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    split = items.select(key, "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no")).select(
        key, "piece_no", (F.col("piece_no") * F.lit(capacity).cast("long")).alias("start_token"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece_no") * capacity).alias("n_tokens")
    )
    split = cut(split)
    # at most capacity + 1 rows reach the driver, whatever the number of documents
    histogram = {int(r["n_tokens"]): int(r["c"]) for r in split.groupBy("n_tokens").agg(F.count("*").alias("c")).collect()}
    zero = histogram.pop(0, 0)
    runs = plan(histogram, capacity)
    total = max(1, sum(r.count for r in runs))
    by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, low, _, container, per in _slots(runs):
        by_length[length].append((low, container, per))
    slots = spark.createDataFrame([(k, sorted(v)) for k, v in by_length.items()] or [(0, [(0, 0, 1)])], "n_tokens long, slots array<struct<rank_from:long,container_from:long,per:long>>")
    if sum(map(len, by_length.values())) <= SLOTS_BROADCAST:  # planned from the histogram: bounded by the capacity, and checked
        slots = F.broadcast(slots)
    placed = ranked(split.where("n_tokens > 0"), "n_tokens", [key, "piece_no"], max(64, 1 << (max(histogram.values(), default=1) // BUCKET_ROWS).bit_length()))
    slot = F.get("slots", _last_at_most(F.col("rank")))
    full = placed.join(slots, "n_tokens").withColumn("__s", slot)
    out = full.select(key, "piece_no", "start_token", "n_tokens", (F.col("__s.container_from") + F.floor((F.col("rank") - F.col("__s.rank_from")) / F.col("__s.per"))).cast("long").alias("container_id"))
    if zero:
        empty = split.where("n_tokens = 0").select(key, "piece_no", "start_token", "n_tokens", F.pmod(F.xxhash64(key), F.lit(total)).cast("long").alias("container_id"))
        out = out.unionByName(empty)
    return out


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, mean fill, containers below 90 % full."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), (F.avg("used") / capacity).alias("mean_fill"), F.count_if(F.col("used") < 0.9 * capacity).alias("below_90"))
