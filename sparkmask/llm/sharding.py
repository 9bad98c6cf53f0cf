"""Consistent-hash ring with virtual nodes and bounded loads (native: DataFrame functions only).

Every shard owns `vnodes` points of a ring of 2^32 positions; a row's key hashes to a position and
belongs to the next point clockwise. Loads are bounded: of N rows, a shard takes N div shards rows,
and N mod shards of them one more. Rows beyond a shard's bound continue clockwise to the next shard
that has room, so counts differ by one at most and only overflow moves.

Rows never meet in one place. Each arc (gap before a point) is split into cells by hash; cells are
counted with a partial aggregate, and the driver settles the overflow on the counts of arcs, of which
there are shards * vnodes whatever the input. What comes back is a table of intervals (arc, first
rank, last rank, shard, first slot), and a row finds its interval by its rank within its arc.

Defined cases: null text has 8 bytes and the crc32 of no bytes; a null key hashes as the empty text;
repeated rows share a ring position and get different slots; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

RING = 2**32


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order. A shard's points don't depend on the others."""
    import zlib

    return sorted((zlib.crc32(f"shard {s} point {v}".encode()) * 2654435761 % RING, s) for s in range(shards) for v in range(vnodes))


def settle(counts: list[int], owner: list[int], caps: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each arc in ring order, (first rank, rows, shard): own shard first, then clockwise while there is room."""
    room, n = list(caps), len(counts)
    left, given = list(counts), [0] * n
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    for step in range(n):
        if not any(left):
            break
        for a in range(n):
            if left[a]:
                s = owner[(a + step) % n]
                if take := min(left[a], room[s]):
                    out[a].append((given[a], take, s))
                    given[a] += take
                    left[a] -= take
                    room[s] -= take
    return out


def arc_of(position: Column, points: list[int]) -> Column:
    """Index of the first point at or after the position, by a tree of comparisons; past the last, 0."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo % len(points))
        mid = (lo + hi) // 2
        return F.when(position <= points[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(points))


def assign_shards(rows: DataFrame, key: str, shards: int = 24, vnodes: int = 64, cells: int = 8) -> DataFrame:
    """rows with arc (int), shard (int), moved (boolean: not on its own shard) and slot (long, gapless from 0).

    `key` names the column that places a row; columns arc, cell, ring and rank are added and dropped.
    """
    points = ring_points(shards, vnodes)
    where, owner = [p for p, _ in points], [s for _, s in points]
    # a lookup by 2^12 equal slices of the ring, then a short search: an array literal instead of a deep CASE
    slices = 4096
    first = [bisect.bisect_left(where, i * (RING // slices)) for i in range(slices)]
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    ring = F.pmod(F.xxhash64(text), F.lit(RING))
    base = F.element_at(F.array(*map(F.lit, first)), (F.col("_ring") / F.lit(RING // slices)).cast("int") + 1)
    later = sum((F.when(F.element_at(F.array(*map(F.lit, [*where, *[RING] * 8])), base + 1 + i) < F.col("_ring"), 1).otherwise(0) for i in range(max_in_slice(where, slices))), F.lit(0))
    placed = rows.withColumn("_ring", ring).withColumn("_arc", F.pmod(base + later, F.lit(len(points))).cast("int")).withColumn("_cell", F.pmod(F.shiftright("_ring", 3), F.lit(cells)).cast("int"))
    counted = {(r["_arc"], r["_cell"]): r["n"] for r in placed.groupBy("_arc", "_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards * vnodes * cells rows at most
    counts = [sum(counted.get((a, c), 0) for c in range(cells)) for a in range(len(points))]
    total = sum(counts)
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    intervals, used = [], [0] * shards
    start = {}
    for a in range(len(points)):
        at = 0
        for c in range(cells):
            start[a, c] = at
            at += counted.get((a, c), 0)
    for a, parts in enumerate(settle(counts, owner, caps)):
        for lo, n, s in parts:
            for c in range(cells):
                c_lo, c_n = start[a, c], counted.get((a, c), 0)
                x, y = max(lo, c_lo), min(lo + n, c_lo + c_n)
                if x < y:
                    intervals.append((a, c, x - c_lo, y - c_lo, s, used[s] + x - lo, s != owner[a]))
            used[s] += n
    plan = rows.sparkSession.createDataFrame(intervals, "_arc int, _cell int, _lo long, _hi long, shard int, _slot long, moved boolean")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_arc", "_cell").orderBy("_ring", text)) - 1)
    hit = [ranked["_arc"] == plan["_arc"], ranked["_cell"] == plan["_cell"], ranked["_rank"] >= plan["_lo"], ranked["_rank"] < plan["_hi"]]
    return ranked.join(F.broadcast(plan), hit).select(*[ranked[c] for c in rows.columns], ranked["_arc"].alias("arc"), plan["shard"], plan["moved"], (plan["_slot"] + ranked["_rank"] - plan["_lo"]).alias("slot"))


def max_in_slice(where: list[int], slices: int) -> int:
    """The most points that lie in one slice of the ring: how many comparisons settle an arc."""
    per: dict[int, int] = {}
    for p in where:
        per[p // (RING // slices)] = per.get(p // (RING // slices), 0) + 1
    return max(per.values())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = d.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = assign_shards(rows, "doc_id")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "arc", "moved")
