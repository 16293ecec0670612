"""Filling fixed-capacity containers with items: harmonic packing with refined classes.

With J tokens between neighbours, k items fit a container of C tokens iff their sizes, each
enlarged by J, add up to C + J at most. Lengths fall into reciprocal-capacity classes: class k
holds the items of which k, but not k + 1, of the largest kind fit. A bin filled from one class
takes a fixed number of items, whichever they are, so workers fill bins knowing only their items'
ranks. To leave less space, classes of few items per bin are refined into ``steps`` parts of the
capacity, and a bin's pattern may take fixed numbers from several classes:

1. count the items of each class (one small row per class, bounded by ``steps`` plus the reciprocal
   classes of a capacity, whatever the number of items);
2. plan patterns on these counts: the largest class left first, then the largest classes that
   still fit by their upper bounds; a pattern is repeated until one of its classes is used up;
3. rank the items of each class with no group in one task: ranks within hash slices of the
   items plus the slices' running totals;
4. rank and pattern give container and slot by arithmetic.

Defined results
* an item longer than the capacity is cut into full containers and a rest; no other is split;
* items without tokens (null or empty text) need no space: container and slot are null;
* the same item id twice is two items; ties are ordered by id; an empty table gives an empty result;
* a null or non-positive capacity is refused.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import Staging, parts_for

STEPS = 256
ROWS_PER_SLICE = 50_000
COARSE_FROM = 24  # classes with more items per bin than this are reciprocal classes only


def upper_bounds(room: int, steps: int = STEPS, coarse_from: int = COARSE_FROM) -> list[int]:
    """Upper bounds of the classes, ascending: reciprocals of the room for small items, refined for large ones."""
    fine = {room * i // steps for i in range(1, steps + 1) if room * i // steps > room // coarse_from}
    halves = {room // k for k in range(1, coarse_from + 1)}
    tiny, k = set(), coarse_from + 1
    while k <= room:
        b = room // k
        tiny.add(b)
        k = max(room // b + 1, k + 1 + k // 64)  # at most 1/64 of an item's size is given away
    return sorted(b for b in fine | halves | tiny if b > 0)


def plan(counts: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (repeats, [(class bound, items of it)]) that use up the counts."""
    left = {b: n for b, n in counts.items() if n > 0}
    out = []
    while left:
        free, use = room, []
        for b in sorted(left, reverse=True):
            k = min(free // b, left[b])
            if k:
                use.append((b, k))
                free -= k * b
            if not free:
                break
        repeat = min(left[b] // k for b, k in use)
        out.append((repeat, use))
        for b, k in use:
            left[b] -= repeat * k
            if not left[b]:
                del left[b]
    return out


def pieces(items: DataFrame, item_id: str, size: str, specs: list[tuple[int, int, int]]) -> DataFrame:
    """(pack_id, room, joint, item, piece, piece_tokens): items cut at each capacity; specs are (pack_id, capacity, joint)."""
    kinds = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("bigint").alias("capacity"), F.lit(j).cast("bigint").alias("joint")) for p, c, j in specs]))
    x = items.select(F.col(item_id).alias("item"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n"), kinds.alias("s")).select("item", "n", "s.*")
    whole = F.floor(F.col("n") / F.col("capacity")).cast("int")
    rest = F.col("n") % F.col("capacity")
    full = F.array_repeat(F.col("capacity"), whole)
    cut = F.when(F.col("n") <= F.col("capacity"), F.array("n")).when(rest > 0, F.concat(full, F.array(rest))).otherwise(full)
    return x.select("pack_id", (F.col("capacity") + F.col("joint")).alias("room"), "joint", "item", F.posexplode(cut).alias("p", "piece_tokens")).withColumn("piece", F.col("p") + 1).drop("p")


PACKED = "pack_id int, container_id bigint, slot int, item bigint, piece int, piece_tokens bigint"


def pack(items: DataFrame, item_id: str, size: str, spec: DataFrame, *, pack_id: str, capacity: str, joint: str, slices: int | None = None) -> DataFrame:
    """(pack_id, container_id, slot, item, piece, piece_tokens) for every item under every row of ``spec``.

    ``spec`` is collected: one row per kind of container, a bounded table. Items are ranked in ``slices`` by hash;
    their number follows from the number of items alone, so the same items give the same containers on any cluster.
    """
    spark = items.sparkSession
    rows = spec.select(F.col(pack_id).cast("int"), F.col(capacity).cast("bigint"), F.coalesce(F.col(joint).cast("bigint"), F.lit(0))).distinct().collect()
    if any(r[1] is None or r[1] <= 0 for r in rows):
        raise ValueError("capacities must be positive")
    rooms = {r[0]: (r[1] + r[2], upper_bounds(r[1] + r[2])) for r in rows}
    if not rows:
        return spark.createDataFrame([], PACKED)
    n = slices or parts_for(items.count(), ROWS_PER_SLICE)
    st = Staging(spark, "pack")
    cut = pieces(items, item_id, size, [tuple(r) for r in rows])
    bound_rows = spark.createDataFrame([(p, b, b2) for p, (_, bs) in rooms.items() for b, b2 in zip([0, *bs], bs)], "pack_id int, above bigint, bound bigint")
    size_of = F.col("piece_tokens") + F.col("joint")
    sizes = cut.filter("piece_tokens > 0").select("pack_id", "joint", "piece_tokens").distinct()
    # Different sizes are at most the capacities, so the class of each size is a bounded table.
    classes = F.broadcast(sizes.join(F.broadcast(bound_rows), "pack_id").filter((size_of > F.col("above")) & (size_of <= F.col("bound"))).select("pack_id", "piece_tokens", "bound"))
    sliced = cut.filter("piece_tokens > 0").join(classes, ["pack_id", "piece_tokens"]).withColumn("slice", F.pmod(F.xxhash64("item", "piece"), F.lit(n)))
    laid = st.put(sliced.select("pack_id", "item", "piece", "piece_tokens", "bound", "slice"))
    per = laid.groupBy("pack_id", "bound", "slice").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("pack_id", "bound").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per = st.put(per.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0))))  # one row per class and slice
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    for r in per.groupBy("pack_id", "bound").agg(F.sum("k").alias("n")).collect():  # one row per class
        counts[r[0]][r[1]] = r[2]
    uses = []
    for p, by_bound in counts.items():
        base = 0
        ranked: dict[int, int] = defaultdict(int)
        for repeat, use in plan(by_bound, rooms[p][0]):
            slot = 1
            for b, k in use:
                uses.append((p, b, ranked[b], ranked[b] + repeat * k, k, base, slot))
                ranked[b] += repeat * k
                slot += k
            base += repeat
    plan_df = F.broadcast(spark.createDataFrame(uses, "pack_id int, bound bigint, lo bigint, hi bigint, per_bin int, base bigint, first_slot int"))
    mine = Window.partitionBy("pack_id", "bound", "slice").orderBy("item", "piece")
    ranked_rows = laid.withColumn("r", F.row_number().over(mine)).join(per.select("pack_id", "bound", "slice", "before"), ["pack_id", "bound", "slice"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    hit = ranked_rows.join(plan_df, ["pack_id", "bound"]).filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    off = F.col("rank") - F.col("lo")
    placed = hit.select("pack_id", (F.col("base") + F.expr("(rank - lo) div per_bin") + 1).alias("container_id"), (F.col("first_slot") + off % F.col("per_bin")).cast("int").alias("slot"), "item", "piece", "piece_tokens")
    empty = cut.filter("piece_tokens = 0").select("pack_id", F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("slot"), "item", "piece", "piece_tokens")
    return placed.unionByName(empty)


def fill_report(packed: DataFrame, spec: DataFrame, pack_id: str, capacity: str, joint: str) -> DataFrame:
    """Containers, tokens and the share of space used, per kind of container."""
    per = packed.filter("container_id IS NOT NULL").groupBy("pack_id", "container_id").agg(F.sum("piece_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    s = F.broadcast(spec.select(F.col(pack_id).cast("int").alias("pack_id"), F.col(capacity).alias("c"), F.col(joint).alias("j")).distinct())
    x = per.join(s, "pack_id").withColumn("over", (F.col("t") + F.col("j") * (F.col("k") - 1) > F.col("c")).cast("bigint"))
    return x.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), F.sum("over").alias("n_overfull"), (F.sum("t") / F.sum("c")).alias("fill"), F.sum("k").alias("n_pieces")
    )

