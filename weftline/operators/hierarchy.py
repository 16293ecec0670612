"""Parent-child links to full hierarchies: peel leaves, Euler tours, parallel list ranking.

1. Deliveries are reduced to one row per node (the latest) and parents that name no node become null.
2. Leaves are peeled. Round k replaces each node's jump by its jump's jump, so the nodes still
   jumped to after round k are those that survive 2^k peelings of all leaves. What survives longer
   than a path can be lies on a cycle; what jumps into it only leads there. The rest are trees.
3. Each tree becomes an Euler tour: entering a node is followed by entering its first child or by
   leaving it, leaving it by entering its next sibling or by leaving its parent.
4. The tours are ranked by pointer doubling: each step adds the rank of the element pointed to and
   doubles the distance. Place in the tour gives entry and exit; the balance of entries and exits
   gives the depth; the tour's last element gives the root.
5. Entry-exit intervals answer the rest: u is an ancestor of v iff entry(u) < entry(v) < exit(u);
   (exit - entry) // 2 is the number of descendants.

Groups (a trace, a forest) of up to ``block_rows`` nodes are packed several to a block, and each
block runs steps 2 to 4 on arrays in one task. A larger group runs the same steps as joins over
all executors, so no group is ever gathered into one task. Each round of joins is written to the
shared folder, so a lost executor costs no recomputation of earlier rounds.

Defined results
* a node whose parent is null, no number, or names no node of its group is a root of depth 0;
* a node that names itself is a cycle of length one: root -1, depth -1;
* root -1 with depth -1 on a cycle, root -1 with depth -2 where only an ancestor lies on one;
* a null or unreadable node or group id is no node; siblings are ordered by node id, which may be any 64-bit number;
* repeated deliveries: the latest counts, ties by the greater parent (null least);
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.relational import numbered
from weftline.session import Staging, parts_for

TOUR = "grp bigint, node bigint, parent bigint, root bigint, depth bigint, entry bigint, exit bigint"
BLOCK_ROWS = 500_000
MOST_ROUNDS = 62  # 2^62 steps: more than any id space holds


def rank_block(grp: np.ndarray, node: np.ndarray, parent: np.ndarray, has_parent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Root, depth, entry, exit and parent's presence of whole groups given as arrays of unique (grp, node)."""
    n = len(node)
    order = np.lexsort((node, grp))
    grp, node, parent, has_parent = grp[order], node[order], parent[order], has_parent[order]
    up = _locate(grp, node, grp, parent, has_parent)
    at = np.arange(n)
    # Peel: jumps double; the image of the jumps shrinks to the roots and the cycles.
    jump = np.where(up < 0, at, up)
    for _ in range(max(1, int(n).bit_length())):
        jump = jump[jump]
    rooted = up[jump] < 0
    cyclic = np.zeros(n, bool)
    cyclic[jump[~rooted]] = True
    # Tours over the trees: element 2i enters node i, 2i + 1 leaves it.
    nxt = np.arange(2 * n)
    tree = np.flatnonzero(rooted)
    nxt[2 * tree] = 2 * tree + 1
    child = tree[up[tree] >= 0]
    if len(child):
        child = child[np.lexsort((child, up[child]))]
        above = up[child]
        first = np.r_[True, above[1:] != above[:-1]]
        nxt[2 * above[first]] = 2 * child[first]
        last = np.r_[first[1:], True]
        nxt[2 * child[last] + 1] = 2 * above[last] + 1
        nxt[2 * child[:-1][~first[1:]] + 1] = 2 * child[1:][~first[1:]]
    done = nxt == np.arange(2 * n)
    steps = np.where(done, 0, 1)
    rise = np.where(np.arange(2 * n) % 2 == 0, 1, -1)
    rise[done] = 0
    live = np.flatnonzero(~done)
    while len(live):
        to = nxt[live]
        steps[live] += steps[to]
        rise[live] += rise[to]
        nxt[live] = nxt[to]
        live = live[~done[nxt[live]]]
    enter, leave = 2 * at, 2 * at + 1
    tail = nxt[enter]
    top = tail // 2
    entry = steps[2 * top] - steps[enter]
    exit_ = steps[2 * top] - steps[leave]
    depth = 1 - rise[enter]  # the suffix from v on holds one leaving (the tail's is left out) per ancestor and v itself
    root = node[top]
    bad = ~rooted
    root, entry, exit_ = np.where(bad, -1, root), np.where(bad, -1, entry), np.where(bad, -1, exit_)
    depth = np.where(bad, np.where(cyclic, -1, -2), depth)
    return grp, node, np.where(up >= 0, parent, 0), up >= 0, root, depth, entry, exit_


def _locate(grp: np.ndarray, node: np.ndarray, want_grp: np.ndarray, want: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Index of each wanted (grp, node) in the sorted arrays, -1 if there is none."""
    n = len(node)
    _, gcode = np.unique(grp, return_inverse=True)
    values, ncode = np.unique(node, return_inverse=True)
    k = np.searchsorted(values, want)
    k[k == len(values)] = 0
    known = has & (values[k] == want)
    width = len(values) + 1
    keys = gcode.astype(np.int64) * width + ncode
    wanted = gcode.astype(np.int64) * width + k
    p = np.searchsorted(keys, wanted)
    p[p == n] = 0
    return np.where(known & (keys[p] == wanted), p, -1)


def _block(t: pa.Table) -> pa.Table:
    parent = t.column("parent").combine_chunks()
    has = parent.is_valid().to_numpy(zero_copy_only=False)
    filled = parent.fill_null(0).to_numpy(zero_copy_only=False)
    g, v, p, hp, root, depth, entry, exit_ = rank_block(t.column("grp").to_numpy().copy(), t.column("node").to_numpy().copy(), filled, has)
    names = ["grp", "node", "parent", "root", "depth", "entry", "exit"]
    cols = [pa.array(g), pa.array(v), pa.array(p, mask=~hp), *(pa.array(np.asarray(x, np.int64)) for x in (root, depth, entry, exit_))]
    return pa.table(dict(zip(names, cols)))


def nodes_of(df: DataFrame, grp: Column, node: Column, parent: Column, at: Column) -> DataFrame:
    """One row per node: (grp, node, parent), the latest delivery."""
    x = df.select(grp.alias("grp"), node.alias("node"), parent.alias("parent"), at.alias("at")).filter("grp IS NOT NULL AND node IS NOT NULL")
    best = x.groupBy("grp", "node").agg(F.max(F.struct("at", "parent")).alias("b"))
    return best.select("grp", "node", F.col("b.parent").alias("parent"))


def build_hierarchy(nodes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``nodes`` has unique (grp, node) with parent (all bigint). Result: columns ``TOUR``."""
    spark = nodes.sparkSession
    st = Staging(spark, "tour")
    one = st.put(nodes)
    sizes = one.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total, large = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > block_rows, 1))).first()
    blocks = parts_for(total, max(1, block_rows // 2), int(spark.conf.get("spark.sql.shuffle.partitions")) if total > 100_000 else 1)
    by_block = F.pmod(F.xxhash64("grp"), F.lit(blocks))
    small = one
    if large:  # at most total / block_rows groups: their ids are few beside the rows
        big = sizes.filter(F.col("n") > block_rows).select("grp")
        small = one.join(big, "grp", "left_anti")
    ranked = small.groupBy(by_block.alias("block")).applyInArrow(_block, TOUR)
    if not large:
        return ranked
    return ranked.unionByName(_ranked_by_joins(st, one.join(big, "grp", "left_semi")))


def _rounds(st: Staging, table: DataFrame, step, left: int) -> DataFrame:  # noqa: ANN001
    """Repeat ``step`` until it reports nothing moved; each round is a written table."""
    for k in range(MOST_ROUNDS):
        after = st.put(step(table))
        moved = after.filter("moved").limit(1).count()
        st.drop(table if k else None)
        table = after
        if not moved and k >= left:
            break
    return table


def _ranked_by_joins(st: Staging, nodes: DataFrame) -> DataFrame:
    """The same steps for groups too large for one task."""
    # Nodes are numbered over all groups, in order of group and id, so that any id leaves room for the enter and leave bit.
    ids = st.put(numbered(nodes, ["grp", "node"], "code").select("grp", "node", "parent", F.col("code").cast("bigint").alias("code")))
    n = ids.count()
    above = ids.select("grp", F.col("node").alias("parent"), F.col("code").alias("up"))
    linked = st.put(ids.join(above, ["grp", "parent"], "left").select("grp", F.col("code").alias("node"), F.col("up").alias("parent")))
    # Peel. A jump rests at a root; others double until they are longer than any path.
    jumps = linked.select("grp", "node", F.coalesce("parent", "node").alias("to"), F.col("parent").isNull().alias("rest"), F.lit(True).alias("moved"))

    def peel(t: DataFrame) -> DataFrame:
        far = t.select("grp", F.col("node").alias("to"), F.col("to").alias("to2"), F.col("rest").alias("rest2"))
        going = t.filter(~F.col("rest")).join(far, ["grp", "to"]).select("grp", "node", F.col("to2").alias("to"), F.col("rest2").alias("rest"), F.lit(True).alias("moved"))
        return going.unionByName(t.filter("rest").withColumn("moved", F.lit(False)))

    # Depths have no gaps and images only shrink: two rounds with the same numbers mean that all trees rest
    # and that the jumps only permute what is left, which then are the cycles.
    before = None
    for k in range(max(1, int(n).bit_length()) + 1):
        after = st.put(peel(jumps))
        st.drop(jumps if k else None)
        jumps = after
        now = tuple(jumps.filter(~F.col("rest")).agg(F.count(F.lit(1)), F.countDistinct("grp", "to")).first())
        if now == before or not now[0]:
            break
        before = now
    loose = jumps.filter(~F.col("rest"))
    on_cycle = loose.select("grp", F.col("to").alias("node")).distinct().withColumn("c", F.lit(1))
    none = F.lit(-1).cast("bigint")
    cycles = (
        loose.join(on_cycle, ["grp", "node"], "left")
        .join(linked, ["grp", "node"])
        .select("grp", "node", "parent", none.alias("root"), F.when(F.col("c") == 1, -1).otherwise(-2).cast("bigint").alias("depth"), none.alias("entry"), none.alias("exit"))
    )
    trees = st.put(linked.join(jumps.filter("rest").select("grp", "node"), ["grp", "node"], "left_semi"))
    tour = _tour(st, trees).select("grp", "elem", "next", F.col("last").alias("rest"), F.when(F.col("last"), 0).otherwise(1).cast("bigint").alias("steps"), F.when(F.col("last"), 0).otherwise(F.col("way")).cast("bigint").alias("rise"), F.lit(True).alias("moved"))

    def double(t: DataFrame) -> DataFrame:
        far = t.select("grp", F.col("elem").alias("next"), F.col("next").alias("n2"), F.col("rest").alias("r2"), F.col("steps").alias("s2"), F.col("rise").alias("h2"))
        going = (
            t.filter(~F.col("rest"))
            .join(far, ["grp", "next"])
            .select("grp", "elem", F.col("n2").alias("next"), F.col("r2").alias("rest"), (F.col("steps") + F.col("s2")).alias("steps"), (F.col("rise") + F.col("h2")).alias("rise"), (~F.col("r2")).alias("moved"))
        )
        return going.unionByName(t.filter("rest").withColumn("moved", F.lit(False)))

    # An element that has come to its tour's last one rests; its steps and rise are final.
    ranked = _rounds(st, tour, double, 0)
    root_steps = ranked.filter((F.col("elem") % 2 == 0) & (F.shiftright("elem", 1) == F.shiftright("next", 1))).select("grp", F.col("next").alias("tail"), F.col("steps").alias("all_steps"))
    ways = ranked.withColumn("tail", F.col("next")).join(root_steps, ["grp", "tail"]).withColumn("place", F.col("all_steps") - F.col("steps"))
    entering = F.col("elem") % 2 == 0
    flat = ways.groupBy("grp", F.shiftright("elem", 1).alias("node0")).agg(
        F.max(F.shiftright("tail", 1)).alias("root0"), F.max(F.when(entering, 1 - F.col("rise"))).alias("depth"), F.max(F.when(entering, F.col("place"))).alias("entry"), F.max(F.when(~entering, F.col("place"))).alias("exit")
    )
    real = ids.join(linked.select("grp", F.col("node").alias("code"), F.col("parent").alias("up")), ["grp", "code"])
    real = real.select("grp", F.col("code").alias("node0"), "node", F.when(F.col("up").isNotNull(), F.col("parent")).alias("parent"))
    named = flat.join(real, ["grp", "node0"]).join(ids.select("grp", F.col("code").alias("root0"), F.col("node").alias("root")), ["grp", "root0"])
    loops = cycles.withColumnsRenamed({"node": "node0"}).drop("parent").join(real, ["grp", "node0"])
    order = ["grp", "node", "parent", "root", "depth", "entry", "exit"]
    done = st.put(named.select(*order).unionByName(loops.select(*order)))
    st.drop(ids, jumps, linked, trees, ranked)
    return done


def _tour(st: Staging, trees: DataFrame) -> DataFrame:
    """Elements (grp, elem, next, last, way): elem 2v enters v, 2v + 1 leaves it. Siblings are found by a
    global sort, so a node with a third of all rows as children is spread over the partitions."""
    kids = trees.filter(F.col("parent").isNotNull())
    sib = _next_sibling(st, kids)
    first = kids.groupBy("grp", F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    enter = trees.join(first, ["grp", "node"], "left").select("grp", (F.col("node") * 2).alias("elem"), F.coalesce(F.col("child") * 2, F.col("node") * 2 + 1).alias("next"), F.lit(False).alias("last"), F.lit(1).alias("way"))
    leave = sib.select("grp", (F.col("node") * 2 + 1).alias("elem"), F.coalesce(F.col("after") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(False).alias("last"), F.lit(-1).alias("way"))
    ends = trees.filter(F.col("parent").isNull()).select("grp", (F.col("node") * 2 + 1).alias("elem"), (F.col("node") * 2 + 1).alias("next"), F.lit(True).alias("last"), F.lit(-1).alias("way"))
    return st.put(enter.unionByName(leave).unionByName(ends))


def _next_sibling(st: Staging, kids: DataFrame) -> DataFrame:
    """(grp, node, parent, after): the next child of the same parent, by id, or null."""
    parts = max(2, int(kids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunk = kids.repartitionByRange(parts, "grp", "parent", "node").withColumn("pid", F.spark_partition_id())
    laid = st.put(chunk)
    heads = laid.groupBy("pid").agg(F.min(F.struct("grp", "parent", "node")).alias("h"))
    # One row per partition: the first child of the next partition follows this partition's last.
    w = Window.orderBy("pid")
    follow = heads.select("pid", F.lead("h").over(w).alias("f"))
    inside = Window.partitionBy("pid").orderBy("grp", "parent", "node")
    x = laid.withColumn("l", F.lead(F.struct("grp", "parent", "node")).over(inside)).join(F.broadcast(follow), "pid")
    nxt = F.coalesce("l", "f")
    same = (nxt["grp"] == F.col("grp")) & (nxt["parent"] == F.col("parent"))
    return x.select("grp", "node", "parent", F.when(same, nxt["node"]).alias("after"))


# ---------------------------------------------------------------- answers from the intervals


def _stacks(table: str) -> object:
    """Linear scan of tours in order: the open intervals are the ancestors of the element at hand."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[int, int]] = []
        chunk, tree = None, None
        for b in batches:
            out: list[tuple] = []
            for pid, seed, grp, root, node, entry, exit_ in zip(*(b.column(i).to_pylist() for i in range(7))):
                if pid != chunk or (grp, root) != tree:
                    stack, chunk, tree = [], pid, (grp, root)
                while stack and stack[-1][1] < entry:
                    stack.pop()
                if not seed:
                    if table == "path":
                        out.append((grp, node, "/".join([*(str(v) for v, _ in stack), str(node)])))
                    else:
                        out += [(grp, v, node, k) for k, (v, _) in zip(range(len(stack), 0, -1), stack)]
                stack.append((node, exit_))
                if len(out) >= 100_000:
                    yield _rows(out, table)
                    out = []
            yield _rows(out, table)

    return run


def _rows(out: list[tuple], table: str) -> pa.RecordBatch:
    names = ["grp", "node", "path"] if table == "path" else ["grp", "ancestor", "node", "distance"]
    kinds = [pa.int64(), pa.int64(), pa.string()] if table == "path" else [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    cols = list(zip(*out)) if out else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)


def _scan(tours: DataFrame, table: str, schema: str) -> DataFrame:
    """Tours are cut into ranges of (grp, root, entry); each range is seeded with the intervals open at its start."""
    spark = tours.sparkSession
    st = Staging(spark, "scan")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    trees = tours.filter("entry >= 0").select("grp", "root", "node", "entry", "exit")
    laid = st.put(trees.repartitionByRange(parts, "grp", "root", "entry").withColumn("pid", F.spark_partition_id()))
    heads = laid.groupBy("pid").agg(F.min(F.struct("grp", "root", "entry")).alias("h")).select("pid", "h.*")
    h = F.broadcast(heads.select(F.col("pid").alias("hp"), F.col("grp").alias("hg"), F.col("root").alias("hr"), F.col("entry").alias("he")))
    # At most one head per partition, so this side is bounded by the number of partitions.
    open_ = laid.join(h, (F.col("grp") == F.col("hg")) & (F.col("root") == F.col("hr")) & (F.col("entry") < F.col("he")) & (F.col("exit") > F.col("he")))
    rows = laid.select("pid", F.lit(False).alias("seed"), "grp", "root", "node", "entry", "exit").unionByName(open_.select(F.col("hp").alias("pid"), F.lit(True).alias("seed"), "grp", "root", "node", "entry", "exit"))
    ordered = rows.repartition(parts, "pid").sortWithinPartitions("pid", "grp", "root", "entry")
    return ordered.mapInArrow(_stacks(table), schema)


def paths(tours: DataFrame) -> DataFrame:
    """(grp, node, path): node ids from the root down, joined by ``/``; unrooted nodes have none."""
    return _scan(tours, "path", "grp bigint, node bigint, path string")


def descendants(tours: DataFrame) -> DataFrame:
    """(grp, ancestor, node, distance) for every node below every node."""
    return _scan(tours, "pairs", "grp bigint, ancestor bigint, node bigint, distance int")
