"""Sparse labelled matrices as DataFrames (i, j, v) with v != 0 and unique (i, j).

Products are equi-joins on the inner index with aggregation before and after the shuffle; nothing is
made dense. Tri-state cells keep ``known`` beside ``support``: unknown is never false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.relational import numbered, pairs_within
from weftline.session import Staging, parts_for


def from_pairs(df: DataFrame, row: str, col: str) -> DataFrame:
    """0/1 incidence of distinct pairs."""
    return df.select(F.col(row).alias("i"), F.col(col).alias("j")).filter("i IS NOT NULL AND j IS NOT NULL").distinct().withColumn("v", F.lit(1.0))


def from_counts(df: DataFrame, row: str, col: str) -> DataFrame:
    return df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("i"), F.col(col).alias("j")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """A x B; cells that cancel to 0 vanish."""
    x = a.select("i", F.col("j").alias("k"), F.col("v").alias("va")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb")), "k")
    return x.groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v")).filter("v <> 0")


def hadamard(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("i", "j", F.col("v").alias("va")).join(b.select("i", "j", F.col("v").alias("vb")), ["i", "j"])
    return x.select("i", "j", (F.col("va") * F.col("vb")).alias("v")).filter("v <> 0")


def threshold(m: DataFrame) -> DataFrame:
    """Every non-zero cell becomes 1."""
    return m.filter("v <> 0").select("i", "j", F.lit(1.0).alias("v"))


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.sum("v").alias("v"))


def nnz_and_sum(m: DataFrame) -> DataFrame:
    return m.agg(F.count(F.lit(1)).alias("nnz"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"))


def matrix_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    """M x v for v(j, v)."""
    return m.join(v.select("j", F.col("v").alias("w")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v")).filter("v <> 0")


def gram(m: DataFrame, block_rows: int = 4096, block_cells: int = 1 << 17) -> DataFrame:
    """M x M': the triangle i <= j, then mirrored.

    Where few rows share a column, by a join on the inner index and a sum per cell. Where columns are so full that the
    products are more than the cells that all pairs of row blocks read, they are multiplied in blocks, and no product
    is shuffled.
    """
    st = Staging(m.sparkSession, "gram")
    m = st.put(m.filter("i IS NOT NULL AND j IS NOT NULL AND v IS NOT NULL").select("i", "j", "v"))
    if dict(m.dtypes)["v"] == "double":
        n = F.col("n").cast("double")
        products = m.groupBy("j").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(n * (n + 1) / 2), F.lit(0.0))).first()[0]
        cells, rows = m.count(), m.select("i").distinct().count()
        if products > cells * (1 + rows / block_rows + cells / block_cells):
            return _gram_blocks(st, m, rows, block_rows, block_cells)
    x = m.select("i", F.col("j").alias("k"), F.col("v").alias("va")).join(m.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("vb")), "k").filter("i <= j")
    half = x.groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v")).filter("v <> 0")
    cell = lambda a, b: F.struct(F.col(a).alias("i"), F.col(b).alias("j"))
    return half.select(F.explode(F.when(F.col("i") == F.col("j"), F.array(cell("i", "j"))).otherwise(F.array(cell("i", "j"), cell("j", "i")))).alias("c"), "v").select("c.i", "c.j", "v")


def _gram_blocks(st: Staging, m: DataFrame, n_rows: int, block_rows: int, block_cells: int) -> DataFrame:
    """The product of each pair of blocks of rows in one task; rows of the same cells are one class in a block.

    A task gives rectangles (all members of classes with one value), which are spread into cells as they are written.
    """
    kind = dict(m.dtypes)
    own = m.groupBy("i").agg(F.sort_array(F.collect_list(F.struct(F.col("j").alias("k"), "v"))).alias("c"))
    laid = st.put(own.withColumn("h", F.xxhash64("c")))
    hot = laid.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / (16 * block_rows)).cast("int").alias("s")).filter("s > 1")  # few: each has many rows
    near = laid.join(F.broadcast(hot), "h", "left").repartition(parts_for(n_rows, 8 * block_rows), "h", F.pmod(F.xxhash64("i"), F.coalesce("s", F.lit(1)))).sortWithinPartitions("h").select("i", "c")
    packed = st.put(near.mapInArrow(_packer(block_rows, block_cells), f"block bigint, labels array<{kind['i']}>, sizes array<int>, lens array<int>, ks array<{kind['j']}>, vs array<double>"))
    ids = packed.select("block").withColumn("b", F.row_number().over(Window.orderBy("block")) - 1)  # one row per block
    blocks = st.put(packed.join(F.broadcast(ids), "block").drop("block"))
    n = blocks.count()
    pairs = n * (n + 1) // 2
    parts = max(1, min(pairs, 4000))
    b, k = F.col("b").cast("bigint"), F.col("k").cast("bigint")
    left = blocks.withColumn("k", F.explode(F.sequence("b", F.lit(n - 1)))).withColumn("pair", F.expr("CAST(k AS BIGINT) * (k + 1) div 2 + b")).withColumn("side", F.when(b == k, 2).otherwise(0))
    right = blocks.filter("b > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).withColumn("pair", F.expr("CAST(b AS BIGINT) * (b + 1) div 2 + k")).withColumn("side", F.lit(1))
    met = left.unionByName(right).repartitionById(parts, (F.col("pair") % parts).cast("int")).sortWithinPartitions("pair", "side").select("side", "labels", "sizes", "lens", "ks", "vs")
    boxes = met.mapInArrow(_multiplier, f"x array<{kind['i']}>, y array<{kind['i']}>, v double")
    return boxes.select(F.explode("x").alias("i"), "y", "v").select("i", F.explode("y").alias("j"), "v")


def _listed(values: pa.Array, lens: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32()), values)


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one after another."""
    return np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())


def _packer(block_rows: int, block_cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lens = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(1).flatten()
            ends = np.cumsum(lens)
            k, v = flat.field(0), flat.field(1).to_numpy(zero_copy_only=False)
            code = k.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            weight = np.cumsum(1 / block_rows + lens / block_cells)
            piece = np.minimum(np.ceil(weight[-1:]) - 1, weight * np.ceil(weight[-1:]) / weight[-1:]).astype(int) if len(lens) else lens
            for rows in np.split(np.arange(len(lens)), np.flatnonzero(np.diff(piece)) + 1) if len(lens) else []:
                classes: dict[tuple[bytes, bytes], list[int]] = {}
                for r in rows:
                    at = slice(ends[r] - lens[r], ends[r])
                    classes.setdefault((code[at].tobytes(), v[at].tobytes()), []).append(r)
                members, one = list(classes.values()), np.array([x[0] for x in classes.values()])
                sizes, at = np.array([len(x) for x in members]), _spans(ends[one] - lens[one], lens[one])
                cols = (batch.column(0).take(pa.array(np.concatenate(members))), pa.array(sizes, pa.int32()), pa.array(lens[one], pa.int32()), k.take(pa.array(at)), pa.array(v[at]))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[_listed(c, np.array([len(c)])) for c in cols]], ["block", "labels", "sizes", "lens", "ks", "vs"])
                number += 1

    return run


def _products(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], n_a: int, n_b: int) -> np.ndarray:
    """The dense product of two sets of rows (row, column, value); cells given twice are added."""
    common = np.intersect1d(a[1], b[1])
    (ra, ka, va), (rb, kb, vb) = ((r[x], np.searchsorted(common, k[x]), v[x]) for r, k, v in (a, b) for x in [np.isin(k, common)])
    out = np.zeros((n_a, n_b))
    held = np.bincount(kb, minlength=len(common))
    if n_a * n_b * len(common) <= 64 * held[ka].sum() and np.isfinite(va).all() and np.isfinite(vb).all():
        for k in range(0, len(common), 512):
            part = []
            for r, c, v, n in ((ra, ka, va, n_a), (rb, kb, vb, n_b)):
                w = min(512, len(common) - k)
                x = (c >= k) & (c < k + w)
                part.append(np.bincount(r[x] * w + c[x] - k, v[x], n * w).reshape(n, w))
            out += part[0] @ part[1].T
        return out
    order = np.argsort(kb, kind="stable")
    rb, vb, starts = rb[order], vb[order], np.cumsum(held) - held
    n = held[ka]
    for x in np.split(np.arange(len(ka)), np.flatnonzero(np.diff(np.cumsum(n) // (1 << 21))) + 1):
        to = _spans(starts[ka[x]], n[x])
        out += np.bincount(np.repeat(ra[x], n[x]) * n_b + rb[to], np.repeat(va[x], n[x]) * vb[to], n_a * n_b).reshape(n_a, n_b)
    return out


def _boxes(g: np.ndarray, first: int, a: tuple, b: tuple, mirror: bool) -> Iterator[pa.RecordBatch]:
    """Rectangles of the cells of ``g`` that are not 0: a class of a from ``first`` on by all classes of b with one value. a, b: labels, their starts and numbers by class."""
    plain = g.size and np.isfinite(g).all() and g.min() >= 0 and g.max() < 1 << 16 and (g == np.floor(g)).all()
    order = np.argsort(g.astype(np.uint16) if plain else g, axis=1, kind="stable" if plain else None)
    v = np.take_along_axis(g, order, 1)
    new = np.ones(v.shape, bool)
    new[:, 1:] = v[:, 1:] != v[:, :-1]
    keep = v != 0
    row, cls, v = np.nonzero(keep)[0] + first, order[keep], v[keep]
    begin = np.flatnonzero(new[keep])
    if not len(begin):
        return
    n_x, per = a[2][row[begin]], np.diff(begin, append=len(row))
    n_y = np.add.reduceat(b[2][cls], begin)
    for box in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(np.cumsum(n_x + n_y) // (1 << 21))) + 1):
        own = cls[begin[box[0]] : begin[box[-1]] + per[box[-1]]]
        x = _listed(a[0].take(pa.array(_spans(a[1][row[begin[box]]], n_x[box]))), n_x[box])
        y = _listed(b[0].take(pa.array(_spans(b[1][own], b[2][own]))), n_y[box])
        value = pa.array(v[begin[box]])
        yield pa.RecordBatch.from_arrays([x, y, value], ["x", "y", "v"])
        if mirror:
            yield pa.RecordBatch.from_arrays([y, x, value], ["x", "y", "v"])


def _multiplier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: tuple = ()
    for batch in batches:
        for i in range(batch.num_rows):
            side = batch.column(0)[i].as_py()
            labels, sizes, lens, ks, vs = (c[i].values for c in batch.columns[1:])
            sizes, lens, vs = (x.to_numpy(zero_copy_only=False) for x in (sizes, lens, vs))
            sizes, lens = sizes.astype(np.int64), lens.astype(np.int64)
            block = (labels, np.cumsum(sizes) - sizes, sizes), lens, ks, vs
            if side == 0:
                kept = block
                continue
            (a, len_a, ks_a, va), (b, len_b, ks_b, vb) = (kept if side == 1 else block), block
            code = pa.concat_arrays([ks_a, ks_b]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ra, rb = np.repeat(np.arange(len(len_a)), len_a), np.repeat(np.arange(len(len_b)), len_b)
            step = max(1, (1 << 21) // len(b[0]))
            for r in range(0, len(len_a), step):
                n = min(step, len(len_a) - r)
                x = slice(*np.searchsorted(ra, [r, r + n]))
                g = _products((ra[x] - r, code[: len(ra)][x], va[x]), (rb, code[len(ra) :], vb), n, len(len_b))
                if side == 2:  # of a block by itself the upper triangle, and the diagonal once
                    yield from _boxes(np.where(np.eye(n, len(len_b), r, dtype=bool), g, 0.0), r, a, b, False)
                    g = np.triu(g, r + 1)
                yield from _boxes(g, r, a, b, True)


def dot(u: DataFrame, v: DataFrame) -> DataFrame:
    """One row: the product of two vectors (j, v); 0 where they share no place."""
    x = u.join(v.select("j", F.col("v").alias("w")), "j")
    return x.agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("v"))


def vector_or(u: DataFrame, v: DataFrame) -> DataFrame:
    """Places that are not zero in one of two vectors (j, v), as ones."""
    return u.unionByName(v).filter("v <> 0").select("j", F.lit(1.0).alias("v")).distinct()


def select_rows(m: DataFrame, basis: DataFrame) -> DataFrame:
    """Rows named by a one-hot basis (i)."""
    return m.join(basis.select("i").distinct(), "i", "left_semi")


def grow_axis(axis: DataFrame, labels: DataFrame) -> DataFrame:
    """An axis (label, at) with new labels appended after the last place, in their order; no label is lost."""
    old = axis.select("label", F.col("at").cast("bigint").alias("at"))
    new = labels.select("label").filter("label IS NOT NULL").distinct().join(old, "label", "left_anti")
    end = old.agg(F.coalesce(F.max("at"), F.lit(-1)).alias("end"))
    return old.unionByName(numbered(new, ["label"], "n").crossJoin(F.broadcast(end)).select("label", (F.col("n") + F.col("end")).cast("bigint").alias("at")))


def grow(m: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """The same cells in a larger shape; a smaller one is refused."""
    if new[0] < old[0] or new[1] < old[1]:
        raise ValueError("a matrix cannot shrink")
    return m


def boolean_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of A x B that are not zero for 0/1 matrices, as ones: a join of row sets."""
    x = a.filter("v <> 0").select("i", F.col("j").alias("k")).join(b.filter("v <> 0").select(F.col("i").alias("k"), "j"), "k")
    return x.select("i", "j").distinct().withColumn("v", F.lit(1.0))


def column_any(m: DataFrame) -> DataFrame:
    """Columns with a cell that is not zero."""
    return m.filter("v <> 0").select("j").distinct()


def column_counts(m: DataFrame) -> DataFrame:
    """Cells that are not zero per column."""
    return m.filter("v <> 0").groupBy("j").agg(F.count(F.lit(1)).alias("n"))


def project_checked(v: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """v x M for v(i, k, v) and M(k, j, v), sums correctly rounded from 38 digits, and the keys of v that M lacks.

    A key that occurs twice in one row of v is refused.
    """
    twice = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("a key occurs twice in one row"))).otherwise(F.first("v"))
    one = v.groupBy("i", "k").agg(twice.alias("v"))
    x = one.join(m.select("k", "j", F.col("v").alias("w")), "k")
    exact = F.sum((F.col("v") * F.col("w")).cast("decimal(28,9)")).cast("double")
    return x.groupBy("i", "j").agg(exact.alias("v")), one.select("k").distinct().join(m.select("k").distinct(), "k", "left_anti")


def resolve(refs: DataFrame, defs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """References with their definitions, and the keys that have none."""
    return refs.join(defs, key), refs.select(key).distinct().join(defs.select(key).distinct(), key, "left_anti")


def basis_overlap(atoms: DataFrame, ids: DataFrame) -> DataFrame:
    """(atom, id, n_direct, n_all): how many basis elements an atom shares with an id, by direct evidence and at all.

    atoms(atom, basis, direct boolean), ids(id, basis).
    """
    a = atoms.groupBy("atom", "basis").agg(F.bool_or("direct").alias("direct"))
    x = a.join(ids.select("id", "basis").distinct(), "basis")
    return x.groupBy("atom", "id").agg(F.count_if(F.col("direct")).alias("n_direct"), F.count(F.lit(1)).alias("n_all"))


def design_audit(x: DataFrame, effect: DataFrame) -> tuple[DataFrame, DataFrame]:
    """X'X with bounds and X'E of a 0/1 design.

    x(i, j) and effect(i, e) are sets of pairs. First: (a, b, n_both, least, most), what two columns share beside
    what their sizes allow at least and at most. Second: (j, e, n).
    """
    p = x.select("i", "j").distinct()
    rows = p.select("i").distinct().agg(F.count(F.lit(1)).alias("n_rows"))
    size = p.groupBy("j").agg(F.count(F.lit(1)).alias("n"))
    both = pairs_within(p, ["i"], "j").groupBy(F.col("j_a").alias("a"), F.col("j_b").alias("b")).agg(F.count(F.lit(1)).alias("n_both"))
    y = both.join(size.select(F.col("j").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("j").alias("b"), F.col("n").alias("nb")), "b").crossJoin(F.broadcast(rows))
    bounds = y.select("a", "b", "n_both", F.greatest(F.col("na") + F.col("nb") - F.col("n_rows"), F.lit(0)).alias("least"), F.least("na", "nb").alias("most"))
    return bounds, p.join(effect.select("i", "e").distinct(), "i").groupBy("j", "e").agg(F.count(F.lit(1)).alias("n"))


def l1_normalize(m: DataFrame) -> DataFrame:
    """Rows divided by their sums; negative and non-finite cells are refused, all-zero rows have none."""
    bad = F.isnan("v") | (F.abs(F.col("v")) == float("inf")) | (F.col("v") < 0)
    x = m.withColumn("v", F.when(bad, F.raise_error(F.lit("cells must be finite and not negative"))).otherwise(F.col("v")))
    s = x.groupBy("i").agg(F.sum("v").alias("s"))
    return x.join(s, "i").select("i", "j", (F.col("v") / F.col("s")).alias("v"))


def row_stochastic(m: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(i, is_stochastic)."""
    return m.groupBy("i").agg((F.abs(F.sum("v") - 1) < tolerance).alias("is_stochastic"))


def validate_coo(m: DataFrame, rows: int, cols: int) -> DataFrame:
    """Faults (i, j, fault): zero, out_of_range, duplicate; an empty result is a valid matrix."""
    zero = m.filter("v = 0 OR v IS NULL").select("i", "j", F.lit("zero").alias("fault"))
    out = m.filter((F.col("i") < 0) | (F.col("i") >= rows) | (F.col("j") < 0) | (F.col("j") >= cols)).select("i", "j", F.lit("out_of_range").alias("fault"))
    dup = m.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("i", "j", F.lit("duplicate").alias("fault"))
    return zero.unionByName(out).unionByName(dup)


def one_hot_faults(planes: DataFrame) -> DataFrame:
    """Cells (i, j) that hold other than one status."""
    return planes.groupBy("i", "j").agg(F.countDistinct("status").alias("n_status")).filter("n_status <> 1")


def unpivot_coo(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """A wide table as (i, j, v), zeros and nulls left out."""
    x = df.select(F.col(row).alias("i"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot("i", columns, "j", "v")
    return x.filter("v <> 0")


def numeric_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, is_numeric): every value reads as a number; a column of nulls is none."""
    one = df.agg(*[(F.coalesce(F.bool_and(F.col(c).cast("string").try_cast("double").isNotNull()), F.lit(False))).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "is_numeric")


# ---------------------------------------------------------------- requirements against support


def deficits(required: DataFrame, support: DataFrame) -> DataFrame:
    """(need, target, n_supported, d): S and D = R (K - S)' over known features, by one join on the feature.

    required(need, feature); support(target, feature, supported boolean), null or absent is unknown. Pairs without
    a known required feature have no row.
    """
    known = support.filter("supported IS NOT NULL").groupBy("target", "feature").agg(F.bool_or("supported").alias("supported"))
    x = required.select("need", "feature").distinct().join(known, "feature")
    return x.groupBy("need", "target").agg(F.count_if(F.col("supported")).alias("n_supported"), F.count_if(~F.col("supported")).alias("d"))


def plan_targets(required: DataFrame, support: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (need, target): how many required features are supported, missing and unknown.

    The counts come from ``deficits``; unknown is what is left of a need's size, so features are never paired
    with all targets. The result itself has a row per need and target.
    """
    size = required.select("need", "feature").distinct().groupBy("need").agg(F.count(F.lit(1)).alias("n_need"))
    grid = size.crossJoin(targets.select("target").distinct())
    x = grid.join(deficits(required, support), ["need", "target"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return x.select("need", "target", n("n_supported").alias("n_supported"), n("d").alias("n_missing"), (F.col("n_need") - n("n_supported") - n("d")).alias("n_unknown"))


def eligible(plan: DataFrame) -> DataFrame:
    """Plans with nothing missing and nothing unknown."""
    return plan.filter("n_missing = 0 AND n_unknown = 0").select("need", "target")


def demand_gate(required: DataFrame, support: DataFrame, targets: DataFrame) -> DataFrame:
    """(need, target, missing, unknown): sorted labels of what stands in the way."""
    need = required.select("need", "feature").distinct()
    grid = need.select("need").distinct().crossJoin(targets.select("target").distinct()).join(need, "need")
    x = grid.join(support.select("target", "feature", "supported"), ["target", "feature"], "left")
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("feature").cast("string")))), ";")
    out = x.groupBy("need", "target").agg(labels(~F.col("supported")).alias("missing"), labels(F.col("supported").isNull()).alias("unknown"))
    return out.filter("missing <> '' OR unknown <> ''")


def argmax_class(scores: DataFrame, default: str) -> DataFrame:
    """Per i the label j of the greatest score, ties by the least label; the default where no score is positive."""
    best = scores.groupBy("i").agg(F.max(F.when(F.col("v") > 0, F.col("v"))).alias("m"))
    hit = scores.join(best, "i").groupBy("i").agg(F.min(F.when(F.col("v") == F.col("m"), F.col("j"))).alias("label"))
    return hit.select("i", F.coalesce(F.col("label"), F.lit(default)).alias("label"))


def affine(x: Column, y: Column, row: tuple[float, float, float]) -> Column:
    """One output of [x, y, 1] x A."""
    return x * row[0] + y * row[1] + row[2]
