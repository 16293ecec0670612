"""Evidence dataflow: joins, quotients, de-duplication, windows and set operations over DataFrames.

Nulls follow SQL unless a function says otherwise; ties are broken by the columns named, so results
do not depend on the order of arrival. Extra columns pass through only where a function says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import Staging

# ---------------------------------------------------------------- de-duplication and latest rows


def origins(df: DataFrame, key: str, origin: Column) -> DataFrame:
    """(key, origin, n_members): what a key was found in, a row per origin, whatever their number."""
    return df.groupBy(key, origin.alias("origin")).agg(F.count(F.lit(1)).alias("n_members"))


def dedup_with_provenance(df: DataFrame, key: str, order: str, provenance: Column, sep: str = "|") -> DataFrame:
    """One row per ``key``, the one with the least ``order``; ``provenance`` joins all sorted distinct origins.

    Null keys form one group. The joined text is for origins of a bounded set (sources, kinds); where each row has
    its own, take ``origins``, which gives them as rows.
    """
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__b"))
    first = best.select(key, *[F.col(f"__b.{c}").alias(c) for c in rest])
    origin = origins(df, key, provenance).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("origin")), sep).alias("provenance"), F.sum("n_members").alias("n_members"))
    return first.join(origin.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k"))).drop("__k")


def latest_wins(df: DataFrame, keys: Sequence[str], priority: Sequence[str]) -> DataFrame:
    """Per key the row with the greatest priority; one partial aggregation, no sort of the groups."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*priority)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the row with the least order."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def argmin_with_ties(df: DataFrame, keys: Sequence[str], cost: Sequence[str]) -> DataFrame:
    """Per key the rows of least cost and how many they are; more than one is an ambiguity."""
    per = df.groupBy(*keys, *cost).agg(F.count(F.lit(1)).alias("n_ties"))
    best = per.groupBy(*keys).agg(F.min(F.struct(*cost, "n_ties")).alias("__m")).select(*keys, "__m.*")
    return df.join(best, [*keys, *cost])


# ---------------------------------------------------------------- quotients


def quotient(df: DataFrame, member: str, attributes: Sequence[str], prefix: str) -> DataFrame:
    """Classes of equal attribute vectors: (class_id, attributes, n_members). Ids follow the sorted vectors."""
    classes = df.groupBy(*attributes).agg(F.countDistinct(member).alias("n_members"))
    return numbered(classes, attributes, "__n").withColumn("class_id", F.format_string(prefix + "%05d", "__n")).drop("__n")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 1 in a total order, by ranges: a row's number is its place in its range plus the rows of the ranges before."""
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = Staging(spark, "numbered").put(df.repartitionByRange(parts, *order).withColumn("__pid", F.spark_partition_id()))
    ahead = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = laid.groupBy("__pid").agg(F.count(F.lit(1)).alias("__k")).select("__pid", F.coalesce(F.sum("__k").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__pid").orderBy(*order)
    return laid.withColumn(name, F.row_number().over(inside)).join(F.broadcast(before), "__pid").withColumn(name, F.col(name) + F.col("__before")).drop("__pid", "__before")


def set_quotient(pairs: DataFrame, row: str, col: str) -> DataFrame:
    """Rows of a 0/1 matrix with the same set of columns: (signature, n_members, first_member)."""
    sig = pairs.groupBy(row).agg(F.array_join(F.array_sort(F.collect_set(F.col(col).cast("string"))), "\x1f").alias("__s"))
    return sig.groupBy(F.substring(F.sha2("__s", 256), 1, 16).alias("signature")).agg(F.count(F.lit(1)).alias("n_members"), F.min(row).alias("first_member"))


# ---------------------------------------------------------------- joins


def containment_join(need: DataFrame, have: DataFrame, need_id: str, have_id: str, item: str) -> DataFrame:
    """(need_id, have_id): every item needed is had; empty needs give no row.

    Each need meets only the holders of its rarest item; the other items are then looked up for those pairs.
    """
    n, h = need.select(need_id, item).distinct(), have.select(have_id, item).distinct()
    held = h.groupBy(item).agg(F.count(F.lit(1)).alias("__f"))
    per = n.join(held, item, "left").groupBy(need_id).agg(F.count(F.lit(1)).alias("__need"), F.min(F.struct(F.coalesce("__f", F.lit(0)).alias("f"), F.col(item).alias("i"))).alias("__r"))
    rare = per.filter("__r.f > 0").select(need_id, "__need", F.col("__r.i").alias(item))
    met = rare.join(h, item)
    alone = met.filter("__need = 1").select(need_id, have_id)
    rest = n.join(rare.select(need_id, item), [need_id, item], "left_anti")
    hit = met.filter("__need > 1").select(need_id, have_id, "__need").join(rest, need_id).join(h, [have_id, item], "left_semi")
    full = hit.groupBy(need_id, have_id).agg(F.first("__need").alias("__need"), F.count(F.lit(1)).alias("__hit")).filter("__hit = __need - 1")
    return alone.unionByName(full.select(need_id, have_id))


def vector_relations(pairs: DataFrame, vector: str, place: str) -> DataFrame:
    """EXACT or IMPLICATION between 0/1 vectors a < b that share a place, from joint counts."""
    p = pairs.select(vector, place).distinct()
    n = p.groupBy(vector).agg(F.count(F.lit(1)).alias("n"))
    met = pairs_within(p.select(F.col(place).alias("p"), F.col(vector).alias("v")), ["p"], "v")
    both = met.groupBy(F.col("v_a").alias("a"), F.col("v_b").alias("b")).agg(F.count(F.lit(1)).alias("n_both"))
    x = both.join(n.select(F.col(vector).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(vector).alias("b"), F.col("n").alias("nb")), "b")
    kind = F.when((F.col("n_both") == F.col("na")) & (F.col("na") == F.col("nb")), "EXACT").when(F.col("n_both") == F.least("na", "nb"), "IMPLICATION")
    return x.withColumn("relation", kind).filter("relation IS NOT NULL").select("a", "b", "n_both", "relation")


def range_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, bucket: float) -> DataFrame:
    """Points joined to the ranges [low, high) that hold them: an equi-join on buckets, then the comparison."""
    p = points.withColumn("__b", F.floor(F.col(point) / bucket))
    last = F.greatest(F.floor(F.col(low) / bucket), F.ceil(F.col(high) / bucket) - 1)
    r = ranges.filter(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / bucket), last)))
    return p.join(r, "__b").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__b")


def compare_status(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """CONFIRMED, CONFLICT, NEW (right only) or MISSING (left only) for each key."""
    x = left.select(*keys, F.col(value).alias("__l"), F.lit(1).alias("__hl")).join(right.select(*keys, F.col(value).alias("__r"), F.lit(1).alias("__hr")), list(keys), "full")
    c = F.when(F.col("__hl").isNull(), "NEW").when(F.col("__hr").isNull(), "MISSING").when(F.col("__l").eqNullSafe(F.col("__r")), "CONFIRMED").otherwise("CONFLICT")
    return x.select(*keys, c.alias("comparison"))


def pairs_within(df: DataFrame, keys: Sequence[str], item: str, block: int = 4096) -> DataFrame:
    """(keys, item_a, item_b): every pair of a group's different items once, item_a < item_b.

    A group of more than ``block`` rows is cut into blocks by hash and its pairs into pairs of blocks, so that
    no task holds more than two blocks of a group. Nulls make no group and no item; repeated items count once.
    """
    have = reduce(lambda a, c: a & F.col(c).isNotNull(), [*keys, item], F.lit(True))
    one = df.filter(have).select(*keys, item).distinct()
    hot = one.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__parts")).filter("__parts > 1")
    x = one.join(hot, list(keys), "left").withColumn("__parts", F.coalesce("__parts", F.lit(1)))
    x = x.withColumn("__at", F.pmod(F.xxhash64(item), "__parts").cast("int"))
    a = x.select(*keys, F.col(item).alias(f"{item}_a"), F.col("__at").alias("__p"), F.explode(F.sequence("__at", F.col("__parts") - 1)).alias("__q"))
    b = x.select(*keys, F.col(item).alias(f"{item}_b"), F.explode(F.sequence(F.lit(0), "__at")).alias("__p"), F.col("__at").alias("__q"))
    left, right = F.col(f"{item}_a"), F.col(f"{item}_b")
    hit = a.join(b, [*keys, "__p", "__q"]).filter((F.col("__p") < F.col("__q")) | (left < right))
    return hit.select(*keys, F.least(left, right).alias(f"{item}_a"), F.greatest(left, right).alias(f"{item}_b"))


def two_hop(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, mid, dst) of two edges that do not lead back."""
    a = edges.select(F.col(src).alias("src"), F.col(dst).alias("mid")).distinct()
    b = edges.select(F.col(src).alias("mid"), F.col(dst).alias("dst")).distinct()
    return a.join(b, "mid").filter("src <> dst").select("src", "mid", "dst")


# ---------------------------------------------------------------- aggregations


def wilson_lower(passed: Column, total: Column, z: float = 1.95996398454) -> Column:
    """Lower bound of the Wilson interval, not below 0; 0 without trials."""
    n, p = total.cast("double"), F.try_divide(passed.cast("double"), total.cast("double"))
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(F.greatest(p * (1 - p) / n + z * z / (4 * n * n), F.lit(0.0)))
    return F.when(total > 0, F.greatest((mid - half) / (1 + z * z / n), F.lit(0.0))).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def cooccurrence(pairs: DataFrame, case: str, item: str) -> DataFrame:
    """Joint case counts of items a < b (the Gram matrix above the diagonal)."""
    p = pairs_within(pairs.select(F.col(case).alias("case"), F.col(item).alias("item")), ["case"], "item")
    return p.groupBy(F.col("item_a").alias("a"), F.col("item_b").alias("b")).agg(F.count(F.lit(1)).alias("n_both"))


def transitions(before: DataFrame, after: DataFrame, key: str, status: str) -> DataFrame:
    """Counts of (old status, new status) over the keys both have."""
    x = before.select(key, F.col(status).alias("old_status")).join(after.select(key, F.col(status).alias("new_status")), key)
    return x.groupBy("old_status", "new_status").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sequences


def islands(df: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """Closed ranges of consecutive places per key.

    Places are cut into ranges of (keys, place), so a hot key is spread over all of them. Runs inside a range are
    final; only the first and last run of a key that goes on in another range are joined to their neighbours.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = df.select(*keys, F.col(place).alias("__x")).filter("__x IS NOT NULL").distinct()
    laid = Staging(spark, "islands").put(one.repartitionByRange(parts, *keys, "__x").withColumn("__pid", F.spark_partition_id()))
    inside = Window.partitionBy("__pid", *keys).orderBy("__x")
    runs = laid.withColumn("__g", F.col("__x") - F.row_number().over(inside)).groupBy("__pid", *keys, "__g").agg(F.min("__x").alias("__s"), F.max("__x").alias("__e"))
    ends = laid.groupBy("__pid", *keys).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    wide = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")  # a key cut by a range: fewer than ranges
    edge = ends.join(F.broadcast(wide), list(keys), "left_semi") if keys else ends
    marked = runs.join(F.broadcast(edge), ["__pid", *keys], "left")
    at_edge = F.coalesce((F.col("__s") == F.col("__lo")) | (F.col("__e") == F.col("__hi")), F.lit(False))
    done = marked.filter(~at_edge).select(*keys, "__s", "__e")
    along = Window.partitionBy(*keys).orderBy("__s")  # at most two runs per range and key
    gap = F.when(F.col("__s") == F.lag("__e").over(along) + 1, 0).otherwise(1)
    loose = marked.filter(at_edge).select(*keys, "__s", "__e").withColumn("__new", gap).withColumn("__g", F.sum("__new").over(along))
    joined = loose.groupBy(*keys, "__g").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e")).drop("__g")
    return done.unionByName(joined).select(*keys, F.col("__s").alias("range_start"), F.col("__e").alias("range_end"))


def lag_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Neighbouring rows of a group whose values differ: (keys, previous, next)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("previous", F.lag(value).over(w)).withColumnRenamed(value, "next")
    return x.filter("previous IS NOT NULL AND previous <> next").select(*keys, "previous", "next")


def first_divergence(a: DataFrame, b: DataFrame, keys: Sequence[str], step: str, value: str, strict: bool) -> DataFrame:
    """The least step at which two sequences differ; ``strict`` counts a step that only one of them has."""
    x = a.select(*keys, step, F.col(value).alias("__a"), F.lit(1).alias("__ha")).join(b.select(*keys, step, F.col(value).alias("__b"), F.lit(1).alias("__hb")), [*keys, step], "full" if strict else "inner")
    differs = ~F.col("__a").eqNullSafe(F.col("__b"))
    if strict:
        differs = differs | F.col("__ha").isNull() | F.col("__hb").isNull()
    else:
        differs = differs & F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return x.filter(differs).groupBy(*keys).agg(F.min(step).alias("first_step"))


def greedy_units(df: DataFrame, key: str, order: Sequence[str], cost: str, most_cost: float, most_items: int) -> DataFrame:
    """Units filled in order within each key: a new unit where the cost or the number of items would pass its bound.

    Rows stream in order through one pass that carries the open unit only, so a key of any size needs no memory.
    A null cost counts 0. Result: key, unit, n_items, unit_cost.
    """
    kind = dict(df.dtypes)[key]
    laid = df.select(key, *[c for c in order if c != key], F.coalesce(F.col(cost).cast("double"), F.lit(0.0)).alias("__c")).repartition(F.col(key)).sortWithinPartitions(key, *order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []  # key, unit, items, cost
        type_ = None

        def rows(found: list[list]) -> pa.RecordBatch:
            cols = list(zip(*found)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (type_, pa.int32(), pa.int32(), pa.float64()))], [key, "unit", "n_items", "unit_cost"])

        for b in batches:
            type_ = b.column(0).type
            out: list[list] = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if open_ and open_[0] == k:
                    if open_[3] + c > most_cost or open_[2] >= most_items:
                        out.append(open_)
                        open_ = [k, open_[1] + 1, 1, c]
                    else:
                        open_ = [k, open_[1], open_[2] + 1, open_[3] + c]
                else:
                    if open_:
                        out.append(open_)
                    open_ = [k, 1, 1, c]
            yield rows(out)
        if open_:
            yield rows([open_])

    return laid.select(key, "__c").mapInArrow(run, f"`{key}` {kind}, unit int, n_items int, unit_cost double")


# ---------------------------------------------------------------- unions


def union_tagged(parts: dict[str, DataFrame], columns: dict[str, dict[str, str]], tag: str = "src") -> DataFrame:
    """Union all under common names, each part's rows tagged with where they come from."""
    shaped = [df.select(F.lit(name).alias(tag), *[F.col(old).alias(new) for new, old in columns[name].items()]) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, shaped)


def weighted_counts(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """What counting each row ``weight`` times gives, without repeating rows."""
    return df.groupBy(*keys).agg(F.sum(F.col(weight).cast("bigint")).alias("n"))


def merge_graphs(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Graphs as (nodes(id), edges(src, dst)) with dense ids from 0 made one by shifting the ids of each.

    The shifts are the running sizes of the graphs: one number each, found in one job. An empty graph takes no ids.
    """
    tops = reduce(DataFrame.unionByName, [n.select(F.lit(k).alias("k"), F.col("id").cast("bigint").alias("id")) for k, (n, _) in enumerate(graphs)])
    top = {r["k"]: r["top"] for r in tops.groupBy("k").agg(F.max("id").alias("top")).collect()}
    nodes, edges, base = [], [], 0
    for k, (n, e) in enumerate(graphs):
        nodes.append(n.withColumn("id", F.col("id") + base))
        edges.append(e.withColumn("src", F.col("src") + base).withColumn("dst", F.col("dst") + base))
        if top.get(k) is not None:
            base += top[k] + 1
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def structural_match(operations: DataFrame, patterns: DataFrame, key: str, name: str, kinds: str) -> DataFrame:
    """Operations matched to patterns of the same name and number of operands: (key, match_status, n_patterns).

    Per place ``any`` fits every kind. exact: some pattern has the same kinds; conditional: some fits by ``any``;
    unsupported: the name is known with other operands only; no_match: the name is unknown.
    """
    p = patterns.select(F.col(name).alias("__n"), F.col(kinds).alias("__k"))
    x = operations.select(key, name, kinds).join(p, F.col(name) == F.col("__n"), "left")
    same_size = F.size(F.col(kinds)) == F.size("__k")
    fits = same_size & F.forall(F.zip_with(F.col(kinds), F.col("__k"), lambda a, b: (a == b) | (b == "any")), lambda ok: F.coalesce(ok, F.lit(False)))
    exact = same_size & (F.col(kinds) == F.col("__k"))
    g = x.groupBy(key).agg(F.coalesce(F.bool_or(exact), F.lit(False)).alias("e"), F.coalesce(F.bool_or(fits), F.lit(False)).alias("f"), F.count("__n").alias("known"), F.count_if(fits).alias("n_patterns"))
    s = F.when(F.col("e"), "exact").when(F.col("f"), "conditional").when(F.col("known") > 0, "unsupported").otherwise("no_match")
    return g.select(key, s.alias("match_status"), "n_patterns")


def token_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str) -> DataFrame:
    """(left_id, right_id, n_shared) of texts that share a word: an equi-join on words, never a nested loop."""
    words = lambda df, k: df.select(k, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))).alias("__w"))
    return words(left, left_id).join(words(right, right_id), "__w").groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("n_shared"))


def witnessed(rows: DataFrame, witnesses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with ``observed``: whether a witness has the same keys."""
    w = witnesses.select(*keys).distinct().withColumn("__w", F.lit(True))
    return rows.join(w, list(keys), "left").withColumn("observed", F.coalesce("__w", F.lit(False))).drop("__w")


def override(defaults: DataFrame, work: DataFrame, key: str, value: str) -> DataFrame:
    """Defaults with the values of ``work`` where it has the key."""
    w = work.groupBy(key).agg(F.max(value).alias("__v"))
    return defaults.join(w, key, "left").withColumn(value, F.coalesce("__v", value)).drop("__v")


def intermediate_routes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, mid): the least intermediate with both legs, for each wanted pair that has one."""
    e = edges.select("src", "dst").distinct()
    a, b = e.select("src", F.col("dst").alias("mid")), e.select(F.col("src").alias("mid"), "dst")
    hops = pairs.select("src", "dst").distinct().join(a, "src").join(b, ["mid", "dst"]).filter("mid <> src AND mid <> dst")
    return hops.groupBy("src", "dst").agg(F.min("mid").alias("mid"))


def split_known(candidates: DataFrame, exact: DataFrame, parameterised: DataFrame, key: str, family: str) -> DataFrame:
    """(key, residual): EXACT where the key is known, PARAMETERISED where its family is, else NEW."""
    x = candidates.select(key, family).join(exact.select(key).distinct().withColumn("__e", F.lit(1)), key, "left").join(parameterised.select(family).distinct().withColumn("__p", F.lit(1)), family, "left")
    return x.select(key, F.when(F.col("__e") == 1, "EXACT").when(F.col("__p") == 1, "PARAMETERISED").otherwise("NEW").alias("residual"))


def feasible_triples(edges: DataFrame) -> DataFrame:
    """(src, mid, dst, only_by_mid): routes over one intermediate between three different nodes, and whether no direct edge does it."""
    e = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    hops = e.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").filter("src <> dst")
    return hops.join(e.withColumn("__d", F.lit(True)), ["src", "dst"], "left").select("src", "mid", "dst", F.col("__d").isNull().alias("only_by_mid"))


def reverse_lookup(df: DataFrame, text: str, part: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose text holds a part and whose key is among ``ids``."""
    return df.filter(F.col(text).contains(part)).join(ids.select(key), key, "left_semi")


def ordered_children(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: str, sep: str = ",") -> DataFrame:
    """(keys, joined): a group's items in order as one text; for groups of bounded size, as a node's operands are."""
    rows = F.array_sort(F.collect_list(F.struct(*order)))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda s: s[item]), sep).alias("joined"))


def bind_arguments(arguments: DataFrame, parameters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(call, parameter, argument) of the arguments that bind, and (call, argument, fault) of those that do not.

    arguments(call, callee, argument, place, name): bound by ``name`` where it has one, else by ``place``; parameters(callee,
    place, parameter). Faults: ``unknown`` names no parameter, ``duplicate`` means a parameter bound more than once.
    """
    p = parameters.select("callee", F.col("place").alias("__at"), "parameter").distinct()
    named = arguments.filter("name IS NOT NULL").join(p.drop("__at"), (arguments["callee"] == p["callee"]) & (F.col("name") == F.col("parameter")), "left").select("call", "argument", "parameter")
    placed = arguments.filter("name IS NULL").join(p, (arguments["callee"] == p["callee"]) & (F.col("place") == F.col("__at")), "left").select("call", "argument", "parameter")
    every = named.unionByName(placed)
    lost = every.filter("parameter IS NULL").select("call", "argument", F.lit("unknown").alias("fault"))
    bound = every.filter("parameter IS NOT NULL")
    twice = bound.groupBy("call", "parameter").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    more = bound.join(twice, ["call", "parameter"], "left_semi").select("call", "argument", F.lit("duplicate").alias("fault"))
    return bound.join(twice, ["call", "parameter"], "left_anti").select("call", "parameter", "argument"), lost.unionByName(more)


def with_timeout(df: DataFrame, key: str, text: str, work: Callable[[str | None], str], seconds: float) -> DataFrame:
    """(key, state, result) of ``work`` on each text: OK, ERROR with its message, or TIMEOUT after so many seconds; the others go on.

    The clock is a signal of the worker process, so work that never returns to Python is not interrupted.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import signal

        class Late(BaseException):
            pass

        def late(*_: object) -> None:
            raise Late

        before = signal.signal(signal.SIGALRM, late)
        try:
            for b in batches:
                state, result = [], []
                for t in b.column(1).to_pylist():
                    try:
                        signal.setitimer(signal.ITIMER_REAL, seconds)
                        got = ("OK", work(t))
                    except Late:
                        got = ("TIMEOUT", None)
                    except Exception as e:  # noqa: BLE001
                        got = ("ERROR", str(e))
                    finally:
                        signal.setitimer(signal.ITIMER_REAL, 0)
                    state.append(got[0])
                    result.append(got[1])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(state, pa.string()), pa.array(result, pa.string())], [key, "state", "result"])
        finally:
            signal.signal(signal.SIGALRM, before)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, state string, result string")
