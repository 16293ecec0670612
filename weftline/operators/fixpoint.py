"""Fixpoint queries over graphs: closure, reachability, derivation, propagation and refinement.

All run semi-naively: a round joins only what the round before found, subtracts what is known and
writes the rest to the shared folder, which cuts lineage and survives lost executors. Rounds are bounded; a query
that would need more raises instead of returning a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import Staging

MOST_ROUNDS = 10_000


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], name: str, hops: int = 8, most: int = MOST_ROUNDS, log: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Least set that holds ``start`` and is closed under ``step``; rows are told apart by ``keys``, the fewest steps win.

    ``log`` receives (name, round, rows found) for every round, the start as round 0. ``step`` must depend on its argument's rows one by one. A round takes ``hops`` steps in one job; only the
    rows of its last step go on, as the others' successors were found in the same round.
    """
    st = Staging(start.sparkSession, name)
    fresh = st.put(start)
    known = [fresh]
    rest = [c for c in start.columns if c not in keys]
    log = [] if log is None else log
    log.append((name, 0, fresh.count()))
    for r in range(1, most + 1):
        all_known = _all(known)
        layer, layers = fresh, []
        for h in range(1, hops + 1):
            layer = step(layer).dropDuplicates(keys)
            layers.append(layer.withColumn("__hop", F.lit(h)))
        first = _all(layers).groupBy(*keys).agg(F.min(F.struct("__hop", *rest)).alias("__b")).select(*keys, "__b.*")
        found = st.put(first.join(all_known.select(*keys), keys, "left_anti"))
        log.append((name, r, found.count()))
        if not log[-1][2]:
            st.drop(found)
            return all_known
        known.append(_staged_as(found.drop("__hop"), found))
        fresh = found.filter(F.col("__hop") == hops).drop("__hop")
        if not fresh.limit(1).count():
            return _all(known)
        if len(known) > 16:  # many small tables make slow plans; the newest is still to be extended
            whole = st.put(_all(known))
            st.drop(*known[:-1])
            known = [whole]
    raise RuntimeError(f"{name}: no fixpoint after {most} rounds")


def _staged_as(df: DataFrame, of: DataFrame) -> DataFrame:
    df._staged_at = of._staged_at
    return df


def rounds_table(spark: SparkSession, log: list[tuple[str, int, int]]) -> DataFrame:
    """The rounds of fixpoints: (name, round, n_found)."""
    return spark.createDataFrame(log, "name string, round int, n_found bigint")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) joined by a path of one edge or more; no identity pairs but those on cycles.

    Paths double each round: known paths are joined to the newest, so rounds grow with the logarithm of the longest path.
    """
    st = Staging(edges.sparkSession, "closure")
    first = st.put(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    parts, fresh = [first], first
    while True:
        known = _all(parts)
        a = fresh.select("src", F.col("dst").alias("mid"))
        b = known.select(F.col("src").alias("mid"), "dst")
        c = known.select("src", F.col("dst").alias("mid"))
        d = fresh.select(F.col("src").alias("mid"), "dst")
        found = a.join(b, "mid").select("src", "dst").unionByName(c.join(d, "mid").select("src", "dst")).distinct()
        new = st.put(found.join(known, ["src", "dst"], "left_anti"))
        if not new.limit(1).count():
            st.drop(new)
            return known
        parts, fresh = [*parts, new], new


def reachable(edges: DataFrame, roots: DataFrame, log: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """(node, depth): nodes reached from ``roots(node)`` with the least number of edges; roots have 0."""
    start = roots.select("node").distinct().withColumn("depth", F.lit(0))
    e = Staging(edges.sparkSession, "reach-edges").put(edges.select(F.col("src").alias("node"), "dst").distinct())
    return fixpoint(start, lambda f: f.join(e, "node").select(F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")), ["node"], "reach", log=log)


def cycles(closure: DataFrame) -> DataFrame:
    """Nodes on a cycle, from a closure."""
    return closure.filter("src = dst").select(F.col("src").alias("node"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge (an edge to itself is one)."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that name a node that is not there."""
    n = nodes.select("node").distinct()
    a = edges.join(n.withColumnRenamed("node", "src"), "src", "left_anti")
    b = edges.join(n.withColumnRenamed("node", "dst"), "dst", "left_anti")
    return a.select("src", "dst").unionByName(b.select("src", "dst")).distinct()


def propagate(depends: DataFrame, unknown: DataFrame) -> DataFrame:
    """(node): unknown nodes and all that depend on one; depends(src, dst): src needs dst."""
    d = Staging(depends.sparkSession, "depends").put(depends.select(F.col("dst").alias("node"), "src").distinct())
    return fixpoint(unknown.select("node").distinct(), lambda f: f.join(d, "node").select(F.col("src").alias("node")), ["node"], "propagate")


def horn_proofs(rules: DataFrame, facts: DataFrame, log: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """(fact, rank, rule): facts have rank 0 and no rule; a rule(rule, head, body) with all bodies known gives its head
    1 + the greatest body rank. ``rule`` is the witness: the least rule that gives the least rank.

    Semi-naive: each rule counts its missing bodies; a round joins only the newest facts to the bodies and lowers
    the counts of the rules they touch. A rule without bodies is written with a null body and fires at once with rank 1.
    """
    st = Staging(rules.sparkSession, "horn")
    log = [] if log is None else log
    r = st.put(rules.select(F.col("rule").cast("string").alias("rule"), "head", "body").distinct())
    bodies = r.filter("body IS NOT NULL").select("rule", "body").distinct()
    counts = bodies.groupBy("rule").agg(F.count(F.lit(1)).cast("int").alias("missing"))
    open_ = st.put(r.filter("body IS NOT NULL").select("rule", "head").distinct().join(counts, "rule").select("rule", "head", "missing", F.lit(0).alias("top")))
    free = r.filter("body IS NULL").join(counts.select("rule"), "rule", "left_anti").select(F.col("head").alias("fact"), F.lit(1).alias("rank"), "rule")
    start = facts.select("fact", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("rule")).unionByName(free)
    best = lambda df: df.groupBy("fact").agg(F.min(F.struct("rank", "rule")).alias("b")).select("fact", "b.rank", "b.rule")
    fresh = st.put(best(start))
    known = [fresh]
    log.append(("horn", 0, fresh.count()))
    for k in range(1, MOST_ROUNDS + 1):
        hit = fresh.select(F.col("fact").alias("body"), "rank").join(bodies, "body").groupBy("rule").agg(F.count(F.lit(1)).cast("int").alias("h"), F.max("rank").alias("t"))
        now = st.put(open_.join(hit, "rule", "left").select("rule", "head", (F.col("missing") - F.coalesce("h", F.lit(0))).alias("missing"), F.greatest("top", F.coalesce("t", F.lit(0))).alias("top")))
        st.drop(open_)
        ready = now.filter("missing = 0").select(F.col("head").alias("fact"), (F.col("top") + 1).alias("rank"), "rule")
        new = st.put(best(ready).join(_all(known).select("fact"), "fact", "left_anti"))
        log.append(("horn", k, new.count()))
        if not log[-1][2]:
            st.drop(new)
            return _all(known)
        open_, fresh = st.put(now.filter("missing > 0")), new
        st.drop(now)
        known.append(new)
        if len(known) > 16:
            whole = st.put(_all(known))
            st.drop(*known[:-1])
            known = [whole]
    raise RuntimeError("horn: no fixpoint")


def horn_closure(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """(fact, rank) of ``horn_proofs``."""
    return horn_proofs(rules, facts).select("fact", "rank")


def horn_blocked(rules: DataFrame, known: DataFrame) -> DataFrame:
    """(rule, fact, reason) per missing body of each rule whose head is not in ``known``, the closure of ``horn_closure``."""
    k = known.select("fact")
    open_ = rules.filter("body IS NOT NULL").select("rule", F.col("head").alias("fact"), "body").distinct().join(k, "fact", "left_anti")
    missing = open_.join(k.withColumnRenamed("fact", "body"), "body", "left_anti")
    return missing.select("rule", "fact", F.concat(F.lit("missing dependency: "), F.col("body").cast("string")).alias("reason"))


def refine(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """(node, class_id): coarsest partition by label in which equal nodes have equal ordered child classes.

    Classes are hashes of (own class, child classes); rounds stop when their number no longer grows.
    edges(src, ordinal, dst). Cyclic graphs are fine; a class is named by its least node.

    A node's children are folded into an exclusive or over hashes of (ordinal, class, how often), so a node with a
    third of all rows as children is one row of a partial aggregation.
    """
    st = Staging(nodes.sparkSession, "refine")
    cur = st.put(nodes.select("node", F.sha2(F.coalesce(F.col(label).cast("string"), F.lit("\x00")), 256).alias("c")))
    count = cur.select("c").distinct().count()
    while True:
        kids = edges.join(cur.select(F.col("node").alias("dst"), F.col("c").alias("cc")), "dst").groupBy(F.col("src").alias("node"), "ordinal", "cc").agg(F.count(F.lit(1)).alias("k"))
        part = lambda seed: F.bit_xor(F.xxhash64("ordinal", "cc", "k", F.lit(seed)))
        sig = kids.groupBy("node").agg(F.concat_ws(",", part(1).cast("string"), part(2).cast("string"), F.sum("k").cast("string")).alias("s"))
        new = st.put(cur.join(sig, "node", "left").select("node", F.sha2(F.concat_ws("|", "c", F.coalesce("s", F.lit(""))), 256).alias("c")))
        n = new.select("c").distinct().count()
        if n == count:
            st.drop(new)
            return cur.join(cur.groupBy("c").agg(F.min("node").alias("class_id")), "c").select("node", "class_id")
        st.drop(cur)
        cur, count = new, n


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): 0 without dependencies, else 1 + the greatest level it depends on; nodes on or above a cycle are left out.

    edges(src, dst): src depends on dst.
    """
    rules = edges.select(F.col("src").cast("string").alias("rule"), F.col("src").cast("string").alias("head"), F.col("dst").cast("string").alias("body"))
    leaf = nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select(F.col("node").cast("string").alias("fact"))
    return horn_closure(rules, leaf).select(F.col("fact").alias("node"), F.col("rank").alias("level"))


def reach_counts(closure: DataFrame) -> DataFrame:
    """(node, n_reached), for ordering by how much a node reaches."""
    return closure.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_reached"))


def frontier(reached: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): edges from reached nodes to nodes that are not there, the unresolved end of a walk."""
    return edges.join(reached.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst").distinct()


def preferred_roots(edges: DataFrame, nodes: DataFrame, group: str, kind: str, wanted: str) -> DataFrame:
    """(group, node): per group one node without incoming edge, of the wanted kind before others, then the least."""
    top = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    best = top.groupBy(group).agg(F.min(F.struct((F.coalesce(F.col(kind), F.lit("")) != wanted).alias("o"), F.col("node"))).alias("b"))
    return best.select(group, F.col("b.node").alias("node"))


def maybe_unassigned(flow: DataFrame, entries: DataFrame, assigns: DataFrame, variables: DataFrame) -> DataFrame:
    """(node, variable): variables that some path from an entry may reach a node without assigning.

    The definitely assigned ones are the greatest solution of "in = AND over predecessors of (in OR assigned there)";
    what it leaves out is the least solution of the opposite, found here: unassigned at entries, and passed along
    edges(src, dst) by nodes that do not assign it. Nodes that no entry reaches have no row.
    """
    st = Staging(flow.sparkSession, "assign")
    e = st.put(flow.select(F.col("src").alias("node"), "dst").distinct())
    a = st.put(assigns.select("node", "variable").distinct())
    start = entries.select("node").distinct().crossJoin(variables.select("variable").distinct())  # the entries times the variables are given facts

    def step(f: DataFrame) -> DataFrame:
        return f.join(a, ["node", "variable"], "left_anti").join(e, "node").select(F.col("dst").alias("node"), "variable")

    return fixpoint(start, step, ["node", "variable"], "assign", hops=4)


def rewrite_chains(start: DataFrame, rules: DataFrame, goal: DataFrame, most_depth: int, most_terms: int = 1_000_000) -> DataFrame:
    """(term, goal, depth, chain): the shortest way of rewriting each start term into a goal term.

    rules(rule, before, after) rewrite a whole term. Breadth first, at most ``most_depth`` steps; a term already met from
    the same start is not met again, so cycles end. Of several shortest chains the least text counts. More than ``most_terms`` terms in
    one round is refused rather than cut.
    """
    st = Staging(start.sparkSession, "rewrite")
    r = st.put(rules.select(F.col("rule").cast("string").alias("rule"), F.col("before").alias("at"), "after").distinct())
    layer = st.put(start.select("term", F.col("term").alias("at"), F.lit(0).alias("depth"), F.lit("").alias("chain")).distinct())
    seen = [layer]
    for k in range(1, most_depth + 1):
        step = layer.join(r, "at").select("term", F.col("after").alias("at"), F.lit(k).alias("depth"), F.concat_ws(">", F.nullif("chain", F.lit("")), "rule").alias("chain"))
        best = step.groupBy("term", "at").agg(F.min("chain").alias("chain")).select("term", "at", F.lit(k).alias("depth"), "chain")
        layer = st.put(best.join(_all(seen).select("term", "at"), ["term", "at"], "left_anti"))
        n = layer.count()
        if n > most_terms:
            raise RuntimeError(f"rewrite_chains: {n} terms in round {k}")
        if not n:
            break
        seen.append(layer)
    hit = _all(seen).join(goal.select(F.col("goal").alias("at")).distinct(), "at", "left_semi").filter("depth > 0")
    return hit.select("term", F.col("at").alias("goal"), "depth", "chain")


def executable_closure(roots_: DataFrame, calls: DataFrame, aliases: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unit) needed by the roots through calls, and (caller, name, reason) of the names that cannot be resolved.

    calls(unit, name), aliases(name, real), units(unit). A name stands for its alias' real name; a name that is no unit then is
    ``missing unit`` or, where its alias names none, ``alias of a missing unit``.
    """
    st = Staging(calls.sparkSession, "units")
    a = aliases.groupBy("name").agg(F.min("real").alias("real"))
    named = calls.select("unit", "name").distinct().join(a, "name", "left").select("unit", "name", F.coalesce("real", "name").alias("to"), F.col("real").isNotNull().alias("aliased"))
    u = units.select(F.col("unit").alias("to")).distinct().withColumn("there", F.lit(True))
    links = st.put(named.join(u, "to", "left"))
    e = st.put(links.filter("there").select(F.col("unit").alias("src"), F.col("to").alias("dst")).distinct())
    need = reachable(e, roots_.select(F.col("unit").alias("node"))).select(F.col("node").alias("unit"))
    lost = links.filter("there IS NULL").join(need, "unit", "left_semi")
    return need, lost.select(F.col("unit").alias("caller"), "name", F.when(F.col("aliased"), "alias of a missing unit").otherwise("missing unit").alias("reason")).distinct()
