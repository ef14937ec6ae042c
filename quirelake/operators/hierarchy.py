"""Parent-child links to full hierarchies, by contraction of partition-local chains.

Nodes are spread over fragments: all nodes of a small group share one, a large group is cut so that a node goes where
the smaller hash of itself and its parent sends it; that puts a third of all links, at least, within a fragment, however
the group looks. In each partition parent chains are contracted by pointer doubling in numpy: a node ends at a local
root, on a local cycle, or at a *fragment exit*, the first node of its chain that lives elsewhere. Exits form a smaller
quotient forest (weighted by the contracted distance, and carrying the contracted path), which is solved the same way
with another hash, until it fits a fragment: each level leaves about two thirds of a chain or less, and all leaves are
gone after the first. Then fragments are expanded: exits take over root, depth, path and state of the quotient, and nodes
between two exits of a global cycle are marked as lying on it.

Defined cases: null or blank groups or nodes are no node; a null parent makes no link; repeated links count once; of
several parents of one node the smallest counts; a node that is its own parent is a cycle of one; an empty table gives
no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.session import durable, partitions_for

#: Rows that one fragment may hold; a partition holds about as many.
FRAGMENT_ROWS = 100_000
#: Fragments are smaller where this many for each core would otherwise not come about, but no smaller than LEAST_ROWS.
FRAGMENTS_PER_CORE, LEAST_ROWS = 2, 1_000
#: Code points of paths that one batch may hold.
PATH_CHARS = 8_000_000
#: What stands between the ids of a path, and what it is written as where it is part of an id.
SEP, ESCAPE = "\x1f", "\x1e"


def links(df: DataFrame, group: str, child: str, parent: str, is_link: F.Column) -> DataFrame:
    """(grp, node, parent): each node once, its parent null at a root. Ids are trimmed and in lower case."""
    clean = lambda c: F.lower(F.btrim(F.col(c), F.lit(" \t\r\n")))
    rows = df.select(F.col(group).alias("grp"), clean(child).alias("node"), F.when(is_link, clean(parent)).alias("parent"))
    rows = rows.withColumn("parent", F.when(F.col("parent") != "", F.col("parent")))
    both = rows.select("grp", F.explode(F.array(F.struct("node", "parent"), F.struct(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))).alias("x")).select("grp", "x.node", "x.parent")
    return both.where("grp is not null and node is not null and node <> ''").groupBy("grp", "node").agg(F.min("parent").alias("parent"))


def _positions(grp: pd.Series, node: pd.Series, parent: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """For each row the row of its parent in the same partition, or -1; and whether it has a parent at all."""
    group = pd.Series(pd.factorize(grp)[0].astype(str), index=grp.index)  # digits hold no separator
    has = parent.notna().to_numpy()
    at = np.full(len(node), -1, np.int64)
    if has.any():
        at[has] = pd.Index(group.str.cat(node, sep=SEP)).get_indexer(group[has].str.cat(parent[has], sep=SEP))
    return at, has


def _walk(at: np.ndarray, seg: np.ndarray) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, paths) of all trees, from what stands at their tops down; only one path is held, and batches are bounded."""
    order = np.argsort(at, kind="stable")
    below = np.searchsorted(at[order], np.arange(len(at) + 1))
    rows: list[int] = []
    paths: list[str] = []
    weight, order, below = 0, order.tolist(), below.tolist()
    for top in np.flatnonzero(at < 0).tolist():
        stack, held = [(top, 0)], []
        while stack:
            i, depth = stack.pop()
            del held[depth:]
            held.append(seg[i])
            rows.append(i)
            paths.append(SEP.join(held))
            weight += len(paths[-1]) + 16
            if weight > PATH_CHARS:
                yield rows, paths
                rows, paths, weight = [], [], 0
            stack += [(j, depth + 1) for j in order[below[i] : below[i + 1]]]
    if rows:
        yield rows, paths


def _contract(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Ends of all chains of one partition: pointer doubling, about log2 of the longest chain steps.

    With a column ``seg``, the part of the path that a node stands for, the path from the chain's end down to the node too.
    """
    frame = frame.reset_index(drop=True)
    n = len(frame)
    at, has = _positions(frame.grp, frame.node, frame.parent)
    own = np.arange(n)
    weight = frame.w.to_numpy(np.int64)
    stops = at < 0
    jump = np.where(stops, own, at)
    dist = np.where(stops, 0, weight)
    for _ in range(max(1, int(n).bit_length()) + 1):
        dist = dist + dist[jump]
        after = jump[jump]
        if (after == jump).all():
            break
        jump = after
    ended = stops[jump]
    exits = ended & has[jump]
    node, parent = frame.node.to_numpy(object), frame.parent.to_numpy(object)
    out = frame.assign(exit=None, dist=0, root=None, state=None)
    # whatever has not ended runs into a local cycle; after at least n steps it stands on it
    state = np.full(n, None, object)
    state[ended & ~exits] = "tree"
    if not ended.all():
        ring = np.zeros(n, bool)
        front = np.unique(jump[~ended])
        while len(front):
            ring[front] = True
            front = np.unique(at[front])
            front = front[~ring[front]]
        state[~ended] = np.where(ring[~ended], "cycle", "below_cycle")
    root = np.full(n, None, object)
    tree = ended & ~exits
    root[tree] = node[jump[tree]]
    leave = np.full(n, None, object)
    leave[exits] = parent[jump[exits]]
    out["exit"], out["root"], out["state"] = leave, root, state
    out["dist"] = np.where(exits, dist + weight[jump], np.where(tree, dist, -1))
    if "seg" not in frame:
        yield out
        return
    for rows, paths in _walk(at, frame.seg.to_numpy(object)):
        yield out.iloc[rows].assign(path=paths)
    yield out[~ended].assign(path=None)


def _mark_rings(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Of the nodes whose chain leaves towards a cycle: those between a cycle's node of this fragment and its exit are on it."""
    frame = frame.reset_index(drop=True)
    at, _ = _positions(frame.grp, frame.node, frame.parent)
    front = np.flatnonzero(frame.self_state.to_numpy(object) == "cycle")
    ring = np.zeros(len(frame), bool)
    while len(front):
        ring[front] = True
        front = np.unique(at[front])
        front = front[front >= 0]
        front = front[~ring[front]]
    state = frame.state.to_numpy(object).copy()
    loose = np.isin(state, ["cycle", "below_cycle"]) & frame.exit.notna().to_numpy()
    state[loose] = np.where(ring[loose], "cycle", "below_cycle")
    yield frame.assign(state=state)


def _whole(frames: Iterator[pd.DataFrame], work: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], names: list[str]) -> Iterator[pd.DataFrame]:
    parts = [f for f in frames if len(f)]
    if parts:
        for done in work(pd.concat(parts, ignore_index=True)):
            for i in range(0, len(done), 20_000):
                yield done.iloc[i : i + 20_000][names]


def _in_fragments(nodes: DataFrame, large: DataFrame | None, parts: int, salt: int) -> DataFrame:
    """Nodes placed by fragment: whole groups where they are small, pieces of the ``large`` ones (grp, nb)."""
    if large is None:
        return nodes.repartition(parts, "grp")
    rank = lambda c: F.xxhash64(c, F.lit(salt))
    leader = F.when(F.col("parent").isNotNull() & (rank("parent") < rank("node")), F.col("parent")).otherwise(F.col("node"))
    placed = nodes.join(large, "grp", "left").withColumn("frag", F.when(F.col("nb").isNotNull(), F.pmod(F.xxhash64(leader, F.lit(-1 - salt)), F.col("nb"))).otherwise(F.lit(0)))
    return placed.drop("nb").repartition(parts, "grp", "frag")


def solve(nodes: DataFrame, fragment_rows: int | None = None, level: int = 0, report: list[int] | None = None) -> DataFrame:
    """(grp, node, root, dist, state[, path]) of a forest (grp, node, parent, w[, seg]): contraction, recursion on the quotient, expansion.

    ``report`` takes the rows of each level: the first is the forest, the others are quotients.
    """
    spark = nodes.sparkSession
    kept = ["seg"] if "seg" in nodes.columns else []
    path = ["path"] if kept else []
    sizes = durable(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), f"sizes-{level}")
    rows, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if report is not None:
        report.append(rows)
    if fragment_rows is None:
        fragment_rows = min(FRAGMENT_ROWS, max(LEAST_ROWS, -(-rows // (FRAGMENTS_PER_CORE * spark.sparkContext.defaultParallelism))))
    parts = partitions_for(spark, rows, fragment_rows)
    large = durable(sizes.where(F.col("n") > fragment_rows).select("grp", F.ceil(F.col("n") / fragment_rows).cast("int").alias("nb")), f"large-{level}") if largest > fragment_rows else None
    schema = "grp string, node string, parent string, exit string, dist bigint, root string, state string" + (", path string" if kept else "")
    names = [c.split()[0] for c in schema.split(", ")]
    local = _in_fragments(nodes.select("grp", "node", "parent", "w", *kept), large, parts, level).mapInPandas(lambda it: _whole(it, _contract, names), schema)
    if large is None:  # nothing is cut, so every chain has ended
        return local.select("grp", "node", "root", "dist", "state", *path)
    local = durable(local, f"fragments-{level}")
    closed = local.where("exit is null").select("grp", "node", "root", "dist", "state", *path)
    open_ = local.where("exit is not null")
    targets = open_.select("grp", F.col("exit").alias("node")).distinct()
    quotient = durable(local.join(targets, ["grp", "node"], "left_semi").select("grp", "node", F.col("exit").alias("parent"), F.col("dist").alias("w"), "root", "state", *path), f"quotient-{level}")
    # nodes that ended locally are roots of the quotient; what they ended with is put in again afterwards
    seg = [F.coalesce("path", F.lit("")).alias("seg")] if kept else []
    solved = solve(quotient.select("grp", "node", "parent", F.coalesce("w", F.lit(0)).alias("w"), *seg), fragment_rows, level + 1, report)
    ends = quotient.where("parent is null").select("grp", F.col("node").alias("root"), F.col("root").alias("root2"), F.col("w").alias("dist2"), F.col("state").alias("state2"))
    full = solved.join(ends, ["grp", "root"], "left").select(
        "grp", "node",
        F.when(F.col("state2") == "tree", F.col("root2")).alias("q_root"),
        F.when(F.col("state2") == "tree", F.col("dist") + F.col("dist2")).alias("q_dist"),
        F.when(F.col("state2").isNull(), F.col("state")).when(F.col("state2") == "tree", F.lit("tree")).otherwise(F.lit("below_cycle")).alias("q_state"),
        *[F.col(c).alias("q_path") for c in path],
    )
    full = durable(full, f"solved-{level}")
    own = full.where("q_state = 'cycle'").select("grp", "node", F.col("q_state").alias("self_state"))
    there = full.withColumnRenamed("node", "exit")
    opened = open_.drop("root", "state").join(there, ["grp", "exit"], "left")
    is_tree = F.col("q_state") == "tree"
    trees = opened.where(is_tree).select("grp", "node", F.col("q_root").alias("root"), (F.col("dist") + F.col("q_dist")).alias("dist"), F.col("q_state").alias("state"), *[F.concat_ws(SEP, "q_path", c).alias(c) for c in path])
    loops = opened.where(~is_tree).select("grp", "node", "parent", "exit", F.lit(None).cast("string").alias("root"), F.lit(-1).cast("bigint").alias("dist"), F.col("q_state").alias("state")).join(own, ["grp", "node"], "left")
    out = ["grp", "node", "root", "dist", "state"]
    marked = _in_fragments(loops, large, parts, level).mapInPandas(lambda it: _whole(it, _mark_rings, out), "grp string, node string, root string, dist bigint, state string")
    return closed.unionByName(trees).unionByName(marked.withColumns({c: F.lit(None).cast("string") for c in path}))


def hierarchy(nodes: DataFrame, fragment_rows: int | None = None, report: list[int] | None = None) -> DataFrame:
    """(grp, node, root_id, node_depth, node_state) of every node; root '' and depth -1 on and below cycles."""
    solved = solve(nodes.withColumn("w", F.lit(1).cast("bigint")), fragment_rows, report=report)
    tree = F.col("state") == "tree"
    return solved.select("grp", "node", F.when(tree, F.col("root")).otherwise(F.lit("")).alias("root_id"), F.when(tree, F.col("dist")).otherwise(F.lit(-1)).cast("int").alias("node_depth"), F.col("state").alias("node_state"))


def paths(nodes: DataFrame, fragment_rows: int | None = None) -> DataFrame:
    """(grp, node, path): the ids from the root down to the node, of each node of a tree. Fragments' paths, expanded."""
    escaped = F.replace(F.replace(F.col("node"), F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(SEP), F.lit(ESCAPE + "1"))
    solved = solve(nodes.select("grp", "node", "parent", F.lit(1).cast("bigint").alias("w"), escaped.alias("seg")), fragment_rows)
    ids = F.split("path", SEP)
    plain = F.transform(ids, lambda x: F.replace(F.replace(x, F.lit(ESCAPE + "1"), F.lit(SEP)), F.lit(ESCAPE + "0"), F.lit(ESCAPE)))
    return solved.where("state = 'tree'").select("grp", "node", F.when(F.contains("path", F.lit(ESCAPE)), plain).otherwise(ids).alias("path"))


def joined(path: Column, by: str = "/") -> Column:
    return F.array_join(path, by)


def ancestors(path_rows: DataFrame) -> DataFrame:
    """(grp, ancestor, node, distance) of every node of a tree and each node above it, that is all descendants, from ``paths``.

    The result is as large as the sum of the depths, which is what is asked for; it is made without a join.
    """
    above = path_rows.where(F.size("path") > 1).select("grp", "node", F.size("path").alias("n"), F.posexplode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("at", "ancestor"))
    return above.select("grp", "ancestor", "node", (F.col("n") - 1 - F.col("at")).alias("distance"))


def descendant_counts(above: DataFrame) -> DataFrame:
    return above.groupBy("grp", F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("descendants"), F.max("distance").alias("height"))


__all__ = ["FRAGMENT_ROWS", "ancestors", "descendant_counts", "hierarchy", "joined", "links", "paths", "solve"]
