"""Graph fixpoints over edge tables: components, chains and greedy selection.

Each loop cuts its lineage to the shared checkpoint folder and stops on an emptiness test, never on
collected rows. Nodes may be of any type that sorts; tables of every size take the same path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from moteflow.session import cut, discard


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Contraction: each node hooks to its smallest neighbour, pointers are jumped twice, and the edge
    table is rewritten between the images and deduplicated. A round at least halves the nodes of every
    unfinished component, so there are O(log n) rounds and the first one dominates. A hub with a large
    share of the edges is pre-aggregated by the minimum and disappears in its first round.
    """
    e = cut(edges.where(F.col(a) != F.col(b))
            .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    rounds = []
    while not e.isEmpty():
        both = e.select(F.col("u").alias("node"), F.col("v").alias("m")) \
            .unionByName(e.select(F.col("v").alias("node"), F.col("u").alias("m")))
        hook = both.groupBy("node").agg(F.min("m").alias("m")) \
            .select("node", F.least("node", "m").alias("to"))
        hook = cut(_jump(_jump(hook)))
        rounds.append(hook)
        before, e = e, cut(e.join(hook.withColumnsRenamed({"node": "u", "to": "u2"}), "u")
                           .join(hook.withColumnsRenamed({"node": "v", "to": "v2"}), "v")
                           .where("u2 <> v2")
                           .select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).distinct())
        discard(before)
    if not rounds:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = rounds[-1].withColumnRenamed("to", "component")
    for hook in reversed(rounds[:-1]):
        out = hook.join(out.withColumnRenamed("node", "to"), "to", "left") \
            .select("node", F.coalesce("component", "to").alias("component"))
    return out


def _jump(ptr: DataFrame) -> DataFrame:
    nxt = ptr.select(F.col("node").alias("to"), F.col("to").alias("to2"))
    return ptr.join(nxt, "to", "left").select("node", F.coalesce("to2", "to").alias("to"))


def chain_heads(nodes: DataFrame, links: DataFrame, node: str = "node") -> DataFrame:
    """(node, head) where ``links(prev, next)`` has degree at most one on each side.

    Pointer doubling: after k rounds a pointer has moved 4**k links back, so a chain as long as the
    movie needs half log2(frames) rounds."""
    ptr = nodes.select(F.col(node).alias("node")) \
        .join(links.select(F.col("next").alias("node"), F.col("prev").alias("to")), "node", "left") \
        .select("node", F.coalesce("to", "node").alias("to"))
    ptr = cut(ptr)
    while True:
        new = cut(_jump(_jump(ptr)))
        moved = new.join(ptr.withColumnRenamed("to", "old"), "node").where("to <> old")
        done = moved.isEmpty()
        discard(ptr)
        ptr = new
        if done:
            return ptr.withColumnRenamed("to", "head")


def greedy_keep(ids: DataFrame, better: DataFrame) -> DataFrame:
    """Greedy selection in rank order: keep a row unless a better-ranked *kept* row conflicts with it.

    ``ids(id)`` are the candidates, ``better(win, lose)`` the conflicts directed from the better to the
    worse row (acyclic, since ranks are total). Rows without an undecided better rival are kept, their
    losers dropped, and the rest re-examined until nothing is undecided.
    """
    kept_parts = []
    edges = cut(better)
    open_ = cut(ids)
    while True:
        kept = cut(open_.join(edges.select(F.col("lose").alias("id")).distinct(), "id", "left_anti"))
        kept_parts.append(kept)
        lost = edges.join(kept.withColumnRenamed("id", "win"), "win", "left_semi") \
            .select(F.col("lose").alias("id")).distinct()
        decided = cut(kept.unionByName(lost))
        open_ = cut(open_.join(decided, "id", "left_anti"))
        if open_.isEmpty():
            break
        old, edges = edges, cut(edges.join(decided.withColumnRenamed("id", "win"), "win", "left_anti")
                                .join(decided.withColumnRenamed("id", "lose"), "lose", "left_anti"))
        discard(old, decided)
    out = kept_parts[0]
    for k in kept_parts[1:]:
        out = out.unionByName(k)
    return out
