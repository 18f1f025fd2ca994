"""Edge weights from hierarchy depths and type patterns, and relevance subgraphs around query nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved, saved_rows
from .closure import longest_depth
from .walks import HUBS, Blocks

#: Weight of an edge of which nothing is known, and the free constant of the formula (fixed values).
DEFAULT_WEIGHT, ALPHA = 0.0001, 0.0
RESTART, ROUNDS, BUDGET, PATH_LENGTH = 0.6, 80, 40, 10
#: Targets of a center-piece subgraph that the driver reads at once.
TARGETS = 64
#: Query nodes whose scores stand side by side in a walk.
ABREAST = 16
#: Nodes between others whose arcs are read before a path takes them.
MIDS = 1_000


def tree_depths(trees: dict[str, DataFrame]) -> DataFrame:
    """(tree, node, depth, height) of each hierarchy of child -> parent arcs."""
    out = None
    for name, arcs in trees.items():
        found = longest_depth(arcs).select(F.lit(name).alias("tree"), "node", "depth")
        out = found if out is None else out.unionByName(found)
    height = out.groupBy("tree").agg(F.max("depth").alias("height"))
    return out.join(height, "tree")


def edge_pi(edges: DataFrame, types: DataFrame) -> DataFrame:
    """(src, pid, dst, pi): per edge between typed nodes (src, pid, dst), how many edges share class, property and class.

    ``types`` holds (node, cls). An edge between nodes of several classes counts in each pattern and takes the largest.
    """
    typed = edges.join(types.toDF("src", "c1"), "src").join(types.toDF("dst", "c2"), "dst")
    pattern = typed.groupBy("c1", "pid", "c2").agg(F.count("*").alias("pi"))
    return typed.join(pattern, ["c1", "pid", "c2"]).groupBy("src", "pid", "dst").agg(F.max("pi").alias("pi"))


def edge_weights(edges: DataFrame, depths: DataFrame, pi: DataFrame) -> DataFrame:
    """(src, pid, dst, weight) of edges: the mean of the property's specificity, the two ends' specificity per degree in
    the class and part hierarchies, the inverse pattern count and the constant. Unknown parts count 0; an edge of which
    all is unknown has the default weight. ``depths`` is ``tree_depths`` of 'sc', 'sp' and 'po'.
    """
    mu = depths.select("tree", "node", (F.col("depth") / F.col("height")).alias("mu"))
    degree = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    per = mu.where("tree <> 'sp'").join(degree, "node").groupBy("node").agg(F.sum(F.col("mu") / F.col("degree")).alias("share"))
    of_property = mu.where("tree = 'sp'").select(F.col("node").alias("pid"), F.col("mu").alias("mu_p"))
    out = edges.join(of_property, "pid", "left").join(per.toDF("src", "su"), "src", "left").join(per.toDF("dst", "sv"), "dst", "left")
    out = out.join(pi, ["src", "pid", "dst"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    known = F.coalesce("mu_p", "su", "sv", "pi").isNotNull()
    value = (zero("mu_p") + 0.5 * (zero("su") + zero("sv")) + F.coalesce(1 / F.col("pi"), F.lit(0.0)) + ALPHA) / 5
    return out.select("src", "pid", "dst", F.when(known, value).otherwise(F.lit(DEFAULT_WEIGHT)).alias("weight"))


def transition(weighted: DataFrame) -> DataFrame:
    """(src, dst, weight) of the undirected graph, a row a pair of nodes; parallel edges add up."""
    edges = weighted.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def random_walks(step: DataFrame, queries: DataFrame, restart: float = RESTART, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """(query, node, score): random walk with restart from each query node, a fixed number of rounds or until no score moves.

    ``step`` is a ``transition``, which is read several times; a node passes its score on in proportion to the weights. A node's
    scores of up to ``ABREAST`` query nodes stand side by side. Every fourth round is checkpointed.
    """
    starts = sorted(r["node"] for r in queries.select("node").distinct().collect())
    blocks = Blocks(step, starts) if starts else None
    found = None
    for k in range(0, len(starts), ABREAST):
        some = _walks_of(blocks, starts[k : k + ABREAST], restart, rounds, tolerance)
        found = some if found is None else found.unionByName(some)
    return queries.select(F.col("node").alias("query"), "node", F.lit(1.0).alias("score")).where("false") if found is None else found


def _walks_of(blocks: Blocks, starts: list[int], restart: float, rounds: int, tolerance: float | None) -> DataFrame:
    with blocks.rounds():
        sent = saved(blocks.first(starts))
        score = saved(blocks.scores(sent, starts))
        for k in range(1, rounds + 1):
            stop = k % 4 == 0 or k == rounds
            sent = blocks.moved(sent, starts, restart, stop and (tolerance is not None or k == rounds))
            if stop:
                sent = saved(sent)
            if stop and (tolerance is not None or k == rounds):
                last, score = score, saved(blocks.scores(sent, starts))
            if stop and tolerance is not None:
                gap = score.join(last.withColumnRenamed("score", "old"), ["query", "node"], "full_outer")
                if (gap.agg(F.max(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0] or 0.0) < tolerance:
                    break
        return score


def joint_scores(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """(node, score): the product of a node's scores over all query nodes; a node that one of them misses has none."""
    n = queries.select("node").distinct().count()
    found = scores.where("score > 0").groupBy("node").agg(F.count("*").alias("n"), F.exp(F.sum(F.log("score"))).alias("score"))
    return found.where(F.col("n") == n).select("node", "score")


def center_piece(
    weighted: DataFrame, queries: DataFrame, budget: int = BUDGET, path_length: int = PATH_LENGTH, rounds: int = ROUNDS
) -> DataFrame:
    """(src, pid, dst, weight) of a small connected subgraph that best links the query nodes.

    Scores of all nodes come from distributed walks. Key paths are then taken greedily, each
    searched over all edges: the best node not yet tried is linked with every query node by
    the path of adjacent nodes with the largest sum of scores per new node, until ``budget``
    nodes are taken. The driver holds the taken nodes and the next ``TARGETS`` targets.
    """
    ties = saved(transition(weighted))
    scores = saved(joint_scores(random_walks(ties, queries, rounds=rounds), queries))
    sources = sorted(r["node"] for r in queries.select("node").distinct().collect())
    value = {s: 0.0 for s in sources} | {r["node"]: r["score"] for r in scores.where(F.col("node").isin(sources)).collect()}
    wide = lambda nodes, within=False: _around(ties, scores, nodes, within)
    taken, near, covered = set(sources), None, set()
    for ahead in _targets(scores, sources):
        for k, (target, score) in enumerate(ahead):
            if len(taken) >= budget + len(sources):
                break
            for s in sources:
                if not taken | {target} <= covered:
                    covered = taken | {t for t, _ in ahead[k:]}
                    covered |= _between(saved(wide(covered)), covered)
                    near = saved(wide(covered))
                taken.update(_key_path(near, taken, s, value[s], target, score, path_length, wide) or ())
        else:
            continue
        break
    # A filter that Spark takes down to the source, so that the weights need not be kept.
    return weighted.where(F.col("src").isin(sorted(taken)) & F.col("dst").isin(sorted(taken))).select("src", "pid", "dst", "weight")


def _targets(scores: DataFrame, sources: list[int]) -> Iterator[list[tuple[int, float]]]:
    """All scored nodes but the query nodes, with their scores, best first, ``TARGETS`` at once."""
    left = scores.where(~F.col("node").isin(sources))
    last = F.lit(True)
    while found := left.where(last).orderBy(F.desc("score"), "node").limit(TARGETS).collect():
        yield [(r["node"], r["score"]) for r in found]
        node, score = found[-1]["node"], found[-1]["score"]
        last = (F.col("score") < score) | ((F.col("score") == score) & (F.col("node") > node))


def _around(ties: DataFrame, scores: DataFrame, nodes: set[int] | DataFrame, within: bool = False) -> DataFrame:
    """(src, dst, value): the arcs of both directions with an end among the nodes (``within``: both ends), and the score of the node they lead to.

    A node that a query node misses scores 0, and may still lie on a path.
    """

    def of(arcs: DataFrame, end: str) -> DataFrame:
        if isinstance(nodes, set):
            return arcs.where(F.col(end).isin(sorted(nodes)))
        return arcs.join(nodes.withColumnRenamed("node", end), end, "left_semi").select("src", "dst")

    ties = ties.select("src", "dst")
    out = of(of(ties, "src"), "dst") if within else of(ties, "src").union(of(ties, "dst")).distinct()
    both = out.union(out.select("dst", "src"))
    return both.join(scores.toDF("dst", "value"), "dst", "left").select("src", "dst", F.coalesce("value", F.lit(0.0)).alias("value"))


def _between(arcs: DataFrame, nodes: set[int]) -> set[int]:
    """Nodes that paths between the given ones are likely to take: the best one between each two of them, ``MIDS`` of these at most."""
    known = sorted(nodes)
    first = arcs.where(F.col("src").isin(known) & ~F.col("dst").isin(known)).toDF("a", "mid", "gain")
    found = first.join(first.select(F.col("a").alias("b"), "mid"), "mid").where("a < b").groupBy("a", "b").agg(F.max(F.struct("gain", -F.col("mid"), "mid")).alias("best"))
    return {r["mid"] for r in found.select("best.gain", "best.mid").distinct().orderBy(F.desc("gain"), "mid").limit(MIDS).collect()}


def _key_path(
    steps: DataFrame, taken: set[int], source: int, value: float, target: int, score: float, most: int, wide: Callable[[DataFrame, bool], DataFrame] | None = None
) -> list[int] | None:
    """The path from source to target, through nodes of rising closeness to the target's score order, with the most score per new node.

    ``steps`` holds all arcs of the taken nodes and the target; ``wide`` gives those of other nodes, or between them, if there are more.
    A state (node, new nodes) keeps its largest sum, and of equal ones the first found; it comes from states of as many new
    nodes or fewer. First come paths with one new node at most between each two of the taken nodes and the target. Where a
    bound tells that more new nodes in a row can win, rounds over the arcs in reach follow, up to a number of new nodes that grows.
    """
    allowed = _allowed(steps, taken, target, score)
    arcs, held = _links(allowed, sorted(taken | {target}), max(most // 2, 1))
    held[source] = value
    best, done = _best(_states(arcs, source, value, most, most), target), 0
    while limit := _limit(arcs, held, taken, source, target, score, best and best[0], done, most):
        done = min(limit, done + 2 if done else 3)
        found = _wide_path(steps, taken, source, value, target, score, most, done, wide)
        best = max((x for x in (best, found) if x), default=None)
    return best and best[3]


def _allowed(steps: DataFrame, taken: set[int], target: int, score: float) -> DataFrame:
    known = F.col("dst").isin(sorted(taken))
    allowed = steps.where(known | (F.col("value") < score) | ((F.col("value") == score) & (F.col("dst") <= target)))
    return allowed.select("src", "dst", F.col("value").alias("gain"), F.when(known, 0).otherwise(1).alias("fresh"))


def _limit(
    arcs: dict[int, list[tuple[int, float, int]]], held: dict[int, float], taken: set[int], source: int, target: int, score: float, best: float | None, done: int, most: int
) -> int:
    """The most new nodes, above ``done``, of a path that may reach the best score per new node with two or more new nodes in a row; else 0.

    Going on to a taken node needs no new node if another one is its neighbour, one if they share a neighbour, else two. With two
    in a row on the way to one of them, or to the target, the others must do with the rest of the new nodes.
    """
    if best is None:
        return most if done < most else 0
    fresh = int(target not in taken)
    near = taken | {target}
    enter = {n: 2 for n in near}
    for src, found in arcs.items():
        for dst, _, _ in found:
            if src != target and dst in near:
                enter[dst] = min(enter[dst], 0 if src in near else 1)
    others = taken - {source, target}

    def worth(left: set[int], room: int) -> float:
        sums = [0.0] * (room + 1)
        for n in left:
            for k in range(room, enter[n] - 1, -1):
                sums[k] = max(sums[k], sums[k - enter[n]] + held.get(n, 0.0))
        return sums[room]

    for n in range(most, done, -1):
        mids = n - fresh
        ways = [worth(others, mids - 2)] if mids >= 2 else []
        if mids - 2 >= enter[target]:
            ways += [held.get(z, 0.0) + worth(others - {z}, mids - 2 - enter[target]) for z in others]
        if ways and (held[source] + max(ways) + score * (mids + 1)) / n * (1 + 1e-9) >= best:
            return n
    return 0


def _wide_path(
    steps: DataFrame, taken: set[int], source: int, value: float, target: int, score: float, most: int, limit: int, wide: Callable[[DataFrame, bool], DataFrame] | None
) -> tuple | None:
    """The best path of up to ``limit`` new nodes, over all arcs that so many new nodes in a row can reach from both sides."""
    # The k-th of so many new nodes in a row is k arcs at most from the taken node before it, or from the one behind it.
    spark = steps.sparkSession
    row = limit - (target not in taken)
    nodes = F.broadcast(spark.createDataFrame([(n,) for n in sorted(taken | {target})], "node long"))
    for k in range(1, row // 2 + 1 if wide else 0):
        reached = _allowed(steps, taken, target, score).join(nodes.toDF("src"), "src", "left_semi").select(F.col("dst").alias("node"))
        nodes, n_nodes = saved_rows(nodes.union(reached).distinct())
        nodes = F.broadcast(nodes) if n_nodes <= HUBS else nodes
        steps = saved(wide(nodes, 2 * k == row))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    allowed = saved(_allowed(steps, taken, target, score).repartition(parts, "src").sortWithinPartitions("src"))
    # A state of all the new nodes that may be matters at the target only, if that is new.
    last = limit if target in taken else F.when(F.col("dst") == target, limit).otherwise(limit - 1)
    state = spark.createDataFrame([(source, 0, -value, True, source, 0, [source])], "node long, new int, cost double, moved boolean, via long, via_new int, path array<long>")
    for _ in range(most):
        reached = (
            state.where("moved")
            .join(allowed, F.col("node") == F.col("src"))
            .where(~F.array_contains("path", F.col("dst")) & (F.col("new") + F.col("fresh") <= last))
            .select(
                F.col("dst").alias("node"), (F.col("new") + F.col("fresh")).alias("new"), (F.col("cost") - F.col("gain")).alias("cost"),
                F.lit(True).alias("moved"), F.col("node").alias("via"), F.col("new").alias("via_new"), F.concat("path", F.array("dst")).alias("path"),
            )
        )
        first = F.min(F.struct("cost", "moved", "via", "via_new", "path")).alias("best")
        found = state.withColumn("moved", F.lit(False)).unionByName(reached).groupBy("node", "new").agg(first).select("node", "new", "best.*")
        state, moved = saved_rows(found, "moved")
        if not moved:
            break
    return _best({(target, r["new"]): (r["cost"], list(r["path"])) for r in state.where(F.col("node") == target).collect()}, target)


def _best(states: dict[tuple[int, int], tuple], target: int) -> tuple | None:
    """(score per new node, .., path) of the best state at the target."""
    return max(((-cost / max(new, 1), -len(path), -new, path) for (node, new), (cost, *_, path) in states.items() if node == target), default=None)


def _links(allowed: DataFrame, near: list[int], mids: int) -> tuple[dict[int, list[tuple[int, float, int]]], dict[int, float]]:
    """Arcs (dst, gain, fresh) by source between the nodes ``near``, straight and by the best ``mids`` other nodes between each two; and the nodes' values."""
    out = allowed.where(F.col("src").isin(near))
    straight = out.where(F.col("dst").isin(near)).select("src", F.lit(None).cast("long").alias("mid"), F.lit(None).cast("double").alias("mid_gain"), "dst", "gain", "fresh")
    first = out.where(~F.col("dst").isin(near)).select("src", F.col("dst").alias("mid"), F.col("gain").alias("mid_gain"))
    second = allowed.where(F.col("dst").isin(near) & ~F.col("src").isin(near)).select(F.col("src").alias("mid"), "dst", "gain", "fresh")
    turn = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("mid_gain"), "mid"))
    between = first.join(second, "mid").where("src <> dst").withColumn("turn", turn).where(F.col("turn") <= mids)
    arcs, held = {}, {}
    for r in straight.unionByName(between.drop("turn")).collect():
        held[r["dst"]] = r["gain"]
        way = [(r["src"], r["dst"], r["gain"], r["fresh"])]
        if r["mid"] is not None:
            way = [(r["src"], r["mid"], r["mid_gain"], 1), (r["mid"], r["dst"], r["gain"], r["fresh"])]
        for src, *arc in way:
            arcs.setdefault(src, set()).add(tuple(arc))
    return {src: sorted(found) for src, found in arcs.items()}, held


def _states(arcs: dict[int, list[tuple[int, float, int]]], source: int, value: float, most: int, limit: int) -> dict[tuple[int, int], tuple]:
    """{(node, new): (cost, via, via_new, path)} after at most ``most`` rounds, with up to ``limit`` new nodes."""
    state = {(source, 0): (-value, source, 0, [source])}
    moved = list(state)
    for _ in range(most):
        reached = {}
        for node, new in moved:
            cost, _, _, path = state[node, new]
            for dst, gain, fresh in arcs.get(node, ()):
                if dst not in path and new + fresh <= limit:
                    found = (cost - gain, node, new, [*path, dst])
                    reached[dst, new + fresh] = min(found, reached.get((dst, new + fresh), found))
        moved = [k for k, found in reached.items() if k not in state or found[0] < state[k][0]]
        if not moved:
            break
        state |= {k: reached[k] for k in moved}
    return state


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k nodes of the largest score, ties by node."""
    turn = F.row_number().over(Window.orderBy(F.desc("score"), "node"))
    return scores.orderBy(F.desc("score"), "node").limit(k).withColumn("turn", turn)

