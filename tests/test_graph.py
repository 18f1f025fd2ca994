"""Graph operators on a micro fixture with hand-computed answers, and on random graphs against plain search."""

import random
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.functions.text import last_ancestors, like_escaped, matches, normalized_literal, path_ids, split_terms
from graphmill.model import GraphError, Graph, nid, node_id, parsed_id, resource_types, rid_of, rtid_of
from graphmill.operators import category, closure, dag, infer, labels, search, setjoin, termindex, traverse, walks, weights

NAMES = dict(zip("ABCDEFX", range(1, 8), strict=True))
SUB = ["BA", "CA", "DB", "DC", "ED", "EA", "FE"]
PROPS = [(1, "subClassOf"), (2, "part_of"), (3, "proper_part_of"), (4, "equivalentClass"), (5, "synonym"), (6, "label"), (7, "has_part"), (8, "type")]


def path_graph_walk(n: int, c: float, rounds: int) -> list[float]:
    """Scores of a walk from the first node of a path of n nodes."""
    r = [1.0] + [0.0] * (n - 1)
    deg = [1 if k in (0, n - 1) else 2 for k in range(n)]
    for _ in range(rounds):
        new = [(1 - c) if k == 0 else 0.0 for k in range(n)]
        for k in range(n):
            for j in (k - 1, k + 1):
                if 0 <= j < n:
                    new[j] += c * r[k] / deg[k]
        r = new
    return [round(x, 9) for x in r]


def make(spark, edges, classes=NAMES, literals=(), hidden=(), obsolete=(), subs=((3, 2),)):
    nodes = [(r, 1, n, n, 1, False, n in obsolete, f"http://x#{n}") for n, r in classes.items()]
    nodes += [(100 + k, 13, t, t, 1, False, False, None) for k, t in enumerate(literals)]
    nodes += [(i, 15, n, n, 1, False, False, f"http://x#{n}") for i, n in PROPS]
    schema = "rid long, rtid int, name string, label string, kbid int, anonymous boolean, is_obsolete boolean, uri string"
    key = spark.createDataFrame([(*e, k in hidden) for k, e in enumerate(edges)], "rid1 long, rtid1 int, pid long, rid2 long, rtid2 int, hidden boolean")
    flags = "id long, name string, is_object boolean, is_transitive boolean, is_symmetric boolean, is_functional boolean, is_datatype boolean, is_annotation boolean, is_system boolean, kbid int"
    return Graph(
        spark.createDataFrame(nodes, schema),
        infer.as_edges(key),
        spark.createDataFrame([(i, n, True, False, n == "equivalentClass", False, False, n in ("synonym", "label"), True, 1) for i, n in PROPS], flags),
        spark.createDataFrame([(c, p, 1) for c, p in subs], "childid long, parentid long, kbid int"),
        spark.createDataFrame([(2, 7, 1)], "propertyid1 long, propertyid2 long, kbid int"),
        spark.createDataFrame([(1, "one"), (2, "two"), (3, "two")], "id int, name string"),
    )


@pytest.fixture(scope="module")
def micro(spark):
    return make(spark, [(NAMES[a], 1, 1, NAMES[b], 1) for a, b in SUB])


def arcs(spark, pairs=SUB):
    return spark.createDataFrame([(NAMES[a], NAMES[b]) for a, b in pairs], "src long, dst long")


@pytest.fixture(scope="module")
def index(spark):
    return dag.closure_index(arcs(spark)).cache()


def pairs(df, *columns):
    back = {v: k for k, v in NAMES.items()}
    return {"".join(back[r[c]] for c in columns[:2]) + str(r[columns[2]] if len(columns) > 2 else "") for r in df.collect()}


def seed(spark, *names):
    return spark.createDataFrame([(NAMES[n], 1) for n in names], "rid long, rtid int")


def test_edge_closure(spark, micro):
    got = traverse.closure_by_property(micro, seed(spark, "A"), "subClassOf", incoming=True)
    assert pairs(got, "rid1", "rid2", "depth") == {"BA1", "CA1", "EA1", "DB2", "DC2", "FE2", "ED3"}
    with pytest.raises(GraphError):
        traverse.closure_by_property(micro, seed(spark, "A"), "nothing", incoming=True)


def test_closure_pairs(index):
    want = "BA1 CA1 DA2 DB1 DC1 EA1 EB2 EC2 ED1 FA2 FB3 FC3 FD2 FE1".split()
    assert pairs(index, "desc", "anc", "hops") == set(want)


def test_counts_and_ancestry(spark, index):
    got = {r["node"]: r for r in dag.neighbor_counts(index).collect()}
    assert [got[1][c] for c in ("desc_all", "desc_1", "desc_2")] == [5, 3, 5]
    assert [got[6][c] for c in ("anc_all", "anc_1", "anc_2")] == [5, 1, 3]
    asked = spark.createDataFrame([(6, 3), (3, 6), (1, 1)], "n1 long, n2 long")
    assert {(r["n1"], r["n2"]): r["is_anc"] for r in dag.is_ancestor(index, asked).collect()} == {(6, 3): True, (3, 6): False, (1, 1): True}
    one = lambda n, h=None: dag.estimate_count(index, spark.createDataFrame([(n,)], "node long"), h).first()[0]
    assert (one(1), one(1, 1), one(6), one(7)) == (5, 3, 0, -1)
    assert pairs(dag.ancestors(index, spark.createDataFrame([(6,)], "node long"), 2), "node", "anc", "hops") == {"FA2", "FD2", "FE1"}


def test_lca(spark, index):
    groups = [(1, "B"), (1, "C"), (2, "E"), (2, "D"), (3, "F"), (3, "C"), (4, "X"), (4, "A"), (5, "D")]
    rows = spark.createDataFrame([(g, NAMES[n]) for g, n in groups], "grp int, node long")
    assert {r["grp"]: r["lca"] for r in dag.lowest_common_ancestors(index, rows).collect()} == {1: 1, 2: 4, 3: 3, 5: 4}


def test_packed_closure(spark, index, monkeypatch):
    loop = spark.createDataFrame([(2, 1), (3, 2), (2, 3), (4, 3)], "src long, dst long")
    rows = lambda df: sorted(map(tuple, df.select("desc", "anc", "hops").collect()))
    assert rows(dag.unpacked_index(dag.packed_index(loop))) == rows(dag.closure_index(loop))
    monkeypatch.setattr(dag, "all_pairs", None)
    packed = dag.packed_index(arcs(spark))
    assert rows(dag.unpacked_index(packed)) == rows(index)
    groups = spark.createDataFrame([(1, 6), (1, 3), (2, 5), (2, 4)], "grp int, node long")
    seen = []
    monkeypatch.setattr(dag, "named_by", lambda left, key, right, by: seen.append(right.selectExpr("sum(size(up)) as n").first()[0]) or closure.named_by(left, key, right, by))
    assert sorted(map(tuple, dag.lowest_common_ancestors(packed, groups).collect())) == [(1, 3), (2, 4)]
    assert seen == [4]  # the single hops above A, B, C and D


def test_paths(spark, index):
    got = dag.shortest_paths(arcs(spark), index, spark.createDataFrame([(6, 1), (6, 2), (1, 6)], "desc long, anc long")).orderBy("step").collect()
    path = lambda a: [r["node"] for r in got if r["anc"] == a]
    assert path(1) == [6, 5, 1] and path(2) == [6, 5, 4, 2]


def test_longest_depth_and_cycles(spark):
    got = {r["node"]: r["depth"] for r in closure.longest_depth(arcs(spark)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5}
    loop = spark.createDataFrame([(2, 1), (3, 2), (2, 3)], "src long, dst long")
    with pytest.raises(GraphError):
        closure.longest_depth(loop)
    assert closure.all_pairs(loop).count() == 4
    with pytest.raises(GraphError):
        dag.closure_index(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_inherited_edges(spark):
    edges = [(NAMES[a], 1, 1, NAMES[b], 1) for a, b in SUB] + [(1, 1, 2, 7, 1), (3, 1, 3, 7, 1)]
    g = make(spark, edges)
    got = infer.inheritable_edges(g, 2, traverse.expand_properties(g, [2])).collect()
    # every class below A or C gets the property of the nearest ancestor that has one
    assert {(r["rid1"], r["pid"]) for r in got if r["rid1"] in (2, 4)} == {(2, 2), (4, 3)} | {(4, 2)} & {(r["rid1"], r["pid"]) for r in got}
    assert {r["rid1"] for r in got} == {2, 4, 5, 6} and all(r["rid2"] == 7 and r["derived"] for r in got)


def inherited_plainly(arcs, own):
    """(rid1, pid, rid2) inherited, by plain search from each class to the nearest ones with an edge to the object."""
    found = set()
    for start in {a for a, _ in arcs}:
        for x in {x for _, _, x in own}:
            seen, ring = {start}, {start}
            while ring and not (hit := {p for n, p, y in own if n in ring and y == x}):
                ring = {b for a, b in arcs if a in ring} - seen
                seen |= ring
            if ring and start not in ring:
                found |= {(start, p, x) for p in hit}
    return found


@pytest.mark.parametrize("cyclic", [False, True])
def test_inherited_edges_on_random_graphs(spark, monkeypatch, cyclic):
    draw = random.Random(5)
    pairs = {(a, draw.randrange(1, a)) for a in range(2, 25) for _ in range(2)} | ({(3, 20)} if cyclic else set())
    own = {(draw.randrange(1, 25), draw.choice([2, 3]), draw.randrange(50, 56)) for _ in range(14)}
    g = make(spark, [(a, 1, 1, b, 1) for a, b in sorted(pairs)] + [(a, 1, p, x, 13) for a, p, x in sorted(own)])
    monkeypatch.setattr(infer, "OBJECTS", 2, raising=False)  # several bins
    monkeypatch.setattr(infer, "LISTS", 3, raising=False)  # several tasks
    for subs in ([], [3]):
        held = {e for e in own if e[1] in (2, *subs)}
        got = [(r["rid1"], r["pid"], r["rid2"]) for r in infer.inheritable_edges(g, 2, subs).collect()]
        assert len(got) == len(set(got)) and set(got) == inherited_plainly(pairs, held)


def test_inherited_edges_of_nothing(spark, micro):
    assert infer.inheritable_edges(micro, 2, []).count() == 0
    assert infer.inheritable_edges(make(spark, [(1, 1, 2, 7, 1)]), 2, [3]).count() == 0


def test_inheriting_reads_the_layers_above_only(spark, monkeypatch):
    reads = []
    for name in ("saved", "saved_rows"):
        kept = getattr(infer, name)
        monkeypatch.setattr(infer, name, lambda df, *a, kept=kept: reads.append(df._jdf.queryExecution().analyzed().toString().count("LogicalRDD")) or kept(df, *a))
    chain = {f"C{k}": k for k in range(1, 11)}
    g = make(spark, [(k, 1, 1, k - 1, 1) for k in range(2, 11)] + [(1, 1, 2, 50, 13)], chain)
    assert infer.inheritable_edges(g, 2, []).count() == 9
    assert max(reads[2:]) <= 4, reads  # what is held is not gathered again each round


def test_neighborhood_walks_through_everything(spark, micro):
    got = traverse.neighborhood(traverse.chosen_edges(micro), seed(spark, "E"), hops=2)
    assert pairs(got, "rid1", "rid2") == {"ED", "EA", "DB", "DC"}
    whole = traverse.neighborhood(traverse.chosen_edges(micro), seed(spark, "F"), hops=None)
    assert whole.count() == 7
    assert traverse.chosen_edges(micro, ["unknown"]).count() == 0 and traverse.chosen_edges(micro, ["*"]).count() == 7
    rows, more = traverse.truncated(traverse.named(micro, micro.edges), 3)
    assert rows.count() == 3 and more
    with pytest.raises(GraphError):
        traverse.neighbors(micro, seed(spark, "A"), direction="up")


def test_self_loops_and_hidden(spark):
    g = make(spark, [(1, 1, 2, 1, 1), (1, 1, 2, 2, 1), (2, 1, 3, 3, 1), (3, 1, 2, 1, 1)], hidden={3})
    assert traverse.neighborhood(traverse.chosen_edges(g), seed(spark, "A"), None).count() == 2
    assert traverse.neighborhood(traverse.chosen_edges(g, hidden=True), seed(spark, "A"), None).count() == 3
    assert pairs(traverse.neighbors(g, seed(spark, "B"), ["part_of"], sub_properties=True), "rid1", "rid2") == {"BC"}


def test_equivalence_groups(spark):
    chain = {"P": 30, "Q": 31, "R": 32, "S": 40, "T": 41}
    edges = [(30, 1, 4, 31, 1), (31, 1, 4, 32, 1), (40, 1, 4, 41, 1), (30, 1, 1, 40, 1), (32, 1, 1, 41, 1), (31, 1, 2, 40, 1)]
    g = make(spark, edges, chain, obsolete={"P"})
    groups = infer.equivalence_groups(g)
    assert {(r["rid"], r["ridm"]) for r in groups.collect()} == {(31, 30), (31, 31), (31, 32), (40, 40), (40, 41)}
    moved = infer.move_equivalent_edges(g, groups).collect()
    assert {(r["rid1"], r["pid"], r["rid2"]) for r in moved} == {(30, 4, 31), (31, 4, 32), (40, 4, 41), (31, 1, 40), (31, 2, 40)}
    again = infer.move_equivalent_edges(Graph(g.nodes, infer.move_equivalent_edges(g, groups), g.properties, g.sub_properties, g.inverse_properties, g.kbs), groups)
    assert {(r["rid1"], r["pid"], r["rid2"]) for r in again.collect()} == {(r["rid1"], r["pid"], r["rid2"]) for r in moved}
    seeds = spark.createDataFrame([(30, 1), (99, 12)], "rid long, rtid int")
    g.extra["equivalence"] = groups
    assert {tuple(r) for r in traverse.representatives(g, seeds).collect()} == {(31, 1), (99, 12)}
    copied = infer.copy_across_equivalents(g).collect()
    assert (32, 1, 40) in {(r["rid1"], r["pid"], r["rid2"]) for r in copied}


def test_nested_sets(spark):
    # A = and(B, and(C, D)); E = or(F, B); X below the nested set itself
    edges = [(1, 1, 4, 50, 8), (5, 1, 4, 60, 9), (7, 1, 1, 51, 8)]
    g = make(spark, edges)
    both = spark.createDataFrame([(50, 2, 1), (50, 51, 8), (51, 3, 1), (51, 4, 1)], "id long, classid long, rtid int")
    either = spark.createDataFrame([(60, 6, 1), (60, 2, 1)], "id long, classid long, rtid int")
    got = {(r["rid1"], r["rid2"]) for r in infer.set_subclasses(g, both, either).where("rtid1 = 1 and rtid2 = 1").collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (7, 3), (7, 4), (6, 5), (2, 5)}


def test_small_rules(spark):
    g = make(spark, [(1, 1, 2, 2, 1), (3, 1, 5, 100, 13), (3, 1, 5, 101, 13)], literals=["c", "other"])
    assert {(r["rid1"], r["pid"], r["rid2"]) for r in infer.inverse_edges(g).collect()} == {(2, 7, 1)}
    assert {r["rid2"] for r in infer.without_duplicate_synonyms(g).where("pid = 5").collect()} == {101}
    mutual = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 4)], "c long, p long")
    assert [tuple(r) for r in infer.without_mutual(mutual, "c", "p").collect()] == [(3, 1)]
    d = spark.createDataFrame([(1, 10), (2, 11)], "pid long, rid long")
    r = spark.createDataFrame([(1, 20), (1, 21), (3, 22)], "pid long, rid long")
    assert {tuple(x) for x in infer.domain_range_edges(d, r, 0).collect()} == {(10, 1, 20), (10, 1, 21), (11, 2, 0), (0, 3, 22)}
    tree = make(spark, [(NAMES[a], 1, 1, NAMES[b], 1) for a, b in SUB])
    done = infer.propagate_obsolete(tree, seed(spark, "X"), seed(spark, "D"))
    assert {r["name"] for r in done.nodes.where("is_obsolete").collect()} == {"E", "F", "X"}
    assert pairs(done.live_edges, "rid1", "rid2") == {"BA", "CA", "DB", "DC"}
    hidden = make(spark, [(1, 1, 1, 9, 3), (9, 3, 2, 4, 1), (8, 3, 2, 4, 1)], hidden={1, 2})
    assert {x["rid1"] for x in infer.unhide_restrictions(hidden.edges).where("hidden").collect()} == {8}
    assert infer.delete_kb(g, 1).nodes.count() == 0 and infer.rename_kb(g, "two", "one").kbs.where("name = 'one'").count() == 2


def test_walk_scores(spark):
    line = spark.createDataFrame([(1, 1, 2, 1.0), (2, 1, 3, 1.0)], "src long, pid long, dst long, weight double")
    queries = spark.createDataFrame([(1,), (3,)], "node long")
    scores = weights.random_walks(weights.transition(line), queries)
    got = {(r["query"], r["node"]): round(r["score"], 6) for r in scores.collect()}
    want = path_graph_walk(3, 0.6, 80)
    assert [got[1, n] for n in (1, 2, 3)] == [round(x, 6) for x in want] == [0.5125, 0.375, 0.1125]
    joint = {r["node"]: round(r["score"], 6) for r in weights.joint_scores(scores, queries).collect()}
    assert joint == {1: 0.057656, 2: 0.140625, 3: 0.057656}
    piece = weights.center_piece(line.union(spark.createDataFrame([(7, 1, 8, 1.0)], line.schema)), queries, budget=3, rounds=8)
    assert {(r["src"], r["dst"]) for r in piece.collect()} == {(1, 2), (2, 3)}


def test_center_piece_through_low_scores(spark):
    # Node 3 is the only way between the query nodes, and 2,200 leaves have larger scores.
    rows = [(1, 1, 3, 1e-9), (3, 1, 2, 1e-9)] + [(k % 2 + 1, 1, 10 + k, 1.0) for k in range(2200)]
    weighted = spark.createDataFrame(rows, "src long, pid long, dst long, weight double")
    queries = spark.createDataFrame([(1,), (2,)], "node long")
    piece = weights.center_piece(weighted, queries, budget=1, rounds=4)
    assert {(1, 3), (3, 2)} < {(r["src"], r["dst"]) for r in piece.collect()}


def test_key_paths_without_wide_rounds(spark, monkeypatch):
    # Among the taken nodes and their links, with the same outcome as rounds over all edges.
    dice = random.Random(4)
    ties = {tuple(sorted(dice.sample(range(40), 2))) for _ in range(150)} | {(0, 1), (1, 2)}
    both = sorted(ties | {(b, a) for a, b in ties})
    value = {n: 1.0 if n < 3 else dice.random() / 1000 for n in range(40)}
    steps = spark.createDataFrame([(a, b, value[b]) for a, b in both], "src long, dst long, value double")
    ranked = sorted(range(3, 40), key=lambda n: (-value[n], n))
    rounds, saved_rows = [], weights.saved_rows
    monkeypatch.setattr(weights, "saved_rows", lambda *given: rounds.append(1) or saved_rows(*given))
    for taken, target in (({0, 1, 2}, ranked[0]), ({0, 1, 2, *ranked[:6]}, ranked[6]), ({0, 1, 2, *ranked[:4]}, ranked[2])):
        arcs = {}
        for a, b in both:
            if b in taken or value[b] < value[target] or (value[b] == value[target] and b <= target):
                arcs.setdefault(a, []).append((b, value[b], int(b not in taken)))
        want = weights._best(weights._states(arcs, 0, value[0], 6, 6), target)
        assert weights._key_path(steps, taken, 0, value[0], target, value[target], 6) == want[3]
    assert not rounds


def test_walks_in_blocks(spark, monkeypatch):
    # As by a dense matrix, whether an edge lies by its end of fewer edges or by itself; a start without edges keeps what restarts.
    dice = random.Random(7)
    rows = [(a, 1, b, dice.choice((1.0, 2.0, 0.5))) for a, b in {tuple(dice.sample(range(30), 2)) for _ in range(90)}] + [(0, 1, k, 1.0) for k in range(100, 160)]
    weighted = spark.createDataFrame(rows, "src long, pid long, dst long, weight double")
    starts = [0, 7, 29, 999]
    matrix = np.zeros((1000, 1000))
    for a, _, b, w in rows:
        matrix[a, b] += w
        matrix[b, a] += w
    total = matrix.sum(axis=0)
    matrix /= np.where(total > 0, total, 1)
    score = start = np.eye(1000)[:, starts]
    for _ in range(9):
        score = 0.6 * matrix @ score + 0.4 * start
    monkeypatch.setattr(walks, "LEAST", 20)
    for name, value in (("HUBS", walks.HUBS), ("HUBS", 1), ("APART", 3)):
        monkeypatch.setattr(walks, name, value)
        found = weights.random_walks(weights.transition(weighted), spark.createDataFrame([(n,) for n in starts], "node long"), rounds=9)
        got = {(r["query"], r["node"]): r["score"] for r in found.collect()}
        assert set(got) == {(q, n) for k, q in enumerate(starts) for n in np.flatnonzero(score[:, k] > 0)}
        assert all(abs(v - score[n, starts.index(q)]) < 1e-12 for (q, n), v in got.items())


def test_only_nodes_of_several_blocks_move(spark, monkeypatch):
    # 800 edges of 4 hubs: a leaf has its edges in one block, so that a round sends a score a leaf, not one an edge.
    rows = [(h, 1, 100 + n, 1.0) for h in range(4) for n in range(200)]
    monkeypatch.setattr(walks, "LEAST", 100)
    blocks = walks.Blocks(weights.transition(spark.createDataFrame(rows, "src long, pid long, dst long, weight double")), [0])
    assert len(blocks.ids) == 8
    sent = sum(len(r["data"]) for r in blocks.moved(blocks.first([0]), [0], 0.6, False).collect()) // 8
    assert 204 <= sent <= 200 + 4 * 8


def test_key_paths_by_way_of_query_nodes(spark, monkeypatch):
    # The best path leads through all query nodes with a node between each two: no round over all edges is needed.
    value = {0: 1.0, 1: 1.0, 2: 1.0, 10: 1e-4, 11: 1e-4, 12: 1e-4, 13: 1e-3} | {20 + k: 1e-6 for k in range(30)}
    ties = [(0, 10), (10, 1), (1, 11), (11, 2), (2, 12), (12, 13)] + [(20 + k, 20 + k + 1) for k in range(29)] + [(0, 20), (13, 49)]
    both = ties + [(b, a) for a, b in ties]
    steps = spark.createDataFrame([(a, b, value[b]) for a, b in both], "src long, dst long, value double")
    rounds, saved_rows = [], weights.saved_rows
    monkeypatch.setattr(weights, "saved_rows", lambda *given: rounds.append(1) or saved_rows(*given))
    assert weights._key_path(steps, {0, 1, 2}, 0, 1.0, 13, 1e-3, 10) == [0, 10, 1, 11, 2, 12, 13]
    assert not rounds


def test_key_paths_with_new_nodes_in_a_row(spark):
    # Arcs beyond those of the taken nodes are read where paths with more new nodes in a row can win.
    value = {0: 1.0, 1: 1.0, 9: 0.3} | {k: 0.2 for k in (3, 4, 5, 6)}
    ties = [(0, 3), (3, 4), (4, 5), (5, 9), (1, 6), (6, 9)]
    both = ties + [(b, a) for a, b in ties]
    steps = spark.createDataFrame([(a, b, value[b]) for a, b in both], "src long, dst long, value double")
    scores = spark.createDataFrame(list(value.items()), "node long, score double")
    wide = lambda nodes, within: weights._around(steps.where("src < dst"), scores, nodes, within)
    near = steps.where("src in (0, 1, 9) or dst in (0, 1, 9)")
    assert weights._key_path(near, {0, 1}, 0, 1.0, 9, 0.3, 10, wide) == [0, 3, 4, 5, 9]
    assert weights._key_path(near, {0, 1}, 1, 1.0, 9, 0.3, 10, wide) == [1, 6, 9]
    assert weights._key_path(near, {0, 1}, 0, 1.0, 9, 0.3, 3, wide) is None
    assert weights._wide_path(near, {0, 1}, 0, 1.0, 9, 0.3, 10, 4, wide)[3] == [0, 3, 4, 5, 9]
    assert weights._wide_path(near, {0, 1}, 0, 1.0, 9, 0.3, 10, 3, wide) is None


def test_edges_of_one_property_are_not_gathered(spark):
    g = make(spark, [(k, 1, 2, 1, 1) for k in range(2000)] + [(1, 1, 4, 2, 1)])
    g = replace(g, inverse_properties=spark.createDataFrame([(2, 7, 1)], "propertyid1 long, propertyid2 long, kbid int"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(infer.of_property(g, "part_of"))
        assert "BroadcastHashJoin" in plan(infer.move_equivalent_edges(g, spark.createDataFrame([(1, 2)], "rid long, ridm long")))
        assert "_salt" in plan(infer.inverse_edges(g))
        assert infer.inverse_edges(g).count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_index_below_without_the_closure(spark, index, monkeypatch):
    rows = lambda df: {(r["desc"], r["anc"], r["hops"]) for r in df.select("desc", "anc", "hops").collect()}
    whole = rows(index)
    monkeypatch.setattr(dag, "all_pairs", None)
    some = spark.createDataFrame([(NAMES["A"],), (NAMES["D"],)], "node long")
    below = dag.index_below(arcs(spark), some)
    assert rows(below) == {x for x in whole if x[1] in (1, 4)}
    assert rows(dag.index_below(arcs(spark), some, 2)) == {x for x in whole if x[1] in (1, 4) and x[2] <= 2}
    cats = some.withColumnRenamed("node", "cat")
    found = lambda i: {(r["rid"], r["cat"]) for r in category.categorised(i, cats).collect()}
    assert found(below) == found(index) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)}
    for node in (1, 4, 6, 99):
        one = spark.createDataFrame([(node,)], "node long")
        for hops, incoming in ((None, True), (2, True), (None, False), (1, False)):
            assert dag.near_count(arcs(spark), one, hops, incoming).first()[0] == dag.estimate_count(index, one, hops, incoming).first()[0]


def test_searches(spark):
    g = make(spark, [(1, 1, 5, 100, 13), (2, 1, 6, 101, 13)], {"Cerebellum": 1, "cerebral 50%": 2, "Brain": 3}, ["little brain", "Cere_label"])
    assert [r["name"] for r in search.search_names(g, "Cere", prefix=True).collect()] == ["Cerebellum", "cerebral 50%"]
    assert {r["name"] for r in search.search_names(g, "50%").collect()} == {"cerebral 50%"}
    assert {r["name"] for r in search.search_names(g, "cere", negated=True).collect()} == {"Brain"}
    assert {tuple(r) for r in search.ids_by_term(g, ["LITTLE brain", "brain"]).collect()} == {
        (1, 1, "little brain"), (3, 1, "Brain"), (100, 13, "little brain"),
    }
    assert {r["name"] for r in search.search_like(g, "cere_").collect()} == {"Cere_label"}
    assert {r["name"] for r in search.search_like(g, "brai").collect()} == {"Brain"}
    assert {r["name"] for r in search.search_regex(g, "^c.*m$").collect()} == {"Cerebellum"}
    assert search.kb_id(g, "one") == 1
    for name in ("two", "none"):
        with pytest.raises(GraphError):
            search.kb_id(g, name)
    terms = search.term_dictionary(g).withColumn("category", F.lit("x"))
    best = search.reconcile(terms, "brain").collect()
    assert [(r["term"], r["score"], r["is_match"]) for r in best][0] == ("Brain", 0.98, True)
    with pytest.raises(GraphError):
        search.reconcile(terms, "brain", type_strict="all")
    suggested = search.autocomplete(spark.createDataFrame([("Abc",), ("abc",), ("abd",), ("regional part of x",)], "term string"), "ab")
    assert sorted(r["term"] for r in suggested.collect()) == ["abc", "abd"]
    many = search.search_concepts(g, "cere", {"synonyms": ["synonym"], "labels": ["label"]}).collect()
    assert {(r["name"], r["synonyms"], r["labels"]) for r in many} >= {("Cerebellum", "little brain", "")}


def test_set_joins(spark):
    edges = [(k, 1, 2, k // 2, 1) for k in range(1, 40)] + [(k, 1, 3, 100 + k, 12) for k in range(0, 40, 3)]
    g = make(spark, edges)
    numbers = setjoin.numbered(g.edges).cache()
    assert sorted(r["num"] for r in numbers.collect()) == list(range(1, numbers.count() + 1))
    bits = setjoin.bitmap_index(g.edges, numbers, ("pid",), "object")
    for pid in (2, 3):
        got = {tuple(r) for r in setjoin.members(bits.where(f"pid = {pid}"), numbers).collect()}
        assert got == {(e[3], e[4]) for e in edges if e[2] == pid} == {tuple(r) for r in setjoin.select_objects(g.edges, pid).collect()}
    assert {r["rid"] for r in setjoin.property_join(g.edges, 2, 3, "ss").collect()} == set(range(3, 40, 3))
    assert {r["rid"] for r in setjoin.property_join(g.edges, 3, 2, "so").collect()} == {k for k in range(0, 20, 3)}
    assert setjoin.property_join(g.edges, 3, 99, "oo").count() == 0
    assert {r["pid"] for r in setjoin.select_properties(g.edges, (6, 1)).collect()} == {2, 3}
    with pytest.raises(ValueError):
        setjoin.property_join(g.edges, 2, 3, "xx")


def test_categories(spark, index):
    cats = spark.createDataFrame([(1,), (4,)], "cat long")
    got = pairs(category.categorised(index, cats), "rid", "cat")
    assert got == {"AA", "BA", "CA", "DD", "ED", "FD"}
    direct = spark.createDataFrame([(70, 6)], "cell long, region long")
    assert {r["region"] for r in category.located(direct, [], index, index.where("false")).collect()} == {1, 2, 3, 4, 5, 6}


def test_random_graphs_agree_with_plain_search(spark):
    rng = random.Random(11)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(70)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    plain = {}
    for s in range(40):
        seen, frontier, hop = {s: 0}, {s}, 0
        while frontier:
            hop += 1
            frontier = {b for a, b in edges if a in frontier} - set(seen)
            seen |= dict.fromkeys(frontier, hop)
        plain |= {(s, n): h for n, h in seen.items()}
    got = closure.reach(df, spark.createDataFrame([(k,) for k in range(40)], "seed long"))
    assert {(r["seed"], r["node"]): r["hops"] for r in got.collect()} == plain
    short = closure.reach(df, spark.createDataFrame([(0,)], "seed long"), 2)
    assert {r["node"] for r in short.collect()} == {n for (s, n), h in plain.items() if s == 0 and h <= 2}
    everyone = closure.all_pairs(df)
    assert {(r["src"], r["dst"]): r["hops"] for r in everyone.collect()} == {k: v for k, v in plain.items() if v}


def test_ids_and_text(spark):
    df = spark.createDataFrame([("5-13", "a\tb é | c| d", "1.20.3", "1 2 3 4")], "i string, t string, p string, q string")
    row = df.select(*parsed_id("i"), normalized_literal("t"), path_ids("p"), last_ancestors("q", 2), last_ancestors("q", 0)).first()
    assert list(row) == [5, 13, "a b e c d", [1, 20, 3], [2, 3], [1, 2, 3]]
    with pytest.raises(Exception, match="malformed id"):
        df.select(parsed_id("t")[0]).collect()
    packed = spark.createDataFrame([(77, 12)], "rid long, rtid int").withColumn("n", nid("rid", "rtid"))
    assert tuple(packed.select(rid_of("n"), rtid_of("n"), node_id(F.col("rid"), F.col("rtid"))).first()) == (77, 12, "77-12")
    assert like_escaped("5%_#") == "5#%#_##" and split_terms(r"a\;b;c;;\\") == ["a;b", "c", "\\"] and resource_types(9) == [1, 13]
    assert df.where(matches("q", "2 3")).count() == 1 and df.where(matches("q", "2", prefix=True)).count() == 0


def test_api_and_rendering(spark, micro):
    from graphmill import api
    from graphmill.functions import render

    got = api.execute(micro, "relations", kind="children", terms=["a"])
    assert pairs(got, "rid1", "rid2") == {"BA", "CA", "EA"}
    assert pairs(api.execute(micro, "relations", kind="all_subclasses", ids=[(4, 1)]), "rid1", "rid2") == {"ED", "FE"}
    assert {r["rid"] for r in api.execute(micro, "siblings", terms=["B"]).collect()} == {3, 5}
    assert {r["name"] for r in api.execute(micro, "concept", uris=["http://x#F"]).collect()} == {"F"}
    assert {r["term"] for r in api.execute(micro, "keyword", text="", ancestors=["D"]).collect()} == {"D", "E", "F"}
    assert api.execute(micro, "sql", statement="select * from graph_nodes where name = :n", n="A").count() == 1
    assert api.execute(micro, "ontologies").count() == 3 and len(list(api.cursor(got))) == 3
    for bad in ({"name": "nothing"}, {"name": "relations", "kind": "strange"}):
        with pytest.raises(GraphError) as found:
            api.execute(micro, **bad) if len(bad) == 1 else api.relations(micro, kind="strange")
        assert render.error_envelope(found.value)["type"] in ("function", "argument")
    xml = [r["xml"] for r in render.relationships_xml(got).collect()]
    assert all(x.startswith("<relationship>") and '<object id="1-1">A</object>' in x for x in xml)
    lines = render.tab_separated(spark.createDataFrame([(1, "a\tb\nc", None)], "a int, b string, c string")).first()["line"]
    assert lines == "1\ta b c\t"
    terms = search.term_dictionary(micro).withColumn("category", F.lit("x"))
    text = render.reconcile_json(search.reconcile(terms, "a"), "f").first()["json"]
    assert text.startswith('f({"result":[{"id":1,"term":"A"') and text.endswith("]})")
    assert render.terms_xml(search.autocomplete(terms, "a")).first()["xml"].startswith("<term")
    assert "<class" in render.classes_xml(search.concept_details(micro, api.DETAILS)).first()["xml"]


def test_longest_depth_of_cycles(spark):
    arcs = lambda *rows: spark.createDataFrame(list(rows), "src long, dst long")
    assert {(r["node"], r["depth"]) for r in closure.longest_depth(arcs((2, 1), (3, 2), (3, 1), (4, 4))).collect()} == {(1, 1), (2, 2), (3, 3)}
    for bad in (arcs((1, 2), (2, 1)), arcs((2, 1), (3, 2), (2, 3)), arcs((2, 1), (8, 9), (9, 8))):
        with pytest.raises(GraphError):
            closure.longest_depth(bad)


def test_longest_depth_contracts_equivalent_cycles(spark):
    frame = lambda names, *rows: spark.createDataFrame(list(rows), names)
    arcs = frame("src long, dst long", (2, 1), (3, 2), (2, 3), (4, 3), (5, 4), (6, 1), (7, 6), (5, 7), (3, 8), (8, 1))
    groups = frame("node long, component long", (2, 2), (3, 2), (6, 6), (7, 6))
    got = {r["node"]: r["depth"] for r in closure.longest_depth(arcs, groups).collect()}
    assert got == {1: 1, 2: 3, 3: 3, 4: 4, 5: 5, 6: 2, 7: 3, 8: 2}  # 6 and 7 are equivalent, but on no cycle
    with pytest.raises(GraphError):  # a cycle that leaves its group
        closure.longest_depth(arcs.union(frame("src long, dst long", (2, 5))), groups)
    with pytest.raises(GraphError):
        closure.longest_depth(arcs)


def test_long_cycles_raise_at_once(spark):
    n = 20_000
    ring = spark.range(1, n + 1).select(F.col("id").alias("src"), F.when(F.col("id") == n, 1).otherwise(F.col("id") + 1).cast("long").alias("dst"))
    began = time.time()
    with pytest.raises(GraphError):
        closure.longest_depth(ring.union(spark.createDataFrame([(1, 0)], "src long, dst long")))
    assert time.time() - began < 30


def test_strong_components(spark):
    rng = random.Random(6)
    for n, m in ((12, 14), (40, 60), (60, 75)):
        arcs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {k: {k} for k in range(n)}
        for _ in range(n):
            for a, b in arcs:
                reach[a] |= reach[b]
        want = {k: max(j for j in reach[k] if k in reach[j]) for k in range(n) if any(j != k and k in reach[j] for j in reach[k])}
        got = closure.strong_components(spark.createDataFrame(sorted(arcs), "src long, dst long")).collect()
        assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_labels_of_random_hierarchies(spark):
    rng = random.Random(14)
    for n, m in ((2, 1), (120, 200)):
        arcs = {tuple(sorted(rng.sample(range(n + 1), 2), reverse=True)) for _ in range(m)}  # child above parent: no cycle
        nodes = sorted({x for arc in arcs for x in arc})
        above = {k: {k} for k in nodes}
        for a, b in sorted(arcs):
            above[a] |= above[b]
        frame = spark.createDataFrame(sorted(arcs), "src long, dst long")
        index = labels.label_index(frame)
        pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes] + [(10**6, 10**6), (10**6, nodes[0])], "n1 long, n2 long")
        got = {(r["n1"], r["n2"]): r["is_anc"] for r in labels.is_ancestor(index, pairs).collect()}
        assert got == {(a, b): b in above[a] for a in nodes for b in nodes} | {(10**6, 10**6): True, (10**6, nodes[0]): False}
        counts = {r["node"]: (r["anc_all"], r["desc_all"]) for r in labels.neighbor_counts(frame).collect()}
        assert counts == {k: (len(above[k]) - 1, sum(k in above[x] for x in nodes) - 1) for k in nodes}
    with pytest.raises(GraphError):
        labels.label_index(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long"))


def test_label_layers_use_their_own_arcs(spark, monkeypatch):
    """Along a chain each layer meets the arcs that begin in it, not all of them, and hears the layers that tell it something."""
    met = []
    monkeypatch.setattr(labels, "saved_rows", lambda df, *which: met.append(df._jdf.queryExecution().optimizedPlan().toString()) or closure.saved_rows(df, *which))
    chain = spark.createDataFrame([(k + 1, k) for k in range(1, 6)] + [(6, 1)], "src long, dst long")
    index = labels.label_index(chain)
    assert {r["node"]: r["n"] for r in labels.below_counts(index).collect()} == {1: 5, 2: 4, 3: 3, 4: 2, 5: 1, 6: 0}
    layers = [plan for plan in met if "from" in plan]
    assert len(layers) == 6 and all(f"= {depth})" in plan for depth, plan in zip(range(6, 0, -1), layers, strict=True))


def test_labels_are_few(spark):
    arcs = spark.range(2, 2001).select(F.col("id").alias("src"), F.explode(F.array_distinct(F.array(F.expr("id div 2"), F.expr("greatest(id div 3, 1)")))).alias("dst"))
    index = labels.label_index(arcs)
    assert index.runs.count() < 5 * index.places.count() and index.places.select("at").distinct().count() == 2000


def test_block_covers(spark):
    n = 300
    rng = random.Random(1)
    runs = [(k, *sorted((rng.randrange(n), rng.randrange(n)))) for k in range(200)] + [(200, 0, n - 1), (201, 0, 0), (202, 255, 256)]
    index = labels.LabelIndex(spark.range(n).select(F.col("id").alias("node"), F.col("id").alias("at")), spark.createDataFrame(runs, "node long, lo long, hi long"))
    met = labels.covers(index).toDF("run", "level", "block").join(labels.keys(index), ["level", "block"]).select("run", "node").collect()
    assert len(met) == len(set(met)) and {tuple(r) for r in met} == {(k, x) for k, lo, hi in runs for x in range(lo, hi + 1)}


def test_term_index(spark):
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abC_%é ") for _ in range(rng.randrange(0, 9))) for _ in range(500)})
    index = termindex.build(spark.createDataFrame([(t,) for t in [*terms, None, terms[0]]], "term string"))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for k, x in enumerate(a):
            last, row = row, [k + 1] + [0] * len(b)
            for j, y in enumerate(b):
                row[j + 1] = min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1)
        return row[-1]

    for text in ("ab", "abc", "Cab_", "%", "", "abcabc", "ééé"):
        low = text.lower()
        assert sorted(r["term"] for r in termindex.containing(index, text).collect()) == [t for t in terms if low in t.lower()]
        assert sorted(r["term"] for r in termindex.starting(index, text).collect()) == [t for t in terms if t.lower().startswith(low)]
        for d in (0, 1, 2):
            assert sorted(tuple(r) for r in termindex.similar(index, text, d).collect()) == [(t, edits(low, t.lower())) for t in terms if edits(low, t.lower()) <= d]
    plan = termindex.containing(index, "abca")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert "StringStartsWith(key,ab)" in termindex.starting(index, "ab")._jdf.queryExecution().toString()
