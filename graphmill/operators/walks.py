"""Random walks with restart over an undirected graph whose edges lie dealt in blocks.

An edge lies in the block of its end of fewer edges, so that most nodes have all their edges in one block. Each node also has
a home that holds its total weight. In a round a home sends its nodes' scores to the blocks that hold edges of them, a block passes
them along its edges, and the homes add up what comes back: one array for each pair of home and block, by places found once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved, shipped

#: Edges of a block at most, on average, and at least if there are idle cores.
MOST, LEAST = 5_000_000, 50_000
#: Nodes of many edges that are broadcast at most when edges are dealt.
HUBS = 250_000
#: Edges of a node from which on they are dealt one by one.
APART = 100_000
#: Edges in a row of a block.
CHUNK = 250_000
PARTITIONS = "spark.sql.shuffle.partitions"
BUILT = "block int, home int, nodes binary, total binary, a binary, times binary, b binary, weight binary"
MESSAGES = "home int, block int, data binary"


@contextmanager
def partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, shuffles of frames that run have ``n`` partitions: as many as blocks, which then don't move in a round."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(n))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


def _ids(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a hash deals to n different partitions."""
    tries = 20 * n
    while True:
        place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        found = [r["id"] for r in spark.range(tries).groupBy(place.alias("place")).agg(F.min("id").alias("id")).collect()]
        if len(found) == n:
            return sorted(found)
        tries *= 4


class Blocks:
    """The edges (src, dst, weight) of an undirected graph, one row a pair, and further nodes, dealt in blocks."""

    def __init__(self, pairs: DataFrame, nodes: list[int]):
        spark = pairs.sparkSession
        shipped(spark)
        degree = saved(pairs.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n")))
        n = (degree.agg(F.sum("n")).first()[0] or 0) // 2
        cores = spark.sparkContext.defaultParallelism
        blocks = max(min(-(-n // (MOST * cores)) * cores, -(-n // LEAST)), 1)
        self.ids, self.spark = _ids(spark, blocks), spark
        hubs = degree.where(F.col("n") > 2 * n // HUBS)  # HUBS rows at most
        pairs = pairs.unionByName(spark.createDataFrame([(q, q, 0.0) for q in nodes], "src long, dst long, weight double"))
        for end in ("src", "dst"):
            pairs = pairs.join(F.broadcast(hubs.toDF(end, f"n_{end}")), end, "left").withColumn(f"n_{end}", F.coalesce(f"n_{end}", F.lit(0)))
        low, few = F.when(F.expr("n_src <= n_dst"), F.col("src")).otherwise(F.col("dst")), F.least("n_src", "n_dst")
        turn = F.pmod(F.when(few > APART, F.xxhash64("src", "dst")).otherwise(F.xxhash64(low)), F.lit(blocks))
        dealt = pairs.select(F.element_at(F.array(*map(F.lit, self.ids)), (turn + 1).cast("int")).cast("int").alias("block"), "src", "dst", "weight")
        with self.rounds():
            built = saved(dealt.repartition(blocks, "block").mapInArrow(_built(self.ids), BUILT))
            self.edges = saved(built.where("home is null").select("block", "a", "times", "b", "weight").repartition(blocks, "block").sortWithinPartitions("block"))
            homes = built.where("home is not null").groupBy("home").applyInArrow(_placed, "home int, block int, nodes binary, total binary")
            self.homes = saved(homes.repartition(blocks, "home").sortWithinPartitions("home"))

    def rounds(self):
        return partitions(self.spark, len(self.ids))

    def first(self, starts: list[int]) -> DataFrame:
        """Messages of the homes when each walk stands at its start."""
        return self.homes.groupBy("home").applyInArrow(lambda key, held: _sent(key, held, None, starts, 0.0, True), MESSAGES)

    def moved(self, sent: DataFrame, starts: list[int], restart: float, own: bool) -> DataFrame:
        """Messages after a round; with ``own``, the homes keep the scores they are made of."""
        passed = self.edges.groupBy("block").cogroup(sent.where("block is not null").groupBy("block")).applyInArrow(_passed(len(starts)), MESSAGES)
        return self.homes.groupBy("home").cogroup(passed.groupBy("home")).applyInArrow(lambda key, held, told: _sent(key, held, told, starts, restart, own), MESSAGES)

    def scores(self, sent: DataFrame, starts: list[int]) -> DataFrame:
        """(query, node, score) of all scores above 0."""

        def rows(key, held, own):
            nodes, _, _ = _home(held)
            score = _array(own.column("data")[0], np.float64).reshape(len(starts), -1)
            query, place = np.nonzero(score > 0)
            return pa.table({"query": np.asarray(starts, np.int64)[query], "node": nodes[place], "score": score[query, place]})

        kept = sent.where("block is null")
        return self.homes.groupBy("home").cogroup(kept.groupBy("home")).applyInArrow(rows, "query long, node long, score double")


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _built(ids: list[int]) -> Callable:
    """A block's edges by places in its list of nodes, which are ordered by home: each first end once, with how many edges follow; for
    each home its nodes and the sums of their weights here."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for block in pc.unique(batch["block"]).to_pylist():
                parts.setdefault(block, []).append(batch.filter(pc.equal(batch["block"], block)))
        for block in list(parts):
            yield from one(block, pa.Table.from_batches(parts.pop(block))).to_batches()

    def one(block: int, rows: pa.Table) -> pa.Table:
        src, dst, weight = (rows.column(c).to_numpy() for c in ("src", "dst", "weight"))
        coded = pa.array(np.concatenate([src, dst])).dictionary_encode()
        nodes, places = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        home = ((nodes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(len(ids))
        order = np.lexsort((nodes, home))
        places = np.argsort(order).astype(np.int32)[places]
        nodes, home = nodes[order], home[order]
        a, b = places[: len(src)], places[len(src) :]
        order = np.argsort(a.astype(np.int64) * len(nodes) + b)  # sums in one order, whatever order the rows come in
        a, b, weight = a[order], b[order], weight[order]
        total = np.bincount(a, weight, len(nodes)) + np.bincount(b, weight, len(nodes))
        out = []
        for k, cut in zip(*np.unique(home, return_index=True), strict=True):
            end = cut + np.count_nonzero(home == k)
            out.append((block, ids[int(k)], nodes[cut:end].tobytes(), total[cut:end].tobytes(), None, None, None, None))
        for k in range(0, len(a), CHUNK):
            end = k + CHUNK
            runs, times = np.unique(a[k:end], return_counts=True)
            small = weight[k:end].astype(np.uint8)  # a byte each where that loses nothing
            heavy = small if np.array_equal(small, weight[k:end]) else weight[k:end]
            out.append((block, None, None, None, runs.tobytes(), times.astype(np.int32).tobytes(), b[k:end].tobytes(), heavy.tobytes()))
        return _table(out, BUILT)

    return build


def _placed(key, rows):
    """A home's nodes with their total weights, and for each block that holds edges of them their places in this list."""
    rows = rows.sort_by("block")
    told = [(b.as_py(), _array(n, np.int64), _array(t, np.float64)) for b, n, t in zip(rows["block"], rows["nodes"], rows["total"], strict=True)]
    nodes = np.unique(np.concatenate([n for _, n, _ in told]))
    total, out = np.zeros(len(nodes)), []
    for block, some, share in told:
        place = np.searchsorted(nodes, some)
        total[place] += share
        out.append((key[0].as_py(), block, place.astype(np.int32).tobytes(), None))
    out.append((key[0].as_py(), None, nodes.tobytes(), total.tobytes()))
    return _table(out, "home int, block int, nodes binary, total binary")


def _home(held: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Nodes and total weights of a home, and the places of each block's nodes."""
    nodes = total = None
    places = {}
    for block, some, share in zip(held["block"], held["nodes"], held["total"], strict=True):
        if block.is_valid:
            places[block.as_py()] = _array(some, np.int32)
        else:
            nodes, total = _array(some, np.int64), _array(share, np.float64)
    return nodes, total, places


def _sent(key, held: pa.Table, told: pa.Table | None, starts: list[int], restart: float, own: bool) -> pa.Table:
    """The scores of a home's nodes from what the blocks told, a share per weight for each block that holds edges of them."""
    nodes, total, places = _home(held)
    score = np.zeros((len(starts), len(nodes)))
    if told is not None:
        for block, data in sorted((b.as_py(), d) for b, d in zip(told["block"], told["data"], strict=True)):
            score[:, places[block]] += _array(data, np.float64).reshape(len(starts), -1)
        score *= restart
    for k, start in enumerate(starts):
        at = np.searchsorted(nodes, start)
        if at < len(nodes) and nodes[at] == start:
            score[k, at] += 1 - restart
    share = np.divide(score, total, out=np.zeros_like(score), where=total > 0)
    out = [(key[0].as_py(), block, share[:, place].tobytes()) for block, place in places.items()]
    if own:
        out.append((key[0].as_py(), None, score.tobytes()))
    return _table(out, MESSAGES)


def _passed(n_starts: int) -> Callable:
    """What a block's edges make of the shares of its nodes, for each home."""

    def passed(key, edges, sent):
        told = sorted((h.as_py(), d) for h, d in zip(sent["home"], sent["data"], strict=True))
        share = np.concatenate([_array(d, np.float64).reshape(n_starts, -1) for _, d in told], axis=1)
        out = np.zeros_like(share)
        for row in zip(edges["a"], edges["times"], edges["b"], edges["weight"], strict=True):
            a, times, b = (_array(x, np.int32).astype(np.intp) for x in row[:3])
            weight = _array(row[3], np.uint8 if row[3].as_buffer().size == len(b) else np.float64).astype(np.float64)
            begin = np.cumsum(times) - times
            for k in range(n_starts):
                out[k, a] += np.add.reduceat(weight * share[k].take(b), begin)
                out[k] += np.bincount(b, weight * np.repeat(share[k].take(a), times), len(share[k]))
        rows, end = [], 0
        for home, data in told:
            begin, end = end, end + data.as_buffer().size // (8 * n_starts)
            rows.append((home, key[0].as_py(), out[:, begin:end].tobytes()))
        return _table(rows, MESSAGES)

    return passed
