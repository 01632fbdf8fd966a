"""Operator 4: approximate nearest neighbours over learned partitions.

On a bounded sample of vectors a neighbour graph is built and cut into
partitions of nearly equal size that keep neighbours together. A small
softmax classifier learns the partition of a vector. It then places every
vector of the table in its most probable partition, and routes a query to its
several most probable ones, whose vectors are compared exactly.

How many partitions a query visits is calibrated on the sample: the least
number that finds ``RECALL`` of the near neighbours of sample vectors. Of a
sample of 1 row in r, the nearest k / r stand for the nearest k of the table.
A query visits more partitions if those hold too few vectors.

The index is the partition number of each row: nothing else of the table is
kept, and all rows are indexed. Candidates and queries meet in blocks: a
partition's vectors are dealt into blocks of about ``BLOCK`` rows (so a hot
partition is many blocks), its queries likewise, and each pair of blocks is
compared in a task by array operations, giving the nearest few of each query;
a last top-k a query merges them. Distances are computed in double precision
from differences of the original values.

Defined results: vectors that are NULL, zero, of another length than the
table's (the most frequent one) or hold NULL or non-finite components take no
part, neither do rows with a NULL id; of rows that repeat a query's id one
(the least vector) is the query; every row with another id is a candidate,
repeated ones each; ties go to the smaller id; an empty table gives an empty
result; extra columns don't matter.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierlake.llm.frames import hash_sample
from tierlake.session import cut_lineage

#: Vectors of the sample that the partitions are learnt from.
SAMPLE = 6000
#: Neighbours of a vector in the graph.
GRAPH_NEIGHBOURS = 10
#: Vectors of a partition, about, and the most partitions.
PARTITION, MOST_PARTITIONS = 1500, 64
#: Share of the sample's true neighbours that the visited partitions hold.
RECALL = 0.95
#: Rows of a block of candidates, and of queries.
BLOCK, QUERY_BLOCK = 2048, 512


# --------------------------------------------------------------------------
# Learning the partitions (bounded sample, arrays)
# --------------------------------------------------------------------------

def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, nearest first."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    norms = (x * x).sum(1)
    for lo in range(0, len(x), 1024):
        part = x[lo : lo + 1024]
        far = norms[None, :] - 2 * part @ x.T
        far[np.arange(len(part)), np.arange(lo, lo + len(part))] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
        out[lo : lo + 1024] = np.take_along_axis(near, order, axis=1)
    return out


def balanced_partition(graph: np.ndarray, parts: int, seed: int = 0, slack: float = 1.1) -> np.ndarray:
    """Partition of the graph's nodes: regions grown in step from far-apart
    nodes, then moves to the partition of most neighbours, or swaps where that
    is full; none exceeds ``slack`` times the mean size."""
    n = len(graph)
    if parts == 1:
        return np.zeros(n, np.int64)
    rng = np.random.default_rng(seed)
    room = int(np.ceil(slack * n / parts))
    around: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            around[i].append(j)
            around[j].append(i)
    label = np.full(n, -1, np.int64)
    size = [0] * parts
    fronts = [deque([node]) for node in _far_nodes(around, parts, rng)]
    spare = deque(rng.permutation(n).tolist())
    left = n
    while left:  # the smallest region that can still grow takes a node
        p = min(range(parts), key=lambda q: (not fronts[q], size[q]))
        if not fronts[p]:  # what no region reaches goes to the smallest one
            p = min(range(parts), key=lambda q: size[q])
            while label[spare[0]] >= 0:
                spare.popleft()
            fronts[p].append(spare[0])
        node = fronts[p].popleft()
        if label[node] >= 0:
            continue
        label[node] = p
        size[p] += 1
        left -= 1
        if size[p] < room:
            fronts[p].extend(j for j in around[node] if label[j] < 0)
        else:
            fronts[p].clear()
    for _ in range(16):
        moved = 0
        wanted: dict[tuple[int, int], list[int]] = {}  # (from, to): nodes that would rather be there
        for i in rng.permutation(n).tolist():
            votes = np.bincount(label[around[i]], minlength=parts)
            best, here = int(votes.argmax()), int(label[i])
            if best == here or votes[best] <= votes[here]:
                continue
            back = wanted.get((best, here))
            if size[best] < room:
                label[i] = best
                size[best] += 1
                size[here] -= 1
                moved += 1
            elif back:  # swap with a node that wants the other way
                label[back.pop()] = here
                label[i] = best
                moved += 1
            else:
                wanted.setdefault((here, best), []).append(i)
        if not moved:
            break
    return label


def _far_nodes(around: list[list[int]], parts: int, rng: np.random.Generator) -> list[int]:
    """Nodes spread over the graph: each is farthest, in steps, from those
    before it; nodes that no step reaches count as farthest."""
    n = len(around)
    steps = np.full(n, n + 1, np.int64)
    chosen = [int(rng.integers(n))]
    while True:
        steps[chosen[-1]] = 0
        queue = deque([chosen[-1]])
        while queue:
            i = queue.popleft()
            for j in around[i]:
                if steps[j] > steps[i] + 1:
                    steps[j] = steps[i] + 1
                    queue.append(j)
        if len(chosen) == parts:
            return chosen
        far = steps.max()
        if far == n + 1:  # of the parts not reached, a node with most neighbours
            apart = np.flatnonzero(steps == far)
            chosen.append(int(apart[np.argmax([len(around[i]) for i in apart])]))
        else:
            chosen.append(int(rng.choice(np.flatnonzero(steps == far))))


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Router:
    """One hidden layer: probabilities of the partitions of a vector."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        return softmax(hidden @ self.w2 + self.b2)


def train(x: np.ndarray, label: np.ndarray, parts: int, hidden: int = 128, epochs: int = 30,
          seed: int = 0) -> Router:
    """The classifier, by stochastic gradient steps (Adam)."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), float(x.std()) + 1e-12
    z = (x - mean) / scale
    weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
               rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
    first, second, step = [0 * w for w in weights], [0 * w for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            rows = order[lo : lo + 256]
            inner = z[rows] @ weights[0] + weights[1]
            active = np.maximum(inner, 0)
            delta = softmax(active @ weights[2] + weights[3])
            delta[np.arange(len(rows)), label[rows]] -= 1
            delta /= len(rows)
            back = (delta @ weights[2].T) * (inner > 0)
            gradients = [z[rows].T @ back, back.sum(0), active.T @ delta, delta.sum(0)]
            step += 1
            for k, g in enumerate(gradients):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - 2e-3 * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *weights, visits=1)


def learn(x: np.ndarray, parts: int, recall: float = RECALL, near: int = GRAPH_NEIGHBOURS) -> Router:
    """Partitions of the sample, their classifier, and how many partitions a
    query visits to find its ``near`` nearest of the sample."""
    parts = max(1, min(parts, len(x) // 4))
    graph = neighbour_graph(x, GRAPH_NEIGHBOURS) if len(x) > 1 else np.zeros((len(x), 0), np.int64)
    router = train(x, balanced_partition(graph, parts), parts)
    ranked = np.argsort(-router.probabilities(x), axis=1, kind="stable")
    home = ranked[:, 0]
    place = np.empty_like(ranked)  # place of each partition in a vector's ranking
    np.put_along_axis(place, ranked, np.arange(parts)[None, :].repeat(len(x), 0), axis=1)
    needed = np.take_along_axis(place, home[graph[:, :near]], axis=1).ravel()
    visits = parts
    if len(needed):
        visits = int(np.quantile(needed, recall, method="higher")) + 1
    return Router(*[getattr(router, f) for f in ("mean", "scale", "w1", "b1", "w2", "b2")], visits=visits)


# --------------------------------------------------------------------------
# Spark
# --------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """Not NULL, without NULL or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, as doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _routed(vectors: DataFrame, router: Router, sizes: np.ndarray | None, least: int) -> DataFrame:
    """``vectors`` (id, vector) with its partition (sizes None), or once for
    each partition that it visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = router.probabilities(_matrix(batch.column("vector")))
            if sizes is None:
                rows, part = np.arange(len(p)), p.argmax(axis=1)
            else:
                ranked = np.argsort(-p, axis=1, kind="stable")
                held = np.cumsum(sizes[ranked], axis=1)
                short = (held < least).sum(axis=1) + 1
                visits = np.minimum(np.maximum(router.visits, short), ranked.shape[1])
                chosen = np.arange(ranked.shape[1])[None, :] < visits[:, None]
                rows, part = np.nonzero(chosen)[0], ranked[chosen]
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(taken), batch.column("vector").take(taken),
                 pa.array(part.astype(np.int32))], names=["id", "vector", "part"])

    return vectors.select("id", "vector").mapInArrow(run, "id long, vector array<double>, part int")


def _block_numbers(sizes: DataFrame, most: int) -> DataFrame:
    """(part, blocks): how many blocks each partition is dealt into."""
    return sizes.select("part", F.ceil(F.col("n") / most).alias("blocks"))


def _blocks(rows: DataFrame, sizes: DataFrame, most: int, names: tuple[str, str, str]) -> DataFrame:
    """Rows packed into blocks of about ``most`` rows of one partition."""
    split = rows.join(F.broadcast(_block_numbers(sizes, most)), "part")
    dealt = split.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")))
    ids, vectors, width = names
    return dealt.groupBy("part", "block").agg(
        F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("rows")).select(
        "part", "block", F.transform("rows", lambda r: r["id"]).alias(ids),
        F.flatten(F.transform("rows", lambda r: r["vector"])).alias(vectors),
        F.size(F.get("rows", F.lit(0))["vector"]).alias(width))


def _compare(k: int):
    """Task function over pairs of blocks: the nearest k of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, found, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            for row in range(batch.num_rows):
                q_ids, c_ids = (batch.column(c)[row].values.to_numpy() for c in ("q_ids", "c_ids"))
                q, c = (batch.column(v)[row].values.to_numpy().reshape(len(i), -1)
                        for v, i in (("q", q_ids), ("c", c_ids)))
                for i, query in enumerate(q):
                    away = np.sqrt(((c - query) ** 2).sum(axis=1))
                    away[c_ids == q_ids[i]] = np.inf  # the query's own rows
                    if len(away) > k:
                        edge = np.partition(away, k - 1)[k - 1]
                        near = np.flatnonzero(away <= edge)
                    else:
                        near = np.arange(len(away))
                    near = near[np.lexsort((c_ids[near], away[near]))][:k]
                    near = near[np.isfinite(away[near])]
                    queries.append(np.full(len(near), q_ids[i]))
                    found.append(c_ids[near])
                    far.append(away[near])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (queries, found, far)],
                names=["query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id",
           vector: str = "embedding", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query,
    among all rows of ``df`` with another id, by Euclidean distance. Runs
    jobs."""
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
        is_query.alias("is_query"))
    width = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not width:
        return empty
    rows = cut_lineage(rows.where(F.size("vector") == width[0].w))
    picked = hash_sample(rows.select("id", "vector"), sample, "id", "vector").toArrow()
    x = np.unique(_matrix(picked.column("vector").combine_chunks()), axis=0)
    total = rows.count()
    parts = max(1, min(MOST_PARTITIONS, total // PARTITION))
    router = learn(x, parts, recall, max(1, round(k * len(x) / total)))

    placed = cut_lineage(_routed(rows, router, None, 0))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    count = np.zeros(len(router.b2), np.int64)
    for r in sizes.collect():
        count[r.part] = r.n
    queries = rows.where("is_query").groupBy("id").agg(F.min("vector").alias("vector"))
    routed = cut_lineage(_routed(queries, router, count, k + 1))
    visited = routed.groupBy("part").agg(F.count("*").alias("n"))
    q = _blocks(routed, visited, QUERY_BLOCK, ("q_ids", "q", "q_width")).drop("q_width", "block")
    c = _blocks(placed, sizes, BLOCK, ("c_ids", "c", "c_width")).drop("c_width")
    # A block of queries meets each block of its partition in a task of its own.
    q = q.join(F.broadcast(_block_numbers(sizes, BLOCK)), "part").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    nearest = q.join(c, ["part", "block"]).select("q_ids", "q", "c_ids", "c").mapInArrow(
        _compare(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
