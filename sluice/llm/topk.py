"""Exact top-k by inner product: a KD-tree in every shard.

Vectors are dealt by a hash of their id into shards of bounded size. A shard's
tree halves its points at the median of the widest side of their bounding box
until a leaf is small or all its points are equal; each node keeps the tight
box of its own points. For a query q the inner product with any point of a box
is at most ``sum(max(q * low, q * high))``. A search pops the node with the
highest bound, and ends when that bound is below the k-th best score so far.
The first shard is searched first, and its k-th scores are where the searches
of all other shards start from.

Queries are a stated set, broadcast in blocks of bounded bytes to all shards.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed


def build_tree(ids: np.ndarray, points: np.ndarray, leaf: int) -> dict[str, np.ndarray]:
    """Median splits; nodes in the order they were made, points reordered so that a node is a slice."""
    order, nodes, todo = np.lexsort((ids,)), [], [(0, len(ids), -1, 0)]
    links: list[list[int]] = []
    while todo:
        a, b, parent, side = todo.pop()
        at = order[a:b]
        own = points[at]
        low, high = own.min(0), own.max(0)
        n = len(nodes)
        nodes.append((a, b, low, high, ids[at].min()))
        links.append([-1, -1])
        if parent >= 0:
            links[parent][side] = n
        wide = int(np.argmax(high.astype(float) - low)) if own.shape[1] else 0
        if b - a > leaf and own.shape[1] and high[wide] > low[wide]:
            split = np.argsort(own[:, wide], kind="stable")
            order[a:b] = at[split]
            half = a + (b - a) // 2
            todo += [(a, half, n, 0), (half, b, n, 1)]
    return {
        "ids": ids[order], "points": points[order], "span": np.array([x[:2] for x in nodes]), "low": np.array([x[2] for x in nodes]), "high": np.array([x[3] for x in nodes]),
        "least": np.array([x[4] for x in nodes]), "links": np.array(links),
    }


def search(tree: dict[str, np.ndarray], queries: list[tuple[int, np.ndarray]], k: int, floors: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's best k in this tree, without those a floor (score, id) beats."""
    if not queries:
        return []
    width = tree["points"].shape[1]
    q = np.array([v for _, v in queries]).reshape(len(queries), width)
    large = max(1, width) * float(max(abs(q).max(initial=0), 1)) * float(max(abs(tree["low"]).max(initial=0), abs(tree["high"]).max(initial=0), 1))
    kind = np.float64 if large < 2**53 else object  # floats are exact below 2^53, Python's integers anywhere
    q, points, low, high = (x.astype(kind) for x in (q, tree["points"], tree["low"], tree["high"]))
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    out = []
    for (query, _), v, bound in zip(queries, q, bounds, strict=True):
        best: list[tuple[int, int]] = []  # least first: (score, -id)
        floor = floors.get(query, None)
        heap = [(-bound[0], 0)]
        while heap:
            top, n = heapq.heappop(heap)
            worst = best[0] if len(best) == k else None
            if floor is not None and (worst is None or floor > worst):
                worst = floor
            if worst is not None and -top < worst[0]:
                break
            if worst is not None and -top == worst[0] and -int(tree["least"][n]) < worst[1]:
                continue
            left, right = tree["links"][n]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-bound[child], int(child)))
                continue
            a, b = tree["span"][n]
            ids = tree["ids"][a:b]
            scores = points[a:b] @ v
            keep = np.flatnonzero(ids != query)
            if worst is not None:
                keep = keep[scores[keep] >= worst[0]]
            if len(keep) > k:
                keep = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
            for i in keep:
                one = (int(scores[i]), -int(ids[i]))
                if floor is not None and one < floor:
                    continue
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
        out += [(query, -i, s) for s, i in best]
    return out


def _pack(tree: dict[str, np.ndarray]) -> bytes:
    np.savez(out := io.BytesIO(), **tree)
    return out.getvalue()


def _build(leaf: int):
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        points = t.column("v").combine_chunks()
        width = t.column("width")[0].as_py()
        tree = build_tree(ids, points.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width), leaf)
        return pa.table({"shard": t.column("shard")[:1], "width": t.column("width")[:1], "tree": pa.array([_pack(tree)], pa.binary())})

    return run


def _search(sent: Broadcast, k: int):
    """Searches of trees for the broadcast queries, by width: ids, vectors, and of each the floor (score, -id) or None."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for width, packed in zip(b.column("width").to_pylist(), b.column("tree").to_pylist(), strict=True):
                ids, vectors, floors = sent.value.get(width, ((), (), {}))
                if not len(ids):
                    continue
                with np.load(io.BytesIO(packed)) as z:
                    tree = dict(z)
                for a in range(0, len(ids), 2048):  # the bounds of so many queries for a tree's boxes are held at once
                    found = search(tree, list(zip(ids[a : a + 2048].tolist(), vectors[a : a + 2048], strict=True)), k, floors)
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=schema)

    return run


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null if any is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, shard_rows: int = 8192, leaf: int = 64, block_bytes: int = 32 << 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest inner products of every query with all vectors but those of its own id.

    Components are ``floor(1024 x)`` integers and scores are exact. Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller id. Only
    vectors as long as the query count for it. Queries go to the tasks in
    blocks of ``block_bytes``, each with one pass over the trees.

    Rows with a null id, a null vector, or null or non-finite components take
    no part, as queries or candidates. Repeated rows count each; rows that
    repeat the query's own id are not its candidates, and of several vectors
    under a query's id the least in order is asked for. An empty table, or no
    queries, gives an empty result. Other columns are not read.
    """
    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("v"))
        return v.where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("width", F.size("v"))

    spark = vectors.sparkSession
    points, asked = checkpointed(clean(vectors)), checkpointed(clean(queries).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v")))
    widths = {r["width"]: r["n"] for r in points.groupBy("width").agg(F.count("*").alias("n")).collect()}
    shards = F.lit(1)
    for width, n in widths.items():
        shards = F.when(F.col("width") == width, F.lit(-(-n // shard_rows))).otherwise(shards)
    # equal rows of one id are told apart by their place, so that no id can fill a shard of its own
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), shards).cast("int"))
    trees = checkpointed(dealt.groupBy("width", "shard").applyInArrow(_build(leaf), "shard int, width int, tree binary"))
    total = asked.agg(F.sum(8 * (F.col("width") + 1)).alias("n")).first()["n"] or 0
    parts, found, schema = -(-total // block_bytes), None, "query_id long, vec_id long, score long"
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toArrow()
        block = {}
        for width in sorted(set(own.column("width").to_pylist())):
            t = own.filter(pc.equal(own.column("width"), width))
            vectors_ = t.column("v").combine_chunks()
            block[width] = (t.column("vec_id").to_numpy(), vectors_.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, width))
        sent = spark.sparkContext.broadcast({w: (*x, {}) for w, x in block.items()})
        seeds = checkpointed(trees.where("shard = 0").mapInArrow(_search(sent, k), schema))
        kth = seeds.groupBy("query_id").agg(F.min(F.struct("score", (-F.col("vec_id")).alias("n"))).alias("m"), F.count("*").alias("found")).where(F.col("found") >= k).select("query_id", "m.*").toArrow()
        floors = dict(zip(kth.column("query_id").to_pylist(), zip(kth.column("score").to_pylist(), kth.column("n").to_pylist(), strict=True), strict=True))
        sent = spark.sparkContext.broadcast({w: (*x, floors) for w, x in block.items()})
        both = seeds.unionByName(trees.where("shard > 0").mapInArrow(_search(sent, k), schema))
        found = both if found is None else found.unionByName(both)
    if found is None:
        found = spark.createDataFrame([], schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
