"""Approximate nearest neighbours by a forest of hash prefixes.

A tree gives every vector a string of BITS bits, the signs of its products with random directions,
and keeps the vectors in the strings' order; in each tree other directions are used.  Vectors whose
strings have a long prefix in common lie next to each other.  A query descends in every tree to the
longest prefix that any vector shares with it, and then ascends in all trees together, bit by bit,
until the ranges of vectors that share the prefix hold ``candidates`` entries; the vectors in these
ranges are compared exactly, by the cosine in double precision.  Prefixes so have the length that
the data ask for: long where vectors are dense, short where they are sparse.

Equal vectors are one node, with the ids that can be among a query's nearest: its k + 1 least, which
is all that equal scores and ties to smaller ids let through, so nothing is lost by it.  Nodes are
dealt by a hash into shards of about ``shard_rows``; a shard is indexed by one task, and every block
of queries visits every shard, as a stream, so a task holds one shard and one block at a time.  The
shards' answers are put together by query.

In a shard of no more than ``candidates`` nodes all are compared.  Recall is measured in the tests
and stated in the README.

Edge cases: null vectors, and those with null or non-finite components, of length zero, or of
another number of components than most rows have, take no part, as queries or candidates; rows with
a query's id are its own and no candidates; repeated rows count once; null ids take no part; fewer
than k candidates give fewer rows; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SALTS, quoted, stored

BITS, TREES, SEED = 64, 64, 42
#: Nodes of a shard, about, and entries at which a query stops to ascend in a shard.
SHARD_ROWS, CANDIDATES = 8192, 4096
#: Queries that visit a shard together.
BLOCK = 512
_ANSWER = "query_id bigint, vec_id bigint, score double"


class Forest:
    """Sorted arrays of hash strings over the rows of ``x``."""

    def __init__(self, x: np.ndarray, trees: int = TREES, seed: int = SEED) -> None:
        self.x, self.norms = x, np.linalg.norm(x, axis=1)
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((trees, x.shape[1], BITS))
        self.order, self.strings = [], []
        for t in range(trees):
            strings = self.hashed(x, t)
            self.order.append(np.argsort(strings, kind="stable"))
            self.strings.append(strings[self.order[-1]])

    def hashed(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The first direction's sign is the highest bit."""
        out = np.empty(len(x), np.uint64)
        for i in range(0, len(x), 4096):
            bits = np.packbits(x[i : i + 4096] @ self.directions[tree] > 0, axis=1)
            out[i : i + 4096] = bits.view(">u8").ravel()
        return out

    def ranges(self, asked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each tree has the strings that share ``length`` bits with those ``asked`` (trees, queries)."""
        low, high = np.zeros(asked.shape, np.int64), np.full(asked.shape, len(self.x), np.int64)
        if length:
            rest = np.uint64((1 << (BITS - length)) - 1)
            for t, strings in enumerate(self.strings):
                low[t] = np.searchsorted(strings, asked[t] & ~rest, side="left")
                high[t] = np.searchsorted(strings, asked[t] | rest, side="right")
        return low, high

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the places of the vectors to compare, ascending."""
        asked = np.stack([self.hashed(queries, t) for t in range(len(self.strings))])
        low, high = self.ranges(asked, 0)
        # The prefix may be longer while enough entries share it: all trees go up together.
        lengths, step = np.zeros(len(queries), np.int64), BITS
        while step:
            for length in np.unique(lengths):
                try_ = lengths == length
                if length + step <= BITS:
                    lo, hi = self.ranges(asked[:, try_], int(length + step))
                    enough = (hi - lo).sum(axis=0) >= least
                    at = np.flatnonzero(try_)[enough]
                    lengths[at] += step
                    low[:, at], high[:, at] = lo[:, enough], hi[:, enough]
            step //= 2
        for q in range(len(queries)):
            found = np.zeros(len(self.x), bool)
            for t, order in enumerate(self.order):
                found[order[low[t, q] : high[t, q]]] = True
            yield np.flatnonzero(found)

    def nearest(self, queries: np.ndarray, k: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, of the candidates found, places and scores of all that reach the k-th best score."""
        for query, places in zip(queries, self.candidates(queries, least)):
            scores = np.einsum("ij,j->i", self.x[places], query) / (self.norms[places] * np.linalg.norm(query))
            if len(scores) > k:
                keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                places, scores = places[keep], scores[keep]
            yield places, scores


def usable(rows: DataFrame, asks: Column, vec_id: str, vector: str) -> DataFrame:
    """(id, v, asked): the rows that take part, components as doubles."""
    v = quoted(vector).cast("array<double>")
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    taken = rows.select(quoted(vec_id).cast("bigint").alias("id"), v.alias("v"), F.coalesce(asks, F.lit(False)).alias("asked"))
    taken = taken.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = taken.where(~odd).where(F.exists("v", lambda c: c != 0.0))
    common = fine.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return fine.where(F.size("v") == (common["d"] if common else 0))


def nodes(rows: DataFrame, k: int, salts: int = SALTS) -> DataFrame:
    """(v, ids): distinct vectors with the k + 1 least ids of each; a vector with many rows is cut down in parts."""
    least = rows.select("id", "v", F.xxhash64("v").alias("h")).distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    for keys in (["h", "v", "salt"], ["h", "v"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        least = least.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    return least.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def search(
    rows: DataFrame, asks: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES,
    candidates: int = CANDIDATES, shard_rows: int = SHARD_ROWS, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row where ``asks`` holds."""
    fine = stored(usable(rows, asks, vec_id, vector), "forest-rows")
    index = stored(nodes(fine, k), "forest-nodes")
    shards = max(1, -(-index.count() // shard_rows))
    vectors = index.select(F.pmod(F.col("h"), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).cast("bigint").alias("block"), "ids", "v")
    asked = stored(fine.where("asked").select("id", "v").distinct(), "forest-queries")
    blocks = max(1, -(-asked.count() // block))
    asked = asked.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("block"), F.array("id").alias("ids"), "v")
    visits = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "ids", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vs, forest, members = None, [], [], None, []

        def flush():
            """What was gathered is a shard to be indexed, or a block of queries to be answered."""
            nonlocal forest, members
            if now is None:
                return None
            if now[1] < 0:
                forest, members = Forest(np.array(vs), trees, seed), ids
                return None
            if forest is None:
                return None
            out: tuple[list, list, list] = ([], [], [])
            # k + 1 nodes: one of them may hold nothing but the query itself.
            for (own,), (places, scores) in zip(ids, forest.nearest(np.array(vs), k + 1, candidates)):
                best = sorted((-s, i) for p, s in zip(places.tolist(), scores.tolist()) for i in members[p] if i != own)[:k]
                out[0].extend([own] * len(best))
                out[1].extend(i for _, i in best)
                out[2].extend(-s for s, _ in best)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

        for b in batches:
            for shard, block_, i, v in zip(*(b.column(c).to_pylist() for c in range(4))):
                if (shard, block_) != now:
                    if (answer := flush()) is not None:
                        yield answer
                    if now is None or shard != now[0]:
                        forest = None
                    now, ids, vs = (shard, block_), [], []
                ids.append(i)
                vs.append(v)
        if (answer := flush()) is not None:
            yield answer

    both = vectors.unionByName(visits).repartition(shards, "shard").sortWithinPartitions("shard", "block")
    found = both.mapInArrow(run, _ANSWER)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Of an id's several rows with different vectors the better score counts.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

