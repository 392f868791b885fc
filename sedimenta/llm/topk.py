"""Exact top-k inner products by multi-resolution segment statistics.

Each vector is cut into 1, 4 and 16 segments; of each it keeps the mean and deviation. For a segment of length L,
sum(x * y) <= L * (mean_x * mean_y + dev_x * dev_y), which is a lower bound on the squared distance given the norms. A
block of queries meets a block of candidates coarse to fine: a product of the statistics gives all bounds at a
resolution, candidates below a query's k-th score so far go, and exact integer products settle the survivors.

Vectors are packed into blocks of rows. Candidate blocks are numbered from 0 and dealt in turn to as many tasks as the
shuffle has (MOST_SALTS at most), and each query block goes to all of them, so neither side has to fit anywhere; a task
makes the statistics of a candidate block once while it's among the last KEPT it met, keeps k rows a query, and a ranked
window (limited before its shuffle) merges them.

quantised() turns a component x into floor(1024 * x), at the ends of 64 bits if it's beyond them. Vectors that are null, or hold null or non-finite components, take
no part. Vectors of different lengths aren't compared. Ties go to the smaller id. Rows that repeat an id are
candidates each, except for queries of that id. Null ids take no part. No queries or no candidates give no rows.
Scores beyond 64 bits are at its ends and equal to each other there; all others are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_BLOCK, CANDIDATE_BLOCK, MOST_SALTS, KEPT = 512, 8192, 200, 4
SEGMENTS = (1, 4, 16)
BLOCKS = "dim int, part int, block int, ids binary, data binary"
FOUND = "query_id long, id long, score long"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """id and ints (array<long>) of the vectors that take part."""
    x = F.col(vector_col)
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("ints"))


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows packed into blocks of one length of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        k = 0

        def pack(dim: int) -> pa.RecordBatch:
            nonlocal k
            ids, rows = held.pop(dim)
            k += 1
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "block": pa.array([k - 1], pa.int32()), "ids": [np.array(ids, "<i8").tobytes()], "data": [np.array(rows, "<i8").reshape(len(ids), dim).tobytes()]})

        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = held.setdefault(len(row), ([], []))
                ids.append(i)
                rows.append(row)
                if len(ids) >= size:
                    yield pack(len(row))
        for dim in list(held):
            yield pack(dim)

    return vectors.select("id", "ints").mapInArrow(run, BLOCKS)


def statistics(rows: np.ndarray, segments: int) -> np.ndarray:
    """Root-length-weighted means and deviations of each segment: products of these are bounds on inner products."""
    cuts = np.linspace(0, rows.shape[1], segments + 1).astype(int)
    out = np.empty((len(rows), 2 * segments))
    for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        root = np.sqrt(max(b - a, 1))
        out[:, 2 * s] = rows[:, a:b].mean(1) * root if b > a else 0
        out[:, 2 * s + 1] = rows[:, a:b].std(1) * root if b > a else 0
    return out


class Candidates:
    """A block of candidates, the largest first, with its statistics at each resolution."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        floats = rows.astype(np.float64)
        order = np.argsort(-np.abs(floats).sum(1), kind="stable")
        self.ids, self.rows, self.floats = ids[order], rows[order], floats[order]
        self.largest = float(np.abs(floats).max(initial=0))
        self.stats = {s: statistics(self.floats, s) for s in SEGMENTS if s <= max(rows.shape[1], 1)}


class BlockSearch:
    """The best k of each query of a block among the candidate blocks met so far."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.rows, self.k = ids, rows, k
        self.floats = rows.astype(np.float64)
        self.stats = {s: statistics(self.floats, s) for s in SEGMENTS if s <= max(rows.shape[1], 1)}
        self.best_ids = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.best = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.count = np.zeros(len(ids), np.int64)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.search(Candidates(ids, rows))

    def search(self, block: Candidates) -> None:
        exact = block.rows.shape[1] * block.largest * float(np.abs(self.floats).max(initial=0))
        for at in range(0, len(block.ids), 2048):
            self._search(block, slice(at, at + 2048), exact)

    def _scores(self, wanted: np.ndarray, rows: np.ndarray, floats: np.ndarray, exact: float) -> np.ndarray:
        if exact < 2**53:
            return np.rint(self.floats[wanted] @ floats.T).astype(np.int64)
        with np.errstate(over="ignore"):
            scores = self.rows[wanted] @ rows.T
        if exact >= 2**62:  # pairs whose sum may not fit are added up in whole numbers of any size
            for q, c in np.argwhere(np.abs(self.floats[wanted]) @ np.abs(floats).T >= 2**62):
                whole = sum(x * y for x, y in zip(self.rows[wanted[q]].tolist(), rows[c].tolist(), strict=True))
                scores[q, c] = max(-(2**63), min(2**63 - 1, whole))
        return scores

    def _search(self, block: Candidates, part: slice, exact: float) -> None:
        ids, floats = block.ids[part], block.floats[part]
        alive, slack = np.ones((len(self.ids), len(ids)), bool), 1e-9 * max(exact, 1)
        if (some := np.flatnonzero(self.count >= self.k)).size:
            floor = self.best[some, -1].astype(np.float64) - slack
            for step, mine in self.stats.items():
                columns = np.flatnonzero(alive[some].any(0))
                if not len(columns):
                    break
                bound = mine[some] @ block.stats[step][part][columns].T
                alive[np.ix_(some, columns)] &= bound >= floor[:, None]
        columns = np.flatnonzero(alive.any(0))
        if not len(columns):
            return
        wanted = np.flatnonzero(alive.any(1))
        scores = self._scores(wanted, block.rows[part][columns], floats[columns], exact)
        own = self.ids[wanted][:, None] == ids[columns][None, :]
        for q, row, skip, live in zip(wanted, scores, own, alive[np.ix_(wanted, columns)], strict=True):
            use = np.flatnonzero(live & ~skip)
            if self.count[q] >= self.k:
                use = use[row[use] >= self.best[q, -1]]
            elif len(use) > 4 * self.k:
                cut = np.partition(row[use], len(use) - self.k)[len(use) - self.k]
                use = use[row[use] >= cut]
            if not len(use):
                continue
            n = self.count[q]
            all_scores = np.concatenate([self.best[q, :n], row[use]])
            all_ids = np.concatenate([self.best_ids[q, :n], ids[columns][use]])
            top = np.lexsort((all_ids, ~all_scores))[: self.k]
            self.count[q] = len(top)
            self.best[q, : len(top)], self.best_ids[q, : len(top)] = all_scores[top], all_ids[top]

    def result(self) -> pa.RecordBatch:
        at = np.arange(self.k) < self.count[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.count)), pa.array(self.best_ids[at]), pa.array(self.best[at])], names=["query_id", "id", "score"])


def _deals(spark: SparkSession, parts: int) -> list[int]:
    """Numbers whose hashes send them to tasks 0, 1, ... of a shuffle: one for each of MOST_SALTS tasks at most."""
    task = F.pmod(F.hash("id"), F.lit(parts))
    rows = spark.range(32 * parts).groupBy(task.alias("task")).agg(F.min("id").alias("id")).where(f"task < {MOST_SALTS}").orderBy("task").collect()
    return [r.id for r in rows]


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), id and score of the k best candidates of every query, both (id, ints)."""
    spark = candidates.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, search = None, None
        held: dict[tuple, Candidates] = {}
        for batch in batches:
            for dim, q_ids, q_data, ids, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if name != (dim, q_ids):
                    if search:
                        yield search.result()
                    name, search = (dim, q_ids), BlockSearch(np.frombuffer(q_ids, "<i8"), np.frombuffer(q_data, "<i8").reshape(-1, dim), k)
                if (block := held.get((dim, ids))) is None:
                    if len(held) == KEPT:
                        del held[next(iter(held))]
                    mine = np.frombuffer(ids, "<i8")
                    block = held[dim, ids] = Candidates(mine, np.frombuffer(data, "<i8").reshape(len(mine), dim))
                search.search(block)
        if search:
            yield search.result()

    deals = _deals(spark, parts)
    table = F.array(*[F.lit(d).cast("long") for d in deals])
    asked = _blocks(queries.repartition(max(1, -(-queries.count() // QUERY_BLOCK)), "id"), QUERY_BLOCK)
    asked = asked.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.explode(table).alias("deal"))
    least = max(spark.sparkContext.defaultParallelism, -(-candidates.count() // CANDIDATE_BLOCK))
    dealt = candidates.coalesce(least)
    sizes = dealt.groupBy(F.spark_partition_id().alias("part"), F.size("ints").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / CANDIDATE_BLOCK).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("before"))
    turn = F.pmod(F.coalesce(F.col("before"), F.lit(0)) + F.col("block"), F.lit(len(deals))).cast("int") + 1
    met = _blocks(dealt, CANDIDATE_BLOCK).join(F.broadcast(before), "part", "left").select("dim", "ids", "data", F.element_at(table, turn).alias("deal"))
    pairs = asked.hint("merge").join(met, "deal").where(F.col("dim") - F.col("q_dim") == 0)
    found = pairs.select("dim", "q_ids", "q_data", "ids", "data").mapInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
