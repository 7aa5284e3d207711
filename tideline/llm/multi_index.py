"""Approximate nearest neighbours by an inverted multi-index.

Vectors are split in two halves and each half is quantised by its own codebook (Lloyd's k-means on a bounded sample of rows). A
vector lies in the cell of its two codewords. For a query, the inner products of its halves with the codewords are sorted, and a
heap walks the pairs of codewords by falling sum, cell by cell, until the cells taken hold ``probe`` of all rows. The rows of the
cells are scored exactly on the original vectors in double precision, and the best are kept.

All rows are indexed. Rows lie in blocks of bounded size by their first codeword and move there once. A query goes to the blocks
that hold one of its cells, as its vector and the sum of its last cell; a task sorts a block's rows before the queries that ask
it, keeps those rows in memory and streams the queries past them, however many they are. What leaves it are the best few of each
query. Ties go to the smaller id: rows within a rounding error of the last place are all kept until their scores are recomputed
in one fixed order of addition, so equal vectors score equal.

Vectors that are null, empty, zero, of another length than most, or that hold null or non-finite components take no part, as
query or as candidate. Null ids take no part. Of rows that repeat an id, the one with the largest vector (in array order) counts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from tideline.llm.frames import staged

ROWS_PER_BLOCK = 4096  # at least; a block grows to MOST_PER_BLOCK rows before the number of blocks passes BLOCKS
MOST_PER_BLOCK = 65536
BLOCKS = 256
QUERIES_PER_BLOCK = 2048  # scored against a block at a time
SCORES = 1 << 22  # scores held at a time
SLACK = 1e-12  # times the norms of the query and of the largest row
CELL_SLACK = 1e-12  # the same for the sum of a cell: sums made in another batch may differ by rounding


def usable(vector: Column) -> Column:
    """Every component is a finite number and one is not 0."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vec`` of the rows that take part, one per id."""
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    good = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    return good.groupBy("id").agg(F.max("vec").alias("vec"))


def k_means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codebook of at most k rows; starts from evenly spaced rows, so it is the same every time."""
    distinct = np.unique(points, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        many = np.bincount(own, minlength=k)
        for d in range(points.shape[1]):
            total = np.bincount(own, points[:, d], k)
            centres[many > 0, d] = total[many > 0] / many[many > 0]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1)[None, :] - 2 * points @ centres.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells by falling sum of the two inner products until they hold ``enough`` rows (all cells if they never do).

    The heap holds at most one cell for each place in the first order: a cell enters when the one before it in its row was
    taken, and a row is opened when its predecessor's first cell was.
    """
    rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    up, across = first[rows], second[columns]
    heap, taken, have = [(-(up[0] + across[0]), 0, 0)], [], 0
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        cell = (int(rows[i]), int(columns[j]))
        many = sizes[cell]
        if many:
            taken.append(cell)
            have += many
        if j == 0 and i + 1 < len(up):
            heapq.heappush(heap, (-(up[i + 1] + across[0]), i + 1, 0))
        if j + 1 < len(across):
            heapq.heappush(heap, (-(up[i] + across[j + 1]), i, j + 1))
    return taken


def best(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, r_ids: np.ndarray, visits: np.ndarray, cell: np.ndarray, top: int):
    """(query, row, score) of each query's best visited rows; ``visits`` marks the cells that a query takes, ``cell`` is each row's."""
    found = []
    slack = max(SLACK, 8 * queries.shape[1] * np.finfo(float).eps)  # two sums of rounded products for each of two rows
    margin = slack * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max(initial=0) + np.finfo(float).tiny
    step = max(1, min(256, SCORES // max(1, len(rows))))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        score = np.where(visits[at : at + step][:, cell] & (r_ids[None, :] != q_ids[at : at + step, None]), part @ rows.T, -np.inf)
        if score.shape[1] > top:
            last = np.partition(score, score.shape[1] - top, axis=1)[:, score.shape[1] - top]
        else:
            last = np.full(len(part), -np.inf)
        q, r = np.nonzero((score >= (last - margin[at : at + step])[:, None]) & (score > -np.inf))
        found.append((q + at, r))
    q, r = (np.concatenate(x) for x in zip(*found))
    exact = np.zeros(len(q))
    for d in range(queries.shape[1]):  # one fixed order of addition
        exact += queries[q, d] * rows[r, d]
    order = np.lexsort((r_ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < top
    return q[keep], r[keep], exact[keep]


def nearest_rows(rows: DataFrame, every: int, top: int, words: int = 64, probe: float = 0.6, sample: int = 20_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``top`` rows nearest (largest inner product) to each row whose id is divisible by ``every``.

    ``words`` codewords in each half, ``probe`` the share of rows a query looks at, ``sample`` the most rows the codebooks are
    fitted on (those with the smallest id hash). Columns: ``query_id, rank, vec_id, score``.
    """
    spark = rows.sparkSession
    good = staged(vectors_of(rows, id_col, vector_col), "vectors")
    lengths = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], result)
    dim = lengths[0]["n"]
    total = lengths[0]["count"]
    good = good.filter(F.size("vec") == dim)
    fitted = good.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toPandas()
    points = np.array(fitted["vec"].tolist(), np.float64)
    half = max(1, dim // 2)
    books = (k_means(points[:, :half], words), k_means(points[:, half:], words) if dim > half else np.zeros((1, 0)))

    def to_cells(batches):
        for batch in batches:
            vec = _matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nearest(vec[:, :half], books[0])), pa.array(nearest(vec[:, half:], books[1]))], names=["id", "vec", "i", "j"])

    index = staged(good.mapInArrow(to_cells, "id long, vec array<double>, i long, j long"), "multi-index")
    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)  # one number per cell: words squared at most
    for row in index.groupBy("i", "j").count().collect():
        sizes[row["i"], row["j"]] = row["count"]
    # consecutive first codewords share a block of rows; a codeword with more rows than a block is dealt over several
    block_rows = min(MOST_PER_BLOCK, max(ROWS_PER_BLOCK, -(-total // BLOCKS)))
    ends = np.cumsum(sizes.sum(1))
    first_block = (ends - sizes.sum(1)) // block_rows
    many_blocks = np.maximum(ends - 1, 0) // block_rows - first_block + 1
    enough = max(int(np.ceil(probe * total)), top + 1)
    wide = len(books[1])

    def to_asked(batches):
        """One row per query and block of rows that it visits, with the sum of the last cell of its walk."""
        for batch in batches:
            vec = _matrix(batch.column(1), dim)
            at, block, floor = [], [], []
            for n, (a, b) in enumerate(zip(vec[:, :half] @ books[0].T, vec[:, half:] @ books[1].T)):
                cells = walk(a, b, sizes, enough)
                asked = {k for i in {i for i, _ in cells} for k in range(int(first_block[i]), int(first_block[i] + many_blocks[i]))}
                at += [n] * len(asked)
                block += sorted(asked)
                floor += [a[cells[-1][0]] + b[cells[-1][1]]] * len(asked)
            pick = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(block, pa.int64()), pa.array(floor, pa.float64())], names=["id", "vec", "block", "floor"])

    asked = index.filter(F.col("id") % every == 0).select("id", "vec").mapInArrow(to_asked, "id long, vec array<double>, block long, floor double")
    of_word = lambda values: F.get(F.array(*[F.lit(int(v)) for v in values]), F.col("i").cast("int"))
    block = (of_word(first_block) + F.pmod(F.xxhash64("id"), of_word(many_blocks))).cast("long")
    held = index.select("id", "vec", block.alias("block"), F.lit(None).cast("double").alias("floor"), (F.col("i") * wide + F.col("j")).alias("code"))
    both = held.unionByName(asked.withColumn("code", F.lit(None).cast("long")))
    # a block's rows come first (no floor), then the queries that ask it
    met = both.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("floor"), "id")

    def meet(batches):
        now, parts, rows = None, [], None
        for batch in batches:
            blocks, codes = batch.column(2).to_numpy(), batch.column(4)
            is_row = ~np.asarray(codes.is_null())
            edges = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (is_row[1:] != is_row[:-1]), True])
            for lo, hi in zip(edges, edges[1:]):
                if blocks[lo] != now:
                    now, parts, rows = blocks[lo], [], None
                ids, vec = batch.column(0)[lo:hi].to_numpy(), _matrix(batch.column(1)[lo:hi], dim)
                if is_row[lo]:
                    parts.append((ids, vec, codes[lo:hi].to_numpy()))
                    continue
                if rows is None and parts:
                    rows, parts = [np.concatenate(x) for x in zip(*parts)], []
                    cells, of_row = np.unique(rows[2], return_inverse=True)
                if rows is None:
                    continue
                floor = batch.column(3)[lo:hi].to_numpy()
                for at in range(0, hi - lo, QUERIES_PER_BLOCK):
                    q = vec[at : at + QUERIES_PER_BLOCK]
                    reach = (q[:, :half] @ books[0].T)[:, cells // wide] + (q[:, half:] @ books[1].T)[:, cells % wide]
                    visits = reach >= (floor[at : at + len(q)] - CELL_SLACK * np.linalg.norm(q, axis=1) * longest)[:, None]
                    mine = ids[at : at + len(q)]
                    n, r, score = best(q, mine, rows[1], rows[0], visits, of_row, top)
                    yield pa.RecordBatch.from_arrays([pa.array(mine[n]), pa.array(rows[0][r]), pa.array(score)], names=["query_id", "vec_id", "score"])

    longest = sum(np.linalg.norm(book, axis=1).max(initial=0) for book in books)
    near = met.mapInArrow(meet, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)
