"""Exact top-k search by distributed histogram selection.

Queries go in blocks of at most ``block`` vectors; a block's size is known before it is
sent to the executors. For a block every candidate is scored, and each task counts
its scores in a histogram for each query. A task's histogram goes down only to the
bin of its own kth score (no lower bin can hold the kth of all), so a task sends at
most k counts for a query. Summed, the histograms tell the bin of each query's kth
score; the next round divides that bin, until bins are one wide and the kth value is
exact. A last pass keeps what is above it, and of the ties at it the smallest ids:
each task at most k of them, so ties never gather anywhere.

Scores are integers, computed in floating point where their bound proves them exact,
and of larger vectors with Python's integers. A score beyond the range of a long
counts as the nearest long.

Defined results: vectors that are null, hold null or non-finite components, or differ
in length from most of a block's queries take no part (unequal lengths have no inner
product); rows that share an id are candidates of their own, and as queries the first
vector by order counts; a query never meets rows with its own id; null ids take no
part; columns other than id and vector are left out, whatever their names; empty tables give no rows; a query with fewer than k candidates gets them all.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: At most this many bytes of query vectors go to the executors at once.
BLOCK_BYTES = 16 << 20
BINS = 1024
#: Sums below this are exact in floating point.
EXACT = 2**52
HUGE, LONG = 1.7976931348623157e308, 2**63 - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): integer components as doubles, of rows that take part."""
    v = vectors[vector_col].cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # Doubles of 2^53 and more are integers; the largest finite one stands for products beyond it.
    scaled = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(F.greatest(F.least(x * scale, F.lit(HUGE)), F.lit(-HUGE)))
    return vectors.where(fine & vectors[id_col].isNotNull()).select(vectors[id_col].cast("long").alias("vec_id"), F.transform(v, scaled).alias("v"))


def _scores(batch, ids, matrix, dims: int, wide: bool):
    """(candidate ids, score matrix queries x candidates, which of its cells count) of a batch; a query's own rows don't.

    Scores are floats, or if ``wide`` unsigned integers in the order of the scores' longs.
    """
    import numpy as np

    lists = batch.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    keep = sizes == dims
    mine = batch.column(0).to_numpy()[keep]
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if not keep.all():
        values = values[np.repeat(keep, sizes)]
    rows = values.reshape(-1, dims)
    with np.errstate(over="ignore", invalid="ignore"):
        scores = matrix @ rows.T
        if wide:
            scores = _longs(scores, matrix, rows)
    counts = np.ones(scores.shape, bool)
    for k in np.flatnonzero(np.isin(mine, ids)):
        counts[np.searchsorted(ids, mine[k]), k] = False
    return mine, scores, counts


def _longs(scores, matrix, rows):
    """The exact scores as unsigned integers: their longs plus 2^63."""
    import numpy as np

    reach = np.sqrt((matrix * matrix).sum(1))[:, None] * np.sqrt((rows * rows).sum(1))[None, :]
    sure = reach < EXACT  # not where it isn't a number
    out = np.where(sure, scores, 0).astype(np.int64)
    for q in np.flatnonzero(~sure.all(1)):
        own = [int(x) for x in matrix[q]]
        for c in np.flatnonzero(~sure[q]):
            out[q, c] = max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(own, rows[c], strict=True))))
    return out.view(np.uint64) ^ np.uint64(1 << 63)


def _parts(batches, rows: int):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _histograms(candidates: DataFrame, shared, dims: int, k: int, low, width: int, wide: bool):
    """Counts by query and bin for the bins from ``low[q]`` up; scores above the last bin count there."""
    lows = low

    def run(batches):
        import numpy as np

        ids, matrix = shared.value
        total = np.zeros((len(ids), BINS + 1), np.int64)
        for batch in _parts(batches, 1024):
            _, scores, counts = _scores(batch, ids, matrix, dims, wide)
            if wide:
                counts &= scores >= lows[:, None]
                which = np.where(counts, np.minimum((scores - lows[:, None]) // np.uint64(width), np.uint64(BINS)).astype(np.int64), -1)
            else:
                which = np.floor((scores - lows[:, None]) / width)
                np.clip(which, -1, BINS, out=which)
                which[~counts] = -1
            flat = which.astype(np.int64) + 1 + np.arange(len(ids))[:, None] * (BINS + 2)
            total += np.bincount(flat.ravel(), minlength=len(ids) * (BINS + 2)).reshape(len(ids), BINS + 2)[:, 1:]
        above = total[:, ::-1].cumsum(1)[:, ::-1]
        q, b = np.nonzero((total > 0) & (above - total < k))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(total[q, b])], ["q", "bin", "n"])

    return candidates.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _kth_values(candidates: DataFrame, shared, count: int, dims: int, k: int, bound: int, wide: bool):
    """Each query's kth largest score, or the lowest bound if it has fewer candidates."""
    import numpy as np

    low = np.zeros(count, np.uint64) if wide else np.full(count, float(-bound))
    width = max(1, -(-(2**64 if wide else 2 * bound + 1) // BINS))
    downwards = Window.partitionBy("q").orderBy(F.desc("bin"))
    while True:
        seen = _histograms(candidates, shared, dims, k, low, width, wide).withColumn("seen", F.sum("n").over(downwards))
        for r in seen.where((F.col("seen") >= k) & (F.col("seen") - F.col("n") < k)).select("q", "bin").collect():  # a row for each query of the block
            low[r.q] += np.uint64(r.bin * width) if wide else r.bin * width
        if width == 1:
            return low
        width = -(-width // BINS)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products for each query row against all of ``vectors``."""
    import numpy as np

    spark = vectors.sparkSession
    candidates = usable(vectors, id_col, vector_col, scale)
    asked = usable(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    facts = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts.n:
        return spark.createDataFrame([], schema)
    largest = lambda df: df.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    most = largest(candidates), largest(asked)
    bound = np.sqrt(most[0]) * np.sqrt(most[1])
    wide = not bound < EXACT
    bound = 0 if wide else int(np.ceil(bound)) + 1
    kind = np.float32 if not wide and bound < 2**23 and max(most) < 2**23 else np.float64
    per_block = max(1, min(2048, BLOCK_BYTES // (8 * facts.dims)))
    blocks = -(-facts.n // per_block)
    hits = None
    for b in range(blocks):
        own, last = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), None
        while rows := own.where(F.lit(True) if last is None else F.col("vec_id") > last).orderBy("vec_id").limit(per_block).collect():
            last = rows[-1].vec_id
            for dims in sorted({len(r.v) for r in rows}):
                same = [r for r in rows if len(r.v) == dims]
                ids = np.array([r.vec_id for r in same], np.int64)
                shared = spark.sparkContext.broadcast((ids, np.array([r.v for r in same], kind)))
                kth = _kth_values(candidates, shared, len(ids), dims, k, bound, wide)
                found = candidates.mapInArrow(_selection(shared, kth, dims, k, wide), "query_id long, vec_id long, score long")
                hits = found if hits is None else hits.unionAll(found)
            if len(rows) < per_block:
                break
    if hits is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _selection(shared, kth, dims: int, k: int, wide: bool):
    def longs(x):
        import numpy as np

        return (x ^ np.uint64(1 << 63)).view(np.int64) if wide else x.astype(np.int64)

    def run(batches):
        import heapq

        import numpy as np

        ids, matrix = shared.value
        ties: list[list[int]] = [[] for _ in ids]
        for batch in _parts(batches, 1024):
            mine, scores, counts = _scores(batch, ids, matrix, dims, wide)
            q, c = np.nonzero((scores > kth[:, None]) & counts)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(mine[c]), pa.array(longs(scores[q, c]))], ["query_id", "vec_id", "score"])
            q, c = np.nonzero((scores == kth[:, None]) & counts)
            if len(q):
                order = np.lexsort((mine[c], q))
                q, c = q[order], c[order]
                first = np.searchsorted(q, np.arange(len(ids)))
                place = np.arange(len(q)) - first[q]
                for x, y in zip(q[place < k].tolist(), mine[c[place < k]].tolist(), strict=True):
                    ties[x].append(y)
                for x in set(q.tolist()):
                    ties[x] = heapq.nsmallest(k, ties[x])
        rows = [(x, y) for x, own in enumerate(ties) for y in own]
        if rows:
            q = np.array([x for x, _ in rows])
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array([y for _, y in rows], pa.int64()), pa.array(longs(kth[q]))], ["query_id", "vec_id", "score"])

    return run
