"""Nearest neighbours by inner product with a vantage-point tree per shard.

Vectors are dealt into shards of bounded size by id. In each shard a vantage-point tree halves the
points again and again by their distance to a vantage point, keeping the nearest and farthest
distance on either side. Queries come in blocks; a block walks a shard's tree together, each query
into its own side first, and enters the other side unless the triangle inequality shows that nothing
there can be among its nearest. The bound is multiplied by ``relax``: 1 is exact search, more prunes
more and may miss neighbours.

Inner products become distances by one more coordinate, ``sqrt(M^2 - |x|^2)`` with M the largest norm of the shard
(0 for queries), so nearest by distance is largest by inner product, for vectors of any length. Distances only decide
which leaves are entered, with a margin for their rounding. In a leaf, every point whose inner product is within rounding
of the ``k``-th best so far is scored anew in double precision, component by component in order, and the best by
score and id are held, so that neither ties nor a single long vector lose a neighbour.

Every query block meets every shard: that is the search itself. Shards and blocks are bounded, and of
each pair only the nearest ``k`` of each query leave the task.

Defined results: vectors that are null, zero, or hold a null or a non-finite component, and rows without an id, take no part;
vectors of different length are never neighbours; equal vectors are all candidates, ties go to the
smaller id; rows repeated with one id are one query, and never candidates of it; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_QUERIES, LEAF = 16384, 4096, 256
#: Scores of a leaf computed in order at once.
SCORES = 1 << 18
RELAX = 1.0

FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Tree:
    """A vantage-point tree over the rows of ``points``, in nested tuples.

    A leaf is an array of rows. A node is (vantage row, (lo, hi) of the near side, (lo, hi) of the far side, near, far).
    """

    def __init__(self, points):
        import numpy as np

        self.points = points
        self.squares = np.einsum("ij,ij->i", points, points)
        self.root = self.split(np.arange(len(points)))

    def distances(self, queries, query_squares, rows):
        import numpy as np

        d = query_squares[:, None] + self.squares[rows][None, :] - 2.0 * (queries @ self.points[rows].T)
        return np.sqrt(np.maximum(d, 0.0))

    def split(self, rows):
        import numpy as np

        if len(rows) <= LEAF:
            return rows
        vantage = rows[len(rows) // 2]
        at = self.points[vantage : vantage + 1]
        d = self.distances(at, self.squares[vantage : vantage + 1], rows)[0]
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        bounds = [(d[side].min(), d[side].max()) for side in (near, far)]
        return vantage, *bounds, self.split(rows[near]), self.split(rows[far])

    def walk(self, queries, meet, reach, relax: float) -> None:
        """Call ``meet(active, rows)`` for each leaf and the queries that may have points there within ``reach(active)``, squared.

        Also counts the distances computed.
        """
        import numpy as np

        squares = np.einsum("ij,ij->i", queries, queries)
        # What rounding can do to a squared distance.
        double = np.finfo(float)
        slack = 16 * (queries.shape[1] + 8) * double.eps * (squares + self.squares.max()) + double.tiny
        self.seen = 0

        def visit(node, active):
            if not len(active):
                return
            if not isinstance(node, tuple):
                self.seen += len(active) * len(node)
                meet(active, node)
                return
            vantage, near_bounds, far_bounds, near, far = node
            d = self.distances(queries[active], squares[active], np.array([vantage]))[:, 0]
            self.seen += len(active)
            e = slack[active]
            least, most = np.sqrt(np.maximum(d**2 - e, 0.0)), np.sqrt(d**2 + e)
            nearer = d <= (near_bounds[1] + far_bounds[0]) / 2
            sides = ((near, near_bounds, nearer), (far, far_bounds, ~nearer))
            for side, _, first in sides:
                visit(side, active[first])
            for side, (lo, hi), first in sides:
                bound = np.maximum(np.sqrt(np.maximum(lo**2 - e, 0.0)) - most, least - np.sqrt(hi**2 + e)) * relax
                # Written so that what overflows is visited.
                visit(side, active[~first & ~(bound > np.sqrt(np.maximum(reach(active) + e, 0.0)))])

        visit(self.root, np.arange(len(queries)))

    def search(self, queries, k: int, relax: float):
        """Rows and distances of the ``k`` nearest of each query, unsorted; -1 where there are fewer."""
        import numpy as np

        squares = np.einsum("ij,ij->i", queries, queries)
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1, np.int64)

        def meet(active, rows):
            d = np.concatenate([best[active], self.distances(queries[active], squares[active], rows)], axis=1)
            rows = np.concatenate([found[active], np.broadcast_to(rows, (len(active), len(rows)))], axis=1)
            take = np.argpartition(d, k - 1, axis=1)[:, :k]
            best[active] = np.take_along_axis(d, take, 1)
            found[active] = np.take_along_axis(rows, take, 1)

        self.walk(queries, meet, lambda active: best[active].max(axis=1) ** 2, relax)
        return found, best


def norms(vectors):
    """Lengths of rows, none of them zero, without overflow or underflow of squares."""
    import numpy as np

    scale = np.abs(vectors).max(axis=1)
    unit = vectors / scale[:, None]
    return scale * np.sqrt(np.einsum("ij,ij->i", unit, unit))


def nearest_in_shard(query_ids, queries, ids, vectors, k: int, relax: float):
    """(query id, id, score) of the ``k`` nearest of each query within a shard."""
    import numpy as np

    # Equal vectors are one point with a list of ids, in order.
    vectors = vectors + 0.0
    points, point_of = np.unique(vectors, axis=0, return_inverse=True)
    by_point = np.lexsort((ids, point_of))
    first = np.searchsorted(point_of[by_point], np.arange(len(points) + 1))
    listed = ids[by_point]
    known, number = np.unique(listed, return_inverse=True)
    places = point_of[by_point] * len(known) + number
    own = np.minimum(np.searchsorted(known, query_ids), len(known) - 1)
    own = np.where(known[own] == query_ids, own, -1)

    squares, lengths, query_lengths = np.einsum("ij,ij->i", points, points), norms(points), norms(queries)
    query_squares, largest = np.einsum("ij,ij->i", queries, queries), squares.max()
    tree = Tree(np.column_stack([points, np.sqrt(np.maximum(largest - squares, 0.0))]))
    by_component = list(zip(np.ascontiguousarray(queries.T), np.ascontiguousarray(points.T)))
    double = np.finfo(float)
    rounding = 4 * (queries.shape[1] + 2) * double.eps

    held = np.zeros(len(queries), np.int64)
    score, vec = np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)

    def worst(active):
        return np.where(held[active] == k, score[active, -1], -np.inf)

    def improve(active, rows):
        least = worst(active)
        margin = rounding * query_lengths[active][:, None] * lengths[rows] + double.tiny
        # Written so that what overflows is scored.
        at, p = np.nonzero(~(queries[active] @ points[rows].T + margin < least[:, None]))
        q, p, made = active[at], rows[p], np.zeros(len(at))
        # Inner products, each summed component by component in order.
        for of_query, of_point in by_component:
            made += of_query[q] * of_point[p]
        keep = ~(made < least[at])
        q, p, made = q[keep], p[keep], made[keep]
        # Each point stands for its ``k`` smallest ids besides the query's own.
        mine = p * len(known) + own[q]
        times = np.where(own[q] < 0, 0, np.searchsorted(places, mine, "right") - np.searchsorted(places, mine))
        take = np.minimum(first[p + 1] - first[p], k + times)
        at = np.repeat(first[p], take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        q, made, found = np.repeat(q, take), np.repeat(made, take), listed[at]
        keep = found != query_ids[q]
        q, made, found = q[keep], made[keep], found[keep]
        touched = np.unique(q)
        at, column = np.nonzero(np.arange(k) < held[touched][:, None])
        before = touched[at]
        q = np.concatenate([before, q])
        made, found = np.concatenate([score[before, column], made]), np.concatenate([vec[before, column], found])
        # As in Spark, NaN (of products that overflow) comes before all numbers.
        order = np.lexsort((found, -made, ~np.isnan(made), q))
        q, made, found = q[order], made[order], found[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        q, made, found, rank = q[rank < k], made[rank < k], found[rank < k], rank[rank < k]
        score[q, rank], vec[q, rank] = made, found
        held[touched] = np.bincount(q, minlength=len(queries))[touched]

    def meet(active, rows):
        step = max(1, SCORES // int(np.minimum(first[rows + 1] - first[rows], k).sum()))
        for i in range(0, len(active), step):
            improve(active[i : i + step], rows)

    with np.errstate(over="ignore", invalid="ignore"):
        tree.walk(
            np.column_stack([queries, np.zeros(len(queries))]), meet, lambda active: query_squares[active] + largest - 2 * worst(active), relax
        )
    q, rank = np.nonzero(np.arange(k) < held[:, None])
    return query_ids[q], vec[q, rank], score[q, rank]


def nearest(
    base: DataFrame, queries: DataFrame, k: int = 20, relax: float = RELAX, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """The ``k`` nearest rows of ``base`` for each row of ``queries`` (both ``vec_id``, ``embedding``), by rank."""

    def vectors(df):
        vector = F.transform("embedding", lambda x: x.cast("double"))
        return df.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", vector.alias("embedding"), F.size("embedding").alias("dim"))

    base, queries = vectors(base), vectors(queries).dropDuplicates(["vec_id"])
    count, asked = base.count(), queries.count()
    shards, blocks = max(1, -(-count // shard_rows)), max(1, -(-asked // block_queries))

    def dealt(df, own, parts, other, others):
        place = F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(parts))
        return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<bigint>")))

    left = dealt(base, "shard", shards, "block", blocks).groupBy("dim", "shard", "block")
    right = dealt(queries, "block", blocks, "shard", shards).groupBy("dim", "shard", "block")

    def search(points, asked):
        import numpy as np
        import pyarrow as pa

        def arrays(table):
            flat = table.column("embedding").combine_chunks()
            flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
            return np.asarray(table.column("vec_id")), np.asarray(flat.flatten()).reshape(table.num_rows, -1)

        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        found = empty
        if points.num_rows and asked.num_rows:
            found = nearest_in_shard(*arrays(asked), *arrays(points), k, relax)
        return pa.table([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    found = left.cogroup(right).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
