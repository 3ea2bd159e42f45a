"""Exact top-k by inner product: KD-trees in shards that are dealt by space, searched best box first."""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow.llm.scratch import written
from hubflow.llm.tokens import sc_broadcast

#: Components of all vectors of a shard, rows of a tree's leaf, queries that are searched for together.
SHARD_VALUES, LEAF_ROWS, TOGETHER = 1 << 20, 256, 2048
#: Regions of space at most, vectors of the sample that the cuts between them are taken from, and regions that a query looks at before the others.
REGIONS, SAMPLE, NEAR = 1024, 16_384, 2


class Best:
    """The k best (score, id, row) of each of n queries: higher scores first, of equal ones smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor

    def kth(self, some: np.ndarray) -> np.ndarray:
        """What a score must at least be to count."""
        return np.maximum(self.score[some, -1], self.floor[some])

    def offer(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """of: the query of each candidate."""
        if not len(of):
            return
        k = self.score.shape[1]
        some, of = np.unique(of, return_inverse=True)
        who = np.concatenate((np.repeat(np.arange(len(some)), k), of))
        score, ids = np.concatenate((self.score[some].reshape(-1), score)), np.concatenate((self.id[some].reshape(-1), ids))
        order = np.lexsort((ids, -score, who))
        first = np.searchsorted(who[order], np.arange(len(some)))
        top = order[(first[:, None] + np.arange(k)).reshape(-1)]
        self.score[some], self.id[some] = score[top].reshape(-1, k), ids[top].reshape(-1, k)


class Tree:
    """Median splits along the longest side; low, high: the tight box of each node's vectors; least: their smallest id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.row, self.vectors = ids[order], rows[order], vectors[order]
        self.low, self.high, self.least, self.children, self.rows = [], [], [], [], []
        if len(ids):
            self._node(np.arange(len(ids)))
            self.low, self.high, self.least = np.array(self.low), np.array(self.high), np.array(self.least)

    def _node(self, rows: np.ndarray) -> int:
        here, x = len(self.rows), self.vectors[rows]
        self.low.append(x.min(0))
        self.high.append(x.max(0))
        self.least.append(int(self.ids[rows].min()))
        self.children.append(())
        self.rows.append(np.sort(rows))
        if len(rows) > LEAF_ROWS and x.shape[1]:
            side = int(np.argmax(self.high[here] - self.low[here]))
            by = rows[np.argpartition(x[:, side], len(rows) // 2)]
            self.children[here] = (self._node(by[: len(rows) // 2]), self._node(by[len(rows) // 2 :]))
            self.rows[here] = None
        return here

    def search(self, queries: np.ndarray, own: np.ndarray, best: Best) -> None:
        """Offer best the rows that may be among the k best of each query, other than the query's own row.

        Queries are searched for together: the open node whose box promises one of them most beyond its kth score is next,
        with those queries to which it still promises something.
        """
        if not len(self.rows) or not len(queries):
            return
        bounds = upper_bounds(queries, self.low, self.high)
        turn, open_nodes = 0, [(0.0, 0, 0, np.arange(len(queries)))]
        while open_nodes:
            _, _, node, some = heapq.heappop(open_nodes)
            some = some[promising(bounds[some, node], self.least[node], best, some)]
            if not len(some):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    kth, turn = best.kth(some), turn + 1
                    gain = float(np.max(np.where(np.isfinite(kth), bounds[some, child] - kth, np.inf)))
                    heapq.heappush(open_nodes, (-gain if np.isfinite(gain) else -float(bounds[some, child].max()) - 1e300, turn, child, some))
                continue
            rows = self.rows[node]
            scores = queries[some] @ self.vectors[rows].T
            hit = scores >= best.kth(some)[:, None]
            hit &= self.row[rows][None, :] != own[some][:, None]
            q, r = np.nonzero(hit)
            best.offer(some[q], scores[q, r], self.ids[rows[r]])


def upper_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Queries x boxes: no vector in the box has a higher inner product."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def promising(bound: np.ndarray, least, best: Best, some: np.ndarray) -> np.ndarray:
    """Whether a box of that bound and smallest id can change the k best: by a higher score than the kth, or the same with a smaller id."""
    kth = best.kth(some)
    return (bound > kth) | (bound == kth) & ((best.score[some, -1] < kth) | (least < best.id[some, -1]))


class Regions:
    """Space cut at medians of a sample along the longest sides, into at most so many regions."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.side, self.cut, self.children, self.count = [], [], [], 0
        self._cut(sample, regions)

    def _cut(self, x: np.ndarray, regions: int) -> int:
        here = len(self.side)
        self.side.append(-1)
        self.cut.append(0.0)
        self.children.append((self.count, self.count))
        spread = x.max(0) - x.min(0) if len(x) and x.shape[1] else np.zeros(1)
        if regions > 1 and spread.max() > 0:
            side = int(np.argmax(spread))
            cut = float(np.partition(x[:, side], len(x) // 2)[len(x) // 2])
            if not (x[:, side] < cut).any():
                cut = float(x[x[:, side] > cut, side].min())
            self.side[here], self.cut[here] = side, cut
            below = x[:, side] < cut
            self.children[here] = (self._cut(x[below], regions // 2), self._cut(x[~below], regions - regions // 2))
        else:
            self.count += 1
        return here

    def of(self, x: np.ndarray) -> np.ndarray:
        """The region of each vector."""
        out, open_nodes = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if self.side[node] < 0:
                out[rows] = self.children[node][0]
            elif len(rows):
                below = x[rows, self.side[node]] < self.cut[node] if self.side[node] < x.shape[1] else np.full(len(rows), self.cut[node] > 0)
                open_nodes += [(self.children[node][0], rows[below]), (self.children[node][1], rows[~below])]
        return out


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of integers as rows of doubles; shorter ones are filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and sizes.min() == sizes.max():
        return values.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(x).astype(x.dtype.newbyteorder("<")).tobytes() for x in arrays)


class Queries:
    """Queries of a block: row, id, kth score so far, vector."""

    def __init__(self, load: bytes, width: int):
        n = len(load) // 8 // (width + 3)
        self.row, self.id = np.frombuffer(load, "<i8", n), np.frombuffer(load, "<i8", n, 8 * n)
        self.kth, self.vector = np.frombuffer(load, "<f8", n, 16 * n), np.frombuffer(load, "<f8", n * width, 24 * n).reshape(n, width)


FOUND = "shard long, query_row long, query_id long, vec_id long, score long"


def found_table(shard: int, row: np.ndarray, ids: np.ndarray, best: Best) -> pa.Table:
    q, r = np.nonzero(np.isfinite(best.score))
    return pa.table([pa.array(np.full(len(q), shard)), pa.array(row[q]), pa.array(ids[q]), pa.array(best.id[q, r]), pa.array(best.score[q, r].astype(np.int64))], names=[x.split()[0] for x in FOUND.split(", ")])


def top_k(vectors: DataFrame, is_query, k: int = 5, shard_values: int = SHARD_VALUES, regions: int = REGIONS) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query with all other rows, ties to the smaller vec_id.

    vectors has vec_id and v (whole numbers); is_query is a condition on vec_id. Space is cut into regions at medians of a
    sample; a region of many vectors is dealt into shards by hash. A query first searches its own shard, then, with its
    kth score, the shards of the NEAR regions whose boxes promise most, then, with what it has found there, those of all
    other regions whose boxes can still hold a better one. The table of regions' boxes is broadcast: REGIONS rows at most. Queries
    travel in blocks. Rows with a null vec_id or v take no part; vectors of fewer components count as filled with zeros.
    Each row of a repeated vec_id is a query and a candidate of its own; only the query's row itself is no neighbour,
    and ranks count within a row. Sums must stay under 2 ** 53. An empty table gives no rows.
    """
    given = vectors.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    given = given.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), is_query.alias("is_query"))
    rows, width = given.agg(F.count("*"), F.max(F.size("v"))).first()
    width, shard_rows = width or 0, max(1, shard_values // max(1, width or 0))
    many = min(regions, max(1, rows // shard_rows))
    sample = given.select("v").sample(min(1.0, 2 * SAMPLE / max(1, rows)), seed=9).limit(SAMPLE).collect() if many > 1 else []
    cuts = sc_broadcast(vectors, Regions(widened(matrix(pa.array([r.v for r in sample], pa.list_(pa.float64()))), width), many))

    def place(batches):
        for batch in batches:
            region = cuts.value.of(widened(matrix(batch["v"]), width))
            yield pa.record_batch([*(batch[c] for c in ("row", "vec_id", "v", "is_query")), pa.array(region.astype(np.int32))], names=["row", "vec_id", "v", "is_query", "region"])

    placed = written(given.mapInArrow(place, "row long, vec_id long, v array<double>, is_query boolean, region int"), "vectors")

    def partial_boxes(batches):
        found: dict[int, list] = {}
        for batch in batches:
            x, region, ids = widened(matrix(batch["v"]), width), batch["region"].to_numpy(), batch["vec_id"].to_numpy()
            for r in np.unique(region).tolist():
                here = x[region == r]
                low, high, n, least = here.min(0), here.max(0), len(here), int(ids[region == r].min())
                if r in found:
                    a = found[r]
                    low, high, n, least = np.minimum(low, a[0]), np.maximum(high, a[1]), n + a[2], min(least, a[3])
                found[r] = [low, high, n, least]
        kinds = [pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64(), pa.int64()]
        values = [[r, a[0].tolist(), a[1].tolist(), a[2], a[3]] for r, a in found.items()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*values, strict=True) if values else [[]] * 5, kinds, strict=True)], names=["region", "low", "high", "n", "least"])

    parts = placed.select("region", "vec_id", "v").mapInArrow(partial_boxes, "region int, low array<double>, high array<double>, n long, least long")
    least = lambda c, f: F.array(*(f(F.col(c)[i]) for i in range(width))) if width else F.first(c)
    boxes = sorted(parts.groupBy("region").agg(least("low", F.min).alias("low"), least("high", F.max).alias("high"), F.sum("n").alias("n"), F.min("least").alias("least")).collect())
    low, high = (np.array([b[c] for b in boxes], float).reshape(len(boxes), width) for c in ("low", "high"))
    number, smallest = np.array([b.region for b in boxes], np.int64), np.array([b.least for b in boxes], np.int64)
    pieces = np.array([-(-b.n // shard_rows) for b in boxes], np.int64)
    first = np.cumsum(pieces) - pieces
    shared = sc_broadcast(vectors, (low, high, number, smallest, pieces))
    counts = vectors.sparkSession.createDataFrame(list(zip(number.tolist(), first.tolist(), pieces.tolist(), strict=True)), "region int, first long, pieces long")
    shards = placed.join(F.broadcast(counts), "region").select("row", "vec_id", "v", "is_query", "region", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("pieces"))).alias("shard"))
    dealt = shards.groupBy("shard")

    def tree(table: pa.Table) -> Tree:
        return Tree(table["vec_id"].to_numpy(), table["row"].to_numpy(), widened(matrix(table["v"]), width))

    def at_home(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t, x = tree(table), widened(matrix(table["v"]), width)
        ask = np.flatnonzero(table["is_query"].to_numpy(zero_copy_only=False))
        own, ids = table["row"].to_numpy()[ask], table["vec_id"].to_numpy()[ask]
        best = Best(len(ask), k, np.full(len(ask), -np.inf))
        for b in range(0, len(ask), TOGETHER):
            part = Best(min(TOGETHER, len(ask) - b), k, best.floor[b : b + TOGETHER])
            t.search(x[ask[b : b + TOGETHER]], own[b : b + TOGETHER], part)
            best.score[b : b + TOGETHER], best.id[b : b + TOGETHER] = part.score, part.id
        return found_table(key[0].as_py(), own, ids, best)

    def route(wave: int):
        def run(batches):
            low, high, number, smallest, pieces = shared.value
            begin = np.cumsum(pieces) - pieces
            for batch in batches:
                x, shard = widened(matrix(batch["v"]), width), batch["shard"].to_numpy()
                row, ids, kth, kth_id = (batch[c].to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "kth", "kth_id"))
                bounds = upper_bounds(x, low, high)
                rank = np.argsort(np.argsort(-bounds, axis=1, kind="stable"), axis=1, kind="stable")
                wanted = (bounds > kth[:, None]) | (bounds == kth[:, None]) & (smallest[None, :] < kth_id[:, None])
                wanted &= rank < NEAR if wave == 1 else rank >= NEAR
                out = []
                for r in np.flatnonzero(wanted.any(0)).tolist():
                    for p in range(int(pieces[r])):
                        some = np.flatnonzero(wanted[:, r] & (shard != begin[r] + p))
                        out += [(int(begin[r] + p), packed(row[q], ids[q], kth[q], x[q])) for q in np.array_split(some, -(-len(some) // TOGETHER)) if len(q)] if len(some) else []
                to, load = zip(*out, strict=True) if out else ((), ())
                yield pa.record_batch([pa.array(to, pa.int64()), pa.array(load, pa.binary())], names=["shard", "load"])

        return run

    def abroad(key: tuple[pa.Scalar, ...], table: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [found_table(0, np.zeros(0, np.int64), np.zeros(0, np.int64), Best(0, k, np.zeros(0)))]
        if table.num_rows and blocks.num_rows:
            t = tree(table)
            for load in blocks["load"].to_pylist():
                q = Queries(load, width)
                best = Best(len(q.row), k, q.kth)
                t.search(q.vector, q.row, best)
                out.append(found_table(key[0].as_py(), q.row, q.id, best))
        return pa.concat_tables(out)

    best_first = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    found = dealt.applyInArrow(at_home, FOUND)
    asking = shards.where("is_query").select("row", "vec_id", "v", "shard")
    for wave in (1, 2) if int(pieces.sum()) > 1 else ():
        found = written(ranked(found).drop("rank"), "neighbours")
        kth = ranked(found).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("kth"), F.col("vec_id").alias("kth_id"))
        state = asking.join(kth, "row", "left").na.fill({"kth": float("-inf"), "kth_id": np.iinfo(np.int64).max})
        blocks = state.mapInArrow(route(wave), "shard long, load binary")
        found = found.unionByName(dealt.cogroup(blocks.groupBy("shard")).applyInArrow(abroad, FOUND))
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def op9_kd_tree_top_k(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return top_k(rows.where(F.col("embedding").isNotNull() & finite).select("vec_id", v.alias("v")), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
