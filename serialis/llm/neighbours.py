"""Approximate nearest neighbours by balanced posting lists.

The centroids are fitted in two levels, each to a bounded sample: cells to one of the whole table on
the driver, then the lists' centroids to one of each cell, a task per cell. A table of n vectors has
about sqrt(n) lists, so that both their number and their lengths grow more slowly than the table; all
their centroids stay in memory, every vector stays in lists on disk. A vector is posted in the list
of its nearest centroid and, if it lies near a boundary, in those of further centroids whose
distance is within a ratio of the nearest, unless a chosen centroid is nearer to the candidate than
the vector is. A query finds centroids by best-first search over their neighbour graph; it goes on
as long as they are within a ratio of the nearest's distance, and these lists are the query's.
Lists are cut into parts of about PART vectors, and the queries of a list into parts, so that a
crowded one is many tasks. A task streams the queries past the part's vectors, ranks them exactly
by matrix products, and the best of all parts are the result.

Vectors of each length are an index of their own.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialis.llm.common import list_array, saved

#: Bound, on average, of the vectors that the cells are fitted to, and those that one cell's lists are fitted to.
SAMPLE, CELL_SAMPLE = 16_384, 8_192
#: Most cells, and most lists of a cell; up to (MOST_CELLS * MOST_LISTS)^2 vectors there are sqrt(n) lists.
MOST_CELLS, MOST_LISTS = 256, 256
#: Fewest vectors of a list on average.
LIST_SIZE = 128
#: A vector's copies, and the distance ratio up to which it has them.
COPIES, COPY_RATIO = 4, 1.1
#: The distance ratio up to which a list is read for a query.
LIST_RATIO = 1.2
#: Neighbours of a centroid in the graph; nearest centroids that a search keeps open at least.
DEGREE, WIDTH = 24, 32
#: Vectors of a list, and queries of one, that a task has.
PART, QUERY_PART = 4_096, 8_192
ROUNDS = 8


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """k-means on unit vectors in which a cluster's size is held against it, so that sizes stay even."""
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    sizes = np.full(k, len(x) / k)
    for _ in range(rounds):
        # A centroid twice as full as the average is as good as one 0.1 further away.
        cost = distances(x, centroids) + 0.1 * (sizes / (len(x) / k) - 1)
        own = cost.argmin(1)
        now = np.bincount(own, minlength=k)
        sizes = (sizes + now) / 2
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where((norms > 0)[:, None], sums / np.maximum(norms, 1e-12)[:, None], centroids)
    return centroids


class Graph:
    """Neighbour graph of the centroids, with best-first search from a fixed entry."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        links: list[set[int]] = [{(i + 1) % k} for i in range(k)]  # a ring keeps the graph connected
        for begin in range(0, k, 1024):
            near = np.argsort(distances(centroids[begin : begin + 1024], centroids), axis=1, kind="stable")[:, : DEGREE + 1]
            for i, row in enumerate(near.tolist(), begin):
                links[i].update(row)
                for other in row[: DEGREE // 2]:
                    links[other].add(i)
        self.links = [np.array(sorted(x - {i}), np.int64) for i, x in enumerate(links)]
        self.entry = int((centroids @ centroids.mean(0)).argmax())

    def search(self, q: np.ndarray, ratio: float, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """The centroids found within `ratio` of the nearest's distance, or of the `width` nearest ones
        if those lie further out; nearest first, with their distances."""
        d = float(distances(q[None], self.centroids[[self.entry]])[0, 0])
        seen, todo, found, best = np.zeros(len(self.centroids), bool), [(d, self.entry)], [(d, self.entry)], [-d]
        nearest = d
        seen[self.entry] = True
        while todo:
            d, at = heapq.heappop(todo)
            if len(best) >= width and d > max(-best[0], ratio * nearest):
                break
            new = self.links[at][~seen[self.links[at]]]
            seen[new] = True
            for far, k in zip(distances(q[None], self.centroids[new])[0].tolist(), new.tolist(), strict=True):
                nearest = min(nearest, far)
                if len(best) < width or far <= max(-best[0], ratio * nearest):
                    heapq.heappush(todo, (far, k))
                    found.append((far, k))
                    heapq.heappush(best, -far)
                    if len(best) > width:
                        heapq.heappop(best)
        found.sort()
        return np.array([k for _, k in found], np.int64), np.array([d for d, _ in found])


def postings(x: np.ndarray, centroids: np.ndarray) -> list[np.ndarray]:
    """The lists of each vector, its own first."""
    far = distances(x, centroids)
    near = np.argpartition(far, min(COPIES * 2, far.shape[1] - 1), axis=1)[:, : COPIES * 2]
    out = []
    for row, d in zip(near, far, strict=True):
        row = row[np.lexsort((row, d[row]))]
        chosen = [int(row[0])]
        for c in map(int, row[1:]):
            if len(chosen) == COPIES or d[c] > COPY_RATIO * d[chosen[0]] + 1e-9:
                break
            if all(distances(centroids[[c]], centroids[[o]])[0, 0] >= d[c] * 0.7 for o in chosen):
                chosen.append(c)
        out.append(np.array(chosen, np.int32))
    return out


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(vectors: list[np.ndarray], at_most: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """(row numbers, unit vectors) of each length, at most so many at a time."""
    lengths = np.array([len(v) for v in vectors])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length).tolist()
        for some in (rows[i : i + at_most] for i in range(0, len(rows), at_most)):
            yield some, _unit(np.stack([vectors[k] for k in some]).astype(np.float64))


class Index:
    """The centroids of each vector length, with the lists' numbers; a length without any has one list."""

    def __init__(self, centroids: dict[int, np.ndarray], sizes: np.ndarray | None = None):
        self.centroids, self.sizes = centroids, sizes
        self.graphs = {d: Graph(c) for d, c in centroids.items()} if sizes is not None else {}
        ends = np.cumsum([1, *(len(c) for c in centroids.values())]).tolist()
        self.first, self.size = dict(zip(centroids, ends[:-1], strict=True)), ends[-1]

    def post(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, rid, v) with the lists of each vector, its own first."""
        for batch in batches:
            vectors = _vectors(batch.column(2))
            lists: list[np.ndarray] = [np.zeros(1, np.int32)] * len(vectors)
            for rows, x in _by_length(vectors, max(1, (1 << 21) // self.size)):
                if (d := x.shape[1]) in self.centroids:
                    for row, found in zip(rows, postings(x, self.centroids[d]), strict=True):
                        lists[row] = found + self.first[d]
            yield pa.RecordBatch.from_arrays([*batch.columns, list_array(lists, pa.int32())], [*batch.schema.names, "lists"])

    def ask(self, k: int):
        """Rows (id, rid, v) with the lists to be read for k neighbours: those within the ratio, and of
        further ones as many as hold enough vectors for a full answer."""

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = _vectors(batch.column(2))
                lists: list[np.ndarray] = [np.zeros(1, np.int32)] * len(vectors)
                for rows, x in _by_length(vectors, 1024):
                    if (d := x.shape[1]) not in self.centroids:
                        continue
                    for row, q in zip(rows, x, strict=True):
                        found, far = self.graphs[d].search(q, LIST_RATIO)
                        need = int(np.searchsorted(np.cumsum(self.sizes[found + self.first[d]]), k + 1)) + 1
                        if need > len(found):
                            found = np.argsort(distances(q[None], self.centroids[d])[0], kind="stable")
                            need = int(np.searchsorted(np.cumsum(self.sizes[found + self.first[d]]), k + 1)) + 1
                        wanted = int((far <= LIST_RATIO * far[0] + 1e-9).sum())
                        lists[row] = (found[: max(wanted, need)] + self.first[d]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, list_array(lists, pa.int32())], [*batch.schema.names, "lists"])

        return ask


_FOUND = "query_id long, query_rid long, vec_id long, rid long, score double"


def _ranker(k: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (list, part, query_part, asks, id, rid, v) in this order, each part's vectors ahead of its
        queries: the k nearest of the part for each query, equal ones by id."""
        at, ids, rids, x, norms, by_length = None, [], [], [], None, {}
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)
            vectors = _vectors(batch.column(6))
            own_ids, own_rids = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            out: list[tuple] = []
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True):
                if begin == end:
                    continue
                *group, asks = keys[begin].tolist()
                if group != at:
                    at, ids, rids, x, by_length = group, [], [], [], {}
                if not asks:
                    ids.append(own_ids[begin:end])
                    rids.append(own_rids[begin:end])
                    x += vectors[begin:end]
                    continue
                if x and not by_length:
                    every, every_rid, lengths = np.concatenate(ids), np.concatenate(rids), np.array([len(v) for v in x])
                    for length in np.unique(lengths).tolist():
                        rows = np.flatnonzero(lengths == length)
                        rows = rows[np.lexsort((every_rid[rows], every[rows]))]
                        own = np.stack([x[r] for r in rows]).astype(np.float64)
                        by_length[length] = every[rows], every_rid[rows], own, np.sqrt((own * own).sum(1))
                for q, query, query_rid in zip(vectors[begin:end], own_ids[begin:end].tolist(), own_rids[begin:end].tolist(), strict=True):
                    if len(q) not in by_length:
                        continue
                    some, some_rid, own, norms = by_length[len(q)]
                    rough = own @ q / norms
                    rough[(some == query) & (some_rid == query_rid)] = -np.inf
                    # The product only preselects, with room for its rounding.
                    kth = np.partition(rough, -k)[-k] if len(rough) > k else -np.inf
                    near = np.flatnonzero((rough >= kth - 1e-9 * np.sqrt(q @ q)) & (rough > -np.inf))
                    scores = (own[near] * q).sum(1) / (norms[near] * np.sqrt((q * q).sum()))
                    best = np.argsort(-scores, kind="stable")[:k]
                    out += [(query, query_rid, i, r, s) for i, r, s in zip(some[near[best]].tolist(), some_rid[near[best]].tolist(), scores[best].tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["query_id", "query_rid", "vec_id", "rid", "score"])

    return rank


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, rid, v): vectors that take part: without null or non-finite components, and not zero, with
    an id; a row for each different vector of an id, told apart by rid."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    rows = rows.where(~bad & F.exists(v, lambda x: x != 0))
    return rows.groupBy("id", "v").agg(F.xxhash64("v").alias("rid")).select("id", "rid", "v")


def _key(seed: int) -> Column:
    """A hash of a row's id and vector in [0, 10^6), by which samples are drawn."""
    return F.pmod(F.xxhash64("id", "rid", F.lit(seed)), F.lit(1_000_000))


def fitted(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """The lists' centroids of each vector length that the sample holds."""
    share = min(1.0, SAMPLE / max(n, 1))
    sample = [np.asarray(r[0]) for r in rows.where(_key(2) < int(1_000_000 * share)).orderBy("id", "rid").select("v").collect()]
    size = max(LIST_SIZE, int(np.sqrt(n)))
    cells, held = {}, [np.ones(1)]
    for some, x in _by_length(sample, len(sample)) if sample else ():
        lists = max(1, int(len(some) / share / size))
        cells[x.shape[1]] = centroids = balanced_centroids(x, min(MOST_CELLS, len(some), int(np.ceil(np.sqrt(lists)))))
        held.append(np.bincount(distances(x, centroids).argmin(1), minlength=len(centroids)))
    if not cells:
        return {}
    # How many vectors each cell has, as the sample tells, and the share of them that its lists are fitted to.
    index, sizes = Index(cells), np.maximum(np.concatenate(held), 1) / share
    shares = np.minimum(1.0, CELL_SAMPLE / sizes)

    def own_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in index.post(batches):
            first = np.array([x[0].as_py() for x in batch.column("lists")], np.int32)
            drawn = batch.column("key").to_numpy() < 1_000_000 * shares[first]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(first)], ["id", "rid", "v", "cell"]).filter(pa.array(drawn & (first > 0)))

    def fit(some: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(some.sort_values(["id", "rid"])["v"].tolist()))
        k = max(1, min(MOST_LISTS, len(x), round(sizes[some["cell"].iloc[0]] / size)))
        return pd.DataFrame({"cell": some["cell"].iloc[0], "centroid": list(balanced_centroids(x, k))})

    # Cell 0 holds the lengths that have no cells.
    drawn = rows.withColumn("key", _key(4)).where(F.col("key") < 1_000_000 * float(shares[1:].max())).mapInArrow(own_cell, "id long, rid long, v array<double>, cell int")
    found = drawn.groupBy("cell").applyInPandas(fit, "cell int, centroid array<double>").orderBy("cell").collect()
    out: dict[int, list[np.ndarray]] = {}
    for r in found:
        out.setdefault(len(r["centroid"]), []).append(np.asarray(r["centroid"]))
    return {d: np.unique(np.stack(c), axis=0) for d, c in sorted(out.items())}


def nearest(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that `queries` (over vec_id) marks, its k nearest
    by cosine among all other rows of its length, nearest first, equal ones by id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
    an id. Rows alike in id and vector are one; different vectors of one id are rows of their own, as
    candidates and as queries. With fewer than k other vectors all are returned; an empty table gives
    no rows. Other columns are ignored.
    """
    rows = saved(usable(df, id_col, vector_col))
    centroids = fitted(rows, rows.count())
    posted = saved(rows.mapInArrow(Index(centroids).post, "id long, rid long, v array<double>, lists array<int>"))
    lengths = posted.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    held = lengths.toPandas()
    sizes = np.zeros(Index(centroids).size, np.int64)
    sizes[held["list"].astype(int)] = held["n"]
    marked = rows.withColumn(id_col, F.col("id")).where(queries).select("id", "rid", "v")
    asked = saved(marked.mapInArrow(Index(centroids, sizes).ask(k), "id long, rid long, v array<double>, lists array<int>"))
    # One row per list, of which there are at most 1 + MOST_CELLS * MOST_LISTS for each vector length.
    asks = asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("queries"))
    cuts = F.broadcast(lengths.join(asks, "list").select("list", F.ceil(F.col("n") / PART).alias("parts"), F.ceil(F.col("queries") / QUERY_PART).alias("query_parts")))
    entries = posted.select(F.explode("lists").alias("list"), "id", "rid", "v").join(cuts, "list")
    entries = entries.select("list", F.pmod(F.xxhash64("id", "rid"), "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("query_part"), F.lit(0).alias("asks"), "id", "rid", "v")
    wanted = asked.select(F.explode("lists").alias("list"), "id", "rid", "v").join(cuts, "list")
    wanted = wanted.select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("id", "rid"), "query_parts").alias("query_part"), F.lit(1).alias("asks"), "id", "rid", "v")
    dealt = entries.union(wanted).repartition("list", "part", "query_part").sortWithinPartitions("list", "part", "query_part", "asks")
    found = dealt.mapInArrow(_ranker(k), _FOUND)
    best = Window.partitionBy("query_id", "query_rid").orderBy(F.desc("score"), "vec_id", "rid")
    ranked = found.dropDuplicates(["query_id", "query_rid", "vec_id", "rid"]).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
