"""A search table that is kept: postings written once in files by ranges of terms, and pages that read few of them.

Below one path lie four tables. `postings` (term, block, key, weight, tf) is cut into ranges of (term, block, key),
sorted, a folder a range, so that a common term is many files. `ranges` holds each folder's first and last
term: a search names the folders whose terms it needs, and the term range goes on to the files' own
statistics. `documents` (key, name, block) deals documents to blocks by the weight of all their terms, and
`bounds` (term, block, most, n) has the most that a term adds to any document of a block. Heavy documents share
blocks, so most blocks can't reach a page of the best, and their postings aren't read.
"""

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from serialis.operators import search

#: Bounds are sums in another order than ranks: they are compared with so much to spare.
_SPARE = 1e-9


def _counted(name: float, body: float, rows: int = 500):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with `__name` and `__body`, their terms between spaces, as documents with their mass and postings."""
        for batch in batches:
            kept = [n for n in batch.schema.names if n not in ("__name", "__body")]
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                mass, ends, terms, weights, tfs, adds = [], [0], [], [], [], []
                for named, other in zip(part.column("__name").to_pylist(), part.column("__body").to_pylist(), strict=True):
                    named, other = Counter(named.split()), Counter(other.split())
                    mass.append(name * named.total() + body * other.total() if named or other else None)
                    for counts, weight in ((named, name), (other, body)):
                        terms += counts.keys()
                        tfs += counts.values()
                        weights += [weight] * len(counts)
                    # What a document's term adds in all is told once, by the posting of its name if there is one.
                    adds += [name * n + body * other.get(t, 0) for t, n in named.items()]
                    adds += [None if t in named else body * n for t, n in other.items()]
                    ends.append(len(terms))
                found = [pa.array(terms, pa.string()), pa.array(weights, pa.float64()), pa.array(tfs, pa.int64()), pa.array(adds, pa.float64())]
                postings = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(found, ["term", "weight", "tf", "adds"]))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(mass, pa.float64()), postings], [*kept, "__mass", "__postings"])

    return count


def build(df: DataFrame, path: str, key: str, name: str, *body: str, keep: Sequence[str] = (), blocks: int = 64, files: int | None = None) -> None:
    """Write the search table of df at `path`. Null texts have no terms; a document without terms is in the
    lightest block. Pages show the key, the name and the columns to keep. `files` sets the number of ranges; else Spark cuts them by their size.

    A document's terms are counted where its text is read, once; they are shuffled as postings that have their
    block, to their range, and for the bounds as one row of a task for each term and block."""
    spark = df.sparkSession
    spaced = {"__name": search.spaced(F.col(name)), "__body": F.concat_ws(" ", *(search.spaced(F.col(b)) for b in body))}
    texts = df.select(key, name, *keep, *(c.alias(n) for n, c in spaced.items()))
    shown = texts.drop(*spaced).schema
    schema = StructType([*shown, *StructType.fromDDL("__mass double, __postings array<struct<term: string, weight: double, tf: bigint, adds: double>>")])
    texts.mapInArrow(_counted(search.NAME, search.BODY), schema).write.parquet(f"{path}/weighed")
    weighed = spark.read.schema(schema).parquet(f"{path}/weighed")
    cuts = weighed.agg(F.percentile_approx("__mass", [k / blocks for k in range(1, blocks)], 10_000).alias("cuts")).first()["cuts"]
    block = sum((F.when(F.col("__mass") > cut, 1).otherwise(0) for cut in sorted(set(cuts or []))), F.lit(0))
    dealt = weighed.withColumn("block", block.cast("int"))
    dealt.select(*shown.names, "block").write.parquet(f"{path}/documents")
    found = dealt.select(key, "block", F.inline("__postings"))
    order = ["term", "block", key]
    rows = found.select(*order, "weight", "tf")
    ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", *order).write.partitionBy("part").parquet(f"{path}/postings")
    # Terms are made distinct first: that hashes, while the least of texts sorts.
    written = _read_postings(spark, path).select("part", "term").distinct()
    written.groupBy("part").agg(F.min("term").alias("first"), F.max("term").alias("last")).coalesce(1).write.parquet(f"{path}/ranges")
    bounds = found.where("adds is not null").groupBy("term", "block").agg(F.max("adds").alias("most"), F.count(F.lit(1)).alias("n"))
    bounds.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(f"{path}/bounds")


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents")


def _read_postings(spark: SparkSession, path: str) -> DataFrame:
    key = documents(spark, path).schema[0]
    schema = StructType().add("term", "string").add("block", "integer").add(key).add("weight", "double").add("tf", "long").add("part", "integer")
    return spark.read.schema(schema).parquet(f"{path}/postings")


def _any(words: Sequence[str], condition) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | condition(w)
    return found


def postings(spark: SparkSession, path: str, *queries: str) -> DataFrame:
    """The postings under the queries' words, of the folders that can hold any."""
    words = list(dict.fromkeys(w for q in queries for w in search.words(q)))
    reaches = lambda w: (F.col("last") >= w) & ((F.col("first") < w) | F.startswith("first", F.lit(w)))
    parts = [r["part"] for r in spark.read.parquet(f"{path}/ranges").where(_any(words, reaches)).select("part").collect()]
    return _read_postings(spark, path).where(F.col("part").isin(parts)).where(_any(words, search.under))


def ranks(spark: SparkSession, path: str, query: str, key: str) -> DataFrame:
    """(key, rank) of all documents that match."""
    return search.from_postings(postings(spark, path, query), documents(spark, path), query, key).withColumn("rank", F.round("rank", 6))


def page(spark: SparkSession, path: str, query: str, key: str, name: str, offset: int = 0, limit: int = 25) -> DataFrame:
    """A ranked page (key, name, what is kept, rank) out of all ranks."""
    return search.ranked_page(ranks(spark, path, query, key), documents(spark, path), key, name, offset, limit).drop("block")


def _of_each(queries: Sequence[str], value) -> Column:
    """A row for each query that `value` gives a struct for, not null."""
    return F.explode(F.array_compact(F.array(*(value(q) for q in queries))))


def _scores(spark: SparkSession, path: str, found: DataFrame, blocks: dict[str, list[int] | None], key: str) -> DataFrame:
    """(query, key, rank) of the documents of each query's blocks (None: all) that match it: one pass over the
    postings for all queries, a sum for each distinct word."""
    terms = list(dict.fromkeys(w for q in blocks for w in search.words(q)))
    inside = {q: F.lit(True) if chosen is None else F.col("block").isin(chosen) for q, chosen in blocks.items()}
    wanted = _any(list(blocks), lambda q: inside[q] & _any(search.words(q), search.under))
    sums = [F.sum(F.when(search.under(w), F.col("weight") * F.col("tf")).otherwise(0.0)).alias(f"__{i}") for i, w in enumerate(terms)]
    hits = found.where(wanted).groupBy(key, "block").agg(*sums)
    if any(map(search.matches_without_words, blocks)):
        hits = documents(spark, path).select(key, "block").join(hits.drop("block"), key, "left").fillna(0.0, [f"__{i}" for i in range(len(terms))])
    weight = lambda w: F.col(f"__{terms.index(w)}")

    def scored(q: str) -> Column:
        rank = sum((weight(w) for w in search.words(q)), F.lit(0.0))
        return F.when(inside[q] & search.predicate(q, lambda w: weight(w) > 0), F.struct(F.lit(q).alias("query"), rank.alias("rank")))

    return hits.select(key, _of_each(list(blocks), scored).alias("__t")).select("__t.query", key, "__t.rank")


def _bounds(spark: SparkSession, path: str, queries: Sequence[str]) -> dict[str, list[tuple[float, int, int]]]:
    """Of each query the highest rank that a document of a block can have, the block, and how many postings
    tell; highest first. At most a row for each query and block."""
    near = spark.read.parquet(f"{path}/bounds").where(_any([w for q in queries for w in search.words(q)], search.under))

    def bound(q: str) -> Column:
        times = sum((F.when(search.under(w), 1).otherwise(0) for w in search.words(q)), F.lit(0))
        return F.when(times > 0, F.struct(F.lit(q).alias("query"), (F.col("most") * times).alias("bound"), F.col("n").alias("n")))

    rows = near.select("block", _of_each(queries, bound).alias("t")).groupBy("t.query", "block").agg(F.sum("t.bound").alias("bound"), F.sum("t.n").alias("n")).collect()
    return {q: sorted(((r["bound"], r["block"], r["n"]) for r in rows if r["query"] == q), reverse=True) for q in queries}


def reaching_blocks(spark: SparkSession, path: str, queries: Sequence[str], key: str, most: int) -> dict[str, tuple[list[int] | None, float]]:
    """Of each query (blocks, share): the blocks that hold its `most` best documents, ties with the last
    included, and the share of its postings that lie in them. None stands for all blocks: of a query that
    documents without any of its words match, or that fewer documents match.

    The eighth of the blocks with the highest bounds is ranked first, then four times as many, until enough
    documents match; no block whose bound is below the last one's rank can hold a better document. All
    queries take each step together, so the number of jobs doesn't grow with them."""
    told: dict[str, tuple[list[int] | None, float]] = dict.fromkeys(queries, (None, 1.0))
    bounded = [q for q in told if not search.matches_without_words(q)]
    if not bounded:
        return told
    bounds, found = _bounds(spark, path, bounded), postings(spark, path, *bounded)
    taken = {q: max(1, len(bounds[q]) // 8) for q in bounded}
    by_rank = Window.partitionBy("query").orderBy(F.desc("rank"))
    while taken := {q: n for q, n in taken.items() if n < len(bounds[q])}:
        scored = _scores(spark, path, found, {q: [b for _, b, _ in bounds[q][:n]] for q, n in taken.items()}, key)
        lasts = scored.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") == most).select("query", "rank").collect()
        for last in lasts:
            q = last["query"]
            least, n = last["rank"] * (1 - _SPARE) - 1e-6, taken.pop(q)
            kept = bounds[q][:n] + [x for x in bounds[q][n:] if x[0] >= least]
            told[q] = sorted(b for _, b, _ in kept), sum(x[2] for x in kept) / sum(x[2] for x in bounds[q])
        taken = {q: 4 * n for q, n in taken.items()}
    return told


def best_blocks(spark: SparkSession, path: str, query: str, key: str, most: int) -> tuple[list[int] | None, float]:
    """(blocks, share) of one query."""
    return reaching_blocks(spark, path, [query], key, most)[query]


def best(spark: SparkSession, path: str, query: str, key: str, name: str, offset: int = 0, limit: int = 25) -> DataFrame:
    """The same page, out of the blocks that can reach it."""
    blocks, _ = best_blocks(spark, path, query, key, offset + limit)
    found = postings(spark, path, query)
    if blocks is not None:
        found = found.where(F.col("block").isin(blocks))
    docs = documents(spark, path)
    scored = search.from_postings(found, docs, query, key).withColumn("rank", F.round("rank", 6))
    return search.ranked_page(scored, docs, key, name, offset, limit).drop("block")


def several(spark: SparkSession, path: str, queries: Sequence[str], key: str, name: str, limit: int = 25) -> DataFrame:
    """(query, place, key, name, rank): the best documents of each query, all found together in one pass over
    the blocks that can reach any of them. A query that is asked twice is answered once."""
    blocks = {q: chosen for q, (chosen, _) in reaching_blocks(spark, path, queries, key, limit).items()}
    scored = _scores(spark, path, postings(spark, path, *blocks), blocks, key).withColumn("rank", F.round("rank", 6))
    named = scored.join(documents(spark, path).select(key, name), key)
    order = Window.partitionBy("query").orderBy(F.desc("rank"), name, key)
    return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query", "place", key, name, "rank")
