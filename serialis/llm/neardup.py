"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

Each distinct shingle set posts its id under every (coordinate, value) of its signature. Values
that only one set has are skipped, and of the rest a set keeps only its rarest: two sets that agree
in at least MATCHES of COORDINATES values must share one of the COORDINATES - MATCHES + 1 rarest of
either. Pairs from these lists are kept if they agree in MATCHES values, and then confirmed by
the exact similarity of the full shingle sets.

A list of near copies would have a square number of pairs. So each list is first compared with
one hub, its set with the fewest shingles of its own, which joins nearly all of a group to one
component. Only pairs of different components remain, less those whose sets have too many
shingles that no other candidate has: for |A| and |B| with a and b shared ones the similarity is at
most min(a, b) / (|A| + |B| - min(a, b)). Long lists compare those outside their largest component with
all in blocks, and only links leave a task. Nothing is capped or sampled.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialis.llm.common import documents, list_array, saved, slices, utf8

COORDINATES = 64
#: A pair of similarity 0.8 agrees in 51.2 values on average, and in fewer than 34 with a probability
#: of 3.2e-7 (binomial), the chance that its link is lost; at 0.85 it is 2.9e-10.
MATCHES = 34
PERCENT = 80
#: Lists of up to so many sets make pairs; longer ones are compared block by block. A block has about so many sets, and
#: shingles, at most, so that a task's memory is bounded for long texts, too, but for a single text's own.
SHORT_LIST, BLOCK, BLOCK_SHINGLES = 32, 512, 500_000
_MEMO = 150_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: bytes, words: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle."""
    tokens = text.lower().split()
    n = len(tokens)
    hashes = np.fromiter(map(memo.__getitem__, tokens), np.uint64, n)
    if not n:
        return hashes
    width, step = min(n, words), np.uint64(0x9E3779B97F4A7C15)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = total * step + hashes[i : n - width + 1 + i]
    return np.unique(_mixed(total))


def _signer(words: int):
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
    place = np.arange(COORDINATES, dtype=np.int64) << 32

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in slices(batches):
            sets = [shingles(t, words, memo) for t in utf8(batch.column(1))]
            keys = [place | (np.min(s[:, None] * factors, axis=0) >> np.uint64(32)).astype(np.int64) if len(s) else place[:0] for s in sets]
            sums = np.array([np.add.reduce(s) for s in sets], np.uint64).view(np.int64)
            mixes = np.array([np.bitwise_xor.reduce(_mixed(s)) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums), pa.array(mixes), list_array(keys, pa.int64()), batch.column(2).cast(pa.string())],
                ["doc_id", "n", "h1", "h2", "keys", "digest"],
            )

    return sign


def _shingler(words: int):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in slices(batches):
            sets = [shingles(t, words, memo).view(np.int64) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), list_array(sets, pa.int64())], ["node", "shingles"])

    return whole


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b): label is the smallest node that
    can be reached. Labels spread to neighbours and then jump along themselves, each round written
    as a table, so that long chains take few rounds."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        moved = saved(spread.join(jump, F.col("to") == F.col("at")).select("node", "old", F.least("to", "next").alias("label")))
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def _possible(n: str, f: str, n2: str, f2: str) -> Column:
    """Whether two sets of n and n2 shingles, f and f2 of them shared with any set, can be similar."""
    most = F.least(F.col(f), F.col(f2))
    return 100 * most >= PERCENT * (F.col(n) + F.col(n2) - most)


def _confirmed(pairs: DataFrame, keys: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in MATCHES coordinates and whose full sets are similar."""
    left, right = keys.select(F.col("node").alias("a"), F.col("keys").alias("ka")), keys.select(F.col("node").alias("b"), F.col("keys").alias("kb"))
    near = pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("ka", "kb")) >= MATCHES).select("a", "b")
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return near.join(right, "b").join(left, "a").where(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _linked(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between sets of two blocks, `left` and not, with different labels, as a spanning forest of
    the labels: all similarities come from products of the sets' incidence matrices, a slice of shingles
    at a time."""
    rows = rows.sort_values("left", ascending=False, kind="stable")
    sets, nodes, labels, n = rows["shingles"].tolist(), rows["node"].to_numpy(), rows["label"].to_numpy(), int(rows["left"].sum())
    lengths = np.array([len(x) for x in sets])
    values, where = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(where, kind="stable")
    owner, where = np.repeat(np.arange(len(sets)), lengths)[order], where[order]
    both = np.zeros((n, len(sets) - n), np.float32)
    for low in range(0, len(values), 4096):
        begin, end = np.searchsorted(where, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[begin:end], where[begin:end] - low] = 1
        both += part[:n] @ part[n:].T
    alike = 100 * both >= PERCENT * (lengths[:n, None] + lengths[n:] - both)
    merged = {x: x for x in labels}
    found = []
    for i, j in zip(*np.nonzero(alike & (labels[:n, None] != labels[n:])), strict=True):
        j += n
        while merged[x := merged[labels[i]]] != x:
            merged[labels[i]] = merged[x]
        while merged[y := merged[labels[j]]] != y:
            merged[labels[j]] = merged[y]
        if x != y:
            merged[max(x, y)] = min(x, y)
            found.append((nodes[i], nodes[j]))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _by_blocks(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) within long lists (key, node, n, label, m, w), m being a list's sets and w their shingles. Those
    that a list's largest component already holds need no comparison with each other: each other member is
    compared with all. Both sides are dealt to blocks of about BLOCK sets or BLOCK_SHINGLES shingles, and a task compares a pair of blocks of one list, on the full
    sets. Only links leave a task."""
    sizes = entries.groupBy("key", "label").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("its"))
    largest = saved(sizes.groupBy("key").agg(F.max(F.struct("of", "label", "its")).alias("top")).select("key", F.col("top.label").alias("top"), "top.of", "top.its"))
    told = entries.join(largest, "key")
    count = lambda m, w: F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(w / BLOCK_SHINGLES))
    blocks, left_blocks = count(F.col("m"), F.col("w")), count(F.col("m") - F.col("of"), F.col("w") - F.col("its"))
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = told.select("key", block(blocks).alias("right_block"), every(left_blocks).alias("left_block"), "node", "label", F.lit(False).alias("left"))
    rows = rows.unionByName(told.where("label <> top").select("key", every(blocks).alias("right_block"), block(left_blocks).alias("left_block"), "node", "label", F.lit(True).alias("left")))
    dealt = rows.join(sets.dropDuplicates(["node"]), "node")
    return dealt.groupBy("key", "left_block", "right_block").applyInPandas(_linked, "a long, b long")


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def _grouped(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: (doc_id, n, digest, node, group, component_id): the digest of its text,
    the number of its set, the smallest set number that can be reached, and the smallest id there."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _digest(text_col).alias("digest"))
    signed = saved(texts.mapInArrow(_signer(words), "doc_id long, n long, h1 long, h2 long, keys array<long>, digest string"))
    # A set's number is written once; its keys and shingles are those of one row.
    first = F.min_by(F.struct("digest", "keys"), F.struct("doc_id", "digest")).alias("first")
    classes = signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), first)
    classes = saved(classes.select("h1", "h2", "least", "first.*", F.monotonically_increasing_id().alias("node")))
    member = saved(signed.where("doc_id is not null").select("doc_id", "n", "h1", "h2", "digest").join(classes.select("h1", "h2", "node", "least"), ["h1", "h2"], "left")
        .unionByName(signed.where("doc_id is null").select("doc_id", "n", "h1", "h2", "digest"), allowMissingColumns=True))
    keys = classes.select("node", "keys")

    posts = keys.select("node", F.explode("keys").alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = Window.partitionBy("node")
    rank, common = F.row_number().over(mine.orderBy("df", "key")), F.count(F.lit(1)).over(mine)
    prefix = posts.join(shared, "key").select("node", "key", rank.alias("rank"), common.alias("common"))
    lists = saved(prefix.where(F.col("rank") <= F.col("common") - MATCHES + 1).select("key", "node"))
    # Counts by key are written before they are joined, so that the join can split a long list.
    lists = lists.join(saved(lists.groupBy("key").count().where("count > 1").select("key")), "key", "left_semi")

    candidates = lists.select("node").distinct()
    named = classes.join(candidates, "node", "left_semi").select("node", F.col("least").alias("doc_id"), "digest")
    texts_of = texts.join(named, ["doc_id", "digest"]).groupBy("doc_id", "digest", "node").agg(F.first("text").alias("text")).select("node", "text")
    sets = saved(texts_of.mapInArrow(_shingler(words), "node long, shingles array<long>"))
    own = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    size = sets.groupBy("node").agg(F.max(F.size("shingles")).alias("n"))
    facts = size.join(own, "node", "left").select("node", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("f")).where(100 * F.col("f") >= PERCENT * F.col("n"))
    entries = saved(lists.join(facts, "node"))

    hub = F.max(F.struct((F.col("f") / F.col("n")).alias("part"), (-F.col("node")).alias("minus"), "n", "f"))
    hubs = saved(entries.groupBy("key").agg(hub.alias("hub")).select("key", (-F.col("hub.minus")).alias("a"), F.col("hub.n").alias("na"), F.col("hub.f").alias("fa")))
    stars = entries.join(hubs, "key").where((F.col("node") != F.col("a")) & _possible("n", "f", "na", "fa")).select("a", F.col("node").alias("b")).distinct()
    edges = saved(_confirmed(stars, keys, sets))

    joined = saved(entries.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node")))
    several = F.min("label") != F.max("label")
    open_lists = saved(joined.groupBy("key").agg(several.alias("open"), F.min("n").alias("least")).where("open").select("key", "least"))
    linkable = F.col("f") * (100 + PERCENT) >= PERCENT * (F.col("n") + F.col("least"))
    rest = saved(joined.join(open_lists, "key").where(linkable).select("key", "node", "n", "f", "label"))
    lengths = saved(rest.groupBy("key").agg(several.alias("open"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("w")).where("open").select("key", "m", "w"))
    rest = saved(rest.join(lengths, "key"))
    few, many = rest.where(F.col("m") <= SHORT_LIST), rest.where(F.col("m") > SHORT_LIST)
    other = few.select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "f", "label")))
    pairs = few.join(other, "key").where((F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2")) & _possible("n", "f", "n2", "f2"))
    # A pair that the hubs have refused is not confirmed a second time.
    pairs = pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    edges = edges.union(_confirmed(pairs, keys, sets)).union(_by_blocks(many, sets))
    labels = components(edges)

    # The smallest id of each component, then of each set.
    ids = saved(labels.join(classes.select("node", "least"), "node"))
    ids = ids.join(ids.groupBy("label").agg(F.min("least").alias("component")), "label").select(F.col("node").alias("of"), "label", "component")
    out = member.join(ids, F.col("node") == F.col("of"), "left")
    return out.select("doc_id", "n", "digest", "node", F.coalesce("label", "node").alias("group"), F.coalesce("component", "least", "doc_id").alias("component_id"))


def near_duplicates(df: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id, kept).

    Rows are alike by their set of `words`-word shingles. Rows of equal sets are one node; nodes whose
    sets' similarity is at least PERCENT / 100 are linked. component_id is the smallest id that can be
    reached, kept whether it is the row's own. Null or empty texts have no shingles and no links. A
    row without id links nothing: its component is null, and it is kept. Rows that repeat an id each
    get the result of their own text. An empty table gives no rows. Other columns are ignored.
    """
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return _grouped(df, words, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def without_near_duplicates(df: DataFrame, words: int = 5) -> DataFrame:
    """The rows of df that near_duplicates keeps, one of each group of copies. Rows that repeat an id
    are told apart by their texts; of copies under the smallest id of a group, the text of the
    smallest digest stays, once. Columns as in df."""
    found = saved(_grouped(df, words, "doc_id", "text").where("node is not null"))
    own = found.where("doc_id = component_id").groupBy("group").agg(F.min("digest").alias("best"), F.count(F.lit(1)).alias("rows"))
    judged = found.join(own, "group").select("doc_id", "digest", ((F.col("doc_id") == F.col("component_id")) & (F.col("digest") == F.col("best"))).alias("stays"), "rows")
    marked = lambda d: d.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    gone, again = saved(marked(judged.where("not stays or rows > 1"))), saved(marked(judged.where("stays and rows > 1")))
    here = (F.col("doc_id") == F.col("__id")) & (_digest("text") == F.col("__digest"))
    once = df.join(again, here).groupBy("__id", "__digest").agg(F.first(F.struct(*[df[c] for c in df.columns])).alias("__row")).select("__row.*")
    return df.join(gone, here, "left_anti").union(once)


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
