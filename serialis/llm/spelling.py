"""Spelling variants of the words of a corpus, by a relational trie frontier.

Words are spelled as edges (parent, letter, child) of tries in a distributed table, one trie for each
length, once forwards and once backwards. One edit leaves a first or a last half of a word intact, so a
frontier opens only below the middle of a trie: at a node, where two words go on with different letters
(a replacement), or where the longer word has one letter more (a deletion). A state is (word's node, other
node, letters left): all words that share a beginning share its states, and its place is the depth of its
node. Each level joins the states with the edge table on both sides, by equal letters, and is written
as a table; states with no letters left are pairs of words that are one edit apart.

A node has at most as many children as there are letters, and a pair of nodes is one edit apart, so no
node gathers more than some ninety states a letter, however common its words are. Words of LONG letters and
more, of which there are few, would need a level for each letter; they meet on hashes of themselves with one
letter left out instead, which is as exact. Pairs of either kind are confirmed on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialis.llm.common import documents, list_array, saved, slices

#: Words of so many letters are compared by hashes, those of fewer or as many by tries.
LONG = 48
#: Distinct words that a task holds before it hands their counts on.
_HELD = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})


def _counter(least: int, every: int):
    runs = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or ""
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall(text.lower() if text.isascii() else text.translate(_LOWER))).items():
                    if every and not (h := zlib.crc32(word.encode(), seed)) % every:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
            if len(total) > _HELD:
                yield out()
                total.clear()
        yield out()

    return count


def corpus_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, least_count: int = 2, every: int = 0) -> DataFrame:
    """(word, n): the lower-cased (A-Z) runs of Latin letters of all texts, of at least so many code points, that
    occur so often. With `every`, a run of a document is misspelt on purpose where the crc32 of `<id>:<run>`
    is a multiple of it: it loses the code point at that crc32 modulo its length. Null texts have no runs,
    a null id counts as empty. Each task adds up what it reads before counts are shuffled."""
    counted = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_counter(least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _edges(words: DataFrame) -> DataFrame:
    """(parent, letter, child, twin, backwards, depth, length): the tries' edges from the middle on; the twin is the
    parent's like in the trie of words that are one letter shorter."""
    both = words.select(F.explode(F.array(F.struct(F.col("word").alias("s"), F.lit(0).alias("backwards")), F.struct(F.reverse("word").alias("s"), F.lit(1).alias("backwards")))).alias("w")).select("w.*")
    sized = both.withColumn("length", F.length("s"))
    middle = F.when(F.col("backwards") == 0, F.floor((F.col("length") - 1) / 2)).otherwise(F.col("length") - F.floor(F.col("length") / 2)).cast("int")
    each = sized.withColumn("depth", F.explode(F.sequence(middle, F.col("length") - 1)))
    rows = each.select(
        _node(F.substring("s", F.lit(1), F.col("depth"))).alias("parent"), F.substring("s", F.col("depth") + 1, F.lit(1)).alias("letter"),
        _node(F.substring("s", F.lit(1), F.col("depth") + 1)).alias("child"), _node(F.substring("s", F.lit(1), F.col("depth")), 1).alias("twin"), "backwards", "depth", "length",
    )
    return rows.dropDuplicates(["parent", "letter"])


def _node(prefix: Column, less: int = 0) -> Column:
    return F.xxhash64("backwards", F.col("length") - less, prefix)


def _by_tries(words: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of words that have at most LONG letters."""
    edges = saved(_edges(words))
    half = F.floor(F.col("length") / 2)
    opened = edges.where(F.col("depth") >= F.when(F.col("backwards") == 0, half).otherwise(F.col("length") - half))
    other = edges.select("parent", F.col("letter").alias("letter2"), F.col("child").alias("node2"))
    replaced = opened.join(other, "parent").where("letter < letter2").select(F.col("child").alias("node"), "node2", (F.col("length") - F.col("depth") - 1).alias("left"))
    longer = edges.select(F.col("child").alias("node"), F.col("twin").alias("node2"), (F.col("length") - F.col("depth") - 1).alias("left"))
    mine = edges.select(F.col("parent").alias("node"), "letter", F.col("child").alias("to"))
    theirs = edges.select(F.col("parent").alias("node2"), "letter", F.col("child").alias("to2"))
    levels = [saved(replaced.unionByName(longer))]
    while not (open_states := levels[-1].where("left > 0")).isEmpty():
        moved = open_states.join(mine, "node").join(theirs, ["node2", "letter"])
        levels.append(saved(moved.select(F.col("to").alias("node"), F.col("to2").alias("node2"), (F.col("left") - 1).alias("left"))))
    ends = reduce(DataFrame.unionByName, [x.where("left = 0").select("node", "node2") for x in levels])
    spelt = words.select("word", F.length("word").alias("length"))
    whole = spelt.withColumn("backwards", F.lit(0)).select("word", _node(F.col("word")).alias("node")).union(spelt.withColumn("backwards", F.lit(1)).select("word", _node(F.reverse("word"))))
    whole = saved(whole)
    return ends.join(whole.withColumnRenamed("word", "a"), "node").join(whole.select(F.col("word").alias("b"), F.col("node").alias("node2")), "node2").select("a", "b")


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, whole, less): the hash of a word, and those of it without each letter."""
    for batch in slices(batches, 20):
        wholes, lesses = [], []
        for word in batch.column("word").to_pylist():
            letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            n = len(letters)
            powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _STEP))])
            # The hash of letters i to j is (sums[j] - sums[i]) of letter times power of its place.
            sums = np.concatenate([[np.uint64(0)], np.add.accumulate(letters * powers[:n])])
            # Without letter i those behind it are a place further on.
            lesses.append((sums[:-1] * _STEP + (sums[-1] - sums[1:])).view(np.int64))
            wholes.append(int((sums[-1] * _STEP).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(wholes, pa.int64()), list_array(lesses, pa.int64())], ["id", "whole", "less"])


def _by_hashes(words: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of long words: equal but for the letter at the same place, or where one is the other without a letter."""
    named = saved(words.select("word", F.monotonically_increasing_id().alias("id")))
    hashed = saved(named.mapInArrow(_left_out, "id long, whole long, less array<long>"))
    less = saved(hashed.select("id", F.posexplode("less").alias("at", "key")))
    replaced = less.join(less.select(F.col("id").alias("id2"), "at", "key"), ["at", "key"]).where("id < id2")
    longer = less.join(hashed.select(F.col("id").alias("id2"), F.col("whole").alias("key")), "key")
    pairs = replaced.select("id", "id2").union(longer.select("id", "id2")).distinct()
    return pairs.join(named.withColumnRenamed("word", "a"), "id").join(named.select(F.col("word").alias("b"), F.col("id").alias("id2")), "id2").select("a", "b")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of distinct words, both ways, that differ by exactly one inserted, deleted or replaced
    code point. Null and empty words take no part; repeated ones count once; an empty table gives no rows."""
    distinct = saved(words.where("word is not null and word <> ''").select("word").distinct())
    pairs = _by_tries(distinct.where(F.length("word") <= LONG)).union(_by_hashes(distinct.where(F.length("word") >= LONG)))
    confirmed = saved(pairs.where(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return confirmed.select(F.col("a").alias("word"), F.col("b").alias("near")).union(confirmed.select("b", "a"))


def variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words.

    A word's form is its near word of largest n, the smallest of several, if it is at least `factor` times as
    frequent, else null; its root is the last of its chain of forms, or the word itself. Each step of a chain
    multiplies n, so chains are short; they are followed by doubling. An empty table gives no rows.
    """
    counts = saved(words.select("word", "n"))
    near = near_words(counts).join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    told = counts.join(best, "word", "left")
    is_form = F.col("best.near_n") >= factor * F.col("n")
    told = saved(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("best.near_n")).alias("form_n")))
    roots = saved(told.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = saved(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(corpus_words(documents(spark, sf_dir), every=31))


OP11_SQL = r"""
with tab as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)),
      lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i))),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
r as (select coalesce(doc_id::varchar, '') || ':' || w as k, any_value(w) as w, count(*) as n from runs where length(w) >= 7 group by doc_id, w),
h as (select w, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(k, ''),
      lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [192 + (unicode(c) >> 6)::bigint, 128 + (unicode(c) & 63)::bigint] end))),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) as h from r, tab),
m as (select case when h % 31 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from h),
d as (select word, sum(n)::bigint as n from m where length(word) >= 7 group by word having sum(n) >= 2),
l as (select word, unnest(range(length(word))) as i from d),
o as (select word, i, substr(word, 1, i::int) || substr(word, i::int + 2) as less from l),
p as (select distinct a.word as word, b.word as near from o a join o b on a.i = b.i and a.less = b.less and length(a.word) = length(b.word) and a.word <> b.word
      union select o.word, d.word from o join d on d.word = o.less union select d.word, o.word from o join d on d.word = o.less),
b as (select p.word, count(*) as n_near, arg_min({'w': d.word, 'n': d.n}, (-d.n, encode(d.word))) as f from p join d on d.word = p.near group by p.word),
f as (select d.word, d.n, coalesce(n_near, 0)::bigint as n_near, case when f.n >= 10 * d.n then f.w end as form, case when f.n >= 10 * d.n then f.n end as form_n from d left join b using (word)),
chain as (with recursive c as (select word, form as root, 1 as step from f where form is not null
      union all select c.word, f.form, step + 1 from c join f on f.word = c.root where f.form is not null)
      select word, arg_max(root, step) as root from c group by word)
select f.word, f.form, coalesce(c.root, f.word) as root, f.n, f.n_near, f.form_n from f left join chain c on c.word = f.word
"""
