"""Mixing sources to target weights, in DataFrame operations only.

Every row gets a hash-random key; rows are cut into key ranges within their source, so that a
source with a third of all rows is many ranges; word counts are summed by range, ranges are
prefix-summed, and each row's own prefix is found within its range. A source is then cut at its
exact budget: whole epochs first, then rows in key order, the row across the cut in part.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialis.llm.common import documents, saved, word_count

#: Weights go to the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: A source's target stops at this many times its size.
MAX_EPOCHS = 2
#: Of the keys.
SEED = 17
#: Share of all words that the mix takes, as a fraction.
SHARE = (3, 2)


def hash_key(seed: int, id_col: str, text_col: str) -> Column:
    """A key in [0, 2^60) that looks random, and is the same on every run: of the id and the text, so that rows that
    repeat an id spread over the ranges."""
    told = [F.coalesce(c, F.lit("")) for c in (F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")))]
    text = F.concat_ws("|", F.lit(str(seed)), *told)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = MAX_EPOCHS) -> DataFrame:
    """Each source's target. `sizes` has one row per source (source, source_size, n_rows), so the
    window over all of them holds source names only, never documents.

    Sources are filled in proportion to their weights; those that fill up first are those of the
    smallest cap by weight, so the filled ones are a prefix in that order. Empty sources get 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long")
    every = Window.partitionBy(F.lit(1))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    budget = share[0] * F.sum("source_size").over(every) / share[1]
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0))
    level = (budget - cap * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / left
    filled = sizes.withColumn("weight", weight).withColumn("level", level)
    # The first source that its cap does not stop has the level of all after it.
    stop = F.min(F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.col("source_size") / F.col("weight"))).over(every)
    final = F.min(F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    target = F.when(stop.isNull(), F.col("source_size") * F.lit(float(cap))).otherwise(
        F.least(F.col("source_size") * F.lit(float(cap)), final * F.col("weight"))
    )
    return filled.select("source", "source_size", "n_rows", target.alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One row per input row: (doc_id, source, size, source_size, target, taken, key), where `taken` is
    how many of the row's words the mix takes, repeats counted. A source's taken words are its
    target rounded down to whole words; a row is taken at most MAX_EPOCHS times.

    Null or empty texts have size 0 and take 0. A null source is a source of its own, the last. Null
    and repeated ids are allowed: rows alike in id, source and text are interchangeable; `key` is the hash of id and text. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = saved(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), hash_key(seed, id_col, text_col).alias("key"))
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    plan = saved(targets(sizes)).withColumn("ranges", F.ceil(F.sqrt("n_rows"))).withColumnRenamed("source", "plan_source")
    # The keys are uniform, so equal key ranges hold about equal numbers of rows: as many as there are ranges.
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("range", F.floor(F.col("key") / F.lit(2.0**60) * F.col("ranges")))
    sums = placed.groupBy("plan_source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("plan_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("plan_source").alias("start_source"), F.col("range").alias("start_range"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("plan_source", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    found = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        starts, F.col("plan_source").eqNullSafe(F.col("start_source")) & (F.col("range") == F.col("start_range"))
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("ahead")))
    return found.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "key")


def mixed_documents(df: DataFrame) -> DataFrame:
    """The mix as documents: a row for every epoch of a document, the last one cut after its taken
    words; rows that the mix takes nothing of are left out. Of rows alike in id, source and text each
    is taken as one row of the mix. Null or empty texts are never taken; null ids and sources are
    values like others. An empty table gives no rows. Columns as in df."""
    plain = [c for c, kind in df.dtypes if "map<" not in kind]
    keyed = df.withColumn("__key", F.struct(F.col("doc_id"), F.col("source"), word_count("text").alias("size"), hash_key(SEED, "doc_id", "text").alias("key")))
    cuts = saved(mix(df).select(F.struct("doc_id", "source", "size", "key").alias("__key"), F.col("taken").alias("__taken")))
    # Texts are joined by the key alone; only rows that share one, if there are any, are numbered on both sides.
    keys = saved(cuts.groupBy("__key").agg(F.count(F.lit(1)).alias("n"), F.max("__taken").alias("__taken")))
    single, several = keys.where("n = 1 and __taken > 0").drop("n"), keys.where("n > 1").select("__key")
    joined = keyed.join(single, "__key")
    if not several.isEmpty():
        numbered = lambda rows, *order: rows.join(several, "__key", "left_semi").withColumn("__row", F.row_number().over(Window.partitionBy("__key").orderBy(*order)))
        joined = joined.unionByName(numbered(keyed, F.xxhash64(*plain)).join(numbered(cuts, F.desc("__taken")).where("__taken > 0"), ["__key", "__row"]).drop("__row"))
    joined = joined.withColumn("__size", F.col("__key.size"))
    epochs = F.sequence(F.lit(0), F.ceil(F.col("__taken") / F.col("__size")).cast("int") - 1)
    each = joined.withColumn("__epoch", F.explode(epochs))
    words = F.least(F.col("__size"), F.col("__taken") - F.col("__epoch") * F.col("__size")).cast("int")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(words == F.col("__size"), F.col("text")).otherwise(F.array_join(F.slice(pieces, 1, words), ""))
    out = {"text": text, "n_chars": F.length(text).cast(df.schema["n_chars"].dataType)} if "n_chars" in df.columns else {"text": text}
    return each.select(*(out[c].alias(c) if c in out else F.col(c) for c in df.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("source", "key")


OP4_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
      ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '') || '|' || coalesce(md5(text), '')), 1, 15))::bigint as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s),
f as (select *, (3 * sum(source_size) over () / 2 - 2 * coalesce(sum(source_size) over o, 0)) / (sum(weight) over () - coalesce(sum(weight) over o, 0)) as level
      from w window o as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select arg_min(level, source_size / weight) as level from f where level * weight <= 2 * source_size),
t as (select source, source_size, least(source_size * 2.0::double, coalesce((select level from l), 1e300) * weight)::double as target from f),
p as (select d.doc_id, size, source_size, target, floor(target)::bigint as budget,
      coalesce(sum(size) over (partition by d.source order by k, d.doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (case when source_size > 0 then budget // source_size else 0 end * size
   + greatest(0, least(size, budget - case when source_size > 0 then budget // source_size else 0 end * source_size - ahead)))::bigint as taken from p
"""
