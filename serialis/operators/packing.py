"""Packing pages into volumes of limited size, in order."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialis.functions.text import content_key, display_title
from serialis.operators.running import ranged, running
from serialis.sources.io import kept_table, replaced

LIMIT = 12 * 1024 * 1024
#: Pages of a document up to which one task folds it, and least questions to a range that a task answers.
LONG, _DEALT = 100_000, 10_000


def _filler(limit: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages in order with place (from 1 in each group), size and the group's total: their volumes."""
        filled, volume = 0, 1
        for batch in batches:
            out = []
            for place, size, total in zip(*(batch.column(c).to_pylist() for c in ("__place", "__size", "__total")), strict=True):
                if place == 1:
                    filled, volume = 0, 1
                if total > limit and filled > 1 + total // (1 + total // limit):
                    filled, volume = 0, volume + 1
                filled += size or 0
                out.append(volume)
            kept = [n for n in batch.schema.names if not n.startswith("__")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.int32())], [*kept, "volume"])

    return fill


def _folded(df: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """The volumes of documents that each stream through one task, in order."""
    group_rows = Window.partitionBy(group)
    sizes = F.coalesce(F.col(size), F.lit(0)).cast("long")
    pages = df.select(group, order, size, sizes.alias("__size"), F.row_number().over(group_rows.orderBy(order, size)).alias("__place")).withColumn("__total", F.sum("__size").over(group_rows))
    pages = pages.sortWithinPartitions(group, "__place")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if not f.name.startswith("__"))
    return pages.mapInArrow(_filler(limit), f"{kinds}, volume int")


def _doubled(df: DataFrame, group: str, order: str, size: str, limit: int, ranges: int | None) -> DataFrame:
    """The volumes of documents of any length; none of them meets in one task.

    Sizes are prefix-summed over ranges of pages. A volume that begins at a page is closed by the first page whose sum
    passes that before its beginning by more than 1 + total // n; the page after it is the next cut. Each
    page looks that up in the one range where the sum is passed, and pages that ask the same range are
    dealt to as many tasks as there are of them. From the first pages on, real cuts are marked by
    pointer doubling, and counted by a running sum.
    """
    # A null document is one of its own, under a name that joins.
    pages = df.select(F.to_json(F.struct(F.col(group).alias("g"))).alias("g"), F.col(group).alias("of"), F.col(order).alias("o"), F.col(size).alias("s"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    # Ranges and sums follow (order, size, a number), which is total.
    pages = ranged(pages.withColumn("id", F.monotonically_increasing_id()), "g", ["o", "s", "id"], ranges)
    summed = kept_table(running(pages, "g", ["o", "s", "id"], sum=F.col("size"), place=F.lit(1)))
    spans = summed.groupBy("g", "__range").agg(F.max("sum").alias("high"), F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    totals = spans.groupBy("g").agg(F.max("high").alias("total"))
    closed = (1 + F.floor(F.col("total") / (1 + F.floor(F.col("total") / limit)))).cast("long")
    totals = kept_table(totals.select("g", closed.alias("closed"), (F.col("total") > limit).alias("cut")))
    spans = kept_table(spans.join(totals.where("cut"), "g").select("g", "__range", "high", "first", "n", "closed"))

    # Each page of a document to be cut asks for the first sum above `asks`.
    asking = summed.join(totals.where("cut"), "g").select("g", "__range", "place", (F.col("sum") - F.col("size") + F.col("closed")).alias("asks"))
    own = asking.groupBy("g", "__range").agg(F.min("asks").alias("least"), F.max("asks").alias("most"))
    later = spans.select(F.col("g").alias("g2"), F.col("__range").alias("to"), "high", F.coalesce(F.lag("high").over(Window.partitionBy("g").orderBy("__range")), F.lit(-1)).alias("under"))
    # The ranges that a range's pages can ask: sums above `under`, up to `high`. Neighbouring ranges share at most one.
    reach = own.join(later, (F.col("g") == F.col("g2")) & (F.col("high") > F.col("least")) & (F.col("under") <= F.col("most"))).groupBy("g", "__range").agg(F.sort_array(F.collect_list(F.struct("high", "to"))).alias("reach"))
    routed = kept_table(asking.join(reach, ["g", "__range"]).select("g", "place", "asks", F.get(F.filter("reach", lambda r: r["high"] > F.col("asks")), F.lit(0))["to"].alias("to")).where("to is not null"))
    copies = routed.groupBy("g", "to").agg(F.count(F.lit(1)).alias("asked")).join(spans.select("g", F.col("__range").alias("to"), "n"), ["g", "to"]).select("g", "to", F.ceil(F.col("asked") / F.greatest(F.col("n"), F.lit(_DEALT))).cast("int").alias("copies"))
    copies = kept_table(copies)
    asked = routed.join(copies, ["g", "to"]).select("g", "to", F.pmod(F.xxhash64("place"), "copies").cast("int").alias("copy"), F.col("asks").alias("sum"), F.lit(1).alias("asks"), "place")
    told = summed.join(copies.withColumnRenamed("to", "__range"), ["g", "__range"]).select("g", F.col("__range").alias("to"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "sum", F.lit(0).alias("asks"), "place")
    # From the end on, so that a window keeps its last page: one that reaches from each row to the end is read again for every row.
    onward = Window.partitionBy("g", "to", "copy").orderBy(F.desc("sum"), F.desc("asks"), F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    closing = F.last(F.when(F.col("asks") == 0, F.col("place")), ignorenulls=True).over(onward)
    jumps = kept_table(asked.unionByName(told).withColumn("next", closing + 1).where("asks = 1").select("g", "place", "next"))

    cuts = kept_table(totals.where("cut").select("g", F.lit(1).cast("long").alias("place")))
    while True:
        reached = cuts.join(jumps, ["g", "place"]).select("g", F.col("next").alias("place"))
        more = kept_table(reached.join(cuts, ["g", "place"], "left_anti").distinct())
        if more.isEmpty():
            break
        cuts = replaced(cuts.unionByName(more), cuts, more)
        further = jumps.select("g", F.col("place").alias("next"), F.col("next").alias("further"))
        jumps = replaced(jumps.join(further, ["g", "next"]).select("g", "place", F.col("further").alias("next")), jumps)

    marked = summed.join(cuts.select("g", "place", F.lit(1).alias("is_cut")), ["g", "place"], "left").withColumn("is_cut", F.coalesce("is_cut", F.lit(0)))
    numbered_pages = running(marked, "g", ["place"], volume=F.col("is_cut"))
    return numbered_pages.select(F.col("of").alias(group), F.col("o").alias(order), F.col("s").alias(size), F.greatest(F.col("volume"), F.lit(1)).cast("int").alias("volume"))


def volumes(df: DataFrame, group: str, order: str, size: str, limit: int = LIMIT, long: int = LONG, ranges: int | None = None) -> DataFrame:
    """(group, order, size, volume): greedy volumes from 1. With n = 1 + total // limit, a volume is
    closed once it has passed 1 + total // n; a total within the limit is one volume. A null size
    counts as 0. Documents of up to `long` pages stream past in order, a task keeping one sum; those of more
    are cut by prefix sums and pointer doubling, so that no task holds one. Both give the same. Pages alike
    in order and size may stand for each other."""
    counted = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > long).select("__g")
    if counted.isEmpty():
        return _folded(df, group, order, size, limit)
    among = df[group].eqNullSafe(F.col("__g"))
    counted = kept_table(counted)
    return _folded(df.join(counted, among, "left_anti"), group, order, size, limit).unionByName(_doubled(df.join(counted, among, "left_semi"), group, order, size, limit, ranges))


def numbered(df: DataFrame, group: str, volume: str, out: str = "suffix") -> DataFrame:
    """df with "(02/05)": a volume's number of how many."""
    most = df.groupBy(F.col(group).alias("__g")).agg(F.max(volume).alias("__most"))
    joined = df.join(most, df[group].eqNullSafe(F.col("__g")))
    return joined.withColumn(out, F.format_string("(%02d/%02d)", F.col(volume), F.col("__most"))).drop("__g", "__most")


def documents(df: DataFrame, group: str, order: str, size: str, limit: int = LIMIT) -> DataFrame:
    """A row for each volume to be written: its first and last page, how many, their size, its suffix,
    and a key of the group's name and the volume's number."""
    packed = numbered(volumes(df, group, order, size, limit), group, "volume")
    row = packed.groupBy(group, "volume").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("pages"), F.sum(size).alias("size"), F.min("suffix").alias("suffix"))
    return row.withColumn("key", content_key(F.col(group).cast("string"), F.col("volume")))


def collected(df: DataFrame, key: str, order: str, value: str, short: Column | None = None) -> DataFrame:
    """Per key its pages in order, and whether any is missing."""
    missing = F.bool_or(short if short is not None else F.col(value).isNull())
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("pages"), missing.alias("broken"))


def with_placeholder(pages: str, order: str, images: str, empty: str = "empty.png") -> Column:
    """The first image of every page in order; a page without images gets the placeholder."""
    shown = lambda p: F.struct(p[order].alias("o"), F.coalesce(F.get(p[images], F.lit(0)), F.lit(empty)).alias("i"))
    return F.transform(F.array_sort(F.transform(pages, shown)), lambda p: p["i"])


def titled(packed: DataFrame, title: Column, issue: Column, number: Column, group: str, volume: str = "volume") -> DataFrame:
    """Volumes with the title each is shown under; several volumes of a document say which of how many."""
    total = F.max(volume).over(Window.partitionBy(group))
    return packed.withColumn("title", display_title(title, issue, number, total > 1, F.col(volume), total))
