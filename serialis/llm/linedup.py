"""Removing repeated runs of lines, by a suffix array over line ids.

The lines of all documents form one sequence, with a break after each document. Lines that occur
once can be part of no repeat and drop out; the rest get order-preserving ids. Prefix doubling
ranks the suffixes by their first 1, 2, 4, ... lines, each level from the one before by a join, a
distributed sort and a join; suffixes of equal rank form an interval of the suffix array with that
longest common prefix. Two overlapping ranks of a level name the interval of any run length in
between. A run of lines is deleted where it holds at least MIN_WORDS words and the same run begins
at an earlier position (by id, then line); the first copy stays.

To delete every line of every such run it is enough to look at the shortest runs of MIN_WORDS words
that begin or end at a line: if a longer run is repeated, so are those inside it, and they cover it.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serialis.llm.common import documents, saved, slices

#: Words from which on a repeated run is deleted.
MIN_WORDS = 50
_BLANK = b" \t\n\x0b\x0c\r"
_LINES = "did long, rid long, i int, k1 long, k2 long, forward int, backward int"


def _hash(line: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(line, seed) - 2**63


def windows(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every line, how many lines from it on (and up to it) hold `least` words; 0: too few."""
    total = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(len(counts))
    forward = np.searchsorted(total, total[:-1] + least)
    backward = np.searchsorted(total, total[1:] - least, side="right") - 1
    return np.where(forward <= len(counts), forward - at, 0).astype(np.int32), np.where(total[1:] >= least, at + 1 - backward, 0).astype(np.int32)


def _splitter(least: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            for did, rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                lines = [x for x in (text or b"").split(b"\n") if x.strip(_BLANK)]
                n = len(lines)
                forward, backward = windows(np.fromiter((len(x.split()) for x in lines), np.int64, n), least)
                row = (np.full(n, did), np.full(n, rid), np.arange(n, dtype=np.int32), np.fromiter((_hash(x, 0) for x in lines), np.int64, n), np.fromiter((_hash(x, 1) for x in lines), np.int64, n), forward, backward)
                for part, x in zip(parts, row, strict=True):
                    part.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["did", "rid", "i", "k1", "k2", "forward", "backward"])

    return split


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts without the lines (numbered among those that aren't blank) to delete."""
    for batch in slices(batches):
        texts, lines, removed = [], [], []
        for text, gone in zip(batch.column("__text").cast(pa.binary()).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
            drop, kept, at = set(gone or ()), [], 0
            for line in (text or b"").split(b"\n"):
                if line.strip(_BLANK):
                    if at not in drop:
                        kept.append(line)
                    at += 1
                else:
                    kept.append(line)
            texts.append(text if not drop else b"\n".join(kept))
            lines.append(at)
            removed.append(len(drop))
        names = [n for n in batch.schema.names if n not in ("__text", "__gone")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*names, "__left", "__lines", "__removed"]
        )


def _row_keys(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.withColumns({"__did": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "__rid": F.xxhash64(text_col)})


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with `rank`, an id in the order of the keys and equal for equal keys; rows whose keys no
    other row has are left out. Only distinct keys are sorted."""
    repeated = rows.groupBy(*keys).count().where("count > 1").select(*keys)
    names = saved(repeated.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))
    return rows.join(names, keys)


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(did, rid, gone): for each document with lines to delete, their numbers among its lines
    that aren't blank."""
    keyed = _row_keys(df, id_col, text_col).select("__did", "__rid", F.col(text_col).alias("__text"))
    lines = keyed.mapInArrow(_splitter(min_words), _LINES).dropDuplicates(["did", "rid", "i"])
    ranks = saved(_named(saved(lines), ["k1", "k2"]).drop("k1", "k2"))
    starts = ranks.where("forward > 0").select("did", "rid", F.col("i").alias("s"), F.col("forward").alias("k"))
    ends = ranks.where("backward > 0").select("did", "rid", (F.col("i") - F.col("backward") + 1).alias("s"), F.col("backward").alias("k"))
    runs = saved(starts.union(ends).distinct())
    longest = runs.agg(F.max("k")).first()[0] or 0
    ranks = ranks.select("did", "rid", "i", "rank")
    found, width = [], 1
    while width <= longest:
        # Runs of width to 2 * width - 1 lines are named by the ranks at their two ends.
        head = ranks.select("did", "rid", F.col("i").alias("s"), F.col("rank").alias("r1"))
        tail = ranks.select("did", "rid", F.col("i").alias("t"), F.col("rank").alias("r2"))
        these = runs.where(f"k >= {width} and k < {2 * width}").withColumn("t", F.col("s") + F.col("k") - width).join(head, ["did", "rid", "s"]).join(tail, ["did", "rid", "t"])
        these = saved(these.select("did", "rid", "s", "k", "r1", "r2"))
        # Written, so that the join below can split a run that very many documents have.
        first = saved(these.groupBy("k", "r1", "r2").agg(F.min(F.struct("did", "rid", "s")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        later = these.join(first, ["k", "r1", "r2"]).where(F.struct("did", "rid", "s") > F.col("first"))
        found.append(saved(later.select("did", "rid", "s", "k")))
        if 2 * width <= longest:
            pairs = head.withColumn("t", F.col("s") + width).join(tail, ["did", "rid", "t"])
            ranks = saved(_named(pairs, ["r1", "r2"]).select("did", "rid", F.col("s").alias("i"), "rank"))
        width *= 2
    if not found:
        found.append(runs)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    gone = every.select("did", "rid", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("k") - 1)).alias("i"))
    return gone.groupBy("did", "rid").agg(F.sort_array(F.collect_set("i")).alias("gone"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with its texts less repeated runs, and `n_lines` and `n_removed` (longs): lines of the text
    that aren't blank, and how many of these were deleted.

    A line ends at a line feed. Blank lines are not counted, break no run and stay. A text from
    which nothing is deleted stays as it is, null included; a text of which all goes is empty. A null
    id comes before all others; rows alike in id and text are one document. An empty table gives no
    rows. Other columns pass through.
    """
    gone = repeated_lines(df, id_col, text_col, min_words)
    joined = _row_keys(df, id_col, text_col).withColumnRenamed(text_col, "__text").join(
        gone.select(F.col("did").alias("__did"), F.col("rid").alias("__rid"), F.col("gone").alias("__gone")), ["__did", "__rid"], "left"
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("__text", "__gone"))
    cut = joined.mapInArrow(_cut, f"{kinds}, __left string, __lines long, __removed long")
    out = [F.col("__left").alias(c) if c == text_col else F.col(c) for c in df.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*out, F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"))


def without_repeats(df: DataFrame) -> DataFrame:
    """The documents less their repeated runs; a document goes if nothing of it is left.
    Columns as in df; `n_chars` is counted anew, in its own type."""
    cut = dedup_lines(df).where(~((F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")) == "")))
    sizes = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in df.columns else {}
    return cut.withColumns(sizes).select(*df.columns)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


OP10_SQL = r"""
with raw as (select doc_id, generate_subscripts(ls, 1) as raw, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)),
b as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from raw),
l as (select doc_id, raw, line, w, row_number() over (partition by doc_id order by raw) as i, sum(w) over (partition by doc_id order by raw) as upto from b where w > 0),
f as (select a.doc_id, a.i as s, min(z.i) as e from l a join l z on a.doc_id = z.doc_id and z.i >= a.i and z.upto >= a.upto - a.w + 50 group by all),
k as (select z.doc_id, max(a.i) as s, z.i as e from l z join l a on a.doc_id = z.doc_id and a.i <= z.i and z.upto >= a.upto - a.w + 50 group by z.doc_id, z.i),
r as (select * from f union select * from k),
t as (select r.doc_id, s, e, md5(string_agg(line, chr(10) order by i)) as h, e - s as n from r join l on l.doc_id = r.doc_id and i between s and e group by all),
m as (select *, min((doc_id, s)) over (partition by h, n) as first from t),
g as (select distinct m.doc_id, l.raw from m join l on l.doc_id = m.doc_id and l.i between s and e where (m.doc_id, s) <> first),
o as (select b.doc_id, string_agg(line, chr(10) order by b.raw) filter (g.raw is null) as text, count(*) filter (w > 0) as n_lines, count(g.raw) as n_removed
      from b left join g on b.doc_id = g.doc_id and b.raw = g.raw group by b.doc_id)
select d.doc_id, case when coalesce(n_removed, 0) = 0 then d.text else coalesce(o.text, '') end as text, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed
from documents d left join o on d.doc_id = o.doc_id
"""
