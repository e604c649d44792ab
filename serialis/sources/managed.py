"""Tables in partitions that are replaced one by one, behind a manifest.

A table is a folder of `data/<write>/__part=<value>` folders and of `manifests/<version>.json`. A manifest names
the table's columns, and for every partition its folder, rows, and the least and largest time in it. Readers take
the newest manifest, so what a write has left before its manifest is there, whole or not, is no part of
the table; the manifest is renamed into place last, and never over another. A merge finds the
partitions that its changes touch and rewrites these alone; all others keep their files. Retention drops whole
partitions by the manifest's times without reading them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from serialis.sources.io import kept_table

_PART = "__part"
_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class Part:
    value: str | None
    folder: str
    rows: int
    timeless: int
    least: str | None
    most: str | None


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: StructType
    by: str
    time: str | None
    parts: tuple[Part, ...]


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _child(spark: SparkSession, *names: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(names))


def versions(spark: SparkSession, path: str) -> list[int]:
    files, at = _files(spark, f"{path}/manifests")
    return sorted(int(x.getPath().getName()[:-5]) for x in files.listStatus(at) if x.getPath().getName()[:-5].isdigit()) if files.exists(at) else []


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The newest manifest, or that of a version."""
    version = versions(spark, path)[-1] if version is None else version
    files, at = _files(spark, f"{path}/manifests/{version:012d}.json")
    stream = files.open(at)
    try:
        told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(version, StructType.fromJson(told["schema"]), told["by"], told["time"], tuple(Part(**p) for p in told["parts"]))


def _commit(spark: SparkSession, path: str, new: Manifest) -> None:
    files, at = _files(spark, f"{path}/manifests/{new.version:012d}.json")
    draft = _child(spark, path, "manifests", f"draft-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(json.dumps({"schema": new.schema.jsonValue(), "by": new.by, "time": new.time, "parts": [asdict(p) for p in new.parts]}).encode()))
    out.close()
    if files.exists(at) or not files.rename(draft, at):
        raise RuntimeError(f"version {new.version} of {path} has been written by another")


def _written(df: DataFrame, path: str, by: str, time: str | None) -> list[Part]:
    """Write rows by partition to a new folder; large partitions are several files, small ones few."""
    spark, folder = df.sparkSession, f"{path}/data/{uuid.uuid4().hex}"
    df.withColumn(_PART, F.col(by)).hint("rebalance", _PART).write.partitionBy(_PART).parquet(folder)
    files, at = _files(spark, folder)
    unescaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    folders = {unescaped(n[len(_PART) + 1 :]): n for x in files.listStatus(at) if (n := x.getPath().getName()).startswith(_PART)}
    if not folders:
        return []
    times = [F.count_if(F.col(time).isNull()), F.min(time).cast("string"), F.max(time).cast("string")] if time else [F.lit(0), F.lit(None), F.lit(None)]
    rows = spark.read.schema(df.schema).parquet(*(f"{folder}/{n}" for n in folders.values()))
    facts = {r[0]: r for r in rows.groupBy(F.col(by).cast("string").alias("part")).agg(F.count(F.lit(1)), *times).collect()}
    return [Part(v, f"{folder}/{n}", *facts[v][1:]) for x, n in folders.items() for v in [None if x == _NULL else x]]


def create(df: DataFrame, path: str, by: str, time: str | None = None) -> None:
    """A new table of df in partitions by a column; with `time`, its partitions' times are kept for retention."""
    if versions(df.sparkSession, path):
        raise ValueError(f"{path} is a table")
    _commit(df.sparkSession, path, Manifest(1, df.schema, by, time, tuple(_written(df, path, by, time))))


def _rows(spark: SparkSession, of: Manifest, parts: Iterable[Part]) -> DataFrame:
    folders = [p.folder for p in parts]
    return spark.read.schema(of.schema).parquet(*folders) if folders else spark.createDataFrame([], of.schema)


def read(spark: SparkSession, path: str, version: int | None = None, values: Iterable[str | None] | None = None) -> DataFrame:
    """The table, or its partitions of some values, as of the newest version or another."""
    of = manifest(spark, path, version)
    wanted = None if values is None else set(values)
    return _rows(spark, of, (p for p in of.parts if wanted is None or p.value in wanted))


def _replace(spark: SparkSession, path: str, old: Manifest, touched: set[str | None], rows: DataFrame) -> None:
    kept = tuple(p for p in old.parts if p.value not in touched)
    _commit(spark, path, Manifest(old.version + 1, old.schema, old.by, old.time, kept + tuple(_written(rows.select(*old.schema.names), path, old.by, old.time))))


def refresh(df: DataFrame, path: str, values: Iterable[str | None] | None = None) -> None:
    """Replace the table, or its partitions of some values, by df in one step: readers see the old rows until the new
    ones are all there. With values, df's rows of other partitions are left out."""
    spark = df.sparkSession
    of = manifest(spark, path)
    if values is None:
        return _replace(spark, path, of, {p.value for p in of.parts}, df)
    wanted = set(values)
    return _replace(spark, path, of, wanted, df.where(_among(of.by, wanted)))


def _among(by: str, values: set[str | None]) -> Column:
    named = F.coalesce(F.col(by).cast("string").isin([v for v in values if v is not None]), F.lit(False))
    return named | F.col(by).isNull() if None in values else named


def merge(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], deletes: bool = False) -> DataFrame:
    """(keys, action) of every key: incoming rows, with all the table's columns, replace those of their key and are
    added where they lack; with `deletes` stored keys that don't come go, else they are `keep`.

    Keys are compared over the whole table, on a hash of the other columns; only partitions in which a row is
    added, changed, leaves or goes are read whole and written again. Without a change there is no new version.
    A row that changes its partition touches both. Keys that repeat on a side are the caller's to remove.
    """
    of = manifest(spark, path)
    rest = [c for c in of.schema.names if c not in keys]
    facts = lambda df, name: df.select(*keys, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias(f"{name}_hash"), F.col(of.by).cast("string").alias(f"{name}_part"), F.lit(True).alias(name))
    new = incoming.select(*(F.col(f.name).cast(f.dataType) for f in of.schema))
    joined = facts(_rows(spark, of, of.parts), "__old").join(facts(new, "__new"), keys, "full_outer")
    action = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete" if deletes else "keep").when(F.col("__old_hash") == F.col("__new_hash"), "keep").otherwise("update")
    log = kept_table(joined.withColumn("action", action))
    changed = log.where("action <> 'keep'")
    parts = changed.where("__old").select(F.col("__old_part").alias("p")).union(changed.where("__new").select("__new_part")).distinct()
    touched = {r["p"] for r in parts.collect()}  # as many as partitions at most
    if touched:
        stored = _rows(spark, of, (p for p in of.parts if p.value in touched))
        kept = stored.join(new.select(*keys), keys, "left_anti") if not deletes else stored.where(F.lit(False))
        _replace(spark, path, of, touched, kept.unionByName(new.where(_among(of.by, touched))))
    return log.select(*keys, "action")


def expire(spark: SparkSession, path: str, before: Column) -> dict[str, int]:
    """Remove the rows whose time lies before a value (one constant expression). Partitions that end before it go
    unread, those that begin at or after it stay as they are, and only those it falls into are rewritten. Rows
    without a time stay. Gives how many partitions were dropped, rewritten and kept."""
    of = manifest(spark, path)
    if not of.time:
        raise ValueError(f"{path} keeps no times")
    kind = of.schema[of.time].dataType
    told = spark.createDataFrame([(k, p.least, p.most) for k, p in enumerate(of.parts)], "k long, least string, most string")
    bound = before.cast(kind)
    known = {r["k"]: (r["old"], r["new"]) for r in told.select("k", (F.col("most").cast(kind) < bound).alias("old"), (F.col("least").cast(kind) >= bound).alias("new")).collect()}
    old = [p for k, p in enumerate(of.parts) if known[k][0]]
    dropped = {p.value for p in old if not p.timeless}
    border = {p.value for p in old if p.timeless} | {p.value for k, p in enumerate(of.parts) if known[k] == (False, False)}
    rows = _rows(spark, of, (p for p in of.parts if p.value in border)).where(F.col(of.time).isNull() | (F.col(of.time) >= bound))
    if dropped or border:
        _replace(spark, path, of, dropped | border, rows)
    return {"dropped": len(dropped), "rewritten": len(border), "kept": len(of.parts) - len(dropped) - len(border)}


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove what the last `keep` versions don't use; gives the number of folders removed. No write may run meanwhile."""
    every = versions(spark, path)
    used = {p.folder for v in every[-keep:] for p in manifest(spark, path, v).parts}
    files, data = _files(spark, f"{path}/data")
    gone = 0
    for write in files.listStatus(data):
        for folder in files.listStatus(write.getPath()):
            name = f"{path}/data/{write.getPath().getName()}/{folder.getPath().getName()}"
            if folder.isDirectory() and name not in used:
                files.delete(folder.getPath(), True)
                gone += 1
    for v in every[:-keep]:
        files.delete(_child(spark, path, "manifests", f"{v:012d}.json"), False)
    return gone
