"""Retention: what is too old, too much or has lost its parent. Reports are what a dry run shows;
removals give the table that is left."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serialis.operators.listing import with_default


def older(time: str, asof: Column, days: int = 0, hours: int = 0) -> Column:
    return F.col(time) < asof - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))


def age_hours(time: str, asof: Column) -> Column:
    return F.floor((F.unix_seconds(asof.cast("timestamp_ltz")) - F.unix_seconds(F.col(time).cast("timestamp_ltz"))) / 3600)


def age_text(hours: Column) -> Column:
    """Hours as `DDd HHh`."""
    return F.format_string("%02dd %02dh", F.floor(hours / 24).cast("long"), (hours % 24).cast("long"))


def expired(df: DataFrame, created: str, asof: Column, seconds: int) -> DataFrame:
    """Rows that outlived their time, whole days included and fractions of a second counted. Times without a zone
    are compared as they stand."""
    return df.where(F.col(created) < asof - F.make_dt_interval(secs=F.lit(seconds)))


def overflow(df: DataFrame, created: str, key: str, slots: int, batch: int) -> DataFrame:
    """The `batch` oldest rows if there are more than `slots`, else none."""
    return df.orderBy(created, key).limit(batch).where(df.agg(F.count(F.lit(1))).scalar() > slots)


def inactive(users: DataFrame, uses: DataFrame, key: str, use_key: str, used: str, login: Column, before: Column) -> DataFrame:
    """Users whose last login and last use, if any, lie before a time."""
    last = uses.groupBy(F.col(use_key).alias("__key")).agg(F.max(used).alias("last_use"))
    joined = users.join(last, users[key] == F.col("__key"), "left").drop("__key")
    return joined.where((login < before) & ((F.col("last_use") < before) | F.col("last_use").isNull()))


def deactivated(users: DataFrame, gone: DataFrame, key: str, active: str) -> DataFrame:
    """Users with those inactive marked as such, instead of removed."""
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    return users.join(ids, F.col(key) == F.col("__gone"), "left").withColumn(active, F.col(active) & F.col("__gone").isNull()).drop("__gone")


def labelled(cache: DataFrame, created: str, asof: Column, seconds: int, labels: DataFrame, key: str, label_key: str, label: str, unknown: str = "<UNKNOWN>") -> DataFrame:
    """Expired cache rows with the label of what they held, for the report."""
    return with_default(expired(cache, created, asof, seconds), labels, key, label_key, label, unknown, "label")


def without_broken(caches: list[DataFrame], gone: DataFrame, key: str) -> list[DataFrame]:
    """Each cache less the rows of broken keys."""
    return [c.join(gone.select(key).distinct(), key, "left_anti") for c in caches]


def old_files(files: DataFrame, asof: Column, days: int, errors: DataFrame | None = None) -> DataFrame:
    """Files (path, modificationTime, length) to remove: older than so many days, and, if a list of
    files with errors is given, none of these."""
    old = files.where(older("modificationTime", asof, days))
    return old if errors is None else old.join(errors.select(F.col("file").alias("path")), "path", "left_anti")


def orphans(df: DataFrame, referenced: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(referenced.select(*keys), keys, "left_anti")


def invalid_nested(df: DataFrame, key: str, values: str, existing: DataFrame, existing_key: str) -> DataFrame:
    """(key, valid): whether every element of an array exists; empty arrays are valid."""
    each = df.select(key, F.explode(values).alias("__value"))
    missing = each.join(existing.select(F.col(existing_key).alias("__value")).distinct(), "__value", "left_anti").select(F.col(key).alias("__bad")).distinct()
    return df.join(missing, df[key] == F.col("__bad"), "left").select(key, F.col("__bad").isNull().alias("valid"))


def broken(df: DataFrame, pages: str, images: str) -> DataFrame:
    """Rows any of whose pages has no image."""
    return df.where(F.exists(pages, lambda p: F.size(p[images]) == 0))


def suite(asof: Column, **rules: tuple[DataFrame, str, str, int]) -> DataFrame:
    """(kind, key, age): what each named rule would remove. A rule is (table, its key, its time column,
    days); all ages count from the same asof."""
    reports = [df.where(older(time, asof, days)).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), age_text(age_hours(time, asof)).alias("age")) for kind, (df, key, time, days) in rules.items()]
    return reduce(DataFrame.unionAll, reports)
