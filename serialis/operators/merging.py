"""Merges as DataFrame operators: each gives the new table or a log of actions, and changes nothing
in place. Keys decide by one full outer join."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(stored: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys and `action`: insert, update, keep or delete. A row is updated if any column differs,
    nulls being equal to each other."""
    left = stored.select(*keys, F.struct(*columns).alias("__old"), F.lit(True).alias("__stored"))
    right = incoming.select(*keys, F.struct(*columns).alias("__new"), F.lit(True).alias("__came"))
    same = F.col("__old").eqNullSafe(F.col("__new"))
    action = F.when(F.col("__stored").isNull(), "insert").when(F.col("__came").isNull(), "delete").when(same, "keep").otherwise("update")
    return left.join(right, keys, "full_outer").select(*keys, action.alias("action"))


def partial_update(stored: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str], present: str, touched: tuple[str, Column] | None = None) -> DataFrame:
    """Stored rows, each column replaced where an incoming row of the key names it in its array
    `present` (a null that is named is written); unknown keys are added. touched: a column and
    what it becomes for every row that came."""
    new = incoming.select(*keys, F.col(present).alias("__present"), *(F.col(c).alias(f"__new_{c}") for c in columns))
    joined = stored.withColumn("__stored", F.lit(True)).join(new, keys, "full_outer")
    named = {c: F.when(F.array_contains("__present", c), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns}
    if touched:
        named[touched[0]] = F.when(F.col("__present").isNotNull(), touched[1]).otherwise(F.col(touched[0]))
    return joined.withColumns(named).select(*stored.columns)


def insert_only(stored: DataFrame, incoming: DataFrame, parents: DataFrame, parent: str, parent_key: str, keys: list[str]) -> DataFrame:
    """Incoming rows to add: of a known parent and with a new key. Nothing is updated or deleted."""
    known = incoming.join(parents.select(F.col(parent_key).alias(parent)).distinct(), parent, "left_semi")
    return known.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def resolve(links: DataFrame, named: DataFrame, name: str, known_name: str, known_id: str) -> DataFrame:
    """links with the id of their name: the exact name's, else the smallest of those equal but for case."""
    exact = named.groupBy(F.col(known_name).alias("__exact")).agg(F.min(known_id).alias("__exact_id"))
    loose = named.groupBy(F.lower(known_name).alias("__loose")).agg(F.min(known_id).alias("__loose_id"))
    joined = links.join(exact, F.col(name) == F.col("__exact"), "left").join(loose, F.lower(name) == F.col("__loose"), "left")
    return joined.withColumn(known_id, F.coalesce("__exact_id", "__loose_id")).drop("__exact", "__exact_id", "__loose", "__loose_id")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; order must be total."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with incoming ones in place of those of the same key; columns that incoming lacks
    stay, or are null in new rows."""
    given = [c for c in incoming.columns if c not in keys]
    new = incoming.select(*keys, F.lit(True).alias("__came"), *(F.col(c).alias(f"__new_{c}") for c in given))
    joined = stored.join(new, keys, "full_outer")
    return joined.withColumns({c: F.when(F.col("__came"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in given}).select(*stored.columns)


def sync(stored: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str], asof: Column, created: str = "created", modified: str = "modified", told: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(table, log) of a full sync: the table holds the incoming keys with their columns, the log each
    key's action as in `diff`, and the incoming columns that are to be `told` there. New rows are created at asof, and changed ones modified. Both are views
    of one full outer join; for a dry run take the log alone."""
    old = stored.select(*keys, F.col(created).alias("__created"), F.col(modified).alias("__modified"), F.struct(*columns).alias("__old"), F.lit(True).alias("__stored"))
    joined = incoming.select(*keys, *columns, F.lit(True).alias("__came")).join(old, keys, "full_outer")
    same = F.col("__stored") & F.col("__old").eqNullSafe(F.struct(*columns))
    action = F.when(F.col("__stored").isNull(), "insert").when(F.col("__came").isNull(), "delete").when(same, "keep").otherwise("update")
    table = joined.where("__came").select(*keys, *columns, F.coalesce("__created", asof).alias(created), F.when(same, F.col("__modified")).otherwise(asof).alias(modified))
    return table, joined.select(*keys, *told, action.alias("action"))


def resolved_links(stored: DataFrame, named: DataFrame, known: DataFrame, parent: str, name: str, known_name: str, known_id: str) -> DataFrame:
    """(parent, id, action) of a title's tag links: the incoming names resolved to ids, against the stored
    links; names that are not known give none."""
    links = resolve(named, known, name, known_name, known_id).where(F.col(known_id).isNotNull()).select(parent, known_id).distinct()
    return diff(stored.select(parent, known_id).distinct(), links, [parent, known_id], [parent])


def deliver(deliveries: DataFrame, incoming: DataFrame, subscriptions: DataFrame, keys: list[str], subscription: str) -> tuple[DataFrame, DataFrame]:
    """(deliveries, refused): incoming deliveries of known subscriptions are upserted, others refused."""
    known = subscriptions.select(subscription).distinct()
    return upsert(deliveries, incoming.join(known, subscription, "left_semi"), keys), incoming.join(known, subscription, "left_anti")


def settings(stored: DataFrame, wishes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Stored rows with the wished settings of their key, a null wish leaving the old one; keys that are
    not stored are no rows."""
    new = wishes.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in columns)).dropDuplicates(keys)
    joined = stored.join(new, keys, "left")
    return joined.withColumns({c: F.coalesce(f"__new_{c}", c) for c in columns}).select(*stored.columns)


def set_status(df: DataFrame, status: str, value: Column, send_date: str, failed: str = "FA") -> DataFrame:
    """df with a new status; a failed delivery loses its date and so uses no quota."""
    return df.withColumn(status, value).withColumn(send_date, F.when(F.col(status) == failed, None).otherwise(F.col(send_date)))


def subscribe(stored: DataFrame, wishes: DataFrame, keys: list[str]) -> DataFrame:
    """Subscriptions after the wishes: new ones are added, deleted ones revived."""
    return upsert(stored, wishes.withColumn("deleted", F.lit(False)), keys)


def soft_delete(subscriptions: DataFrame, gone: DataFrame, key: str, deliveries: DataFrame, status: str, under_way: str = "PR") -> tuple[DataFrame, DataFrame]:
    """(subscriptions with `deleted` set, deliveries less those under way of the deleted)."""
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    marked = subscriptions.join(ids, F.col(key) == F.col("__gone"), "left").withColumn("deleted", F.col("deleted") | F.col("__gone").isNotNull()).drop("__gone")
    left = deliveries.where(F.col(status) == under_way).join(ids, F.col(key) == F.col("__gone"), "left_anti")
    return marked, deliveries.where((F.col(status) != under_way) | F.col(status).isNull()).unionByName(left)


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(F.col(parent_key).alias("__parent")).distinct(), F.col(key) == F.col("__parent"), "left_semi")


def violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is not one of those allowed, null included."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def default_profiles(users: DataFrame, profiles: DataFrame, user: str, email: str) -> DataFrame:
    """A profile for each user that has none."""
    new = users.join(profiles.select(user), user, "left_anti")
    return new.select(user, F.lit("F").alias("mode"), F.lit("EN").alias("language"), F.lit(30).alias("issues_per_day"), F.col(email).alias("email"))


def covers(df: DataFrame, images: str, out: str = "cover") -> DataFrame:
    """The file name of the first image's url, or null without images."""
    name = F.element_at(F.split(F.regexp_replace(F.get(images, F.lit(0)), r"[?#].*$", ""), "/"), -1)
    return df.withColumn(out, F.when(F.size(images) > 0, name))

