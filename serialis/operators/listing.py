"""Listings: latest changes, counts, pages, lookups. All take column names, so that the same code
runs on catalog tables and on any others."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(parents: DataFrame, children: DataFrame, key: str, child_key: str, changed: str, ties: list[str], out: str = "last_change") -> DataFrame:
    """Parents with the last change among their children, newest first; those without come last.
    Children are aggregated before the join, so the join moves one row per parent."""
    last = children.groupBy(F.col(child_key).alias("__key")).agg(F.max(changed).alias(out))
    joined = parents.join(last, parents[key] == F.col("__key"), "left").drop("__key")
    return joined.orderBy(F.col(out).desc_nulls_last(), *ties)


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of an ordered table; a number below 1 is an error."""
    if number < 1 or size < 1:
        raise ValueError(f"no page {number} of size {size}")
    return df.offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> int:
    """How many pages a table has, at least one; counts the base table without any join."""
    return max(1, -(-df.count() // size))


def views(deleted: Column, paused: Column) -> dict[str, Column]:
    """The condition of each view: `all`, `present` (not deleted), `active` (neither deleted nor paused)."""
    return {"all": F.lit(True), "present": ~deleted, "active": ~deleted & ~paused}


def dealt(df: DataFrame, *keys: str, most: int = 500_000) -> DataFrame:
    """df dealt by its keys to as many tasks as leave each about `most` rows, so that what a task holds doesn't grow with
    the table; a small table, which Spark's own tasks share well enough, stays as it is."""
    tasks = -(-df.count() // most)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def visible(df: DataFrame, view: str, deleted: Column, paused: Column) -> DataFrame:
    """The rows of a view."""
    return df.where(views(deleted, paused)[view])


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(*columns)


def dashboard(df: DataFrame, key: str, status: str, **named: str) -> DataFrame:
    """Per key one conditional count for every name=status, and the total, in one pass."""
    counts = [F.count_if(F.col(status) == value).alias(name) for name, value in named.items()]
    return df.groupBy(key).agg(*counts, F.count(F.lit(1)).alias("total"))


def recent(time: str, asof: Column, hours: int = 22) -> Column:
    """The closed range of `hours` up to asof, in which deliveries use up a quota."""
    return F.col(time).between(asof - F.make_dt_interval(hours=F.lit(hours)), asof)


def remaining_quota(owners: DataFrame, uses: DataFrame, key: str, use_key: str, limit: Column, out: str = "remains") -> DataFrame:
    """Owners with what is left of their limit after their uses; without uses the whole limit."""
    used = uses.groupBy(F.col(use_key).alias("__key")).agg(F.count(F.lit(1)).alias("used"))
    joined = owners.join(used, owners[key] == F.col("__key"), "left").drop("__key")
    return joined.withColumn("used", F.coalesce("used", F.lit(0))).withColumn(out, F.greatest(F.lit(0), limit - F.col("used")))


def page_of_latest(df: DataFrame, key: str, order: list[str], changed: str, size: int) -> DataFrame:
    """For each key, the page that holds the row changed last (ties: the later position)."""
    rows = df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    best = F.max_by("__rn", F.struct(F.coalesce(F.col(changed), F.lit("0001-01-01").cast("timestamp")), "__rn"))
    return rows.groupBy(key).agg((F.floor((best - 1) / size) + 1).cast("long").alias("page"))


def with_default(df: DataFrame, labels: DataFrame, key: str, label_key: str, label: str, default: str, out: str) -> DataFrame:
    """df with the label of its key, or the default."""
    named = labels.select(F.col(label_key).alias("__key"), F.col(label).alias("__label")).dropDuplicates(["__key"])
    return df.join(named, df[key] == F.col("__key"), "left").withColumn(out, F.coalesce("__label", F.lit(default))).drop("__key", "__label")


def only(df: DataFrame, where: Column, what: str = "row") -> DataFrame:
    """The one row that fits; none or several are an error."""
    found = df.where(where)
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"{'no' if not n else 'more than one'} {what} fits")
    return found


def contains(column: str, text: str) -> Column:
    """Whether a column holds the text, ignoring case; % and _ have no meaning."""
    return F.contains(F.lower(F.col(column)), F.lit(text.lower()))


def titles_like(titles: DataFrame, issues: DataFrame, name: str, text: str, key: str, issue_key: str, order: list[str], language: Column | None = None) -> DataFrame:
    """Titles whose name holds the text, with their issues in order, those of one language if it is told;
    a title without any keeps a row."""
    mine = issues if language is None else issues.where(language)
    return titles.where(contains(name, text)).join(mine, F.col(key) == F.col(issue_key), "left").orderBy(name, key, *order)


def title_in_source(titles: DataFrame, source: Column, name: Column, url: Column) -> DataFrame:
    """The one title of a source by its name or its url; none or several are an error."""
    return only(titles.where(source), name | url, "title")


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """"1,3-5" as [(1, 1), (3, 5)]; a range must not fall."""
    out = []
    for part in text.split(","):
        low, dash, high = part.strip().partition("-")
        pair = int(low), int(high if dash else low)
        if pair[0] > pair[1]:
            raise ValueError(f"range {part.strip()} falls")
        out.append(pair)
    return out


def in_ranges(column: str, text: str) -> Column:
    """Whether a number is in a range list, or True for `all`; no numbers are enumerated."""
    if text.strip() == "all":
        return F.lit(True)
    found = F.lit(False)
    for low, high in parse_ranges(text):
        found = found | F.col(column).between(low, high)
    return found


def among(df: DataFrame, column: str, names: str, known: DataFrame, known_column: str) -> DataFrame:
    """Rows whose column is in a comma list, or all for `all`; names that `known` lacks are an error."""
    if names.strip() == "all":
        return df
    wanted = sorted({n.strip() for n in names.split(",")})
    have = {r[0] for r in known.where(F.col(known_column).isin(wanted)).select(known_column).distinct().collect()}
    if missing := [n for n in wanted if n not in have]:
        raise LookupError(f"unknown: {', '.join(missing)}")
    return df.where(F.col(column).isin(wanted))


def default_value(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Per key its value if it has exactly one, else null: then the caller must say which."""
    return df.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.first(value)).alias(out))


def due(send_at: str, time_zone: str, utc_hour: int | Column) -> Column:
    """Whether a user's local sending hour is now, in UTC."""
    return F.pmod(24 + F.col(send_at) - F.col(time_zone), F.lit(24)) == utc_hour


def lanes(df: DataFrame, column: str, slow: list[str], out: str = "lane") -> DataFrame:
    """df with a lane, slow or fast, by membership: one table, read once."""
    return df.withColumn(out, F.when(F.col(column).isin(slow), "slow").otherwise("fast"))


def without(df: DataFrame, handled: DataFrame, *keys: str) -> DataFrame:
    return df.join(handled.select(*keys).distinct(), list(keys), "left_anti")


def having(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key the other table has: issues of subscribed titles, endpoints that passed a check."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi")


def flagged(df: DataFrame, other: DataFrame, key: str, out: str) -> DataFrame:
    """df with whether the other table has its key."""
    keys = other.select(F.col(key).alias("__key"), F.lit(True).alias("__has")).distinct()
    return df.join(keys, F.col(key) == F.col("__key"), "left").withColumn(out, F.col("__has").isNotNull()).drop("__key", "__has")


def state_flags(df: DataFrame, status: str, **named: str) -> DataFrame:
    """df with a boolean for every name=status: is_sent="SE" and the like. A null status is none of them."""
    return df.withColumns({name: F.coalesce(F.col(status) == value, F.lit(False)) for name, value in named.items()})


def results(deliveries: DataFrame, subscriptions: DataFrame, subscription: str, user: str, deleted: Column, status: Column | None = None) -> DataFrame:
    """Deliveries through subscriptions that are not deleted, with their user; of one status, if told.
    `is_sent` is the semi join with the sent ones."""
    live = subscriptions.where(~deleted).select(F.col(subscription).alias("__key"), user)
    found = deliveries.join(live, F.col(subscription) == F.col("__key")).drop("__key")
    return found if status is None else found.where(status)


def owned(df: DataFrame, subscriptions: DataFrame, subscription: str, user: str, me: Column) -> DataFrame:
    """Rows whose subscription belongs to the caller."""
    return df.join(subscriptions.where(F.col(user) == me).select(F.col(subscription).alias("__key")).distinct(), F.col(subscription) == F.col("__key"), "left_semi")


def source_flags(names: DataFrame, sources: DataFrame, name: str, enabled: str, through: list[str]) -> DataFrame:
    """Every known source name with `enabled` (false if its row lacks) and whether it needs an endpoint."""
    rows = sources.select(F.col(name).alias("__name"), F.col(enabled).alias("__on"))
    joined = names.select(name).distinct().join(rows, F.col(name) == F.col("__name"), "left")
    return joined.select(name, F.coalesce("__on", F.lit(False)).alias(enabled), F.col(name).isin(through).alias("needs_endpoint"))


def history(issues: DataFrame, deliveries: DataFrame, keys: list[str], changed: str, *ties: str, out: str = "last_change") -> DataFrame:
    """Issues that were delivered, the last changed delivery first."""
    last = deliveries.groupBy(*keys).agg(F.max(changed).alias(out))
    return issues.join(last, keys).orderBy(F.col(out).desc_nulls_last(), *ties)


def first_chosen(choices: DataFrame, owner: str, order: list[Column | str], remains: str, most: int = 100) -> DataFrame:
    """Of every owner's chosen rows the first ones, as many as the owner's own column says remain, at most `most`."""
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return choices.withColumn("__rank", rank).where((F.col("__rank") <= most) & (F.col("__rank") <= F.col(remains))).drop("__rank")


def page_object(df: DataFrame, number: int, size: int) -> tuple[DataFrame, dict[str, int]]:
    """(rows, facts) of a page: its number, size, how many pages there are. A page beyond the last is
    an error."""
    pages = page_count(df, size)
    if number > pages:
        raise ValueError(f"no page {number} of {pages}")
    return page(df, number, size), {"number": number, "size": size, "pages": pages}


def drill_down(df: DataFrame, time: str, unit: str = "day") -> DataFrame:
    return df.groupBy(F.date_trunc(unit, time).alias(unit)).agg(F.count(F.lit(1)).alias("n"))


def newest(df: DataFrame, status: str, value: str, changed: str, *ties: str) -> DataFrame:
    """Rows of one status, last changed first."""
    return df.where(F.col(status) == value).orderBy(F.col(changed).desc_nulls_last(), *ties)


def alert_level(remains: str) -> Column:
    return F.when(F.col(remains) <= 0, "danger").when(F.col(remains) <= 10, "warning").otherwise("info")


def one_per_group(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """A row of each group, chosen by a seeded hash: random, yet the same every time."""
    order = F.struct(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), F.col(key))
    return df.groupBy(group).agg(F.min_by(F.struct(*df.columns), order).alias("__row")).select("__row.*")


def joined_names(parents: DataFrame, df: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """Parents with their names in order, joined by a space; empty without names."""
    names = df.groupBy(F.col(key).alias("__key")).agg(F.array_join(F.sort_array(F.collect_list(name)), " ").alias(out))
    return parents.join(names, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(out, F.coalesce(out, F.lit("")))
