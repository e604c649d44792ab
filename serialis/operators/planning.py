"""Daily delivery plans: quotas by subscription and by user, and retries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serialis.operators.listing import due, recent, visible
from serialis.operators.merging import upsert

#: Deliveries that failed more often than this are not tried again.
RETRIES = 3
#: The largest quota a day that anyone has; what is more counts as so much. The bound is a constant, so that tasks keep
#: only the first rows of a group before they shuffle.
MOST_A_DAY = 100


def shuffled(seed: str, key: str) -> Column:
    """A reproducible random order."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))


def issues_to_send(issues: DataFrame, handled: DataFrame, issue: str, subscription: str, order: list[str], remains: Column, most: int, out: str = "rank") -> DataFrame:
    """Per subscription its first issues in order that are not handled, as many as remain.
    `most` bounds `remains`, so that each task keeps only its first rows of a subscription."""
    open_issues = issues.join(handled.select(issue).distinct(), issue, "left_anti")
    rank = F.row_number().over(Window.partitionBy(subscription).orderBy(*order))
    return open_issues.withColumn(out, rank).where((F.col(out) <= most) & (F.col(out) <= remains))


def handled(deliveries: DataFrame, status: str, retry: str, sent: list[str], failed: str, retries: int | None = None) -> DataFrame:
    """Deliveries that rule an issue out: sent or under way, or failed too often."""
    limit = RETRIES if retries is None else retries
    return deliveries.where(F.col(status).isin(sent) | ((F.col(status) == failed) & (F.col(retry) > limit)))


def capped(plan: DataFrame, user: str, order: list[Column | str], remains: Column | int, out: str = "position", most: int = MOST_A_DAY) -> DataFrame:
    """Per user the first planned rows in order, up to the user's own quota, which `most` bounds."""
    rank = F.row_number().over(Window.partitionBy(user).orderBy(*order))
    return plan.withColumn(out, rank).where((F.col(out) <= most) & (F.col(out) <= remains))


def retries(deliveries: DataFrame, status: str, retry: str, failed: str, limit: int | None = None) -> DataFrame:
    """Failed deliveries that may be tried again, with their counter up by one. No quota applies."""
    most = RETRIES if limit is None else limit
    return deliveries.where((F.col(status) == failed) & (F.col(retry) <= most)).withColumn(retry, F.col(retry) + 1)


def live(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions (with paused, deleted, enabled) in use, of sources that are."""
    return visible(subscriptions, "active", F.col("deleted"), F.col("paused")).where("enabled")


def used(deliveries: DataFrame, key: str, asof: Column) -> DataFrame:
    """(key, used): deliveries of the last day."""
    return deliveries.where(recent("send_date", asof)).groupBy(key).agg(F.count(F.lit(1)).alias("used"))


def remaining(owners: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """owners with `remains`: their per_day less what they have used, at least 0."""
    joined = owners.join(counts.select(F.col(key).alias("__key"), "used"), F.col(key) == F.col("__key"), "left")
    return joined.withColumn("remains", F.greatest(F.lit(0), F.col("per_day") - F.coalesce("used", F.lit(0)))).drop("__key", "used")


def daily(users: DataFrame, subscriptions: DataFrame, issues: DataFrame, deliveries: DataFrame, asof: Column, hour: int | Column | None, seed: str, keep: tuple[str, ...] = (), user: object = None, most: int = MOST_A_DAY) -> DataFrame:
    """The plan of a day: (owner, subscription, issue, position, retry), and what to keep of the subscription.

    users: owner, send_at, time_zone, per_day; subscriptions: subscription, owner, language, per_day,
    paused, deleted, enabled; issues: subscription, issue, language, order; deliveries: subscription, issue,
    status, retry, send_date. Users whose hour it is (None: all of them), or the one `user`, get, of their live
    subscriptions in a random order that the seed fixes, the first issues not yet handled, as many as the
    subscription's quota has left and, over all of them, the user's own. A delivery that failed is counted up.

    Where issues carry `status` and `retry`, null without a delivery, deliveries are read for the quotas
    only: what was used is counted by subscription once, and summed by owner from that.
    """
    recently = used(deliveries, "subscription", asof)
    by_owner = recently.join(subscriptions.select("subscription", "owner"), "subscription").groupBy("owner").agg(F.sum("used").alias("used"))
    asked = users if user is None else users.where(F.col("owner") == user)
    asked = asked if hour is None else asked.where(due("send_at", "time_zone", hour))
    now = remaining(asked, by_owner, "owner").select("owner", F.col("remains").alias("owner_remains")).where("owner_remains > 0")
    mine = remaining(live(subscriptions).join(now, "owner"), recently, "subscription").where("remains > 0")
    told = issues if "status" in issues.columns else issues.join(deliveries.select("subscription", "issue", "status", "retry"), ["subscription", "issue"], "left")
    open_ = F.col("status").isNull() | ((F.col("status") == "FA") & (F.col("retry") <= RETRIES))
    new = mine.join(told.where(open_), ["subscription", "language"])
    rank = F.row_number().over(Window.partitionBy("subscription").orderBy("order", "issue"))
    first = new.withColumn("rank", rank).where((F.col("rank") <= most) & (F.col("rank") <= F.col("remains")))
    planned = capped(first, "owner", [shuffled(seed, "subscription"), "subscription", "rank"], F.col("owner_remains"), most=most)
    again = F.when(F.col("status") == "FA", F.col("retry") + 1).otherwise(0)
    return planned.select("owner", "subscription", "issue", "position", again.alias("retry"), *keep)


def daily_retries(subscriptions: DataFrame, issues: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(owner, subscription, issue, retry): failed deliveries of live subscriptions in their language that may
    be tried again, counted up. No quota applies."""
    again = retries(deliveries, "status", "retry", "FA").select("subscription", "issue", "retry")
    return live(subscriptions).join(issues.select("subscription", "issue", "language"), ["subscription", "language"]).join(again, ["subscription", "issue"]).select("owner", "subscription", "issue", "retry")


def under_way(deliveries: DataFrame, planned: DataFrame, asof: Column) -> DataFrame:
    """Deliveries once the planned ones are processing, as of now."""
    return upsert(deliveries, planned.select("subscription", "issue", F.lit("PR").alias("status"), "retry", asof.alias("send_date")), ["subscription", "issue"])


def counted_or_dropped(df: DataFrame, retry: str, limit: int = RETRIES) -> DataFrame:
    """The counter up by one; rows that pass the limit go."""
    return df.withColumn(retry, F.col(retry) + 1).where(F.col(retry) <= limit)


def outcome_of(valid: Column, ok: Column) -> Column:
    """SE if the images were valid and all volumes mailed, else FA; what is not known has failed."""
    return F.when(F.coalesce(valid & ok, F.lit(False)), "SE").otherwise("FA")


def outcome(deliveries: DataFrame, issue: str, cached: DataFrame, mailed: DataFrame) -> DataFrame:
    """Deliveries with their new status `outcome`, FA or SE. cached: (issue, valid); mailed: (issue, ok),
    a row per volume. An issue not cached, with invalid images, or any of whose volumes was not
    mailed has failed."""
    valid = cached.groupBy(F.col(issue).alias("__c")).agg(F.bool_and("valid").alias("__valid"))
    sent = mailed.groupBy(F.col(issue).alias("__m")).agg(F.bool_and("ok").alias("__ok"))
    joined = deliveries.join(valid, F.col(issue) == F.col("__c"), "left").join(sent, F.col(issue) == F.col("__m"), "left")
    return joined.withColumn("outcome", outcome_of(F.col("__valid"), F.col("__ok"))).drop("__c", "__m", "__valid", "__ok")


def send_list(deliveries: DataFrame, chosen: DataFrame, keys: list[str], status: str, value: str, send_date: str | None = None, asof: Column | None = None) -> DataFrame:
    """Deliveries with those of the chosen keys set to a status and added where they lack. A send date
    is set only if it is named; otherwise the stored ones stay."""
    marked = chosen.select(*keys).distinct().withColumn(status, F.lit(value))
    return upsert(deliveries, marked.withColumn(send_date, asof) if send_date else marked, keys)
