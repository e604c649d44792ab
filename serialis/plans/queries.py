"""The catalog operators bound to the test tables: query name -> (spark, folder) -> DataFrame, with
the same query in DuckDB's SQL beside it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serialis.functions import cleaning as C
from serialis.functions import text as X
from serialis.operators import extraction, listing, merging, packing, planning, retention
from serialis.sources.io import rendered_log, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _asof(df: DataFrame, time: str = "ts"):
    """The latest time of a table, as a scalar subquery: one value, never the clock."""
    return df.agg(F.max(time)).scalar()


@query("""select p_partkey, p_name, max(l_shipdate) as last_change from part left join lineitem on l_partkey = p_partkey
group by all order by last_change desc nulls last, p_name, p_partkey limit 25 offset 25""")
def latest_titles(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return listing.page(listing.latest(parts, table(spark, d, "lineitem"), "p_partkey", "l_partkey", "l_shipdate", ["p_name", "p_partkey"]), 2, 25)


@query("""select c_custkey, c_name, max(o_orderdate) as last_delivery from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P'
where c_mktsegment = 'BUILDING' group by all""")
def latest_subscriptions(spark, d):
    """The subscriptions of one segment's users, whose deliveries are open orders."""
    users = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return listing.latest(users, table(spark, d, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey", "o_orderdate", ["c_custkey"], "last_delivery")


@query("select o_custkey, o_orderpriority, count(*) as n from orders group by all")
def language_counts(spark, d):
    return listing.counts_by(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("""select user_id, count(*) filter (event_type = 'purchase') as sent, count(*) filter (event_type = 'error') as failed, count(*) as total from events group by all""")
def dashboard_counts(spark, d):
    return listing.dashboard(table(spark, d, "events"), "user_id", "event_type", sent="purchase", failed="error")


@query("""with u as (select user_id, count(*) as used from events where ts between (select max(ts) from events) - interval 22 hour and (select max(ts) from events) group by all)
select c_custkey, coalesce(used, 0) as used, greatest(0, 4 - coalesce(used, 0)) as remains,
case when greatest(0, 4 - coalesce(used, 0)) <= 0 then 'danger' when greatest(0, 4 - coalesce(used, 0)) <= 10 then 'warning' else 'info' end as level
from customer left join u on user_id = c_custkey""")
def quota_remaining(spark, d):
    events = table(spark, d, "events")
    uses = events.where(listing.recent("ts", _asof(events)))
    left = listing.remaining_quota(table(spark, d, "customer").select("c_custkey"), uses, "c_custkey", "user_id", F.lit(4))
    return left.withColumn("level", listing.alert_level("remains"))


def _issues(spark, d) -> DataFrame:
    deliveries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linenumber")
    handled = planning.handled(deliveries, "l_returnflag", "l_linenumber", ["A"], "R")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return planning.issues_to_send(orders, handled, "o_orderkey", "o_custkey", ["o_orderdate", "o_orderkey"], F.lit(2), 2)


_ISSUES = """i as (select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rank from orders
where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A' or (l_returnflag = 'R' and l_linenumber > 3)) qualify rank <= 2)"""


@query(f"with {_ISSUES} select o_custkey, o_orderkey, rank from i")
def issues_to_send(spark, d):
    return _issues(spark, d).select("o_custkey", "o_orderkey", "rank")


#: The tables of a delivery plan: a customer is a user, an order a subscription, a line its issue, and a
#: line that was returned or accepted a delivery, failed or sent.
_TABLES = """u as (select c_custkey as owner, n_nationkey % 24 as send_at, n_regionkey * 3 - 6 as time_zone, (2 + floor(greatest(c_acctbal, 0) / 2000))::int as per_day from customer join nation on n_nationkey = c_nationkey),
s as (select o_orderkey as subscription, o_custkey as owner, case when o_orderstatus = 'F' then 'F' else 'O' end as language, (1 + floor(o_totalprice / 150000))::int as per_day, o_totalprice < 25000 as paused, o_orderdate < '1995-07-01' as deleted,
o_orderpriority as source, o_orderpriority <> '5-LOW' as enabled from orders),
i as (select l_orderkey as subscription, l_linenumber as issue, max(l_linestatus) as language, min(l_partkey) as place from lineitem group by 1, 2),
d as (select l_orderkey as subscription, l_linenumber as issue, case when bool_or(l_returnflag = 'A') then 'SE' else 'FA' end as status, max(floor(l_discount * 50))::int as retry, max(l_shipdate) filter (l_returnflag = 'A') as send_date
from lineitem where l_returnflag <> 'N' group by 1, 2),
l as (select * from s where not paused and not deleted and enabled), r as (select * from d where send_date between (select max(send_date) from d) - interval 22 hour and (select max(send_date) from d))"""
_PLANNED = f"""{_TABLES}, ur as (select u.owner, greatest(0, any_value(u.per_day) - count(r.issue)) as owner_remains from u left join s on s.owner = u.owner left join r on r.subscription = s.subscription where (24 + send_at - time_zone) % 24 = 6 group by 1),
sr as (select l.subscription, l.owner, l.language, owner_remains, greatest(0, any_value(l.per_day) - count(r.issue)) as remains from l join ur on ur.owner = l.owner and owner_remains > 0 left join r on r.subscription = l.subscription group by 1, 2, 3, 4),
n as (select sr.*, i.issue, row_number() over (partition by sr.subscription order by place, i.issue) as rank from sr join i on i.subscription = sr.subscription and i.language = sr.language
left join d on d.subscription = i.subscription and d.issue = i.issue where d.issue is null or (status = 'FA' and retry <= 3)),
p as (select n.owner, n.subscription, n.issue, row_number() over (partition by owner order by md5('7' || subscription::varchar), subscription, rank) as position, owner_remains from n where rank <= remains),
planned as (select p.owner, p.subscription, p.issue, position, coalesce(d.retry + 1, 0) as retry from p left join d on d.subscription = p.subscription and d.issue = p.issue where position <= owner_remains)"""


#: The same for the user with the most subscriptions, at any hour.
_PLANNED_OF_ONE = "with " + _PLANNED.replace("where (24 + send_at - time_zone) % 24 = 6", "where u.owner = (select owner from s group by 1 order by count(*) desc, owner limit 1)")


def _plan_tables(spark, d) -> dict[str, DataFrame]:
    zones = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 24).alias("send_at"), (F.col("n_regionkey") * 3 - 6).alias("time_zone"))
    quota = (2 + F.floor(F.greatest("c_acctbal", F.lit(0)) / 2000)).cast("int")
    users = table(spark, d, "customer").join(zones, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("owner"), "send_at", "time_zone", quota.alias("per_day"))
    subscriptions = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("subscription"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("language"), (1 + F.floor(F.col("o_totalprice") / 150000)).cast("int").alias("per_day"),
        (F.col("o_totalprice") < 25000).alias("paused"), (F.col("o_orderdate") < "1995-07-01").alias("deleted"), F.col("o_orderpriority").alias("source"), (F.col("o_orderpriority") != "5-LOW").alias("enabled"),
    )
    keys = F.col("l_orderkey").alias("subscription"), F.col("l_linenumber").alias("issue")
    # Dealt once by what both tables are grouped and joined by.
    lines = listing.dealt(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")
    sent = F.col("l_returnflag") == "A"
    delivered = F.col("l_returnflag") != "N"
    status = F.when(F.bool_or(sent), "SE").when(F.bool_or(delivered), "FA").alias("status")
    retry = F.max(F.when(delivered, F.floor(F.col("l_discount") * 50))).cast("int").alias("retry")
    # An issue with what became of it, from one pass over the lines.
    issues = lines.groupBy(*keys).agg(F.max("l_linestatus").alias("language"), F.min("l_partkey").alias("order"), status, retry)
    deliveries = lines.where(delivered).groupBy(*keys).agg(status, retry, F.max(F.when(sent, F.col("l_shipdate"))).alias("send_date"))
    return {"users": users, "subscriptions": subscriptions, "issues": issues, "deliveries": deliveries}


def _last_sent(spark, d):
    return _asof(table(spark, d, "lineitem").where("l_returnflag = 'A'"), "l_shipdate")


@query(f"with {_PLANNED} select p.owner, subscription, issue, position, retry, case when source in ('1-URGENT', '2-HIGH') then 'slow' else 'fast' end as lane from planned p join s using (subscription)")
def daily_plan(spark, d):
    tables = _plan_tables(spark, d)
    plan = planning.daily(**tables, asof=_last_sent(spark, d), hour=6, seed="7", keep=("source",))
    return listing.lanes(plan, "source", ["1-URGENT", "2-HIGH"]).drop("source")


@query(f"""with {_PLANNED} select coalesce(d.subscription, p.subscription) as subscription, coalesce(d.issue, p.issue) as issue, case when p.issue is null then d.status else 'PR' end as status, coalesce(p.retry, d.retry) as retry,
case when p.issue is null then send_date else (select max(send_date) from d) end as send_date from d full join planned p on d.subscription = p.subscription and d.issue = p.issue""")
def daily_deliveries(spark, d):
    deliveries, planned = _plan_tables(spark, d)["deliveries"], daily_plan(spark, d)
    return planning.under_way(deliveries, planned, _last_sent(spark, d))


@query(f"""{_PLANNED_OF_ONE} select p.owner, subscription, issue, position, retry from planned p""")
def plan_of_one(spark, d):
    """The plan of the user with the most subscriptions, whatever the hour."""
    tables = _plan_tables(spark, d)
    user = tables["subscriptions"].groupBy("owner").count().agg(F.max_by("owner", F.struct("count", -F.col("owner")))).first()[0]
    return planning.daily(**tables, asof=_last_sent(spark, d), hour=None, seed="7", user=user)


@query(f"with {_TABLES} select l.owner, l.subscription, d.issue, d.retry + 1 as retry from l join i on i.subscription = l.subscription and i.language = l.language join d on d.subscription = i.subscription and d.issue = i.issue where status = 'FA' and retry <= 3")
def retry_plan(spark, d):
    tables = _plan_tables(spark, d)
    return planning.daily_retries(tables["subscriptions"], tables["issues"], tables["deliveries"])


@query("select c_custkey from customer join nation on n_nationkey = c_nationkey where (24 + n_nationkey % 24 - (n_regionkey * 3 - 6) + 24) % 24 = 6")
def due_users(spark, d):
    zones = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 24).alias("send_at"), (F.col("n_regionkey") * 3 - 6).alias("zone"))
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return customers.join(zones.where(listing.due("send_at", "zone", 6)), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query(f"with {_TABLES} select 'all' as view, count(*) as n from s union all select 'present', count(*) from s where not deleted union all select 'active', count(*) from s where not deleted and not paused")
def visibility_views(spark, d):
    subscriptions = _plan_tables(spark, d)["subscriptions"]
    counts = subscriptions.agg(*(F.count_if(c).alias(v) for v, c in listing.views(F.col("deleted"), F.col("paused")).items()))
    return counts.unpivot([], ["all", "present", "active"], "view", "n")


#: Two versions of a table: per customer the facts of finished and pending orders, and of open and pending ones.
_VERSIONS = """s as (select o_custkey, max(o_orderpriority) as priority, count(*) as n, max(o_totalprice) as price from orders where o_orderstatus <> 'O' group by 1),
i as (select o_custkey, max(o_orderpriority) as priority, count(*) as n, max(o_totalprice) as price from orders where o_orderstatus <> 'F' group by 1)"""


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    facts = F.max("o_orderpriority").alias("priority"), F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("price")
    orders = table(spark, d, "orders")
    return tuple(orders.where(F.col("o_orderstatus") != status).groupBy("o_custkey").agg(*facts) for status in ("O", "F"))


@query(f"""with {_VERSIONS} select o_custkey, case when s.n is null then 'insert' when i.n is null then 'delete' when (s.priority, s.n) = (i.priority, i.n) then 'keep' else 'update' end as action from s full join i using (o_custkey)""")
def diff_merge(spark, d):
    stored, incoming = _versions(spark, d)
    return merging.diff(stored, incoming, ["o_custkey"], ["priority", "n"])


@query(f"""with {_VERSIONS} select o_custkey, case when i.price > 400000 then i.priority else s.priority end as priority, coalesce(case when i.price <= 400000 then i.n else s.n end, 0) as n, case when i.n is null then s.price else -1 end as price from s full join i using (o_custkey)""")
def partial_update(spark, d):
    stored, incoming = _versions(spark, d)
    present = F.when(F.col("price") > 400000, F.array(F.lit("priority"))).otherwise(F.array(F.lit("n")))
    return merging.partial_update(stored, incoming.withColumn("present", present), ["o_custkey"], ["priority", "n"], "present", ("price", F.lit(-1.0))).fillna(0, ["n"])


@query("""select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal >= 0) and o_orderkey not in (select l_orderkey from lineitem where l_linestatus = 'F')""")
def insert_only_latest(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    stored = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merging.insert_only(stored, orders, table(spark, d, "customer").where("c_acctbal >= 0"), "o_custkey", "c_custkey", ["o_orderkey"])


@query("select s_suppkey, n_nationkey from supplier join nation on n_nationkey = s_nationkey")
def tag_links(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    named = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_acctbal") < 5000, F.lower("n_name")).otherwise(F.col("n_name")).alias("tag"))
    return merging.resolve(named, nations, "tag", "n_name", "n_nationkey").select("s_suppkey", "n_nationkey")


@query("""select o_orderkey, coalesce(status, 'PR') as status, case when coalesce(status, 'PR') <> 'FA' then o_orderdate end as send_date
from orders left join (select l_orderkey, case when bool_or(l_returnflag = 'R') then 'FA' else 'SE' end as status from lineitem where l_returnflag <> 'N' group by 1) on l_orderkey = o_orderkey""")
def upsert_delivery(spark, d):
    """Deliveries under way take the outcome of their lines: one that was returned fails and loses its date."""
    stored = table(spark, d, "orders").select("o_orderkey", F.lit("PR").alias("status"), F.col("o_orderdate").alias("send_date"))
    failed = F.when(F.bool_or(F.col("l_returnflag") == "R"), "FA").otherwise("SE")
    news = table(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(failed.alias("status"))
    known = news.join(stored.select("o_orderkey"), "o_orderkey", "left_semi")
    return merging.set_status(merging.upsert(stored, known, ["o_orderkey"]), "status", F.col("status"), "send_date")


@query("""select distinct on (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem
order by l_orderkey, l_linenumber, l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc""")
def last_wins(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return merging.last_wins(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]).drop("l_shipdate")


@query("""select c_custkey, case when c_acctbal < 0 then null else trim(c_name) end as name, case when c_mktsegment = 'MACHINERY' then null else (c_custkey * 1000)::double end as rank,
case when c_nationkey = 3 then null else 'EN' end as language,
list_filter([case when c_acctbal < 0 then 'name' end, case when c_mktsegment = 'MACHINERY' then 'rank' end, case when c_nationkey = 3 then 'language' end], lambda x: x is not null) as errors
from customer where c_acctbal < 0 or c_mktsegment = 'MACHINERY' or c_nationkey = 3""")
def clean_reject(spark, d):
    raw = table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, " <b></b> ").otherwise(F.concat(F.lit(" <i>"), "c_name", F.lit("</i> "))).alias("name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "none").otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit("k"))).alias("rank"),
        F.when(F.col("c_nationkey") == 3, "Klingon").otherwise("English").alias("language"),
    )
    rules = {"name": F.nullif(F.trim(C.clean_str(F.col("name"))), F.lit("")), "rank": C.parse_number(F.col("rank")), "language": C.clean_enum(F.col("language"), C.LANGUAGES, C.BY_NAME)}
    return C.clean_rows(raw, rules, ["name", "rank", "language"])[1]


@query("select o_orderkey, date_trunc('day', o_orderdate)::timestamp as parsed from orders")
def date_roundtrip(spark, d):
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 8
    formats = ["dd MMMM yyyy - hh:mm a", "dd MMM yyyy", "MMM d, yyyy HH:mma", "MMM d, yyyy", "d-M-yyyy", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss'+00:00'", "yyyy-MM-dd HH:mm:ss' UTC'"]
    text = F.lit(None).cast("string")
    for k, f in enumerate(formats):
        text = F.when(kind == k, F.date_format(day, f)).otherwise(text)
    return table(spark, d, "orders").select("o_orderkey", C.parse_date(text, F.lit("2015-01-01 01:00:00").cast("timestamp")).cast("timestamp").alias("parsed"))


@query("""select o_orderkey, (timestamp '2015-01-01 01:00:00' - case o_orderkey % 4 when 0 then (o_orderkey % 50) * interval 1 day when 1 then (o_orderkey % 50) * interval 1 hour
when 2 then (o_orderkey % 50) * interval 7 day else (o_orderkey % 50) * interval 30 day end)::date::timestamp as parsed from orders""")
def relative_dates(spark, d):
    key = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, ("days", "hours", "weeks", "months"))), (key % 4 + 1).cast("int"))
    text = F.concat((key % 50).cast("string"), F.lit(" "), unit, F.lit(" ago"))
    return table(spark, d, "orders").select("o_orderkey", C.parse_date(text, F.lit("2015-01-01 01:00:00").cast("timestamp")).cast("timestamp").alias("parsed"))


_PLAIN = "trim(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', chr(160)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), ' ')"


@query(f"""select page_id, {_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} as title, {_PLAIN.format("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} as heading,
len(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) as n_paragraphs from pages""")
def html_text(spark, d):
    return extraction.extract(table(spark, d, "pages"), "html", skipped=[]).select("page_id", "title", "heading", F.size("paragraphs").alias("n_paragraphs"))


@query(r"""select page_id, n - pos + 1 as "order", regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || link as link
from (select page_id, url, len(l) as n, unnest(l) as link, generate_subscripts(l, 1) as pos from (select *, regexp_extract_all(html, '<li><a href="([^"]*)"', 1) as l from pages))""")
def page_links(spark, d):
    return extraction.link_rows(table(spark, d, "pages"), "page_id", "url", "html")


@query("""with r as (select o_custkey, o_orderkey, o_orderdate, (row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) - 1) // 4 as page from orders),
p as (select o_custkey, page, min(o_orderdate) as oldest from r group by all), k as (select o_custkey, page, min(oldest) over (partition by o_custkey order by page rows between unbounded preceding and 1 preceding) as earlier from p)
select o_custkey, o_orderkey, page from r join k using (o_custkey, page) where earlier is null or earlier >= '2000-01-01'""")
def latest_until(spark, d):
    from pyspark.sql import Window

    feed = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    paged = feed.withColumn("page", F.floor((place - 1) / 4))
    return extraction.until(paged, "page", "o_orderdate", F.lit("2000-01-01").cast("timestamp"), "o_custkey").select("o_custkey", "o_orderkey", "page")


_HITS = r"""t as (select *, list_filter(string_split_regex(lower(source), '[^\p{L}\p{N}]+'), lambda x: x <> '') as a, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as b from documents),
m as (select doc_id, source, len(list_filter(a, lambda x: starts_with(x, 'src1'))) + 0.1::double * len(list_filter(b, lambda x: starts_with(x, 'src1')))
+ len(list_filter(a, lambda x: starts_with(x, 'tion'))) + 0.1::double * len(list_filter(b, lambda x: starts_with(x, 'tion'))) + len(list_filter(a, lambda x: starts_with(x, 'zu'))) + 0.1::double * len(list_filter(b, lambda x: starts_with(x, 'zu'))) as rank,
len(list_filter(a || b, lambda x: starts_with(x, 'src1'))) > 0 as p, len(list_filter(a || b, lambda x: starts_with(x, 'tion'))) > 0 as q, len(list_filter(a || b, lambda x: starts_with(x, 'zu'))) > 0 as r from t)"""


@query("""select p_partkey, p_name || case p_size % 5 when 0 then '' when 1 then ' 000a' when 2 then ' ' || lpad(p_size::varchar, 3, '0') || '.5' when 3 then ' ' || lpad(p_size::varchar, 3, '0') || 'b' else ' ' || lpad(p_size::varchar, 3, '0') end
|| case when p_retailprice > 1000 then printf(' (%02d/%02d)', p_size % 4 + 1, p_size % 4 + 3) else '' end || ': ' || p_brand as shown from part""")
def display_title(spark, d):
    """The shapes of issue names that sources give: volumes with fractions, chapters, letters, no number."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    number = F.element_at(F.array(F.lit(""), F.lit("a"), F.concat(size, F.lit(".5")), F.concat(size, F.lit("b")), size), (F.col("p_size") % 5 + 1).cast("int"))
    chapter = F.when(number.rlike("^[0-9]"), F.concat(F.lit(" Ch. "), F.regexp_replace(number, "b", ""), F.lit(" - "))).otherwise(F.lit(" - "))
    issue = F.concat(F.lit("Vol 1.5 "), F.upper(name), chapter, number, F.lit(": "), F.col("p_brand"))
    volume = F.col("p_size") % 4 + 1
    return table(spark, d, "part").select("p_partkey", X.display_title(name, issue, number, F.col("p_retailprice") > 1000, volume, volume + 2).alias("shown"))


_VOLUMES = """t as (select {g}, {o}, {s} as n, row_number() over (partition by {g} order by {o}) as i, (sum({s}) over (partition by {g}))::bigint as total from {t}),
v as (select {g}, i, {o}, n, total, 1 as volume, n as filled from t where i = 1
union all select t.{g}, t.i, t.{o}, t.n, t.total, case when t.total > {l} and v.filled > 1 + t.total // (1 + t.total // {l}) then v.volume + 1 else v.volume end,
case when t.total > {l} and v.filled > 1 + t.total // (1 + t.total // {l}) then t.n else v.filled + t.n end from v join t on t.{g} = v.{g} and t.i = v.i + 1)"""


@query(f"""with recursive {_VOLUMES.format(g="o_custkey", o="o_orderkey", s="floor(o_totalprice)::bigint", t="orders", l=600000)}
select o_custkey, o_orderkey, n, volume, printf('(%02d/%02d)', volume, max(volume) over (partition by o_custkey)) as suffix from v""")
def split_volumes(spark, d):
    """Orders of a customer as the pages of a document."""
    pages = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("n"))
    return packing.numbered(packing.volumes(pages, "o_custkey", "o_orderkey", "n", 600_000), "o_custkey", "volume")


@query("select conv_id, count(*) as n, string_agg(turn::varchar, ',' order by turn) as turns, bool_or(length(text) < 80) as broken from conversations group by conv_id")
def collect_pages(spark, d):
    pages = packing.collected(table(spark, d, "conversations"), "conv_id", "turn", "text", F.length("text") < 80)
    return pages.select("conv_id", F.size("pages").alias("n"), F.array_join(F.transform("pages", lambda p: p["turn"].cast("string")), ",").alias("turns"), "broken")


@query("""with r as (select o_custkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as rn from orders)
select o_custkey, (arg_max(rn, (o_orderdate, rn)) - 1) // 4 + 1 as page from r group by all""")
def page_of_latest(spark, d):
    return listing.page_of_latest(table(spark, d, "orders"), "o_custkey", ["o_orderpriority", "o_orderkey"], "o_orderdate", 4)


@query("select l_linenumber, count(*) as n from lineitem where l_linenumber in (1, 3, 4, 5) group by all")
def range_select(spark, d):
    return listing.counts_by(table(spark, d, "lineitem").where(listing.in_ranges("l_linenumber", "1,3-5")), "l_linenumber")


@query("""select c_custkey, max(o_orderdate) as last_use from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'P'
where c_acctbal < 5000 group by c_custkey having max(o_orderdate) < '2001-01-01' or max(o_orderdate) is null""")
def inactive_users(spark, d):
    """Only open orders count as uses, so that some users have none."""
    login = F.when(F.col("c_acctbal") < 5000, F.lit("1999-01-01")).otherwise(F.lit("2002-01-01")).cast("timestamp")
    uses = table(spark, d, "orders").where("o_orderstatus = 'P'")
    users = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return retention.inactive(users, uses, "c_custkey", "o_custkey", "o_orderdate", login, F.lit("2001-01-01").cast("timestamp")).drop("c_acctbal")


@query("""select o_orderkey, n_name, r_name, printf('%02dd %02dh', h // 24, h % 24) as age from (select *, (epoch(timestamp '2001-01-01') - epoch(o_orderdate))::bigint // 3600 as h from orders)
join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where o_orderdate < timestamp '2001-01-01' - interval 900 day""")
def old_rows_report(spark, d):
    asof = F.lit("2001-01-01").cast("timestamp")
    old = table(spark, d, "orders").where(retention.older("o_orderdate", asof, 900))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = old.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("o_orderkey", "n_name", "r_name", retention.age_text(retention.age_hours("o_orderdate", asof)).alias("age"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def orphans(spark, d):
    used = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return retention.orphans(table(spark, d, "orders").select("o_orderkey"), used, ["o_orderkey"])


@query("select event_id, coalesce(c_name, '<UNKNOWN>') as label from events left join customer on c_custkey = user_id and c_acctbal >= 0")
def unknown_label(spark, d):
    """Customers with a debt are unknown."""
    return listing.with_default(table(spark, d, "events").select("event_id", "user_id"), table(spark, d, "customer").where("c_acctbal >= 0"), "user_id", "c_custkey", "c_name", "<UNKNOWN>", "label").drop("user_id")


@query("select event_id, ts from events where (select count(*) from events) > 4096 order by ts, event_id limit 1024")
def cache_evict(spark, d):
    return retention.overflow(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id", 4096, 1024)


@query("select event_id from events where epoch((select max(ts) from events)) - epoch(ts) > 864000")
def cache_ttl(spark, d):
    events = table(spark, d, "events")
    return retention.expired(events, "ts", _asof(events), 864_000).select("event_id")


@query("select l_orderkey, bool_and(l_partkey in (select p_partkey from part where p_size > 5)) as valid from lineitem group by all")
def nested_validity(spark, d):
    """Small parts count as missing."""
    arrays = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return retention.invalid_nested(arrays, "l_orderkey", "parts", table(spark, d, "part").where("p_size > 5"), "p_partkey")


@query("select s_nationkey, arg_min(s_suppkey, md5('42' || s_suppkey::varchar)) as s_suppkey from supplier group by all")
def one_per_group(spark, d):
    return listing.one_per_group(table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey", "42")


@query("select l_orderkey, l_partkey, l_linenumber + 1 as l_linenumber from lineitem where l_linenumber + 1 <= 3")
def retry_or_drop(spark, d):
    return planning.counted_or_dropped(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_linenumber")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def unique_violations(spark, d):
    return merging.violations(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("select s_nationkey, count(*) as n from supplier where s_nationkey not in (0, 1, 2, 3, 4) group by all")
def enum_violations(spark, d):
    return listing.counts_by(merging.outside(table(spark, d, "supplier"), "s_nationkey", [0, 1, 2, 3, 4]), "s_nationkey")


@query("select c_custkey, c_name from customer where c_name ilike '%#0000001%' or c_custkey = 7")
def lookup_or(spark, d):
    return table(spark, d, "customer").where(listing.contains("c_name", "#0000001") | (F.col("c_custkey") == 7)).select("c_custkey", "c_name")


@query("""select case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'slow' else 'fast' end as lane, count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0) group by all""")
def lanes(spark, d):
    cached = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return listing.counts_by(listing.lanes(listing.without(table(spark, d, "orders"), cached, "o_custkey"), "o_orderpriority", ["1-URGENT", "2-HIGH"]), "lane")


@query("select date_trunc('day', ts)::timestamp as day, count(*) as n from events group by all")
def drill_down(spark, d):
    return listing.drill_down(table(spark, d, "events"), "ts")


@query("select user_id, count(*) as errors from events where event_type = 'error' group by all")
def log_errors(spark, d):
    lines = table(spark, d, "events").select("user_id", rendered_log(F.col("ts"), F.upper("event_type"), F.col("event_id").cast("string")).alias("line"))
    return lines.where(X.is_error_line(F.col("line"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("errors"))


@query(r"""with p as (select page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) as name, contains(url, '?') as moved, contains(url, '#') as same, length(html) < 3000 as partial from pages)
select page_id, moved and name || '.html' = name || case when same then '' else '.html' end as valid, case when partial and not moved then 500 when moved then 302 else 200 end as status from p""")
def redirect_class(spark, d):
    """Pages with a query in their url count as moved, to a page of the same name unless a fragment is named."""
    status, path = F.when(F.contains("url", F.lit("?")), 302).otherwise(200), F.regexp_replace("url", r"[?#].*$", "")
    target = F.when(F.contains("url", F.lit("#")), path).otherwise(F.concat(path, F.lit(".html")))
    valid = X.valid_redirect(status, F.concat(path, F.lit(".html")), target)
    return table(spark, d, "pages").select("page_id", valid.alias("valid"), X.fetch_status(status, F.length("html") < 3000, [302]).alias("status"))


@query("""select o_orderkey, coalesce(names, '') as names from orders left join (select l_orderkey, string_agg(distinct l_returnflag, ' ' order by l_returnflag) as names from lineitem group by 1) on l_orderkey = o_orderkey""")
def alt_names(spark, d):
    names = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag").distinct()
    return listing.joined_names(table(spark, d, "orders").select("o_orderkey"), names, "o_orderkey", "l_returnflag", "names")


@query("""select l_orderkey, case when count(*) filter (l_returnflag = 'R') > 0 or count(*) filter (l_linestatus = 'O') > 0 then 'FA' else 'SE' end as outcome from lineitem group by all""")
def delivery_outcome(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "R").alias("valid"), F.bool_and(F.col("l_linestatus") != "O").alias("ok"))
    return lines.select("l_orderkey", planning.outcome_of(F.col("valid"), F.col("ok")).alias("outcome"))


@query("select o_orderkey, c_nationkey from orders join customer on c_custkey = o_custkey where c_acctbal >= 0")
def cascade_delete(spark, d):
    users = table(spark, d, "customer").where("c_acctbal >= 0").select("c_custkey", "c_nationkey")
    return merging.cascade(table(spark, d, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey", "c_custkey").join(users, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")


@query("select c_custkey, 'F' as mode, 'EN' as language, 30 as issues_per_day, c_name as email from customer where c_acctbal >= 0")
def default_profiles(spark, d):
    users = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return merging.default_profiles(users, users.where("c_acctbal < 0"), "c_custkey", "c_name")


@query("""select user_id, date_trunc('hour', ts)::timestamp + interval 1 hour * (i - 21) as begin, count(*) as n from events, range(0, 22) r(i) group by all""")
def usage_windows(spark, d):
    from serialis.streaming.latest import usage

    return usage(table(spark, d, "events"), "ts", "user_id").select("user_id", F.col("window.start").alias("begin"), "n")


@query("""select c_custkey, coalesce(l, 'PE') as status from customer left join (select o_custkey, max(o_orderstatus) as l from orders where o_orderpriority = '1-URGENT' group by all) on o_custkey = c_custkey""")
def status_labels(spark, d):
    """Only urgent orders give a status, so that some users have the default."""
    last = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max("o_orderstatus").alias("l"))
    return listing.with_default(table(spark, d, "customer").select("c_custkey"), last, "c_custkey", "o_custkey", "l", "PE", "status")


@query("""with s as (select l_partkey, max(l_returnflag) as flag, max(l_suppkey) as supp, min(l_shipdate) as created, max(l_shipdate) as modified from lineitem where l_linestatus = 'F' group by 1),
i as (select l_partkey, max(l_returnflag) as flag, max(l_suppkey) as supp from lineitem where l_linestatus = 'O' group by 1)
select i.*, coalesce(s.created, timestamp '2002-01-01') as created, case when s.flag = i.flag and s.supp = i.supp then s.modified else timestamp '2002-01-01' end as modified from i left join s on s.l_partkey = i.l_partkey""")
def collection_sync(spark, d):
    return _collection(spark, d)[0]


@query("""with s as (select l_partkey, max(l_returnflag) as flag, max(l_suppkey) as supp from lineitem where l_linestatus = 'F' group by 1),
i as (select l_partkey, max(l_returnflag) as flag, max(l_suppkey) as supp from lineitem where l_linestatus = 'O' group by 1)
select l_partkey, case when s.supp is null then 'insert' when i.supp is null then 'delete' when s.flag = i.flag and s.supp = i.supp then 'keep' else 'update' end as action from s full join i using (l_partkey)""")
def collection_log(spark, d):
    return _collection(spark, d)[1]


def _collection(spark, d):
    lines = table(spark, d, "lineitem")
    facts = F.max("l_returnflag").alias("flag"), F.max("l_suppkey").alias("supp")
    stored = lines.where("l_linestatus = 'F'").groupBy("l_partkey").agg(*facts, F.min("l_shipdate").alias("created"), F.max("l_shipdate").alias("modified"))
    incoming = lines.where("l_linestatus = 'O'").groupBy("l_partkey").agg(*facts)
    return merging.sync(stored, incoming, ["l_partkey"], ["flag", "supp"], F.lit("2002-01-01").cast(lines.schema["l_shipdate"].dataType))


@query("""with s as (select l_orderkey, l_linenumber, max(l_returnflag) as status, max(l_shipdate) as send_date from lineitem where l_linestatus = 'F' group by 1, 2),
c as (select distinct l_orderkey, l_linenumber from lineitem where l_linenumber in (1, 3, 4, 5) and l_quantity >= 25)
select coalesce(s.l_orderkey, c.l_orderkey) as l_orderkey, coalesce(s.l_linenumber, c.l_linenumber) as l_linenumber, case when c.l_orderkey is null then status else 'SE' end as status, send_date
from s full join c on s.l_orderkey = c.l_orderkey and s.l_linenumber = c.l_linenumber""")
def send_list(spark, d):
    lines, keys = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    stored = lines.where("l_linestatus = 'F'").groupBy(*keys).agg(F.max("l_returnflag").alias("status"), F.max("l_shipdate").alias("send_date"))
    return planning.send_list(stored, lines.where(listing.in_ranges("l_linenumber", "1,3-5") & (F.col("l_quantity") >= 25)), keys, "status", "SE")


@query("""with old as (select 'titles' as kind, l_partkey as key, max(l_shipdate) as t, 60 as days from lineitem group by l_partkey union all
select case o_orderstatus when 'P' then 'processing' else 'failed' end, o_orderkey, o_orderdate, case o_orderstatus when 'P' then 400 else 700 end from orders where o_orderstatus in ('P', 'F')),
h as (select kind, key, (epoch(timestamp '2001-06-01') - epoch(t))::bigint // 3600 as h from old where t < timestamp '2001-06-01' - interval 1 day * days)
select kind, key, printf('%02dd %02dh', h // 24, h % 24) as age from h""")
def retention_suite(spark, d):
    orders = table(spark, d, "orders")
    titles = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_shipdate").alias("seen"))
    status = lambda s: orders.where(F.col("o_orderstatus") == s)
    rules = {"titles": (titles, "l_partkey", "seen", 60), "processing": (status("P"), "o_orderkey", "o_orderdate", 400), "failed": (status("F"), "o_orderkey", "o_orderdate", 700)}
    return retention.suite(F.lit("2001-06-01").cast("timestamp"), **rules)


@query("""with recursive t as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as i, (sum(length(text)) over (partition by conv_id))::bigint as total from conversations),
v as (select conv_id, i, turn, n, total, 1 as volume, n as filled from t where i = 1
union all select t.conv_id, t.i, t.turn, t.n, t.total, case when t.total > 300 and v.filled > 1 + t.total // (1 + t.total // 300) then v.volume + 1 else v.volume end,
case when t.total > 300 and v.filled > 1 + t.total // (1 + t.total // 300) then t.n else v.filled + t.n end from v join t on t.conv_id = v.conv_id and t.i = v.i + 1)
select conv_id, volume, min(turn) as first, max(turn) as last, count(*) as pages, sum(n)::bigint as size, printf('(%02d/%02d)', volume, max(volume) over (partition by conv_id)) as suffix,
md5(conv_id::varchar) || printf('-%02d', volume) as key from v group by conv_id, volume""")
def packed_documents(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return packing.documents(pages, "conv_id", "turn", "n", 300)


@query("""select c_custkey, coalesce(p, c_mktsegment) as language, p is null and c_acctbal < 0 as deleted
from customer left join (select o_custkey, max(o_orderpriority) as p from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey""")
def subscribe_merge(spark, d):
    """Wishes are open orders, which not all users have."""
    stored = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("language"), (F.col("c_acctbal") < 0).alias("deleted"))
    wishes = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("language"))
    return merging.subscribe(stored, wishes, ["c_custkey"])


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderstatus <> 'P' or o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def soft_delete(spark, d):
    subscriptions = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(False).alias("deleted"), "c_acctbal")
    deliveries = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return merging.soft_delete(subscriptions, subscriptions.where("c_acctbal < 0"), "o_custkey", deliveries, "o_orderstatus", "P")[1]


@query("""select page_id, case when regexp_matches(html, '<li><a href="[^"]*"') then regexp_extract(regexp_replace(regexp_extract(html, '<li><a href="([^"]*)"', 1), '[?#].*$', ''), '([^/]*)$', 1) end as cover from pages""")
def cover_update(spark, d):
    pages = table(spark, d, "pages").select("page_id", extraction.field(F.col("html"), extraction.RULES["links"]).alias("links"))
    return merging.covers(pages, "links").select("page_id", "cover")


@query("select conv_id from conversations group by conv_id having bool_or(not regexp_matches(text, '[a-z]{8,}'))")
def broken_issues(spark, d):
    images = F.regexp_extract_all("text", F.lit("([a-z]{8,})"))
    issues = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(images.alias("images"))).alias("pages"))
    return retention.broken(issues, "pages", "images").select("conv_id")
