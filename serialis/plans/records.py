"""More catalog queries on the test tables: records and their cleaning, subscriptions, pages, search."""

from pyspark.sql import functions as F

from serialis.functions import cleaning as C
from serialis.functions import text as X
from serialis.operators import extraction, listing, merging, packing, planning, retention, search
from serialis.plans.queries import _TABLES, _VOLUMES, _asof, _plan_tables, query
from serialis.sources import managed
from serialis.sources.io import endpoints, error_logs, files, refresh, rendered_log, scratch, set_times, snapshot, table, table_stream
from serialis.streaming.latest import latest_sync, usage

_ASOF = "2002-01-01 01:00:00"

#: An order is a title, its lines are its issues; those in no known language (N) are dropped.
_RAW = """x as (select l_orderkey, count(*) filter (l_returnflag <> 'N') as n, sum(l_linenumber) filter (l_returnflag <> 'N') as places, max(l_shipdate) filter (l_returnflag <> 'N') as newest from lineitem group by 1),
t as (select o_orderkey, case when o_orderpriority = '5-LOW' then null else o_orderpriority || ' ' || c_name end as name, c_name as author, case o_orderstatus when 'F' then 'RL' when 'O' then 'LR' end as reading_direction,
case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'O' when c_mktsegment = 'HOUSEHOLD' then 'C' end as status, (floor(o_totalprice / 1000) * 1000)::bigint as rank, coalesce(n, 0) as n_issues, places, newest
from orders join customer on c_custkey = o_custkey left join x on l_orderkey = o_orderkey)"""


def _raw_titles(spark, d):
    lines = table(spark, d, "lineitem")
    language = F.when(F.col("l_returnflag") == "A", "en").when(F.col("l_returnflag") == "R", " ES ").otherwise("Klingon")
    issue = F.struct(
        F.concat(F.lit(" Ch. "), F.col("l_linenumber")).alias("name"), F.col("l_linenumber").cast("string").alias("number"), F.concat(F.lit(" "), F.col("l_linenumber"), F.lit("th")).alias("order"), F.trim(language).alias("language"),
        F.date_format("l_shipdate", "MMM d, yyyy").alias("release"), F.lit(" http://host/issue ").alias("url"),
    )
    issues = lines.groupBy("l_orderkey").agg(F.collect_list(issue).alias("issues"))
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(issues, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    words = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "Ongoing").when(F.col("c_mktsegment") == "HOUSEHOLD", "Completed").otherwise("Hiatus")
    return orders.select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "), "c_name", F.lit(" "))).alias("name"), F.array("c_name", F.lit("")).alias("alt_name"), F.col("c_name").alias("author"), F.lit(" ").alias("artist"),
        F.when(F.col("o_orderstatus") == "F", "rl").when(F.col("o_orderstatus") == "O", "lr").otherwise("up").alias("reading_direction"), words.alias("status"), F.array(F.col("o_orderstatus")).alias("genres"),
        F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("k")).alias("rank"), F.lit("asc").alias("rank_order"), F.concat(F.lit("<p>Of "), "c_name", F.lit("&#x21;</p>")).alias("description"), F.coalesce("issues", F.array()).alias("issues"), F.lit("http://host/").alias("url"),
    )


@query(f"""with {_RAW} select o_orderkey, name, author, author as alternatives, '' as artist, reading_direction, status, rank, 'ASC' as rank_order, 'Of ' || author || '!' as description, n_issues, places::bigint as places, newest
from t where name is not null and reading_direction is not null and status is not null and n_issues > 0""")
def clean_titles(spark, d):
    clean = C.clean_titles(_raw_titles(spark, d), F.lit(_ASOF).cast("timestamp"))[0]
    places = F.aggregate("issues", F.lit(0).cast("long"), lambda total, x: total + x["order"])
    return clean.select(
        "o_orderkey", "name", "author", F.array_join("alt_name", ",").alias("alternatives"), "artist", "reading_direction", "status", "rank", "rank_order", "description", F.size("issues").cast("long").alias("n_issues"), places.alias("places"),
        F.array_max(F.transform("issues", lambda x: x["release"])).cast("timestamp").alias("newest"),
    )


@query(f"""with {_RAW}, e as (select o_orderkey, list_filter([case when name is null then 'name' end, case when reading_direction is null then 'reading_direction' end, case when status is null then 'status' end, case when n_issues = 0 then 'issues' end], lambda z: z is not null) as e from t)
select o_orderkey, array_to_string(e, ',') as errors from e where len(e) > 0""")
def reject_titles(spark, d):
    rejected = C.clean_titles(_raw_titles(spark, d), F.lit(_ASOF).cast("timestamp"))[1]
    return rejected.select("o_orderkey", F.array_join("errors", ",").alias("errors"))


#: What is stored of titles: those not open, half of them under names that nobody has given.
_STORED = """s as (select o_orderkey, o_orderkey as k, case when o_orderkey % 2 = 0 then o_orderpriority || ' ' || c_name else '?' end as name, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'O' else 'C' end as status, o_orderdate as created
from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'O')"""


def _synced(spark, d, asof):
    """(table, log) of cleaned titles against the stored ones."""
    clean = C.clean_titles(_raw_titles(spark, d), F.lit(_ASOF).cast("timestamp"))[0].select("o_orderkey", "name", "status")
    old = table(spark, d, "orders").where("o_orderstatus <> 'O'").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat("o_orderpriority", F.lit(" "), "c_name")).otherwise("?")
    stored = old.select("o_orderkey", name.alias("name"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "O").otherwise("C").alias("status"), F.col("o_orderdate").alias("created"), F.col("o_orderdate").alias("modified"))
    return merging.sync(stored, clean, ["o_orderkey"], ["name", "status"], asof, told=("name",))


@query(f"""with {_RAW}, c as (select * from t where name is not null and reading_direction is not null and status is not null and n_issues > 0),
{_STORED} select o_orderkey, c.name, case when s.k is null then 'insert' when c.k is null then 'delete' when s.name = c.name and s.status = c.status then 'keep' else 'update' end as action from s full join (select *, o_orderkey as k from c) c using (o_orderkey)""")
def collection_of_titles(spark, d):
    """The full sync of cleaned records against what is stored: rejected titles are no longer incoming."""
    return _synced(spark, d, F.lit(_ASOF).cast("timestamp"))[1].select("o_orderkey", "name", "action")


@query(f"""with {_RAW}, c as (select * from t where name is not null and reading_direction is not null and status is not null and n_issues > 0),
{_STORED} select o_orderkey, c.name, c.status, coalesce(s.created, timestamp '{_ASOF}') as created, case when s.name = c.name and s.status = c.status then s.created else timestamp '{_ASOF}' end as modified from c left join s using (o_orderkey)""")
def collection_refresh(spark, d):
    """Clean, sync, and rewrite the derived table by status."""
    path = scratch(spark)
    refresh(_synced(spark, d, F.lit(_ASOF).cast("timestamp_ntz"))[0], path, "status")
    return spark.read.parquet(path)


@query("""select conv_id, turn, role as manga, case when length(text) > 200 then conv_id::varchar else '' end as issue, turn::bigint as number from conversations where role <> 'system'""")
def clean_pages(spark, d):
    """The page plan: issue is optional, title and number are not."""
    raw = table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", " ").otherwise(F.concat(F.lit(" "), "role", F.lit(" "))).alias("manga"), F.when(F.length("text") > 200, F.col("conv_id").cast("string")).otherwise(F.lit(" ")).alias("issue"),
        F.concat(F.col("turn").cast("string"), F.lit("th")).alias("number"),
    )
    return C.clean_rows(raw, C.page_rules(), ["manga", "number"])[0].select("conv_id", "turn", "manga", "issue", "number")


@query("select p_brand, string_agg(distinct p_type, ',' order by p_type) as names from part group by 1")
def clean_tags(spark, d):
    """A source's tags by their plan: trimmed, less the words that are none."""
    tags = F.concat(F.array(F.lit("All"), F.lit(" ")), F.transform(F.sort_array(F.collect_set("p_type")), lambda x: F.concat(F.lit(" "), x)), F.array(F.lit("[no chapters]")))
    clean = C.clean_rows(table(spark, d, "part").groupBy("p_brand").agg(tags.alias("names")), C.tag_rules(), ["names"])[0]
    return clean.select("p_brand", F.array_join("names", ",").alias("names"))


@query("""select p_partkey, p_name || ' ' || p_brand as joined, p_name || ',' || p_brand || ',' || p_type as flat, p_size::bigint as whole, 7::bigint as fallback, p_retailprice as price, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> 'ring'), ',') as kept,
array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') as tags, case when p_size > 25 then 'DE' when p_size > 10 then 'EN' end as language, p_name as plain, p_name || '|' || p_brand as names, 'No. ' || p_size as bare,
case when p_size > 40 then 'O' when p_size > 20 then 'C' end as status, case when p_type = 'ECONOMY' then 'O' else 'C' end as ongoing, case when p_type = 'PROMO' then 'C' else 'O' end as complete, case when p_size > 30 then 'LR' else 'RL' end as by_kind,
case when p_size > 30 then 'RL' else 'LR' end as by_origin, replace(p_name, ' ', '_') || '.mobi' as file, lower(p_brand) || '/horizontal-rl/' || p_type || '/' || p_name as facts, coalesce(case when p_type = 'PROMO' then upper(p_name) end, p_name) as own from part""")
def clean_fields(spark, d):
    """The scalar and list cleaners, and a source's own rule for a field."""
    name, size, kind = F.col("p_name"), F.col("p_size"), F.col("p_type")
    words = F.split(name, " ")
    facts = X.document_facts(F.col("p_brand"), F.lit("RL"), kind, name)
    return table(spark, d, "part").select(
        "p_partkey", C.as_str(F.array(F.concat(F.lit(" "), name, F.lit(" ")), F.col("p_brand"))).alias("joined"), F.array_join(C.as_list(F.array(F.array(name), F.array(F.col("p_brand"), kind)), 2), ",").alias("flat"),
        C.clean_int(F.array(size.cast("string"))).alias("whole"), C.clean_int(F.array(name), optional=True, default=7).alias("fallback"), C.clean_float(F.array(F.col("p_retailprice").cast("string"))).alias("price"),
        F.array_join(C.clean_list(words, exclude=["ring"], optional=True), ",").alias("kept"), F.array_join(C.title_case(words), " ").alias("tags"),
        C.clean_enum(F.when(size > 25, "flag_germany").when(size > 10, "flag_united_kingdom").otherwise("flag_none"), C.LANGUAGES, C.BY_FLAG).alias("language"),
        C.without_kind(F.concat(name, F.lit(" Manhwa"))).alias("plain"), F.array_join(C.split_names(F.array(F.concat(name, F.lit("; "), "p_brand", F.lit(";")))), "|").alias("names"), C.without_zeros(F.concat(F.lit("No. "), F.lpad(size.cast("string"), 3, "0"))).alias("bare"),
        C.clean_enum(F.when(size > 40, "Ativo").when(size > 20, "Completo").otherwise("?"), ["O", "C"], C.STATUSES).alias("status"), C.status_if(F.when(kind == "ECONOMY", "Ongoing (Publish)").otherwise(kind), "Ongoing", "O", "C").alias("ongoing"),
        C.status_if(F.when(kind == "PROMO", "Completed").otherwise(kind), "Completed", "C", "O").alias("complete"), C.direction(F.when(size > 30, "Manhwa").otherwise("Manhua")).alias("by_kind"),
        C.direction(F.when(size > 30, "Japanese").otherwise("French"), C.BY_ORIGIN, "LR").alias("by_origin"), X.safe_name(name).alias("file"), F.concat_ws("/", facts["language"], facts["writing_mode"], facts["author"], facts["publisher"]).alias("facts"),
        C.dispatched(kind, {"PROMO": F.upper(name)}, name).alias("own"),
    )


@query("""select o_orderkey, floor(o_totalprice)::double as rank, date_trunc('day', o_orderdate)::timestamp as release from orders""")
def dotted_fields(spark, d):
    """Numbers with dots at the thousands, dates with the day first."""
    price = F.floor("o_totalprice")
    dotted = F.concat(F.floor(price / 1000).cast("string"), F.lit("."), F.lpad((price % 1000).cast("string"), 3, "0"))
    release = C.clean_date(F.array(F.date_format("o_orderdate", "d/M/yyyy")), F.lit(_ASOF).cast("timestamp"), day_first=True)
    return table(spark, d, "orders").select("o_orderkey", C.parse_number(dotted, True, ".").alias("rank"), release.cast("timestamp").alias("release"))


@query("""select page_id, regexp_replace(url, '[^/]*$', '1.html') as first, contains(html, '</article>') and not contains(html, 'Ner') as valid, url || 'é &nosuch;' as decoded from pages""")
def page_facts(spark, d):
    """First page of an issue, validity of a body, and urls read back from character references of all kinds."""
    pages = table(spark, d, "pages")
    written = F.replace(F.replace(F.replace("url", F.lit("/"), F.lit("&#47;")), F.lit("e"), F.lit("&#x65;")), F.lit("?"), F.lit("&#63;"))
    decoded = C.decoded(F.concat(written, F.lit("&eacute; &nosuch;")))
    return pages.select("page_id", C.first_page(F.col("url")).alias("first"), X.valid_body(F.col("html"), ["</article>"], ["Ner"]).alias("valid"), decoded.alias("decoded"))


# Subscriptions and deliveries


@query(f"with {_TABLES} select owner, subscription, issue, status, retry from d join s using (subscription) where not deleted and status = 'SE'")
def sent_results(spark, d):
    """Deliveries of an issue that its user has received through a subscription that is not deleted."""
    t = _plan_tables(spark, d)
    return listing.results(t["deliveries"], t["subscriptions"], "subscription", "owner", F.col("deleted"), F.col("status") == "SE").select("owner", "subscription", "issue", "status", "retry")


@query(f"with {_TABLES} select subscription, issue, coalesce(status = 'SE', false) as is_sent, coalesce(status = 'FA' and retry > 0, false) as is_failed, coalesce(status = 'FA' and retry = 0, false) as is_processing, status is null as is_pending from i left join d using (subscription, issue)")
def issue_states(spark, d):
    """An issue that has failed without a retry yet counts as under way here."""
    issues = _plan_tables(spark, d)["issues"]
    status = F.when((F.col("status") == "FA") & (F.col("retry") == 0), "PR").otherwise(F.coalesce("status", F.lit("PE")))
    states = listing.state_flags(issues.withColumn("status", status), "status", is_sent="SE", is_failed="FA", is_processing="PR", is_pending="PE")
    return states.select("subscription", "issue", "is_sent", "is_failed", "is_processing", "is_pending")


@query(f"with {_TABLES} select subscription, issue, status from d where subscription in (select subscription from s where owner = (select max(owner) from s))")
def own_deliveries(spark, d):
    """The deliveries that the caller, here the last user, may see."""
    t = _plan_tables(spark, d)
    return listing.owned(t["deliveries"], t["subscriptions"], "subscription", "owner", _asof(t["subscriptions"], "owner")).select("subscription", "issue", "status")


@query(f"with {_TABLES} select c_custkey, c_custkey in (select owner from l) as subscribed from customer")
def subscribed_users(spark, d):
    live = planning.live(_plan_tables(spark, d)["subscriptions"]).select(F.col("owner").alias("c_custkey"))
    return listing.flagged(table(spark, d, "customer").select("c_custkey"), live, "c_custkey", "subscribed")


@query(f"with {_TABLES} select i.subscription, i.issue from i where subscription in (select subscription from l)")
def subscribed_issues(spark, d):
    t = _plan_tables(spark, d)
    return listing.having(t["issues"].select("subscription", "issue"), planning.live(t["subscriptions"]), "subscription")


@query(f"with {_TABLES} select subscription, issue, send_date as last_change from d join i using (subscription, issue)")
def issue_history(spark, d):
    t = _plan_tables(spark, d)
    return listing.history(t["issues"].select("subscription", "issue"), t["deliveries"], ["subscription", "issue"], "send_date", "subscription", "issue")


@query(f"with {_TABLES} select subscription, owner from (select s.*, u.per_day as most, row_number() over (partition by owner order by s.subscription) as rank from s join u using (owner)) where rank <= most")
def first_chosen(spark, d):
    """Of what a user has chosen, the first so many as the user's own limit allows."""
    t = _plan_tables(spark, d)
    chosen = t["subscriptions"].select("subscription", "owner").join(t["users"].select("owner", "per_day"), "owner")
    return listing.first_chosen(chosen, "owner", ["subscription"], "per_day").select("subscription", "owner")


@query("select o_orderkey, o_orderdate from orders where o_orderstatus = 'F'")
def newest_failed(spark, d):
    return listing.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), "o_orderstatus", "F", "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("""select n_name, coalesce(enabled, false) as enabled, n_name in ('NATION_1', 'NATION_3') as needs_endpoint from nation left join (select s_nationkey, max(s_acctbal) > 9000 as enabled from supplier where s_acctbal >= 5000 group by 1) on s_nationkey = n_nationkey""")
def source_list(spark, d):
    """Sources are nations with a supplier of a balance of 5,000 or more; the rest have none."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    sources = table(spark, d, "supplier").where("s_acctbal >= 5000").groupBy("s_nationkey").agg((F.max("s_acctbal") > 9000).alias("enabled"))
    return listing.source_flags(nations, sources.join(nations, F.col("s_nationkey") == F.col("n_nationkey")), "n_name", "enabled", ["NATION_1", "NATION_3"])


@query("select s_suppkey, n_name from supplier join nation on n_nationkey = s_nationkey where n_name in ('NATION_1', 'NATION_3', 'NATION_7')")
def sources_among(spark, d):
    """A comma list of sources, every name of which must be known."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return listing.among(suppliers, "n_name", "NATION_1, NATION_3,NATION_7", nations, "n_name")


@query("select c_custkey, c_name from customer where c_name = 'Customer#000000007' or c_custkey = 7")
def lookup_one(spark, d):
    """One user by name or number; none or several would be an error."""
    users = table(spark, d, "customer").select("c_custkey", "c_name")
    return listing.only(users, (F.col("c_name") == "Customer#000000007") | (F.col("c_custkey") == 7), "user")


@query("select s_suppkey, s_nationkey from supplier where s_suppkey >= 0 and (s_name = 'Supplier#000000003' or s_suppkey = 3)")
def lookup_title(spark, d):
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return listing.title_in_source(suppliers, F.col("s_suppkey") >= 0, F.col("s_name") == "Supplier#000000003", F.col("s_suppkey") == 3).select("s_suppkey", "s_nationkey")


@query("select p_partkey, p_name, l_orderkey, l_linenumber from part left join lineitem on l_partkey = p_partkey and l_linestatus = 'F' where p_name ilike '%wid%'")
def titles_like(spark, d):
    issues = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_linestatus")
    found = listing.titles_like(table(spark, d, "part").select("p_partkey", "p_name"), issues, "p_name", "WID", "p_partkey", "l_partkey", ["l_orderkey", "l_linenumber"], F.col("l_linestatus") == "F")
    return found.select("p_partkey", "p_name", "l_orderkey", "l_linenumber")


@query("select o_custkey, case when count(distinct o_orderpriority) = 1 then min(o_orderpriority) end as language from orders where o_orderstatus = 'P' group by 1")
def language_defaults(spark, d):
    """The default of users by their open orders alone; the others have none."""
    return listing.default_value(table(spark, d, "orders").where("o_orderstatus = 'P'"), "o_custkey", "o_orderpriority", "language")


@query("select n_nationkey, n_name, 3 as number, 9 as size, 3 as pages from nation order by n_name, n_nationkey limit 9 offset 18")
def page_object(spark, d):
    rows, facts = listing.page_object(table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_name", "n_nationkey"), 3, 9)
    return rows.withColumns({name: F.lit(value) for name, value in facts.items()})


@query("""select c_custkey, coalesce(o.priority, c_mktsegment) as language, coalesce(o.per_day, 4) as per_day from customer left join (select o_custkey, max(o_orderpriority) as priority, count(*)::int as per_day from orders where o_orderstatus = 'P' group by 1) o on o_custkey = c_custkey""")
def subscription_settings(spark, d):
    """Wishes are open orders, which not all users have; the rest keep their settings."""
    stored = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("language"), F.lit(4).alias("per_day"))
    wishes = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("language"), F.count(F.lit(1)).cast("int").alias("per_day"))
    return merging.settings(stored, wishes, ["c_custkey"], ["language", "per_day"])


@query("""with k as (select distinct o_custkey from orders where o_orderstatus = 'P') select user_id, count(*) filter (o_custkey is null) as refused, count(*) filter (o_custkey is not null) as sent, count(*) filter (o_custkey is null and event_type = 'view') as left_failed from events left join k on o_custkey = user_id group by 1""")
def refused_deliveries(spark, d):
    """Incoming deliveries over stored ones that failed: those whose subscription (an open order) is known are written,
    the others told apart."""
    events = table(spark, d, "events")
    incoming = events.select("event_id", "user_id", F.lit("SE").alias("status"))
    stored = events.where("event_type = 'view'").select("event_id", "user_id", F.lit("FA").alias("status"))
    known = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"))
    deliveries, refused = merging.deliver(stored, incoming, known, ["event_id"], "user_id")
    each = deliveries.select("user_id", "status").union(refused.select("user_id", F.lit("refused")))
    count = lambda status: F.count_if(F.col("status") == status)
    return each.groupBy("user_id").agg(count("refused").alias("refused"), count("SE").alias("sent"), count("FA").alias("left_failed"))


@query("""with i as (select distinct l_partkey, s_nationkey, true as came from lineitem join supplier on s_suppkey = l_suppkey where l_linestatus = 'O'), s as (select distinct l_partkey, s_nationkey, true as stored from lineitem join supplier on s_suppkey = l_suppkey where l_linestatus = 'F')
select l_partkey, s_nationkey as n_nationkey, case when stored is null then 'insert' when came is null then 'delete' else 'keep' end as action from s full join i using (l_partkey, s_nationkey)""")
def tag_link_sync(spark, d):
    """A title's links to tags: names as they come, in any case, against the links that are stored."""
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    suppliers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey", "n_name", "s_acctbal")
    links = table(spark, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    incoming = links.where("l_linestatus = 'O'").select("l_partkey", F.when(F.col("s_acctbal") < 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("tag"))
    return merging.resolved_links(links.where("l_linestatus = 'F'"), incoming, nations, "l_partkey", "tag", "n_name", "n_nationkey")


@query("""select c_custkey, not (c_acctbal < 5000 and coalesce(last < '2001-01-01', true)) as active from customer left join (select o_custkey, max(o_orderdate) as last from orders where o_orderstatus = 'P' group by 1) on o_custkey = c_custkey""")
def deactivated_users(spark, d):
    """Only open orders count as uses, so that some users have none."""
    users = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(True).alias("active"))
    login = F.when(F.col("c_acctbal") < 5000, F.lit("1999-01-01")).otherwise(F.lit("2002-01-01")).cast("timestamp")
    gone = retention.inactive(users, table(spark, d, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey", "o_orderdate", login, F.lit("2001-01-01").cast("timestamp"))
    return retention.deactivated(users.drop("c_acctbal"), gone, "c_custkey", "active")


@query("select event_id, coalesce(c_name, '<UNKNOWN>') as label from events left join customer on c_custkey = user_id and c_acctbal >= 0 where epoch((select max(ts) from events)) - epoch(ts) > 864000")
def cache_report(spark, d):
    """Customers with a debt are unknown labels."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    return retention.labelled(events, "ts", _asof(events), 864_000, table(spark, d, "customer").where("c_acctbal >= 0"), "user_id", "c_custkey", "c_name").select("event_id", "label")


@query("""with b as (select conv_id from conversations group by 1 having bool_or(not regexp_matches(text, '[a-z]{8,}')))
select 'pages' as cache, count(*) as n from conversations where conv_id not in (from b) union all select 'documents', count(distinct conv_id) from conversations where conv_id not in (from b)""")
def caches_without_broken(spark, d):
    """Both caches, of pages and of documents, lose the issues with a missing image."""
    pages = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("([a-z]{8,})")).alias("images"))
    issues = pages.groupBy("conv_id").agg(F.collect_list(F.struct("images")).alias("pages"))
    left = retention.without_broken([pages.select("conv_id"), issues.select("conv_id")], retention.broken(issues, "pages", "images"), "conv_id")
    return left[0].agg(F.count(F.lit(1)).alias("n")).select(F.lit("pages").alias("cache"), "n").union(left[1].agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("cache"), "n"))


# Pages and documents


@query("""with p as (select conv_id, turn, regexp_extract_all(text, '[a-z]{8,}') as images from conversations) select conv_id, string_agg(coalesce(images[1], 'empty.png'), ',' order by turn) as images from p group by 1""")
def placeholder_pages(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("([a-z]{8,})")).alias("images"))
    issues = pages.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "images")).alias("pages"))
    return issues.select("conv_id", F.array_join(packing.with_placeholder("pages", "turn", "images"), ",").alias("images"))


@query(f"""with recursive {_VOLUMES.format(g="conv_id", o="turn", s="length(text)", t="conversations", l=300)}, k as (select conv_id, volume, sum(n)::bigint as size from v group by 1, 2)
select conv_id, volume, size, 'Conv ' || lpad(conv_id::varchar, greatest(3, length(conv_id::varchar))::int, '0') || case when max(volume) over (partition by conv_id) > 1 then printf(' (%02d/%02d)', volume, max(volume) over (partition by conv_id)) else '' end || ': talk' as title from k""")
def packed_titles(spark, d):
    """Documents as they are sent: pages packed into volumes, each under its own title."""
    pages = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    packed = packing.documents(pages, "conv_id", "turn", "n", 300).select("conv_id", "volume", "size")
    number = F.col("conv_id").cast("string")
    return packing.titled(packed, F.lit("Conv"), F.concat(F.lit("conv "), number, F.lit(" - talk")), number, "conv_id")


_ITEMS = """regexp_extract_all(html, '<li><a href="([^"]*)">', 1)"""


@query(rf"""with p as (select page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) as origin, {_ITEMS} as l, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) as n from pages), e as (select page_id, origin, len(l) as size, unnest(l) as link, unnest(n) as label, generate_subscripts(l, 1) as pos from p)
select page_id, size - pos + 1 as "order", label as name, origin || link as url from e""")
def title_issues(spark, d):
    """Records of pages with their issues, in one row per issue."""
    rules = {"heading": extraction.RULES["heading"]}
    records = extraction.title_records(table(spark, d, "pages").select("page_id", "url", "html"), "url", "html", rules, extraction.RULES["links"], extraction.RULES["labels"], skipped=[])
    return records.select("page_id", F.explode("issues").alias("i")).select("page_id", F.col("i.order").alias("order"), F.col("i.name").alias("name"), F.col("i.url").alias("url"))


@query("""select page_id, array_to_string(list_filter(list_transform(flatten(list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), lambda x: string_split(x, ','))), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') as tags from pages""")
def page_tags(spark, d):
    """Tags of a page, those in one text split at commas."""
    rule = extraction.Rule(extraction.RULES["labels"].pattern, every=True, split=",")
    return table(spark, d, "pages").select("page_id", F.array_join(extraction.field(F.col("html"), rule), "|").alias("tags"))


@query("select page_id from pages where not contains(html, 'Ner') and not contains(html, 'Und')")
def record_pages(spark, d):
    """Pages that hold a record: those that a text rules out are skipped."""
    return extraction.extract(table(spark, d, "pages").select("page_id", "html"), "html", {}, ["Ner", "Und"]).select("page_id")


@query("select l_orderkey, l_quantity::int::varchar as number, count(*) as n from lineitem group by 1, 2")
def issue_numbers(spark, d):
    """The number in an issue's name, after a chapter's mark or at the end."""
    number = F.col("l_quantity").cast("int").cast("string")
    name = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Vol 2 Ch."), number, F.lit(" talk"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("Cap. "), number)).otherwise(F.concat(F.lit("Name 7 "), number))
    return listing.counts_by(table(spark, d, "lineitem").select("l_orderkey", extraction.issue_number(name).alias("number")), "l_orderkey", "number")


@query(rf"""with p as (select page_id, regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) as origin, {_ITEMS} as l from pages) select page_id, len(l) as number, array_to_string(list_transform(l, lambda x: origin || x), ' ') as images from p""")
def page_images(spark, d):
    pages = table(spark, d, "pages").withColumn("number", F.size(F.regexp_extract_all("html", F.lit(extraction.RULES["links"].pattern), F.lit(1))))
    return extraction.page_images(pages, "page_id", "number", "url", "html", extraction.RULES["links"]).select("page_id", "number", F.array_join("image_urls", " ").alias("images"))


@query("select p_partkey, 100.0::double * best as rank from part left join (select l_partkey, min(l_suppkey) as best from lineitem where l_quantity > 45 group by 1) on l_partkey = p_partkey")
def ranked_titles(spark, d):
    """Titles with the rank that another listing gives them; that lists lines of more than 45 pieces only."""
    ranks = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("rank"))
    return extraction.ranked_titles(table(spark, d, "part").select("p_partkey"), ranks, "p_partkey", "rank", 100.0)


@query("""select event_id, case when p and status <> 500 then 500 else status end as status, used and (status >= 400 or p) as drops from (select event_id, value < 5 as p, user_id < 20 as used, case event_type when 'error' then 500 when 'signup' then 404 else 200 end as status from events)""")
def fetch_outcomes(spark, d):
    """The status that a fetch counts as, and whether its endpoint goes."""
    partial, used = F.col("value") < 5, F.col("user_id") < 20
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).otherwise(200)
    return table(spark, d, "events").select("event_id", X.fetch_status(status, partial, [500]).alias("status"), X.drops_endpoint(status, partial, F.lit(False), used).alias("drops"))


# Search


_TITLE_HITS = """a as (select l_partkey, string_agg(distinct s_name, ' ' order by s_name) as alternatives from lineitem join supplier on s_suppkey = l_suppkey group by 1),
t as (select p_partkey, p_name, p_brand, coalesce(alternatives, '') as alternatives, source from part left join a on l_partkey = p_partkey join (select p_brand, max(p_type) as source from part group by 1) using (p_brand)),
m as (select *, list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as a, list_filter(string_split_regex(lower(alternatives || ' ' || source), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as b from t),
h as (select p_partkey, p_name, source, round(len(list_filter(a, lambda x: starts_with(x, 'wid'))) + 0.1::double * len(list_filter(b, lambda x: starts_with(x, 'wid'))) + len(list_filter(a, lambda x: starts_with(x, '000000001'))) + 0.1::double * len(list_filter(b, lambda x: starts_with(x, '000000001'))), 6) as rank,
len(list_filter(a || b, lambda x: starts_with(x, 'wid'))) > 0 as p, len(list_filter(a || b, lambda x: starts_with(x, '000000001'))) > 0 as q from m)"""


@query("select p_partkey, p_name from part order by p_retailprice desc, p_partkey limit 25 offset 25")
def browse_newest(spark, d):
    """A query that is malformed shows a page of the newest titles instead."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    return search.browse(parts, "(wid or", parts.orderBy(F.desc("p_retailprice"), "p_partkey"), "p_partkey", "p_name", "p_brand", offset=25, limit=25).select("p_partkey", "p_name")


# Streams, each run until the tables' files are read


@query("""select o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_linestatus = 'F') or o_custkey in (select c_custkey from customer where c_acctbal >= 0)""")
def latest_stream(spark, d):
    """The stored issues after a stream of incoming ones has added those of known titles."""
    orders = lambda rows: rows.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("seen"))
    finished = table(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    path = scratch(spark)
    orders(table(spark, d, "orders")).join(finished, "o_orderkey", "left_semi").write.parquet(path)
    titles = table(spark, d, "customer").where("c_acctbal >= 0")
    latest_sync(orders(table_stream(spark, d, "orders")), "seen", "o_orderkey", titles, "o_custkey", "c_custkey", path, scratch(spark)).awaitTermination()
    return spark.read.parquet(path).select("o_orderkey", "o_custkey")


@query("""with w as (select user_id, date_trunc('hour', ts)::timestamp + interval 1 hour * (i - 21) as begin from events, range(0, 22) r(i))
select user_id, begin, count(*) as n from w where begin + interval 23 hour <= (select max(ts) from events) group by all""")
def usage_stream(spark, d):
    """Sliding usage counts as a stream writes them: the windows that are over, an hour's delay allowed for."""
    events = table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch(spark)
    counts = usage(events, "ts", "user_id").select("user_id", F.col("window.start").alias("begin"), "n")
    counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path).select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), "n")


# Files, written from the tables and read again


@query("""select distinct '10.' || (c_custkey // 250) % 250 || '.' || c_nationkey || '.' || c_custkey % 250 || ':' || (8000 + c_nationkey) as endpoint from customer""")
def endpoint_list(spark, d):
    """Endpoints out of lists, plain ones and zipped ones with markup, local ones left out."""
    key = F.col("c_custkey")
    host = F.format_string("10.%d.%d.%d:%d", F.floor(key / 250) % 250, "c_nationkey", key % 250, F.col("c_nationkey") + 8000)
    users, plain, zipped = table(spark, d, "customer"), scratch(spark), scratch(spark)
    users.where("c_acctbal >= 0").select(F.concat(host, F.lit(" 127.0.0.1:8080")).alias("value")).write.text(plain)
    users.select(F.concat(F.lit("<e>"), host, F.lit("</e>")).alias("value")).write.option("compression", "gzip").text(zipped)
    return endpoints(spark, plain, zipped)


@query("select p_partkey, p_name, p_retailprice from part")
def snapshot_copy(spark, d):
    """A compressed snapshot, read back."""
    parts, path = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), scratch(spark)
    snapshot(parts, path)
    return spark.read.schema(parts.schema).json(path)


@query("select c_mktsegment, c_nationkey, count(*) as n, max(c_acctbal) as best from customer group by all")
def refreshed_view(spark, d):
    """A derived table by segment, of which one segment is computed anew and replaced in one step."""
    path = scratch(spark)
    view = lambda rows: rows.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("best"))
    users = table(spark, d, "customer")
    managed.create(view(users.where("c_acctbal >= 0 or c_mktsegment <> 'BUILDING'")), path, "c_mktsegment")
    managed.refresh(view(users.where("c_mktsegment = 'BUILDING'")), path, ["BUILDING"])
    return managed.read(spark, path)


@query("select count(*)::bigint as errors from events where event_type = 'error'")
def error_log_files(spark, d):
    path = scratch(spark)
    lines = table(spark, d, "events").select(rendered_log(F.col("ts"), F.upper("event_type"), F.col("event_id").cast("string")).alias("value"))
    lines.write.text(path)
    return error_logs(spark, path).agg(F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))


@query("""select event_type, strftime(ts, '%Y-%m-%d') as day, sum(strlen(strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') || ' ' || upper(event_type) || ' ' || event_id) + 1)::bigint as bytes from events where event_type <> 'error' group by 1, 2
having date_trunc('millisecond', max(ts)) < (select max(ts) from events) - interval 12 day""")
def old_log_sizes(spark, d):
    """Bytes of the log files, one a day and kind of event, that a cleaning at the last event's time removes: those
    last written 12 days before, but files with errors stay. Files are as old as their last event."""
    path, day = scratch(spark), F.date_format("ts", "yyyy-MM-dd").alias("day")
    events = table(spark, d, "events")
    lines = events.select("event_type", day, rendered_log(F.col("ts"), F.upper("event_type"), F.col("event_id").cast("string")).alias("value"))
    lines.repartition("event_type", "day").write.partitionBy("event_type", "day").text(path)
    last = events.groupBy("event_type", day).agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("at"))
    set_times(spark, {f"{path}/event_type={r['event_type']}/day={r['day']}": r["at"] for r in last.collect()})
    asof = F.lit(events.agg(F.max("ts").cast("string")).first()[0]).cast("timestamp")
    old = retention.old_files(files(spark, path), asof, 12, error_logs(spark, path))
    part = lambda name: F.regexp_extract("path", f"{name}=([^/]*)/", 1).alias(name)
    return old.groupBy(part("event_type"), part("day")).agg(F.sum("length").alias("bytes"))
