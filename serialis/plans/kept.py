"""Tables that queries make of the given ones and keep, and the queries on them."""

from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from serialis.operators import extraction, index, nested, packing, paging, running, search
from serialis.plans.queries import _HITS, query
from serialis.plans.records import _TITLE_HITS
from serialis.sources import io, managed
from serialis.sources.io import scratch, table
from serialis.streaming import keyed

_made: dict[tuple, str] = {}


def kept(spark: SparkSession, d: str, names: Sequence[str], what: str, make: Callable[[str], None]) -> str:
    """The path of what is made of tables, made once in a session and again when a table's files change."""
    state = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size = files.getContentSummary(path)
        state.append((name, size.getLength(), size.getFileCount(), files.getFileStatus(path).getModificationTime()))
    key = (spark.sparkContext.applicationId, d, what, *state)
    if key not in _made:
        made = scratch(spark)
        make(made)
        _made[key] = made
    return _made[key]


def _search_table(spark, d) -> str:
    """The search table of the documents: sources are their names."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return kept(spark, d, ["documents"], "search table", lambda path: index.build(docs, path, "doc_id", "source", "text", files=32))


@query(f"with {_HITS} select doc_id, source, round(rank, 6) as rank from m where p and (q or not r) order by round(rank, 6) desc, source, doc_id limit 25")
def search_page(spark, d):
    return index.page(spark, _search_table(spark, d), "src1 (tion or not zu)", "doc_id", "source")


@query(f"with {_HITS} select count(*) as n from m where p and (q or not r)")
def search_count(spark, d):
    return index.ranks(spark, _search_table(spark, d), "src1 (tion or not zu)", "doc_id").agg(F.count(F.lit(1)).alias("n"))


_SEVERAL = ["tion", "the of", "src2 tion", "ent or zu", "not the"]
_SEVERAL_SQL = r"""with t as (select *, list_filter(string_split_regex(lower(source), '[^\p{L}\p{N}]+'), lambda x: x <> '') as a, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as b from documents),
w as (select unnest(['tion', 'the', 'of', 'src2', 'ent', 'zu']) as w),
h as (select doc_id, source, w, len(list_filter(a, lambda x: starts_with(x, w))) + 0.1::double * len(list_filter(b, lambda x: starts_with(x, w))) as h from t, w),
m as (select doc_id, source, max(h) filter (w = 'tion') as tion, max(h) filter (w = 'the') as the, max(h) filter (w = 'of') as "of", max(h) filter (w = 'src2') as src2, max(h) filter (w = 'ent') as ent, max(h) filter (w = 'zu') as zu from h group by 1, 2),
q as (select 'tion' as query, doc_id, source, tion as rank from m where tion > 0 union all select 'the of', doc_id, source, the + "of" from m where the > 0 and "of" > 0 union all select 'src2 tion', doc_id, source, src2 + tion from m where src2 > 0 and tion > 0
union all select 'ent or zu', doc_id, source, ent + zu from m where ent > 0 or zu > 0 union all select 'not the', doc_id, source, the from m where the = 0)
select query, row_number() over (partition by query order by round(rank, 6) desc, source, doc_id) as place, doc_id, source, round(rank, 6) as rank from q qualify place <= 10"""


@query(_SEVERAL_SQL)
def search_several(spark, d):
    """The ten best documents of several queries, out of the blocks whose bounds reach them."""
    return index.several(spark, _search_table(spark, d), _SEVERAL, "doc_id", "source", 10)


def _title_search_table(spark, d) -> str:
    """The search table of the titles: parts with the names of their suppliers and their brand's facts."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    names = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_partkey").alias("p_partkey"), F.col("s_name").alias("alternative")).distinct()
    sources = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_type").alias("source"))
    docs = search.title_documents(parts, names, sources, "p_partkey", "p_name", "p_brand")
    return kept(spark, d, ["part", "lineitem", "supplier"], "titles", lambda path: index.build(docs, path, "p_partkey", "p_name", "alternatives", "source", keep=["source"]))


@query(f"with {_TITLE_HITS} select p_partkey, p_name, source, rank from h where p or q order by rank desc, p_name, p_partkey limit 50")
def search_titles(spark, d):
    """A page of titles by name, alternative names and source's facts, through the search table."""
    return index.page(spark, _title_search_table(spark, d), "wid or 000000001", "p_partkey", "p_name", limit=50).select("p_partkey", "p_name", "source", "rank")


@query(f"with {_TITLE_HITS} select p_partkey from h where not p")
def search_without(spark, d):
    """Titles that hold none of a query's words, by name, alternative names or facts."""
    return index.ranks(spark, _title_search_table(spark, d), "not wid", "p_partkey").select("p_partkey")


# Pages deep in a long order


_LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"""with n as (select count(*) as n from lineitem) select l_shipdate, {", ".join(_LINES)}, ceil(n / 40)::bigint as number, ceil(n / 40)::bigint as pages
from (select *, row_number() over (order by l_shipdate desc, {", ".join(_LINES)}) as rn from lineitem), n where rn > (ceil(n / 40) - 1) * 40""")
def last_page_of_lines(spark, d):
    """The last page of all lines, newest first, of 40 lines a page; at most 500 rows are sorted."""
    lines = table(spark, d, "lineitem").select("l_shipdate", *_LINES)
    rows, facts = paging.numbered_page(lines, [paging.By("l_shipdate", descending=True), *_LINES], 0, 40, most=500)
    return rows.withColumns({k: F.lit(facts[k]).cast("long") for k in ("number", "pages")})


@query("""with p as (select case when p_size % 3 = 0 then null else p_name end as name, p_partkey from part), n as (select count(*) // 2 as half from p)
select name, p_partkey from (select *, row_number() over (order by name desc nulls last, p_partkey) as rn from p), n where rn > half and rn <= half + 30""")
def middle_of_titles(spark, d):
    """Thirty titles from the middle of all, by name from the end, nameless ones last."""
    parts = table(spark, d, "part").select(F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("name"), "p_partkey")
    return paging.deep_page(parts, [paging.By("name", descending=True), "p_partkey"], parts.count() // 2, 30, most=100)


@query("""with r as (select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as place from orders), x as (select max(o_orderkey) as k from orders where o_orderstatus = 'P')
select k as o_orderkey, place::bigint as place, (place // 25 + 1)::bigint as page from r join x on k = o_orderkey""")
def page_of_one(spark, d):
    """The page on which the newest open order stands, by price."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    newest = table(spark, d, "orders").where("o_orderstatus = 'P'").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), "o_orderkey").alias("r")).select("r.*").first()
    place = paging.position(orders, ["o_totalprice", "o_orderkey"], newest.asDict())
    return spark.range(1).select(F.lit(newest["o_orderkey"]).alias("o_orderkey"), place.alias("place")).withColumn("page", F.floor(F.col("place") / 25) + 1)


# Groups of any size


@query("""with p as (select o_orderstatus as shelf, o_orderkey, floor(o_totalprice)::bigint as n, row_number() over (partition by o_orderstatus order by o_orderkey) as i from orders
union all select 'all', o_orderkey, floor(o_totalprice)::bigint, row_number() over (order by o_orderkey) from orders),
s as materialized (select *, (sum(n) over (partition by shelf order by i))::bigint as upto, (sum(n) over (partition by shelf))::bigint as total from p),
c as (with recursive c as (select shelf, 1::bigint as i, 0::bigint as gone, total from s where i = 1
  union all select shelf, i, gone, total from (select c.shelf, s.i, s.upto - s.n as gone, c.total, row_number() over (partition by c.shelf order by s.i) as k from c join s on s.shelf = c.shelf and s.i > c.i and s.upto - s.n > c.gone + 1 + c.total // (1 + c.total // 90000000)
  where c.total > 90000000) where k = 1) select * from c),
v as (select s.shelf, s.o_orderkey, s.n, (select count(*) from c where c.shelf = s.shelf and c.i <= s.i)::int as volume from s)
select shelf, volume, count(*) as pages, min(o_orderkey) as first, max(o_orderkey) as last, sum(n)::bigint as size from v group by all""")
def long_volumes(spark, d):
    """Few documents of very many pages: the orders of a status, and all orders."""
    orders = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", F.floor("o_totalprice").alias("n"))
    pages = orders.withColumnRenamed("o_orderstatus", "shelf").union(orders.select(F.lit("all"), "o_orderkey", "n"))
    packed = packing.volumes(pages, "shelf", "o_orderkey", "n", 90_000_000, long=1000, ranges=24)
    return packed.groupBy("shelf", "volume").agg(F.count(F.lit(1)).alias("pages"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.sum("n").alias("size"))


@query("""select distinct user_id, ts, count(*) over (partition by user_id, ts) as uses, greatest(0, 4 - count(*) over (partition by user_id order by ts range between interval 22 hour preceding and current row)) as remains from events""")
def quota_over_time(spark, d):
    """What is left of a quota of four at every user's own times."""
    counts = running.rolling_counts(table(spark, d, "events"), "user_id", "ts", 22)
    return counts.select("user_id", "ts", "uses", F.greatest(F.lit(0), 4 - F.col("used")).alias("remains"))


@query("""select event_type, ts, count(*) as uses, any_value(used) as used from (select event_type, ts, count(*) over (partition by event_type order by ts range between interval 22 hour preceding and current row) as used from events) group by all""")
def busy_kinds(spark, d):
    """The same for few groups with very many uses each."""
    return running.rolling_counts(table(spark, d, "events"), "event_type", "ts", 22, ranges=24)


# Records with their relations


_NESTED_SQL = """so as (select o_orderkey as id, o_custkey as owner, o_orderpriority as shelf, o_orderdate as created from orders where o_orderstatus <> 'O' or o_orderkey % 3 > 0),
io as (select o_orderkey as id, case when o_totalprice > 100000 then null when o_orderstatus = 'P' then -o_custkey else o_custkey end as owner, o_orderpriority as shelf from orders where o_orderstatus <> 'P' or o_orderkey % 2 = 0),
sl as (select l_orderkey as id, l_linenumber as n, min(l_quantity) as q from lineitem where l_linenumber > 1 and l_orderkey in (select id from so) group by all),
il as (select l_orderkey as id, l_linenumber as n, min(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as q from lineitem where l_linenumber < 5 and l_orderkey in (select id from io) group by all),
st as (select l_orderkey as id, list(distinct l_returnflag) as tags from lineitem where l_orderkey in (select id from so) group by 1), it as (select l_orderkey as id, list_distinct(list(l_linestatus)) as tags from lineitem where l_orderkey in (select id from io) group by 1),
c as (select id, n, s.id is null as new, i.id is null as gone, s.q as sq, i.q as iq from sl s full join il i using (id, n)),
k as (select id, count(*) filter (new) as inserted, count(*) filter (gone) as deleted, count(*) filter (not new and not gone and sq = iq) as unchanged, count(*) filter (not new and not gone and sq <> iq) as changed, sum(iq) as quantity, sum(sq) as old_quantity from c group by id),
t as (select id, coalesce(st.tags, []) as old_tags, list_filter(coalesce(it.tags, []), lambda x: x <> 'O') as tags, list_filter(coalesce(it.tags, []), lambda x: x <> 'O' and not list_contains(coalesce(st.tags, []), x)) as added, list_filter(coalesce(st.tags, []), lambda x: not (list_contains(coalesce(it.tags, []), x) and x <> 'O')) as removed from st full join it using (id))"""


def _nested_titles(spark, d):
    """Orders as titles, their lines as issues and return flags as tags: what is stored, and what came."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    by_line = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("old"), F.min(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("new"))
    issue = lambda c: F.struct(F.col("l_linenumber").alias("number"), F.col(c).alias("quantity"))
    issues = by_line.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(F.col("l_linenumber") > 1, issue("old"))).alias("stored"), F.collect_list(F.when(F.col("l_linenumber") < 5, issue("new"))).alias("came"))
    tags = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_linestatus").alias("states"))
    titles = orders.withColumnRenamed("o_orderkey", "id").join(issues, "id", "left").join(tags, "id", "left")
    stored = titles.where("o_orderstatus <> 'O' or id % 3 > 0").select("id", F.col("o_custkey").alias("owner"), F.col("o_orderpriority").alias("shelf"), F.col("stored").alias("issues"), F.col("flags").alias("tags"), F.col("o_orderdate").alias("created"), F.col("o_orderdate").alias("modified"))
    owner = F.when(F.col("o_totalprice") > 100000, None).when(F.col("o_orderstatus") == "P", -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    came = titles.where("o_orderstatus <> 'P' or id % 2 = 0").select("id", owner.alias("owner"), F.col("o_orderpriority").alias("shelf"), F.col("came").alias("issues"), F.col("states").alias("tags"), F.array(F.lit("F"), F.lit("N")).alias("known"))
    return stored, came


def _nested(spark, d):
    stored, came = _nested_titles(spark, d)
    return nested.sync_records(stored, came, ["id"], ["owner", "shelf"], [nested.Relation("issues", "number"), nested.Links("tags", "known")], F.lit("2002-01-01").cast("timestamp_ntz"))


@query(f"""with {_NESTED_SQL} select id, case when io.id is null then 'absent' when so.id is null then 'insert' when (io.owner is not null and io.owner <> so.owner) or inserted + deleted + changed > 0 or len(added) + len(removed) > 0 then 'update' else 'keep' end as action,
case when io.id is null then 0 else coalesce(inserted, 0) end as inserted, case when io.id is null then 0 else coalesce(changed, 0) end as changed, case when io.id is null then 0 else coalesce(unchanged, 0) end as unchanged, case when io.id is null then 0 else coalesce(deleted, 0) end as deleted,
case when io.id is null then '' else array_to_string(list_sort(coalesce(added, [])), ',') end as added, case when io.id is null then '' else array_to_string(list_sort(coalesce(removed, [])), ',') end as removed
from so full join io using (id) left join k using (id) left join t using (id)""")
def nested_log(spark, d):
    """What a sync of titles with their issues and tags does to each."""
    of = lambda column, action: F.filter(f"{column}_log", lambda x: x["action"] == action)
    count = lambda action: F.size(of("issues", action)).cast("long")
    names = lambda action: F.array_join(F.sort_array(F.transform(of("tags", action), lambda x: x["key"])), ",")
    return _nested(spark, d).select("id", "action", count("insert").alias("inserted"), count("update").alias("changed"), count("keep").alias("unchanged"), count("delete").alias("deleted"), names("insert").alias("added"), names("delete").alias("removed"))


@query(f"""with {_NESTED_SQL} select id, coalesce(io.owner, so.owner) as owner, coalesce(io.shelf, so.shelf) as shelf, coalesce(case when io.id is null then old_quantity else quantity end, 0) as quantity, array_to_string(list_sort(coalesce(case when io.id is null then old_tags else tags end, [])), ',') as tags,
coalesce(created, timestamp '2002-01-01') as created, case when io.id is null then created else timestamp '2002-01-01' end as modified from so full join io using (id) left join k using (id) left join t using (id)""")
def nested_titles(spark, d):
    """The titles after it."""
    quantity = F.aggregate("issues", F.lit(0.0), lambda total, x: total + x["quantity"])
    return nested.table_of(_nested(spark, d)).select("id", "owner", "shelf", F.coalesce(quantity, F.lit(0.0)).alias("quantity"), F.coalesce(F.array_join(F.sort_array("tags"), ","), F.lit("")).alias("tags"), "created", "modified")


# Tables in partitions behind a manifest


def _orders_by_year(spark, d, path) -> None:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", F.year("o_orderdate").alias("year"))
    managed.create(orders.where("o_orderkey % 10 > 0 or year < 1998"), path, "year", time="o_orderdate")


_CAME = """c as (select o_orderkey, o_custkey, case when o_orderstatus = 'O' then -o_totalprice else o_totalprice end as o_totalprice, o_orderdate, year(o_orderdate) as year from orders where year(o_orderdate) >= 1998),
s as (select o_orderkey, o_custkey, o_totalprice, o_orderdate, year(o_orderdate) as year from orders where o_orderkey % 10 > 0 or year(o_orderdate) < 1998)"""


def _came(spark, d):
    year = F.year("o_orderdate")
    price = F.when(F.col("o_orderstatus") == "O", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return table(spark, d, "orders").where(year >= 1998).select("o_orderkey", "o_custkey", price.alias("o_totalprice"), "o_orderdate", year.alias("year"))


@query(f"with {_CAME} select * from c union all select * from s where o_orderkey not in (select o_orderkey from c)")
def partition_merge(spark, d):
    """Orders after a merge of the last years' newer rows: earlier years keep their files."""
    path = scratch(spark)
    _orders_by_year(spark, d, path)
    managed.merge(spark, path, _came(spark, d), ["o_orderkey"])
    return managed.read(spark, path)


@query(f"with {_CAME} select o_orderkey, case when s.o_custkey is null then 'insert' when c.o_custkey is null then 'delete' when s.o_totalprice = c.o_totalprice then 'keep' else 'update' end as action from s full join c using (o_orderkey)")
def partition_sync_log(spark, d):
    """The log of the same as a full sync: orders that don't come go."""
    path = scratch(spark)
    _orders_by_year(spark, d, path)
    return managed.merge(spark, path, _came(spark, d), ["o_orderkey"], deletes=True)


@query("""select l_orderkey, l_linenumber, l_partkey, l_shipdate, strftime(l_shipdate, '%Y-%m') as month from lineitem where l_shipdate >= (select max(l_shipdate) from lineitem) - interval 1000 day""")
def partition_retention(spark, d):
    """Lines that are not too old, by months: old months are dropped unread, one is rewritten."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    path = scratch(spark)
    managed.create(lines, path, "month", time="l_shipdate")
    newest = lines.agg(F.max("l_shipdate").cast("string")).first()[0]
    managed.expire(spark, path, F.lit(newest).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(1000)))
    return managed.read(spark, path)


# State by key, and dumps


@query("""with e as (select user_id, ts, event_type = 'error' as failed, lag(ts) over (partition by user_id order by ts) as before from events),
g as (select *, sum(case when before is null or ts > before + interval 12 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as life from e),
l as (select user_id, min(ts) as first, max(ts) as last, count(*) as uses, count(*) filter (failed) as failures from g group by user_id, life)
select *, failures > 3 as dropped from l where last + interval 12 hour < date_trunc('millisecond', (select max(ts) from events)) - interval 1 hour""")
def lives_stream(spark, d):
    """How long users stay in use, 12 hours after the last one, and whether too much failed: by a stream in four
    batches, which stops after each and goes on from its checkpoint. A life whose time ends with the last watermark
    itself, to the microsecond, isn't over yet."""
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    at = F.unix_micros("ts")
    told = events.agg(F.percentile_approx(at, [0.25, 0.5, 0.75]).alias("cuts"), F.unix_millis(F.max("ts")).alias("newest")).first()
    cuts = [None, *(told["cuts"] or []), None]
    source, path, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        events.where((F.lit(low is None) | (at > (low or 0))) & (F.lit(high is None) | (at <= (high or 0)))).write.mode("append").parquet(source)
        lives = keyed.lives(spark.readStream.schema(events.schema).parquet(source), "user_id", "ts", "failed", 12 * 3600)
        keyed.run(lives, path, checkpoint)
    over = F.unix_micros("last") < ((told["newest"] or 0) - 13 * 3_600_000) * 1000
    return spark.read.schema(lives.schema).parquet(path).where(over).select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")), "uses", "failures", "dropped")


@query("""select o_orderkey as pk, o_orderpriority as name, o_custkey as owner, case when o_orderstatus = 'P' then 0 else o_totalprice end as price, '{"' || o_orderstatus || '}, {' as note from orders""")
def dump_rows(spark, d):
    """Orders written as dumps, arrays of records of two models, and read again by byte ranges."""
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))  # null fields aren't written
    note = F.concat(F.lit('{"'), "o_orderstatus", F.lit("}, {"))
    order = F.struct(F.lit("core.order").alias("model"), F.col("o_orderkey").alias("pk"), F.struct(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("owner"), price.alias("price"), note.alias("note")).alias("fields"))
    owner = F.struct(F.lit("core.owner").alias("model"), F.col("c_custkey").alias("pk"), F.struct(F.col("c_name").alias("name")).alias("fields"))
    rows = table(spark, d, "orders").select(F.to_json(order).alias("value")).union(table(spark, d, "customer").select(F.to_json(owner)))
    path = scratch(spark)
    io.write_dump(rows, "value", path)
    fields = StructType().add("name", "string").add("owner", "long").add("price", "double").add("note", "string")
    return io.dump(spark, path, "core.order", fields, {"price": 0.0})


# Pages of titles, rendered from the tables as sources show them, and their records


def _title_pages(spark, d):
    """A page for every customer as a title, its orders as issues, newest first."""
    cell = lambda label, value: F.concat(F.lit(f"<tr><td>{label}</td>\n<td> "), value, F.lit("</td></tr>"))
    escaped = lambda c: F.replace(c, F.lit("#"), F.lit("&#35;"))
    row = F.concat(F.lit('<tr class="issue"><td><a href="/'), F.col("o_orderkey"), F.lit('">Ch. '), F.col("o_orderkey"), F.lit("</a> : x</td><td>"), F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit("</td></tr>"))
    newest = F.transform(F.array_sort(F.collect_list(F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey", row.alias("row")))), lambda x: x["row"])
    issues = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(newest, "").alias("issues"))
    titles = table(spark, d, "customer").join(issues, F.col("c_custkey") == F.col("o_custkey"), "left")
    name, kind = escaped("c_name"), F.col("c_mktsegment")
    html = F.concat(
        F.lit('<h2 class="aname">'), name, F.lit("</h2><table>"), cell("Alternate Name:", F.concat(kind, F.lit(", "), F.lower(kind), F.lit("; "), name)), cell("Author:", F.concat(F.lit("Author of "), name)), cell("Artist:", F.lit("")),
        cell("Reading Direction:", F.when(F.col("c_nationkey") > 12, "Right to Left").otherwise("Left to Right")), cell("Status:", F.when(F.col("c_acctbal") < 0, "Completed").otherwise("Ongoing")), F.lit('</table><span class="genretags">'), kind,
        F.lit('</span><span class="genretags">N'), F.col("c_nationkey"), F.lit('</span><div id="readmangasum"><h3>About</h3><p>Of <b>'), name, F.lit('</b>!</p></div><div id="mangaimg"><img alt="" src="../c/'), F.col("c_custkey"), F.lit('.jpg"></div><table>'), F.coalesce("issues", F.lit("")),
        F.lit('</table><div id="sp"><a href="?p=1">&lt;</a><a href="?p='), F.col("c_custkey") + 1, F.lit('">'), F.when(F.col("c_custkey") % 5 > 0, "&gt;").otherwise("last"), F.lit("</a></div>"),
    )
    return titles.select("c_custkey", F.concat(F.lit("http://host/t/"), F.col("c_custkey")).alias("url"), html.alias("html"))


@query("""select c_custkey, 'http://host/t/' || c_custkey as url, c_name as name, c_mktsegment || '|' || lower(c_mktsegment) || '|' || c_name as alternatives, 'Author of ' || c_name as author, '' as artist, case when c_nationkey > 12 then 'RL' else 'LR' end as reading_direction,
case when c_acctbal < 0 then 'Completed' else 'Ongoing' end as status, c_mktsegment || '|N' || c_nationkey as genres, 'Of ' || c_name || '!' as description, 'http://host/c/' || c_custkey || '.jpg' as images, count(o_orderkey) as n_issues,
coalesce(string_agg(o_orderkey || '@' || strftime(o_orderdate, '%m/%d/%Y'), ' ' order by o_orderdate desc, o_orderkey), '') as issues from customer left join orders on o_custkey = c_custkey group by all""")
def title_records(spark, d):
    """The eleven fields of a title's page. Pages are rendered from the tables first: a round trip."""
    records = extraction.labelled_records(_title_pages(spark, d), "url", "html")
    joined = lambda c: F.array_join(c, "|")
    issues = F.array_join(F.transform("issues", lambda x: F.concat(x["number"], F.lit("@"), x["release"])), " ")
    return records.select("c_custkey", "url", "name", joined("alt_name").alias("alternatives"), "author", "artist", "reading_direction", "status", joined("genres").alias("genres"), "description", joined("image_urls").alias("images"), F.size("issues").cast("long").alias("n_issues"), issues.alias("issues"))


@query("select c_custkey, case when c_custkey % 5 > 0 then 'http://host/t/' || c_custkey || '?p=' || (c_custkey + 1) end as next from customer")
def next_links(spark, d):
    """The link that each page's arrow leads to; pages without one are the last."""
    return _title_pages(spark, d).select("c_custkey", extraction.next_page(F.col("html"), F.col("url")).alias("next"))
