import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from serialis.functions import cleaning as C
from serialis.functions import text as X
from serialis.operators import extraction, listing, merging, packing, planning, retention, search
from serialis.plans import kept, records  # noqa: F401
from serialis.plans.queries import ORACLE_SQL, QUERIES
from serialis.sources import io
from serialis.streaming.latest import latest_sync

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def one(spark, column, **given):
    """A column's value over one row of strings."""
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)) if given else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    found = QUERIES[name](spark, DATA)
    wanted = oracle.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    key = lambda r: [str(x) for x in r]
    left = sorted(([plain(r[c]) for c in columns] for r in found.collect()), key=key)
    at = [wanted.columns.index(c) for c in columns]
    right = sorted(([plain(r[i]) for i in at] for r in wanted.fetchall()), key=key)
    assert left == right


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Today", dt.date(2015, 1, 1)), ("Yesterday", dt.date(2014, 12, 31)), ("Just now", dt.date(2015, 1, 1)), ("90 minutes ago", dt.date(2014, 12, 31)), ("an hour ago", dt.date(2015, 1, 1)),
        ("2 hours ago", dt.date(2014, 12, 31)), ("3 days ago", dt.date(2014, 12, 29)), ("a week ago", dt.date(2014, 12, 25)), ("1 month ago", dt.date(2014, 12, 2)), ("2 years ago", dt.date(2013, 1, 1)),
        ("27 October 2014 - 07:14 PM", dt.date(2014, 10, 27)), ("24 Nov 2014", dt.date(2014, 11, 24)), ("Nov 4, 2014 09:14am", dt.date(2014, 11, 4)), ("Nov 4, 2014", dt.date(2014, 11, 4)),
        ("4-11-2014", dt.date(2014, 11, 4)), ("11/4/2014", dt.date(2014, 11, 4)), ("2014-11-04T01:02:03+00:00", dt.date(2014, 11, 4)), ("2014-11-04 01:02:03 UTC", dt.date(2014, 11, 4)), ("someday", None), (None, None),
    ],
)
def test_dates(spark, text, wanted):
    asof = F.lit("2015-01-01 01:00:00").cast("timestamp")
    assert one(spark, C.parse_date(F.col("t"), asof), t=text) == wanted


def test_day_first(spark):
    assert one(spark, C.parse_date(F.col("t"), F.current_timestamp(), True), t="4/11/2014") == dt.date(2014, 11, 4)


@pytest.mark.parametrize(("text", "wanted"), [("1st", 1), ("22nd", 22), ("1,234", 1234), ("1.5k", 1500), ("2m", 2e6), ("-1.5", -1), ("x", None), ("", None)])
def test_numbers(spark, text, wanted):
    assert one(spark, C.parse_number(F.col("t"), as_int=True), t=text) == wanted


def test_strings_and_lists(spark):
    assert one(spark, C.clean_str(F.col("t")), t=" <b>a &amp;lt; b</b> ") == "a &lt; b"
    assert one(spark, C.clean_str(F.col("t")), t="<br>") is None
    assert one(spark, C.clean_str(F.col("t"), max_length=4), t="<b>abc") == "a"
    assert one(spark, C.clean_list(F.split("t", ","), exclude=["All", ""]), t=" a,All,, b") == ["a", "b"]
    assert one(spark, C.as_str(F.split("t", ",")), t=" a , b ") == "a b"
    assert one(spark, C.clean_enum(F.col("t"), C.LANGUAGES), t="en") == "EN"
    assert one(spark, C.clean_enum(F.col("t"), C.LANGUAGES, C.BY_NAME, optional=True), t="Klingon") == "Klingon"
    assert one(spark, C.without_kind(F.col("t")), t="Some Name Manga") == "Some Name"
    assert one(spark, C.first_page(F.col("t")), t="http://a/b/c/7.html") == "http://a/b/c/1.html"
    assert one(spark, C.split_names(F.split("t", ",")), t="a; b,;c") == ["a", "b", "c"]
    assert one(spark, C.direction(F.col("t")), t="Manhwa") == "LR"
    assert one(spark, C.without_zeros(F.col("t")), t="007 v00") == "7 v00"


GOLDEN = [
    ("Manga 1 - title", "1", None, "Manga 001: title"), ("manga 1 - title", "1", None, "Manga 001: title"), ("title", "1", None, "Manga 001: title"), ("Manga 1", "1", None, "Manga 001"), ("Manga 99.11", "99.11", None, "Manga 099.11"),
    ("Manga 1: title", "1", None, "Manga 001: title"), ("manga 1 Vol.1 title", "1", None, "Manga 001: title"), ("manga 1 vol.1 title", "1", None, "Manga 001: title"), ("Manga 1 Ch.1 title", "1", None, "Manga 001: title"),
    ("Manga 1 Ch1 Vol 1 title", "1", None, "Manga 001: title"), ("Manga 1 Ch.1 title", "1", (1, 1), "Manga 001 (01/01): title"), ("Manga 1 Ch.1", "1", (1, 1), "Manga 001 (01/01)"), ("Manga 1a - title", "1a", None, "Manga 001a: title"),
    ("Manga 1.1a - title", "1.1a", None, "Manga 001.1a: title"), ("Manga a - title", "a", None, "Manga 000a: title"), ("Manga - title", "", None, "Manga: title"), ("title", "", None, "Manga: title"),
    ("Vol 1.5 Ch 10.5: Name", "10.5", None, "Manga 010.5: Name"), ("1984", "1", None, "Manga 001: 984"),
]


def test_titles(spark):
    rows = spark.createDataFrame([(k, i, n, v is not None, *(v or (0, 0)), w) for k, (i, n, v, w) in enumerate(GOLDEN)], "k int, issue string, number string, multi boolean, vol int, total int, wanted string")
    shown = X.display_title(F.lit("Manga"), *(F.col(c) for c in ("issue", "number", "multi", "vol", "total")))
    assert values(rows.select("k", shown.alias("v")), "k") == [(k, g[3]) for k, g in enumerate(GOLDEN)]
    assert one(spark, X.display_title(F.col("a"), F.col("b"), F.col("c")), a="T+", b="T+ 3a", c="3a") == "T+ 003a"


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("&eacute;&#8217;&#x27;&#X41;", "é’'A"), ("a &amp;lt; b", "a &lt; b"), ("&nosuch; & &#; &#xD800; &#99999999;", "&nosuch; & &#; &#xD800; &#99999999;"), ("&#119070;&hellip;&apos;", "𝄞…'"), ("plain", "plain"), (None, None), ("", "")],
)
def test_references(spark, text, wanted):
    assert one(spark, C.decoded(F.col("t")), t=text) == wanted


@pytest.mark.parametrize(
    ("link", "wanted"),
    [("x.html", "http://h/a/x.html"), ("/x", "http://h/x"), ("//o/x", "http://o/x"), ("?p=1", "http://h/a/b?p=1"), ("#t", "http://h/a/b?q#t"), ("https://o/", "https://o/"), ("../x.html", "http://h/x.html"), ("./y?u=../z", "http://h/a/y?u=../z"), ("c/../../d", "http://h/d"), ("../../..", "http://h/"), ("", "http://h/a/b?q")],
)
def test_urls(spark, link, wanted):
    assert one(spark, X.absolute_url(F.lit("http://h/a/b?q"), F.col("t")), t=link) == wanted


def test_queries_of_words(spark):
    rows = spark.createDataFrame([(1, "red fox", "blue"), (2, "blue", "red foxes"), (3, "green", "")], "id int, name string, body string")
    found = search.search(rows, "fox", "id", "name", "body")
    assert [r["id"] for r in found.collect()] == [1, 2]
    assert values(search.matches(rows, "not (red or gre)", "name", "body").select("id")) == []
    assert values(search.matches(rows, "blue and not gre", "name", "body").select("id")) == [(1,), (2,)]
    assert [search.is_valid(q) for q in ("a (b or c)", "((a) b)", "(a", "a)", "and a", "a or", "not", "")] == [True, True] + [False] * 6
    found = search.postings(rows, "id", "name", "body")
    assert found.where("id = 1 and weight = 1.0").count() == 2
    for q in ("fox", "not (red or gre)", "blue and not gre", "red or not fox", "gre (fox or not blue)"):
        wanted = values(search.matches(rows, q, "name", "body").select("id", F.round("rank", 6)))
        assert values(search.from_postings(found, rows, q, "id").select("id", F.round("rank", 6))) == wanted


def test_ranges():
    assert listing.parse_ranges("1,3-5,9-10") == [(1, 1), (3, 5), (9, 10)]
    with pytest.raises(ValueError):
        listing.parse_ranges("5-1")


def test_pages_join_to_the_list(spark):
    rows = spark.range(23).orderBy("id")
    assert [r.id for k in (1, 2, 3) for r in listing.page(rows, k, 9).collect()] == list(range(23))
    assert listing.page_count(rows, 9) == 3
    with pytest.raises(ValueError):
        listing.page(rows, 0, 9)


def test_lookups(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "n string, k int")
    assert listing.only(rows, F.col("n") == "a").first()["k"] == 1
    for name in ("b", "c"):
        with pytest.raises(LookupError):
            listing.only(rows, F.col("n") == name)
    with pytest.raises(LookupError):
        listing.among(rows, "n", "a,zz", rows, "n")
    assert values(listing.default_value(rows, "n", "k", "d"), "n") == [("a", 1), ("b", None)]


def test_merging_twice_is_merging_once(spark):
    stored = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "k int, n string, v int")
    new = spark.createDataFrame([(2, "b", 1), (3, "x", 2), (4, "d", None)], "k int, n string, v int")
    assert values(merging.diff(stored, new, ["k"], ["n", "v"]), "k") == [(1, "delete"), (2, "keep"), (3, "update"), (4, "insert")]
    once = merging.upsert(stored, new, ["k"])
    assert values(once) == values(merging.upsert(once, new, ["k"]))
    added = merging.insert_only(stored, new, spark.createDataFrame([("d",)], "name string"), "n", "name", ["k"])
    assert values(added.select("k")) == [(4,)]


def test_soft_delete_and_retention(spark):
    subs = spark.createDataFrame([(1, False), (2, False)], "s int, deleted boolean")
    gone, left = merging.soft_delete(subs, subs.where("s = 1"), "s", spark.createDataFrame([(1, "PR"), (1, "SE"), (2, "PR")], "s int, status string"), "status")
    assert values(gone) == [(1, True), (2, False)] and values(left) == [(1, "SE"), (2, "PR")]
    rows = spark.createDataFrame([(1, [[]]), (2, [["a"]]), (3, [])], "k int, pages array<array<string>>").select("k", F.transform("pages", lambda p: F.struct(p.alias("images"))).alias("pages"))
    assert values(retention.broken(rows, "pages", "images").select("k")) == [(1,)]
    assert one(spark, retention.age_text(F.lit(49))) == "02d 01h"
    assert retention.overflow(spark.range(3).select("id", F.col("id").alias("t")), "t", "id", 3, 2).count() == 0


def test_volumes(spark):
    def volumes(sizes, limit):
        df = spark.createDataFrame([("d", i, s) for i, s in enumerate(sizes)], "g string, i int, s long")
        return [r["volume"] for r in packing.volumes(df, "g", "i", "s", limit).orderBy("i").collect()]

    assert volumes([12_547] * 6, 25_094) == [1, 1, 2, 2, 3, 3]
    assert volumes([5, 5], 10) == [1, 1]
    several = spark.createDataFrame([(g, i, 3 + (i * 7 + (g or 0)) % 5) for g in (1, 2, None) for i in range(50)] + [(4, 0, None)], "g int, i int, s long").repartition(3)
    for g in (1, 2, None):
        mine, total, filled, volume = [3 + (i * 7 + (g or 0)) % 5 for i in range(50)] if g is not None else [r["s"] for r in several.where("g is null").orderBy("i").collect()], 0, 0, 1
        total, wanted = sum(mine), []
        for s in mine:
            if total > 40 and filled > 1 + total // (1 + total // 40):
                filled, volume = 0, volume + 1
            filled += s
            wanted.append(volume)
        assert [r["volume"] for r in packing.volumes(several, "g", "i", "s", 40).where(F.col("g").eqNullSafe(F.lit(g))).orderBy("i").collect()] == wanted


def test_browse(spark):
    rows = spark.createDataFrame([(1, "red fox", "x"), (2, "blue", "y"), (3, "red", "z")], "id int, name string, body string")
    newest = rows.orderBy(F.desc("id"))
    ids = lambda q, **k: [r["id"] for r in search.browse(rows, q, newest, "id", "name", "body", **k).collect()]
    assert (ids("red"), ids(None), ids("(red"), ids("", offset=1, limit=1)) == ([3, 1], [3, 2, 1], [3, 2, 1], [2])


def test_sync_twice_changes_nothing(spark):
    early, late = (F.lit(f"202{k}-01-01").cast("timestamp") for k in (0, 1))
    stored = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, n string").withColumns({"created": early, "modified": early})
    new = spark.createDataFrame([(2, None), (3, "x"), (4, None)], "k int, n string")
    once, log = merging.sync(stored, new, ["k"], ["n"], late)
    assert values(log, "k") == [(1, "delete"), (2, "keep"), (3, "update"), (4, "insert")]
    assert [(r["k"], r["created"].year, r["modified"].year) for r in once.orderBy("k").collect()] == [(2, 2020, 2020), (3, 2020, 2021), (4, 2021, 2021)]
    again, log = merging.sync(once, new, ["k"], ["n"], F.lit("2022-01-01").cast("timestamp"))
    assert values(again, "k") == values(once, "k") and log.where("action <> 'keep'").isEmpty()


def test_outcome_and_quota(spark):
    deliveries = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    cached = spark.createDataFrame([(1, True), (2, False)], "i int, valid boolean")
    mailed = spark.createDataFrame([(1, True), (1, False), (2, True)], "i int, ok boolean")
    assert values(planning.outcome(deliveries, "i", cached, mailed)) == [(1, "FA"), (2, "FA"), (3, "FA")]
    plan = QUERIES["daily_plan"](spark, DATA)
    assert plan.groupBy("owner", "position").count().where("count > 1").isEmpty()


def test_plan_of_a_day(spark):
    """One user at the hour: paused, deleted and disabled subscriptions give nothing, both quotas hold, what was
    sent is left out and what failed is counted up."""
    asof = F.lit("2020-01-02 00:00:00").cast("timestamp")
    users = spark.createDataFrame([(1, 4, -2, 3), (2, 5, 0, 9)], "owner int, send_at int, time_zone int, per_day int")
    subscriptions = spark.createDataFrame(
        [(10, 1, "EN", 2, False, False, True), (11, 1, "EN", 5, True, False, True), (12, 1, "EN", 5, False, True, True), (13, 1, "EN", 5, False, False, False), (14, 1, "ES", 9, False, False, True), (20, 2, "EN", 9, False, False, True)],
        "subscription int, owner int, language string, per_day int, paused boolean, deleted boolean, enabled boolean",
    )
    issues = spark.createDataFrame([(s, i, "ES" if s == 14 else "EN", i) for s in (10, 11, 12, 13, 14, 20) for i in range(1, 6)] + [(10, 9, "FR", 0)], "subscription int, issue int, language string, order int")
    deliveries = spark.createDataFrame([(10, 1, "SE", 0, "2019-12-01"), (10, 2, "FA", 3, None), (10, 3, "FA", 4, None), (14, 1, "SE", 0, "2020-01-01 12:00:00")], "subscription int, issue int, status string, retry int, day string")
    deliveries = deliveries.select("subscription", "issue", "status", "retry", F.col("day").cast("timestamp").alias("send_date"))
    plan = planning.daily(users, subscriptions, issues, deliveries, asof, 6, "7")
    found = {(r["subscription"], r["issue"]): r["retry"] for r in plan.collect()}
    assert len(found) == 2 and {r["owner"] for r in plan.collect()} == {1}
    everything = planning.daily(users.withColumn("per_day", F.lit(99)), subscriptions, issues, deliveries, asof, 6, "7")
    assert {(r["subscription"], r["issue"], r["retry"]) for r in everything.collect()} == {(10, 2, 4), (10, 4, 0), (14, 2, 0), (14, 3, 0), (14, 4, 0), (14, 5, 0)}
    after = planning.under_way(deliveries, plan, asof)
    assert after.where("status = 'PR'").count() == 2 and after.count() == 4 + sum(k not in {(10, 1), (10, 2), (10, 3), (14, 1)} for k in found)
    assert values(planning.daily_retries(subscriptions, issues, deliveries)) == [(1, 10, 2, 4)]


def test_clean_titles(spark):
    asof = F.lit("2020-01-01").cast("timestamp")
    issue = "struct<name:string,number:string,order:string,language:string,release:string,url:string>"
    kinds = f"name string, alt_name array<string>, author string, artist string, reading_direction string, status string, genres array<string>, rank string, rank_order string, description string, issues array<{issue}>, url string"
    good = (" Ch 1 ", "1", "1st", "en", "Nov 4, 2014", " u ")
    row = lambda name, direction, issues: (name, ["a", " "], None, "x" * 300, direction, "Ongoing", ["g"], "1.5k", "asc", "<i>d</i>&eacute;", issues, "u")
    rows = spark.createDataFrame([row(" T ", "rl", [good, (" ", "1", "1", "en", "Today", "u"), ("n", None, "x", "en", "Today", "u")]), row("T2", "up", [good]), row("T3", "LR", [("n", "1", "1", "??", "Today", "u")]), row(None, "LR", None)], kinds)
    clean, rejected = C.clean_titles(rows, asof)
    r = clean.collect()
    assert len(r) == 1 and (r[0]["name"], r[0]["alt_name"], r[0]["reading_direction"], r[0]["status"], r[0]["rank"], len(r[0]["artist"]), r[0]["description"]) == ("T", ["a"], "RL", "O", 1500, 200, "dé")
    assert [tuple(x) for x in r[0]["issues"]] == [("Ch 1", "1", 1, "EN", dt.date(2014, 11, 4), "u")]
    assert sorted(x["errors"] for x in rejected.collect()) == [["issues"], ["name", "issues"], ["reading_direction"]]


def test_links_and_ranks(spark):
    html = '<a rel="prev" href="/1">x</a><a class="n" rel="next" href="../3?a=1&amp;b=2">y</a>'
    assert one(spark, extraction.next_page(F.col("t"), F.lit("http://h/a/b/2")), t=html) == "http://h/a/3?a=1&b=2"
    assert one(spark, extraction.next_page(F.col("t"), F.lit("http://h/")), t="<p>none</p>") is None
    pages = spark.createDataFrame([(1, "http://h/t/", '<h1>T</h1><li><a href="i2">Ch. 2</a><li><a href="i1">Ch. 1.5</a>')], "id int, url string, html string")
    record = extraction.title_records(pages, "url", "html", {"name": extraction.RULES["heading"]}, extraction.RULES["links"], extraction.RULES["labels"]).first()
    assert record["name"] == "T" and [tuple(i) for i in record["issues"]] == [("Ch. 2", "2", 2, "http://h/t/i2"), ("Ch. 1.5", "1.5", 1, "http://h/t/i1")]


def test_files_and_bodies(spark, tmp_path):
    day = lambda d: dt.datetime(2020, 1, d)
    files = spark.createDataFrame([("a", day(1), 1), ("b", day(1), 1), ("c", day(9), 1)], "path string, modificationTime timestamp, length long")
    errors = spark.createDataFrame([("b",)], "file string")
    assert values(retention.old_files(files, F.lit("2020-01-10").cast("timestamp"), 2).select("path")) == [("a",), ("b",)]
    assert values(retention.old_files(files, F.lit("2020-01-10").cast("timestamp"), 2, errors).select("path")) == [("a",)]
    assert [one(spark, X.valid_body(F.col("t"), ["ok"], ["bad"]), t=t) for t in ("all ok", "ok bad", "none")] == [True, False, False]
    assert one(spark, X.valid_body(F.col("t"), [], []), t="x") is False
    assert one(spark, X.safe_name(F.col("t")), t="a b/é") == "a_b_é.mobi"
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, part string")
    io.refresh(df, str(tmp_path / "t"), "part")
    io.refresh(spark.createDataFrame([(3, "y")], "k int, part string"), str(tmp_path / "t"), "part")
    assert values(spark.read.parquet(str(tmp_path / "t")).select("k")) == [(1,), (3,)]


def test_html_text_keeps_every_page(spark, tmp_path):
    from serialis.plans.queries import QUERIES

    rows = [(1, "u", "<title>a</title><p>says 404 Not Found</p>"), (2, "u", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["page_id"]: r["title"] for r in QUERIES["html_text"](spark, str(tmp_path)).collect()}
    assert found == {1: "a", 2: None}
    assert [r["page_id"] for r in extraction.extract(spark.read.parquet(str(tmp_path / "pages.parquet")), "html").collect()] == [2]


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "http://h/x/", '<title>A&amp;B</title><li><a href="/p">P</a><li><a href="q">Q</a>'), (2, "u", "404 Not Found")], "id int, url string, html string")
    found = extraction.extract(pages, "html").collect()
    assert [(r["id"], r["title"], r["labels"]) for r in found] == [(1, "A&B", ["P", "Q"])]
    assert values(extraction.link_rows(pages.where("id = 1"), "id", "url", "html")) == [(1, 1, "http://h/x/q"), (1, 2, "http://h/p")]
    assert one(spark, extraction.issue_number(F.col("t")), t="Vol 2 Ch.10.5 x") == "10.5"


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.log").write_text("x\nERROR y\n1.2.3.4:80 127.0.0.1:80 1.2.3.4:80\n")
    (tmp_path / "d.json").write_text('[{"model": "m", "pk": 1, "fields": {"a": "x"}}, {"model": "o", "pk": 2, "fields": {}}]')
    assert io.error_logs(spark, str(tmp_path / "log")).first()["errors"] == 1
    assert values(io.endpoints(spark, str(tmp_path / "log"))) == [("1.2.3.4:80",)]
    assert io.files(spark, str(tmp_path / "log")).count() == 1
    from pyspark.sql.types import StructType

    dump = io.dump(spark, str(tmp_path / "d.json"), "m", StructType().add("a", "string").add("n", "integer"), {"n": 0})
    assert values(dump) == [(1, "x", 0)]
    io.snapshot(dump, str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 1

    schema = "t timestamp, url string, title string"
    rows = spark.createDataFrame([(dt.datetime(2020, 1, 1), u, t) for u, t in (("u1", "a"), ("u1", "a"), ("u2", "a"), ("u3", "z"))], schema)
    rows.write.parquet(str(tmp_path / "in"))
    rows.where("url = 'u2'").write.parquet(str(tmp_path / "table"))
    titles = spark.createDataFrame([("a",)], "name string")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    latest_sync(stream, "t", "url", titles, "title", "name", str(tmp_path / "table"), str(tmp_path / "ckpt")).awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "table")).select("url")) == [("u1",), ("u2",)]


def test_expiry_counts_fractions_of_a_second(spark):
    """A row is kept to the very end of its time, whatever the fractions and the session's time zone."""
    asof = "timestamp_ntz'2024-04-01 00:00:00.2'"
    rows = spark.sql(f"select id, {asof} - make_dt_interval(10, 0, 0, late) as ts from values (1, 0.0), (2, 0.000001), (3, 0.3), (4, 1.0), (5, -0.000001), (6, -0.9), (7, -3600.0) as t(id, late)")
    labels = spark.createDataFrame([(3, "c")], "k long, name string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for name in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", name)
        try:
            assert {r["id"] for r in retention.expired(rows, "ts", F.expr(asof), 864_000).collect()} == {2, 3, 4}
            labelled = retention.labelled(rows, "ts", F.expr(asof), 864_000, labels, "id", "k", "name")
            assert {(r["id"], r["label"]) for r in labelled.collect()} == {(2, "<UNKNOWN>"), (3, "c"), (4, "<UNKNOWN>")}
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_date_is_trimmed_and_tidied_once(spark):
    """Within functions over arrays nothing that repeats is shared, so that each reading of a date cost it again."""
    df = spark.createDataFrame([(["Mar 3, 2020", " 3-4-2020 ", "Mar 3, 2020 12:34pm", "2 days ago", "x"],)], "t array<string>")
    dates = df.select(F.transform("t", lambda x: C.parse_date(x, F.lit("2020-01-03").cast("timestamp"))).alias("d"))
    plan = dates._jdf.queryExecution().analyzed().toString()
    assert plan.count("trim(") == 1 and plan.count("(?i)") == 2
    day = dt.date
    assert dates.first()["d"] == [day(2020, 3, 3), day(2020, 4, 3), day(2020, 3, 3), day(2020, 1, 1), None]


@pytest.mark.parametrize("name", ["issue_history", "issue_states", "retry_plan"])
def test_lines_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch, name):
    """A task holds about as many lines in a larger table: issues and deliveries are dealt once by their keys, and
    grouped and joined where they lie. The rows stay the same."""
    found = sorted(map(str, QUERIES[name](spark, DATA).collect()))
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    most = lines.count() // 20
    monkeypatch.setattr(listing.dealt, "__kwdefaults__", {"most": most})
    dealt = QUERIES[name](spark, DATA)
    assert sorted(map(str, dealt.collect())) == found
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "REPARTITION_BY_NUM" in plan
    if name == "issue_history":
        assert plan.count("hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2
    rows = listing.dealt(lines, "l_orderkey", "l_linenumber").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in rows) < 1.5 * most
    small = lines.limit(most)
    assert listing.dealt(small, "l_orderkey") is small
