"""Kept search tables, deep pages, packing and counts in groups of any size, nested syncs, partitioned tables, dumps
and state by key: each against brute force on small tables."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from serialis.operators import index, nested, packing, paging, running, search
from serialis.plans import kept
from serialis.sources import io, managed
from serialis.streaming import keyed

QUERIES = ["the", "of not the", "src1 (th or ou)", "zzz", "not th", "th the"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = "the than of on an ant ou our in ing er est tion".split()
    rows = [(k, f"src{k % 7}", " ".join(rng.choices(words, range(13, 0, -1), k=rng.choice([3, 5, 8, 200])))) for k in range(400)]
    rows += [(1000, None, None), (1001, "src1", ""), (1002, "same", "the the the"), (1003, "same", "the the the")]
    return spark.createDataFrame(rows, "id long, name string, text string").repartition(3).cache()


@pytest.fixture(scope="module")
def searched(texts, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('index')}/t"
    index.build(texts, path, "id", "name", "text", blocks=16, files=12)
    return path


@pytest.mark.parametrize("query", QUERIES)
def test_kept_search(spark, texts, searched, query):
    full = [tuple(r) for r in search.search(texts, query, "id", "name", "text", limit=1000).select("id", "rank").collect()]
    for offset, limit in ((1, 5), (0, 1000)):
        for found in (index.page, index.best):
            rows = [(r["id"], r["rank"]) for r in found(spark, searched, query, "id", "name", offset, limit).collect()]
            assert rows == full[offset : offset + limit]


def test_few_postings_are_read(spark, searched):
    shares = [index.best_blocks(spark, searched, q, "id", 5)[1] for q in ("the", "an th")]
    assert max(shares) < 0.7
    found = index.postings(spark, searched, "ing")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,ing)" in plan and "StringStartsWith(term,ing)" in plan and "PartitionFilters: [part#" in plan
    parts = [r["part"] for r in spark.read.parquet(f"{searched}/postings").select("part").distinct().collect()]
    assert 0 < len({f for f in found.inputFiles()}) and found.select("part").distinct().count() < len(parts)
    # A common term is several files.
    assert spark.read.parquet(f"{searched}/postings").where("term = 'the'").select("part").distinct().count() > 1


def test_texts_are_read_once(spark, tmp_path):
    """A search table takes its terms, blocks and bounds from one count of each text; its postings are those of `search`."""
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (read.add(1), x)[1], "string").asNondeterministic()
    docs = spark.createDataFrame([(1, "Ab ab", "ab İx, c_9"), (2, None, "c9 C9 ab"), (3, "", None), (4, "é\u2003É", "x")], "id long, name string, text string")
    index.build(docs.withColumn("text", seen("text")), f"{tmp_path}/t", "id", "name", "text", blocks=4)
    assert read.value == 4
    found = spark.read.parquet(f"{tmp_path}/t/postings").select("id", "term", "weight", "tf")
    wanted = search.postings(docs, "id", "name", "text").select("id", "term", "weight", "tf")
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, wanted.collect()))
    masses = {r[0]: r[1] for r in spark.read.parquet(f"{tmp_path}/t/weighed").select("id", "__mass").collect()}
    assert masses == {1: pytest.approx(2.5), 2: pytest.approx(0.3), 3: None, 4: pytest.approx(2.1)}
    most = [(r["most"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/t/bounds").collect() if r["term"] == "ab" and r["most"] > 1]
    assert most == [(pytest.approx(2.1), 1)]


@pytest.mark.parametrize("limit", [3, 1000])
def test_several_searches_together(spark, texts, searched, limit):
    """The same pages as one by one, a repeated query once; groups are limited before they are shuffled."""
    found = index.several(spark, searched, [*QUERIES, "the"], "id", "name", limit)
    rows = sorted((r["query"], r["place"], r["id"], r["name"], r["rank"]) for r in found.collect())
    wanted = [(q, k, r["id"], r["name"], r["rank"]) for q in QUERIES for k, r in enumerate(search.search(texts, q, "id", "name", "text", limit=limit).collect(), 1)]
    assert rows == sorted(wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert limit == 1000 or "WindowGroupLimit" in plan


def test_blocks_of_several_queries(spark, searched):
    """Each query has the blocks that it has alone, and all of them take the jobs of one."""
    context = spark.sparkContext

    def jobs(group, queries):
        context.setJobGroup(group, group)
        told = index.reaching_blocks(spark, searched, queries, "id", 5)
        context.setLocalProperty("spark.jobGroup.id", None)
        return told, len(context.statusTracker().getJobIdsForGroup(group))

    together, count = jobs("together", QUERIES)
    alone = [jobs(f"alone {q}", [q]) for q in QUERIES]
    assert together == {q: told[q] for q, (told, _) in zip(QUERIES, alone, strict=True)}
    assert count < sum(n for _, n in alone) / 2


def test_kept_search_of_nothing(spark, texts, tmp_path):
    path = f"{tmp_path}/t"
    index.build(texts.where("false"), path, "id", "name", "text")
    assert index.best(spark, path, "the", "id", "name").count() == index.page(spark, path, "not the", "id", "name").count() == 0


def order_rows(rng, n):
    day = dt.datetime(2001, 1, 1)
    return [
        (k, rng.choice([None, 1, 1, 1, 2, 7, -(10**12), 10**17]), rng.choice([None, -1e300, 0.0, 0.5, 1e-300, rng.random()]), rng.choice([None, "", "a", "prefix of many a", "prefix of many b", "prefix of many " + str(rng.random()), "é", "\U0001f600"]), rng.choice([None, day, day + dt.timedelta(microseconds=rng.randrange(5)), day + dt.timedelta(days=rng.randrange(900))]), rng.choice([None, True, False]))
        for k in range(n)
    ]


@pytest.mark.parametrize("seed", range(2))
def test_deep_pages(spark, seed):
    rng = random.Random(seed)
    df = spark.createDataFrame(order_rows(rng, 700), "id long, n long, x double, s string, t timestamp_ntz, b boolean").repartition(3).cache()
    for columns in (["n", "s", "id"], ["b", "x", "t", "id"]):
        order = [paging.By(c, rng.random() < 0.5, rng.random() < 0.5) for c in columns]
        full = [tuple(r) for r in df.orderBy(*(by.sort() for by in order)).collect()]
        for offset, limit in ((349, 20), (690, 20), (300, 300), (700, 5)):
            found = [tuple(r) for r in paging.deep_page(df, order, offset, limit, most=30, ranges=8).collect()]
            assert found == full[offset : offset + limit]
        place = paging.place_of(df, order, 350, most=30, ranges=8)
        assert place.rows.count() == place.size <= 30 and place.before <= 350 < place.before + place.size
        row = full[350]
        assert df.limit(1).select(paging.position(df, order, dict(zip(df.columns, row, strict=True)))).first()[0] == 350


def test_pages_by_number(spark):
    df = spark.range(45).withColumn("even", F.col("id") % 2)
    rows, facts = paging.numbered_page(df, ["even", "id"], 0, 10, most=7)
    assert [r["id"] for r in rows.collect()] == [35, 37, 39, 41, 43] and facts == {"number": 5, "size": 10, "pages": 5}
    with pytest.raises(ValueError):
        paging.numbered_page(df, ["id"], 6, 10)
    with pytest.raises(ValueError):
        paging.deep_page(df, ["id"], -1, 10)
    assert paging.numbered_page(df.where("false"), ["id"], 1, 10)[0].count() == 0
    # Rows alike in the whole order stand for each other.
    assert [r["even"] for r in paging.deep_page(df, ["even"], 22, 2, most=3).collect()] == [0, 1]


def test_volumes_of_any_length(spark):
    rng = random.Random(0)
    rows = [(g, k, rng.choice([0, 1, 5, 40, None] if g == "small" else [0, 0, 1, 2] if g == "flat" and k < 300 else [900, 1, 0, 7])) for g, n in (("small", 30), ("flat", 420), (None, 200), ("one", 1)) for k in range(n)]
    rows += [("flat", 5, 1), ("flat", 5, 1)]
    df = spark.createDataFrame(rows, "doc string, page long, size long").repartition(3)
    for limit in (50, 10**9):
        folded = Counter(map(tuple, packing.volumes(df, "doc", "page", "size", limit).collect()))
        assert Counter(map(tuple, packing.volumes(df, "doc", "page", "size", limit, long=25, ranges=7).collect())) == folded
    wanted, filled, volume = [], 0, 1
    pages = sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
    total = sum(r[2] or 0 for r in pages)
    for _, page, size in pages:
        if total > 700 and filled > 1 + total // (1 + total // 700):
            filled, volume = 0, volume + 1
        filled += size or 0
        wanted.append((page, volume))
    assert sorted((r["page"], r["volume"]) for r in packing.volumes(df, "doc", "page", "size", 700, long=0, ranges=9).where("doc is null").collect()) == wanted


def test_no_window_is_read_again_for_every_row(spark, monkeypatch):
    """A frame that reaches to a partition's end costs the square of its rows."""
    plans, keep = [], packing.kept_table
    monkeypatch.setattr(packing, "kept_table", lambda df: plans.append(df._jdf.queryExecution().toString().lower()) or keep(df))
    df = spark.range(60).selectExpr("'a' as doc", "id as page", "id % 5 as size")
    assert packing.volumes(df, "doc", "page", "size", 60, long=0, ranges=3).count() == 60
    assert any("windowspecdefinition" in p for p in plans) and not any("unboundedfollowing" in p for p in plans)


def test_rolling_counts(spark):
    rng = random.Random(1)
    start = dt.datetime(2020, 3, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), start + dt.timedelta(hours=rng.randrange(400), seconds=rng.choice([0, 0, 1]))) for _ in range(600)] + [(5, None)]
    found = running.rolling_counts(spark.createDataFrame(rows, "user long, at timestamp_ntz").repartition(3), "user", "at", 22, ranges=6).collect()
    timed = [r for r in rows if r[1]]
    wanted = {(u, t): (timed.count((u, t)), sum(v == u and t - dt.timedelta(hours=22) <= s <= t for v, s in timed)) for u, t in set(timed)}
    assert {(r["user"], r["at"]): (r["uses"], r["used"]) for r in found} == wanted


CHILD = "array<struct<number: long, name: string>>"


def test_nested_sync(spark):
    old = dt.datetime(2000, 1, 1)
    stored = spark.createDataFrame([
        (1, "a", [(1, "x"), (2, "y"), (3, "z")], ["p", "q"], old, old), (2, "b", None, None, old, old), (3, "c", [(1, "x"), (1, "twice")], ["p"], old, old), (4, "d", [(None, "n")], [], old, old), (5, "e", [(9, "z")], ["q"], old, old),
    ], f"id long, title string, issues {CHILD}, tags array<string>, created timestamp, seen timestamp")
    came = spark.createDataFrame([
        (1, None, [(4, "new"), (2, "y"), (3, "other")], ["q", "r", "r", "unknown"], ["p", "q", "r"]), (2, "b", [], None, None), (3, "c", [(1, "twice")], ["p"], ["p"]), (4, "dd", [(None, "m"), (None, "n")], [], []), (6, "f", [(1, "x")], ["p"], ["p"]),
    ], f"id long, title string, issues {CHILD}, tags array<string>, known array<string>")
    asof = dt.datetime(2001, 1, 1)
    synced = nested.sync_records(stored, came, ["id"], ["title"], [nested.Relation("issues", "number"), nested.Links("tags", "known")], F.lit(asof), seen="seen")
    rows = {r["id"]: r for r in synced.collect()}
    log = lambda k: ({x["key"]: x["action"] for x in rows[k]["issues_log"]}, {x["key"]: x["action"] for x in rows[k]["tags_log"]})
    assert {k: r["action"] for k, r in rows.items()} == {1: "update", 2: "keep", 3: "keep", 4: "update", 5: "absent", 6: "insert"}
    assert log(1) == ({1: "delete", 2: "keep", 3: "update", 4: "insert"}, {"p": "delete", "q": "keep", "r": "insert"})
    assert rows[1]["title"] == "a" and [tuple(x) for x in rows[1]["issues"]] == [(4, "new"), (2, "y"), (3, "other")] and sorted(rows[1]["tags"]) == ["q", "r"]
    assert log(3) == ({1: "keep"}, {"p": "keep"}) and log(4) == ({None: "keep"}, {}) and log(5) == ({}, {}) and log(6) == ({1: "insert"}, {"p": "insert"})
    assert [tuple(x) for x in rows[5]["issues"]] == [(9, "z")] and rows[5]["seen"] == old and rows[6]["created"] == asof and rows[1]["seen"] == asof and rows[1]["created"] == old
    more = nested.sync_records(stored, came, ["id"], ["title"], [nested.Relation("issues", "number", deletes=False)], F.lit(asof), seen="seen", deletes=True)
    rows = {r["id"]: r for r in more.collect()}
    assert [tuple(x) for x in rows[1]["issues"]] == [(4, "new"), (2, "y"), (3, "other"), (1, "x")] and rows[5]["action"] == "delete"
    assert {r["id"] for r in nested.table_of(more).collect()} == {1, 2, 3, 4, 6}
    plan = synced._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Generate" not in plan
    assert nested.sync_records(stored.where("false"), came.where("false"), ["id"], ["title"], [], F.lit(asof), seen="seen").count() == 0


def test_merges_touch_what_changes(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows = [(k, k % 5 if k % 11 else None, f"v{k}") for k in range(100)]
    managed.create(spark.createDataFrame(rows, "id long, shelf int, v string"), path, "shelf")
    folders = {p.value: p.folder for p in managed.manifest(spark, path).parts}
    assert set(folders) == {"0", "1", "2", "3", "4", None} and sum(p.rows for p in managed.manifest(spark, path).parts) == 100
    with pytest.raises(ValueError):
        managed.create(spark.createDataFrame(rows, "id long, shelf int, v string"), path, "shelf")
    came = spark.createDataFrame([(1, 1, "v1"), (2, 2, "other"), (3, 4, "moved"), (200, 7, "new")], "id long, shelf int, v string")
    log = {r["id"]: r["action"] for r in managed.merge(spark, path, came, ["id"]).collect()}
    assert {k: a for k, a in log.items() if a != "keep"} == {2: "update", 3: "update", 200: "insert"} and len(log) == 101
    now = {p.value: p.folder for p in managed.manifest(spark, path).parts}
    assert {v for v in folders if folders[v] == now[v]} == {"0", "1", None} and "7" in now
    changed = {**{r[0]: r for r in rows}, 2: (2, 2, "other"), 3: (3, 4, "moved"), 200: (200, 7, "new")}
    assert sorted(map(tuple, managed.read(spark, path).collect())) == sorted(changed.values())
    assert sorted(map(tuple, managed.read(spark, path, version=1).collect())) == rows
    assert {r["id"] for r in managed.read(spark, path, values=["7", None]).collect()} == {200, *range(0, 100, 11)}
    # Nothing changes: no new version. A write that fails leaves the table as it was.
    managed.merge(spark, path, came, ["id"])
    assert managed.versions(spark, path) == [1, 2]
    broken = came.withColumn("v", F.when(F.col("id") == 200, F.raise_error(F.lit("broken"))).otherwise("x"))
    with pytest.raises(Exception, match="broken"):
        managed.merge(spark, path, broken, ["id"])
    with monkeypatch.context() as m:
        m.setattr(managed, "_commit", lambda *_: (_ for _ in ()).throw(OSError("no manifest")))
        with pytest.raises(OSError):
            managed.merge(spark, path, came.withColumn("v", F.lit("x")), ["id"])
    assert managed.versions(spark, path) == [1, 2] and sorted(map(tuple, managed.read(spark, path).collect())) == sorted(changed.values())
    # Another writer has been faster.
    with pytest.raises(RuntimeError):
        managed._commit(spark, path, managed.manifest(spark, path))
    assert {r["action"] for r in managed.merge(spark, path, came, ["id"], deletes=True).collect()} == {"keep", "delete"}
    assert managed.read(spark, path).count() == 4
    # A refresh replaces what it names in one step.
    managed.refresh(came.withColumn("v", F.lit("fresh")), path, ["7"])
    assert {r["id"]: r["v"] for r in managed.read(spark, path).collect()} == {1: "v1", 2: "other", 3: "moved", 200: "fresh"}
    managed.refresh(came.where("id < 4"), path)
    assert managed.read(spark, path).count() == 3 and managed.read(spark, path, version=4).count() == 4
    managed.refresh(came, path)
    assert managed.vacuum(spark, path) > 0 and managed.versions(spark, path) == [6] and managed.read(spark, path).count() == 4


def test_retention_drops_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    start = dt.datetime(2020, 1, 1)
    rows = [(k, (start + dt.timedelta(days=k)).strftime("%Y-%m"), start + dt.timedelta(days=k)) for k in range(200)] + [(999, "2020-01", None)]
    managed.create(spark.createDataFrame(rows, "id long, month string, t timestamp"), path, "month", time="t")
    before = {p.value: p.folder for p in managed.manifest(spark, path).parts}
    assert managed.expire(spark, path, F.lit(dt.datetime(2020, 4, 10))) == {"dropped": 2, "rewritten": 2, "kept": 3}
    after = {p.value: p.folder for p in managed.manifest(spark, path).parts}
    assert sorted(after) == ["2020-01", "2020-04", "2020-05", "2020-06", "2020-07"] and {v for v in after if after[v] == before[v]} == {"2020-05", "2020-06", "2020-07"}
    assert sorted(r["id"] for r in managed.read(spark, path).collect()) == [*range(100, 200), 999]
    # The lines of what was dropped go unread: their files may be gone.
    for value in ("2020-02", "2020-03"):
        io.remove(spark, before[value])
    assert managed.read(spark, path).count() == 101
    assert managed.expire(spark, path, F.lit(dt.datetime(2019, 1, 1)))["dropped"] == 0


@pytest.mark.parametrize("indent", [None, 4])
@pytest.mark.parametrize("first", ["model", "fields"])
def test_dumps_split(spark, tmp_path, indent, first):
    rows = [{"model": "a.b" if k % 3 else "a.c", "pk": k, "fields": {"s": f'{{"model": ]}}, {{"{k}', "n": k} if k % 5 else {"s": "é\n\t\\"}} for k in range(2000)]
    file = tmp_path / "d.json"
    file.write_text(json.dumps([{k: r[k] for k in sorted(r, key=lambda x: (x != first, x))} for r in rows], indent=indent))
    fields = StructType().add("s", "string").add("n", "integer")
    settings = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = io.dump(spark, str(file), "a.b", fields, {"n": -1})
        parts = found.select(F.spark_partition_id().alias("p")).distinct().count()
        got = sorted(map(tuple, found.collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert parts > 3
    assert got == [(r["pk"], r["fields"]["s"], r["fields"].get("n", -1)) for r in rows if r["model"] == "a.b"]


def test_odd_dumps(spark, tmp_path):
    fields = StructType().add("s", "string")
    for text in ("[]", " [\n] ", ""):
        (tmp_path / "e.json").write_text(text)
        assert io.dump(spark, str(tmp_path / "e.json"), "m", fields).count() == 0
    (tmp_path / "bad.json").write_text('[{"model": "m", "pk": 1, "fields": {"s": {"model": "inner"}}}, {"model": "m", "pk": 2, "fields": {}}]')
    with pytest.raises(Exception, match="can't be read"):
        io.dump(spark, str(tmp_path / "bad.json"), "m", fields).collect()


@pytest.mark.parametrize("batches", [2])
def test_lives(spark, tmp_path, batches):
    rng = random.Random(9)
    start = dt.datetime(2021, 5, 1)
    rows = sorted(((rng.choice([1, 1, 2, 3]), start + dt.timedelta(minutes=rng.randrange(6000)), rng.random() < 0.3) for _ in range(300)), key=lambda r: r[1])
    rows = [(u, t, f if k % 10 else None) for k, (u, t, f) in enumerate(rows)]
    ttl, wanted = dt.timedelta(minutes=90), []
    for user in (1, 2, 3):
        life = []
        for _, t, f in [r for r in rows if r[0] == user] + [(user, dt.datetime(2100, 1, 1), False)]:
            if life and t > life[-1][0] + ttl:
                wanted.append((user, life[0][0], life[-1][0], len(life), sum(bool(x[1]) for x in life), sum(bool(x[1]) for x in life) > 3))
                life = []
            life.append((t, f))
    watermark = rows[-1][1] - dt.timedelta(hours=1)
    wanted = [w for w in wanted if w[2] + ttl < watermark]
    schema = "user long, at timestamp, failed boolean"
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k in range(batches):
        part = rows[len(rows) * k // batches : len(rows) * (k + 1) // batches]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        keyed.run(keyed.lives(spark.readStream.schema(schema).parquet(source), "user", "at", "failed", 90 * 60), out, checkpoint)
    found = spark.read.parquet(out).select("user", "first", "last", "uses", "failures", "dropped").collect()
    assert sorted(map(tuple, found)) == sorted(wanted) and any(w[-1] for w in wanted)


def test_lives_are_session_windows(spark, tmp_path):
    """No row or key passes through Python, and a use later than the delay counts in a life that is open."""
    schema, source, out, checkpoint = "user long, at timestamp, failed boolean", *(str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    at = lambda hours: dt.datetime(2021, 5, 1) + dt.timedelta(hours=hours)
    for rows in ([(1, at(0), True), (2, at(3), False), (None, at(0), None)], [(1, at(1), True), (2, at(5), False)], [(2, at(30), False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        done = keyed.run(keyed.lives(spark.readStream.schema(schema).parquet(source), "user", "at", "failed", 4 * 3600, retries=1), out, checkpoint)
        assert [x["operatorName"] for x in done.lastProgress["stateOperators"]] == ["sessionWindowStateStoreSaveExec"]
    found = [tuple(r) for r in spark.read.parquet(out).orderBy("user").select("user", "first", "last", "uses", "failures", "dropped").collect()]
    assert found == [(None, at(0), at(0), 1, 0, False), (1, at(0), at(1), 2, 2, True), (2, at(3), at(5), 2, 0, False)]


@pytest.mark.parametrize("rows", [0, 1, 400])
def test_lives_of_events(spark, tmp_path, rows):
    """Times on whole minutes, so that lives meet their end and the last watermark exactly; several files, few or no events."""
    rng = random.Random(5)
    start = dt.datetime(2021, 5, 1)
    events = [(rng.choice([1, 2, 3]), start + dt.timedelta(minutes=180 * rng.randrange(200)), rng.choice(["error", "view"])) for _ in range(rows)]
    if rows > 1:
        newest = max(t for _, t, _ in events)
        events += [(8, newest - dt.timedelta(hours=13), "view"), (9, newest - dt.timedelta(hours=13, microseconds=1), "view")]
    spark.createDataFrame(events, "user_id long, ts timestamp_ntz, event_type string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    found = kept.lives_stream(spark, str(tmp_path)).collect()
    wanted = []
    for user in {u for u, _, _ in events}:
        life = []
        for _, t, kind in [*sorted(e for e in events if e[0] == user), (user, dt.datetime(2100, 1, 1), "")]:
            if life and t > life[-1][0] + dt.timedelta(hours=12):
                failures = sum(k == "error" for _, k in life)
                if life[-1][0] + dt.timedelta(hours=12) < max(x for _, x, _ in events) - dt.timedelta(hours=1):
                    wanted.append((user, life[0][0], life[-1][0], len(life), failures, failures > 3))
                life = []
            life.append((t, kind))
    assert sorted(map(tuple, found)) == sorted(wanted) and {u for u, *_ in wanted} == ({1, 2, 3, 9} if rows > 1 else set())
