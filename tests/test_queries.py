"""Every query against the checking engine on the smallest tables, and hand-made or brute-force rows for what has none."""

import math
import random
import statistics
from collections import OrderedDict, defaultdict
from decimal import Decimal

import pytest

from millrace.functions import columns
from millrace.operators import hooks, measures, nested, predicates, reports, sequences, store
from millrace.plans import catalog
from millrace.plans.engine import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "None" if math.isnan(v) else f"{float(v):.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id long, t double, request_id long")


def test_window_is_anchored_at_its_first_request(spark):
    d = events(spark, [(1, 0.0, 1), (1, 9.9, 2), (1, 10.0, 3), (1, 15.0, 4), (2, 5.0, 5)])
    got = {r.request_id: (r.n, r.allowed) for r in sequences.fixed_window_limit(d, limit=1, window=10).collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (1, True), 4: (2, False), 5: (1, True)}


def test_rejected_request_leaves_the_bucket_as_it_is(spark):
    d = events(spark, [(1, 0.0, 1), (1, 0.0, 2), (1, 0.0, 3), (1, 1.0, 4)])
    got = {r.request_id: r.accepted for r in sequences.leaky_bucket(d, rate=1, burst=1).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True}


def test_batches_close_by_size_and_by_time(spark):
    d = spark.createDataFrame([("a", i / 100, i) for i in range(5)] + [("a", 9.0, 9)], "service string, t double, request_id long")
    got = {r.request_id: r.batch for r in sequences.micro_batch(d, size=4, wait=1).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 9: 3}


def test_caches_expire_and_keep_valid_results_only(spark):
    d = spark.createDataFrame([("a", 0.0, 1, False), ("a", 1.0, 2, True), ("a", 30.0, 3, True), ("a", 31.0, 4, False), ("a", 32.0, 5, True)], "key string, t double, request_id long, valid boolean")
    assert {r.request_id: r.hit for r in sequences.ttl_cache(d, ttl=30).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    assert {r.request_id: r.hit for r in sequences.token_cache(d, key="key", ttl=30).collect()} == {1: False, 2: False, 3: True, 4: False, 5: False}


def test_least_recently_used_goes(spark):
    r = random.Random(1)
    rows = [(f"s{r.randrange(3)}", float(i), i, f"k{r.randrange(9)}") for i in range(400)]
    held, want = defaultdict(OrderedDict), {}
    for shard, _, i, key in rows:
        hit, out = key in held[shard], None
        held[shard][key] = 1
        held[shard].move_to_end(key)
        if len(held[shard]) > 4:
            out = held[shard].popitem(last=False)[0]
        want[i] = (hit, out)
    d = spark.createDataFrame(rows, "shard string, t double, request_id long, key string")
    assert {x.request_id: (x.hit, x.evicted) for x in sequences.lru_cache(d, 4).collect()} == want


def test_least_connections_and_failed_backends(spark):
    rows = [("p", 0.0, 1, 10.0, True), ("p", 0.0, 2, 1.0, True), ("p", 0.5, 3, 9.0, True), ("p", 1.0, 4, 9.0, True), ("p", 2.0, 5, 1.0, True), ("q", 0.0, 6, 1.0, False), ("q", 1.0, 7, 1.0, False), ("q", 2.0, 8, 1.0, False), ("q", 3.0, 9, 1.0, True), ("q", 40.0, 10, 1.0, True)]
    d = spark.createDataFrame(rows, "pool string, t double, request_id long, duration double, ok boolean")
    got = {x.request_id: x.backend for x in sequences.least_connections(d).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0, 9: 1, 10: 0}


@pytest.mark.parametrize("seed", range(6))
def test_percentiles_are_exact(spark, seed):
    r = random.Random(seed)
    rows = [(f"g{i % 3}", r.choice([None, r.randint(0, 5) / 2, r.random() * 100])) for i in range(r.choice([4, 90, 700]))] + [("one", 7.0), ("none", None)]
    got = {x.g: x for x in measures.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"a": ("linear", 0.95), "b": ("exclusive", 0.95), "c": ("floor", 0.95), "d": ("linear", 0.5)}).collect()}
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    assert set(got) == set(by)
    for g, v in by.items():
        v.sort()
        n = len(v)
        k = (n - 1) * 0.95
        linear = v[int(k)] + (v[min(int(k) + 1, n - 1)] - v[int(k)]) * (k - int(k))
        exclusive = v[0] if n == 1 else statistics.quantiles(v, n=20)[18]
        for have, want in ((got[g].a, linear), (got[g].b, exclusive), (got[g].c, v[int(0.95 * n)]), (got[g].d, statistics.median(v))):
            assert math.isclose(have, want, rel_tol=1e-9, abs_tol=1e-9), (g, n)


def test_ranks_over_all_rows(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, 1.0, 1.0, r.random() * 9])) for i in range(500)]
    d = spark.createDataFrame(rows, "id long, v double")
    for down in (False, True):
        got = sorted((x.place, x.id) for x in measures.global_rank(d, "v", ["id"], "place", down).collect())
        some = sorted([x for x in rows if x[1] is not None], key=lambda x: (-x[1] if down else x[1], x[0]))
        none = [x for x in rows if x[1] is None]
        assert [i for _, i in got] == [i for i, _ in (some + none if down else none + some)] and [p for p, _ in got] == list(range(1, 501))
    assert measures.global_rank(d.limit(0), "v", ["id"], "place").count() == 0


def test_store_expires_and_decodes(spark):
    puts = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0), ("b", 3, 0.0)], "key string, v int, t double")
    kept = store.put(puts, "key", nested.F.struct("v"), "t", 10).unionByName(spark.createDataFrame([("c", "{oops", 0.0, 99.0)], "key string, value string, stored_at double, expires_at double"))
    gets = spark.createDataFrame([("a", 14.0), ("b", 14.0), ("c", 1.0), ("d", 1.0)], "key string, t double")
    got = {r.key: (r.hit, r.found.v if r.hit else None) for r in store.get(gets, kept, "key", "t", "v int").collect()}
    assert got == {"a": (True, 2), "b": (False, None), "c": (False, None), "d": (False, None)}


def test_stream_ends_by_limit_or_when_the_client_goes(spark):
    d = spark.createDataFrame([(1, "a b c", 9, 9), (2, "a b c", 2, 9), (3, "a b c", 9, 1), (4, "", 9, 9)], "id int, text string, allowed int, read int")
    got = defaultdict(list)
    for r in nested.sse_stream(d, ["id"], allowed=nested.F.col("allowed"), read=nested.F.col("read")).orderBy("id", "pos").collect():
        got[r.id].append((r.frame, r.billed))
    assert [f for f, _ in got[1]] == ["retry: 1000", "data: a", "data: b", "data: c", "data: [DONE]"] and [b for _, b in got[1]] == [0, 1, 1, 1, 0]
    assert [f for f, _ in got[2]][-2:] == ["data: b", 'data: {"error": "Rate limit exceeded"}']
    assert [f for f, _ in got[3]] == ["retry: 1000", "data: a"] and [f for f, _ in got[4]] == ["retry: 1000", "data: [DONE]"]


def test_missing_backup_files_are_an_error(spark, tmp_path):
    users = spark.createDataFrame([(1, "a")], "id long, email string")
    store.back_up({"users": users}, f"{tmp_path}/backup-2024-01-01")
    assert store.find_backup(spark, str(tmp_path)) == "backup-2024-01-01" and store.find_backup(spark, str(tmp_path), "2023-01-01") is None
    with pytest.raises(FileNotFoundError):
        store.restore(spark, f"{tmp_path}/backup-2024-01-01", {"users": "id long", "keys": "id long"})
    with pytest.raises(ValueError):
        store.keep_view(spark, f"{tmp_path}/v", lambda: users.unionByName(users), "id")


def test_rules_take_thresholds(spark):
    one = spark.createDataFrame([(120.0, None)], "p95 double, rps double")
    got = {r.gate: r.passed for r in reports.gates(one, {"a": ("p95", "<", 130), "b": ("p95", "<", 100), "c": ("rps", ">", 1)}).collect()}
    assert got == {"a": True, "b": False, "c": False}
    both = spark.createDataFrame([("/a", 3000.0, 50.0), ("/b", 1.0, 100.0)], "endpoint string, p95 double, success double")
    assert [r.endpoint for r in reports.threshold_failures(both).collect()] == ["/a", "/a"]
    perms = spark.createDataFrame([(["read"],), (["admin"],), (None,)], "p array<string>")
    assert [r[0] for r in perms.select(predicates.has_permission(nested.F.col("p"), "write")).collect()] == [False, True, False]


def on_events(spark, tmp_path, name, rows, kind="'view'"):
    """What the query and its SQL make of events ``(event_id, user_id, value, k)``."""
    import duckdb

    d = spark.createDataFrame([(i, u, v, f'{{"k": {k}}}') for i, u, v, k in rows], "event_id long, user_id long, value double, props string")
    d = d.selectExpr("event_id", "timestamp'2024-01-01' as ts", "user_id", f"{kind} as event_type", "value", "props")
    d.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    return sorted(tuple(plain(r[c]) for c in names) for r in got.collect()), sorted(tuple(map(plain, r)) for r in want.fetchall())


ZERO = [(1, 0, 2.0, 8), (2, 0, 4.0, 8), (4, 1, 0.0, 5), (5, 1, 2.0, 8), (8, 2, 1.0, 1)]


@pytest.mark.parametrize(("rows", "best"), [(ZERO, "1"), ([(1, 0, 0.0, 0), (4, 0, 0.0, 3)], "2"), ([(1, 0, -0.0, 3), (4, 0, 1.0, 1)], "1")])
def test_best_batch_with_requests_of_no_time(spark, tmp_path, rows, best):
    got, want = on_events(spark, tmp_path, "agg_best_batch", rows)
    assert got == want == [(best,)]


def test_compared_models_with_requests_of_no_time(spark, tmp_path):
    got, want = on_events(spark, tmp_path, "agg_compare_models", [*ZERO[:-1], (8, 2, 1.5, 1)])
    assert got == [("model_1", "model_1", "model_2", "model_0")]  # no errors at all: SQL leaves the last open
    assert got[0][:3] == want[0][:3]


@pytest.mark.parametrize("rows", [ZERO, [(1, 0, 0.0, 0), (4, 1, -0.0, 3), (5, 2, 1.0, 3)]])
def test_model_summary_with_requests_of_no_time(spark, tmp_path, rows):
    got, want = on_events(spark, tmp_path, "agg_model_summary", rows)
    assert got == want


def test_tied_batches(spark, tmp_path):
    got, _ = on_events(spark, tmp_path, "agg_best_batch", [(3, 0, 0.0, 3), (2, 0, 0.0, 3), (5, 0, 0.0, 3), (4, 0, 1.0, 3)])
    assert got == [("2",)]  # SQL leaves open which of 2, 3 and 4 it is


def test_ids_of_more_pages_than_five_digits_number(spark, duck, tmp_path):
    spark.range(100_020).select(nested.F.col("id").alias("page_id")).write.parquet(pages := str(tmp_path / "pages.parquet"))
    sql = catalog.ORACLE_SQL["win_ids_seq"].replace("from pages", f"from '{pages}/*.parquet'")
    got = catalog.QUERIES["win_ids_seq"](spark, str(tmp_path)).select("finding", "page_id").collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(sql).fetchall())


def test_numbers_are_written_as_printf_writes_them(spark):
    r = random.Random(5)
    values = [0.125, 0.375, -0.125, 150.505, 2000.125, 1.005, 1e12 + 0.125, 0.0, -0.001, 1e22, *(r.randrange(40000) / 200 for _ in range(500))]
    d = spark.createDataFrame([(x,) for x in [*values, math.inf, -math.inf, None]], "x double")
    got = d.select("x", columns.fixed(nested.F.col("x"), 2).alias("two"), columns.fixed(nested.F.col("x"), 0).alias("none")).collect()
    assert all((g.two, g.none) == (("%.2f" % g.x, "%.0f" % g.x) if g.x is not None else (None, None)) for g in got)
    ends = spark.createDataFrame([("/a", 2000.125, 98.125)], "endpoint string, p95 double, success double")
    assert [x.line for x in reports.threshold_failures(ends).collect()] == ["/a: P95 response time 2000.12 exceeds 2000.00", "/a: success rate 98.12 below 99.00"]


def test_thresholds_of_odd_endpoints(spark, tmp_path):
    rows = [(1, 0, 150.505, 1), (2, 0, None, 1), (3, 0, None, 1), (4, 0, 300.0, 1), (5, 0, 200.0, 1), (6, 0, 200.01, 1)]
    got, want = on_events(spark, tmp_path, "rul_lt_thresholds", rows, "case event_id when 1 then 'view' when 2 then 'error' when 4 then null else 'click' end")
    assert got == want and len(got) == 4


def test_percentiles_to_the_last_bit(spark, duck):
    r = random.Random(4)
    rows = [(g, r.randrange(20000) / 100) for g in range(60) for _ in range(r.randint(3, 90))]
    d = spark.createDataFrame(rows, "g int, v double")
    got = {x.g: x.p for x in measures.percentiles(d, ["g"], "v", {"p": ("linear", 0.95)}).collect()}
    duck.execute("create or replace table percentile_rows (g int, v double)")
    duck.executemany("insert into percentile_rows values (?, ?)", rows)
    assert got == dict(duck.execute("select g, quantile_cont(v, 0.95e0) from percentile_rows group by g").fetchall())


def test_unknown_models_are_refused(spark):
    with pytest.raises(ValueError):
        hooks.generate(spark.createDataFrame([(1, "x")], "id int, text string"), "gone", ["id"])


def test_empty_input(spark):
    assert sequences.fixed_window_limit(events(spark, [])).count() == 0
    assert measures.percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", {"p": ("linear", 0.5)}).count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
