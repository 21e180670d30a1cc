"""Operators on small authored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlight.functions import location
from harborlight.operators import filters, merge, queue, rollups
from harborlight.streaming import flows

JOB = "_id string, company string, companyKey string, level string, totalCompensation double, currencyCode string, compensationUnknown boolean, url string, postedAt long, scrapedAt long, _creationTime long"


def test_rollup_golden(spark):
    rows = [
        ("1", "Acme Inc", None, "junior", 100000.0, "USD", False, "u1", 100, None, 90), ("2", "acme", None, "junior", 200000.0, "INR", False, "u2", 200, 500, 91),
        ("3", "Acme, LLC", None, "junior", 150000.0, "$", False, " ", 150, None, 92), ("4", "Acme", None, "junior", 175000.0, "USD", True, "u4", 50, 700, 93), ("5", "Acme", None, "junior", None, "USD", None, None, 250, None, 94),
        ("6", "n/a", None, "mid", 1.0, "USD", False, None, 1, 1, 1),
    ]
    got = rollups.company_summaries(spark.createDataFrame(rows, JOB)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.key, r.n_jobs, r.name, r.sample_url, r.currency, r.avg_junior, r.avg_mid, r.last_posted, r.last_scraped) == ("acme", 5, "acme", "u1", "USD", 125000.0, None, 250, 700)


def test_rollup_without_dollars(spark):
    r = rollups.company_summaries(spark.createDataFrame([("1", "Acme", None, "mid", 9e6, "INR", False, "u", 1, 1, 1)], JOB)).first()
    assert r.currency is None and r.avg_mid is None


def test_caps_fill_and_never_fall(spark):
    m = spark.createDataFrame([("Acme", "mid", 100_400.0), ("Acme", "senior", 90_000.0), ("Bolt", "senior", 180_000.0), (None, "mid", 1.0)], "company string, level string, top double")
    got = {r.company: (r.cap_junior, r.cap_mid, r.cap_senior, r.cap_staff) for r in rollups.pay_caps(m).collect()}
    assert got["Acme"] == (0, 100_000, 100_000, 100_000)
    assert got["Bolt"][1:3] == (134_000, 180_000)


QUEUE = "url string, sourceUrl string, siteId string, status string, attempts int, createdAt long, updatedAt long, scheduledAt long"


def test_lease_is_fair(spark):
    now = 100 * 86_400_000
    rows = [(f"a{i}", "s", "A", "pending", 0, now - 10 + i, None, now - 100 + i) for i in range(5)] + [("b0", "s", "B", "pending", 0, now, None, now), ("c0", "s", None, "processing", 1, now - 10, now - 90_000_000, now - 200), ("old", "s", "A", "pending", 0, 1, None, 1), ("late", "s", "A", "pending", 0, now, None, now + 1)]
    out = queue.lease(spark.createDataFrame(rows, QUEUE), now, 3)
    assert {r.url for r in out["leased"].collect()} == {"a0", "b0", "c0"}
    assert [r.url for r in out["expired"].collect()] == ["old"]
    assert {r.attempts for r in out["leased"].collect()} == {1, 2}


def test_complete(spark):
    q = spark.createDataFrame([("a", "s", "A", "processing", 1, 1, 1, 1), ("b", "s", "A", "processing", 3, 1, 1, 1), ("c", "s", "A", "processing", 1, 1, 1, 1)], QUEUE)
    r = spark.createDataFrame([("a", "completed", None), ("b", "failed", "x"), ("c", "failed", "HTTP 404")], "url string, new_status string, error string")
    out = queue.complete(q, r, 9)
    assert [(x.url, x.status, x.completedAt) for x in out["queue"].collect()] == [("a", "completed", 9)]
    assert {(x.url, x.reason) for x in out["ignored"].collect()} == {("b", "max_attempts"), ("c", "http_404")}


def test_upsert_and_insert(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, n int")
    delta = spark.createDataFrame([(2, None, 5), (3, "c", 7)], "k int, name string, n int")
    assert sorted(map(tuple, merge.upsert(base, delta, ["k"]).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 7)]
    assert sorted(map(tuple, merge.upsert(base, delta, ["k"], delete_absent=True).collect())) == [(2, "b", 5), (3, "c", 7)]
    new = merge.insert_absent(base, spark.createDataFrame([(3, "x", 2), (3, "y", 1), (1, "z", 0)], "k int, name string, n int"), ["k"], [F.col("n")])
    assert [r.name for r in new.collect()] == ["y"]


def test_seed_listings(spark):
    jobs = spark.createDataFrame([("https://x.com/jobs/", "All", "job openings"), ("https://x.com/jobs/1", "Engineer", "build")], "url string, title string, description string")
    kept, dropped = filters.seed_listings(jobs, spark.createDataFrame([("https://x.com/jobs",)], "seed_url string"))
    assert [r.url for r in kept.collect()] == ["https://x.com/jobs/1"] and dropped.count() == 1


def test_repaired(spark):
    kids = spark.createDataFrame([("1", "p1"), ("2", "old"), ("3", "gone")], "id string, ref string")
    parents, hops = spark.createDataFrame([("p1",), ("p2",)], "_id string"), spark.createDataFrame([("old", "p2")], "old string, new string")
    assert sorted(map(tuple, merge.repaired(kids, parents, hops, "ref").collect())) == [("1", "p1"), ("2", "p2")]


def test_repaired_joins_only_real_references(spark):
    """References without a hop met as nulls in one task; a direct reference is one row, whatever hops there are."""
    kids = spark.createDataFrame([("1", "p1"), ("2", "old"), ("3", None), ("4", "old"), ("5", "lost")], "id string, ref string")
    parents = spark.createDataFrame([("p1",), ("p2",), ("p1",)], "_id string")
    hops = spark.createDataFrame([("old", "p2"), ("old", "gone"), ("p1", "p2"), ("p1", "p1"), ("lost", "gone"), (None, "p1")], "old string, new string")
    got = merge.repaired(kids, parents, hops, "ref")
    assert sorted(map(tuple, got.collect())) == [("1", "p1"), ("2", "p2"), ("4", "p2")]
    assert "LeftOuter" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_recover_late_timer(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "view"), (1, "2024-01-01 01:00:00", "purchase"), (2, "2024-01-01 00:00:00", "view")]
    schema = "user_id long, ts timestamp, event_type string"
    for i, part in enumerate([rows, [(9, "2024-01-05 00:00:00", "view")], [(9, "2024-01-05 00:00:01", "view")]]):
        df = spark.createDataFrame([(u, t, e) for u, t, e in part], "user_id long, t string, event_type string").select("user_id", F.to_timestamp("t").alias("ts"), "event_type")
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = flows.run_once(flows.recover_late(stream, "user_id", "purchase", 23 * 3_600_000), "late", checkpoint=str(tmp_path / "state"))
    outcome = {r.user_id: r.outcome for r in got.collect()}
    assert outcome[1] == "closed" and outcome[2] == "expired"


def test_recover_late_takes_the_first_of_many_closings(spark, tmp_path):
    rows = spark.range(30_000).select(F.lit(1).cast("long").alias("user_id"), F.timestamp_millis(F.lit(1_704_067_200_000) - F.col("id")).alias("ts"), F.lit("done").alias("event_type"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = flows.run_once(flows.recover_late(stream, "user_id", "done", 1000), "late_many", checkpoint=str(tmp_path / "state"))
    assert [(r.outcome, r.at) for r in got.collect()] == [("closed", 1_704_067_200_000 - 29_999)]


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:03:00", "a")], "t string, k string").select(F.to_timestamp("t").alias("ts"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    got = flows.run_once(flows.windowed_counts(stream, ["k"], "1 minute", "5 minutes"), "win", mode="complete").collect()
    assert [(r.k, r.n) for r in got] == [("a", 2)]


def test_places_of_long_keys(spark):
    """Keys of more than four words, and whole texts, are found."""
    keys = location.dictionary(spark, [("San Francisco Bay Area", "California", "United States", [], False), ("Bay", "Texas", "United States", [], False)])
    rows = spark.createDataFrame([(1, "Office: San Francisco Bay Area United States, now"), (2, "the bay"), (3, "San Francisco Bay Area California"), (4, "")], "row_id int, place_text string")
    got = {r.row_id: r.place and (r.place.city, r.place.phrase) for r in location.resolve_places(rows, "place_text", keys).collect()}
    assert got == {1: ("San Francisco Bay Area", "san francisco bay area united states"), 2: ("Bay", "bay"), 3: ("San Francisco Bay Area", "san francisco bay area california"), 4: None}


def test_requests_are_sorted_once(spark):
    now = 10 * 86_400_000
    req = spark.createDataFrame([(" https://a.com/1 ", "s", None, 2), ("https://a.com/1", "t", 5, 1), ("https://a.com/2", "s", 0, 3), ("https://a.com/3", "s", 0, 4), ("https://a.com/4", "s", 0, 5), ("https://a.com/5", "s", 0, 6), ("", "s", 0, 7)], "url string, sourceUrl string, delay_ms long, pos long")
    stored = spark.createDataFrame([("https://a.com/2", "completed", now, now), ("https://a.com/3", "pending", now, now)], "url string, status string, createdAt long, updatedAt long")
    out = queue.enqueue(req, stored, spark.createDataFrame([("https://a.com/4",)], "url string"), spark.createDataFrame([("https://a.com/5",)], "url string"), now)
    assert {k: sorted(r.url[-1] for r in df.collect()) for k, df in out.items()} == {"seen": ["4"], "requeued": ["2"], "inserted": ["1"]}
    row = out["inserted"].first()
    assert (row.sourceUrl, row.scheduledAt, row.attempts, row.status) == ("t", now + 5, 0, "pending")


def test_requests_meet_every_spelling_once(spark):
    """Jobs are found under any spelling of an address; spellings are computed once a request, and what is known meets it in one exchange."""
    urls = ["https://A.com//x/", "https://a.com/y/#top", "\u00a0https://a.com/z", "https://a.com/w", "https://a.com/w", "https://a.com/v"]
    jobs = spark.createDataFrame([(u,) for u in ("https://a.com/x", "https://a.com/y", "https://a.com/z", "\u00a0https://a.com/w", "https://a.com/v", "https://a.com/v")], "url string")
    req = spark.createDataFrame([(u, "s", 0, n) for n, u in enumerate(urls)], "url string, sourceUrl string, delay_ms long, pos long")
    stored = spark.createDataFrame([("https://a.com/w", "pending", 10 * 86_400_000, 10 * 86_400_000)], "url string, status string, createdAt long, updatedAt long")
    out = queue.sorted_requests(req, stored, jobs, jobs.limit(0), 10 * 86_400_000)
    assert sorted((r.url, r.kind, r.pos) for r in out.collect()) == sorted([(urls[0], "seen", 0), (urls[1], "seen", 1), (urls[2], "seen", 2), ("https://a.com/w", "kept", 3), ("https://a.com/v", "seen", 5)])
    steps = out.select("url", "kind")._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert not [x for x in steps if "Aggregate" in x and "regexp_extract" in x or "Generate" in x and "regexp" in x]
    assert len([x for x in steps if "HashAggregate" in x]) == 2 and len([x for x in steps if "Join" in x]) == 1


def test_queue_rows_without_a_time(spark):
    """A row that doesn't say when it was created has no age: it is leased, not expired, and not purged."""
    from harborlight.operators import queue

    now = 10 * queue.TTL_MS
    schema = "url string, sourceUrl string, siteId string, status string, attempts int, createdAt long, updatedAt long, scheduledAt long"
    rows = [("u1", "s", "x", "pending", 0, None, None, None), ("u2", "s", "x", "pending", 0, now, now, None), ("u3", "s", "x", "pending", 0, 1, now, None), ("u4", "s", "x", None, 0, 1, None, None), ("u5", "s", "x", "processing", 1, None, None, None), ("u6", "s", "x", "completed", 1, 1, 1, 1)]
    q = spark.createDataFrame(rows, schema)
    out = queue.lease(q, now, 10)
    assert sorted(r.url for r in out["leased"].collect()) == ["u1", "u2", "u5"]  # u5's lease has no time either, and is past
    assert [r.url for r in out["expired"].collect()] == ["u3"]
    assert sorted(r.url for r in queue.purge(q, now).collect()) == ["u1", "u2", "u4", "u5", "u6"]
