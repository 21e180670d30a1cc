"""Extraction, sinks, events and configuration on small authored inputs."""

from __future__ import annotations

import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from harborlight.functions import text
from harborlight.operators import extract, ingest
from harborlight.sources import config, webhooks

NOW = 1_700_000_000_000


def scrapes(spark, *payloads):
    return spark.createDataFrame([("https://x.com/jobs", i, i, json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(payloads)], "sourceUrl string, startedAt long, completedAt long, payload string")


def test_extract_spellings(spark):
    rows = extract.extract_jobs(
        scrapes(spark, [{"title": "Staff Engineer", "url": "https://A.com/jobs/1/", "salary": {"min": "90,000", "max": "120,000"}, "posted_at": 1_600_000_000}], {"results": {"items": [{"jobTitle": "untitled", "href": "https://b.com/jobs/data-engineer", "location": {"name": "Remote"}}]}}, {"items": [{"title": "No address"}]}, "{bad"), NOW
    ).orderBy("url")
    got = [(r.title, r.url, r.company, r.level, r.remote, r.totalCompensation, r.postedAt, r.postedAtUnknown) for r in rows.collect()]
    assert got == [("Staff Engineer", "https://a.com/jobs/1", "A", "staff", False, 120000.0, 1_600_000_000_000, False), ("data engineer", "https://b.com/jobs/data-engineer", "B", "mid", True, 0.0, NOW, True)]


def test_hints(spark):
    body = "# Senior Engineer in Austin, TX | Acme\n\nLocation: Austin, TX\n\nPay: $120k to $160,000 a year. Hybrid work."
    h = spark.range(1).select(extract.hints(F.lit(body)).alias("h")).first().h
    assert (h.title, h.company, h.level, h.location, h.remote, h.pay, h.currency) == ("Senior Engineer", "Acme", "senior", "Austin, TX", False, 140000, "USD")
    hourly = spark.range(1).select(extract.hints(F.lit("# Junior Cook\n\nRemote. $50 per hour")).alias("h")).first().h
    assert hourly.pay == 104000 and hourly.remote


def test_hints_fill_only_gaps(spark):
    rows = [("v1", "n/a", "unknown", None, True, "# Staff Engineer\nLocation: Boston, MA\n$200,000\nAbout Acme"), ("Bolt", "Chef", "Paris", 5.0, False, "# Staff Engineer")]
    out = extract.patched_by_hints(spark.createDataFrame(rows, "company string, title string, location string, totalCompensation double, compensationUnknown boolean, description string")).drop("description")
    assert sorted(map(tuple, out.collect())) == [("Acme", "Staff Engineer", "Boston, MA", 200000.0, False), ("Bolt", "Chef", "Paris", 5.0, False)]


def test_new_and_ignored_rows(spark):
    rows = spark.createDataFrame([("https://a.com/1", "Data Engineer", 0, 0), ("https://a.com/1", "Data Engineer II", 1, 0), ("https://a.com/2", "Chef", 0, 0), ("https://a.com/3", "Web Engineer", 0, 0)], "url string, title string, startedAt long, completedAt long")
    out = ingest.jobs_of(rows, spark.createDataFrame([("https://a.com/3",)], "url string"), text.has_required_keyword("title", ["engineer"]))
    assert [(r.url, r.title) for r in out["jobs"].collect()] == [("https://a.com/1", "Data Engineer")]
    assert [r.title for r in out["ignored"].collect()] == ["Chef"] and out["details"].count() == 1


def test_webhook_signature(spark):
    body, good = '{"jobId": "1", "type": "completed"}', hmac.new(b"k", b'{"jobId": "1", "type": "completed"}', hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(body, f"sha256={good}"), (body, "00"), (body, None), ("{", hmac.new(b"k", b"{", hashlib.sha256).hexdigest())], "body string, signature string")
    assert [r.error for r in webhooks.verified(rows, "k").collect()] == [None, "bad_signature", "missing_signature", "bad_json"]
    flat = webhooks.flat_events(rows.limit(1)).first()
    assert (flat.jobId, flat.event, flat.status) == ("1", "completed", None)


def test_events_close_pending(spark):
    schema = "jobId string, event string, receivedAt long, processed boolean, error string"
    stored = spark.createDataFrame([("a", "pending", 1, False, None), ("b", "completed", 1, True, None)], schema)
    new = spark.createDataFrame([("a", "completed", 2), ("a", "completed", 3), ("b", "failed", 2), ("c", "pending", 2)], "jobId string, event string, receivedAt long")
    got = {(r.jobId, r.event): (r.processed, r.error) for r in webhooks.upsert_events(stored, new).collect()}
    assert got == {("a", "pending"): (True, "completed"), ("a", "completed"): (False, None), ("b", "completed"): (True, None), ("b", "failed"): (True, "already_processed"), ("c", "pending"): (False, None)}


def test_provider_rows(spark):
    dump = json.dumps([[{"url": "u", "status": 200, "content": {"commonmark": "# Hi"}, "costs": {"total_cost": 0.0012}, "duration_elasped_ms": 7}, {"content": {"raw": "x"}, "meta": {}}]])
    rows = webhooks.provider_rows(spark.createDataFrame([(dump,), (json.dumps({"request": {}, "response": [[{"url": "v"}]]}),)], "body string")).collect()
    assert [(r.url, r.status, r.text, r.cost_milli_cents, r.ms) for r in rows] == [("u", 200, "# Hi", 120, 7), (None, None, "x", None, None), ("v", None, None, None, None)]


def test_site_schedules(spark, tmp_path):
    entry = {"url": "https://x.com/jobs", "name": "X", "enabled": True, "type": "general", "schedule": {"name": "s", "days": ["mon"], "startTime": "08:00", "intervalMinutes": 60, "timezone": "UTC"}}
    (tmp_path / "s.json").write_text(json.dumps({"site_schedules": [entry, {**entry, "url": "https://x.com/jobs/", "name": "Y"}]}))
    rows = config.site_schedules(spark, str(tmp_path / "s.json")).collect()
    assert [(r.key, r.name, r.schedule.days) for r in rows] == [("general:https://x.com/jobs", "X", ["mon"])]


def test_bulk_sites_and_fan_out(spark):
    lines = spark.createDataFrame([("https://a.com, Firecrawl, https://a.com/*, greenhouse",), ("https://b.com",), (" ",)], "value string")
    assert [tuple(r) for r in config.bulk_sites(lines).collect()] == [("https://a.com", "https://a.com/*", "greenhouse", "firecrawl"), ("https://b.com", None, "general", None)]
    c = spark.createDataFrame([("x", 3), ("y", None)], "id string, count int")
    assert sorted(r.id for r in config.fan_out(c).collect()) == ["x", "x-2", "x-3", "y"]


def test_geo_tables(spark, tmp_path):
    (tmp_path / "c.txt").write_text("\t".join(["1", "Austin", *["x"] * 6, "US", "x", "TX", *["x"] * 3, "964254"]) + "\n")
    assert tuple(config.geo_cities(spark, str(tmp_path / "c.txt")).first()) == ("Austin", "US", "TX", 964254)
    rows = spark.createDataFrame([("A", "S", "C", ["x"], False, 5), ("A", "S", "C", ["y", "x"], True, None)], "city string, state string, country string, aliases array<string>, remoteOnly boolean, population long")
    r = config.merge_cities(rows).first()
    assert (r.population, r.aliases, r.remoteOnly) == (5, ["x", "y"], True)


@pytest.mark.parametrize("label,key", [("E-mail address", "email"), ("First Name *", "first_name"), ("Full name", "name"), ("Favourite colour", None)])
def test_form_key(spark, label, key):
    assert spark.range(1).select(extract.form_key(F.lit(label)).alias("k")).first().k == key


def test_cut_banner_and_patterns(spark):
    t = spark.range(1).select(extract.cut_banner(F.lit("We use cookies\nHello\n[](x)\n<br>\nBye")).alias("t")).first().t
    assert t == "Hello\nBye"
    learned = spark.createDataFrame([("d", "pay", "b", 1), ("d", "pay", "a", 9)], "domain string, field string, regex string, successCount int")
    defaults = spark.createDataFrame([("pay", "z", 0)], "field string, regex string, rank int")
    assert extract.ordered_patterns(learned, defaults).first().patterns == ["a", "b", "z"]
