"""Expression tests on literal rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from harborlight.functions import clock, company, location, pay, payload, text, url


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


CASES = [
    (text.is_unknown_label, None, True), (text.is_unknown_label, " N/A ", True), (text.is_unknown_label, " ", True), (text.is_unknown_label, "Acme", False),
    (text.engineer_flag, "Job_Title", True), (text.engineer_flag, "Site Reliability Engineer", True), (text.engineer_flag, "Chef", False),
    (text.slug, "Acme & Sons, Inc.", "acme-sons-inc"), (text.slug, "--", "unknown"), (text.title_case, "open-AI labs", "Open AI Labs"),
    (text.decode_entities, "a &amp;lt; b", "a < b"), (text.escape_html, "<a href='x'>&", "&lt;a href=&#39;x&#39;&gt;&amp;"),
    (text.clean_scraped, "<p>Hi<script>x</script> &amp; bye</p>", "Hi & bye"), (text.clean_scraped, None, ""),
    (text.listing_title, "Staff Engineer @ Acme", "Staff Engineer"), (text.listing_title, "Data Engineer - Remote", "Data Engineer"), (text.listing_title, "Untitled", None), (text.listing_title, "Data Engineer - Platform", "Data Engineer - Platform"),
    (text.normal_title, " ", "Untitled"), (text.is_noisy_title, "see https://x.y", True), (text.is_noisy_title, "Engineer", False),
    (text.is_uuid_like, "123e4567-e89b-12d3-a456-426614174000", True), (text.is_numeric_id, "12", False), (text.mask_secret, "abcdefghijkl", "abcd...ijkl"),
    (url.host, "HTTPS://User@Jobs.Example.COM:8080/a", "jobs.example.com"), (url.host, None, ""), (url.greenhouse_slug, "https://boards.greenhouse.io/v1/boards/Acme/jobs", "acme"),
    (url.greenhouse_slug, "https://boards-api.greenhouse.io/v1", None), (url.ashby_slug, "https://jobs.ashbyhq.com/Acme/1", "acme"), (url.ashby_slug, "https://api.ashbyhq.com/posting-api/job-board/Acme", "acme"),
    (url.company_from_url, "https://acme.wd5.myworkdayjobs.com/x", "Acme"), (url.company_from_url, "https://careers.big-corp.com/x", "Big Corp"), (url.site_name, "https://www.acme.io", "acme"),
    (url.domain_key, "acme.co.uk/jobs", "acme.co.uk"), (url.domain_key, "https://boards.greenhouse.io/acme", "acme.greenhouse.io"),
    (url.job_url, "https://X.com//a\\b//c/#top", "https://x.com/a/b/c"), (url.job_url, "https://jobs.ashbyhq.com/a/1/application", "https://jobs.ashbyhq.com/a/1"), (url.job_url, "https://x.avature.net/careers/SearchJobs", None), (url.job_url, "nothing", None),
    (url.site_url, "boards.greenhouse.io/acme", "https://api.greenhouse.io/v1/boards/acme/jobs"), (url.site_url, "Example.com/a/", "https://example.com/a"),
    (url.title_from_url, "https://x.com/jobs/staff_data-engineer", "staff data engineer"), (url.title_from_url, "https://x.com/jobs/12345", None), (url.fix_scheme, "https:/x.com", "https://x.com"),
    (url.unwrap, "<(https://x.com)>", "https://x.com"), (url.is_link, "mailto:a@b.c", False), (url.is_listing_url, "https://x.com/careers/?a=1", True), (url.is_listing_root, "https://x.com/2/jobs", False), (url.is_auth_url, "https://x.com/Login/a", True),
    (url.apply_url_score, "https://boards-api.greenhouse.io/x", 0), (url.apply_url_score, "", -1),
    (company.filter_key, "Acme Widgets, Inc.", "acmewidgets"), (company.filter_key, "Acme L L C", "acme"), (company.filter_key, "Inc", "inc"), (company.company_key, "!!!", "!!!"), (company.ingest_name, "Acme Group GmbH", "acme"),
    (company.should_override, "v2", True), (company.should_override, "Ashby HQ", True), (company.should_override, "Acme", False),
    (pay.usd, " us$ ", "USD"), (pay.usd, "EUR", None), (pay.pay_from_text, "401k plan and 120,000 to 150,000", 150000), (pay.pay_from_text, "12 days", 0), (pay.pay_from_field, "$12", 12.0),
    (pay.hint_pay, "$100k to $150,000", 125000), (pay.currency_code, "£40,000", "GBP"), (pay.currency_code, "12 lakhs", "INR"), (pay.parse_pay_input, "$150k", 150000), (pay.parse_pay_input, "x", None),
    (pay.level_from_hint, "Director", "staff"), (pay.level_from_hint, "manager", "mid"), (location.state_name, "tx", "Texas"), (location.state_name, "new york", "New York"), (location.state_name, "Paris", None),
    (location.country_of, "Toronto, ON", "Canada"), (location.country_of, "Remote", "United States"), (location.country_of, "Lyon, France", "France"), (location.country_of, "", None),
    (location.folded_key, "São Paulo (BR)", "sao paulo"), (clock.clock_minutes, "25:70", 23 * 60 + 59), (clock.clock_minutes, "8:30", 0),
]


@pytest.mark.parametrize("f,given,expected", CASES, ids=[f"{f.__name__}-{i}" for i, (f, _, _) in enumerate(CASES)])
def test_expression(spark, f, given, expected):
    assert value(spark, f(lit(given))) == expected


def test_level_twins(spark):
    none = F.lit(None).cast("string")
    assert value(spark, pay.level_at_ingest(none, F.lit("Engineering Manager"))) == "senior"
    assert value(spark, pay.level_at_ingest(F.lit("staff"), F.lit("x"))) == "staff"


def test_remote_twins(spark):
    none = F.lit(None).cast("string")
    assert value(spark, pay.remote_at_store(none, F.lit("Austin"), F.lit("Remote Engineer")))
    assert not value(spark, pay.remote_at_ingest(none, F.lit("Austin"), F.lit("Remote Engineer")))


def test_label_ladder(spark):
    u = F.lit("Unknown")
    assert value(spark, location.label(F.lit("Austin"), F.lit("Texas"), u)) == "Austin, Texas"
    assert value(spark, location.label(F.lit("Paris"), u, F.lit("France"))) == "Paris, France"
    assert value(spark, location.short_label(F.lit("Austin"), F.lit("Texas"), u)) == "Austin, TX"
    assert value(spark, location.label(u, u, u)) == "Unknown"


def test_us_first(spark):
    places = F.array(*map(F.lit, ["Berlin, Germany", "Remote", "Austin, Texas"]))
    assert value(spark, location.us_first(places)) == ["Austin, Texas", "Berlin, Germany", "Remote"]


def test_dictionary_longest_phrase(spark):
    rows = spark.createDataFrame([(1, "work from new york city or boston"), (2, "nowhere"), (3, "SF")], "row_id long, t string")
    got = {r.row_id: r.place.city if r.place else None for r in location.resolve_places(rows, "t", location.dictionary(spark)).collect()}
    assert got == {1: "New York", 2: None, 3: "San Francisco"}


def test_posted_at(spark):
    now = F.lit(5)
    assert value(spark, clock.posted_at(F.lit("1700000000"), now)).asDict() == {"ms": 1_700_000_000_000, "unknown": False}
    assert value(spark, clock.posted_at(F.lit("2024-01-02T00:00:00+0000"), now)).asDict() == {"ms": 1_704_153_600_000, "unknown": False}
    assert value(spark, clock.posted_at(F.lit("soon"), now)).asDict() == {"ms": 5, "unknown": True}


def test_slot_in_zone(spark):
    days = F.array(F.lit("mon"))
    at = 1_704_729_600_000  # a Monday, 09:00 in Denver
    assert value(spark, clock.latest_slot(F.lit(at), days, F.lit("08:30"), F.lit(20), "America/Denver")) == at - 10 * 60_000
    assert value(spark, clock.latest_slot(F.lit(at), F.array(F.lit("tue")), F.lit("08:30"), F.lit(20), "America/Denver")) is None


def test_payload_rows(spark):
    doc = '{"items": [{"title": "A", "absolute_url": "u"}], "results": {"items": [{"job_title": "B"}]}}'
    v = payload.variant(F.lit(doc))
    rows = spark.range(1).select(F.explode(payload.payload_rows(v)).alias("r")).select(payload.first_text(F.col("r"), payload.TITLE_KEYS).alias("t"), payload.first_text(F.col("r"), payload.URL_KEYS).alias("u"))
    assert [(r.t, r.u) for r in rows.collect()] == [("A", "u"), ("B", None)]
    assert value(spark, payload.count_rows(payload.variant(F.lit("{bad")))) == 0
    assert value(spark, payload.pay_range(payload.variant(F.lit('{"min": "10,000", "max": null}')))) == 10000.0


def test_links(spark):
    md = F.lit("see [Role A](https://x.com/jobs/1) and https://y.com/careers/2.")
    assert [tuple(r) for r in value(spark, payload.markdown_links(md))] == [("Role A", "https://x.com/jobs/1")]
    assert value(spark, payload.job_links(md)) == ["https://x.com/jobs/1", "https://y.com/careers/2"]


def test_pages(spark):
    u = F.lit("https://x.com/list?page=1&a=b")
    assert value(spark, url.page_urls(u, "page", F.lit(1), F.lit(10), F.lit(25))) == ["https://x.com/list?a=b&page=0", "https://x.com/list?a=b&page=2"]
    assert value(spark, url.offset_urls(F.lit("https://x.com/l"), "offset", F.lit(0), F.lit(20), F.lit(45))) == ["https://x.com/l?offset=20", "https://x.com/l?offset=40"]


def test_job_posting(spark):
    html = '<script type="application/ld+json">{"@type": "JobPosting", "title": "Engineer", "hiringOrganization": {"name": "Acme"}}</script>'
    got = value(spark, payload.job_posting(F.lit(html)))
    assert got.title == "Engineer" and got.hiringOrganization.name == "Acme"


def test_listing_page(spark):
    assert value(spark, text.is_listing_page(F.lit("Jobs"), F.lit("Open positions. Search for opportunities. Select department")))
    assert not value(spark, text.is_listing_page(F.lit("Engineer"), F.lit("Responsibilities: build things")))


def test_string_leaves_skip_keys_and_gaps(spark):
    body = F.lit('{"a": "x", "b": {"c": ["y", 1, "z\\"w"]}, "d": "https:\\/\\/e.com"}')
    assert value(spark, payload.string_leaves(body)) == ["x", "y", 'z"w', "https://e.com"]
    assert value(spark, payload.string_leaves(F.lit("{}"))) == []


def test_distinct_in_order_of_long_lists(spark):
    words = [f"w{i % 5000}" for i in range(20_000)]
    got = value(spark, text.distinct_in_order(F.split(F.lit(" ".join(["B", "unknown", "b", "A", *words])), " ")))
    assert got == ["B", "A", *words[:5000]]
    assert value(spark, text.distinct_in_order(F.array(F.lit(None).cast("string"), F.lit(" ")))) == []


def test_short_label_of_other_countries(spark):
    assert value(spark, location.short_label(F.lit("Perth"), F.lit("Washington"), F.lit("Australia"))) == "Perth, Washington"
    assert value(spark, location.short_label(F.lit("Seattle"), F.lit("Washington"), F.lit("USA"))) == "Seattle, WA"
