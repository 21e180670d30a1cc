"""Notices, menus, page kinds, form plans, scrape logs, shown pay and checked leases against plain loops and literal rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from harborlight.bindings import NOW_MS
from harborlight.functions import markdown, pages, pay, payload
from harborlight.operators import forms, queue, rollups, views


def _texts(spark, texts, f):
    return [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def _is_tag(s):
    return bool(re.fullmatch(r"\s*<.*>\s*", s)) and not re.sub("<[^>]*>", "", s).strip(" ")


def _cut(lines, first, last, before, after):
    while first > 0 and before(lines[first - 1]):
        first -= 1
    while last + 1 < len(lines) and after(lines[last + 1]):
        last += 1
    return "\n".join(lines[:first] + lines[last + 1 :]).strip("\n")


def test_notices_against_a_loop(spark):
    rng = random.Random(5)
    parts = ["Accept all", "cookie  policy", "We use cookies; GTM", "text", "", "<br>", "Preferences", "a cookie"]
    texts = ["\n".join(rng.choice(parts[: rng.choice([3, 8])]) if rng.random() < 0.5 else rng.choice(parts[3:6]) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    texts += [None, "", "cookie policy\n" + "x\n" * gap + "manage cookies" if (gap := 239) else "", "cookie policy\n" + "x\n" * 240 + "manage cookies", "Cookie policy, reject all cookies", "cookie policy\naccept all cookies"]
    signal = re.compile("|".join(w.replace(" ", r"\s+") for w in markdown.COOKIE_SIGNALS), re.I)
    control = re.compile("|".join(w.replace(" ", r"\s+") for w in markdown.COOKIE_CONTROLS), re.I)

    def plain(t):
        lines = (t or "").split("\n")
        hits = [i for i, s in enumerate(lines) if signal.search(s)]
        if len(hits) < 2 or sum(bool(re.search(r"\bcookies?\b", s, re.I)) for s in lines) < 2 or hits[-1] - hits[0] > 240:
            return t or ""
        soft = lambda s: not s.strip() or _is_tag(s)
        return _cut(lines, hits[0], hits[-1], soft, lambda s: soft(s) or bool(control.fullmatch(s.strip()))) or (t or "").strip("\n")

    assert _texts(spark, texts, markdown.cut_notice) == [plain(t) for t in texts]


def test_menus_against_a_loop(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(150):
        body = [rng.choice([*markdown.MENU, "# Careers ", "### Sales", "", " ", "words", "sales"]) if rng.random() < 0.8 else "words" for _ in range(rng.randint(0, 30))]
        texts.append("\n".join(["lead"] * rng.choice([0, 1, 119, 120, 121, 190]) + body + ["tail"] * rng.randint(0, 2)))
    texts += [None, "", "\n".join(markdown.MENU)]

    def plain(t):
        lines = (t or "").split("\n")
        word = lambda s: s.strip().lstrip("#").strip() in {*markdown.MENU, "Careers"}
        hits = [i for i, s in enumerate(lines[:200]) if word(s)]
        if len(hits) < 8 or hits[0] > 120:
            return t or ""
        solid = sum(bool(s.strip()) for s in lines[hits[0] : hits[-1] + 1])
        if len(hits) < max(8, int(solid * 0.6)):
            return t or ""
        return _cut(lines, hits[0], hits[-1], lambda s: not s.strip(), lambda s: not s.strip() or word(s)) or (t or "").strip("\n")

    got = _texts(spark, texts, markdown.cut_menu)
    assert got == [plain(t) for t in texts]
    assert sum(g != (t or "") for g, t in zip(got, texts)) > 20


def test_menu_runs_and_the_whole_chain(spark):
    run = " ".join(markdown.MENU)
    assert _texts(spark, [f"a {run}  ### careers\n{run.upper()} b", run[:-9], None], markdown.cut_menu_run) == ["a \n b", run[:-9], None]
    body = "\n".join(["Cookie policy", "Manage cookies", "", "<div></div>", *markdown.MENU, "Build things", "BACK", "similar jobs", "other"])
    assert _texts(spark, [body, None, ""], markdown.strip_known_blocks) == ["Build things", "", ""]


def test_listing_cards(spark):
    card = "Engineer\nApply now\nPosted 2 days ago\nhttps://x.com/jobs)."
    rows = [card, card + "\nRequirements", card + "\nx" * 11, card + "\n" + "y" * 500, "View job Apply now https://x.com/careers", "Apply now https://x.com/careers", "View job Apply now https://x.com/1/careers", "View job, apply now", None, ""]
    assert _texts(spark, rows, lambda t: pages.is_listing_card(F.lit("t"), t, F.lit(None).cast("string"))) == [True, False, False, False, True, False, False, False, False, False]
    assert _texts(spark, ["View job, apply now"], lambda t: pages.is_listing_card(F.lit(None).cast("string"), t, F.lit("https://x.com/openings/"))) == [True]


def test_places_boards_payloads_and_metadata(spark):
    spots = ["Austin, TX", "a", "Unknown", "Remote in any of many far places", "one two three four five", "a, b, c, d", "one two three four, x", "Pay range", "Berlin (401k)", None, "x" * 101, "Austin,, TX,"]
    assert _texts(spark, spots, pages.is_plausible_place) == [True, False, False, True, False, False, False, False, False, False, False, True]
    boards = ["https://boards.greenhouse.io/acme/", "https://boards.greenhouse.io/acme/jobs/1", "https://api.greenhouse.io/v1/boards/a/jobs?x", "https://boards.greenhouse.io", "https://x.com/jobs", None]
    assert _texts(spark, boards, pages.is_board_address) == [True, False, True, False, False, False]
    bodies = ['{"singleview": true}', '{"singleview": 1}', '{"singleview": 0}', '{"singleview": "1"}', '{"positions": [1], "pid": 5}', '{"positions": [1], "pid": ""}', '{"positions": [1], "count": 1}', '{"positions": [1, 2], "pid": 5}', "x", None, "[]"]
    assert _texts(spark, bodies, lambda t: pages.is_detail_payload(payload.variant(t))) == [True, True, False, False, True, False, True, False, False, False, False]
    texts = ["x" * 199, "x" * 199 + " salary", "x" * 300, "x" * 300 + " Salary", "x" * 300 + " salary, saved jobs, job alerts", None]
    assert _texts(spark, texts, pages.prefers_structured) == [True, False, True, False, True, True]
    block = "Location: Rome\nTeam\n\n* Core\nR12345\n# Job description\nwords"
    pairs = [(block, "rome"), (block, " CORE"), (block, "R12345"), (block, ""), (None, "x"), (block, None), ("Rome", "Rome")]
    got = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, b string, t string").orderBy("i").select(pages.title_is_metadata("b", "t")).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False]


def test_form_plan(spark):
    entries = [(1, "first_name", "Ann"), (1, "last_name", "Lee"), (1, "email", "b@x"), (1, "email", "a@x"), (1, "phone", " "), (1, "notice_period", "2 weeks"), (1, "notice", "soon"), (2, "full_name", "Bo"), (2, "first_name", "B"), (None, "email", "z"), (3, "first_name", "Cy")]
    rows = [
        (1, "Your Name", "name", None, None, "input", "text"), (1, "NAME", None, None, None, "input", "text"), (1, "Notice (period)", None, None, None, "SELECT", None), (1, "", "x", "contact", "c", "input", "email"),
        (1, "Call me", None, None, None, "input", "tel"), (2, "full name", None, None, None, "input", "radio"), (2, None, None, None, None, "input", "file"), (9, "email", None, None, None, "input", "text"), (None, "email", None, None, None, None, None),
        (3, "Full name", None, None, None, "input", "text"),
    ]
    fields = spark.createDataFrame([(7, i, *r) for i, r in enumerate(rows)], "form int, field int, person int, label string, placeholder string, name string, id string, tag string, kind string")
    out = forms.fill_plan(fields, spark.createDataFrame(entries, "person int, entry string, value string"))
    assert {r.field: (r.op, r.entry, r.value) for r in out.collect()} == {
        0: ("type", "full_name", "Ann Lee"), 1: ("type", "full_name", "Ann Lee"), 2: ("select", "notice_period", "2 weeks"), 3: ("type", "email", "a@x"), 4: ("type", None, None),
        5: ("check", "full_name", "Bo"), 6: ("upload", None, None), 7: ("type", "email", None), 8: ("type", "email", None), 9: ("type", "full_name", "Cy"),
    }
    assert out.count() == len(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert forms.fill_plan(fields.limit(0), spark.createDataFrame(entries, "person int, entry string, value string")).count() == 0


def test_scrape_log(spark):
    jobs = spark.createDataFrame([("b", "https://x/1/"), ("a", "https://x/1"), ("c", "https://x"), ("d", None)], "_id string, url string")
    scrapes = [("s1", "https://x", ["https://x/1//", None, "https://x/2"], ["https://x/9"]), ("s2", "https://y", [], ["https://x/1", "https://x/3"]), ("s3", "https://x/", None, None), ("s4", None, None, []), ("s5", "https://y", [" "], None)]
    df = spark.createDataFrame([(*s[:2], 5, *s[2:]) for s in scrapes], "scrapeId string, sourceUrl string, at long, rows array<string>, links array<string>")
    got = sorted(((r.scrapeId, r.url, r.reason, r.action, r.jobId, r.rowCount, r.linkCount) for r in views.scrape_log(df, jobs).collect()), key=str)
    assert got == sorted([
        ("s1", "https://x/1//", "already_saved", "skipped", "a", 3, 1), ("s1", "https://x", "missing_url", "skipped", "c", 3, 1), ("s1", "https://x/2", None, "scraped", None, 3, 1),
        ("s2", "https://x/1", "listing_only", "skipped", "a", 0, 2), ("s2", "https://x/3", "listing_only", "skipped", None, 0, 2), ("s3", "https://x/", "no_items_existing_job", "skipped", "c", 0, 0),
        ("s4", "unknown", "no_items", "skipped", None, 0, 0), ("s5", "https://y", "missing_url", "scraped", None, 1, 0),
    ], key=str)


@pytest.mark.parametrize("value, code, shown", [(1234567.5, "USD", "$1,234,568"), (0.4, "eur", "€0"), (-2.6, "GBP", "-£3"), (5.0, "SEK", "SEK 5"), (5.0, "us$", "$5"), (None, "USD", "Unknown"), (7.0, None, "$7")])
def test_money(spark, value, code, shown):
    assert spark.createDataFrame([(value, code)], "v double, c string").select(pay.money("v", "c")).first()[0] == shown


def test_pay_shown(spark):
    caps = spark.createDataFrame([("Acme", 1, 100, 200, 0), ("No Mid", 1, None, 5, 6)], "company string, cap_junior long, cap_mid long, cap_senior long, cap_staff long")
    rows = [("a c-me", " Senior", None, None), ("Acme", "staff", None, None), ("Acme", "vp", 5.0, True), ("Acme", None, 5.0, None), ("No Mid", "staff", None, None), (None, "mid", None, None), ("", "mid", 9.0, False)]
    jobs = spark.createDataFrame([(i, *r, " why " if i == 4 else None, "EUR") for i, r in enumerate(rows)], "i int, company string, level string, totalCompensation double, compensationUnknown boolean, compensationReason string, currencyCode string")
    got = [(r.payShown, r.payUnknown, r.payEstimated, r.payReason) for r in rollups.pay_shown(jobs, caps).orderBy("i").collect()]
    cap, given, none = "Company salary cap from config", "Compensation provided in listing", pay.NO_PAY_REASON
    assert got == [("€200", False, True, cap), ("€100", False, True, cap), ("€100", False, True, cap + " (mid-level fallback)"), ("€5", False, False, given), ("Unknown", True, False, "why"), ("Unknown", True, False, none), ("€9", False, False, given)]


def _queue(spark, rows):
    schema = "url string, sourceUrl string, siteId string, status string, attempts int, createdAt long, updatedAt long, scheduledAt long"
    return spark.createDataFrame([(u, "s", None, "pending", a, NOW_MS - 1000, None, n) for n, (u, a) in enumerate(rows)], schema)


def test_lease_goes_on_while_a_batch_is_skipped_whole(spark):
    seen = spark.createDataFrame([("s", "https://x/seen"), ("other", "https://x/b")], "sourceUrl string, url string")
    rows = [("https://x/login", 0), ("https://x/seen", 0), ("https://x/a/sso", 0), ("https://x/seen", 0), ("https://x/b", 1), ("https://x/worn/login", 9)]
    out = queue.lease_fit(_queue(spark, rows), seen, NOW_MS, 2)
    assert [r.url for r in out["leased"].collect()] == ["https://x/b"] and out["leased"].first().attempts == 2
    assert sorted(map(tuple, out["skipped"].collect())) == [("https://x/a/sso", "auth_url"), ("https://x/login", "auth_url"), ("https://x/seen", "skip_listed_url")]
    worn = queue.lease_fit(_queue(spark, [("https://x/worn/login", 9), ("https://x/c", 9), ("https://x/d", 2)]), seen, NOW_MS, 3)
    assert [r.url for r in worn["leased"].collect()] == ["https://x/d"]
    assert sorted(map(tuple, worn["skipped"].collect())) == [("https://x/c", "max_attempts_exceeded"), ("https://x/worn/login", "max_attempts_exceeded")]
    none = queue.lease_fit(_queue(spark, [(f"https://x/{i}/login", 0) for i in range(9)]), seen, NOW_MS, 2)
    assert none["leased"].count() == 0 and none["skipped"].count() == 6
    empty = queue.lease_fit(_queue(spark, rows).limit(0), seen, NOW_MS, 2)
    assert empty["leased"].count() == 0 and empty["skipped"].count() == 0


def test_verdicts(spark):
    rows = [(["", None, "u"], "s", "stored"), (["u"], "s", "invalid_scrape"), (None, " s ", None), ([None], "t", "stored"), ([], None, "stored")]
    got = queue.verdicts(spark.createDataFrame(rows, "subUrls array<string>, sourceUrl string, outcome string")).collect()
    assert sorted(map(tuple, got)) == [("s", "failed", "store_scrape_failed"), ("t", "completed", None), ("u", "invalid", "invalid_job_data")]
