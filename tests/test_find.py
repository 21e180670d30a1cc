"""As-of joins, text search and rules by host against plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harborlight.functions import url
from harborlight.operators import asof, routes, search


@pytest.mark.parametrize("lookback, bucket", [(0, 10), (7, 10), (35, 10), (100, 7), (1000, 100)])
def test_newest_before(spark, lookback, bucket):
    rng = random.Random(lookback)
    keys = ["hot"] * 6 + ["a", "b", None]
    left = [(i, rng.choice(keys), None if rng.random() < 0.1 else rng.randint(-50, 200)) for i in range(120)]
    right = [(rng.choice(keys), None if rng.random() < 0.1 else rng.randint(-60, 210), rng.randint(0, 3), "x") for _ in range(300)]
    out = asof.newest_before(spark.createDataFrame(left, "n int, k string, t long"), spark.createDataFrame(right, "k string, at long, v int, t string"), "k", "n", "t", "at", lookback, bucket)
    assert out.columns == ["n", "k", "t", "hit"]
    got = {r.n: r.hit and (r.hit["at"], r.hit.v) for r in out.collect()}
    want = {n: max(((a, v) for k2, a, v, _ in right if None not in (k, t, a) and k2 == k and t - lookback <= a <= t), default=None) for n, k, t in left}
    assert got == want


def test_guarded(spark):
    old, new = ["Unknown", "known", None, "x", "known"], ["seen", "n/a", "y", None, " "]
    got = [r[0] for r in spark.createDataFrame(list(zip(old, new)), "o string, n string").select(asof.guarded(F.col("o"), F.col("n"))).collect()]
    assert got == ["seen", "known", "y", "x", "known"]


def test_search_reads_and_ranks_the_asked_postings(spark, monkeypatch):
    rng = random.Random(2)
    words = ["Job", "dev", "Müller", "42", "x-y", "", "rare"]
    docs = [(i, None if i == 5 else " ".join(rng.choice(words[:6]) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(70, "rare job")]
    queries = [(1, "JOB rare"), (2, "müller, x"), (3, ""), (4, None), (5, "nowhere"), (6, "42 42 dev")]
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    counts = {i: Counter(cut(t)) for i, t in docs}
    df = Counter(w for c in counts.values() for w in c)

    def plain(k):
        out = []
        for q, text in queries:
            score = {i: round(sum((1 + math.log(c[w])) * math.log((len(docs) + 1) / df[w]) for w in set(cut(text)) if c[w]), 6) for i, c in counts.items() if any(c[w] for w in set(cut(text)))}
            out += [(q, n, i, s) for n, (i, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
        return out

    index = search.TextIndex.build(spark.createDataFrame(docs, "i long, t string"), "i", "t")
    asked = spark.createDataFrame(queries, "q int, t string")
    result = index.search(asked, "q", "t", 7)
    assert sorted(map(tuple, result.collect())) == plain(7)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder", "folder") or re.search(r"PartitionFilters: \[[^\]]*folder", plan)
    assert "MapInArrow" in plan  # a posting is read once, whatever number of queries asks its token
    monkeypatch.setattr(search, "NAMED", 1)
    assert sorted(map(tuple, index.search(asked, "q", "t", 7).collect())) == plain(7)
    assert index.search(asked.limit(0), "q", "t", 7).count() == 0
    monkeypatch.setattr(search, "BLOCK", 2)
    assert sorted(map(tuple, index.search(asked, "q", "t", 1).collect())) == plain(1)
    monkeypatch.setattr(search, "PAIRS", 1)
    assert sorted(map(tuple, index.search(asked, "q", "t", 7).collect())) == plain(7)


def test_lists_merge_at_first_places(spark):
    rows = [(1, 0, 1, "a"), (1, 0, 2, "b"), (1, 1, 1, "b"), (1, 1, 2, "c"), (1, 1, 3, "a"), (2, 1, 5, "z")]
    got = search.merged_lists(spark.createDataFrame(rows, "q int, no int, rank int, item string"), "q", "no", "rank", "item").collect()
    assert sorted((r.q, r.position, r.item) for r in got) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "z")]


def test_longest_fit(spark):
    rng = random.Random(3)
    hosts = ["com", "e.com", "a.e.com", "b.a.e.com", "xe.com", "org", ""]
    paths = ["", "/", "/en", "/en/", "/en/7", "/de/8/x"]
    rules = [(h, p, rng.choice("ab")) for h in hosts for p in paths if rng.random() < 0.5]
    rows = [(i, rng.choice([*hosts, None]), rng.choice([*paths, "/en/71", None])) for i in range(200)]
    out = routes.longest_fit(spark.createDataFrame(rows, "i int, host string, path string"), spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string"))
    got = {r.i: r.fit and tuple(r.fit) for r in out.collect()}

    def plain(h, p):
        fits = [r for r in rules if h and p is not None and r[0] and (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
        return max(fits, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1]), default=None)

    assert got == {i: plain(h, p) for i, h, p in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(
    "address, domain",
    [
        ("https://boards.greenhouse.io/Acme/jobs/12", "acme.com"),
        ("https://boards.greenhouse.io/jobs/550e8400-e29b-41d4-a716-446655440000/acme.io", "acme.io"),
        ("https://acme.wd1.myworkdayjobs.com/JobDetail/else", "wd1.com"),
        ("https://jobs.acme.avature.net/careers/JobDetail/1", "acme.com"),
        ("https://jobs.lever.co/", None),
        ("https://acme.com/jobs", None),
    ],
)
def test_company_of_hosted_addresses(spark, address, domain):
    hosts = spark.createDataFrame([(d, "") for d in routes.HOSTED_JOB_DOMAINS], "rule_host string, rule_path string")
    row = spark.createDataFrame([(address,)], "u string").withColumns({"host": url.host("u"), "path": url.path("u")})
    assert routes.longest_fit(row, hosts).select(routes.company_of_address("u", F.col("fit.rule_host"))).first()[0] == domain


def test_pages_of_known_sites(spark):
    rows = [("https://www.uber.com/careers/list?q=1&Page=1#x", 35), ("https://explore.jobs.netflix.net/careers?start=10&num=10", 30), ("https://careers.docusign.com/jobs", 25), ("https://a.wd5.myworkdayjobs.com/s", 20), ("https://other.org/", 99)]
    df = spark.createDataFrame(rows, "u string, total int").withColumns({"host": url.host("u"), "path": url.path("u")})
    rules = spark.createDataFrame(routes.SITE_RULES, routes.SITE_SCHEMA)
    got = sorted((r.fit.site, r.page, r.next) for r in routes.listing_pages(routes.longest_fit(df, rules), "u", "total").collect())
    assert got == [
        ("docusign", 2, "https://careers.docusign.com/jobs?page=2"),
        ("docusign", 3, "https://careers.docusign.com/jobs?page=3"),
        ("netflix", 20, "https://explore.jobs.netflix.net/careers?num=10&start=20"),
        ("uber", 2, "https://www.uber.com/careers/list?q=1&page=2"),
        ("uber", 3, "https://www.uber.com/careers/list?q=1&page=3"),
    ]
