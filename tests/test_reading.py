"""Text stripping against literal texts, and odd inputs of the lists."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from harborlight.functions import markdown, text
from harborlight.operators import views


@pytest.fixture(scope="module")
def one(spark):
    return lambda value, f: spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "f, given, want",
    [
        (markdown.html_markdown, "<h1>A</h1><ul><li>b</li><li>c &amp; d</li></ul><script>x</script>", "A\n- b\n- c & d\n\n"),
        (markdown.html_markdown, None, ""),
        (markdown.cut_tag_lines, "a\n<div><br></div>\n<b>kept</b>", "a\n<b>kept</b>"),
        (markdown.cut_empty_links, "a\n[ ](#)\n* [\n](  )\n[x](y)", "a\n[x](y)"),
        (markdown.cut_platform_lines, "Mail_outline\nback\nback to work\nABCDEFGH\nABC", "back to work\nABC"),
        (markdown.cut_json_lines, '{"display_text": 1, "b": 2}\n{"a": 1, "b": 2}\nx', '{"a": 1, "b": 2}\nx'),
        (markdown.cut_json_lines, '`{"branding": 1, "b": "' + "y" * 200 + '"}`\nx', "x"),
        (markdown.cut_theme_objects, 'a {"x": {"themeOptions": {"y": {}}}}  b', "a b"),
        (markdown.cut_theme_objects, "a {b}  c", "a {b}  c"),
        (markdown.cut_tail, "\n".join(["line"] * 12 + ["[", "Apply now", "](/careers/Login?x)", "more"]), "\n".join(["line"] * 12)),
        (markdown.cut_tail, "[\nApply now\n](/careers/login)\nbody", "[\nApply now\n](/careers/login)\nbody"),
        (markdown.cut_tail, "/careers/login", "/careers/login"),
        (markdown.cut_tail, "similar jobs\nx", "similar jobs\nx"),
        (markdown.title_before_bar, "Engineer in Austin | Acme", "Engineer"),
        (markdown.title_before_bar, "Engineer", "Engineer"),
        (markdown.application_title, "Job Application for Cook at Acme", "Cook"),
        (markdown.whole_number, "1.234,00", 1234),
        (markdown.whole_number, "$1,234,567", 1234567),
        (markdown.whole_number, "none", None),
        (markdown.clean_path, "/a//", "/a"),
        (markdown.clean_path, "///", "/"),
        (markdown.url_list, '["a", "", null, "b"]', ["a", "b"]),
        (markdown.url_list, "a", ["a"]),
        (markdown.url_list, None, []),
    ],
)
def test_stripping(one, f, given, want):
    assert one(given, f) == want


@pytest.mark.parametrize(
    "given, description, metadata",
    [
        ("Location\nBerlin\nReq ID\nR12345\n\n## Job Description:\n\nWe cook.", "We cook.", "Location\nBerlin\nReq ID\nR12345"),
        ("We are a firm.\n# Description & Requirements\nWe cook.", "We are a firm.\n\nWe cook.", None),
        ("No heading\nat all", "No heading\nat all", None),
        ("Job details", "Job details", None),
        (None, "", None),
    ],
)
def test_split_description(one, given, description, metadata):
    assert tuple(one(given, markdown.split_description)) == (description, metadata)


def test_meta_description(one):
    page = "<head><title>T &amp; U</title><meta property='og:description' content='two'><meta content=\"one\" name=\"description\"></head>"
    assert one(page, markdown.meta_description) == "T & U\n\none"
    assert one(page.replace('name="description"', ""), markdown.meta_description) == "T & U\n\ntwo"
    assert one("<title>T</title>", markdown.meta_description) is None


def test_error_phrases(one):
    for phrase in text.ERROR_PHRASES:
        assert one(f"Sorry, {phrase.upper()}!", lambda c: text.is_error_landing(F.lit(None).cast("string"), c))
    assert not one("x" * 700 + " job is closed", lambda c: text.is_error_landing(F.lit(""), c))


def test_lists_of_nothing(spark):
    sites = spark.createDataFrame([("a", None, None, None), ("b", True, True, 5)], "siteId string, completed boolean, failed boolean, lastRunAt long").withColumn("lastFailureAt", F.col("lastRunAt"))
    assert [r.siteId for r in views.successful_sites(sites, 0).collect()] == ["b"] and views.failed_sites(sites, 5).count() == 0
    stored = spark.createDataFrame([("f1", 1, "x", 5, True)], "id string, userId long, name string, createdAt long, selected boolean")
    assert views.default_filters(stored.limit(0), stored.select("userId"), 9).first().id == "default-1"
    none = views.select_filter(stored, spark.createDataFrame([(1, None)], "userId long, filterId string"))
    assert none.first().selected is False
    assert views.company_names(spark.createDataFrame([], "name string, aliases array<string>"), spark.createDataFrame([("Acme",)], "input string")).first().names == ["Acme"]
