"""Rules by host suffix and path prefix as a table of any length, met by equality joins: no rule is a node of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import url
from harborlight.functions.text import is_uuid_like

# Hosts that list other companies' jobs, path segments and name parts that name no company.
HOSTED_JOB_DOMAINS = ["avature.net", "avature.com", "searchjobs.com", "greenhouse.io", "ashbyhq.com", "lever.co", "workable.com", "smartrecruiters.com", "myworkdayjobs.com", "icims.com", "jobvite.com", "bamboohr.com"]
DETAIL_SEGMENTS = ["jobdetail", "job-details", "jobdetails"]
RESERVED_SEGMENTS = ["boards", "jobs", "careers", "jobdetail", "apply", "application", "applications", "openings", "positions", "roles", "role", "departments"]

# Fixed values: (site, host suffix, path, kind of paging, parameter, page size, first page, path of one job) of known sites. "page" counts pages, "offset" rows.
SITE_RULES = [
    ("uber", "uber.com", "/", "page", "page", 10, 0, "/global/en/careers/list/{id}"),
    ("netflix", "jobs.netflix.net", "/", "offset", "start", 10, 0, "/careers/job/{id}"),
    ("docusign", "careers.docusign.com", "/", "page", "page", 10, 1, "/jobs/{id}"),
    ("cisco", "careers.cisco.com", "/", "offset", "from", 10, 0, "/global/en/job/{id}"),
    ("adobe", "careers.adobe.com", "/", "offset", "from", 10, 0, "/us/en/job/{id}"),
    ("github", "github.careers", "/", "page", "page", 10, 1, "/careers-home/jobs/{id}"),
    ("confluent", "careers.confluent.io", "/", "page", "page", 10, 1, "/jobs/job/{id}"),
    ("avature", "avature.net", "/", "offset", "jobOffset", 12, 0, "/careers/JobDetail/{id}"),
    ("workday", "myworkdayjobs.com", "/", "offset", "offset", 20, 0, "/job/{id}"),
]
SITE_SCHEMA = "site string, rule_host string, rule_path string, kind string, param string, size int, first int, detail string"


def host_suffixes(host: Column) -> Column:
    """The host and each of its parent domains."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def longest_fit(rows: DataFrame, rules: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Rows with `fit`, the struct of the rule (rule_host, rule_path, ...) that fits: its host is the row's or a parent of it, its path
    begins the row's. The longest host and path together win, of equal ones the last in text order; null without any.

    Different (host, path) pairs are asked once. A pair meets the lengths of the paths that rules of its suffixes have, a few rows
    each, then the rules by (suffix, beginning of that length): both joins are by equality, whatever the number of rules.
    """
    rest = [c for c in rules.columns if c not in ("rule_host", "rule_path")]
    known = rules.where("rule_host <> '' and rule_path is not null").groupBy("rule_host", "rule_path").agg(F.max(F.struct(*rest)).alias("r")) if rest else rules.select("rule_host", "rule_path").distinct().withColumn("r", F.lit(None).cast("struct<>"))
    lengths = known.select(F.col("rule_host").alias("suffix"), F.length("rule_path").alias("n")).distinct()
    pairs = rows.select(F.col(host).alias("h"), F.col(path).alias("p")).where("h <> '' and p is not null").distinct()
    asked = pairs.withColumn("suffix", F.explode(host_suffixes(F.col("h")))).join(lengths, "suffix").where(F.length("p") >= F.col("n"))
    asked = asked.select("h", "p", F.col("suffix").alias("rule_host"), F.substring("p", F.lit(1), F.col("n")).alias("rule_path"))
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.concat("rule_host", "rule_path").alias("rule"))
    best = asked.join(known, ["rule_host", "rule_path"]).groupBy("h", "p").agg(F.max_by(F.struct("rule_host", "rule_path", *(["r.*"] if rest else [])), order).alias("fit"))
    return rows.join(best, (F.col(host) == best.h) & (F.col(path) == best.p), "left").drop("h", "p")


def company_of_address(c: Column | str, hosted: Column) -> Column:
    """The company's domain that an address on a hosting domain names: the first telling segment of its path, else of its subdomains, the nearest first;
    a bare word gets .com. Null where nothing does. hosted: the hosting domain of the address, or null."""
    parts = F.transform(url.segments(c), F.lower)
    stop = F.array_position(F.transform(parts, lambda s: s.isin(DETAIL_SEGMENTS)), True).cast("int")
    open_parts = F.when(stop > 0, F.slice(parts, F.lit(1), stop - 1)).otherwise(parts)
    opaque = lambda s: is_uuid_like(s) | s.rlike("^[0-9a-f]{24,}$")
    domain = lambda s: s.rlike(r"^[a-z0-9-][a-z0-9.-]*\.[a-z0-9.-]*[a-z0-9-]$") & ~s.contains("..")
    telling = F.filter(open_parts, lambda s: ~s.isin(RESERVED_SEGMENTS) & ~s.rlike(r"^\d+$") & ~opaque(s) & (domain(s) | s.rlike("^[a-z0-9-]+$")))
    own = url.host(c)
    subdomains = F.slice(url.labels(own), F.lit(1), F.greatest(F.size(url.labels(own)) - F.size(url.labels(hosted)), F.lit(0)))
    named = F.filter(F.reverse(subdomains), lambda s: ~s.isin(url.GENERIC_SUBDOMAINS) & s.rlike("^[a-z0-9-]+$"))
    slug = F.coalesce(F.get(telling, 0), F.get(named, 0))
    return F.when(hosted.isNotNull(), F.when(slug.contains("."), slug).otherwise(F.concat(slug, F.lit(".com"))))


def listing_pages(rows: DataFrame, address: str, total: str) -> DataFrame:
    """One row for each further page (next) of listings with a `fit` of SITE_SCHEMA: pages by number, or by offset, after the one the address names."""
    fit = F.col("fit")
    given = F.call_function("regexp_extract", F.col(address), F.concat(F.lit("(?i)[?&]"), fit["param"], F.lit(r"=(\d+)")), F.lit(1))
    now = F.coalesce(F.nullif(given, F.lit("")).try_cast("int"), fit["first"])
    paged = fit["kind"] == "page"
    step = F.when(paged, 1).otherwise(fit["size"])
    last = F.when(paged, F.ceil(F.col(total) / fit["size"]) - 1 + fit["first"]).otherwise(F.col(total) - 1).cast("int")
    more = F.when(now + step <= last, F.sequence(now + step, last, step)).otherwise(F.array().cast("array<int>"))
    base = F.regexp_replace(F.regexp_replace(F.col(address), r"#.*$", ""), F.concat(F.lit("(?i)([?&])"), fit["param"], F.lit(r"=[^&]*&?")), F.lit("$1"))
    bare = F.regexp_replace(base, r"[?&]+$", "")
    joined = F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), fit["param"], F.lit("="), F.col("page").cast("string"))
    return rows.where(fit.isNotNull()).withColumn("page", F.explode(more)).withColumn("next", joined)


def detail_address(host: Column, template: Column, job: Column) -> Column:
    return F.concat(F.lit("https://"), host, F.replace(template, F.lit("{id}"), job))
