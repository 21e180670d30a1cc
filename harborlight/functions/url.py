"""URL and host expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions.base import col, lower, trim
from harborlight.functions.text import is_numeric_id, is_uuid_like, title_case

# Hosts of job-board providers, subdomains that name no company, last segments of listing pages.
WORKDAY, ASHBY = "myworkdayjobs.com", "ashbyhq.com"
GENERIC_SUBDOMAINS = ["www", "jobs", "careers", "boards", "board", "apply", "app", "join", "team", "teams", "work"]
LISTING_SEGMENTS = ["jobs", "careers", "openings", "job-openings", "all-jobs", "positions", "opportunities"]
AUTH_SEGMENTS = ["login", "signin", "sign-in", "signup", "sign-up", "register", "auth", "account", "password", "sso", "logout"]
SITE_TYPES = ["general", "greenhouse", "ashby", "workday", "avature", "netflix", "uber", "docusign", "cisco", "adobe", "confluent", "github", "notion"]


def with_scheme(c: Column | str) -> Column:
    u = trim(col(c))
    return F.when(u.contains("://"), u).otherwise(F.concat(F.lit("https://"), u))


def host(c: Column | str) -> Column:
    """Lower-cased host without user and port; empty for no address."""
    return _host(with_scheme(c))


def _host(u: Column) -> Column:
    return F.coalesce(lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def path(c: Column | str) -> Column:
    return _path(with_scheme(c))


def _path(u: Column) -> Column:
    return F.coalesce(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def query(c: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(col(c), r"^[^?#]*(\?[^#]*)", 1), F.lit(""))


def segments(c: Column | str) -> Column:
    return F.filter(F.split(path(c), "/"), lambda s: s != "")


def labels(h: Column) -> Column:
    return F.filter(F.split(h, r"\."), lambda s: s != "")


def base_domain(h: Column) -> Column:
    """Registrable domain by rule: three labels where one of the last two has two letters."""
    p = labels(h)
    n = F.size(p)
    short = (F.length(F.try_element_at(p, F.lit(-1))) == 2) | (F.length(F.try_element_at(p, F.lit(-2))) == 2)
    take = F.when(short & (n >= 3), 3).otherwise(2)
    return F.when(n <= 1, h).otherwise(F.array_join(F.slice(p, -F.least(take, n), F.least(take, n)), "."))


def _segment_after(c: Column | str, word: str) -> Column:
    s = segments(c)
    i = F.array_position(F.transform(s, F.lower), word).cast("int")
    return lower(F.when((i > 0) & (i < F.size(s)), F.try_element_at(s, i + 1)).otherwise(F.try_element_at(s, F.lit(1))))


def greenhouse_slug(c: Column | str) -> Column:
    """The board's name on a greenhouse host: after "boards", else the first segment; version segments are none."""
    s = _segment_after(c, "boards")
    return F.when(host(c).contains("greenhouse") & s.isNotNull() & ~s.rlike(r"^v\d+$"), s)


def ashby_slug(c: Column | str) -> Column:
    s = _segment_after(c, "job-board")
    return F.when(host(c).endswith(ASHBY) & s.isNotNull() & (s != "posting-api"), s)


def workday_tenant(h: Column) -> Column:
    """The first subdomain that names a company; else the last that is no server number."""
    subs = F.slice(labels(h), 1, F.greatest(F.size(labels(h)) - 2, F.lit(0)))
    named = F.filter(subs, lambda s: ~s.rlike(r"^wd\d+$"))
    good = F.filter(named, lambda s: ~s.isin(GENERIC_SUBDOMAINS))
    return F.when(h.endswith(WORKDAY), F.coalesce(F.try_element_at(good, F.lit(1)), F.try_element_at(named, F.lit(-1))))


def domain_key(c: Column | str) -> Column:
    """The key under which a company's aliases are kept."""
    h, g, a = host(c), greenhouse_slug(c), ashby_slug(c)
    return F.when(h.endswith(WORKDAY), h).when(g.isNotNull(), F.concat(g, F.lit(".greenhouse.io"))).when(a.isNotNull(), F.concat(a, F.lit(".ashbyhq.com"))).otherwise(base_domain(h))


def company_from_url(c: Column | str) -> Column:
    """Board name, tenant, or the label before the top-level domain, in title case."""
    h = host(c)
    bare = F.regexp_replace(h, r"^(careers\.|jobs\.|boards\.|boards-|job-)", "")
    p = labels(bare)
    label = F.when(F.size(p) >= 2, F.try_element_at(p, F.lit(-2))).otherwise(F.try_element_at(p, F.lit(1)))
    return title_case(F.coalesce(greenhouse_slug(c), ashby_slug(c), workday_tenant(h), label, F.lit("")))


def site_name(c: Column | str) -> Column:
    """A short name of a site when nothing else is known; "Site" at worst."""
    h = host(c)
    p = F.filter(labels(h), lambda s: ~s.isin(GENERIC_SUBDOMAINS))
    label = F.when(F.size(p) >= 2, F.try_element_at(p, F.lit(-2))).otherwise(F.try_element_at(p, F.lit(1)))
    return F.coalesce(greenhouse_slug(c), ashby_slug(c), workday_tenant(h), label, F.lit("Site"))


def url_key(c: Column | str) -> Column:
    return F.regexp_replace(trim(F.coalesce(col(c), F.lit(""))), r"/+$", "")


def site_url(c: Column | str) -> Column:
    """Scheme, lower-cased host with port, path without closing slashes, query; a board's listing API where it has one."""
    u, g = with_scheme(c), greenhouse_slug(c)
    scheme = lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    netloc = lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    p = F.regexp_replace(path(c), r"/+$", "")
    plain = F.concat(scheme, F.lit("://"), netloc, F.when(p == "", "/").otherwise(p), query(u))
    return F.when(trim(F.coalesce(col(c), F.lit(""))) == "", "").when(g.isNotNull(), F.concat(F.lit("https://api.greenhouse.io/v1/boards/"), g, F.lit("/jobs"))).otherwise(plain)


def site_key(c: Column | str, kind: Column | str) -> Column:
    return F.concat(lower(F.coalesce(col(kind), F.lit("general"))), F.lit(":"), site_url(c))


def job_url(c: Column | str) -> Column:
    """Canonical job address: forward slashes, none doubled or closing, no fragment, no apply form; null for utility pages."""
    return _job_url(trim(col(c)))


def _job_url(trimmed: Column) -> Column:
    """Of an address without spaces around it. One without a scheme has no canonical form, so host and path are read from it as it is."""
    u = F.regexp_replace(trimmed, r"\\+", "/")
    h = _host(u)
    p = F.regexp_replace(F.regexp_replace(_path(u), "/{2,}", "/"), "/+$", "")
    p = F.when(h.endswith(ASHBY), F.regexp_replace(p, "(?i)/application$", "")).otherwise(p)
    avature = h.endswith("avature.net") | h.endswith("avature.com")
    head = lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return F.when((h != "") & ~(avature & p.rlike("(?i)/(savejob|searchjobs|jobsearch)")), F.concat(head, F.regexp_replace(p, r"^\z", "/"), query(u)))


def url_candidates(c: Column | str) -> Column:
    """The distinct spellings under which a job may be stored.

    Equal parts are shared where this is a column of a select, but neither in an explode nor in a function of arrays with a lambda.
    """
    raw = trim(F.coalesce(col(c), F.lit("")))
    norm = _job_url(raw)
    cut = lambda x: F.regexp_replace(x, "/+$", "")
    return F.array_except(F.array(raw, cut(raw), norm, cut(norm)), F.array(F.lit(""), F.lit(None).cast("string")))


def fix_scheme(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?i)^(https?):/+", "$1://")


def unwrap(c: Column | str) -> Column:
    """Drops paired quotes, brackets and angles around an address."""
    out = trim(col(c))
    for _ in range(3):
        out = trim(F.regexp_replace(out, r"""^(?:<(.*)>|\((.*)\)|\[(.*)\]|"(.*)"|'(.*)')$""", "$1$2$3$4$5"))
    return out


def is_link(c: Column | str) -> Column:
    return F.coalesce((trim(col(c)) != "") & ~trim(col(c)).rlike(r"(?i)^(mailto:|tel:|javascript:|#)"), F.lit(False))


def is_listing_url(c: Column | str) -> Column:
    return F.split(trim(F.coalesce(col(c), F.lit(""))), r"\?")[0].rlike("(?i)/(" + "|".join(LISTING_SEGMENTS) + ")/?$")


def is_listing_root(c: Column | str) -> Column:
    """The last segment is a listing word and no segment has a digit."""
    s = segments(c)
    return F.coalesce((F.size(s) > 0) & ~path(c).rlike(r"\d") & lower(F.try_element_at(s, F.lit(-1))).isin("jobs", "careers", "career", "positions", "openings"), F.lit(False))


def is_auth_url(c: Column | str) -> Column:
    return F.arrays_overlap(F.transform(segments(c), F.lower), F.array(*map(F.lit, AUTH_SEGMENTS)))


def title_from_url(c: Column | str) -> Column:
    """The last segment as words; null where it is an id or a form."""
    last = F.try_element_at(segments(c), F.lit(-1))
    words = trim(F.regexp_replace(F.regexp_replace(F.try_url_decode(last), "[-_]+", " "), r"\s+", " "))
    skip = lower(last).isin("application", "savejob", "searchjobs", "jobsearch") | is_uuid_like(words) | is_numeric_id(words) | (words == "")
    return F.when(last.isNotNull() & ~skip, words)


def apply_url_score(c: Column | str) -> Column:
    """2 for a company's own host, 1 for a hosted board, 0 for a board's API, -1 for none."""
    h = host(c)
    return F.when(h.contains("boards-api.greenhouse.io") | h.startswith("api.greenhouse.io"), 0).when(h.endswith("greenhouse.io"), 1).when(h != "", 2).otherwise(-1)


def best_apply_url(candidates: Column) -> Column:
    """The candidate of the best host, the first among equals."""
    kept = F.filter(candidates, lambda x: x.isNotNull() & (trim(x) != ""))
    ranked = F.transform(kept, lambda x, i: F.struct(apply_url_score(x).alias("s"), (-i).alias("i"), trim(x).alias("u")))
    return F.array_max(ranked)["u"]


def matches_pattern(url: Column | str, pattern: str) -> Column:
    """A pattern with stars is a prefix up to its first star."""
    return col(url).startswith(pattern.split("*")[0].strip())


def with_query_param(c: Column | str, name: str, value: Column) -> Column:
    """Replaces or appends one query parameter."""
    u = col(c)
    base, q = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_replace(query(u), r"^\?", "")
    kept = F.filter(F.split(q, "&"), lambda p: (p != "") & ~p.startswith(f"{name}="))
    return F.concat(base, F.lit("?"), F.array_join(F.array_append(kept, F.concat(F.lit(f"{name}="), value.cast("string"))), "&"))


def page_urls(c: Column | str, name: str, current: Column, size: Column, total: Column, zero_based: bool = True) -> Column:
    """Addresses of all pages of a listing but the current one."""
    last = F.ceil(total / size).cast("int") - (1 if zero_based else 0)
    first = F.lit(0 if zero_based else 1)
    pages = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(pages, lambda p: p != current), lambda p: with_query_param(c, name, p))


def offset_urls(c: Column | str, name: str, current: Column, size: Column, total: Column, most: int = 10) -> Column:
    """Addresses of the next offsets up to the total, a bounded number of them."""
    steps = F.filter(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: current + i * size), lambda o: total.isNull() | (o < total))
    return F.transform(steps, lambda o: with_query_param(c, name, o))
