"""Scraped bodies: HTML to plain lines, and what is not part of a posting cut away, line by line or object by object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions.base import col, contains_any, let, squeeze, trim
from harborlight.functions.jsonscan import without_objects
from harborlight.functions.text import clean_scraped, decode_entities, is_unknown_label

# Lines and markers of known page furniture.
PLATFORM_LINES = ["carousel_paragraph", "get future jobs matching this search", "job_description.share.html", "loginorregister", "mail_outline", "enable javascript to run this app"]
TAIL_MARKERS = ["back to job search", "similar jobs"]
TAIL_LINKS = ["/careers/login", "/careers/savejob", "/careers/searchjobs"]
TAIL_LABELS = ["apply now", "save this job", "back to job search"]
THEME_MARKERS = ["themeOptions", "customTheme", "varTheme", "micrositeConfig"]
ALWAYS_DROPPED = ['"display_banner"', '"display_text"']
BLOB_MARKERS = [
    '"domain"', '"positions"', '"branding"', '"candidate"', '"custom_html"', '"custom_style"', '"customNavbarItems"', '"themeOptions"',
    '"customTheme"', '"varTheme"', '"micrositeConfig"', '"i18n_overrides_master"',
]
DESCRIPTION_HEADINGS = [
    "job description", "job details", "job detail", "job summary", "job overview", "role description", "position description",
    "position details", "description and requirements", "description and requirement", "description and responsibilities", "description",
]
METADATA_LABELS = [
    "location", "locations", "business area", "business unit", "department", "team", "function", "work type", "time type",
    "employment type", "shift", "job number", "reference", "salary", "compensation", "pay", "rate", "office", "city", "state", "country",
]
BLOB_LENGTH, HUGE_BLOB = 200, 1200
# A career site's menu in its order, and what tells a cookie notice.
MENU = [
    "Welcome", "Culture", "Workplace Benefits", "Candidate Experience", "Diversity, Equity & Inclusion", "Learning & Development",
    "Pup Culture Blog", "Teams", "Engineering", "General & Administrative", "Marketing", "Product Design", "Product Management", "Sales",
    "Technical Solutions", "Early Career & Internships", "Locations", "Americas", "Asia Pacific", "EMEA", "Remote", "All Jobs",
]
COOKIE_SIGNALS = [
    "cookie preferences", "cookie policy", "cookie consent", "cookie settings", "your choice regarding cookies", "this website uses cookies",
    "accept all", "reject all", "save and close", "manage cookies", "essential cookies", "performance cookies", "functional cookies",
    "advertising cookies", "cookiebot", "onetrust", "trustarc", "optimizely", "google analytics", "microsoft clarity", "tag manager", "gtm",
]
COOKIE_CONTROLS = ["accept all", "reject all", "save and close", "cookie preferences", "preferences"]
#: Bounds of a menu (hits, lines looked at, latest first line, share of its lines) and of a notice (signals, lines between first and last).
MENU_HITS, MENU_WINDOW, MENU_FIRST, MENU_SHARE, NOTICE_SIGNALS, NOTICE_LINES = 8, 200, 120, 0.6, 2, 240


def lines_of(c: Column | str) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), r"\r?\n")


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _without(c: Column | str, junk) -> Column:
    return joined(F.filter(lines_of(c), lambda s: ~junk(s)))


def html_markdown(html: Column | str) -> Column:
    """Scripts, styles and comments gone, block ends to line breaks, list items to dashes, entities decoded."""
    out = F.coalesce(col(html), F.lit(""))
    for pattern, by in (
        (r"(?is)<script\b[^>]*>.*?</script>", " "),
        (r"(?is)<style\b[^>]*>.*?</style>", " "),
        (r"(?s)<!--.*?-->", ""),
        (r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/ul|/ol|/section|/article)\b[^>]*>", "\n"),
        (r"(?i)<li\b[^>]*>", "- "),
        (r"<[^>]+>", ""),
    ):
        out = F.regexp_replace(out, pattern, by)
    out = F.regexp_replace(decode_entities(out), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def meta_description(html: Column | str) -> Column:
    """The page's description, or else its Open Graph one, behind its title; null without either."""
    h = col(html)
    tag = lambda key: F.get(F.filter(F.regexp_extract_all(h, F.lit(r"(?is)(<meta\b[^>]*>)"), 1), lambda t: t.rlike(rf"(?i)\b(?:name|property)\s*=\s*[\"']{key}[\"']")), 0)
    content = lambda t: F.nullif(clean_scraped(F.regexp_extract(t, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)), F.lit(""))
    found = F.coalesce(content(tag("description")), content(tag("og:description")))
    title = F.nullif(clean_scraped(F.regexp_extract(h, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit(""))
    return F.when(found.isNotNull(), F.concat_ws("\n\n", title, found))


def cut_tag_lines(c: Column | str) -> Column:
    """Lines of tags alone go."""
    return _without(c, is_tag_line)


def cut_empty_links(c: Column | str) -> Column:
    """Lines that are what is left of a link without text."""
    return _without(c, lambda s: s.rlike(r"^\s*(?:\[|[*\-•] \[|[*\-•]?\s*\[\s*\]|\]\(\s*#?\s*\)|\[\s*\]\(\s*#?\s*\))\s*$"))


def cut_platform_lines(c: Column | str) -> Column:
    """Lines with a hosting platform's own labels, and lines that are one upper-case identifier."""
    return _without(c, lambda s: contains_any(F.lower(squeeze(s)), PLATFORM_LINES) | (F.lower(F.trim(s)) == "back") | s.rlike(r"^\s*[A-Z0-9_.]{8,}\s*$"))


def cut_json_lines(c: Column | str) -> Column:
    """One-line JSON values of at least two keys go if they hold a banner, or are long and hold page state, or are huge."""

    def junk(s: Column) -> Column:
        t = F.regexp_replace(F.trim(s), r"^`+\s*|\s*`+$", "")
        shaped = t.rlike(r"(?s)^[\[{].*[\]}]$") & (F.regexp_count(t, F.lit('":')) >= 2)
        long = (F.length(t) >= BLOB_LENGTH) & contains_any(t, BLOB_MARKERS)
        huge = (F.length(t) >= HUGE_BLOB) & (F.regexp_count(t, F.lit(r"[\[{]")) >= 2)
        return shaped & (contains_any(t, ALWAYS_DROPPED) | long | huge)

    return _without(c, junk)


def cut_theme_objects(c: Column | str) -> Column:
    """JSON objects that hold a theme setting go, from their outermost brace and at any depth; the white space left is squeezed. An unclosed object stays."""
    t = F.coalesce(col(c), F.lit(""))
    out = without_objects(F.when(contains_any(t, THEME_MARKERS), t), THEME_MARKERS)
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")
    return F.trim(F.coalesce(tidy, t))


def cut_tail(c: Column | str) -> Column:
    """The text before the first line of a career site's closing links, past its first fifth and eight lines, or before
    the first line that names similar jobs; the whole text if nothing would be left."""
    t = F.coalesce(col(c), F.lit(""))
    lines = lines_of(t)
    plain = F.transform(lines, lambda s: F.lower(F.trim(s)))
    at = F.array_position(F.transform(plain, lambda s: contains_any(s, TAIL_LINKS)), True)  # from 1; 0: none
    label = lambda back: F.coalesce(F.get(plain, (at - back - 1).cast("int")).isin(TAIL_LABELS), F.lit(False)) & (at > back)
    bracket = lambda back: F.coalesce(F.get(plain, (at - back - 1).cast("int")).isin("[", "* [", "- [", "• ["), F.lit(False)) & (at > back)
    first = F.when(label(1), F.when(bracket(2), at - 2).otherwise(at - 1)).when(label(2), at - 2).when(bracket(1), at - 1).otherwise(at)
    far = at - 1 >= F.greatest(F.lit(8), F.floor(F.size(lines) * 0.2))
    before = lambda n: F.regexp_replace(joined(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0)).cast("int"))), r"^\n+|\n+$", "")
    named = F.array_position(F.transform(plain, lambda s: contains_any(s, TAIL_MARKERS)), True)
    return F.when((at > 0) & far & (before(first) != ""), before(first)).when((named > 0) & (before(named) != ""), before(named)).otherwise(t)


def is_tag_line(s: Column) -> Column:
    return s.rlike(r"^\s*<.*>\s*$") & (F.trim(F.regexp_replace(s, r"<[^>]*>", "")) == "")


def leading(flags: Column) -> Column:
    """How many of the flags are true before the first that is not."""
    at = F.array_position(flags, False).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(flags))


def _spread(rows: Column, soft_before: str, soft_after: str, first: Column, last: Column) -> Column:
    """The text without the lines first to last (from 1) and the soft ones that touch them; line breaks at both ends go."""
    back = leading(F.transform(F.reverse(F.slice(rows, F.lit(1), first - 1)), lambda r: r[soft_before]))
    on = leading(F.transform(F.slice(rows, last + 1, F.size(rows) - last), lambda r: r[soft_after]))
    kept = F.concat(F.slice(rows, F.lit(1), first - 1 - back), F.slice(rows, last + on + 1, F.size(rows) - last - on))
    return F.regexp_replace(joined(F.transform(kept, lambda r: r["line"])), r"^\n+|\n+$", "")


def _ends(rows: Column, hit: str) -> Column:
    flags = F.transform(rows, lambda r: r[hit])
    last = F.size(rows) - F.array_position(F.reverse(flags), True).cast("int") + 1
    return F.struct(F.array_position(flags, True).cast("int").alias("first"), last.alias("last"), F.size(F.filter(flags, lambda f: f)).alias("hits"))


def cut_notice(c: Column | str) -> Column:
    """A cookie notice goes from the first line with a signal to the last, with the blank lines, tags and buttons around it: at least two lines
    hold signals, two name cookies, and at most 240 lines lie between. The text stays, but for line breaks at its ends, if nothing would be left."""
    t = F.coalesce(col(c), F.lit(""))

    def told(s: Column, low: Column) -> Column:
        empty = (low == "") | is_tag_line(s)
        named = low.contains("cookie") & low.rlike(r"\bcookies?\b")
        return F.struct(s.alias("line"), contains_any(low, COOKIE_SIGNALS).alias("hit"), named.alias("named"), empty.alias("before"), (empty | low.isin(COOKIE_CONTROLS)).alias("after"))

    def result(rows: Column, e: Column) -> Column:
        named = F.size(F.filter(rows, lambda r: r["named"]))
        notice = (e["hits"] >= NOTICE_SIGNALS) & (named >= NOTICE_SIGNALS) & (e["last"] - e["first"] <= NOTICE_LINES)
        return F.when(notice, F.coalesce(F.nullif(_spread(rows, "before", "after", e["first"], e["last"]), F.lit("")), F.regexp_replace(t, r"^\n+|\n+$", "")))

    # most texts name no cookie: one plain search tells them before their lines are made
    each = F.transform(lines_of(t), lambda s: let(F.lower(F.trim(squeeze(s))), lambda low: told(s, low)))
    found = let(each, lambda rows: let(_ends(rows, "hit"), lambda e: result(rows, e)))
    return F.coalesce(F.when(F.lower(t).contains("cookie"), found), t)


def cut_menu_run(c: Column | str) -> Column:
    """The menu in its own order, once or twice, written behind each other with any white space, becomes a line break."""
    # one word after the other must match, so that the search never goes back far
    run = r"\s+".join(r"\Q" + w + r"\E" for w in MENU)
    return F.regexp_replace(col(c), rf"(?i){run}(?:\s+###\s*Careers)?(?:\s+{run})?", "\n")


def cut_menu(c: Column | str) -> Column:
    """A menu goes from its first line to its last, with blank lines before, and blank and menu lines after it: at least eight of the first 200
    lines are its words, the first within 120, and of the lines from first to last that aren't blank at least three fifths."""
    t = F.coalesce(col(c), F.lit(""))
    start = r"^[^\S\n]*#*[^\S\n]*(?:" + "|".join(r"\Q" + w + r"\E" for w in [*MENU, "Careers"]) + ")"

    def told(s: Column, i: Column) -> Column:
        hit = s.rlike(start + r"\s*$")
        blank = s.rlike(r"^\s*$")
        return F.struct(s.alias("line"), (hit & (i < MENU_WINDOW)).alias("hit"), blank.alias("blank"), (hit | blank).alias("after"))

    def result(rows: Column, e: Column) -> Column:
        solid = F.size(F.filter(F.slice(rows, e["first"], e["last"] - e["first"] + 1), lambda r: ~r["blank"]))
        menu = (e["first"] <= MENU_FIRST + 1) & (e["hits"] >= F.greatest(F.lit(MENU_HITS), F.floor(solid * MENU_SHARE)))
        return F.when(menu, F.coalesce(F.nullif(_spread(rows, "blank", "after", e["first"], e["last"]), F.lit("")), F.regexp_replace(t, r"^\n+|\n+$", "")))

    found = let(F.transform(lines_of(t), told), lambda rows: let(_ends(rows, "hit"), lambda e: F.when(e["hits"] >= MENU_HITS, result(rows, e))))
    return F.coalesce(F.when(t.rlike("(?m)" + start), found), t)


def strip_known_blocks(c: Column | str) -> Column:
    """The whole chain: cookie notice, tag lines, the menu as a run, closing links, JSON lines, empty links, platform labels, the menu by lines."""
    out = F.coalesce(col(c), F.lit(""))
    for step in (cut_notice, cut_tag_lines, cut_menu_run, cut_tail, cut_json_lines, cut_empty_links, cut_platform_lines, cut_menu):
        out = let(out, step)  # each step's text is computed once, though the step names it often
    return out


def section_key(line: Column) -> Column:
    """A heading's words in lower case, without marks; & reads as "and"."""
    t = F.regexp_replace(F.trim(line), r"^[#*\-•]+\s*", "")
    t = F.replace(F.regexp_replace(F.trim(t), r":+$", ""), F.lit("&"), F.lit("and"))
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")))


def is_separator(line: Column) -> Column:
    return line.rlike(r"^\s*(?:#*|[-*_]{3,})\s*$")


def trim_separators(lines: Column) -> Column:
    """Without blank lines and rules at both ends."""

    def cut(x: Column, solid: Column) -> Column:
        first, last = F.array_position(solid, True).cast("int"), F.array_position(F.reverse(solid), True).cast("int")
        return F.when(first > 0, F.slice(x, first, F.size(x) - last - first + 2)).otherwise(F.array().cast("array<string>"))

    return let(lines, lambda x: let(F.transform(x, lambda s: ~is_separator(s)), lambda solid: cut(x, solid)))


def is_metadata_block(lines: Column) -> Column:
    """3 to 40 short lines of labels and reference numbers."""

    def told(s: Column) -> Column:
        label = lambda k: k.isin(METADATA_LABELS) | (k.endswith(" id") & (F.size(F.split(k, " ")) <= 3)) | (k.rlike("^re[fq]") & (F.size(F.split(k, " ")) <= 2))
        return F.struct(let(section_key(s), label).alias("label"), s.rlike(r"^[A-Za-z]{0,3}\d{3,}$").alias("number"), ((F.length(s) <= 80) & ~s.endswith(".")).alias("short"))

    def judged(rows: Column) -> Column:
        labels, numbers, short = (F.size(F.filter(rows[k], lambda hit: hit)) for k in ("label", "number", "short"))
        n = F.size(rows)
        return ((labels >= 2) & (short >= n * 0.6)) | ((labels >= 1) & (numbers >= 1) & (short >= n * 0.6)) | ((numbers >= 1) & (short >= n * 0.8) & (n >= 4))

    bare = lambda x: F.transform(x, lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[#*\-•]+\s*", "")))
    kept = F.filter(lines, lambda s: ~is_separator(s))
    return let(kept, lambda x: F.when(F.size(x).between(3, 40), let(F.transform(bare(x), told), judged)).otherwise(False))


def split_description(c: Column | str) -> Column:
    """struct(description, metadata): the first description heading goes; what stands before it is metadata if it is a
    block of labels, else it stays in front."""
    heading = lambda lines: F.array_position(F.transform(lines, lambda s: section_key(s).isin(DESCRIPTION_HEADINGS)), True).cast("int")

    def parts(lines: Column, at: Column) -> Column:
        before = trim_separators(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0))))
        after = trim_separators(F.slice(lines, F.greatest(at + 1, F.lit(1)), F.size(lines)))
        return let(before, lambda b: F.struct(at.alias("at"), joined(lines).alias("text"), joined(b).alias("head"), joined(after).alias("body"), is_metadata_block(b).alias("block")))

    def result(p: Column) -> Column:
        apart = (p["head"] != "") & (p["body"] != "") & p["block"]
        merged = F.concat_ws("\n\n", F.nullif(p["head"], F.lit("")), F.nullif(p["body"], F.lit("")))
        description = F.when(p["at"] == 0, p["text"]).when(apart, p["body"]).when(merged == "", p["text"]).otherwise(merged)
        return F.struct(description.alias("description"), F.when((p["at"] > 0) & apart, p["head"]).alias("metadata"))

    return let(lines_of(c), lambda lines: let(heading(lines), lambda at: let(parts(lines, at), result)))


def title_before_bar(c: Column | str) -> Column:
    """"Title in City | Company" gives the title; other titles stay."""
    t = trim(c)
    return F.coalesce(F.nullif(trim(F.regexp_extract(t, r"^(.+?)\s+in\s+[^|]+\|\s*.+$", 1)), F.lit("")), t)


def application_title(c: Column | str) -> Column:
    """"Job application for X at Y" gives X; null for other texts."""
    return F.nullif(trim(F.regexp_extract(col(c), r"(?i)^\s*job application for\s+(.+?)\s+at\s+.+$", 1)), F.lit(""))


def whole_number(c: Column | str) -> Column:
    """An integer however its thousands are marked; cents are dropped."""
    t = F.regexp_replace(trim(c), r"[.,]\d{2}$", "")
    return F.try_to_number(F.nullif(F.regexp_replace(t, r"[^\d]", ""), F.lit("")), F.lit("9" * 18)).cast("long")


def should_replace(new: Column | str, old: Column | str) -> Column:
    """A text gives way only to another one that says something, and a known one never to an unknown."""
    a, b = trim(F.coalesce(col(new), F.lit(""))), trim(F.coalesce(col(old), F.lit("")))
    return (a != "") & (a != b) & ~(is_unknown_label(a) & ~is_unknown_label(b))


def clean_path(c: Column | str) -> Column:
    p = F.regexp_replace(F.coalesce(col(c), F.lit("")), "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def first_of(kind: str, docs: Column) -> Column:
    """Of a provider's documents (array of strings) the first that is JSON, or the first that is plain text and not blank."""
    shaped = lambda d: F.try_parse_json(d).isNotNull() & d.rlike(r"^\s*[\[{]")
    return F.get(F.filter(docs, shaped if kind == "json" else lambda d: ~shaped(d) & (F.trim(d) != "")), 0)


def url_list(c: Column | str) -> Column:
    """A JSON array of addresses, or one address, as an array; blank entries go."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    many = F.from_json(F.when(t.startswith("["), t), "array<string>")
    return F.filter(F.coalesce(many, F.array(t)), lambda u: F.coalesce(F.trim(u) != "", F.lit(False)))


def line_around(c: Column | str, needle: Column, reach: int = 4) -> Column:
    """The lines up to so many away from the first that holds the needle, itself and other link lines left out."""
    lines = lines_of(c)
    at = F.array_position(F.transform(lines, lambda s: F.contains(s, needle)), True).cast("int")
    near = F.slice(lines, F.greatest(at - reach, F.lit(1)), F.least(at, F.lit(reach + 1)) + reach)
    return F.when(at > 0, F.filter(near, lambda s: ~s.rlike(r"\[[^\]]*\]\([^)]*\)") & ~F.contains(s, needle)))
