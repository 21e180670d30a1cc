"""What a fetched page is: a listing's card, a board, one job's detail; and whether its parts are what they claim to be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions import url
from harborlight.functions.base import all_of, any_of, col, contains_any, let, lower, trim
from harborlight.functions.markdown import METADATA_LABELS, lines_of, section_key, split_description
from harborlight.functions.payload import get
from harborlight.functions.text import DETAIL_MARKERS, marker_hits, sample_of

# A listing card's buttons, words no place has, and furniture that tells a page's frame from its posting.
CARD_BUTTONS = ["direct apply", "apply with ai", "apply now", "view job", "view details"]
NO_PLACE_WORDS = ["diversity", "equity", "inclusion", "benefits", "culture", "salary", "compensation", "pay", "package", "bonus", "range", "401k", "401(k", "$"]
FRAME_MARKERS = [
    "saved jobs", "recently viewed jobs", "job alerts", "sign up for job alerts", "join our talent community", "view all of our available opportunities",
    "view all jobs", "cookie settings", "job_description.share", "job_description.share.html", "loginorregister", "mail_outline",
    "get future jobs matching this search",
]
#: A card's most characters, words and lines, and the words under which two buttons do without a time.
CARD_LENGTH, CARD_WORDS, CARD_LINES, CARD_FEW_WORDS = 500, 120, 14, 80


def names_listing(c: Column | str) -> Column:
    """Any address in the text ends in a listing's segment."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?i:https?)://\S+"), F.lit(0))
    return F.exists(F.transform(found, lambda u: F.regexp_replace(u, r"""[).,;\]"']+$""", "")), url.is_listing_root)


def is_listing_card(title: Column | str, body: Column | str, address: Column | str) -> Column:
    """A short text with a button and a listing's address, but no marker of a posting, that tells when it was posted or has two buttons."""
    b = trim(F.coalesce(col(body), F.lit("")))

    def judged(s: Column) -> Column:
        words = F.regexp_count(b, F.lit(r"[\p{L}\p{N}_]+"))
        buttons = marker_hits(s, CARD_BUTTONS)
        return all_of(
            marker_hits(s, DETAIL_MARKERS) == 0,
            F.length(b).between(1, CARD_LENGTH) & (words <= CARD_WORDS),
            F.size(F.filter(lines_of(body), lambda x: trim(x) != "")) <= CARD_LINES,
            buttons >= 1,
            names_listing(body) | url.is_listing_root(address),
            (s.contains("posted") & s.contains("ago")) | ((buttons >= 2) & (words <= CARD_FEW_WORDS)),
        )

    return F.coalesce(let(sample_of(title, body, 2000), judged), F.lit(False))


def is_plausible_place(c: Column | str) -> Column:
    """2 to 100 characters without words of pay or culture; with commas at most three parts of three words, else four words or remote."""
    v = col(c)
    low = lower(trim(v))
    words = lambda s: F.size(F.regexp_extract_all(s, F.lit(r"(?U)\S+"), F.lit(0)))
    parts = F.filter(F.transform(F.split(v, ","), trim), lambda p: p != "")
    listed = (F.size(parts) <= 3) & F.forall(parts, lambda p: words(p) <= 3)
    shape = F.when(v.contains(","), listed).otherwise(low.contains("remote") | (words(v) <= 4))
    return F.coalesce(F.length(v).between(2, 100) & ~low.isin("unknown", "n/a", "na") & ~contains_any(low, NO_PLACE_WORDS) & shape, F.lit(False))


def is_board_address(c: Column | str) -> Column:
    """A board's own page or the list of its jobs on the hosting domain greenhouse.io, not one job."""
    h, p = url.host(c), F.rtrim(lower(url.path(c)), F.lit("/"))
    own = h.endswith("boards.greenhouse.io") & p.rlike("^/[^/]+$")
    return F.coalesce((h.endswith("greenhouse.io") & p.endswith("/jobs")) | own, F.lit(False))


def is_detail_payload(v: Column) -> Column:
    """A VARIANT that shows one job: marked so, or with a single position and an id or a count of one."""
    marked = F.coalesce(get(v, "$.singleview", "boolean"), F.lit(False)) & F.schema_of_variant(F.try_variant_get(v, "$.singleview", "variant")).isin("BOOLEAN", "BIGINT")
    marked = marked & (F.coalesce(get(v, "$.singleview", "long"), F.lit(1)) == 1)
    single = F.size(get(v, "$.positions", "array<variant>")) == 1
    pid = ~F.coalesce(get(v, "$.pid"), F.lit("")).isin("", "0", "false", "[]", "{}")
    one = (F.schema_of_variant(F.try_variant_get(v, "$.count", "variant")) == "BIGINT") & (get(v, "$.count", "long") == 1)
    return F.coalesce(marked, F.lit(False)) | (F.coalesce(single, F.lit(False)) & (pid | F.coalesce(one, F.lit(False))))


def prefers_structured(body: Column | str) -> Column:
    """A page's structured description serves better than its text: short, framed by two pieces of furniture, or without a marker of a posting."""
    t = trim(F.coalesce(col(body), F.lit("")))
    return let(lower(t), lambda low: any_of(F.length(low) < 200, marker_hits(low, FRAME_MARKERS) >= 2, ~contains_any(low, DETAIL_MARKERS)))


def title_is_metadata(body: Column | str, title: Column | str) -> Column:
    """The title is what the body's metadata says behind a label, on its line or as the next line that isn't blank."""
    target = lower(trim(F.coalesce(col(title), F.lit(""))))
    labelled = lambda s: section_key(s).isin(METADATA_LABELS)
    bare = lambda s: lower(trim(F.regexp_replace(trim(s), r"^[#*\-•]+\s*", "")))
    inline = lambda s: labelled(F.substring_index(s, ":", 1)) & (lower(trim(F.regexp_replace(s, r"(?s)^[^:]*:", ""))) == target)

    def told(lines: Column) -> Column:
        behind = F.exists(F.transform(lines, lambda s, i: (i > 0) & ~labelled(s) & (bare(s) == target) & F.coalesce(labelled(F.get(lines, i - 1)), F.lit(False))), lambda hit: hit)
        return F.exists(lines, lambda s: s.contains(":") & inline(s)) | behind

    kept = F.filter(lines_of(split_description(body)["metadata"]), lambda s: trim(s) != "")
    return F.coalesce((target != "") & let(kept, told), F.lit(False))
