"""Place names: keys, states, countries, labels, and the dictionary join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions.base import any_of, col, contains_any, let, lookup, lower, squeeze, trim

# States by abbreviation, country spellings, Canadian provinces, words for a missing place.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DC": "District of Columbia",
    "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "IA": "Iowa", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "KS": "Kansas", "KY": "Kentucky",
    "LA": "Louisiana", "MA": "Massachusetts", "MD": "Maryland", "ME": "Maine", "MI": "Michigan", "MN": "Minnesota", "MO": "Missouri", "MS": "Mississippi", "MT": "Montana",
    "NC": "North Carolina", "ND": "North Dakota", "NE": "Nebraska", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NV": "Nevada", "NY": "New York",
    "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas",
    "UT": "Utah", "VA": "Virginia", "VT": "Vermont", "WA": "Washington", "WI": "Wisconsin", "WV": "West Virginia", "WY": "Wyoming",
}
COUNTRIES = {
    "usa": "United States", "u s a": "United States", "u s": "United States", "united states": "United States", "united states of america": "United States",
    "us": "United States", "america": "United States", "uk": "United Kingdom", "united kingdom": "United Kingdom", "britain": "United Kingdom",
    "england": "United Kingdom", "scotland": "United Kingdom", "wales": "United Kingdom", "eu": "Europe", "europe": "Europe", "spain": "Spain", "espana": "Spain",
    "france": "France", "germany": "Germany", "netherlands": "Netherlands", "belgium": "Belgium", "portugal": "Portugal", "ireland": "Ireland", "denmark": "Denmark",
    "sweden": "Sweden", "norway": "Norway", "finland": "Finland", "italy": "Italy", "poland": "Poland", "czech republic": "Czech Republic", "austria": "Austria",
    "hungary": "Hungary", "switzerland": "Switzerland", "brazil": "Brazil", "bahasa": "Indonesia", "indonesia": "Indonesia", "nordics": "Europe", "argentina": "Argentina",
    "chile": "Chile", "colombia": "Colombia", "peru": "Peru", "uruguay": "Uruguay", "mexico": "Mexico", "canada": "Canada", "india": "India", "singapore": "Singapore",
    "hong kong": "Hong Kong", "japan": "Japan", "south korea": "South Korea", "korea": "South Korea", "china": "China", "israel": "Israel",
    "united arab emirates": "United Arab Emirates", "uae": "United Arab Emirates", "australia": "Australia", "new zealand": "New Zealand", "newzealand": "New Zealand", "qatar": "Qatar",
}
PROVINCE_CODES = ["AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT"]
PROVINCES = [
    "alberta", "british columbia", "manitoba", "new brunswick", "newfoundland and labrador", "nova scotia", "northwest territories", "nunavut", "ontario",
    "prince edward island", "quebec", "saskatchewan", "yukon",
]
UNKNOWN_PLACES = ["", "unknown", "n/a", "n a", "na", "unspecified", "not available"]
US_TERMS = [
    "united states", "united states of america", "usa", "u.s.", "u.s.a", "u.s", "america", "within the us", "anywhere in the us", "remote in us", "remote - us",
    "us remote", "us-based", "us only",
]
CURRENCY_COUNTRY = {"INR": "India", "GBP": "United Kingdom", "EUR": "Europe"}

#: Our own compact dictionary: city, state, country, other spellings, remote only.
CITIES = [
    ("Austin", "Texas", "United States", ["atx"], False), ("Boston", "Massachusetts", "United States", [], False), ("Chicago", "Illinois", "United States", [], False),
    ("Denver", "Colorado", "United States", [], False), ("Los Angeles", "California", "United States", ["la"], False), ("Miami", "Florida", "United States", [], False),
    ("New York", "New York", "United States", ["nyc", "new york city", "manhattan"], False), ("Palo Alto", "California", "United States", [], False),
    ("Portland", "Oregon", "United States", [], False), ("San Francisco", "California", "United States", ["sf", "san francisco bay area"], False),
    ("San Jose", "California", "United States", [], False), ("Seattle", "Washington", "United States", [], False), ("Remote", "Remote", "United States", ["anywhere"], True),
    ("Amsterdam", "Unknown", "Netherlands", [], False), ("Bangalore", "Karnataka", "India", ["bengaluru"], False), ("Berlin", "Unknown", "Germany", [], False),
    ("Dublin", "Unknown", "Ireland", [], False), ("London", "Unknown", "United Kingdom", ["greater london"], False), ("Paris", "Unknown", "France", [], False),
    ("Singapore", "Unknown", "Singapore", [], False), ("Tokyo", "Unknown", "Japan", [], False), ("Toronto", "Ontario", "Canada", [], False), ("Vancouver", "British Columbia", "Canada", [], False),
]


def place_key(c: Column | str) -> Column:
    """Lower case, no parentheses, ASCII letters and digits, single spaces."""
    k = F.regexp_replace(lower(F.coalesce(col(c), F.lit(""))), r"\(.*?\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(k, "[^a-z0-9 ]+", " "), " +", " "))


def folded_key(c: Column | str) -> Column:
    """The ingest layer's key: accents of the Latin letters dropped first."""
    return place_key(F.translate(col(c), "áàâäãåéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ", "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN"))


def is_unknown_place(c: Column | str) -> Column:
    return lower(trim(F.coalesce(col(c), F.lit("")))).isin(UNKNOWN_PLACES)


def state_name(c: Column | str) -> Column:
    """Full name of a state given by name or abbreviation; null for none."""
    k = place_key(c)
    names = {n.lower(): n for n in STATES.values()}
    return F.coalesce(lookup(F.upper(F.replace(k, F.lit(" "), F.lit(""))), STATES), lookup(k, names))


def state_code(c: Column | str) -> Column:
    return lookup(state_name(c), {n: a for a, n in STATES.items()})


def country_of(c: Column | str) -> Column:
    """Country of a label by its words alone: remote and unknown count as the United States."""
    raw, key = trim(F.coalesce(col(c), F.lit(""))), place_key(c)
    part = lambda p: F.coalesce(
        lookup(place_key(p), COUNTRIES),
        F.when(F.upper(p).isin(PROVINCE_CODES) | place_key(p).isin(PROVINCES), "Canada"),
        F.when(state_name(p).isNotNull(), "United States"),
    )
    parts = F.filter(F.transform(F.split(raw, ","), lambda p: part(trim(p))), lambda x: x.isNotNull())
    free = key.contains("remote") | key.contains("unknown") | key.isin(UNKNOWN_PLACES)
    return F.when(raw == "", F.lit(None)).when(key == "", F.lit(None)).when(free, "United States").otherwise(F.coalesce(F.try_element_at(parts, F.lit(1)), lookup(key, COUNTRIES)))


def label(city: Column, state: Column, country: Column) -> Column:
    """Remote, else "City, State", "City, Country", city, state, country, Unknown."""
    known = lambda x: (x != "") & (x != "Unknown")

    def ladder(at: Column) -> Column:
        c, s, n = at["c"], at["s"], at["n"]
        return (
            F.when((F.lower(c) == "remote") | (F.lower(s) == "remote"), "Remote")
            .when(known(c) & known(s), F.concat(c, F.lit(", "), s))
            .when((c != "") & known(n), F.concat(c, F.lit(", "), n))
            .when(known(c), c)
            .when(known(s), s)
            .when(known(n), n)
            .otherwise("Unknown")
        )

    return let(F.struct(*(trim(F.coalesce(x, F.lit(""))).alias(k) for k, x in (("c", city), ("s", state), ("n", country)))), ladder)


def short_label(city: Column, state: Column, country: Column) -> Column:
    """The ingest layer's label, with the abbreviation for a state unless another country than the US is given."""
    us = lower(trim(F.coalesce(country, F.lit("")))).isin("united states", "usa", "us", "united states of america", *UNKNOWN_PLACES)
    return label(city, F.when(us, F.coalesce(state_code(state), state)).otherwise(state), country)


def split_places(c: Column | str) -> Column:
    """Places of a field: cut at semicolon, bar and slash, cleaned, 2 to 100 characters, distinct in order."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[;|/]"), lambda p: F.regexp_replace(trim(squeeze(p)), "^[,;]+|[,;]+$", ""))
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 2) & (F.length(p) <= 100)))


def read_places(places: Column) -> Column:
    """Each place as struct(place, country, state), read once for all that derives from it."""
    return F.transform(places, lambda p: F.struct(p.alias("place"), country_of(p).alias("country"), state_name(F.try_element_at(F.split(p, ","), F.lit(2))).alias("state")))


def place_names(read: Column) -> Column:
    return F.transform(read, lambda r: r["place"])


def us_first_read(read: Column) -> Column:
    """Moves the first US place that is not remote to the front, else the first remote one."""
    us = F.filter(read, lambda r: (r["country"] == "United States") & ~F.lower(r["place"]).contains("remote") & ~is_unknown_place(r["place"]))
    remote = F.filter(read, lambda r: F.lower(r["place"]).contains("remote"))
    head = F.coalesce(F.try_element_at(us, F.lit(1)), F.try_element_at(remote, F.lit(1)))
    return F.when(head.isNull(), read).otherwise(F.concat(F.array(head), F.filter(read, lambda r: r["place"] != head["place"])))


def us_first(places: Column) -> Column:
    return place_names(let(read_places(places), us_first_read))


def distinct_known(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda s: s.isNotNull()))


def states_of(places: Column) -> Column:
    return distinct_known(F.transform(read_places(places), lambda r: r["state"]))


def countries_of(places: Column) -> Column:
    return distinct_known(F.transform(places, country_of))


def search_tokens_read(read: Column) -> Column:
    tokens = F.flatten(F.transform(read, lambda r: F.split(F.concat_ws(" ", r["place"], r["country"]), r"[\s,]+")))
    return F.array_join(F.array_distinct(F.filter(tokens, lambda t: t != "")), " ")


def job_country(explicit: Column, countries: Column, states: Column) -> Column:
    """Explicit, else the first known country, else a known state's, else Unknown."""
    first = F.try_element_at(F.filter(countries, lambda c: c != "Unknown"), F.lit(1))
    stated = F.exists(states, lambda s: ~s.isin("", "Unknown", "Remote"))
    return F.coalesce(F.nullif(trim(explicit), F.lit("")), F.when(first != "Other", first), F.when(stated, "United States"), F.lit("Unknown"))


def matches_country(job: Column, wanted: str, other: str = "Other") -> Column:
    """An unknown country passes any named one; "Other" is all but the United States."""
    if not wanted:
        return F.lit(True)
    return job != "United States" if wanted == other else job.isin(wanted, "Unknown")


def matches_usa(c: Column | str, non_us: list[str], cities: list[str], allow_missing: bool = True) -> Column:
    """Ordered rules, the first that fits decides."""
    low, up = lower(trim(col(c))), F.upper(trim(col(c)))
    us = contains_any(low, US_TERMS)
    codes = up.rlike(r"(^|[^A-Z])(" + "|".join([*STATES, "PR", "GU", "VI"]) + r")([^A-Z]|$)")
    named = any_of(up.rlike(r"\bU\.S\."), low.rlike(r"\b\d{5}(-\d{4})?\b"), codes, contains_any(low, [s.lower() for s in STATES.values()]), contains_any(low, cities))
    return F.when(F.coalesce(low, F.lit("")) == "", F.lit(allow_missing)).when(contains_any(low, non_us), False).when(low.contains("remote") & ~us, F.lit(allow_missing)).otherwise(us | named)


def city_state_in(c: Column | str) -> Column:
    """The first "City, ST" of a text, as a struct; null without one."""
    pattern = r"\b([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+)*)\s*,\s*(" + "|".join(STATES) + r")\b"
    city = F.regexp_extract(col(c), pattern, 1)
    return F.when(city != "", F.struct(city.alias("city"), lookup(F.regexp_extract(col(c), pattern, 2), STATES).alias("state")))


def dictionary(spark: SparkSession, cities: list[tuple] = CITIES) -> DataFrame:
    """(key, city, state, country, remote_only): every spelling, with state, abbreviation and country added; the first wins."""
    base = spark.createDataFrame(cities, "city string, state string, country string, aliases array<string>, remote_only boolean").withColumn("place", F.monotonically_increasing_id())
    spelt = base.withColumn("spelling", F.explode(F.concat(F.array("city"), "aliases")))
    forms = F.array(F.col("spelling"), F.concat_ws(" ", "spelling", F.when(F.col("state") != "Unknown", F.col("state"))), F.concat_ws(" ", "spelling", "country"), F.concat_ws(" ", "spelling", state_code("state")))
    keyed = spelt.select(F.explode(F.array_distinct(F.transform(forms, place_key))).alias("key"), "city", "state", "country", "remote_only", "place")
    return keyed.groupBy("key").agg(F.min_by(F.struct("city", "state", "country", "remote_only"), "place").alias("at")).select("key", "at.*")


def resolve_places(rows: DataFrame, text: str, keys: DataFrame, most_words: int = 7) -> DataFrame:
    """Adds the place that a text names: the whole text as a key, else its longest phrase that is one, the earliest among equals.

    Phrases of one to most_words words (the most that a key of the dictionary has) and the whole text meet the keys by
    equality, so that no text is compared with every key. rows need a column row_id.
    """
    words = rows.select("row_id", F.split(place_key(text), " ").alias("w"))
    grams = [F.expr(f"transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> struct(i as i, array_join(slice(w, i, {n}), ' ') as phrase))") for n in range(1, most_words + 1)]
    grams.append(F.expr("array(struct(1 as i, array_join(w, ' ') as phrase))"))
    phrases = words.select("row_id", F.size("w").alias("n"), F.explode(F.concat(*grams)).alias("g")).select("row_id", "n", "g.i", "g.phrase").where("phrase <> ''").distinct()
    hit = phrases.join(keys, phrases.phrase == keys.key)
    rank = F.struct(F.length("phrase").alias("l"), (-F.col("i")).alias("i"))
    best = hit.groupBy("row_id").agg(F.max_by(F.struct("city", "state", "country", "remote_only", "phrase"), rank).alias("place"))
    return rows.join(best, "row_id", "left")
