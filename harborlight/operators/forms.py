"""Form fields filled from résumés: which entry a field asks for, by rules on its words or by the words it shares with the entry's name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions.base import col, contains_any, lower, trim
from harborlight.operators.search import tokens

# Entries of a résumé, and the words in a field's label that ask for them; the first that fits.
ENTRY_WORDS = [
    ("first_name", ["first name", "given name"]),
    ("last_name", ["last name", "family name", "surname"]),
    ("full_name", ["full name"]),
    ("email", ["email"]),
    ("phone", ["phone", "mobile", "cell"]),
    ("linkedin", ["linkedin", "linked in"]),
    ("github", ["github", "git hub"]),
    ("portfolio", ["portfolio", "website", "site", "url"]),
    ("cover_letter", ["cover letter", "motivation"]),
    ("resume_file", ["resume", "cv"]),
    ("current_company", ["company", "current employer"]),
    ("location", ["location", "city", "address"]),
    ("years_experience", ["experience", "years"]),
    ("salary_expectation", ["salary", "compensation", "pay"]),
    ("start_date", ["start date"]),
    ("work_authorization", ["visa", "sponsorship"]),
    ("work_authorized", ["authorized", "legally"]),
    ("relocation", ["relocate", "remote", "onsite"]),
    ("pronouns", ["pronoun"]),
]
#: Least share of an entry's words that a field without a rule must hold.
LEAST_SHARE = 0.5


def entry_asked(*labels: Column | str) -> Column:
    """The entry that the first telling label asks for; labels in order of trust, null if none tells."""

    def of(low: Column) -> Column:
        return F.coalesce(*(F.when(contains_any(low, words) | ((low == "name") if key == "full_name" else F.lit(False)), key) for key, words in ENTRY_WORDS))

    plain = F.transform(F.array(*(col(c) for c in labels)), lambda c: F.lower(trim(F.coalesce(c, F.lit("")))))
    return F.get(F.filter(F.transform(plain, of), lambda key: key.isNotNull()), 0)


def action(tag: Column, kind: Column) -> Column:
    """What a browser does with the field."""
    return F.when(lower(tag) == "select", "select").when(lower(kind).isin("checkbox", "radio"), "check").when(lower(kind) == "file", "upload").otherwise("type")


def fill_plan(fields: DataFrame, entries: DataFrame) -> DataFrame:
    """fields (form, field, person, tag, kind, label, placeholder, name, id) with columns op, entry and value.

    entries (person, entry, value) are the résumés; repeated ones count once, by the least value. A rule on the words decides first. A field
    without one takes the person's entry of which it holds the most words by share, at least half, then by number, then the first by name;
    a field of kind email or tel without a value takes that entry. A full name is put together from its parts where it is missing. Nulls count
    as blank; fields without an entry stay with null. All joins are by person and entry, or by person and word.
    """
    known = entries.where("person is not null and entry is not null and trim(value) <> ''").groupBy("person", "entry").agg(F.min("value").alias("value"))
    parts = known.where("entry in ('first_name', 'last_name')").groupBy("person").agg(
        F.concat_ws(" ", F.max(F.when(F.col("entry") == "first_name", F.col("value"))), F.max(F.when(F.col("entry") == "last_name", F.col("value")))).alias("value")
    )
    joined_names = parts.join(known.where("entry = 'full_name'").select("person"), "person", "left_anti").select("person", F.lit("full_name").alias("entry"), "value")
    known = known.unionByName(joined_names)

    told = fields.withColumn("_rule", entry_asked("label", "placeholder", "name", "id")).withColumn("op", action(F.col("tag"), F.col("kind")))
    words = told.where("_rule is null").select("form", "field", "person", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "label", "placeholder", "name", "id")))).alias("word"))
    named = known.select("person", "entry", F.array_distinct(tokens(F.replace("entry", F.lit("_"), F.lit(" ")))).alias("words"))
    named = named.select("person", "entry", F.size("words").alias("size"), F.explode("words").alias("word"))
    shared = words.join(named, ["person", "word"]).groupBy("form", "field", "entry").agg(F.count("*").alias("hits"), F.first("size").alias("size"))
    score = F.struct(-F.col("hits") / F.col("size"), -F.col("hits"), "entry")
    best = shared.where(F.col("hits") >= LEAST_SHARE * F.col("size")).groupBy("form", "field").agg(F.min_by("entry", score).alias("_best"))

    by_kind = F.when(lower("kind") == "email", "email").when(lower("kind").isin("tel", "phone"), "phone")
    out = told.join(best, ["form", "field"], "left").withColumn("entry", F.coalesce("_rule", "_best"))
    out = out.join(known, ["person", "entry"], "left").withColumn("_kind", F.when(F.col("value").isNull(), by_kind))
    spare = known.where("entry in ('email', 'phone')").select("person", F.col("entry").alias("_kind"), F.col("value").alias("_spare"))
    out = out.join(spare, ["person", "_kind"], "left")
    out = out.withColumn("entry", F.when(F.col("_spare").isNotNull(), F.col("_kind")).otherwise(F.col("entry"))).withColumn("value", F.coalesce("value", "_spare"))
    return out.select(*fields.columns, "op", "entry", "value")
