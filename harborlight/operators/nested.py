"""Values of payloads nested to any depth: VARIANT exploded level by level, some levels a job, until no object or array is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.functions import payload
from harborlight.operators.scratch import kept

# Spellings under which provider responses keep a body, the preferred first; the same for titles and places.
BODY_TEXT_KEYS = ["commonmark", "markdown", "content", "text", "body", "result", "html", "raw_html", "raw"]
EVENT_TITLE_KEYS = ["title", "job_title", "jobtitle", "name"]
EVENT_PLACE_KEYS = ["location", "joblocation", "locations", "office"]

#: Levels that one job goes down.
ROUND = 10
_FOUND = "struct<order: struct<holder: array<int>, rank: bigint, path: array<int>>, hit: struct<key: string, text: string, depth: int>>"


def first_text_under(rows: DataFrame, id_col: str, payload_col: str, keys: list[str]) -> DataFrame:
    """(id, key, text, depth) of the preferred text of each payload that has one.

    Objects are asked in reading order, an object before what it holds; of one object's non-blank texts the one under the key that
    comes first in keys (in any case) is taken. Members of an object go by key, as VARIANT stores them. Payloads that aren't JSON have no text.

    One job goes down ROUND levels: a row is a value to open, with the places of its ancestors and its own (path), or a text that was found.
    Only what lies deeper is written out as JSON for another job, so that lineage doesn't grow with depth.
    """
    spark = rows.sparkSession
    text, place = payload.get(F.col("value"), "$", "string"), F.array_append("path", F.col("pos"))
    tells = F.lower("key").isin(keys) & (F.schema_of_variant("value") == "STRING") & (F.trim(text) != "")
    order = F.struct(F.col("path").alias("holder"), F.array_position(F.array(*map(F.lit, keys)), F.lower("key")).alias("rank"), place.alias("path"))
    hit = F.struct(order.alias("order"), F.struct("key", text.alias("text"), F.size(place).alias("depth")).alias("hit"))
    deep = payload.get(F.col("v"), "$", "map<string,variant>").isNotNull() | payload.get(F.col("v"), "$", "array<variant>").isNotNull()
    at = rows.select(F.col(id_col).alias("id"), F.array().cast("array<int>").alias("path"), F.col(payload_col).alias("json"))
    rounds = []
    while True:
        open_ = at.select("id", "path", F.lit(None).cast(_FOUND).alias("found"), payload.variant("json").alias("v")).where("v is not null")
        for _ in range(ROUND):
            # A value that can't be opened gives one row without a place: a found text is carried on by it, others end.
            each = spark.sql("SELECT t.id, t.path, t.found, e.pos, e.key, e.value FROM {rows} t, LATERAL variant_explode_outer(t.v) e", rows=open_)
            open_ = each.where("pos is not null or found is not null").select("id", place.alias("path"), F.coalesce("found", F.when(tells, hit)).alias("found"), F.col("value").alias("v"))
        left = open_.where(F.col("found").isNotNull() | F.coalesce(deep, F.lit(False)))
        rounds.append(kept(left.select("id", "path", "found", F.when(F.col("found").isNull(), F.to_json("v")).alias("json")), "levels"))
        at = rounds[-1].where("json is not null").select("id", "path", "json")
        if at.isEmpty():
            break
    found = reduce(DataFrame.union, [r.where("found is not null").select("id", "found") for r in rounds])
    return found.groupBy("id").agg(F.min_by("found.hit", "found.order").alias("hit")).select("id", "hit.*")
