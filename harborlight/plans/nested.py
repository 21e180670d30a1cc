"""Queries over JSON in running text and over payloads of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions import jsonscan, markdown, payload
from harborlight.operators import nested
from harborlight.plans.registry import Registry

R = Registry()

_STRING = r'"(?:[^"\\]|\\.)*"'
_FLAT = rf'\{{(?:[^{{}}"\[\]]|{_STRING})*\}}|\[(?:[^{{}}"\[\]]|{_STRING})*\]'
_TWO = rf'[{{\[](?:[^{{}}"\[\]]|{_STRING}|{_FLAT})*[}}\]]'

#: What is planted behind each document, by doc_id % 6: nothing, flat and nested values, a value inside an unsound one, an unclosed one.
_PLANTED = r"""CASE doc_id % 6
  WHEN 0 THEN ' said "no: {"a": ' || doc_id || ', "b": "x}y"} end'
  WHEN 1 THEN ' [1, {"k": "v' || doc_id || '"}] and {"z": [' || doc_id || ', "]"]}'
  WHEN 2 THEN ' {"open": [' || doc_id || '], '
  WHEN 3 THEN ' {bad {"in": ' || doc_id || '} x} {"n": tru}'
  WHEN 4 THEN ' {"q": "say ' || chr(92) || '"hi' || chr(92) || '" {"}' ELSE '' END"""


@R.add("document_json_values", rf"""
SELECT doc_id, array_to_string(flatten(list_transform(regexp_extract_all(t, '{_TWO}'), lambda m: CASE WHEN json_valid(m) THEN [m] ELSE list_filter(regexp_extract_all(substr(m, 2), '{_FLAT}'), lambda x: json_valid(x)) END)), chr(10)) AS found
FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 2 THEN replace(t, '{{"open"', '("open"') ELSE t END AS t FROM (SELECT doc_id, translate(coalesce(text, ''), '{{}}[]', '()()') || {_PLANTED} AS t FROM documents))""")  # fmt: skip
def document_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost sound JSON values of each document's text and what is planted behind it; an unclosed object's list counts."""
    t = F.concat(F.translate(F.coalesce("text", F.lit("")), "{}[]", "()()"), F.expr(_PLANTED.replace("chr(92)", "char(92)")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.array_join(jsonscan.values_in(t), "\n").alias("found"))


#: Each event's note: a theme setting, a text that only looks like one, or none, under a number of objects; every seventh lacks a brace.
_NOTE = """'note  ' || event_type || ' ' || repeat('{"k": ', CAST(user_id % 13 AS INT)) || CASE event_id % 3 WHEN 0 THEN '{"customTheme": ' || props || '}' WHEN 1 THEN '{"a": "custom{Theme"}' ELSE '{"varTheme": "}"}' END
  || repeat('}', CAST(user_id % 13 - CASE WHEN event_id % 7 = 0 AND user_id % 13 > 0 THEN 1 ELSE 0 END AS INT)) || '  tail ' || event_id"""


@R.add("event_theme_cut", f"""
WITH t AS (SELECT event_id, {_NOTE} AS t FROM events), c AS (SELECT event_id, unnest(range(1, length(t) + 1)) AS i, t FROM t),
p AS (SELECT event_id, i, substr(t, i, 1) AS c, count(*) FILTER (substr(t, i, 1) = '"') OVER (PARTITION BY event_id ORDER BY i) % 2 AS inside FROM c),
b AS (SELECT event_id, i, c, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY event_id ORDER BY i) + CASE WHEN c = '}}' THEN 1 ELSE 0 END AS level FROM p WHERE c IN ('{{', '}}') AND inside = 0),
m AS (SELECT event_id, i AS s, lead(i) OVER w AS e, c, lead(c) OVER w AS d FROM b WINDOW w AS (PARTITION BY event_id, level ORDER BY i)),
s AS (SELECT m.event_id, s, e FROM m JOIN t USING (event_id) WHERE c = '{{' AND d = '}}' AND regexp_matches(substr(t, s, e - s + 1), 'customTheme|varTheme')),
o AS (SELECT event_id, min(s) AS s, arg_min(e, s) AS e FROM s GROUP BY event_id)
SELECT event_id, CASE WHEN s IS NULL THEN t ELSE regexp_replace(substr(t, 1, s - 1) || ' ' || substr(t, e + 1), '[ \\t]+', ' ', 'g') END AS body FROM t LEFT JOIN o USING (event_id)""")  # fmt: skip
def event_theme_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme objects under up to thirteen others go from the outermost closed brace; the SQL counts depth character by character."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", markdown.cut_theme_objects(F.expr(_NOTE)).alias("body"))


_LINKS = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"


def _listing(links: Column) -> Column:
    jobs = F.transform(links, lambda u: F.struct(u.alias("absolute_url"), F.lit("a {b} \"c\"").alias("title")))
    return F.to_json(F.struct(F.struct(F.lit(1).alias("page")).alias("meta"), F.struct(F.array(F.struct(jobs.alias("jobs"))).alias("board")).alias("data")))


@R.add("page_listing_payloads", f"SELECT page_id, len({_LINKS})::BIGINT AS n, {_LINKS}[1] AS first_url FROM pages WHERE page_id % 5 <> 4")
def page_listing_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of each page's links, three objects deep: in a <pre> block, in a code fence, in two pieces, or after other words; every fifth is cut off."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", _listing(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("json"))
    half = (F.length("json") / 2).cast("int")
    pre = F.concat(F.lit("<html><body><pre class='x'>"), F.replace(F.replace(F.col("json"), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("</pre></body>"))
    fence = F.concat(F.lit("Here is it:\n```json\n"), F.col("json"), F.lit("\n```\nbye"))
    pieces = jsonscan.merged_fragments(F.array(F.substr("json", F.lit(1), half), F.lit(" "), F.substr("json", half + 1)))
    kind = F.col("page_id") % 5
    sent = F.when(kind == 0, pre).when(kind == 1, fence).when(kind == 2, pieces).when(kind == 3, F.concat(F.lit('he said: "'), F.col("json"), F.lit("[1"))).otherwise(F.substr("json", F.lit(1), half))
    jobs = payload.board_jobs(jsonscan.jobs_payload(sent))
    return p.select("page_id", jobs.alias("jobs")).where("jobs is not null").select("page_id", F.size("jobs").cast("long").alias("n"), F.get("jobs.absolute_url", 0).alias("first_url"))


#: Provider events: a text under one of four spellings, under up to eight objects and lists, with a later text at the top.
_NESTED = """repeat('{"data": [7, ', CAST(user_id % 9 AS INT)) || '{"' || CASE event_id % 4 WHEN 0 THEN 'Content' WHEN 1 THEN 'markdown' WHEN 2 THEN 'none' ELSE 'text' END || '": "' || event_type || ' ' || event_id || '", "body": "' || CASE WHEN event_id % 3 = 0 THEN 'b' || user_id ELSE ' ' END
  || '", "html": {"text": 5}}' || repeat('], "more": {"raw": "late"}}', CAST(user_id % 9 AS INT))"""


@R.add("event_nested_texts", f"""
SELECT event_id, arg_min(key, (parent, rank)) AS key, arg_min(atom ->> '$', (parent, rank)) AS text FROM (
  SELECT event_id, t.key, t.atom, t.parent, list_position(['commonmark', 'markdown', 'content', 'text', 'body', 'result', 'html', 'raw_html', 'raw'], lower(t.key)) AS rank
  FROM (SELECT event_id, ({_NESTED})::JSON AS j FROM events) e, json_tree(e.j) t WHERE t.type = 'VARCHAR' AND trim(t.atom ->> '$') <> '') u
WHERE rank IS NOT NULL GROUP BY event_id""")  # fmt: skip
def event_nested_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred text of payloads nested to different depths."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_NESTED).alias("body"))
    found = nested.first_text_under(e, "event_id", "body", nested.BODY_TEXT_KEYS)
    return found.select(F.col("id").alias("event_id"), "key", "text")
