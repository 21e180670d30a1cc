"""Validated intake of posted bodies: what is sound goes on, the rest goes to dead letters with its reason; nothing is lost."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Form:
    """What a kind of body must be: fields and types, which of them must be there, which values they may have."""

    fields: str
    required: tuple[str, ...]
    allowed: tuple[tuple[str, tuple[str, ...]], ...] = ()


# Bodies of the posting, heartbeat and run endpoints, their required fields and levels.
FORMS = {
    "job": Form(
        "title string, company string, description string, location string, remote boolean, level string, totalCompensation double, url string, test boolean",
        ("title", "company", "description", "location", "remote", "level", "totalCompensation", "url"),
        (("level", ("junior", "mid", "senior", "staff")),),
    ),
    "heartbeat": Form(
        "workerId string, hostname string, temporalAddress string, temporalNamespace string, taskQueue string, workflows array<struct<id string, type string, status string, startTime string>>, noWorkflowsReason string",
        ("workerId", "hostname", "temporalAddress", "temporalNamespace", "taskQueue", "workflows"),
    ),
    "run": Form(
        "runId string, workflowId string, workflowName string, status string, startedAt long, completedAt long, siteUrls array<string>, sitesProcessed int, jobsScraped int, workerId string, taskQueue string, error string",
        ("runId", "workflowId", "status", "startedAt", "siteUrls"),
    ),
}


def judged(bodies: DataFrame, form: Form, column: str = "body") -> DataFrame:
    """Rows with `parsed`, the body's fields, and `reason`: null for a sound body, else bad_json, missing:<field> or invalid:<field>, the first that holds.

    A body that isn't one JSON object, or whose fields have other types, is bad JSON; a null field is missing.
    """
    raw = F.from_json(column, f"{form.fields}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = bodies.withColumn("parsed", raw)
    p = F.col("parsed")
    shaped = F.coalesce(p["_corrupt"].isNull() & F.col(column).rlike(r"^\s*\{"), F.lit(False))
    tests: list[tuple[str, Column]] = [("bad_json", ~shaped)]
    tests += [(f"missing:{f}", p[f].isNull()) for f in form.required]
    tests += [(f"invalid:{f}", ~p[f].isin(*values)) for f, values in form.allowed]
    reason = F.coalesce(*(F.when(hit, F.lit(name)) for name, hit in tests))
    return rows.withColumn("reason", reason).withColumn("parsed", F.when(F.col("reason").isNull(), p.dropFields("_corrupt")))


def parted(bodies: DataFrame, form: Form, column: str = "body") -> dict[str, DataFrame]:
    """accepted: the other columns and the body's fields; rejected: the row as it came and its reason."""
    rows = judged(bodies, form, column)
    rest = [c for c in bodies.columns if c != column]
    return {"accepted": rows.where("reason is null").select(*rest, "parsed.*"), "rejected": rows.where("reason is not null").select(*bodies.columns, "reason")}


def writer(path: str, form: Form, column: str = "body") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function with two sinks, a folder a batch each, so that a replayed batch overwrites what it wrote before.

    The batch is judged and written once, by reason; both sinks are folders of that one write, and so appear together.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = judged(batch, form, column).withColumn("fate", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))
        rows.write.mode("overwrite").partitionBy("fate").parquet(f"{path}/batch={number}")

    return write


def written(rows: DataFrame, fate: str) -> DataFrame:
    """One sink of what writer() left, read by its path: rows of spark.read.parquet(path)."""
    held = rows.where(F.col("fate") == fate).drop("fate")
    return held.select(*(c for c in held.columns if c not in ("parsed", "reason", "body")), "parsed.*") if fate == "accepted" else held.drop("parsed")


def latest_workers(heartbeats: DataFrame, at: str) -> DataFrame:
    """One row a worker: its last heartbeat."""
    rest = F.struct(at, *(c for c in heartbeats.columns if c not in (at, "workerId")))
    return heartbeats.groupBy("workerId").agg(F.max_by(rest, F.struct(at, F.to_json(rest))).alias("r")).select("workerId", "r.*")
