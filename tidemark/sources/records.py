"""JSON records in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RELATIONSHIPS = "relationships array<struct<did:string, following:string, followedBy:string>>"
THREAD = "thread struct<replies: array<struct<post: struct<uri:string, author: struct<did:string>, record: struct<text:string>>>>>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_audit(events: DataFrame, path: str) -> None:
    """One folder for each kind and UTC day. events: kind, ts, payload ..."""
    events.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).write.mode("append").partitionBy("kind", "date").json(path)


def relationships(raw: DataFrame, column: str) -> DataFrame:
    """did, graph_distance from relationship responses."""
    r = raw.select(F.explode(F.from_json(column, RELATIONSHIPS)["relationships"]).alias("r")).select("r.*")
    following, followed = F.col("following").isNotNull(), F.col("followedBy").isNotNull()
    kind = F.when(following & followed, "Mutual follow").when(followed, "Follows you").when(following, "You follow").otherwise("Stranger")
    return r.where("did is not null").select("did", kind.alias("graph_distance"))


def thread_replies(raw: DataFrame, column: str) -> DataFrame:
    """did, text, uri of the direct replies; those without a did or text are skipped."""
    r = raw.select(F.explode(F.from_json(column, THREAD)["thread"]["replies"]).alias("r"))
    out = r.select(F.col("r.post.author.did").alias("did"), F.col("r.post.record.text").alias("text"), F.col("r.post.uri").alias("uri"))
    return out.where("coalesce(did, '') <> '' and coalesce(text, '') <> ''")


def typed(raw: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``raw`` with a column for each field (path, type) of a JSON text, and ``malformed``.

    A path that isn't there, or whose value isn't of the type, gives null; text that is no JSON is malformed, and so are all
    its fields null. The text is parsed once. A null text isn't malformed.
    """
    parsed = raw.withColumn("_v", F.try_parse_json(column))
    made = {name: F.try_variant_get("_v", path, kind) for name, (path, kind) in fields.items()}
    return parsed.withColumns({**made, "malformed": F.col(column).isNotNull() & F.col("_v").isNull()}).drop("_v")


def set_aside(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of well-formed texts, malformed rows) of what ``typed`` gives."""
    return rows.where("not malformed").drop("malformed"), rows.where("malformed").drop("malformed")


BLOCK = {"subject": ("$.value.subject", "string"), "created_at": ("$.value.createdAt", "string"), "uri": ("$.uri", "string")}


def blocks(raw: DataFrame, column: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(block records: subject, created_at, uri; newest first, at most so many; malformed rows). Records without a subject are left out."""
    good, bad = set_aside(typed(raw, column, BLOCK))
    good = good.select("subject", F.try_to_timestamp("created_at").alias("created_at"), "uri").where("subject is not null")
    good = good.orderBy(F.desc_nulls_last("created_at"), "uri")
    return (good if most is None else good.limit(most)), bad


def replies_to(posts: DataFrame, uris: DataFrame, depth: int = 1) -> DataFrame:
    """Replies (uri, parent_uri, text ...) under the posts in ``uris`` (uri), with ``root`` and ``depth``; 1 is direct replies only."""
    found, level = None, uris.select(F.col("uri").alias("root"), F.col("uri").alias("parent_uri")).distinct()
    for d in range(1, depth + 1):
        step = posts.join(level, "parent_uri").withColumn("depth", F.lit(d))
        found = step if found is None else found.unionByName(step)
        level = step.select("root", F.col("uri").alias("parent_uri")).distinct()
    return found


def json_number(column: Column, path: str) -> Column:
    return F.get_json_object(column, path).try_cast("double")


def json_array(column: Column, element: str) -> Column:
    kind = f"array<{element}>"
    return F.coalesce(F.from_json(column, kind), F.array().cast(kind))


#: States of a job and what each asks for (any other has failed).
JOB_STATES = {"IN_QUEUE": "wait", "IN_PROGRESS": "wait", "TIMED_OUT": "retry", "COMPLETED": "done"}

JOB = "id string, status string, error string, output array<struct<toxic: boolean, confidence: double>>"
ATTRIBUTES = "attributeScores map<string, struct<summaryScore: struct<value: double>>>"
DID_DOCUMENT = "service array<struct<id: string, type: string, serviceEndpoint: string>>"


def job_state(raw: Column) -> Column:
    """What a job's envelope says: its status, and what to do (done, wait, retry, failed). One that can't be parsed has failed."""
    job = F.from_json(raw, JOB)
    status = job["status"]
    says = F.create_map(*[F.lit(x) for kv in JOB_STATES.items() for x in kv])[status]
    todo = F.when((says == "done") & job["output"].isNull(), "failed").otherwise(F.coalesce(says, F.lit("failed")))
    return F.struct(job["id"].alias("id"), status.alias("status"), todo.alias("todo"), F.coalesce(F.size(job["output"]), F.lit(0)).alias("outputs"))


def attribute_score(raw: Column, name: str) -> Column:
    """The summary score of an attribute; 0 where the response lacks it."""
    return F.coalesce(F.get(F.transform(F.filter(F.map_entries(F.from_json(raw, ATTRIBUTES)["attributeScores"]), lambda e: e["key"] == name), lambda e: e["value"]["summaryScore"]["value"]), 0), F.lit(0.0))


def service_endpoint(raw: Column, kind: str = "#atproto_pds") -> Column:
    """Endpoint of the first service of that id or type in an identity document; null without one."""
    services = F.from_json(raw, DID_DOCUMENT)["service"]
    return F.get(F.filter(services, lambda x: x["id"].endswith(kind) | (x["type"] == kind)), 0)["serviceEndpoint"]


def exported(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with the named columns as JSON text."""
    return rows.withColumns({c: F.to_json(c) for c in columns})


def write_lines(rows: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Rows as JSON lines or as tab-separated values with a header."""
    if kind not in ("jsonl", "tsv"):
        raise ValueError(f"unknown kind {kind!r}")
    writer = rows.write.mode("errorifexists")
    if kind == "jsonl":
        writer.json(path)
    else:
        writer.option("sep", "\t").option("header", True).csv(path)
