"""Line deduplication with DataFrame functions only.

Lines are exploded and normalised, their keys hashed to 128 bits, and the
distinct documents of each hash counted. Where a key stands in at least
``min_docs`` documents its lines go, except in the smallest doc_id that holds
it. What stays is put together again by position.

The hashed lines are written once and read twice (count, then join), so texts
are split and hashed once. Counting keeps two ids a key in the map-side
combine. The few keys that hold a large share of all lines are joined by a
broadcast of a fixed bound, so the join's shuffle has no hot key.

Defined results: a null or empty text is one empty line; a document without
doc_id is left out, as it cannot be named; rows with the same doc_id are one
document for the count and are answered once each; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frequent import join_hot
from .scratch import keep

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def drops(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(_tm_id, _tm_th, _tm_bounds): -1, the sorted positions of the lines that each document loses, 2**30."""
    long_lines = (
        docs.select("_tm_id", "_tm_th", F.posexplode("_tm_lines").alias("pos", "line"))
        .select("_tm_id", "_tm_th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("_tm_id", "_tm_th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    hashed = keep(long_lines, "lines")
    sizes = [F.min("_tm_id").alias("keeper"), F.count("*").alias("n")]
    if min_docs <= 2:
        common = hashed.groupBy("h1", "h2").agg(*sizes, F.max("_tm_id").alias("last")).where(F.col("keeper") < F.col("last"))
    else:
        common = hashed.groupBy("h1", "h2").agg(*sizes, F.count_distinct("_tm_id").alias("docs")).where(F.col("docs") >= min_docs)
    common = keep(common.select("h1", "h2", "keeper", "n"), "common")
    return (
        join_hot(hashed, common, ["h1", "h2"], "n")
        .where(F.col("_tm_id") != F.col("keeper"))
        .groupBy("_tm_id", "_tm_th")
        .agg(F.concat(F.array(F.lit(-1)), F.sort_array(F.collect_set("pos")), F.array(F.lit(1 << 30))).alias("_tm_bounds"))
    )


def kept_lines() -> Column:
    """The runs of lines between those that go, in order: linear in the number of lines."""
    at = lambda k: F.get(F.col("_tm_bounds"), k)
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_tm_bounds") - 2),
        lambda k: F.slice(F.col("_tm_lines"), at(k) + 2, at(k + 1) - at(k) - 1),
    )
    return F.when(F.col("_tm_bounds").isNull(), F.col("_tm_lines")).otherwise(F.flatten(runs))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows with ``text_col`` cut to the lines that stay, and n_lines and n_dropped added."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.where(F.col(id_col).isNotNull())
    lines = named.select(F.col(id_col).alias("_tm_id"), F.xxhash64(text).alias("_tm_th"), F.split(text, "\n").alias("_tm_lines"))
    gone = drops(lines, min_chars, min_docs)
    joined = named.withColumn("_tm_hash", F.xxhash64(text))
    joined = joined.join(gone, (joined[id_col] == gone["_tm_id"]) & (joined["_tm_hash"] == gone["_tm_th"]), "left")
    return (
        joined.withColumn("_tm_lines", F.split(text, "\n"))
        .withColumn("n_lines", F.size("_tm_lines").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("_tm_bounds") - 2, F.lit(0)).cast("long"))
        .withColumn(text_col, F.array_join(kept_lines(), "\n"))
        .drop("_tm_lines", "_tm_bounds", "_tm_id", "_tm_th", "_tm_hash")
    )


def line_report(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    done = dedup_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
