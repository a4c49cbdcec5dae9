"""Two-stage classification, verdict bookkeeping, agreement and accuracy."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring

Classifier = Callable[[DataFrame], DataFrame]
#: Scores of a batch of texts, one for each and in their order.
BatchScorer = Callable[[list[str]], list[float]]


def one_by_one(score: BatchScorer, texts: list[str]) -> list[float | None]:
    """Scores of the batch; if it fails or returns another number of them, of each text alone, null where that fails too."""
    if not texts:
        return []
    try:
        found = list(score(texts))
        if len(found) == len(texts):
            return found
    except Exception:  # noqa: BLE001
        pass
    out: list[float | None] = []
    for t in texts:
        try:
            single = list(score([t]))
            out.append(single[0] if len(single) == 1 else None)
        except Exception:  # noqa: BLE001
            out.append(None)
    return out


def scored_batches(score: BatchScorer, text: str, batch: int):
    """Arrow batches with ``score``. Texts of one call at a time are Python objects, however long an Arrow batch is."""

    def run(batches):
        for whole in batches:
            for b in (whole.slice(at, batch) for at in range(0, whole.num_rows, batch)):
                texts = b.column(b.schema.get_field_index(text)).to_pylist()
                there = [i for i, t in enumerate(texts) if t is not None]
                found: list[float | None] = [None] * len(texts)
                for i, s in zip(there, one_by_one(score, [texts[i] for i in there]), strict=True):
                    found[i] = None if s is None or s != s else float(s)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*b.schema.names, "score"])

    return run


def clean_pass(rows: DataFrame, score: BatchScorer, text: str = "text", batch: int = 64) -> DataFrame:
    """``rows`` with ``score``: one bad text costs its own score only, not its batch's nor its account's. Null texts have none."""
    rows = rows.drop("score")
    return rows.mapInArrow(scored_batches(score, text, batch), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def each_account(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "account_id", most: int = 500) -> DataFrame:
    """What ``work`` makes of each account's rows, with ``error``: one account that fails is one row with its error, and costs no other.

    For steps that need Python over a whole account's sample, which is bounded (an account with more than ``most`` rows fails).
    """
    kind = rows.schema[key].dataType
    made = T.StructType([T.StructField(key, kind), *T._parse_datatype_string(schema).fields, T.StructField("error", T.StringType())])

    def run(account: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            if len(frame) > most:
                raise ValueError(f"{len(frame)} rows")
            out = work(frame).assign(error=None)
        except Exception as e:  # noqa: BLE001  whatever it is, it stays with its account
            out = pd.DataFrame([dict.fromkeys(made.names) | {"error": f"{type(e).__name__}: {e}"}])
        return out.assign(**{key: account[0]})[made.names]

    return rows.groupBy(key).applyInPandas(run, made)


def split_clean(scored: DataFrame, threshold: float = scoring.CLEAN) -> tuple[DataFrame, DataFrame]:
    """(clean, survivors) by a primary score strictly below the threshold; rows without a score are in neither."""
    return scored.where(F.col("score") < threshold), scored.where(F.col("score") >= threshold)


def two_stage(scored: DataFrame, classify: Classifier, threshold: float = scoring.CLEAN, level: float = 0.5) -> DataFrame:
    """The classifier sees survivors only. It adds toxic_token, confidence."""
    clean, rest = split_clean(scored, threshold)
    judged = classify(rest)
    toxic = scoring.is_toxic(F.col("toxic_token"), F.col("confidence"), level)
    judged = judged.withColumn("is_toxic", toxic).withColumn("source", F.when(toxic, "ClassifierToxic").otherwise("ClassifierSafe"))
    clean = clean.withColumn("toxic_token", F.lit(None).cast("boolean")).withColumn("confidence", F.lit(None).cast("double"))
    return clean.withColumn("is_toxic", F.lit(False)).withColumn("source", F.lit("OnnxCleared")).unionByName(judged)


def complete(queue: DataFrame, key: str = "account_id") -> DataFrame:
    """Accounts with all their queued posts done and judged, and those without."""
    done = (F.col("status") == "done") & F.col("toxic_token").isNotNull()
    return queue.groupBy(key).agg(F.bool_and(done).alias("complete"), F.count("*").alias("queued"), F.count_if(done).alias("judged"))


def compare(pairs: DataFrame) -> DataFrame:
    """One row of counters over verdicts a and b of the same rows, null where a backend failed.

    With columns ``label`` (toxic or clean) and ``ms_a``, ``ms_b``, how many of
    the labelled rows each gets right, and their mean latency, are given too.
    """
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    more = []
    if "label" in pairs.columns:
        want = F.when(F.col("label") == "toxic", True).when(F.col("label") == "clean", False)
        more += [F.count(want).alias("labelled"), *[F.count_if(F.col(x) == want).alias(f"{x}_right") for x in ("a", "b")]]
    more += [F.avg(F.when(F.col(x).isNotNull(), F.col(f"ms_{x}"))).alias(f"mean_ms_{x}") for x in ("a", "b") if f"ms_{x}" in pairs.columns]
    n = F.count_if(both)
    return pairs.agg(
        F.count("*").alias("total"),
        n.alias("both_ok"),
        F.count_if(F.col("a").isNull()).alias("a_errors"),
        F.count_if(F.col("b").isNull()).alias("b_errors"),
        F.count_if(both & F.col("a") & F.col("b")).alias("both_toxic"),
        F.count_if(both & ~F.col("a") & ~F.col("b")).alias("both_safe"),
        F.count_if(both & F.col("a") & ~F.col("b")).alias("only_a"),
        F.count_if(both & ~F.col("a") & F.col("b")).alias("only_b"),
        F.when(n > 0, F.count_if(both & (F.col("a") == F.col("b"))) / F.nullif(n, F.lit(0))).otherwise(0.0).alias("agreement"),
        *more,
    )


def disagreements(pairs: DataFrame) -> DataFrame:
    """Rows on which a and b differ; a failed backend differs from none."""
    return pairs.where(F.col("a") != F.col("b"))


def gate(pairs: DataFrame, least: int = 50, agreement: float = 0.85) -> DataFrame:
    c = compare(pairs)
    return c.select("both_ok", "agreement", ((F.col("both_ok") >= least) & (F.col("agreement") >= agreement)).alias("passed"))


def accuracy(labels: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """How the tier ranks against the label's: exact, over, under."""
    got, want = scoring.tier_rank(F.col("tier")), scoring.tier_rank(F.col("label"))
    n = F.count("*")
    return labels.join(scores, keys).agg(
        n.alias("total"),
        F.count_if(got == want).alias("exact"),
        F.count_if(got > want).alias("over"),
        F.count_if(got < want).alias("under"),
        F.when(n > 0, F.count_if(got == want) / F.nullif(n, F.lit(0))).otherwise(0.0).alias("accuracy"),
    )


def histogram(scores: DataFrame) -> DataFrame:
    """Rows by tier; low is what no other bucket holds."""
    t = lambda name: F.count_if(F.col("tier") == name)
    rest = t("High") + t("Elevated") + t("Watch") + t("NotAssessed") + t("Insufficient Data")
    return scores.agg(
        t("High").alias("high"), t("Elevated").alias("elevated"), t("Watch").alias("watch"),
        (F.count("*") - rest).alias("low"), t("NotAssessed").alias("not_assessed"),
        t("Insufficient Data").alias("insufficient"), F.count("*").alias("total"),
    )
