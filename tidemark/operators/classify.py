"""Classification in chunks, with failures by kind.

A chunk is one request of a classifier that takes several texts at once. What
goes wrong has one of four kinds: ``decode`` costs one text only, which counts as
benign under a model id of its own, so that it can't raise a score; ``transient``
is tried again a few times, and then leaves the chunk for a later run;
``cost_cap`` and ``abort`` are not tried again. A chunk's failure is a column of its
rows: the other chunks' verdicts are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Verdict (flag, confidence) of each text, in order; an exception in its place costs that text only.
Batch = Callable[[list[str]], list]
#: Kinds that stop a run, the one that counts first.
STOPS = ["cost_cap", "abort", "transient"]
DECODE_ERROR = "decode-error"


class Transient(Exception):
    """May go well another time."""


class CostCapped(Exception):
    """No more money may be spent."""


def one_chunk(ask: Batch, texts: list[str], tries: int) -> tuple[list, str | None, str | None, int]:
    """(outcomes, failure, detail, tries made)."""
    for n in range(1, tries + 1):
        try:
            found = list(ask(texts))
        except Transient as e:
            if n == tries:
                return [], "transient", str(e), n
        except CostCapped as e:
            return [], "cost_cap", str(e), n
        except Exception as e:  # noqa: BLE001  any other error would come again each time
            return [], "abort", f"{type(e).__name__}: {e}", n
        else:
            if len(found) != len(texts):
                return [], "abort", f"{len(found)} verdicts for {len(texts)} texts", n
            return found, None, None, n
    raise ValueError("tries must be 1 or more")


def in_chunks(rows: DataFrame, ask: Batch, chunk: str = "chunk", order: str = "_n", text: str = "text", model_id: str = "model", tries: int = 3) -> DataFrame:
    """``rows`` with toxic_token, confidence, model_id, failure, detail and tries; rows with the same ``chunk`` are one request.

    A chunk must be small enough for a request; its texts are asked in ``order``.
    A null text is asked as an empty one.
    """
    kept = [f for f in rows.schema.fields if f.name not in ("toxic_token", "confidence", "model_id", "failure", "detail", "tries")]
    made = T.StructType([*kept, *T._parse_datatype_string("toxic_token boolean, confidence double, model_id string, failure string, detail string, tries int").fields])
    names = [f.name for f in kept]

    def judged(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        found, failure, detail, n = one_chunk(ask, frame[text].fillna("").tolist(), tries)
        out = []
        for x in found or [None] * len(frame):
            if failure:
                out.append((None, None, None, failure, detail, n))
            elif isinstance(x, Exception):
                out.append((False, 0.0, DECODE_ERROR, None, str(x), n))
            else:
                out.append((bool(x[0]), float(x[1]), model_id, None, None, n))
        more = pd.DataFrame(out, columns=["toxic_token", "confidence", "model_id", "failure", "detail", "tries"], index=frame.index)
        return pd.concat([frame, more.astype({"toxic_token": object, "confidence": float})], axis=1)

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunks of sorted rows, of which the last of a batch may go on in the next."""
        rest = None
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            last = f[chunk].iloc[-1]
            rest = f[f[chunk] == last]
            for _, part in f[f[chunk] != last].groupby(chunk, sort=False):
                yield judged(part)
        if rest is not None and len(rest):
            yield judged(rest)

    return rows.select(*names).repartition(chunk).sortWithinPartitions(chunk, order).mapInPandas(stream, made)

