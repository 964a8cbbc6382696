"""Hooks for callables of the user (X1-X3), and SQL functions (X4). No network is used here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.functions import scalars as S
from ticketflow.operators import windows
from ticketflow.operators.lineage import cut


class Transient(Exception):
    """A failure that is worth another try."""


def _retried(fn: Callable, arg, retries: int, base_s: float):
    for k in range(retries + 1):
        try:
            return fn(arg), None
        except Transient as x:
            if k == retries:
                return None, f"transient: {x}"
            time.sleep(min(30.0, base_s * 2**k))
        except Exception as x:  # the row carries the reason
            return None, str(x)


def score_batches(df: DataFrame, fn: Callable[[list[str]], list[str]], batch_size: int = 20, retries: int = 3, base_s: float = 2.0, by: Sequence[str] = (), fields: Sequence[str] = ()) -> DataFrame:
    """(id, prompt, and the columns of `by`) -> id, reply, error, and the reply's `fields` (P21). `fn` gets the prompts of one batch of W7 at a time.

    Batches are the same on every run: rows of a group in order of id. Secrets are removed from replies and errors (P17). `fn` runs once for a batch, as what it
    gave is kept in the checkpoint folder.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        replies, error = _retried(fn, part["prompt"].tolist(), retries, base_s)
        if error is None and len(replies) != len(part):
            error = f"{len(replies)} replies for {len(part)} prompts"
        return pd.DataFrame({"id": part["id"], "reply": [None] * len(part) if error else list(replies), "error": error})

    keys = list(by) or ["_all"]
    rows = df.select("id", "prompt", *by) if by else df.select("id", "prompt").withColumn("_all", F.lit(0))
    kind = df.schema["id"].dataType.simpleString()
    out = cut(windows.batch_assign(rows, batch_size, keys, ["id"]).groupBy(*keys, "batch").applyInPandas(run, f"id {kind}, reply string, error string"))
    out = out.withColumn("reply", F.when(F.col("reply").isNotNull(), S.redact_secrets(F.col("reply")))).withColumn("error", F.when(F.col("error").isNotNull(), S.redact_secrets(F.col("error"))))
    return out.select("*", *[S.parse_reply(F.col("reply"), f).alias(f) for f in fields])


def embed_texts(df: DataFrame, fn: Callable[[list[str]], list[list[float]]], dim: int) -> DataFrame:
    """(id, text) -> id, embedding. Each distinct text is embedded once; a wrong dimension or a failure gives null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors, error = _retried(fn, frame["text"].tolist(), 0, 0.0)
            yield pd.DataFrame({"text": frame["text"], "embedding": [list(map(float, v)) if error is None and v is not None and len(v) == dim else None for v in (vectors or [None] * len(frame))]})

    distinct = df.select("text").filter("text is not null").distinct().mapInPandas(run, "text string, embedding array<double>")
    return df.select("id", "text").join(distinct.hint("merge"), "text", "left").select("id", "embedding")


def extract_attachments(df: DataFrame, fn: Callable[[str], str | None], max_bytes: int, mimes: tuple[str, ...] = ("image/png", "image/jpeg")) -> DataFrame:
    """(id, sha, mime, size, content) -> id, text, status. One call for each distinct content that passes the gate."""
    ok = F.col("mime").isin(*mimes) & (F.col("size") <= max_bytes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [_retried(fn, c, 0, 0.0) for c in frame["content"]]
            yield pd.DataFrame({"sha": frame["sha"], "text": [g[0] for g in got], "status": ["ok" if g[1] is None else "failed" for g in got]})

    once = df.filter(ok).dropDuplicates(["sha"]).select("sha", "content").mapInPandas(run, "sha string, text string, status string")
    rows = df.withColumn("gated", ~F.coalesce(ok, F.lit(False))).join(once.hint("merge"), "sha", "left")
    return rows.select("id", F.when(~F.col("gated"), F.col("text")).alias("text"), F.when(F.col("gated"), "skipped").otherwise(F.col("status")).alias("status"))


def _replaced(text: str, steps: Sequence[tuple[str, str]]) -> str:
    """SQL of replacements one after the other."""
    for pattern, to in steps:
        text = f"regexp_replace({text}, r'{pattern}', r'{to}')"
    return text


def register_sql(spark: SparkSession) -> None:
    """SQL functions of P1, P7, P8, P14, P16 and P24, as expressions that the optimizer sees through."""
    words = "lower(concat(coalesce(title, ''), ' ', coalesce(description, '')))"
    for text in (
        f"tf_content_hash(title STRING, description STRING) RETURNS STRING RETURN substring(sha2(trim({_replaced(words, S.HASHED)}), 256), 1, 16)",
        f"tf_mask_pii(s STRING) RETURNS STRING RETURN {_replaced('s', S.PII)}",
        "tf_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN exists(a, x -> x <> 0) AND exists(b, x -> x <> 0) THEN aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x) / (sqrt(aggregate(a, CAST(0 AS DOUBLE), (s, x) -> s + x * x)) * sqrt(aggregate(b, CAST(0 AS DOUBLE), (s, x) -> s + x * x))) ELSE CAST(0 AS DOUBLE) END",
        r"tf_offering_key(s STRING) RETURNS STRING RETURN CASE WHEN contains(s, '.') THEN trim(regexp_extract(trim(s), '^(.*)\\.[^.]*$', 1)) END",
        "tf_service_key(s STRING) RETURNS STRING RETURN CASE WHEN coalesce(trim(s), '') = '' OR endswith(trim(s), '.OFFERING-GAP') OR startswith(lower(trim(substring_index(trim(s), '.', 1))), 'system/application') OR trim(substring_index(trim(s), '.', 1)) = 'General / Unspecified' THEN '' ELSE trim(substring_index(trim(s), '.', 1)) END",
        r"tf_normalize_code(s STRING) RETURNS STRING RETURN upper(translate(s, '٠١٢٣٤٥٦٧٨٩ \t\r\n-_', '0123456789'))",
        "tf_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, x) -> s + x)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
