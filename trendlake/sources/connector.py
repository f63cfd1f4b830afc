"""Stored payloads, in place of the sources' interfaces, and what requests to these would carry."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def payloads(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, name, payload) of stored payloads, a row a file: files, folders or patterns in any store that Spark reads. Failed reads are retried as tasks are. id: a hash of the file's name."""
    rows = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("payload"))
    return rows.select(F.xxhash64("name").alias("id"), "name", "payload")


def bearer(token: str) -> dict[str, str]:
    """The header of a request with a token; none without one."""
    return {"Authorization": f"Bearer {token.strip()}"} if token and token.strip() else {}


def wait_seconds(status: int, headers: dict[str, str], attempt: int, now: float = 0.0, first: float = 0.25, most: float = 60.0) -> float | None:
    """How long to wait before a request is tried again: what a limited source asks for, else longer each time; None where trying again won't help."""
    if status not in (403, 408, 425, 429) and status < 500:
        return None
    h = {k.lower(): v for k, v in headers.items()}
    if "retry-after" in h and h["retry-after"].strip().isdigit():
        return min(most, float(h["retry-after"]))
    if h.get("x-ratelimit-remaining") == "0" and h.get("x-ratelimit-reset", "").isdigit():
        return min(most, max(0.0, float(h["x-ratelimit-reset"]) - now))
    return None if status == 403 else min(most, first * 2 ** (attempt - 1))


def spaced(requests: DataFrame, source: str, order: list, seconds: float, stored=None) -> DataFrame:
    """requests with not_before, in seconds from the start: those of one source follow each other, in order, after `seconds` at least. A source with most requests is numbered by many tasks."""
    from ..operators.ordering import ranks
    from .sinks import stored as kept

    return ranks(requests, [source], order, stored or kept, "_turn").withColumn("not_before", (F.col("_turn") - 1) * F.lit(float(seconds))).drop("_turn")


def tc3_signature(secret: str, service: str, day: str, to_sign: str) -> str:
    """The TC3-HMAC-SHA256 signature of a text: keys derived from day and service, in hexadecimal."""
    key = ("TC3" + secret).encode()
    for part in (day, service, "tc3_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    return hmac.new(key, to_sign.encode(), hashlib.sha256).hexdigest()
