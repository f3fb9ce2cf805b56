"""Calls to outside services from within Spark, with the service as an injectable function.

No network code lives here: a service is a callable a caller supplies, deterministic stubs stand in for it offline.
Defined results: a call that keeps failing gives null and never fails the job; a reply that holds no JSON object gives null.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import article_text

MIN_CHARS = 50


class Missing(Exception):
    """What was asked for is not there (a reply with status 404); asking again is no use."""


def with_retries(call: Callable[[str], str | None], attempts: int = 3, pause: float = 0.0, permanent: tuple[type[Exception], ...] = (Missing,)) -> Callable[[str], str | None]:
    """``call``, tried up to ``attempts`` times with doubling pauses; None once they are used up or on a permanent failure."""

    def tried(request: str) -> str | None:
        for k in range(attempts):
            try:
                return call(request)
            except permanent:
                return None
            except Exception:  # noqa: BLE001 - any failure of an outside service is a missing reply
                if pause and k + 1 < attempts:
                    time.sleep(pause * 2**k)
        return None

    return tried


def ask(rows: DataFrame, request: str, call: Callable[[str], str | None], out: str = "reply") -> DataFrame:
    """``rows`` plus the reply to each row's request text; one call a row, in Arrow batches."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{out}` string"

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in it:
            yield part.assign(**{out: [None if r is None else call(r) for r in part[request]]})

    return rows.mapInPandas(batches, schema)


def article_requests(articles: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``articles`` of at least ``min_chars`` characters in all, plus ``request``: title, text, date and source as JSON."""
    whole = F.concat(*[F.coalesce(c, F.lit("")) for c in ("content", "description", "title")])
    text = article_text(F.col("content"), F.col("description"), F.col("title"))
    body = F.to_json(F.struct(F.coalesce("title", F.lit("")).alias("title"), text.alias("text"), F.coalesce("published_at", F.lit("")).alias("published_at"), F.coalesce("source_name", F.lit("")).alias("source")))
    return articles.where(F.length(whole) >= min_chars).withColumn("request", body)


def stub_sentiment(request: str) -> str:
    """A deterministic stand-in for a sentiment service: a score from the length of the text."""
    return json.dumps({"sentiment_score": (len(request) % 201 - 100) / 100})


def sentiment_score(reply) -> F.Column:
    """The score of a reply, 0.0 where it is missing."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(reply), "$.sentiment_score", "double"), F.lit(0.0))
