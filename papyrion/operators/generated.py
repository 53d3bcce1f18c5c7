"""Observations from an external model: the request, the provider and the check of its answer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "struct<insights:array<struct<title:string,body:string,category:string,severity:string>>>"


def request(results: DataFrame) -> DataFrame:
    """``doc_id, payload``: the result as JSON without its text and pages."""
    keep = [c for c in results.columns if c not in ("text", "raw_text", "pages")]
    return results.select("doc_id", F.to_json(F.struct(*keep)).alias("payload"))


def validate(raw: Column) -> Column:
    """Observations in an answer: JSON, or the outermost braces in it. Null if there is no list of them.

    Titles have 120 characters at most, bodies 600, categories 60; an unknown severity counts as info.
    """
    block = F.regexp_extract(raw, r"\{[\s\S]*\}", 0)
    parsed = F.from_json(F.when(block != "", block), ANSWER)
    text = lambda x, default, n: F.substring(F.coalesce(x, F.lit(default)), 1, n)
    return F.transform(
        parsed["insights"],
        lambda i: F.struct(
            text(i["title"], "", 120).alias("title"),
            text(i["body"], "", 600).alias("body"),
            text(i["category"], "AI Insight", 60).alias("category"),
            F.when(i["severity"].isin("info", "notice", "warning"), i["severity"]).otherwise("info").alias("severity"),
        ),
    )


def status(raw: Column) -> Column:
    return F.when(raw.isNull(), "error").when(validate(raw).isNull(), "error").otherwise("ready")


def ask(requests: DataFrame, provider: Callable[[str], str] | None) -> DataFrame:
    """``doc_id, raw, error``: a provider's answers; without one every row is refused. Failures become errors."""
    if provider is None:
        return requests.select("doc_id", F.lit(None).cast("string").alias("raw"), F.lit("no provider configured").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, payload in zip(b["doc_id"], b["payload"], strict=True):
                try:
                    json.loads(payload)
                    out.append((doc_id, provider(payload), None))
                except Exception as e:  # noqa: BLE001  a provider may fail in any way; the job goes on
                    out.append((doc_id, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "raw", "error"])

    return requests.select("doc_id", "payload").mapInPandas(run, "doc_id long, raw string, error string")
