"""Choice of chat models, and batched calls to a pluggable backend."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def preferred(available: DataFrame, preferences: list[str], avoid: list[str] | None = None) -> DataFrame:
    """(case_id, name): the model to use for each catalogue (case_id, pos, name).

    By rank of preference: the very name, else the first in server order that starts
    with the preference's family. Where none fits: the first whose name has none of
    avoid, if given, else the first; catalogues without any such model give no row.
    """
    spark = available.sparkSession
    wanted = spark.createDataFrame([(i, n, n.split(":")[0]) for i, n in enumerate(preferences)], "rank int, wanted string, family string")
    # a short fixed list against catalogues of a few names each
    fits = available.join(F.broadcast(wanted), F.col("name").startswith(F.col("family")))
    best = fits.groupBy("case_id").agg(F.min_by("name", F.struct("rank", (F.col("name") != F.col("wanted")).cast("int"), "pos")).alias("best"))
    usable = available
    for part in avoid or []:
        usable = usable.filter(~F.contains(F.lower("name"), F.lit(part)))
    last = usable.groupBy("case_id").agg(F.min_by("name", "pos").alias("last"))
    return best.join(last, "case_id", "full").select("case_id", F.coalesce("best", "last").alias("name")).filter("name IS NOT NULL")


def chat(prompts: DataFrame, backend: Callable[[list[str], dict], list[str | None]], options: dict) -> DataFrame:
    """(q_id, answer): a backend's answers to (q_id, prompt), batch by batch; a failed batch gives nulls, never a failure."""

    def run(batches):
        for batch in batches:
            try:
                said = backend(batch["prompt"].tolist(), options)
            except Exception:  # a model that is away degrades the answers, as defined
                said = [None] * len(batch)
            yield pd.DataFrame({"q_id": batch["q_id"], "answer": said})

    return prompts.select("q_id", "prompt").mapInPandas(run, "q_id long, answer string")


def http_backend(url: str, model: str, timeout: float = 120.0):
    """A backend that posts each prompt to a chat endpoint; for use where there is one."""

    def call(prompts: list[str], options: dict) -> list[str | None]:
        import json
        from urllib.request import Request, urlopen

        out: list[str | None] = []
        for prompt in prompts:
            body = {"model": model, "stream": False, "options": options, "messages": [{"role": "user", "content": prompt}]}
            request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
            try:
                with urlopen(request, timeout=timeout) as reply:
                    out.append(json.load(reply)["message"]["content"])
            except (OSError, ValueError, KeyError):
                out.append(None)
        return out

    return call


def token_rate(chunks: DataFrame) -> DataFrame:
    """(model, tokens, seconds, tokens_per_s) of (model, ts, text): white-space words over the time from first to last chunk."""
    from lorequery.functions.text import words

    seconds = (F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")).alias("seconds")
    rate = chunks.groupBy("model").agg(F.sum(F.size(words(F.col("text")))).alias("tokens"), seconds)
    return rate.withColumn("tokens_per_s", F.try_divide("tokens", "seconds"))
