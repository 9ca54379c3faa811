"""External metrics: the JSON answers of lab, search and analytics providers as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(result: Column) -> Column:
    """The JSON of an answer; one that is a JSON text holding JSON is read once more."""
    return F.when(F.ltrim(result).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), result, F.lit("}")), "$.v")).otherwise(result)


def lab(observations: DataFrame) -> DataFrame:
    """``observation_id, requested_url, strategy, kind, name, value``: one row per score and per metric.

    ``observations`` has ``observation_id, result``. Answers that are null or no JSON give no rows; a value that is
    no number is null.
    """
    answer = F.from_json(_plain(F.col("result")), "requested_url string, strategy string, scores map<string, string>, metrics map<string, string>")
    parsed = observations.select("observation_id", answer.alias("a")).select("observation_id", "a.*")
    every = [parsed.select("observation_id", "requested_url", "strategy", F.lit(kind).alias("kind"), F.explode(field).alias("name", "value")) for kind, field in (("score", "scores"), ("metric", "metrics"))]
    return every[0].unionByName(every[1]).withColumn("value", F.col("value").try_cast("double"))


def search(observations: DataFrame) -> DataFrame:
    """``observation_id, position, search_text, page, clicks, impressions, ctr, rank``: one row per listed row."""
    answer = F.from_json(_plain(F.col("result")), "rows array<struct<keys: array<string>, clicks: string, impressions: string, ctr: string, position: string>>")
    rows = observations.select("observation_id", F.posexplode(answer["rows"]).alias("position", "r"))
    number = lambda name: F.col(f"r.{name}").try_cast("double")
    return rows.select(
        "observation_id", "position", F.get("r.keys", F.lit(0)).alias("search_text"), F.get("r.keys", F.lit(1)).alias("page"),
        number("clicks").alias("clicks"), number("impressions").alias("impressions"), number("ctr").alias("ctr"), number("position").alias("rank"),
    )


def analytics(observations: DataFrame) -> DataFrame:
    """``observation_id, property_id, position, name, value``: rows of dimensions and metrics in long form."""
    answer = F.from_json(_plain(F.col("result")), "property_id string, rows array<map<string, string>>")
    rows = observations.select("observation_id", answer["property_id"].alias("property_id"), F.posexplode(answer["rows"]).alias("position", "r"))
    return rows.select("observation_id", "property_id", "position", F.explode("r").alias("name", "value"))
