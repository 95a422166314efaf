"""Alerts joined to captured responses: interval join, ranking, and what the evidence is worth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to the distance in time (seconds) of a response whose length does not fit.
PENALTY = 3600.0


def orphan_bytes_fit(expected: Column, length: Column) -> Column:
    """Whether a response without a request may be the one expected, by length; unknown lengths fit."""
    expected, length = F.coalesce(expected, F.lit(0)), F.coalesce(length, F.lit(0))
    known = (expected > 0) & (length > 0)
    return ~known | (F.abs(expected - length) <= F.greatest(F.floor(expected / 10), F.lit(256)))


def catch_all_bytes_fit(a: Column, verified: Column) -> Column:
    """Whether two lengths are those of one catch-all page."""
    return (a > 0) & (verified > 0) & (F.abs(a - verified) <= F.greatest(F.floor(verified * 15 / 100), F.lit(256)))


#: Upper bounds of the classes of lengths by which responses without a request are looked up; each is an eighth above the one before.
_CLASSES = [int(256 * 1.125**i) for i in range(110)]


def _class(length: Column) -> Column:
    """The class of a length; lengths of one class differ by little, and a class beyond the last bound holds the rest."""
    steps = F.floor(F.log(F.greatest(length.cast("double"), F.lit(256.0)) / 256.0) / float(np.log(1.125)))
    return F.least(steps, F.lit(len(_CLASSES))).cast("int")


def candidates(alerts: DataFrame, responses: DataFrame, window: int) -> DataFrame:
    """All pairs, for those who want to see each (``sweep.best`` finds the best ones without writing pairs), of ``alerts`` (event_id, ts, method, path, host, user_agent, status, bytes) and ``responses`` (resp_seq, resp_ts, resp_method, resp_path, resp_host, resp_agent, resp_status, content_length, content_type, body_hash, ...) that may belong together.

    Times are at most ``window`` seconds apart. A response with a request has the alert's method and path, one
    without fits by length. An alert's status, if it is known, is the response's; hosts are equal if both are
    known. Columns that a table lacks are unknown.

    Time is cut into bins of the window's length and a response is listed in its own and both neighbouring bins,
    so all joins are on equal bins. Responses with a request join on the request. Those without join on status,
    host and class of length where the alert knows all three; alerts that lack one of them join on the bin alone.
    """
    alerts, responses = _filled(alerts, ["host", "user_agent"]), _filled(responses, ["resp_host", "resp_agent", "content_type"])
    second = lambda c: F.col(c).cast("double")
    bins = F.array(*[F.floor(second("resp_ts") / window) + i for i in (-1, 0, 1)])
    listed = responses.withColumn("_bin", F.explode(bins))
    mine = alerts.withColumn("_bin", F.floor(second("ts") / window))
    asked = F.coalesce("resp_method", F.lit("")) != ""
    near = F.abs(second("ts") - second("resp_ts")) <= window
    state = ~(F.coalesce("status", F.lit(0)) > 0) | F.col("status").eqNullSafe(F.col("resp_status"))
    host = (F.col("host") == "") | (F.col("resp_host") == "") | (F.col("host") == F.col("resp_host"))
    requests = listed.where(asked).withColumns({"method": F.col("resp_method"), "path": F.col("resp_path")})
    paired = mine.join(requests, ["_bin", "method", "path"]).drop("_bin")
    lone = listed.where(~asked).withColumn("_class", F.when(F.col("content_length") > 0, _class(F.col("content_length"))).otherwise(-1))
    known = (F.coalesce("status", F.lit(0)) > 0) & (F.coalesce("bytes", F.lit(0)) > 0) & (F.col("host") != "")
    slack = F.greatest(F.floor(F.col("bytes") / 10), F.lit(256))
    classes = F.concat(F.array(F.lit(-1)), F.sequence(_class(F.col("bytes") - slack), _class(F.col("bytes") + slack)))
    sharp = mine.where(known).withColumn("_host", F.explode(F.array("host", F.lit("")))).withColumn("_class", F.explode(classes)).withColumn("_status", F.col("status"))
    sharp = sharp.join(lone.withColumns({"_host": F.col("resp_host"), "_status": F.col("resp_status")}), ["_bin", "_host", "_status", "_class"]).drop("_bin", "_host", "_status", "_class")
    blunt = mine.where(~known).join(lone, "_bin").drop("_bin", "_class")
    loose = sharp.unionByName(blunt).where(orphan_bytes_fit(F.col("bytes"), F.col("content_length")))
    return paired.unionByName(loose).where(near & state & host)


def _filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit("")) if c in df.columns else F.lit("") for c in columns})


def best(pairs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The best response of each alert: nearest in time, after a penalty for a length that does not fit; of equal ones one with the alert's user agent, then the latest.

    ``candidates`` counts its rivals; ``confidence`` is HIGH where there is one, or all of them are one body of
    one length and type, else LOW. ``keep`` names more columns of the response to carry along.
    """
    expected, length = F.col("bytes"), F.col("content_length")
    off = (expected > 0) & (length > 0) & (F.abs(expected - length) > F.greatest(F.floor(expected / 5), F.lit(2048)))
    score = F.abs(F.col("ts").cast("double") - F.col("resp_ts").cast("double")) + F.when(off, PENALTY).otherwise(0.0)
    other = ~((F.col("user_agent") != "") & (F.col("user_agent") == F.col("resp_agent")))
    taken = dict.fromkeys(["resp_seq", "content_length", "body_hash", *(keep or [])])
    row = F.struct(*[F.col(c) for c in taken])
    rank = F.struct(score.alias("score"), other.alias("other"), (-F.col("resp_seq")).alias("late"))
    bodies = F.struct("body_hash", "content_length", "content_type")
    out = pairs.groupBy("event_id").agg(F.min_by(row, rank).alias("b"), F.min(rank).alias("r"), F.count("*").alias("candidates"), (F.min(bodies) == F.max(bodies)).alias("_clones"))
    high = (F.col("candidates") == 1) | (F.col("_clones") & (F.coalesce("b.body_hash", F.lit("")) != ""))
    return out.select("event_id", "b.resp_seq", "r.score", "b.content_length", "b.body_hash", *[f"b.{c}" for c in keep or []], "candidates", F.when(high, "HIGH").otherwise("LOW").alias("confidence"))


def pair_in_flow(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """First-in first-out pairs of a flow: the nth response takes the nth request, where that came before it. Columns: flow, seq."""
    nth = Window.partitionBy("flow").orderBy("seq")
    q = requests.withColumn("n", F.row_number().over(nth)).select("flow", "n", F.col("seq").alias("request_seq"))
    r = responses.withColumn("n", F.row_number().over(nth)).select("flow", "n", F.col("seq").alias("response_seq"))
    return r.join(q, ["flow", "n"], "left").select("flow", "response_seq", F.when(F.col("request_seq") < F.col("response_seq"), F.col("request_seq")).alias("request_seq"))


def capture_changes(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """What to do so that ``actual`` (id, pid) becomes ``desired``: open, close, repair (another pid) or keep, for each id."""
    both = desired.select("id", F.col("pid").alias("want")).join(actual.select("id", F.col("pid").alias("have")), "id", "full_outer")
    action = F.when(F.col("have").isNull(), "open").when(F.col("want").isNull(), "close").when(F.col("want") != F.col("have"), "repair").otherwise("keep")
    return both.select("id", action.alias("action"))
