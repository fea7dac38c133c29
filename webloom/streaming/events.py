"""Browser event streams: request states, sessions of network activity, stages.

Events: request_id, seq, ts, kind (sent, redirect, response, finished, failed, ws_created,
ws_handshake), url, method, resource_type, status_code, mime_type, redirect_to. The batch
form uses windows over request_id; the streaming form keeps the same state by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

API_TYPES = ("xhr", "fetch", "eventsource")
QUIET_MS, EXPIRY_S = 750, 5
#: Shares of the time budget at which phases end.
CUTOFFS = (("navigate", 0.50), ("scroll", 0.70), ("click", 0.95), ("settle", 1.00))


def captured(events: DataFrame) -> DataFrame:
    """Only requests that can be API calls are followed."""
    return events.where(F.lower("resource_type").isin(*API_TYPES))


def hops(events: DataFrame) -> DataFrame:
    """Events with the hop they belong to: redirects before or at them, per request."""
    order = Window.partitionBy("request_id").orderBy("seq")
    return events.withColumn("hop", F.sum((F.col("kind") == "redirect").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def requests(events: DataFrame) -> DataFrame:
    """One row for each hop of a request: first url and method, last status, whether it completed or failed, where it was redirected."""
    lane = events.where(F.col("kind").isin("sent", "redirect", "response", "finished", "failed"))
    each = hops(lane)
    last = lambda c: F.max_by(F.when(F.col("kind") == "response", F.col(c)), F.when(F.col("kind") == "response", F.col("seq")))
    rows = each.groupBy("request_id", "hop").agg(
        F.min("seq").alias("seq"), F.coalesce(last("url"), F.min_by("url", "seq")).alias("url"), F.min_by("method", "seq").alias("method"), F.min_by("resource_type", "seq").alias("resource_type"),
        F.coalesce(last("status_code"), F.lit(0)).cast("long").alias("status_code"), F.coalesce(last("mime_type"), F.lit("")).alias("mime_type"),
        F.bool_or(F.col("kind").isin("finished", "failed")).alias("ended"), F.bool_or(F.col("kind") == "failed").alias("failed"), F.bool_or(F.col("kind").isin("sent", "redirect")).alias("begun"),
    )
    order = Window.partitionBy("request_id").orderBy("hop")
    out = rows.where("begun").withColumns({"redirect_to": F.coalesce(F.lead("url").over(order), F.lit("")), "redirect_from": F.coalesce(F.lag("url").over(order), F.lit(""))})
    return out.select("request_id", F.col("hop").alias("redirect_index"), "seq", "url", "method", "resource_type", "status_code", "mime_type", (F.col("ended") | (F.col("redirect_to") != "")).alias("completed"), "failed", "redirect_from", "redirect_to")


def with_late_bodies(found: DataFrame, bodies: DataFrame) -> DataFrame:
    """Bodies that came late go to the last hop of their (request_id, url), unless a newer hop took the id."""
    latest = F.max("redirect_index").over(Window.partitionBy("request_id"))
    own = bodies.groupBy("request_id", "url").agg(F.max_by("body", "seq").alias("body"))
    rows = found.withColumn("_last", latest == F.col("redirect_index")).join(own, ["request_id", "url"], "left")
    return rows.withColumn("body", F.when(F.col("_last"), F.col("body"))).drop("_last")


def websockets(events: DataFrame) -> DataFrame:
    """Sockets and whether their handshake failed: any status but 101."""
    rows = events.where(F.col("kind").isin("ws_created", "ws_handshake"))
    return rows.groupBy("request_id").agg(F.min_by("url", "seq").alias("url"), F.coalesce(F.bool_or((F.col("kind") == "ws_handshake") & (F.col("status_code") != 101)), F.lit(False)).alias("failed"))


def sessions(events: DataFrame, gap: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Spans of activity without a quiet gap (T4); ``ts`` may be either timestamp type."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return rows.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")


def idle_points(events: DataFrame, key: str) -> DataFrame:
    """Ends of activity after which nothing is in flight and the quiet time passes (T4).

    A request counts as in flight from its start for at most ``EXPIRY_S`` seconds; columns
    key, ts, kind (start or end of a request). Event sources should be left out before.
    """
    start = events.where(F.col("kind") == "start")
    expiry = start.select(key, "request_id", (F.col("ts").cast("timestamp") + F.expr(f"INTERVAL {EXPIRY_S} SECONDS")).alias("ts"), F.lit("expiry").alias("kind"))
    ends = events.where(F.col("kind") == "end").select(key, "request_id", F.col("ts").cast("timestamp").alias("ts"), F.lit("end").alias("kind"))
    closing = ends.unionByName(expiry).groupBy(key, "request_id").agg(F.min("ts").alias("ts")).withColumn("step", F.lit(-1))
    both = start.select(key, "request_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("step")).unionByName(closing)
    order = Window.partitionBy(key).orderBy("ts", "step", "request_id")
    rows = both.withColumns({"open": F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("ts").over(order)})
    quiet = (F.col("next").isNull()) | (F.unix_millis("next") - F.unix_millis("ts") >= QUIET_MS)
    return rows.where((F.col("open") == 0) & quiet).select(key, F.col("ts").alias("idle_from"))


def staged(events: DataFrame, key: str) -> DataFrame:
    """Each event with the stage set last before it (T5)."""
    order = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("stage", F.coalesce(F.last(F.when(F.col("kind") == "stage", F.col("stage_name")), ignorenulls=True).over(order), F.lit("navigate")))


def phase(elapsed: Column, budget: Column) -> Column:
    """Phase by the share of the budget that has passed."""
    out = None
    for name, share in CUTOFFS:
        test = elapsed < budget * share
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("over")


def readable_bodies(responses: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """Responses whose body may be read: XHR or fetch, text-like, within the limit, not failed."""
    mime = F.lower("mime_type")
    text = mime.startswith("text/") | mime.contains("json") | mime.contains("javascript") | mime.contains("xml")
    return responses.where(F.lower("resource_type").isin("xhr", "fetch") & text & (F.col("encoded_length") <= limit) & ~F.col("failed"))


def initiator_urls(stacks: Column) -> Column:
    """Ordered distinct URLs of nested call stacks."""
    return F.filter(F.array_distinct(F.flatten(stacks)), lambda u: u != "")


# ---------------------------------------------------------------- streaming form

_STATE = "hop int, seq long, url string, method string, resource_type string, status_code long, mime_type string, redirect_from string"
_OUT = "request_id string, redirect_index int, seq long, url string, method string, resource_type string, status_code long, mime_type string, completed boolean, failed boolean, redirect_from string, redirect_to string"


def streamed_requests(events: DataFrame, timeout_ms: int = 0) -> DataFrame:
    """``requests`` as a stream: a hop is emitted when it is redirected, ends, or, with ``timeout_ms``, times out.

    One small state row per open request; a closed one drops its state.
    """

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        own = list(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append(_row(key[0], own, False, False, ""))
            own = None
        else:
            for rows in batches:
                for e in rows.sort_values("seq").itertuples(index=False):
                    if e.kind == "redirect" and own:
                        out.append(_row(key[0], own, True, False, e.url))
                        own = [own[0] + 1, e.seq, e.url, e.method, e.resource_type, 0, "", own[2]]
                    elif e.kind in ("sent", "redirect"):
                        own = [0, e.seq, e.url, e.method, e.resource_type, 0, "", ""]
                    elif own and e.kind == "response":
                        own[2], own[5], own[6] = e.url, int(e.status_code or 0), e.mime_type or ""
                    elif own and e.kind in ("finished", "failed"):
                        out.append(_row(key[0], own, True, e.kind == "failed", ""))
                        own = None
        if own:
            state.update(tuple(own))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return events.groupBy("request_id").applyInPandasWithState(run, _OUT, _STATE, "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")


def _row(request: str, own: list, completed: bool, failed: bool, target: str) -> tuple:
    hop, seq, url, method, kind, status, mime, origin = own
    return (request, hop, seq, url, method, kind, status, mime, completed, failed, origin, target)


_OPEN = "requests string, idle_from long"


def streamed_idle(events: DataFrame, key: str) -> DataFrame:
    """``idle_points`` as a stream: (key, idle_from) once nothing was in flight for the quiet time.

    ``events``: key, ts (a timestamp with watermark), kind (start or end of a request), request_id. The state
    of a key holds its open requests and since when none is; a timer of the event time ends the quiet time
    or lets the request that expires next go. Late events beyond the watermark are not seen.
    """

    def told(group: tuple, since: int) -> tuple:
        return (*group, pd.Timestamp(since, unit="ms"))

    def run(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        raw, since = state.get if state.exists else ("{}", -1)
        open_: dict[str, int] = json.loads(raw)
        out: list[tuple] = []

        def until(now: int) -> None:
            """What happens up to ``now`` without an event: requests expire, quiet times pass."""
            nonlocal since
            for request, begun in sorted(open_.items(), key=lambda x: (x[1], x[0])):
                if begun + 1000 * EXPIRY_S <= now:
                    del open_[request]
                    since = begun + 1000 * EXPIRY_S if not open_ else -1
            if since >= 0 and now - since >= QUIET_MS:
                out.append(told(group, since))
                since = -1

        rows = pd.concat(list(batches)) if not state.hasTimedOut else None
        if rows is None:
            until(state.getCurrentWatermarkMs())
        else:
            rows = rows.assign(ms=rows["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000, end=rows["kind"] == "start")
            for e in rows.sort_values(["ms", "end", "request_id"]).itertuples(index=False):
                until(int(e.ms))
                if e.kind == "start":
                    open_[e.request_id], since = int(e.ms), -1
                elif e.kind == "end" and open_.pop(e.request_id, None) is not None and not open_:
                    since = int(e.ms)
        if open_ or since >= 0:
            state.update((json.dumps(open_), since))
            due = min(open_.values()) + 1000 * EXPIRY_S if open_ else since + QUIET_MS
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "idle_from"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, idle_from timestamp", _OPEN, "append", "EventTimeTimeout")


def streamed_late_bodies(found: DataFrame, bodies: DataFrame, within: str) -> DataFrame:
    """``with_late_bodies`` of two streams (T2): a body goes to its (request_id, url) if it comes ``within`` after
    the hop ended. ``found``: request_id, url, ts, newest (no newer hop took the id); ``bodies``: request_id, url, ts, body.
    Both need a watermark; state older than the interval is dropped."""
    late = bodies.select(F.col("request_id").alias("b_request"), F.col("url").alias("b_url"), F.col("ts").alias("b_ts"), "body")
    met = (F.col("request_id") == F.col("b_request")) & (F.col("url") == F.col("b_url")) & F.col("newest") & (F.col("b_ts") >= F.col("ts")) & (F.col("b_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return found.join(late, met, "leftOuter").drop("b_request", "b_url")


def streamed_sessions(events: DataFrame, gap: str, lateness: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``sessions`` of a stream with a watermark; ``ts`` is cast, since watermarks need a time zone."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    rows = timed.groupBy(*keys, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return rows.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_events")
