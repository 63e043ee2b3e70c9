"""Q1: request log -> enriched, anonymised, de-duplicated click events.

DED-1 / FLT-1 keep a state of their own per click id: the event time at which the
id's current period began.  The first sight of an id passes and opens a period of
``dedup_ttl_hours``; a sight inside it is a duplicate and does not prolong it; the
first one at or after its end passes and opens the next, whatever the watermark.

The watermark trails the newest request by ``dedup_lateness_hours``.  Older requests
are dropped and counted (``too_old``); a period's state goes once the watermark
passes its end, so the state holds the ids of the period and the lateness.  Inside
a micro-batch an id's sights are taken in event-time order; across batches an older
sight that comes after a newer one falls into the newer one's period.

It is a query of its own (a query holds one watermark; the window aggregate needs
10 s).  The only shuffle is the one on ``click_id``.  Built-in streaming dedup cannot
tell the period from the watermark's delay, hence the keyed state (Arrow batches).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clickwise.config import JobConfig
from clickwise.operators import enrich
from clickwise.sinks.messages import event_messages

HOUR_MS = 3_600_000


def openings(times: np.ndarray, start: int | None, ttl_ms: int) -> tuple[np.ndarray, int | None]:
    """Which of an id's sights (event times in order) pass, and the start of the last period;
    ``start``: that of the period open before them."""
    out, at = np.zeros(len(times), bool), 0
    while True:
        # The next sight that the period does not hold; all between are duplicates.
        at = at if start is None else int(np.searchsorted(times, start + ttl_ms))
        if at >= len(times):
            return out, start
        out[at], start = True, int(times[at])


def _first_sights(ttl_ms: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start = int(state.get[0]) if state.exists else None
        rows = pd.concat(list(parts)).sort_values("timestamp_ms", kind="stable")
        passed, start = openings(rows["timestamp_ms"].to_numpy(), start, ttl_ms)
        if start + ttl_ms > state.getCurrentWatermarkMs():
            state.update((start,))
            state.setTimeoutTimestamp(start + ttl_ms)
        elif state.exists:
            state.remove()
        if passed.any():
            yield rows[passed]
    return run


def first_sights(events: DataFrame, cfg: JobConfig = JobConfig()) -> DataFrame:
    """The events of a stream that pass the dedup, all columns."""
    out = events.schema
    timed = events.withColumn("event_time", F.timestamp_millis("timestamp_ms")).withWatermark("event_time", f"{cfg.dedup_lateness_hours} hours")
    passed = timed.groupBy("click_id").applyInPandasWithState(
        _first_sights(cfg.dedup_ttl_hours * HOUR_MS), timed.schema, "start_ms long", "append", GroupStateTimeout.EventTimeTimeout)
    return passed.select(*out.fieldNames())


def ingest_stream(requests: DataFrame, cfg: JobConfig = JobConfig(),
                  country: enrich.Step = enrich.stub_country) -> DataFrame:
    events = enrich.ingest(requests, country)
    # FLT-4 counters: surfaced in StreamingQuery.lastProgress["observedMetrics"].
    events = events.observe("intake", F.count(F.lit(1)).alias("requests"))
    return first_sights(events, cfg).observe("published", F.count(F.lit(1)).alias("published"))


def intake_counts(progress) -> dict[str, int]:
    """FLT-4 over a query's progress reports: requests, published, too_old (older
    than the watermark, dropped) and duplicates (the rest)."""
    def seen(p, name, field):
        row = (p["observedMetrics"] or {}).get(name)
        return (row[field] if row else 0) or 0
    requests = sum(seen(p, "intake", "requests") for p in progress)
    published = sum(seen(p, "published", "published") for p in progress)
    too_old = sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"] or [])
    return {"requests": requests, "published": published, "too_old": too_old, "duplicates": requests - published - too_old}


def start_ingest(requests: DataFrame, out_path: str | None, checkpoint: str, cfg: JobConfig = JobConfig(),
                 trigger: dict | None = None, country: enrich.Step = enrich.stub_country,
                 kafka_servers: str | None = None, use_avro: bool = False):
    """Append the events as parquet (exactly-once file sink via the checkpoint),
    or — with ``kafka_servers`` — to the raw-click topic keyed by ad id so one
    ad stays in one partition (SNK-4, at-least-once)."""
    events = ingest_stream(requests, cfg, country)
    if kafka_servers:
        w = (event_messages(events, use_avro=use_avro).writeStream.format("kafka")
             .option("kafka.bootstrap.servers", kafka_servers).option("topic", cfg.raw_clicks_topic)
             .option("checkpointLocation", checkpoint).outputMode("append"))
    else:
        w = (events.writeStream.format("parquet").option("path", out_path)
             .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(**(trigger or {"processingTime": f"{cfg.trigger_seconds} seconds"}))
    return w.start()
