"""Job parameters (CFG-1).

Defaults equal the reference job's properties; each can be overridden by an
explicitly named environment variable.  A bad integer falls back to the
default instead of failing the job.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

# Defaults of the reference job.
DEFAULTS = {
    "kafka_bootstrap_servers": "localhost:9092",
    "raw_clicks_topic": "raw-clicks",
    "late_clicks_topic": "late-clicks",
    "window_minutes": 1,
    "watermark_seconds": 10,
    "allowed_lateness_seconds": 30,
    "idle_partition_minutes": 5,
    "trigger_seconds": 5,
    "dedup_ttl_hours": 24,
    "dedup_lateness_hours": 24,
    "hll_precision": 14,
    "retention_years": 2,
    "max_offsets_per_trigger": 1_000_000,
    "jdbc_batch_size": 500,
    "jdbc_url": "",
    "jdbc_table": "clicks_1min",
    "jdbc_user": "",
    "jdbc_password": "",
    "jdbc_driver": "",
}

ENV_NAMES = {
    "kafka_bootstrap_servers": "CLICKWISE_KAFKA_BOOTSTRAP_SERVERS",
    "raw_clicks_topic": "CLICKWISE_RAW_CLICKS_TOPIC",
    "late_clicks_topic": "CLICKWISE_LATE_CLICKS_TOPIC",
    "window_minutes": "CLICKWISE_WINDOW_MINUTES",
    "watermark_seconds": "CLICKWISE_WATERMARK_SECONDS",
    "allowed_lateness_seconds": "CLICKWISE_ALLOWED_LATENESS_SECONDS",
    "idle_partition_minutes": "CLICKWISE_IDLE_PARTITION_MINUTES",
    "trigger_seconds": "CLICKWISE_TRIGGER_SECONDS",
    "dedup_ttl_hours": "CLICKWISE_DEDUP_TTL_HOURS",
    "dedup_lateness_hours": "CLICKWISE_DEDUP_LATENESS_HOURS",
    "hll_precision": "CLICKWISE_HLL_PRECISION",
    "retention_years": "CLICKWISE_RETENTION_YEARS",
    "max_offsets_per_trigger": "CLICKWISE_MAX_OFFSETS_PER_TRIGGER",
    "jdbc_batch_size": "CLICKWISE_JDBC_BATCH_SIZE",
    "jdbc_url": "CLICKWISE_JDBC_URL",
    "jdbc_table": "CLICKWISE_JDBC_TABLE",
    "jdbc_user": "CLICKWISE_JDBC_USER",
    "jdbc_password": "CLICKWISE_JDBC_PASSWORD",
    "jdbc_driver": "CLICKWISE_JDBC_DRIVER",
}


@dataclass(frozen=True)
class JobConfig:
    kafka_bootstrap_servers: str = DEFAULTS["kafka_bootstrap_servers"]
    raw_clicks_topic: str = DEFAULTS["raw_clicks_topic"]
    late_clicks_topic: str = DEFAULTS["late_clicks_topic"]
    window_minutes: int = DEFAULTS["window_minutes"]
    watermark_seconds: int = DEFAULTS["watermark_seconds"]
    allowed_lateness_seconds: int = DEFAULTS["allowed_lateness_seconds"]
    idle_partition_minutes: int = DEFAULTS["idle_partition_minutes"]
    trigger_seconds: int = DEFAULTS["trigger_seconds"]
    dedup_ttl_hours: int = DEFAULTS["dedup_ttl_hours"]
    # How far the intake's watermark trails its newest request (no property of the reference).
    dedup_lateness_hours: int = DEFAULTS["dedup_lateness_hours"]
    hll_precision: int = DEFAULTS["hll_precision"]
    retention_years: int = DEFAULTS["retention_years"]
    max_offsets_per_trigger: int = DEFAULTS["max_offsets_per_trigger"]
    jdbc_batch_size: int = DEFAULTS["jdbc_batch_size"]
    jdbc_url: str = DEFAULTS["jdbc_url"]
    jdbc_table: str = DEFAULTS["jdbc_table"]
    jdbc_user: str = DEFAULTS["jdbc_user"]
    jdbc_password: str = field(default=DEFAULTS["jdbc_password"], repr=False)
    jdbc_driver: str = DEFAULTS["jdbc_driver"]
    extra: dict = field(default_factory=dict)

    @property
    def window(self) -> str:
        return f"{self.window_minutes} minutes"

    @property
    def jdbc(self) -> dict | None:
        """Arguments of ``write_jdbc``, when a database is configured."""
        if not self.jdbc_url:
            return None
        props = {"user": self.jdbc_user, "password": self.jdbc_password, "driver": self.jdbc_driver}
        return {"url": self.jdbc_url, "table": self.jdbc_table, "batch_size": self.jdbc_batch_size,
                "properties": {k: v for k, v in props.items() if v}}

    @property
    def watermark(self) -> str:
        return f"{self.watermark_seconds} seconds"

    def with_(self, **kw) -> "JobConfig":
        return replace(self, **kw)

    @classmethod
    def load(cls, env: dict | None = None) -> "JobConfig":
        env = os.environ if env is None else env
        values = {}
        for name, default in DEFAULTS.items():
            raw = env.get(ENV_NAMES[name])
            if raw is None:
                continue
            if isinstance(default, int):
                try:
                    values[name] = int(raw.strip())
                except ValueError:
                    continue  # invalid integer: keep the default
            else:
                values[name] = raw
        return cls(**values)
