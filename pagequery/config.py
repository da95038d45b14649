"""Settings of the engine: one immutable value, from a mapping or from ``spark.pagequery.*``."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession

from pagequery.errors import ConfigError

PREFIX = "spark.pagequery."


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of fetching, crawling, learning and state; ``extra`` holds settings that the engine does not know."""

    per_second: float = 2.0
    global_per_second: float = 0.0
    jitter: float = 0.0
    honor_robots: bool = True
    timeout_seconds: float = 30.0
    page_ttl_seconds: int = 1800
    page_max_bytes: int = 10_000_000
    crawl_max_pages: int = 100
    crawl_max_depth: int = 2
    crawl_max_pending: int = 5000
    follow_max_pages: int = 20
    learn_attempts: int = 2
    hydration_max_chars: int = 500_000
    state_folder: str = ""
    log_level: str = "WARNING"
    extra: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("per_second", "global_per_second", "jitter", "timeout_seconds"):
            if getattr(self, name) < 0:
                raise ConfigError("a setting is negative", key=name, value=getattr(self, name))
        if self.crawl_max_pages < 1 or self.learn_attempts < 1:
            raise ConfigError("a limit is below one", crawl_max_pages=self.crawl_max_pages, learn_attempts=self.learn_attempts)


def _typed(name: str, value, kind: str):
    if kind == "str" or not isinstance(value, str):
        return value
    text = value.strip()
    try:
        if kind == "bool":
            return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[text.lower()]
        return {"int": int, "float": float}[kind](text)
    except (KeyError, ValueError) as e:
        raise ConfigError("a setting has a bad value", key=name, value=value) from e


def configured(values: Mapping[str, object], base: EngineConfig | None = None, strict: bool = False) -> EngineConfig:
    """``base`` with the given settings. Unknown names go to ``extra``; with ``strict`` they raise."""
    base = base or EngineConfig()
    kinds = {f.name: f.type for f in fields(EngineConfig) if f.name != "extra"}
    unknown = {k: v for k, v in values.items() if k not in kinds}
    if unknown and strict:
        raise ConfigError("unknown settings", keys=sorted(unknown))
    known = {k: _typed(k, v, kinds[k]) for k, v in values.items() if k in kinds}
    return replace(base, **known, extra={**base.extra, **{k: str(v) for k, v in unknown.items()}})


def from_session(spark: SparkSession, strict: bool = False) -> EngineConfig:
    """Settings of the session whose names begin with ``spark.pagequery.``."""
    held = {k[len(PREFIX) :]: v for k, v in spark.conf.getAll.items() if k.startswith(PREFIX)}
    return configured(held, strict=strict)


def configure_logging(config: EngineConfig) -> logging.Logger:
    """The engine's logger, a line of key=value pairs for each event; calling it again changes only the level."""
    logger = logging.getLogger("pagequery")
    level = logging.getLevelName(config.log_level.upper())
    if not isinstance(level, int):
        raise ConfigError("unknown log level", key="log_level", value=config.log_level)
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s level=%(levelname)s event=%(message)s"))
        logger.addHandler(handler)
    logger.setLevel(level)
    return logger
