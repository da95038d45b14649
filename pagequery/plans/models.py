"""Models as functions: names, failures and second tries, checked answers, and counts of what was asked."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession

from pagequery.errors import ConfigError, ModelAuthError, ModelError
from pagequery.functions.loose import first_object
from pagequery.plans.learn import ModelClient

#: Makers of clients by provider: from a model's name to a function of (instruction, view). None are shipped; callers register theirs.
PROVIDERS: dict[str, Callable[[str], ModelClient]] = {}


def register_provider(name: str, make: Callable[[str], ModelClient]) -> None:
    PROVIDERS[name.strip().lower()] = make


def parse_model(uri: str) -> tuple[str, str]:
    """Provider and model of ``provider/model``; the model may hold slashes."""
    provider, slash, model = (uri or "").partition("/")
    provider, model = provider.strip().lower(), model.strip()
    if not slash or not provider or not model:
        raise ConfigError("a model is named provider/model", key="model", value=uri)
    return provider, model


def client_for(uri: str) -> ModelClient:
    """The client of a registered provider, with second tries."""
    provider, model = parse_model(uri)
    if provider not in PROVIDERS:
        raise ConfigError("no such provider is registered", key="provider", value=provider)
    return with_retries(PROVIDERS[provider](model), model=uri)


def _status(error: BaseException) -> int | None:
    return next((s for s in (getattr(error, "status_code", None), getattr(getattr(error, "response", None), "status_code", None), getattr(error, "code", None)) if isinstance(s, int)), None)


def failure(error: BaseException) -> str:
    """Kind of a failure, by type and status: "auth", "limit", "timeout" or "other"."""
    name, status = type(error).__name__.lower().replace("_", ""), _status(error)
    if status in (401, 403) or any(w in name for w in ("authentication", "unauthorized", "apikey")):
        return "auth"
    if status == 429 or any(w in name for w in ("ratelimit", "toomanyrequests")):
        return "limit"
    return "timeout" if isinstance(error, TimeoutError) or "timeout" in name else "other"


@dataclass(frozen=True)
class Retry:
    """Attempts, and the wait between them: doubled from ``base`` to ``most`` seconds, more or less by the share ``jitter``."""

    attempts: int = 3
    base: float = 0.5
    most: float = 8.0
    jitter: float = 0.2

    def wait(self, attempt: int) -> float:
        return min(self.most, self.base * 2 ** (attempt - 1)) * (1 + random.uniform(-self.jitter, self.jitter))


def with_retries(client: ModelClient, retry: Retry = Retry(), model: str = "", sleep: Callable[[float], None] = time.sleep) -> ModelClient:  # noqa: B008
    """``client`` that asks again after limits and timeouts; refused credentials raise at once, other failures too."""

    def ask(told: str, view: str) -> str:
        for attempt in range(1, retry.attempts + 1):
            try:
                return client(told, view)
            except Exception as e:
                kind = failure(e)
                if kind == "auth":
                    raise ModelAuthError("the model refused the credentials", model=model, error=repr(e)) from e
                if kind == "other" or attempt == retry.attempts:
                    raise ModelError("the model's call failed", model=model, error=repr(e), attempt=attempt) from e
                sleep(retry.wait(attempt))
        raise ModelError("no attempt is allowed", model=model)

    return ask


def constrained(client: ModelClient, fits: Callable[[dict], bool], tries: int = 3) -> Callable[[str, str], dict]:
    """Asks for a JSON object until the answer holds one, ``tries`` times at most; one that does not fit raises and is not asked again."""

    def ask(told: str, view: str) -> dict:
        answer = ""
        for attempt in range(tries):
            answer = client(told if not attempt else f"{told}\nAnswer with one JSON object and nothing else.", view)
            found = first_object(answer)
            if found is not None:
                if not fits(found):
                    raise ModelError("the answer does not fit the schema", answer=answer[:200])
                return found
        raise ModelError("the model gave no JSON object", answer=answer[:200], tries=tries)

    return ask


class _Counts(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:  # noqa: N802 - Spark's name
        for k, v in b.items():
            a[k] = a.get(k, 0) + v
        return a


class Meter:
    """Counts by label that clients add to on the executors. A task that runs again counts again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, spark.sparkContext.accumulator({}, _Counts())

    def client(self, client: ModelClient, model: str) -> ModelClient:
        held = self.held

        def ask(told: str, view: str) -> str:
            began = time.monotonic()
            try:
                answer = client(told, view)
            except Exception as e:
                held.add({(model, "failed:" + failure(e)): 1})
                raise
            held.add({(model, "calls"): 1, (model, "characters"): len(told) + len(view) + len(answer), (model, "milliseconds"): int(1000 * (time.monotonic() - began))})
            return answer

        return ask

    def report(self) -> DataFrame:
        """model, measure, value."""
        return self.spark.createDataFrame([(m, k, v) for (m, k), v in sorted(self.held.value.items())], "model string, measure string, value long")


def explain(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """What an extraction did (see ``extract_pages``): templates asked about, questions, plans learned, rows and rows with an error."""
    from pyspark.sql import functions as F

    told = asked.agg(F.count("*").alias("templates"), F.coalesce(F.sum("questions"), F.lit(0)).cast("long").alias("questions"), F.count("plan").alias("learned"))
    made = rows.agg(F.count("*").alias("rows"), F.count("_error").alias("failed"))
    return told.withColumn("_one", F.lit(1)).join(made.withColumn("_one", F.lit(1)), "_one").drop("_one")
