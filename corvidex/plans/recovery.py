"""Driver-side retries and fallbacks around whole actions.

Tasks are retried by the scheduler; these are for what surrounds a job, such as a
store that is briefly away.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Row, SparkSession

T = TypeVar("T")

# What the message of a passing trouble holds.
TRANSIENT = ("timeout", "timed out", "busy", "locked", "connection", "temporarily")


def transient(error: BaseException) -> bool:
    return any(x in str(error).lower() for x in TRANSIENT)


def delays(attempts: int = 3, first: float = 1.0, factor: float = 2.0, cap: float = 10.0) -> list[float]:
    """Pauses between the attempts."""
    return [min(first * factor**i, cap) for i in range(attempts - 1)]


def with_retry(action: Callable[[], T], *, attempts: int = 3, first: float = 1.0, passing: Callable[[BaseException], bool] = transient, sleep: Callable[[float], None] = time.sleep) -> T:
    """The action's result; passing troubles are tried again with growing pauses, others raise at once."""
    for pause in [*delays(attempts, first), None]:
        try:
            return action()
        except Exception as e:
            if pause is None or not passing(e):
                raise
            sleep(pause)
    raise AssertionError("unreachable")


def with_fallback(action: Callable[[], T], fallback: Callable[[BaseException], T], **retry) -> T:
    """As :func:`with_retry`; what still fails gives ``fallback(error)``."""
    try:
        return with_retry(action, **retry)
    except Exception as e:
        return fallback(e)


def with_time_limit(spark: SparkSession, action: Callable[[], T], seconds: float) -> T:
    """The action's result; its Spark jobs are interrupted after ``seconds``, which raises TimeoutError."""
    sc, late = spark.sparkContext, threading.Event()
    group, keys = f"limit-{uuid.uuid4().hex}", ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
    before = [sc.getLocalProperty(k) for k in keys]

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, f"at most {seconds} s", True)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"interrupted after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for k, v in zip(keys, before, strict=True):
            sc.setLocalProperty(k, v)


def get(spark: SparkSession, statement: str, args: dict | None = None, *, seconds: float = 30.0) -> Row | None:
    """The first row of a statement, None without one; tried again and limited in time."""
    return with_retry(lambda: with_time_limit(spark, spark.sql(statement, args or {}).first, seconds))


def rows(spark: SparkSession, statement: str, args: dict | None = None, *, most: int = 1000, seconds: float = 30.0) -> list[Row]:
    """At most ``most`` rows of a statement on the driver."""
    return with_retry(lambda: with_time_limit(spark, spark.sql(statement, args or {}).limit(most).collect, seconds))
