"""Where a telemetry batch goes, and what came of it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

#: What came of a batch.
NO_ENDPOINT, SENT, FAILED = "no_endpoint", "sent", "failed"


def as_json(batch: DataFrame, endpoint: str) -> None:
    """Rows of a batch as JSON lines in a folder that Spark can write to; a repeated batch replaces itself."""
    batch.write.mode("overwrite").json(endpoint)


def emit(batch: DataFrame, endpoint: str | None, write: Callable[[DataFrame, str], None] = as_json) -> dict[str, Any]:
    """Writes a batch to its endpoint: ``no_endpoint`` without one, ``sent``, or ``failed`` with the error, which never stops the caller.

    ``write`` spreads the rows itself; nothing is brought to the driver.
    """
    if not endpoint:
        return {"status": NO_ENDPOINT, "error": None}
    try:
        write(batch, endpoint)
    except Exception as error:
        return {"status": FAILED, "error": str(error).splitlines()[0] if str(error) else type(error).__name__}
    return {"status": SENT, "error": None}
