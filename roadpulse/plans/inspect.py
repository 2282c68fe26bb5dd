"""Plan text for checks on the physical plan (pushdown, pruning, top-k)."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def count_exchanges(df: DataFrame) -> int:
    """Shuffle exchanges in the physical plan (broadcasts not counted)."""
    text = plan_text(df, "simple")
    return sum(1 for line in text.splitlines() if "Exchange" in line and "BroadcastExchange" not in line)


def uses_python(df: DataFrame) -> bool:
    text = plan_text(df, "simple")
    return any(k in text for k in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"))
