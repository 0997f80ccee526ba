"""Physical-plan checks: the properties the ledger's plans must keep at scale
(no Python evaluation, no cartesian product, filters at the scan)."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
PAIR_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def exchanges(text: str) -> list[str]:
    """Shuffle exchanges of the initial physical plan (one line each)."""
    initial = text.split("== Initial Plan ==")[-1].split("\n\n")[0]
    return [ln.strip() for ln in initial.splitlines() if re.search(r"\bExchange\b", ln)
            and "Broadcast" not in ln]


def python_nodes(text: str) -> list[str]:
    return [n for n in PYTHON_NODES if n in text]


def pair_nodes(text: str) -> list[str]:
    return [n for n in PAIR_NODES if n in text]


def pushed_filters(text: str) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)\]", text)


def read_schemas(text: str) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*?>)\n", text)
