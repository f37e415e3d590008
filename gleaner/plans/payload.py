"""Charts' JSON shapes from small results; the only place that collects."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleaner.operators import histogram as H
from gleaner.operators import scatter as S


def histogram(df: DataFrame, errors: DataFrame, x: str, y: str | None = None, n: int = 10, m: int = 10) -> dict:
    kinds, out = H.column_kinds(df, [c for c in (x, y) if c]), []
    for r in H.histogram(df, errors, x, y, n, m).collect():  # bins times bins
        entry = {"count": {"items": r["items"], **r["errors"]}}
        for k, c in (("x", x), ("y", y)):
            if c:
                entry |= {f"{k}Bin": r[f"{k}_bin"] if kinds[c] == "numeric" and r[k] is None else r[k], f"{k}Type": kinds[c]}
        out.append(entry)
    scales = {}
    for k, c, bins in (("X", x, n), ("Y", y, m)):
        if c:
            rows = H.scale(df, c, bins).collect()
            number = bool(rows) and "x0" in rows[0].asDict()
            scales[f"scale{k}"] = {"numeric": [{"x0": r["x0"], "x1": r["x1"]} for r in sorted(rows, key=lambda r: r["code"])] if number else [], "categorical": [] if number else [r["label"] for r in rows]}
    return {"histograms": out, **scales}


def scatter(df: DataFrame, errors: DataFrame, x: str, y: str, **limits) -> dict:
    return {"data": [r.asDict(recursive=True) for r in S.entries(df, errors, x, y, **limits).collect()]}


def plot_matrix(columns: list[str]) -> list[list[tuple[str, str, str]]]:
    """Chart and columns of each cell: bars on the diagonal, points above it, heat maps below."""
    return [[("histogram" if i == j else "scatter" if i < j else "heatmap", x, y) for j, x in enumerate(columns)] for i, y in enumerate(columns)]
