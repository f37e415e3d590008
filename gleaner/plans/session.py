"""Immutable table versions with preview, undo, redo and script export."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from gleaner.operators.detectors import run_detectors
from gleaner.operators.summary import attribute_summary
from gleaner.operators.wranglers import WRANGLERS
from gleaner.sources import kept, slice_both

#: Versions between two that are written, which cuts the lineage.
CUT = 10


@dataclass
class Version:
    """A table and what was done to get it; its errors are found when first asked for, and written once."""

    table: DataFrame
    step: str | None = None
    ids: tuple | DataFrame = ()
    options: dict = field(default_factory=dict)
    found: DataFrame | None = None

    @property
    def errors(self) -> DataFrame:
        if self.found is None:
            self.found = kept(run_detectors(self.table))
        return self.found


class Session:
    """A linear history with a cursor; a new step drops what was undone.  Version 0 is the original."""

    def __init__(self, table: DataFrame, errors: DataFrame | None = None):
        self.versions, self.at = [Version(table, found=errors)], 0

    @property
    def current(self) -> Version:
        return self.versions[self.at]

    @property
    def original(self) -> Version:
        return self.versions[0]

    def preview(self, step: str, ids, **options) -> Version:
        table = WRANGLERS[step](self.current.table, ids, **options)
        return Version(table, step, ids if isinstance(ids, DataFrame) else tuple(ids), options)

    def window(self, low: int, high: int) -> tuple[DataFrame, DataFrame]:
        """The current table and its errors, in a range of IDs."""
        return slice_both(self.current.table, self.current.errors, low, high)

    def summary(self, low: int, high: int) -> dict:
        """``attribute_summary`` of that range."""
        return attribute_summary(*self.window(low, high))

    def apply(self, step: str, ids, **options) -> Version:
        new = self.preview(step, ids, **options)
        if (self.at + 1) % CUT == 0:
            new = Version(kept(new.table), new.step, new.ids, new.options)
        self.versions = [*self.versions[: self.at + 1], new]
        self.at += 1
        return new

    def undo(self) -> Version:
        self.at = max(0, self.at - 1)
        return self.current

    def redo(self) -> Version:
        self.at = min(len(self.versions) - 1, self.at + 1)
        return self.current

    def script(self, source: str = "table.csv", target: str = "repaired", order_by: list[str] | None = None, typed: bool = True) -> str:
        """A PySpark script that replays the steps up to the cursor on ``source``, read and numbered as ``ingest`` did
        with the same ``order_by`` and ``typed``."""
        lines = ["from pyspark.sql import SparkSession", "from gleaner.operators.wranglers import WRANGLERS", "from gleaner.sources import read_csv, with_id, write_csv", "", "spark = SparkSession.builder.getOrCreate()", f"df = with_id(read_csv(spark, {source!r}, typed={typed!r}), {order_by!r})"]
        for v in self.versions[1 : self.at + 1]:
            if isinstance(v.ids, DataFrame):
                raise ValueError("a step whose rows are a DataFrame has no script")
            lines.append(f"df = WRANGLERS[{v.step!r}](df, {list(v.ids)!r}{''.join(f', {k}={x!r}' for k, x in v.options.items())})")
        return "\n".join([*lines, f"write_csv(df, {target!r})", ""])
