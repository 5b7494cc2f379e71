"""One object for all requests on a dataset: load, query, page, describe, chart, export, keep."""

from __future__ import annotations

import dataclasses
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import charts, grouping, predicates, values
from quarry.operators import rows as pages
from quarry.operators import stats as described
from quarry.plans.meta import Dataset, DatasetMeta
from quarry.plans.spec import Chart, Layout, Query, View, to_json
from quarry.sources import adopt, ingest, samples, sinks
from quarry.sources.store import Store

#: Filtered frames that stay cached at once.
CACHED = 4


def filtered(ds: Dataset, query: Query = Query()) -> DataFrame:
    """The rows of a query, lazily: __rid and the columns. Conditions reach the scan where it can take them."""
    df = ds.df
    for where in (predicates.stored_condition(ds, query.filters), predicates.condition(ds, query.filters, query.search)):
        df = df if where is None else df.filter(where)
    # ids that aren't stored number the rows that are left: numbering all rows would keep filters from the scan
    df = df if ds.has_rid else df.withColumn(Dataset.RID, F.monotonically_increasing_id())
    return df.select(Dataset.RID, *[f"`{c.id}`" for c in ds.meta.columns])


class Engine:
    """Holds one dataset and the last query. Everything but facts and small results is a lazy frame."""

    def __init__(self, spark: SparkSession, store: str | None = None, progress: Callable[[str, float], None] = lambda phase, ratio: None):
        self.spark, self.progress = spark, progress
        self.store = Store(spark, store) if store else None
        self.ds: Dataset | None = None
        self.spec: Query | None = None
        self._frames: dict[str, DataFrame] = {}
        self._tag = ""

    # loading

    def open(self, ds: Dataset) -> DatasetMeta:
        self.dispose()
        self.ds = ds
        return ds.meta

    def load_file(self, path: str, options: ingest.Options = ingest.Options()) -> DatasetMeta:
        return self.open(ingest.ingest(self.spark, path, options, self.progress))

    def load_bytes(self, content: bytes, name: str, options: ingest.Options = ingest.Options()) -> DatasetMeta:
        return self.open(ingest.ingest_bytes(self.spark, content, name, options))

    def load_parquet(self, path: str) -> DatasetMeta:
        return self.open(adopt.read_parquet(self.spark, path))

    def load_sample(self, preset: str, n: int) -> DatasetMeta:
        self.progress("generating", 0.0)
        return self.open(samples.sample(self.spark, preset, n))

    def load_stored(self, dataset_id: str) -> DatasetMeta | None:
        found = self._store().load(dataset_id)
        return self.open(found) if found else None

    def dispose(self) -> None:
        for frame in self._frames.values():
            frame.unpersist()
        self._frames.clear()
        self.ds = self.spec = None

    def count_values(self) -> DatasetMeta:
        """Facts with counts of nulls and of distinct values."""
        self.ds = adopt.with_counts(self._dataset())
        return self.ds.meta

    # queries

    def _dataset(self) -> Dataset:
        if self.ds is None:
            raise LookupError("no dataset is open")
        return self.ds

    def _store(self) -> Store:
        if self.store is None:
            raise LookupError("the engine has no store")
        return self.store

    def rows(self) -> DataFrame:
        """The filtered rows of the last query, cached by what restricts them."""
        if self.spec is None:
            raise LookupError("no query has been run")
        live = [f for f in self.spec.filters if f.enabled]
        key = to_json(Query(tuple(live), self.spec.search))
        if key not in self._frames:
            while len(self._frames) >= CACHED:
                self._frames.pop(next(iter(self._frames))).unpersist()
            self._frames[key] = filtered(self._dataset(), self.spec).persist()
        return self._frames[key]

    def query(self, spec: Query = Query()) -> dict:
        """Runs a query: how many rows match, of how many, in how many groups."""
        began, ds = time.monotonic(), self._dataset()
        self._tag = f"query-{uuid.uuid4().hex}"
        self.spark.addTag(self._tag)
        self.progress("querying", 0.0)
        try:
            self.spec = spec
            matched = self.rows().count()
            total = ds.meta.row_count if ds.meta.row_count >= 0 else ds.df.count()
            groups = grouping.group(ds, self.rows(), spec.group).count() if spec.group.columns else None
        finally:
            self.spark.removeTag(self._tag)
        return {"matched": matched, "total": total, "group_count": groups, "elapsed_ms": (time.monotonic() - began) * 1000}

    def cancel(self) -> None:
        """Stops the jobs of the running query."""
        if self._tag:
            self.spark.interruptTag(self._tag)

    def window(self, offset: int = 0, limit: int = pages.PAGE_ROWS, columns: list[str] | None = None) -> DataFrame:
        return pages.window(self._dataset(), self.rows(), self.spec.sorts, offset, limit, columns)

    def groups(self, offset: int = 0, limit: int = pages.PAGE_ROWS) -> DataFrame:
        frame = self.rows()
        return grouping.group_window(self._dataset(), frame, self.spec.group, self.spec.sorts, offset, limit)

    def distinct(self, column: str, limit: int = 0, search: str = "", everywhere: bool = False) -> DataFrame:
        """Values of a column in the current rows, or in the whole dataset."""
        frame = self._dataset().df if everywhere else self.rows()
        return values.distinct_values(self._dataset(), frame, column, limit, search)

    def extent(self, column: str) -> DataFrame:
        return values.extent(self._dataset(), column)

    # description

    def stats(self, column: str) -> DataFrame:
        return described.stats(self._dataset(), self.rows(), column)

    def histogram(self, column: str, bins: float = 30) -> DataFrame:
        return described.histogram(self._dataset(), self.rows(), column, bins)

    def top_values(self, column: str, top: int = described.TOP_VALUES) -> DataFrame:
        return described.top_values(self._dataset(), self.rows(), column, top)

    def profile(self, columns: list[str] | None = None, bins: int = described.SPARK_BINS) -> DataFrame:
        return described.profiles(self._dataset(), self.rows(), columns, bins)

    def chart(self, spec: Chart) -> charts.ChartResult:
        return charts.chart(self._dataset(), self.rows(), spec)

    # export and storage

    def export_csv(self, path: str, columns: list[str] | None = None, limit: int = 0) -> int:
        """Writes the current rows, never groups, in their order; returns how many."""
        ds, frame = self._dataset(), self.rows()
        ordered = frame.orderBy(*pages.ordering(ds, self.spec.sorts)) if self.spec.sorts else frame
        sinks.write_csv(ds, ordered, path, columns, limit)
        return sinks.exported_rows(frame.count(), limit)

    def export_view(self, path: str, layout: Layout) -> int:
        """Writes what a view shows: visible columns in their order, and rows up to the most that a view exports."""
        return self.export_csv(path, sinks.view_columns(layout), sinks.view_limit(self.rows().count()))

    def save(self) -> int:
        return self._store().save(self._dataset(), self.progress)

    def apply_view(self, view: View) -> dict:
        """Runs a saved view's query."""
        return self.query(view.query)

    def memory_report(self) -> list[tuple[str, int, int]]:
        return ingest.estimate_naive(self._dataset().meta)

    def rename(self, name: str) -> None:
        ds = self._dataset()
        self.ds = dataclasses.replace(ds, meta=dataclasses.replace(ds.meta, name=name))
