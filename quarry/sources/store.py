"""Datasets and views on any file system that Spark reaches: Parquet data, and a manifest that is written last and so commits
a save."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

from quarry.plans.meta import Dataset, DatasetMeta
from quarry.plans.spec import View, to_json, view_from
from quarry.sources.files import Folder


class Store:
    """A folder (a path or a URI) with data/<id>, manifests/<id>.json and views/<id>.json."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Folder(spark, root)

    @staticmethod
    def _safe(name: str) -> str:
        if not re.fullmatch(r"[\w.-]+", name) or name.startswith("."):
            raise ValueError(f"{name!r} can't be an id")
        return name

    def _data(self, dataset_id: str) -> str:
        return f"data/{self._safe(dataset_id)}"

    def _manifest(self, dataset_id: str) -> str:
        return f"manifests/{self._safe(dataset_id)}.json"

    def _view(self, view_id: str) -> str:
        return f"views/{self._safe(view_id)}.json"

    def save(self, ds: Dataset, progress=lambda phase, ratio: None) -> int:
        """Writes a dataset and returns its bytes. A failed save leaves no data and no manifest, and touches no view."""
        progress("saving", 0.0)
        target, manifest = self._data(ds.meta.id), self._manifest(ds.meta.id)
        fresh = uuid.uuid4().hex
        ids = [f"`{c.id}`" for c in ds.meta.columns]
        try:
            ds.with_rid().select("__rid", *ids).write.parquet(self.files.uri(f"{target}/{fresh}"))
            size = self.files.size(f"{target}/{fresh}")
            self.files.write(manifest, json.dumps({"meta": json.loads(ds.meta.to_json()), "data": fresh}))  # the commit
        except Exception:
            self.files.delete(target)
            self.files.delete(manifest)
            raise
        for old in self.files.names(target):
            if old != fresh:
                self.files.delete(f"{target}/{old}")
        progress("saving", 1.0)
        return size

    def load(self, dataset_id: str) -> Dataset | None:
        """The dataset, or None if its manifest, its data or one of its columns is missing."""
        try:
            found = json.loads(self.files.read(self._manifest(dataset_id)) or "")
            meta = DatasetMeta.from_json(json.dumps(found["meta"]))
        except (ValueError, KeyError, TypeError):
            return None
        path = f"{self._data(dataset_id)}/{found['data']}"
        if not self.files.exists(path):
            return None
        df = self.spark.read.parquet(self.files.uri(path))
        if {c.id for c in meta.columns} - set(df.columns):
            return None
        return Dataset(df, meta, has_rid=True)

    def datasets(self) -> list[DatasetMeta]:
        """Facts of all saved datasets, newest first."""
        texts = [self.files.read(f"manifests/{n}") for n in self.files.names("manifests") if n.endswith(".json")]
        return sorted((DatasetMeta.from_json(json.dumps(json.loads(t)["meta"])) for t in texts if t), key=lambda m: -m.created_at)

    def delete(self, dataset_id: str) -> None:
        """Removes a dataset with its data and views; an unknown id does nothing."""
        self.files.delete(self._manifest(dataset_id))
        self.files.delete(self._data(dataset_id))
        for view in self.views(dataset_id):
            self.delete_view(view.id)

    def save_view(self, view: View) -> None:
        self.files.write(self._view(view.id), to_json(view))

    def _all_views(self) -> list[View]:
        texts = [self.files.read(f"views/{n}") for n in self.files.names("views") if n.endswith(".json")]
        return [view_from(t) for t in texts if t]

    def views(self, dataset_id: str) -> list[View]:
        return sorted((v for v in self._all_views() if v.dataset_id == dataset_id), key=lambda v: -v.created_at)

    def delete_view(self, view_id: str) -> None:
        self.files.delete(self._view(view_id))

    def clear(self) -> int:
        """Removes everything, and returns how many datasets there were."""
        n = len(self.datasets())
        for part in ("data", "manifests", "views"):
            self.files.delete(part)
        return n

    def quota(self) -> dict | None:
        """Bytes that the store has, and that it could have."""
        if not self.files.exists(""):
            return None
        used = self.files.size("")
        return {"usage": used, "quota": used + self.files.room()}

    def report(self) -> dict:
        quota = self.quota()
        return {"available": quota is not None, **(quota or {"usage": None, "quota": None}), "datasets": len(self.datasets()), "views": len(self._all_views())}
