"""Facts of datasets and columns, and their ids."""

from __future__ import annotations

import dataclasses
import json
import re
import time
import unicodedata
from dataclasses import dataclass, field

from quarry.plans.spec import QUANTITATIVE


@dataclass(frozen=True)
class ColumnMeta:
    id: str
    name: str
    index: int
    kind: str
    null_count: int = -1
    distinct_count: int = -1  # -1: not known
    byte_size: int = -1
    date_format: str | None = None

    @property
    def quantitative(self) -> bool:
        return self.kind in QUANTITATIVE


@dataclass(frozen=True)
class DatasetMeta:
    id: str
    name: str
    columns: tuple[ColumnMeta, ...]
    row_count: int = -1
    byte_size: int = -1
    source_bytes: int = -1
    created_at: int = 0
    bad_rows: int = 0
    delimiter: str | None = None

    def column(self, column_id: str) -> ColumnMeta | None:
        return next((c for c in self.columns if c.id == column_id), None)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> DatasetMeta:
        data = json.loads(text)
        return cls(**(data | {"columns": tuple(ColumnMeta(**c) for c in data["columns"])}))


def slug(name: str) -> str:
    """Lower-case letters, marks and digits of any script; other runs become one underscore."""
    kept = "".join(c if unicodedata.category(c)[0] in "LMN" else "_" for c in name.strip().lower())
    return re.sub("_+", "_", kept).strip("_")


def column_ids(names: list[str]) -> list[str]:
    """Slugs of header names; blank ones become column_N, repeats take _2, _3 and so on."""
    used: set[str] = set()
    out = []
    for k, name in enumerate(names, 1):
        base = slug(name) or f"column_{k}"
        found, n = base, 1
        while found in used:
            n += 1
            found = f"{base}_{n}"
        used.add(found)
        out.append(found)
    return out


def dataset_id(name: str, rows: int, created_at: int) -> str:
    """ds_ and the 32-bit FNV-1a hash of name, rows and time in base 36."""
    h = 0x811C9DC5
    for char in f"{name}|{rows}|{created_at}":
        h = ((h ^ ord(char)) * 0x01000193) & 0xFFFFFFFF
    digits = ""
    while h or not digits:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    return f"ds_{digits}"


def now_ms() -> int:
    return int(time.time() * 1000)


@dataclass(frozen=True)
class Dataset:
    """One table: a lazy frame whose columns are the ids of meta, with __rid, the source order, if has_rid."""

    df: object
    meta: DatasetMeta
    has_rid: bool = False
    raw: dict = field(default_factory=dict)  # of float columns: the stored column, which scans can filter by

    RID = "__rid"

    def with_rid(self):
        """The frame with __rid; numbered by place in the source where it isn't stored."""
        from pyspark.sql import functions as F

        return self.df if self.has_rid else self.df.withColumn(self.RID, F.monotonically_increasing_id())
