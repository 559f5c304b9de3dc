"""A folder of fitted objects: each is one described row, and the tables it holds are Parquet beside it."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import fields, is_dataclass
from datetime import date, datetime
from decimal import Decimal
from importlib import import_module

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.functions.columns import ColumnError
from tidemill.functions.durable import claim

ROW = "name string, module string, type string, body string"


class FittedStore:
    """Fitted objects under auto-numbered names (``iqr_v1``, ``iqr_v2``, ...) below ``path``.

    Any fitted object of this library can be saved: fields that are plain values, lists, maps or arrays go into the
    described row, fields that are DataFrames are written as tables of their own, so their size does not matter. The
    row comes last: an object whose save broke off is never listed. Names are read from the folder, so a store opened by
    another session knows them all. A number is claimed by creating a file, so two writers never share one; a
    number whose writer broke off stays unused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def list(self) -> DataFrame:
        return self._rows().select("name", "type")

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(ROW).parquet(f"{self.path}/objects/*")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ROW)  # nothing saved yet

    def save(self, base: str, fitted) -> str:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", base):
            raise ColumnError(f"{base!r} is no name: letters, digits, _, . and - are allowed")
        if not is_dataclass(fitted):
            raise TypeError(f"{type(fitted).__name__} is not a fitted object")
        taken = [r["name"].rsplit("_v", 1) for r in self._rows().select("name").collect()]
        folder = f"tables/{base}-{uuid.uuid4().hex}"
        body = {f.name: self._plain(getattr(fitted, f.name), f"{folder}/{f.name}") for f in fields(fitted)}
        kind = type(fitted)
        number = 1 + max((int(number) for stem, number in taken if stem == base), default=0)
        while not claim(self.spark, f"{self.path}/claims/{base}_v{number}"):
            number += 1  # another writer has it, or had it and broke off
        name = f"{base}_v{number}"
        self.spark.createDataFrame([(name, kind.__module__, kind.__name__, json.dumps(body))], ROW) \
            .coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/objects/{name}")
        return name

    def get(self, name: str, kind: type | None = None):
        """The object saved as ``name``; with ``kind``, only if it is one."""
        row = self._rows().filter(F.col("name") == name).first()
        if row is None:
            stored = sorted(r["name"] for r in self.list().collect())
            raise ColumnError(f"{name!r} is not stored; stored: {stored}")
        if not row["module"].startswith("tidemill."):
            raise ColumnError(f"{name!r} is of a type from {row['module']}, which is not loaded")
        found = getattr(import_module(row["module"]), row["type"])
        if kind is not None and found is not kind:
            raise ColumnError(f"{name!r} is a {row['type']}")
        return found(**{k: self._restored(v) for k, v in json.loads(row["body"]).items()})

    def _plain(self, value, place: str):
        """``value`` as JSON; what JSON lacks is marked by its kind."""
        if isinstance(value, DataFrame):
            value.write.parquet(f"{self.path}/{place}")
            return {"table": place}
        if isinstance(value, np.ndarray):
            return {"array": value.tolist(), "dtype": str(value.dtype)}
        if isinstance(value, np.generic):
            return value.item()
        if isinstance(value, dict):
            return {"map": [[self._plain(k, f"{place}.k{i}"), self._plain(v, f"{place}.{i}")]
                            for i, (k, v) in enumerate(value.items())]}
        if isinstance(value, tuple):
            return {"tuple": [self._plain(v, f"{place}.{i}") for i, v in enumerate(value)]}
        if isinstance(value, list):
            return [self._plain(v, f"{place}.{i}") for i, v in enumerate(value)]
        if isinstance(value, Decimal):
            return {"decimal": str(value)}
        if isinstance(value, datetime):
            return {"timestamp": value.isoformat()}
        if isinstance(value, date):
            return {"date": value.isoformat()}
        if value is None or isinstance(value, (str, bool, int, float)):
            return value
        raise TypeError(f"a {type(value).__name__} cannot be stored")

    def _restored(self, value):
        if isinstance(value, list):
            return [self._restored(v) for v in value]
        if not isinstance(value, dict):
            return value
        kind = next(iter(value))
        held = value[kind]
        if kind == "table":
            return self.spark.read.parquet(f"{self.path}/{held}")
        if kind == "array":
            return np.array(held, dtype=value["dtype"])
        if kind == "map":
            return {self._restored(k): self._restored(v) for k, v in held}
        if kind == "tuple":
            return tuple(self._restored(v) for v in held)
        return {"decimal": Decimal, "timestamp": datetime.fromisoformat, "date": date.fromisoformat}[kind](held)
