"""Stored contracts: versions of what a table must look like, checked run by run."""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .contract import Contract, violations
from .profile import column_profile, family


class ContractStore:
    """Contracts in a folder, a JSON file a version; the first run of a table makes version 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        _, where, files = self._files()
        if not files.exists(where):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(where) if s.getPath().getName().startswith("version="))

    def save(self, contract: Contract, profile: DataFrame | None = None) -> int:
        """Write the next version: the contract, and the column profile of the table that it was made from."""
        version = max(self.versions(), default=-1) + 1
        body = json.dumps(asdict(contract))
        out = self.spark.createDataFrame([(body,)], "contract string")
        if profile is not None:
            rows = profile.agg(F.to_json(F.array_sort(F.collect_list(F.struct("column", "type", "rows", "nulls", "null_pct")))).alias("profile"))
            out = out.join(F.broadcast(rows))  # one row each
        out.coalesce(1).write.json(f"{self.path}/version={version:06d}")
        return version

    def load(self, version: int | None = None) -> Contract:
        version = max(self.versions()) if version is None else version
        row = json.loads(self.spark.read.schema("contract string").json(f"{self.path}/version={version:06d}").first().contract)
        ranges = {c: tuple(r) for c, r in row.pop("ranges").items()}
        return Contract(**row, ranges=ranges)

    def profile(self, version: int) -> DataFrame:
        """The column profile that a version was made with."""
        raw = self.spark.read.schema("profile string").json(f"{self.path}/version={version:06d}")
        return raw.select(F.inline(F.from_json("profile", "array<struct<column:string,type:string,rows:long,nulls:long,null_pct:double>>")))


class Violated(ValueError):
    """A run broke its contract; `report` has all of it."""

    def __init__(self, report: DataFrame):
        super().__init__("schema contract violated")
        self.report = report


def checkpoint(df: DataFrame, store: ContractStore, required: list[str], *, mode: str = "enforce", allow_new: bool = True, **rules) -> DataFrame:
    """(version, rank, violation) of a run against the newest contract, in the order of the rules; no row when it holds.

    The first run makes the contract from `df` and `rules` and holds. Columns that are new and allowed, in a run without
    violations, make the next version. In mode "enforce" a violation raises `Violated` with the report; in any other mode it is told only.
    """
    if not store.versions():
        store.save(Contract.of(df, required, **rules), column_profile(df, distinct=False))
        return store.spark.createDataFrame([], "version int, rank int, violation string")
    version, contract = max(store.versions()), store.load()
    found = violations(df, contract, allow_new).select(F.lit(version).alias("version"), "rank", "violation")
    broken = not found.isEmpty()
    if broken and mode == "enforce":
        raise Violated(found)
    if not broken and (new := {f.name: family(f.dataType) for f in df.schema.fields if f.name not in contract.columns}):
        store.save(replace(contract, columns=contract.columns | new), column_profile(df, distinct=False))
    return found
