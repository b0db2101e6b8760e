"""Jobs in stages that can be cut anywhere and go on: each stage is a written table with a manifest, committed by a rename.

A stage whose manifest is there is never computed again; one that was cut has files but no manifest, and starts anew in a
folder of its own. A stage may wait for a table from outside, such as people's decisions: the run ends there with the
state ``waiting`` and goes on once the table is handed in.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..storage import delete, exists, path_of

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """``make`` gets the tables of all stages before it; with ``waits_for`` also that table from outside."""

    name: str
    make: Callable[[Tables], DataFrame]
    waits_for: str | None = None


@dataclass
class Outcome:
    state: str  # done or waiting
    tables: Tables
    computed: list[str] = field(default_factory=list)
    waits_for: str | None = None


class StagedRun:
    """One run in a shared folder. ``inputs`` names the tables it starts from, ``version`` what it was computed by.

    A manifest holds the version and the stages before its own, as they were; if either is another, the stage and all
    after it are computed again.
    """

    def __init__(self, spark: SparkSession, root: str, stages: list[Stage], inputs: Tables, version: str = "1"):
        self.spark, self.root, self.stages, self.inputs, self.version = spark, root.rstrip("/"), stages, inputs, version

    def _manifest(self, name: str) -> str:
        return f"{self.root}/_committed/{name}.json"

    def committed(self, name: str) -> dict | None:
        if not exists(self.spark, self._manifest(name)):
            return None
        fs, p = path_of(self.spark, self._manifest(name))
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, name: str, manifest: dict) -> None:
        """The manifest in one step: written beside its place, then renamed."""
        fs, target = path_of(self.spark, self._manifest(name))
        _, draft = path_of(self.spark, f"{self.root}/_drafts/{name}-{uuid.uuid4().hex[:8]}")
        fs.mkdirs(target.getParent())
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        finally:
            out.close()
        fs.delete(target, False)
        if not fs.rename(draft, target):
            raise OSError(f"{target} couldn't be committed")

    def _table(self, manifest: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(manifest["path"])

    def hand_in(self, name: str, table: DataFrame) -> None:
        """Keeps a table from outside in the run. The first one stays: a run that goes on again decides by the same."""
        if self.committed(f"input-{name}") is None:
            self._write(f"input-{name}", table, [])

    def _write(self, name: str, table: DataFrame, after: list[str]) -> dict:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:12]}"
        table.write.parquet(path)
        manifest = {"id": uuid.uuid4().hex, "version": self.version, "after": after, "path": path, "schema": table.schema.jsonValue()}
        self._commit(name, manifest)
        return manifest

    def run(self, until: str | None = None) -> Outcome:
        """Goes through the stages from the first that isn't committed; ends after ``until``, or where one has to wait."""
        tables, after, computed = dict(self.inputs), [], []
        for stage in self.stages:
            if stage.waits_for:
                given = self.committed(f"input-{stage.waits_for}")
                if given is None:
                    return Outcome("waiting", tables, computed, stage.waits_for)
                tables[stage.waits_for] = self._table(given)
                after = [*after, given["id"]]
            manifest = self.committed(stage.name)
            if manifest is None or manifest["version"] != self.version or manifest["after"] != after:
                old = manifest
                manifest = self._write(stage.name, stage.make(tables), after)
                computed.append(stage.name)
                if old is not None:
                    delete(self.spark, old["path"])
            tables[stage.name] = self._table(manifest)
            after = [*after, manifest["id"]]
            if stage.name == until:
                break
        return Outcome("done", tables, computed)
