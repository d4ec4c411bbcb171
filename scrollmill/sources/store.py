"""A versioned store of Parquet tables: whole commits, no table rewritten to add rows.

A table is a list of parts, folders that are written once and never changed. A commit writes new
parts and then makes them current by creating one small file, named by the version it makes: that
fails if another commit made the version first, and a commit that dies before it leaves nothing
behind but parts that no version names. Readers see the parts of one version, never a mixture.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SCHEMA = 7


class Conflict(RuntimeError):
    """Another commit came first."""


class Store:
    """Tables under `root`, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        os.makedirs(root, mode=0o700, exist_ok=True)
        if os.path.islink(root):
            raise ValueError("the store's folder is a link")
        os.chmod(root, 0o700)
        self.versions = os.path.join(root, "versions")
        os.makedirs(self.versions, mode=0o700, exist_ok=True)

    def _names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.versions) if n.endswith(".json"))

    def pointer(self) -> dict:
        """The newest version: `schema, version, tables` (name to parts) and `facts` that commits carry on."""
        names = self._names()
        if not names:
            return {"schema": SCHEMA, "version": 0, "tables": {}, "facts": {}}
        with open(os.path.join(self.versions, names[-1])) as f:
            found = json.load(f)
        if found["schema"] != SCHEMA:
            raise ValueError(f"the store has schema {found['schema']}, this library {SCHEMA}: call rebuild() and ingest anew")
        return found

    @property
    def version(self) -> int:
        return self.pointer()["version"]

    def rebuild(self) -> None:
        """Remove everything, whatever its schema: what was ingested can be ingested again."""
        for name in os.listdir(self.root):
            path = os.path.join(self.root, name)
            shutil.rmtree(path) if os.path.isdir(path) else os.unlink(path)
        os.makedirs(self.versions, mode=0o700)

    def read(self, name: str) -> DataFrame | None:
        """The committed table, or None if there is none."""
        parts = self.pointer()["tables"].get(name)
        return None if not parts else self.spark.read.parquet(*(os.path.join(self.root, p) for p in parts))

    def _write(self, name: str, df: DataFrame, version: int, by: list[str]) -> str:
        path = f"{name}/v{version}-{uuid.uuid4().hex[:8]}"
        full = os.path.join(self.root, path)
        df.write.partitionBy(*by).parquet(full)
        for folder, _, files in os.walk(full):
            os.chmod(folder, 0o700)
            for f in files:
                os.chmod(os.path.join(folder, f), 0o600)
        os.chmod(os.path.dirname(full), 0o700)
        return path

    def commit(
        self, tables: dict[str, DataFrame], base: int, partition_by: dict[str, list[str]] | None = None,
        append: dict[str, DataFrame] | None = None, facts: dict | None = None,
    ) -> int:
        """Write `tables` in place of the old ones, `append` beside them, and make both current.

        Refused if the store has moved on from version `base`, before anything is written and again
        at the end. `facts` are merged into those of the pointer.
        """
        now = self.pointer()
        if now["version"] != base:
            raise Conflict(f"version {now['version']}, expected {base}")
        by = partition_by or {}
        todo = [*((name, df, True) for name, df in tables.items()), *((name, df, False) for name, df in (append or {}).items())]
        with ThreadPoolExecutor(max(1, len(todo))) as pool:  # parts are written beside one another
            parts = list(pool.map(lambda x: self._write(x[0], x[1], base + 1, by.get(x[0], [])), todo))
        made: dict[str, list[str]] = {}
        for (name, _, whole), part in zip(todo, parts):
            made[name] = [*made.get(name, [] if whole else now["tables"].get(name, [])), part]
        new = now | {"version": base + 1, "tables": now["tables"] | made, "facts": now["facts"] | (facts or {})}
        part = os.path.join(self.root, f"part.{uuid.uuid4().hex}")
        with open(part, "w") as f:
            json.dump(new, f)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(part, 0o600)
        try:
            os.link(part, os.path.join(self.versions, f"{base + 1:012d}.json"))  # fails if it is there
        except FileExistsError:
            raise Conflict(f"version {base + 1} was made by another commit") from None
        finally:
            os.unlink(part)
        return base + 1

    def upsert(self, name: str, rows: DataFrame, keys: list[str], drop: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The table after `drop` with `rows` in place of those of equal keys (to be committed whole)."""
        old = self.read(name)
        return rows if old is None else drop(old).join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)

    def status(self) -> dict[str, int]:
        """Rows of each table."""
        return {name: self.read(name).count() for name in self.pointer()["tables"]}

    def reclaim(self) -> int:
        """Remove parts that the current version does not name, and older versions; how many parts were removed."""
        names = self._names()
        current = {p for parts in self.pointer()["tables"].values() for p in parts}
        for name in names[:-1]:
            os.unlink(os.path.join(self.versions, name))
        gone = 0
        for name in {os.path.dirname(p) for p in current}:
            for part in os.listdir(os.path.join(self.root, name)):
                if f"{name}/{part}" not in current:
                    shutil.rmtree(os.path.join(self.root, name, part))
                    gone += 1
        return gone

    def compact(self, name: str, files: int) -> int:
        """Rewrite a table of many parts into one of `files` files."""
        base = self.version
        return self.commit({name: self.read(name).repartition(files)}, base)
