"""State tables written once per micro-batch and published by a manifest.

Data goes to fresh folders that nobody reads yet; then one small file that
names all folders in use takes the place of the one before it.  Readers open
what it names, so they see a batch whole or not at all, and neither reading
nor writing lists the root: the cost of a batch does not grow with the number
of batches before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.sources.files import delete_path, read_text, replace_text

MANIFEST = "MANIFEST.json"


class VersionedTable:
    """Versions (one for each micro-batch number) and folds (many versions reduced to one) under a root.

    Writing a version again replaces it; readers take the versions below the
    one being written, so a replay starts from the same state.  A version that
    a fold has taken in is final: writing it again does nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> dict:
        """Folder names by kind and number, and the names of those that the next fold removes."""
        text = read_text(self.spark, f"{self.root}/{MANIFEST}")
        found = json.loads(text) if text else {}
        held = {kind: {int(n): name for n, name in found.get(kind, {}).items()} for kind in ("version", "fold")}
        return held | {"gone": found.get("gone", [])}

    def _publish(self, manifest: dict) -> None:
        replace_text(self.spark, f"{self.root}/{MANIFEST}", json.dumps(manifest, sort_keys=True))

    def _store(self, kind: str, number: int, df: DataFrame) -> str:
        name = f"{kind}-{number}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def versions(self, below: int | None = None) -> list[int]:
        """Numbers of the versions the manifest names; those of old folds are not among them."""
        return sorted(v for v in self.manifest()["version"] if below is None or v < below)

    def latest(self, below: int | None = None) -> DataFrame | None:
        held = self.manifest()["version"]
        known = [v for v in held if below is None or v < below]
        return self.spark.read.parquet(f"{self.root}/{held[max(known)]}") if known else None

    def union_all(self, below: int | None = None, folds_below: int | None = None) -> DataFrame | None:
        """All versions together: the newest fold and the versions after it."""
        held = self.manifest()
        bound = below if folds_below is None else folds_below
        folds = [f for f in held["fold"] if bound is None or f < bound]
        names = [held["fold"][max(folds)]] if folds else []
        names += [held["version"][v] for v in sorted(held["version"]) if (below is None or v < below) and (not folds or v > max(folds))]
        return self.spark.read.parquet(*[f"{self.root}/{n}" for n in names]) if names else None

    def write(self, version: int, df: DataFrame) -> None:
        if version <= max(self.manifest()["fold"], default=-1):
            return
        name = self._store("version", version, df)
        manifest = self.manifest()
        manifest["gone"] += [manifest["version"][version]] if version in manifest["version"] else []
        manifest["version"][version] = name
        self._publish(manifest)

    def fold(self, version: int, every: int, reduce: Callable[[DataFrame], DataFrame]) -> None:
        """Every ``every`` versions store the reduced union of all versions so far.

        Readers then start from it.  What the fold before it has taken in
        leaves the manifest, which so stays small, and its folders go with the
        next fold: a reader has that long to finish.
        """
        folds = self.manifest()["fold"]
        if not every or not version or version % every or version <= max(folds, default=-1):
            return
        name = self._store("fold", version, reduce(self.union_all(below=version + 1, folds_below=version)))
        manifest = self.manifest()
        before = max(manifest["fold"], default=-1)
        gone = [manifest["fold"].pop(f) for f in sorted(manifest["fold"]) if f < before]
        gone += [manifest["version"].pop(v) for v in sorted(manifest["version"]) if v <= before]
        removed, manifest["gone"] = manifest["gone"], gone
        manifest["fold"][version] = name
        self._publish(manifest)
        for folder in removed:
            delete_path(self.spark, f"{self.root}/{folder}")
