"""Publication of folders: a reader always finds one whole version.

A version is written to a folder of its own under ``data``. It counts from the
moment when a numbered file under ``commits`` names it; the file is created, never
renamed or replaced, so two writers can't commit the same number, and readers take
the highest number that is whole. Earlier versions stay until ``vacuum``, so a
version can be taken back by a commit that names an earlier one.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from .files import Files


class Publication:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def stage(self) -> str:
        """A new folder to write a version to."""
        return f"{self.root}/data/{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"

    def history(self) -> list[dict]:
        """All whole commits, the newest last."""
        out = []
        for name in self.files.names(f"{self.root}/commits"):
            try:
                out.append({"number": int(name.removesuffix(".json")), **json.loads(self.files.read(f"{self.root}/commits/{name}"))})
            except ValueError:  # still being written, or not ours
                continue
        return out

    def current(self) -> dict:
        found = self.history()
        if not found:
            raise FileNotFoundError(f"nothing is published at {self.root}")
        return found[-1]

    def folder(self, commit: dict | None = None) -> str:
        return f"{self.root}/data/{(commit or self.current())['version']}"

    def _next(self) -> int:
        # files that are not whole count too: their number is taken
        return 1 + max((int(n.removesuffix(".json")) for n in self.files.names(f"{self.root}/commits") if n.removesuffix(".json").isdigit()), default=0)

    def commit(self, staged: str, expected: int | None = None, **info) -> dict:
        """Makes a staged folder the current version; ``expected`` is the number of the commit that it was made from, if another one must not come between."""
        number = self._next()
        if expected is not None and number != expected + 1:
            raise RuntimeError(f"{self.root} has changed: commit {number - 1} instead of {expected}")
        entry = {"version": staged.rstrip("/").rsplit("/", 1)[-1], "committed_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **info}
        self.files.create(f"{self.root}/commits/{number:010d}.json", json.dumps(entry, sort_keys=True, ensure_ascii=False))
        return {"number": number, **entry}

    def rollback(self) -> dict:
        """Goes back to the version before the current one."""
        found = self.history()
        earlier = [c for c in found if c["version"] != found[-1]["version"]] if found else []
        if not earlier:
            raise ValueError(f"{self.root} has no earlier version")
        last = {k: v for k, v in earlier[-1].items() if k not in ("number", "version", "committed_at")}
        return self.commit(self.folder(earlier[-1]), **last | {"rolled_back_from": found[-1]["version"]})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all but the last versions that were current and the ``segments`` that they refer to, and what was staged and never committed; no writer may be at work."""
        commits = {c["version"]: c for c in self.history()}
        order = list(dict.fromkeys(c["version"] for c in reversed(self.history())))[: max(keep, 1)]
        needed = {*order, *(s for v in order for s in commits[v].get("segments", []))}
        gone = [v for v in self.files.names(f"{self.root}/data") if v not in needed]
        for v in gone:
            self.files.delete(f"{self.root}/data/{v}")
        return gone

    def publish(self, df: DataFrame, **info) -> dict:
        """Writes one table and commits it."""
        staged = self.stage()
        df.write.parquet(staged)
        return self.commit(staged, **info)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.folder())
