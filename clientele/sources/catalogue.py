"""Staged results found again by name and input version, for a limited time.

A result lies in a folder of its own; a small entry names it, when it was made and of what
type its columns are, so that reading it again runs no job. Expired results are not found any more,
and ``expire`` removes their folders and entries.
"""

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import commits

# Fixed value: how long a loaded dashboard may be shown again, in seconds.
KEEP_SECONDS = 600.0
# Removed this long after they expired, so that readers that found them just before can end.
GRACE_SECONDS = 3600.0


class Catalogue:
    """Results under ``path``, usable for ``keep`` seconds; ``clock`` gives the time in seconds."""

    def __init__(self, spark: SparkSession, path: str, keep: float = KEEP_SECONDS, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.keep, self.clock = spark, path.rstrip("/"), keep, clock

    def get(self, name: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The result ``name`` of input ``version``: one made before and still fresh, or what ``build`` returns, written.

        Of two writers at once the later one takes the other's result and removes its own. A write cut
        short leaves no entry and is not found.
        """
        while True:
            kind = self._kind(name, version)
            taken = commits.numbers(self.spark, self.path, kind)
            entry = self._entry(kind, taken[-1]) if taken else None
            if entry and self._fresh(entry):
                return self._open(entry)
            df, folder = build(), f"result-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            entry = {"folder": folder, "made": self.clock(), "schema": df.schema.json()}
            try:
                commits.publish(self.spark, self.path, kind, taken[-1] + 1 if taken else 1, entry)
                return self._open(entry)
            except commits.Taken:
                commits.remove(self.spark, f"{self.path}/{folder}")

    def expire(self, grace: float = GRACE_SECONDS) -> list[str]:
        """Remove results that expired ``grace`` seconds ago or earlier, and return their folders.

        The newest entry of a result stays, so that its numbers only rise.
        """
        gone = []
        for kind, numbers in commits.kinds(self.spark, self.path).items():
            for number in numbers:
                entry = self._entry(kind, number)
                if entry and self.clock() >= entry["made"] + self.keep + grace:
                    if commits.remove(self.spark, f"{self.path}/{entry['folder']}"):
                        gone.append(entry["folder"])
                    if number != numbers[-1]:
                        commits.remove(self.spark, f"{self.path}/{kind}={number}")
        return gone

    def _fresh(self, entry: dict) -> bool:
        return self.clock() < entry["made"] + self.keep

    def _entry(self, kind: str, number: int) -> dict | None:
        """None where another session has just removed it."""
        try:
            return commits.read(self.spark, self.path, kind, number)
        except commits.Missing:
            return None

    def _open(self, entry: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{entry['folder']}")

    @staticmethod
    def _kind(name: str, version: str) -> str:
        text = f"{name}@{version}"
        if "=" in text or "/" in text:
            raise ValueError(f"not a name and version: {text!r}")
        return text
