"""A versioned store of fitted state: tables and models in folders of their own, published by a manifest written last.

A version is a folder below ``states`` and a manifest ``manifests/<number>-<batch>.json`` that names it.  Folders are
never changed once a manifest names them, so readers of one version are not disturbed by the next.  Publishing creates
the next manifest, which only one of several writers can; whatever a writer left before that is named by nothing and
has no effect.  A manifest counts once it is whole: a writer that dies in the middle leaves one that is passed over.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class ConcurrentPublish(Exception):
    """Another writer has published since the version that this one started from."""


@dataclass(frozen=True)
class Version:
    number: int
    batch: str
    folder: str
    meta: dict


_NAME = re.compile(r"(\d{10})-(.*)\.json")


class Store:
    """The versions below ``base``, a path that driver and executors reach."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[tuple[int, str, str]]:
        """(number, batch, file name) of all manifests, the newest first."""
        folder = self._path(f"{self.base}/manifests")
        if not self._files.exists(folder):
            return []
        found = [_NAME.fullmatch(f.getPath().getName()) for f in self._files.listStatus(folder)]
        return sorted(((int(m[1]), m[2], m[0]) for m in found if m), reverse=True)

    def _read(self, number: int, batch: str, name: str) -> Version | None:
        row = self.spark.read.text(f"{self.base}/manifests/{name}", wholetext=True).first()
        try:
            body = json.loads(row[0]) if row else {}
            text = json.dumps(body["state"], sort_keys=True)
            return Version(number, batch, body["state"]["folder"], body["state"]["meta"]) if zlib.crc32(text.encode()) == body["crc32"] else None
        except (ValueError, KeyError):
            return None

    def current(self) -> Version | None:
        """The newest whole version."""
        return next((v for n in self._names() if (v := self._read(*n)) is not None), None)

    def version(self, number: int) -> Version:
        found = [v for n in self._names() if n[0] == number and (v := self._read(*n)) is not None]
        if not found:
            raise KeyError(f"no version {number}")
        return found[0]

    def of_batch(self, batch: str) -> Version | None:
        """The version that a batch has published, so that a replay can be told."""
        return next((v for n in self._names() if n[1] == _safe(batch) and (v := self._read(*n)) is not None), None)

    def stage(self) -> str:
        """A fresh folder for a version's tables; it means nothing until it is published."""
        return f"{self.base}/states/{uuid.uuid4().hex}"

    def publish(self, folder: str, meta: dict, batch: str = "", after: Version | None = None) -> Version:
        """Make a staged folder the newest version, provided that ``after`` (or none) still is."""
        names = self._names()
        newest = self.current()
        if (newest.number if newest else None) != (after.number if after else None):
            raise ConcurrentPublish(f"version {newest.number if newest else None} has been published meanwhile")
        number = (names[0][0] if names else 0) + 1
        state = {"folder": folder, "meta": meta}
        text = json.dumps({"state": state, "crc32": zlib.crc32(json.dumps(state, sort_keys=True).encode())})
        claim = self._path(f"{self.base}/claims/{number:010d}")
        if not self._files.createNewFile(claim):  # one writer gets a number
            raise ConcurrentPublish(f"version {number} is being published")
        out = self._files.create(self._path(f"{self.base}/manifests/{number:010d}-{_safe(batch)}.json"), False)
        out.write(bytearray(text.encode()))
        out.close()
        return Version(number, _safe(batch), folder, meta)

    def rollback(self, number: int) -> Version:
        """Publish an earlier version again as the newest one."""
        old = self.version(number)
        return self.publish(old.folder, old.meta, f"rollback-{number}-{uuid.uuid4().hex[:8]}", self.current())

    def table(self, name: str, version: Version | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise KeyError("nothing has been published")
        return self.spark.read.parquet(f"{version.folder}/{name}")

    def has(self, name: str, version: Version) -> bool:
        return bool(self._files.exists(self._path(f"{version.folder}/{name}")))


def _safe(batch: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.]", lambda m: f"%{ord(m[0]):x}", batch)
