"""A table as numbered immutable snapshots: data first, then a pointer that only one writer can create.

``root/data/<number>-<token>`` holds the rows of a snapshot, ``root/commits/<number>`` names the token. A commit is the creation of that file if it is absent, which file
systems do atomically, so of two writers of one number one wins and the other gets ``Conflict``. A writer that dies before the commit leaves data that no
reader sees; one that dies while it writes the pointer leaves a torn one, which readers take for absent after ``RETRIES`` looks, and the next writer
takes the next number."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RETRIES, PAUSE = 3, 0.05


class Conflict(Exception):
    """Another writer has made the snapshot of this number."""


class Snapshots:
    """Snapshots under a folder of any store that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def numbers(self) -> list[int]:
        """Numbers with a pointer, torn ones too, ascending."""
        at = self._path("commits")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def _pointer(self, number: int) -> dict | None:
        """What a pointer says; None if it stays torn."""
        for look in range(RETRIES):
            if look:
                time.sleep(PAUSE)
            stream = self._fs.open(self._path(f"commits/{number:012d}"))
            try:
                raw = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            finally:
                stream.close()
            try:
                found = json.loads(raw)
            except ValueError:
                continue
            if isinstance(found, dict) and "token" in found:
                return found
        return None

    def latest(self) -> tuple[int, dict] | None:
        """The newest whole snapshot's number and pointer."""
        for number in reversed(self.numbers()):
            if (found := self._pointer(number)) is not None:
                return number, found
        return None

    def stage(self, df: DataFrame, number: int) -> str:
        """Write rows for a snapshot; returns the token to commit. Nobody reads them before."""
        token = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{number:012d}-{token}")
        return token

    def commit(self, number: int, token: str, **more) -> None:
        """Make a staged snapshot the one of its number, with further facts (JSON values) in its pointer."""
        try:
            out = self._fs.create(self._path(f"commits/{number:012d}"), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"snapshot {number} of {self.root} exists") from e
            raise
        try:
            out.write(bytearray(json.dumps({"token": token, **more}).encode()))
        finally:
            out.close()

    def write(self, df: DataFrame, number: int | None = None, **more) -> int:
        """The rows as the next snapshot, or as the given number, else Conflict."""
        if number is None:
            number = (self.numbers() or [0])[-1] + 1
        self.commit(number, self.stage(df, number), **more)
        return number

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of the newest whole snapshot, or of the newest one up to a number; None before the first."""
        for at in reversed(self.numbers()):
            if number is not None and at > number:
                continue
            if (found := self._pointer(at)) is not None:
                return self.spark.read.parquet(f"{self.root}/data/{at:012d}-{found['token']}")
        return None

    def update(self, change: Callable[[DataFrame | None], DataFrame], tries: int = 5, **more) -> int:
        """The newest rows changed, as the next snapshot; begins again from what another writer has made meanwhile."""
        for left in range(tries - 1, -1, -1):
            number = (self.numbers() or [0])[-1] + 1
            try:
                return self.write(change(self.read()), number, **more)
            except Conflict:
                if not left:
                    raise
        raise Conflict(self.root)

    def data_folders(self) -> list[str]:
        """Names of all data folders, committed or not."""
        at = self._path("data")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []
