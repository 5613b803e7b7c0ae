"""Commit logs: which versions of a table are complete, and which run and batch wrote them.

A version is one small file, named after its number, run and batch, and put in place by a rename after all its data
is written. Readers take one listing of names and ask no version by itself. Numbers go up by one whatever run writes
them, so a new checkpoint, which counts its batches from zero again, continues the table. One writer per log.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, jpath = _file_system(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place by a rename; False if it is there already."""
    folder, name = path.rsplit("/", 1)
    fs, jpath = _file_system(spark, path)
    _, draft = _file_system(spark, f"{folder}/_{name}.{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(jpath) or not fs.rename(draft, jpath):
        fs.delete(draft, False)
        return False
    return True


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """Name of the run that a checkpoint belongs to. It lives and dies with the checkpoint."""
    path = f"{checkpoint}/run_id"
    found = read_text(spark, path)
    if found is None:
        write_text(spark, path, uuid.uuid4().hex)
        found = read_text(spark, path)
    return found


@dataclass(frozen=True, order=True)
class Version:
    number: int
    run: str
    batch_id: int

    @property
    def name(self) -> str:
        return f"{self.number:012d}-{self.run}-{self.batch_id}.json"


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def create(self) -> CommitLog:
        """Make sure that the folder is there, for streams that read the log."""
        fs, jpath = _file_system(self.spark, self.folder)
        fs.mkdirs(jpath)
        return self

    def versions(self) -> list[Version]:
        """Complete versions in order: one listing."""
        fs, jpath = _file_system(self.spark, self.folder)
        if not fs.exists(jpath):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(jpath)]
        parts = [n.removesuffix(".json").split("-") for n in names if n.endswith(".json") and n[0] not in "_."]
        return sorted(Version(int(number), run, int(batch)) for number, run, batch in parts)

    def newest(self) -> int:
        return max((v.number for v in self.versions()), default=-1)

    def place(self, run: str, batch_id: int) -> tuple[int, bool]:
        """The version of a batch, and whether it is complete already; a new batch gets the next number."""
        known = self.versions()
        for version in known:
            if (version.run, version.batch_id) == (run, batch_id):
                return version.number, True
        return max((v.number for v in known), default=-1) + 1, False

    def content(self, number: int) -> dict:
        """What was committed with a version; empty for one that is not there."""
        for version in self.versions():
            if version.number == number:
                return json.loads(read_text(self.spark, f"{self.folder}/{version.name}"))
        return {}

    def commit(self, number: int, run: str, batch_id: int, **content) -> None:
        """Complete a version. Doing so again changes nothing."""
        version = Version(number, run, batch_id)
        entry = {"version": number, "run": run, "batch_id": batch_id, **content}
        write_text(self.spark, f"{self.folder}/{version.name}", json.dumps(entry))
