"""Folder trees as a Spark data source, ``folders``: batches of some folders, streams of whole trees.

    spark.dataSource.register(FolderSource)
    spark.read.format("folders").option("roots", '["/data/a"]').load()          # what lies in these folders
    spark.readStream.format("folders").option("roots", '["/data"]').option("state", "/shared/walk").load()

A stream's offset is a level of the tree; each micro-batch lists one level. Tasks write the
folders they find to the state folder, which executors and driver share: they are the next
level. The driver reads of such a file only its first line, the number of folders in it, and
cuts the level into splits of as many folders. A split that is read again replaces its file
with the same folders, so a lost task or a stop costs a split or a level; a stream goes on
from its checkpoint. Entries are passed on in batches while a folder is read: neither a
folder of any size nor a level is ever held whole.

The rows are those of ``walk.LISTING``; what cannot be read is a row of kind error. Roots
below another root are listed with it; roots that are no folders give nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from stratafold.sources import walk

_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in walk.LISTING.split(", "))])


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return walk.LISTING

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:  # noqa: N802  (the interface's name)
        return FolderStream(self.options)


def _roots(options) -> list[str]:
    roots = [r for r in dict.fromkeys(json.loads(options["roots"])) if os.path.isdir(r)]
    return [r for r in roots if not any(r.startswith(o + "/") for o in roots)]


def _listed(folders: list[tuple[str, int, str]], excluded: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of what lies in the folders (path, depth, root)."""
    asked = pd.DataFrame([(*f, True) for f in folders], columns=["path", "depth", "root", "changed"])
    for frame in walk._list(iter([asked]), excluded):
        yield pa.RecordBatch.from_pandas(frame, schema=_SCHEMA, preserve_index=False)


class Named(InputPartition):
    """Folders by their paths."""

    def __init__(self, folders: list[str]):
        self.folders = folders


class FolderReader(DataSourceReader):
    """What lies in the roots themselves."""

    def __init__(self, options):
        self.roots, self.excluded = _roots(options), frozenset(json.loads(options.get("excluded", "[]")))
        self.per_task = int(options.get("folders_a_task", walk.FOLDERS_A_TASK))

    def partitions(self) -> list[Named]:
        return [Named(self.roots[i : i + self.per_task]) for i in range(0, len(self.roots), self.per_task)] or [Named([])]

    def read(self, partition: Named) -> Iterator[pa.RecordBatch]:
        yield from _listed([(r, 0, r) for r in partition.folders], self.excluded)


class Split(InputPartition):
    """Folders lo to hi of a file of the state folder."""

    def __init__(self, level: int, file: str, lo: int, hi: int):
        self.level, self.file, self.lo, self.hi = level, file, lo, hi


class FolderStream(DataSourceStreamReader):
    def __init__(self, options):
        self.options, self.state = dict(options), options["state"]
        self.excluded, self.per_task = frozenset(json.loads(options.get("excluded", "[]"))), int(options.get("folders_a_task", walk.FOLDERS_A_TASK))

    def _level(self, level: int) -> str:
        return f"{self.state}/level={level:04d}"

    def _put(self, level: int, name: str, folders: list[str]) -> None:
        """A file of folders, as JSON lines below their number; whole or not there."""
        os.makedirs(self._level(level), exist_ok=True)
        part = f"{self._level(level)}/.{name}.{os.getpid()}"
        with open(part, "w") as f:
            f.write(f"{len(folders)}\n")
            f.writelines(x + "\n" for x in folders)
        os.replace(part, f"{self._level(level)}/{name}.jsonl")

    def _files(self, level: int) -> list[tuple[str, int]]:
        """The level's files and how many folders each has."""
        if not os.path.isdir(self._level(level)):
            return []
        out = []
        for entry in sorted(os.scandir(self._level(level)), key=lambda e: e.name):
            if entry.name.endswith(".jsonl"):
                with open(entry.path) as f:
                    out.append((entry.path, int(f.readline())))
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        if not self._files(0):
            self._put(0, "roots", [json.dumps([r, 0, r]) for r in _roots(self.options)])
        return {"level": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The first level that nobody has found folders for yet."""
        level = 0
        while any(n for _, n in self._files(level)):
            level += 1
        return {"level": level}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return [
            Split(level, file, lo, min(lo + self.per_task, n))
            for level in range(start["level"], end["level"]) for file, n in self._files(level) for lo in range(0, n, self.per_task)
        ]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        with open(partition.file) as f:
            f.readline()
            folders = [tuple(json.loads(line)) for i, line in enumerate(f) if partition.lo <= i < partition.hi]
        name = hashlib.sha256(f"{partition.file} {partition.lo}".encode()).hexdigest()[:24]
        os.makedirs(self._level(partition.level + 1), exist_ok=True)
        part, n = f"{self._level(partition.level + 1)}/.{name}.{os.getpid()}", 0
        with open(part, "w") as found:
            for batch in _listed(folders, self.excluded):
                for kind, path, depth, root in zip(*(batch.column(c).to_pylist() for c in ("kind", "path", "depth", "root"))):
                    if kind == "folder":
                        found.write(json.dumps([path, depth, root]) + "\n")
                        n += 1
                yield batch
        whole = f"{part}.whole"
        with open(whole, "w") as out, open(part) as found:
            out.write(f"{n}\n")
            for line in found:
                out.write(line)
        os.unlink(part)
        os.replace(whole, f"{self._level(partition.level + 1)}/{name}.jsonl")

    def commit(self, end: dict) -> None:
        """Nothing to do: the state folder is as large as the folders' names, and a checkpoint may go back to any level."""
