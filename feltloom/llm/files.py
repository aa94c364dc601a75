"""Few files at a time through Spark's own file systems, by the driver: names, moves and small texts."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.conf), target

    def names(self, folder: str) -> list[str]:
        """Of the files in a folder, sorted; of none if there is no such folder."""
        fs, target = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []

    def move(self, path: str, to: str) -> None:
        """Rename; done already if only the new name is there, so that a move that is run again does no harm."""
        fs, source = self._at(path)
        _, target = self._at(to)
        if not fs.exists(source) and fs.exists(target):
            return
        if not fs.rename(source, target):
            raise OSError(f"{path} can't be renamed to {to}")

    def make(self, folder: str) -> None:
        fs, target = self._at(folder)
        fs.mkdirs(target)

    def delete(self, path: str) -> None:
        fs, target = self._at(path)
        fs.delete(target, True)

    def read(self, path: str) -> str:
        fs, target = self._at(path)
        stream = fs.open(target)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Write under a temporary name, then rename: a reader sees the old text or the new one."""
        fs, target = self._at(path)
        draft_path = f"{path.rpartition('/')[0]}/_draft-{uuid.uuid4().hex}"
        _, draft = self._at(draft_path)
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(target):
            fs.delete(target, False)
        self.move(draft_path, path)
