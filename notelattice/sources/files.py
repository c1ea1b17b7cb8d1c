"""Small files on any store that Spark's Hadoop client knows: notes, manifests, registries.

What is written appears as a whole: a sibling is written, then renamed. Local files get no checksum files beside them, since
other programs edit notes too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from .scratch import place


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        where, store = place(self.spark, f"{self.root}/{path}" if path else self.root)
        return where, store.getRawFileSystem() if store.getScheme() == "file" else store

    def exists(self, path: str) -> bool:
        where, store = self._at(path)
        return store.exists(where)

    def read(self, path: str) -> str:
        """FileNotFoundError if there is none."""
        where, store = self._at(path)
        if not store.exists(where):
            raise FileNotFoundError(path)
        stream = store.open(where)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, store, where, text: str, overwrite: bool) -> None:
        store.mkdirs(where.getParent())
        stream = store.create(where, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The file replaced as a whole."""
        where, store = self._at(path)
        beside = place(self.spark, f"{where.getParent()}/.{uuid.uuid4().hex}.tmp")[0]
        self._put(store, beside, text, True)
        if not store.rename(beside, where):  # a store that does not rename over a file
            store.delete(where, False)
            store.rename(beside, where)

    def claim(self, path: str, text: str) -> None:
        """A file that must not be there yet: where a store's rename refuses to replace a file, one of several writers succeeds."""
        where, store = self._at(path)
        beside = place(self.spark, f"{where.getParent()}/.{uuid.uuid4().hex}.tmp")[0]
        self._put(store, beside, text, True)
        if store.exists(where) or not store.rename(beside, where):
            store.delete(beside, False)
            raise FileExistsError(path)

    def rename(self, source: str, target: str) -> None:
        """FileExistsError if the target is there."""
        (a, store), (b, _) = self._at(source), self._at(target)
        if store.exists(b):
            raise FileExistsError(target)
        store.mkdirs(b.getParent())
        if not store.rename(a, b):
            raise FileNotFoundError(source)

    def delete(self, path: str) -> bool:
        where, store = self._at(path)
        return store.delete(where, True)

    def changed(self, path: str) -> int:
        """When it was last changed, in milliseconds."""
        where, store = self._at(path)
        return store.getFileStatus(where).getModificationTime()

    def names(self, folder: str) -> list[str]:
        where, store = self._at(folder)
        return sorted(x.getPath().getName() for x in store.listStatus(where)) if store.exists(where) else []

    def below(self, folder: str, ending: str) -> Iterator[str]:
        """Paths of the files below a folder, as the root sees them, one after another."""
        where, store = self._at(folder)
        if not store.exists(where):
            return
        top = len(place(self.spark, self.root)[0].toUri().getPath().rstrip("/")) + 1
        found = store.listFiles(where, True)
        while found.hasNext():
            path = found.next().getPath().toUri().getPath()
            if path.endswith(ending):
                yield path[top:]
