"""Names and small files under a folder, through Spark's own file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self.path, self.jvm = root, spark._jvm.org.apache.hadoop.fs.Path, spark._jvm
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(folder))) if self.exists(folder) else []

    def numbers(self, folder: str) -> list[int]:
        """Numbers at the end of the names, ascending."""
        return sorted(int(n.rsplit("=", 1)[-1]) for n in self.names(folder) if n.rsplit("=", 1)[-1].isdigit())

    def create(self, name: str, text: str = "") -> None:
        """Write a file that must not exist yet: of two writers one fails."""
        out = self.fs.create(self.at(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(self.fs.open(self.at(name)))).decode()

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
