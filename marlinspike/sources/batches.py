"""Folders that grow by batches, each of which is seen as a whole or not at all.

A batch is a folder with a table for each artefact.  It counts once its number
is committed, which a rename does; what a failed writer leaves is never read, so
a retry adds nothing twice.  Of two writers that take the same number the second
one fails and has to read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


class Conflict(RuntimeError):
    """Another writer has committed in between."""


def files(spark: SparkSession, path: str):
    """Hadoop's file system of a path: (JVM, path, file system)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, target, system = files(spark, path)
    return system.exists(target)


class Batches:
    """A folder of batches and the log of those that are committed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self) -> dict[int, str]:
        """Folder of each committed batch, by number; a commit is one small file."""
        _, target, system = files(self.spark, f"{self.root}/commits")
        if not system.exists(target):
            return {}
        out = {}
        for name in sorted(s.getPath().getName() for s in system.listStatus(target)):
            if name.isdigit():
                jvm, path, _ = files(self.spark, f"{self.root}/commits/{name}")
                stream = system.open(path)
                try:
                    out[int(name)] = f"{self.root}/batches/{jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
                finally:
                    stream.close()
        return out

    def stage(self) -> str:
        """Folder of a batch that nobody sees yet."""
        return f"{self.root}/batches/{uuid.uuid4().hex}"

    def drop(self, folder: str) -> None:
        """Delete a staged batch."""
        _, target, system = files(self.spark, folder)
        system.delete(target, True)

    def commit(self, number: int, folder: str) -> None:
        """Make a batch the one of this number; fails if the number is taken.

        The commit is a file named by the number alone, so that it can exist
        once.  It is written beside the log and renamed, which never replaces.
        """
        jvm, beside, system = files(self.spark, f"{folder}/COMMIT")
        stream = system.create(beside, True)
        try:
            stream.write(bytearray(folder.rsplit("/", 1)[1].encode()))
        finally:
            stream.close()
        log = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        system.mkdirs(log)
        done = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/{number:08d}")
        uri = done.toUri() if done.toUri().getScheme() else jvm.java.net.URI("file:///")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(beside, done, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if system.exists(done):
                raise Conflict(f"batch {number} is committed already") from e
            raise

    def next_number(self) -> int:
        return max(self.committed(), default=-1) + 1

    def read(self, artefact: str, schema: str, numbered: bool = False) -> DataFrame:
        """Rows of all committed batches, with their batch's number as ``batch`` if asked for."""
        out = None
        for number, folder in self.committed().items():
            part = self.spark.read.schema(schema).parquet(f"{folder}/{artefact}")
            part = part.withColumn("batch", F.lit(number)) if numbered else part
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema + (", batch int" if numbered else "")) if out is None else out

    def clear_unfinished(self) -> int:
        """Delete the batches of writers that failed, while no other is at work; returns how many."""
        _, target, system = files(self.spark, f"{self.root}/batches")
        if not system.exists(target):
            return 0
        kept = {f.rsplit("/", 1)[1] for f in self.committed().values()}
        gone = [s.getPath() for s in system.listStatus(target) if s.getPath().getName() not in kept]
        for path in gone:
            system.delete(path, True)
        return len(gone)
