"""Small files in any file system that Spark reaches."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession

from memstore.errors import Locked


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def age(self, name: str) -> float:
        """Seconds since a file was last written."""
        return time.time() - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes, exclusive: bool = False) -> None:
        """exclusive: raises Locked where the file is there already."""
        try:
            stream = self.fs.create(self.path(name), not exclusive)
        except Exception as e:
            if exclusive and ("FileAlreadyExists" in str(e) or "already exists" in str(e)):
                raise Locked(f"{name} was committed by another writer") from None
            raise
        stream.write(data)
        stream.close()

    def read_json(self, name: str) -> dict:
        return json.loads(self.read(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place of spark.checkpoint.dir.  Where that is unset: in the warehouse on a cluster, a temporary one on one machine."""
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        root = "file://" + tempfile.mkdtemp(prefix="memstore-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
