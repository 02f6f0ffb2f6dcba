"""Snapshot tables: every commit writes a folder of its own, and one small file names the folders that belong together.

A reader that has read the pointer sees one state of all tables, whatever is written meanwhile. One writer is assumed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = lambda at: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}")
        self.fs = self.path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """{"version": n, "tables": {name: folder}} of the last commit."""
        at = self.path("_current")
        if not self.fs.exists(at):
            return {"version": 0, "tables": {}}
        return self._json("_current")

    def _json(self, at: str) -> dict:
        stream = self.fs.open(self.path(at))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{(state or self.state())['tables'][name]}")

    def commit(self, **tables: DataFrame) -> int:
        """Write the tables and make all of them current at once; tables that are not named stay. Returns the version."""
        now = self.state()
        folders = dict(now["tables"])
        for name, df in tables.items():
            folders[name] = f"{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{folders[name]}")
        version = now["version"] + 1
        for at in (f"_versions/{version:08d}", "_next"):
            out = self.fs.create(self.path(at), True)
            out.write(bytearray(json.dumps({"version": version, "tables": folders}).encode()))
            out.close()
        self._replace("_next", "_current")
        return version

    def _replace(self, new: str, old: str) -> None:
        """Rename over a file that is there, in one step where the file system can."""
        sc = self.spark.sparkContext
        overwrite = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        options = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = overwrite
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(new).toUri(), sc._jsc.hadoopConfiguration()).rename(self.path(new), self.path(old), options)

    def keep(self, versions: int = 14) -> list[int]:
        """Forget all but the last ``versions`` commits, and folders that none of them names; returns the kept versions."""
        names = sorted(x.getPath().getName() for x in self.fs.listStatus(self.path("_versions")))
        old, kept = names[:-versions], names[-versions:]
        read = lambda n: set(self._json(f"_versions/{n}")["tables"].values())
        live = set().union(*map(read, kept))
        for n in old:
            for folder in read(n) - live:
                self.fs.delete(self.path(folder), True)
            self.fs.delete(self.path(f"_versions/{n}"), False)
        return [int(n) for n in kept]
