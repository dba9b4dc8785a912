"""Results of requests, kept as tables under a digest of what was asked, for one dump date."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class ResultStore:
    """Results below ``root``, a folder for each dump date and in it one for each request.

    The key is a digest of the request's name and of all its parameters, page
    numbers included, so no two requests share a result. A result counts once
    its writer has finished; one that was broken off is written again.
    """

    def __init__(self, spark: SparkSession, root: str, dump_date: str):
        self.spark, self.root, self.dump_date = spark, root.rstrip("/"), dump_date

    def _file(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def path(self, name: str, **parameters) -> str:
        """Where the result of a request is or would be; parameters are named in any order and are plain values."""
        asked = json.dumps([name, parameters], sort_keys=True, ensure_ascii=False)
        return f"{self.root}/{self.dump_date}/{hashlib.sha256(asked.encode()).hexdigest()}"

    def holds(self, name: str, **parameters) -> bool:
        files, place = self._file(f"{self.path(name, **parameters)}/_SUCCESS")
        return files.exists(place)

    def get(self, name: str, compute: Callable[[], DataFrame], **parameters) -> DataFrame:
        """The kept result of a request, which ``compute`` makes if there is none; its rows come back in any order."""
        path = self.path(name, **parameters)
        if not self.holds(name, **parameters):
            compute().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def forget_older(self) -> list[str]:
        """Remove the results of all other dump dates; their names."""
        files, place = self._file(self.root)
        if not files.exists(place):
            return []
        gone = sorted(s.getPath().getName() for s in files.listStatus(place) if s.getPath().getName() != self.dump_date)
        for name in gone:
            files.delete(self._file(f"{self.root}/{name}")[1], True)
        return gone
