"""Resumable runs: a folder of finished settings, each committed as a whole, so that a rerun does what is left."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Ledger:
    """Results by setting in ``folder``, which driver and executors share.

    A setting's result is first written to a folder of its own attempt and then renamed, which is one
    step of the file system: it is there whole or not at all. A run that stops anywhere leaves what it
    has finished, and an attempt of another run that finishes the same setting later is thrown away.
    """

    spark: SparkSession
    folder: str

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _place(self, setting: str) -> str:
        return f"{self.folder}/done/setting={quote(setting, safe='')}"

    def done(self) -> set[str]:
        """Settings that are finished."""
        fs, path = self._fs(f"{self.folder}/done")
        if not fs.exists(path):
            return set()
        return {unquote(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(path) if s.isDirectory()}

    def commit(self, setting: str, result: DataFrame) -> bool:
        """Write a setting's result; whether this attempt was the first."""
        attempt = f"{self.folder}/attempts/{uuid.uuid4().hex}"
        result.write.parquet(attempt)
        fs, source = self._fs(attempt)
        target = self._fs(self._place(setting))[1]
        fs.mkdirs(target.getParent())
        first = not fs.exists(target) and fs.rename(source, target)
        if not first:
            fs.delete(source, True)
        else:
            # a rename onto a folder that has just come moves into it: then the other attempt stays
            inner = self._fs(f"{self._place(setting)}/{source.getName()}")[1]
            if fs.exists(inner):
                fs.delete(inner, True)
                first = False
        return first

    def run(self, settings: Iterable[str], work: Callable[[str], DataFrame]) -> list[str]:
        """Do ``work`` for every setting that isn't finished, in order; those that were done now."""
        finished, now = self.done(), []
        for setting in dict.fromkeys(settings):
            if setting not in finished and self.commit(setting, work(setting)):
                now.append(setting)
        return now

    def forget(self, setting: str) -> None:
        """Take a setting's result away, to have it done again."""
        fs, path = self._fs(self._place(setting))
        fs.delete(path, True)

    def results(self, schema: str) -> DataFrame:
        """All finished results, with ``setting``."""
        if not self.done():
            return self.spark.createDataFrame([], f"{schema}, setting string")
        return self.spark.read.schema(f"{schema}, setting string").parquet(f"{self.folder}/done")
