"""Published versions of a table: new folders, and one pointer that names the live one.

A version is written to a folder of its own.  It becomes live when the next numbered
pointer file appears, by one rename to a name that did not exist; the pointer before it
stays.  A reader takes the highest number, so at no moment is there no table, and one that
began with the version before still finds its files: the last ``keep`` versions stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from martlens.session import delete_path


class Pointer:
    """Numbered states below ``path``; a state is a small dictionary, ``folders`` its data.

    One writer at a time: a second one that publishes the same number is refused.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        if keep < 1:
            raise ValueError("the live version has to be kept")
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def numbers(self) -> list[int]:
        """Numbers of the states that are kept, the live one last."""
        if not self._files.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def state(self, number: int | None = None) -> dict | None:
        """The live state, or the one of a number; None before the first."""
        if number is None:
            found = self.numbers()
            if not found:
                return None
            number = found[-1]
        stream = self._files.open(self._file(f"{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def fresh_folder(self) -> str:
        return f"{self.path}/data-{uuid.uuid4().hex}"

    def publish(self, state: dict) -> int:
        """Make ``state`` the live one; folders that no kept state names are removed."""
        kept = self.numbers()
        number = kept[-1] + 1 if kept else 1
        draft, final = self._file(f"{uuid.uuid4().hex}.draft"), self._file(f"{number:012d}.json")
        stream = self._files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"{self.path}: version {number} was published by another job")
        self._forget([*kept, number])
        return number

    def _forget(self, numbers: list[int]) -> None:
        old, live = numbers[: -self.keep], numbers[-self.keep :]
        if not old:
            return
        used = {f for n in live for f in self.state(n)["folders"]}
        gone = {f for n in old for f in self.state(n)["folders"]} - used
        for n in old:  # first the pointer: nobody finds a state without its files
            self._files.delete(self._file(f"{n:012d}.json"), False)
        for folder in sorted(gone):
            delete_path(self.spark, folder)


class VersionedTable:
    """A table whose contents are replaced at one moment, by path and, if named, in SQL."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, keep: int = 2):
        self.spark, self.name = spark, name
        self.pointer = Pointer(spark, path, keep)

    def publish(self, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        """Replace the contents by ``df``, which may read them; returns the new contents.

        A job that breaks off leaves the old contents live and a folder without a pointer.
        """
        folder = self.pointer.fresh_folder()
        df.write.partitionBy(*partition_by).parquet(folder)
        self.pointer.publish({"folders": [folder]})
        return self._live(folder)

    def _live(self, folder: str) -> DataFrame:
        if self.name:
            # one change of the catalog entry: the name always resolves
            self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} AS SELECT * FROM parquet.`{folder}`")
        return self.spark.read.parquet(folder)

    def read(self) -> DataFrame:
        state = self.pointer.state()
        if state is None:
            raise LookupError(f"{self.pointer.path} has no version yet")
        return self.spark.read.parquet(*state["folders"])

    def roll_back(self) -> DataFrame:
        """Make the version before the live one live again, as a new version."""
        kept = self.pointer.numbers()
        if len(kept) < 2:
            raise LookupError(f"{self.pointer.path} has no earlier version")
        state = self.pointer.state(kept[-2])
        self.pointer.publish(state)
        return self._live(state["folders"][0])
