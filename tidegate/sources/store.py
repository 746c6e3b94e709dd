"""Files of the shared folder: step tables, small texts, and logs of numbered entries that any number of writers append to."""

from __future__ import annotations

import json
import os
import random
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Entries after which a log's rows are gathered in one table.
GATHERED = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where the session names none (on one machine)."""
    return (spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="files-")).rstrip("/")


def scratch(spark: SparkSession, name: str = "files") -> str:
    """The path of a new folder in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, folder: str) -> DataFrame:
    """The rows as a table of their own in a folder, read from there: a repeated step does not carry the plans of those before it."""
    path = f"{folder.rstrip('/')}/step-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _hadoop(spark, path)
    return store.exists(place)


def size(spark: SparkSession, path: str) -> int:
    place, store = _hadoop(spark, path)
    return store.getFileStatus(place).getLen()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    place, store = _hadoop(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(place)) if store.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, store = _hadoop(spark, path)
    store.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    place, store = _hadoop(spark, path)
    stream = store.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file as a whole, unless one of its name is there; whether it did. Of several writers one does."""
    place, store = _hadoop(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, draft, text)
    try:
        if store.getUri().getScheme() == "file":  # a local rename would replace the file, a link does not
            own = spark._jvm.org.apache.hadoop.fs.Path(draft).toUri().getPath()
            os.link(own, place.toUri().getPath())
        else:
            fs = spark._jvm.org.apache.hadoop.fs
            none = spark._sc._gateway.new_array(fs.Options.Rename, 0)
            fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.Path(draft), place, none)
        return True
    except FileExistsError:
        return False
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        remove(spark, draft)


class Log:
    """A table as numbered entries of rows. An entry is put as a whole and never changes; the next one has the next number.

    Who appends has seen all entries before: if another writer was first, what is to
    be appended is worked out anew. Every GATHERED entries are gathered in one Parquet
    table, so that a reader opens few files.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _entry(self, number: int) -> str:
        return f"{self.folder}/{number:020d}.json"

    def _state(self) -> tuple[int, list[int]]:
        """The last entry that is gathered, and the numbers of all after it."""
        found = names(self.spark, self.folder)
        gathered = max((int(n.removeprefix("upto-")) for n in found if n.startswith("upto-") and exists(self.spark, f"{self.folder}/{n}/_SUCCESS")), default=0)
        return gathered, sorted(k for n in found if n.endswith(".json") and (k := int(n.removesuffix(".json"))) > gathered)

    def last(self) -> int:
        gathered, after = self._state()
        return max([gathered, *after])

    def table(self) -> DataFrame:
        gathered, after = self._state()
        rows = self.spark.createDataFrame([], self.schema)
        if gathered:
            rows = self.spark.read.schema(self.schema).parquet(f"{self.folder}/upto-{gathered:020d}")
        return rows.unionByName(self.spark.read.schema(self.schema).json([self._entry(k) for k in after])) if after else rows

    def commit(self, decide: Callable[[], list[dict] | None]) -> int | None:
        """Appends the rows that ``decide`` gives after looking at the table; it is asked again if another entry came between. None: nothing is to be done."""
        for turn in range(1000):
            number = self.last() + 1
            rows = decide()
            if rows is None:
                return None
            if put_if_absent(self.spark, self._entry(number), "".join(json.dumps(r) + "\n" for r in rows)):
                if number % GATHERED == 0:
                    self._gather(number)
                return number
            time.sleep(random.random() * min(0.01 * 2**turn, 1))
        raise TimeoutError(f"{self.folder}: other writers were always first")

    def append(self, *rows: dict) -> int | None:
        return self.commit(lambda: list(rows))

    def _gather(self, number: int) -> None:
        gathered, after = self._state()
        if after[: number - gathered] == list(range(gathered + 1, number + 1)):
            rows = self.spark.read.schema(self.schema).json([self._entry(k) for k in after if k <= number])
            if gathered:
                rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.folder}/upto-{gathered:020d}"))
            rows.coalesce(1).write.mode("ignore").parquet(f"{self.folder}/upto-{number:020d}")
