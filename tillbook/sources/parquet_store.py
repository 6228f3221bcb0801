"""Tables as Parquet files under numbered commits.

Files are written to folders of their own; a commit is one small manifest that names
the folders of every table, so several tables change together. Manifests are created,
never overwritten: of two writers of one commit, one fails, and readers of an earlier
commit are never disturbed. A table may be kept by month of a timestamp; a change then
writes the months it touches, and the manifest keeps the folders of the others.

Rows can be erased by key without writing a table: the keys are written once, and the
manifest says which folders are read without them. Rows written later are in other folders,
so a key may come back; folding writes what is left of a folder anew.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.operators.versions import without
from tillbook.schema import table_schema

# A folder, alone or followed by the folders of erased keys, each with the key's column before it.
Part = str | list[str]

MONTH = "_month"
# Folder of rows without a month.
UNDATED = "none"
# The one folder of a table that is not kept by month.
WHOLE = "all"


@dataclass(frozen=True)
class Months:
    """Next rows of the ``touched`` months of a table kept by the month of ``column``;
    rows of other months may come with them only if those months are listed too."""

    rows: DataFrame
    column: str
    touched: list[str] | None = None  # None: all


@dataclass(frozen=True)
class Sorted:
    """Next rows of a table that single rows are read from by ``key``: files that do not
    overlap, in order of the key, with small pages and a Bloom filter on it."""

    rows: DataFrame
    key: str


# Rows of a page of a sorted table, the least that a point read takes.
PAGE_ROWS = 1000
# Values of one list that a scan compares with pages and Bloom filters one by one.
LISTED = 10


class ParquetStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, pattern: str) -> list[str]:
        path, files = self._path(pattern)
        return sorted(status.getPath().getName() for status in files.globStatus(path) or [])

    def _manifest(self, version: int) -> dict[str, dict[str, Part]]:
        """Part by month by table. Manifests hold folder names only, a few per table."""
        path, files = self._path(f"commits/{version:010d}.json")
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commits(self) -> list[int]:
        return [int(name.split(".")[0]) for name in self._listed("commits/[0-9]*.json")]

    def versions(self, table: str) -> list[int]:
        """Commits that changed the table, oldest first."""
        found, before = [], None
        for version in self.commits():
            now = self._manifest(version).get(table)
            if now != before:
                found.append(version)
            before = now
        return found

    def _state(self, version: int | None) -> dict[str, dict[str, Part]]:
        known = [v for v in self.commits() if version is None or v <= version]
        return self._manifest(known[-1]) if known else {}

    def exists(self, table: str) -> bool:
        return table in self._state(None)

    def read(self, table: str, version: int | None = None, months: list[str] | None = None) -> DataFrame:
        """The table as of a commit, the latest by default; only of some months if given."""
        parts = self._state(version)[table]
        schema = table_schema(table)
        # Folders with the same erased keys are scanned together.
        scans: dict[tuple[str, ...], list[str]] = {}
        for month, part in parts.items():
            if months is None or month in months:
                folder, *erased = [part] if isinstance(part, str) else part
                scans.setdefault(tuple(erased), []).append(f"{self.root}/{folder}")
        found = [self._without(self.spark.read.schema(schema).parquet(*folders), erased) for erased, folders in scans.items()]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def _without(self, rows: DataFrame, erased: tuple[str, ...]) -> DataFrame:
        for key, folder in zip(erased[::2], erased[1::2]):
            keys = self.spark.read.schema(f"{key} {rows.schema[key].dataType.simpleString()}").parquet(f"{self.root}/{folder}")
            rows = without(rows, keys, key)
        return rows

    def find(self, table: str, key: str, values: list) -> DataFrame:
        """The rows with the given keys; of a sorted table, their pages are all that is read.

        Scans look single values up only in short lists, so long ones are cut up.
        """
        wanted = sorted(set(values))
        lists = [wanted[at : at + LISTED] for at in range(0, len(wanted), LISTED)]
        conditions = [F.col(key).isin(some) for some in lists]
        return self.read(table).filter(reduce(lambda a, b: a | b, conditions, F.lit(False)))

    def erase(self, keys: DataFrame, key: str, tables: list[str]) -> int:
        """Drop the rows with the given keys from several tables in one commit.

        Only the keys are written, whatever the tables hold; NULL is no key.
        """
        folder = f"erased/{uuid.uuid4().hex}"
        keys.select(key).filter(F.col(key).isNotNull()).distinct().write.parquet(f"{self.root}/{folder}")
        state, version = self._next()
        for table in tables:
            state[table] = {m: [*([part] if isinstance(part, str) else part), key, folder] for m, part in state[table].items()}
        return self._append(state, version)

    def fold(self, table: str, column: str | None = None) -> int:
        """Write the parts of a table from which keys were erased anew, without these rows;
        ``column`` is the one whose month the table is kept by."""
        parts = self._state(None)[table]
        touched = [month for month, part in parts.items() if not isinstance(part, str)]
        rows = self.read(table, months=touched)
        return self.commit({table: rows if column is None else Months(rows, column, touched)})

    def months_of(self, table: str, column: str, keys: DataFrame, key: str) -> list[str]:
        """Months in which rows with the given keys lie; reads the two columns only."""
        rows = self.read(table).select(key, _month(column)).join(keys.select(key).distinct(), key, "left_semi")
        return sorted(r[MONTH] for r in rows.select(MONTH).distinct().collect())  # a row per month

    def commit(self, changes: dict[str, DataFrame | Months | Sorted], version: int | None = None) -> int:
        """Write changes of several tables and make them one commit, the next or the one
        named. Raises FileExistsError if that commit exists; the files are then unused.
        """
        state, version = self._next(version)
        for table, change in changes.items():
            folder = f"{table}/{uuid.uuid4().hex}"
            if isinstance(change, Sorted):
                rows = change.rows.repartitionByRange(change.key).sortWithinPartitions(change.key)
                layout = {f"parquet.bloom.filter.enabled#{change.key}": "true", "parquet.page.row.count.limit": str(PAGE_ROWS)}
                rows.write.options(**layout).parquet(f"{self.root}/{folder}")
                state[table] = {WHOLE: folder}
                continue
            if not isinstance(change, Months):
                change.write.parquet(f"{self.root}/{folder}")
                state[table] = {WHOLE: folder}
                continue
            change.rows.withColumn(MONTH, _month(change.column)).write.partitionBy(MONTH).parquet(f"{self.root}/{folder}")
            kept = {} if change.touched is None else {m: f for m, f in state.get(table, {}).items() if m not in change.touched}
            written = {name.split("=", 1)[1]: f"{folder}/{name}" for name in self._listed(f"{folder}/{MONTH}=*")}
            if kept.keys() & written.keys():
                raise ValueError(f"rows of untouched months {sorted(kept.keys() & written.keys())} of {table}")
            state[table] = kept | written
        return self._append(state, version)

    def _next(self, version: int | None = None) -> tuple[dict[str, dict[str, Part]], int]:
        """The state that the next commit, or the one named, changes, and its number."""
        if version is None:
            version = max(self.commits(), default=-1) + 1
        return self._state(version), version

    def _append(self, state: dict[str, dict[str, Part]], version: int) -> int:
        self._create(f"commits/{version:010d}.json", json.dumps(state, indent=1).encode())
        return version

    def _create(self, name: str, content: bytes) -> None:
        """Write a file that must not exist. Renaming onto its name would replace another
        writer's, so the name itself is created, which one writer alone can."""
        path, files = self._path(name)
        draft, _ = self._path(f"drafts/{uuid.uuid4().hex}")
        claim, _ = self._path(f"{name}.claim")
        files.mkdirs(path.getParent())
        with_content = files.create(draft, False)
        with_content.write(content)
        with_content.close()
        try:
            won = files.createNewFile(claim)
        except self.spark._jvm.java.io.IOException:
            won = False
        if not won and (files.exists(path) or not self._abandoned(claim, files)):
            raise FileExistsError(f"{name} has a writer already")
        if files.exists(path) or not files.rename(draft, path):
            raise FileExistsError(f"{name} has a writer already")

    def _abandoned(self, claim, files) -> bool:
        """Whether a claim is so old that its writer, which had but a rename left, is dead."""
        age = self.spark._jvm.java.lang.System.currentTimeMillis() - files.getFileStatus(claim).getModificationTime()
        return age > 600_000

    def write(self, df: DataFrame, table: str, version: int | None = None) -> int:
        return self.commit({table: df}, version)

    def update(self, table: str, column: str, keys: DataFrame, key: str, job: Callable[[DataFrame], DataFrame]) -> int:
        """Run a job on the months in which ``keys`` lie and commit these months anew."""
        touched = self.months_of(table, column, keys, key)
        return self.commit({table: Months(job(self.read(table, months=touched)), column, touched)})

    def numbers(self, pattern: str) -> list[int]:
        """Numbers of the complete folders ``.../name=number``, in order."""
        path, files = self._path(f"{pattern}/_SUCCESS")
        return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in files.globStatus(path) or [])

    def delete(self, folder: str) -> None:
        path, files = self._path(folder)
        files.delete(path, True)


def _month(column: str):
    return F.coalesce(F.date_format(column, "yyyy-MM"), F.lit(UNDATED)).alias(MONTH)
