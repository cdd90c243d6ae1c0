"""Tables that are written by commits: Parquet folders, and one file a version that names the live ones.

A row's bucket comes from its key, so that a write reads and rewrites only the buckets that it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


def _write_of(folder: str) -> str:
    """The write that a bucket's folder comes from."""
    return folder.split("/")[1]


class Conflict(Exception):
    """Another writer has committed the version that this one was to be."""


class VersionedTable:
    """The table at ``path``, in a folder that all executors share.

    Data folders are written once and never changed. A version is a JSON file that lists the folders of each bucket;
    it is written aside and renamed to its number, which fails if that number is there: of two writers with the same
    base one wins, and the other starts again from the new version. What is written but not committed, by a lost
    writer, is in no version. A write may also name keys whose older rows no longer count; they lie in folders of their
    own, and are taken away where the older folders are read. The driver handles folder names alone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop, self._conf = jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._files = self._place("").getFileSystem(self._conf)

    def _place(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}".rstrip("/"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 8) -> VersionedTable:
        """A new table without rows; ``keys`` fix a row's bucket. An existing table is a :class:`Conflict`."""
        table = cls(spark, path)
        first = {"version": 0, "schema": schema.json(), "keys": keys, "buckets": buckets, "folders": {}, "transactions": {}}
        table._write_version(first)
        return table

    def _write_version(self, state: dict) -> None:
        aside = self._place(f"_commits/.{uuid.uuid4().hex}")
        out = self._files.create(aside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        final = self._place(f"_commits/{state['version']:020d}.json")
        options = self.spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        options[0] = getattr(self._hadoop, "Options$Rename").NONE
        try:
            self._hadoop.FileContext.getFileContext(aside.toUri(), self._conf).rename(aside, final, options)
        except Py4JJavaError as error:
            self._files.delete(aside, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Conflict(f"version {state['version']} is there") from None
            raise

    def state(self, version: int | None = None) -> dict:
        """The version file, of the newest version by default."""
        if version is None:
            names = [s.getPath().getName() for s in self._files.listStatus(self._place("_commits"))]
            version = max(int(n[:20]) for n in names if n.endswith(".json") and n[0] != ".")
        source = self._files.open(self._place(f"_commits/{version:020d}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()

    def version(self) -> int:
        return self.state()["version"]

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        return self._rows(self.state(version), buckets)

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        wanted = state["folders"] if buckets is None else [str(b) for b in buckets if str(b) in state["folders"]]
        # folders from which the same later writes have taken keys are read together
        parts: dict[tuple[str, ...], list[str]] = {}
        for folder in (f for b in wanted for f in state["folders"][b]):
            parts.setdefault(tuple(state.get("gone", {}).get(_write_of(folder), ())), []).append(f"{self.path}/{folder}")
        found = [self._without(self.spark.read.schema(schema).parquet(*paths), state, gone) for gone, paths in parts.items()]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)

    def _without(self, rows: DataFrame, state: dict, gone: tuple[str, ...]) -> DataFrame:
        """``rows`` without the keys in the folders ``gone``; null keys are equal."""
        if not gone:
            return rows
        kinds = StructType([rows.schema[k] for k in state["keys"]])
        keys = self.spark.read.schema(kinds).parquet(*[f"{self.path}/{f}" for f in gone])
        keys = keys.select(*[F.col(f"`{k}`").alias(f"_gone{i}") for i, k in enumerate(state["keys"])])
        return rows.join(keys, [rows[f"`{k}`"].eqNullSafe(keys[f"_gone{i}"]) for i, k in enumerate(state["keys"])], "left_anti")

    def bucket(self, state: dict | None = None) -> Column:
        state = state or self.state()
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in state["keys"]]), F.lit(state["buckets"])).cast("int")

    def _write_rows(self, rows: DataFrame, state: dict, late: dict[str, Column]) -> dict[str, list[str]]:
        """New folders with the rows, by bucket. Rows of one bucket go through several tasks if they are many."""
        folder = f"data/{uuid.uuid4().hex}"
        columns = StructType.fromJson(json.loads(state["schema"])).names
        named = rows.withColumns(late).select(*[F.col(f"`{c}`") for c in rows.columns], self.bucket(state).alias(BUCKET))
        # the rebalance splits a bucket that is too large for a task, and joins small ones
        dealt = named.hint("rebalance", BUCKET).withColumns(late).select(*[F.col(f"`{c}`") for c in columns], BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}", compression="zstd")
        found = [s.getPath().getName() for s in self._files.listStatus(self._place(folder))]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in found if n.startswith(f"{BUCKET}=")}

    def _commit(self, base: dict, added: dict[str, list[str]], replaced: list[int] | None, transaction: tuple[str, int] | None, gone: list[str]) -> int:
        folders = {b: f for b, f in base["folders"].items() if replaced is None or int(b) not in replaced}
        older = base.get("gone", {})
        taken = {write: older.get(write, []) + gone for write in sorted({_write_of(f) for fs in folders.values() for f in fs})}
        for b, new in added.items():
            folders[b] = folders.get(b, []) + new
        done = base["transactions"] | ({transaction[0]: transaction[1]} if transaction else {})
        self._write_version(base | {"version": base["version"] + 1, "folders": folders, "transactions": done, "gone": {w: g for w, g in taken.items() if g}})
        return base["version"] + 1

    def change(self, make: Callable[[dict], tuple | None], transaction: tuple[str, int] | None = None, attempts: int = 20) -> int:
        """Commit the rows that ``make`` gives for the base version, and return the version that has them.

        ``make`` gives (rows, buckets that they replace; None to append), or None where nothing is to be done. It may add
        keys whose rows in older folders no longer count, null for none, and columns by which the rows are completed
        after they are dealt to tasks, so that what follows from other columns isn't shuffled. If another writer commits first, it is asked again with the new base. A ``transaction`` (writer, number) that a version
        already has is done, and nothing is written: a batch that is run again after a failure leaves its rows once."""
        for _ in range(attempts):
            base = self.state()
            if transaction and base["transactions"].get(transaction[0], -1) >= transaction[1]:
                return base["version"]
            made = make(base)
            if made is None and transaction is None:
                return base["version"]
            rows, replaced, keys, late = (*(made or ()), None, None, None, None)[:4]
            added, gone = {} if rows is None else self._write_rows(rows, base, late or {}), []
            if keys is not None:
                gone = [f"gone/{uuid.uuid4().hex}"]
                keys.select(*[F.col(f"`{k}`") for k in base["keys"]]).write.parquet(f"{self.path}/{gone[0]}", compression="zstd")
            try:
                return self._commit(base, added, replaced, transaction, gone)
            except Conflict:
                for folder in {*gone, *(f[0].rpartition("/")[0] for f in added.values())}:
                    self._files.delete(self._place(folder), True)
        raise Conflict(f"{attempts} attempts have lost against other writers")

    def append(self, rows: DataFrame, transaction: tuple[str, int] | None = None) -> int:
        return self.change(lambda base: (rows, None), transaction)

    def writes(self, state: dict) -> int:
        """From how many writes the live folders come."""
        return len({_write_of(f) for fs in state["folders"].values() for f in fs})

    def touched(self, rows: DataFrame, state: dict | None = None) -> list[int]:
        """The buckets of the keys of ``rows``, at most as many as the table has."""
        return sorted(r[0] for r in rows.select(self.bucket(state)).distinct().collect())
