"""Bucketed Parquet tables under numbered manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.schema import BUCKET_KEYS, MIGRATIONS, TABLES, VERSION


class ReadOnlyError(RuntimeError):
    """A write was asked of a store opened read-only."""


class Store:
    """Tables under one folder. A table is a list of parts, each the rows of one hash bucket of its key.

    A write adds files and then a manifest with the next number, which names every part; creating it
    fails if another writer took the number, and the write is tried again on what that one left.
    Readers take the highest manifest, so they never meet a table half written. An append adds parts and
    touches no other; a merge reads and rewrites the buckets its keys fall in. ``erase=True`` deletes
    the parts and manifests that are no longer current, which erasure of content needs. The folder
    may be on any file system Hadoop knows whose create fails on an existing file.
    """

    def __init__(self, spark: SparkSession, root: str, readonly: bool = False, buckets: int = 16):
        self.spark, self.root, self.readonly, self.buckets = spark, root.rstrip("/"), readonly, buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        have, kept = (self._number(f"_meta/{x}") for x in ("version", "buckets"))
        self.opened_as = have  # the version it had before this opening; 0 for a new store
        if have > VERSION:
            raise RuntimeError(f"schema {have} is newer than this build's {VERSION}")
        if readonly:
            if have != VERSION:
                raise RuntimeError("a read-only store must have this build's schema version")
        else:
            for step in range(have + 1, VERSION + 1):
                for name in MIGRATIONS.get(step, []):
                    if not self._number(f"{name}/_manifest"):
                        self._publish(name, 1, [])
                self._create(f"_meta/version/{step:012d}", "")
            if not kept:
                self._create(f"_meta/buckets/{buckets:012d}", "")
        self.buckets = kept or buckets

    def _path(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}")

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def _number(self, rel: str) -> int:
        """The highest number among the files of a folder; 0 for none."""
        p = self._path(rel)
        fs = self._fs(p)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _create(self, rel: str, value: str) -> bool:
        """Write a small file; False if there is one of this name."""
        # complete under a name of its own first: a reader sees all of it or nothing
        final, own = self._path(rel), self._path(f"{rel}.{uuid.uuid4().hex}")
        fs = self._fs(final)
        try:
            out = fs.create(own, False)
            out.write(bytearray(value.encode()))
            out.close()
            if fs.exists(final):
                return False
            return self._move(fs, own, final)
        finally:
            if fs.exists(own):
                fs.delete(own, False)

    def _move(self, fs, own, final) -> bool:
        if fs.getScheme() == "file":  # a rename there replaces what exists, a link does not
            import os

            try:
                os.link(own.toUri().getPath(), final.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return bool(fs.rename(own, final))

    def _parts(self, name: str, number: int) -> list[list]:
        p = self._path(f"{name}/_manifest/{number:012d}")
        stream = self._fs(p).open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, name: str, number: int, parts: list[list]) -> bool:
        return self._create(f"{name}/_manifest/{number:012d}", json.dumps(parts))

    def _current(self, name: str) -> tuple[int, list[list]]:
        while True:
            n = self._number(f"{name}/_manifest")
            try:
                return n, self._parts(name, n) if n else []
            except Exception as x:  # noqa: BLE001
                if "FileNotFound" not in str(x) and "does not exist" not in str(x):
                    raise  # an eraser removed it after a newer one appeared

    def empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[name])

    def _frame(self, name: str, parts: list[list]) -> DataFrame:
        paths = [f"{self.root}/{name}/{d}/_b={b}" for d, b in parts]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.empty(name)

    def read(self, name: str) -> DataFrame:
        """The current rows of a table, none if it was never written."""
        return self._frame(name, self._current(name)[1])

    def _bucket(self, name: str):
        return F.pmod(F.xxhash64(F.coalesce(F.col(BUCKET_KEYS[name]).cast("string"), F.lit(""))), F.lit(self.buckets)).cast("int")

    def _whole(self, name: str, df: DataFrame) -> DataFrame:
        """The table's columns of ``df``, NULL where it has none of that name."""
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.empty(name).schema])

    def _files(self, name: str, df: DataFrame) -> list[list]:
        """Write rows; the parts that hold them."""
        new = f"d-{uuid.uuid4().hex}"
        self._whole(name, df).withColumn("_b", self._bucket(name)).write.partitionBy("_b").parquet(f"{self.root}/{name}/{new}")
        p = self._path(f"{name}/{new}")
        return [[new, int(s.getPath().getName()[3:])] for s in self._fs(p).listStatus(p) if s.getPath().getName().startswith("_b=")]

    def _commit(self, name: str, change: Callable[[list[list]], list[list]], erase: bool) -> None:
        if self.readonly:
            raise ReadOnlyError("the store is read-only")
        while True:
            number, parts = self._current(name)
            after = change(parts)
            if self._publish(name, number + 1, after):
                break
        if erase:
            live = {(d, f"_b={b}") for d, b in after}
            for d in self._names(name):
                for b in self._names(f"{name}/{d}") if d != "_manifest" else ():
                    if (d, b) not in live:
                        self._delete(f"{name}/{d}/{b}")
            for n in self._names(f"{name}/_manifest"):
                if n != f"{number + 1:012d}":
                    self._delete(f"{name}/_manifest/{n}")

    def _names(self, rel: str) -> list[str]:
        p = self._path(rel)
        return [s.getPath().getName() for s in self._fs(p).listStatus(p)]

    def _delete(self, rel: str) -> None:
        p = self._path(rel)
        self._fs(p).delete(p, True)

    def write(self, name: str, df: DataFrame, erase: bool = False) -> None:
        """Replace a table."""
        if self.readonly:
            raise ReadOnlyError("the store is read-only")
        parts = self._files(name, df)
        self._commit(name, lambda _: parts, erase)

    def append(self, name: str, df: DataFrame) -> None:
        """Add rows in files of their own."""
        if self.readonly:
            raise ReadOnlyError("the store is read-only")
        parts = self._files(name, df)
        self._commit(name, lambda old: old + parts, False)

    def merge(self, name: str, df: DataFrame | None, keys: list[str], scope: DataFrame | None = None, erase: bool = False) -> None:
        """Rows of ``df`` replace those whose keys are in ``scope`` (by default in ``df``); NULL keys never match.

        Only buckets that ``scope`` or ``df`` falls in are read and written; with keys that are not
        the table's bucket key all are.
        """
        if self.readonly:
            raise ReadOnlyError("the store is read-only")
        scope = (df if scope is None else scope).select(*keys).distinct()
        touched = None
        if BUCKET_KEYS[name] in keys:
            touched = {r[0] for r in scope.select(self._bucket(name).alias("b")).distinct().collect()}  # at most one row per bucket

        def change(parts: list[list]) -> list[list]:
            hit = [p for p in parts if touched is None or p[1] in touched]
            left = self._frame(name, hit).join(scope, keys, "left_anti")
            new = left if df is None else left.unionByName(self._whole(name, df))
            return [p for p in parts if p not in hit] + self._files(name, new)

        self._commit(name, change, erase)

    def compact(self, name: str, most: int = 8) -> None:
        """Rewrite the buckets that appends have left in more than ``most`` parts."""

        def change(parts: list[list]) -> list[list]:
            count: dict[int, int] = {}
            for _, b in parts:
                count[b] = count.get(b, 0) + 1
            many = [p for p in parts if count[p[1]] > most]
            return [p for p in parts if p not in many] + self._files(name, self._frame(name, many)) if many else parts

        self._commit(name, change, False)
