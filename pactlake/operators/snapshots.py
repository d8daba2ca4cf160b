"""Tables that change by key in whole steps: bucketed snapshots behind a pointer that moves last (K5 to K9).

A table is a folder: `data/<id>/bucket=<k>` holds the rows of one bucket as some merge wrote them, `versions/<n>` is
version n, a list of the folder that each bucket has in it. A merge reads and rewrites only the buckets that its
changes touch, writes the list under a name of its own, and puts it in place by renaming it to the next number, which
fails if another writer was faster; then the merge starts again from the new version. So readers see a whole version,
an interrupted merge leaves the old one, and a repeated task writes into its own attempt's files. `vacuum` deletes what
no kept version names. Folders may be in any store that Hadoop's file systems rename files in atomically.

The driver handles names of buckets (a fixed number) and versions, never rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, ATTEMPTS = 64, 5


class Conflict(RuntimeError):
    """Other writers were faster, each time."""


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    folder: str
    keys: tuple[str, ...]
    schema: str
    buckets: int = BUCKETS

    # ---- files ----

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder.rstrip("/"), *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _names(self, *parts: str) -> list[str]:
        files, path = self._files(), self._path(*parts)
        return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []

    def _put(self, text: str, *parts: str) -> None:
        stream = self._files().create(self._path(*parts), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _get(self, *parts: str) -> str:
        stream = self._files().open(self._path(*parts))
        content = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return content

    # ---- versions ----

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("versions") if n.isdigit()]

    def version(self) -> int:
        """The newest version; 0 for a table without any."""
        return max(self.versions(), default=0)

    def _places(self, version: int) -> dict[int, str]:
        """bucket -> folder."""
        lines = self._get("versions", f"{version:09d}").splitlines() if version else []
        return {int(k): place for k, place in (line.split(" ") for line in lines)}

    def _commit(self, version: int, places: dict[int, str]) -> bool:
        """Whether `places` became version + 1; False if there is one already."""
        draft = f".draft-{uuid.uuid4().hex}"
        self._put("\n".join(f"{k} {place}" for k, place in sorted(places.items())), "versions", draft)
        target = self._path("versions", f"{version + 1:09d}")
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), self._files().getConf())
        renames = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        renames[0] = none
        try:
            context.rename(self._path("versions", draft), target, renames)
            return True
        except Exception as e:
            self._files().delete(self._path("versions", draft), False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    # ---- rows ----

    def _read(self, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder.rstrip('/')}/{p}" for p in places])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        return self._read(sorted(self._places(self.version() if version is None else version).values()))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """rule(old rows, changes) gives the new rows of the buckets that changes (with the keys) touch; the new version.

        The rule sees whole buckets, so rows without a change must be kept by it; it must not move rows to other keys.
        """
        touched = sorted(r["b"] for r in changes.select(self._bucket().alias("b")).distinct().collect())  # at most `buckets`
        for _ in range(ATTEMPTS):
            version = self.version()
            places = self._places(version)
            if not touched:
                return version
            own = f"data/{uuid.uuid4().hex}"
            new = rule(self._read([places[b] for b in touched if b in places]), changes)
            columns = [c.split(" ")[0] for c in self.schema.split(", ")]
            new.select(*columns, self._bucket().alias("bucket")).repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.folder.rstrip('/')}/{own}")
            made = {int(n.split("=")[1]) for n in self._names(*own.split("/")) if n.startswith("bucket=")}
            if made - set(touched):
                raise ValueError("the rule moved rows to buckets that the changes do not touch")
            kept = {b: p for b, p in places.items() if b not in touched}
            if self._commit(version, kept | {b: f"{own}/bucket={b}" for b in made}):
                return version + 1
        raise Conflict(self.folder)

    def upsert(self, rows: DataFrame, order: str, kept: tuple[str, ...] = ()) -> int:
        """Rows replace those with their key, which keep the columns `kept`; the last by `order` of several for a key wins."""

        def rule(old: DataFrame, new: DataFrame) -> DataFrame:
            fields = [c for c in old.columns if c not in self.keys]
            newest = new.groupBy(*self.keys).agg(F.max_by(F.struct(*fields), order).alias("r")).select(*self.keys, "r.*")
            before = old.select(*self.keys, *[F.col(c).alias(f"_{c}") for c in kept])
            merged = newest.join(before, list(self.keys), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in kept}) if kept else newest
            return old.join(newest.select(*self.keys), list(self.keys), "left_anti").unionByName(merged.select(*old.columns))

        return self.merge(rows, rule)

    def set_fields(self, changes: DataFrame, order: str | None = None) -> int:
        """Set the other columns of `changes` in the rows with its keys (a null is set too); keys without a row change nothing.

        Of several changes for a key the last by `order` counts.
        """

        def rule(old: DataFrame, new: DataFrame) -> DataFrame:
            fields = [c for c in new.columns if c not in self.keys]
            last = F.max_by(F.struct(*fields), order) if order else F.first(F.struct(*fields))
            one = new.groupBy(*self.keys).agg(last.alias("_new"), F.lit(True).alias("_hit"))
            joined = old.join(one, list(self.keys), "left")
            return joined.select(*[F.when(F.col("_hit"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns])

        return self.merge(changes, rule)

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions before the last `keep`, and data that no version names; how many folders of data went.

        Not while a merge runs: its data has no version yet.
        """
        versions = self.versions()
        for old in versions[: max(0, len(versions) - keep)]:
            self._files().delete(self._path("versions", f"{old:09d}"), False)
        used = {p for v in self.versions() for p in self._places(v).values()}
        gone = 0
        for data in self._names("data"):
            for name in self._names("data", data):
                if name.startswith("bucket=") and f"data/{data}/{name}" not in used:
                    self._files().delete(self._path("data", data, name), True)
                    gone += 1
            if not any(n.startswith("bucket=") for n in self._names("data", data)):
                self._files().delete(self._path("data", data), True)
        return gone
