"""Keyed tables: one row per key, changed by merges, read as whole snapshots.

The rows of a table are dealt to a fixed number of buckets by a hash of the key, so buckets are even
whatever the keys are. A merge reads only the buckets its rows fall in and writes only those in which a
row is new or different; then it publishes a snapshot, a small file that names the folder of every
bucket. Readers take the newest published snapshot, so they never see half a merge. A
merge that fails leaves folders nobody names, and one that runs again changes nothing. Two
merges at once cannot both publish: the second one fails and is run again. Folders that no kept snapshot names go with `expire`.

Key columns may be NULL (equal to NULL). Choose the number of buckets so that one of them is a
comfortable task: rows / buckets of a few million.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from holdwright.sources.store import Store


@dataclass(frozen=True)
class Merge:
    """What a merge did: the snapshot readers see now, and the buckets it read and wrote."""

    snapshot: int
    read: list[int]
    written: list[int]


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], buckets: int = 16):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, list(keys), buckets

    # --- files -----------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _names(self, *parts: str) -> list[str]:
        place = self._path(*parts)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []

    def _bucket_folders(self, *parts: str) -> list[int]:
        return sorted(int(n.removeprefix("bucket=")) for n in self._names(*parts) if n.startswith("bucket="))

    def snapshots(self) -> list[int]:
        return sorted(int(n) for n in self._names("snapshots") if n.isdigit())

    def _folders(self, snapshot: int | None = None) -> dict[int, str]:
        """Folder of every bucket that has rows."""
        known = self.snapshots()
        if not known:
            return {}
        place = self._path("snapshots", str(known[-1] if snapshot is None else snapshot))
        stream = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): folder for b, folder in (line.split(" ", 1) for line in text.splitlines())}

    def _publish(self, folders: dict[int, str], snapshot: int) -> None:
        draft, final = self._path("snapshots", f"draft-{uuid.uuid4().hex}"), self._path("snapshots", str(snapshot))
        files = draft.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(draft, False)
        out.write(bytearray("".join(f"{b} {folders[b]}\n" for b in sorted(folders)).encode()))
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise RuntimeError(f"snapshot {snapshot} of {self.root} was published meanwhile; run the merge again")

    # --- reading ---------------------------------------------------------------

    def _read(self, folders: dict[int, str], only: Sequence[int] | None = None) -> DataFrame:
        """Rows of the given buckets with their bucket number."""
        paths = [f"{self.root}/{folders[b]}/bucket={b}" for b in sorted(folders if only is None else set(only) & set(folders))]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return rows.withColumn("bucket", self._bucket())

    def rows(self, snapshot: int | None = None) -> DataFrame:
        return self._read(self._folders(snapshot)).drop("bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # --- writing ---------------------------------------------------------------

    def _on(self, left: DataFrame, right: DataFrame) -> Column:
        on = left["bucket"] == right["bucket"]
        for k in self.keys:
            on = on & left[k].eqNullSafe(right[k])
        return on

    def _written(self, df: DataFrame, *parts: str) -> list[int]:
        """Write rows by bucket and tell which buckets got any."""
        df.select(*self.schema.names, "bucket").repartition("bucket").write.partitionBy("bucket").parquet("/".join((self.root, *parts)))
        return self._bucket_folders(*parts)

    def merge(self, rows: DataFrame, latest: Sequence[str] = ()) -> Merge:
        """Insert the rows of new keys and replace those of known ones.

        Several rows of one key: the last by `latest` counts, then the last by all columns.
        """
        snapshot, mine = (self.snapshots() or [0])[-1], f"m-{uuid.uuid4().hex}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        rest = [c for c in self.schema.names if c not in {*self.keys, *latest}]
        one = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest, *latest), F.struct(*latest, *rest)).alias("kept")) if rest or latest else rows.distinct()
        one = one.select(*self.keys, "kept.*") if rest or latest else one
        touched = self._written(one.withColumn("bucket", self._bucket()), "staged", mine)
        folders = self._folders(snapshot) if snapshot else {}
        arrived = self._read({b: f"staged/{mine}" for b in touched})
        current = self._read(folders, touched)
        old = current.select("bucket", *self.schema.names, F.lit(True).alias("is_known")).alias("old")
        both = arrived.join(old, self._on(arrived, current), "left")
        differs = ~F.coalesce(F.col("old.is_known"), F.lit(False))
        for c in rest + list(latest):
            differs = differs | ~arrived[c].eqNullSafe(F.col(f"old.{c}"))
        changed = self._written(both.where(differs).select(*[arrived[c] for c in self.schema.names], arrived["bucket"]), "changes", mine)
        if not changed:
            self._drop("staged", mine)
            self._drop("changes", mine)
            return Merge(snapshot, touched, [])
        new = self._read({b: f"changes/{mine}" for b in changed})
        kept = self._read(folders, changed)
        self._written(kept.join(new, self._on(kept, new), "left_anti").unionByName(new), "data", mine)
        self._publish({**folders, **{b: f"data/{mine}" for b in changed}}, snapshot + 1)
        self._drop("staged", mine)
        self._drop("changes", mine)
        return Merge(snapshot + 1, touched, changed)

    def _drop(self, *parts: str) -> None:
        place = self._path(*parts)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def expire(self, keep: int = 2) -> None:
        """Remove all but the newest snapshots, and the folders none of these names."""
        known = self.snapshots()
        named = {folder for s in known[-keep:] for folder in self._folders(s).values()}
        for s in known[:-keep]:
            self._drop("snapshots", str(s))
        for name in self._names("data"):
            if f"data/{name}" not in named:
                self._drop("data", name)


def keyed(store: Store, name: str, schema: T.StructType, keys: Sequence[str], buckets: int = 16) -> KeyedTable:
    """A keyed table among the tables of a store."""
    return KeyedTable(store.spark, store.path(name), schema, keys, buckets)
