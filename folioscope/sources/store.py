"""A table of the newest row of each key, in immutable generations that a manifest names.

    store/data/<generation>/      Parquet, written once and never changed
    store/manifests/<version>     JSON: which generations make the table, and what it was built by

A writer first writes a generation and then makes the next manifest, by one rename that fails if that
version exists.  Readers take the newest manifest, so they see one state whole, however long they
read; a writer that dies between the two steps leaves a folder that nothing names.  Changes are
deltas, merged on read, until they outgrow the base; then both become a new base.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compaction import latest_by

FORMAT = 1


class StoreError(RuntimeError):
    """The store cannot be used as it is."""


class OtherFormatError(StoreError):
    """Another version of the library wrote the store: it is to be built again, not guessed at."""


class LostRaceError(StoreError):
    """Another writer made the same version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], *place: str, outgrown: float = 0.5, kept: int = 2) -> None:
        """`place` orders the rows of a key.  Deltas of more than `outgrown` times the base's rows are
        compacted; vacuum() leaves what the `kept` newest manifests name."""
        self.spark, self.path, self.keys, self.place, self.outgrown, self.kept = spark, path.rstrip("/"), keys, place, outgrown, kept
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        root = self._at(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        qualified = self._fs.makeQualified(root)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration())

    # ---------------------------------------------------------------- manifests

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The newest manifest, or that of a version; None if there is none yet."""
        found = self.versions()
        if not found:
            return None
        version = found[-1] if version is None else version
        stream = self._fs.open(self._at(f"{self.path}/manifests/{version}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        held = json.loads(text)
        if held.get("format") != FORMAT:
            raise OtherFormatError(f"{self.path} is of format {held.get('format')}, this library reads {FORMAT}: build it again")
        if held["keys"] != self.keys or held["place"] != list(self.place):
            raise StoreError(f"{self.path} is kept by {held['keys']} and {held['place']}")
        return held | {"version": version}

    def _publish(self, held: dict, version: int) -> None:
        """The one step that changes what readers see."""
        draft = self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(json.dumps(held).encode())
        finally:
            out.close()
        self._fs.mkdirs(self._at(f"{self.path}/manifests"))
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(f"{self.path}/manifests/{version}")), options)
        except Exception as why:
            if "AlreadyExists" in str(why):
                raise LostRaceError(f"version {version} of {self.path} exists") from None
            raise

    # ---------------------------------------------------------------- writing

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        generation = uuid.uuid4().hex
        where = f"{self.path}/data/{generation}"
        rows.write.parquet(where)
        return generation, self.spark.read.schema(rows.schema).parquet(where).count()

    def commit(self, rows: DataFrame, epoch: int | None = None) -> int:
        """Add rows; the version that has them.  A batch of a stream names its epoch and counts once,
        though it may come again."""
        held = self.manifest() or {"format": FORMAT, "keys": self.keys, "place": list(self.place), "base": None, "base_rows": 0, "deltas": [], "delta_rows": 0, "epoch": -1, "schema": rows.schema.jsonValue(), "version": 0}
        version = held.pop("version")
        if epoch is not None and epoch <= held["epoch"]:
            return version
        generation, n = self._write(latest_by(rows, self.keys, *self.place))
        held |= {"deltas": [*held["deltas"], generation], "delta_rows": held["delta_rows"] + n, "epoch": held["epoch"] if epoch is None else epoch}
        if held["delta_rows"] > self.outgrown * held["base_rows"]:
            held = self._compacted(held)
        self._publish(held, version + 1)
        return version + 1

    def _compacted(self, held: dict) -> dict:
        base, n = self._write(self._table(held))
        return held | {"base": base, "base_rows": n, "deltas": [], "delta_rows": 0}

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""
        return lambda batch, epoch: self.commit(batch, epoch) and None

    def vacuum(self) -> list[str]:
        """Remove older manifests, and generations that none of those left names; the latter's names."""
        for old in self.versions()[: -self.kept]:
            self._fs.delete(self._at(f"{self.path}/manifests/{old}"), False)
        named = {g for v in self.versions() for m in (self.manifest(v),) for g in (m["base"], *m["deltas"])}
        there = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/data"))]
        gone = [g for g in there if g not in named]
        for g in gone:
            self._fs.delete(self._at(f"{self.path}/data/{g}"), True)
        return gone

    # ---------------------------------------------------------------- reading

    def _generations(self, held: dict, names: list[str]) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(held["schema"])).parquet(*[f"{self.path}/data/{g}" for g in names])

    def _table(self, held: dict) -> DataFrame:
        if not held["deltas"]:
            return self._generations(held, [held["base"]])
        changed = self._generations(held, held["deltas"])
        if held["base"] is None:
            return latest_by(changed, self.keys, *self.place)
        base = self._generations(held, [held["base"]])
        # Only rows of keys that changed are merged; the base's others pass as they are.
        same = [base[k].eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        touched = changed.select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        still, old = base.join(touched, same, "left_anti"), base.join(touched, same, "left_semi")
        return still.unionByName(latest_by(changed.unionByName(old), self.keys, *self.place))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of its newest manifest, or of a version; None if nothing was written yet."""
        held = self.manifest(version)
        return self._table(held) if held else None
