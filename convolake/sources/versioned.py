"""A table of Parquet files that changes by copy-on-write.

Below the table's folder, ``data/<id>/`` holds the files of one change, and
``versions/<n>`` names the files that make up version n, one path a line.  A
change finds the files that hold one of its keys, rewrites these alone, and then
publishes the next version by renaming its list into place.  Until then readers
see the old version; a change that dies before leaves files that no version
names.  Of two changes of one version, the second fails instead of undoing the
first.  The folder must be on a file system whose rename does not overwrite.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convolake.operators import changes as CH


class ConflictError(RuntimeError):
    """Another change has published the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions -----------------------------------------------------------

    def version(self) -> int:
        """The newest published version; 0 before the first."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def files(self, version: int | None = None) -> list[str]:
        """Paths of a version's files, relative to the folder."""
        version = self.version() if version is None else version
        if version == 0:
            return []
        stream = self._fs.open(self._path(f"{self.path}/versions/{version:010d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text.split("\n") if text else []

    def read(self, version: int | None = None) -> DataFrame:
        files = self.files(version)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files])

    def _publish(self, version: int, files: Sequence[str]) -> int:
        draft, final = (self._path(f"{self.path}/versions/{n}") for n in (f"_{uuid.uuid4().hex}", f"{version:010d}"))
        out = self._fs.create(draft, False)
        out.write(bytearray("\n".join(sorted(files)).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConflictError(f"version {version} of {self.path} was published by another change")
        return version

    def _write(self, rows: DataFrame) -> list[str]:
        """Files of ``rows``, not part of any version yet."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.parquet(f"{self.path}/{folder}")
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}")))
        return [f"{folder}/{n}" for n in names if n.endswith(".parquet")]

    # --- changes ------------------------------------------------------------

    def append(self, rows: DataFrame) -> int:
        version = self.version()
        return self._publish(version + 1, [*self.files(version), *self._write(rows)])

    def touched(self, keys: DataFrame, key: str, version: int) -> list[str]:
        """Files of a version that hold one of the keys.  Only the key column is
        read, where footers allow it between the least and the greatest key;
        Spark adds its own Bloom filter of the keys when the join is large."""
        files = self.files(version)
        if not files:
            return []
        low, high = keys.agg(F.min(key), F.max(key)).first()
        if low is None:
            return []
        held = self.read(version).select(key, F.col("_metadata.file_path").alias("__file")).where(F.col(key).between(low, high))
        found = {r[0] for r in held.join(keys.select(key).distinct(), key, "left_semi").select("__file").distinct().toLocalIterator()}
        ends = {"/".join(path.split("/")[-3:]) for path in found}  # data/<id>/<name>
        return [f for f in files if f in ends]

    def _change(self, keys: DataFrame, key: str, rewrite: Callable[[DataFrame], DataFrame]) -> int:
        version = self.version()
        old = self.touched(keys, key, version)
        base = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in old]) if old else self.spark.createDataFrame([], self.schema)
        new = self._write(rewrite(base))
        return self._publish(version + 1, [*(set(self.files(version)) - set(old)), *new])

    def upsert(self, new: DataFrame, key: str, reset: Sequence[str] = (), order: Sequence[str] = ()) -> int:
        """Op 77 on the table; of several rows of a key the last by ``order``."""
        new = CH.one_per_key(new, [key], order).drop(*[o for o in order if o not in self.schema.names])
        return self._change(new, key, lambda base: CH.upsert_rows(base, new, key, reset))

    def patch(self, patches: DataFrame, key: str, allowed: Sequence[str], as_of, order: Sequence[str] = (), updated_col: str = "updated_at") -> int:
        """Op 78 on the table."""
        return self._change(patches, key, lambda base: CH.patch_rows(base, patches, key, allowed, as_of, updated_col, order))

    def replace(self, rows: DataFrame, key: str, value) -> int:
        """``rows`` in place of those whose ``key`` is ``value``."""
        one = self.spark.range(1).select(F.lit(value).alias(key))
        return self._change(one, key, lambda base: base.where(~F.col(key).eqNullSafe(F.lit(value))).unionByName(rows))

    def delete(self, ids: DataFrame, key: str) -> int:
        """Hard delete of op 79 on the table."""
        return self._change(ids, key, lambda base: base.join(ids.select(key).distinct(), key, "left_anti"))
