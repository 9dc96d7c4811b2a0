"""Tables whose changes show at once: files are added beside the old ones, then a pointer to the new list is put in place.

A table is a folder::

    data/snapshot_write=<name>/...   what one write added, never changed afterwards
    files/<name>                     the list of files that make up one version of a table with keys
    versions/<number>                the pointer: which list (without keys: which writes), the schema, the keys

A write that fails leaves files that no pointer names, so readers go on with the version before. A pointer is put in
place by a rename that does not replace, so of two writers who start from one version the second fails with
:class:`TableChanged` and not the first one's work.

A table with keys is kept in files of disjoint key ranges. Its list has each file's rows, its first and last key, and
the key from which on the file is the owner of all keys up to the next file's. An upsert finds the owners of its
keys, joins and rewrites their files only, and lists the others again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..operators import ingest
from ..operators.ranks import last_at_most

#: Rows in a file of a table with keys; a file that grows beyond is split.
FILE_ROWS = 1_000_000
#: Names that the folders use; a table's columns have others.
OWN_NAMES = ("snapshot_write", "snapshot_range", "_owner", "_path")
#: Files whose first keys are searched together. The key ranges are in a table of one row for each such block.
BLOCK = 1024


class TableChanged(RuntimeError):
    """Another writer published a version first."""


@dataclass(frozen=True)
class Change:
    """What one write did: the files of the version before that it replaced and left, those it added and their rows."""

    version: int
    replaced: int
    left: int
    added: int
    rows: int = 0


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ versions

    def _file_system(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        fs, folder = self._file_system(), self._at("versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def state(self, version: int | None = None) -> dict | None:
        """The pointer of a version, of the newest by default; None if there is no version."""
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return None
        source = self._file_system().open(self._at("versions", f"{version:012d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _publish(self, state: dict) -> None:
        jvm, fs = self.spark._jvm, self._file_system()
        staged, final = self._at("versions", f".staged-{uuid.uuid4().hex}"), self._at("versions", f"{state['version']:012d}")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(staged, final, options)
        except Py4JJavaError as err:
            fs.delete(staged, False)
            if "FileAlreadyExistsException" not in str(err.java_exception.toString()):
                raise
            raise TableChanged(f"{self.path}: version {state['version']} was published by another writer") from err

    def _list(self, rows: list[tuple], keys: StructType) -> str:
        """Writes the list of a table with keys: path, rows, low (null for the first), first and last."""
        name = uuid.uuid4().hex
        fields = [StructField("place", IntegerType()), StructField("path", StringType()), StructField("rows", LongType())]
        fields += [StructField(c, keys) for c in ("low", "first", "last")]
        numbered = [(i, *r) for i, r in enumerate(rows)]
        self.spark.createDataFrame(numbered, StructType(fields)).coalesce(1).write.parquet(f"{self.path}/files/{name}")
        return name

    def files(self, version: int | None = None) -> list[Row]:
        """The files of a version by key, or its whole writes; as long as the list that Spark's reader needs on the driver."""
        state = self.state(version)
        if state is None:
            return []
        if not state["keys"]:
            return [Row(path=path, rows=rows) for path, rows in state["writes"]]
        return self.spark.read.parquet(f"{self.path}/files/{state['files']}").orderBy("place").collect()

    # ------------------------------------------------------------ reading

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        if state is None:
            raise FileNotFoundError(f"{self.path}: no version has been published")
        return self._rows([r.path for r in self.files(state["version"])], state)

    def _rows(self, paths: Iterable[str], state: dict, extra: Iterable[Column] = ()) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.path}/data/{p}" for p in paths]
        if not paths:
            return self.spark.createDataFrame([], schema).select("*", *extra)
        found = self.spark.read.option("basePath", f"{self.path}/data").schema(schema).parquet(*paths)
        return found.select(*[F.col(f"`{c}`") for c in schema.names], *extra)

    # ------------------------------------------------------------ writing

    def overwrite(
        self,
        df: DataFrame,
        keys: Iterable[str] = (),
        partition_by: Iterable[str] = (),
        expected: int | None = None,
        file_rows: int = FILE_ROWS,
    ) -> Change:
        """A version that holds the rows of ``df`` alone.

        With ``keys`` the table takes upserts; each key may then occur in one row (rows whose key has a null are never
        matched and may repeat). A count other than ``expected`` is an error, and nothing is published.
        """
        before = self.state()
        state = {
            "version": before["version"] if before else 0,
            "schema": json.dumps(df.schema.jsonValue()),
            "keys": list(keys),
            "partition_by": list(partition_by),
            "file_rows": file_rows,
            "applied": before["applied"] if before else {},
        }
        if state["keys"] and state["partition_by"]:
            raise ValueError("a table with keys is laid out by its keys")
        if state["keys"]:
            files = [r[1:] for r in self._add_ranges(df.withColumn("_owner", F.lit(0)), state, {0: None})]
        else:
            files = [self._add(df, state["partition_by"])]
        self._expect(files, expected)
        replaced = len(self.files(before["version"])) if before else 0
        return self._commit(state, files, replaced, 0, files)

    def append(self, df: DataFrame, partition_by: Iterable[str] = (), expected: int | None = None, tries: int = 5) -> Change:
        """A version with the rows of ``df`` added to a table without keys; the rows are written once, and listed
        again if another writer was first."""
        state = self.state()
        if state is None:
            return self.overwrite(df, (), partition_by, expected)
        if state["keys"]:
            raise ValueError(f"{self.path}: a table with keys takes upserts")
        added = self._add(df, state["partition_by"])
        self._expect([added], expected)
        for turn in range(tries):
            state = self.state()
            before = [(r.path, r.rows) for r in self.files(state["version"])]
            try:
                return self._commit(state, [*before, added], 0, len(before), [added])
            except TableChanged:
                if turn == tries - 1:
                    raise
        raise AssertionError

    def _add(self, df: DataFrame, partition_by: list[str], counted: bool = True) -> tuple[str, int]:
        _refuse_own_names(df)
        name = f"snapshot_write=w{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/data/{name}")
        return name, self.spark.read.schema(StructType([])).parquet(f"{self.path}/data/{name}").count() if counted else 0

    def _expect(self, files: list[tuple], expected: int | None) -> None:
        found = sum(r[1] for r in files)
        if expected is not None and found != expected:
            raise RuntimeError(f"{self.path}: expected {expected} rows, found {found}")

    def _add_ranges(self, rows: DataFrame, state: dict, lows: dict[int, object]) -> list[tuple]:
        """Writes rows by (_owner, key), each file within one owner's range; the new files in order, behind their owner.

        Ranges of (_owner, key) are dealt to tasks, so that an owner that gets most of the rows is written by many.
        """
        _refuse_own_names(rows.drop("_owner"))
        keys, name = state["keys"], f"snapshot_write=w{uuid.uuid4().hex}"
        ordered = rows.repartitionByRange("_owner", *keys).sortWithinPartitions("_owner", *keys)
        folder = f"{self.path}/data/{name}"
        writer = ordered.withColumnRenamed("_owner", "snapshot_range").write.partitionBy("snapshot_range")
        writer.option("maxRecordsPerFile", state["file_rows"]).parquet(folder)
        written = self.spark.read.schema(rows.drop("_owner").schema).parquet(folder)
        if "snapshot_range" not in written.columns:  # no rows, no file
            return []
        key = F.struct(*keys)
        found = written.groupBy(F.col("snapshot_range").alias("owner"), F.col("_metadata.file_name").alias("file")).agg(
            F.count("*").alias("rows"), F.min(key).alias("first"), F.max(key).alias("last")
        )
        out, last, seen = [], None, set()
        for r in found.orderBy("owner", "first", "last").collect():
            if last is not None and last == r.first and None not in last:
                raise ValueError(f"{self.path}: the key {tuple(last)} occurs twice")
            low = r.first if r.owner in seen else lows[r.owner]
            seen.add(r.owner)
            out.append((r.owner, f"{name}/snapshot_range={r.owner}/{r.file}", r.rows, low, r.first, r.last))
            last = r.last
        return out

    def _commit(
        self, state: dict, files: list[tuple], replaced: int, left: int, added: list[tuple], applied: dict | None = None
    ) -> Change:
        schema = StructType.fromJson(json.loads(state["schema"]))
        keys = StructType([StructField(k, schema[k].dataType) for k in state["keys"]])
        version = state["version"] + 1
        self._publish(
            state
            | {
                "version": version,
                "files": self._list(files, keys) if state["keys"] else None,
                "writes": None if state["keys"] else files,
                "applied": state["applied"] | (applied or {}),
            }
        )
        return Change(version, replaced, left, len(added), sum(r[1] for r in added))

    # ------------------------------------------------------------ upserts

    def _owners(self, rows: DataFrame, files: list, keys: list[str]) -> DataFrame:
        """Adds ``_owner``, the place of the file that owns the row's key: the last one whose low is not above it."""
        if len(files) < 2:
            return rows.withColumn("_owner", F.lit(0))
        key = F.struct(*keys)
        kind = StructType([StructField(k, rows.schema[k].dataType) for k in keys])
        starts = range(0, len(files), BLOCK)
        blocks = self.spark.createDataFrame(
            [(b, b * BLOCK, [r.low for r in files[a : a + BLOCK]]) for b, a in enumerate(starts)],
            f"_block int, _start int, _lows array<{kind.simpleString()}>",
        )
        # one literal for each 1,024 files
        cuts = [F.struct(*[F.lit(files[a].low[k]).cast(kind[k].dataType).alias(k) for k in keys]) for a in starts[1:]]
        block = F.lit(0) if not cuts else F.aggregate(F.array(*cuts), F.lit(0), lambda n, c: n + (c <= key).cast("int"))
        found = rows.withColumn("_block", block).join(blocks, "_block")
        return found.withColumn("_owner", F.col("_start") + last_at_most(F.col("_lows"), key, BLOCK)).drop(
            "_block", "_start", "_lows"
        )

    def upsert(self, batch: DataFrame, order: str = "row_no", applied: dict[str, int] | None = None) -> Change:
        """Rows of ``batch`` inserted or written over those of the same key, by the rules of ``ingest.upsert``.

        Only the files that own one of the batch's keys are read and written again; a batch without a usable key
        publishes nothing. ``applied`` names a source and the number of its batch: a number not above the one that the
        newest version has for that source was published before and changes nothing.
        """
        state = self.state()
        if state is None or not state["keys"]:
            raise ValueError(f"{self.path}: not a table with keys")
        if applied and all(state["applied"].get(k, -1) >= v for k, v in applied.items()):
            return Change(state["version"], 0, len(self.files(state["version"])), 0)
        keys, files = state["keys"], self.files(state["version"])
        last = ingest.last_per_key(batch.dropna(subset=keys), keys, order).drop(order)
        schema = StructType.fromJson(json.loads(state["schema"]))
        typed = last.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in last.columns if c in schema.names])
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        self._owners(typed, files, keys).write.parquet(staged)
        rows = self.spark.read.schema(StructType([*typed.schema, StructField("_owner", IntegerType())])).parquet(staged)
        touched = sorted(r[0] for r in rows.select("_owner").distinct().collect())  # at most a number for each file
        if not touched:
            return Change(state["version"], 0, len(files), 0)
        replaced = [files[i] for i in touched] if files else []
        folders = [F.concat(F.lit(f"{c}="), F.col(c)) for c in ("snapshot_write", "snapshot_range")]
        at = F.concat_ws("/", *folders, F.col("_metadata.file_name")) if replaced else F.lit("")
        owners = self.spark.createDataFrame([(r.path, r.place) for r in replaced], "_path string, _owner int")
        target = self._rows([r.path for r in replaced], state, [at.alias("_path")]).join(owners, "_path").drop("_path")
        # a key has one owner, so matching both changes nothing and keeps the owner
        merged = ingest.merge_rows(target, rows, [*keys, "_owner"])
        by_owner: dict[int, list[tuple]] = {}
        for owner, *entry in self._add_ranges(merged, state, {i: files[i].low if files else None for i in touched}):
            by_owner.setdefault(owner, []).append(tuple(entry))
        listed: list[tuple] = [] if files else by_owner[0]
        for f in files:
            listed += by_owner.get(f.place, [(f.path, f.rows, f.low, f.first, f.last)])
        added = [entry for entries in by_owner.values() for entry in entries]
        return self._commit(state, listed, len(replaced), len(files) - len(replaced), added, applied)

    # ------------------------------------------------------------ clean-up

    def expire(self, keep: int = 1) -> int:
        """Forget all but the newest ``keep`` versions and delete the files that only they used; the number deleted."""
        known = self.versions()
        kept, gone = known[-keep:], known[:-keep]
        if not gone:
            return 0
        needed = {r.path for v in kept for r in self.files(v)}
        old = {r.path for v in gone for r in self.files(v)} - needed
        fs = self._file_system()
        for v in gone:
            name = self.state(v)["files"]
            fs.delete(self._at("versions", f"{v:012d}"), False)
            if name:
                fs.delete(self._at("files", name), True)
        for path in old:
            fs.delete(self._at("data", path), True)
        return len(old)


def _refuse_own_names(df: DataFrame) -> None:
    taken = [c for c in df.columns if c in OWN_NAMES]
    if taken:
        raise ValueError(f"columns of these names cannot be stored: {', '.join(taken)}")
