"""Size-tiered compaction of append-only shards under an atomically committed, versioned manifest.

Arrivals are appended as small immutable Parquet shards. Compaction sorts the small shards into tiers by
size (each tier `fanout` times the one below) and merges each tier of at least `fanout` shards into files
of about the target size, by reading its files into as many partitions as it needs files: no row is
shuffled, and no key can be hot. A version is a manifest table (Parquet) and a pointer file, which a rename
that never overwrites makes visible: of two concurrent commits of one version, one fails and the store
stays as the other left it. Readers see whole versions only; old shards stay until expire().

What reaches the driver is one line a shard (path, bytes, rows), not rows of data. The target bounds the lines: at
512 MB a shard, 100 TB are 200,000.

A version has a schema, the union of its shards' columns. A later arrival may bring new columns and leave out old ones: nothing
that was written is lost by a merge, and rows that lack a column have NULL there. One that has a column of the same name
with another type (names are compared without case, as Spark resolves them) is refused before anything is written.

Defined results: NULLs in any column, empty and long texts, repeated rows and rows of equal key are kept as they
are; an empty append commits a version with no new shard; a store of no rows, and one that nothing was appended to, reads
as an empty table of its schema; all columns are kept whatever their names.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from quernstone.llm._common import free_name

MANIFEST = "path string, bytes bigint, rows bigint, tier int, since bigint"


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class SchemaConflict(ValueError):
    """A column has another type than the store's column of that name."""


def nullable(kind: DataType) -> DataType:
    """The type with NULLs allowed throughout: what Parquet files are read as."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType), True) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType), True)
    return MapType(nullable(kind.keyType), nullable(kind.valueType), True) if isinstance(kind, MapType) else kind


def merged_schema(old: StructType, new: StructType) -> StructType:
    """old's columns, then those that only new has."""
    known = {f.name.lower(): f.dataType for f in old}
    for f in new:
        if known.get(f.name.lower(), nullable(f.dataType)) != nullable(f.dataType):
            raise SchemaConflict(f"{f.name} is {f.dataType.simpleString()}, the store has {known[f.name.lower()].simpleString()}")
    return StructType([*old.fields, *[StructField(f.name, nullable(f.dataType), True) for f in new if f.name.lower() not in known]])


class ShardStore:
    """A table of immutable shards under root.

    target_bytes: size of a merged file. fanout: shards that a tier needs to be merged, and the ratio of
    sizes between tiers. base_bytes: upper bound of the lowest tier. arrival_rows: rows of an arriving
    shard at most.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, base_bytes: int = 1 << 20, arrival_rows: int = 4096):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.base_bytes, self.arrival_rows = target_bytes, fanout, base_bytes, arrival_rows
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        option = jvm.org.apache.hadoop.fs.Options.Rename
        self._once = spark.sparkContext._gateway.new_array(option, 1)
        self._once[0] = getattr(option, "NONE")

    # ------------------------------------------------------------ versions

    def version(self) -> int:
        """The latest committed version; 0 if there is none."""
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return 0
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(at) if x.getPath().getName().isdigit()), default=0)

    def _pointer(self, version: int) -> dict:
        """{"manifest": folder, "schema": JSON} of a version."""
        stream = self._fs.open(self._path(f"{self.root}/versions/{version:012d}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def schema(self, version: int | None = None) -> StructType:
        version = self.version() if version is None else version
        return StructType.fromJson(self._pointer(version)["schema"]) if version else StructType()

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, rows, tier, since) of the shards of a version; the latest by default."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{self._pointer(version)['manifest']}")

    def _commit(self, base: int, shards: list[tuple], schema: StructType | None = None) -> int:
        """Makes base + 1 of these shards, with base's schema or a new one, unless another writer has."""
        schema = schema or self.schema(base)
        name = f"manifest/{uuid.uuid4().hex}"
        self.spark.createDataFrame(shards, MANIFEST).coalesce(1).write.parquet(f"{self.root}/{name}")
        draft, final = (self._path(f"{self.root}/versions/{x}") for x in (f"_{uuid.uuid4().hex}", f"{base + 1:012d}"))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        stream.close()
        try:
            self._context.rename(draft, final, self._once)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise CommitConflict(f"version {base + 1} is there already") from e
            raise
        return base + 1

    # ------------------------------------------------------------ shards

    def tier(self, size: int) -> int:
        return 0 if size <= self.base_bytes else math.ceil(math.log(size / self.base_bytes, self.fanout))

    def _written(self, folder: str, since: int) -> list[tuple]:
        """A manifest line for each file of a folder; row counts come from Parquet footers."""
        files = self.spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        found = files.groupBy("path", "bytes").agg(F.count("*").alias("rows")).collect()
        return [(r["path"], r["bytes"], r["rows"], self.tier(r["bytes"]), since) for r in sorted(found)]

    def append(self, rows: DataFrame) -> int:
        """Writes rows as small shards and commits them; returns the version."""
        base = self.version()
        schema = merged_schema(self.schema(base), rows.schema)
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", self.arrival_rows).option("compression", "zstd").parquet(folder)
        kept = [tuple(r) for r in self.manifest(base).collect()]
        return self._commit(base, kept + self._written(folder, base + 1), schema)

    def append_each(self, rows: DataFrame, arrivals: int, key: str, each=None) -> int:
        """Takes rows in as `arrivals` arrivals, dealt by a hash of the key column: one job writes the shards of all, and each arrival is a commit of its own.

        each: called after every commit, as by a compactor that runs beside the writers. Arrivals without rows commit nothing, but no rows at all are one
        empty arrival; returns the version.
        """
        base = self.version()
        schema = merged_schema(self.schema(base), rows.schema)
        name = free_name("arrival", rows.columns)
        folder = f"{self.root}/data/a-{uuid.uuid4().hex}"
        dealt = rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(arrivals)))
        dealt.write.option("maxRecordsPerFile", self.arrival_rows).option("compression", "zstd").partitionBy(name).parquet(folder)
        if not any(x.isDirectory() for x in self._fs.listStatus(self._path(folder))):
            return self.append(rows)
        of: dict[str, list[tuple]] = {}
        for path, size, n, tier, _ in self._written(folder, base):
            of.setdefault(path.rsplit("/", 2)[1], []).append((path, size, n, tier))
        for _, shards in sorted(of.items()):
            base = self.version()
            kept = [tuple(r) for r in self.manifest(base).collect()]
            self._commit(base, kept + [(*s, base + 1) for s in shards], schema)
            if each is not None:
                each()
        return self.version()

    def plan(self, shards: list[tuple]) -> list[list[tuple]]:
        """The runs to merge: shards of one tier below half the target, if they are at least fanout or fill a target.

        A merge of a few shards of a low tier makes one of a higher tier, which a later round merges with its like.
        """
        tiers: dict[int, list[tuple]] = {}
        for s in shards:
            if 2 * s[1] <= self.target_bytes:
                tiers.setdefault(s[3], []).append(s)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fanout or sum(s[1] for s in run) >= self.target_bytes and len(run) > 1]

    def compact(self) -> int:
        """Merges one round of runs and commits the result; returns the version, unchanged if there is nothing to merge.

        All runs are written by one job; a row count that differs from the manifest's ends it without a commit.
        """
        base = self.version()
        shards = [tuple(r) for r in self.manifest(base).collect()]
        runs = self.plan(shards)
        if not runs:
            return base
        schema = self.schema(base)
        merged = None
        for run in runs:
            files = max(1, round(sum(s[1] for s in run) / self.target_bytes))
            part = self.spark.read.schema(schema).parquet(*[s[0] for s in run]).coalesce(files)
            merged = part if merged is None else merged.unionByName(part)
        folder = f"{self.root}/data/m-{uuid.uuid4().hex}"
        merged.write.option("compression", "zstd").parquet(folder)
        new = self._written(folder, base + 1)
        gone = {s[0] for run in runs for s in run}
        if sum(s[2] for s in new) != sum(s[2] for run in runs for s in run):
            raise RuntimeError("a merge has other rows than its shards; nothing is committed")
        return self._commit(base, [s for s in shards if s[0] not in gone] + new, schema)

    def settle(self) -> int:
        """Compacts until no tier asks for it; every round leaves fewer shards, or shards of a higher tier, so that it ends."""
        version = None
        while version != (version := self.compact()):
            pass
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the version's columns."""
        version = self.version() if version is None else version
        schema, paths = self.schema(version), [r["path"] for r in self.manifest(version).select("path").collect()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def expire(self, keep: int = 1) -> int:
        """Deletes the shards that only versions before the latest `keep` have; returns how many."""
        last = self.version()
        live = {r["path"] for v in range(max(1, last - keep + 1), last + 1) for r in self.manifest(v).select("path").collect()}
        old = {r["path"] for v in range(1, last - keep + 1) if self._fs.exists(self._path(f"{self.root}/versions/{v:012d}")) for r in self.manifest(v).select("path").collect()}
        for path in sorted(old - live):
            self._fs.delete(self._path(path), False)
        for v in range(1, last - keep + 1):
            at = self._path(f"{self.root}/versions/{v:012d}")
            if self._fs.exists(at):
                self._fs.delete(self._path(f"{self.root}/{self._pointer(v)['manifest']}"), True)
                self._fs.delete(at, False)
        return len(old - live)


#: Arrivals of the query's table, after how many of them the compactor looks, and the size up to which a shard is of the lowest tier there.
ARRIVALS, EVERY, LOWEST = 16, 4, 1 << 16


def round_trip(docs: DataFrame, root: str, **options) -> DataFrame:
    """docs as they come back from a store that has taken them in as ARRIVALS arrivals and was compacted after every EVERY of them and until it settled:
    (doc_id, lang, source, n_bytes, text_sha256, arrivals, merged), merged being whether at least two rounds of merges were committed on the way."""
    store = ShardStore(docs.sparkSession, root, **{"base_bytes": LOWEST} | options)
    commits = rounds = 0

    def compactor() -> None:
        nonlocal commits, rounds
        commits += 1
        if commits % EVERY == 0:
            before = store.version()
            rounds += store.compact() - before
            store.expire()

    store.append_each(docs, ARRIVALS, "doc_id", compactor)
    before = store.version()
    rounds += store.settle() - before
    store.expire()
    rows = store.read()
    said = [F.lit(ARRIVALS).cast("bigint").alias("arrivals"), F.lit(rounds >= 2).alias("merged")]
    return rows.select("doc_id", "lang", "source", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), *said)
