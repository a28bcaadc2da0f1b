"""Upserts without MERGE: last or first write wins, set-union merges, versioned Parquet."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*[c.desc() for c in order]))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def upsert(current: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """current with new's rows in place of those of the same key; of equal keys in new, the last."""
    both = current.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, key, [F.col("__new"), *order]).drop("__new")


def replaced(current: DataFrame, links: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch that replaces rows of the same key: (rows, links, changes).

    current: raw_id, key, ...; links: raw_id, ...; new: seq, key, ... with seq numbers beyond all raw_id. The last row of a key in the batch is written with its
    seq as its raw_id, also where it replaces a row, whose links go with it: they are dependants of the old id, so that the record is structured again.
    changes: key, kind (insert or replace), raw_id, old_id, links (how many have gone). One union and one aggregate by key find all of it.
    """
    fields = [c for c in current.columns if c not in ("raw_id", *key)]
    old = current.select(*key, F.struct(F.lit(0).alias("new"), F.col("raw_id").alias("id"), *fields).alias("r"))
    both = old.unionByName(new.select(*key, F.struct(F.lit(1).alias("new"), F.col("seq").alias("id"), *fields).alias("r")))
    is_new = F.col("r.new") == 1
    last = both.groupBy(*key).agg(F.max_by("r", F.struct("r.new", "r.id")).alias("last"), F.max(F.when(~is_new, F.col("r.id"))).alias("old_id"), F.max(is_new).alias("touched"))
    rows = last.select(F.col("last.id").alias("raw_id"), *key, *[F.col(f"last.{c}").alias(c) for c in fields])
    changes = last.where("touched").select(*key, F.when(F.col("old_id").isNull(), "insert").otherwise("replace").alias("kind"), F.col("last.id").alias("raw_id"), "old_id")
    gone = changes.where("old_id is not null").select(F.col("old_id").alias("raw_id"))
    kept = links.join(gone, "raw_id", "left_anti")
    per = links.join(gone, "raw_id", "left_semi").groupBy(F.col("raw_id").alias("old_id")).agg(F.count("*").alias("links"))
    return rows, kept, changes.join(per, "old_id", "left").withColumn("links", F.coalesce("links", F.lit(0)).cast("bigint"))


def first_wins(current: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """current and the first of new's rows for each key that it has not."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    added = new.withColumn("__nth", nth).where("__nth = 1").drop("__nth").join(current.select(*key).distinct(), key, "left_anti")
    return current.unionByName(added, allowMissingColumns=True)


def merge_venues(current: DataFrame, found: DataFrame) -> DataFrame:
    """(name, ids, years, first_year, last_year): unions of both sides' ids and years, years latest first."""
    a = current.select("name", F.col("ids").alias("ids_a"), F.col("years").alias("years_a"))
    b = found.select("name", F.col("ids").alias("ids_b"), F.col("years").alias("years_b"))
    both = a.join(b, "name", "full_outer")
    union = lambda x, y, kind: F.array_union(F.coalesce(x, F.array().cast(kind)), F.coalesce(y, F.array().cast(kind)))
    ids, years = union(F.col("ids_a"), F.col("ids_b"), "array<string>"), union(F.col("years_a"), F.col("years_b"), "array<int>")
    return both.select("name", F.sort_array(ids).alias("ids"), F.sort_array(years, asc=False).alias("years")).withColumns({"first_year": F.array_min("years"), "last_year": F.array_max("years")})


def without_method(pk: DataFrame, method: str) -> DataFrame:
    return pk.where(~F.col("method").eqNullSafe(F.lit(method)))


def evolve(rows: DataFrame, renames: dict[str, str], schema) -> DataFrame:
    """rows with renamed columns, in the order and types of the schema; columns that are missing are NULL."""
    for old, new in renames.items():
        rows = rows.withColumnRenamed(old, new)
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


class Conflict(RuntimeError):
    """Another writer has committed this version."""


#: As many runs of one size are merged into one of the next.
RUNS = 4


class Table:
    """A Parquet table with versions: a version is a list of runs, folders of rows, which a file that a rename never overwrites makes visible.

    An upsert writes its own rows alone, as a new run; RUNS runs of one size are merged into one, so that a row is written again as often as the table grows
    RUNS-fold. Readers see whole versions only, of each key the row of the latest run. Of two writers that started from one version the later to commit gets
    a Conflict, and nothing of it is seen.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        option = jvm.org.apache.hadoop.fs.Options.Rename
        self._once = spark.sparkContext._gateway.new_array(option, 1)
        self._once[0] = getattr(option, "NONE")

    def version(self) -> int:
        """The latest version; 0 if nothing was written."""
        at = self._path(f"{self.root}/_versions")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def exists(self) -> bool:
        return self.version() > 0

    def state(self, version: int | None = None) -> dict:
        """What a version holds: `key`, or None where rows have none, and `runs` from the oldest on, each a folder and how often it was merged."""
        version = self.version() if version is None else version
        if not version:
            return {"key": None, "runs": []}
        stream = self._fs.open(self._path(f"{self.root}/_versions/{version:012d}"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        if not state["runs"]:
            raise FileNotFoundError(f"{self.root} has no version")
        return self._merged(state["runs"], state["key"])

    def write(self, rows: DataFrame, partition_by: list[str] | None = None, base: int | None = None) -> int:
        """Makes rows the version after `base`, by default the latest when the write began; returns it."""
        base = self.version() if base is None else base
        return self._commit({"key": None, "runs": [[self._run(rows, partition_by), 0]]}, base)

    def upsert(self, new: DataFrame, key: list[str], order: list[Column]) -> int:
        """new's rows in place of those of the same key; of equal keys in new, the last. The first upsert of a table that was written under no key, or another, writes it anew."""
        base = self.version()
        state = self.state(base)
        runs = state["runs"]
        if runs and state["key"] != key:
            return self._commit({"key": key, "runs": [[self._run(upsert(self._merged(runs, state["key"]), new, key, order)), 0]]}, base)
        runs = [*runs, [self._run(last_wins(new, key, order)), 0]]
        while len(runs) >= RUNS and len({merged for _, merged in runs[-RUNS:]}) == 1:
            runs[-RUNS:] = [[self._run(self._merged(runs[-RUNS:], key)), runs[-1][1] + 1]]
        return self._commit({"key": key, "runs": runs}, base)

    def _merged(self, runs: list, key: list[str] | None) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.root}/{name}") for name, _ in runs]
        if len(parts) == 1:
            return parts[0]
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("__run", F.lit(i)) for i, p in enumerate(parts)])
        return last_wins(both, key, [F.col("__run")]).drop("__run")

    def _run(self, rows: DataFrame, partition_by: list[str] | None = None) -> str:
        name = f"v-{uuid.uuid4().hex}"
        (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(f"{self.root}/{name}")
        return name

    def _commit(self, state: dict, base: int) -> int:
        draft, final = (self._path(f"{self.root}/_versions/{x}") for x in (f"_{uuid.uuid4().hex}", f"{base + 1:012d}"))
        stream = self._fs.create(draft, False)
        stream.writeUTF(json.dumps(state))
        stream.close()
        try:
            self._files.rename(draft, final, self._once)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise Conflict(f"version {base + 1} is there already") from e
            raise
        return base + 1
