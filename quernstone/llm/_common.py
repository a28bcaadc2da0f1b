"""What the operators of this subpackage share: tables, materialisation, vectorised words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a Python worker holds a few batches at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches so that a batch of very long texts still fits in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets a
    temporary folder that goes with the process; on a cluster an error is raised, as no folder of one machine would do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("quernstone.scratch", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quernstone-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            at = f"file://{folder}"
            spark.conf.set("quernstone.scratch", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_name(name: str, taken: list[str]) -> str:
    """name, lengthened until no column of `taken` has it (names differ by more than case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


def held_out(doc_id: str, n: int, remainder: int) -> Column:
    """True where the remainder is met; a row with a NULL id is not held out."""
    return F.coalesce(crc_mod(doc_id, n) == F.lit(remainder), F.lit(False))


# ---------------------------------------------------------------- words of a batch

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BINV = np.uint64(pow(int(_B), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: ASCII that is neither letter nor digit separates words as well; bytes of other letters stay.
PUNCT = np.ones(256, bool)
PUNCT[ord("0") : ord("9") + 1] = False
PUNCT[ord("A") : ord("Z") + 1] = False
PUNCT[ord("a") : ord("z") + 1] = False
PUNCT[0x80:] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) <= n:
        m = max(n + 1, 1 << 20)
        with np.errstate(over="ignore"):
            _POW = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, _B, np.uint64))])
            _INV = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, _BINV, np.uint64))])
    return _POW, _INV


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and each row's offset; NULL counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20):
    """Ranges of whole rows of about `most` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
    """Start and end byte of each word, and the row that each stands in; no word crosses a row."""
    is_word = ~separators[data]
    n = len(data)
    starts, ends = is_word.copy(), np.zeros(n + 1, bool)
    starts[1:] &= ~is_word[:-1]
    ends[1:n] = is_word[:-1] & ~is_word[1:]
    if n:
        ends[n] = is_word[-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    starts[cut] = is_word[cut]
    ends[cut] = is_word[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return s, e, np.searchsorted(offsets, s, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span of data, from prefix sums of a polynomial modulo 2^64; ASCII case is folded."""
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data] if lower else data).astype(np.uint64) * power[: len(data)] + power[: len(data)], out=prefix[1:])
        return mix64((prefix[ends] - prefix[starts]) * inverse[starts])


# ---------------------------------------------------------------- labelled rows

#: Labelled rows that a classifier is fitted on at most.
SAMPLE = 20_000


def first_by_hash(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """The `most` rows with the smallest hash of their id.

    The rows are counted first: of many, only those below a hash that half as many again are expected under reach the task
    that orders them; else each partition would send it `most` rows. Fewer than `most` lie below it with a probability under 1e-30.
    """
    h, n = F.xxhash64(id_col), rows.count()
    if n > 2 * most:
        rows = rows.where(h < F.lit(-(2**63) + int(2**64 * 1.5 * most / n)))
    return rows.orderBy(h, id_col).limit(most)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE, metadata: tuple[str, ...] = ()) -> DataFrame:
    """(text, label, metadata) of up to `most` labelled documents outside the held-out fold (crc32(doc_id) mod 5 = 0), written to the shared folder.

    The rows are those of the smallest xxhash64 of doc_id, so the choice does not depend on order or content.
    A doc_id with several labels has the largest; one with several texts, the one of the smallest hash; NULL ids and labels are
    left out. metadata: numeric columns of docs that come along, as doubles; one that docs has not is NULL.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("label")).where("__id is not null and label is not null")
    known = known.groupBy("__id").agg(F.max("label").alias("label")).where(~held_out("__id", 5, 0))
    known = first_by_hash(known, "__id", most)
    extra = [with_metadata(docs, c).alias(c) for c in metadata]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra).join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("text", "label", *metadata), F.xxhash64("text", *metadata)).alias("r"))
    return materialise(one.select("r.*"), f"sample-{label}")


def with_metadata(docs: DataFrame, name: str) -> Column:
    """The numeric column of that name as a double; NULL where docs has none."""
    return F.col(name).cast("double") if name in docs.columns else F.lit(None).cast("double")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of a ridge logistic regression of y on the columns of x, by Newton's method."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) / len(y) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
