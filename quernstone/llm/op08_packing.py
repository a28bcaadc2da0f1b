"""Best-fit packing by exact-complement hashing.

Texts are tokenised where they lie; only (doc_id, piece, length, ...) rows move. The packing itself is a
plan over the histogram of lengths, which has at most `capacity` entries however many pieces there are:
single, pair and triple sums of available lengths are looked up by the gap they fill exactly, as many
at once as the counts allow; what is left goes best-fit. Each piece then takes its place by its rank among
the pieces of its length, which follows from where its row lies in the written table of pieces: equal rows differ there, so that no
group of rows is larger than a chunk of a file.

Ids are those of the tokenizers library for the same file, which tests compare, at six times its speed.

Defined results: a NULL text is empty and gives one piece with the end id alone; a NULL doc_id packs like
any other; repeated rows are packed each for itself; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm._common import materialise

CAPACITY, END_ID = 1024, 2
#: Rows of a written file that are ranked together at most.
RANK_GROUP = 2_000
#: White space of so many characters or more is encoded as the one token run that the pattern makes of it: the pattern's look-ahead takes time with the
#: square of a gap, and more stack than there is.
LONG_GAP = 512


@functools.cache
def encoder(ranks_file: str):
    """The byte-level BPE of the rank file: the same vocabulary, merges, added tokens and ids as the tokenizers file, several times as fast."""
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encode(enc, text: str) -> np.ndarray:
    """Ids of a text, of any length.

    The pattern takes a gap whole at the end of a text and before an added token, else all of it but the last character,
    which goes with what follows. What stands before a gap does not depend on it.
    """
    import regex

    out, at = [], 0
    for gap in regex.finditer(rf"\p{{White_Space}}{{{LONG_GAP},}}", text) if len(text) > LONG_GAP else ():
        whole = gap.end() == len(text) or any(text.startswith(x, gap.end()) for x in enc.special_tokens_set)
        end = gap.end() if whole else gap.end() - 1
        out += [enc.encode_to_numpy(text[at : gap.start()], allowed_special="all"), np.array(enc._encode_single_piece(text[gap.start() : end]), np.uint32)]
        at = end
    out.append(enc.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(out) if len(out) > 1 else out[0]


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all but the first have full capacity."""
    first = length - capacity * max(0, -(-length // capacity) - 1)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, ranks_file: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document's tokens and the end id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def run(batches):
        import pyarrow as pa

        enc = encoder(ranks_file or ranks_path())
        for batch in batches:
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                found = np.append(encode(enc, text.as_py() or ""), end_id).astype("<u4")
                for k, (s, n) in enumerate(cut(len(found), capacity)):
                    part = found[s : s + n]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan


@dataclass(frozen=True)
class Group:
    """`times` sequences, each with pieces of these lengths in this order."""

    lengths: tuple[int, ...]
    times: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Groups of sequences that hold every piece of the histogram once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    groups: list[Group] = []

    def take(lengths: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times > 0:
            for x, k in need.items():
                left[x] -= k * times
            groups.append(Group(lengths, times))

    for big in range(capacity, 0, -1):
        if not left[big]:
            continue
        gap = capacity - big
        if gap == 0:
            take((big,))
            continue
        if gap <= big and left[gap]:
            take((big, gap))
        for a in range(min(gap - 1, big), (gap + 1) // 2 - 1, -1):  # a pair sum: a + b fills the gap
            if not left[big]:
                break
            if left[a] and left[gap - a]:
                take((big, a, gap - a))
        for a in range(min(gap - 2, big), 0, -1):  # a triple sum: a + b + c fills the gap
            if not left[big]:
                break
            if not left[a]:
                continue
            rest = gap - a
            b = np.arange((rest + 1) // 2, min(a, rest - 1) + 1)
            for x in b[(left[b] > 0) & (left[rest - b] > 0)][::-1].tolist():
                take((big, a, x, rest - x))
                if not left[big] or not left[a]:
                    break
    # Best fit of the rest, longest first: open sequences by the room that is left in them.
    rooms: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity + 1) if rooms[r]), None)
            if room is None:
                rooms[capacity].append(((), n))
                room = capacity
            lengths, times = rooms[room].pop()
            used = min(n, times)
            if used < times:
                rooms[room].append((lengths, times - used))
            rooms[room - length].append((lengths + (length,), used))
            n -= used
    return groups + [Group(lengths, times) for room in rooms for lengths, times in room if lengths]


def slots(groups: list[Group]) -> dict[str, np.ndarray]:
    """For each length and rank from which on: the sequence of that rank and the place in it, sorted by length and rank."""
    given: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for g in groups:
        offset = 0
        for x in g.lengths:
            rows.append((x, given[x], base, offset))
            given[x] += g.times
            offset += x
        base += g.times
    rows.sort()
    of = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": of[:, 0] << 48 | of[:, 1], "rank": of[:, 1], "sequence": of[:, 2], "offset": of[:, 3]}


def ranked(rows: DataFrame, group: int = RANK_GROUP) -> DataFrame:
    """rows, which are a scan of written files, with `rank`: 0, 1, ... within each length.

    Rows come in the order of files, of chunks of a file and of places in a chunk. Three sums give a row's rank: rows
    of its length in files before its own, in chunks before its own, and before it in its chunk. What one task sorts
    is bounded by the number of files, by a file's chunks and by a chunk's rows, however many rows a length has.
    """
    at = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    at = at.withColumn("__chunk", F.floor(F.col("__row") / F.lit(group)))
    chunks = at.groupBy("length", "__file", "__chunk").agg(F.count("*").alias("n"))
    files = chunks.groupBy("length", "__file").agg(F.sum("n").alias("n"))
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("length", "__file", before(["length"], "__file").alias("__files"))
    chunks = chunks.select("length", "__file", "__chunk", before(["length", "__file"], "__chunk").alias("__chunks")).join(files, ["length", "__file"])
    own = F.row_number().over(Window.partitionBy("length", "__file", "__chunk").orderBy("__row")) - 1
    placed = at.withColumn("__own", own).join(chunks, ["length", "__file", "__chunk"])
    return placed.select(*rows.columns, (F.col("__files") + F.col("__chunks") + F.col("__own")).cast("bigint").alias("rank"))


def place(rows: DataFrame, capacity: int = CAPACITY, group: int = RANK_GROUP) -> DataFrame:
    """rows with sequence_id and offset, by their column length, which is from 1 to capacity."""
    rows = materialise(rows, "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    at = slots(plan(histogram, capacity))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            slot = np.searchsorted(at["key"], length.astype(np.int64) << 48 | rank, "right") - 1
            new = [at["sequence"][slot] + rank - at["rank"][slot], at["offset"][slot]]
            keep = [i for i, f in enumerate(batch.schema.names) if f != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *map(pa.array, new)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked(rows, group).mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return place(pieces(docs))
