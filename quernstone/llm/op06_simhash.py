"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has one or more 64-bit lanes. Distinct fingerprints meet in buckets: every way of
keeping some blocks of bits whole, so that no pair within the radius is lost. Within a bucket fingerprints are compared by bit planes: plane p
holds bit p of 64 fingerprints in each word, carry-save counters add the differing planes of a query to
64 distances at once, and a block is left as soon as all its distances exceed the radius. Each bucket
returns a spanning forest of its links, never all pairs; components are joined across buckets.

The pipeline's stage links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Its buckets are bands of least
hashes, which lose no pair at 0.8 that matters; within a bucket SimHash fingerprints of two lanes are compared by bit planes, as above, in every
round, and only what lies within the radius is decided by the exact similarity.

Defined results: a NULL or wordless text has fingerprint zero and links like any other; a NULL doc_id
gets its component like other rows, but never names one unless all are NULL; repeated rows share a
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quernstone.llm._common import chunks, materialise, mix64, span_hashes, text_bytes, word_spans
from quernstone.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Fixed values of the contract.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Members of one comparison; a larger bucket is split into parts of this size that meet pair by pair.
CELL = 2048
#: Cells up to this size are compared pair by pair, many at once.
_SMALL = 16


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of each shingle of lower-cased words; fewer words make one shingle, none no shingle."""
    from xxhash import xxh64_intdigest

    found = WORD.findall(text.lower())
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= words:
        return [xxh64_intdigest(line, seed)]
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    begin = np.concatenate([[0], np.cumsum(lengths)])
    end = (begin[words:] - 1).tolist()
    return [xxh64_intdigest(line[i:j], seed) for i, j in zip(begin.tolist(), end)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each row's fingerprint: the bits set in over half of its hashes; counts has the hashes of each row."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        first = np.concatenate([[0], np.cumsum(counts[full])])[:-1]
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(id_col, lane0, lane1, ...): the fingerprint of each text, one lane for each seed, as signed longs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            lanes = [[] for _ in seeds]
            # Long texts make many hashes: their bits are counted a few thousand rows' worth at a time.
            for lane, seed in zip(lanes, seeds):
                held, counts = [], []
                for a, b in itertools.pairwise(offsets.tolist()):
                    h = shingle_hashes(data[a:b].tobytes(), words, seed)
                    held.append(np.array(h, np.uint64))
                    counts.append(len(h))
                    if sum(counts) > 200_000:
                        lane.append(majority(np.concatenate(held), np.array(counts)))
                        held, counts = [], []
                if counts:
                    lane.append(majority(np.concatenate(held), np.array(counts)))
            columns = [pa.array(np.concatenate(x).view(np.int64)) if x else pa.array([], pa.int64()) for x in lanes]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *(f"lane{i}" for i in range(len(seeds)))])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"lane{i} bigint" for i in range(len(seeds))))


# ---------------------------------------------------------------- bit-sliced comparison


def planes(lanes: np.ndarray) -> np.ndarray:
    """Bit planes [bits, words] of fingerprints [n, lanes]: bit i of word w of plane p is bit p of fingerprint 64 w + i."""
    n, k = lanes.shape
    bits = np.unpackbits(np.ascontiguousarray(lanes).astype("<u8").view(np.uint8).reshape(n, 8 * k), axis=1, bitorder="little")
    padded = np.zeros((64 * k, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, vertical: np.ndarray, radius: int, alive: np.ndarray, step: int = 8) -> np.ndarray:
    """Bits [queries, words] of the fingerprints at `radius` or fewer differing bits from each query.

    Carry-save counters of radius.bit_length() bits start at 2^bits - 1 - radius, so that the carry out
    of the top counter marks a distance beyond the radius; the mark stays. Every `step` planes the block is left
    if every live distance is marked.
    """
    size = radius.bit_length()
    start = (1 << size) - 1 - radius
    shape = (len(queries), vertical.shape[1])
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.full(shape, full if start >> i & 1 else 0, np.uint64) for i in range(size)]
    over = np.broadcast_to(~alive, shape).copy()
    bits = np.unpackbits(np.ascontiguousarray(queries).astype("<u8").view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little")
    flip = np.where(bits.astype(bool), full, np.uint64(0))
    for p in range(len(vertical)):
        carry = vertical[p][None, :] ^ flip[:, p, None]
        for c in counters:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if p % step == step - 1 and bool((over == full).all()):
            break
    return ~over


def _unpack(found: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(found).view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)


def _mask(n: int) -> np.ndarray:
    live = np.zeros(-(-n // 64) * 64, np.uint8)
    live[:n] = 1
    return np.packbits(live, bitorder="little").view("<u8").copy()


def forest(lanes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (i, j) within the radius that connect what all such links of these fingerprints connect."""
    n = len(lanes)
    if n < 2:
        return []
    vertical, alive = planes(lanes), _mask(n)
    links, waiting = [], np.ones(n, bool)
    for seed in range(n):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        alive[seed // 64] &= ~(np.uint64(1) << np.uint64(seed % 64))
        front = [seed]
        while front and alive.any():
            now, front = front[:64], front[64:]
            found = within(lanes[now], vertical, radius, alive)
            hit = np.bitwise_or.reduce(found, axis=0)
            if hit.any():
                near = _unpack(found, n)
                reached = np.flatnonzero(near.any(0))
                by = near[:, reached].argmax(0)
                links += [(int(j), now[int(i)]) for j, i in zip(reached, by)]
                waiting[reached] = False
                alive &= ~hit
                front += reached.tolist()
    return links


# ---------------------------------------------------------------- buckets


def intact_masks(radius: int, bits: int = 64, key_blocks: int = 2) -> list[tuple[int, ...]]:
    """Bit masks such that two fingerprints within the radius agree on at least one: radius + key_blocks blocks, of which key_blocks stay whole."""
    blocks = radius + key_blocks
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    masks = []
    for kept in itertools.combinations(range(blocks), key_blocks):
        whole = sum(((1 << cuts[b + 1]) - 1) ^ ((1 << cuts[b]) - 1) for b in kept)
        masks.append(tuple((whole >> 64 * i) & (2**64 - 1) for i in range(bits // 64)))
    return masks


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def stars(found: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Links [n, 2] from each row that `found` connects to others to the one of the smallest fingerprint among them.

    Buckets that share most of a family then name the same root, so their links are the same and few.
    """
    order = np.lexsort(lanes.T[::-1])
    rank = np.empty(len(lanes), np.int64)
    rank[order] = np.arange(len(lanes))
    label = rank.copy()
    i, j = found[:, 0], found[:, 1]
    while True:
        new, least = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != rank)
    return np.stack([moved, order[label[moved]]], axis=1)


def cell_links(cells: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """Links [n, 2] of row numbers, of sorted rows: cells [n, k] names each row's cell.

    Small cells are compared all in one go: the planes hold the differences of their pairs, 64 to a word.
    Larger cells give a spanning forest each. What is connected within a cell is returned as a star.
    """
    n = len(cells)
    same = (cells[1:] == cells[:-1]).all(1) if n > 1 else np.zeros(0, bool)
    cut = np.concatenate([[0], np.flatnonzero(~same) + 1, [n]])
    size = np.diff(cut)
    out = [np.zeros((0, 2), np.int64)]
    small = np.flatnonzero((size > 1) & (size <= _SMALL))
    for shift in range(1, _SMALL):
        of = small[size[small] > shift]
        if not len(of):
            break
        left = size[of] - shift
        i = np.repeat(cut[of] - np.concatenate([[0], np.cumsum(left)[:-1]]), left) + np.arange(left.sum())
        for at in range(0, len(i), 1 << 16):
            pair = i[at : at + (1 << 16)]
            differ = lanes[pair] ^ lanes[pair + shift]
            found = within(np.zeros((1, lanes.shape[1]), np.uint64), planes(differ), radius, _mask(len(pair)))
            hit = pair[_unpack(found, len(pair))[0]]
            out.append(np.stack([hit, hit + shift], axis=1))
    for c in np.flatnonzero(size > _SMALL):
        found = np.array(forest(lanes[cut[c] : cut[c + 1]], radius), np.int64).reshape(-1, 2)
        out.append(found + cut[c])
    return stars(np.concatenate(out), lanes)


def links(nodes: DataFrame, masks: list[tuple[int, ...]], radius: int, cell: int = CELL) -> DataFrame:
    """(a, b): links that connect what the fingerprints within the radius that share a bucket connect.

    nodes: (node, lane0, ...), one row for each distinct fingerprint. A bucket of over `cell` members is split
    by hash into parts, each pair of which is one cell, so that no task holds an unbounded bucket. There are
    at most rows / cell such buckets; their sizes are broadcast if they are few, else joined by a shuffle.
    """
    lanes = [c for c in nodes.columns if c.startswith("lane")]
    keys = F.array(*[F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(_signed(m))) for c, m in zip(lanes, mask)]) for t, mask in enumerate(masks)])
    large = materialise(nodes.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell), "simhash-large")
    keyed = nodes.select(*lanes, F.explode(keys).alias("key"))
    some = large.count()
    if some:
        parts = F.coalesce(F.ceil(F.col("n") / F.lit(cell)), F.lit(1)).cast("int")
        keyed = keyed.join(F.broadcast(large) if some <= 100_000 else large, "key", "left").withColumn("parts", parts)
        mine = F.pmod(F.xxhash64(*lanes, F.lit(1)), F.col("parts")).cast("int")
        keyed = keyed.withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
        part = F.least("mine", "other") * F.lit(1 << 20) + F.greatest("mine", "other")
    else:
        part = F.lit(0)
    cells = keyed.select("key", part.cast("bigint").alias("part"), *lanes)
    cells = cells.repartition("key", "part").sortWithinPartitions("key", "part")
    out = [f"{x}{i}" for x in "ab" for i in range(len(lanes))]

    def run(batches):
        import pyarrow as pa

        def emit(rows):
            found = cell_links(rows[:, :2], rows[:, 2:].view(np.uint64), radius)
            ends = np.concatenate([rows[found[:, 0], 2:], rows[found[:, 1], 2:]], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, i])) for i in range(len(out))], names=out)

        held = None
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(batch.num_columns)], axis=1)
            held = new if held is None else np.concatenate([held, new])
            cut = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(1)) + 1
            if len(held) > 50_000 and len(cut):
                yield emit(held[: cut[-1]])
                held = held[cut[-1] :]
        if held is not None and len(held):
            yield emit(held)

    ends = cells.mapInArrow(run, ", ".join(f"{c} bigint" for c in out))
    name = lambda x: F.col(f"{x}0") if len(lanes) == 1 else F.xxhash64(*[f"{x}{i}" for i in range(len(lanes))])
    return ends.select(name("a").alias("a"), name("b").alias("b"))


def classes(prints: DataFrame, masks: list[tuple[int, ...]], radius: int, id_col: str = "doc_id", cell: int = CELL) -> DataFrame:
    """prints with component_id: the smallest id that links reach from the row, its own included."""
    lanes = [c for c in prints.columns if c.startswith("lane")]
    node = F.col(lanes[0]) if len(lanes) == 1 else F.xxhash64(*lanes)
    nodes = materialise(prints.groupBy(*lanes).agg(F.min(id_col).alias("least")).withColumn("node", node), "simhash-nodes")
    roots = materialise(components(links(nodes.select("node", *lanes), masks, radius, cell)), "simhash-roots")
    linked = nodes.select("node", "least").join(roots, "node")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    moved = roots.join(smallest, "root").select("node", "smallest")
    named = nodes.join(moved, "node", "left").select(*lanes, F.coalesce("smallest", "least").alias("component_id"))
    # Rows of a hot fingerprint meet one row of `named`: the join's skewed side can be split.
    return prints.join(named, lanes, "left")


def near_duplicates(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """(doc_id, fingerprint, component_id): three-word shingles, links at three or fewer differing bits, every such link found."""
    prints = materialise(fingerprints(docs), "simhash-prints")
    found = classes(prints, intact_masks(RADIUS), RADIUS, cell=cell)
    return found.select("doc_id", F.lower(F.lpad(F.hex("lane0"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- the pipeline's stage

#: For stages: sets of five-word shingles, linked at a Jaccard similarity of SIMILARITY in hundredths or more. Candidates share a
#: band of STAGE_ROWS least hashes; a pair at 0.8 shares none of STAGE_BANDS bands with probability (1 - 0.8^5)^24 = 7e-5.
STAGE_SHINGLE, STAGE_SIMILARITY, STAGE_BANDS, STAGE_ROWS = 5, 80, 24, 5
#: Lanes of the stage's fingerprints, of distinct shingles, and their radius. Two sets at 0.8 differ in a bit with probability 0.19 at most
#: (four shingles of five; 0.15 in large sets): more than 44 of 128 bits with 2e-5 at most, and beyond ten shingles with 1e-7.
STAGE_LANES, STAGE_RADIUS = 2, 44
#: Rows of a few numbers each (24 bytes) that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Rounds that try one member of each bucket against the others, before all pairs that no link connects are tried.
STAR_ROUNDS = 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = STAGE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct shingles, sorted; words as in the fingerprints, fewer words make one shingle."""
    start, end, row = word_spans(data, offsets)
    h = span_hashes(data, start, end)
    n = len(offsets) - 1
    begin = np.searchsorted(row, np.arange(n + 1))
    count = np.diff(begin)
    odd = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    at = np.arange(len(h))
    left = begin[1:][row] - at  # words of the row from here on
    first = np.flatnonzero((left >= words) | (at == begin[:-1][row]) & (count[row] < words))
    found = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            here = left[first] > k
            found[here] += h[first[here] + k] * odd[k]
    found, of = mix64(found), row[first]
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    return of[new], found[new]


def shingle_lanes(of: np.ndarray, h: np.ndarray, n: int, lanes: int = STAGE_LANES) -> np.ndarray:
    """Fingerprints [n, lanes] of rows from their distinct shingles (of: the row of each hash, sorted)."""
    counts = np.bincount(of, minlength=n)
    out = np.zeros((n, lanes), np.uint64)
    for lane in range(lanes):
        # Long texts have many shingles: their bits are counted a few rows at a time.
        with np.errstate(over="ignore"):
            mixed = mix64(h * np.uint64(2 * lane + 3) + np.uint64(0x632BE59BD9B4E019))
        ends = np.concatenate([[0], np.cumsum(counts)])
        for a, b in chunks(ends, 100_000):
            out[a:b, lane] = majority(mixed[ends[a] : ends[b]], counts[a:b])
    return out


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps have none."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has few rows, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def sketches(docs: DataFrame, bands: int = STAGE_BANDS, rows: int = STAGE_ROWS) -> DataFrame:
    """(doc_id, copy, row, node, size, bands, text): a hash of each text, one of its whole row, one of its set of shingles, the set's size and the
    keys of its bands (none of a wordless text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rng = np.random.default_rng(11)
    salts, factors = rng.integers(1, 2**63, (2, bands * rows)).astype(np.uint64)
    factors |= np.uint64(1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            data, offsets = text_bytes(batch.column(3))
            node, size, keys = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros((n, bands), np.uint64)
            for a, b in chunks(offsets):
                of, h = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if not len(h):
                    continue
                some, first = np.unique(of, return_index=True)
                size[a + some] = np.diff(np.append(first, len(of)))
                with np.errstate(over="ignore"):
                    node[a + some] = mix64(np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), first))
                    for t in range(bands):
                        key = np.full(len(some), t + 1, np.uint64)
                        for j in range(t * rows, (t + 1) * rows):
                            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((h ^ salts[j]) * factors[j], first))
                        keys[a + some, t] = key
            full = size > 0
            ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node.view(np.int64)), pa.array(size), lists, batch.column(3)], names=["doc_id", "copy", "row", "node", "size", "bands", "text"])

    return docs.select("doc_id", F.xxhash64("text").alias("copy"), row_hash(docs).alias("row"), "text").mapInArrow(run, f"doc_id {kind}, copy bigint, row bigint, node bigint, size bigint, bands array<bigint>, text string")


def with_lanes(texts: DataFrame) -> DataFrame:
    """(node, text) with lane0, lane1: the stage's fingerprint of each text."""
    names = [f"lane{i}" for i in range(STAGE_LANES)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            lanes = [np.zeros((0, STAGE_LANES), np.uint64)]
            for a, b in chunks(offsets):
                lanes.append(shingle_lanes(*shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a))
            found = np.concatenate(lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(STAGE_LANES)]], names=["node", "text", *names])

    return texts.select("node", "text").mapInArrow(run, "node bigint, text string, " + ", ".join(f"{x} bigint" for x in names))


def alike(pairs: DataFrame, texts: DataFrame, similarity: int = STAGE_SIMILARITY, radius: int = STAGE_RADIUS) -> DataFrame:
    """The (a, b) of `pairs` whose fingerprints lie within the radius and whose texts' sets of shingles have a Jaccard similarity of `similarity`
    hundredths or more; texts: (node, text, lanes).

    The planes hold the differences of 64 pairs in each word; the sets of shingles are made of the pairs that are left.
    """
    lanes = range(STAGE_LANES)
    end = lambda node, text: texts.select(F.col("node").alias(node), F.col("text").alias(text), *[F.col(f"lane{i}").alias(f"{text}{i}") for i in lanes])
    both = pairs.select("a", "b").join(end("a", "x"), "a").join(end("b", "y"), "b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            side = lambda c: np.stack([batch.column(f"{c}{i}").to_numpy() for i in lanes], axis=1).view(np.uint64)
            differ = side("x") ^ side("y")
            near = _unpack(within(np.zeros((1, STAGE_LANES), np.uint64), planes(differ), radius, _mask(len(differ))), len(differ))[0]
            batch = batch.filter(pa.array(near))
            if not batch.num_rows:
                continue
            x, y = text_bytes(batch.column(2)), text_bytes(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for a, b in chunks(x[1] + y[1]):
                sets = [shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for data, offsets in (x, y)]
                of, h = (np.concatenate(c) for c in zip(*sets))
                order = np.lexsort((h, of))
                of, h = of[order], h[order]
                common = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=b - a)
                either = np.bincount(of, minlength=b - a) - common
                keep[a:b] = 100 * common >= similarity * either
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.select("a", "b", "x", "y", *[f"{c}{i}" for c in "xy" for i in lanes]).mapInArrow(run, "a bigint, b bigint")


def cell_forest(root: np.ndarray, lanes: np.ndarray, data: np.ndarray, offsets: np.ndarray, similarity: int, radius: int) -> list[tuple[int, int]]:
    """Links (i, j) of rows at the similarity that connect what all such links connect, given that rows of one root are connected.

    Bit planes give the rows within the radius of 64 rows at a time; the sets of shingles decide among those.
    """
    n, label = len(root), np.unique(root, return_inverse=True)[1]
    parts = [(a + of, h) for a, b in chunks(offsets) for of, h in [shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]]
    of, h = (np.concatenate(c) for c in zip(*parts))
    names, h = np.unique(h, return_inverse=True)
    begin = np.searchsorted(of, np.arange(n + 1))
    size, mark, links = np.diff(begin), np.zeros(len(names), bool), []
    vertical, alive = planes(lanes), _mask(n)
    for block in range(0, n - 1, 64):
        near = _unpack(within(lanes[block : block + 64], vertical, radius, alive), n)
        for i in range(block, min(block + 64, n - 1)):
            fit = i + 1 + np.flatnonzero(near[i - block, i + 1 :] & (label[i + 1 :] != label[i]))
            # The smaller of two sets this similar has at least this share of the larger's shingles.
            fit = fit[100 * np.minimum(size[fit], size[i]) >= similarity * np.maximum(size[fit], size[i])]
            if not len(fit):
                continue
            mark[h[begin[i] : begin[i + 1]]] = True
            ends = np.cumsum(size[fit])
            where = np.arange(ends[-1]) + np.repeat(begin[fit] - (ends - size[fit]), size[fit])
            common = np.add.reduceat(mark[h[where]].astype(np.int64), ends - size[fit])
            mark[h[begin[i] : begin[i + 1]]] = False
            for j in fit[100 * common >= similarity * (size[i] + size[fit] - common)].tolist():
                if label[j] != label[i]:
                    links.append((i, j))
                    label[label == label[j]] = label[i]
    return links


def bucket_links(named: DataFrame, sizes: DataFrame, similarity: int, texts: DataFrame | None = None, radius: int = STAGE_RADIUS, cell: int = CELL) -> DataFrame:
    """(a, b): links at the similarity that connect what each key's rows (key, node, root, text, lanes) have; sizes: (key, members); texts: (node,
    text, lanes), if the rows have none.

    A key of over `cell` rows is split by hash into parts that meet pair by pair, as the buckets of fingerprints are.
    """
    lanes = [f"lane{i}" for i in range(STAGE_LANES)]
    parts = F.ceil(F.col("members") / F.lit(cell)).cast("int")
    split = named.join(sizes, "key").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    split = split if texts is None else split.join(texts, "node")  # texts come last, so that they move once
    part = F.least("mine", "other").cast("bigint") * F.lit(1 << 20) + F.greatest("mine", "other")
    cells = split.select("key", part.alias("part"), "node", "root", "text", *lanes).repartition("key", "part").sortWithinPartitions("key", "part")

    def run(batches):
        import pyarrow as pa

        def emit(table):
            if not table.num_rows:
                return
            key, of, node, root = (table.column(c).to_numpy() for c in range(4))
            cut = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (of[1:] != of[:-1])) + 1, [len(key)]])
            for a, b in itertools.pairwise(cut.tolist()):
                if (root[a:b] == root[a]).all():
                    continue
                prints = np.stack([table.column(5 + i).slice(a, b - a).to_numpy() for i in range(STAGE_LANES)], axis=1).view(np.uint64)
                found = cell_forest(root[a:b], prints, *text_bytes(table.column(4).slice(a, b - a)), similarity, radius)
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(node[a + i]), pa.array(node[a + j])], names=["a", "b"])

        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            key, of = (held.column(c).to_numpy() for c in range(2))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (of[1:] != of[:-1])) + 1
            if len(cut):
                yield from emit(held.slice(0, int(cut[-1])))
                held = held.slice(int(cut[-1])).combine_chunks()
        if held is not None:
            yield from emit(held)

    return cells.mapInArrow(run, "a bigint, b bigint")


def similar(rows: DataFrame, similarity: int = STAGE_SIMILARITY) -> DataFrame:
    """(node, root) of all nodes that links at the similarity connect to others; rows: sketches. Every pair that shares a band and may be
    similar is tried by its exact similarity, unless links connect it already."""
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    keyed = nodes.select(F.explode("bands").alias("key"), "node", "size")

    def crowded(batches):
        """Rows of keys with several nodes."""
        import pyarrow as pa

        last = None  # a row not yet known to share its key
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            fresh = np.ones(len(new), bool)
            if last is not None:
                new, fresh = np.concatenate([last[0], new]), np.concatenate([last[1], fresh])
            if not len(new):
                continue
            same = new[1:, 0] == new[:-1, 0]
            keep = fresh & (np.append(same, False) | np.append(False, same))
            last = new[-1:], (fresh & ~keep)[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(new[keep, c])) for c in range(3)], names=["key", "node", "size"])

    members = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(crowded, "key bigint, node bigint, size bigint")
    members = materialise(members, "stage-members")
    crowd = small(materialise(members.select("node").distinct(), "stage-crowd"))
    wanted = rows.select("node", "text").join(crowd, "node", "left_semi")
    texts = materialise(with_lanes(wanted.groupBy("node").agg(F.first("text").alias("text"))), "stage-texts")
    # The smaller of two sets this similar has at least this share of the larger's shingles.
    sizes = 100 * F.least("n", "size") >= similarity * F.greatest("n", "size")
    found = roots = None
    for turn in range(STAR_ROUNDS + 1):
        named = members.withColumn("root", F.col("node")) if roots is None else members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if roots is not None:
            apart = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low <> high")
            named = named.join(apart.select("key"), "key", "left_semi")
        if turn < STAR_ROUNDS:
            # One member of each bucket, mostly the same one in all buckets of a family, against those of other roots.
            hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("a"), F.col("size").alias("n"), F.col("root").alias("r"))).over(Window.partitionBy("key"))
            pairs = named.withColumn("hub", hub).select("hub.a", "hub.n", "hub.r", F.col("node").alias("b"), "size", "root")
            pairs = pairs.where("r <> root").where(sizes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            new = alike(pairs, texts, similarity)
        else:
            new = bucket_links(named, apart.select("key", "members"), similarity, texts)
        new = materialise(new, "stage-links")
        found = new if found is None else found.unionByName(new)
        roots = materialise(components(found), "stage-roots")
    return roots


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near-duplicates, which are what links at similarity 0.8 or more connect: of the row's smallest id, of
    several texts of that id that of the smallest hash, of several rows of that text that of the smallest hash of all columns.

    Texts without a word are one group. Rows with a NULL id stay, as nothing can name them. Rows of one id and different texts are judged
    each; of rows that are equal in all columns one stays.
    """
    rows = materialise(sketches(docs), "stage-sketches")
    own = ["doc_id", "copy", "row"]
    known = rows.where("doc_id is not null")
    # The first row of each node, then of each group of nodes: rows of a large group meet nowhere, as only their own keys are joined.
    of_node = known.groupBy("node").agg(F.min(F.struct(*own)).alias("first"))
    first = of_node.join(similar(rows), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    by_row = known.groupBy(*own).agg(F.count("*").alias("n")).join(first.select("first.*", F.lit(True).alias("found")), own, "left")
    odd = by_row.select(*[F.col(c).alias(f"__{c}") for c in own], "n", F.col("found").isNotNull().alias("stays")).where("n > 1 or not stays").drop("n")
    odd = materialise(odd, "stage-odd")

    def same(o: DataFrame) -> Column:
        return (F.col("doc_id") == o["__doc_id"]) & (F.xxhash64("text") == o["__copy"]) & (row_hash(docs) == o["__row"])

    odd_rows = small(odd)
    kept = docs.join(odd_rows, same(odd_rows), "left_anti")
    repeated = odd.where("stays")
    if repeated.limit(1).count():
        again = small(repeated)
        one = docs.join(again, same(again), "left_semi").groupBy("doc_id", F.xxhash64("text").alias("__copy"), row_hash(docs).alias("__row"))
        kept = kept.unionByName(one.agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__one")).select("__one.*"))
    return kept
