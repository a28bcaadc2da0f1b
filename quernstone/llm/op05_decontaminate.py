"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, and exact edit verification.

Texts are words: runs of letters and digits, ASCII case folded, hashed. A window of W words is embedded by the random walk of
Chakraborty, Goldenberg and Koucky: at step j the word under the pointer is put out, and the pointer moves on if the j-th random bit of that
word says so. Windows that are a few edits apart walk together again soon, so that their outputs differ in few
places; a few places of the output, chosen at random, are the key of a hash table. Windows of all items, at every offset, are indexed in
several tables of several walks, and every window of a document is looked up. A copy with the most edits that
count has windows with fewer edits than others, and each has several walks and tables: tests find no copy lost among
thousands for every length from 3 words to 120 and every kind of edit. A candidate is verified by the
exact word edit distance of the item to the best span around it.

A document leaks an item if some span of it is within floor((1 - similarity) m) word edits of the item's m words. An item of under LEAST_WORDS
words, which much ordinary text would contain, is leaked by documents that consist of it.

Defined results: NULL or wordless texts and items leak nothing; repeated rows and items are reported each; a NULL
doc_id or item_id is carried as such; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import PUNCT, chunks, mix64, span_hashes, text_bytes, word_spans

SIMILARITY = 0.8
#: Words of the items that one pass over the documents takes; more go in further passes. An index has about 130 bytes for each of them and table.
BLOCK_WORDS = 1_000_000
#: Items of fewer words are compared with whole documents only.
LEAST_WORDS = 3
#: By least item length: words of a window, words from a document's window to its next, walks, tables of each walk.
WINDOWS = ((20, 8, 2, 3, 2), (7, 4, 1, 3, 2), (5, 2, 1, 1, 1), (LEAST_WORDS, LEAST_WORDS, 1, 1, 1))
#: Places of the output in a key; words of a document that an item is compared with at once.
SAMPLES, MOST_REGION = 3, 4_096
_BITS, _CLASSES = 1 << 20, 1 << 10


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it stands in."""
    start, end, row = word_spans(data, offsets, PUNCT)
    return span_hashes(data, start, end), row


def walk_keys(words: np.ndarray, start: np.ndarray, length: int, walk: int, tables: int):
    """For each table of a walk, the keys of the windows of `length` words from each start."""
    rng = np.random.default_rng([length, walk])
    salt = rng.integers(1, 2**63, dtype=np.uint64)
    # A pointer stays two steps on a word on average: places are drawn from each third of the steps until it reaches the end.
    steps = 2 * length
    third = [(i * steps // SAMPLES, max((i + 1) * steps // SAMPLES, i * steps // SAMPLES + 1)) for i in range(SAMPLES)]
    places = [[int(rng.integers(*t)) for t in third] for _ in range(tables)]
    wanted: dict[int, list[int]] = {}
    for t, at in enumerate(places):
        for j in at:
            wanted.setdefault(j, []).append(t)
    padded = np.concatenate([words, np.zeros(steps + 1, np.uint64)])
    coins = mix64(padded ^ salt)
    keys = [np.full(len(start), t + 1, np.uint64) for t in range(tables)]
    pointer, end = start.copy(), start + length
    for j in range(max(wanted) + 1):
        if j in wanted:
            out = np.where(pointer < end, padded[pointer], np.uint64(0))
            with np.errstate(over="ignore"):
                for t in wanted[j]:
                    keys[t] = keys[t] * np.uint64(0x9E3779B97F4A7C15) + out
        pointer += ((coins >> np.uint64(j)) & np.uint64(1)).astype(np.int64)[pointer]
    return [mix64(k) for k in keys]


def edit_distance(item: np.ndarray, region: np.ndarray, most: int) -> int:
    """Least word edit distance of the item to any span of the region; most + 1 if it is beyond."""
    column = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (region != word))
        new[0] = i + 1
        row = np.minimum.accumulate(new - column) + column
        if row.min() > most:
            return most + 1
    return int(row.min())


class Index:
    """Windows of a block of items; it is sent to the executors as a whole."""

    def __init__(self, texts: list[str], similarity: float = SIMILARITY):
        self.items, self.most = [], []
        for t in texts:
            data = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
            self.items.append(words_of(data, np.array([0, len(data)]))[0])
            self.most.append(int((1 - similarity) * len(self.items[-1]) + 1e-9))
        # Which of 1024 word classes an item has: rejects most candidates before the exact distance.
        self.has = np.zeros((len(self.items), _CLASSES), bool)
        for i, words in enumerate(self.items):
            self.has[i, words & np.uint64(_CLASSES - 1)] = True
        self.allowed = np.array(self.most, np.int64)
        self.length = np.array([len(w) for w in self.items], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *self.items])
        begin = np.concatenate([[0], np.cumsum(self.length)])
        self.tables = []  # window, stride, walk, tables of (keys, owner, offset, folded keys that are there)
        above = 1 << 62
        for least, window, stride, walks, tables in WINDOWS:
            mine = np.flatnonzero((self.length >= least) & (self.length < above))
            above = least
            if not len(mine):
                continue
            n = self.length[mine] - window + 1
            owner = np.repeat(mine, n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for walk in range(walks):
                held = []
                for keys in walk_keys(every, begin[owner] + offset, window, walk, tables):
                    order = np.argsort(keys, kind="stable")
                    there = np.zeros(_BITS, bool)
                    there[keys & np.uint64(_BITS - 1)] = True
                    held.append((keys[order], owner[order], offset[order], there))
                self.tables.append((window, stride, walk, held))
        self.whole: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((self.length > 0) & (self.length < LEAST_WORDS)).tolist():
            self.whole.setdefault(self.items[i].tobytes(), []).append(i)

    def candidates(self, words: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Distinct (row, item, first): a copy of the item may begin about the row's word `first`."""
        begin, end = np.searchsorted(row, row, "left"), np.searchsorted(row, row, "right")
        folded = (words & np.uint64(_CLASSES - 1)).astype(np.int64)
        found = [np.zeros((0, 4), np.int64)]
        place = np.arange(len(words)) - begin
        for window, stride, walk, held in self.tables:
            # The last window of a text is taken whatever the stride.
            start = np.flatnonzero((end - np.arange(len(words)) >= window) & ((place % stride == 0) | (end - np.arange(len(words)) == window)))
            for key, (keys, owner, offset, there) in zip(walk_keys(words, start, window, walk, len(held)), held):
                hit = np.flatnonzero(there[key & np.uint64(_BITS - 1)])
                low, high = np.searchsorted(keys, key[hit], "left"), np.searchsorted(keys, key[hit], "right")
                n = high - low
                if n.sum():
                    which = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    at = np.repeat(start[hit], n)
                    new = np.stack([row[at], owner[which], at - begin[at] - offset[which], at], axis=1)
                    found.append(new[np.unique(new[:, :3], axis=0, return_index=True)[1]])
        every = np.concatenate(found)
        every = every[np.unique(every[:, :3], axis=0, return_index=True)[1]]
        out = [np.zeros((0, 3), np.int64)]
        for a in range(0, len(every), 1 << 14):
            part = every[a : a + (1 << 14)]
            item, first = part[:, 1], begin[part[:, 3]]
            # A copy lies within the allowed edits about the item's place: all its other words are the item's.
            low = np.maximum(first + part[:, 2] - self.allowed[item], first)
            high = np.minimum(first + part[:, 2] + self.length[item] + self.allowed[item], end[part[:, 3]])
            n = high - low
            stop = np.cumsum(n)
            where = np.arange(stop[-1]) + np.repeat(low - (stop - n), n)
            shared = np.add.reduceat(self.has[np.repeat(item, n), folded[where]].astype(np.int64), stop - n)
            out.append(part[shared >= self.length[item] - self.allowed[item], :3])
        return np.concatenate(out)

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, distance) of every leak that the candidates lead to, at its least distance."""
        out: dict[tuple[int, int], int] = {}
        if not self.tables and not self.whole:
            return []
        for a, b in chunks(offsets):
            words, row = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(words):
                continue
            begin = np.searchsorted(row, np.arange(b - a + 1))
            for r in range(b - a if self.whole else 0):
                if begin[r + 1] - begin[r] < LEAST_WORDS:
                    out |= {(a + r, i): 0 for i in self.whole.get(words[begin[r] : begin[r + 1]].tobytes(), ())}
            # Candidates come by row, item and place: regions that overlap are compared as one, up to MOST_REGION words.
            merged: list[list[int]] = []
            for r, i, at in self.candidates(words, row).tolist():
                low = int(begin[r]) + max(0, at - 2 * self.most[i] - 1)
                high = min(int(begin[r]) + max(0, at + len(self.items[i]) + 2 * self.most[i] + 1), int(begin[r + 1]))
                if merged and merged[-1][:2] == [r, i] and low <= merged[-1][3] and high - merged[-1][2] <= MOST_REGION:
                    merged[-1][3] = max(high, merged[-1][3])
                else:
                    merged.append([r, i, low, high])
            for r, i, low, high in merged:
                most, item, region = self.most[i], self.items[i], words[low:high]
                if out.get((a + r, i)) == 0 or self.has[i, (region & np.uint64(_CLASSES - 1)).astype(np.int64)].sum() < len(item) - most:
                    continue
                d = edit_distance(item, region, most)
                if d <= most:
                    out[a + r, i] = min(d, out.get((a + r, i), d))
        return [(r, i, d) for (r, i), d in sorted(out.items())]


def _blocks(benchmark: DataFrame, similarity: float):
    """(ids, Index) of each block of items; one block is on the driver at a time. Blocks are dealt by hash, so that each has about BLOCK_WORDS words at most."""
    size = benchmark.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "[^0-9A-Za-z\\x80-\\x{10FFFF}]+")))).first()[0] or 0
    n = max(1, -(-size // BLOCK_WORDS))
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], Index([r["text"] for r in rows], similarity)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, item_words, distance): one row for each item that a document leaks."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for ids, index in _blocks(benchmark, similarity):

        def run(batches, ids=ids, index=index):
            import pyarrow as pa

            for batch in batches:
                found = index.leaks(*text_bytes(batch.column(1)))
                columns = [batch.column(0).take(pa.array([r for r, _, _ in found], pa.int64())), pa.array([ids[i] for _, i, _ in found], batch_kind), pa.array([len(index.items[i]) for _, i, _ in found], pa.int32()), pa.array([d for _, _, d in found], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "item_words", "distance"])

        from pyspark.sql.pandas.types import to_arrow_type

        batch_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, item_words int, distance int")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that leak any item; rows pass as they are, where they lie."""
    for _, index in _blocks(benchmark, similarity):
        text = docs.columns.index("text")

        def run(batches, index=index, text=text):
            import pyarrow as pa

            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _, _ in index.leaks(*text_bytes(batch.column(text)))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
