"""Quality classification by a factorisation machine.

Inputs of a text are its hashed words (the frequencies of words that share a bucket are added up; length-normalised), statistics of its
structure (characters by class, lines, repetition, word and sentence lengths) and metadata: the number of characters that the
table states for it and whether it states one (labels, lang, source and doc_id are no inputs). The machine adds to a linear model the
interaction <v_i, v_j> x_i x_j of every pair of inputs, and scores it in linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). It is fitted by Adagrad on a
bounded sample of labelled rows, classes weighted alike.

Defined results: a NULL text is empty; empty texts are scored by their (zero) statistics; a NULL doc_id is not held
out and never learnt from; repeated rows are scored each; without labels every score is 0.5; an empty table
gives an empty result; a table without n_chars, or with NULL, states no length; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import PUNCT, SPACE, chunks, held_out, labelled_sample, logistic, span_hashes, text_bytes, with_metadata, word_spans

#: Labelled rows of the fit; hashed words; factors; passes over the sample. On the driver a row of the sample has 12 bytes for each bucket
#: that its words are in, of which there are WORDS: 1.6 GB at the very most, 21 MB in practice.
SAMPLE, WORDS, FACTORS, EPOCHS = 8_000, 1 << 14, 8, 4
THRESHOLD = 0.3
METADATA = ("n_chars",)

STATISTICS = (
    "log bytes", "log words", "log lines", "capitals", "digits", "punctuation", "symbols", "beyond ASCII", "exclamation marks", "full stops", "bars",
    "spaces", "all-capital words", "word length", "distinct words", "longest word", "repeated lines", "words a line", "one-word lines", "words with symbols",
    "stated characters", "no stated length",
)

_NEWLINE = np.zeros(256, bool)
_NEWLINE[ord("\n")] = True


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


_CAPITAL, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_POINTS, _SYMBOLS = _table(".,;:?!'\"()-"), _table("#$%&*+/<=>@[\\]^_`{|}~")
_ONE = {"!": _table("!"), ".": _table("."), "|": _table("|")}
_FAR = (np.arange(256) >= 0x80).astype(np.int64)
_GAP = SPACE.astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def features(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(statistics [rows, k], word inputs' row, column, value) of a chunk of texts; no row has a column twice. stated: n_chars, NaN where unknown."""
    rows = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    share = lambda t: _sums(t[data], offsets) / np.maximum(size, 1)
    start, end, row = word_spans(data, offsets, PUNCT)
    h = span_hashes(data, start, end)
    n = np.bincount(row, minlength=rows).astype(float)
    per = lambda values, among: np.bincount(row, weights=values, minlength=rows) / np.maximum(among, 1)
    capital = np.concatenate([[0], np.cumsum(_CAPITAL[data])])
    shouted = (capital[end] - capital[start] == end - start) & (end - start > 1)
    distinct, times = np.unique(np.stack([row.astype(np.uint64), h], axis=1), axis=0, return_counts=True) if len(h) else (np.zeros((0, 2), np.uint64), np.zeros(0))
    of = distinct[:, 0].astype(np.int64)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, (end - start).astype(float))
    # Lines, their words and their repetition.
    a, b, line_row = word_spans(data, offsets, _NEWLINE)
    line_hash = span_hashes(data, a, b)
    lines = np.bincount(line_row, minlength=rows).astype(float)
    different = np.bincount(np.unique(np.stack([line_row.astype(np.uint64), line_hash], axis=1), axis=0)[:, 0].astype(np.int64), minlength=rows) if len(a) else np.zeros(rows)
    in_line = np.searchsorted(start, b) - np.searchsorted(start, a)
    # Tokens between spaces that hold a symbol.
    s, e, token_row = word_spans(data, offsets, SPACE)
    symbol = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    marked = np.bincount(token_row, weights=symbol[e] > symbol[s], minlength=rows) / np.maximum(np.bincount(token_row, minlength=rows), 1)
    stats = np.stack(
        [
            np.log1p(size), np.log1p(n), np.log1p(lines), share(_CAPITAL), share(_DIGIT), share(_POINTS), share(_SYMBOLS), share(_FAR), share(_ONE["!"]), share(_ONE["."]), share(_ONE["|"]),
            share(_GAP), per(shouted, n), per(end - start, n), np.bincount(of, minlength=rows) / np.maximum(n, 1), np.log1p(longest), 1 - different / np.maximum(lines, 1), n / np.maximum(lines, 1),
            np.bincount(line_row, weights=in_line <= 1, minlength=rows) / np.maximum(lines, 1), marked,
            np.log1p(np.maximum(np.nan_to_num(stated), 0)), np.isnan(stated).astype(float),
        ],
        axis=1,
    )
    place, back = np.unique(of * WORDS + (distinct[:, 1] % np.uint64(WORDS)).astype(np.int64), return_inverse=True)
    value = np.bincount(back, weights=times, minlength=len(place))
    of = place // WORDS
    norm = np.sqrt(np.bincount(of, weights=value**2, minlength=rows))
    return stats, of, place % WORDS, value / np.maximum(norm[of], 1e-9)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float] = (0.0, 0.0)

    def inputs(self, stats, row, column, value):
        """All inputs of rows in order: hashed words, then the standardised statistics."""
        k, rows = stats.shape[1], len(stats)
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(k)
        row = np.concatenate([row, np.repeat(np.arange(rows), k)])
        column = np.concatenate([column, np.tile(WORDS + np.arange(k), rows)])
        value = np.concatenate([value, z.ravel()])
        order = np.argsort(row, kind="stable")
        return row[order], column[order], value[order]

    def margin(self, row, column, value, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The machine's output for each row and its factor sums; every row has an input, as all have statistics."""
        first = np.searchsorted(row, np.arange(rows))
        v = self.factors[column] * value[:, None]
        sums = np.add.reduceat(v, first, axis=0)
        squares = np.add.reduceat((v * v).sum(1), first)
        return self.bias + np.add.reduceat(self.linear[column] * value, first) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, data: np.ndarray, offsets: np.ndarray, stated: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in chunks(offsets):
            found = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], stated[a:b])
            y, _ = self.margin(*self.inputs(*found), b - a)
            out.append(1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * y, -30, 30))))
        return np.concatenate(out)


def train(stats, row, column, value, y, seed: int = 3) -> Machine:
    """A machine of these rows; row is sorted."""
    rng = np.random.default_rng(seed)
    k = stats.shape[1]
    m = Machine(0.0, np.zeros(WORDS + k), rng.normal(0, 0.05, (WORDS + k, FACTORS)), stats.mean(0), np.maximum(stats.std(0), 1e-6))
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    row, column, value = m.inputs(stats, row, column, value)
    ends = np.searchsorted(row, np.arange(len(y) + 1))
    seen_linear, seen_factors, seen_bias = np.full(WORDS + k, 1e-6), np.full((WORDS + k, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            batch = order[at : at + 64]
            n = ends[batch + 1] - ends[batch]
            pick = np.repeat(ends[batch] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            r, c, x = np.repeat(np.arange(len(batch)), n), column[pick], value[pick]
            out, sums = m.margin(r, c, x, len(batch))
            error = weight[batch] * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[batch]) / len(batch)
            columns, back = np.unique(c, return_inverse=True)
            by = error[r] * x
            g = np.bincount(back, weights=by) + 1e-5 * m.linear[columns]
            each = by[:, None] * (sums[r] - m.factors[c] * x[:, None])
            gf = np.stack([np.bincount(back, weights=each[:, f]) for f in range(FACTORS)], axis=1) + 1e-5 * m.factors[columns]
            seen_linear[columns] += g * g
            seen_factors[columns] += gf * gf
            seen_bias += error.sum() ** 2
            m.linear[columns] -= 0.1 * g / np.sqrt(seen_linear[columns])
            m.factors[columns] -= 0.03 * gf / np.sqrt(seen_factors[columns])
            m.bias -= 0.1 * error.sum() / np.sqrt(seen_bias)
    return m


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine of up to SAMPLE labelled rows; a fifth of them sets the curve from its output to a score."""
    sample = labelled_sample(docs, labels, "quality", SAMPLE, METADATA).withColumn("key", F.xxhash64("text", *METADATA))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            stated = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets):
                stats, row, column, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], stated[a:b])
                cut = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (column.astype(np.int32), value.astype(np.float32))]
                k = stats.shape[1]
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * k, k, dtype=np.int32)), pa.array(stats.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1).slice(a, b - a), batch.column(1).slice(a, b - a), *lists], names=["key", "label", "column", "value", "stats"])

    table = sample.select("text", "label", *METADATA, "key").mapInArrow(run, "key bigint, label int, column array<int>, value array<float>, stats array<double>").toArrow()
    # The order of training, and the fifth, go by what the rows hold, so that no other partitioning or retry gives another machine.
    table = table.sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks()
    y = (table.column("label").to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        k = len(STATISTICS)
        return Machine(0.0, np.zeros(WORDS + k), np.zeros((WORDS + k, FACTORS)), np.zeros(k), np.ones(k), (0.0 if not len(y) else 4.0 * y[0] - 2.0, 0.0))
    lists = {c: table.column(c).combine_chunks() for c in ("column", "value", "stats")}
    stats = lists["stats"].flatten().to_numpy().reshape(len(y), -1)
    row = np.repeat(np.arange(len(y)), np.diff(lists["column"].offsets.to_numpy()))
    column, value = lists["column"].flatten().to_numpy().astype(np.int64), lists["value"].flatten().to_numpy().astype(float)
    check = np.arange(len(y)) % 5 == 0
    of_check = check[row]
    renumber = lambda keep: np.cumsum(keep) - 1
    m = train(stats[~check], renumber(~check)[row[~of_check]], column[~of_check], value[~of_check], y[~check])
    out, _ = m.margin(*m.inputs(stats[check], renumber(check)[row[of_check]], column[of_check], value[of_check]), int(check.sum()))
    if y[check].min() < y[check].max():
        share = y[check].mean()
        w = np.where(y[check] > 0, 0.5 / share, 0.5 / (1 - share))
        m.curve = tuple(float(v) for v in logistic(np.stack([np.ones(len(out)), out], axis=1), y[check], 1e-3, weight=w))
    else:
        m.curve = (0.0, 1.0)
    return m


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    m = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(*text_bytes(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text", with_metadata(docs, "n_chars").alias("n_chars")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
