"""Toxicity by maximum-scoring segment search.

Tokens are words and their first 4, 5 and 6 bytes, ASCII case folded. Their weights are log-odds between
toxic and other labelled texts with an informative Dirichlet prior (the pooled frequencies, alpha_0
pseudo-counts); tokens whose z-score reaches 3 are significant, and all of them are kept. A word scores the weight of its most specific
significant token, any other word a small constant loss, so that the expected score is negative. The linear-time
scan of Ruzzo and Tompa finds all maximal segments of a text.

Segments are calibrated by extreme values. In a non-toxic text of n words the largest segment score M follows
P(M <= S) = exp(-K n exp(-lambda S)). lambda is the root of E[exp(lambda s)] = 1 over the scores s of the words of the
sample's other texts, each weight with its own frequency. K is the maximum-likelihood fit to the largest scores of those
texts; as the law is one of high scores, those below the quantile TAIL, c, are censored there: K = (texts with M > c) / (sum of
n exp(-lambda max(M, c))). A segment of score S has the expected number E = K n exp(-lambda S) in such a text, and the
evidence of a text is the sum of -ln E over segments with E < 1. A logistic curve, fitted on the same bounded
sample, maps evidence to a score.

Near-copies would count a text's words many times: of the sample's texts that share the smallest hash
of their five-word shingles, one is counted.

Defined results: NULL, empty and wordless texts have no segment and the score of no evidence; a NULL doc_id is not
held out and never learnt from; repeated rows are scored each; without any toxic label every score is
the base rate's; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import PUNCT, chunks, held_out, labelled_sample, logistic, materialise, mix64, span_hashes, text_bytes, word_spans

PRIOR, SIGNIFICANT = 10_000.0, 3.0
#: Loss of a word without a significant token: the log of what toxic passages have besides such words, at one in 50.
LOSS = float(np.log(1 - 1 / 50))
PREFIXES = (6, 5, 4)
#: Quantile of the largest scores of other texts from which on they count for K.
TAIL = 0.9
_BITS = 1 << 18


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each word, most specific first (0: no such prefix), and the row of each word."""
    start, end, row = word_spans(data, offsets, PUNCT)
    kinds = [span_hashes(data, start, end)]
    for k in PREFIXES:
        long = end - start > k
        kinds.append(np.where(long, mix64(span_hashes(data, start, np.minimum(end, start + k)) ^ np.uint64(k)), np.uint64(0)))
    return kinds, row


def maximal_segments(hits: list[tuple[int, float]], loss: float = LOSS) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal-scoring segments, given the positions that gain; every other position has the (negative) loss.

    Ruzzo and Tompa: each candidate keeps the cumulative sums at its ends; a new one joins back to the last
    candidate that started lower and ended lower.
    """
    stack: list[list[float]] = []  # first, last, left sum, right sum
    total, at = 0.0, 0
    for position, gain in hits:
        total += loss * (position - at)
        new = [position, position, total, total + gain]
        total, at = total + gain, position + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(int(a), int(b), r - left) for a, b, left, r in stack]


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    decay: float  # lambda
    rate: float  # K
    curve: tuple[float, float]

    def __post_init__(self):
        self.there = np.zeros(_BITS, bool)
        self.there[self.hashes & np.uint64(_BITS - 1)] = True

    def gains(self, kinds: list[np.ndarray]) -> np.ndarray:
        """Weight of each word's most specific significant token, else 0."""
        out = np.zeros(len(kinds[0]))
        for h in reversed(kinds):
            maybe = np.flatnonzero(self.there[h & np.uint64(_BITS - 1)])
            if len(maybe) and len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[maybe]
                out[maybe[hit]] = self.weights[at[hit]]
        return out

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[tuple[int, int, float]]]]:
        """For each row: its words and all maximal segments (first word, last word, score)."""
        out = []
        for a, b in chunks(offsets):
            kinds, row = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            gain = self.gains(kinds)
            begin = np.searchsorted(row, np.arange(b - a + 1))
            hit = np.flatnonzero(gain)
            of: dict[int, list] = {}
            for i, r in zip(hit.tolist(), row[hit].tolist()):
                of.setdefault(r, []).append((i - int(begin[r]), float(gain[i])))
            out += [(int(begin[r + 1] - begin[r]), maximal_segments(of[r]) if r in of else []) for r in range(b - a)]
        return out

    def passages(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, list[tuple[int, int, float, float]]]]:
        """For each row: its words and the significant segments (first word, last word, score, E)."""
        out = []
        for n, found in self.segments(data, offsets):
            expected = [(*s, n * self.rate * float(np.exp(-self.decay * s[2]))) for s in found]
            out.append((n, [s for s in expected if s[3] < 1]))
        return out

    def evidence(self, segments) -> float:
        return float(sum(-np.log(max(s[3], 1e-12)) for s in segments))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(evidence), -30, 30)))


def _once(sample: DataFrame) -> DataFrame:
    """The sample with one text of each group of near-copies, written."""

    def shingles(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            start, end, row = word_spans(data, offsets, PUNCT)
            h = span_hashes(data, start, end)
            # A text of under five words is known by all its words.
            key = np.diff(np.searchsorted(row, np.arange(batch.num_rows + 1))).astype(np.uint64)
            with np.errstate(over="ignore"):
                place = np.arange(len(h)) - np.searchsorted(row, row)
                np.add.at(key, row, mix64(h + place.astype(np.uint64)))
            key = mix64(key)
            if len(h) >= 5:
                with np.errstate(over="ignore"):
                    five = mix64(sum(h[k : len(h) - 4 + k] * np.uint64(2 * k + 3) ** np.uint64(3) for k in range(5)))
                whole = np.flatnonzero(row[4:] == row[:-4])
                if len(whole):
                    rows, first = np.unique(row[whole], return_index=True)
                    key[rows] = np.minimum.reduceat(five[whole], first)
            key = np.where(np.diff(offsets) > 0, key, np.uint64(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key.view(np.int64))], names=["text", "label", "key"])

    return materialise(sample.mapInArrow(shingles, "text string, label int, key bigint").groupBy("key", "label").agg(F.min("text").alias("text")).select("text", "label"), "sample-once")


def _counts(sample: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """(token, toxic, other): in how many of the sample's texts each token is, near-copies counted once."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False)
            kinds, row = tokens(data, offsets)
            h, r = np.concatenate(kinds), np.tile(row, len(kinds))
            kept = h != 0
            pair = np.unique(np.stack([h[kept], r[kept].astype(np.uint64)], axis=1), axis=0)
            token, first = np.unique(pair[:, 0], return_index=True)
            toxic = np.add.reduceat(label[pair[:, 1].astype(np.int64)].astype(np.int64), first) if len(token) else np.zeros(0, np.int64)
            n = np.diff(np.concatenate([first, [len(pair)]]))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(toxic), pa.array(n - toxic)], names=["token", "toxic", "other"])

    once = _once(sample) if once is None else once
    return once.mapInArrow(count, "token bigint, toxic bigint, other bigint").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def decay_of(scores: np.ndarray, times: np.ndarray) -> float:
    """lambda: the positive root of E[exp(lambda s)] = 1 over word scores that are met so many times each; their mean is negative."""
    share = times / max(times.sum(), 1)
    excess = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def rate_of(words: np.ndarray, largest: np.ndarray, decay: float, tail: float = TAIL) -> float:
    """K: most likely for texts of so many words with these largest scores, of which those up to the `tail` quantile say only that they lie below it."""
    if not len(largest):
        return 1.0
    least = float(np.quantile(largest, tail, method="lower"))
    return float(((largest > least).sum() + 0.5) / ((words * np.exp(-decay * np.maximum(largest, least))).sum() + 1.0))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from up to SAMPLE labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic")
    once = _once(sample)
    counts = materialise(_counts(sample, once), "token-counts")
    totals = counts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).cast("double").alias("t"), F.coalesce(F.sum("other"), F.lit(0)).cast("double").alias("o")).first()
    t, o = totals["t"], totals["o"]
    a0 = F.lit(PRIOR)
    a = a0 * (F.col("toxic") + F.col("other")) / F.lit(max(t + o, 1.0))
    odds = lambda y, n: F.log((F.col(y) + a) / (F.lit(n) + a0 - F.col(y) - a))
    scored = counts.withColumn("weight", odds("toxic", t) - odds("other", o)).withColumn("z", F.col("weight") / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("other") + a)))
    found = scored.where(F.col("z") >= SIGNIFICANT).select("token", "weight").toArrow()  # tokens of SAMPLE texts at most
    hashes = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    model = Model(hashes[order], found.column("weight").to_numpy()[order], 1.0, 1.0, (0.0, 0.0))

    def background(batches):
        """Of the other texts: how many words have each score, and each text's words and largest segment score."""
        import pyarrow as pa

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for x, y in chunks(offsets):
                gain = model.gains(tokens(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])[0])
                score, times = np.unique(np.where(gain > 0, gain, LOSS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(score), np.int32)), pa.array(score), pa.array(times)], names=["kind", "score", "n"])
            texts = model.segments(data, offsets)
            largest = [max((z for _, _, z in found), default=0.0) for _, found in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(texts), np.int32)), pa.array(largest, pa.float64()), pa.array([n for n, _ in texts], pa.int64())], names=["kind", "score", "n"])

    met = once.where("label = 0").select("text").mapInArrow(background, "kind int, score double, n bigint")
    met = met.groupBy("kind", "score", F.when(F.col("kind") == 1, F.col("n")).alias("words")).agg(F.sum("n").alias("n"), F.count("*").alias("texts")).toArrow()  # a row a weight, and a row a text at most
    kind, score, words, n, texts = (met.column(c).to_numpy() for c in ("kind", "score", "words", "n", "texts"))
    if (kind == 0).any():
        model.decay = decay_of(score[kind == 0], n[kind == 0])
        of = kind == 1
        model.rate = rate_of(np.repeat(words[of], texts[of]), np.repeat(score[of], texts[of]), model.decay)

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            found = [model.evidence(s) for _, s in model.passages(*text_bytes(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], names=["evidence", "label"])

    pairs = sample.select("text", "label").mapInArrow(weigh, "evidence double, label int").toArrow()  # SAMPLE rows at most
    x = np.log1p(pairs.column("evidence").to_numpy())
    y = pairs.column("label").to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        model.curve = tuple(float(v) for v in logistic(np.stack([np.ones(len(x)), x], axis=1), y, 1e-4))
    else:
        share = (y.sum() + 0.5) / (len(y) + 1)
        model.curve = (float(np.log(share / (1 - share))) if len(y) else -2.0, 0.0)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages, passages): passages are "first word:last word:score", comma-joined."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = model.passages(*text_bytes(batch.column(1)))
            scores = model.score(np.array([model.evidence(s) for _, s in found], float))
            said = [",".join(f"{a}:{b}:{x:.3f}" for a, b, x, _ in s) for _, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array([len(s) for _, s in found], pa.int32()), pa.array(said, pa.string())], names=["doc_id", "score", "n_passages", "passages"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_passages int, passages string")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passages")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold; rows pass as they are, where they lie."""
    text = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = model.passages(*text_bytes(batch.column(text)))
            yield batch.filter(pa.array(model.score(np.array([model.evidence(s) for _, s in found], float)) < threshold))

    return docs.mapInArrow(run, docs.schema)
