"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, runs of what is not a letter become one space. Counts of four-character grams are
gathered over every text outside the held-out fold whose language is known, in Spark, and none is left out; the lower orders'
continuation counts follow from the distinct grams. A model keeps, for each order, its grams and contexts as
sorted arrays of 64-bit keys, and is asked by binary search; a worker remembers the answers in a direct-mapped table.
Models go to the workers in blocks of languages of up to BLOCK_GRAMS grams, and a text passes all blocks, keeping its two lowest
entropies: neither the driver nor a worker holds more than one block, which a single language with more grams than that has for itself
(it has four-character grams of its own script only, so that it ends growing long before the texts do).
The language of the lowest cross-entropy per character is chosen; a logistic curve over the margin to the
second and the length, fitted on a bounded sample, gives the score, and a choice below REJECT is marked.

Defined results: a NULL text, or one without a letter, is `und` with score 0; a NULL doc_id is not held out and never
learnt from, nor is a NULL lang; of equal entropies the language first in alphabetical order wins; repeated rows
are scored each; with nothing to learn from all is `und`; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import crc_mod, first_by_hash, held_out, logistic, materialise, mix64

ORDER = 4
#: Texts that the score's curve is fitted on at most.
CURVE_SAMPLE = 4_000
REJECT = 0.5
#: Four-character grams of the languages that are sent to the workers at once, about 40 bytes each there.
BLOCK_GRAMS = 4_000_000
_SLOTS = 1 << 20


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and letterhood of each code point of the basic plane."""
    chars = [chr(c) for c in range(1 << 16)]
    low = np.array([ord(x) if len(x := c.lower()) == 1 and not 0xD800 <= i < 0xE000 else i for i, c in enumerate(chars)], np.uint32)
    return np.where(low < 1 << 16, low, np.arange(1 << 16)).astype(np.uint16), np.array([c.isalpha() for c in chars])


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """16-bit characters of all texts, each after two spaces and before one, and each text's offset; a text without a letter has no character. Letters beyond the basic plane become U+FFFF."""
    low, letter = _tables()
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    n = np.array([len(c) for c in codes])
    # Two spaces open each text, so that a single letter has a gram; the next text's close it.
    gap = np.array([0x20, 0x20], np.uint32)
    flat = np.concatenate([x for c in codes for x in (gap, c)] + [gap])
    start = np.concatenate([[0], np.cumsum(n + 2)])
    far = flat >= 1 << 16
    small = np.where(far, 0, flat).astype(np.uint16)
    alpha = letter[small]
    if far.any():
        which, back = np.unique(flat[far], return_inverse=True)
        alpha[far] = np.array([chr(c).isalpha() for c in which])[back]
    out = np.where(alpha, np.where(far, np.uint16(0xFFFF), low[small]), np.uint16(0x20))
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]  # the first space after a letter
    begins = start[:-1]
    keep[begins] = keep[begins + 1] = True
    keep[-2] = True
    at = np.concatenate([[0], np.cumsum(keep)])[start]
    text = out[keep]
    return text, at


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-character grams of all texts and the text each is of."""
    text, at = normalised(texts)
    if len(text) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = text.astype(np.uint64)
    key = wide[:-3] << np.uint64(48) | wide[1:-2] << np.uint64(32) | wide[2:-1] << np.uint64(16) | wide[3:]
    owner = np.searchsorted(at, np.arange(len(key)), "right") - 1
    # A gram may end with the space that opens the next text, and no further.
    inside = np.arange(len(key)) + ORDER - 1 <= at[np.minimum(owner + 1, len(at) - 1)]
    letters = (text != 0x20).astype(np.int8)
    any_letter = letters[:-3] + letters[1:-2] + letters[2:-1] + letters[3:] > 0
    kept = inside & any_letter
    return key[kept], owner[kept]


class Language:
    """Interpolated Kneser-Ney of order 4 over packed grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int):
        self.orders, self.alphabet = [], alphabet
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(float)
        for n in range(ORDER, 0, -1):
            ones, twos = float((counts == 1).sum()), float((counts == 2).sum())
            discount = ones / (ones + 2 * twos) if ones else 0.5
            context, first = np.unique(keys >> np.uint64(16), return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            kinds = np.diff(np.concatenate([first, [len(keys)]])).astype(float)
            self.orders.append((n, keys, counts, context, total, kinds, discount))
            suffix, times = np.unique(keys & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True) if n > 1 else (keys, counts)
            keys, counts = suffix, times.astype(float)

    def probability(self, key: np.ndarray) -> np.ndarray:
        """Of the last character of each packed gram after the first three."""
        p = np.full(len(key), 1.0 / self.alphabet)
        for n, keys, counts, context, total, kinds, discount in reversed(self.orders):
            mine = key & np.uint64((1 << 16 * n) - 1) if n < ORDER else key
            c = _find(keys, mine, counts)
            before = mine >> np.uint64(16)
            all_, different = _find(context, before, total), _find(context, before, kinds)
            seen = all_ > 0
            safe = np.where(seen, all_, 1.0)
            p = np.where(seen, np.maximum(c - discount, 0) / safe + discount * different / safe * p, p)
        return p


def _find(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


class Model:
    """The models of a block of languages; alphabet is that of all languages."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], alphabet: int):
        self.names = sorted(counts)
        self.languages = [Language(*counts[k], alphabet) for k in self.names]
        self._memo = None

    def __getstate__(self):
        return self.__dict__ | {"_memo": None}

    def _losses(self, key: np.ndarray) -> np.ndarray:
        """-ln p of each gram in each language, as float32 [grams, languages]."""
        if self._memo is None:
            self._memo = np.zeros(_SLOTS, np.uint64), np.zeros((_SLOTS, len(self.names)), np.float32)
        known, losses = self._memo
        slot = (mix64(key) >> np.uint64(44)).astype(np.int64)
        missing = np.flatnonzero(known[slot] != key)
        extra = None
        if len(missing):
            new, back = np.unique(key[missing], return_inverse=True)
            computed = np.stack([-np.log(np.maximum(x.probability(new), 1e-30)) for x in self.languages], axis=1).astype(np.float32)
            at = (mix64(new) >> np.uint64(44)).astype(np.int64)
            known[at], losses[at] = new, computed
            extra = computed[back]
        out = losses[slot]
        if extra is not None:
            out[missing] = extra
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per gram of each text in each language [texts, languages], and the texts' grams."""
        n = np.zeros(len(texts), np.int64)
        out = np.zeros((len(texts), len(self.names)))
        size = np.cumsum([len(t or "") for t in texts])
        cut = [0, *np.unique(np.searchsorted(size, np.arange(500_000, size[-1] if len(size) else 0, 500_000)) + 1), len(texts)]
        for a, b in itertools.pairwise(dict.fromkeys(min(int(x), len(texts)) for x in cut)):
            key, owner = grams(texts[a:b])
            if len(key):
                rows, first = np.unique(owner, return_index=True)
                sums = np.add.reduceat(self._losses(key), first, axis=0, dtype=np.float64)
                n[a + rows] = np.diff(np.concatenate([first, [len(key)]]))
                out[a + rows] = sums / n[a + rows, None]
        return out, n

    def lower(self, texts: list[str | None], name: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the texts have of the blocks before (name of the lowest entropy, it, the second lowest) with this block's languages, and the texts'
        grams. Blocks come in alphabetical order, so that of equal entropies the first name stays."""
        entropy, n = self.entropies(texts)
        order = np.argsort(entropy, axis=1, kind="stable")[:, :2]
        low = np.take_along_axis(entropy, order, 1)
        other = low[:, 1] if low.shape[1] > 1 else np.full(len(texts), np.inf)
        better = low[:, 0] < first
        new = np.array(self.names, object)[order[:, 0]]
        return np.where(better, new, name), np.where(better, low[:, 0], first), np.where(better, np.minimum(first, other), np.minimum(low[:, 0], second)), n


def _known(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "lang", "text").where("lang is not null and text is not null").where(crc_mod("doc_id", 3) != 1)


def counted(known: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text)."""

    def run(batches):
        import pyarrow as pa

        held: dict[str, list] = {}

        def flush():
            for lang, parts in held.items():
                key = np.concatenate([k for k, _ in parts])
                order = np.argsort(key, kind="stable")
                key, n = key[order], np.concatenate([c for _, c in parts])[order]
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                if len(first):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), pa.array(key[first].view(np.int64)), pa.array(np.add.reduceat(n, first))], names=["lang", "gram", "n"])
            held.clear()

        waiting = 0
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in set(langs.tolist()):
                key, _ = grams([texts[i] for i in np.flatnonzero(langs == lang)])
                key, n = np.unique(key, return_counts=True)
                held.setdefault(lang, []).append((key, n))
                waiting += len(key)
            if waiting > 1_000_000:
                yield from flush()
                waiting = 0
        yield from flush()

    return known.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def blocks_of(table: DataFrame, most: int = BLOCK_GRAMS):
    """A Model of each block of languages of the written (lang, gram, n); one is on the driver at a time."""
    sizes = {r["lang"]: r["count"] for r in table.groupBy("lang").count().collect()}  # a row a language
    letters = table.agg(F.count_distinct(F.col("gram").bitwiseAND(F.lit(0xFFFF)))).first()[0] + 1
    block, held = [], 0
    for lang in [*sorted(sizes), None]:
        if block and (lang is None or held + sizes[lang] > most):
            counts = {}
            for k in block:
                rows = table.where(F.col("lang") == k).select("gram", "n").toArrow()
                counts[k] = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
            yield Model(counts, letters)
            block, held = [], 0
        if lang is not None:
            block.append(lang)
            held += sizes[lang]


def entropies(rows: DataFrame, table: DataFrame, most: int = BLOCK_GRAMS) -> DataFrame:
    """rows (..., text) with name, first, second, grams: the language of the lowest entropy, it, the second lowest, the grams; `text` is gone.

    Between two blocks the rows are written to the shared folder.
    """
    out = rows.select("*", F.lit(None).cast("string").alias("name"), F.lit(float("inf")).alias("first"), F.lit(float("inf")).alias("second"), F.lit(0).cast("bigint").alias("grams"))
    started = False
    for model in blocks_of(table, most):
        out = materialise(out, "language-block") if started else out
        started = True
        text, name = (out.columns.index(c) for c in ("text", "name"))

        def run(batches, model=model, text=text, name=name):
            import pyarrow as pa

            for batch in batches:
                old = [batch.column(name + k).to_numpy(zero_copy_only=False) for k in range(3)]
                names, first, second, n = model.lower(batch.column(text).to_pylist(), *old)
                yield pa.RecordBatch.from_arrays([*batch.columns[:name], pa.array(names, pa.string()), pa.array(first), pa.array(second), pa.array(n)], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out.drop("text")


def _inputs(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the curve is over: the margin to the second language, times the root of the grams, and the entropy."""
    margin = np.where(np.isinf(second), 1.0, second - np.where(np.isinf(first), 0.0, first)) * np.sqrt(n)
    return np.stack([np.ones(len(n)), np.log1p(margin), np.where(np.isinf(first), 0.0, first)], axis=1)


def learnt(docs: DataFrame) -> DataFrame:
    """(lang, gram, n), written, of all rows outside the held-out fold (crc32(doc_id) mod 3 = 1) with a known language."""
    return materialise(counted(_known(docs)), "grams")


def curve_of(docs: DataFrame, table: DataFrame, most: int = BLOCK_GRAMS) -> np.ndarray:
    """Coefficients of the score: of up to CURVE_SAMPLE learnt rows, which language they are of and which was chosen."""
    sample = first_by_hash(_known(docs), "doc_id", CURVE_SAMPLE).select("lang", "text").repartition(16)
    rows = entropies(sample, table, most).where("grams > 0").select((F.col("name") == F.col("lang")).alias("ok"), "first", "second", "grams").toArrow()
    if not rows.num_rows:
        return np.zeros(3)
    x = _inputs(*(rows.column(c).to_numpy() for c in ("first", "second", "grams")))
    # One made-up miss at no margin, so that the curve falls there even if all are right.
    return logistic(np.vstack([x, [1.0, 0.0, x[:, 2].mean()]]), np.append(rows.column("ok").to_numpy(zero_copy_only=False).astype(float), 0.0), 1e-3)


def identify(docs: DataFrame, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """The contract's columns for every document, and `rejected`."""
    table = learnt(docs)
    curve = curve_of(docs, table, block_grams)
    found = entropies(docs.select("doc_id", "text"), table, block_grams)
    margin = F.when(F.col("second") == float("inf"), 1.0).otherwise(F.col("second") - F.col("first")) * F.sqrt("grams")
    x = F.lit(float(curve[0])) + F.lit(float(curve[1])) * F.log1p(margin) + F.lit(float(curve[2])) * F.col("first")
    known = (F.col("grams") > 0) & F.col("name").isNotNull()
    score = F.when(known, 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))).otherwise(0.0)
    out = found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.when(known, F.col("name")).otherwise("und").alias("lang_pred"), score.alias("score"))
    return out.withColumn("rejected", F.col("score") < REJECT)
