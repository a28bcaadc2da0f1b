"""Fill-in-the-middle texts, cut by overlapping chunks.

A text is a sequence of units: a run of ASCII letters, or any other single code point. Where a unit starts can be told from two
neighbouring characters: everywhere but between two letters. So the bytes of a batch of texts are cut into chunks, each of which also
looks at the byte before it; every chunk counts its units and its characters by itself, prefix sums of these counts say which chunk owns
the unit at which a text is to be cut, and only the owning chunks are looked at again. Nothing is kept for each character of a
text beyond one slab of chunks, and a text takes time in proportion to its length, however long and wherever it is cut.

The cuts come back as character counts; the texts are put together by built-in functions, and `restored` takes them apart again.

Defined results: a NULL text is empty; a NULL id is hashed as no digits; repeated rows give a row each and equal results; an empty table
gives an empty result; other columns stay as they are, a column named as a result excepted, which the result replaces (`transform`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm._common import free_name, text_bytes

#: Fixed values of the contract: the marks, and the shares in a hundred.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1:"

#: Bytes of a chunk, and chunks that are counted together.
CHUNK, SLAB = 4096, 256

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
#: Bytes that begin a character of UTF-8.
_FIRST = np.ones(256, bool)
_FIRST[0x80:0xC0] = False


def chunk_starts(offsets: np.ndarray, size: int = CHUNK) -> np.ndarray:
    """Where chunks start: at each text, and every `size` bytes within it. An empty text has no chunk."""
    lengths = np.diff(offsets)
    per = -(-lengths // size)
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return np.repeat(offsets[:-1], per) + within * size


def starts(data: np.ndarray, a: int, b: int, text_starts: np.ndarray) -> np.ndarray:
    """For the bytes a to b whether a unit starts there; the byte before a is looked at as well."""
    letter = _LETTER[data[a:b]]
    joined = letter.copy()
    joined[1:] &= letter[:-1]
    joined[:1] &= a > 0 and _LETTER[data[a - 1]]
    out = _FIRST[data[a:b]] & ~joined
    lo, hi = np.searchsorted(text_starts, [a, b])
    out[text_starts[lo:hi] - a] = True
    return out


def counts(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, slab: int = SLAB) -> tuple[np.ndarray, np.ndarray]:
    """Units and characters of each chunk, a slab of chunks at a time."""
    units, chars = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    begins = offsets[:-1][np.diff(offsets) > 0]
    for i in range(0, len(at), slab):
        a, b = at[i], at[i + slab] if i + slab < len(at) else offsets[-1]
        units[i : i + slab] = np.add.reduceat(starts(data, a, b, begins).astype(np.int64), at[i : i + slab] - a)
        chars[i : i + slab] = np.add.reduceat(_FIRST[data[a:b]].astype(np.int64), at[i : i + slab] - a)
    return units, chars


def cut(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the characters before its unit number h1 % (n + 1) and h2 % (n + 1), the smaller first."""
    at = chunk_starts(offsets, size)
    units, chars = counts(data, offsets, at)
    before_units, before_chars = np.concatenate([[0], np.cumsum(units)]), np.concatenate([[0], np.cumsum(chars)])
    chunk_of = np.searchsorted(at, offsets)  # the first chunk of each text, and of what follows the last
    n = np.diff(before_units[chunk_of])
    total = np.diff(before_chars[chunk_of])
    begins = offsets[:-1][np.diff(offsets) > 0]
    ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    out = np.zeros_like(ranks)
    for k in range(2):
        rank = ranks[k]
        out[k] = np.where(rank >= n, total, 0)
        inner = np.flatnonzero((rank > 0) & (rank < n))
        wanted = before_units[chunk_of[inner]] + rank[inner]  # the number of the unit, counted over the batch
        owner = np.searchsorted(before_units, wanted, "right") - 1
        for row, unit, c in zip(inner.tolist(), wanted.tolist(), owner.tolist()):
            a = at[c]
            b = min(a + size, offsets[row + 1])
            place = np.flatnonzero(starts(data, a, b, begins))[unit - before_units[c]]
            out[k, row] = before_chars[c] - before_chars[chunk_of[row]] + np.count_nonzero(_FIRST[data[a : a + place]])
    return n, out[0], out[1]


def _cuts(text, h1, h2):
    import pyarrow as pa

    data, offsets = text_bytes(text)
    n, a, b = cut(data, offsets, h1.to_numpy(zero_copy_only=False).astype(np.int64), h2.to_numpy(zero_copy_only=False).astype(np.int64))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["n", "a", "b"])


def numbers(id_col: Column, seed: str = SEED) -> list[Column]:
    """Four numbers under 2^32 that follow from the id alone."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def cuts(text: Column, h1: Column, h2: Column) -> Column:
    """struct(n, a, b): a text's units, and the characters before the first and the second cut."""
    return F.arrow_udf(_cuts, "struct<n:bigint,a:bigint,b:bigint>")(text, h1, h2)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """docs with n, form (plain, psm or spm), prefix_chars, middle_chars and output.

    transformed of a hundred texts are, suffix_first of a hundred of these with the suffix first; which ones, and where they are cut,
    follows from the id and the seed. A text that holds one of the marks stays plain, so that every output can be taken apart.
    """
    h1, h2, h3, h4 = numbers(F.col(id_col), seed)
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut_name = free_name("cut", docs.columns)
    form_name = free_name("form_", [*docs.columns, cut_name])
    rows = docs.withColumn(cut_name, cuts(text, h1, h2))
    plain = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h3 % 100 >= transformed)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn(form_name, form)
    a, b, is_plain = F.col(cut_name)["a"], F.col(cut_name)["b"], F.col(form_name) == "plain"
    prefix, middle, suffix = F.substr(text, F.lit(1), a.cast("int")), F.substr(text, (a + 1).cast("int"), (b - a).cast("int")), F.substr(text, (b + 1).cast("int"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = {
        "output": F.when(is_plain, text).when(F.col(form_name) == "spm", spm).otherwise(psm),
        "n": F.col(cut_name)["n"],
        "prefix_chars": F.when(~is_plain, a),
        "middle_chars": F.when(~is_plain, b - a),
        "form": F.col(form_name),
    }
    return rows.withColumns(made).drop(cut_name, form_name)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the form was made of. The marks can't overlap each other, so the first of each is the one that was put there."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def parted(mark: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(body, mark, 1)
        rest = F.substr(body, F.length(first) + F.lit(len(mark) + 1))
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, F.substr(rest, F.length(second) + F.lit(len(MIDDLE) + 1))

    prefix, suffix, middle = parted(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parted(PREFIX)
    return F.when(form == "plain", output).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(psm)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    rows = transform(docs.select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))
