"""Quality rules: repetition and length measures, and distance from the document's language.

Of each text two histograms are made, over character classes and over the common words of the
languages below. Their Jensen-Shannon distance (the square root of the divergence to base 2, 0 to 1)
from the sum over all documents of the same language that pass the base rules says how unlike that
language the text is. Texts too short for a histogram to mean anything are not judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvaflow.llm.tables import stored
from sylvaflow.llm.text import Words, by_bytes, list_array, shingles

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it with as was on are by this be from or",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "fr": "de la le et les des en un une du que est pour dans qui par sur pas au plus",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
#: Symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"
CHAR_MAX, CHAR_LEAST = 0.32, 200
WORD_MAX, WORD_LEAST = 0.5, 100
#: Share of the distance of a text without common words that a text may have, where that distance
#: tells anything: in a language that hardly has the words above, only WORD_MAX holds.
WORD_SHARE, WORD_TELLS = 0.7, 0.22
#: Words that a text has at least, and percentage of words in repeated windows of three at most.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Languages up to which their histograms are broadcast; beyond it they are joined by a shuffle.
FEW_LANGUAGES = 1000

_CLASS = np.full(256, 8, np.int64)
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t", 3), ("\n\r\v\f", 4), (".,;:!?'\"()-", 5), (SYMBOLS, 6)):
    _CLASS[list(_chars.encode())] = _k
_CLASS[0xC0:0xE0] = 7  # letters of two bytes
_CLASS[0xE0:] = 9
_CLASS[0x80:0xC0] = -1  # continuation bytes are no characters
CHAR_BINS = 10
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
_VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
WORD_BINS = len(_VOCABULARY) + 1
_known = Words(pa.array(_VOCABULARY)).hash
_SORTED, _BIN = np.sort(_known), np.argsort(_known)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<long>, words array<long>"


def _per_row(mask: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[rows[1:]] - total[rows[:-1]]


def _repeated(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry, whether its key occurs in its row twice or more, and whether it came earlier."""
    order = np.lexsort((np.arange(len(key)), key, row))
    k, r = key[order], row[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    out[order], later[order] = twice, same
    return out, later


def measure(column: pa.Array) -> list[pa.Array]:
    """The MEASURES of each text."""
    words = Words(column, lower=False)
    data, rows, n = words.data, words.rows, len(words.rows) - 1
    counts = np.diff(words.first)
    row_of_word = np.repeat(np.arange(n), counts)
    letter = _CLASS[data] >= 0
    blank = np.isin(data, np.frombuffer(b" \t\n\v\f\r", np.uint8))
    n_symbols = _per_row(np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8)), rows)

    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    newline = np.flatnonzero(data == 10)
    start = np.union1d(newline + 1, rows[:-1][np.diff(rows) > 0])
    start = start[start < len(data)]
    stop = np.flatnonzero(edge[1:] | (data == 10)) if len(data) else start
    at = np.searchsorted(stop, start) if len(start) else start
    end = stop[at] + (data[stop[at]] != 10)
    seen = np.concatenate([[0], np.cumsum(~blank)])
    full = seen[end] > seen[start]
    start, end = start[full], end[full]
    line_row = np.searchsorted(rows, start, side="right") - 1
    _, again = _repeated(words.spans(start, end), line_row)
    n_dup = np.bincount(line_row[again], minlength=n)

    three, first = shingles(words.hash, words.first, 3)
    number = np.where(counts >= 3, np.diff(first), 0)
    three_row = np.repeat(np.arange(n), np.diff(first))
    valid = counts[three_row] >= 3
    twice, _ = _repeated(three[valid], three_row[valid])
    place = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(number)[:-1]]), number) + np.arange(number.sum())
    covered = np.zeros(len(words.start) + 3, bool)
    for j in range(3):
        covered[place[twice] + j] = True
    n_repeat = np.bincount(row_of_word[covered[: len(row_of_word)]], minlength=n)

    row_of_byte = np.repeat(np.arange(n), np.diff(rows))
    chars = np.bincount(row_of_byte[letter] * CHAR_BINS + _CLASS[data[letter]], minlength=n * CHAR_BINS)
    low = Words(column)
    tail = low.end - (_STOP[low.data[low.end - 1]] & (low.end - low.start > 1) if len(low.end) else 0)
    hashes = low.spans(low.start, tail)
    spot = np.minimum(np.searchsorted(_SORTED, hashes), len(_SORTED) - 1)
    slot = np.where(_SORTED[spot] == hashes, _BIN[spot], WORD_BINS - 1)
    bins = np.bincount(row_of_word * WORD_BINS + slot, minlength=n * WORD_BINS)
    return [
        pa.array(counts.astype(np.int64)), pa.array(_per_row(letter & ~blank, rows)), pa.array(n_symbols), pa.array(n_dup.astype(np.int64)), pa.array(n_repeat.astype(np.int64)),
        list_array(chars, np.arange(n + 1) * CHAR_BINS, pa.int64()), list_array(bins, np.arange(n + 1) * WORD_BINS, pa.int64()),
    ]


def _distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance of two histograms; null if one of them is empty."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)
    sums = F.struct(total(F.col(a)).alias("a"), total(F.col(b)).alias("b"))
    return F.transform(
        F.array(sums),
        lambda t: F.when(
            (t["a"] > 0) & (t["b"] > 0),
            F.aggregate(
                F.zip_with(a, b, lambda x, y: (part(x / t["a"], (x / t["a"] + y / t["b"]) / 2) + part(y / t["b"], (x / t["a"] + y / t["b"]) / 2)) / 2),
                F.lit(0.0),
                lambda s, x: s + x,
                lambda s: F.sqrt(F.greatest(s, F.lit(0.0))),
            ),
        ),
    )[0]


def language_histograms(docs: DataFrame) -> DataFrame:
    """language, ref_chars, ref_words: sums over all documents of a language (null: the empty string) that
    pass the base rules; a language without such documents has sums of zero and judges nothing.

    Each Arrow batch is summed before the shuffle, so a hot language sends a few rows a batch.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                got = measure(part.column("text"))
                n_words, n_repeat = got[0].to_numpy(), got[4].to_numpy()
                good = (n_words >= LEAST_WORDS) & (100 * n_repeat <= MOST_REPEATED * n_words)
                names, index = np.unique(np.array(part.column("language").to_pylist(), object), return_inverse=True)
                for k, size in ((5, CHAR_BINS), (6, WORD_BINS)):
                    grid = got[k].flatten().to_numpy().reshape(-1, size) * good[:, None]
                    total = np.zeros((len(names), size), np.int64)
                    np.add.at(total, index, grid)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, size), pa.string()), pa.array(np.tile(np.arange(size) + 1000 * (k == 6), len(names)), pa.int32()), pa.array(total.reshape(-1))], ["language", "bin", "n"])

    found = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("language"), "text").mapInArrow(sums, "language string, bin int, n long")
    bins = found.groupBy("language", "bin").agg(F.sum("n").alias("n"))
    side = lambda word: F.transform(F.array_sort(F.collect_list(F.when((F.col("bin") >= 1000) == word, F.struct("bin", "n")))), lambda x: x["n"])
    return bins.groupBy("language").agg(side(False).alias("ref_chars"), side(True).alias("ref_words"))


def quality(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs(doc_id, text, lang, ...) with a column `quality` (named apart if docs has one): a struct of
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance,
    base_failed, kept.

    kept is false if base_failed (fewer than 50 words, or over half of the words in repeated windows
    of three), or a text of CHAR_LEAST characters is over CHAR_MAX away, or one of WORD_LEAST words over
    WORD_MAX or over WORD_SHARE of what a text without common words is. Null and empty texts have zero
    measures and fail. Very long texts are measured whole, in one task each. A null language is one of its
    own. Repeated rows count each; an empty table gives an empty result. keep_text=False leaves only
    doc_id beside the struct.
    """
    refs = language_histograms(docs).withColumn("none", F.array(*[F.lit(int(k == WORD_BINS - 1)) for k in range(WORD_BINS)]).cast("array<long>"))
    most = F.col("most")
    refs = refs.withColumn("most", _distance("none", "ref_words"))
    refs = refs.withColumn("word_limit", F.when(most >= WORD_TELLS, F.least(F.lit(WORD_MAX), WORD_SHARE * most)).otherwise(WORD_MAX))
    refs = stored(refs.drop("none", "most"), "languages")
    refs = F.broadcast(refs) if refs.count() <= FEW_LANGUAGES else refs
    rows = docs if keep_text else docs.select("doc_id", "text", "lang")
    name, language = "quality", "language"
    while name in docs.columns:
        name += "_"
    while language in docs.columns:
        language += "_"
    kept = docs.columns if keep_text else ["doc_id"]
    inner = T.StructType.fromDDL(MEASURES)
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(language, T.StringType()), T.StructField(name, inner)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                struct = pa.StructArray.from_arrays(measure(part.column("text")), [f.name for f in inner])
                lang = part.column("lang").cast(pa.string()).fill_null("")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), lang, struct], [*kept, language, name])

    found = rows.mapInArrow(measured, schema).join(refs.withColumnRenamed("language", language), language, "left")
    q = F.col(name)
    found = found.withColumns({f"{name}_c": q["chars"], f"{name}_w": q["words"]})
    found = found.withColumns({f"{name}_c": _distance(f"{name}_c", "ref_chars"), f"{name}_w": _distance(f"{name}_w", "ref_words")})
    failed = (q["n_words"] < LEAST_WORDS) | (100 * q["n_repeat_words"] > MOST_REPEATED * q["n_words"])
    odd = (F.aggregate(q["chars"], F.lit(0).cast("long"), lambda s, x: s + x) >= CHAR_LEAST) & (F.coalesce(f"{name}_c", F.lit(0.0)) > CHAR_MAX)
    odd = odd | ((q["n_words"] >= WORD_LEAST) & (F.coalesce(f"{name}_w", F.lit(0.0)) > F.col("word_limit")))
    parts = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    result = F.struct(*parts, F.col(f"{name}_c").alias("char_distance"), F.col(f"{name}_w").alias("word_distance"), failed.alias("base_failed"), (~failed & ~odd).alias("kept"))
    return found.select(*kept, result.alias(name))


def kept_by_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    found = quality(docs)
    return found.filter(F.col(found.columns[-1])["kept"]).select(*docs.columns)
