"""Toxicity by a support vector machine with a subsequence string kernel.

A text is read as sentences of words in 31 symbols: letters without case and accents, digits as the letters they
look like; marks inside a word are skipped, and single letters in a row are one word, so that "i.d.i o t" is read
as its letters. Two words are as alike as their common subsequences of three and four symbols, a start and an end
mark included; up to two skipped symbols are allowed, each at the price of DECAY. A sentence scores as its highest
word does.

The machine is trained on the sentences of labelled documents, of which only the document's label is known: the
words that stand out of the toxic ones by the mean difference of the kernel come first, then each round takes the
highest word of each toxic document and the highest ones of clean documents and solves again. Nyström landmarks,
the words that were ever highest and some of the background, span the solution. As the kernel is a product of
subsequence counts, the landmarks' sum folds into one weight a subsequence: scoring a word adds up table entries,
equal to comparing it with every landmark.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.tables import stored
from sylvaflow.llm.text import mix

DECAY, MARK, LONGEST, STRIDE = 0.5, 31, 24, 12
#: Offsets of the subsequences' symbols, and how many symbols each skips.
GAPS = [((0, *c), c[-1] - n) for n in (2, 3) for c in combinations(range(1, n + 3), n)]
SIZE = 2**15 + 2**20
#: Bounds of the labelled sample: documents of each class, distinct words of one document, landmarks, and words in one solution.
DOCUMENTS, WORDS, LANDMARKS, ACTIVE = 2_000, 2_000, 256, 6_000
ROUNDS, COST = 4, 4.0
#: Words of a toxic document that teach in a round, and the share of clean documents whose highest word they must exceed.
TOP, USUAL = 5, 0.95
#: How many times more often in toxic documents than in clean ones a word must be to teach.
RARER = 4
#: Characters of a text that are read at once.
SEGMENT = 1 << 19
_WIDTHS = (5, 8, 12, 17, LONGEST)
#: Digits read as the letters they look like.
_LOOKS = dict(zip("0134578", "oieastb"))


@cache
def _symbols() -> np.ndarray:
    """The symbol of each code point up to 65535: 0 for white space, 255 for what is skipped."""
    table = np.full(1 << 16, 255, np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isspace():
            table[code] = 0
        elif c.isalnum():
            base = _LOOKS.get(c) or unicodedata.normalize("NFKD", c)[0].lower()
            table[code] = ord(base) - 96 if "a" <= base <= "z" else 27 + code % 4
    return table


def segments(texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Groups of (row of each, parts of texts) with SEGMENT characters in all. A longer text is cut after white
    space if it has any there; else the parts overlap by a word's window."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end, following = min(len(text), at + SEGMENT), None
            if end < len(text):
                space = max(text.rfind(c, at + 1, end) for c in " \n\t")
                end, following = (space, None) if space > 0 else (end, end - LONGEST)
            rows.append(row)
            parts.append(text[at:end])
            size += end - at
            at = following or end
            if size >= SEGMENT:
                yield np.array(rows), parts
                rows, parts, size = [], [], 0
    if parts:
        yield np.array(rows), parts


def words(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words of parts of texts, a row of LONGEST symbols each, and the part each is of. A longer word is
    given as windows, STRIDE apart."""
    code = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _symbols()[np.minimum(code, 65535)]
    kind[code > 65535] = 255
    start = np.cumsum([0] + [len(p) + 1 for p in parts])
    place = np.flatnonzero(kind != 255)
    kind = kind[place]
    inside = np.concatenate([[False], kind > 0, [False]])
    first, last = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(first):
        return np.zeros((0, LONGEST), np.uint8), np.zeros(0, np.int64)
    length, part = last - first, np.searchsorted(start, place[first], "right") - 1
    single = length == 1
    joins = np.zeros(len(first), bool)
    joins[1:] = single[1:] & single[:-1] & (part[1:] == part[:-1])
    group = np.flatnonzero(~joins)
    length, part = np.add.reduceat(length, group), part[group]
    letters = kind[kind > 0]
    begin = np.cumsum(length) - length
    pieces = np.where(length <= LONGEST, 1, -((STRIDE - length) // STRIDE))
    skip = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRIDE
    begin, length, part = np.repeat(begin, pieces) + skip, np.minimum(np.repeat(length, pieces) - skip, LONGEST), np.repeat(part, pieces)
    out = np.zeros((len(begin), LONGEST), np.uint8)
    for j in range(LONGEST):
        have = length > j
        out[have, j] = letters[begin[have] + j]
    return out, part


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, and of each word its number among these."""
    keys = np.zeros((len(rows), 2), np.uint64)
    for j in range(LONGEST):
        keys[:, j // 12] |= rows[:, j].astype(np.uint64) << np.uint64(5 * (j % 12))
    with np.errstate(over="ignore"):
        _, index, back = np.unique(mix(keys[:, 0] + mix(keys[:, 1])), return_index=True, return_inverse=True)
    return rows[index], back


def _framed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words between marks, and their lengths."""
    length = (rows > 0).sum(1)
    out = np.zeros((len(rows), rows.shape[1] + 2), np.int32)
    out[:, 0], out[:, 1:-1] = MARK, rows
    out[np.arange(len(rows)), length + 1] = MARK
    return out, length


def _occurrences(framed: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each kind of subsequence a matrix of its numbers from each start, and its weight. A subsequence
    that holds padding has a number of weight 0."""
    for offsets, skipped in GAPS:
        wide = framed.shape[1] - offsets[-1]
        if wide <= 0:
            continue
        number = np.zeros((len(framed), wide), np.int32)
        full = np.ones((len(framed), wide), bool)
        for k in offsets:
            piece = framed[:, k : k + wide]
            number = (number << 5) | piece
            full &= piece > 0
        yield np.where(full, number + (2**15 if len(offsets) == 4 else 0), 0), DECAY**skipped


@cache
def _scale() -> np.ndarray:
    """By length of a word, what makes its kernel with itself about 1: the root of its squared occurrences."""
    out = np.ones(LONGEST + 1)
    for n in range(LONGEST + 1):
        squares = sum(max(0, n + 2 - offsets[-1]) * DECAY ** (2 * skipped) for offsets, skipped in GAPS)
        out[n] = 1 / np.sqrt(max(squares, 1))
    return out


def _by_width(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, framed words, scales) of words of about equal length, at most 20,000 at once."""
    length = (rows > 0).sum(1)
    low = -1
    for width in _WIDTHS:
        chosen = np.flatnonzero((length > low) & (length <= width))
        low = width
        for k in range(0, len(chosen), 20_000):
            part = chosen[k : k + 20_000]
            framed, n = _framed(rows[part, :width])
            yield part, framed, _scale()[n]


def word_scores(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The machine's value of each word, without its bias."""
    out = np.zeros(len(rows))
    for part, framed, scale in _by_width(rows):
        total = np.zeros(len(part))
        for number, weight in _occurrences(framed):
            total += weight * table[number].sum(1)
        out[part] = total * scale
    return out


def _means(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean of a table over each word's subsequences, by their weights."""
    flat = np.ones(len(table))
    table[0] = flat[0] = 0
    return word_scores(rows, table) / np.maximum(word_scores(rows, flat), 1e-9)


def _folded(rows: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """Sum of the words' subsequence counts, each times its amount."""
    out = np.zeros(SIZE)
    for part, framed, scale in _by_width(rows):
        for number, weight in _occurrences(framed):
            out += np.bincount(number.ravel(), np.repeat(amounts[part] * scale * weight, number.shape[1]), SIZE)
    out[0] = 0
    return out


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of words with landmarks."""
    wanted = np.zeros(SIZE, bool)
    for _, framed, _ in _by_width(landmarks):
        for number, _ in _occurrences(framed):
            wanted[number] = True
    wanted[0] = False
    used = np.flatnonzero(wanted)
    place = np.zeros(SIZE, np.int32)
    place[used] = np.arange(1, len(used) + 1)
    columns = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for part, framed, scale in _by_width(landmarks):
        for number, weight in _occurrences(framed):
            np.add.at(columns, (place[number], part[:, None]), (weight * scale)[:, None].astype(np.float32))
    columns[0] = 0
    out = np.zeros((len(rows), len(landmarks)), np.float32)
    for part, framed, scale in _by_width(rows):
        for number, weight in _occurrences(framed):
            at = place[number]
            for j in range(at.shape[1]):
                some = np.flatnonzero(at[:, j])
                out[part[some]] += np.float32(weight) * columns[at[some, j]]
        out[part] *= scale[:, None].astype(np.float32)
    return out


def _solved(x: np.ndarray, y: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """Weights and bias with the least squared hinge loss and half squared norm, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(25):
        near = y * (x @ w) < 1
        xs, cost = x[near], COST * amount[near]
        new = np.linalg.solve((xs * cost[:, None]).T @ xs + np.diag(ridge), xs.T @ (cost * y[near]))
        if np.abs(new - w).max() < 1e-6 * max(1, np.abs(new).max()):
            return new
        w = new
    return w


class Sample:
    """The labelled sample: distinct words, and for each document the numbers of its words."""

    def __init__(self, docs: list[tuple[int, bytes]]):
        flat = np.frombuffer(b"".join(d[1] for d in docs), np.uint8).reshape(-1, LONGEST)
        self.toxic = np.array([d[0] for d in docs], bool)
        self.sizes = np.array([len(d[1]) // LONGEST for d in docs])
        self.rows, self.word = distinct(flat)
        self.doc = np.repeat(np.arange(len(docs)), self.sizes)

    def highest(self, values: np.ndarray, chosen: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The `most` words of the highest values of each chosen document, and these values."""
        use = np.flatnonzero(chosen[self.doc])
        order = use[np.lexsort((-values[self.word[use]], self.doc[use]))]
        doc = self.doc[order]
        rank = np.arange(len(order)) - np.searchsorted(doc, doc)
        best = self.word[order[rank < most]]
        return best, values[best]


def fitted(sample: Sample, chosen: np.ndarray) -> tuple[np.ndarray, float]:
    """Table of subsequence weights and bias from the chosen documents."""
    counts = [np.bincount(sample.word[chosen[sample.doc] & (sample.toxic[sample.doc] == k)], minlength=len(sample.rows)) for k in (False, True)]
    number = [max(1, (chosen & (sample.toxic == k)).sum()) for k in (False, True)]
    clean, toxic = (_folded(sample.rows, c / n) for c, n in zip(counts, number))
    values = _means(sample.rows, np.log((toxic + 0.5 / number[1]) / (clean + 0.5 / number[1])))
    rng = np.random.default_rng(7)
    pure = np.flatnonzero(counts[0] > 0)
    background = rng.choice(pure, min(len(pure), ACTIVE // 2), replace=False)
    hard, taught = np.zeros(0, int), np.zeros(len(sample.rows), int)
    table, bias = np.zeros(SIZE), -1.0
    for _ in range(ROUNDS):
        best, high = sample.highest(values, chosen & sample.toxic, TOP)
        _, usual = sample.highest(values, chosen & ~sample.toxic, 1)
        best = best[high > (np.quantile(usual, USUAL) if len(usual) else -np.inf)]  # a toxic label without a word that stands out teaches nothing
        taught = np.maximum(taught, np.bincount(best, minlength=len(taught)))
        positive = np.flatnonzero((taught > 0) & (counts[0] * number[1] * RARER < counts[1] * number[0]))
        if not len(positive):
            break
        amount = taught[positive]
        frequent = positive[np.argsort(-amount, kind="stable")[: LANDMARKS * 3 // 4]]
        landmarks = np.unique(np.concatenate([background[: LANDMARKS // 4], frequent]))
        hard = np.unique(np.concatenate([hard, pure[np.argsort(-values[pure], kind="stable")[: ACTIVE // (2 * ROUNDS)]]]))
        negative = np.setdiff1d(np.concatenate([background, hard]), positive)
        inner = kernel(sample.rows[landmarks], sample.rows[landmarks]).astype(float)
        e, v = np.linalg.eigh((inner + inner.T) / 2)
        root = v / np.sqrt(np.maximum(e, 1e-4)) @ v.T
        x = kernel(sample.rows[np.concatenate([positive, negative])], sample.rows[landmarks]) @ root
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        w = _solved(x, y, np.concatenate([amount.astype(float), np.ones(len(negative))]))
        table, bias = _folded(sample.rows[landmarks], root @ w[:-1]), float(w[-1])
        values = word_scores(sample.rows, table) + bias
    return table, bias


def _evidence(highest: np.ndarray, above: np.ndarray, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What a document's score is made of: its highest word, how many are above 0, how far for its size."""
    return np.stack([np.clip(highest, -3, 3), np.log1p(above), np.log1p(20 * total / np.maximum(n, 1)), np.ones(len(n))], 1)


def _logistic(x: np.ndarray, y: np.ndarray, amount: np.ndarray) -> np.ndarray:
    """Logistic weights with a small ridge, by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, 0.05), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (amount * (p - y)) + ridge * w
        step = np.linalg.solve((x * (amount * p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Weights of subsequences, bias and the step from a document's words to its score."""

    def __init__(self, docs: list[tuple[int, bytes]], totals: tuple[int, int]):
        self.rate = totals[1] / max(1, sum(totals))
        self.table = None
        if not docs:
            return
        sample = Sample(docs)
        if not sample.toxic.any() or sample.toxic.all() or not len(sample.word):
            return
        every = np.ones(len(docs), bool)
        fold = np.zeros(len(docs), int)
        for k in (False, True):
            own = np.flatnonzero(sample.toxic == k)
            fold[own] = np.arange(len(own)) % 2
        folds = [fold == k for k in (0, 1)] if sample.toxic.sum() > 3 and (~sample.toxic).sum() > 3 else [every]
        evidence = np.zeros((len(docs), 4))
        for rest in folds:  # each half is judged by what the other taught
            table, bias = fitted(sample, ~rest if len(folds) > 1 else every)
            evidence[rest] = self._of(sample, word_scores(sample.rows, table) + bias, len(docs), bias)[rest]
        present = np.array([max(1, (~sample.toxic).sum()), sample.toxic.sum()])
        amount = (np.array(totals) / present)[sample.toxic.astype(int)]
        use = np.arange(evidence.shape[1])
        while True:  # more evidence never lowers a score
            step = _logistic(evidence[:, use], sample.toxic.astype(float), amount / amount.mean())
            if (step[:-1] >= 0).all():
                break
            use = np.delete(use, np.argmin(step[:-1]))
        self.step = np.zeros(evidence.shape[1])
        self.step[use] = step
        table, self.bias = fitted(sample, every)
        self.table = table.astype(np.float32)

    @staticmethod
    def _of(sample: Sample, values: np.ndarray, n: int, bias: float) -> np.ndarray:
        state = State(n, bias)
        state.add(sample.doc, values[sample.word])
        return state.evidence()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A score from 0 to 1 of each text; one without words scores as an empty word does."""
        if self.table is None:
            return np.full(len(texts), self.rate)
        state = State(len(texts), self.bias)
        for rows, parts in segments(texts):
            found, part = words(parts)
            if len(found):
                known, back = distinct(found)
                state.add(rows[part], (word_scores(known, self.table) + self.bias)[back])
        return 1 / (1 + np.exp(-np.clip(state.evidence() @ self.step, -30, 30)))


class State:
    """Highest word, words above 0, their sum and the number of words by document, as parts of it are added."""

    def __init__(self, n: int, bias: float):
        self.highest = np.full(n, min(bias, 0.0))
        self.above, self.total, self.n = np.zeros(n), np.zeros(n), np.zeros(n)

    def add(self, doc: np.ndarray, values: np.ndarray) -> None:
        np.maximum.at(self.highest, doc, values)
        over = np.maximum(values, 0)
        self.above += np.bincount(doc, values > 0, len(self.n))
        self.total += np.bincount(doc, over, len(self.n))
        self.n += np.bincount(doc, minlength=len(self.n))

    def evidence(self) -> np.ndarray:
        return _evidence(self.highest, self.above, self.total, self.n)


def held_out(doc_id: str = "doc_id"):
    """Whether an id is of the fifth that is never learnt from; a null id isn't, and has no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text, at most WORDS of them, spread over all by their hash."""
    for batch in batches:
        out = []
        for text in batch.column("text"):
            seen = np.zeros((0, LONGEST), np.uint8)
            for _, parts in segments([text.as_py()]):
                seen, _ = distinct(np.concatenate([seen, words(parts)[0]]))
                seen = seen[:WORDS]
            out.append(seen.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(out, pa.binary())], ["doc_id", "toxic", "words"])


def learnt(documents: DataFrame, labels: DataFrame, most: int = DOCUMENTS) -> Model:
    """The model of at most `most` labelled documents of each class, those of the least hash of their ids."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = stored(marked, "labels")
    totals = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = [marked.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("doc_id", "text", "toxic")
    rows = texts.mapInArrow(_words_of, "doc_id long, toxic int, words binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("words").alias("words")).orderBy("doc_id").collect()
    return Model([(r.toxic, bytes(r.words)) for r in rows], (totals.get(0, 0), totals.get(1, 0)))


def toxicity(documents: DataFrame, labels: DataFrame, most: int = DOCUMENTS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document.

    Only labels of 0 and 1 outside the held-out fifth teach; a document labelled both ways counts as toxic, a
    repeated label once. Where either class is missing, each score is the share of toxic labels, 0 without any
    label. Null and empty texts, and texts without letters, score as a text of one empty word. Texts of any
    length are read whole, in parts; a word longer than 24 symbols in windows. Repeated rows are each scored;
    of a repeated id's texts the one with the least words' bytes may teach. Null ids are scored, and not held
    out. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    model = learnt(documents, labels, most)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
