"""Cross-entropy difference of matched n-gram models.

Both models are interpolations of word-pair and word frequencies over one vocabulary, all words of all
documents: the background model from all documents, the target model from the target documents. All
words and all pairs of neighbours are counted and none is left out, so the models grow with the corpus.
A document's own counts are taken out of both models before it is scored. Its score is the mean per
token of its loss under the target model less its loss under the background model: below zero, it is
more like the target.

Nothing that grows is broadcast or collected. Documents are put into chunks of CHUNK bytes, which are
stored as the distinct words of a chunk and a number for each token. A chunk asks for the counts of its
distinct words and pairs, each in the bucket of its hash, with the occurrences in the chunk; a bucket
adds what all chunks say of a key and answers each of them. So a key counts once a chunk, however
frequent it is: there are no hot keys, and buckets, as many as the corpus needs, are of equal size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.tables import small, stored
from sylvaflow.llm.text import Words, by_bytes, mix

#: Weight of the pair frequencies, and what is added to every word's count.
PAIR_WEIGHT, ADDED = 0.5, 0.5
#: Target ids that are broadcast at most; more are joined by a shuffle of the texts.
FEW_TARGETS = 1 << 21
#: Text bytes of a chunk, and keys that a bucket gets from all chunks, about.
CHUNK, BUCKET_KEYS = 5 << 20, 1 << 20
CHUNKS = "chunk long, doc_ids array<long>, sizes array<long>, target array<boolean>, n_tokens long, n_words long, words binary, stream binary"
ASKED = "bucket long, chunk long, keys binary, counts binary"
ANSWERS = "bucket long, chunk long, counts binary, n_distinct long"
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
_R = np.uint64(0x9E3779B97F4A7C15)


def mixture(pair: np.ndarray, first: np.ndarray, single: np.ndarray, total, vocabulary: int) -> np.ndarray:
    """Probability of a word after another: `pair` of the `first` pairs that begin with the other word are
    of both, and `single` of `total` words are the word. Sums to 1 over the vocabulary for every other word;
    without such pairs it is the word's own probability."""
    own = (single + ADDED) / (total + ADDED * vocabulary)
    return np.where(first > 0, PAIR_WEIGHT * pair / np.maximum(first, 1) + (1 - PAIR_WEIGHT) * own, own)


def _packed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type, which the first byte tells."""
    size = next(s for s in (1, 2, 4, 8) if counts.max(initial=0) < 1 << (8 * s - (s == 8)))
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId() << 32, 0
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        nonlocal seq
        ids, target = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
        sizes, hashes = (np.concatenate([h[k] for h in held]) for k in (2, 3))
        words, stream = np.unique(hashes, return_inverse=True)
        values = [part + seq, ids.to_pylist(), sizes.tolist(), target.to_pylist(), len(hashes), len(words), words.tobytes(), stream.astype("<u4").tobytes()]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        seq += 1
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["chunk", "doc_ids", "sizes", "target", "n_tokens", "n_words", "words", "stream"])

    size = 0
    for batch in batches:
        for rows in by_bytes(batch, "text"):
            words = Words(rows.column("text"))
            held.append((rows.column("doc_id"), rows.column("target"), np.diff(words.first), words.hash))
            size += len(words.data)
            if size >= CHUNK:
                yield out()
                held, size = [], 0
    if held:
        yield out()


class _Chunk:
    """A chunk's tokens, and its keys in the order of their buckets."""

    def __init__(self, row: dict, word_buckets: int, pair_buckets: int):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.stream = np.frombuffer(row["stream"], "<u4").astype(np.int64)
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.in_target = np.asarray(row["target"], bool)
        # the places at which a token follows another of its document
        self.second = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1 if len(self.doc) else self.doc
        code = self.stream[self.second - 1] * max(len(self.words), 1) + self.stream[self.second]
        codes, self.pair = np.unique(code, return_inverse=True)
        with np.errstate(over="ignore"):
            pairs = mix(self.words[codes // max(len(self.words), 1)] * _R + self.words[codes % max(len(self.words), 1)])
        # words in the buckets from 0 on, pairs in those after
        self.sets = [(keys, *self._dealt(keys, number, shift)) for keys, number, shift in ((self.words, word_buckets, 0), (pairs, pair_buckets, word_buckets))]

    @staticmethod
    def _dealt(keys: np.ndarray, number: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
        bucket = (((mix(keys) >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)).astype(np.int64) + shift
        order = np.argsort(bucket, kind="stable")
        return bucket[order], order

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(words x 4) occurrences and occurrences as first of a pair, (pairs x 2) occurrences: each in all
        documents, then in target documents."""
        own = self.in_target[self.doc]
        first = self.second - 1
        count = lambda index, size, mask: np.stack([np.bincount(index, minlength=size), np.bincount(index[mask], minlength=size)], axis=1)
        words = np.concatenate([count(self.stream, len(self.words), own), count(self.stream[first], len(self.words), own[first])], axis=1)
        return words, count(self.pair, len(self.sets[1][0]), own[self.second])

    def asks(self) -> Iterator[tuple[int, bytes, bytes]]:
        for (keys, bucket, order), counts in zip(self.sets, self.counts()):
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield int(bucket[a]), keys[order[a:b]].tobytes(), _packed(counts[order[a:b]].reshape(-1))

    def losses(self, answers: list[tuple[int, bytes]], totals: tuple[int, int], vocabulary: int) -> np.ndarray:
        """Summed losses (2 x documents): background, target."""
        got = []
        for (keys, bucket, order), width in zip(self.sets, (4, 2)):
            mine = {int(b) for b in np.unique(bucket)}
            flat = [_unpacked(raw) for b, raw in sorted(answers) if b in mine]
            table = np.zeros((len(keys), width), np.int64)
            table[order] = np.concatenate(flat).reshape(-1, width) if flat else 0
            got.append(table)
        words, pairs = got
        first = self.stream[self.second - 1]
        own = lambda index, doc, size: _own(doc * max(size, 1) + index)
        own_word, own_first = own(self.stream, self.doc, len(words)), own(first, self.doc[self.second], len(words))
        own_pair = own(self.pair, self.doc[self.second], len(pairs))
        out = np.zeros((2, len(self.sizes)))
        for m in (0, 1):
            left = np.ones(len(self.doc), np.int64) if m == 0 else self.in_target[self.doc].astype(np.int64)
            pair, before = np.zeros(len(self.doc)), np.zeros(len(self.doc))
            at = self.second
            pair[at] = pairs[self.pair, m] - own_pair * left[at]
            before[at] = words[first, 2 + m] - own_first * left[at]
            single = words[self.stream, m] - own_word * left
            p = mixture(pair, before, single, totals[m] - self.sizes[self.doc] * left, vocabulary)
            del pair, before, single
            out[m] = np.bincount(self.doc, -np.log(p), minlength=len(self.sizes))
        return out


def _own(key: np.ndarray) -> np.ndarray:
    """How often each entry's key occurs."""
    _, back, number = np.unique(key, return_inverse=True, return_counts=True)
    return number[back]


def _answer(rows: pa.Table) -> pa.Table:
    keys = [np.frombuffer(raw, np.uint64) for raw in rows.column("keys").to_pylist()]
    counts = [_unpacked(raw) for raw in rows.column("counts").to_pylist()]
    sizes = [len(k) for k in keys]
    width = len(counts[0]) // sizes[0]
    names, back = np.unique(np.concatenate(keys), return_inverse=True)
    table, said = np.concatenate(counts).reshape(-1, width), np.zeros((len(names), width), np.int64)
    for k in range(width):  # sums in doubles are exact below 2**53
        said[:, k] = np.bincount(back, table[:, k], len(names))
    ends = np.cumsum(sizes)
    answers = [_packed(said[back[b - n : b]].reshape(-1)) for b, n in zip(ends.tolist(), sizes)]
    distinct = np.where(np.arange(len(sizes)) == 0, len(names), 0)
    return pa.Table.from_arrays([rows.column("bucket"), rows.column("chunk"), pa.array(answers, pa.binary()), pa.array(distinct, pa.int64())], ["bucket", "chunk", "counts", "n_distinct"])


def target_documents(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled of good quality and not toxic."""
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()


def cross_entropy_difference(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (nats per word) of every row of docs(doc_id, text).

    target(doc_id): the documents of the target model. Words are lower-cased (A-Z). Null, empty and
    wordless texts have 0 tokens and null losses; a document without id is not of the target. With an
    empty target its model is uniform over the vocabulary. Repeated rows count each, so a row's copies
    stay in the models that score it; an empty table gives an empty result; other columns are ignored.
    """
    marks = target.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().withColumn("target", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(small(marks, FEW_TARGETS), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    chunks = stored(rows.mapInArrow(_chunks, CHUNKS), "chunks", "zstd")
    size = chunks.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum(F.aggregate(F.zip_with("sizes", "target", lambda n, t: F.when(t, n).otherwise(0)), F.lit(0).cast("long"), lambda s, n: s + n))).first()
    n_tokens, n_words, n_target = (int(x or 0) for x in size)
    buckets = (n_words // BUCKET_KEYS + 1, n_tokens // BUCKET_KEYS + 1)
    totals = (n_tokens, n_target)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                asks = list(_Chunk(row, *buckets).asks())
                columns = [pa.array([a[0] for a in asks], pa.int64()), pa.array([row["chunk"]] * len(asks), pa.int64()), *(pa.array([a[j] for a in asks], pa.binary()) for j in (1, 2))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "keys", "counts"])

    asked = chunks.select("chunk", "sizes", "target", "words", "stream").mapInArrow(ask, ASKED)
    answers = stored(asked.groupBy("bucket").applyInArrow(_answer, ANSWERS), "answers", "zstd")
    vocabulary = int(answers.filter(F.col("bucket") < buckets[0]).agg(F.sum("n_distinct")).first()[0] or 0)

    def score(chunk: pa.Table, said: pa.Table) -> pa.Table:
        (row,) = chunk.to_pylist()
        background, wanted = _Chunk(row, *buckets).losses(list(zip(said.column("bucket").to_pylist(), said.column("counts").to_pylist())), totals, vocabulary)
        n = np.asarray(row["sizes"], np.int64)
        many = np.maximum(n, 1)
        values = (wanted / many, background / many, (wanted - background) / many)
        return pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(n), *(pa.array(v, mask=n == 0) for v in values)], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    mine = chunks.select("chunk", "doc_ids", "sizes", "target", "words", "stream").groupBy("chunk")
    return mine.cogroup(answers.select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(score, SCORES)
