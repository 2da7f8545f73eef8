"""Exact byte-level BPE encoding of Arrow text columns with the public tokenizers library.

The pre-tokenizer always cuts where a space follows a non-space, and before the last space of a
run. Texts are cut there, equal pieces of a batch are encoded once, and their ids are gathered. Where
a space stands between other white space such a cut would be wrong; those texts are cut only between
a non-space and a space. A piece never holds both ends of such a place, so a long text is encoded in
short pieces, and only a text without any space is one piece.

Letters, and the punctuation after them, are one pre-token each. So of "word," the ids are those of
"word" and of ",", and a run of letters goes to the library's BPE model at once; all other new pieces
go through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sylvaflow.llm.text import Words, as_strings, offsets

#: Bytes of the pieces whose ids a worker keeps; beyond it the store starts anew. Longer pieces aren't kept.
CACHE_BYTES, LONGEST = 48 << 20, 1 << 10
#: Marks that are one pre-token after letters.
TAIL = ".,!?:;%*&$#"
_BLANK = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
UNSAFE = rf"{_BLANK} (?:{_BLANK}|$)|^ (?:{_BLANK}|$)"
#: Runs of letters of blocks in which all assigned characters are letters, whatever the Unicode version.
LETTERS = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{388}-\x{3ce}\x{400}-\x{481}]+$"
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
# Byte-level alphabets show printable bytes as themselves, the others as the characters after 255 in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def _hashes(words: pa.Array) -> np.ndarray:
    spans = Words(words, lower=False)
    return spans.spans(spans.rows[:-1], spans.rows[1:])


class _Pieces:
    """Pieces of one kind (at a text's start, or after a space) and their ids' numbers in the store.

    They stand in runs sorted by hash, each over twice as long as the next, so a look-up searches few runs and an
    addition seldom sorts a long one: neither goes over all pieces for each slice of text."""

    def __init__(self) -> None:
        self.runs: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def add(self, names: pa.Array, hashes: np.ndarray, number: np.ndarray) -> None:
        run = (names, hashes, number)
        while self.runs and len(self.runs[-1][1]) <= 2 * len(run[1]):
            old = self.runs.pop()
            run = (pa.concat_arrays([old[0], run[0]]), *(np.concatenate([x, y]) for x, y in zip(old[1:], run[1:])))
        order = np.argsort(run[1], kind="stable")
        self.runs.append((run[0].take(pa.array(order)), run[1][order], run[2][order]))

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for unknown ones. Equal hashes count only with equal bytes."""
        out = np.full(len(words), -1, np.int64)
        for names, known, number in self.runs:
            left = np.flatnonzero(out < 0)
            if not len(left) or not len(known):
                continue
            place = np.minimum(np.searchsorted(known, hashes[left]), len(known) - 1)
            hit = known[place] == hashes[left]
            left, place = left[hit], place[hit]
            equal = pc.equal(names.take(pa.array(place)), words.take(pa.array(left))).to_numpy(zero_copy_only=False)
            out[left[equal]] = number[place[equal]]
        return out


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        for word in (" word", "Größe"):
            if self._encode([word]) != self._model([word.strip()], word[: word.startswith(" ")]):
                raise ValueError("not a byte-level BPE vocabulary")
        self.clear()

    def clear(self) -> None:
        self.kinds = (_Pieces(), _Pieces())
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1, np.int64)
        self.held = 0

    def _store(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new entries with these ids, one after another."""
        used, have = int(self.at[-1]), len(self.at) - 1
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
        self.ids[used : used + len(ids)] = ids
        self.at = np.concatenate([self.at, used + np.cumsum(sizes)])
        return np.arange(have, have + len(sizes))

    def _encode(self, words: list[str], space: str = "") -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([space + w for w in words], add_special_tokens=False)]

    def _model(self, words: list[str], space: str = "") -> list[list[int]]:
        """Ids of runs of letters, after `space`."""
        tokenize, mark = self.model.tokenize, space.translate(_BYTE_CHARS)
        shown = (mark + (w if w.isascii() else w.encode().decode("latin-1").translate(_BYTE_CHARS)) for w in words)
        return [[t.id for t in tokenize(w)] for w in shown]

    def _learn(self, names: pa.Array, kind: int) -> np.ndarray:
        """Numbers of new pieces."""
        space = " " if kind else ""
        stems = pc.utf8_rtrim(names, TAIL)
        word = pc.match_substring_regex(stems, LETTERS)
        whole = pc.equal(pc.binary_length(stems), pc.binary_length(names))
        out = np.zeros(len(names), np.int64)
        as_mask = lambda m: m.to_numpy(zero_copy_only=False)
        for mask, encode in ((pc.and_(word, whole), self._model), (pc.invert(word), self._encode)):
            own = names.filter(mask).to_pylist()
            if own:
                got = encode(own, space)
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                out[as_mask(mask)] = self._store(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes)
        joined = pc.and_not(word, whole)
        stems, full = stems.filter(joined), names.filter(joined)
        if len(full):
            size = pc.binary_length(stems).to_numpy()
            raw = np.frombuffer(full.buffers()[2], np.uint8)
            begin, end = offsets(full)[:-1] + size, offsets(full)[1:]
            tails = pa.array([raw[a:b].tobytes().decode() for a, b in zip(begin.tolist(), end.tolist())], pa.large_string())
            both = np.empty(2 * len(full), np.int64)
            for k, (part, of) in enumerate(((stems, kind), (tails, 0))):
                coded = part.dictionary_encode()
                both[k::2] = self._numbers(coded.dictionary, of)[coded.indices.to_numpy()]
            source, sizes = self._gather(both)
            out[as_mask(joined)] = self._store(self.ids[source], sizes.reshape(-1, 2).sum(1))
        return out

    def _numbers(self, words: pa.Array, kind: int) -> np.ndarray:
        """Store number of each of the distinct words, as pieces of a kind."""
        have, hashes = self.kinds[kind], _hashes(words)
        out = have.find(words, hashes)
        fresh = out < 0
        if fresh.any():
            new = words.filter(pa.array(fresh))
            number = out[fresh] = self._learn(new, kind)
            short = pc.less_equal(pc.binary_length(new), LONGEST)
            kept, mask = new.filter(short), short.to_numpy(zero_copy_only=False)
            have.add(kept, hashes[fresh][mask], number[mask])
            self.held += kept.nbytes
        return out

    def _gather(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ids of stored pieces, one after another, and how many each has."""
        size = self.at[piece + 1] - self.at[piece]
        end = np.cumsum(size)
        return np.repeat(self.at[piece] - (end - size), size) + np.arange(end[-1] if len(end) else 0), size

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Store number of every piece, and the first piece of each row."""
        if self.held > CACHE_BYTES or self.at[-1] > CACHE_BYTES:
            self.clear()
        odd = pc.match_substring_regex(texts, UNSAFE)
        parts = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        counts = np.diff(parts.offsets.to_numpy()).astype(np.int64)
        words, later = parts.flatten(), np.ones(len(parts.values), bool)
        first = np.concatenate([[0], np.cumsum(counts)])
        later[first[:-1]] = False
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(rows):
            # the empty piece of such a row makes room for its own pieces
            cut = [_SAFE_CUT.split(t) for t in texts.take(pa.array(rows)).to_pylist()]
            more = np.ones(len(counts), np.int64)
            more[rows] = [len(c) for c in cut]
            own = pa.array([w for c in cut for w in c], pa.large_string())
            mine = odd.to_numpy(zero_copy_only=False)
            number = np.where(mine, more, counts)
            start = np.concatenate([[0], np.cumsum(number)])
            order = np.zeros(start[-1], np.int64)
            is_odd = np.repeat(mine, number)
            order[is_odd] = len(words) + np.arange(len(own))
            keep = np.ones(len(words), bool)
            keep[first[:-1][rows]] = False
            order[~is_odd] = np.flatnonzero(keep)
            words = pa.concat_arrays([words, own]).take(pa.array(order))
            flags = np.concatenate([later, np.zeros(len(own), bool)])
            later, first = flags[order], start
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(index), np.int64)
        for kind, mask in enumerate((~later, later)):
            used = np.zeros(len(coded.dictionary), bool)
            used[index[mask]] = True
            some = np.flatnonzero(used)
            if len(some):
                number = np.zeros(len(used), np.int64)
                number[some] = self._numbers(coded.dictionary.take(pa.array(some)), kind)
                out[mask] = number[index[mask]]
        return out, first

    def counts(self, column: pa.Array) -> np.ndarray:
        """Ids of each text; only lengths are made."""
        texts = as_strings(column)
        if not len(texts):
            return np.zeros(0, np.int64)
        piece, first = self._pieces(texts)
        return np.add.reduceat(self.at[piece + 1] - self.at[piece], first[:-1])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first of each text."""
        texts = as_strings(column)
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        piece, first = self._pieces(texts)
        source, size = self._gather(piece)
        start = np.zeros(len(texts) + 1, np.int64)
        start[1:] = np.cumsum(size)[first[1:] - 1]
        return self.ids[source], start


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
