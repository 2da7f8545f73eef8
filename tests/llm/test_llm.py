"""The corpus operators against brute force, exact round trips and planted cases."""

import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from conftest import SMALL
from pyspark.sql import functions as F

from sylvaflow.llm import decontaminate, encoding, html_text, near_dup, queries
from sylvaflow.llm.decontaminate import leaks, without_leaks
from sylvaflow.llm.html_text import host_of, main_text
from sylvaflow.llm.licenses import aligned, license_scan
from sylvaflow.llm.lm_score import cross_entropy_difference, mixture
from sylvaflow.llm.mixing import mixed, mixing_rates
from sylvaflow.llm.near_dup import near_duplicates, one_of_each
from sylvaflow.llm.pii import ENTITY, with_surrogates
from sylvaflow.llm.quality import kept_by_quality, quality
from sylvaflow.llm.token_blocks import BLOCK, encoded, pack, read_blocks, unpack, write_blocks
from sylvaflow.llm.token_counts import token_counts

SPACES = " \t\n\v\f\r"


def words_of(text):
    out, run = [], []
    for c in text or "":
        if c in SPACES:
            if run:
                out.append("".join(run))
            run = []
        else:
            run.append(c)
    return [*out, "".join(run)] if run else out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", 7, "a"), (2, "", None, 8, "b"), (None, "no id here at all", "en", 9, "c"), (3, "same words", "de", 1, "d"), (3, "same words", "de", 1, "d"), (4, "ab cd " * 60_000, "en", 2, "e"), (5, " \n\t ", "xx", 3, "f"), (6, "x" * 300_000, None, 4, "g")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int, rate string")


def test_near_duplicates_are_those_of_all_pairs(spark, texts):
    sets = {}
    for i, t in texts.items():
        w = words_of(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = queries.op2_near_dup(spark, SMALL).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_copies_that_link_only_to_their_original_are_found(spark):
    rng = np.random.default_rng(5)
    original = [f"w{k}" for k in range(200)]
    rows = [(2000, " ".join(original))]
    for i in range(1000):  # 181 of 211 shingles are shared with the original, about 166 of 226 with each other
        words = list(original)
        for k in (rng.integers(5, 60), rng.integers(70, 125), rng.integers(135, 190)):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    rows += [(3000 + i, " ".join(original[:100] + [f"y{i}-{k}" for k in range(100)])) for i in range(100)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {i: 0 if i <= 2000 else i for i, _ in rows}


@pytest.mark.parametrize(("percent", "blocks"), [(85, (1024, 4096)), (80, (8, 16))])
def test_links_of_many_hubs_in_one_region_are_found(spark, monkeypatch, percent, blocks):
    rng, n = np.random.default_rng(11), 300
    base = [f"w{k}" for k in range(n)]
    put = lambda words, at, tag: [f"{tag}-{k}" if k in at else w for k, w in enumerate(words)]
    rows, want = [], {}
    for hub in range(30):  # hubs share half their words, their copies link with their own hub alone
        own = put(base, set(rng.choice(n // 2, 8, False).tolist()), f"h{hub}")
        own = own[: n // 2] + [f"t{hub}-{k}" if k % 12 == 0 else w for k, w in enumerate(own[n // 2 :])]
        for i in range(20):
            rows.append((100 * hub + i, " ".join(put(own, set(rng.choice(n, 3, False).tolist()), f"x{hub}-{i}") if i else own)))
            want[100 * hub + i] = 100 * hub
    monkeypatch.setattr(near_dup, "FEW_BLOCK", blocks[0])
    monkeypatch.setattr(near_dup, "ALL_BLOCK", blocks[1])
    monkeypatch.setattr(near_dup, "_neighbours", lambda percent: lambda batches: iter(()))  # the regions alone find all
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    assert got == want


def test_links_without_a_common_run_of_minima_are_found(spark, monkeypatch):
    # 4 of 5 shingles: about one pair in 5,600 shares no three leading minima in any tree
    pairs = [[f"{k}w{j}" for j in range(9)] for k in range(40_000)]
    rows = [(2 * k + side, " ".join(words[side:])) for k, words in enumerate(pairs) for side in (0, 1)]
    monkeypatch.setattr(near_dup, "_neighbours", lambda percent: lambda batches: iter(()))  # the exact pass alone finds all
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_duplicates(docs, 80).filter("component_id <> doc_id - doc_id % 2").collect() == []


def test_prefixes_of_similar_sets_meet_and_put_common_shingles_last():
    rng = np.random.default_rng(4)
    levels = rng.integers(0, 5, 1 << near_dup.BUCKET_BITS).astype(np.uint8)
    for n in (1, 2, 5, 39, 40, 41, 300):
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for percent in (80, 85, 100):
            fewest = -(-n * percent // 100)  # of n shared ones, the last in order: the least that still link
            last = one[np.lexsort((one, levels[near_dup._bucket(one)]))][n - fewest :]
            got, start = near_dup.prefixes(np.concatenate([one, np.sort(last)]), np.array([0, n, n + fewest]), levels, percent)
            assert np.intersect1d(got[: start[1]], got[start[1] :]).size
            place = levels[near_dup._bucket(got[: start[1]])]
            assert start[1] == n - fewest + 1 and place.max() <= np.sort(levels[near_dup._bucket(one)])[start[1] - 1]


def test_sketches_differ_in_no_more_bits_than_sets_in_values():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)) for k in (1, 40, 0, 900)]
    sets.append(np.sort(np.concatenate([sets[1][:30], sets[3][:5]])))
    found = near_dup.sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))
    for x, a in zip(found, sets):
        for y, b in zip(found, sets):
            apart = len(np.setxor1d(a, b))
            assert np.bitwise_count(x ^ y).sum() <= apart and (apart > 40 or np.bitwise_count(x ^ y).sum() >= apart - 8)


def test_shingles_with_the_same_ends_are_one_region_and_no_pair_is_lost(spark):
    rng = np.random.default_rng(8)
    held = {node: {*rng.choice(150, 8, False).tolist()} for node in range(-40, 40)}
    held |= {node: held[node - 1000] | {*range(1000, 1400)} for node in (1000, 1001, 1002)}  # near copies share 400
    known = spark.createDataFrame([(node, sorted(x)) for node, x in held.items() for _ in range(2)], "node long, prefix array<long>")
    rows = near_dup._members(known).collect()
    regions = defaultdict(set)
    for r in rows:
        regions[r.region].add(r.node)
    met = {(a, b) for x in regions.values() for a in x for b in x}
    assert {(a, b) for a in held for b in held if a != b and held[a] & held[b]} <= met
    assert len(rows) == sum(map(len, regions.values())) < 1000  # 3 x 400 for the copies alone before


def test_neighbours_that_sketches_refute_are_not_read(spark, monkeypatch):
    rows, seen, real = [], [], near_dup._linked
    for k in range(40):  # 376 of 396 shingles in common, and 296 of 496
        words = [f"{k}w{j}" for j in range(400)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(words[:380])), (3 * k + 2, " ".join(words[:300] + [f"{k}x{j}" for j in range(100)]))]

    def linked(docs, nodes, part, pairs, percent):
        of = {r.node: r.doc_id for r in nodes.collect()}
        seen.append(sorted(tuple(sorted((of[r.a], of[r.b]))) for r in pairs.collect()))
        return real(docs, nodes, part, pairs, percent)

    monkeypatch.setattr(near_dup, "_linked", linked)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {i: i - (i % 3 == 1) for i, _ in rows}
    assert seen == [[(3 * k, 3 * k + 1) for k in range(40)]]


def test_rows_that_repeat_an_id_keep_their_own_classes(spark):
    base = [f"w{k}" for k in range(120)]
    x, y = list(base), [f"v{k}" for k in range(120)]
    x[60] = "other"
    rows = [(5, " ".join(base)), (5, " ".join(y)), (2, " ".join(x)), (1, " ".join(y[:-1] + ["end"]))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect())
    assert got == [(1, 116, 1), (2, 116, 2), (5, 116, 1), (5, 116, 2)]


def test_a_segment_is_encoded_in_slices():
    seen = []

    class Code:
        def encode(self, column):
            seen.append(sum(map(len, column.to_pylist())))
            sizes = [len(t) % 7 for t in column.to_pylist()]
            return np.arange(sum(sizes), dtype=np.uint32) + 1, np.concatenate([[0], np.cumsum(sizes)])

    texts = ["x" * (k * 1009 % 40_000) for k in range(200)]
    ids, sizes = encoded(Code(), pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), 0)
    assert len(seen) > 3 and max(seen) < 1_200_000 and sum(seen) == sum(map(len, texts))
    assert sizes.tolist() == [len(t) % 7 + 1 for t in texts] and np.flatnonzero(ids == 0).tolist() == (np.cumsum(sizes) - 1).tolist()


def test_known_pieces_are_found_in_few_sorted_runs():
    pieces, hashed = encoding._Pieces(), lambda words: encoding._hashes(pa.array(words, pa.large_string()))
    for k in range(200):
        words = [f"w{k}-{j}é"[: 3 + j] + str(k) for j in range(k % 5)] + [f"x{k}\n"]
        pieces.add(pa.array(words, pa.large_string()), hashed(words), 1000 * k + np.arange(len(words)))
    assert len(pieces.runs) <= 9 and sum(len(r[1]) for r in pieces.runs) == 600
    asked = ["x7\n", "x7", "w9-3é9", "", "x199\n"]
    assert pieces.find(pa.array(asked, pa.large_string()), hashed(asked)).tolist() == [7002, -1, 9003, -1, 199_004]
    assert pieces.find(pa.array(["other"], pa.large_string()), hashed(["x7\n"])).tolist() == [-1]  # equal hashes, other bytes


def test_token_counts_and_blocks_are_the_librarys(spark, texts):
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: code.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    got = {r.doc_id: r for r in queries.op6_token_counts(spark, SMALL).collect()}
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {i: (len((texts[i] or "").encode()), len(x), len(x) > 1024) for i, x in ids.items()}
    start, want = 0, {}
    for i in sorted(ids):
        own = np.array([*ids[i], 0], "<u4")
        want[i] = (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_blocks(spark, SMALL).collect()} == want


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 5 * BLOCK + 7):
        ids = rng.integers(0, 50257, n, dtype=np.uint32)
        ids[rng.random(n) < 0.97] %= 50
        assert (unpack(n, **pack(ids)) == ids).all()
    assert (unpack(3, **pack(np.array([7, 7, 2**32 - 1], np.uint32))) == [7, 7, 2**32 - 1]).all()


def test_quality_measures(spark, texts):
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, SMALL).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        w = words_of(t)
        threes = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(threes)
        repeated = len({k + j for k, x in enumerate(threes) if often[x] > 1 for j in range(3)})
        lines, seen = 0, set()
        for line in (t or "").split("\n"):
            if words_of(line):
                lines += line in seen
                seen.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), lines, repeated)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * repeated > 50 * len(w)) and not (r.base_failed and r.kept)


def test_texts_without_function_words_are_rejected(spark):
    rng = np.random.default_rng(2)
    made = lambda: "".join(chr(97 + k) for k in rng.integers(0, 26, 5))
    common = "the of and to in a is that for it with as was on are by this be from or".split()
    rows = [(i, " ".join(common[rng.integers(20)] if rng.random() < 0.26 and i < 90 else made() for _ in range(200)), "en") for i in range(100)]
    got = {r.doc_id: r.quality.kept for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {i: i < 90 for i in range(100)}


def test_leaks_against_all_windows(spark, texts):
    items = {r.item_id: words_of(lower(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, SMALL).collect()}
    whole = set()
    for i, t in texts.items():
        joined = " " + " ".join(words_of(lower(t))) + " "
        whole |= {(i, k) for k, w in items.items() if len(w) >= 5 and f" {' '.join(w)} " in joined}
    assert whole and whole <= got
    for i, k in got:  # every hit holds most of the item's shingles
        w, v = words_of(lower(texts[i])), items[k]
        mine = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        theirs = {tuple(v[j : j + 5]) for j in range(len(v) - 4)}
        assert len(mine & theirs) >= 0.6 * len(theirs)


def test_leaks_at_the_threshold_are_found(spark):
    rng, five = np.random.default_rng(3), lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    items, docs, want = [], [], {}
    for k, (size, changed) in enumerate([(50, 1), (60, 1), (100, 2), (150, 3), (200, 4), (300, 6)] * 15):
        item = [f"i{k}-{j}" for j in range(size)]
        near = list(item)
        for j in rng.choice(size, changed, replace=False):
            near[j] = f"new{j}"
        doc = [f"a{k}-{j}" for j in range(80)] + near + [f"b{k}-{j}" for j in range(80)]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(doc)))
        best = 0.0
        for j in range(len(doc) - size + 1):
            x, y = five(doc[j : j + size]), five(item)
            both = sum((x & y).values())
            best = max(best, both / (sum(x.values()) + sum(y.values()) - both))
        if best >= 0.8:
            want[k] = round(best, 9)
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 0.8)
    got = {r.doc_id: round(r.similarity, 9) for r in found.collect()}
    assert len(want) > 40 and got == want, (len(got), len(want))


def test_repeated_items_are_one(spark):
    item, other = (" ".join(f"{c}{k}" for k in range(20)) for c in "ab")
    items = spark.createDataFrame([(1, item)] * 50 + [(1, other), (2, item), (None, item), (3, None), (4, "")], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"x {item} y {other}"), (7, item), (None, other), (8, "none of it")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity) for r in leaks(docs, items).collect()), key=str)
    assert got == [(7, 1, 0, 20, 1.0), (7, 1, 1, 20, 1.0), (7, 1, 22, 20, 1.0), (7, 2, 0, 20, 1.0), (7, 2, 1, 20, 1.0), (None, 1, 0, 20, 1.0)]
    assert [r.doc_id for r in without_leaks(docs, items).collect()] == [8]


def test_surrogates(spark):
    text = "Mail John.Doe12@mail3.Example.com or JOHN.DOE12@mail3.example.com, +1 (743) 555-3824 or 743-555-3824, 4111 1111 1111 1111, id 4111111111111112, from 8.196.197.208, token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\". Mrs Anna Schmidt met Mr Schmidt. господин Петров"
    docs = spark.createDataFrame([(1, text), (1, text), (2, "nothing of that kind"), (3, None)], "doc_id long, text string")
    rows = with_surrogates(docs, "k").collect()
    out = [r.text for r in rows if r.doc_id == 1]
    assert len(rows) == 4 and out[0] == out[1]
    assert {r.text for r in rows if r.doc_id != 1} == {"nothing of that kind", None}
    for gone in ("Doe12", "Example.com", "555-3824", "4111 1111 1111 1111", "8.196.197.208", "1eb9c6", "Schmidt", "Петров", "Anna"):
        assert gone not in out[0]
    assert "id 4111111111111112" in out[0] and "+1 (" in out[0]
    before, after = text.split(" "), out[0].split(" ")
    assert len(before) == len(after) and after[1].lower() == after[3].rstrip(",").lower()
    name = after[after.index("Mrs") + 2]
    assert name == after[after.index("Mr") + 1].rstrip(".") and after[after.index("Mrs") + 1].endswith("a")


def test_surrogates_stay_distinct(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("to "), F.conv("id", 10, 36), F.lit("@b.org")).alias("text"))
    rows = with_surrogates(docs, "k").collect()
    made = [r.entities[0].surrogate for r in rows]
    assert len(set(made)) == 400 and not set(made) & {np.base_repr(i, 36).lower() for i in range(400)}


def test_full_number_spaces_end(spark):
    """All of a two-digit space, a thousand of ten thousand short phones, and secrets of one character."""
    rows = [(i, f"call +49 {i // 10} {i % 10} now") for i in range(100)] + [(1000 + i, f"call +49 {20 + i % 80} {i // 80:02d} x") for i in range(1000)]
    rows += [(5000, "token = " + "-" * 20), (5001, "from 8.8.8.8 and 08.8.8.08")]
    got = {r.doc_id: r for r in with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for ids in (range(100), range(1000, 2000)):
        made = [got[i].entities[0].surrogate for i in ids]
        assert len(set(made)) == len(made) and all(re.fullmatch(r"\+49\d+", m) for m in made)
        assert {len(m) for m in made} == {5 if ids[0] == 0 else 7}
    assert "-" * 20 + " " not in got[5000].text + " " and len(got[5001].entities) == 2
    assert got[5001].entities[0].surrogate == got[5001].entities[1].surrogate != "8.8.8.8"


def test_surrogates_are_one_to_one_over_the_table(spark, texts):
    """Text around entities stays; each address part, and each number, has one surrogate, and no two the same."""
    entity = regex.compile(ENTITY)
    out = {r.doc_id: (r.text, r.n_entities) for r in queries.op3_surrogates(spark, SMALL).collect()}
    maps = defaultdict(dict)
    for i, t in texts.items():
        new, number = out[i]
        if not number:
            assert new == t
            continue
        mentions, gaps = [m[0] for m in entity.finditer(t)], [g for g in re.split("\0", entity.sub("\0", t))]
        at = 0
        made = []
        for k, gap in enumerate(gaps):
            assert new.startswith(gap, at) if k == 0 else True
            end = new.index(gap, at) if k < len(gaps) - 1 else len(new) - len(gap)
            if k:
                made.append(new[at:end])
            at = end + len(gap)
        assert len(made) == len(mentions)
        for a, b in zip(mentions, made):
            if "@" in a:
                for k, name in enumerate(("local", "domain")):
                    maps[name].setdefault(a.lower().split("@")[k], set()).add(b.lower().split("@")[k])
            elif regex.fullmatch(r"\d+(\.\d+){3}", a):
                maps["ip"].setdefault(a, set()).add(b)
    assert maps["local"]
    for name, pairs in maps.items():
        assert all(len(v) == 1 for v in pairs.values()), name
        made = [next(iter(v)) for v in pairs.values()]
        assert len(set(made)) == len(made) and not set(made) & set(pairs), name


def test_license_alignment(spark):
    assert aligned(list("abcxdef"), list("abqcydef")) == [(0, 0), (1, 1), (2, 3), (4, 5), (5, 6), (6, 7)]
    assert aligned([], [1]) == [] and aligned([1, 1], [1, 1]) == [(0, 0), (1, 1)]
    docs = spark.createDataFrame([(1, "Foo. Released under the MIT License. More, and released UNDER the mit license"), (2, "x " * 5000 + "Licensed under CC BY-NC 4.0.***"), (3, "the license of the mit under released the")], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.start_word, r.end_word) for r in license_scan(docs).collect())
    assert got == [(1, "MIT", 1, 6), (1, "MIT", 8, 13), (2, "CC-BY-NC-4.0", 5000, 5005)]


def test_scores_favour_the_target(spark):
    docs = spark.createDataFrame([(i, ("red green blue " if i % 2 else "one two three ") * 20) for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in cross_entropy_difference(docs, docs.filter("doc_id % 2 = 1")).collect()}
    assert all((s < 0) == bool(i % 2) for i, s in got.items())


def test_scores_are_those_of_counted_models(spark, texts):
    """Against dictionaries of all words and pairs, each document left out of its own models."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    target = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    words = {i: words_of(lower(t)) for i, t in texts.items()}
    counted = lambda ids, f: sum((Counter(f(words[i])) for i in ids), Counter())
    pairs_of, firsts_of = lambda w: zip(w, w[1:]), lambda w: w[:-1]
    models = [[counted(ids, f) for f in (list, firsts_of, pairs_of)] for ids in (words, sorted(target & words.keys()))]
    size = len(models[0][0])
    totals = [sum(m[0].values()) for m in models]
    for row in queries.op5_lm_score(spark, SMALL).collect():
        w = words[row.doc_id]
        assert row.n_tokens == len(w)
        if not w:
            assert row.score is None
            continue
        own = [Counter(f(w)) for f in (list, firsts_of, pairs_of)]
        losses = []
        for (single, first, pair), total, held in zip(models, totals, (True, row.doc_id in target)):
            loss = 0.0
            for k, x in enumerate(w):
                p = (single[x] - held * own[0][x] + 0.5) / (total - held * len(w) + 0.5 * size)
                if k and (n := first[w[k - 1]] - held * own[1][w[k - 1]]):
                    p = 0.5 * (pair[w[k - 1], x] - held * own[2][w[k - 1], x]) / n + 0.5 * p
                loss -= np.log(p)
            losses.append(loss / len(w))
        assert np.allclose([row.background_loss, row.target_loss, row.score], [*losses, losses[1] - losses[0]])


def test_models_are_distributions():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 12, 300)
    pairs, first = np.zeros((13, 13)), np.bincount(tokens[:-1], minlength=13)
    np.add.at(pairs, (tokens[:-1], tokens[1:]), 1)
    for v in range(13):  # the last word occurs in no pair
        assert np.isclose(mixture(pairs[v], np.full(13, first[v]), np.bincount(tokens, minlength=13), 300, 13).sum(), 1)


def test_rates_meet_the_targets(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing_rates(docs, labels, {"good": 0.6, "low": 0.3, "toxic": 0.1}, total=50_000).collect()
    sums = np.array([r.rate * r.n_tokens * np.array(r.posterior) for r in rows]).sum(0)
    assert min(r.rate for r in rows) >= 0 and np.allclose(sums, [30_000, 15_000, 5_000], rtol=1e-3)
    truth = defaultdict(list)
    for r in labels.join(spark.createDataFrame([(x.doc_id, float(x.posterior[2])) for x in rows], "doc_id long, p double"), "doc_id").collect():
        truth[r.toxic].append(r.p)
    assert np.mean(truth[1]) > 0.8 > 0.2 > np.mean(truth[0])


def test_registered_rates_meet_the_weights(spark):
    rows = queries.op10_mixing(spark, SMALL).collect()
    held = np.array([[r[f"p_{d}"] * r.n_tokens * r.rate for d in queries.WEIGHTS] for r in rows]).sum(0)
    assert np.allclose(held / held.sum(), list(queries.WEIGHTS.values()), atol=1e-5)
    assert np.isclose(held[0], sum(r.p_good * r.n_tokens for r in rows), rtol=1e-4)


def test_rates_of_a_repeated_id_and_of_ties(spark):
    docs = spark.createDataFrame([(i % 30, ("good words here " if i % 3 else "bad stuff ") * 5) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)] + [(0, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    rows = mixing_rates(docs, labels, {"good": 0.5, "low": 0.5}).collect()
    assert len(rows) == 60 and len({(r.doc_id % 3 == 0, round(r.rate, 9)) for r in rows}) == 2


def test_main_text(spark):
    page = "<html><head><title>T</title></head><body><nav>Menu</nav><article><h1>Head &amp; more</h1><p>One\n two.</p><div class='comments'>Reply</div></article><footer>Foot</footer><script>x<y</script></body></html>"
    pages = spark.createDataFrame([(1, "http://a.b/c", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    assert {r.page_id: r.blocks for r in main_text(pages).collect()} == {1: ["Head & more", "One two."], 2: [], 3: []}


def test_what_a_site_repeats_goes(spark):
    """Unmarked site parts on all pages and promo lines on all go; quotations, copies and tiny hosts stay."""
    def page(k, host="h.org"):
        body = f"<div><span>Site {host}</span> line</div><p>Subscribe now to all of it</p><article><h1>Title {k}</h1><p>Own words of page {k} {'and more ' * 20}</p><p>A quotation of many pages</p><ul><li>Buy it here</li></ul></article>"
        return (k, f"http://{host}/{k}", f"<html><body>{body if k % 2 else body.replace('<p>A quotation of many pages</p>', '')}<div>Other {k}</div></body></html>")

    rows = [page(k) for k in range(8)] + [page(k, "tiny.org") for k in (100, 101)] + [(200 + k, "http://copies.org/", page(1)[2]) for k in range(6)]
    got = {r.page_id: r.blocks for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == [f"Title {k}", f"Own words of page {k} {'and more ' * 20}".strip(), *["A quotation of many pages"] * (k % 2)]
    assert got[101][-1] == "Buy it here" and got[200] == got[205] and got[200][-1] == "Buy it here"


def test_templates_are_those_of_a_count_in_memory(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("url", "html", host_of(F.col("url")).alias("host"))
    pages = pages.unionByName(pages.withColumn("html", F.concat(F.col("html"), F.lit("<div>on all pages</div>"))))
    held, sizes = defaultdict(list), Counter()
    for row in pages.collect():
        sizes[row.host] += 1
        for key, parent in {(html_text._key(n, i), i): p for n, p, i in html_text._marked(html_text.parse(row.html or ""))}.items():
            held[row.host, *key].append(parent)
    want = set()
    for (host, key, inside), parents in held.items():
        n, different = len(parents), len(set(parents))
        if n >= 3 and n >= (0.9 if inside else 0.2) * sizes[host] and different >= min(5, sizes[host]):
            want.add((host, key))
    assert want == {tuple(r) for r in html_text.site_templates(pages).collect()} and want


def test_odd_pages():
    read = lambda s: html_text.blocks(html_text.parse(s))
    assert read("<body><form><h1>T</h1><p>story words here</p></form></body>") == ["T", "story words here"]
    assert read("<div><p>the story is this long text in a div</p></div><article><p>a comment</p></article>") == ["the story is this long text in a div"]
    assert read("<article><p>a <span class='share'>b</span></p><div class='content has-sidebar'>c</div></article>") == ["a b", "c"]
    begin = time.time()
    for bad in ("<a b " * 200_000, "<div>" * 4000 + "</x>" * 4000, "<b>" * 4000 + "<hr>" * 4000 + "</p>" * 4000, "<a b='" * 50_000):
        read(bad)
    assert time.time() - begin < 4


def test_short_articles_beside_long_furniture(spark):
    """Furniture goes at any size, the article stays at any."""
    read = lambda s: html_text.blocks(html_text.parse(f"<html><body>{s}</body></html>"))
    long = "".join(f"<li>entry number {k} of it</li>" for k in range(30))
    article = "<article><p>One sentence.</p></article>"
    for around in (f"<nav><ul>{long}</ul></nav>", f"<footer>{long}</footer>", f"<aside>{long}</aside>", f"<div role='navigation'>{long}</div>", f"<div class='sidebar'>{long}</div>", f"<div class='comments'>{long}</div>", f"<form>{long}</form>", f"<header>{long}</header>", f"<div id='comments'><article><p>{long}</p></article></div>"):
        assert read(around + article) == read(article + around) == ["One sentence."], around
        assert read(f"<main>{around}<p>One sentence.</p></main>") == ["One sentence."] or "<form" in around or "<article" in around, around
    assert read(f"<nav>{long}</nav><div><p>One sentence.</p></div><div class='comments'>{long}</div>") == ["One sentence."]
    assert read(f"<div class='promo'>{article}</div><nav>{long}</nav>") == ["One sentence."]
    assert read(f"<article><p>One sentence.</p><div class='comments'>{long}</div></article>") == ["One sentence."]
    assert read(f"<article><h1>Title</h1><p>One.</p></article><div>{long}</div>") == ["Title", "One."]
    assert read(f"<nav>{long}</nav>") == []


def test_short_articles_beside_long_template(spark):
    links = "".join(f"<li>link number {k} of the site</li>" for k in range(30))
    page = lambda k: (k, f"http://t.org/{k}", f"<html><body><div><ul>{links}</ul></div><article><h2>Title {k}</h2><p>Words of page {k}.</p></article><p>Other {k}</p></body></html>")
    got = {r.page_id: r.blocks for r in main_text(spark.createDataFrame([page(k) for k in range(9)], "page_id long, url string, html string")).collect()}
    assert all(got[k] == [f"Title {k}", f"Words of page {k}."] for k in range(9))


def test_odd_rows_and_empty_tables(spark, odd, tmp_path):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "no id here at all"), (2, None), (None, "x y z a b c"), (3, "few words")], "item_id long, text string")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")

    def blocks(d):
        path = str(tmp_path / f"blocks{d.count()}")
        write_blocks(d, vocabulary, path)
        return read_blocks(spark, path)

    whole = {
        "counts": lambda d: token_counts(d, vocabulary), "blocks": blocks, "quality": quality, "near": near_duplicates,
        "pii": lambda d: with_surrogates(d, "k"), "lm": lambda d: cross_entropy_difference(d, d), "mix": lambda d: mixing_rates(d, labels, queries.WEIGHTS),
    }
    for name, f in whole.items():
        assert f(odd).count() == 8, name
        assert f(odd.limit(0)).count() == 0, name
    some = {"leaks": lambda d: leaks(d, bench), "license": license_scan, "kept": kept_by_quality, "one": one_of_each, "clean": lambda d: without_leaks(d, bench), "mixed": lambda d: mixed(d, labels, queries.WEIGHTS)}
    for name, f in some.items():
        assert name == "mixed" or f(odd).count() <= 8, name
        assert f(odd.limit(0)).count() == 0, name
    for name in ("kept", "one", "clean", "mixed"):
        assert some[name](odd).columns == odd.columns
    # a small text may be repeated to meet the targets, one without tokens never
    assert some["mixed"](odd).filter("coalesce(trim(text, ' \t\n'), '') = ''").count() <= 3
    assert one_of_each(odd).count() == 7 and without_leaks(odd, bench).count() == 7


def test_pipeline_keeps_clean_and_distinct_documents(spark, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "token blocks"]
    found = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SMALL).collect()}
    judged = {r.doc_id for r in queries.op8_quality_rules(spark, SMALL).filter("kept").collect()}
    leaked = {r.doc_id for r in queries.op1_decontaminate(spark, SMALL).collect()}
    assert found.keys() <= judged - leaked and len(found) > 0.5 * len(judged)


def test_leaks_with_inserted_and_deleted_words_are_found(spark):
    """Against all windows of all lengths of items; tiles and whole windows find each by SimHash alone."""
    rng, five = np.random.default_rng(5), lambda w: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    items, docs, want = [], [], {}
    for k in range(160):
        size = int(rng.integers(8, 260))
        item = [f"i{k}-{j}" for j in range(size)]
        near = list(item)
        for _ in range(int(rng.integers(0, max(size // 45, 1) + 1))):
            j = int(rng.integers(0, len(near)))
            near[j : j + int(rng.integers(0, 2))] = [f"n{j}"] * int(rng.integers(0, 2))
        doc = [f"a{k}-{j}" for j in range(60)] + near + [f"b{k}-{j}" for j in range(60 * (k % 3 > 0))]
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(doc)))
        y, n = five(item), size - 4
        best = 0.0
        for j in range(len(doc) - 4):
            x = five(doc[j : j + size])
            both = sum((x & y).values())
            best = max(best, both / (sum(x.values()) + n - both))
        if best >= 0.8:
            want[k] = round(best, 9)
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 0.8)
    got = {r.doc_id: round(r.similarity, 9) for r in found.collect()}
    assert len(want) > 100 and got == want, {k: (want.get(k), got.get(k)) for k in want.keys() | got.keys() if want.get(k) != got.get(k)}


def test_leaks_in_very_long_texts(monkeypatch):
    """A text read in pieces has the matches of the whole one, also of an item over a cut and at the end."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 10**6, 20000)]
    items = [(k, " ".join(words[a : a + 40])) for k, a in enumerate((0, 777, 5000, 9990, 19960))]
    index = decontaminate.ItemIndex(items, 0.8)
    text = pa.array([None, items[1][1], "  ".join(words[:9000]) + "\n" + " ".join(words[9000:]), "x " * 50, items[0][1]])
    whole = index.matches(text)
    assert {k: v[1] for (r, k), v in whole.items() if r == 2} == {0: 0, 1: 777, 2: 5000, 3: 9990, 4: 19960} and len(whole) == 7
    for size in (64, 1000, 4096, 50000):
        monkeypatch.setattr(decontaminate, "PIECE", size)
        assert index.matches(text) == whole
    monkeypatch.setattr(decontaminate, "PIECE", 100)
    assert index.matches(pa.array(["x" * 5000])) == {} and index.matches(pa.array(["é " * 500])) == {}


def test_quality_distances_and_verdicts_against_plain_ones(spark, texts):
    from sylvaflow.llm import quality as q

    classes = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:!?'\"()-", "#*$%&|<>"]
    common = sorted({w for v in q.COMMON_WORDS.values() for w in v.split()})

    def chars(text):
        out = [0] * 10
        for c in text or "":
            out[next((k for k, s in enumerate(classes) if c in s), 8 if c < "\x80" else 7 if c < "\u0800" else 9)] += 1
        return out

    def common_words(text):
        found = Counter(w[:-1] if len(w) > 1 and w[-1] in ".,;:!?" else w for w in words_of(lower(text)))
        return [found[w] for w in common] + [sum(found.values()) - sum(found[w] for w in common)]

    def distance(a, b):
        if not sum(a) or not sum(b):
            return None
        a, b = np.array(a) / sum(a), np.array(b) / sum(b)
        m = (a + b) / 2
        part = lambda p: float(sum(x * np.log2(x / y) for x, y in zip(p, m) if x > 0))
        return max((part(a) + part(b)) / 2, 0) ** 0.5

    lang = {r.doc_id: r.lang or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, SMALL).collect()}
    refs = {}
    for i, t in texts.items():
        if not got[i].base_failed:
            x, y = refs.setdefault(lang[i], (np.zeros(10), np.zeros(len(common) + 1)))
            x += chars(t)
            y += common_words(t)
    assert len(got) == len(texts)
    for i, t in texts.items():
        x, y = refs.get(lang[i], ([0], [0]))
        c, w = distance(chars(t), x), distance(common_words(t), y)
        for mine, theirs in ((c, got[i].char_distance), (w, got[i].word_distance)):
            assert (mine is None) == (theirs is None) and (mine is None or abs(mine - theirs) < 1e-6), i
        bare = distance([0] * len(common) + [1], y) or 0
        most = min(q.WORD_MAX, q.WORD_SHARE * bare) if bare >= q.WORD_TELLS else q.WORD_MAX
        odd = sum(chars(t)) >= q.CHAR_LEAST and (c or 0) > q.CHAR_MAX or len(words_of(t)) >= q.WORD_LEAST and (w or 0) > most
        assert got[i].kept == (not got[i].base_failed and not odd), i
