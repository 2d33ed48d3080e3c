"""Parts of the text operators that need no Spark, against plain versions."""

import re
import sys
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from txscreen.llm import ann, bpe, jaccard, langid, quality, substrings
from txscreen.llm.queries import word_bpe_path

ODD_TEXTS = [
    "",
    " \n\t ",
    "Hello World's <|endoftext|> x<|startoftext|>y <|endoftext",
    "ΣΑΣ Σ İstanbul ſ ǅ Å ẞ ﬁ",
    "áé ½²३ ४५ 😀👍🏽 don't DON'T it'll x y\x85z\x1cw",
    "日本語テキスト ไทย 한국어 \x00b﻿c​d",
    "x" * 3000,
    "ab" * 2000 + "!" * 500,
]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Vocabulary(bpe.load_definition(word_bpe_path())))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe_path())


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_bpe_equals_the_library(codec, library, text):
    theirs = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == theirs
    assert codec.decode(theirs) == library.decode(theirs, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cn", "Cs", "Co"]), max_size=60))
def test_bpe_equals_the_library_on_any_text(codec, library, text):
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=40))
def test_segment_tree_merges_like_a_scan(symbols):
    """Merges over a small alphabet, where ties and runs of equal symbols abound."""
    radix, merges, joined = 100, {}, []
    made = 4
    for a in range(6):
        for b in range(0, 6, 2):
            merges[a * radix + b] = len(joined)
            joined.append(made)
            made += 1
    plain = list(symbols)
    while True:
        ranks = [merges.get(a * radix + b, 1 << 60) for a, b in zip(plain, plain[1:])]
        if not ranks or min(ranks) == 1 << 60:
            break
        at = ranks.index(min(ranks))
        plain[at : at + 2] = [joined[ranks[at]]]
    assert bpe.merge_word(list(symbols), merges, joined, radix) == plain


def test_cache_of_codes_keeps_its_size(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    vocabulary = bpe.Vocabulary(bpe.load_definition(word_bpe_path()))
    codes = bpe.Codes(vocabulary)
    words = ["a", "b", "c", "d", "a", "e", "f", "g"]
    assert [codes[w][1] for w in words] == [f"{w}</w>" for w in words]
    assert len(codes) <= 3 and len(codes.older) <= 3


def test_new_words_are_merged_together(library, monkeypatch):
    """Merging each new word on its own takes most of the time of a varied corpus."""
    alone = []
    merge_word = bpe.merge_word
    monkeypatch.setattr(bpe, "merge_word", lambda *a: alone.append(a) or merge_word(*a))
    letters = [a + b for a in "etaoinß" for b in ["", "r", "nd", "ing"]]
    texts = [
        " ".join(letters[i % 28] + letters[k % 28] + letters[i * k % 28] + "." for k in range(60))
        + "<|endoftext|>" * (i % 2)
        for i in range(80)
    ]
    texts += ["", None, "x" * 3000, *ODD_TEXTS]
    vocabulary = bpe.Vocabulary(bpe.load_definition(word_bpe_path()))
    for found, text in zip(bpe.Codec(vocabulary).codes_of(texts), texts, strict=True):
        ids = [int(i) for code in found for i in code[0].split(" ")]
        assert ids == library.encode(text or "", add_special_tokens=False).ids
    words = {w for t in texts if t for w in vocabulary.words(t)}
    assert len(words) > 500 and len(alone) < 150


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=40), min_size=1, max_size=8))
def test_words_merged_together_equal_single_ones(words):
    radix, merges, joined = 100, {}, []
    for a in range(10):
        for b in range(0, 8, 2):
            merges[a * radix + b] = len(joined)
            joined.append(4 + len(joined))
    alone = [bpe.merge_word(list(w), merges, joined, radix) if len(w) > 1 else w for w in words]
    pairs = bpe.PairRanks(merges, joined, radix)
    flat, lengths = np.concatenate(words), np.array([len(w) for w in words])
    assert bpe.merge_words(flat, lengths, pairs) == alone


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in quality.SYMBOLS for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ä#", "\n", " ", "\t", "\x0b", "c|", " "]), max_size=60))
def test_measures_of_a_text(parts):
    text = " ".join(parts)
    assert quality.measures(text) == plain_measures(text)


def test_measures_of_no_text():
    assert quality.measures(None) == quality.measures("") == (0, 0, 0, 0, 0)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=100, max_size=900))
def test_every_window_has_one_phrase(data):
    found = [(f, c) for first, count, _ in substrings.phrases(data) for f, c in zip(first, count)]
    windows = [w for f, c in found for w in range(f, f + c)]
    assert windows == list(range(len(data) - 99))


def test_phrases_do_not_depend_on_what_lies_around(monkeypatch):
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 256, 700, np.uint8).tobytes()
    noise = [rng.integers(0, 256, n, np.uint8).tobytes() for n in (333, 901)]
    monkeypatch.setattr(substrings, "PIECE", 256)
    names = []
    for before in noise:
        data = before + shared
        grams_ = {}
        for first, count, gram in substrings.phrases(data):
            for f, c, g in zip(first.tolist(), count.tolist(), gram.tolist()):
                for w in range(f, f + c):
                    grams_[w - len(before)] = g
        names.append({w: g for w, g in grams_.items() if w >= 0})
    assert names[0] == names[1]


@settings(max_examples=60, deadline=None)
@given(st.integers(32, 130), st.integers(0, 40), st.binary(max_size=300), st.binary(max_size=300), st.randoms())
def test_phrases_of_a_shared_window_share_its_side(length, more, before, behind, random):
    shared = random.randbytes(length + more)
    found = []
    for data, ahead in ((before + shared, len(before)), (shared + behind, 0)):
        windows = {}
        for piece, hashes, first, count, anchor in substrings._anchored(data, length):
            bits = substrings.sides(hashes, anchor, length)
            for f, c, a, both in zip(*(x.tolist() for x in (first, count, anchor, bits))):
                middle = a - substrings.reach(length) + 1
                for w in range(f, f + c):
                    windows[piece + w - ahead] = both >> 32 if w < middle else ~(both % 2**32)
        found.append([windows[w] for w in range(more + 1)])
    assert found[0] == found[1]


def test_runs_join_spans_that_touch():
    assert substrings.runs([(5, 9), (0, 3), (3, 5), (20, 30), (22, 25)]) == [(0, 9), (20, 30)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(0, 40))
def test_overlap_is_exact_once_it_reaches_the_least(a, b, least):
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    found = jaccard.overlap_reaching(x, y, least)
    assert found == len(a & b) if len(a & b) >= least else found < least


def test_shingles_by_the_contract():
    hashes = jaccard._WordHashes()
    assert len(jaccard.shingle_set(None, hashes)) == len(jaccard.shingle_set(" \n", hashes)) == 0
    assert len(jaccard.shingle_set("a b", hashes)) == 1
    same = [jaccard.shingle_set(t, hashes) for t in ("A b\tC  d e", "a B c d\ne")]
    assert len(same[0]) == 2 and (same[0] == same[1]).all()
    # Only A to Z is lower-cased.
    other = [jaccard.shingle_set(t, hashes) for t in ("É b c d", "é b c d")]
    assert other[0][0] != other[1][0]


def test_new_words_take_no_call_of_python_each():
    text = " ".join(f"w{i}" for i in range(5000))
    calls = []
    before = sys.getprofile()
    sys.setprofile(lambda frame, event, arg: calls.append(frame) if event == "call" else None)
    try:
        shingles = jaccard.shingle_set(text, jaccard._WordHashes())
    finally:
        sys.setprofile(before)
    assert len(shingles) == 4997 and len(calls) < 100


@settings(max_examples=100, deadline=None)
@given(st.text("ab \n", max_size=60), st.integers(1, 6))
def test_shingles_are_sorted_and_distinct(text, width):
    words = text.split()
    wide = min(width, len(words))
    plain = {tuple(words[i : i + wide]) for i in range(len(words) - wide + 1)} if words else set()
    found = jaccard.shingle_set(text, jaccard._WordHashes(), width)
    assert len(found) == len(plain) and (np.diff(found.astype(object)) > 0).all()


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=50), st.integers(0, 3), st.integers(0, 2**32))
def test_rare_shingles_come_first(values, most, seed):
    shingles = np.array(sorted(values), np.uint64)
    counts = np.random.default_rng(seed).integers(0, most + 1, 1 << jaccard.BUCKET_BITS)
    plain = sorted(values, key=lambda v: (counts[v >> (64 - jaccard.BUCKET_BITS)], v))
    assert jaccard.in_order(shingles, counts).tolist() == plain


def test_divide_skip_block_finds_all_links():
    """Against all pairs, connected components alike."""
    rng = np.random.default_rng(7)
    base = [rng.choice(10_000, 60, replace=False) for _ in range(6)]
    sets = {}
    for key in range(60):
        tokens = set(base[key % 6].tolist())
        for _ in range(int(rng.integers(0, 8))):
            tokens.discard(int(rng.choice(base[key % 6])))
            tokens.add(int(rng.integers(10_000, 10_200)))
        sets[key] = np.array(sorted(tokens), np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        sets[key].sort()
    block = jaccard._Block(85)
    for key, s in sets.items():
        block.add(key, key, s)
    links = [(k, other) for k, s in sets.items() for other in block.search(k, k, s)]

    def closed(pairs):
        forest = jaccard._Forest()
        for a, b in pairs:
            forest.join(a, b)
        return [forest.find(k) for k in sets]

    pairs = [
        (a, b)
        for a in sets
        for b in sets
        if a < b
        and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))
    ]
    assert pairs and closed(links) == closed(pairs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25)), max_size=9), st.integers(1, 6))
def test_merge_finds_what_is_in_enough_lists(sets, least):
    lists = [sorted(s) for s in sets]
    counts = Counter(i for s in sets for i in s)
    found = list(jaccard.merge_skip(lists, least))
    assert found == sorted((i, n) for i, n in counts.items() if n >= least)


def test_merge_skips_what_cannot_be_in_enough_lists():
    """One long list among short ones: it is left by binary search, not read through."""

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    long = Counted(range(100_000))
    assert list(jaccard.merge_skip([long, [5, 99_990], [99_990]], 3)) == [(99_990, 3)]
    assert Counted.reads < 60


def test_long_lists_are_probed_until_out_of_reach():
    rng = np.random.default_rng(9)
    sets = [np.sort(rng.choice(4000, 300, replace=False)).astype(np.uint64) for _ in range(50)]
    near = sets[0].copy()
    near[:20] = np.arange(5000, 5020)
    block = jaccard._Block(85)
    for key, s in enumerate([*sets, np.sort(near)]):
        block.add(key, key, s)
    probed, reaches = [], block._reaches

    def counted(place, count, long, least):
        probed.append(place)
        return reaches(place, count, long, least)

    block._reaches = counted
    assert block.search(0, 0, sets[0]) == [50] and probed == [50]
    assert 0 < jaccard.long_count(255, 50) < 254 and jaccard.long_count(1, 50) == 0


def test_codes_bound_inner_products():
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((500, 48))
    vectors[:20] = vectors[0]
    queries = rng.standard_normal((20, 48))
    centre, turn = vectors.mean(axis=0), ann.rotation(48)
    assert np.allclose(turn @ turn.T, np.eye(48))
    value, half = ann.estimate(*ann.encode(vectors, centre, turn), queries, centre, turn)
    off = np.abs(value - queries @ vectors.T)
    assert (off <= half).mean() > 0.97
    assert off.mean() < 0.8 * np.abs(queries @ vectors.T).mean()


def test_profile_ranks_by_count_then_code_point():
    found = langid.text_profile("aab ba")
    one = [g for g in found if g < 1 << 21]
    assert one[:2] == [ord("a"), ord("b")]
    assert (langid.text_profile("ÄÖ 12") == langid.text_profile("äö")).all()
