"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

Every leaf of the tree is the rank of one adjacent pair of symbols. The root
names the leftmost pair of the lowest rank; merging it changes three leaves, so
a word of n symbols is encoded in O(n log n), however long it is. Words are
the pieces that the vocabulary's pattern cuts a normalised text into. Short
words that a worker meets for the first time are merged together, each with a
tree of its own: one step of all of them is a few operations on arrays.
"""

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_MERGE = 1 << 60

#: Words whose codes a worker keeps, in each of two generations, and the longest
#: word that is kept. Any other word is encoded again.
CACHE_WORDS, CACHE_CHARS = 120_000, 40

#: Characters of text whose new words are merged together, words in one set of
#: arrays, and the fewest words of about one length that are worth it.
GROUP_CHARS, MOST_TREES, LEAST_TREES = 1_000_000, 10_000, 32


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, all others are numbered
    from 256 on.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 256
    for byte in range(256):
        if byte in printable:
            letters.append(chr(byte))
        else:
            letters.append(chr(spare))
            spare += 1
    return letters


def merge_word(symbols: list[int], merges: dict[int, int], joined: list[int], radix: int) -> list[int]:
    """``symbols`` with all merges applied, lowest rank first, leftmost of equals.

    ``merges`` gives the rank of the pair ``left * radix + right``, ``joined``
    the symbol that a rank makes. ``tree`` holds the leaves, one per adjacent
    pair, from ``leaves`` on; node i is the lower of 2 i and 2 i + 1.
    """
    count = len(symbols)
    get = merges.get
    ranks = [get(a * radix + b, NO_MERGE) for a, b in zip(symbols, symbols[1:])]
    leaves = 1 << (count - 2).bit_length() if count > 2 else 1
    tree = ranks + [NO_MERGE] * (leaves - count + 1)
    level = tree
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        tree = level + tree
    tree = [NO_MERGE, *tree]
    after = list(range(1, count + 1))
    before = list(range(-1, count - 1))
    while (low := tree[1]) != NO_MERGE:
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] != low:
                node += 1
        at = node - leaves
        right = after[at]
        made = symbols[at] = joined[low]
        symbols[right] = -1
        behind = after[at] = after[right]
        changed = []
        if behind < count:
            before[behind] = at
            changed.append((node, get(made * radix + symbols[behind], NO_MERGE)))
            changed.append((leaves + right, NO_MERGE))
        else:
            changed.append((node, NO_MERGE))
        if (ahead := before[at]) >= 0:
            changed.append((leaves + ahead, get(symbols[ahead] * radix + made, NO_MERGE)))
        for node, rank in changed:
            if tree[node] == rank:
                continue
            tree[node] = rank
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                if other < rank:
                    rank = other
                if tree[node] == rank:
                    break
                tree[node] = rank
    return [s for s in symbols if s >= 0]


class PairRanks:
    """Ranks of many pairs at once; ``none``, which is no symbol, merges with nothing."""

    def __init__(self, merges: dict[int, int], joined: list[int], radix: int):
        self.none, self.step = radix, radix + 1
        pairs = np.fromiter(merges, np.int64, len(merges))
        keys = pairs // radix * self.step + pairs % radix
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        ranks = np.fromiter(merges.values(), np.int64, len(merges))
        self.ranks = np.append(ranks[order], NO_MERGE)
        self.joined = np.array(joined, np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.step + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_MERGE)


def merge_words(symbols: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> list[list[int]]:
    """``merge_word`` of many short words, whose symbols follow each other in ``symbols``.

    Every word has a row with one more place before and at least one behind
    it, which hold no symbol. Leaf i of its tree is the pair of places i and
    i + 1. Each round merges one pair in every word that still has one.
    """
    words, levels = len(lengths), int(lengths.max()).bit_length()
    leaves, width = 1 << levels, (1 << levels) + 1
    places = np.arange(width)
    held = (places > 0) & (places <= lengths[:, None])
    row_symbols = np.full((words, width), pairs.none, np.int64)
    row_symbols[held] = symbols
    tree = np.full((words, 2 * leaves), NO_MERGE, np.int64)
    paired = held[:, :-1] & held[:, 1:]
    tree[:, leaves:][paired] = pairs.of(row_symbols[:, :-1][paired], row_symbols[:, 1:][paired])
    size = leaves
    while size > 1:
        np.minimum(
            tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2], out=tree[:, size // 2 : size]
        )
        size //= 2
    after = np.tile(places + 1, words)
    before = np.tile(places - 1, words)
    flat, nodes = row_symbols.reshape(-1), tree.reshape(-1)
    row, root = np.arange(words) * width, np.arange(words) * 2 * leaves
    while True:
        low = nodes[root + 1]
        going = np.flatnonzero(low != NO_MERGE)
        if not going.size:
            break
        row, root, low = row[going], root[going], low[going]
        node = np.ones(len(low), np.int64)
        for _ in range(levels):
            node *= 2
            node += nodes[root + node] != low
        at = node - leaves
        right, ahead = after[row + at], before[row + at]
        behind = after[row + right]
        made = pairs.joined[low]
        flat[row + at] = made
        flat[row + right] = pairs.none
        after[row + at] = behind
        before[row + behind] = at
        next_rank = pairs.of(made, flat[row + behind])
        last_rank = pairs.of(flat[row + ahead], made)
        roots = np.concatenate([root, root, root])
        node = np.concatenate([at, right, ahead]) + leaves
        nodes[roots + node] = np.concatenate([next_rank, np.full(len(at), NO_MERGE), last_rank])
        for _ in range(levels):
            node >>= 1
            child = roots + 2 * node
            nodes[roots + node] = np.minimum(nodes[child], nodes[child + 1])
    kept = row_symbols != pairs.none
    ids = row_symbols[kept].tolist()
    ends = list(accumulate(kept.sum(axis=1).tolist()))
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


# What the vocabulary's pattern finds in lower-case ASCII, for the faster library.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value
_PLAIN_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+").findall


class Vocabulary:
    """Token ids, merges and special tokens of a byte-level BPE with word ends."""

    def __init__(self, definition: str):
        parts = json.loads(definition)
        model = parts["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {
            i: t for t, i in self.special.items()
        }
        self.names = {i: str(i) for i in self.tokens}
        # A pair of ids is one number; the made symbol is known by the rank.
        self.radix = max(self.ids.values()) + 1
        self.merges: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.ids[left] * self.radix + self.ids[right]] = rank
            self.joined.append(self.ids[left + right])
        pieces = parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pieces != _PATTERN:
            raise ValueError(f"unknown pattern of words: {pieces}")
        self.pattern = regex.compile(pieces)
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")")
        self.letters = byte_letters()
        self.first = [self.ids[c] for c in self.letters]
        self.last = [self.ids[c + self.end] for c in self.letters]
        self.pairs = PairRanks(self.merges, self.joined, self.radix)
        self.first_of, self.last_of = np.array(self.first), np.array(self.last)

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word and its ids; those whose trees are of one size are merged together."""
        sizes: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            if word[0] == " ":
                yield word, self.encode_word(word)
                continue
            data = word.encode("utf-8", "replace")
            sizes.setdefault(len(data).bit_length(), []).append((word, data))
        for alike in sizes.values():
            if len(alike) < LEAST_TREES:
                for word, _ in alike:
                    yield word, self.encode_word(word)
                continue
            for start in range(0, len(alike), MOST_TREES):
                some, data = zip(*alike[start : start + MOST_TREES])
                lengths = np.fromiter(map(len, data), np.int64, len(data))
                code_units = np.frombuffer(b"".join(data), np.uint8)
                ends = np.cumsum(lengths) - 1
                symbols = self.first_of[code_units]
                symbols[ends] = self.last_of[code_units[ends]]
                yield from zip(some, merge_words(symbols, lengths, self.pairs))

    def encode_word(self, word: str) -> list[int]:
        """Ids of a word, or of a special token with a blank before it."""
        if word[0] == " ":
            return [self.special[word[1:]]]
        data = word.encode("utf-8", "replace")
        symbols = [self.first[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if len(symbols) == 1:
            return symbols
        return merge_word(symbols, self.merges, self.joined, self.radix)

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens.

        White space only parts words, so it needs no normalising of its own.
        """
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "\u03a3" in text or "\u0130" in text:
                # Letter by letter: a capital sigma becomes the same small one everywhere.
                text = "".join(map(str.lower, text))
            else:
                text = text.lower()
            return self.pattern.findall(text)
        return _PLAIN_WORDS(text.lower())


class Codes(dict):
    """Ids and tokens, both joined by blanks, by word; what isn't there is encoded.

    Two generations of limited size: words not met again while one fills go.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        code = self.older.get(word)
        if code is None:
            code = self.code(self.vocabulary.encode_word(word))
            if len(word) > CACHE_CHARS:
                return code
        self.keep(word, code)
        return code

    def code(self, ids: list[int]) -> tuple[str, str]:
        names, tokens = self.vocabulary.names, self.vocabulary.tokens
        return " ".join([names[i] for i in ids]), " ".join([tokens[i] for i in ids])

    def keep(self, word: str, code: tuple[str, str]) -> None:
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = code

    def learn(self, words: Iterable[str]) -> None:
        """Encode those of ``words``, each given once, that are short and not there."""
        older = self.older
        new = [w for w in words if w not in self and w not in older and len(w) <= CACHE_CHARS]
        for word, ids in self.vocabulary.encode_words(new):
            self.keep(word, self.code(ids))


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known = Codes(vocabulary)

    def cut(self, text: str | None) -> list[str]:
        """Words and special tokens of ``text``; a blank, which no word has, leads the latter."""
        if not text:
            return []
        vocabulary = self.vocabulary
        if "<|" not in text:
            return vocabulary.words(text)
        pieces = []
        for part in vocabulary.split_special.split(text):
            if part in vocabulary.special:
                pieces.append(" " + part)
            else:
                pieces.extend(vocabulary.words(part))
        return pieces

    def codes(self, text: str | None) -> list[tuple[str, str]]:
        """Ids and tokens of each word and special token of ``text``."""
        return list(map(self.known.__getitem__, self.cut(text)))

    def codes_of(self, texts: Iterable[str | None]) -> Iterator[list[tuple[str, str]]]:
        """``codes`` of each text, with the new words of several texts encoded together."""
        cuts, chars = [], 0
        for text in texts:
            cuts.append(self.cut(text))
            chars += len(text or "")
            if chars >= GROUP_CHARS:
                yield from self._codes_of_cuts(cuts)
                cuts, chars = [], 0
        yield from self._codes_of_cuts(cuts)

    def _codes_of_cuts(self, cuts: list[list[str]]) -> Iterator[list[tuple[str, str]]]:
        self.known.learn(set().union(*cuts))
        for pieces in cuts:
            yield list(map(self.known.__getitem__, pieces))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for code in self.codes(text) for i in code[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: the vocabulary's file names no decoder."""
        tokens = self.vocabulary.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


@lru_cache(maxsize=2)
def _codec(definition: str) -> Codec:
    return Codec(Vocabulary(definition))


def load_definition(path: str) -> str:
    """The vocabulary's file, read once on the driver: some megabytes, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_documents(
    docs: DataFrame,
    definition: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``.

    ``with_ids`` adds the ids themselves (``ids``, an array) and the decoded
    text (``decoded``). A null or empty text has no token; strings of special
    tokens in a text are those tokens. Every row stands for itself, so
    repeated rows and null ids need no care, and nothing is shuffled.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([few.schema["doc_id"]]).add("n_tokens", "long")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            lengths, ids, decoded, id_marks, text_marks = [], [], [], [], []
            texts = (value.as_py() for value in batch.column("text"))
            for codes in codec.codes_of(texts):
                joined, back = map(" ".join, zip(*codes)) if codes else ("", "")
                lengths.append(joined.count(" ") + 1 if codes else 0)
                id_marks.append(_hex(joined))
                text_marks.append(_hex(back))
                if with_ids:
                    ids.append([int(i) for i in joined.split()])
                    decoded.append(back)
            columns = [batch.column("doc_id"), pa.array(lengths, pa.int64())]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            columns += [pa.array(id_marks, pa.string()), pa.array(text_marks, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return few.mapInArrow(encode, schema)
