"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

Frequent words, counted over the whole corpus by Spark, are compiled with their token ids into a minimal acyclic
automaton. Suffixes are shared; the ids are reached through numbers added up along the arcs (each arc carries how many
lexicon words sort before the ones below it), so a word's walk ends with its row in a table of token ids. The compiled
arrays go to every executor as one file and are memory-mapped. Words outside the lexicon are merged exactly, by the
vocabulary's merge ranks, and memoised up to a bound.

Defined results: null text is the empty text; empty text has no tokens; the two special tokens' strings are recognised in
raw text as the tokenizers library does; texts of any length are encoded whole; repeated rows give repeated results.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
import struct
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import give_back, stored
from auditweave.storage import put

LEXICON_WORDS = 100_000
MEMO_WORDS = 250_000
#: Of texts that are cut together, but for a longer one.
MOST_BYTES = 1 << 21
#: White space as the vocabulary's pre-tokeniser sees it (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BLANK = re.compile(f"[{SPACE}]+")
#: str.split() would also split at these.
ODD = re.compile("[\x1c-\x1f]")
#: A full stop or comma next to other punctuation.
BESIDE = re.compile(r"[.,](?:[^\w\s]|_|(?<=[^\w\s.,][.,])|(?<=_[.,]))")
#: What lower() puts behind the i of a dotted capital I.
DOT = "\u0307"
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def _class(kind: str, end: int) -> str:
    """A character class of the code points below `end` whose general category starts with kind."""
    spans, start = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            spans.append((start, c - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


@lru_cache(2)
def splitter(end: int = 0x10000):
    """Splits normalised text whose code points are all below `end` into words; small classes match faster."""
    letters, numbers = _class("L", end), _class("N", end)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+").findall


def normalise(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would look at a sigma's neighbours
    return text.lower()


def words_of(text: str) -> list[str]:
    return words_in(normalise(text))


def words_in(text: str) -> list[str]:
    """Words of normalised text."""
    if text.isalpha():
        return [text]
    return splitter(0x110000 if ASTRAL.search(text) else 0x10000)(text)


#: Kinds of bytes in UTF-8: white space, letter, digit, other ASCII, apostrophe, other.
BLANK_BYTE, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(6)
KIND = bytes(
    BLANK_BYTE if b in b"\t\n\v\f\r " else OTHER if b > 127 else APOSTROPHE if b == 39 else LETTER if chr(b).isalpha() else DIGIT if 48 <= b < 58 else MARK
    for b in range(256)
)
#: By 8 * kind + next kind, whether a piece ends between the two. Nothing is cut beside apostrophes and other bytes, but at white space.
CUT = bytes(
    (a != b and (BLANK_BYTE in (a, b) or max(a, b) < APOSTROPHE)) or a == b == DIGIT if max(a, b) <= OTHER else 0 for a, b in (divmod(i, 8) for i in range(256))
)


def pieces_of(raw: bytes, starts: np.ndarray, fixed: list[tuple[int, int]]):
    """Cuts joined UTF-8 texts where no word and no normalisation can reach over: the pieces, their number before each start, and those at the fixed spans.

    Most pieces are words. What has other bytes than ASCII and Latin letters, or apostrophes, is left for words_in().
    ASCII letters are lower-cased unless a combining mark may follow.
    """
    import pyarrow as pa

    data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(KIND), np.uint8).copy()
    lead = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF: letters but for two
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    low = np.frombuffer(raw.lower(), np.uint8).copy()
    before_other = np.maximum(np.flatnonzero(kind == OTHER) - 1, 0)
    low[before_other] = data[before_other]
    cut = np.ones(len(data), bool)
    cut[1:] = np.frombuffer(((kind[:-1] << 3) | kind[1:]).tobytes().translate(CUT), bool)
    cut[starts[starts < len(data)]] = True
    for a, b in fixed:
        cut[a:b] = False
        cut[[a, *([b] if b < len(data) else [])]] = True
    filled = kind != BLANK_BYTE
    first, held = np.flatnonzero(cut & filled), low[filled]
    ends = np.append(np.flatnonzero(cut[filled]), len(held)).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(held))
    return pieces, np.searchsorted(first, starts), np.searchsorted(first, [a for a, _ in fixed])


class Merger:
    """Exact byte-pair merging of single words by merge rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] if x["special"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank = {(a, b): r for r, (a, b) in enumerate(map(tuple, model["merges"]))}
        self.symbols = byte_symbols()
        self.at_special = re.compile("|".join(f"({re.escape(x)})" for x in self.special)) if self.special else None

    def ids(self, word: str) -> tuple[int, ...]:
        parts = [self.symbols[b] for b in word.encode("utf-8", "replace")]
        parts[-1] += self.suffix
        parts = self._few(parts) if len(parts) <= 48 else self._many(parts)
        return tuple(map(self.vocab.__getitem__, parts))

    def batch(self, words: list[str]) -> list[bytes]:
        """ids() of many words, as unsigned 32-bit integers: words of about one length merge side by side, the best pair of each in every step."""
        out: list = [None] * len(words)
        data = np.frombuffer("".join([w + "\n" for w in words]).encode("utf-8", "replace"), np.uint8)
        ends = np.flatnonzero(data == 10)  # no word holds a line feed
        start = np.concatenate(([0], ends[:-1] + 1)) if len(words) else ends
        size = ends - start
        for low, high in ((0, 5), (5, 7), (7, 9), (9, 11), (11, 14), (14, 18), (18, 26), (26, 48)):
            which = np.flatnonzero((size > low) & (size <= high))
            for at in np.array_split(which, 1 + len(which) // 8_000):
                if len(at):
                    cols = np.minimum(start[at, None] + np.arange(high), len(data) - 1)
                    for i, ids in zip(at.tolist(), self._side_by_side(data[cols], size[at])):
                        out[i] = ids
        for i in np.flatnonzero(size > 48).tolist():
            out[i] = packed(self.ids(words[i]))
        return out

    @cached_property
    def tables(self):
        """Symbol ids of bytes within and at the end of words; ranks of pairs; the ids that ranks make; ranks of pairs of bytes, within and at the end."""
        inner = np.array([self.vocab[x] for x in self.symbols], np.int32)
        ending = np.array([self.vocab[x + self.suffix] for x in self.symbols], np.int32)
        made = np.array([self.vocab[a + b] for a, b in self.rank], np.int32)
        ranks = PairRanks(np.array([(self.vocab[a] << 20) | self.vocab[b] for a, b in self.rank], np.int64))
        pairs = [ranks.of(np.repeat(inner, 256), np.tile(second, 256)) for second in (inner, ending)]
        return inner, ending, ranks, made, *pairs

    def _side_by_side(self, flat: np.ndarray, size: np.ndarray) -> list[bytes]:
        """flat holds a word's bytes in each row, size their number; what stands behind them counts for nothing."""
        inner, ending, ranks, made, within, at_end = self.tables
        none, (n, width) = np.int32(NO_RANK), flat.shape
        cols, rows, wide = np.arange(width), np.arange(n), width + 1
        # a column more, for what stands before the first symbol and behind the last; symbols stay in place and are linked
        parts = np.full((n, wide), -1, np.int32)
        parts[:, :-1] = np.where(cols < size[:, None], inner[flat], np.int32(-1))
        parts[rows, size - 1] = ending[flat[rows, size - 1]]
        after, before = np.empty((n, wide), np.int8), np.empty((n, wide), np.int8)
        after[:], before[:] = np.arange(1, wide + 1), np.arange(-1, width)
        after[rows, size - 1] = before[:, 0] = width
        pair = flat[:, :-1].astype(np.uint16) << 8 | flat[:, 1:]
        best = np.full((n, wide), none, np.int32)
        best[:, : width - 1] = np.where(cols[1:] < size[:, None] - 1, within[pair], none)
        two = np.flatnonzero(size > 1)
        best[two, size[two] - 2] = at_end[pair[two, size[two] - 2]]
        whole, parts, after, before = parts, parts.ravel(), after.ravel(), before.ravel()
        base = rows * wide
        while True:
            i = best.argmin(1)
            own = np.arange(len(best)) * wide
            least = best.ravel()[own + i]
            open_ = np.flatnonzero(least < none)
            if len(open_) < len(best):
                best, base, i, least, own = best[open_], base[open_], i[open_], least[open_], own[: len(open_)]
            if not len(open_):
                break
            at = base + i
            second = after[at].astype(np.int64)
            behind = after[base + second].astype(np.int64)
            ahead = before[at].astype(np.int64)
            parts[at] = joined = made[least]
            parts[base + second] = -1
            after[at], before[base + behind] = behind, i
            left = best.ravel()
            left[own + second] = none
            left[own + i] = ranks.of(joined, parts[base + behind])
            left[own + ahead] = ranks.of(parts[base + ahead], joined)
        there = whole >= 0
        ends = (4 * np.cumsum(there.sum(1))).tolist()
        ids = whole[there].tobytes()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def _few(self, parts: list[str]) -> list[str]:
        rank, none = self.rank.get, 1 << 30
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _many(self, parts: list[str]) -> list[str]:
        """The same merges from a heap over a linked list, for very long words."""
        n = len(parts)
        after, before, rank = [*range(1, n), -1], [*range(-1, n - 1)], self.rank.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (r := rank((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]


#: Of pairs that no merge joins.
NO_RANK = 1 << 30


class PairRanks:
    """Merge ranks of pairs of symbols, looked up many at once; -1 stands for no symbol and makes a key below all others.

    A key that shares its slot with another is found by binary search.
    """

    BITS = 20

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], -1), np.append(order, NO_RANK).astype(np.int32)
        self.slots = np.full(1 << self.BITS, len(keys), np.int32)
        self.slots[self._slot(self.keys[:-1])] = np.arange(len(keys))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).view(np.int64)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        at = self.slots[self._slot(key)]
        other = np.flatnonzero((self.keys[at] != key) & (at < len(self.keys) - 1))
        if len(other):
            found = np.minimum(np.searchsorted(self.keys[:-1], key[other]), len(self.keys) - 2)
            at[other] = np.where(self.keys[found] == key[other], found, len(self.keys) - 1)
        return self.ranks[at]


def packed(ids) -> bytes:
    return array("I", ids).tobytes()


def unpacked(ids: bytes, names: dict[int, str] | None = None) -> list[int]:
    return memoryview(ids).cast("I").tolist()


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


# ---------------------------------------------------------------------------------------------- the lexicon transducer


def compile_lexicon(words: list[str], ids_of) -> bytes:
    """A minimal acyclic automaton of the words (incremental construction over sorted input), arcs numbered, as bytes.

    Layout: eight int32 sizes, then int32 arrays: first arc of each state, arc labels, arc targets, arc numbers (words
    below earlier arcs), whether a state is final, words below each state, offsets into ids, ids.
    """
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple((c, t) for c, t in node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the unsettled states along the last word
    last = ""

    def fold(down: int) -> None:
        while len(path) > down + 1:
            target = settle(path.pop())
            path[-1][1][-1] = (path[-1][1][-1][0], target)

    for word in words:
        same = len(os.path.commonprefix((last, word)))
        fold(same)
        for c in word[same:]:
            path[-1][1].append((ord(c), -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    fold(0)
    root = settle(path[0])

    below = np.zeros(len(states), np.int32)  # targets are settled before the states that reach them
    for s, (final, arcs) in enumerate(states):
        below[s] = final + sum(below[t] for _, t in arcs)
    first, labels, targets, numbers = [0], [], [], []
    for final, arcs in states:
        seen = int(final)
        for c, t in arcs:
            labels.append(c)
            targets.append(t)
            numbers.append(seen)
            seen += int(below[t])
        first.append(len(labels))
    ids = [ids_of(w) for w in words]
    arrays = [first, labels, targets, numbers, [f for f, _ in states], below, np.cumsum([0, *map(len, ids)]), [x for y in ids for x in y]]
    arrays = [np.asarray(a, np.int32) for a in arrays]
    return struct.pack("<9i", root, *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """The compiled lexicon, memory-mapped; looks up many words at once, one character of each in every step."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int32, "r")
        self.root, sizes = int(data[0]), data[1:9]
        at, parts = 9, []
        for n in sizes:
            parts.append(data[at : at + int(n)])
            at += int(n)
        self.first, self.labels, self.targets, self.numbers, self.final, self.below, self.offsets, self.tokens = parts
        # arcs in order of (state, label), so that one binary search finds a state's arc
        self.arcs = (np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) << 21) | self.labels

    def rows(self, words: list[str]) -> np.ndarray:
        """Each word's row in the table of token ids, or -1."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
        start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(words) else size
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        alive, step = np.flatnonzero(size > 0), 0
        out = np.full(len(words), -1, np.int64)
        while len(alive) and len(self.arcs):
            key = (state[alive] << 21) | text[start[alive] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[arc] == key
            alive, arc = alive[ok], arc[ok]
            number[alive] += self.numbers[arc]
            state[alive] = self.targets[arc]
            step += 1
            done = size[alive] == step
            ended = alive[done]
            ended = ended[self.final[state[ended]] > 0]
            out[ended] = number[ended]
            alive = alive[~done]
        return out

    def ids(self, row: int) -> tuple[int, ...]:
        return tuple(self.tokens[self.offsets[row] : self.offsets[row + 1]].tolist())

    def packed(self, row: int) -> bytes:
        return self.tokens[self.offsets[row] : self.offsets[row + 1]].tobytes()


@lru_cache(2)
def lexicon(path: str) -> Lexicon:
    return Lexicon(path)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each word occurs over all whole texts. Only ranks words, so a plainer split than the encoder's will do."""
    parts = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"), F.lit(1)))
    return docs.select(parts.alias("word")).where(F.length("word") <= 64).groupBy("word").count()


def build_lexicon(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS, text: str = "text") -> str:
    """Compiles the most frequent words (at most `words`, so the file's size is bounded) and sends the file to all executors."""
    spark = docs.sparkSession
    counted = stored(word_counts(docs, text).where("count > 1"), "word-counts")
    # the smallest count that at most `words` words reach: from how many words have each count, a table of few rows
    least, taken = 2, 0
    for row in counted.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():
        if (taken := taken + row.n) > words:
            least = row["count"] + 1
            break
    top = counted.where(F.col("count") >= least).select("word").collect()
    merge = merger(vocabulary)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    # the encoder's own split decides which strings are words to it
    spark.sparkContext.addFile(put(spark, name, compile_lexicon([r.word for r in top if words_of(r.word) == [r.word]], merge.ids)))
    return name


class Encoder:
    """Whole texts to tokens, one white-space-delimited run at a time: memo, then lexicon, then exact merges.

    No word reaches over white space and no normalisation joins over it, so runs can be split, normalised and merged alone.
    The memo keeps what comes from the lexicon and drops the rest whenever its bound of entries or characters is reached.
    documents() gives plain ids without the lexicon: bytes of many texts are cut into pieces at once, and each different
    piece is looked up once.
    """

    def __init__(self, vocabulary: str, lexicon_file: str | None = None, make=unpacked):
        self.merge = merger(vocabulary)
        self.lexicon = lexicon(SparkFiles.get(lexicon_file)) if lexicon_file else None
        self.make = make  # what is kept of a run's ids, which are unsigned 32-bit integers
        self.memo: dict = {}
        self.common: dict = {}
        self.held = 0
        self.pieces: dict[str, bytes] = {}  # the memo of documents()

    def _learn(self, runs: list[str]) -> None:
        special, names, make = self.merge.special, self.merge.names, self.make
        # no run holds a line feed, and nothing is joined or lower-cased over one
        split = [[run] if run in special else words_in(text) for run, text in zip(runs, normalise("\n".join(runs)).split("\n"))]
        new = list(set().union(*split) - special.keys())
        rows = self.lexicon.rows(new) if self.lexicon else np.full(len(new), -1)
        listed = {new[i]: self.lexicon.packed(int(rows[i])) for i in np.flatnonzero(rows >= 0).tolist()}
        unseen = [new[i] for i in np.flatnonzero(rows < 0).tolist()]
        words = {s: packed((i,)) for s, i in special.items()} | listed | dict(zip(unseen, self.merge.batch(unseen)))
        kept = [words[own[0]] if len(own) == 1 else b"".join([words[w] for w in own]) for own in split]
        learnt = dict(zip(runs, [make(ids, names) for ids in kept]))
        self.common |= {run: learnt[run] for run in listed.keys() & learnt.keys()}
        self.memo |= learnt
        self.held += sum(map(len, runs))

    def runs(self, text: str) -> list[str]:
        special = self.merge.at_special
        if ODD.search(text) or ("<|" in text and special and special.search(text)):
            runs: list[str] = []
            for part in re.split(f"({'|'.join(map(re.escape, self.merge.special))})", text):
                runs += [part] if part in self.merge.special else BLANK.split(part)
            return [r for r in runs if r]
        if not BESIDE.search(text):  # full stops and commas that are words by themselves: fewer different runs to keep
            text = text.replace(".", " . ").replace(",", " , ")
        return text.split()

    def entries(self, texts: list[str | None]) -> Iterator[list]:
        """For each text, what is kept of each of its runs, in order."""
        gc.disable()  # nothing here is cyclic, and the collector would walk the memo again and again
        try:
            yield from self._entries(texts)
        finally:
            gc.enable()

    def _entries(self, texts: list[str | None]) -> Iterator[list]:
        for some in together(texts):
            split = [self.runs(text) if text else [] for text in some]
            if len(self.memo) > MEMO_WORDS or self.held > 16 * MEMO_WORDS:
                self.memo = dict(self.common)
                self.held = 0
            memo = self.memo
            if new := [run for run in set().union(*split) if run not in memo]:
                self._learn(new)
            get = self.memo.__getitem__
            for runs in split:
                yield list(map(get, runs))

    def documents(self, texts) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow column of strings; null counts as empty."""
        import pyarrow as pa

        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = memoryview(texts.buffers()[2] or b"")
        from_ = 0
        while from_ < len(texts):
            to = max(from_ + 1, int(np.searchsorted(offsets, offsets[from_] + MOST_BYTES, "right")) - 1)
            yield from self._documents(bytes(data[offsets[from_] : offsets[to]]), offsets[from_ : to + 1] - offsets[from_])
            from_ = to

    def _documents(self, raw: bytes, starts: np.ndarray) -> Iterator[np.ndarray]:
        special = {s.encode(): i for s, i in self.merge.special.items()}
        fixed: list[tuple[int, int]] = []
        if any(s in raw for s in special):
            find = re.compile(b"|".join(map(re.escape, special))).finditer
            fixed = [m.span() for a, b in zip(starts.tolist(), starts[1:].tolist()) for m in find(raw, a, b)]
        pieces, counts, at = pieces_of(raw, starts, fixed)
        coded = pieces.dictionary_encode()
        del pieces
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        codes[at] = np.arange(len(names), len(names) + len(at))
        ids = self._ids(names) + [packed((special[raw[a:b]],)) for a, b in fixed]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), np.uint32)
        del coded, names, ids
        long = size[codes]
        ends = np.concatenate(([0], np.cumsum(long)))
        flat = flat[np.repeat(first[codes] - ends[:-1], long) + np.arange(ends[-1])]
        bounds = ends[counts].tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield flat[a:b]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, as bytes; the memo keeps at least those of the last call."""
        gc.disable()  # as in entries()
        try:
            memo = self.pieces
            known = list(map(memo.get, pieces))
            new = [p for p, ids in zip(pieces, known) if ids is None]
            text = normalise("\n".join(new))
            split = [words_in(x) for x in text.split("\n")] if new else []
            words = set().union(*split)
            # a word alone is a piece with the same ids, unless lower() made its dot of a capital: marks behind that stay in their order
            dotted = [w for w in words if DOT in w] if DOT in text else []
            own = dict(zip(dotted, self.merge.batch(dotted)))
            plain = list(words - own.keys() - memo.keys())
            memo.update(zip(plain, self.merge.batch(plain)))
            memo.update([(p, b"".join([own[w] if w in own else memo[w] for w in ws])) for p, ws in zip(new, split) if p not in memo])
            out = [memo[p] if ids is None else ids for p, ids in zip(pieces, known)]
            self.held += len(text)
            if len(memo) > MEMO_WORDS or self.held > 16 * MEMO_WORDS:
                self.pieces, self.held = dict(zip(pieces, out)), sum(map(len, pieces))
            return out
        finally:
            gc.enable()


def together(texts: list[str | None], most: int = 1 << 21) -> Iterator[list[str | None]]:
    """The texts in pieces of about `most` characters."""
    from_, held = 0, 0
    for to, text in enumerate(texts, 1):
        held += len(text or "")
        if held >= most or to == len(texts):
            yield texts[from_:to]
            from_, held = to, 0


def encode(docs: DataFrame, vocabulary: str, lexicon_file: str | None = None, *, keep_ids: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every whole text; with keep_ids False the two digests instead of ids and decoded."""

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(vocabulary, lexicon_file, lambda data, names: (len(ids := unpacked(data)), " ".join(map(str, ids)), " ".join([names[i] for i in ids]), ids if keep_ids else ()))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            counts, first, second = [], [], []
            for words in encoder.entries(texts):
                n, ids, names, raw = zip(*words) if words else ((), (), (), ())
                counts.append(sum(n))
                if keep_ids:
                    first.append([x for y in raw for x in y])
                    second.append(" ".join(names))
                else:
                    first.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                    second.append(hashlib.sha256(" ".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts, pa.int64()), pa.array(first, pa.list_(pa.int32()) if keep_ids else pa.string()), pa.array(second, pa.string())], names=columns)
        del encoder
        give_back()

    columns = [doc_id, "n_tokens", *(("ids", "decoded") if keep_ids else ("ids_sha256", "decoded_sha256"))]
    kinds = ["long", "array<int>" if keep_ids else "string", "string"]
    source = docs.select(F.col(doc_id), F.col(text))
    schema = ", ".join([f"`{doc_id}` {source.schema[0].dataType.simpleString()}", *(f"{c} {k}" for c, k in zip(columns[1:], kinds))])
    return source.mapInArrow(run, schema)


def decode(ids: list[int], vocabulary: str) -> str:
    names = merger(vocabulary).names
    return " ".join(names[i] for i in ids if i in names)


def default_vocabulary() -> str:
    """The public vocabulary file that the queries name; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
