"""Phrase collocations from count tries: sharded, serialised in order, merged by prefix range.

1. Each task grows a trie of depth DEPTH over its texts, one a language: every word starts a path of up to DEPTH words that
   ends with its piece. Words are numbered in byte order, so sorted numbers are the trie: a node is a run of paths with one
   prefix, its count their sum. A trie of CHUNK words is written out in blocks of sorted paths with their own word lists.
2. Sampled paths of all blocks cut the order of (language, path) into as many ranges as there are shuffle partitions, and
   blocks are cut where ranges end. A frequent prefix is spread over several ranges by the words that follow it, and a
   passage with a third of all words is one path a shard.
3. A task merges its range's blocks, which come sorted by their first path: what lies before the first path of the newest
   block is complete, is walked and is given up, so a task holds the overlapping blocks only. The walk yields each node of
   at least `least` with the counts of its ancestors, which are its left parts. Nodes on the rim of a stretch may go on in
   the next one; they are given out whatever their count, and are added up.
4. A phrase's right part is the node that its suffix link names: a join of the frequent nodes with themselves.

Defined results: null text is the empty text, null language is `und`; only A-Z are lower-cased; repeated rows count each
for itself; words may hold any other characters and be of any length; ties are ordered by score, a and phrase, so ranks
are certain; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditweave.llm.common import partitions, stored

DEPTH = 4
LEAST = 30
TOP = 2000
#: Words of a task's trie before it is written out; paths of a block; paths a sampled one stands for.
CHUNK, BLOCK, SAMPLE = 1 << 20, 1 << 16, 1 << 10
SAMPLES_A_RANGE = 64
#: Paths a merging task holds before it gives up what is complete.
HELD = 1 << 20
SLICE = 1 << 20  # bytes of a text read at once
LONGEST_CUT = 64  # bytes of a word that mark where ranges end

#: A-Z in lower case, ends of pieces as line feeds, tabs as spaces.
LETTERS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
GAP = re.compile(rb"[ \n]")
BLOCKS = "lang string, first array<binary>, words array<binary>, size int, paths binary, counts binary"


class Numbers(dict):
    """word -> number, given as words come."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Trie:
    """The paths of one language in one task."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk = chunk
        self.reset([])

    def reset(self, words: list[bytes]) -> None:
        self.ids = Numbers({b"": 0, b"\n": 1})
        self.parts, self.size = [], 0
        if words:
            self.append(words)

    def append(self, words: list[bytes]) -> None:
        part = np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))
        part = part[part != 0]
        self.parts.append(part)
        self.size += len(part)

    def add(self, text: bytes):
        """Takes in a text; yields sorted paths whenever the trie is full."""
        text, at = text.translate(LETTERS), 0
        while at < len(text):
            gap = GAP.search(text, at + SLICE)
            end = gap.start() if gap else len(text)
            self.append(text[at:end].replace(b"\n", b" \n ").split(b" "))
            at = end
            if self.size >= self.chunk:
                yield self.paths(False)
        self.append([b"\n"])

    def paths(self, done: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(words in byte order, distinct paths of their numbers from 1 in order, counts); unless done, the last words stay as they may go on."""
        words = list(self.ids)
        order = sorted(range(2, len(words)), key=words.__getitem__)
        rank = np.zeros(len(words), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        stay = 0 if done else min(DEPTH - 1, len(ids))
        tail = [words[i] for i in ids[len(ids) - stay :]]
        t = np.concatenate((rank[ids], np.zeros(DEPTH - 1, np.int64)))
        n = len(ids) - stay
        steps = [t[:n]]
        for d in range(1, DEPTH):
            steps.append(np.where(steps[-1] == 0, 0, t[d : n + d]))
        p = np.stack(steps, 1)[t[:n] != 0]
        self.reset(tail)
        sorted_words = [words[i] for i in order]
        return sorted_words, *distinct(p, np.ones(len(p), np.int64), len(order))


def packed(p: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray | None, int]:
    """Paths as one number each, in the same order; the pairs that stand for their first half where needed; bits of a word."""
    bits = max(1, int(most).bit_length())
    if 4 * bits <= 63:
        return (((p[:, 0] << bits | p[:, 1]) << bits | p[:, 2]) << bits) | p[:, 3], None, bits
    pairs, inverse = np.unique(p[:, 0] << 32 | p[:, 1], return_inverse=True)
    return (inverse.astype(np.int64) << bits | p[:, 2]) << bits | p[:, 3], pairs, bits


def distinct(p: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Different paths in order with the sums of their counts; word numbers are at most `most`."""
    if not len(p):
        return p, counts
    key, pairs, bits = packed(p, most)
    if (counts == 1).all():
        key.sort()
        start = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        counts = np.diff(np.append(start, len(key)))
    else:
        order = np.argsort(key)
        key = key[order]
        start = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        counts = np.add.reduceat(counts[order], start)
    key = key[start]
    mask = (1 << bits) - 1
    head = key >> 2 * bits
    halves = (head >> bits, head & mask) if pairs is None else (pairs[head] >> 32, pairs[head] & 0xFFFFFFFF)
    return np.stack((*halves, key >> bits & mask, key & mask), 1), counts


def squeezed(numbers: np.ndarray) -> bytes:
    """32- or 64-bit numbers, byte planes apart, compressed."""
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(numbers.reshape(-1).view(np.uint8).reshape(-1, numbers.itemsize).T), codec="zstd", asbytes=True)


def opened(data: bytes, n: int, kind) -> np.ndarray:
    import pyarrow as pa

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def block(words: list[bytes], p: np.ndarray, counts: np.ndarray) -> dict:
    """One row: sorted paths with the words they use."""
    used = np.unique(p)
    used = used[used > 0]
    own = np.searchsorted(used, p) + (p > 0) if len(used) else p
    own[p == 0] = 0
    steps = own.T.astype(np.int32)
    steps[0] = np.diff(steps[0], prepend=0)  # first words are in order
    return {"first": [words[i - 1] for i in p[0] if i], "words": [words[i - 1] for i in used], "size": len(p), "paths": squeezed(steps), "counts": squeezed(counts.astype(np.int64))}


def unblocked(size: int, paths: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = opened(paths, size * DEPTH, np.int32).reshape(DEPTH, size).astype(np.int64)
    steps[0] = np.cumsum(steps[0])
    return steps.T, opened(counts, size, np.int64)


def shards(docs: DataFrame, text: str, lang: str, chunk: int = CHUNK, most: int = BLOCK) -> DataFrame:
    """The tries of all tasks as blocks; cuts: some of their paths, each standing for SAMPLE."""

    def run(batches):
        import zlib

        import pyarrow as pa

        schema = pa.schema([("lang", pa.string()), ("first", pa.list_(pa.binary())), ("words", pa.list_(pa.binary())), ("size", pa.int32()), ("paths", pa.binary()), ("counts", pa.binary()), ("cuts", pa.list_(pa.list_(pa.binary())))])

        def rows(language, words, p, counts):
            for a in range(0, len(p), most):
                row = block(words, p[a : a + most], counts[a : a + most])
                from_ = zlib.crc32(b" ".join(row["first"])) % SAMPLE
                cuts = [[words[i - 1][:LONGEST_CUT] for i in p[n] if i] for n in range(a + from_, min(a + most, len(p)), SAMPLE)]
                yield pa.RecordBatch.from_pylist([row | {"lang": language, "cuts": cuts}], schema)

        tries: dict[str, Trie] = {}
        for batch in batches:
            for language, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                trie = tries.setdefault(language, Trie(chunk))
                for found in trie.add(value.as_buffer().to_pybytes()):
                    yield from rows(language, *found)
                if sum(t.size for t in tries.values()) > 4 * chunk:  # many languages
                    full = max(tries, key=lambda k: tries[k].size)
                    yield from rows(full, *tries.pop(full).paths(True))
        for language, trie in tries.items():
            yield from rows(language, *trie.paths(True))

    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    return source.mapInArrow(run, f"{BLOCKS}, cuts array<array<binary>>")


def range_ends(blocks: DataFrame, ranges: int) -> list[tuple[bytes, ...]]:
    """(language, path) of the first path of every range but the first: `ranges` at most, from about SAMPLES_A_RANGE paths each, whatever the corpus holds."""
    found = blocks.select(F.col("lang").cast("binary").alias("lang"), F.explode("cuts").alias("path"))
    every = blocks.agg(F.sum(F.size("cuts"))).first()[0] or 1
    some = found.where(F.pmod(F.xxhash64("lang", "path"), F.lit(every)) < SAMPLES_A_RANGE * ranges).select("lang", "path").collect()
    held = sorted((bytes(r.lang), *map(bytes, r.path)) for r in some)
    return sorted({held[len(held) * i // ranges] for i in range(1, ranges)}) if held else []


def position(words: list[bytes], high: np.ndarray, low: np.ndarray, path: tuple[bytes, ...]) -> int:
    """How many paths of a block (as pairs of word numbers) lie before a path."""
    key = [0] * DEPTH
    for d, word in enumerate(path):
        i = bisect_left(words, word)
        key[d] = i + 1
        if i == len(words) or words[i] != word:
            break
    first, second = key[0] << 32 | key[1], key[2] << 32 | key[3]
    a, b = np.searchsorted(high, first, "left"), np.searchsorted(high, first, "right")
    return int(a + np.searchsorted(low[a:b], second, "left"))


def cut(blocks: DataFrame, ends: list[tuple[bytes, ...]]) -> DataFrame:
    """The blocks, cut where ranges end, with their range."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("first", pa.list_(pa.binary())), ("words", pa.list_(pa.binary())), ("size", pa.int32()), ("paths", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                language = row["lang"].encode()
                base, top = bisect_left(ends, (language,)), bisect_left(ends, (language + b"\0",))
                if base == top:
                    yield pa.RecordBatch.from_pylist([row | {"range": base}], schema)
                    continue
                p, counts = unblocked(row["size"], row["paths"], row["counts"])
                high, low = p[:, 0] << 32 | p[:, 1], p[:, 2] << 32 | p[:, 3]
                at = [0, *(position(row["words"], high, low, ends[i][1:]) for i in range(base, top)), len(p)]
                for i, (a, b) in enumerate(zip(at, at[1:])):
                    if b > a:
                        yield pa.RecordBatch.from_pylist([block(row["words"], p[a:b], counts[a:b]) | {"range": base + i, "lang": row["lang"]}], schema)

    return blocks.select("lang", "first", "words", "size", "paths", "counts").mapInArrow(run, f"range int, {BLOCKS}")


def joined(parts: list[tuple[list[bytes], np.ndarray, np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Blocks as one."""
    if len(parts) == 1:
        return parts[0]
    words = sorted(set().union(*(w for w, _, _ in parts)))
    number = {w: i for i, w in enumerate(words, 1)}
    moved = [np.array([0, *map(number.__getitem__, w)], np.int64)[p] for w, p, _ in parts]
    return words, *distinct(np.concatenate(moved), np.concatenate([c for _, _, c in parts]), len(words))


def walked(words: list[bytes], p: np.ndarray, counts: np.ndarray, least: int):
    """(path, depth, count, counts of its ancestors or none on the rim, rim) of the nodes of a complete stretch."""
    new = np.ones(len(p), bool)
    new[1:] = False
    above = np.full((len(p), DEPTH), -1, np.int64)  # counts of the nodes over each path, -1 on the rim
    yield (), 0, int(counts.sum()), [], True
    for d in range(DEPTH):
        new = new.copy()
        new[1:] |= p[1:, d] != p[:-1, d]
        start = np.flatnonzero(new)
        total = np.add.reduceat(counts, start)
        rim = np.zeros(len(start), bool)
        rim[[0, -1]] = True
        above[:, d] = np.repeat(np.where(rim, -1, total), np.diff(np.append(start, len(p))))
        for i in np.flatnonzero((p[start, d] > 0) & (rim | (total >= least))).tolist():
            row = start[i]
            yield tuple(words[w - 1] for w in p[row, : d + 1]), d + 1, int(total[i]), [None if v < 0 else v for v in above[row, :d].tolist()], bool(rim[i])


def nodes(pieces: DataFrame, least: int, ranges: int, most: int = HELD) -> DataFrame:
    """lang, phrase, depth, f, lefts (of each proper prefix, null if not known here), rim: of every range's merged trie."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("depth", pa.int32()), ("f", pa.int64()), ("lefts", pa.list_(pa.int64())), ("rim", pa.bool_())])
        held: list = []
        at, size, merged = None, 0, 0

        def told(stretch):
            found = list(walked(*stretch, least)) if len(stretch[1]) else []
            columns = ([at[1]] * len(found), [b" ".join(f[0]) for f in found], *([f[i] for f in found] for i in range(1, 5)))
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema)], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["range"], row["lang"]) != at:
                    if held:
                        yield told(joined(held))
                    at, held, size, merged = (row["range"], row["lang"]), [], 0, 0
                elif size >= max(most, 2 * merged):
                    words, p, counts = joined(held)
                    n = position(words, p[:, 0] << 32 | p[:, 1], p[:, 2] << 32 | p[:, 3], tuple(row["first"]))
                    if n:
                        yield told((words, p[:n], counts[:n]))
                    held = [(words, p[n:], counts[n:])] if n < len(p) else []
                    size = merged = len(p) - n
                held.append((row["words"], *unblocked(row["size"], row["paths"], row["counts"])))
                size += row["size"]
        if held:
            yield told(joined(held))

    dealt = pieces.repartitionById(ranges, "range").sortWithinPartitions("range", "lang", "first")
    return dealt.mapInArrow(run, "lang string, phrase binary, depth int, f long, lefts array<long>, rim boolean").withColumn("phrase", F.col("phrase").cast("string"))


def frequent(docs: DataFrame, least: int, text: str, lang: str) -> DataFrame:
    """lang, phrase, depth, f, lefts of every phrase of up to DEPTH words with f >= least; depth 0 is the language's words."""
    spark = docs.sparkSession
    ranges = partitions(spark)
    blocks = stored(shards(docs, text, lang), "phrase-tries")
    found = stored(nodes(cut(blocks, range_ends(blocks, ranges)), least, ranges), "phrase-nodes")
    inner = found.where("not rim")
    rim = found.where("rim").groupBy("lang", "phrase", "depth").agg(F.sum("f").alias("f"))
    rim = rim.where((F.col("f") >= least) | (F.col("depth") == 0)).withColumn("lefts", F.array_repeat(F.lit(None).cast("long"), F.greatest(F.col("depth") - 1, F.lit(0))))
    return stored(inner.drop("rim").unionByName(rim), "phrase-counts")


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases."""
    known = frequent(docs, least, text, lang)
    counts = known.where("depth > 0").select("lang", "phrase", "f")
    part = lambda from_, size: F.array_join(F.slice("words", from_, size), " ")
    phrases = known.where("depth > 1").withColumn("words", F.split("phrase", " "))
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "lefts", "words", "depth", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.get("lefts", F.col("k") - 1).alias("l"), part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("depth") - F.col("k")).alias("right"))
    # only phrases under a node on the rim of a stretch have left parts that the walk didn't know
    found = cuts.where("l is not null").drop("left")
    rest = cuts.where("l is null").drop("l").join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).drop("left")
    whole = found.unionByName(rest).join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * exact("a"), exact("l") + exact("r"))
    scored = whole.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("depth") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("depth") - size + 1), lambda from_: part(from_, size))))
    covers = phrases.where("depth > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * exact("longer") < 80 * exact("a")))
    words = known.where("depth = 0").select("lang", F.col("f").alias("n"))
    best = ranked(kept, [F.desc("score"), F.desc("a"), "phrase"]).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with rank, from 1 within each language: one sort of all rows over all tasks, then where each task's stretch begins.

    The stretches of a language are counted, one number a task, so no task gets a language's rows.
    """
    placed = stored(rows.orderBy("lang", *order).withColumn("at", F.monotonically_increasing_id()), "phrases-in-order").withColumn("task", F.shiftrightunsigned("at", 33))
    stretches = placed.groupBy("lang", "task").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(stretches.select("lang", "task", "from", before.alias("before")), ["lang", "task"]).withColumn("rank", F.col("at") - F.col("from") + F.col("before") + 1).drop("at", "task", "from", "before")


def sql(least: int = LEAST, top: int = TOP) -> str:
    """The registered query in SQL."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " union all ".join(f"select lang, {d} as d, array_to_string(w[i:i + {d - 1}], ' ') as phrase from pieces, range(1, len(w) - {d} + 2) t(i)" for d in range(1, DEPTH + 1))
    return rf"""with split as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({lower}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
pieces as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from split), f as materialized (select lang, d, phrase, count(*) as f from ({grams}) group by all having d = 1 or count(*) >= {least}),
n as (select lang, sum(f)::bigint as n from f where d = 1 group by lang), c as materialized (select *, string_split(phrase, ' ') as w from f where d > 1),
cuts as (select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r, (2000000::hugeint * c.f) // (l.f + r.f) as score from c, range(1, {DEPTH}) t(k), f l, f r
where k < c.d and l.lang = c.lang and r.lang = c.lang and l.phrase = array_to_string(c.w[:k], ' ') and r.phrase = array_to_string(c.w[k + 1:], ' ')),
best as (select lang, phrase, a, arg_min(l, (score, k)) as l, arg_min(r, (score, k)) as r, min(score) as score from cuts group by lang, phrase, a),
covers as (select lang, array_to_string(w[i:i + s - 1], ' ') as phrase, max(f) as longer from c, range(2, {DEPTH}) u(s), range(1, {DEPTH}) t(i) where s < d and i + s - 1 <= d group by all),
kept as (select best.* from best left join covers using (lang, phrase) where longer is null or 100 * longer < 80 * a)
select lang, (row_number() over (partition by lang order by score desc, a desc, phrase))::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from kept join n using (lang) qualify rank <= {top}"""
