"""Personal data: fixed patterns, and identifiers discovered from the contexts in which those occur.

1. E-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers are found by fixed patterns: the seed entities.
   In the same pass every other white-space-delimited run that holds a digit, and five code points after trimming, becomes a candidate
   instance; shorter runs and runs without a digit are no candidates. Seeds and candidates are written with their lexical
   patterns: the two words before, the word before and the word after, the two words after. Words are whole, however long
   and however far away.
2. Spark scores the graph of patterns and instances: a pattern's confidence is the mean score of its instances (seeds 1)
   with one unit of doubt, an instance's score is the noisy-or of its patterns' confidences. ROUNDS rounds.
3. Patterns of at least MIN_SEEDS different seeds and MIN_CONFIDENCE mark the candidates they hold as spans of kind `id`.

No text is shuffled: the first pass writes spans and contexts to the shared folder, and only those are grouped and joined.

Defined results: null text is the empty text, without spans; offsets count code points, ends are exclusive; texts of any
length are read whole, in linear time; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import give_back, marked, slices, stored

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS = 3
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.7
LONG_WORD = 64  # longer words stand in patterns by their 128-bit hash

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
RUN = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*")  # starts where a run does, so no run is read twice
EDGE = "\"'`.,;:!?()[]{}<>|*#$%&="


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, each found from its @, so long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15]
    return out


def plain(word: str) -> str:
    """A word as patterns name it."""
    import xxhash

    word = word.strip(EDGE).lower() or word
    return word if len(word) <= LONG_WORD else "#" + xxhash.xxh3_128_hexdigest(word.encode("utf-8", "replace"))


class Words:
    """The white-space-delimited runs of a text and the instances in them, found in one pass.

    What a run holds beside an instance, as far as the next instance, is a word of its own. Instances of one kind don't
    overlap, so no character is read more often than there are kinds.
    """

    def __init__(self, text: str, held: list[tuple[int, int, bool]] = ()):
        self.text = text
        self.runs = [m.span() for m in WORD.finditer(text)]
        self.starts = [a for a, _ in self.runs]
        self.said: dict[int, str] = {}  # run -> its name, once asked for
        self.begins, self.ends = sorted(a for a, _, _ in held), sorted(b for _, b, _ in held)

    def name(self, k: int) -> str:
        if k not in self.said:
            self.said[k] = plain(self.text[slice(*self.runs[k])])
        return self.said[k]

    def around(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """Up to two words before start and after end."""
        first, last = bisect_right(self.starts, start) - 1, bisect_left(self.starts, end) - 1
        i, k = bisect_right(self.ends, start), bisect_left(self.begins, end)
        from_, to = max(self.runs[first][0], self.ends[i - 1] if i else 0), min(self.runs[last][1], self.begins[k] if k < len(self.begins) else len(self.text))
        before = [plain(self.text[from_:start])] if from_ < start else []
        after = [plain(self.text[end:to])] if end < to else []
        before = [self.name(k) for k in range(max(0, first - 2 + len(before)), first)] + before
        after += [self.name(k) for k in range(last + 1, min(len(self.runs), last + 3 - len(after)))]
        return before, after


def contexts(words: Words, start: int, end: int) -> list[str]:
    before, after = words.around(start, end)
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    return out


def instances(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, seed): the seeds, and the trimmed runs with a digit that touch none."""
    seeds = sorted({(a, b) for _, a, b in spans})
    out = [(a, b, True) for a, b in seeds]
    k = 0
    for m in RUN.finditer(text):
        while k < len(seeds) and seeds[k][1] <= m.start():
            k += 1
        if k < len(seeds) and seeds[k][0] < m.end():
            continue
        run = m.group()
        a = m.start() + len(run) - len(run.lstrip(EDGE))
        b = a + len(run.strip(EDGE))
        if b - a >= 5:
            out.append((a, b, False))
    return out


SPAN = "struct<kind:int,start:int,end:int>"


def printed(rows: DataFrame) -> DataFrame:
    """rows with print, a hash of their text."""
    return rows.withColumn("print", F.xxhash64(F.coalesce("text", F.lit(""))))


def first_pass(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, print (of the text), base spans, and the instances with their patterns."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        found_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
        signed = lambda s: xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)
        give_back()  # what earlier tasks of this worker left
        for batch in slices(batches):
            spans, found = [], []
            for t in batch.column(1).to_pylist():
                t = t or ""
                base = base_spans(t)
                held = instances(t, base)
                words = Words(t, held) if held else None
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                found.append([{"start": a, "end": b, "seed": s, "instance": signed(t[a:b]), "patterns": contexts(words, a, b)} for a, b, s in held])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(found_type))], names=["doc_id", "print", "base", "found"])

    source = printed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, print long, base array<{SPAN}>, found array<struct<start:int,end:int,seed:boolean,instance:long,patterns:array<string>>>")


def confident_patterns(read: DataFrame) -> DataFrame:
    """pattern, confidence: the patterns that discover."""
    found = read.select(F.explode("found").alias("f")).select("f.instance", "f.seed", F.explode("f.patterns").alias("pattern"))
    edges = stored(found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    # patterns without a seed can gain confidence from later rounds only through instances that some seeded pattern holds
    score = edges.select("instance", F.col("seed").cast("double").alias("s")).groupBy("instance").agg(F.max("s").alias("s"))
    for r in range(ROUNDS):
        patterns = edges.join(score, "instance").groupBy("pattern").agg((F.sum("s") / (F.count("*") + 1)).alias("c"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        if r + 1 < ROUNDS:
            held = edges.join(patterns.where("c > 0"), "pattern")
            score = stored(held.groupBy("instance").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log1p(-F.least(F.col("c"), F.lit(0.999)))))).alias("s")).select("instance", F.when(F.col("seed"), 1.0).otherwise(F.col("s")).alias("s")), "pii-scores")
    return stored(patterns.where((F.col("seeds") >= MIN_SEEDS) & (F.col("c") >= MIN_CONFIDENCE)).select("pattern", F.col("c").alias("confidence")), "pii-patterns")


def discovered(read: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, print, learned: the spans that confident patterns add."""
    candidates = read.select("doc_id", "print", F.explode(F.filter("found", lambda f: ~f.seed)).alias("f")).select("doc_id", "print", "f.start", "f.end", F.explode("f.patterns").alias("pattern"))
    hit = candidates.join(patterns, "pattern").select("doc_id", "print", F.struct(F.lit(4).alias("kind"), "start", "end").alias("span"))
    return hit.groupBy("doc_id", "print").agg(F.collect_set("span").alias("learned"))  # of one document at most


def extract(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, print, base, learned: arrays of (kind, start, end) for every document."""
    read = stored(first_pass(docs, text, doc_id), "pii-spans")
    learned = discovered(read, confident_patterns(read)).withColumnsRenamed({"doc_id": "_doc", "print": "_print"})
    kept = read.select("doc_id", "print", "base")
    out = kept.join(learned, kept.doc_id.eqNullSafe(F.col("_doc")) & (kept.print == F.col("_print")), "left")
    return out.select("doc_id", "print", "base", F.coalesce("learned", F.array().cast(f"array<{SPAN}>")).alias("learned"))


def digested(spans: DataFrame) -> DataFrame:
    """The counts and digests of extract()'s rows."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda column: F.array_join(F.transform(F.array_sort(column), lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return spans.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.concat("base", "learned")).alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with every span replaced by its kind, such as [EMAIL]; overlapping spans become one, named by the first.

    Rows are held as they are in a column of their own, so their columns may have any names. Only texts that a bitmap marks
    as holding discovered spans are joined with those; the others are redacted from their own text alone.
    """
    learned = extract(docs, text=text, doc_id=doc_id).where(F.size("learned") > 0).select("doc_id", "print", "learned").dropDuplicates(["doc_id", "print"])
    learned = stored(learned.withColumn("at", F.xxhash64("doc_id", "print")), "pii-learned")
    rows = printed(docs.select(F.struct("*").alias("doc"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    dealt = marked(rows.withColumn("at", F.xxhash64("doc_id", "print")), "at", learned.select("at"))
    near = dealt.where("marked").select("row.*").alias("n")
    same = (F.col("n.at") == F.col("l.at")) & F.col("n.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("n.print") == F.col("l.print"))
    joined = near.join(learned.alias("l"), same, "left").select("n.doc", "l.learned").union(dealt.where("not marked").select("row.doc", F.lit(None).cast(f"array<{SPAN}>")))
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        give_back()
        for batch in slices(batches):
            columns, out = batch.column(0).flatten(), []
            for t, extra in zip(columns[at].to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    out.append(t)
                    continue
                spans = base_spans(t) + [(s["kind"], s["start"], s["end"]) for s in extra or ()]
                parts, free = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= free:
                        parts += [t[free:a], f"[{KINDS[kind].upper()}]"]
                    free = max(free, b)
                parts.append(t[free:])
                out.append("".join(parts))
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    return joined.mapInArrow(run, docs.schema)
