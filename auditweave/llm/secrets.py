"""Secret scans over a trigram inverted index, with DataFrame functions only.

1. Each rule's regex is taken apart on the driver into a Boolean trigram query: alternatives of trigram sets, one of which
   any match must contain whole. Rules without such trigrams (hex) scan every text.
2. One pass over the texts writes the index's postings, by document. The lengths of the queried trigrams' posting lists
   are counted over all of them; an intersection starts from each alternative's shortest list.
3. Postings of one document and one alternative are intersected by counting: an alternative all of whose trigrams are there
   makes the document a candidate of the rule.
4. Candidates are joined back to their texts and verified by the regex itself. Only documents that a bitmap of the
   candidates marks take part in the join; the others are scanned for hex where they are read.

Spans come from split() and regexp_extract_all(), which cut and return the same leftmost non-overlapping matches: running
sums of the pieces' lengths are the offsets, in code points.

Defined results: null text is the empty text; documents are told apart by id and text, so null ids and repeated rows are
scanned each for itself; an empty table gives no rows; whole texts of any length and any number of matches are scanned.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave.llm.common import marked, stored


class Rule(NamedTuple):
    kind: str
    regex: str
    group: int = 0  # the group whose length counts
    least: int = 1  # shorter matches are dropped
    base: bool = False
    java: str = ""  # finds the same matches in linear time where the regex doesn't, if what comes before `lead` is left off
    lead: str = ""


#: The rules. Java and Python read these patterns alike.
RULES = [
    Rule("assign", "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]{24,}", 0, 24, True),  # of [0-9a-f]+ the matches that aren't dropped
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    # all parts that start within one run end alike, so only a run's first is tried
    Rule("jwt", "eyJ[A-Za-z0-9_-]{5,}\\.eyJ[A-Za-z0-9_-]{5,}\\.[A-Za-z0-9_-]{5,}", java="(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]{5,}+\\.eyJ[A-Za-z0-9_-]{5,}+\\.[A-Za-z0-9_-]{5,}+", lead="eyJ"),
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
]
MOST_STRINGS = 64


def literal_runs(regex: str) -> list[list[str]]:
    """For each stretch of the regex that can only be one of a few strings, those strings, lower-cased."""
    runs: list[list[str]] = []
    now = [""]

    def cut():
        nonlocal now
        runs.append(now)
        now = [""]

    def strings(items) -> list[str] | None:
        """All strings the items can be, if they are few."""
        out = [""]
        for kind, value in items:
            if kind == op.LITERAL:
                own = [chr(value).lower()]
            elif kind == op.IN and all(k == op.LITERAL for k, _ in value):
                own = sorted({chr(c).lower() for _, c in value})
            elif kind == op.SUBPATTERN:
                own = strings(value[3])
            elif kind == op.BRANCH:
                parts = [strings(b) for b in value[1]]
                own = None if None in parts else [s for p in parts for s in p]
            elif kind == op.MAX_REPEAT and value[1] != op.MAXREPEAT and value[1] <= 2:
                part = strings(value[2])
                own = None if part is None else ["".join(x) for n in range(value[0], value[1] + 1) for x in product(part, repeat=n)]
            else:
                own = None
            if own is None or len(own) * len(out) > MOST_STRINGS:
                return None
            out = [a + b for a in out for b in own]
        return out

    def walk(items):
        nonlocal now
        for item in items:
            own = strings([item])
            if own is not None and len(own) * len(now) <= MOST_STRINGS:
                now = [a + b for a in now for b in own]
            elif item[0] == op.SUBPATTERN:
                walk(item[1][3])
            else:
                cut()

    walk(parser.parse(regex))
    cut()
    return runs


def trigram_query(regex: str) -> list[list[str]]:
    """Alternatives, each a sorted list of trigrams; a matching text, lower-cased, holds all trigrams of one. [] if none are mandatory."""
    useful = [r for r in literal_runs(regex) if all(len(s) >= 3 for s in r)]
    found = {frozenset(s[i : i + 3] for s in strings for i in range(len(s) - 2)) for strings in product(*useful)} if useful else set()
    return sorted(sorted(f) for f in found if not any(g < f for g in found))


def queries(rules: list[Rule]) -> list[tuple[int, int, list[str]]]:
    """(rule, alternative, trigrams) of the rules that have mandatory trigrams."""
    return [(r, a, tris) for r, rule in enumerate(rules) for a, tris in enumerate(trigram_query(rule.regex))]


SPANS = "array<struct<start:int,kind:int,end:int>>"
CHUNK = 256


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, also where use reads it inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """The rule's matches as array<struct<start, kind, end>>.

    Appending copies an array, so matches are walked in chunks: first the chunks' lengths, then each chunk from its start.
    """
    regex = F.lit(rule.java or rule.regex)
    matches, pieces = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, rule.java or rule.regex, -1)
    counted = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else matches
    none = F.array().cast(SPANS)
    rows = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(counted, F.length).alias("counts"), F.transform(matches, lambda m: F.instr(m, rule.lead) - 1 if rule.lead else F.lit(0)).alias("off"))
    long = lambda row: row["gap"] + F.coalesce(row["size"], F.lit(0))

    def start(state, chunk):
        return F.struct((state.at + F.aggregate(chunk, F.lit(0), lambda n, row: n + long(row))).alias("at"), F.array_append(state.starts, state.at).alias("starts"))

    def step(state, row):
        begin = state.at + row["gap"]
        span = F.struct((begin + row["off"]).alias("start"), F.lit(number).alias("kind"), (begin + row["size"]).alias("end"))
        return F.struct((state.at + long(row)).alias("at"), F.when(row["counts"] >= rule.least, F.array_append(state.spans, span)).otherwise(state.spans).alias("spans"))

    def walked(chunks):
        starts = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), start, lambda s: s.starts)
        return F.flatten(F.zip_with(chunks, starts, lambda chunk, at: F.aggregate(chunk, F.struct(at.alias("at"), none.alias("spans")), step, lambda s: s.spans)))

    def chunked(rows):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda c: F.slice(rows, c * CHUNK + 1, CHUNK))

    found = bound(rows, lambda rows: bound(chunked(rows), walked))
    return F.when(F.rlike(text, regex), found).otherwise(none)


def postings(read: DataFrame, grams: list[str]) -> DataFrame:
    """doc, print, grams (their numbers): the queried trigrams that each text holds, for texts that hold any."""
    held = lambda low: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(g)), F.lit(n)) for n, g in enumerate(grams))))
    # bound and generated, so that neither the lower-cased text nor the list is made again for each use
    return read.select("doc", "print", F.explode(F.array(bound(F.lower("text"), held))).alias("grams")).where(F.size("grams") > 0)


def candidates(index: DataFrame, asked: list[tuple[int, int, list[int]]]) -> DataFrame:
    """doc, print, rules: which rules' trigram queries each document satisfies."""
    # the queries: a table whose size depends on the rules alone
    wanted = index.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(t).alias("gram"), F.lit(r).alias("rule"), F.lit(a).alias("alternative"), F.lit(len(grams)).alias("all")) for r, a, grams in asked for t in grams))))
    met = index.select("doc", "print", F.explode("grams").alias("gram")).join(F.broadcast(wanted), "gram").groupBy("doc", "print", "rule", "alternative").agg(F.size(F.collect_set("gram")).alias("n"), F.first("all").alias("all"))
    return met.where("n = all").groupBy("doc", "print").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: list[Rule] = RULES, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, spans: array<struct<start, kind (number of the rule), end>> of every document, in order."""
    queried = queries(rules)
    always = [r for r in range(len(rules)) if r not in {q[0] for q in queried}]
    words = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(doc_id).alias("doc"), words.alias("text"), F.xxhash64(F.col(doc_id), words).alias("print"))
    none = F.array().cast(SPANS)

    def verified(df: DataFrame, rules_of) -> DataFrame:
        each = [spans_of(F.col("text"), rule, r) if r in always else F.when(rules_of(r), spans_of(F.col("text"), rule, r)).otherwise(none) for r, rule in enumerate(rules) if r in always or rules_of]
        return df.select(F.col("doc").alias(doc_id), F.array_sort(F.concat(*each)).alias("spans") if each else none.alias("spans"))

    if not queried:
        return verified(read, None)
    grams = sorted({t for _, _, tris in queried for t in tris})
    asked = [(r, a, [grams.index(t) for t in tris]) for r, a, tris in queried]
    index = stored(postings(read, grams), "secret-postings")  # the only pass that looks for trigrams
    length = {r.gram: r["count"] for r in index.select(F.explode("grams").alias("gram")).groupBy("gram").count().collect()}
    # an intersection starts from the shortest list: a text that is on none of these satisfies no query
    least = sorted({min(tris, key=lambda t: (length.get(t, 0), t)) for _, _, tris in asked})
    found = stored(candidates(index.where(F.arrays_overlap("grams", F.array(*map(F.lit, least)))), asked), "secret-candidates").withColumnsRenamed({"doc": "_doc", "print": "_print"})
    dealt = marked(read, "print", found.select(F.col("_print").alias("print")))
    able = dealt.where("marked").select("row.*")
    able = able.join(found, able["doc"].eqNullSafe(F.col("_doc")) & (able["print"] == F.col("_print")), "left").select("doc", "text", F.coalesce("rules", F.array().cast("array<int>")).alias("rules"))
    return verified(able, lambda r: F.array_contains("rules", r)).union(verified(dealt.where("not marked").select("row.*"), None))


def digested(scanned: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id") -> DataFrame:
    """The counts of base kinds and the digests of scan()'s rows."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind.isin([k for k, r in enumerate(rules) if r.base]))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    return scanned.select(doc_id, *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def sql(rules: list[Rule] = RULES) -> str:
    """The same digests in DuckDB's SQL, each rule scanning every text."""

    def listed(r: int, rule: Rule) -> str:
        regex = rule.regex.replace("'", "''")
        return f"""list_filter(list_transform(range(1, len(m{r}) + 1), lambda i: {{
          'start': coalesce(list_sum(list_transform(p{r}[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(m{r}[1:i - 1], lambda x: length(x))), 0)::bigint,
          'kind': {r}, 'size': length(m{r}[i]), 'counts': length(c{r}[i])}}), lambda s: s.counts >= {rule.least})""".replace("{regex}", regex)

    parts = ",\n    ".join(f"regexp_extract_all(t, '{x}') as m{r}, string_split_regex(t, '{x}') as p{r}, regexp_extract_all(t, '{x}', {rule.group}) as c{r}" for r, rule in enumerate(rules) for x in [rule.regex.replace("'", "''")])
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    said = "coalesce(list_aggregate(list_transform({}, lambda s: {}[s.kind + 1] || ':' || s.start || ':' || (s.start + s.size)), 'string_agg', ','), '')"
    base = [k for k, r in enumerate(rules) if r.base]
    return f"""
with cut as (
  select row_number() over () as n, doc_id, coalesce(text, '') as t from documents),
parts as (
  select n, doc_id,
    {parts}
  from cut),
spans as (
  select doc_id, {", ".join(f"{listed(r, rule)} as s{r}" for r, rule in enumerate(rules))} from parts),
sorted as (
  select doc_id, {", ".join(f"len(s{k})::bigint as n_{rules[k].kind}" for k in base)},
    list_sort({" || ".join(f"s{k}" for k in base)}) as base, list_sort({" || ".join(f"s{k}" for k in range(len(rules)))}) as every from spans)
select doc_id, {", ".join(f"n_{rules[k].kind}" for k in base)}, sha256({said.format("base", names)}) as base_sha256, {said.format("every", names)} as spans from sorted"""
