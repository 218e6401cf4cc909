"""From source files to lines, signals, functions, entry points, scopes and operations.

files: absolute_path, relative_path, language, text. Everything below is keyed by file_id; the per-file scanner state
(comments and strings over lines, block ends, open functions) is one Arrow pass, all else is joins and array functions.

Functions are an interval forest: one stack pass per file gives each line its `owners`, the first lines of all functions
that hold it, outermost first. What lies in a function is an equi join on (file, owner), what lies in none has no owners.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from auditweave import catalog
from auditweave.frontends import BUILT_IN, Frontends
from auditweave.functions import columns as C
from auditweave.storage import large

FACTS = "struct<target:string,assigned:array<string>,calls:array<struct<callee:string,receiver:string,arguments:array<string>,argument_variables:array<array<string>>>>,branch:array<string>,returned:array<string>>"
GIVEN = "struct<target:string,assigned:array<string>>"
HEADER = "struct<name:string,parameters:string,names:array<string>,above:array<string>>"
OWN = "struct<signals:array<struct<kind:string,label:string,category:string,code:string,variables:array<string>>>,entries:array<struct<method:string,route:string>>>"
REFERENCES = "array<struct<local:string,target:string,kind:string>>"
LINE = f"file_id string, language string, line int, raw string, masked string, plain string, block_end int, facts {FACTS}, given {GIVEN}, named array<string>, references {REFERENCES}, header {HEADER}, owners array<int>, own {OWN}"

#: What signals, functions, entries and scopes need of a line; what flows through it can be read later (with_facts).
PLACES = ["file_id", "language", "line", "raw", "masked", "plain", "block_end", "references", "header", "owners", "own"]


def with_ids(files: DataFrame) -> DataFrame:
    return large(files.withColumn("file_id", C.short_hash(C.slashed("absolute_path"))))


def lines(files: DataFrame, frontends: Frontends = BUILT_IN, columns: Sequence[str] | None = None) -> DataFrame:
    """file_id, language, line, raw, masked (no strings or comments), plain (no comments), block_end, and what each line says.

    facts: of the masked line, null if blank; given, named: assignment and names of the raw line; references: of the whole
    file, on its first line; header: of the function that starts there, with the plain lines above it; owners: the functions
    that hold the line; own: what the language's own parser says of the line. Everything that needs Python is read in this
    one pass. Few input splits hold much work for one task each, so files are dealt to more.

    columns: those of LINE that are wanted (all by default), and any column of files; what isn't asked for isn't worked out.
    A line that occurs many times in a batch is read once, and its record repeated by Arrow.
    """
    from auditweave.functions import lexing

    headers, parsers = frontends.headers, frontends.parsers
    columns = list(columns or StructType.fromDDL(LINE).names)
    own_columns = {f.name: f for f in StructType.fromDDL(LINE)}
    carried = [c for c in columns if c not in own_columns]
    asked = set(columns)
    blanks = bool(asked & {"masked", "plain", "block_end", "facts", "references", "header", "owners", "own"})

    def of_file(language, path, text):
        """raw, masked, plain, block_end, references, header, owners, own of one file's lines, as far as they are asked for."""
        text = (text or "").replace("\r\n", "\n")
        parse = parsers.get(language)
        raw = text.split("\n")
        if parse:
            told = lexing.parsed(parse(text, path))
            raw += [""] * (told.lines - len(raw))
            n = len(raw)
            ends, starts = told.ends(n), told.headers(n)
            return raw, raw, raw, ends, told.references, starts, lexing.owners(starts, ends), told.own(n)
        if not blanks:
            return raw, raw, raw, (), (), (), (), ()
        masked, plain = (lexing.blanked(text, language, strings).split("\n") for strings in (True, False))
        references = lexing.file_references(plain, language) if "references" in asked else ()
        if not asked & {"block_end", "header", "owners"}:
            return raw, masked, plain, (), references, (), (), ()
        ends = lexing.indent_ends(raw) if language == "python" else lexing.block_ends(masked)
        starts = lexing.headers(masked, plain, headers.get(language, ()), language)
        return raw, masked, plain, ends, references, starts, lexing.owners(starts, ends), ()

    def slices(batches):
        """Pieces of 256 files."""
        for whole in batches:
            for from_ in range(0, whole.num_rows, 256):
                yield whole.slice(from_, 256)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kinds = to_arrow_schema(schema)

        def sparse(values, kind):
            """Values that are mostly null."""
            some = [n for n, x in enumerate(values) if x is not None]
            if not some:
                return pa.nulls(len(values), kind)
            index = np.zeros(len(values), np.int32)
            index[some] = np.arange(len(some))
            absent = np.ones(len(values), bool)
            absent[some] = False
            return pa.array([values[n] for n in some], kind).take(pa.array(index, mask=absent))

        for piece in slices(batches):
            raw, masked, plain, ends, references, starts, owners, own, sizes = ([] for _ in range(9))
            for language, path, text in zip(*(piece.column(n).to_pylist() for n in (1, 2, 3))):
                r, m, p, e, refs, h, o, w = of_file(language, path, text)
                n = len(r)
                raw += r
                masked += m
                plain += p
                ends += e
                owners += o
                starts += h
                own += w or [None] * n
                references += [list(refs), *[None] * (n - 1)]
                sizes.append(n)
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            count = np.arange(1, len(raw) + 1, dtype=np.int32) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes).astype(np.int32)
            made = {
                "file_id": lambda k: piece.column(0).take(of), "language": lambda k: piece.column(1).take(of), "line": lambda k: pa.array(count),
                "raw": lambda k: pa.array(raw, k), "masked": lambda k: pa.array(masked, k), "plain": lambda k: pa.array(plain, k), "block_end": lambda k: pa.array(ends, k),
                "facts": lambda k: repeated(masked, lambda x: lexing.line_facts(x) if x.strip() else None, k), "given": lambda k: repeated(raw, lexing.given, k), "named": lambda k: repeated(raw, lambda x: lexing.identifiers(x.strip()), k),
                "references": lambda k: sparse(references, k), "header": lambda k: sparse(starts, k), "owners": lambda k: pa.array(owners, k), "own": lambda k: sparse(own, k),
            }
            made |= {c: lambda k, n=n: piece.column(n).take(of) for n, c in enumerate(carried, 4)}
            yield pa.RecordBatch.from_arrays([made[k.name](k.type) for k in kinds], schema=kinds)

    path = F.col("relative_path") if "relative_path" in files.columns else F.col("absolute_path")
    schema = StructType([own_columns.get(c) or files.schema[c] for c in columns])
    cores = files.sparkSession.sparkContext.defaultParallelism
    if files.rdd.getNumPartitions() < 4 * cores:
        files = files.repartition(4 * cores, "absolute_path")
    return with_ids(files).select("file_id", "language", path.alias("_path"), "text", *carried).mapInArrow(run, schema)


def repeated(values, read, kind):
    """An Arrow array of read() of every value, worked out once for those that are equal."""
    import pyarrow as pa

    at: dict = {}
    index = pa.array([at.setdefault(x, len(at)) for x in values], pa.int32())
    return pa.array([read(x) for x in at], kind).take(index)


def read_again(rows: DataFrame, column: str, **kernels) -> DataFrame:
    """rows with what kernels (name=(function, type)) say of a column."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = batch.column(at).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(repeated(values, read, kind) for (read, _), kind in zip(kernels.values(), kinds))], names=names)

    at, names = rows.columns.index(column), [*rows.columns, *kernels]
    added = StructType.fromDDL(", ".join(f"{name} {kind}" for name, (_, kind) in kernels.items()))
    kinds = [f.type for f in to_arrow_schema(added)]
    return rows.mapInArrow(run, StructType([*rows.schema, *added]))


def with_facts(lines: DataFrame) -> DataFrame:
    """file_id, line, raw, masked, owners and facts of the lines that aren't blank."""
    from auditweave.functions import lexing

    return read_again(lines.where(F.trim("masked") != "").select("file_id", "line", "raw", "masked", "owners"), "masked", facts=(lambda x: lexing.line_facts(x) if x.strip() else None, FACTS))


def with_names(signals: DataFrame) -> DataFrame:
    """signals with given and named, from their code."""
    from auditweave.functions import lexing

    # lists that are null are counted from the start with every row that goes to Python, so empty ones are sent
    told = F.col("variables").isNotNull()
    sent = signals.withColumns({"variables": F.coalesce("variables", F.array().cast("array<string>")), "_told": told})
    read = read_again(sent, "code", given=(lexing.given, GIVEN), named=(lambda x: lexing.identifiers(x.strip()), "array<string>"))
    return read.withColumn("variables", F.when(F.col("_told"), F.col("variables"))).drop("_told")


def signals(lines: DataFrame, frontends: Frontends = BUILT_IN) -> DataFrame:
    """file_id, language, line, ordinal (in the catalogue), kind, label, category, code, variables, owners, and given, named if lines have them.

    One literal regex each, so Spark compiles each once; a language with a parser of its own has the parser's signals.
    variables: what a parser says the signal reads; given, named, owners: as of the line.
    """
    by_language, none = None, F.lit(None).cast("array<string>")
    for language, rows in frontends.patterns.items():
        tests = F.array_compact(F.array(*(
            F.when(F.rlike(F.col("plain" if strings else "masked"), F.lit(regex)), F.struct(F.lit(n).alias("ordinal"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(category or kind).alias("category"), F.trim("raw").alias("code"), none.alias("variables")))
            for n, (kind, label, regex, category, strings) in enumerate(rows))))
        by_language = F.when(F.col("language") == language, tests) if by_language is None else by_language.when(F.col("language") == language, tests)
    more = [c for c in ("given", "named", "owners") if c in lines.columns]
    kept = ["file_id", "language", "line", *more]
    found = lines.where(F.trim("masked") != "").select(*kept, F.explode(by_language).alias("s"))
    if frontends.parsers:
        told = lines.where("own is not null").select(*kept, F.trim("raw").alias("raw"), F.posexplode("own.signals").alias("n", "p"))
        found = found.unionByName(told.select(*kept, F.struct(F.col("n").alias("ordinal"), "p.kind", "p.label", F.coalesce("p.category", "p.kind").alias("category"), F.coalesce("p.code", "raw").alias("code"), "p.variables").alias("s")))
    return found.select("file_id", "language", "line", "s.*", *more)


SIGNAL = ["line", "ordinal", "kind", "label", "category", "code"]


def functions(lines: DataFrame) -> DataFrame:
    """file_id, language, name, parameters (raw), names (of the parameters), line, end_line, and the plain lines above (eight with its own)."""
    return lines.where("header is not null").select("file_id", "language", F.when(F.col("header.name") == "", "callback").otherwise(F.col("header.name")).alias("name"), "header.parameters", "header.names", "line", F.col("block_end").alias("end_line"), "header.above")


ANNOTATED = ("java", "python", "csharp", "typescript", "javascript")


def function_signals(functions: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of each function (fn_line): those inside it, and annotations up to eight lines above it."""
    inside = signals.withColumn("fn_line", F.explode("owners"))
    marks = signals.where(F.rlike("code", F.lit(r"^\s*(?:@|\[)")) & F.col("language").isin(*ANNOTATED))
    above = marks.withColumn("fn_line", F.explode(F.transform(F.array(*map(F.lit, range(1, 9))), lambda n: F.col("line") + n)))
    return inside.unionByName(above.join(functions.select("file_id", F.col("line").alias("fn_line")), ["file_id", "fn_line"], "left_semi"))


def uncovered(rows: DataFrame) -> DataFrame:
    """Rows (with owners) that lie in no function."""
    return rows.where(F.size("owners") == 0)


def entries(lines: DataFrame, functions: DataFrame, signals: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, method, route, title, line, end_line, function_line, function_name."""
    paths = with_ids(files).select("file_id", "relative_path")
    fn = functions.withColumns({"eight": F.array_join("above", " "), "seven": F.array_join(F.slice("above", F.greatest(F.lit(1), F.size("above") - 6), 7), " "), "plain": F.element_at("above", -1)})
    get = F.regexp_extract
    empty_null = lambda c: F.nullif(c, F.lit(""))

    java = catalog.SPRING_MAPPING
    mapping, inside = get("eight", java, 1), get("eight", java, 2)
    jax, servlet = get("eight", catalog.JAX_METHOD, 1), get("name", catalog.SERVLET_METHOD, 1)
    java_method = F.when(mapping == "RequestMapping", F.coalesce(empty_null(get(inside, catalog.SPRING_METHOD, 1)), F.lit("ANY"))).when(mapping != "", F.upper(F.replace(mapping, F.lit("Mapping"), F.lit("")))).when(jax != "", jax).otherwise(F.upper(servlet))
    java_route = F.coalesce(empty_null(get(inside, catalog.QUOTED_ROUTE, 1)), empty_null(get("eight", catalog.JAX_PATH, 1)), F.col("name"))

    nest = catalog.NEST_ROUTE
    exported = F.rlike("name", F.lit(catalog.EXPORTED_METHOD)) & F.rlike("plain", F.lit(catalog.EXPORT))
    js_method = F.when(F.rlike("seven", F.lit(nest)), F.upper(get("seven", nest, 1))).when(exported, F.col("name"))
    js_route = F.coalesce(empty_null(get("seven", nest, 2)), F.col("name"))

    py = catalog.PYTHON_ROUTE
    verb = F.upper(get("eight", py, 1))
    py_method = F.when(F.rlike("eight", F.lit(py)), F.when(verb == "ROUTE", F.coalesce(empty_null(F.upper(get(get("eight", py, 3), catalog.PYTHON_METHOD, 1))), F.lit("ANY"))).otherwise(verb)).when(F.rlike("parameters", F.lit(catalog.PYTHON_REQUEST)), "REQUEST")
    py_route = F.coalesce(empty_null(get("eight", py, 2)), F.col("name"))

    http, attr = catalog.CSHARP_HTTP, catalog.CSHARP_ROUTE
    cs_method = F.when(F.rlike("eight", F.lit(http)), F.upper(get("eight", http, 1))).when(F.rlike("eight", F.lit(attr)), "ANY")
    cs_route = F.coalesce(empty_null(get("eight", http, 2)), empty_null(get("eight", attr, 1)), F.col("name"))

    js, is_java = F.col("language").isin("javascript", "typescript"), (mapping != "") | (jax != "") | (servlet != "")
    method = F.when(F.col("language") == "java", F.when(is_java, java_method)).when(js, js_method).when(F.col("language") == "python", py_method).when(F.col("language") == "csharp", cs_method)
    route = F.when(F.col("language") == "java", java_route).when(js, js_route).when(F.col("language") == "python", py_route).when(F.col("language") == "csharp", cs_route)
    headed = fn.select("file_id", method.alias("method"), route.alias("route"), "line", "end_line", F.col("line").alias("function_line"), F.col("name").alias("function_name")).where("method is not null")

    # entries that a line declares by itself
    php, js_line = catalog.PHP_ROUTE, catalog.SCRIPT_ROUTE
    declared = lines.where(((F.col("language") == "php") & F.rlike("plain", F.lit(php))) | (js & F.rlike("plain", F.lit(js_line))))
    pick = lambda g: F.when(F.col("language") == "php", get("plain", php, g)).otherwise(get("plain", js_line, g))
    declared = _within(declared.select("file_id", F.upper(pick(1)).alias("method"), pick(2).alias("route"), "line", "owners"), functions)

    # PHP files with input but no routes: the script itself is an entry
    first = signals.where("kind = 'source' and language = 'php'").groupBy("file_id").agg(F.min("line").alias("line"), F.min_by("owners", "line").alias("owners"))
    script = first.join(declared.select("file_id").distinct(), "file_id", "left_anti").join(paths, "file_id")
    script = _within(script.select("file_id", F.lit("REQUEST").alias("method"), F.col("relative_path").alias("route"), "line", "owners"), functions).withColumn("line", F.coalesce("function_line", "line"))

    # Go: handlers by name in the same file, then functions with handler parameters that no entry names
    direct, router = catalog.GO_HANDLE, catalog.GO_ROUTER
    is_direct, kind = F.rlike("plain", F.lit(direct)), get("plain", router, 1)
    named = lines.where((F.col("language") == "go") & (is_direct | F.rlike("plain", F.lit(router)))).select(
        "file_id", F.when(is_direct, "REQUEST").when(F.lower(kind) == "handlefunc", F.coalesce(empty_null(F.upper(get("plain", catalog.GO_METHODS, 1))), F.lit("ANY"))).otherwise(F.upper(kind)).alias("method"),
        F.when(is_direct, get("plain", direct, 1)).otherwise(get("plain", router, 2)).alias("route"), "line", F.when(is_direct, get("plain", direct, 2)).otherwise(get("plain", router, 3)).alias("handler"))
    handlers = functions.groupBy("file_id", F.col("name").alias("handler")).agg(F.min_by(F.struct(F.col("line").alias("function_line"), "end_line"), "line").alias("f"))
    routed = named.join(handlers, ["file_id", "handler"], "left").select("file_id", "method", "route", F.coalesce("f.function_line", "line").alias("line"), F.coalesce("f.end_line", "f.function_line", "line").alias("end_line"), "f.function_line", F.when(F.col("f").isNotNull(), F.col("handler")).alias("function_name"))
    typed = functions.where(F.col("language").eqNullSafe("go") & F.rlike("parameters", F.lit(catalog.GO_HANDLER)))
    typed = typed.join(routed.where("function_line is not null").select("file_id", F.col("function_line").alias("line")).distinct(), ["file_id", "line"], "left_anti")
    typed = typed.select("file_id", F.lit("REQUEST").alias("method"), F.col("name").alias("route"), "line", "end_line", F.col("line").alias("function_line"), F.col("name").alias("function_name"))

    # entries that a language's own parser names
    told = lines.where("own is not null").select("file_id", "line", "owners", F.explode("own.entries").alias("e"))
    told = _within(told.select("file_id", F.upper("e.method").alias("method"), "e.route", "line", "owners"), functions)

    every = headed.unionByName(declared).unionByName(script).unionByName(routed).unionByName(typed).unionByName(told)
    # scripts can name one entry twice on a line: the first that ends stays
    script_files = with_ids(files).where(F.col("language").isin("javascript", "typescript")).select("file_id")
    key = ["file_id", "method", "route", "line"]
    once = every.join(script_files, "file_id", "left_semi").groupBy(*key).agg(F.min(F.struct("end_line", "function_line", "function_name")).alias("f")).select(*key, "f.*")
    return once.unionByName(every.join(script_files, "file_id", "left_anti")).withColumn("title", F.concat_ws(" ", "method", "route"))


def _within(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds the first function that contains each row's line (of its owners the outermost), and the end it gives."""
    first = functions.select("file_id", F.col("line").alias("function_line"), F.col("end_line").alias("fn_end"), F.col("name").alias("function_name"))
    placed = rows.withColumn("function_line", F.get("owners", F.lit(0))).join(first, ["file_id", "function_line"], "left")
    return placed.select("file_id", "method", "route", "line", F.coalesce("fn_end", "line").alias("end_line"), "function_line", "function_name")


def scopes(files: DataFrame, lines: DataFrame, functions: DataFrame, signals: DataFrame, entries: DataFrame) -> DataFrame:
    """scope_id, file_id, name, parameters (names), line, end_line, language, paths, is_entry, entry_title, is_global, references."""
    info = with_ids(files).select("file_id", "absolute_path", "relative_path")
    titles = entries.where("function_line is not null").groupBy("file_id", F.col("function_line").alias("line")).agg(F.min("title").alias("entry_title"))
    fn = functions.join(info, "file_id")
    signature = F.concat("name", F.lit("("), F.array_join("names", ","), F.lit(")"))
    nth = F.row_number().over(Window.partitionBy("file_id", signature).orderBy("line")) - 1
    fn = fn.withColumn("scope_id", C.short_hash(F.concat_ws(":", C.slashed("relative_path"), "language", signature, nth.cast("string"))))
    fn = fn.join(titles, ["file_id", "line"], "left").select("scope_id", "file_id", "name", F.col("names").alias("parameters"), "line", "end_line", "language", "absolute_path", "relative_path", F.col("entry_title").isNotNull().alias("is_entry"), "entry_title", F.lit(False).alias("is_global"))

    free = uncovered(lines.select("file_id", "language", "line", "owners"))
    wanted = uncovered(signals).select("file_id").union(entries.where("function_line is null").select("file_id")).distinct()
    loose = entries.where("function_line is null").groupBy("file_id").agg(F.min_by("title", "line").alias("entry_title"))
    rest = free.join(wanted, "file_id", "left_semi").groupBy("file_id", "language").agg(F.min("line").alias("line"), F.max("line").alias("end_line")).join(info, "file_id").join(loose, "file_id", "left")
    rest = rest.select(C.short_hash(F.concat_ws(":", C.slashed("relative_path"), "language", F.lit("global-scope"))).alias("scope_id"), "file_id", F.lit("global scope").alias("name"), F.array().cast("array<string>").alias("parameters"), "line", "end_line", "language", "absolute_path", "relative_path", F.col("entry_title").isNotNull().alias("is_entry"), "entry_title", F.lit(True).alias("is_global"))
    return fn.unionByName(rest).join(references(lines), "file_id", "left").withColumn("references", F.coalesce("references", F.array().cast(REFERENCES)))


def references(lines: DataFrame) -> DataFrame:
    """file_id, references: the imports and typed receivers of each file, in order."""
    return lines.where("line = 1").select("file_id", "references")


def postings(lines: DataFrame) -> DataFrame:
    """identifier, file_id, line, column, end_column of every identifier in code that is no member: an index for lookups of any number of identifiers."""
    from auditweave.functions import lexing

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [[(*m, n) for m in lexing.mentioned(code)] for n, code in enumerate(batch.column(2).to_pylist())]
            flat = [m for each in found for m in each]
            at = pa.array([m[3] for m in flat], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in flat], pa.string()), batch.column(0).take(at), batch.column(1).take(at), pa.array([m[1] for m in flat], pa.int32()), pa.array([m[2] for m in flat], pa.int32())], names=["identifier", "file_id", "line", "column", "end_column"])

    return lines.where(F.trim("masked") != "").select("file_id", "line", "masked").mapInArrow(run, "identifier string, file_id string, line int, column int, end_column int")


def mentions(postings: DataFrame, lines: DataFrame, signals: DataFrame, wanted: DataFrame) -> DataFrame:
    """identifier, file_id, line, column, end_column, code, role, kinds of every mention of the wanted identifiers.

    wanted: identifier, and file_id where only one file counts. Found by equi joins on the postings.
    """
    found = postings.join(wanted, [c for c in ("identifier", "file_id") if c in wanted.columns], "left_semi")
    kinds = signals.groupBy("file_id", "line").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    rows = found.join(lines.select("file_id", "line", "raw"), ["file_id", "line"]).join(kinds, ["file_id", "line"], "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    return rows.select("identifier", "file_id", "line", "column", "end_column", F.trim("raw").alias("code"), C.trace_role("raw", "identifier", "kinds").alias("role"), "kinds")


CALLED = "struct<callee:string,receiver:string,arguments:array<string>,argument_variables:array<array<string>>>"
EVENT = f"kind string, nth int, variables array<string>, target string, call {CALLED}"


def events_of(facts: dict, declared: str | None) -> list[dict]:
    """The events of a line's facts; declared: the name of the function whose header the line is, which is no call of it."""
    real, target = [c for c in facts["calls"] if c["callee"] != declared], facts["target"]
    found = [("assignment", 0, facts["assigned"], target, None)] if target is not None and not real else []
    found += [(kind, 0, facts[key], None, None) for kind, key in (("branch", "branch"), ("return", "returned")) if facts[key] is not None]
    found += [("call", n, [], target, c) for n, c in enumerate(real)]
    return [dict(zip(("kind", "nth", "variables", "target", "call"), e)) for e in found]


def said_events(lines: DataFrame) -> DataFrame:
    """file_id, fn_line, line, code and the events (EVENT) that each line's syntax says, once for every function that holds it (0: none).

    Lines that are equal in a batch are read once, and their events repeated by Arrow.
    """
    from auditweave.functions import lexing

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from auditweave.functions.arrow import values_of

        for batch in batches:
            masked, at, owners, names = (values_of(batch.column(n)) for n in (3, 1, 4, 5))
            seen: dict = {}
            rows, fns, said = [], [], []
            for n, (code, line, held, name) in enumerate(zip(masked, at, owners, names)):
                for fn in held or (0,):
                    rows.append(n)
                    fns.append(fn)
                    said.append(seen.setdefault((code, (name or "callback") if fn == line else None), len(seen)))
            facts: dict = {}
            events = [events_of(facts.get(code) or facts.setdefault(code, lexing.line_facts(code)), declared) for code, declared in seen]
            counts = np.array([len(e) for e in events], np.int64)
            first, said = np.cumsum(counts) - counts, np.array(said, np.int64)
            many = counts[said]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, event = pa.array(np.repeat(rows, many)), pa.array(np.repeat(first[said], many) + nth)
            flat = [e for each in events for e in each]
            made = [pa.array([e[k.name] for e in flat], k.type).take(event) for k in kinds]
            fn_line = pa.array(np.repeat(np.array(fns, np.int32), many))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), fn_line, batch.column(1).take(row), batch.column(2).take(row), *made], names=["file_id", "fn_line", "line", "code", *(k.name for k in kinds)])

    kinds = list(to_arrow_schema(StructType.fromDDL(EVENT)))
    rows = lines.where(F.trim("masked") != "").select("file_id", "line", F.trim("raw").alias("code"), "masked", "owners", "header.name")
    return rows.mapInArrow(run, f"file_id string, fn_line int, line int, code string, {EVENT}")


def operations(scopes: DataFrame, lines: DataFrame, functions: DataFrame, signals: DataFrame) -> DataFrame:
    """The events of every scope: scope_id, line, kind, ord (their order on a line), nth, code, variables, target, label, category, kinds, guards, call."""
    # a scope is met by its file and first line, the global one by line 0
    place = F.when(F.col("is_global"), 0).otherwise(F.col("line"))
    scope = scopes.select("scope_id", "file_id", place.alias("fn_line"), "name", F.col("line").alias("scope_line"), "parameters")
    every = function_signals(functions, signals).unionByName(uncovered(signals).withColumn("fn_line", F.lit(0)))
    every = every if "given" in every.columns else with_names(every)  # after the union, whose parts would each read all signals
    seen = every.withColumn("a", F.col("given")).join(scope, ["file_id", "fn_line"])
    held = F.when((F.col("kind") == "source") & F.col("a").isNotNull(), F.array("a.target")).otherwise(F.coalesce("a.assigned", "named"))
    held = F.coalesce("variables", held)
    held = F.when((F.col("line") <= F.col("scope_line")) & (F.size("parameters") > 0), F.array_distinct(F.concat("parameters", held))).otherwise(held)
    guards = F.when(F.col("kind").isin("auth", "sanitizer"), C.guard_capabilities("kind", "label", "code")).otherwise(F.array().cast("array<string>"))
    no_call = F.lit(None).cast(CALLED)
    marked = seen.select(
        "scope_id", "line", F.when(F.col("kind").isin("source", "sink"), F.col("kind")).otherwise("control").alias("kind"), F.col("ordinal").alias("nth"), "code", held.alias("variables"), F.lit(None).cast("string").alias("target"),
        "label", "category", F.when(F.col("kind") == "source", C.source_kind("label", "code")).alias("source_kind"), F.when(F.col("kind") == "sink", C.sink_kind("category")).alias("sink_kind"), guards.alias("guards"), no_call.alias("call"))

    none = F.lit(None).cast("string")
    syntax = said_events(lines).join(scope.select("scope_id", "file_id", "fn_line"), ["file_id", "fn_line"]).select(
        "scope_id", "line", "kind", "nth", "code", "variables", "target", none.alias("label"), none.alias("category"), none.alias("source_kind"), none.alias("sink_kind"), F.array().cast("array<string>").alias("guards"), "call")
    both = marked.unionByName(syntax)
    return both.withColumn("ord", C.constant_map(catalog.EVENT_ORDER, F.col("kind"), 9)).withColumn(
        "operation_id", C.short_hash(F.concat_ws(":", "scope_id", "kind", F.col("line").cast("string"), F.coalesce("label", "call.callee", "target", F.lit("operation")))))
