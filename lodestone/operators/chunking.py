"""Cutting sources into line-addressed chunks."""

from __future__ import annotations

import ast
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import basename, lines, stem, uuid5
from lodestone.operators.search import cut_by, rounded
from lodestone.providers import Embedder, HashedEmbedder
from lodestone.session import importable
from lodestone.workers import frugal

WINDOW_LINES, OVERLAP_LINES = 100, 20
UNIT_LINES, LEAST_LINES, LEAST_SPAN, MOST_SPAN = 4, 12, 6, 120
MOST_TOKENS = 6000
#: Bytes of chunks that a task splits at a time.
SPLIT_BYTES = 4 << 20
#: Patterns of declarations, of import lines and of calls.
DECLARATION = r"^\s*(?:(?:export|public|private|protected|static|final|async)\s+)*(?:def|class|func|function|fn|struct|interface|impl|trait|type|enum|module|const|let|var|sub|package)\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPORT_LINE = r"^\s*(?:from\s+\S+\s+import\b|import\b|#include\b|using\b|use\b|require\b|require_relative\b|extern\s+crate\b|package\b)"
CALL = r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("
#: Words before a parenthesis that are no calls.
NO_CALLS = ["if", "for", "while", "switch", "catch", "return", "def", "function", "class", "print", "super", "new", "async", "await", "yield", "with", "elif", "except", "case", "sizeof", "typeof", "instanceof"]


def calls(source: Column, pattern: str = CALL) -> Column:
    """Sorted distinct names that are called in a source."""
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(source, F.lit("(?U)" + pattern), 1)), F.array(*map(F.lit, NO_CALLS))))


def imports(source: Column, most: int = 40) -> Column:
    """First distinct import lines, stripped, in order."""
    return F.slice(F.array_distinct(F.transform(F.filter(lines(source), lambda x: x.rlike(IMPORT_LINE)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))), 1, most)


def declared_name(source: Column) -> Column:
    """Name on the first line that declares something, or null."""
    named = F.filter(F.transform(lines(source), lambda x: F.regexp_extract(x, DECLARATION, 1)), lambda x: x != "")
    return F.get(named, F.lit(0))


def fixed_windows(files: DataFrame, size: int = WINDOW_LINES, overlap: int = OVERLAP_LINES, path: str = "file_path", text: str = "source_text") -> DataFrame:
    """Overlapping windows of lines; a null or empty text has none. Keeps the other columns but the text."""
    step = size - overlap
    rest = [c for c in files.columns if c != text]
    cut = files.select(*rest, lines(F.col(text)).alias("_lines")).where(F.size("_lines") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("_lines") - size) / F.lit(step))).cast("int")
    cut = cut.withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("window") * step + 1
    end = F.least(F.col("window") * step + size, F.size("_lines"))
    out = cut.select(*rest, "window", start.alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_lines", start, F.lit(size)), "\n").alias("content"))
    address = F.concat_ws(":", F.col(path), F.col("start_line").cast("string"), F.col("end_line").cast("string"))
    name = F.concat(stem(basename(F.col(path))), F.lit("["), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("]"))
    return out.withColumns({"chunk_id": uuid5(address), "symbol_name": name, "symbol_type": F.lit("text_window")})


def span_breaks(units: DataFrame, group: str, order: str, vector: str, share: float = 0.9) -> DataFrame:
    """Adds distance to the next unit, the group's percentile of distances, and whether a span ends here (strictly above)."""
    w = Window.partitionBy(group).orderBy(order)
    v, nxt = F.col(vector).cast("array<double>"), F.lead(F.col(vector).cast("array<double>")).over(w)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(v, v)) * F.sqrt(dot(nxt, nxt))
    out = units.withColumn("distance", F.when(nxt.isNotNull(), F.when(norm == 0, 1.0).otherwise(F.round(1.0 - dot(v, nxt) / norm, 9))))
    cut = out.groupBy(group).agg(F.percentile("distance", F.lit(share)).alias("threshold"))
    return out.join(cut, group).withColumn("ends", F.coalesce(F.col("distance") > F.round("threshold", 9), F.lit(False)))


def limit_spans(spans: DataFrame, group: str, least: int = LEAST_SPAN, most: int = MOST_SPAN) -> DataFrame:
    """(group, start, end) half-open: short spans join their predecessor, long ones are cut into equal parts.

    A running count of the spans that stand alone names the merged span.
    """
    order = Window.partitionBy(group).orderBy("start")
    alone = (F.row_number().over(order) == 1) | (F.col("end") - F.col("start") >= least)
    named = spans.withColumn("_alone", alone.cast("int")).withColumn("_span", F.sum("_alone").over(order))
    merged = named.groupBy(group, "_span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    step = F.when(length > most, F.ceil(length / F.ceil(length / F.lit(most)))).otherwise(F.greatest(length, F.lit(1))).cast("int")
    parts = merged.withColumn("_step", step).withColumn("_at", F.explode(F.expr("sequence(start, end - 1, _step)")))
    return parts.select(group, F.col("_at").alias("start"), F.least(F.col("_at") + F.col("_step"), F.col("end")).alias("end"))


def semantic_units(files: DataFrame, path: str = "file_path", text: str = "source_text", unit: int = UNIT_LINES) -> DataFrame:
    """(path, unit, start, end, n, unit_text): units of lines, half-open, each with its neighbours' lines as text; short files are one unit."""
    cut = files.select(path, lines(F.col(text)).alias("_lines")).withColumn("n", F.size("_lines")).where("n > 0")
    starts = F.when(F.col("n") < LEAST_LINES, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1, F.lit(unit)))
    cut = cut.select(path, "n", "_lines", F.posexplode(starts).alias("unit", "start"))
    end = F.when(F.col("n") < LEAST_LINES, F.col("n")).otherwise(F.least(F.col("start") + unit, F.col("n")))
    first = F.greatest(F.col("start") - unit, F.lit(0))
    around = F.array_join(F.slice("_lines", first + 1, F.least(F.col("start") + 2 * unit, F.col("n")) - first), "\n")
    return cut.select(path, "unit", "start", end.alias("end"), "n", around.alias("unit_text"))


def limited(spans: list[tuple[int, int]], least: int = LEAST_SPAN, most: int = MOST_SPAN) -> list[tuple[int, int]]:
    """``limit_spans`` of one group: half-open spans in their order."""
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and b - a < least:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    out = []
    for a, b in merged:
        step = -(-(b - a) // -(-(b - a) // most)) if b - a > most else max(1, b - a)
        out += [(x, min(x + step, b)) for x in range(a, b, step)]
    return out


def unit_texts(rows: list[str], unit: int = UNIT_LINES) -> list[str]:
    """``semantic_units`` of one file that isn't short: each unit's lines with its neighbours'."""
    return ["\n".join(rows[max(0, a - unit) : a + 2 * unit]) for a in range(0, len(rows), unit)]


def breaks(vectors, share: float = 0.9):
    """``span_breaks`` of one group: whether a span ends at each unit."""
    import numpy as np

    v = np.asarray(vectors, float)
    norm = np.sqrt((v * v).sum(axis=1))
    both = norm[:-1] * norm[1:]
    distance = np.where(both == 0, 1.0, rounded(1.0 - (v[:-1] * v[1:]).sum(axis=1) / np.where(both == 0, 1.0, both), 9))
    # With two places at least there is a distance.
    ordered, at = np.sort(distance), share * (len(distance) - 1)
    low, high = int(np.floor(at)), int(np.ceil(at))
    cut = ordered[low] if low == high or ordered[low] == ordered[high] else (high - at) * ordered[low] + (at - low) * ordered[high]
    return np.append(distance > rounded(cut, 9), False)


def spans_of(rows: Column, embedder: Callable[[], Embedder]) -> Column:
    """array<struct<start, end>>, half-open, of a list of lines: a file's units stay together, so nothing is shuffled; short files have no distances and aren't embedded."""
    kind = "array<struct<start:int,end:int>>"
    held: list[Embedder] = []

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        import numpy as np

        if not held:
            held.append(embedder())
        starts, ends, cut = [], [], [0]
        for scalar in column:
            lines_of = scalar.as_py()
            if lines_of is not None:
                flags = breaks(held[0].embed(unit_texts(lines_of)))
                stops = [min((i + 1) * UNIT_LINES, len(lines_of)) for i in np.flatnonzero(flags)]
                stops = [*stops, len(lines_of)] if not stops or stops[-1] < len(lines_of) else stops
                for a, b in limited(list(zip([0, *stops[:-1]], stops, strict=True))):
                    starts.append(a)
                    ends.append(b)
            cut.append(len(starts))
        pairs = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pairs)

    n = F.size(rows)
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end"))).cast(kind)
    return F.when(n < LEAST_LINES, whole).otherwise(run(F.when(n >= LEAST_LINES, rows)))


def semantic_spans(files: DataFrame, path: str = "file_path", text: str = "source_text", embedder: Callable[[], Embedder] = HashedEmbedder) -> DataFrame:
    """(path, start, end), half-open lines: cut where the distance of neighbouring units is above the file's 90th percentile, within size limits."""
    importable(files.sparkSession)
    cut = files.select(path, lines(F.col(text)).alias("_lines")).where(F.size("_lines") > 0)
    return cut.select(path, F.explode(spans_of(F.col("_lines"), embedder)).alias("_s")).select(path, "_s.start", "_s.end")


def semantic_chunks(files: DataFrame, path: str = "file_path", text: str = "source_text", embedder: Callable[[], Embedder] = HashedEmbedder) -> DataFrame:
    """One row a span that isn't blank, named by its first declaration or by its lines; file_path must name its file alone."""
    importable(files.sparkSession)
    cut = files.select(path, lines(F.col(text)).alias("_lines"), imports(F.col(text)).alias("imports")).where(F.size("_lines") > 0)
    cut = cut.withColumn("_s", F.explode(spans_of(F.col("_lines"), embedder))).select(path, "_lines", "imports", "_s.start", "_s.end")
    cut = cut.withColumn("content", F.array_join(F.slice("_lines", F.col("start") + 1, F.col("end") - F.col("start")), "\n")).where(F.col("content").rlike(r"\S"))
    cut = cut.withColumns({"start_line": F.col("start") + 1, "end_line": F.col("end")}).drop("start", "end", "_lines")
    place = F.concat(stem(basename(F.col(path))), F.lit("["), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("]"))
    cut = cut.withColumns({"symbol_name": F.coalesce(declared_name(F.col("content")), place), "symbol_type": F.lit("semantic_chunk")})
    return cut.withColumn("chunk_id", uuid5(F.concat_ws(":", F.col(path), F.col("start_line").cast("string"), F.col("end_line").cast("string"), F.col("symbol_name"))))


def split_oversized(chunks: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Halve chunks by lines until each has at most ``most`` tokens; a single longer line is truncated.

    Tokens are white-space separated words here. Columns: chunk_id, symbol_name,
    start_line, end_line, content; other columns are copied to every part.
    """
    rest = [c for c in chunks.columns if c not in ("chunk_id", "symbol_name", "start_line", "end_line", "content")]

    def halves(one: dict) -> list[dict]:
        text = one["content"] or ""
        tokens = text.split()
        if len(tokens) <= most:
            return [one]
        rows = text.splitlines()
        if len(rows) <= 1:
            return [one | {"content": " ".join(tokens[:most])}]
        middle, out = len(rows) // 2, []
        for n, part, first in ((0, rows[:middle], one["start_line"]), (1, rows[middle:], one["start_line"] + middle)):
            last = one["start_line"] + middle - 1 if n == 0 else one["end_line"]
            out += halves(one | {"chunk_id": str(uuid.uuid5(uuid.NAMESPACE_URL, f"{one['chunk_id']}:split:{n}")), "symbol_name": f"{one['symbol_name']}[part{n + 1}]", "start_line": first, "end_line": last, "content": "\n".join(part)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # So many rows are objects at a time as have a few MB of text, whatever a batch has.
            for a, b in cut_by(pc.binary_length(batch.column("content")).fill_null(0).to_numpy() + 64, SPLIT_BYTES):
                yield pa.RecordBatch.from_pylist([p for one in batch.slice(a, b - a).to_pylist() for p in halves(one)], schema=batch.schema)

    ordered = chunks.select("chunk_id", "symbol_name", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "content", *rest)
    return ordered.mapInArrow(frugal(run), ordered.schema)


#: The kinds of syntax nodes that are chunks, by language.
NODES = {
    "python": ["function_definition", "class_definition"],
    "javascript": ["function_declaration", "class_declaration", "method_definition", "arrow_function", "generator_function_declaration"],
    "typescript": ["function_declaration", "class_declaration", "method_definition", "interface_declaration", "arrow_function"],
    "tsx": ["function_declaration", "class_declaration", "method_definition", "interface_declaration", "arrow_function"],
    "go": ["function_declaration", "method_declaration", "type_declaration"],
    "java": ["method_declaration", "class_declaration", "interface_declaration"],
    "rust": ["function_item", "impl_item", "struct_item", "trait_item"],
    "c": ["function_definition", "struct_specifier"],
    "cpp": ["function_definition", "class_specifier", "struct_specifier"],
    "c_sharp": ["method_declaration", "class_declaration", "interface_declaration"],
    "ruby": ["method", "class", "module"],
    "php": ["function_definition", "method_declaration", "class_declaration"],
    "swift": ["function_declaration", "class_declaration"],
    "kotlin": ["function_declaration", "class_declaration"],
    "scala": ["function_definition", "class_definition", "object_definition"],
}

_NAME = r"([A-Za-z_$][\w$]*)"
_METHOD = rf"(?:[\w<>\[\],.?*&:~]+\s+)*[*&]?{_NAME}\s*\([^;{{}}]*\)[^;{{}}()]*(?=\{{)"
#: How each kind of node begins, for the outline of languages with braces; the name is the last group that matched.
HEADS = {
    "function_declaration": rf"(?:async\s+)?(?:function|func|fun)\s+{_NAME}\s*[<(\[]",
    "generator_function_declaration": rf"function\s*\*\s*{_NAME}\s*\(",
    "method_declaration": rf"func\s*\([^)]*\)\s*{_NAME}\s*\(|{_METHOD}",
    "method_definition": _METHOD,
    "arrow_function": rf"{_NAME}\s*=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*=>\s*(?=\{{)",
    "type_declaration": rf"type\s+{_NAME}\b",
    "class_declaration": rf"\bclass\s+{_NAME}",
    "class_definition": rf"\bclass\s+{_NAME}",
    "class_specifier": rf"\bclass\s+{_NAME}",
    "interface_declaration": rf"\binterface\s+{_NAME}",
    "function_item": rf"\bfn\s+{_NAME}",
    "impl_item": rf"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?{_NAME}",
    "struct_item": rf"\bstruct\s+{_NAME}",
    "struct_specifier": rf"\bstruct\s+{_NAME}",
    "trait_item": rf"\btrait\s+{_NAME}",
    "object_definition": rf"\bobject\s+{_NAME}",
}
_HIDDEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_RUBY = re.compile(r"^([ \t]*)(def|class|module)\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", re.M)
KEYWORD_FUNCTION = rf"\b(?:function|def)\s+{_NAME}"
Unit = tuple[str, str, int, int, str]


def python_outline(source: str) -> list[Unit]:
    """Functions and classes, nested ones too, in preorder; none if the source doesn't parse, however it fails."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    # The parser ends lines at these alone; a form feed is no end.
    rows, out, todo = re.split(r"\r\n|\r|\n", source), [], [tree]
    while todo:
        node = todo.pop()
        todo += reversed(list(ast.iter_child_nodes(node)))
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            part = rows[node.lineno - 1 : node.end_lineno]
            # Columns are counted in bytes.
            part[-1] = part[-1].encode()[: node.end_col_offset].decode()
            part[0] = part[0].encode()[node.col_offset :].decode()
            out.append(("class_definition" if isinstance(node, ast.ClassDef) else "function_definition", node.name, node.lineno, node.end_lineno, "\n".join(part)))
    return out


def python_imports(source: str, most: int = 40) -> list[str]:
    """Top-level import statements, as they are written."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return [ast.get_source_segment(source, n) for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)][:most]


def brace_outline(source: str, language: str) -> list[Unit]:
    """Declarations of a language with braces, in the order of their heads: from the head to the brace that closes its first."""
    bare = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    closing, stack = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            closing[stack.pop()] = m.end()
    found: dict[tuple[int, int], Unit] = {}
    # The pattern of methods meets other heads too: of equal spans the kind that is named first stays.
    for kind in sorted(NODES[language], key=lambda k: k.startswith("method")):
        if kind == "function_definition" or language == "php" and kind == "method_declaration":
            pattern = re.compile(KEYWORD_FUNCTION if language in ("php", "scala") else _METHOD)
        else:
            pattern = re.compile(HEADS[kind])
        for m in pattern.finditer(bare):
            name = next(g for g in reversed(m.groups()) if g)
            opened = bare.find("{", m.start() if kind != "arrow_function" else m.end() - 1)
            ended = bare.find(";", m.end())
            if name in NO_CALLS or opened < 0 or opened not in closing or 0 <= ended < opened:
                continue
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            span = (first, closing[opened])
            found.setdefault(span, (kind, name, source.count("\n", 0, first) + 1, source.count("\n", 0, span[1]) + 1, source[slice(*span)]))
    return [found[s] for s in sorted(found, key=lambda s: (s[0], -s[1]))]


def ruby_outline(source: str) -> list[Unit]:
    """Methods, classes and modules: up to the ``end`` with their own indentation."""
    out = []
    for m in _RUBY.finditer(source):
        last = re.compile(rf"^{m[1]}end\b", re.M).search(source, m.end())
        if last:
            first = m.start() + len(m[1])
            out.append(("method" if m[2] == "def" else m[2], m[3], source.count("\n", 0, first) + 1, source.count("\n", 0, last.end()) + 1, source[first : last.end()]))
    return out


def outline(source: str, language: str) -> list[Unit]:
    """(kind, name, first line, last line, content) of the declarations that are chunks; none for other languages."""
    if language not in NODES:
        return []
    return python_outline(source) if language == "python" else ruby_outline(source) if language == "ruby" else brace_outline(source, language)


def syntax_units(files: DataFrame, path: str = "file_path", text: str = "source_text", language: str | None = None) -> DataFrame:
    """One row for each declaration of each source, nested ones too; equal spans of a file count once.

    ``language`` is read from the column of that name unless it is given. Files
    without any declaration, or that don't parse, give no rows: cut those into windows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, source, kind_of in zip(batch[path], batch[text], batch["_language"], strict=True):
                source = source or ""
                top, seen = python_imports(source) if kind_of == "python" else None, set()
                for kind, symbol, first, last, content in outline(source, kind_of):
                    if (first, last, content) not in seen:
                        seen.add((first, last, content))
                        out.append((str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}:{first}:{last}:{symbol}")), name, symbol, kind, kind_of, first, last, content, top))
            yield pd.DataFrame(out, columns=["chunk_id", "file_path", "symbol_name", "symbol_type", "language", "start_line", "end_line", "content", "syntax_imports"])

    chosen = files.select(path, text, (F.col("language") if language is None else F.lit(language)).alias("_language"))
    units = chosen.mapInPandas(run, "chunk_id string, file_path string, symbol_name string, symbol_type string, language string, start_line int, end_line int, content string, syntax_imports array<string>")
    # Where the syntax names no import, lines that look like one do.
    by_line = files.select(F.col(path).alias("file_path"), imports(F.col(text)).alias("imports"))
    units = units.join(by_line, "file_path")
    return units.withColumn("imports", F.when(F.size("syntax_imports") > 0, F.col("syntax_imports")).otherwise(F.col("imports"))).drop("syntax_imports")


def python_units(files: DataFrame, path: str = "file_path", text: str = "source_text") -> DataFrame:
    """``syntax_units`` of Python sources."""
    return syntax_units(files, path, text, "python")


def embedding_text(path: Column, kind: Column, symbol: Column, content: Column) -> Column:
    return F.concat(F.lit("# "), path, F.lit(" :: "), kind, F.lit(" "), symbol, F.lit("\n"), content)
