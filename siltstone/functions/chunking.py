"""Source files into chunks: named functions and classes of six languages, sections of Markdown, or the whole file.

A language is a Pack: its extensions, how its definitions, imports and bodies are found. Python goes through its own
parser; the others through a masked copy of the text, in which strings and comments are blanks of the same length, so that
patterns and brackets are only seen in code. A file without definitions, or one that a parser refuses, is one module chunk.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import control

CHUNK = "file_path string, start_line long, end_line long, chunk_type string, kind string, name string, language string, content string, chunk_id string, token_count long, ord long"
SECTION_BUDGET, NESTING_LIMIT = 400, 192  # fixed values: tokens of a section, depth of quotes and indents


@dataclass(frozen=True)
class Found:
    """A definition: its span, the start of its body (or its end), its kind and type."""

    begin: int
    end: int
    body: int
    kind: str
    type: str
    name: str


@dataclass(frozen=True)
class Pack:
    name: str
    extensions: tuple[str, ...]
    definitions: Callable[[str], list[Found]]
    imports: Callable[[str], list[str]]
    sample: str


def masked(text: str, comments: str, strings: str) -> str:
    """The text with comments and strings blanked; newlines stay."""
    return re.sub(f"{comments}|{strings}", lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def closing(text: str, at: int, pair: str = "{}") -> int:
    """The place after the bracket that closes the one at a place; the end if none does."""
    depth = 0
    for m in re.compile(rf"[{re.escape(pair)}]").finditer(text, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(text)


def python_definitions(text: str) -> list[Found]:
    lines = text.encode().splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    raw = text.encode()
    place = lambda line, col: len(raw[: starts[line - 1] + col].decode(errors="ignore"))
    out, todo = [], [ast.parse(text)]
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            cls = isinstance(node, ast.ClassDef)
            out.append(Found(place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset), place(node.body[0].lineno, node.body[0].col_offset), "class_definition" if cls else "function_definition", "class" if cls else "function", node.name))
        todo += list(ast.iter_child_nodes(node))
    return out


def python_imports(text: str) -> list[str]:
    found = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Import):
            found += [(node.lineno, a.name.split(".")[0]) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            found.append((node.lineno, node.module.split(".")[0]))
    return [name for _, name in sorted(found, key=lambda x: x[0])]


SLASHES = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
QUOTED = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?"


def braced(rules: list[tuple[str, str, str]], strings: str = QUOTED) -> Callable[[str], list[Found]]:
    """Definitions by pattern; each pattern ends with the opening brace of the body or with a semicolon, and names the definition if it can."""
    compiled = [(re.compile(p, re.M), kind, type_) for p, kind, type_ in rules]

    def find(text: str) -> list[Found]:
        code, out = masked(text, SLASHES, strings), {}
        for pattern, kind, type_ in compiled:
            for m in pattern.finditer(code):
                begin, name = m.start("at") if "at" in pattern.groupindex else m.start(), m.groupdict().get("name") or ""
                if name in ("if", "for", "while", "switch", "catch", "return", "else", "do", "function", "sizeof"):
                    continue
                body = m.end() - 1
                end = closing(code, body) if code[body] == "{" else m.end()
                out.setdefault(begin, Found(begin, end, body if code[body] == "{" else end, kind, type_, name))
        return list(out.values())

    return find


SCRIPT = [
    (r"(?P<at>(?:async\s+)?function\b\s*\*?\s*(?P<name>[\w$]+)\s*\([^()]*\)[^{};]*)\{", "function_declaration", "function"),
    (r"^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*(?P<at>(?P<name>[\w$#]+)\s*\([^(){};]*\)\s*(?::[^{};=]+)?)\{", "method_definition", "function"),
    (r"(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?P<at>(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^={}]+)?=>\s*)\{", "arrow_function", "function"),
    (r"(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?P<at>(?:async\s+)?function\s*\*?\s*\([^()]*\)[^{};]*)\{", "function_expression", "function"),
    (r"(?P<at>(?:abstract\s+)?class\s+(?P<name>[\w$]+)[^{};]*)\{", "class_declaration", "class"),
]
TYPED = [(r"(?P<at>interface\s+(?P<name>[\w$]+)[^{};]*)\{", "interface_declaration", "class"), (r"(?P<at>(?:const\s+)?enum\s+(?P<name>[\w$]+)\s*)\{", "enum_declaration", "class")]
RUST = [
    (r"(?P<at>(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern\s+\S+)\s+)*fn\s+(?P<name>\w+)[^{};]*)\{", "function_item", "function"),
    *[(rf"(?P<at>(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?{w}\b(?:<[^{{}};]*?>)?\s+(?P<name>[\w:]+)[^{{}};]*)[{{;]", f"{w}_item", "class") for w in ("struct", "enum", "trait", "impl", "union")],
]
C = [
    (r"^(?P<at>(?:[A-Za-z_]\w*(?:\s+|\s*\*[\s*]*))+(?P<name>\w+)\s*\([^;{}]*\)\s*)\{", "function_definition", "function"),
    *[(rf"(?P<at>\b{w}\s+(?P<name>\w+)\s*)\{{", f"{w}_specifier", "class") for w in ("struct", "union", "enum")],
]


def ruby_definitions(text: str) -> list[Found]:
    """def, class and module up to their end, by counting what opens a block at the start of a line or ends it with do."""
    code = masked(text, r"#[^\n]*|^=begin[\s\S]*?^=end", QUOTED)
    opens = re.compile(r"(?m)^[ \t]*(?:(?P<def>def)[ \t]+(?P<self>self\.)?(?P<d>[\w?!=.]+)|(?P<cls>class|module)[ \t]+(?P<c>[\w:<]+)|(?:if|unless|while|until|case|begin|for)\b)|\bdo\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*$)|=[ \t]*(?:if|case|begin)\b|\b(?P<end>end)\b")
    out, held = [], []
    for m in opens.finditer(code):
        if m["end"]:
            if held and (own := held.pop()):
                begin, body, kind, type_, name = own
                out.append(Found(begin, m.end(), body, kind, type_, name))
        elif m["def"] or m["cls"]:
            begin = m.start("def" if m["def"] else "cls")
            line = code.find("\n", begin) + 1 or len(code)
            kind = ("singleton_method" if m["self"] else "method") if m["def"] else m["cls"]
            held.append((begin, line, kind, "function" if m["def"] else "class", m["d"] or m["c"]))
        else:
            held.append(None)
    return out


def specifier(spec: str) -> str:
    own = [s for s in spec.split("/") if s not in ("", ".", "..")]
    return "/".join(own[:2]) if own and own[0].startswith("@") else own[0] if own else ""


def by_pattern(pattern: str, shape: Callable[[str], str]) -> Callable[[str], list[str]]:
    found = re.compile(pattern, re.M)
    return lambda text: [shape(next(g for g in m.groups() if g)) for m in found.finditer(text)]


_stem = lambda p: re.sub(r"\.[^./]*$", "", p.rsplit("/", 1)[-1])
_script_imports = by_pattern(r"""(?:import|export)\b[^'"\n;]*?from\s*['"]([^'"]+)|^\s*import\s*['"]([^'"]+)|\brequire\(\s*['"]([^'"]+)|\bimport\(\s*['"]([^'"]+)""", specifier)
_TEMPLATES = QUOTED + r"|`(?:\\.|[^`\\])*`?"
PACKS = [
    Pack("python", (".py",), python_definitions, python_imports, "import os\n\n\ndef f():\n    return os\n"),
    Pack("javascript", (".js", ".jsx", ".mjs", ".cjs"), braced(SCRIPT, _TEMPLATES), _script_imports, "import a from 'b';\nfunction f() { return a; }\n"),
    Pack("ruby", (".rb",), ruby_definitions, by_pattern(r"""^\s*require(?:_relative)?\s*\(?\s*['"]([^'"]+)""", _stem), "require 'set'\ndef f\n  1\nend\n"),
    Pack("rust", (".rs",), braced(RUST, r'"(?:\\.|[^"\\])*"?|' + r"'(?:\\.|[^'\\\n])'"), by_pattern(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?:::)?(\w+)", str), "use std::io;\nfn f() -> u8 { 1 }\n"),
    Pack("typescript", (".ts", ".tsx"), braced([*TYPED, *SCRIPT], _TEMPLATES), _script_imports, "import a from './b';\nfunction f(x: number): number { return x; }\n"),
    Pack("c", (".c", ".h"), braced(C), by_pattern(r'^\s*#\s*include\s*[<"]([^>"]+)', _stem), "#include <stdio.h>\nint f(void) { return 1; }\n"),
]


TYPES = ("function", "class")


class Registry:
    """Packs by extension; a name or an extension is taken once."""

    def __init__(self, packs: list[Pack] = PACKS):
        self.packs, self.by_extension = [], {}
        for pack in packs:
            self.register(pack)

    def register(self, pack: Pack) -> None:
        taken = [e for e in pack.extensions if e in self.by_extension]
        if taken or any(p.name == pack.name for p in self.packs):
            raise ValueError(f"{pack.name}: name or extension {taken} already registered")
        self.packs.append(pack)
        self.by_extension |= {e: pack for e in pack.extensions}

    def of(self, path: str) -> Pack | None:
        name = path.rsplit("/", 1)[-1]
        return self.by_extension.get("." + name.rsplit(".", 1)[1].lower()) if "." in name[1:] else None

    def validate(self) -> dict[str, list[str]]:
        """What is wrong with each pack: its shape; what it finds in its own sample, by types that are known; and whether the chunks of
        the sample lie in it, in order and each with an id of its own."""
        out = {}
        for p in self.packs:
            wrong = [f"extension {e!r} is no lower-case suffix" for e in p.extensions if not re.fullmatch(r"\.[a-z0-9]+", e)]
            wrong += [] if p.name and p.extensions else ["a pack needs a name and an extension"]
            found = p.definitions(p.sample)
            wrong += [] if found else ["no definition found in the sample"]
            wrong += [] if p.imports(p.sample) else ["no import found in the sample"]
            for type_ in dict.fromkeys(f.type for f in found if f.type not in TYPES):
                near = control.suggestions(type_, list(TYPES))
                wrong.append(f"type {type_!r} is not known" + (f"; did you mean {', '.join(map(repr, near))}?" if near else ""))
            wrong += ["a definition lies outside the sample"] if any(not 0 <= f.begin < f.end <= len(p.sample) for f in found) else []
            ids = [identity("sample", f.begin, f.end, p.sample[f.begin : f.end]) for f in found]
            wrong += ["two chunks of the sample have one id"] if len(set(ids)) < len(ids) else []
            out[p.name] = wrong
        return out


def token_estimate(text: str) -> int:
    return max(1, len(text.encode()) // 4)


def identity(path: str, start: int, end: int, content: str) -> str:
    return hashlib.sha256(f"{path}:{start}:{end}:".encode() + content.encode()[:100]).hexdigest()[:16]


def row(path: str, start: int, end: int, type_: str, kind: str, name: str, language: str, content: str) -> tuple:
    return path, start, end, type_, kind, name, language, content, identity(path, start, end, content), token_estimate(content)


def code_chunks(path: str, text: str, registry: Registry) -> list[tuple]:
    """Chunks in order of where they begin, outer ones first; else the whole file."""
    pack, found = registry.of(path), []
    if pack:
        try:
            found = sorted(pack.definitions(text), key=lambda f: (f.begin, -f.end))
        except (SyntaxError, ValueError, RecursionError):
            found = []
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    if not found:
        return [row(path, 1, len(breaks) + 1, "module", "module", "", pack.name if pack else "text", text)]
    return [row(path, line(f.begin), line(max(f.begin, f.end - 1)), f.type, f.kind, f.name, pack.name, text[f.begin : f.end]) for f in found]


def imports_of(path: str, text: str, registry: Registry) -> list[str]:
    pack = registry.of(path)
    try:
        return [m for m in dict.fromkeys(pack.imports(text)) if m] if pack else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def compressed(path: str, text: str, level: str, registry: Registry) -> str:
    """"full": the text; "signature": the head of its first definition; "compact": that and the signatures of members, or the first
    line of the body."""
    if level == "full":
        return text
    pack = registry.of(path)
    try:
        found = sorted(pack.definitions(text), key=lambda f: (f.begin, -f.end)) if pack else []
    except (SyntaxError, ValueError, RecursionError):
        found = []
    if not found:
        lines = text.splitlines()
        at = next((i for i, x in enumerate(lines) if x.strip()), None)
        rest = 0 if at is None else len(lines) - at - 1
        return "" if at is None else lines[at] + (f"\n… (+{rest} lines)" if rest and level else "")
    top = found[0]
    head = text[top.begin : top.body].rstrip()
    if level == "signature" or top.body >= top.end:
        return head
    if top.type == "class":
        members = [f for f in found[1:] if f.end <= top.end and not any(o is not f and o is not top and o.begin < f.begin and f.end <= o.end for o in found)]
        return "\n".join([head, *["  " + text[m.begin : m.body].strip() for m in members]])
    body = [x for x in text[top.body : top.end].strip("{} \n").splitlines() if x.strip()]
    return head + (f"\n  {body[0].strip()}" + (f"\n  … (+{len(body) - 1} lines)" if len(body) > 1 else "") if body else "")


def nesting(text: str) -> int:
    """The deepest run of quote marks and indents at the start of a line."""
    depth = lambda s: s.count(">") + (len(s.replace("\t", "    ").replace(">", "")) // 2)
    return max((depth(re.match(r"[ \t>]*", x)[0]) for x in text.splitlines()), default=0)


def headings(text: str) -> list[tuple[int, int, str]]:
    """(line from 0, level, title) of ATX and setext headings outside fences."""
    out, fence, lines = [], None, text.split("\n")
    for i, raw in enumerate(lines):
        line = raw.rstrip("\r")
        mark = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = None
        elif mark and not (mark[1][0] == "`" and "`" in mark[2]):
            fence = mark[1]
        elif m := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            out.append((i, len(m[1]), (m[2] or "").strip()))
        elif i and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", line)) and lines[i - 1].strip() and not re.match(r" {0,3}(?:[#>]|[-*+][ \t]|\d+[.)][ \t])", lines[i - 1]) and (not out or out[-1][0] != i - 1):
            out.append((i - 1, 1 if m[1][0] == "=" else 2, lines[i - 1].strip()))
    return out


def markdown_chunks(path: str, text: str, budget: int = SECTION_BUDGET) -> list[tuple]:
    """Sections: whole if they fit the budget or have no parts, else their own text and then their parts."""
    lines = text.split("\n")
    marks = headings(text) if nesting(text) <= NESTING_LIMIT else []
    if not marks:
        return [row(path, 1, text.count("\n") + 1, "module", "module", "", "markdown", text)]
    out: list[tuple] = []

    def add(lo: int, hi: int, kind: str, name: str) -> None:
        while hi > lo and not lines[hi - 1].strip():
            hi -= 1
        if hi > lo:
            out.append(row(path, lo + 1, hi, "module", kind, name, "markdown", "\n".join(lines[lo:hi])))

    if marks[0][0]:
        add(0, marks[0][0], "preamble", "")
    todo = [(0, len(marks), ())]
    while todo:
        lo, hi, above = todo.pop()
        if lo >= hi:
            continue
        at, level, title = marks[lo]
        end = next((j for j in range(lo + 1, hi) if marks[j][1] <= level), hi)
        last = marks[end][0] if end < len(marks) else len(lines)
        name = " > ".join([*above, title])
        todo.append((end, hi, above))
        if end == lo + 1 or token_estimate("\n".join(lines[at:last])) <= budget:
            add(at, last, "section", name)
        else:
            add(at, marks[lo + 1][0], "section", name)
            todo.append((lo + 1, end, (*above, title)))
    return sorted(out, key=lambda r: r[1])


def chunk_files(files: DataFrame, registry: Registry | None = None, budget: int = SECTION_BUDGET) -> DataFrame:
    """files: file_path, content. A row a chunk; ord is 63 bits of a hash of path and place (two of n chunks share one with a chance of n * n / 2 ** 64)."""
    own = registry or Registry()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["file_path"], frame["content"]):
                content = content or ""
                rows = markdown_chunks(path, content, budget) if path.lower().endswith((".md", ".markdown")) else code_chunks(path, content, own)
                out += [(*r, int.from_bytes(hashlib.sha256(f"{path}\0{i}".encode()).digest()[:8]) >> 1) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return files.select("file_path", "content").mapInPandas(run, CHUNK)


def file_imports(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """file_path, module, place: in order, each once."""
    own = registry or Registry()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(p, m, i) for p, c in zip(frame["file_path"], frame["content"]) for i, m in enumerate(imports_of(p, c or "", own))]
            yield pd.DataFrame(out, columns=["file_path", "module", "place"]).astype({"place": "int64"})

    return files.select("file_path", "content").mapInPandas(run, "file_path string, module string, place long")


def compress_chunks(chunks: DataFrame, level: str, registry: Registry | None = None) -> DataFrame:
    own = registry or Registry()
    f = F.pandas_udf(lambda p, c: pd.Series([compressed(a, b or "", level, own) for a, b in zip(p, c)]), "string")
    return chunks.withColumn("compressed", f("file_path", "content"))
