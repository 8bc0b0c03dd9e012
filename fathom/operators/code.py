"""Chunks of Python source along its syntax tree, and checks of code chunks."""

from __future__ import annotations

import ast
import textwrap
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType

from fathom.operators.chunkers import handed_on, split_lines, split_recursive

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DEFINITIONS = (*_FUNCTIONS, ast.ClassDef)
#: A chunk of so many words or fewer joins the next one of its scope.
SHORT = 50


def _label(node: ast.AST) -> str:
    return f"{'class' if isinstance(node, ast.ClassDef) else 'function'}:{node.name}"


class _Walk:
    """Collects chunks: functions whole, the plain statements of classes in runs."""

    def __init__(self, lines: list[str]):
        self.lines, self.scope, self.out = lines, [], []

    def piece(self, first: ast.AST, last: ast.AST, kind: str, parent: str) -> dict:
        text = "\n".join(self.lines[first.lineno - 1 : last.end_lineno]).strip()
        return {"text": text, "node_type": kind, "start_line": first.lineno, "end_line": last.end_lineno, "parent": parent}

    def visit(self, node: ast.AST) -> None:
        if isinstance(node, _FUNCTIONS):
            self.out.append(self.piece(node, node, type(node).__name__, " > ".join([*self.scope, _label(node)])))
        elif isinstance(node, ast.ClassDef):
            self.scope.append(_label(node))
            for run in _plain_runs(node.body):
                self.out.append(self.piece(run[0], run[-1], "ClassHeader", " > ".join(self.scope)))
            for child in node.body:
                self.visit(child)
            self.scope.pop()
        else:
            for child in ast.iter_child_nodes(node):
                self.visit(child)


def _plain_runs(body: list[ast.stmt]) -> list[list[ast.stmt]]:
    runs: list[list[ast.stmt]] = [[]]
    for node in body:
        if isinstance(node, _DEFINITIONS):
            runs.append([])
        else:
            runs[-1].append(node)
    return [r for r in runs if r]


def _join_short(chunks: list[dict]) -> list[dict]:
    """A short chunk goes in front of the next one of the same scope, which keeps its own metadata."""
    out: list[dict] = []
    carry = ""
    for i, c in enumerate(chunks):
        text = carry + c["text"]
        after = chunks[i + 1] if i + 1 < len(chunks) else None
        related = after is not None and (c["parent"] == after["parent"] or (c["node_type"] == "ClassHeader" and after["parent"].startswith(c["parent"] + " >")))
        if related and len(text.split()) <= SHORT:
            carry = text + "\n\n"
        else:
            out.append(c | {"text": text})
            carry = ""
    return out


def split_code(source: str) -> list[dict]:
    """Chunks of a module; none if it doesn't parse. Statements between top-level definitions come
    last, as orphans, and never join others."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return []
    walk = _Walk(source.splitlines())
    walk.visit(tree)
    orphans = [walk.piece(r[0], r[-1], "orphan", "") | {"is_orphan": True} for r in _plain_runs(tree.body)]
    return [c for c in [*_join_short(walk.out), *orphans] if c["text"].strip()]


def chunk_source(source: str, mode: str, size: int, overlap: int) -> list[dict]:
    """Chunks with their ids. Oversize pieces of ``structure_code`` are split once more as ``i_j``."""
    if mode == "structure_code":
        out = []
        for i, c in enumerate(split_code(source)):
            if len(c["text"]) <= size:
                out.append(c | {"chunk_id": str(i)})
            else:
                out += [c | {"chunk_id": f"{i}_{j}", "text": t, "fallback_chunked": True} for j, t in enumerate(split_recursive(c["text"], size, overlap))]
        return out
    if mode == "fixed":
        flat = split_recursive(source, size, overlap)
    elif mode == "line":
        flat = split_lines(source, size, overlap)
    elif mode == "token":
        words, step = source.split(), max(1, size - overlap)
        flat = [" ".join(words[i : i + size]) for i in range(0, max(len(words) - size, 0) + step, step) if i == 0 or i - step + size < len(words)] if words else []
    else:
        return []
    return [{"chunk_id": str(i), "text": t} for i, t in enumerate(flat) if t.strip()]


CODE_CHUNK = "chunk_id string, text string, node_type string, start_line int, end_line int, parent string, is_orphan boolean, fallback_chunked boolean"
_FIELDS = {"chunk_id": pa.string(), "text": pa.string(), "node_type": pa.string(), "start_line": pa.int32(), "end_line": pa.int32(), "parent": pa.string(), "is_orphan": pa.bool_(), "fallback_chunked": pa.bool_()}


def chunk_code(files: DataFrame, mode: str, size: int, overlap: int, id_col: str = "source_file", text: str = "text") -> DataFrame:
    """(file, chunk_id, text, tree metadata) of each source; metadata is null in the flat modes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return handed_on(batches, lambda t: chunk_source(t or "", mode, size, overlap), id_col, _FIELDS)

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, {CODE_CHUNK}")


def _is_python(code: str) -> bool:
    try:
        ast.parse(code)
    except SyntaxError:
        return False
    return True


def parses(code: str) -> bool:
    """Whether code is valid Python, on its own once dedented or as the body of a function."""
    plain = textwrap.dedent(code)
    return _is_python(plain) or _is_python("def body():\n" + textwrap.indent(plain, "    "))


@F.pandas_udf(BooleanType())
def code_parses(code: pd.Series) -> pd.Series:
    return code.fillna("").map(parses)
