"""FeatureCollections of any size, one file read by many tasks.

Hadoop's line reader splits a file at any separator byte; at "}" every row is the text up to a closing brace. Two passes:
the first gives what each split does to the open brackets, whether it begins inside a string or not; put together in the
file's order that tells where every split begins. The second cuts features out; one that spans splits is joined from pieces.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators.storage import Workspace
from gridweave.sources.geojson import FormatError, decode

#: The array of features, a string, innermost arrays (skipped), a bracket, a character that JSON has in strings only.
TOKEN = re.compile(r'(?P<features>"features"\s*:\s*\[)|"[^"\\]*(?:\\.[^"\\]*)*(?P<end>"|\Z)|(?:\[[^\[\]{}"]*\][\s,]*)+|[{}\[\]]|(?P<bad>[^\s\d,:.eE+\-truefalsn])', re.S)
STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
PAIRS = {"}": "{", "]": "["}


def _brackets(text: str, quoted: bool) -> tuple[list[tuple[int, str]], bool]:
    """Brackets outside strings with their places, "F" for the array of features, "!" for what can't be there; and whether
    the text ends inside a string. A text that begins inside one skips to its end."""
    begin = 0
    if quoted:
        end = STRING_END.match(text)
        if end is None:
            return [], True
        begin = end.end()
    found, quoted = [], False
    for m in TOKEN.finditer(text, begin):
        if m.lastgroup == "end":
            quoted = not m["end"]
        elif m.lastgroup == "features":
            found.append((m.end() - 1, "F"))
        elif m.lastgroup == "bad":
            return [*found, (m.start(), "!")], quoted
        elif m.end() - m.start() == 1:
            found.append((m.start(), m[0]))
    return found, quoted


class _Cursor:
    """Where a row of a split begins, counted from the split's first row: bytes, lines, characters of the line."""

    def __init__(self, offset: int = 0, line: int = 0, column: int = 0):
        self.offset, self.line, self.column = offset, line, column

    def place(self, text: str, at: int) -> tuple[int, int, int]:
        head = text[:at]
        lines = head.count("\n")
        return self.offset + len(head.encode()), self.line + lines, at - head.rfind("\n") - 1 if lines else self.column + at

    def after(self, text: str) -> _Cursor:
        return _Cursor(*self.place(text + "}", len(text) + 1))


class _Half:
    """What a split does to the brackets open before it, if it begins inside a string (or not)."""

    def __init__(self, quoted: bool):
        self.quoted, self.opened, self.closed, self.wrong, self.arrays = quoted, [], [], None, set()

    def bracket(self, kind: str, where: tuple) -> None:
        """where is (cursor, text, position): worked out only for what is still open at the end."""
        if kind in "{[F":
            if kind == "F":
                self.arrays.add((len(self.closed), "".join(k for k, _ in self.opened)))
            self.opened.append((kind, where))
        elif kind == "!" or (self.opened and PAIRS[kind] != self.opened[-1][0].replace("F", "[")):
            self.wrong = (f"unexpected {kind}" if kind in PAIRS else "unexpected character", where)
        elif self.opened:
            self.opened.pop()
        else:
            self.closed.append((kind, where))

    def row(self, cursor: _Cursor, text: str) -> None:
        found, self.quoted = _brackets(text, self.quoted)
        for at, kind in found:
            self.bracket(kind, (cursor, text, at))
            if self.wrong:
                return

    def summary(self) -> dict:
        place = lambda w: w[0].place(*w[1:])
        named = lambda pairs: [(k, *place(w)) for k, w in pairs]
        return {"quoted": self.quoted, "opened": named(self.opened), "closed": named(self.closed), "wrong": self.wrong and (self.wrong[0], *place(self.wrong[1])), "arrays": sorted(self.arrays)}


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, int, str]]:
    for b in batches:
        yield from zip(b["file"], b["block"], b["size"], b["value"], strict=True)


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a split: (file, block, size, end, summary of both halves). The brace after its last row is left open."""
    key, end = None, _Cursor()

    def close() -> pd.DataFrame:
        tail = {"end": (end.offset, end.line, end.column), "halves": [h.summary() for h in halves]}
        return pd.DataFrame({"file": [key[0]], "block": [key[1]], "size": [key[2]], "summary": [json.dumps(tail)]})

    for file, block, size, text in _rows(batches):
        if (file, block, size) != key:
            if key:
                yield close()
            key, end, halves, last = (file, block, size), _Cursor(), [_Half(False), _Half(True)], None
        for h in halves:
            if h.wrong is None and last is not None and not h.quoted:
                h.bracket("}", last)
            if h.wrong is None:
                h.row(end, text)
        last = (end, text + "}", len(text))
        end = end.after(text)
    if key:
        yield close()


def _fail(file: str, what: str, line: int, column: int) -> None:
    raise FormatError(f"{file}: {what}, line {line + 1}, column {column + 1}")


def _starts(splits: list) -> dict[tuple[str, int], dict]:
    """The state at the first row of each split, from the splits' summaries in the order of each file."""
    files, states = defaultdict(list), {}
    for s in splits:
        files[s.file].append(s)
    for file, parts in files.items():
        parts.sort(key=lambda s: s.block)
        size, offset, line, column, quoted, stack, seen = parts[0].size, 0, 0, 0, False, [], False
        total = sum(json.loads(s.summary)["end"][0] for s in parts)
        if not {total, total - 1} & {size, size - 3}:  # 3: a byte order mark, which the line reader takes off
            raise FormatError(f"{file}: not plain text in UTF-8")

        def close(kind: str, row: int, at: int) -> None:
            if not stack or stack[-1][0].replace("F", "[") != PAIRS[kind]:
                _fail(file, f"unexpected {kind}", row, at)
            stack.pop()

        for n, s in enumerate(parts):
            summary = json.loads(s.summary)
            shift = lambda o, r, c: (offset + o, line + r, c if r else column + c)
            ended = n + 1 < len(parts) or total in (size, size - 3)
            states[file, s.block] = {"offset": offset, "line": line, "column": column, "quoted": quoted, "stack": list(stack), "ended": ended}
            half = summary["halves"][quoted]
            before = "".join(k for k, *_ in stack)
            seen = seen or any(before[: len(before) - shut] + opened == "{" for shut, opened in half["arrays"] if shut <= len(before))
            for kind, *at in half["closed"]:
                close(kind, *shift(*at)[1:])
            if half["wrong"]:
                _fail(file, half["wrong"][0], *shift(*half["wrong"][1:])[1:])
            stack += [(kind, *shift(*at)) for kind, *at in half["opened"]]
            quoted = half["quoted"]
            offset, line, column = shift(*summary["end"])
            if ended and not quoted:
                close("}", line, column - 1)
        if quoted or stack:
            _fail(file, "unexpected end", line, column if ended else column - 1)
        if not seen:
            raise FormatError(f"{file}: not a FeatureCollection: no array of features")
    return states


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def _cut(batches: Iterator[pd.DataFrame], states: dict) -> Iterator[pd.DataFrame]:
    """(file, at, block, whole, text): features by their first byte, and pieces of those that reach over a split's edge."""
    parse = json.JSONDecoder(parse_constant=_no_constant).decode
    key, out, held = None, [], 0

    def feature(whole: bool) -> None:
        nonlocal held
        text = "".join(pieces)
        if whole:
            try:
                parse(text)
            except json.JSONDecodeError as e:
                _, line, column = _Cursor(*start).place(text, e.pos)
                _fail(key[0], e.msg, line, column)
            except ValueError as e:
                _fail(key[0], str(e), *start[1:])
        out.append((*key[:1], start[0], key[1], whole, text))
        held += len(text)

    def brace() -> None:
        """The brace that ends the row before."""
        nonlocal whole, start
        if quoted:
            if start:
                pieces.append("}")
            return
        stack.pop()
        if start:
            pieces.append("}")
            if stack == ["{", "F"]:
                feature(whole)
                pieces.clear()
                whole, start = True, None

    def finish() -> None:
        if state["ended"]:
            brace()
        if pieces:
            feature(False)

    def batch() -> pd.DataFrame:
        nonlocal held
        df = pd.DataFrame(out, columns=["file", "at", "block", "whole", "text"])
        out.clear()
        held = 0
        return df

    for file, block, _, text in _rows(batches):
        if (file, block) != key:
            if key:
                finish()
            key, state = (file, block), states[file, block]
            cursor, quoted = _Cursor(state["offset"], state["line"], state["column"]), state["quoted"]
            stack, pieces = [s[0] for s in state["stack"]], []
            inside = stack[:3] == ["{", "F", "{"]
            whole, start = not inside, state["stack"][2][1:] if inside else None
        else:
            brace()
        begin, edge, comma = 0, 0, r"\s*,\s*"  # what stands between two features, or between one and the end
        found, quoted = _brackets(text, quoted)
        for at, kind in found:
            if kind in "{[F":
                if stack == ["{", "F"]:
                    if kind != "{" or not re.fullmatch(comma, text[edge:at]):
                        _fail(file, "a feature or a comma is missing", *cursor.place(text, at)[1:])
                    start, begin = cursor.place(text, at), at
                stack.append(kind)
                if stack == ["{", "F"]:
                    edge, comma = at + 1, r"\s*"
            else:
                if stack == ["{", "F"] and text[edge:at].strip():
                    _fail(file, "unexpected text after a feature", *cursor.place(text, at)[1:])
                stack.pop()
        if start:
            pieces.append(text[begin:])
        cursor = cursor.after(text)
        if held > 1 << 24:
            yield batch()
    if key:
        finish()
    yield batch()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Features of the FeatureCollections under path, as geojson.read_collection gives them, whatever their size.

    The ordinal is the byte at which a feature begins in its file (after a byte order mark). Keys stand in any order; those
    beside "features" are skipped, and "features" itself is written without escapes. Faults raise FormatError here, with line
    and column, but in a feature that spans two splits, where decoding fails with its byte. A file without text isn't a
    collection; compressed files and other encodings aren't read. The driver takes one short row a split; the features'
    texts go to a table in the shared folder, so that later reads don't come back to the file.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    rows = raw.select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))
    splits = rows.mapInPandas(_survey, "file string, block long, size long, summary string").collect()
    if len({s.file for s in splits}) < len(raw.inputFiles()):
        raise FormatError(f"{path}: a file without text")
    states = spark.sparkContext.broadcast(_starts(splits))
    work = Workspace(spark, "collection")
    try:
        pieces = work.write(rows.mapInPandas(lambda batches: _cut(batches, states.value), "file string, at long, block long, whole boolean, text string"), "pieces")
    except PythonException as e:
        if "FormatError: " in str(e):
            raise FormatError(str(e).split("FormatError: ", 1)[1].split("\n")[0]) from e
        raise
    cut = pieces.where("NOT whole").groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p.text), "").alias("text"))
    return decode(pieces.where("whole").select("at", "text").unionByName(cut.select("at", "text")).withColumnRenamed("at", "ordinal"))
