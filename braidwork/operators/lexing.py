"""Physical lines of scripts to logical lines, by a scan that carries what is open from line to line.

Quotes and brackets may stay open over any number of lines, so what a line is
depends on all before it in its file. Lines are dealt by file and sorted; a task
reads each file once from its first line on and keeps the open quote, the brackets,
the parts of the logical line at hand and the stack of indents, nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from braidwork.operators.parts import values

#: Characters of a logical line; of a longer one the rest is left out, and it is a fault.
MOST_CHARS = 1 << 20

_ORDINARY = re.compile(r"[^'\"#()\[\]{}]+")
_CLOSES = {
    "'": re.compile(r"(?:[^\\']++|\\.)*+'", re.DOTALL),
    '"': re.compile(r'(?:[^\\"]++|\\.)*+"', re.DOTALL),
    "'''": re.compile(r"(?:[^\\']++|\\.|'(?!''))*+'''", re.DOTALL),
    '"""': re.compile(r'(?:[^\\"]++|\\.|"(?!""))*+"""', re.DOTALL),
}

#: A line that leaves nothing open, up to its comment: outside a quote, quotes that end, and brackets around such. Fixed value.
_WITHIN = r"""[^'"#()\[\]{}]++|"(?!"")(?:[^"\\]++|\\.)*+"|'(?!'')(?:[^'\\]++|\\.)*+'"""
_CLOSED = re.compile(rf"([ \t]*+)((?:{_WITHIN}|[(\[{{](?:{_WITHIN})*+[)\]}}])*+)(?:#|\Z)", re.DOTALL)


@dataclass
class Open:
    """What stands open where a line ends: a quote, whether its next character is escaped, and how many brackets."""

    quote: str | None = None
    escaped: bool = False
    brackets: int = 0

    def code(self, line: str) -> str:
        """The line up to a comment; changes what is open to what is open after it."""
        at = 0
        while at < len(line):
            if self.quote:
                if self.escaped:
                    at, self.escaped = at + 1, False
                elif closed := _CLOSES[self.quote].match(line, at):
                    at, self.quote = closed.end(), None
                else:
                    slashes = len(line) - max(len(line.rstrip("\\")), at)
                    at, self.escaped = len(line), slashes % 2 == 1
                continue
            if plain := _ORDINARY.match(line, at):
                at = plain.end()
                continue
            char = line[at]
            if char == "#":
                return line[:at]
            if char in "'\"":
                self.quote, self.escaped = (char * 3 if line.startswith(char * 3, at) else char), False
                at += len(self.quote)
                continue
            self.brackets = self.brackets + 1 if char in "([{" else max(self.brackets - 1, 0)
            at += 1
        return line


@dataclass
class File:
    """The scan of one file."""

    path: str | None
    open: Open = field(default_factory=Open)
    parts: list[str] = field(default_factory=list)
    size: int = 0
    start: int = 0
    end: int = 0
    lead: str = ""
    above: list[tuple[int, int]] = field(default_factory=list)  # (indent, first line) of the lines that enclose what comes next

    def line(self, number: int, text: str) -> tuple | None:
        """The logical line that ends here, if one does."""
        text = text.rstrip("\r\n")
        if not self.parts and (closed := _CLOSED.match(text)):  # most lines; the others go by quotes and brackets
            lead, code = closed.groups()
            code = code.rstrip()
            if not code:
                return None
            if code[-1] != "\\" and len(code) < MOST_CHARS:
                return self._placed(number, number, lead, code, None)
        content = text.lstrip() if self.parts else text.lstrip(" \t")
        if not self.parts:
            self.start, self.lead = number, text[: len(text) - len(content)]
        code = self.open.code(content).rstrip()
        self.end = number
        if self.parts or code:
            if self.size <= MOST_CHARS:
                self.parts.append(code)
            self.size += len(code) + 1
        goes_on = self.open.quote or self.open.brackets or code.endswith("\\")
        return None if goes_on or not self.parts else self.finished(None)

    def finished(self, fault: str | None) -> tuple | None:
        """The row of the logical line at hand: (path, start_line, end_line, indent, code, tab_indent, parent, fault)."""
        code = "\n".join(self.parts).rstrip()
        fault = "too_long" if self.size > MOST_CHARS else fault
        self.open, self.parts, self.size = Open(), [], 0
        return self._placed(self.start, self.end, self.lead, code, fault) if code else None

    def _placed(self, start: int, end: int, lead: str, code: str, fault: str | None) -> tuple:
        """The row of a logical line, and its place under those above it."""
        indent, above = len(lead), self.above
        while above and above[-1][0] >= indent:
            above.pop()
        parent = above[-1][1] if above else None
        above.append((indent, start))
        return self.path, start, end, indent, code, "\t" in lead, parent, fault

    def last(self) -> tuple | None:
        """What is left at the end of the file: with a quote or bracket open, a fault."""
        return self.finished("unterminated" if self.open.quote or self.open.brackets else None) if self.parts else None


#: The columns of logical lines. Fixed value.
COLUMNS = {"path": pa.string(), "start_line": pa.int64(), "end_line": pa.int64(), "indent": pa.int32(), "code": pa.string(), "tab_indent": pa.bool_(), "parent": pa.int64(), "fault": pa.string()}

_SQL_NAMES = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}


def _rows(found: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    values = list(zip(*found, strict=True)) if found else [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(values, columns.values(), strict=True)], names=list(columns))


def scanned(lines: DataFrame, columns: dict[str, pa.DataType], reader: Callable[[], Callable[[tuple], tuple | None]] | None = None) -> DataFrame:
    """lines(path, line_no, line) -> rows of ``columns``: the logical lines, or what ``reader``, made anew for each file, gives for each in order; None gives no row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = read = None
        for batch in batches:
            found = []
            for path, number, text in zip(*map(values, batch.columns), strict=True):
                if file is None or path != file.path:
                    if file and (row := file.last()):
                        found.append(read(row) if read else row)
                    file, read = File(path), reader and reader()
                if row := file.line(number, text or ""):
                    found.append(read(row) if read else row)
            yield _rows([x for x in found if x], columns)
        if file and (row := file.last()) and (left := read(row) if read else row):
            yield _rows([left], columns)

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small files of much text are not put into few tasks
    dealt = lines.select("path", "line_no", "line").repartition(parts, "path").sortWithinPartitions("path", "line_no")
    return dealt.mapInArrow(scan, ", ".join(f"{name} {_SQL_NAMES[kind]}" for name, kind in columns.items()))


def logical_lines(lines: DataFrame) -> DataFrame:
    """lines(path, line_no, line) -> (path, start_line, end_line, indent, code, tab_indent, parent, fault).

    Comments and blank lines go. A line goes on in the next while a quote or bracket is
    open, or where it ends with a backslash outside quotes; its parts are joined by
    newlines. ``parent`` is the first line of the last one before that stands further
    left, null at the left edge. fault: ``unterminated`` where the file ends with a
    quote or bracket open, ``too_long`` beyond ``MOST_CHARS``, else null. A null line is empty.
    """
    return scanned(lines, COLUMNS)
