"""Logical lines of scripts as statement rows: blocks by indentation, and what each statement is.

Files are independent: what a line stands under is carried on in the scan that reads its file, so no row is sorted or looked up again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.operators.lexing import logical_lines, scanned

#: Statement words that stand for themselves. Fixed values.
PLAIN = ("scene", "show", "hide", "play", "stop", "queue", "voice", "with", "pause", "pass", "window")

#: A string literal: between triple quotes, which newlines may stand in, or single ones; loops take no stack. Fixed value.
_QUOTED = (
    r"\"{3}(?:[^\"\\]++|\\(?s:.)|\"(?!\"\"))*+\"{3}|'{3}(?:[^'\\]++|\\(?s:.)|'(?!''))*+'{3}"
    r"|\"(?!\"\")(?:[^\"\\\n]++|\\(?s:.))*+\"|'(?!'')(?:[^'\\\n]++|\\(?s:.))*+'"
)

#: What a backslash and a character stand for in a literal, but for code points and the backslash itself. Fixed values.
_ESCAPES = (("\n", ""), ("'", "'"), ('"', '"'), ("n", "\n"), ("t", "\t"), ("r", "\r"))


def head(text: Column) -> tuple[Column, Column]:
    """The leading word (letters, digits, ``_``; or ``$``) of a text, and the rest without outer blanks."""
    trimmed = F.ltrim(text)
    word = F.regexp_extract(trimmed, r"^(\$|[\p{L}\p{N}_]*)", 1)
    return word, F.trim(F.substring(trimmed, F.length(word) + 1, F.length(trimmed)))


def without_colon(text: Column) -> Column:
    """A block header without its last colon; null where it has none."""
    bare = F.rtrim(text)
    return F.when(bare.endswith(":"), F.rtrim(F.substring(bare, F.lit(1), F.length(bare) - 1)))


def literal_value(literal: Column) -> Column:
    """What a quoted literal says: without its quotes, with simple escapes resolved."""
    triple = literal.startswith('"""') | literal.startswith("'''")
    body = F.when(triple, F.substring(literal, F.lit(4), F.length(literal) - 6)).otherwise(F.substring(literal, F.lit(2), F.length(literal) - 2))
    said = F.replace(body, F.lit("\\\\"), F.lit("\x01"))
    for char, value in _ESCAPES:
        said = F.replace(said, F.lit(f"\\{char}"), F.lit(value))
    return F.when(literal.contains("\\"), F.replace(said, F.lit("\x01"), F.lit("\\"))).otherwise(body)


def with_choice(rows: DataFrame, text: str, in_menu: Column) -> DataFrame:
    """``rows`` with ``caption`` and ``choice_condition`` of ``"caption":`` or ``"caption" if condition:`` in a menu; null where the line is no choice."""
    pattern = rf"^\s*({_QUOTED})\s*(?:if\b\s*((?s:.+)))?$"
    rows = rows.withColumn("choice", F.when(in_menu, without_colon(F.col(text))))
    rows = rows.withColumn("literal", F.when(F.col("choice").isNotNull(), F.nullif(F.regexp_extract("choice", pattern, 1), F.lit(""))))
    condition = F.when(F.col("literal").isNotNull() & F.col("choice").contains("if"), F.nullif(F.trim(F.regexp_extract("choice", pattern, 2)), F.lit("")))
    return rows.withColumn("choice_condition", condition).withColumn("caption", F.when(F.col("literal").isNotNull(), literal_value(F.col("literal")))).drop("choice", "literal")


#: A line's first word, ``$`` for one; and the name after it. Fixed values.
_WORD, _NAME = re.compile(r"\$|\w*"), re.compile(r"(?:label|jump|call)(?!\w) *([\w.]+)")

#: Words of lines whose blocks hold statements. Fixed values.
_HOLDING = ("menu", "if", "elif", "else")

#: What ``_Blocks`` gives of each line. Fixed value.
_PLACED = {
    "path": pa.string(), "stmt": pa.int64(), "end_line": pa.int64(), "code": pa.string(), "word": pa.string(), "named": pa.string(), "label": pa.string(), "parent": pa.int64(),
    "in_menu": pa.bool_(), "ordinal": pa.int32(), "if_at": pa.int64(),
}


@dataclass(slots=True)
class _Block:
    """A line that others may stand under, and what is known of those that do."""

    indent: int = -1
    start: int | None = None
    word: str | None = None  # null at the top of a file and for a faulty line
    is_label: bool = False
    over: str | None = None  # the word of the block that it stands in
    rows: int = 0
    if_at: int | None = None
    flat: _Block | None = None  # the label whose block goes on beside it


class _Blocks:
    """Logical lines of a file, one after the other -> rows of ``_PLACED`` of those that are reached from a label: what they stand under."""

    def __init__(self):
        self.open, self.last, self.current, self.label = [_Block()], None, None, None

    def __call__(self, line: tuple) -> tuple | None:
        path, start, end, indent, code, _, _, fault = line
        word = None if fault else _WORD.match(code).group()
        if self.last and not fault:  # the line before was a label
            label, beside = self.last
            beside.flat = label if indent == label.indent and word != "label" and label.start > 0 else None
            self.last = None
        while self.open[-1].indent >= indent:
            self.open.pop()
        under = beside = self.open[-1]
        if fault:
            self.open.append(_Block(indent, start))
            return None
        named = own.group(1) if word in ("label", "jump", "call") and (own := _NAME.match(code)) else None
        is_label = bool(word == "label" and named and code[-1] == ":")
        if under.flat and not is_label:
            under = under.flat
        here = _Block(indent, start, word, is_label, under.word)
        self.open.append(here)
        if is_label:
            self.last = here, beside
            if named[0] != ".":
                self.current = named
        if named and named[0] == ".":
            named = (self.current or "") + named
        if is_label:
            self.label = named
        held = is_label if under.start is None else under.is_label or under.word in _HOLDING or under.over == "menu"
        if not held or self.label is None:
            return None
        under.rows += 1
        if word == "if":
            under.if_at = start
        return path, start, end, code, word, named, self.label, under.start, under.word == "menu", under.rows - 1, under.if_at


def statements(lines: DataFrame) -> DataFrame:
    """lines(path, line_no, line) -> statement rows, one a logical line that is reached from a label.

    Lines with a fault give no row, see ``diagnostics``.

    (path, stmt, parent, ordinal, kind, label, name, target, expression,
    condition, caption, reason, start_line, end_line, text). kind: label, menu,
    choice, caption, if, branch, jump, call, return, opaque, a word of ``PLAIN``
    or statement. A line under a statement that opens no block of its own, or
    before the first label, gives no row. Lines of one ``if`` are its branches;
    ``chain`` is the line of that ``if``. Statements at the indent of a label
    right after it are its block, up to the next label.
    """
    rows = scanned(lines, _PLACED, _Blocks)
    trimmed = F.trim(F.substring("code", F.length("word") + 1, F.length("code")))
    rows = rows.withColumn("tail", trimmed).withColumn("opens", F.col("code").endswith(":"))
    in_menu = F.col("in_menu")
    rows = with_choice(rows, "code", in_menu)
    screen = (F.col("word") == "call") & F.col("tail").rlike(r"^screen\b")
    rows = rows.withColumn("transfer", F.col("word").isin("jump", "call") & ~screen)
    rows = rows.withColumn("dynamic", F.when(F.col("transfer"), F.when(F.col("tail").startswith("expression"), F.regexp_extract("tail", r"^expression\s*(.*)$", 1)).otherwise("")))
    transfer, dynamic = F.col("transfer"), F.col("dynamic")
    kind = (
        F.when((F.col("word") == "label") & F.col("opens") & F.col("named").isNotNull(), "label")
        .when(in_menu, F.when(F.col("caption").isNotNull(), "choice").when(F.col("word") == "set", "set").otherwise("caption"))
        .when(transfer, F.col("word"))
        .when(F.col("word") == "return", "return")
        .when(F.col("word").isin("if", "elif", "else"), "branch")
        .when(F.col("word") == "menu", "menu")
        .when(F.col("word").isin("call", "python", "$", "init") | F.col("opens"), "opaque")
        .when(F.col("word").isin(*PLAIN), F.col("word"))
        .otherwise("statement")
    )
    reason = F.when(F.col("kind") == "opaque", F.when(F.col("word") == "call", "interactive_screen_call").when(F.col("word").isin("python", "$", "init"), "embedded_python_not_executed").when(F.col("word").isin("while", "for"), "unsupported_control_flow").otherwise("creator_or_unsupported_block"))
    rows = rows.withColumn("kind", kind).withColumn("reason", reason)
    return rows.select(
        "path", "stmt", "parent", "ordinal", "kind", "label",
        F.when(F.col("kind") == "label", F.col("label")).alias("name"),
        F.when(transfer & (dynamic == "") & (F.col("tail") != "expression"), F.col("named")).alias("target"),
        F.when(transfer & ((dynamic != "") | (F.col("tail") == "expression")), F.coalesce(F.nullif(dynamic, F.lit("")), F.lit("<empty expression>"))).alias("expression"),
        F.coalesce(F.col("choice_condition"), F.when((F.col("kind") == "branch") & (F.col("word") != "else"), without_colon(F.col("tail")))).alias("condition"),
        "caption", "reason", F.when(F.col("kind") == "branch", F.col("if_at")).alias("chain"), F.col("stmt").alias("start_line"), "end_line", F.col("code").alias("text"),
    )


def diagnostics(lines: DataFrame) -> DataFrame:
    """(path, code, start_line) of logical lines indented by tabs, without an end or too long, labels and branches without a colon, and menus without a choice."""
    rows = logical_lines(lines)
    word, _ = head(F.col("code"))
    rows = rows.withColumn("word", word).withColumn("opens", without_colon(F.col("code")).isNotNull())
    nested = rows.where("parent IS NOT NULL").select("path", F.col("parent").alias("start_line")).distinct().withColumn("nested", F.lit(True))
    rows = rows.join(nested, ["path", "start_line"], "left")
    sound = F.col("fault").isNull()
    code = F.array_compact(F.array(
        F.col("fault"),
        F.when(F.col("tab_indent"), "tab_indent"),
        F.when(sound & (F.col("word") == "label") & ~F.col("opens"), "malformed_label"),
        F.when(sound & F.col("word").isin("if", "elif", "else") & ~F.col("opens"), "malformed_if"),
        F.when(sound & (F.col("word") == "menu") & F.col("nested").isNull(), "empty_menu"),
    ))
    return rows.select("path", F.explode(code).alias("code"), "start_line")
