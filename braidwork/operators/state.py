"""Requirements, effects and variables of story state, from conditions and statements.

Expressions are read by Python's grammar, never run: a small Arrow function
gives each row its structure, and everything after that is relational.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions import text as T

#: Parts of names of calls that change state. Fixed values.
STATE_CALLS = ("add", "award", "change", "decrease", "gain", "increase", "lose", "point", "remove", "relationship", "set", "stat", "update", "xp")

_COMPARES = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_TURNED = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}

REQUIREMENT = "status string, variables array<string>, reason string, terms array<struct<variable:string,op:string,value:string>>"
EFFECT = "op string, variable string, value string, status string, call_target string, reason string"


def _scalar(node: ast.expr) -> tuple[bool, object]:
    """Whether a node is a number, text, bool or None, and its value."""
    if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float, str, type(None))):
        return True, node.value
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        known, value = _scalar(node.operand)
        if known and isinstance(value, (int, float)) and not isinstance(value, bool):
            return True, -value
    return False, None


def _unsafe(node: ast.expr) -> str | None:
    """Why a condition's truth does not follow from its variables alone; None where it does."""
    match node:
        case ast.Name() | ast.Constant(value=bool() | None):
            return None
        case ast.UnaryOp(op=ast.Not()):
            return _unsafe(node.operand)
        case ast.BoolOp():
            return next(filter(None, map(_unsafe, node.values)), None)
        case ast.Compare():
            if any(type(op) not in _COMPARES for op in node.ops):
                return "unsupported_comparison_operator"
            plain = all(isinstance(x, ast.Name) or _scalar(x)[0] for x in [node.left, *node.comparators])
            return None if plain else "computed_comparison_operand"
    return "unsupported_or_dynamic_condition"


def _terms(node: ast.expr) -> list[tuple[str, str, str]]:
    """(variable, op, value) of comparisons that all have to hold: those joined by ``and`` at the top."""
    if isinstance(node, ast.BoolOp) and isinstance(node.op, ast.And):
        return [t for x in node.values for t in _terms(x)]
    if isinstance(node, ast.Name):
        return [(node.id, "==", "True")]
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not) and isinstance(node.operand, ast.Name):
        return [(node.operand.id, "==", "False")]
    out = []
    if isinstance(node, ast.Compare):
        for left, op, right in zip([node.left, *node.comparators], node.ops, node.comparators, strict=False):
            sign = _COMPARES.get(type(op))
            if sign and isinstance(left, ast.Name) and _scalar(right)[0]:
                out.append((left.id, sign, str(_scalar(right)[1])))
            elif sign and isinstance(right, ast.Name) and _scalar(left)[0]:
                out.append((right.id, _TURNED[sign], str(_scalar(left)[1])))
    return out


def requirement_of(expression: str | None) -> dict:
    """status proven or unresolved, the names read, a reason where unresolved, and the terms that must hold."""
    try:
        node = ast.parse((expression or "").strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError):
        return {"status": "unresolved", "variables": [], "reason": "invalid_expression", "terms": []}
    names = sorted({x.id for x in ast.walk(node) if isinstance(x, ast.Name)})
    reason = _unsafe(node)
    terms = [] if reason else [dict(zip(("variable", "op", "value"), t, strict=True)) for t in _terms(node)]
    return {"status": "unresolved" if reason else "proven", "variables": names, "reason": reason, "terms": terms}


def _called(node: ast.expr) -> str | None:
    """A dotted name that is called; None for anything else."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (base := _called(node.value)):
        return f"{base}.{node.attr}"
    return None


def effect_of(text: str | None) -> dict:
    """What a statement does to state; all fields null for one that does nothing that is known of."""
    row = dict.fromkeys(("op", "variable", "value", "status", "call_target", "reason"))
    try:
        body = ast.parse((text or "").strip().removeprefix("$").strip()).body
    except (SyntaxError, ValueError, RecursionError):
        return row
    if len(body) != 1:
        return row
    match body[0]:
        case ast.Assign(targets=[ast.Name(id=name)], value=value):
            known, found = _scalar(value)
            row |= {"op": "assignment", "variable": name, "value": str(found) if known else None, "status": "proven" if known else "unresolved", "reason": None if known else "computed_assignment_value"}
        case ast.Assign():
            row |= {"op": "assignment", "status": "unresolved", "reason": "dynamic_or_unsupported_assignment_target"}
        case ast.AugAssign(target=ast.Name(id=name), op=op, value=value):
            known, found = _scalar(value)
            row |= {"op": "augmented_assignment", "variable": name, "status": "unresolved"}
            if not isinstance(op, (ast.Add, ast.Sub)):
                row["reason"] = "unsupported_augmented_operator"
            elif known and isinstance(found, (int, float)) and not isinstance(found, bool):
                change = found if isinstance(op, ast.Add) else -found
                row |= {"op": "increment" if change >= 0 else "decrement", "value": str(abs(change)), "status": "proven"}
            else:
                row["reason"] = "computed_or_non_numeric_delta"
        case ast.AugAssign():
            row |= {"op": "augmented_assignment", "status": "unresolved", "reason": "dynamic_or_unsupported_assignment_target"}
        case ast.Expr(value=ast.Call(func=function, args=given, keywords=named)):
            target = _called(function)
            touches = target is not None and any(t in target.casefold() for t in STATE_CALLS)
            if target is None:
                row |= {"op": "call", "status": "unresolved", "reason": "dynamic_call_target"}
            elif touches:
                fixed = not named and all(_scalar(x)[0] for x in given)
                reason = "keyword_call_arguments_not_supported" if named else None if fixed else "computed_call_argument"
                row |= {"op": "call", "status": "possible" if fixed else "unresolved", "call_target": target, "reason": reason}
    return row


def _over(function):
    """A scalar function over a column of texts, applied batch by batch."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([function(x) for x in batch], columns=list(function(None)))

    return run


def requirements(df: DataFrame, expression: str) -> DataFrame:
    """``df`` with ``requirement``, a struct of ``REQUIREMENT``; a null expression is invalid."""
    return df.withColumn("requirement", F.pandas_udf(_over(requirement_of), REQUIREMENT)(F.col(expression)))


def effects(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``effect``, a struct of ``EFFECT``."""
    return df.withColumn("effect", F.pandas_udf(_over(effect_of), EFFECT)(F.col(text)))


def variable_registry(reads: DataFrame, writes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """reads(variable, id), writes(variable, id), names(variable, display) -> (variable, category, display_name, n_reads, n_writes, first_id).

    A display name given by a user stands before the one made from the variable's own.
    """
    rows = reads.select("variable", "id", F.lit(1).alias("r"), F.lit(0).alias("w")).unionByName(writes.select("variable", "id", F.lit(0).alias("r"), F.lit(1).alias("w")))
    found = rows.where("variable IS NOT NULL").groupBy("variable").agg(F.sum("r").alias("n_reads"), F.sum("w").alias("n_writes"), F.min("id").alias("first_id"))
    shown = T.display_name(F.col("variable"))
    if names is not None:
        found = found.join(names.select("variable", "display"), "variable", "left")
        shown = F.coalesce("display", shown)
    return found.select("variable", T.category(F.col("variable")).alias("category"), shown.alias("display_name"), "n_reads", "n_writes", "first_id")


def constraint_intersection(terms: DataFrame, group: str) -> DataFrame:
    """terms(group, variable, op, number) -> (group, variable, low, high, n_equal, satisfiable): what comparisons of one variable leave together.

    Bounds are inclusive of what ``>=`` and ``<=`` name; ``satisfiable`` is false where no number is left.
    """
    op, x = F.col("op"), F.col("number")
    found = terms.groupBy(group, "variable").agg(
        F.max(F.when(op.isin(">", ">=", "=="), x)).alias("low"),
        F.min(F.when(op.isin("<", "<=", "=="), x)).alias("high"),
        F.count_distinct(F.when(op == "==", x)).alias("n_equal"),
        F.max(F.when(op == ">", x)).alias("above"),
        F.min(F.when(op == "<", x)).alias("below"),
        F.array_sort(F.collect_set(F.when(op == "!=", x))).alias("but"),
    )
    empty = (
        (F.col("n_equal") > 1)
        | F.coalesce(F.col("low") > F.col("high"), F.lit(False))
        | F.coalesce((F.col("low") == F.col("high")) & ((F.col("above") == F.col("low")) | (F.col("below") == F.col("low"))), F.lit(False))
        | F.coalesce((F.col("low") == F.col("high")) & F.array_contains("but", F.col("low")), F.lit(False))
    )
    return found.select(group, "variable", "low", "high", "n_equal", (~F.coalesce(empty, F.lit(False))).alias("satisfiable"))


def running_values(effects_: DataFrame, group: str, order: str) -> DataFrame:
    """effects(group, order, variable, op, number, status) -> the rows with ``value_after``: assignments set, ``increment`` and ``decrement`` add up.

    Before the first assignment a variable counts from 0; an effect that is not proven clears it, null until the next assignment.
    """
    w = W.partitionBy(group, "variable").orderBy(order)
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    resets = (F.col("op") == "assignment") | (F.col("status") != "proven")
    marked = effects_.withColumn("_run", F.sum(resets.cast("int")).over(so_far))
    run = W.partitionBy(group, "variable", "_run").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    change = F.when(F.col("op") == "decrement", -F.col("number")).otherwise(F.col("number"))
    lost = F.max((F.col("status") != "proven").cast("int")).over(run) == 1
    return marked.withColumn("value_after", F.when(~lost, F.sum(change).over(run))).drop("_run")


def requirement_source(reads: DataFrame, writes: DataFrame, group: str, order: str) -> DataFrame:
    """Each read with the last write of its variable before it: (group, order, variable, source, written_at).

    source is ``effect`` where the write is proven, ``unknown`` where it is not, ``precondition`` where nothing was written before.
    """
    rows = reads.select(group, order, "variable", F.lit(1).alias("read"), F.lit(None).cast("string").alias("status")).unionByName(writes.select(group, order, "variable", F.lit(0).alias("read"), "status"))
    w = W.partitionBy(group, "variable").orderBy(order, "read").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("read") == 0, F.struct(F.col(order).alias("at"), "status")), ignorenulls=True).over(w)
    found = rows.withColumn("last", last).where("read = 1")
    source = F.when(F.col("last").isNull(), "precondition").when(F.col("last.status") == "proven", "effect").otherwise("unknown")
    return found.select(group, order, "variable", source.alias("source"), F.col("last.at").alias("written_at"))


def dispatch_splits(arms: DataFrame, writes: DataFrame) -> DataFrame:
    """arms(split, arm, variable, op, value), writes(variable, value) -> (split, variable) of splits that tell one variable's values apart.

    Every arm tests the same variable by ``==``, and writes of at least two values cover those tested.
    """
    tested = arms.groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("variable").alias("n_variables"), F.min("variable").alias("variable"), F.bool_and((F.col("op") == "==") & F.col("variable").isNotNull()).alias("equal"), F.collect_set("value").alias("tested")
    )
    known = writes.groupBy("variable").agg(F.collect_set("value").alias("written"))
    joined = tested.where("equal AND n_variables = 1 AND n >= 2").join(known, "variable")
    return joined.where((F.size("written") >= 2) & (F.size(F.array_except("tested", "written")) == 0)).select("split", "variable")


def truth(values: dict[str, object], expression: str) -> bool | None:
    """A condition over a part of the variables: true, false, or None where what is missing decides. Python's truth of numbers and texts holds."""
    try:
        node = ast.parse(expression.strip(), mode="eval").body
    except (SyntaxError, ValueError):
        return None
    return _truth(node, values)


def _value(node: ast.expr, values: dict) -> tuple[bool, object]:
    if isinstance(node, ast.Name):
        return node.id in values, values.get(node.id)
    return _scalar(node)


def _truth(node: ast.expr, values: dict) -> bool | None:
    match node:
        case ast.BoolOp(op=op):
            parts = [_truth(x, values) for x in node.values]
            decides = isinstance(op, ast.Or)
            return decides if decides in parts else None if None in parts else not decides
        case ast.UnaryOp(op=ast.Not()):
            inner = _truth(node.operand, values)
            return None if inner is None else not inner
        case ast.Compare():
            sides = [_value(x, values) for x in [node.left, *node.comparators]]
            result: bool | None = True
            for (known, a), op, (also, b) in zip(sides, node.ops, sides[1:], strict=False):
                sign = _COMPARES.get(type(op))
                if sign is None or not (known and also):
                    result = None
                    continue
                try:
                    holds = {"==": a == b, "!=": a != b}[sign] if sign in ("==", "!=") else {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]
                except TypeError:
                    return None
                if not holds:
                    return False
            return result
    known, value = _value(node, values)
    return bool(value) if known else None
