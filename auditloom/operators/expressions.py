"""Arithmetic of rules as data: text to postfix tokens once per rule, tokens to a number per document.

Both steps are array functions inside the JVM. Nothing of the rule table is collected, no column is built
from a rule's text, and the number of rules has no bound: an expression is a value of its row.

Grammar: numbers, names, ``+ - * /``, signs and parentheses. Anything else, unbalanced parentheses or a
missing operand has no postfix form (null). Division by zero and unknown names give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME = "[A-Za-z_][A-Za-z0-9_]*"
NUMBER = r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_TOKEN = f"{NUMBER}|{NAME}|[-+*/()]"
_FOLD = "struct<out:array<string>,ops:array<string>,operand:boolean,ok:boolean>"
#: Signs inside a postfix form.
MINUS, PLUS = "neg()", "pos()"


def _binds(op: Column) -> Column:
    """How strongly an operator binds; an open parenthesis stops everything."""
    return F.when(op == "(", -1).when(op.isin("+", "-"), 1).when(op.isin("*", "/"), 2).otherwise(3)


def _kept(ops: Column, least: Column) -> Column:
    """How many operators stay below when those that bind at least so strongly leave the top."""
    stops = F.transform(ops, lambda o, i: F.when(_binds(o) < least, i + 1).otherwise(0))
    return F.coalesce(F.array_max(stops), F.lit(0))


def postfix(text: Column) -> Column:
    """Tokens in postfix order, or null when the text is no arithmetic."""

    def state(out: Column, ops: Column, operand, ok: Column) -> Column:
        return F.struct(out.alias("out"), ops.alias("ops"), F.lit(operand).alias("operand"), ok.alias("ok")).cast(_FOLD)

    def popped(a: Column, keep: Column) -> Column:
        return F.concat(a["out"], F.reverse(F.slice(a["ops"], keep + 1, F.size(a["ops"]) - keep)))

    def step(a: Column, t: Column) -> Column:
        binary = _kept(a["ops"], _binds(t))
        opened = _kept(a["ops"], F.lit(0))
        sign = F.when(t == "-", MINUS).otherwise(PLUS)
        return (
            F.when(t == "(", state(a["out"], F.array_append(a["ops"], t), False, a["ok"] & ~a["operand"]))
            .when(t == ")", state(popped(a, opened), F.slice(a["ops"], 1, F.greatest(opened - 1, F.lit(0))), True, a["ok"] & a["operand"] & (opened > 0)))
            .when(t.isin("+", "-") & ~a["operand"], state(a["out"], F.array_append(a["ops"], sign), False, a["ok"]))
            .when(t.isin("+", "-", "*", "/"), state(popped(a, binary), F.array_append(F.slice(a["ops"], 1, binary), t), False, a["ok"] & a["operand"]))
            .otherwise(state(F.array_append(a["out"], t), a["ops"], True, a["ok"] & ~a["operand"]))
        )

    none = F.array().cast("array<string>")
    tokens = F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1))
    folded = F.aggregate(tokens, state(none, none, False, F.lit(True)), step, lambda a: F.when(
        a["ok"] & a["operand"] & ~F.array_contains(a["ops"], "("), F.concat(a["out"], F.reverse(a["ops"]))))
    return F.when(F.trim(F.regexp_replace(text, _TOKEN, "")) == "", folded)


def names_in(text: Column) -> Column:
    """Names mentioned anywhere in the text, once each, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({NAME})"), F.lit(1))))


def evaluate(tokens: Column | str, number_of: Callable[[Column], Column]) -> Column:
    """Value of a postfix form; ``number_of`` gives the number behind a name."""

    def operand(t: Column) -> Column:
        return F.when(t.rlike(f"^(?:{NUMBER})$"), t.try_cast("double")).otherwise(number_of(t))

    def step(stack: Column, t: Column) -> Column:
        n = F.size(stack)
        right, left = F.get(stack, n - 1), F.get(stack, n - 2)
        value = F.when(t == "+", left + right).when(t == "-", left - right).when(t == "*", left * right).otherwise(F.try_divide(left, right))
        return (
            F.when(t == PLUS, stack)
            .when(t == MINUS, F.array_append(F.slice(stack, 1, n - 1), -right))
            .when(t.isin("+", "-", "*", "/"), F.array_append(F.slice(stack, 1, n - 2), value))
            .otherwise(F.array_append(stack, operand(t)))
        )

    return F.aggregate(tokens, F.array().cast("array<double>"), step, lambda stack: F.get(stack, F.lit(0)))
