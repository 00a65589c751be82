import ast
import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import expressions
from auditloom.operators import rules as R

RULE_SCHEMA = ("rule_id string, invoice_type_id string, rule_name string, field_id string, check_type string, check_value string, "
               "severity string, error_message string, rule_order int")
FIELD_SCHEMA = "doc_id int, field_id string, field_name string, value_text string, source_page int"


def verdict(spark, values, check, value, field="target", severity="error", required=True):
    docs = spark.createDataFrame([(1, "T")], "doc_id int, invoice_type_id string")
    facts = spark.createDataFrame([(1, f"ID_{n}", n, v, 1) for n, v in values.items()], FIELD_SCHEMA)
    rules = spark.createDataFrame([("R1", "T", "rule", field, check, value, severity, "bad", 1)], RULE_SCHEMA)
    fields = spark.createDataFrame([(f"ID_{field}", required), (field, required)], "field_id string, required boolean")
    return R.evaluate_rules(docs, facts, rules, fields).first()


@pytest.mark.parametrize("values,check,value,required,want", [
    ({"target": None}, "required", "", True, "failed"), ({"target": "0"}, "required", "", True, "passed"),
    ({"target": "null"}, "required", "", True, "failed"), ({"target": "AB1"}, "regex", "AB", True, "passed"),
    ({"target": "xAB"}, "regex", "AB", True, "failed"), ({"target": None}, "regex", "AB", False, "skipped"),
    ({"target": "<span>50</span>"}, "range", "0,100", False, "passed"), ({"target": "%%%"}, "range", "0,100", False, "skipped"),
    ({"target": "%%%"}, "range", "0,100", True, "failed"), ({"target": None}, "range", "0,100", False, "skipped"),
    ({"target": "5"}, "range", "low,high", True, "failed"), ({"target": "5"}, "range", "low,high", False, "skipped"),
    ({"target": "21"}, "enum", "4,10,21,0", False, "passed"), ({"target": "21.0"}, "enum", "4,10,21", False, "failed"),
    ({"target": " eur "}, "enum", "EUR, USD", True, "passed"), ({"target": "250", "days": "10", "rate": "25"}, "cross_field", "days * rate", True, "passed"),
    ({"target": "2,50", "days": "10", "rate": "25"}, "cross_field", "days * rate", True, "passed"),
    ({"target": "100.02", "a": "60", "b": "40"}, "cross_field", "a + b", True, "passed"), ({"target": "100.03", "a": "60", "b": "40"}, "cross_field", "a + b", True, "failed"),
    ({"target": "1", "a": "60"}, "cross_field", "a + b", True, "skipped"), ({"target": "1", "a": "6", "b": "0"}, "cross_field", "a / b", True, "skipped"),
    ({"target": "1", "a": "6"}, "cross_field", "__import__('os').system('x') + a", True, "skipped"), ({"target": "-6", "a": "6"}, "cross_field", "-(a)", True, "passed"),
    ({"flag": "True", "vat": "0"}, "conditional_check", "if flag=true then vat=0", True, "passed"),
    ({"flag": "true", "vat": "5"}, "conditional_check", "if flag=true then vat=0", True, "failed"),
    ({"flag": "no", "vat": "5"}, "conditional_check", "if flag=true then vat=0", True, "skipped"),
    ({"flag": "true", "vat": ""}, "conditional_check", "if flag=true then vat=null", True, "passed"),
    ({"flag": "true"}, "conditional_check", "nonsense", True, "skipped"), ({"other": "x"}, "required_one_of", "ID_other, z", True, "passed"),
    ({"other": ""}, "required_one_of", "ID_other", True, "failed"), ({"target": "x"}, "visual_check", "", True, "skipped"), ({"target": "x"}, "new_kind", "", True, "skipped"),
])
def test_checks(spark, values, check, value, required, want):
    assert verdict(spark, values, check, value, required=required).status == want


@pytest.mark.parametrize("text,number,check,value,want", [
    ("0,00", 0.0, "conditional_check", "if flag=true then target=0", "passed"), ("0,00", None, "conditional_check", "if flag=true then target=0", "failed"),
    ("0.0", 0.0, "conditional_check", "if flag=true then target=null", "passed"), ("5,00", 5.0, "conditional_check", "if flag=true then target=5.0", "passed"),
    ("21", 21.0, "enum", "4,10,21", "failed"), ("21,00", 21.0, "enum", "4, 21.0", "passed"), ("1.234,56", 1234.56, "regex", "1234[.]56$", "passed"),
    ("x", 50.0, "range", "0,100", "passed"), ("x", 3.0, "cross_field", "one + one + one", "passed"), ("x", 0.03, "cross_field", "one * rate_a", "passed"),
])
def test_typed_decimals_are_compared_as_numbers(spark, text, number, check, value, want):
    docs = spark.createDataFrame([(1, "T"), (2, "T")], "doc_id int, invoice_type_id string")
    rows = [(1, "ID_target", "target", text, 1, number), (1, "ID_flag", "flag", "True", 1, None), (1, "ID_one", "one", "1", 1, None), (1, "ID_rate", "rate_a", "3", 1, None)]
    facts = spark.createDataFrame(rows, FIELD_SCHEMA + ", value_num double")
    rules = spark.createDataFrame([("R1", "T", "rule", "ID_target", check, value, "error", "bad", 1)], RULE_SCHEMA)
    out = {r["doc_id"]: r["status"] for r in R.evaluate_rules(docs, facts, rules).collect()}
    assert out[1] == want and len(out) == 2


def test_building_the_plan_runs_no_job(spark):
    docs = spark.createDataFrame([(1, "T")], "doc_id int, invoice_type_id string")
    facts = spark.createDataFrame([(1, "a", "a", "1", 1)], FIELD_SCHEMA)
    rules = spark.range(60_000).selectExpr("concat('R', id) rule_id", "'T' invoice_type_id", "'n' rule_name", "'a' field_id", "'cross_field' check_type",
                                           "concat('a + ', id) check_value", "'error' severity", "'' error_message", "cast(id as int) rule_order")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    out = R.evaluate_rules(docs, facts, rules)
    assert tracker.getJobIdsForGroup("plan") == []
    spark.sparkContext.setJobGroup("run", "run")
    assert out.where("status = 'passed'").count() == 1 and out.count() == 60_000


def test_expressions_against_a_parser(spark):
    """Random arithmetic and texts that are none, against Python's own grammar."""
    rnd, names = random.Random(4), {"a": 6.0, "b": -3.5, "c_1": 0.1, "zero": 0.0}

    def text(depth):
        if depth == 0 or rnd.random() < 0.3:
            return rnd.choice(["a", "b", "c_1", "2", "0.5", ".25", "1e2", "zero", "gone"])
        kind = rnd.random()
        if kind < 0.4:
            return rnd.choice("+-") + text(depth - 1) if kind < 0.2 else f"({text(depth - 1)})"
        return text(depth - 1) + rnd.choice(["+", " - ", "*", " / "]) + text(depth - 1)

    def value(node):
        if isinstance(node, ast.BinOp):
            left, right = value(node.left), value(node.right)
            if left is None or right is None:
                return None
            kind = type(node.op)
            if kind is ast.Div:
                return None if right == 0 else left / right
            return {ast.Add: left + right, ast.Sub: left - right, ast.Mult: left * right}[kind]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            inner = value(node.operand)
            return inner if inner is None or isinstance(node.op, ast.UAdd) else -inner
        if isinstance(node, ast.Name):
            return names.get(node.id)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return float(node.value)
        raise KeyError

    texts = [text(4) for _ in range(250)] + ["a.b", "f(1)", "a ** 2", "a // b", "(a", "a)", "", "  ", "a b", "1 2", "-", "a+", "()", "a()", "a;b", "a % b", "x=1", "2*-a", "--a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", expressions.postfix(F.col("t"))).withColumn(
        "v", expressions.evaluate("p", lambda n: F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), n))).collect()
    for r in rows:
        try:
            want = True, value(ast.parse(r["t"].strip(), mode="eval").body)
        except (SyntaxError, KeyError):
            want = False, None
        assert (r["p"] is not None, r["v"]) == want, r["t"]
