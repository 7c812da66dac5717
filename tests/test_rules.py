"""Three-valued rules against a plain evaluator."""

import json
import random

import pytest
from pyspark.sql import functions as F

from noticeloom.operators.rules import compare, evaluate, nodes


def judged(rule, x, up=None):
    """The same rule for one applicant with plain recursion: True, False or None."""
    up = up or {}
    seen = {**up, **{k: v for k, v in rule.items() if k in ("verification",)}}
    base = None
    if seen.get("verification") == "official" and rule.get("effect") not in ("priority", "metadata"):
        kind = rule["operator"] if rule["kind"] == "condition_group" else rule["kind"]
        values = [judged(c, x, seen) for c in rule.get("conditions", [])]
        if kind == "all":
            base = None if not values else False if False in values else None if None in values else True
        elif kind == "any":
            base = None if not values else True if True in values else None if None in values else False
        elif kind == "not":
            base = not values[0] if len(values) == 1 and values[0] is not None else None
        elif kind == "number" and x is not None:
            base = {">=": x >= rule["value"], "<": x < rule["value"]}.get(rule["operator"])
    other = [judged(c, x, seen) for c in rule.get("exceptions", [])]
    if True in other:
        return True
    return None if base is False and None in other else base


def invented(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return {"kind": rng.choice(["number", "number", "number", "unparsed"]), "operator": rng.choice([">=", "<", "~"]), "value": rng.randint(0, 5)}
    rule = {"kind": rng.choice(["all", "any", "not", "condition_group"]), "operator": rng.choice(["all", "any"]), "conditions": [invented(rng, depth - 1) for _ in range(rng.randint(0, 3))]}
    if rng.random() < 0.3:
        rule["exceptions"] = [invented(rng, depth - 1) for _ in range(rng.randint(1, 2))]
    if rng.random() < 0.1:
        rule["verification"] = "ai_unverified"
    return rule


def test_trees_against_plain_python(spark):
    rng = random.Random(1)
    rules = [{**invented(rng, 3), "verification": rng.choice(["official"] * 9 + ["unknown"])} for _ in range(80)]
    frame = spark.createDataFrame([(str(i), json.dumps(r)) for i, r in enumerate(rules)], "rule_id string, rule string")
    people = spark.createDataFrame([(i, None if i == 6 else float(i)) for i in range(7)], "id int, x double")
    got = evaluate(nodes(frame), people, ["id"], {"number": lambda r: compare(F.col("x"), r["operator"], r["value_number"])}).collect()
    assert len(got) == 80 * 7
    words = {True: "pass", False: "fail", None: "review"}
    for r in got:
        assert r.result == words[judged(rules[int(r.rule_id)], None if r.id == 6 else float(r.id))], rules[int(r.rule_id)]


def test_no_json_is_review_and_depth_is_bounded(spark):
    people = spark.createDataFrame([(1,)], "id int")
    bad = spark.createDataFrame([("a", "not json"), ("b", None)], "rule_id string, rule string")
    assert {r.result for r in evaluate(nodes(bad), people, ["id"], {}).collect()} == {"review"}
    deep = {"kind": "not", "conditions": []}
    for _ in range(9):
        deep = {"kind": "not", "conditions": [deep]}
    with pytest.raises(ValueError):
        nodes(spark.createDataFrame([("a", json.dumps(deep))], "rule_id string, rule string"))
