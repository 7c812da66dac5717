"""Nested three-valued rules: flattened to nodes once, judged beside each applicant, folded from the leaves up.

pass, fail and review are true, false and null. An empty group, an unknown kind, an unverified rule and a missing
input are null, never true.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.arrays import inlined
from noticeloom.session import ensure_checkpoint_dir


MAX_DEPTH = 8
BLOCK_NODES = 5_000
TASKS_PER_CORE = 4
GROUPS = ("all", "any", "not", "condition_group")
# What a condition takes from its parent where it has none of its own.
INHERITED = (
    "verification", "source", "supply_type", "unit_type", "housing_kind", "criterion_date", "criterion_basis", "document_hash", "parser_version", "evidence_url",
)
FIELDS = ("kind", "effect", "operator", "value", *INHERITED)
Context = Sequence[tuple[tuple[str, ...], Callable[[Column], tuple[Column, ...]]]]


def nodes(rules: DataFrame) -> DataFrame:
    """rules (rule_id, rule: JSON) -> a row for each node: rule_id, path, parent, role, depth, the fields, value_number, value_text, own_verification.

    role: root, condition or exception. path extends the parent's, so that a node is known in all levels. Rules that
    are not JSON give a root whose fields are null. More than MAX_DEPTH levels raise. Each level is a checkpoint, so that
    plans stay short.
    """
    field = lambda name: F.try_variant_get("v", f"$.{name}", "string").alias(name)
    level = rules.select("rule_id", F.lit("0").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit("root").alias("role"), F.col("rule").alias("raw"), *[F.lit(None).cast("string").alias(f"up_{x}") for x in INHERITED])
    ensure_checkpoint_dir(rules.sparkSession)
    out, depth = None, 0
    while out is None or not level.isEmpty():
        if depth > MAX_DEPTH:
            raise ValueError(f"rules are nested more than {MAX_DEPTH} levels deep")
        rows = level.withColumn("v", F.try_parse_json("raw"))
        own = [F.coalesce(field(x), f"up_{x}").alias(x) for x in INHERITED]
        rows = rows.select("rule_id", "path", "parent", "role", "v", *[field(x) for x in FIELDS if x not in INHERITED], field("verification").alias("own_verification"), *own)
        done = rows.select("rule_id", "path", "parent", "role", F.lit(depth).alias("depth"), *FIELDS, F.col("value").try_cast("double").alias("value_number"), F.col("value").alias("value_text"), "own_verification")
        out, depth = done if out is None else out.unionByName(done), depth + 1
        listed = [_children("condition", "conditions"), _children("exception", "exceptions")]
        level = rows.select("rule_id", F.col("path").alias("parent"), *[F.col(x).alias(f"up_{x}") for x in INHERITED], F.explode(F.concat(*listed)).alias("c"))
        step = F.concat(F.substring("c.role", 1, 1), F.lpad(F.col("c.n").cast("string"), 4, "0"))
        level = level.select("rule_id", F.concat_ws(".", "parent", step).alias("path"), "parent", "c.role", "c.raw", *[f"up_{x}" for x in INHERITED]).checkpoint()
    return out


def with_nodes(rules: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rules (rule: JSON, ...) -> with nodes: array<struct<v, depth, excepted, filled, own_verification, fields>>, the root first.

    The nodes of `nodes`, made within the rule's row: nothing is shuffled or written, so that many rules are read in one
    pass. excepted: it or one above it is an exception; filled: it has conditions. More than MAX_DEPTH levels raise.
    """
    def node(v: Column, up: Column | None, depth: int, excepted: Column) -> Column:
        told = {x: F.try_variant_get(v, f"$.{x}", "string") for x in (*fields, "verification")}
        own = [(F.coalesce(told[x], up[x]) if up is not None and x in INHERITED else told[x]).alias(x) for x in fields]
        return F.struct(v.alias("v"), F.lit(depth).alias("depth"), excepted.alias("excepted"), (F.size(listed(v, "conditions")) > 0).alias("filled"), told["verification"].alias("own_verification"), *own)

    def listed(v: Column, key: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.expr("cast(array() as array<variant>)"))

    def read(x: Column) -> Column:  # a text stands for the JSON that it holds
        text = F.try_variant_get(x, "$.kind", "string").isNull() & F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))
        return F.when(text, F.try_parse_json(F.try_variant_get(x, "$", "string"))).otherwise(x)

    def below(depth: int) -> Callable[[Column], Column]:
        nodes_of = lambda n, key, excepted: F.transform(F.transform(listed(n["v"], key), read), lambda v: node(v, n, depth, excepted))
        return lambda n: F.concat(nodes_of(n, "conditions", n["excepted"]), nodes_of(n, "exceptions", F.lit(True)))

    # Levels are columns of their own, so that each is made once.
    rows = rules.withColumn("_v", F.try_parse_json("rule")).withColumn("_level0", F.array(node(F.col("_v"), None, 0, F.lit(False))))
    for depth in range(1, MAX_DEPTH + 1):
        rows = rows.withColumn(f"_level{depth}", F.flatten(F.transform(f"_level{depth - 1}", below(depth))))
    levels = [f"_level{i}" for i in range(MAX_DEPTH + 1)]
    deeper = F.exists(levels[-1], lambda n: n["filled"] | (F.size(listed(n["v"], "exceptions")) > 0))
    error = F.raise_error(F.lit(f"rules are nested more than {MAX_DEPTH} levels deep"))
    return rows.withColumn("nodes", F.when(deeper, error).otherwise(F.concat(*levels))).drop("_v", *levels)


def _children(role: str, key: str) -> Column:
    """The raw JSON of a node's conditions or exceptions, in order, as array<struct<role, n, raw>>."""
    raw = F.from_json(F.to_json(F.try_variant_get("v", f"$.{key}", "variant")), "array<string>")
    own = F.transform(raw, lambda x, n: F.struct(F.lit(role).alias("role"), n.alias("n"), x.alias("raw")))
    return F.coalesce(own, F.expr("cast(array() as array<struct<role:string,n:int,raw:string>>)"))


def compare(value: Column, operator: Column, limit: Column) -> Column:
    """value operator limit; unknown operators and missing inputs are null."""
    return F.when(operator == ">=", value >= limit).when(operator == ">", value > limit).when(operator == "<=", value <= limit).when(operator == "<", value < limit).when(operator.isin("=", "=="), value == limit)


def evaluate(rule_nodes: DataFrame, applicants: DataFrame, keys: list[str], leaves: dict[str, Callable], context: Context = ()) -> DataFrame:
    """keys x rules -> result: pass, fail or review.

    leaves: for each kind a function of the rule's fields (by name) and of applicants' columns to a boolean column. context: what
    leaves find in a rule besides its fields, step by step: names, and a function of a node to their columns. Every
    applicant meets every rule: rules go to applicants as an array of at most about BLOCK_NODES nodes, and more rules
    take further passes over applicants.
    """
    blocks = max(1, -(-rule_nodes.count() // BLOCK_NODES))
    applicants, out = spread(applicants, keys), None
    for i in range(blocks):
        part = rule_nodes if blocks == 1 else rule_nodes.filter(F.pmod(F.xxhash64("rule_id"), F.lit(blocks)) == i)
        got = inlined(with_results(part, applicants, leaves, context), keys, "_results")
        out = got if out is None else out.unionByName(got)
    return out


def spread(applicants: DataFrame, keys: list[str]) -> DataFrame:
    """applicants dealt to all cores by keys: a small file of them is one task's, and each takes long to judge."""
    spark = applicants.sparkSession
    return applicants.repartition(max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def with_results(rule_nodes: DataFrame, applicants: DataFrame, leaves: dict[str, Callable], context: Context = ()) -> DataFrame:
    """applicants with _results: array<struct<rule_id, result>>, by rule_id.

    The rules' nodes stand in one array beside each applicant, are judged and folded there; rules whose nodes are all the same are
    judged once. judge_day of rule_nodes, where it has that column, is the day on which a node is judged: see timeline.
    """
    names = (*FIELDS, "value_number", "value_text", *(["judge_day"] if "judge_day" in rule_nodes.columns else []))
    node = F.struct((-F.col("depth")).alias("order"), "path", F.coalesce("parent", F.lit("")).alias("parent"), "role", *names)
    per_rule = rule_nodes.groupBy("rule_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    alike = per_rule.groupBy("nodes").agg(F.collect_list("rule_id").alias("rule_ids"))
    alike = alike.agg(F.array_sort(F.collect_list(F.struct("nodes", "rule_ids"))).alias("t"))
    named = F.flatten(F.transform("t", lambda x, i: F.transform(x["rule_ids"], lambda r: F.struct(r.alias("rule_id"), (i + 1).alias("tree")))))
    whole = alike.select(F.struct(F.transform("t", lambda x: x["nodes"]).alias("trees"), F.array_sort(named).alias("rules"))).scalar()

    told_first = [x for own, _ in context for x in own]

    def with_more(have: tuple[str, ...], own: tuple[str, ...], step: Callable) -> Callable:
        return lambda n: F.struct(*[n[x].alias(x) for x in have], *[c.alias(x) for x, c in zip(own, step(n), strict=True)])

    def prepared(tree: Column) -> Column:
        have = ("path", "parent", "role", *names)
        for own, step in context:
            tree, have = F.transform(tree, with_more(have, own, step)), (*have, *own)
        return tree

    def judged(n: Column) -> Column:
        rule, value = {x: n[x] for x in (*names, *told_first)}, F.lit(None).cast("boolean")
        for kind, test in leaves.items():
            value = F.when(rule["kind"] == kind, test(rule)).otherwise(value)
        usable = (rule["verification"] == "official") & ~F.coalesce(rule["effect"].isin("priority", "metadata"), F.lit(False))
        return F.struct(*[n[x].alias(x) for x in ("path", "parent", "role", "kind", "operator")], value.alias("value"), usable.alias("usable"))

    def result(tree: Column) -> Column:
        root = F.element_at(_folded(F.transform(prepared(tree), judged)), "")
        told = lambda c: F.when(c["yes"] > 0, "pass").when(c["no"] > 0, "fail").otherwise("review")
        return F.transform(F.array(root), told)[0]

    def named(told: Column) -> Column:
        return F.transform("_rules.rules", lambda r: F.struct(r["rule_id"].alias("rule_id"), F.element_at(told, r["tree"]).alias("result")))

    # An array of one, so that trees are judged once and not for each rule.
    told = F.array(F.transform("_rules.trees", result))
    return applicants.withColumn("_rules", whole).withColumn("_results", F.transform(told, named)[0]).drop("_rules")


COUNTS = ("yes", "no", "open", "excused", "unsure")


def _folded(tree: Column) -> Column:
    """For each path how many conditions below it hold, fail and are open, and how many exceptions hold or are open.

    The tree lists the deepest nodes first, so a node's counts are complete when it is reached.
    """
    zero = F.struct(*[F.lit(0).alias(x) for x in COUNTS])

    def value(n: Column, c: Column) -> Column:
        mode = F.when(n["kind"] == "condition_group", n["operator"]).otherwise(n["kind"])
        size = c["yes"] + c["no"] + c["open"]
        group = (
            F.when(size == 0, None).when(mode == "all", F.when(c["no"] > 0, False).when(c["open"] == 0, True))
            .when(mode == "any", F.when(c["yes"] > 0, True).when(c["open"] == 0, False)).when((mode == "not") & (size == 1) & (c["open"] == 0), c["no"] == 1)
        )
        base = F.when(n["usable"], F.when(n["kind"].isin(*GROUPS), group).otherwise(n["value"]))
        return F.when(c["excused"] > 0, True).when(F.coalesce(~base, F.lit(False)) & (c["unsure"] > 0), None).otherwise(base)

    def step(acc: Column, n: Column) -> Column:
        own = F.coalesce(F.element_at(acc, n["path"]), zero)
        up = F.coalesce(F.element_at(acc, n["parent"]), zero)

        def counted(v: Column) -> Column:
            is_exception = n["role"] == "exception"
            hits = {"yes": ~is_exception & v, "no": ~is_exception & ~v, "open": ~is_exception & v.isNull(), "excused": is_exception & v, "unsure": is_exception & v.isNull()}
            return F.struct(*[(up[x] + F.when(hits[x], 1).otherwise(0)).alias(x) for x in COUNTS])

        new = F.element_at(F.transform(F.array(value(n, own)), counted), 1)
        return F.map_concat(F.map_filter(acc, lambda k, _: k != n["parent"]), F.map_from_arrays(F.array(n["parent"]), F.array(new)))

    kind = ",".join(f"{x}:int" for x in COUNTS)
    return F.aggregate(tree, F.expr(f"cast(map() as map<string,struct<{kind}>>)"), step)
