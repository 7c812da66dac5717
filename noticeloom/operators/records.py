"""A catalogue's whole record for each applicant and notice, made beside the applicant: no shuffle of combinations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions.arrays import inlined
from noticeloom.functions.text import unit_key
from noticeloom.operators.evaluation import QUESTIONS, in_scope
from noticeloom.operators.rules import BLOCK_NODES, Context, spread, with_results

GENERAL = r"^\s*일반(?:\s*공급)?\s*$"
SCOPE = ("supply_type", "unit_type", "unit_types")


def scoped(combinations: DataFrame, rules: DataFrame, ids: Column, closures: DataFrame | None) -> DataFrame:
    """A row for each notice: combos (pos, supply_type, unit_type, rules: places in ids) and closures (area, closed_units, all_closed)."""
    r = rules.select("notice_id", F.array_position(ids, F.col("rule_id")).cast("int").alias("place"), *[F.col(x).alias(f"r_{x}") for x in SCOPE])
    spoken = in_scope({x: F.col(f"r_{x}") for x in SCOPE}, F.col("unit_type"), F.col("supply_type"))
    rows = combinations.join(r, "notice_id", "left").withColumn("place", F.when(spoken, F.col("place")))
    combos = rows.groupBy("notice_id", "pos", "supply_type", "unit_type").agg(F.array_sort(F.collect_list("place")).alias("rules"))
    out = combos.groupBy("notice_id").agg(F.array_sort(F.collect_list(F.struct("pos", "supply_type", "unit_type", "rules"))).alias("combos"))
    if closures is None:
        return out.withColumn("closures", F.expr("cast(array() as array<struct<area:string,closed_units:array<string>,all_closed:boolean>>)"))
    own = closures.groupBy("notice_id").agg(F.collect_list(F.struct("area", "closed_units", "all_closed")).alias("closures"))
    return out.join(own, "notice_id", "left")


def records(
    applicants: DataFrame, keys: list[str], combinations: DataFrame, rules: DataFrame, rule_nodes: DataFrame, tests: dict[str, Callable], closures: DataFrame | None = None, context: Context = (), block_nodes: int = BLOCK_NODES,
) -> DataFrame:
    """keys x notices of combinations -> status, groups, shared_reasons, questions, n_open: what a screen of a notice shows.

    combinations (notice_id, pos, supply_type, unit_type), rules (notice_id, rule_id, supply_type, unit_type, unit_types),
    rule_nodes of these rules, tests and context: see rules.evaluate; closures (notice_id, area, closed_units, all_closed): what results
    have closed for applicants of an area (a column of applicants).
    groups: array<struct<supply_type, status, closed, reasons: array<struct<rule_id, result>>, units>>, general supply first, then in
    the inventory's order: combinations with the same supply, status and reasons are one. A combination that no rule speaks of is
    unpublished; general supply of a closed unit is a mismatch. status: possible if any is, mismatch if all are, else
    review; unpublished if all are. shared_reasons: those of two supplies or more. questions: array<struct<field, facts,
    n_combinations>>, the facts that open combinations wait for, those that most wait for first. n_open: how many these are.
    The catalogue goes to applicants as one array of about block_nodes nodes; a larger one takes further passes by notices.
    """
    blocks = max(1, -(-rule_nodes.count() // block_nodes))
    named = rules.select("rule_id", "notice_id")
    applicants, out = spread(applicants, keys), None
    for i in range(blocks):
        own = (lambda x: x) if blocks == 1 else (lambda x, i=i: x.filter(F.pmod(F.xxhash64("notice_id"), F.lit(blocks)) == i))
        nodes = rule_nodes if blocks == 1 else rule_nodes.join(own(named).select("rule_id"), "rule_id", "left_semi")
        got = _records(applicants, keys, own(combinations), own(rules), nodes, tests, None if closures is None else own(closures), context)
        out = got if out is None else out.unionByName(got)
    return out


def _records(applicants: DataFrame, keys: list[str], combinations: DataFrame, rules: DataFrame, rule_nodes: DataFrame, tests: dict[str, Callable], closures: DataFrame | None, context: Context) -> DataFrame:
    ids = rule_nodes.agg(F.array_sort(F.collect_set("rule_id"))).scalar()
    asked = rule_nodes.filter(F.col("kind").isin(*QUESTIONS)).groupBy("rule_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    asked = asked.select(F.struct(F.array_position(ids, F.col("rule_id")).cast("int").alias("place"), "kinds").alias("x")).agg(F.array_sort(F.collect_list("x"))).scalar()
    whole = scoped(combinations, rules, ids, closures).agg(F.array_sort(F.collect_list(F.struct("notice_id", "combos", "closures")))).scalar()
    rows = with_results(rule_nodes, applicants, tests, context).withColumns({"_asked": asked, "_notices": whole})
    rows = inlined(rows, [*keys, "_results", "_asked", *(["area"] if "area" in applicants.columns else [F.lit(None).cast("string").alias("area")])], "_notices")
    closed = F.get(F.filter(F.coalesce("closures", F.expr("cast(array() as array<struct<area:string,closed_units:array<string>,all_closed:boolean>>)")), lambda x: x["area"].eqNullSafe(F.col("area"))), F.lit(0))

    def judged(c: Column) -> Column:
        reasons = F.transform(c["rules"], lambda p: F.element_at("_results", p))
        said = lambda kind: F.exists(reasons, lambda r: r["result"] == kind)
        shut = c["supply_type"].rlike(GENERAL) & (F.coalesce(F.col("_closed.all_closed"), F.lit(False)) | F.coalesce(F.array_contains("_closed.closed_units", unit_key(c["unit_type"])), F.lit(False)))
        status = F.when(shut, "mismatch").when(F.size(reasons) == 0, "unpublished").when(said("fail"), "mismatch").when(said("review"), "review").otherwise("possible")
        return F.struct(c["pos"].alias("pos"), c["supply_type"].alias("supply_type"), c["unit_type"].alias("unit_type"), status.alias("status"), shut.alias("closed"), reasons.alias("reasons"), c["rules"].alias("rules"))

    rows = rows.withColumn("_closed", closed).withColumn("_combos", F.transform("combos", judged))
    key = lambda c: F.struct(c["supply_type"].alias("supply_type"), c["status"].alias("status"), c["closed"].alias("closed"), c["reasons"].alias("reasons"))
    rows = rows.withColumn("_keys", F.array_distinct(F.transform("_combos", key)))  # in the inventory's order

    def group(k: Column) -> Column:
        units = F.transform(F.filter("_combos", lambda c: key(c) == k), lambda c: c["unit_type"])
        return F.struct(*[k[x].alias(x) for x in ("supply_type", "status", "closed", "reasons")], units.alias("units"))

    general = lambda g: F.coalesce(g["supply_type"].rlike(GENERAL), F.lit(False))
    groups = F.transform("_keys", group)
    rows = rows.withColumn("_groups", groups).withColumn("groups", F.concat(F.filter("_groups", general), F.filter("_groups", lambda g: ~general(g))))
    holds = lambda status: F.exists("_combos", lambda c: c["status"] == status)
    every = lambda status: F.forall("_combos", lambda c: c["status"] == status)
    status = F.when(holds("possible"), "possible").when(every("mismatch"), "mismatch").when(every("unpublished"), "unpublished").otherwise("review")
    all_reasons = F.array_distinct(F.flatten(F.transform("_combos", lambda c: c["reasons"])))
    supplies = lambda r: F.size(F.array_distinct(F.transform(F.filter("_combos", lambda c: F.array_contains(c["reasons"], r)), lambda c: c["supply_type"])))
    shared = F.array_sort(F.filter(all_reasons, lambda r: supplies(r) > 1))
    return rows.select(
        *keys, "notice_id", status.alias("status"), "groups", shared.alias("shared_reasons"), _questions().alias("questions"),
        F.size(F.filter("_combos", lambda c: c["status"] == "review")).alias("n_open"),
    )


def _questions() -> Column:
    """What open combinations wait for: the fields that their rules under review ask, by how many combinations each could still change."""
    field = F.create_map(*[F.lit(x) for k, (f, _) in sorted(QUESTIONS.items()) for x in (k, f)])
    facts = F.create_map(*[F.lit(x) for f, g in sorted(set(QUESTIONS.values())) for x in (f, g)])
    waiting = lambda c: F.filter(c["rules"], lambda p: F.element_at("_results", p)["result"] == "review")
    kinds = lambda p: F.flatten(F.transform(F.filter("_asked", lambda a: a["place"] == p), lambda a: a["kinds"]))
    fields = lambda c: F.array_distinct(F.transform(F.flatten(F.transform(waiting(c), kinds)), lambda k: field[k]))
    each = F.flatten(F.transform(F.filter("_combos", lambda c: c["status"] == "review"), fields))
    count = lambda f: F.size(F.filter(each, lambda x: x == f))
    told = F.transform(F.array_distinct(each), lambda f: F.struct((-count(f)).alias("order"), f.alias("field"), facts[f].alias("facts")))
    return F.transform(F.array_sort(told), lambda x: F.struct(x["field"].alias("field"), x["facts"].alias("facts"), (-x["order"]).alias("n_combinations")))


def deciding(whole: DataFrame) -> DataFrame:
    """Rows of records -> field, facts, n_combinations, n_records, place: fields by how many open combinations wait for them."""
    rows = inlined(whole, [], "questions").groupBy("field", "facts").agg(F.sum("n_combinations").cast("long").alias("n_combinations"), F.count(F.lit(1)).alias("n_records"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_combinations"), "field")))  # a row for each field
