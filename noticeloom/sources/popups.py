"""Public result pages: competition rows with the checks that a change of the page must fail, and winning scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeloom.functions.text import compact, first_usable, integer, result_status, unit_key
from noticeloom.sources.feeds import AREA, column, lookup
from noticeloom.sources.html import html_table

# The page's table, the attributes of its rows, the classes of its cells, its areas, and the greatest score.
TABLE, ATTRIBUTES = "compitTbl", ("data-ty", "data-sem")
UNIT_CLASS, RESULT_CLASS, SCORE_CLASS = "cpHouseTy", "cpSubscrptRt", "cpResideSenm"
AREAS = {"해당지역": "local", "기타지역": "other", "기타경기": "other_gyeonggi"}
MOST_SCORE = 84
SCORE_KEY = ("unit_key", "residence_area", "house_no", "notice_no", "supply_type", "rank", "selection_path", "min_score", "max_score", "average_score")


def _has(row: Column, i: int, name: str) -> Column:
    classes = F.try_element_at(row["classes"], F.lit(i + 1))
    return F.coalesce((classes == name) | (classes.contains(name) & F.array_contains(F.split(classes, r"\s+"), name)), F.lit(False))


def _text(row: Column, i: int) -> Column:
    return F.coalesce(F.try_element_at(row["texts"], F.lit(i + 1)), F.lit(""))


def _attr(row: Column, name: str) -> Column:
    return F.coalesce(F.element_at(row["attrs"], ATTRIBUTES.index(name) + 1), F.lit(""))


def _rank(row: Column, text: Column) -> Column:
    """The rank that both the class and the text of the third cell tell."""
    return F.when(_has(row, 2, "cpRank1") & (compact(text) == "1순위"), 1).when(_has(row, 2, "cpRank2") & (compact(text) == "2순위"), 2)


def _read(row: Column) -> Column:
    """A row with what is told of its cells without white space, each read once; what is the same as written isn't read twice."""
    unit, named, label, area = _text(row, 0), _attr(row, "data-ty"), _text(row, 3), _attr(row, "data-sem")
    same_unit, same_area = (unit == named) | (unit_key(unit) == unit_key(named)), (label == area) | (compact(label) == compact(area))
    columns = (F.size(row["texts"]) >= 7) & _has(row, 0, UNIT_CLASS) & _has(row, 6, RESULT_CLASS)
    return F.struct(
        F.size(row["texts"]).alias("size"), columns.alias("columns"), ((unit_key(unit) != "") & same_unit).alias("unit"), same_area.alias("area"), compact(label).alias("label"),
        _rank(row, _text(row, 2)).alias("rank"), _has(row, 7, SCORE_CLASS).alias("scored"), row["texts"].alias("texts"),
    )


def _problem(row: Column) -> Column:
    """Why a row isn't what it was when this was written: its columns, unit, area or rank."""
    return (
        F.when(~row["columns"], "columns").when(~row["unit"], "unit").when(~row["area"], "area").when(row["rank"].isNull(), "rank")
    )


def _area(label: Column) -> Column:
    return F.coalesce(lookup(AREAS, label), F.lit("unknown"))


def _result(row: Column) -> Column:
    return F.struct(
        _text(row, 0).alias("unit_type"), row["rank"].alias("rank"), _area(row["label"]).alias("residence_area"), _text(row, 3).alias("residence_area_label"), F.lit("general").alias("supply_type"),
        integer(_text(row, 1)).alias("supply_count"), integer(_text(row, 4)).alias("application_count"), F.coalesce(F.nullif(_text(row, 5), F.lit("")), F.lit("-")).alias("competition_rate"),
        result_status(_text(row, 6)).alias("result_status"), F.nullif(_text(row, 6), F.lit("")).alias("result_text"),
    )


def _number(text: Column) -> Column:
    value = F.when(F.trim(text).rlike(r"^\d+(?:\.\d+)?$"), F.trim(text).try_cast("double"))
    return F.when(value <= MOST_SCORE, value)


def _score(row: Column) -> Column:
    """The winning score of a first-rank row of eleven cells whose two areas agree, lowest <= average <= highest; else null."""
    numbers = F.transform(F.slice(row["texts"], 9, 3), _number)
    sound = (row["size"] == 11) & _problem(row).isNull() & (row["rank"] == 1) & (_area(row["label"]) != "unknown") & row["scored"]
    sound = sound & (compact(_text(row, 7)) == row["label"])
    score = lambda n: F.when((n[0] <= n[2]) & (n[2] <= n[1]), F.struct(_text(row, 0).alias("unit_type"), _area(row["label"]).alias("residence_area"), n[0].alias("min_score"), n[1].alias("max_score"), n[2].alias("average_score")))
    return F.when(sound, F.element_at(F.transform(F.array(numbers), score), 1))


def popups(pages: DataFrame) -> DataFrame:
    """pages (..., html) -> with error, results, scores: what the result table says.

    Rows without a data-ty attribute are headers and samples. A page without the whole table, or with a row that fails
    a check, has an error and no results; scores are read row by row and independent of it. html is dropped.
    """
    rows = pages.withColumn("_table", html_table(F.col("html"), TABLE, *ATTRIBUTES))
    whole = F.coalesce(F.col("_table.closed"), F.lit(False))
    real = F.transform(F.filter("_table.rows", lambda r: _attr(r, "data-ty") != ""), _read)
    rows = rows.withColumn("_rows", F.when(whole, real))
    problem = F.try_element_at(F.array_compact(F.transform("_rows", _problem)), F.lit(1))
    rows = rows.withColumn("error", F.when(~whole, "table").otherwise(problem))
    rows = rows.withColumn("results", F.when(F.col("error").isNull(), F.transform("_rows", _result))).withColumn("scores", F.array_compact(F.transform("_rows", _score)))
    return rows.drop("_table", "_rows", "html")


def complete(results: Column, expected: Column) -> Column:
    """Whether results hold exactly the expected units, none empty, each with a local and another area of the first rank."""
    units = lambda rows: F.array_distinct(F.transform(rows, lambda r: unit_key(r["unit_type"])))
    first = lambda *areas: units(F.filter(results, lambda r: (r["rank"] == 1) & r["residence_area"].isin(*areas)))
    keys, wanted = units(results), F.array_distinct(F.filter(F.transform(expected, unit_key), lambda u: u != ""))
    both = (F.size(F.array_except(keys, first("local"))) == 0) & (F.size(F.array_except(keys, first("other", "other_gyeonggi"))) == 0)
    return F.coalesce((F.size(wanted) > 0) & (F.array_sort(keys) == F.array_sort(wanted)) & both, F.lit(False))


def identified(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """Rows of a results API with the page they came for (page_id), requested (page_id, house_no, notice_no) -> with misplaced.

    misplaced: another notice's row, or one of no requested page; a caller fails the whole page for one of them.
    """
    out = rows.join(requested.select("page_id", F.col("house_no").alias("_house"), F.col("notice_no").alias("_notice")), "page_id", "left")
    same = F.col("house_no").eqNullSafe(F.col("_house")) & F.col("notice_no").eqNullSafe(F.col("_notice")) & F.col("_house").isNotNull()
    return out.withColumn("misplaced", ~same).drop("_house", "_notice")


def with_model_numbers(results: DataFrame, api: DataFrame) -> DataFrame:
    """results (notice_id, unit_type, rank, residence_area, ...), api (the same, model_no, pos) -> results with model_no.

    The last API row of a notice's unit, rank and area gives the number.
    """
    keys = ["notice_id", "_unit", "rank", "residence_area"]
    numbers = api.withColumn("_unit", unit_key(F.col("unit_type"))).groupBy(*keys).agg(F.max_by(F.struct("model_no"), "pos")["model_no"].alias("model_no"))
    return results.withColumn("_unit", unit_key(F.col("unit_type"))).join(numbers, keys, "left").drop("_unit")


def api_scores(rows: DataFrame) -> DataFrame:
    """Rows of the scores API -> house_no, notice_no, unit_type, residence_area, min_score, max_score, average_score; unsound ones are left out."""
    c = lambda n: column(rows, n)
    low, high, mean = (_number(c(n)) for n in ("LWET_SCORE", "TOP_SCORE", "AVRG_SCORE"))
    out = rows.select(
        c("HOUSE_MANAGE_NO").alias("house_no"), c("PBLANC_NO").alias("notice_no"), first_usable(c("HOUSE_TY")).alias("unit_type"), lookup(AREA, F.lpad(c("RESIDE_SECD"), 2, "0")).alias("residence_area"),
        low.alias("min_score"), high.alias("max_score"), mean.alias("average_score"),
    )
    return out.filter("unit_type IS NOT NULL AND residence_area IS NOT NULL AND min_score <= average_score AND average_score <= max_score")


def merged_scores(api: DataFrame, popup: DataFrame) -> DataFrame:
    """Score rows of both sources, one of each SCORE_KEY, the API's first, with `origin`; values that conflict both stay.

    Rows: house_no, notice_no, unit_type, residence_area, min_score, max_score, average_score.
    """
    both = api.withColumn("origin", F.lit("api")).unionByName(popup.withColumn("origin", F.lit("popup")))
    both = both.withColumns({"unit_key": unit_key(F.col("unit_type")), "supply_type": F.lit("일반공급"), "rank": F.lit(1), "selection_path": F.lit("points")})
    first = Window.partitionBy(*SCORE_KEY).orderBy("origin", "unit_type")
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "unit_key")


def score_status(api_ok: Column, n_api: Column, n_popup: Column, popup_ok: Column) -> Column:
    """success: the API or, where it wasn't asked (api_ok null), the page has scores; fallback: the page has them, the API failed;
    unpublished: none; error: none, and what was asked failed."""
    return (
        F.when(F.coalesce(n_api, F.lit(0)) > 0, "success").when((n_popup > 0) & ~F.coalesce(api_ok, F.lit(True)), "fallback").when(n_popup > 0, "success")
        .when(~popup_ok & ~F.coalesce(api_ok, F.lit(False)), "error").otherwise("unpublished")
    )


def with_winning_scores(rules: Column, rows: Column, status: Column, criterion_date: Column) -> Column:
    """array<string> of JSON rules with the notice's winning scores replaced by rows (array of structs).

    Where the status is error the rows known before stay, marked with it.
    """
    kind = lambda r: F.get_json_object(r, "$.kind")
    kept = F.filter(rules, lambda r: ~F.coalesce(kind(r) == "winning_scores", F.lit(False)))
    before = F.filter(rules, lambda r: kind(r) == "winning_scores")
    old = F.get_json_object(F.try_element_at(before, F.lit(1)), "$.rows")
    given = F.when(status == "error", F.coalesce(old, F.lit("[]"))).otherwise(F.to_json(F.coalesce(rows, F.array())))
    head = F.to_json(F.struct(F.lit("winning_scores").alias("kind"), F.lit("metadata").alias("effect"), F.lit("official").alias("verification"), status.alias("status"), criterion_date.cast("string").alias("criterion_date")))
    return F.concat(kept, F.array(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"rows":'), given, F.lit("}"))))
