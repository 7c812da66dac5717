"""Tables of documents: deposits by area and region, allocation bands, supplies with their sums."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions.text import canonical_unit, integer
from noticeloom.operators.dealing import dealt

# The areas of the deposit table, and the columns that a supply table may have before its total.
DEPOSIT_AREAS = ("85", "102", "135")
SUPPLY_COLUMNS = ("기관추천", "다자녀", "신혼부부", "노부모", "생애최초", "신생아", "일반")


def deposit_table(lines: DataFrame, keys: list[str], of: DataFrame | None = None) -> DataFrame:
    """lines (keys, page, line, text) -> keys, tiers: array<struct<max_area, amounts>> of a table with rows up to 85, 102 and 135 and for all
    areas, each with the same number of amounts; documents without exactly these rows have no row here. of: the documents, see dealt."""
    number = r"([\d,]+)\s*만\s*원?"
    area = F.when(F.col("text").rlike(r"모든\s*면적"), "0").otherwise(F.regexp_extract("text", r"(\d{2,3})\s*㎡\s*이하", 1))
    rows = lines.select(*keys, "page", "line", area.alias("area"), F.regexp_extract_all("text", F.lit(number), F.lit(1)).alias("said")).filter("area != '' AND size(said) > 0")
    wanted = ("0", *DEPOSIT_AREAS)
    first = [F.min_by("said", F.when(F.col("area") == x, F.struct("page", "line"))).alias(f"_{x}") for x in wanted]
    # Lines are dealt as narrow rows and grouped once; amounts are read of the four that count.
    found = dealt(rows, *keys, of=lines if of is None else of).groupBy(*keys).agg(*first, F.bool_and(F.col("area").isin(*wanted)).alias("_sole"))
    same = [F.col(f"_{x}").isNotNull() & (F.size(f"_{x}") == F.size(f"_{wanted[0]}")) for x in wanted]
    tier = lambda x: F.struct(F.lit(int(x) or None).cast("int").alias("max_area"), F.transform(f"_{x}", lambda n: integer(n) * 10_000).alias("amounts"))
    return found.filter(F.col("_sole") & reduce(and_, same)).select(*keys, F.array_sort(F.array(*map(tier, wanted))).alias("tiers"))


def allocation_bands(lines: DataFrame, keys: list[str], of: DataFrame | None = None) -> DataFrame:
    """keys, low, high, points, lottery of lines such as '60㎡ 초과 85㎡ 이하 가점 40% 추첨 60%' whose two shares make 100. of: the documents."""
    get = lambda pattern: F.regexp_extract("text", pattern, 1).try_cast("int")
    shares = lines.filter(F.col("text").rlike(r"가점[^\d]{0,6}\d{1,3}\s*%"))  # most lines tell none, and are looked at once
    rows = shares.select(*keys, F.coalesce(get(r"(\d{2,3})\s*㎡\s*초과"), F.lit(0)).alias("low"), get(r"(\d{2,3})\s*㎡\s*이하").alias("high"), get(r"가점[^\d]{0,6}(\d{1,3})\s*%").alias("points"), get(r"추첨[^\d]{0,6}(\d{1,3})\s*%").alias("lottery"))
    return dealt(rows.filter("points + lottery = 100 AND (low > 0 OR high IS NOT NULL)"), *keys, of=lines if of is None else of).distinct()


def supplies(rows: DataFrame, keys: list[str], names: tuple[str, ...] = SUPPLY_COLUMNS) -> DataFrame:
    """rows (keys, unit, counts: array<string>, parts in the order of names and then the total) -> keys, unit_type, supply_type, supply_count.

    A table counts only if every row's parts make its total; one row that doesn't, or that can't be read, retires the
    table. Rows with the same unit: the last count stands in the first row's place, so a unit appears once.
    """
    values = F.transform(F.slice("counts", 1, len(names) + 1), lambda x: integer(F.when(F.trim(x).isin("-", ""), "0").otherwise(x)))
    rows = dealt(rows, *keys).withColumn("unit_type", canonical_unit(F.col("unit"))).withColumn("v", values).withColumn("parts", F.slice("v", 1, len(names)))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x)
    good = (F.size("v") == len(names) + 1) & (total == F.try_element_at("v", F.lit(len(names) + 1))) & F.col("unit_type").isNotNull()
    # A unit's row is chosen before its parts are listed: a row for each part would make every group seven.
    last = F.max_by(F.struct("parts"), "row").alias("last")
    units = rows.groupBy(*keys, "unit_type").agg(last, F.bool_and(F.coalesce(good, F.lit(False))).alias("good"))
    tables = units.groupBy(*keys).agg(F.bool_and("good").alias("sound"), F.collect_list(F.struct("unit_type", "last")).alias("units")).filter("sound")
    listed = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("supply_type"), F.col("u.last.parts").alias("supply_count"))
    out = tables.select(*keys, F.explode("units").alias("u")).select(*keys, "u.unit_type", F.inline(listed))
    return out.filter("supply_count > 0")


# How documents tell in which order and by which shares winners are chosen.
ARROW = r"\s*(?:→|⇒|->)\s*"
ORDER = r"당첨자\s*선정\s*순서\s*[:：]\s*([^■※]{0,300})"
BY_REGION = r"[①②③④⑤]\s*지역\s*[:：]\s*해당지역\s*거주자\s*\(([^)]*)\)" + ARROW + r"기타지역\s*거주자"
BY_QUOTA = r"지역\s*[:：]\s*해당시\s*[·ㆍ.]\s*도\s*거주자\s*(\d{1,3})\s*%[^→⇒%]{0,80}?(?:→|⇒|->)\s*기타지역\s*거주자\s*(\d{1,3})\s*%"
LOTTERY_STAGE = r"(\d+)단계에서\s*경쟁이\s*있는\s*경우\s*순위와\s*관계없이\s*해당지역\s*거주자"
ADVANCE, RECOMMENDED = r"각\s*단계별\s*낙첨자는\s*다음\s*단계\s*공급대상에\s*포함", r"(?:관계|해당)기관의\s*장이\s*정하는\s*우선순위에\s*따라\s*공급"
SHARE_NAMES = (("local", r"해당\s*(?:주택건설)?지역"), ("other_gyeonggi", r"기타\s*경기(?:지역)?"), ("other", r"기타지역(?!\s*경기)"))


def selection_steps(text: Column) -> Column:
    """The steps of a document's order of selection, numbers aside; null unless there are two at least and none is empty."""
    steps = F.transform(F.split(F.trim(F.regexp_extract(text, ORDER, 1)), ARROW), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[①②③④⑤⑥⑦⑧⑨]\\s*", "")))
    return F.when((F.size(steps) > 1) & F.forall(steps, lambda x: x != ""), steps)


def regional_shares(text: Column) -> Column:
    """array<struct<residence_area, percent>> of a quota table; null unless the local area and another are told and all make a hundred."""
    share = lambda pattern: F.regexp_extract(text, pattern + r"[^%]{0,100}?(\d{1,3})\s*%", 1).try_cast("int")
    found = F.filter(F.array(*[F.struct(F.lit(area).alias("residence_area"), share(pattern).alias("percent")) for area, pattern in SHARE_NAMES]), lambda x: x["percent"].isNotNull())
    total = F.aggregate(found, F.lit(0), lambda a, x: a + x["percent"])
    return F.when((F.size(found) > 1) & F.exists(found, lambda x: x["residence_area"] == "local") & (total == 100), found)


def special_selection(sections: DataFrame, inventory: DataFrame) -> DataFrame:
    """sections (notice_id, supply_type, page, text), inventory (notice_id, supply_type, unit_type, supply_count) -> notice_id, supply_type, method,
    local_region, local_percent, steps, lottery_stage, advance, page: how special supplies that are offered choose their winners.

    method: institution, region_priority or regional_quota (two shares that make a hundred), of the first page that tells one;
    steps and the rest from whichever page tells them. Supplies without a positive count, and general supply, have no row.
    """
    offered = inventory.filter("supply_count > 0").select("notice_id", "supply_type").distinct()
    get = lambda pattern, i=1: F.nullif(F.regexp_extract("text", pattern, i), F.lit(""))
    first, second = get(BY_QUOTA, 1).try_cast("int"), get(BY_QUOTA, 2).try_cast("int")
    institution = F.col("supply_type").contains("기관추천")
    method = F.when(institution & F.col("text").rlike(RECOMMENDED), "institution").when(~institution & get(BY_REGION).isNotNull(), "region_priority").when(~institution & (first + second == 100), "regional_quota")
    rows = sections.filter(~F.col("supply_type").rlike(r"^\s*일반(?:\s*공급)?\s*$")).join(offered, ["notice_id", "supply_type"], "left_semi")
    rows = rows.select(
        "notice_id", "supply_type", "page", method.alias("method"), F.when(method == "region_priority", F.trim(F.regexp_replace(get(BY_REGION), r"\s*거주자\s*$", ""))).alias("local_region"), F.when(method == "regional_quota", first).alias("local_percent"),
        selection_steps(F.col("text")).alias("steps"), get(LOTTERY_STAGE).try_cast("int").alias("lottery_stage"), F.col("text").rlike(ADVANCE).alias("advance"),
    )
    at = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page"))).alias(c)
    told = F.min_by(F.struct("method", "local_region", "local_percent", "page"), F.when(F.col("method").isNotNull(), F.col("page")))
    out = rows.groupBy("notice_id", "supply_type").agg(told.alias("t"), at("steps"), at("lottery_stage"), F.bool_or("advance").alias("advance"))
    return out.filter("t.method IS NOT NULL").select("notice_id", "supply_type", "t.method", "t.local_region", "t.local_percent", "steps", "lottery_stage", "advance", "t.page")
