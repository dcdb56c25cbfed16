"""Amounts of the major-decision records and market values of companies in common units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.functions import units as U
from gyeol.operators.unit_solver import solve_units
from gyeol.session import table

#: The item that repeats an amount, by the label that amount_src starts with (blanks removed).
OWN_ITEM = {
    "예정금액보통주식": r"보통주식금액",
    "사채의권면총액": r"사채의권면(\(전자등록\))?총액",
    "신주수×발행가액": r"모집총액",
    "양수금액": r"양수금액",
    "계약금액": r"계약금액",
}
#: The columns of event_major that are read.
MAJOR = ["id", "doc_id", "amount_krw", "amount_src", "currency", "amount_foreign", "use_total", "shares_common", "price_share"]
_LEAD = r"^(?:[0-9]+(?:-[0-9]+)*[.)]|[-ㆍ·ᆞ•※]|\s)+"
OVERSEAS = r"(?:해외발행|해외)\)?총액|해외발행\)총액"


def _last_part(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(U.half_width(c), ">"), -1), _LEAD, "")


def stated_in_items(items: DataFrame) -> DataFrame:
    """(doc_id, label, won) of own items, (doc_id, '#line', won) of unit lines, (doc_id, '#overseas', factor).

    One aggregation with map-side combine: a document has at most one row a label, the latest.
    """
    # every name that counts has one of these words, blanks aside; the expressions below run on the few rows that have
    bare = F.translate("item_name", " \t\n\u3000\u00a0\u2002\u2003\u2009", "")
    near = items.where(bare.contains("금액") | bare.contains("총액") | bare.contains("단위"))
    last = F.regexp_replace(_last_part(F.col("item_name")), r"\s+", "")

    def kind_of(last: Column) -> Column:
        kind = F.when((F.trim(F.coalesce("item_value", F.lit(""))) == "") & F.col("item_name").contains("단위"), F.lit("#line"))
        for label, pat in OWN_ITEM.items():
            kind = kind.when(last.rlike(f"^{pat}(?:$|[(\\[])"), F.lit(label))
        return kind.when(last.rlike(OVERSEAS), F.lit("#overseas"))

    # as a generator the kind is found once a row: a filter on a column would be computed again in the scan
    kinds = F.when(F.col("item_name").contains("정정전"), F.array().cast("array<string>")).otherwise(F.array_compact(F.transform(F.array(last), kind_of)))
    marked = near.select("doc_id", "seq", "loaded_at", "item_name", F.explode(kinds).alias("kind"))
    inner = F.regexp_extract(U.half_width(F.col("item_name")), r"[(\[]\s*(?:단위\s*[:=]?)?\s*([^()\[\]]+)[)\]]\s*$", 1)
    iso, factor = U.currency_of(F.col("inner"))
    marked = marked.withColumn("inner", inner).withColumns({"iso": iso, "factor": factor})
    scale = F.when(F.col("kind") == "#line", U.unit_line_scale(F.col("item_name"))).when(F.col("kind") == "#overseas", F.when(F.col("iso").isNotNull(), F.col("factor"))).otherwise(U.stated_won_scale(F.col("item_name")))
    said = marked.select("doc_id", "kind", "seq", "loaded_at", scale.alias("scale")).where("scale is not null")
    return said.groupBy("doc_id", "kind").agg(F.max_by("scale", F.struct("loaded_at", "seq")).alias("scale"))


def major_units(spark: SparkSession, d: str) -> DataFrame:
    """event_major with the scale of amount_krw, its basis, and ISO code and factor of amount_foreign."""
    em = table(spark, d, "event_major").select(*MAJOR)
    said = stated_in_items(table(spark, d, "major_item"))
    said = said.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "scale"))).alias("said"))
    em = em.join(said, "doc_id", "left")
    label = F.lit(None).cast("string")
    for x in OWN_ITEM:
        label = F.when(F.col("__src").startswith(x), F.lit(x)).otherwise(label)
    in_currency = F.when(F.col("amount_foreign").isNull(), U.bare_won_scale(F.col("currency")))
    em = em.withColumn("__src", F.regexp_replace(U.half_width(F.col("amount_src")), r"\s+", "")).withColumn("__own", label)
    iso, factor = U.currency_of(F.col("currency"))
    em = em.withColumns(
        {
            "__record": F.coalesce(U.stated_won_scale(F.col("amount_src")), in_currency),
            "__item": F.try_element_at("said", F.col("__own")),
            "__line": F.try_element_at("said", F.lit("#line")),
            "__overseas": F.try_element_at("said", F.lit("#overseas")),
            "foreign_iso": iso,
            "__factor": factor,
        }
    )
    em = solve_units(
        em,
        {"amount_krw": U.WON_SCALES},
        [{"amount_krw": 1, "use_total": -1}, {"amount_krw": 1, "shares_common": -1, "price_share": -1}],
    )
    # a solution that isn't the only one converts nothing: it is reported as such
    solved = F.when(F.col("solved_unique"), F.col("solved_amount_krw"))
    basis = F.when(F.col("__record").isNotNull(), "record").when(F.col("__item").isNotNull(), "item").when(F.col("__line").isNotNull(), "line").when(solved.isNotNull(), "identity").when(F.col("solved_amount_krw").isNotNull(), "not unique").otherwise("default")
    out = em.withColumns(
        {
            "won_scale": F.coalesce("__record", "__item", "__line", solved, F.lit(1.0)),
            "won_basis": basis,
            "foreign_factor": F.when(F.col("__factor") != 1, F.col("__factor")).otherwise(F.coalesce("__overseas", F.lit(1.0))),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def market_caps(spark: SparkSession, d: str) -> DataFrame:
    """company with the factor of market_cap: 억원 unless a note on the market value says otherwise."""
    note = F.lower(U.half_width(F.col("note")))
    clause = F.regexp_extract(note, r"(?:시가총액|시총|market\s*cap(?:italization)?|mkt\s*cap)([^;/]*)", 1)
    unit = F.regexp_extract(clause, rf"({U.WON_UNIT})", 1)
    return table(spark, d, "company").withColumn("cap_unit", unit).withColumn("cap_scale", F.coalesce(U.scale_of(F.col("cap_unit")), F.lit(1e8)))


def _whole(value: Column, factor: Column) -> Column:
    """Exact where the value is a whole number: decimals, not doubles."""
    return F.round(value.cast("decimal(38,6)") * factor.cast("decimal(19,0)"), 0).cast("long")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    em = major_units(spark, d)
    won = em.where("amount_krw is not null and won_scale <> 1").select(
        F.lit("amount_krw").alias("field"), F.col("id").cast("string").alias("row_key"), F.lit("KRW").alias("unit"), _whole(F.col("amount_krw"), F.col("won_scale")).alias("unit_value"))
    abroad = em.where("amount_foreign is not null and not isnan(amount_foreign) and foreign_iso is not null and (currency <> foreign_iso or foreign_factor <> 1)").select(
        F.lit("amount_foreign").alias("field"), F.col("id").cast("string").alias("row_key"), F.col("foreign_iso").alias("unit"), _whole(F.col("amount_foreign"), F.col("foreign_factor")).alias("unit_value"))
    caps = market_caps(spark, d).where("market_cap is not null").select(
        F.lit("market_cap").alias("field"), F.col("corp_code").alias("row_key"), F.lit("KRW").alias("unit"), _whole(F.col("market_cap"), F.col("cap_scale")).alias("unit_value"))
    return won.unionByName(abroad).unionByName(caps).distinct()


def p2_normalized(spark: SparkSession, d: str) -> DataFrame:
    """Every major record with its amounts in won and whole currency units, how the unit was found, and whether it is unique."""
    em = major_units(spark, d)
    return em.select(
        "id", "doc_id", "amount_krw", "won_scale", "won_basis", _whole(F.col("amount_krw"), F.col("won_scale")).alias("amount_won"),
        "solved_unique", (F.col("solved_amount_krw").isNotNull() & (F.col("solved_amount_krw") != F.col("won_scale"))).alias("contradicted"),
        "currency", "foreign_iso", (F.col("amount_foreign").isNotNull() & F.col("foreign_iso").isNull()).alias("currency_unknown"), _whole(F.col("amount_foreign"), F.when(F.col("foreign_iso").isNotNull(), F.col("foreign_factor"))).alias("foreign_units"))
