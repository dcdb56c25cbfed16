"""Explicit schemas of all tables: codes and dates are text, amounts LONG, flags INT with null for not checkable."""

from __future__ import annotations

from pyspark.sql import SparkSession

_ID = "id BIGINT, doc_id STRING, corp_code STRING"
_ITEM = "id BIGINT, doc_id STRING, seq INT, item_name STRING, item_value STRING"
TABLES = {
    "company": "corp_code STRING, stock_code STRING, corp_name STRING, listed_name STRING, corp_eng_name STRING, market STRING, industry STRING, sector_no INT, sector STRING, listing_date STRING, "
    "fiscal_month INT, market_cap BIGINT, n_periodic INT, n_major INT, n_exchange INT, n_holding INT, note STRING",
    "document": "doc_id STRING, corp_code STRING, corp_name STRING, doc_group STRING, doc_subtype STRING, major_kind STRING, category STRING, report_nm STRING, rcept_no STRING, rcept_dt STRING, "
    "flr_nm STRING, base_year INT, base_month INT, is_correction INT, file_path STRING, file_format STRING, n_files INT",
    "doc_relation": "from_doc_id STRING, to_doc_id STRING, rel_type STRING, target_date STRING, target_hint STRING, resolved INT, unresolved_reason STRING, candidates INT, chain_depth INT",
    "event_contract": f"{_ID}, event_type STRING, form STRING, disclosure_type STRING, title STRING, title_norm STRING, category STRING, counterparty STRING, counterparty_rel STRING, region STRING, "
    "amount_krw BIGINT, amount_fixed BIGINT, amount_cond BIGINT, base_amount BIGINT, base_kind STRING, ratio_stated DOUBLE, ratio_calc DOUBLE, ratio_match INT, start_date STRING, end_date STRING, "
    "signed_at STRING, purpose STRING, terminate_reason STRING, hold_until STRING, hold_reason STRING, is_large_corp INT, is_correction INT",
    "event_major": f"{_ID}, major_kind STRING, is_correction INT, decided_at STRING, start_date STRING, end_date STRING, amount_krw BIGINT, amount_src STRING, currency STRING, amount_foreign DOUBLE, "
    "use_facility BIGINT, use_business BIGINT, use_operation BIGINT, use_debt BIGINT, use_acquire BIGINT, use_other BIGINT, use_total BIGINT, check_ok INT, shares_common BIGINT, shares_other BIGINT, "
    "shares_before BIGINT, price_share BIGINT, disposal_purpose STRING, method_market BIGINT, method_block BIGINT, method_otc BIGINT, method_etc BIGINT, is_withdrawn INT, correct_reason STRING",
    "event_holding": f"{_ID}, is_correction INT, form STRING, holder_name STRING, report_type STRING, report_reason STRING, purpose STRING, prev_shares BIGINT, prev_ratio DOUBLE, curr_shares BIGINT, "
    "curr_ratio DOUBLE, total_shares BIGINT, ratio_calc DOUBLE, ratio_match INT, base_date STRING, obligation_date STRING",
    "contract_item": _ITEM,
    "major_item": _ITEM,
    "holding_item": "id BIGINT, doc_id STRING, seq INT, section STRING, has_pii INT, item_name STRING, item_value STRING",
}
#: A manifest line; base_year and base_month are read as DOUBLE, since 2025.0 isn't read as INT.
MANIFEST = (
    "doc_id STRING, corp_code STRING, corp_name STRING, listed_name STRING, stock_code STRING, industry STRING, sector STRING, doc_group STRING, doc_subtype STRING, report_nm STRING, "
    "is_correction BOOLEAN, rcept_no STRING, rcept_dt STRING, flr_nm STRING, base_year DOUBLE, base_month DOUBLE, file_path STRING, file_format STRING, n_files INT"
)
#: Columns that scans filter by most: files are clustered by them instead of indexed.
CLUSTER = {"document": "doc_group", "doc_relation": "rel_type", "event_contract": "event_type", "event_major": "major_kind", "holding_item": "section"}


def create_tables(spark: SparkSession, names: list[str] | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS for all tables, or those named, in the current catalog."""
    for name in names or TABLES:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({TABLES[name]}) USING parquet")


def column_names(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].split(", ")]
