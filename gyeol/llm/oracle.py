"""SQL with the same results as those queries that SQL can express."""

from __future__ import annotations

from gyeol.llm import canon
from gyeol.llm.leakage import MIN_RUN
from gyeol.llm.pieces import LIMIT


def _fold(col: str) -> str:
    """The consistent form of a column: single-character foldings by translate, composition by the engine."""
    one = {chr(a): b for a, b in canon.translation().items() if len(b) <= 1 and a not in (0x27,) and b != "'"}
    kept = {a: b for a, b in one.items() if b} | {"’": "’"}
    gone = [a for a, b in one.items() if not b]
    source, to = "".join(kept) + "".join(gone), "".join(kept.values())
    return f"nfc_normalize(translate(nfc_normalize({col}), '{source}', '{to}'))"


ONCE = "(SELECT doc_id, arg_max(rcept_dt, loaded_at) AS rcept_dt FROM document GROUP BY doc_id)"
_DAY = "(regexp_matches({0}, '^[0-9]{{8}}$') AND try_strptime({0}, '%Y%m%d') IS NOT NULL)"


def _p1() -> str:
    return f"""
WITH t AS (SELECT id, corp_code, title AS raw, {_fold("title")} AS c FROM event_contract WHERE title IS NOT NULL),
k AS (SELECT id, counterparty AS raw, {_fold("counterparty")} AS c FROM event_contract WHERE counterparty IS NOT NULL),
p AS (SELECT party_id, party_name AS raw, {_fold("party_name")} AS c FROM party WHERE party_name IS NOT NULL),
f AS (SELECT folder_id, listed_path AS raw, {_fold("listed_path")} AS c FROM raw_folder WHERE listed_path IS NOT NULL),
d AS (SELECT rcept_no::BIGINT AS n, file_path AS raw, {_fold("file_path")} AS c FROM document WHERE file_path IS NOT NULL)
SELECT DISTINCT 'title' AS field, a.id AS key_a, b.id AS key_b FROM t a JOIN t b ON a.corp_code = b.corp_code AND a.c = b.c AND a.id < b.id AND a.raw <> b.raw
UNION ALL SELECT DISTINCT 'counterparty', party_id, id FROM p JOIN k ON p.c = k.c AND p.raw <> k.raw
UNION ALL SELECT DISTINCT 'file_path', folder_id, n FROM f JOIN d ON f.c = d.c AND f.raw <> d.raw
"""


def _p5() -> str:
    order = "ORDER BY rcept_dt DESC NULLS LAST, is_correction DESC NULLS LAST, loaded_at DESC NULLS LAST, id DESC"
    paid = "amount_krw > 0 AND (ratio_match IS NULL OR ratio_match <> 0)"
    ends = f"coalesce({_DAY.format('end_date')}, false) AND (start_date IS NULL OR end_date >= start_date)"
    return f"""
WITH v AS (SELECT e.*, {_fold("title_norm")} AS g, r.rcept_dt FROM event_contract e LEFT JOIN {ONCE} r USING (doc_id) WHERE title_norm IS NOT NULL AND corp_code IS NOT NULL AND event_type IS NOT NULL)
SELECT keep_id, coalesce(amount_id, -1) AS amount_id, coalesce(end_id, -1) AS end_id FROM (SELECT first(id {order}) AS keep_id, first(id {order}) FILTER (WHERE {paid}) AS amount_id,
 first(id {order}) FILTER (WHERE {ends}) AS end_id, count(*) AS n FROM v GROUP BY corp_code, event_type, g) WHERE n > 1
"""


def _p5_survivors() -> str:
    """Every column of the built record: the newest value that the column's own rule lets pass."""
    trusted = "(ratio_match IS NULL OR ratio_match <> 0)"
    paid = f"{trusted} AND (amount_krw IS NULL OR amount_krw > 0)"
    rules = {
        "id": "true", "amount_krw": f"amount_krw > 0 AND {trusted}", "amount_fixed": f"{paid} AND amount_fixed > 0", "amount_cond": f"{paid} AND amount_cond >= 0",
        "ratio_stated": f"{trusted} AND ratio_stated IS NOT NULL", "end_date": f"coalesce({_DAY.format('end_date')}, false) AND (start_date IS NULL OR end_date >= start_date)",
        "start_date": _DAY.format("start_date"), "signed_at": _DAY.format("signed_at"), "hold_until": _DAY.format("hold_until"),
    }
    plain = ["doc_id", "form", "disclosure_type", "title", "title_norm", "category", "counterparty", "counterparty_rel", "region", "base_amount", "base_kind", "ratio_calc", "ratio_match", "purpose", "terminate_reason", "hold_reason", "is_large_corp", "is_correction", "loaded_at"]
    rules |= {c: f"{c} IS NOT NULL AND trim({c}::VARCHAR) <> '' AND {c}::VARCHAR <> '-'" for c in plain}
    order = "coalesce(rcept_dt, ''), coalesce(is_correction, -1), coalesce(loaded_at, TIMESTAMP '0001-01-01'), id"
    first = dict.fromkeys(("ratio_calc", "ratio_match"), f"{trusted}::INT, ")
    columns = ", ".join(f"arg_max({c}, ({first.get(c, '')}{order})) FILTER (WHERE {rule}) AS {c}" for c, rule in rules.items())
    return f"""
WITH v AS (SELECT e.*, {_fold("title_norm")} AS title_key, r.rcept_dt FROM event_contract e LEFT JOIN {ONCE} r USING (doc_id)),
w AS (SELECT *, CASE WHEN corp_code IS NULL OR event_type IS NULL OR title_key IS NULL THEN id END AS own FROM v)
SELECT corp_code, event_type, title_key, count(*) AS group_rows, {columns} FROM w GROUP BY corp_code, event_type, title_key, own
"""


def _p1_canonical() -> str:
    parts = [("title", "id", "title", "event_contract"), ("counterparty", "id", "counterparty", "event_contract"), ("counterparty", "party_id", "party_name", "party"), ("file_path", "folder_id", "listed_path", "raw_folder"), ("file_path", "try_cast(rcept_no AS BIGINT)", "file_path", "document")]
    return " UNION ALL ".join(f"SELECT '{field}' AS field, {key} AS key, {raw} AS raw, {_fold(raw)} AS canon FROM {t}" for field, key, raw, t in parts)


def _p6() -> str:
    letters = lambda c: rf"lower(regexp_replace({_fold(c)}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
    grams = lambda key, t: f"SELECT DISTINCT {key}, substr(t, k, {MIN_RUN}) AS w FROM (SELECT {key}, t, unnest(range(1, greatest(length(t) - {MIN_RUN - 2}, 1))) AS k FROM {t})"
    return f"""
WITH i AS (SELECT item_id, {letters("text")} AS t FROM eval_item), d AS (SELECT doc_id, {letters("text")} AS t FROM documents)
SELECT DISTINCT doc_id, item_id FROM ({grams("doc_id", "d")}) JOIN ({grams("item_id", "i")}) USING (w)
"""


P3 = f"""
SELECT doc_id, section FROM (SELECT * FROM holding_item QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY loaded_at DESC, id DESC) = 1)
GROUP BY 1, 2 HAVING sum(coalesce(length(item_name), 0) + coalesce(length(item_value), 0) + 3) > {LIMIT}
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _p1(), "p1_canonical": _p1_canonical(), "p5_survivors": _p5_survivors(), "p3_found": P3, "p5_found": _p5(), "p6_found": _p6()}
