"""The fact rows of contracts, decisions and holdings said in SQL for the second engine. Labels are the forms' own fixed values."""

from __future__ import annotations

from gyeol.operators.facts import AMOUNT_ITEM, BOND_KINDS, FORM_LABELS, FORM_PERIOD, USES
from gyeol.plans.relational import ONCE

BLANK = r"[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{202f}\x{3000}]"


def _squeeze(c: str) -> str:
    return f"regexp_replace({c}, '{BLANK}+', '', 'g')"


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _live(name: str) -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY loaded_at DESC, id DESC) = 1)"


def _int(c: str) -> str:
    t = _trim(f"replace({c}, ',', '')")
    return f"CASE WHEN regexp_matches({t}, '^-?[0-9]+$') THEN try_cast({t} AS BIGINT) END"


def _real(c: str) -> str:
    return f"try_cast({_trim(f'replace(replace({c}, $$,$$, $$$$), $$%$$, $$$$)')} AS DOUBLE)"


def _num(c: str) -> str:
    t = _trim(f"replace({c}, ',', '')")
    return f"CASE WHEN regexp_matches({t}, '^-?[0-9]+([.][0-9]+)?$') THEN try_cast({t} AS DOUBLE) END"


def _day(c: str, must: bool) -> str:
    gap = (lambda m: f"{BLANK}*[{m}]{BLANK}*") if must else (lambda m: f"(?:[{m}]|{BLANK})*")
    part = lambda k: f"regexp_extract({c}, '([0-9]{{4}}){gap('-.년')}([0-9]{{1,2}}){gap('-.월')}([0-9]{{1,2}})', {k})"
    return f"CASE WHEN try_cast({part(2)} AS INT) BETWEEN 1 AND 12 AND try_cast({part(3)} AS INT) BETWEEN 1 AND 31 THEN {part(1)} || lpad({part(2)}, 2, '0') || lpad({part(3)}, 2, '0') END"


def contract() -> str:
    keys = sorted({k for m in FORM_LABELS.values() for k in m})
    labels = ", ".join(f"('{form}', '{k}', '{label}')" for form, m in FORM_LABELS.items() for k, label in m.items())
    known = ", ".join(f"('{form}', '{x}')" for form, m in FORM_LABELS.items() for x in {*m.values(), FORM_PERIOD[form], "시작일", "종료일"})
    sign = lambda *xs: f"bool_or(k IN ({', '.join(map(repr, xs))}))"
    form = f"CASE WHEN {sign('투자금액(원)')} AND {sign('자기자본(원)')} THEN '시설투자' WHEN {sign('해지금액(원)', '해지계약명')} THEN '해지' WHEN {sign('확정계약금액', '계약금액총액(원)', '판매ㆍ공급계약내용')} THEN '코스닥' WHEN {sign('체결계약명')} THEN '의무' WHEN {sign('세부내용')} THEN '자율' ELSE '' END"
    text = lambda c: f"nullif({c}, '') AS {c}"
    fields = ", ".join(f"max(v) FILTER (WHERE field = '{k}') AS {k}" for k in keys)
    period = " ".join(f"WHEN '{f}' THEN '{x}'" for f, x in FORM_PERIOD.items())
    return f"""
WITH i AS (SELECT doc_id, seq, trim(regexp_replace(regexp_extract(item_name, '([^>]*)$', 1), '{BLANK}+', ' ', 'g')) AS line, coalesce(item_value, '-') AS value FROM {_live("contract_item")}),
l AS (SELECT doc_id, 2 * seq AS pos, line, value AS nxt FROM i UNION ALL SELECT doc_id, 2 * seq + 1, {_trim("value")}, NULL FROM i UNION ALL SELECT DISTINCT doc_id, -2, '- 체결계약명', doc_id FROM i),
f AS (SELECT doc_id, {form} AS form FROM (SELECT doc_id, regexp_replace({_squeeze("line")}, '^(?:[0-9]{{1,2}}[.．])?[-－ㆍ·]?', '') AS k FROM l) GROUP BY 1),
lab(form, field, label) AS (VALUES {labels}), known(form, label) AS (VALUES {known}),
h AS (SELECT l.doc_id, f.form, field, pos, CASE WHEN (f.form, nxt) IN (SELECT (form, label) FROM known) THEN '' ELSE coalesce(nxt, '') END AS v FROM l JOIN f USING (doc_id) JOIN lab ON lab.form = f.form AND lab.label = l.line QUALIFY row_number() OVER (PARTITION BY l.doc_id, field ORDER BY pos) = 1),
g AS (SELECT doc_id, {fields} FROM h GROUP BY 1),
s AS (SELECT doc_id, min(pos) AS p0 FROM l JOIN f USING (doc_id) WHERE line = CASE form {period} END GROUP BY 1),
p AS (SELECT l.doc_id, arg_max(nxt, pos) FILTER (WHERE line = '시작일') AS starts, arg_max(nxt, pos) FILTER (WHERE line = '종료일') AS ends FROM l JOIN s USING (doc_id) WHERE pos >= p0 AND pos < p0 + 7 GROUP BY 1),
x AS (SELECT f.doc_id, f.form, g.* EXCLUDE (doc_id), starts, ends, {_int("amount")} AS a, {_int("base_amount")} AS b, {_real("ratio_stated")} AS st FROM f LEFT JOIN g USING (doc_id) LEFT JOIN p USING (doc_id)),
c AS (SELECT *, round(nullif(a, 0)::DOUBLE / nullif(b, 0)::DOUBLE * 100, 4) AS calc FROM x)
SELECT doc_id, form, {text("title")}, nullif({_squeeze("title")}, '') AS title_norm, {text("category")}, {text("counterparty")}, {text("counterparty_rel")}, {text("region")}, a AS amount_krw, {_int("amount_fixed")} AS amount_fixed, {_int("amount_cond")} AS amount_cond,
 b AS base_amount, CASE WHEN form <> '' THEN CASE WHEN form = '시설투자' THEN 'equity' ELSE 'revenue' END END AS base_kind, st AS ratio_stated, round(calc, 3) AS ratio_calc, CASE WHEN calc IS NOT NULL AND st IS NOT NULL THEN (abs(calc - st) <= greatest(0.05, st * 0.005))::INT END AS ratio_match,
 {_day("starts", False)} AS start_date, {_day("ends", False)} AS end_date, {_day("signed_at", False)} AS signed_at, {text("purpose")}, {text("terminate_reason")}, {_day("hold_until", False)} AS hold_until, {text("hold_reason")}, CASE trim(is_large_corp) WHEN '해당' THEN 1 WHEN '미해당' THEN 0 END AS is_large_corp FROM c
"""


def _has(*words: str) -> str:
    return " AND ".join(f"contains(n, '{w}')" for w in words)


def _last(*words: str) -> str:
    return f"arg_max(struct_pack(v := item_value), seq) FILTER (WHERE {_has(*words)}).v"


def _first(*words: str) -> str:
    return f"arg_min(struct_pack(v := item_value), seq) FILTER (WHERE {_has(*words)}).v"


REASONS = rf"""
WITH h AS (SELECT doc_id, item_name, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS nth FROM {_live("major_item")}),
a AS (SELECT doc_id, nth, string_split(item_name, '>') AS xs FROM h WHERE nth <= 80 AND item_name IS NOT NULL),
q AS (SELECT doc_id, nth, k AS pos, {_trim("xs[k]")} AS part FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS k FROM a)),
r AS (SELECT doc_id, part, count(*) AS n, min((nth, pos)) AS seen, regexp_matches(part, '철회|취소|해제|무효|가처분|중단') AS off FROM q
 WHERE length(part) >= 8 AND NOT regexp_matches(part, '^[0-9]{{1,2}}{BLANK}*[.．]') AND NOT regexp_matches(part, '^(?:[0-9,.%()-]|{BLANK})+$') GROUP BY 1, 2)
SELECT doc_id, part AS correct_reason, off::INT AS is_withdrawn FROM r WHERE off OR n >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY off DESC, n DESC, seen) = 1
"""


def major() -> str:
    kinds = " ".join(f"WHEN major_kind = '{k}' THEN {_last(*p)}" for k, p in AMOUNT_ITEM.items())
    sources = " ".join(f"WHEN major_kind = '{k}' THEN '{' > '.join(p)}'" for k, p in AMOUNT_ITEM.items())
    uses = ", ".join(f"{_int(_last('자금조달의목적', w))} AS {k}" for k, w in USES.items())
    z = lambda c: f"nullif({c}, 0)"
    bonds = ", ".join(f"'{k}'" for k in BOND_KINDS)
    total = " + ".join(f"coalesce({k}, 0)" for k in USES)
    picks = {
        "face": ("사채의권면", "총액"), "new_common": ("신주의종류와수", "보통주식"), "new_price": ("신주발행가액", "보통주식"), "sell_common": ("처분예정주식", "보통주식"), "buy_common": ("취득예정주식", "보통주식"),
        "new_other": ("신주의종류와수", "기타주식"), "sell_other": ("처분예정주식", "기타주식"), "buy_other": ("취득예정주식", "기타주식"), "before": ("증자전발행주식총수", "보통주식"), "sell_price": ("처분대상주식가격", "보통주식"),
        "buy_price": ("취득예정금액", "1주당"), "m_market": ("처분방법", "시장을통한매도"), "m_block": ("처분방법", "시간외대량매매"), "m_otc": ("처분방법", "장외처분"), "m_etc": ("처분방법", "기타"),
    }
    numbers = ", ".join(f"{_int(_last(*p))} AS {k}" for k, p in picks.items())
    return f"""
WITH i AS (SELECT m.*, k.major_kind, {_squeeze("item_name")} AS n FROM {_live("major_item")} m JOIN (SELECT doc_id, major_kind FROM {ONCE} WHERE doc_group = 'major') k USING (doc_id)),
g AS (SELECT doc_id, major_kind, {_int(f"CASE {kinds} END")} AS main, CASE {sources} END AS src, {uses}, {numbers}, {_last("이사회결의일(결정일)")} AS d1, {_first("이사회결의일")} AS d2, {_first("결정일")} AS d3, {_last("시작일")} AS s, {_last("종료일")} AS e,
 {_last("권면", "총액", "통화단위")} AS fx, {_last("기준환율")} AS rate, {_last("통화단위")} AS fu, {_last("처분목적")} AS disposal FROM i GROUP BY doc_id, major_kind),
t AS (SELECT *, nullif({total}, 0) AS ut, CASE WHEN major_kind = '유상증자결정' THEN {z("new_common")} * {z("new_price")} END AS gross, coalesce({z("new_common")}, {z("sell_common")}, buy_common) AS sc, coalesce({z("new_other")}, {z("sell_other")}, buy_other) AS so,
 coalesce({z("new_price")}, {z("sell_price")}, {z("buy_price")}) AS ps, coalesce(nullif(rate, ''), fu) AS unit FROM g),
u AS (SELECT *, coalesce(main, gross, ut) AS amt FROM t), r AS ({REASONS})
SELECT u.doc_id, major_kind, coalesce({_day("d1", True)}, {_day("d2", True)}, {_day("d3", True)}) AS decided_at, {_day("s", True)} AS start_date, {_day("e", True)} AS end_date, amt AS amount_krw,
 CASE WHEN main IS NOT NULL THEN src WHEN gross IS NOT NULL THEN '신주 수 × 발행가액' WHEN ut IS NOT NULL THEN '자금조달의 목적 합계' ELSE src END AS amount_src,
 CASE WHEN NOT regexp_matches(unit, '^[0-9,.\\s-]*$') THEN nullif(regexp_extract(unit, '[A-Z]{{3}}', 0), '') END AS currency, {_real("fx")} AS amount_foreign, {", ".join(USES)}, ut AS use_total,
 CASE WHEN major_kind IN ({bonds}) THEN CASE WHEN coalesce(ut, 0) <> 0 AND coalesce(face, 0) <> 0 THEN (abs(ut - face) < 1)::INT END
  WHEN major_kind = '유상증자결정' THEN CASE WHEN coalesce(sc * ps, 0) <> 0 AND coalesce(ut, 0) <> 0 THEN (sc * ps - ut BETWEEN sc * ps * -0.0001 AND sc * ps * 0.03)::INT END
  WHEN contains(major_kind, '자기주식처분') OR contains(major_kind, '자기주식취득결정') THEN CASE WHEN coalesce(sc, 0) <> 0 AND coalesce(ps, 0) <> 0 AND coalesce(amt, 0) <> 0 THEN (abs(sc * ps - amt) <= greatest(1, amt * 0.001))::INT END END AS check_ok,
 sc AS shares_common, so AS shares_other, before AS shares_before, ps AS price_share, {", ".join(f"CASE WHEN contains(major_kind, '자기주식처분') THEN {c} END AS {n}" for c, n in (("disposal", "disposal_purpose"), ("m_market", "method_market"), ("m_block", "method_block"), ("m_otc", "method_otc"), ("m_etc", "method_etc")))},
 coalesce(is_withdrawn, 0) AS is_withdrawn, correct_reason FROM u LEFT JOIN r ON r.doc_id = u.doc_id
"""


def holding() -> str:
    first = lambda cond, v="item_value": f"arg_min(struct_pack(v := {v}), seq) FILTER (WHERE {cond}).v"
    summary, who, filled = "section = 'summary'", "section IN ('holding_total', 'holding')", f"coalesce({_num('item_value')}, 0) <> 0"
    total = ", ".join(_num(first(f"{_has(w)} AND {filled}")) for w in ("이번보고서>의결권있는발행주식총수", "직전보고서>의결권있는발행주식총수", "의결권있는발행주식총수(주)"))
    near = lambda c: f"(abs(round({c}, 2) - cr) <= 0.05 OR abs(round({c}, 1) - cr) <= 0.05)"
    return f"""
WITH h AS (SELECT * FROM {_live("holding_item")}), nx AS (SELECT doc_id, seq, lead(item_value) OVER (PARTITION BY doc_id ORDER BY seq) AS nv FROM h WHERE section = 'summary'),
i AS (SELECT h.*, nv, CASE WHEN contains(d.report_nm, '약식') THEN '약식' ELSE '일반' END AS form, {_squeeze("item_name")} AS n FROM h LEFT JOIN nx USING (doc_id, seq) JOIN {ONCE} d ON d.doc_id = h.doc_id WHERE d.doc_group = 'holding'),
g AS (SELECT doc_id, form, {_num(first(f"{summary} AND {_has('직전보고서')}"))} AS prev_shares, {_num(first(f"{summary} AND {_has('보유주식등의수및보유비율', '직전보고서')}", "nv"))} AS prev_ratio,
 {_num(first(f"{summary} AND {_has('이번보고서')}"))} AS cs, {_num(first(f"{summary} AND {_has('보유주식등의수및보유비율', '이번보고서')}", "nv"))} AS cr, {first(f"{summary} AND {_has('보고구분')}")} AS report_type, {first(f"{summary} AND {_has('보고사유')}")} AS report_reason,
 {first(f"{summary} AND {_has('보유목적')}")} AS sp, coalesce({total}) AS ts, coalesce(nullif({first(f"{who} AND {_has('이번보고서>보고자')}")}, ''), nullif({first(f"{who} AND {_has('직전보고서>보고자')}")}, '')) AS holder_name,
 coalesce({_num(first(f"{_has('보유잠재주식의수')} AND {filled}"))}, 0) AS lat, {first(_has("보고서작성기준일"))} AS bd, {first(_has("보고의무발생일"))} AS od FROM i GROUP BY 1, 2)
SELECT doc_id, form, holder_name, report_type, report_reason, coalesce(nullif(sp, ''), CASE WHEN form = '일반' THEN '경영권 영향' END) AS purpose, prev_shares, prev_ratio, cs AS curr_shares, cr AS curr_ratio, ts AS total_shares,
 CASE WHEN coalesce(cs, 0) <> 0 AND coalesce(ts, 0) <> 0 AND cr IS NOT NULL THEN round(cs / ts * 100, 3) END AS ratio_calc,
 CASE WHEN coalesce(cs, 0) <> 0 AND coalesce(ts, 0) <> 0 AND cr IS NOT NULL THEN ({near("cs / ts * 100")} OR (lat <> 0 AND {near("cs / (ts + lat) * 100")}))::INT END AS ratio_match, {_day("bd", True)} AS base_date, {_day("od", True)} AS obligation_date FROM g
"""
