"""p2 and p4 said in SQL for the second engine."""

from __future__ import annotations

from gyeol.functions import units as U
from gyeol.functions.readers import NO, YES
from gyeol.plans.units import OWN_ITEM

FULL, HALF = U._FULL, U._HALF.replace("'", "''")
BLANKS = r"[\s\x{00a0}\x{2002}\x{2003}\x{2009}\x{202f}\x{3000}]+"
KO, EN = U._KO, U._EN
WON = rf"(?:(?:krw|원화|₩)\s*)*(?:1,000\s*원|(?:{KO})\s*원?|(?:{EN})\b(?:\s*won)?|won|원)|krw|원화|₩"


def half(c: str) -> str:
    return f"translate({c}, '{FULL}', '{HALF}')"


def _texts(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def scale(u: str) -> str:
    word = rf"regexp_extract({u}, '({KO}|1,000|{EN})', 1)"
    cases = " ".join(f"WHEN '{w}' THEN {f!r}" for w, f in U.SCALES.items() if w not in ("k", "m"))
    return f"CASE WHEN {u} IS NULL OR {u} = '' THEN NULL ELSE CASE {word} {cases} ELSE 1.0 END END"


def stated(c: str) -> str:
    t = rf"regexp_replace(lower({half(c)}), '[,;]?\s*[^,;()\[\]]*(?:미만|이하|절사|반올림|절상|버림)[^,;()\[\]]*', '', 'g')"
    return rf"regexp_extract({t}, '(?:[(\[,]|단위)\s*(?:단위)?\s*[:=]?\s*({WON})\s*[)\]]*\s*$', 1)"


def line(c: str) -> str:
    return rf"regexp_extract(lower({half(c)}), '^(?:.*>)?[\s(\[※*]*(?:금액)?\s*단위\s*[:=]?\s*({WON})\s*[)\]]*\s*$', 1)"


def _currency(c: str, name: str) -> str:
    """(name, factor) columns of a free-form currency text."""
    t = rf"regexp_replace(lower({half(c)}), '\s+', '', 'g')"
    cases = " ".join(f"WHEN '{w}' THEN {f!r}" for w, f in U.SCALES.items())
    first, last = rf"regexp_extract({t}, '^({KO}|{EN})', 1)", rf"regexp_extract({t}, '({KO}|{EN}|m|k)[)\]]?$', 1)"
    short = rf"regexp_extract({t}, '^(?:{KO}|{EN})?(.*?)[(\[]?(?:{KO}|{EN}|m|k)?[)\]]?$', 1)"
    whole = rf"regexp_extract({t}, '^(?:{KO}|{EN})?(.*?)$', 1)"
    isos = " ".join(f"WHEN {{x}} IN ({_texts(xs)}) THEN '{iso}'" for iso, xs in U.CURRENCIES.items())
    iso = f"coalesce(CASE {isos.format(x=whole)} END, CASE {isos.format(x=short)} END)"
    return f"{iso} AS {name}_iso, coalesce(CASE {first} {cases} END, CASE {last} {cases} END, 1.0) AS {name}_factor"


def p2() -> str:
    last = rf"regexp_replace(regexp_replace(regexp_extract({half('item_name')}, '([^>]*)$', 1), '^(?:[0-9]+(?:-[0-9]+)*[.)]|[-ㆍ·ᆞ•※]|\s)+', ''), '\s+', '', 'g')"
    own = " ".join(rf"WHEN regexp_matches(l, '^{p}(?:$|[(\[])') THEN '{k}'" for k, p in OWN_ITEM.items())
    label = " ".join(f"WHEN starts_with(s, '{k}') THEN '{k}'" for k in OWN_ITEM)
    inner = rf"regexp_extract({half('item_name')}, '[(\[]\s*(?:단위\s*[:=]?)?\s*([^()\[\]]+)[)\]]\s*$', 1)"
    whole = lambda v, f: f"round({v}::DECIMAL(28,6) * ({f})::DECIMAL(19,0) / 1, 0)::BIGINT"
    clause = rf"regexp_extract(lower({half('note')}), '(?:시가총액|시총|market\s*cap(?:italization)?|mkt\s*cap)([^;/]*)', 1)"
    return f"""
WITH r AS (SELECT doc_id, seq, loaded_at, item_name, trim(coalesce(item_value, '')) = '' AS b, {last} AS l FROM major_item WHERE NOT contains(item_name, '정정전')),
k AS (SELECT *, CASE WHEN b AND contains(item_name, '단위') THEN '#line' {own} WHEN regexp_matches(l, '(?:해외발행|해외)\\)?총액|해외발행\\)총액') THEN '#overseas' END AS kind, {inner} AS inner_text FROM r),
c AS (SELECT *, {_currency("inner_text", "i")}, {line("item_name")} AS lu, {stated("item_name")} AS su FROM k WHERE kind IS NOT NULL),
z AS (SELECT doc_id, kind, seq, loaded_at, CASE kind WHEN '#line' THEN {scale("lu")} WHEN '#overseas' THEN CASE WHEN i_iso IS NOT NULL THEN i_factor END ELSE {scale("su")} END AS f FROM c),
g AS (SELECT doc_id, kind, arg_max(f, (loaded_at, seq)) AS f FROM z WHERE f IS NOT NULL GROUP BY 1, 2),
m AS (SELECT e.*, regexp_replace({half("amount_src")}, '\\s+', '', 'g') AS s, {stated("amount_src")} AS ru, CASE WHEN amount_foreign IS NULL THEN regexp_extract(lower({half("currency")}), '^\\s*({WON})\\s*$', 1) END AS cu, {_currency("currency", "c")} FROM event_major e),
n AS (SELECT m.*, coalesce({scale("ru")}, {scale("cu")}) AS rf, CASE {label} END AS own FROM m),
i AS (SELECT n.id, arg_min(u.x, r) AS best, min(r) AS r FROM (SELECT n.id, u.x, coalesce(abs(ln(amount_krw * u.x / use_total)), 0) + coalesce(abs(ln(amount_krw * u.x / shares_common / price_share)), 0) AS r,
  (use_total IS NOT NULL)::INT + (shares_common * price_share IS NOT NULL)::INT AS k FROM n, (VALUES (1.0), (1e3), (1e6), (1e8), (1e9), (1e12)) u(x) WHERE amount_krw > 0 AND (use_total > 0 OR shares_common * price_share > 0)) q JOIN n USING (id) JOIN (VALUES (1.0), (1e3), (1e6), (1e8), (1e9), (1e12)) u(x) ON u.x = q.x
  GROUP BY n.id HAVING min(r / k) <= 0.35),
w AS (SELECT n.*, coalesce(rf, a.f, b.f, i.best, 1.0) AS wf, CASE WHEN c_factor <> 1 THEN c_factor ELSE coalesce(o.f, 1.0) END AS ff FROM n LEFT JOIN g a ON a.doc_id = n.doc_id AND a.kind = own
  LEFT JOIN g b ON b.doc_id = n.doc_id AND b.kind = '#line' LEFT JOIN g o ON o.doc_id = n.doc_id AND o.kind = '#overseas' LEFT JOIN i ON i.id = n.id)
SELECT DISTINCT * FROM (SELECT 'amount_krw' AS field, id::VARCHAR AS row_key, 'KRW' AS unit, {whole("amount_krw", "wf")} AS unit_value FROM w WHERE amount_krw IS NOT NULL AND wf <> 1
UNION ALL SELECT 'amount_foreign', id::VARCHAR, c_iso, {whole("amount_foreign", "ff")} FROM w WHERE amount_foreign IS NOT NULL AND c_iso IS NOT NULL AND (currency <> c_iso OR ff <> 1)
UNION ALL SELECT 'market_cap', corp_code, 'KRW', {whole("market_cap", f"coalesce({scale('nu')}, 1e8)")} FROM (SELECT *, regexp_extract({clause}, '({WON})', 1) AS nu FROM company) WHERE market_cap IS NOT NULL)
"""


def label_key_sql() -> str:
    """Comparable form of an attribute: the last part of its path without blanks, numbering and bullets."""
    lead = r"^(?:\(?[0-9]+(?:-[0-9]+)*[.)]|\(?[가-하][.)]|[①-⑳]|[-ㆍ·ᆞ•‧∙・○●□■※*])+"
    return rf"regexp_replace(regexp_replace(regexp_extract({half('item_name')}, '([^>]*)$', 1), '{BLANKS}', '', 'g'), '{lead}', '')"


def _p4_cells() -> str:
    """CTEs up to v: one row an item of a field, with its value x as text."""
    key = label_key_sql()
    tight = rf"regexp_replace({half('item_value')}, '[\s,]+', '', 'g')"
    shape = "^(?:([0-9]+)조)?(?:([0-9]+)억)?(?:([0-9]+)만)?([0-9]+)?(?:원|주|명|개|건|회)?$"
    part = lambda k: f"coalesce(try_cast(regexp_extract(t, '{shape}', {k}) AS HUGEINT), 0)"
    number = f"CASE WHEN regexp_matches(t, '{shape}') AND regexp_matches(t, '[0-9]') THEN try_cast({part(1)} * 1000000000000 + {part(2)} * 100000000 + {part(3)} * 10000 + {part(4)} AS BIGINT)::VARCHAR END"
    ratio = "round(try_cast(nullif(regexp_extract(t, '^([-+]?[0-9]+(?:[.][0-9]+)?)%?$', 1), '') AS DECIMAL(30,10)), 2)::DECIMAL(18,2)::VARCHAR"
    spelled = "regexp_replace(regexp_extract(d, '^[''’‘`]?((?:[0-9]{2})?[0-9]{2}[-./년][0-9]{1,2}[-./월][0-9]{1,2})[.일]?(?:[(][월화수목금토일][)])?$', 1), '[./년월]', '-', 'g')"
    date = f"strftime(coalesce(try_strptime(CASE WHEN length(split_part({spelled}, '-', 1)) = 2 THEN '20' ELSE '' END || {spelled}, '%Y-%m-%d'), try_strptime(regexp_extract(d, '^([0-9]{{8}})$', 1), '%Y%m%d')), '%Y%m%d')"
    trimmed = rf"regexp_replace(item_value, '^{BLANKS}|{BLANKS}$', '', 'g')"
    text = f"CASE WHEN {trimmed} NOT IN ('', '-', '–', '—', '―', 'N/A', '해당사항 없음') THEN {trimmed} END"
    flag = f"CASE WHEN upper(t) IN ({_texts(YES)}) THEN '1' WHEN upper(t) IN ({_texts(NO)}) THEN '0' END"
    src = " UNION ALL ".join(
        f"SELECT '{n}' AS source_table, doc_id, seq, item_name, item_value, {sec} AS ok FROM {n} WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY loaded_at DESC, id DESC) = 1"
        for n, sec in (("contract_item", "true"), ("major_item", "true"), ("holding_item", "section = 'summary'"))
    )
    return f"""
WITH live AS (SELECT * FROM ({src}) WHERE ok AND item_value IS NOT NULL),
m AS (SELECT l.source_table, l.doc_id, l.seq, l.item_value, w.field, w.value_type, {tight} AS t, regexp_replace({half("item_value")}, '\\s+', '', 'g') AS d FROM live l JOIN wide_field w ON w.source_table = l.source_table AND replace(w.label, ' ', '') = {key}),
v AS (SELECT *, CASE value_type WHEN 'number' THEN {number} WHEN 'ratio' THEN {ratio} WHEN 'date' THEN {date} WHEN 'flag' THEN {flag} WHEN 'text' THEN {text} END AS x FROM m)
"""


def p4() -> str:
    return f"{_p4_cells()} SELECT source_table, doc_id, field, arg_max(x, seq) AS typed_value FROM v WHERE x IS NOT NULL AND value_type <> 'text' GROUP BY 1, 2, 3"


#: The fields of each wide table with their types, as wide_field has them.
WIDE = {
    "contract_item": {"amount": "number", "base_amount": "number", "end_date": "date", "large_corp": "flag", "party": "text", "ratio": "ratio", "signed_at": "date", "start_date": "date"},
    "major_item": {"auditor": "flag", "coupon": "ratio", "decided_at": "date", "maturity": "date", "new_shares": "number", "outside_dirs": "number", "pay_date": "date", "share_price": "number", "yield_rate": "ratio"},
    "holding_item": {"base_date": "date", "curr_ratio": "ratio", "curr_shares": "number", "duty_date": "date", "prev_ratio": "ratio", "prev_shares": "number"},
}


def p4_wide(name: str) -> str:
    cast = {"number": "{}::BIGINT", "ratio": "{}::DECIMAL(18,2)", "flag": "{}::INT", "text": "{}", "date": "strptime({}, '%Y%m%d')::DATE"}
    value = lambda f: f"arg_max(x, seq) FILTER (WHERE field = '{f}')"
    columns = ", ".join(f"{cast[kind].format(value(f))} AS {f}" for f, kind in WIDE[name].items())
    return f"{_p4_cells()} SELECT doc_id, {columns} FROM v WHERE x IS NOT NULL AND source_table = '{name}' GROUP BY doc_id"
