"""Queries give a result for every row, whatever characters it holds: fixtures that a cut of the input would lose."""

import re

from gyeol.plans import registry

ODD = [None, "", "４．７８", "１７７，２００", "－５", "1,234", "12%", "１２％", "-", "–", "금액ㆍ기타", "Zané", "²", "　７　", "5\xa0", "2024년 3월 1일", "２０２４．０３．１２", "2024·03·12", "20240312", "2025년 08년 28일", "２０２４－１３－０１"]


def plain(v):
    """Full-width ASCII and blanks in their plain form, letter by letter."""
    return "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else " " if c in "　\xa0" else c for c in v)


def items(spark, folder, name):
    rows = [(i, "d", i, "n", v) for i, v in enumerate(ODD)]
    spark.createDataFrame(rows, "id long, doc_id string, seq int, item_name string, item_value string").write.parquet(f"{folder}/{name}.parquet")
    return registry.queries()


def test_amount_parse_reads_every_item(spark, tmp_path):
    got = {r.id: (r.whole, r.real_value, r.num) for r in items(spark, tmp_path, "major_item")["amount_parse"](spark, str(tmp_path)).collect()}

    def brute(v):
        if v is None:
            return (None, None, None)
        t = plain(v).replace(",", "").strip()
        number = lambda x: float(x) if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", x) else None
        return (int(t) if re.fullmatch(r"-?[0-9]+", t) else None, number(t.replace("%", "").strip()), number(t))

    assert got == {i: brute(v) for i, v in enumerate(ODD)}


def test_date_parse_reads_every_item(spark, tmp_path):
    got = {r.id: (r.loose, r.strict, r.pointer) for r in items(spark, tmp_path, "contract_item")["date_parse"](spark, str(tmp_path)).collect()}
    patterns = [r"(\d{4})[-.년\s]*(\d{1,2})[-.월\s]*(\d{1,2})", r"(\d{4})\s*[-.년]\s*(\d{1,2})\s*[-.월]\s*(\d{1,2})", r"(\d{4})\s*[-.년월]\s*(\d{1,2})\s*[-.년월]\s*(\d{1,2})"]

    def brute(v):
        out = []
        for k, p in enumerate(patterns):
            m = re.search(p, plain(v or ""))
            y, mo, d = map(int, m.groups()) if m else (0, 0, 0)
            out.append(f"{m[1]}{mo:02}{d:02}" if 1 <= mo <= 12 and 1 <= d <= 31 and (k < 2 or 2000 <= y <= 2030) else None)
        return tuple(out)

    assert got == {i: brute(v) for i, v in enumerate(ODD)}
