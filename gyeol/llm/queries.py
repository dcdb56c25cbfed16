"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyeol.llm import canon, leakage, mixing, oracle, pieces, subjects, survivors
from gyeol.session import table


def _p1_rows(spark: SparkSession, d: str) -> DataFrame:
    """(field, scope, key, raw, in_a, in_b, canon) of all texts that p1 compares, one pass over each table."""
    ec, doc = table(spark, d, "event_contract"), table(spark, d, "document")
    yes, no, whole = F.lit(True), F.lit(False), F.lit("")
    take = lambda df, field, key, raw, in_a, in_b, scope=whole: df.select(F.lit(field).alias("field"), scope.alias("scope"), key.alias("key"), F.col(raw).alias("raw"), in_a.alias("in_a"), in_b.alias("in_b"))
    parts = [
        take(ec, "title", F.col("id"), "title", yes, yes, F.col("corp_code")),
        take(ec, "counterparty", F.col("id"), "counterparty", no, yes),
        take(table(spark, d, "party"), "counterparty", F.col("party_id"), "party_name", yes, no),
        take(table(spark, d, "raw_folder"), "file_path", F.col("folder_id"), "listed_path", yes, no),
        take(doc, "file_path", F.col("rcept_no").try_cast("long"), "file_path", no, yes),
    ]
    return canon.with_canonical(reduce(DataFrame.unionByName, parts), "raw", "canon")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _p1_rows(spark, d).where("raw is not null and key is not null and scope is not null")
    pairs = canon.look_alike_pairs(rows, ["field", "scope"])
    return pairs.where("field <> 'title' or key_a < key_b").select("field", "key_a", "key_b").distinct()


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every text of the compared fields with its consistent form."""
    return _p1_rows(spark, d).select("field", "key", "raw", "canon")


def _contract_versions(spark: SparkSession, d: str) -> DataFrame:
    """event_contract with its group key and the receipt date of its document, one row each."""
    ec = table(spark, d, "event_contract")
    ec = canon.with_canonical(ec, "title_norm", "title_key")
    dates = table(spark, d, "document").groupBy("doc_id").agg(F.max_by("rcept_dt", "loaded_at").alias("rcept_dt"))
    return ec.join(dates, "doc_id", "left")


CONTRACT_KEYS = ["corp_code", "event_type", "title_key"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ec = _contract_versions(spark, d)
    rows = ec.select(*CONTRACT_KEYS, "id", "rcept_dt", "is_correction", "loaded_at", "amount_krw", "ratio_match", "start_date", "end_date")
    order = [F.col(c).desc_nulls_last() for c in ("rcept_dt", "is_correction", "loaded_at", "id")]
    criteria = {
        "keep": F.lit(True),
        "amount": (F.col("amount_krw") > 0) & (F.col("ratio_match").isNull() | (F.col("ratio_match") != 0)),
        "end": survivors.real_day("end_date") & (F.col("start_date").isNull() | (F.col("end_date") >= F.col("start_date"))),
    }
    out = survivors.ranked_survivors(rows, CONTRACT_KEYS, order, criteria, "id").where("group_rows > 1")
    return out.select(*[F.coalesce(F.col(f"{n}.id"), F.lit(-1)).cast("long").alias(f"{n}_id") for n in criteria])


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record for every contract, with every column of event_contract: each field's newest usable value.

    A row with a null in its key is a record of its own. Ratios of rows whose ratio matches come before others.
    """
    ec = _contract_versions(spark, d)
    order = F.struct(F.coalesce("rcept_dt", F.lit("")), F.coalesce("is_correction", F.lit(-1)), F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp_ntz")), "id")
    trusted = F.col("ratio_match").isNull() | (F.col("ratio_match") != 0)
    paid = trusted & (F.col("amount_krw").isNull() | (F.col("amount_krw") > 0))
    special = {"id": F.lit(True), "amount_krw": (F.col("amount_krw") > 0) & trusted, "amount_fixed": paid & (F.col("amount_fixed") > 0), "amount_cond": paid & (F.col("amount_cond") >= 0), "ratio_stated": trusted & F.col("ratio_stated").isNotNull()}
    special |= {"end_date": survivors.real_day("end_date") & (F.col("start_date").isNull() | (F.col("end_date") >= F.col("start_date"))), "start_date": survivors.real_day("start_date"), "signed_at": survivors.real_day("signed_at"), "hold_until": survivors.real_day("hold_until")}
    plain = [c for c in ec.columns if c not in special and c not in CONTRACT_KEYS and c != "rcept_dt"]
    fields = special | {c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") & (F.col(c).cast("string") != "-") for c in plain}
    return survivors.best_values(ec, CONTRACT_KEYS, order, fields, uid="id", prefer={"ratio_calc": trusted, "ratio_match": trusted})


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized section of holding_item, each with its document's file_path."""
    rows = table(spark, d, "holding_item").select("doc_id", "section", "seq", "item_name", "item_value", "loaded_at", "id")
    paths = table(spark, d, "document").groupBy("doc_id").agg(F.max_by("file_path", "loaded_at").alias("file_path"))
    return pieces.split_sections(rows, paths)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Sections that came out as more than one piece."""
    return p3_pieces(spark, d).where("piece_no = 2").select("doc_id", "section")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Leaking documents with the leaked spans removed."""
    return leakage.remove_spans(table(spark, d, "documents"), _leaks(spark, d))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tokens = mixing.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"), *mixing.tokenizer_file())
    return mixing.mix(tokens, table(spark, d, "mix_target"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: each document taken, with its copies."""
    return _mix(spark, d)[0]


def p7_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The mix with unequal probabilities inside a source: a document's copies are in proportion to the root of its size."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.sqrt(F.greatest(F.length("text"), F.lit(1))).alias("quality"))
    tokens = mixing.count_tokens(docs, *mixing.tokenizer_file())
    targets = table(spark, d, "mix_target")
    # half of what the caps would allow, so that probabilities have room on both sides
    return mixing.mix(tokens, targets, part=0.5, weight="quality")[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source was to contribute and does."""
    return _mix(spark, d)[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    per = subjects.assign_subjects(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "subject_label"))
    found = per.select("doc_id", F.explode("subjects").alias("subject")).distinct()
    # labelled documents are taken out of the narrow result by a shuffle of ids; they grow with the corpus, so they aren't broadcast
    return found.join(table(spark, d, "subject_label").select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by subject: documents and characters of each; a document with several subjects is split evenly."""
    per = subjects.assign_subjects(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "subject_label"))
    per = per.withColumn("part", 1.0 / F.greatest(F.size("subjects"), F.lit(1)))
    rows = per.select("doc_id", "n_chars", "part", F.explode(F.when(F.size("subjects") > 0, F.col("subjects")).otherwise(F.array(F.lit("none")))).alias("subject"))
    return rows.groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_chars") * F.col("part")).alias("n_chars"))


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the subjects on labelled documents that nothing was fitted on, with the thresholds found."""
    return subjects.quality(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "subject_label"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_canonical": p1_canonical, "p3_found": p3_found, "p3_pieces": p3_pieces, "p5_found": p5_found, "p5_survivors": p5_survivors, "p6_found": p6_found, "p6_cleaned": p6_cleaned, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_weighted": p7_weighted, "p8_found": p8_found, "p8_composition": p8_composition, "p8_quality": p8_quality}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
