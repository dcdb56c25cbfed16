"""Mixing sources to target weights: each source gets its share of all tokens.

Method: Pareto order sampling. The copies a document is due are its source's target over the tokens there are;
whole copies are allocated to every document of the source for certain, and the fraction left is its inclusion
probability p. Documents are ranked by random odds over inclusion odds, u/(1-u) / (p/(1-p)), and the first ones
are taken until the source has its tokens. An optional weight column makes the probabilities unequal inside a source:
copies due are then proportional to it, up to the cap.

Scale: token counts are one pass over the texts; ranking cuts a histogram of ``BUCKETS`` rank buckets a source
first, and only the rows of the one bucket that the cut falls into are sorted. No source is gathered in one task.

Cases: documents without tokens, with a null id or of a source without a target aren't taken (sources are compared in
lower case with blanks and hyphens as underscores); a source without tokens is left out and the other shares are
kept in proportion; rows repeated with one id are rows of their own; ties in rank go by id; other columns don't
matter, and an n_tokens column of the input is replaced; no input, no mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyeol.session import busy, cut_lineage, ship_package

BUCKETS = 4096
#: Bound of the target table, a configuration that is read to the driver.
MAX_SOURCES = 10_000
#: Weights are solved for in classes of this many to the power of two.
PER_OCTAVE = 16
#: Distinct words whose token counts a worker keeps.
CACHE = 200_000


def tokenizer_file(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """(path, split pattern) of an installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_")


def token_counter(ranks: bytes, pattern: str):
    """text -> number of tokens, exact, with counts of words kept.

    No token of the pattern spans a place where a blank or line end follows another character that isn't white
    space, so a text's count is the sum over its blank-led words.
    """
    import base64
    import re

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
    word, odd = re.compile(r"[ \n]*[^ \n]+|[ \n]+"), re.compile(r"[^\S \n]")

    class Kept(dict):
        def __missing__(self, w: str) -> int:
            if len(self) >= CACHE:
                self.clear()
            n = self[w] = len(encode(w))
            return n

    kept = Kept()

    def count(text: str) -> int:
        if not odd.search(text):
            return sum(map(kept.__getitem__, word.findall(text)))
        # other white space may touch a blank: cut only where neither side is white space but that blank
        parts = re.findall(r"\s*\S+|\s+", text)
        return sum(map(kept.__getitem__, parts))

    return count


def count_tokens(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without its text but with n_tokens. The vocabulary file is read once and sent to the workers."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c not in (text, "n_tokens")]

    def run(batches):
        import pyarrow as pa

        count = token_counter(shared.value, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            n = pa.array([count(t) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in rest] + [n], names=[*rest, "n_tokens"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in rest)
    return busy(docs).mapInArrow(run, f"{fields}, n_tokens long")


def _solve(classes: list[tuple[float, int]], target: float, cap: int) -> float:
    """c with sum(min(cap, c * weight) * tokens) = target, by bisection over weight classes."""
    lo, hi = 0.0, 1.0
    got = lambda c: sum(min(cap, c * w) * n for w, n in classes)
    while got(hi) < target * (1 - 1e-12) and hi < 1e18:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if got(mid) < target else (lo, mid)
    return hi


def mix(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, weight: str | None = None, part: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): mix has doc_id, source, n_tokens, copies >= 1; shares has a row a source.

    ``tokens`` has doc_id, source, n_tokens; ``targets`` has source, target_share, max_repeat. Without
    ``total_tokens`` the mix is ``part`` of the largest that the caps allow with all shares met.
    """
    spark = tokens.sparkSession
    rows = targets.where("source is not null and target_share > 0 and max_repeat > 0").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("the target table has too many sources")
    wanted = {r.source: (float(r.target_share), int(r.max_repeat)) for r in rows}
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = tokens.select("doc_id", source_key(F.col("source")).alias("source"), "n_tokens", own.alias("weight"))
    step = F.round(F.log2("weight") * PER_OCTAVE) / PER_OCTAVE
    base = cut_lineage(base.withColumn("weight", F.when(F.col("weight") > 0, F.pow(F.lit(2.0), F.greatest(F.least(step, F.lit(32.0)), F.lit(-32.0))))))
    live = base.where(F.col("source").isin(list(wanted) or [""]) & F.col("doc_id").isNotNull() & F.col("weight").isNotNull() & (F.col("n_tokens") > 0))
    classes: dict[str, list[tuple[float, int]]] = {}
    for r in live.groupBy("source", "weight").agg(F.sum("n_tokens").alias("n")).collect():  # at most sources x weight classes
        classes.setdefault(r.source, []).append((r.weight, r.n))
    there = {s: sum(n for _, n in c) for s, c in classes.items()}
    whole = sum(wanted[s][0] for s in there)
    most = min((there[s] * wanted[s][1] * whole / wanted[s][0] for s in there), default=0)
    total = most * part if total_tokens is None else min(most, total_tokens)
    plan = [(s, wanted[s][0], wanted[s][1], total * wanted[s][0] / whole, _solve(classes[s], total * wanted[s][0] / whole, wanted[s][1])) for s in sorted(there)]
    plan_df = spark.createDataFrame(plan, "source string, target_share double, max_repeat int, target_tokens double, c double")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
    due = live.join(F.broadcast(plan_df), "source").withColumn("due", F.least(F.col("c") * F.col("weight"), F.col("max_repeat").cast("double")))
    due = due.withColumn("certain", F.least(F.floor(F.col("due") + 1e-9), F.col("max_repeat").cast("long"))).withColumn("p", F.greatest(F.col("due") - F.col("certain"), F.lit(0.0)))
    due = due.withColumn("u", u).withColumn("rank", F.when(F.col("p") > 1e-9, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    due = due.withColumn("bucket", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS), F.lit(BUCKETS - 1)))
    # tokens still to come by chance, and the bucket where a source has them all
    sums = due.groupBy("source").agg((F.first("target_tokens") - F.sum(F.col("certain") * F.col("n_tokens"))).alias("open"))
    by_bucket = due.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = by_bucket.withColumn("upto", F.sum("n").over(w)).join(sums, "source")
    cut = run.where("upto >= open").groupBy("source").agg(F.min("bucket").alias("cut"), F.min_by(F.col("open") - F.col("upto") + F.col("n"), "bucket").alias("room"))
    marked = due.join(F.broadcast(cut), "source", "left")
    edge = Window.partitionBy("source").orderBy("rank", "u", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = marked.where("bucket = cut").withColumn("before", F.coalesce(F.sum("n_tokens").over(edge), F.lit(0)))
    at_edge = at_edge.withColumn("extra", (F.col("before") + F.col("n_tokens") / 2 <= F.col("room")).cast("int")).drop("before")
    others = marked.where("bucket is null or cut is null or bucket <> cut").withColumn("extra", F.coalesce((F.col("bucket") < F.coalesce("cut", F.lit(BUCKETS))).cast("int"), F.lit(0)))
    mixed = others.unionByName(at_edge).withColumn("copies", F.least(F.col("certain") + F.col("extra"), F.col("max_repeat").cast("long")).cast("int"))
    taken = mixed.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("max_copies"), F.sum((F.col("copies") > 0).cast("long")).alias("n_docs"))
    goal = spark.createDataFrame([(s, *wanted[s]) for s in sorted(wanted)], "source string, target_share double, max_repeat int")
    listed = F.when(F.col("source").isin(list(wanted) or [""]), F.col("source")).otherwise("(other)")
    supply = base.groupBy(listed.alias("source")).agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("available_docs"))
    shares = goal.join(supply, "source", "full_outer").join(got, "source", "left")
    all_mixed = F.sum("mixed_tokens").over(Window.partitionBy())  # a row a source: bounded by the target table
    shares = shares.select(
        "source", "target_share", "max_repeat", F.coalesce("available_docs", F.lit(0)).alias("available_docs"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), (F.coalesce("mixed_tokens", F.lit(0)) / all_mixed).alias("actual_share"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"))
    return taken, shares
