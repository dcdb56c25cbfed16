"""Subject areas of each document: which subjects its paragraphs are about.

Method: weighted subject terms are matched with a multi-pattern automaton in one pass over every paragraph; a term inside
a longer matched term doesn't count. Terms are the curated ones of ``subject_terms``, which are priors, and the words and
pairs of words that labelled documents show to belong to a subject. A term's weight for a subject is the share of its
sentences that are about the subject, with the curated weight as a prior, times its rarity in the whole corpus: full where at
most ``RARE`` of the documents have it, less with the logarithm of how many do. A sentence scores the sum of its weights
over a length norm, ``1 - NORM + NORM x length / mean length``; it is about a subject from
``score`` on, unless another subject scores far higher in it (``DOMINANT``). A paragraph
of three or more sentences is about every subject of at least ``sentences`` and at least ``share`` of its sentences. A
document has the subjects of its paragraphs. All three thresholds are calibrated on labelled documents.

Labelled documents: at most ``SAMPLE`` of them, by hash of the id, are read; one half fits weights, a quarter calibrates thresholds, and the
last quarter is used by neither but only measured (``quality``). Document frequencies and the mean length are those of all documents.

Paragraphs end at blank lines. Label lines (cells divided by ``|``) aren't sentences. Characters are brought to one form
first, case doesn't matter. Whole texts, one pass over them; everything after it runs on narrow rows of term numbers.

Cases: null or empty texts have no subject, rows with a null id are left out; repeated rows give repeated results; other
columns don't matter; an empty table gives an empty result; without labels the curated weights and ``DEFAULT`` thresholds hold.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyeol.llm import canon
from gyeol.llm.subject_terms import PRIOR, SUBJECT_TERMS
from gyeol.session import busy, cut_lineage, ship_package

#: Labelled documents that are read at the most, for fitting, calibrating and measuring together.
SAMPLE = 4_000
#: Learned terms of a subject at the most: the size of the fitted model, the heaviest first.
MAX_TERMS = 1_000
#: Sentences that a curated weight counts as, and that doubt about a learned term counts as.
TRUST, DOUBT = 8.0, 2.0
#: Least weight of a learned term and least number of labelled documents that have it.
LEAST_WEIGHT, LEAST_DOCS = 0.5, 3
#: Share of documents up to which a term is as rare as can be, and how much length counts.
RARE, NORM = 0.01, 0.5
#: Sentences that make a paragraph, by the definition of the problem.
PARAGRAPH = 3
#: Share of its best subject's score that a subject needs in a sentence.
DOMINANT = 0.75
NONE = "none"
#: Thresholds (score, sentences, share) tried, and those that hold without labels.
GRID = [(score, n, share) for score in (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7, 0.9) for n in (1, 2, 3, 4) for share in (0.0, 0.34, 0.5, 0.6)]
DEFAULT = (0.2, 2, 0.5)
HITS = "doc_id long, n_chars long, par array<int>, of array<int>, sent array<int>, len array<int>, term array<int>"
_BREAK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_PLAIN = re.compile(r"[\x00-\x7f가-힣■※<>]*")
_END = re.compile(r"[.!?。](?=\s|$)|\n")
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)*|[가-힣]+")
#: Endings that are cut from a Korean word before it is a candidate term.
_ENDING = re.compile(r"(?<=..)(?:에서는|으로는|에서|에게|으로|까지|부터|보다|이나|에는|은|는|이|가|을|를|의|에|와|과|도|로|만)$")


@dataclass
class Model:
    """Terms in the order of their numbers, with the weight of each for its subjects."""

    terms: list[str]
    weights: list[dict[str, float]]
    thresholds: tuple[float, int, float] = DEFAULT
    mean_length: float = 50.0
    learned: set[str] = field(default_factory=set)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for i, t in enumerate(self.terms):
            a.add_word(t, (len(t), i))
        if self.terms:
            a.make_automaton()
        return a


def curated() -> dict[str, dict[str, float]]:
    """term -> subject -> prior weight; a term of several subjects is divided among them."""
    out: dict[str, dict[str, float]] = defaultdict(dict)
    for subject, kinds in SUBJECT_TERMS.items():
        for kind, terms in kinds.items():
            for t in terms:
                out[t.lower()][subject] = PRIOR[kind]
    return {t: {s: w / len(own) for s, w in own.items()} for t, own in out.items()}


def paragraphs(text: str) -> list[str]:
    """Paragraphs in one character form and lower case, without label lines; a wrapped line continues its sentence."""
    out = []
    for block in _BREAK.split(text):
        joined = ""
        for line in block.split("\n"):
            line = line.strip()
            if not line or "|" in line:
                continue
            joined += ("" if not joined else "\n" if joined[-1] in ".!?。" else " ") + line
        if joined:
            out.append(("\n".join(map(canon.fold_text, joined.split("\n"))) if not _PLAIN.fullmatch(joined) else joined).lower())
    return out


def sentence_ends(paragraph: str) -> list[int]:
    ends = [m.end() for m in _END.finditer(paragraph)]
    if not ends or ends[-1] < len(paragraph):
        ends.append(len(paragraph))
    return ends


def _counted(ends: list[int], paragraph: str) -> int:
    """Sentences of a paragraph: stretches with a letter or digit."""
    return sum(1 for a, b in zip([0, *ends], ends, strict=False) if any(map(str.isalnum, paragraph[a:b])))


def term_hits(paragraph: str, automaton) -> list[tuple[int, int]]:
    """(place, term number) of the longest terms that start a word."""
    hits: list[tuple[int, int, int]] = []
    if not len(automaton):
        return []
    for end, (n, i) in automaton.iter(paragraph):
        start = end - n + 1
        if start and paragraph[start - 1].isalnum() or paragraph[end].isascii() and n < 5 and end + 1 < len(paragraph) and paragraph[end + 1].isascii() and paragraph[end + 1].isalpha():
            continue  # inside a word, or a short Latin word that goes on
        while hits and hits[-1][0] >= start:
            hits.pop()  # the longer term of two that share a place
        if not hits or hits[-1][1] <= start:
            hits.append((start, end + 1, i))
    return [(start, i) for start, _, i in hits]


def text_hits(text: str, automaton) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Of each term found: number of its paragraph, that paragraph's sentences, its sentence, the sentence's length, the term."""
    out: tuple[list[int], ...] = ([], [], [], [], [])
    for p, paragraph in enumerate(paragraphs(text)):
        hits = term_hits(paragraph, automaton)
        if not hits:
            continue
        ends = sentence_ends(paragraph)
        n = _counted(ends, paragraph)
        k = 0
        for start, i in hits:
            while ends[k] <= start:
                k += 1
            for column, x in zip(out, (p, n, k, ends[k] - (ends[k - 1] if k else 0), i), strict=True):
                column.append(x)
    return out


# ---- fitting ---------------------------------------------------------------------------------------
def candidates(sentence: str) -> set[str]:
    """Words and pairs of neighbouring words of a sentence, without endings."""
    found, before = set(), None
    for m in _WORD.finditer(sentence):
        word = m.group()
        stem = _ENDING.sub("", word)
        if len(stem) >= (3 if stem.isascii() else 2):
            found.add(stem)
        if before and sentence[before.end() : m.start()] == " ":
            found.add(f"{before.group()} {stem}")
        before = m
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, labels, part) of at most ``size`` labelled documents: parts 0 and 1 fit, 2 calibrates, 3 is held out."""
    own = labels.where("doc_id is not null and subject is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_set("subject")).alias("labels"))
    ids = own.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(size).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(4)).cast("int"))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(ids), "doc_id")  # at most ``size`` short rows


def _posterior(paragraph_sums: dict[str, float], labels: list[str]) -> dict[str, float]:
    """How a paragraph's sentences are credited to the labels of its document."""
    total = {s: paragraph_sums.get(s, 0.0) + 0.05 for s in labels}
    norm = sum(total.values())
    return {s: x / norm for s, x in total.items()}


def _credits(sample: DataFrame, model: Model) -> DataFrame:
    """(term, subject, sentences, docs): sentences with each candidate, credited to the labels of their documents."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        automaton = own.automaton()
        known = set(own.terms)
        for batch in batches:
            sums: dict[tuple[str, str], float] = defaultdict(float)
            docs: Counter = Counter()
            for text, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: set[str] = set()
                for paragraph in paragraphs(text):
                    hits = [i for _, i in term_hits(paragraph, automaton)]
                    score: dict[str, float] = defaultdict(float)
                    for i in hits:
                        for s, w in own.weights[i].items():
                            score[s] += w
                    credit = _posterior(score, labels)
                    ends = sentence_ends(paragraph)
                    for a, b in zip([0, *ends], ends, strict=False):
                        sentence = paragraph[a:b].strip()
                        if sentence[-1:] not in (".", "!", "?", "。"):
                            continue
                        found = candidates(sentence) | {own.terms[i] for _, i in term_hits(sentence, automaton)}
                        seen |= found
                        for t in found:
                            for s, x in credit.items():
                                sums[t, s] += x
                docs.update(seen)
            rows = [(t, s, x, docs[t]) for (t, s), x in sums.items() if docs[t] or t in known]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = [pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["term", "subject", "sentences", "docs"])

    part = busy(sample.select("text", "labels")).mapInArrow(run, "term string, subject string, sentences double, docs long")
    return part.groupBy("term", "subject").agg(F.sum("sentences").alias("sentences"), F.sum("docs").alias("docs"))


def _next_model(sample: DataFrame, model: Model) -> Model:
    """Weights from one reading of the sample. Only terms that can enter the model reach the driver, at most MAX_TERMS a subject."""
    from pyspark.sql import Window

    prior = curated()
    credits = _credits(sample, model)
    whole = Window.partitionBy("term")
    rows = credits.withColumns({"all": F.sum("sentences").over(whole), "n_docs": F.max("docs").over(whole)})
    rows = rows.withColumn("share", F.col("sentences") / (F.col("all") + F.lit(DOUBT)))
    mine = F.col("term").isin(list(prior))
    top = Window.partitionBy("subject").orderBy(F.col("weighty").desc(), "term")
    fit = (F.col("n_docs") >= LEAST_DOCS) & (F.col("share") >= LEAST_WEIGHT) & (F.col("subject") != NONE) & ~mine
    learned = rows.where(fit).withColumn("weighty", F.col("share") * F.log2(1 + F.col("all"))).withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= MAX_TERMS)
    weights: dict[str, dict[str, float]] = {t: dict(own) for t, own in prior.items()}
    for r in rows.where(mine).select("term", "subject", "sentences", "all").collect():  # curated terms x subjects
        have = prior[r.term].get(r.subject, 0.0)
        w = (r.sentences + TRUST * have) / (r["all"] + TRUST)
        if r.subject != NONE and w >= 0.1:
            weights[r.term][r.subject] = w
        else:
            weights[r.term].pop(r.subject, None)
    got = {(r.term, r.subject): r.share for r in learned.select("term", "subject", "share").collect()}
    of_word: dict[str, dict[str, float]] = defaultdict(dict)
    for (term, subject), share in [*got.items(), *(((t, s), w) for t, own in weights.items() for s, w in own.items())]:
        of_word[term][subject] = max(share, of_word[term].get(subject, 0.0))
    for (term, subject), share in got.items():
        words = {y for x in term.split(" ") for y in (x, _ENDING.sub("", x))} if " " in term else set()
        alone = max((of_word[x].get(subject, 0.0) for x in words if x in of_word), default=0.0)
        other = any(s != subject for x in words if x in of_word for s in of_word[x])
        # a pair that says no more than one of its words is that word in some company, unless the other word speaks for another subject
        if alone < 0.8 * share or other:
            weights.setdefault(term, {})[subject] = share
    terms = sorted(weights)
    return Model(terms, [weights[t] for t in terms], learned=set(terms) - set(prior))


def fit_weights(sample: DataFrame, rounds: int = 2) -> Model:
    """Weights fitted on parts 0 and 1: the first round credits sentences by the curated terms, the next by what was learned."""
    prior = curated()
    terms = sorted(prior)
    model = Model(terms, [prior[t] for t in terms])
    half = sample.where("part < 2")
    for _ in range(rounds):
        model = _next_model(half, model)
    return model


# ---- matching and scoring --------------------------------------------------------------------------
def find_terms(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row a document: its length and, side by side, where which term is. The one pass over the texts."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton = shared.value.automaton()
        ints = pa.list_(pa.int32())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [text_hits(t, automaton) if t else ([],) * 5 for t in texts]
            columns = [pa.array([f[k] for f in found], ints) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or "") for t in texts], pa.int64()), *columns], names=["doc_id", "n_chars", "par", "of", "sent", "len", "term"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return busy(source).mapInArrow(run, HITS)


def with_rarity(hits: DataFrame, model: Model) -> Model:
    """The model with weights times rarity and the mean length of sentences, both over all documents."""
    n = hits.count()
    distinct = hits.select(F.explode(F.array_distinct("term")).alias("term")).groupBy("term").count()
    df = {r.term: r["count"] for r in distinct.collect()}  # at most a row a term of the model
    mean = hits.select(F.explode("len").alias("len")).agg(F.avg("len")).head()[0]
    most = math.log(1 + 1 / RARE)
    rarity = [min(1.0, math.log(1 + n / df[i]) / most) if i in df else 1.0 for i in range(len(model.terms))]
    return Model(model.terms, [{s: w * r for s, w in own.items()} for own, r in zip(model.weights, rarity, strict=True)], model.thresholds, float(mean or 50.0), model.learned)


def paragraph_scores(hit: tuple, weights: list[dict[str, float]], mean_length: float, norm: float = NORM) -> dict[tuple[int, int, str], list[float]]:
    """(paragraph, its sentences, subject) -> scores of the sentences with a term of the subject."""
    sums: dict[tuple[int, int, int, str], float] = defaultdict(float)
    for p, n, k, length, i in zip(*hit, strict=True):
        if n >= PARAGRAPH:
            for s, w in weights[i].items():
                sums[p, n, k, s] += w / (1 - norm + norm * length / mean_length)
    best: dict[tuple[int, int], float] = defaultdict(float)
    for (p, _, k, _), x in sums.items():
        best[p, k] = max(best[p, k], x)
    out: dict[tuple[int, int, str], list[float]] = defaultdict(list)
    for (p, n, k, s), x in sums.items():
        if x >= DOMINANT * best[p, k]:
            out[p, n, s].append(x)
    return out


def decide(scores: dict[tuple[int, int, str], list[float]], score: float, sentences: int, share: float) -> set[str]:
    """Subjects of a document from the scores of its paragraphs."""
    found = set()
    for (_, n, s), xs in scores.items():
        if s not in found:
            about = sum(x >= score for x in xs)
            if about >= sentences and about >= share * n:
                found.add(s)
    return found


def _columns(batch, first: int) -> Iterator[tuple]:
    return zip(*[batch.column(first + k).to_pylist() for k in range(5)], strict=True)


def try_thresholds(hits: DataFrame, sample: DataFrame, model: Model, part: int, grid: list[tuple] = GRID, norm: float = NORM) -> list[tuple]:
    """(thresholds, right, wrong, missed) of each of ``grid`` on one part of the labelled documents."""
    wanted = sample.where(F.col("part") == part).select("doc_id", "labels")
    rows = hits.join(F.broadcast(wanted), "doc_id").select("labels", "par", "of", "sent", "len", "term")  # at most SAMPLE short rows
    shared = hits.sparkSession.sparkContext.broadcast((model.weights, model.mean_length))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        weights, mean = shared.value
        total = [[0, 0, 0] for _ in grid]
        for batch in batches:
            for labels, hit in zip(batch.column(0).to_pylist(), _columns(batch, 1), strict=True):
                want, scores = set(labels) - {NONE}, paragraph_scores(hit, weights, mean, norm)
                for t, g in zip(total, grid, strict=True):
                    got = decide(scores, *g)
                    t[0] += len(got & want)
                    t[1] += len(got - want)
                    t[2] += len(want - got)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), *[pa.array([t[k] for t in total], pa.int64()) for k in range(3)]], names=["at", "hit", "wrong", "missed"])

    sums = rows.mapInArrow(run, "at int, hit long, wrong long, missed long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("hit", "wrong", "missed")])
    return [(grid[r["at"]], r.hit, r.wrong, r.missed) for r in sorted(sums.collect(), key=lambda r: r["at"])]


def f1(right: int, wrong: int, missed: int) -> float:
    return 2 * right / max(1, 2 * right + wrong + missed)


def calibrate(hits: DataFrame, sample: DataFrame, model: Model) -> Model:
    """The model with the thresholds of the best F1 on part 2.

    Those within one label of the best count as equal: of them the most sentences, then the greatest share, then the middle score.
    """
    tried = try_thresholds(hits, sample, model, 2)
    best = max((f1(*x[1:]) for x in tried), default=0.0)
    if not best:
        return model
    wanted = max(right + missed for _, right, _, missed in tried)
    equal = [x[0] for x in tried if f1(*x[1:]) >= best - 1 / wanted]
    strict = max((n, share) for _, n, share in equal)
    scores = sorted(x for x, *rest in equal if tuple(rest) == strict)
    return Model(model.terms, model.weights, (scores[len(scores) // 2], *strict), model.mean_length, model.learned)


def assign(hits: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subjects, n_chars): one row a document, its subjects sorted, an empty list where it has none."""
    shared = hits.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            found = [sorted(decide(paragraph_scores(h, own.weights, own.mean_length), *own.thresholds)) for h in _columns(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), batch.column(1)], names=["doc_id", "subjects", "n_chars"])

    return hits.mapInArrow(run, "doc_id long, subjects array<string>, n_chars long")


def fitted(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, DataFrame, Model]:
    """(hits of all documents, labelled sample, model): fitted, weighed by rarity and calibrated."""
    ship_package(docs.sparkSession)
    sample = cut_lineage(labelled_sample(docs, labels, size))
    model = fit_weights(sample)
    hits = cut_lineage(find_terms(docs, model))
    model = with_rarity(hits, model)
    return hits, sample, calibrate(hits, sample, model)


def assign_subjects(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, subjects, n_chars) of all documents (doc_id, text), fitted on ``labels`` (doc_id, subject)."""
    hits, _, model = fitted(docs, labels, size)
    return assign(hits, model)


def quality(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(part, score, sentences, share, n_terms, n_learned, hit, wrong, missed, prec, recall): the calibrating part and the one held out."""
    hits, sample, model = fitted(docs, labels, size)
    rows = []
    for name, part in (("calibration", 2), ("held out", 3)):
        for _, hit, wrong, missed in try_thresholds(hits, sample, model, part, [model.thresholds]):
            rows.append((name, *map(float, model.thresholds), len(model.terms), len(model.learned), hit, wrong, missed, hit / max(1, hit + wrong), hit / max(1, hit + missed)))
    return docs.sparkSession.createDataFrame(rows, "part string, score double, sentences double, share double, n_terms long, n_learned long, hit long, wrong long, missed long, prec double, recall double")
