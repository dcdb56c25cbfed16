import random
import unicodedata

import pytest

from gyeol.llm import subjects
from gyeol.llm.subject_terms import SUBJECT_TERMS
from gyeol.session import table

CHIP = ["식각 장비 문제는 다시 보고될 예정이다.", "반도체 불량이 줄었다.", "신규 웨이퍼 도입으로 이익이 4.0%포인트 개선될 것으로 추정된다."]
BANK = ["예금 금리를 내린 뒤 지점 3곳을 통폐합하였다.", "가계 대출 부문은 둔화세가 뚜렷하다.", "연체율 일정이 지연되었다."]


def plain_model(thresholds=(0.2, 3, 0.0)):
    prior = subjects.curated()
    terms = sorted(prior)
    return subjects.Model(terms, [prior[t] for t in terms], thresholds)


MODEL = plain_model()
AUTOMATON = MODEL.automaton()


def of(text, model=MODEL):
    return subjects.decide(subjects.paragraph_scores(subjects.text_hits(text, AUTOMATON), model.weights, model.mean_length), *model.thresholds)


def test_paragraph_rule():
    assert of(" ".join(CHIP)) == {"semiconductor"}
    assert of("\n".join(CHIP)) == {"semiconductor"}
    assert of(" ".join(CHIP[:2])) == set()
    assert of(" ".join([*CHIP, BANK[1]])) == {"semiconductor"}
    assert of(" ".join(CHIP) + "\n\n" + " ".join(BANK)) == {"semiconductor", "banking"}
    assert of(" ".join(CHIP[:2]) + "\n \n" + CHIP[2]) == set()


def test_labels_and_names_dont_count():
    assert of("웨이퍼 | 1 | 2\n칩셋 | 3 | 4\n반도체 | 5 | 6\n도크 | 1 | 2") == set()
    assert of("다솔은행증권 사업보고서. 한빛가스 보고. 두레조선소 보고.") == set()


def test_characters_and_case():
    assert of(unicodedata.normalize("NFD", " ".join(CHIP))) == {"semiconductor"}
    assert of("WAFER starts are late. Delays in Lithography moved. An outside review of the Foundry closed.") == {"semiconductor"}


def test_thresholds_share_and_length():
    text = " ".join(["오늘은 맑다."] * 9 + CHIP)
    assert of(text) == {"semiconductor"} and of(text, plain_model((0.2, 3, 0.5))) == set()
    long = " ".join(x[:-1] + " 그리고 아무 관계 없는 말이 이어진다" * 12 + "." for x in CHIP)
    assert of(" ".join(CHIP), plain_model((0.6, 3, 0.0))) == {"semiconductor"} and of(long, plain_model((0.6, 3, 0.0))) == set()


def test_dominant_subject():
    """A side term of another subject doesn't make a sentence about it, an equal one does."""
    scores = subjects.paragraph_scores(([0, 0, 0], [3, 3, 3], [0, 0, 1], [40, 40, 40], [0, 1, 1]), [{"a": 1.0}, {"b": 0.5}], 40.0)
    assert sorted(k[2] for k in scores) == ["a", "b"] and scores[0, 3, "b"] == [0.5]


def test_brute_force_matching():
    """The automaton's hits equal a plain search of every word start, longest first."""
    rnd = random.Random(2)
    terms = list(MODEL.terms)

    def brute(text):
        out, at = [], 0
        while at < len(text):
            here = [t for t in terms if text.startswith(t, at)] if at == 0 or not text[at - 1].isalnum() else []
            here = [t for t in here if not (t[-1].isascii() and len(t) < 5 and text[at + len(t) : at + len(t) + 1].isascii() and text[at + len(t) : at + len(t) + 1].isalpha())]
            if here:
                t = max(here, key=len)
                out.append((at, t))
                at += len(t)
            else:
                at += 1
        return out

    for _ in range(200):
        para = " ".join(rnd.choice([f"{rnd.choice(terms)} 이다.", "the dieting carts", "가을 하늘"]) for _ in range(8))
        assert [(p, terms[i]) for p, i in subjects.term_hits(para, AUTOMATON)] == brute(para)


def test_candidates():
    assert subjects.candidates("기름값이 내려 정유 이익이 줄었다.") >= {"기름값", "정유", "정유 이익"}
    assert subjects.candidates("the gas carrier left") >= {"gas", "carrier", "gas carrier"} and "3" not in subjects.candidates("3 of 4")


def test_spark(spark):
    rows = [(1, " ".join(CHIP), "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (4, ("잡음. " * 100_000) + "\n\n" + " ".join(BANK), "x"), (1, " ".join(CHIP), "x")]
    none = spark.createDataFrame([], "doc_id long, subject string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, subjects string")
    hits = subjects.find_terms(docs, MODEL)
    got = sorted((r.doc_id, tuple(r.subjects), r.n_chars > 0) for r in subjects.assign(hits, MODEL).collect())
    assert got == [(1, ("semiconductor",), True), (1, ("semiconductor",), True), (2, (), False), (3, (), False), (4, ("banking",), True)]
    assert subjects.assign_subjects(docs, none).count() == 5
    assert subjects.assign_subjects(docs.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def fitted(spark, tiny):
    d = tiny.replace("0.001", "0.01")
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "subject_label")
    return (*subjects.fitted(docs, labels), " ".join(r.text or "" for r in docs.collect()).lower())


def test_held_out(fitted):
    """Labelled documents that nothing was fitted on; a few labels are wrong by construction."""
    hits, sample, model, _ = fitted
    ((_, right, wrong, missed),) = subjects.try_thresholds(hits, sample, model, 3, [model.thresholds])
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9
    assert model.learned and set(model.terms) > model.learned


def test_vocabulary_is_not_the_corpus(fitted):
    """The curated terms are general: many don't occur in the corpus at all."""
    text = fitted[3]
    terms = [t.lower() for kinds in SUBJECT_TERMS.values() for ts in kinds.values() for t in ts]
    assert sum(t not in text for t in terms) > len(terms) / 4


def test_every_part_acts(fitted):
    """Learned terms, weights, rarity, length norm and each threshold change what comes out."""
    hits, sample, model, _ = fitted
    curated = set(subjects.curated())
    flat = [dict.fromkeys(w, 1.0) for w in model.weights]
    short = [w if t in curated else {} for t, w in zip(model.terms, model.weights, strict=True)]
    grid = [model.thresholds, (0.9, *model.thresholds[1:]), (model.thresholds[0], 1, 0.0), (model.thresholds[0], 3, 0.6)]

    def tried(weights, norm=subjects.NORM):
        own = subjects.Model(model.terms, weights, model.thresholds, model.mean_length)
        return [[x[1:] for x in subjects.try_thresholds(hits, sample, own, p, grid, norm)] for p in (0, 1, 2, 3)]

    base = tried(model.weights)
    assert all(any(part[0] != part[k] for part in base) for k in (1, 2, 3)), base  # each threshold
    assert tried(short) != base and tried(flat) != base and tried(model.weights, 0.0) != base
    assert any(w and max(w.values()) < 0.9 for w in model.weights)  # rarity and evidence spread the weights


def test_rarity_counts_all_documents(spark):
    model = subjects.Model(["반도체", "도크"], [{"semiconductor": 1.0}, {"shipbuilding": 1.0}])
    docs = spark.createDataFrame([(i, "반도체 이야기다. 하나. 둘." + (" 도크 이야기다." if i == 0 else "")) for i in range(200)], "doc_id long, text string")
    out = subjects.with_rarity(subjects.find_terms(docs, model), model)
    assert out.weights[1]["shipbuilding"] == 1.0 and out.weights[0]["semiconductor"] < 0.2
