"""Personal data: long texts, spans near base spans, and how well added spans are told from false ones."""

import random
import time

from pyspark.sql import functions as F

from pointloom.llm import pii


def test_long_runs_of_digits_take_linear_time():
    began = time.perf_counter()
    assert pii.base_spans("7" * 1_000_000) == [] and pii.base_spans("7." * 500_000 + "x") != []
    assert pii.base_spans("1" * 400_000 + ".2.3") == []
    assert time.perf_counter() - began < 20


def test_nothing_is_added_inside_a_base_span():
    mail = "1.2.3.4.5.6.7.8.9.1.2.3.4.5.6.7.8.9.1.2.123-45-6789@example.com"
    base = pii.base_spans(mail)
    assert ("email", 0, len(mail)) in base and sum(k == "ip" for k, *_ in base) == 5
    assert pii.added_proposals(mail, base) == []
    assert pii.added_proposals("ssn 123-45-6789.", []) == [("ssn", 4, 15)]


def corpus(seed, n):
    """Texts with true and false further spans; no text holds both. Rows: id, text, kind, start, end, true or false."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    names, rows = ["Anna", "Peter", "Lucia", "Omar", "Ines"], []
    for i in range(n):
        kind, true = rng.choice(["ssn", "phone_local", "person"]), rng.random() < 0.6
        if kind == "ssn":
            span = f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}" if true else f"9{d(2)}-00-0000"
            left, right = (rng.choice(["her ssn ", "social security number ", "the ssn is ", "on file as ", "taxpayer "]), " was noted") if true else (rng.choice(["part no ", "order ref ", "catalog item "]), "b in stock")
            left, right = (left, right) if true else (left, right)
        elif kind == "phone_local":
            span = f"({rng.choice(['212', '415', '303'])}) 555-{d(4)}" if true else "000-000-0000"
            left, right = (rng.choice(["please call ", "phone ", "reach the desk at ", "tel "]), " after noon") if true else (rng.choice(["serial ", "meter reads "]), " again")
        else:
            who = rng.choice(names) if true else "Quixote" + chr(97 + i % 26) * 2
            span = f"{rng.choice(['Mr', 'Dr', 'Mrs'])} {who}"
            left, right = (rng.choice(["signed by ", "the patient ", "we met ", "author "]), " said") if true else ("", " said")
            if not true:
                continue
        text = "some words first then " + left + span + right
        at = text.index(span)
        rows.append((i, text, kind, at, at + len(span), true))
    return rows


def test_recall_and_precision_of_added_spans(spark):
    rows = corpus(2, 3000)
    found = pii.find_personal_data(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"))
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.ADDED_KINDS} for r in found.collect()}
    hit = sum((k, a, b) in got[i] for i, _, k, a, b, true in rows if true)
    wrong = sum(len(got[i]) for i, *_, true in rows if not true)
    recall, precision = hit / sum(r[-1] for r in rows), hit / (hit + wrong)
    print("recall", recall, "precision", precision)
    assert recall > 0.9 and precision > 0.9


def test_gazetteer_is_counted(spark):
    texts = ["write to a@x.org"] * 300 + ["or b@y.zzz"]
    found = pii.propose(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    sizes, terms = pii.gazetteer(found.select(F.explode(F.concat("base", "added")).alias("s")))
    assert sizes == {"email": 301} and terms == {"email": ["org"]}
