"""Secret scan: long values, runs without a digit or with a late one."""

import random
import string

import pytest

from pointloom.llm import secrets

RNG = random.Random(8)
MIXED = "".join(RNG.choice(string.ascii_letters + string.digits) for _ in range(600))
LETTERS = "".join(RNG.choice(string.ascii_letters) for _ in range(60))
ODD = "".join(RNG.choice(string.ascii_letters + "!$%&?#") for _ in range(600))


@pytest.mark.parametrize(
    ("before", "value"),
    [
        ('token = "', MIXED),
        ('password = "', MIXED),
        ('password = "', ODD),
        ('api key: "', LETTERS[:20]),
        ('auth = "', LETTERS + "7"),
        ('secret = "', "ab!" + MIXED[:40] + "$cd"),
        ("key=", "AKIA" + LETTERS[:16].upper()),
    ],
)
def test_the_whole_secret_is_found(spark, before, value):
    text = "eta oin " + before + value + '" shr'
    row = secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at = text.index(value)
    assert [(s.start, s.end) for s in row.secrets] == [(at, at + len(value))]


def test_closing_punctuation_stays_outside_a_run():
    text = f"password={MIXED[:20]}, then"
    assert secrets.candidates(text) == [(9, 29)]


def test_long_words_are_refused(spark):
    row = secrets.scan_secrets(spark.createDataFrame([(1, "the key internationalization of a well-known-configuration")], "doc_id long, text string")).first()
    assert row.n_candidates == 2 and row.n_secrets == 0
