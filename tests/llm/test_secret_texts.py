"""Secret scan: texts that almost match, and values that very many rows hold."""

import time

import pytest

from oppflow.llm import secret_scan

NEAR = {
    "header": "-----BEGIN " + "A " * 500_000,
    "headers": "-----BEGIN RSA PRIVATE KEY----" * 30_000,
    "tokens": "eyJ" * 300_000,
    "dotted": "eyJabcdefgh.eyJ" * 60_000,
    "words": "token " * 150_000,
    "spaces": "secret" + " " * 1_000_000 + "x",
    "hex": "0123456789abcdef0123456g" * 40_000,
    "upper": "AKIAAAAAAAAAAAAAAAA-" * 50_000,
    "slack": "xoxb-123456789 " * 60_000,
    "quotes": "password'" * 100_000,
}


def test_a_long_key_header_ends_and_is_found(spark):
    rows = [(1, "-----BEGIN " + "A " * 20_000, "s"), (2, "-----BEGIN OPENSSH PRIVATE KEY-----", "s"), (3, "x" * 10 + "-----BEGIN PRIVATE KEY-----", "s")]
    got = {r.doc_id: r.spans for r in secret_scan.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {1: "", 2: "issued:0:35", 3: "issued:10:37"}


@pytest.mark.parametrize("name", NEAR)
def test_a_megabyte_that_almost_matches(spark, name):
    began = time.time()
    got = secret_scan.digest(spark.createDataFrame([(1, NEAR[name], "s")], "doc_id long, text string, source string")).collect()
    assert len(got) == 1 and time.time() - began < 30


def test_salted_values_have_the_same_verdicts(spark, monkeypatch):
    rows = [(i, f"token=abcDEF123456{i % 3} password: own{i}secret99", f"s{i % 4}" if i % 3 else "one") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plain = sorted(map(tuple, secret_scan.digest(docs).collect()))
    monkeypatch.setattr(secret_scan, "HOT_ROWS", 3)
    assert sorted(map(tuple, secret_scan.digest(docs).collect())) == plain
