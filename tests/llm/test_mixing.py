"""Mixing with rare cells."""

import pytest

from oppflow.llm import mixing


def test_a_source_of_one_document_leaves_the_others(spark):
    rows = [(i, "w " * 20, "ab"[i % 2], "en") for i in range(4000)] + [(4000, "w " * 20, "rare", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.sample(docs).toPandas()
    assert (got.tokens * got.probability).sum() == pytest.approx(mixing.KEPT_SHARE * got.tokens.sum(), rel=1e-6)
    p = got.groupby("source").probability.first()
    assert p["rare"] == 1 and p["a"] == pytest.approx(p["b"], rel=1e-6)
    assert abs(got.kept.mean() - mixing.KEPT_SHARE) < 0.03
    assert abs(mixing.mix(docs).count() / len(rows) - mixing.KEPT_SHARE) < 0.03


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9, 1.0])
def test_scale_keeps_the_wanted_share(spark, share):
    cells = [(10, 8.0), (50, 0.4), (40, 0.1)]
    c = mixing.scale(spark.createDataFrame(cells, "tokens long, ratio double"), share)
    kept = sum(n * min(1.0, c * r) for n, r in cells)
    assert kept >= share * 100 - 1e-6
    assert c * 8.0 == pytest.approx(1.0) or kept == pytest.approx(share * 100)


def test_contradictory_margins_are_reported(spark):
    cells = [("german", "de", "prose", 100)] + [(f"s{i}", "en", "prose", 100) for i in range(19)]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    out, off = mixing.raked(df)
    assert out.count() == 20 and off["topic"] < 1e-6 and max(off.values()) > 0.1
    with pytest.warns(UserWarning, match="margins differ"):
        mixing.rake(df)
    fine, off = mixing.raked(spark.createDataFrame([(s, x, "prose", 10) for s in "ab" for x in ("en", "de")], df.schema))
    assert fine.count() == 4 and max(off.values()) <= mixing.TOLERANCE
