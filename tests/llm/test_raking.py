"""The size of the sample does not hang on the rarest cell."""

import random

import pytest

from rastra.llm import queries, raking

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_rare_cell_does_not_shrink_the_sample(spark, tmp_path):
    rng = random.Random(21)
    rows = [(k, " ".join(["word"] * rng.randrange(20, 60)), rng.choice(["en", "en", "fr"]), rng.choice("ab"), 0) for k in range(1500)]
    rows += [(9000, "ten words " * 5, "en", "rare", 0), (9001, "ten words " * 5, None, "a", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7_raking_mix(spark, str(tmp_path)).collect()
    total = sum(r["tokens"] for r in out)
    assert sum(r["tokens"] * r["probability"] for r in out) == pytest.approx(0.25 * total, rel=1e-6)
    assert sum(r["tokens"] for r in out if r["sampled"]) == pytest.approx(0.25 * total, rel=0.15)


def test_cells_that_cannot_supply_are_kept_whole_and_the_rest_fill_the_budget(spark):
    cells = [(10, 0.5), (100, 0.3), (1000, 0.2), (50, 0.0)]
    df = spark.createDataFrame([(t, w, w / t) for t, w in cells], "tokens long, weight double, ratio double")
    for budget in (5.0, 200.0, 700.0, 1110.0):
        scale = raking.scale_to(df, budget)
        assert sum(min(t, w * scale) for t, w in cells if w) == pytest.approx(budget)
    assert raking.scale_to(df, 2000.0) == float("inf")
    with pytest.raises(ValueError):
        raking.mix(df, rate=0.5, budget_tokens=1.0)
