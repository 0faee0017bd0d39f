"""Raking with a highest rate."""

import numpy as np

from alertlake.llm import mix_sources


def test_capped_rates_still_meet_reachable_targets(spark):
    rng = np.random.default_rng(9)
    cells = [(f"s{s}", g, t, int(rng.integers(200, 5000))) for s in range(12) for g in ("de", "en", "fr") for t in range(3)]
    table = spark.createDataFrame(cells, "source string, lang string, topic int, tokens bigint")
    natural = {g: sum(n for _, x, _, n in cells if x == g) for g in ("de", "en", "fr")}
    total = sum(natural.values())
    # Almost all German text is wanted, so many of its cells reach their highest rate.
    share = 0.95 * natural["de"] / (0.5 * total)
    targets = {"lang": {"de": share, "en": (1 - share) / 2, "fr": (1 - share) / 2}, "source": {f"s{s}": 1 for s in range(12)}}
    exponents = {"source": 1.0, "lang": 1.0, "topic": 1.0}
    out = mix_sources.probabilities(mix_sources.rake(table, {"lang": targets["lang"]}, exponents, fraction=0.5), 0.5).toPandas()
    drawn = out.tokens * out.probability
    assert out.probability.max() <= 1 and (out.probability > 0.999).any()
    assert abs(drawn.sum() / total - 0.5) < 1e-3
    got = drawn.groupby(out.lang).sum() / drawn.sum()
    assert all(abs(got[g] - w) < 0.01 for g, w in targets["lang"].items())
    by_source = drawn.groupby(out.source).sum() / drawn.sum()
    wanted = out.groupby("source").tokens.sum() / total
    assert np.allclose(by_source, wanted, atol=0.01)


def test_targets_out_of_reach_take_all_there_is(spark):
    cells = [("a", "de", 0, 100), ("a", "en", 0, 900), ("b", "en", 0, 1000)]
    table = spark.createDataFrame(cells, "source string, lang string, topic int, tokens bigint")
    out = mix_sources.probabilities(mix_sources.rake(table, {"lang": {"de": 1, "en": 1}}, fraction=0.5), 0.5).toPandas().set_index(["source", "lang"])
    assert out.probability[("a", "de")] == 1 and out.probability.max() <= 1
    assert abs((out.tokens * out.probability).sum() - 1000) < 1


def test_topics_are_fitted_on_all_rows(spark, monkeypatch):
    fitted = []

    class Noted(mix_sources.KMeans):
        def fit(self, dataset, params=None):
            fitted.append(dataset.count())
            return super().fit(dataset, params)

    monkeypatch.setattr(mix_sources, "KMeans", Noted)
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('words about subject', id % 5, ' and more') AS text", "'en' AS lang", "'web' AS source")
    out = mix_sources.mixed(docs)
    assert out.count() == 6000 and fitted == [6000]
