import numpy as np

from tideline.functions.quantiles import quantiles

WANTED = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.9999, "e": 1.0}


def test_quantiles_match_sorting(spark):
    """Small groups, one far over what is ranked whole, ties, nulls and an empty table."""
    r = np.random.default_rng(1)
    values = {"few": r.normal(size=7), "one": np.array([3.0]), "many": r.normal(size=60_000), "ties": r.integers(0, 5, 30_000).astype(float), "skew": np.exp(r.normal(0, 4, 25_000))}
    rows = [(k, float(x)) for k, own in values.items() for x in own] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {x.k: x for x in quantiles(df, ["k"], "v", WANTED).collect()}
    assert set(got) == set(values)
    for k, own in values.items():
        for name, q in WANTED.items():
            assert np.isclose(got[k][name], np.quantile(own, q), rtol=1e-12), (k, name)
    whole = quantiles(df, [], "v", {"m": 0.37}).first()
    assert np.isclose(whole.m, np.quantile(np.concatenate(list(values.values())), 0.37), rtol=1e-12)
    assert quantiles(df.where("false"), ["k"], "v", WANTED).count() == 0
