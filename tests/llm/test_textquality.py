import math
import re

import numpy as np
import pytest

from barloom.llm import textquality as q

COMMON = ["the", "of", "und", "it's", "é"]
LIMITS = {"common_share": (0.2, 0.8), "symbol_ratio": (0.0, 0.3), "line_end_share": (0.08, 1.0), "mean_word_length": (0.0, 15.0)}
SCHEMA = "doc_id long, text string, id int, kind int, n_words int, cleared int"
TEXTS = [
    None,
    "",
    " \n\f\t ",
    "The of THE, of. (the)",
    "The cat sat.\nAnd of it\r\n\r\nsaid: \"no\"\fEnd ” \n »",
    "a" * 5000,
    "### $$$ %%%",
    "Über den Wolken, und É ist — 12 % schön! ​",
    "it's 'the' 9the9 --",
    "x" * 200_000 + " the." * 50_000,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 1, 1, 1) for i, t in enumerate(texts)], SCHEMA)


def common(spark):
    return spark.createDataFrame([("en", w) for w in [*COMMON, None, "the"]], "lang string, word string")


def by_hand(text):
    w = (text or "").split()
    if not w:
        return None
    solid = [c for c in text if not c.isspace()]
    lines = [s.rstrip() for s in re.split("[\n\f]", text)]
    lines = [s for s in lines if s]

    def bare(x):
        x = x.lower()
        while x and not x[0].isalpha():
            x = x[1:]
        while x and not x[-1].isalpha():
            x = x[:-1]
        return x

    return (
        sum(map(len, w)) / len(w),
        sum(not c.isalnum() for c in solid) / len(solid),
        sum(s[-1] in ".!?:;…\"”»)" for s in lines) / len(lines),
        sum(bare(x) in COMMON for x in w) / len(w),
    )


def test_statistics_equal_a_count_by_hand(spark):
    got = {r.id: r for r in q.statistics(frame(spark, TEXTS), "doc_id", "text", common(spark)).collect()}
    assert got[0].n_chars is None and got[0].n_words == 0 and got[2].n_lines == 0
    for i, t in enumerate(TEXTS):
        want, r = by_hand(t), got[i]
        own = (r.mean_word_length, r.symbol_ratio, r.line_end_share, r.common_share)
        assert own == (None,) * 4 if want is None else all(math.isclose(a, b) for a, b in zip(own, want)), (t or "")[:50]
    assert q.statistics(frame(spark, []), "doc_id", "text", common(spark)).count() == 0


def corpus(n=120):
    r = np.random.default_rng(1)
    out = []
    for i in range(n):
        rare = lambda: "".join(r.choice(list("abcdefgh"), r.integers(3, 9)))
        kind = i % 6
        if kind < 4:
            out.append(" ".join("the" if r.random() < 0.45 else rare() for _ in range(60)) + ".\n" + " ".join(rare() if r.random() < 0.6 else "of" for _ in range(20)) + ".")
        elif kind == 4:
            out.append("\n".join(rare() for _ in range(30)))
        else:
            out.append("\n".join(f"{r.integers(99)} | {r.integers(9999)} | -- % +" for _ in range(12)))
    return out


def test_judged_documents(spark):
    texts = [*corpus(), *TEXTS]
    rows = q.judged(frame(spark, texts), "doc_id", "text", common(spark), LIMITS).collect()
    assert len(rows) == len(texts)
    breaks = lambda r: any(not lo <= r[c] <= hi for c, (lo, hi) in LIMITS.items())
    for r in rows:
        assert (r.kind == "empty") == (r.n_words == 0)
        if r.cleared:
            assert r.kind == "prose" or not breaks(r)
            assert not breaks(r)
    kinds = [{r.kind for r in rows if r.doc_id < 120 and r.doc_id % 6 == k} for k in range(6)]
    assert all("prose" in k for k in kinds[:4]) and "prose" not in kinds[4] | kinds[5]


def test_kinds_of_the_test_tables(spark, sf):
    """Held-out agreement: documents beyond the limits, none of them an example, are of another kind than prose, and nearly
    all others are prose; each kind has documents."""
    table = lambda name: spark.read.parquet(f"{sf}/{name}.parquet".replace("sf0.001", "sf0.01"))
    rows = [r for r in q.judged(table("documents"), "doc_id", "text", table("common_words"), LIMITS).collect() if r.n_words >= 10]
    bad = [r.kind for r in rows if any(not lo <= r[c] <= hi for c, (lo, hi) in LIMITS.items())]
    good = [r.kind for r in rows if all(lo <= r[c] <= hi for c, (lo, hi) in LIMITS.items())]
    assert sum(k != "prose" for k in bad) / len(bad) >= 0.95 and sum(k == "prose" for k in good) / len(good) >= 0.95
    assert {r.kind for r in rows} == {"prose", "list", "table", "junk"}


def test_densities_equal_those_of_the_formula():
    r = np.random.default_rng(3)
    a = r.normal(size=(4, 5, 5))
    model = q.Mixture(np.zeros(5), np.ones(5), np.array([0.1, 0.2, 0.3, 0.4]), r.normal(size=(4, 5)), a @ a.transpose(0, 2, 1) + np.eye(5), ("prose",) * 4, 0, 0.0)
    x = r.normal(size=(50, 5)) * 4
    logs = np.log(model.weights) - 0.5 * (model.distances(x) + np.linalg.slogdet(model.covariances)[1] + 5 * np.log(2 * np.pi))
    assert np.allclose(q._squares(x) @ model.coefficients(), logs)


def test_no_documents_and_no_words(spark):
    assert q.judged(frame(spark, []), "doc_id", "text", common(spark), LIMITS).count() == 0
    rows = q.judged(frame(spark, [None, ""]), "doc_id", "text", common(spark), LIMITS).collect()
    assert [(r.kind, r.cleared) for r in rows] == [("empty", False)] * 2


def test_mixture_rises_and_radius_keeps_within_the_limits(spark):
    measured = q.statistics(frame(spark, corpus()), "doc_id", "text", common(spark)).cache()
    likelihoods = [q.fit(measured, frozenset(COMMON), most_steps=n, tolerance=0).objective for n in (1, 2, 4)]
    assert likelihoods == sorted(likelihoods)
    model = q.fit(measured, frozenset(COMMON))
    assert model.weights.sum() == pytest.approx(1)
    radius = q.cleared_radius(model, LIMITS)
    assert (radius > 0).any()
    r = np.random.default_rng(0)
    for k, label in enumerate(model.labels):
        if label != "prose":
            assert radius[k] == 0
        if radius[k] == 0:  # also where the mean breaks a limit
            continue
        direction = r.normal(size=(2000, 5))
        z = direction / np.linalg.norm(direction, axis=1)[:, None] * np.sqrt(radius[k])
        x = (model.means[k] + z @ np.linalg.cholesky(model.covariances[k]).T) * model.scale + model.centre
        for name, (lo, hi) in LIMITS.items():
            v = x[:, q.STATISTICS.index(name)]
            assert v.min() >= lo - 1e-9 and v.max() <= hi + 1e-9
    assert q.fit(measured.limit(0), frozenset(COMMON)) is None
