"""The classifiers' parts against plain loops and dense matrices; language sets against all subsets."""

import random
from itertools import combinations

import numpy as np
import pytest

from sievemark.llm import language_id as LI
from sievemark.llm import quality as Q
from sievemark.llm import toxicity as T


def plain_vote(query, vectors, labels, prior):
    if not any(query):
        return prior
    cosines = [round(float(np.float32(np.dot(query, v))), 6) for v in vectors]
    last = sorted(cosines, reverse=True)[min(Q.NEIGHBOURS, len(cosines)) - 1]
    voters = [(c, y) for c, y in zip(cosines, labels, strict=True) if c >= last]
    weights = [max(c, 0.0) ** 8 + 1e-12 for c, _ in voters]
    return sum(w * y for w, (_, y) in zip(weights, voters, strict=True)) / sum(weights)


@pytest.mark.parametrize("count", [3, 15, 16, 200])
def test_votes_of_nearest_neighbours_with_ties(count):
    draw = np.random.default_rng(count)
    # eighths in four places: products are exact in float32, so that ties are ties in any order of sums
    vectors = draw.integers(-4, 5, (count, 4)).astype(np.float32) / 8
    labels = draw.integers(0, 2, count).astype(float)
    space = object.__new__(Q.Space)
    space.vectors, space.labels, space.prior = vectors, labels, 0.25
    block = np.concatenate([vectors[: min(count, 40)], draw.integers(-4, 5, (40, 4)).astype(np.float32) / 8, np.zeros((2, 4), np.float32)])
    want = [plain_vote(q, vectors, labels, 0.25) for q in block]
    np.testing.assert_allclose(space.vote(block), np.clip(want, 0, 1), rtol=1e-9, atol=1e-12)
    ties = [sum(round(float(np.dot(q, v)), 6) >= sorted((round(float(np.dot(q, v)), 6) for v in vectors), reverse=True)[min(count, Q.NEIGHBOURS) - 1] for v in vectors) for q in block[:-2]]
    assert count < 200 or max(ties) > Q.NEIGHBOURS  # the case is there


def texts(n, seed=1):
    draw = random.Random(seed)
    return [" ".join(draw.choice(["Alpha", "beta", "99", "x!", "é\n", "GAMMA"]) * draw.randrange(1, 3) for _ in range(draw.randrange(1, 60))) for _ in range(n)]


def test_latent_space_of_a_small_sample_keeps_all_cosines():
    sample = [Q.features(t) for t in texts(40)]
    dense = np.zeros((40, 1 << Q.BITS))
    for row, (index, weight) in zip(dense, sample, strict=True):
        row[index] = weight
    idf = np.log(41 / (1 + (dense > 0).sum(axis=0))) + 1
    scaled = dense * idf
    scaled /= np.linalg.norm(scaled, axis=1, keepdims=True)
    space = Q.fit(sample, np.arange(40) % 2)
    np.testing.assert_allclose(space.vectors @ space.vectors.T, scaled @ scaled.T, atol=2e-4)
    own = np.array([space.vector(t) for t in texts(40)])
    np.testing.assert_allclose(own, space.vectors, atol=2e-4)
    assert space.prior == 0.5 and not space.vector("").any() and not space.vector(None).any()


def test_log_count_ratios_against_counts():
    own, y = texts(60, 2), [i % 3 == 0 for i in range(60)]
    sets = [set(T.present(t).tolist()) for t in own]
    count = {c: np.zeros(1 << T.BITS) for c in (False, True)}
    for s, c in zip(sets, y, strict=True):
        count[c][list(s)] += 1
    got = T.log_count_ratio(count[True], count[False], sum(y), len(y) - sum(y))
    for gram in set().union(*sets):
        p, q = sum(gram in s for s, c in zip(sets, y, strict=True) if c) + 1, sum(gram in s for s, c in zip(sets, y, strict=True) if not c) + 1
        ratio = np.log(p / (sum(y) + 2)) - np.log(q / (len(y) - sum(y) + 2))
        assert got[gram] == pytest.approx(0 if abs(ratio) < max(T.LEAST_RATIO, T.LEAST_Z * np.sqrt(1 / p + 1 / q)) else ratio)


def test_fit_and_score_against_dense_steps(spark):
    draw = np.random.default_rng(5)
    ratio = np.where(draw.random(80) < 0.2, 0.0, draw.normal(0, 2, 80))
    dense = draw.random((50, 80)) < 0.2
    y = (dense @ ratio > 0).astype(float)
    w, bias = T.fit([np.flatnonzero(r) for r in dense], y, ratio)
    v, b, g, gb = np.zeros(80), 0.0, np.full(80, 1e-6), 1e-6
    order = np.random.default_rng(T.SEED)
    for _ in range(T.EPOCHS):
        for i in order.permutation(50):
            x = dense[i] * ratio
            error = 1 / (1 + np.exp(-np.clip(x @ v + b, -30, 30))) - y[i]
            step = np.where(dense[i], error * x + T.PENALTY * v, 0)
            g += step * step
            v -= T.RATE * step / np.sqrt(g)
            gb += error * error
            b -= T.RATE * error / np.sqrt(gb)
    np.testing.assert_allclose(w, v * ratio, rtol=1e-4, atol=1e-6)
    assert bias == pytest.approx(b, rel=1e-6)
    assert ((dense @ w + bias > 0) == (y > 0)).mean() > 0.95

    weights = draw.normal(0, 1, 1 << T.BITS).astype(np.float32)
    own = [*texts(20, 3), None, "", "123 !!"]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(own)] + [(None, "Alpha beta", 1.0)] * 2, "doc_id long, text string, score double")
    got = sorted(((r["doc_id"], r["score"], r["predicted"]) for r in T.score(df, (weights, -0.3)).collect()), key=str)
    want = []
    for i, t in [*enumerate(own), (None, "Alpha beta"), (None, "Alpha beta")]:
        s = 1 / (1 + np.exp(-np.clip(float(weights[T.present(t)].sum()) - 0.3, -30, 30)))
        want.append((i, pytest.approx(s, rel=1e-5), int(s >= 0.5)))
    assert got == sorted(want, key=lambda x: str((x[0],)))


def test_language_sets_against_all_subsets():
    """The set that grows by the full mixture's weights is the best of all sets on mixtures of up to three languages."""
    draw = random.Random(7)
    alphabets = {"aa": "abcd", "bb": "cdef", "cc": "ghij", "dd": "ijkl"}
    write = lambda lang, n: " ".join("".join(draw.choice(alphabets[lang]) for _ in range(draw.randrange(2, 7))) for _ in range(n))
    model = LI.Mixtures([(lang, np.bincount(LI._grams(write(lang, 3000)), minlength=1 << LI.BITS)) for lang in alphabets])
    for _ in range(25):
        parts = draw.sample(list(alphabets), draw.randrange(1, 4))
        grams = LI._grams(" ".join(write(lang, draw.randrange(15, 60)) for lang in parts))
        index, n = np.unique(grams, return_counts=True)
        n = n.astype(np.float32)
        best = None
        for k in range(1, 5):
            for own in combinations(range(4), k):
                p = model.p[index][:, own]
                start, doc = np.zeros(1, np.int64), np.zeros(len(index), np.int64)
                weights, ll = LI.Mixtures._em(p, n, start, doc, np.array([n.sum()]), np.full((1, k), 1 / k, np.float32))
                value = float(ll[0]) - (k - 1) * LI.PENALTY * np.log1p(n.sum())
                if best is None or value > best[0] + 1e-3:
                    best = (value, {model.langs[i] for i in own}, dict(zip((model.langs[i] for i in own), weights[0], strict=True)))
        (found,) = model.infer([grams])
        assert {lang for lang, _ in found} == best[1]
        assert all(abs(share - best[2][lang]) < 0.02 for lang, share in found)
