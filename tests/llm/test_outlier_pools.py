"""Outlier rules: the estimates against numpy, and groups that are too small for an estimate of their own."""

import collections
import json
import math
import re

import numpy as np
import pytest

from tessera.llm import outliers as O
from tessera.llm import queries as Q

D = len(O.VECTOR)
FACTORS = [k / 256 / O._chi2_share(O._chi2_quantile(k / 256, D), D + 2) if k < 256 else 1.0 for k in range(128, 257)]


def rank(x, p):
    """The least value that a share p of the values doesn't exceed."""
    return np.sort(x)[max(math.ceil(p * len(x)), 1) - 1]


def squared(y, m, inverse):
    return np.einsum("ni,ij,nj->n", y - m, inverse, y - m)


def step(y, m, inverse):
    bins = np.floor(np.log2(np.maximum(squared(y, m, inverse), 1e-9)) * O.OCTAVE).astype(int)
    held = collections.Counter(bins.tolist())
    total, taken = 0, set()
    for k in sorted(held):
        if total >= O.H * len(y):
            break
        taken.add(k)
        total += held[k]
    near = y[np.isin(bins, list(taken))]
    factor = FACTORS[max(math.floor((total / len(y) - 0.5) * 256 + 0.5), 0)]
    cov = np.cov(near.T, bias=True) * factor + O.RIDGE**2 * np.eye(D)
    return near.mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def by_force(x):
    """median, mean and inverse (about the median), cutoff"""
    med = np.array([rank(c, 0.5) for c in x.T])
    y = x - med
    s = np.sqrt((1.4826 * np.array([rank(np.abs(c), 0.5) for c in y.T])) ** 2 + O.RIDGE**2)
    z = y / s
    way = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
    found = []
    for c in (np.eye(D), np.cov(np.tanh(z).T, bias=True), way.T @ way / len(z)):
        size = np.sqrt(np.outer(np.diag(c), np.diag(c)))
        corr = np.where(size > 1e-12, 0.99 * c / np.maximum(size, 1e-300), 0.0)
        np.fill_diagonal(corr, 1)
        m, inverse, det = np.zeros(D), np.linalg.inv(corr * np.outer(s, s)), 0
        for _ in range(O.FIRST_STEPS):
            m, inverse, det = step(y, m, inverse)
        found.append((det, m, inverse))
    det, m, inverse = min(found, key=lambda f: f[0])
    while (new := step(y, m, inverse))[2] < det - O.LOWER:
        m, inverse, det = new
    far = np.log(np.maximum(squared(y, m, inverse), 1e-9))
    q50, q75 = rank(far, 0.5), rank(far, 0.75)
    cutoff = max(math.exp(q50 + O._normal_quantile(1 - O.TAIL) / O._normal_quantile(0.75) * (q75 - q50)), O._chi2_quantile(1 - O.TAIL, D))
    return med, m, inverse, cutoff


def vectors(rows):
    n, c = np.maximum([r.n_words for r in rows], 1), np.maximum([r.word_chars for r in rows], 1)
    lines = np.maximum([len([x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]) for r in rows], 1)
    of = lambda name: np.array([r[name] for r in rows])
    return np.column_stack([np.log1p(of("n_words")), np.log(c / n), np.arcsinh(20 * of("n_symbols") / c), np.arcsinh(2 * of("n_dup_lines") / lines), np.arcsinh(2 * of("n_repeat_words") / n)])


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_query_against_numpy(spark, folder):
    got = Q.QUERIES["op5_mcd_outliers"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source"), "doc_id").collect()
    x, passed = vectors(got), np.array([not r.base_failed for r in got])
    group, language = ([json.dumps([r[c] for c in cols]) for r in got] for cols in (("lang", "source"), ("lang",)))
    n = collections.Counter(g for g, p in zip(group + language, [*passed, *passed], strict=True) if p)
    pool = [g if n[g] >= O.LEAST_GROUP else k if n[k] >= O.LEAST_GROUP else "" for g, k in zip(group, language, strict=True)]
    for name in set(pool):
        inside = passed & np.array([name in (g, k, "") for g, k in zip(group, language, strict=True)]) if name else passed
        med, m, inverse, cutoff = by_force(x[inside])
        mine = [k for k, p in enumerate(pool) if p == name]
        want = squared(x[mine] - med, m, inverse)
        assert np.allclose([got[k].distance2 for k in mine], want, rtol=1e-6, atol=1e-6)
        assert np.allclose([got[k].cutoff for k in mine], cutoff, rtol=1e-6)
        assert [got[k].kept for k in mine] == [bool(passed[k] and d <= cutoff) for k, d in zip(mine, want, strict=True)]
    assert all(r.distance2 is not None for r in got)


def test_mcd_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (1000, D)) @ rng.normal(0, 1, (D, D)) + rng.normal(0, 3, D)
    x[:200] += 40  # a fifth of the rows lies far off
    same = np.tile(rng.normal(0, 1, D), (60, 1))
    rows = spark.createDataFrame([(g, *map(float, r)) for g, v in (("g", x), ("same", same)) for r in v], f"g string, {', '.join(f'{v} double' for v in O.VECTOR)}")
    found = {r.g: r for r in O.mcd(rows.repartition(5)).collect()}
    for g, v in (("g", x), ("same", same)):
        med, m, inverse, cutoff = by_force(v)
        assert np.allclose([found[g][f"m_{k}"] for k in range(D)], m + med, atol=1e-6)
        assert np.allclose(np.array(found[g].precision).reshape(D, D), inverse, rtol=1e-5, atol=1e-5 * np.abs(inverse).max()) and np.isclose(found[g].cutoff, cutoff)
    assert squared(x[:200], np.array([found["g"][f"m_{k}"] for k in range(D)]), np.array(found["g"].precision).reshape(D, D)).min() > found["g"].cutoff


def test_small_groups_have_a_distance(spark):
    text = lambda k: " ".join(f"word{(k * 7 + j * j) % 9973}" for j in range(40 + k % 20))
    rows = [(k, text(k), "en", f"s{k % 20}") for k in range(120)] + [(200 + k, text(k), "fr", "f") for k in range(3)]
    rows += [(300, " ".join("#|<>" * 5 + str(k) for k in range(60)), "en", "s0"), (301, "too short", "de", "d")]
    got = {r.doc_id: r for r in O.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(r.distance2 is not None for r in got.values())
    assert [i for i, r in got.items() if not r.kept and not r.base_failed] == [300]
