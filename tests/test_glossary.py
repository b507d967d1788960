"""Glossaries of any size against one term after the other."""

import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import placeholders as P


def fold(glossary, text):
    for k, (source, _) in enumerate(glossary):
        if source:
            text = text.replace(source, P.placeholder(k, 6))
    return text


def unfold(glossary, text):
    for k, (_, target) in enumerate(glossary):
        text = re.sub(rf"(?:\{{\s*)+id\s*_\s*{k:06d}\s*(?:\s*\}})+", lambda m: target, text)  # noqa: B023
    return text


TERM = st.text(alphabet="ab {}_id01", min_size=0, max_size=5)


@given(st.lists(st.tuples(TERM, st.one_of(TERM, st.just("{{id_000002}}"), st.just("x"))), max_size=12), st.text(alphabet="ab {}_id01", max_size=60))
@settings(max_examples=600, deadline=None)
def test_terms_are_the_fold(glossary, text):
    terms = P.Terms(glossary)
    made = terms.replace(text)
    assert made == fold(glossary, text)
    loose = made.replace("{{id_000001", "{ { id _ 000001")
    for x in (text, made, loose):
        assert terms.restore(x) == unfold(glossary, x)


def test_a_large_glossary_in_one_pass(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    glossary = [(word(), f"<{k}>") for k in range(20_000)]
    texts = [" ".join(word() if rng.random() < 0.8 else rng.choice(glossary)[0] for _ in range(60)) for _ in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, ""])], "k int, t string")
    began = time.time()
    made = df.select("k", "t", P.glossary_replace(F.col("t"), glossary).alias("m"))
    rows = made.select("k", "t", "m", P.glossary_restore(F.col("m"), glossary).alias("b")).collect()
    assert time.time() - began < 60
    for r in rows[:40] + rows[-2:]:
        assert r.m == (r.t and fold(glossary, r.t)) or r.t is None and r.m is None
    targets = {P.placeholder(k, 6): t for k, (_, t) in enumerate(glossary)}
    for r in rows:
        assert r.t is None or r.b == re.sub(r"\{\{id_\d{6}\}\}", lambda m: targets[m[0]], r.m)


def test_few_and_many_terms_agree(spark, monkeypatch):
    glossary = [("the", "THE"), ("a b", "x\\1$y"), ("", "none"), ("id", "ID"), ("0", "zero")]
    df = spark.createDataFrame([("the a b and the id 0",), ("{{id_000001}} { id_000000 }",), (None,)], "t string")
    both = []
    for few in (16, 0):
        monkeypatch.setattr(P, "FEW_TERMS", few)
        made = df.select(P.glossary_replace(F.col("t"), glossary).alias("m"), P.glossary_restore(F.col("t"), glossary).alias("r"))
        both.append(made.collect())
    assert both[0] == both[1]
