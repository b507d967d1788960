"""Decontamination: passages in other case, with edited values, and of few words besides values."""

import collections
import itertools
import random
import re

from pyspark.sql import functions as F

from tessera.llm import decontaminate as D

QUESTION = "Anna has 12 apples and gives 5 kg of them to Peter before she walks 3 miles home again. How many apples has Anna left now?"


def found(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.item_id): r.changed for r in D.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_other_case(spark):
    street = "Die lange Straße am Fluss hat zwölf Häuser und keines davon ist heute noch ganz bewohnt"
    texts = ["before it " + QUESTION.upper(), QUESTION.lower(), "two three " * 20, street.upper(), street.lower()]
    assert found(spark, texts, [QUESTION, street]) == {(0, 0): False, (1, 0): False, (3, 1): False, (4, 1): False}


def test_leaks_in_other_case_on_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id in (1699, 6420, 8376)")  # upper-case copies
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert got == {(1699, 130), (6420, 37), (8376, 101)}


def test_one_value_edited(spark):
    apples = "Tom has 3 red apples and 5 green pears in the basket that he took to the market on the hill"
    texts = [QUESTION.replace("has Anna left", "has Ann left"), apples.replace("3", "4").replace("5", "4"), apples.replace("Tom", "Ann").replace("5", "3")]
    same = apples.replace("5", "3")  # one number in two roles
    assert found(spark, texts, [QUESTION, apples]) == {(0, 0): True, (1, 1): True, (2, 1): True}
    assert found(spark, [same.replace("3 red", "4 red").replace("3 green", "6 green")], [same]) == {(0, 0): True}


def test_windows_of_few_words(spark):
    gaps = "Ada 1 red box 2 3 Bob 4 runs past 5 6 here 7 8"  # windows 0 and 4 have two words besides values
    other = "Eve 11 red box 12 13 Ian 14 runs past 15 16 here 17 18"
    table = "Anna 12 Bert 13 Carl 14 Dora 15 Emil 16 Fritz 17 Gina 18"
    texts = [f"{'so ' * k}{other} and on it goes" for k in range(4)] + ["the table " + table, table.replace("1", "2")]
    assert found(spark, texts, [gaps, table]) == {**{(k, 0): True for k in range(4)}, (4, 1): False}


def test_values_keep_signs_and_points(spark):
    item = "the old farmer sells 1.5 bags of corn at the market for 3.4 coins and walks home with -5 of them left"
    texts = [item.replace("1.5", "15"), item.replace("3.4", "34"), item.replace("-5", "5"), item, item.replace("1.5", "(1.5)").replace("3.4", "3.4,"), item.replace("farmer", "farmer,")]
    assert found(spark, texts, [item]) == {(0, 0): True, (1, 0): True, (2, 0): True, (3, 0): False, (4, 0): False, (5, 0): False}
    big = "the fair had 1,200 guests on its first day and they ate many of the red apples there"
    assert found(spark, [big.replace("1,200", "1200")], [big]) == {(0, 0): False}


def test_a_run_of_names_is_one_place(spark):
    item = "In May a train from New York City carries 5kg of mail and then it goes on to the coast where Anna Maria Lopez waits for it with her dog and two cats"
    other = item.replace("New York City", "Paris").replace("Anna Maria Lopez", "Tom").replace("5kg", "12 pounds").replace("two", "seven")
    docs, bench = spark.createDataFrame([(0, other)], "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string")
    (r,) = D.contaminated(docs, bench).collect()
    assert r.changed and r.n_matched == r.n_windows


def test_plain_text(spark):
    cases = {"a-b, c.d 1,234.5 -3 .5 7–9 3/4 5kg (-2) x-3 5 kg. 10:30 −4": "ab cd 1234.5 -3 .5 7 9 3 4 5 kg -2 x3 5 kg 10 30 -4", "no digits, here!": "no digits here", "5mg 5miles 5mx": "5 mg 5 miles 5mx"}
    for text, want in cases.items():
        assert spark.range(1).select(D._plain(F.lit(text))).first()[0] == want


# ---- brute force ----------------------------------------------------------------------------------------------------


def tokens(text):
    """(kind or word, value) of template words, and folded words; text of ASCII letters, digits and full stops at ends"""
    plain = re.sub(r"[^A-Za-z0-9 ]", "", text).split()
    kind = lambda w: "#" if w[0].isdigit() or w.lower() in D.NUMBER_WORDS and not re.match("[A-Z][a-z]", w) else "N" if re.match("[A-Z][a-z]", w) else "U" if w.lower() in D.UNITS else w.lower()
    out = []
    for k, run in itertools.groupby(plain, kind):
        run = list(run)
        out += [(k, " ".join(run).lower())] if k == "N" else [(k, w.lower()) for w in run]
    return out, [w.lower() for w in plain]


def by_force(text, item):
    """n_windows, n_matched, changed, or None"""
    (t_doc, w_doc), (t_item, w_item) = tokens(text), tokens(item)
    slots, best, differs = {"#", "N", "U"}, [], False
    for track, doc, own in ((0, t_doc, t_item), (1, [(w, w) for w in w_doc], [(w, w) for w in w_item])):
        size = 8 if len(own) >= 11 else len(own)
        starts = [i for i in range(len(own) - size + 1) if size and (track or sum(k not in slots for k, _ in own[i : i + size]) >= min(3, size))]
        at = collections.defaultdict(dict)
        for i in starts:
            for j in range(len(doc) - size + 1):
                if [k for k, _ in own[i : i + size]] == [k for k, _ in doc[j : j + size]]:
                    pairs = {(a, b) for (k, a), (_, b) in zip(own[i : i + size], doc[j : j + size], strict=True) if k in slots and not track}
                    if len({a for a, _ in pairs}) == len(pairs):
                        at[j - i][i] = any(a != b for a, b in pairs)
        good = [v for v in at.values() if len(v) >= 4 or size < 8 or len(own) < 11]
        matched = {i for v in good for i in v}
        differs |= any(x for v in good for x in v.values())
        if starts and matched:
            best.append((len(matched) / len(starts), track, len(starts), len(matched)))
    if not best or max(best)[0] < 0.5:
        return None
    return (*max(best)[2:], differs)


def test_against_brute_force(spark):
    rng = random.Random(5)
    names, nouns = ["Anna", "Bert", "Carla Maria", "New York", "Paris"], "red old house tree walks slowly over the bridge and sees a small bird near water while rain falls down".split()

    def sentence(n):
        return " ".join(rng.choice(names) if rng.random() < 0.15 else str(rng.randint(1, 99)) if rng.random() < 0.15 else rng.choice(["km", "three"]) if rng.random() < 0.05 else rng.choice(nouns) for _ in range(n))

    items = [sentence(rng.choice([4, 9, 11, 14, 20, 30])) + "." for _ in range(25)]
    texts = []
    for k in range(150):
        t = rng.choice(items)
        for _ in range(rng.randint(0, 3)):
            a = rng.choice([*names, *map(str, range(1, 99))])
            t = t.replace(a, rng.choice([*names, "7", "12"]), rng.choice([1, -1]))
        w = t.split()
        if k % 3 == 0 and len(w) > 3:
            w[rng.randrange(len(w))] = "other"
        t = " ".join(w)
        texts.append(f"{sentence(rng.randint(0, 12))} {t.upper() if k % 7 == 0 else t} {sentence(rng.randint(0, 12))}".strip())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.changed) for r in D.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {(k, i): f for k, t in enumerate(texts) for i, x in enumerate(items) if (f := by_force(t, x))}
    assert len(want) > 100 and got == want


def test_only_texts_with_a_hit_move(spark):
    docs = spark.createDataFrame([(0, QUESTION), (1, "nothing of it")], "doc_id long, text string")
    plan = D.leaks(docs, spark.createDataFrame([(0, QUESTION)], "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
