"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose values were exchanged keeps its template.
Windows of words are hash-joined with the benchmark's twice: by their template, in which a run of names is one place, and
by the words themselves without regard to case. What stands in the placeholders is then compared: in a window each value
of the item must stand for one value of the document. All of it is DataFrame code.

The search is whole: every window of every text is looked up. Only texts with a hit move, to be compared with their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import split_join
from tessera.runtime import materialise

WINDOW, STRIDE, COVERAGE, LITERALS = 8, 4, 0.5, 3
#: Broadcast the benchmark's windows, or the keys of texts with a hit, up to so many; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Units that become a placeholder of their own, and words that are numbers (of English; both are parameters).
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "lb", "lbs", "pound", "pounds",
    "ounce", "ounces", "oz", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours",
    "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "degrees", "mph", "kmh",
)
NUMBER_WORDS = (
    "zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "dozen", "half", "twice",
)
_NAME, _NUMBER, _UNIT, _JOINT = "\ue000", "\ue001", "\ue002", "\ue003"
_TEMPLATE, _WORDS = 0, 1


def _plain(text: Column, units: tuple[str, ...] = UNITS) -> Column:
    """Words without punctuation, one space between: what a template and its values are read from. Numbers keep their
    sign and point, but not the commas between thousands; signs between numbers part them, and so do units behind them."""
    signs = F.replace(text, F.lit("−"), F.lit("-"))
    parted = F.regexp_replace(signs, r"[-–/:](?<=\p{Nd}.)(?=\p{Nd})", " ")
    # patterns begin with the class that most characters aren't in, which ends a try at once
    bare = F.regexp_replace(parted, r"(?=[^\p{L}\p{N}\s])(?:[^\p{L}\p{N}\s.,-]+|[.,](?!\p{Nd})|(?<=\p{L})[.,]|(?<=\p{Nd}),(?=\p{Nd}{3}(?!\p{Nd}))|-(?!\.?\p{Nd})|(?<=[\p{L}\p{N}])-)", "")
    apart = F.regexp_replace(bare, rf"(?<=\p{{Nd}})(?=(?:{'|'.join(units)})(?![\p{{L}}\p{{N}}]))", " ")
    return F.trim(F.regexp_replace(F.when(signs.rlike(r"\p{Nd}"), apart).otherwise(F.regexp_replace(text, r"[^\p{L}\p{N}\s]+", "")), r"[^\S ]\s*| \s+", " "))


def _marked(plain: Column) -> Column:
    """Runs of names in one piece: words that begin with a capital and a small letter."""
    return F.regexp_replace(plain, r"(?<![^ ])(\p{Lu}\p{Ll}[^ ]*) (?=\p{Lu}\p{Ll})", f"$1{_JOINT}")


def _template(plain: Column, units: tuple[str, ...], numbers: tuple[str, ...]) -> Column:
    """Template words of _plain() text, one for each word of its _marked() form. The kind of a word depends on the word alone, so windows of equal words have equal
    templates wherever they stand; words that are no value are taken in lower case."""
    t = F.regexp_replace(plain, r"(?=[-.,\p{Nd}])(?<![^ ])-?[.,]?\p{Nd}[^ ]*", _NUMBER)
    t = F.lower(F.regexp_replace(t, r"\p{Lu}(?<![^ ].)\p{Ll}[^ ]*", _NAME))
    t = F.split(F.regexp_replace(t, f"{_NAME}(?: {_NAME})+", _NAME), " ")
    return F.transform(t, lambda x: F.when(x.isin(*units), _UNIT).when(x.isin(*numbers), _NUMBER).otherwise(x))


def _folded(text: Column) -> Column:
    """Words without regard to case (by capitals, so that a sharp s is two letters)."""
    return F.split(F.lower(F.upper(text)), " ")


def _runs(hashes: str, n: int) -> str:
    """An array with a hash of every n neighbours in an array of hashes. Runs of a power of two are made of two halves, and
    others of two such runs that overlap, so that each needs a few steps, not n."""
    run, p, held = hashes, 1, f"slice({{v}}, 1, greatest(size({hashes}) - {n - 1}, 0))"
    pairs = lambda v, at: f"zip_with({v}, slice({v}, {at + 1}, size({v})), (a, b) -> xxhash64({n}, a, b))"
    steps = []
    while p < n:
        at = min(p, n - p)
        steps.append(at)
        p += at
    for k, at in enumerate(steps or [0]):  # each array is made once
        run = f"element_at(transform(array({run}), v{k} -> {pairs(f'v{k}', at)}), 1)"
    return held.format(v=run)


def _windows(sizes: list[int]) -> Column:
    """array<struct<track, pos, size, h>> of the windows of each size, by template and by words."""
    return F.expr(f"concat({', '.join(f'transform({_runs(x, n)}, (h, i) -> struct({track} as track, i as pos, {n} as size, h as h))' for n in sizes for track, x in ((_TEMPLATE, 'th'), (_WORDS, 'fh')))})")


_SLOT = f"('{_NAME}', '{_NUMBER}', '{_UNIT}')"
#: The values in the placeholders of the window w, in order; windows of words have none.
_VALUES = f"if(w.track = {_WORDS}, array(), transform(filter(sequence(w.pos + 1, w.pos + w.size), j -> element_at(words, j) in {_SLOT}), j -> element_at(values, j)))"


def _words(texts: DataFrame, units: tuple[str, ...], numbers: tuple[str, ...], *keys: str) -> DataFrame:
    """keys, template words with what stands in their place, folded words, and hashes of template and words, of the texts'
    _plain() text p."""
    t = texts.select(*keys, _folded(F.col("p")).alias("folded"), _template(F.col("p"), units, numbers).alias("words"), _folded(_marked(F.col("p"))).alias("values"))
    hashes = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    return t.select("*", hashes("words").alias("th"), hashes("folded").alias("fh"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, stride: int = STRIDE, coverage: float = COVERAGE, literals: int = LITERALS,
    units: tuple[str, ...] = UNITS, numbers: tuple[str, ...] = NUMBER_WORDS,
) -> DataFrame:
    """k1, k2 (key of a distinct text of docs), item_id, n_windows (of the item), n_matched and changed (whether a value
    differs), for each text that holds an item's passage.

    A text holds an item if `coverage` of the item's windows stand in it, on alignments of at least `stride` windows each:
    its windows of words, whatever their case, or its windows of template words of which at least `literals` aren't
    placeholders, if one value of the item is one of the text throughout a window. A run of names counts as one template
    word. An item of fewer words (template words) than a passage needs, window + stride - 1, is one window of all its words.
    Null texts are empty. Items that share a template are found together. n_windows and n_matched are of the windows of
    which the larger share was found.
    """
    least = window + stride - 1
    items = benchmark.filter("text is not null").select("item_id", _plain(F.col("text"), units).alias("p")).filter("p != ''").distinct()
    items = _words(items, units, numbers, "item_id")
    lengths = items.select(F.explode(F.array(F.size("words"), F.size("folded"))).alias("n")).filter(F.col("n") < least)
    short = sorted(r[0] for r in lengths.distinct().collect())  # fewer than `least`
    sizes = [window, *(n for n in short if n != window)]
    n_words = f"if(w.track = {_WORDS}, size(folded), size(words))"
    wanted = items.withColumn("ws", _windows(sizes)).select("item_id", "words", "values", F.explode(F.expr(f"filter(ws, w -> w.size = if({n_words} < {least}, {n_words}, {window}))")).alias("w"))
    marks = f"size(filter(slice(words, w.pos + 1, w.size), x -> x not in {_SLOT}))"
    wanted = wanted.filter(F.expr(f"w.track = {_WORDS} or {marks} >= least({literals}, w.size)"))
    wanted = materialise(wanted.select("item_id", "w.track", F.col("w.pos").alias("item_pos"), "w.size", "w.h", F.expr(_VALUES).alias("item_values")).distinct(), "benchmark-windows")
    small = wanted.count() <= BROADCAST_ROWS
    checked = F.broadcast if small else (lambda df: df)

    rows = docs.select(F.coalesce("text", F.lit("")).alias("t"))
    keys = [F.xxhash64("t").alias("k1"), F.xxhash64(F.lit(7), F.col("t")).alias("k2")]
    every = F.expr(f"concat({', '.join(_runs(x, n) for n in sizes for x in ('th', 'fh'))})")
    first = _words(rows.select(*keys, _plain(F.col("t"), units).alias("p")), units, numbers, "k1", "k2").select("k1", "k2", F.explode(every).alias("h"))
    hit = materialise(first.join(checked(wanted.select("h").distinct()), "h").select("k1", "k2").distinct(), "texts-with-a-hit")

    texts = rows.select("t", *keys)
    texts = texts.join(F.broadcast(hit), ["k1", "k2"], "left_semi") if hit.count() <= BROADCAST_ROWS else split_join(texts, hit, ["k1", "k2"], "left_semi")
    texts = texts.groupBy("k1", "k2").agg(F.first("t").alias("t"))
    texts = _words(texts.select("k1", "k2", _plain(F.col("t"), units).alias("p")), units, numbers, "k1", "k2")
    found = texts.select("k1", "k2", "values", "words", F.explode(_windows(sizes)).alias("w"))
    found = found.join(checked(wanted.select(F.col("h").alias("wh")).distinct()), F.col("w.h") == F.col("wh"), "left_semi")
    found = found.select("k1", "k2", "w.track", "w.pos", "w.size", "w.h", F.expr(_VALUES).alias("values"))
    both = found.join(checked(wanted), ["h", "size", "track"]).select(
        "k1", "k2", "item_id", "track", (F.col("pos") - F.col("item_pos")).alias("shift"), "item_pos", "size", F.arrays_zip(F.col("item_values").alias("a"), F.col("values").alias("b")).alias("pairs")
    )
    one_value = F.size(F.array_distinct("pairs.a")) == F.size(F.array_distinct("pairs"))
    differs = F.exists("pairs", lambda p: p.a != p.b)
    aligned = both.filter(one_value).groupBy("k1", "k2", "item_id", "track", "shift").agg(F.collect_set("item_pos").alias("at"), F.max(differs).alias("changed"), F.max("size").alias("size"))
    aligned = aligned.filter((F.size("at") >= stride) | F.col("size").isin(short))
    totals = wanted.groupBy("item_id", "track").agg(F.count_distinct("item_pos").alias("n_windows"))
    by_track = aligned.groupBy("k1", "k2", "item_id", "track").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_matched"), F.max("changed").alias("changed"))
    by_track = by_track.join(checked(totals), ["item_id", "track"])
    best = F.max_by(F.struct("n_windows", "n_matched"), F.struct(F.col("n_matched") / F.col("n_windows"), "track")).alias("best")
    by_item = by_track.groupBy("k1", "k2", "item_id").agg(best, F.max("changed").alias("changed")).select("k1", "k2", "item_id", "best.*", "changed")
    return by_item.filter(F.col("n_matched") >= coverage * F.col("n_windows"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings: object) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, changed: a row for each document and each item that it holds. Rows of docs
    that repeat give rows that repeat; a null doc_id stays null. See leaks() for what counts."""
    body = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(7), body).alias("k2"))
    return split_join(keys, leaks(docs, benchmark, **settings), ["k1", "k2"]).select("doc_id", "item_id", "n_windows", "n_matched", "changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings: object) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark."""
    names = docs.columns
    body = F.coalesce(F.col("text"), F.lit(""))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(7), body).alias("k2"))
    keys = leaks(docs, benchmark, **settings).select("k1", "k2").distinct()
    return split_join(held, keys, ["k1", "k2"], "left_anti").select(*[F.col("row").getField(c).alias(c) for c in names])
