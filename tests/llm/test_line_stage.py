"""The pipeline's line stage: pages that are mostly boilerplate, and copies."""

import corpus_pipeline as C


def test_mostly_boilerplate_and_copies(spark):
    rows = [(k, f"menu\nunique {k}\nfooter") for k in range(8)] + [(8 + k, "one text\nof two lines") for k in range(8)] + [(16, "plain")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in C.line_stage(spark, docs, "").collect()}
    want = {i: (f"unique {i}" if i < 8 else t) for i, t in rows}
    assert got == {i: (t, len(t)) for i, t in want.items()}
