"""The near-copy stage judges rows without an id too."""

from spindrift.llm import simhash


def test_near_copies_without_an_id(spark):
    base, lone = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    near = lambda w, by: " ".join([*w[:-1], by])
    rows = [(7, " ".join(base)), (None, near(base, "end")), (None, " ".join(base)), (None, " ".join(lone)), (None, " ".join(lone).upper()), (None, near(lone, "end")), (None, "something else"), (9, "Something  else"), (0, "of id zero"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = [(r.doc_id, r.text) for r in simhash.near_dedup(docs).collect()]
    named = [x for x in kept if x[0] is not None]
    assert sorted(named) == [(0, "of id zero"), (7, " ".join(base)), (9, "Something  else")]
    # one of the group that no id names, and the text without words
    others = [t for i, t in kept if i is None]
    assert len(others) == 2 and None in others and any((t or "").lower().startswith("v0 v1 ") for t in others)
