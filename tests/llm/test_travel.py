"""What the near-copy stage and the phrases shuffle: no whole texts for a check of pairs, and no prefixes of windows that are not added up."""

from spindrift.llm import phrases, simhash


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_stay_where_they_are_read(spark, monkeypatch):
    said = " ".join(f"w{i}" for i in range(60))
    # two near copies and a copy, an id shared by another text, and texts nobody asks for
    rows = [(1, said), (2, said + " more"), (3, said.upper()), (2, "another text of the same id, with words enough"), *[(i, f"alone {i} " * (i % 7 + 3)) for i in range(10, 60)]]
    docs, made, plain = spark.createDataFrame(rows, "doc_id long, text string"), [], simhash.written

    def kept(df, name, **more):
        made.append((name, plan(df)))
        return plain(df, name, **more)

    monkeypatch.setattr(simhash, "written", kept)
    for bits in (27, 16):
        monkeypatch.setattr(simhash, "ASKED_BITS", bits)
        left = sorted((r["doc_id"], r["text"]) for r in simhash.near_dedup(docs).collect())
        assert left == sorted([rows[0], *rows[3:]])
    cut = [p for name, p in made if name.startswith("star-links") and "MapInArrow" in p and "text" in p]
    assert cut
    for p in cut:  # texts are cut before anything is joined or dealt
        assert "Join" not in p.split("MapInArrow", 1)[1]


def test_bitmap_of_what_is_asked_for(spark):
    at = [1, 9, 32768, 32769, 65536]
    got = simhash._asked(spark.createDataFrame([(x,) for x in at], "at long"), 16)
    assert len(got) == 1 << 13
    assert [i + 1 for i in range(1 << 16) if got[i >> 3] >> (i & 7) & 1] == at


def test_windows_are_added_up_before_their_prefixes_are_made(spark):
    docs = spark.createDataFrame([("en", "a b c d e. a b c. A b c d")] * 4, "lang string, text string")
    counts = phrases.counts(docs, 4, 15)
    below = plan(counts).split("Expand", 1)[1].split("MapInArrow", 1)[0]
    assert "Aggregate [lang" in below
    found = {tuple(r["words"]): r["f"] for r in counts.collect()}
    assert found[()] == 48 and found["a", "b", "c", "d"] == 8 and found["a", "b", "c"] == 12 and found["b", "c", "d", "e"] == 4 and found["e",] == 4
