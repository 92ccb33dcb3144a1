"""Literal cases and naive versions of the operators outside ``llm``."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import corpus as C
from spindrift.operators import evaluation as E
from spindrift.operators import novelty as N
from spindrift.operators import progress as P
from spindrift.operators import ratelimit as L
from spindrift.operators import retrieval as R
from spindrift.sources import io


def test_metrics_with_duplicates_in_a_group(spark):
    import math

    ranking = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 4, "c"), ("q", 3, "x")], "query_id string, rank int, doc_id string")
    qrels = spark.createDataFrame([("q", "g1", 3, "a"), ("q", "g1", 3, "b"), ("q", "g2", 2, "c"), ("z", "g", 1, "a")], "query_id string, group_id string, grade int, doc_id string")
    queries = spark.createDataFrame([("q",), ("z",)], "query_id string")
    got = {r.query_id: r for r in E.ranking_metrics(ranking, qrels, queries, 5).collect()}
    q = got["q"]
    assert (q.recall, q.mrr, q.raw_hits, q.duplicate_hits, q.matched) == (1.0, 1.0, 3, 1, "g1,g2")
    assert q.ndcg == pytest.approx((7 + 3 / math.log2(5)) / (7 + 3 / math.log2(3)), abs=1e-8)
    assert (got["z"].recall, got["z"].mrr, got["z"].ndcg) == (0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        E.ranking_metrics(ranking, qrels, queries, 0)


def test_limiters_equal_a_sequential_run(spark):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    events = [(f"u{rng.randrange(6)}", t0 + timedelta(seconds=rng.randrange(4000)), i) for i in range(600)]
    df = spark.createDataFrame(events, "key string, ts timestamp_ntz, event_id long")
    for limit, window in ((3, 60), (1, 300)):
        sliding, fixed, logs, starts = {}, {}, {}, {}
        for key, ts, i in sorted(events, key=lambda e: (e[1], e[2])):
            log = [t for t in logs.get(key, []) if t > ts - timedelta(seconds=window)]
            sliding[i] = len(log) < limit
            logs[key] = [*log, ts] if sliding[i] else log
            start, n = starts.get(key, (None, 0))
            start, n = (ts, 1) if start is None or ts >= start + timedelta(seconds=window) else (start, n + 1)
            starts[key], fixed[i] = (start, n), n <= limit
        assert {r.event_id: r.allowed for r in L.rate_limit_sliding(df, limit, window).collect()} == sliding
        assert {r.event_id: r.allowed for r in L.rate_limit_fixed(df, limit, window).collect()} == fixed


def test_novelty_finds_copies_and_leaves_others(spark):
    text = "one two three four five six seven eight nine ten"
    refs = spark.createDataFrame([(1, text), (2, "other words that share nothing with it at all here")], "id long, text string")
    cands = spark.createDataFrame([(10, text.upper() + "!"), (11, "one two three four five six seven eight nine eleven"), (12, "fresh"), (13, None), (14, "")], "id long, text string")
    pairs = N.novelty_join(cands, refs)
    got = {(r.candidate_id, r.reference_id): r for r in pairs.collect()}
    assert set(got) == {(10, 1), (11, 1)} and got[10, 1].exact and not got[11, 1].exact
    assert got[11, 1].containment == pytest.approx(5 / 6, abs=1e-8)
    guard = {r.candidate_id: r.rejected for r in N.novelty_guard(cands, pairs).collect()}
    assert guard == {10: True, 11: True, 12: False, 13: False, 14: False}


def test_merge_and_fallback(spark):
    a = spark.createDataFrame([("q", 1, 7, 0.5), ("p", 1, 1, 0.9), ("p", 2, 2, 0.8)], "query_id string, rank int, doc_id long, score double")
    b = spark.createDataFrame([("q", 1, 3, 0.6), ("q", 2, 7, 0.5), ("p", 1, 4, 1.0)], "query_id string, rank int, doc_id long, score double")
    got = {(r.query_id, r.rank): (r.doc_id, r.fallback) for r in R.vector_topk_fallback(a, b, 2).collect()}
    assert got == {("q", 1): (3, True), ("q", 2): (7, True), ("p", 1): (1, False), ("p", 2): (2, False)}


def test_scores_and_statuses(spark):
    rows = [(1, 1, True, None), (1, 2, True, None), (2, 1, True, None), (2, 2, False, None), (3, 1, False, "x"), (3, 2, False, "y"), (4, 1, False, None), *[(5, i, i == 1, None) for i in range(1, 9)]]
    df = spark.createDataFrame(rows, "submission_id long, test_no int, passed boolean, error string")
    got = {r.submission_id: (r.score, r.status, r.feedback) for r in P.score_submission(df).collect()}
    assert got == {1: (100, "passed", None), 2: (50, "partial", None), 3: (0, "runtime_error", "y"), 4: (0, "failed", None), 5: (12, "partial", None)}


def test_validation_reports_the_first_broken_rule(spark):
    case = lambda i, hidden=True, size=1: {"input": str(i) * size, "expected_output": "o", "is_hidden": hidden}
    good = [case(1, False), case(2), case(3), case(4)]
    base = {"topic": "t", "difficulty": "easy", "asked_topic": "t", "asked_difficulty": "easy", "statement": "s", "solution": "int main() {}", "explanation": "e", "test_cases": good}
    cases = [({}, None), ({"topic": "x"}, "topic"), ({"statement": " "}, "empty_statement"), ({"solution": "x" * 5001}, "long_solution"), ({"solution": "// int main()\nvoid f();"}, "no_main"), ({"solution": "int main() { ifstream f; }"}, "file_access"), ({"test_cases": good[:3]}, "test_count"), ({"test_cases": [case(i) for i in range(4)]}, "public_count"), ({"test_cases": [*good, case(1)]}, "duplicate_test"), ({"test_cases": [*good, case(5, True, 501)]}, "long_test")]
    schema = "id int, topic string, difficulty string, asked_topic string, asked_difficulty string, statement string, solution string, explanation string, test_cases array<struct<input:string,expected_output:string,is_hidden:boolean>>"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    df = spark.createDataFrame([tuple((base | change | {"id": i})[n] for n in names) for i, (change, _) in enumerate(cases)], schema)
    assert {r.id: r.broken for r in C.validate_exercise(df).collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_duplicate_files_keep_the_first(spark):
    rows = [("p", "b.pdf", "1"), ("p", "A.pdf", "1"), ("p", "A.pdf", "2"), ("p", "c.pdf", "3"), ("q", "d.pdf", "1")]
    got = {r.path: r.skipped for r in C.dedup_documents_by_id(spark.createDataFrame(rows, "prefix string, path string, id string")).collect()}
    assert got == {"A.pdf": False, "b.pdf": True, "c.pdf": False, "d.pdf": False}


def test_text_rules(spark):
    df = spark.createDataFrame([("Șir de caractere", "O graful", "a b c xx d e yy f zz", "1a 2b")], "a string, b string, c string, d string")
    r = df.select(T.fold_text(F.col("a")).alias("fold"), C.classify_topic(F.col("a")).alias("strings"), C.classify_topic(F.col("b")).alias("graphs"), T.fragmented_line(F.col("c")).alias("frag"), T.compact_answers(F.col("d")).alias("answers"), T.stable_id(F.lit(2019), F.lit(None).cast("string"), F.lit(1), F.lit("Mate Info"), F.lit("ro"), F.lit(1), F.lit(2)).alias("id")).collect()[0]
    assert (r.fold, r.strings, r.graphs, r.frag, r.answers, r.id) == ("sir de caractere", "strings", "graphs", True, "1:a,2:b", "bac-2019-exam-v01-mate-info-ro-s1-ex2")
    items = C.split_items(spark.createDataFrame([(1, "intro\n1. first\n2. second\nmore")], "id int, text string"))
    assert [(x.number, x.item) for x in items.orderBy("number").collect()] == [(1, "1. first"), (2, "2. second\nmore")]
    assert C.check_items(items, 2).collect()[0].complete and not C.check_items(items, 3).collect()[0].complete


def test_sources_and_sinks(spark, tmp_path):
    golden = tmp_path / "g.json"
    golden.write_text('[{"version": 1, "queries": [{"id": " q1 ", "text": "t", "topic": "a", "topic_filter": null, "relevance_groups": [{"id": "g", "grade": 3, "document_ids": ["d1", "d2"], "rationale": "r"}]}]}]')
    queries, qrels = io.read_golden(spark, str(golden))
    assert queries.collect()[0].query_id == "q1" and sorted(r.doc_id for r in qrels.collect()) == ["d1", "d2"]
    with pytest.raises(ValueError):
        io.write_preview(queries, str(tmp_path / "corpus.json"))
    io.write_preview(queries, str(tmp_path / "x.preview.json"))
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, version int, v string")
    new = spark.createDataFrame([(1, 2, "c")], "id int, version int, v string")
    assert {r.id: r.v for r in io.upsert(old, new, ["id"]).collect()} == {1: "c", 2: "b"}
    (tmp_path / "in").mkdir()
    for n in ("B.PDF", "a.pdf", "c.txt"):
        (tmp_path / "in" / n).write_text("x")
    assert [r.low.rsplit("/", 1)[1] for r in io.scan_files(spark, str(tmp_path / "in"), ".pdf").orderBy("low").collect()] == ["a.pdf", "b.pdf"]


def test_stream_limiter_equals_batch(spark, tmp_path):
    from spindrift.streaming.streams import stream_rate_limit

    t0 = datetime(2024, 1, 1)
    rows = [("u", t0 + timedelta(seconds=10 * i), i) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, event_id long")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    out = str(tmp_path / "out")
    q = stream_rate_limit(stream, 3, 60, "0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.event_id: r.allowed for r in L.rate_limit_sliding(df, 3, 60).collect()}
    got = {r.event_id: r.allowed for r in spark.read.schema("key string, event_id long, allowed boolean").parquet(out).collect()}
    assert got and all(want[i] == a for i, a in got.items())


def test_papers_become_an_audited_corpus(spark):
    from spindrift.operators import papers as A

    def paper(kind, lang, variant, third="Se citește n.", tail=""):
        head = f"Examenul de bacalaureat național 2019\n{kind}\nMatematică-informatică\n{lang}\nVarianta {variant}\n"
        items = lambda n: "\n".join(f"{i}. {third if i == 3 else 'Un număr natural.'}" for i in range(1, n + 1))
        return head + f"SUBIECTUL I\n{items(5)}\nSUBIECTUL al II-lea\n{items(3)}\nSUBIECTUL al III-lea\n{items(3)}{tail}"

    subject, guide = "Toate subiectele sunt obligatorii", "Barem de evaluare"
    compact = paper(guide, "comun pentru limbajele C/C++", 1).replace("\n".join(f"{i}. {'Se citește n.' if i == 3 else 'Un număr natural.'}" for i in range(1, 6)), "1a 2b 3c 4d 5a")
    rows = [
        ("a", paper(subject, "Limbajul C/C++", 1)), ("b", compact), ("c", paper(subject, "Limbajul C/C++", 1)), ("d", paper(subject, "Limbajul Pascal", 1, "Graful reprezentat alăturat.")),
        ("e", paper(subject, "Limbajul C/C++", 2, tail=" (cid:7)")), ("f", "nothing"), ("g", None), ("h", paper(subject, "Limbajul C/C++", 3).replace("SUBIECTUL al II-lea", "SUBIECTUL I")), ("i", paper(subject, "Limbajul C/C++", 4)),
    ]
    read = A.read_papers(spark.createDataFrame(rows, "source string, text string"))
    got = {r.source: r for r in A.audit_records(read).collect()}
    assert {k: (r.skipped, r.n_exercises, r.n_excluded, r.n_graded) for k, r in got.items()} == {
        "a": (False, 11, 0, 0), "b": (False, 0, 0, 11), "c": (True, 0, 0, 0), "d": (False, 8, 3, 0), "e": (True, 0, 0, 0), "f": (True, 0, 0, 0), "g": (True, 0, 0, 0), "h": (True, 0, 0, 0), "i": (False, 11, 0, 0),
    }
    unstated = "exam session is not stated in the PDF"
    assert got["a"].warnings == unstated and got["i"].warnings == f"{unstated}; no matching grading guide found"
    assert got["f"].warnings == "missing or ambiguous year, document type, profile, programming language, variant"
    assert got["h"].warnings == f"{unstated}; duplicate section marker: I" and got["c"].warnings.endswith("duplicate retrieval IDs")
    assert "unresolved embedded-font glyph: (cid:7)" in got["e"].warnings
    docs = {r.id: r for r in A.corpus_documents(read).collect()}
    assert len(docs) == 30 and docs["bac-2019-exam-v01-mi-cpp-s2-ex1"].text == "Context: Bacalaureat 2019; sesiune nespecificată; varianta 1; profil MI; limbaj C/C++; Subiectul II; exercițiul 1.\n\n1. Un număr natural."
    first = next(r for r in read.collect() if r.source == "b").graded[0]
    assert (first.section, first.number, first.item) == ("I", 1, "Răspuns: a")
    empty = A.audit_records(A.read_papers(spark.createDataFrame([], "source string, text string")))
    assert A.build_summary(empty).collect()[0].asDict() == dict.fromkeys(("scanned", "parsed", "skipped", "extracted", "excluded", "warnings"), 0)


def test_glyphs_and_lines_are_repaired(spark):
    from spindrift.operators import papers as A

    cases = [("x (cid:1)(cid:1) 3", "x ← 3"), ("a×××b ££ c", "a ×b ≤ c"), ("« a « b", "a ↔ b"), ("˛ x ˛ [1,2]", "x∈[1,2]"), ("A ¨¨ B", "A ∪ B"), ("Pagina 1 din 3\n\n a \t b\n\n\n\nc \n", "a b\n\nc"), ("é", "é"), (None, None), ("", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, text string")
    assert {r.id: r.text for r in A.normalize_extracted(df).collect()} == {i: w for i, (_, w) in enumerate(cases)}
    reasons = [("⟦unsafe:ambiguous_math_notation⟧", "ambiguous_math_notation"), ("x\n ă î ș \ny", "unreliable_text_layout"), ("a b cd e f gh i jk", "unreliable_text_layout"), ("graful alăturat", "missing_required_visual"), ("graful alăturat, matrice 0 1 1 0 0 1 1 0 1", None), ("Un text", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(reasons)], "id int, text string")
    assert {r.id: r.why for r in df.select("id", A.exclusion_reason(F.col("text")).alias("why")).collect()} == {i: w for i, (_, w) in enumerate(reasons)}


def test_prompts_leave_out_empty_blocks(spark):
    from spindrift.operators import papers as A

    df = spark.createDataFrame([("t", "c"), ("u", ""), ("v", None)], "topic string, context string")
    got = [r.prompt for r in A.render_prompt(df, "About {topic}.{context}", {"context": " See {context}!"}).collect()]
    assert got == ["About t. See c!", "About u.", "About v."]


def test_minhash_recall_and_classes(spark):
    """Links nearly all that the exact join links; equal token sets in any order, and copies, stay reachable."""
    import random

    from spindrift.operators import novelty

    rng = random.Random(7)
    texts = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 80))] for _ in range(60)]
    texts += [[*t[:-1], f"x{i}"] for i, t in enumerate(texts[:30])] + [t[::-1] for t in texts[:20]] + [list(t) for t in texts[10:40]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    exact = {(r.candidate_id, r.reference_id) for r in novelty.jaccard_join(df, df, 0.8).collect() if r.candidate_id < r.reference_id}
    rows = novelty.minhash_candidates(df).collect()
    root = {i: i for i in range(len(texts))}
    for r in rows:
        if r.jaccard == 1.0 and set(texts[r.a]) == set(texts[r.b]):
            root[r.b] = r.a
    pairs = {(r.a, r.b) for r in rows}
    found = [p for p in exact if (x := sorted((root[p[0]], root[p[1]]))) and (x[0] == x[1] or tuple(x) in pairs)]
    assert len(found) >= 0.95 * len(exact) > 70
    assert all(root[i] == min(j for j, u in enumerate(texts) if set(u) == set(t)) for i, t in enumerate(texts))


def test_golden_groups(spark):
    """Groups as written: twice in a query, without documents; each is a violation of its own."""
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    qrels = spark.createDataFrame([(1, "g", 3, 10), (2, "h", 2, 11)], "query_id long, group_id string, grade int, doc_id long")
    groups = spark.createDataFrame([(1, "g", 1), (1, "g", 2), (2, "h", 1), (2, "i", 0), (2, "k", None)], "query_id long, group_id string, n_documents int")
    assert E.golden_checks(queries, qrels).count() == 0
    got = sorted((r.rule, r.query_id, r.item) for r in E.golden_checks(queries, qrels, groups).collect())
    assert got == [("duplicate_group", "1", "g"), ("no_documents", "2", "i"), ("no_documents", "2", "k")]
