"""Alignment of two tokenizers, shared lines and collocations against brute force, odd rows, and the faults mended in main text and toxicity."""

import hashlib
import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from spindrift.llm import align, html, lines, packing, phrases, toxicity
from tests.llm.test_llm_operators import DIR, ODD, SMALL, documents, empty, needs_data, odd
from tests.test_entry import against_sql

TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "one"), (5, "a  b\n\nc  d \n e\nf"), (6, "has ▁ in it"), (7, "<|endoftext|> <s> <0x0A> q"), (8, "Ünï 字 😀 w   　 k z"), (8, "Ünï 字 😀 w   　 k z"),
    (None, "no id here's it"), (9, "\nstart\tx\r\nend\n"), (10, "ab, cd. " * 3000), (11, "x" * 5000), (12, "  two"), (13, "é, ́ a\u0085 b\x1c c×, d÷."), (14, "end. Next: 3.14, it's?! (so)"), (15, "\n\n"), (16, "word\n"),
]


def aligned_plainly(rows):
    """By whole texts and token spans, one after the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = align.paths()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    to_byte, out, count = align.byte_level(), [], Counter()

    def spans(ids, said):
        at, found = 0, []
        for i, x in zip(ids, said, strict=True):
            found.append((at, at + len(x), i))
            at += len(x)
        return found

    for doc, text in rows:
        links, groups, x, y = [], [], [], []
        if text:
            want = f" {text}".encode()
            ia, ib = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            sa = [bytes(to_byte[c] for c in a.id_to_token(i)) for i in ia]
            sb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(sa) == want == b"".join(sb):
                x, y = spans(ia, sa), spans(ib, sb)
        i = j = 0
        while i < len(x) and j < len(y):
            links.append((x[i][2], y[j][2]))
            i, j = i + (x[i][1] <= y[j][1]), j + (y[j][1] <= x[i][1])
        lo = 0
        for end in sorted({s[1] for s in x} & {s[1] for s in y}):
            groups.append("|".join(",".join(str(s[2]) for s in side if lo < s[1] <= end) for side in (x, y)) if len(x) < 3000 else None)
            lo = end
        if len(x) >= 3000:  # the same, without going through all tokens for each group
            ends, parts = sorted({s[1] for s in x} & {s[1] for s in y}), []
            for side in (x, y):
                own, k = [[] for _ in ends], 0
                for s in side:
                    while s[1] > ends[k]:
                        k += 1
                    own[k].append(str(s[2]))
                parts.append([",".join(o) for o in own])
            groups = [f"{p}|{q}" for p, q in zip(*parts, strict=True)]
        count.update(links)
        out.append((doc, len(x), len(y), len(groups), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, b_id), n in count.items():
        best[b_id] = max(best[b_id], n)
    return [(d, na, nb, ng, len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, na, nb, ng, k, g in out]


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_alignment_of_odd_texts(spark, size):
    same(align.align(documents(spark, TEXTS), size=size), aligned_plainly(TEXTS))
    assert align.align(empty(spark)).count() == 0
    same(align.align(odd(spark).selectExpr("*", "doc_id as chunk", "doc_id as units", "doc_id as pairs")), aligned_plainly(ODD))
    nothing = [(1, None), (2, ""), (3, "▁")]
    same(align.align(documents(spark, nothing)), [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)])


@needs_data
def test_alignment_query_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    same(align.op11_align(spark, SMALL), aligned_plainly(rows))


def test_units_are_where_neither_tokenizer_joins():
    texts = [x.encode() for _, x in TEXTS if x]
    of = align._tokenizers(align.paths())
    units, n = align.cut(texts, of.signs)
    said, at = units.to_pylist(), 0
    for t, k in zip(texts, n, strict=True):
        own = said[at : at + k]
        assert "".join(own).encode() == b" " + t
        a, b = of.ids(own)
        assert b"".join(a) == of.ids([f" {t.decode()}"])[0][0] and b"".join(b) == of.ids([f" {t.decode()}"])[1][0]
        at += k


# ---- 12 lines


def dropped_plainly(rows):
    white = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: x.strip(white).translate(lower)
    ids = defaultdict(set)
    for d, own in cut:
        for x in own:
            if len(key(x)) >= 40 and d is not None:
                ids[key(x)].add(d)
    out = []
    for d, own in cut:
        kept = [x for x in own if not (len(ids.get(key(x), ())) >= 5 and d != max(ids[key(x)]))]
        out.append((d, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines_shared_by_documents(spark):
    rng = random.Random(12)
    pool = [f"{'Ärger mit Zeilen, ' * 2}{i:04d}"[:n] for i, n in enumerate((39, 40, 41, 42, 43, 44))]
    rows = [*ODD]
    for i in range(40):
        own = [rng.choice([x.upper() if rng.random() < 0.3 else f"\t {x} \r" if rng.random() < 0.3 else x for x in pool]) if rng.random() < 0.6 else rng.choice(["", " ", "short", f"a line of its own that nobody else has, number {i}"]) for _ in range(rng.randrange(8))]
        rows.append((100 + i // 2 if i < 20 else (None if i % 9 == 0 else 200 + i), "\n".join(own)))
    rows += [(500 + i, "x" * 50) for i in range(4)] + [(503, "x" * 50), (600, "y" * 60 + "\n" + "y" * 60), *[(601 + i, "y" * 60) for i in range(4)]]
    from pyspark.sql import functions as F

    df = documents(spark, rows).withColumns({c: F.lit(1) for c in ("id", "of", "row", "kept", "gone", "h", "g", "keeper")})
    found = lines.drop_lines(df).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.array_join("kept", "\n"), 256))
    same(found, dropped_plainly(rows))
    out = lines.line_dedup(df)
    assert out.columns == df.columns and out.where("text is null").count() == 1 and lines.line_dedup(empty(spark)).count() == 0


# ---- 13 phrases


def collocated_plainly(rows, least, top):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        left = []
        for p, a in good.items():
            cuts = [(int(Fraction(2000000 * a, own[p[:k]] + own[p[k:]])), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items())
            if not inside:
                left.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(left)[:top])]
    return out


def test_phrases(spark):
    rng = random.Random(13)
    words = ["New", "york", "city", "the", "of", "É", "字", "a b", "x\x1cy", "don't", "(so)", "rare1", "rare2"]
    rows = [(None, None), ("en", ""), ("en", " \t\n"), ("de", "...")]
    for _ in range(300):
        said = " ".join(rng.choice(["new York city of the", "the (so) É 字", rng.choice(words), rng.choice(words) + rng.choice([",", ".", " \t", "\r\n", "?"])]) for _ in range(rng.randrange(12)))
        rows.append((rng.choice(["en", "de", None, "und"]), said))
    rows.append(("en", "same same " * 4000))
    df = spark.createDataFrame([(i, t, x, 1, 1) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, words int")
    for least, top, bits in ((30, 2000, phrases.BITS), (5, 7, phrases.BITS), (3, 50, 15)):
        same(phrases.collocations(df, least, top, bits), collocated_plainly(rows, least, top))
    assert phrases.collocations(empty(spark)).count() == 0


def test_phrases_scores_pass_64_bits(spark):
    big = 9 * 10**12
    df = spark.createDataFrame([(big, big, big)], "a long, l long, r long")
    score = df.selectExpr("cast(2000000 as decimal(38,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as s").first().s
    assert score == 1_000_000


@needs_data
@pytest.mark.parametrize("name", ["op12_lines", "op13_phrases"])
def test_new_queries_equal_sql(spark, name):
    from spindrift.llm import registry

    against_sql(spark, name, registry.QUERIES, registry.SQL)


# ---- main text, toxicity, packing


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "col with-menu", "content social-studies", "hero-header", "search-results", "comment-free", "text-hidden-xs"])
def test_a_word_of_a_name_does_not_drop_a_page(name):
    long = [f"{'Some long words, and more of them. ' * 8}{i}" for i in range(4)]
    for extra in ("", '<input type="text">'):
        page = f'<html><body><div class="sidebar"><p>gone</p></div><div class="site-footer">gone</div><div class="{name}">{extra}{"".join(f"<p>{x}</p>" for x in long)}</div><footer>gone</footer></body></html>'
        assert html.main_text(page).split("\n") == long


@pytest.mark.parametrize("n", range(1, 13))
def test_short_blocks_beside_the_best_part_stay(n):
    long = [f"{'Long words, many of them. ' * 9}{i}" for i in range(n)]
    page = f'<div id="c"><h3>Part</h3><p>Short lead.</p><div>{"".join(f"<p>{x}</p>" for x in long)}</div><h3>Next</h3><p>End.</p></div>'
    assert html.main_text(page).split("\n") == ["Part", "Short lead.", *long, "Next", "End."]


@pytest.mark.parametrize("page", ["<a" * 100_000, "<a" * 100_000 + ">", "<a<!" * 60_000, "<" * 200_000])
def test_runs_of_open_tags_are_read_once(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 8


def test_toxic_features_of_one_long_word_are_linear():
    began = time.time()
    got = toxicity.features("a" * 1_000_000 + " b1c" * 10, {}, (1, 1))
    assert time.time() - began < 5 and got[toxicity.FEATURES.index("obscured")] == pytest.approx(100 * 10 / 11)


def test_rows_without_id_are_not_held_out(spark):
    df = documents(spark, [(None, "x")])
    assert [r[0] for r in df.select(toxicity.held_out(df["doc_id"])).collect()] == [False]


def test_packing_shuffles_no_row_by_source_alone(spark):
    import re

    rows = packing.queues(documents(spark, [(1, "a")]).selectExpr("doc_id as row", "source", "n_chars as n"), 4)
    assert "piece" in rows.columns
    credits = packing.credited(rows, None, 1 << 16, 1.0).selectExpr("source", "credit", "explode(sequence(0L, 3L)) as piece")
    joined = rows.join(credits.hint("merge"), ["source", "piece"])._jdf.queryExecution().executedPlan().toString()
    top = joined[: joined.index("Window")]
    assert not re.search(r"hashpartitioning\(source#\d+, \d+\)", top)
