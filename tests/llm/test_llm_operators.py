"""The ten operators and the pipeline: small cases, brute-force versions, SQL, held-out accuracy, recall."""

import hashlib
import math
import os
import random
import zlib
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from spindrift.llm import common, forest, html, mixing, packing, quality, registry, repeats, secrets, simhash, tokenfile, toxicity

SMALL, DIR = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, schema=DOCS, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in texts], schema)


LONG = "alpha beta gamma delta " * 3000
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two three four five"), (6, "one two three four five"), (7, LONG), (None, "no id here at all"), (8, "Ünïcode 字 😀 words"), (8, "Ünïcode 字 😀 words")]


def odd(spark):
    """Nulls, empties, repeats, a long text, and columns whose names clash with those that operators use."""
    rows = [(i, t, "en", None if i == 4 else "s", None, 1, "x", None, 2.0) for i, t in ODD]
    return spark.createDataFrame(rows, DOCS + ", fp long, ids string, failure_bits long, copy double")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 quality rules


def naive_repeat(words):
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {j for i in at for j in range(i, i + 8)}
    return len(hit)


def test_ledger_measures(spark):
    rng = random.Random(1)
    texts = list(enumerate([" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 7, 8, 9, 15, 16, 40, 90)] + ["x # y\nx # y\n\n |z|"]))
    got = {r.doc_id: r for r in quality.ledger(documents(spark, texts)).collect()}
    for i, t in texts:
        assert got[i].n_repeat_words == naive_repeat(t.split())
    last = got[8]
    assert (last.n_words, last.n_symbols, last.n_dup_lines, last.n_lines, last.word_chars) == (7, 4, 1, 3, 9)


def test_ledger_odd_rows_policies_and_ablations(spark):
    book = quality.ledger(odd(spark))
    assert book.count() == len(ODD)
    assert all(r.n_words == 0 and r.failure_bits & 1 for r in book.where("doc_id <= 3").collect())
    assert quality.quality_filter(empty(spark)).count() == 0
    assert quality.quality_filter(odd(spark)).columns == odd(spark).columns
    rows = quality.ablations(book).collect()
    for p in quality.POLICIES:
        kept = book.where(quality.kept(p)).count()
        own = [r for r in rows if r.policy == p.version]
        assert {r.rule for r in own} == set(p.rules) and all(r.n_kept == kept and r.n_kept_without == kept + r.n_failed_alone for r in own)


# ---- 3 packing


def check_pieces(rows, ids, length):
    from collections import defaultdict

    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for doc, want in ids.items():
        at = 0
        for r in sorted(by[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in want[at : at + r.length]))
            at += r.length
        assert at == len(want)
    sizes = []
    for pieces in seq.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= length
        sizes.append(at)
    assert sum(s < length for s in sizes) <= 1
    return len(sizes)


def test_packing_proportions_and_pieces(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    texts = [(i, f"text number {i} of words " * (1 + i % 5)) for i in range(120)] + [(900, None), (901, ""), (902, "two  spaces   <|endoftext|> end"), (903, LONG)]
    docs = documents(spark, texts).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") == 901, None).otherwise("cold"))
    ids = {i: tk.encode(t or "", add_special_tokens=False).ids + [0] for i, t in texts}
    pieces = packing.pack(docs, {"hot": 0.75, "cold": 0.25}, length=32, per_round=128)
    rows = packing.digests(pieces).collect()
    check_pieces(rows, ids, 32)
    assert packing.sequences(pieces).count() == len({r.sequence_id for r in rows})
    early = [r for r in rows if r.sequence_id < 16]  # four rounds of four sequences
    hot = sum(r.length for r in early if r.doc_id % 3 == 0)
    assert abs(hot - 0.75 * 512) <= 64
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pack(odd(spark)).groupBy("doc_id").count().count() == 9


def tokens_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids + [packing.END]


def played_rounds(lengths, source, credit, length):
    """Deficit round-robin played round by round over queues of packets: the stream's order of (row, packet)."""
    waiting = {s: [(r, j, min(length, n - j)) for r, n in lengths if source[r] == s for j in range(0, n, length)] for s in sorted(credit)}
    deficit, stream, k = dict.fromkeys(waiting, 0.0), [], 0
    while any(waiting.values()):
        k += 1
        for s, queue in waiting.items():
            served = sum(x[2] for x in stream if source[x[0]] == s)
            deficit[s] = k * credit[s] - served  # what all rounds so far have credited, less what was served
            while queue and queue[0][2] <= deficit[s] + 1e-9:
                deficit[s] -= queue[0][2]
                stream.append(queue.pop(0))
    return stream


def test_packing_equals_rounds_played_one_by_one(spark):
    rng = random.Random(12)
    lengths = [(i, rng.choice([1, 3, 20, 40, 100, 302])) for i in range(150)]
    source = {i: rng.choice(["a", "a", "a", "b", "tiny" if i % 30 == 0 else "c"]) for i, _ in lengths}
    credit = {"a": 40.0, "b": 20.5, "c": 3.0, "tiny": 0.25}
    rows = spark.createDataFrame([(i, source[i], n) for i, n in lengths], "row long, source string, n long")
    queued = packing.queues(rows, 1).join(spark.createDataFrame(list(credit.items()), "source string, credit double"), "source")
    order = [r.row for r in queued.orderBy("source", "at").collect()]
    got = [(r.row, r.start, r.length) for r in packing.placed(queued, 32).orderBy("pos").collect()]
    assert got == played_rounds(sorted(lengths, key=lambda x: order.index(x[0])), source, credit, 32)
    at = 0
    for r in packing.placed(queued, 32).orderBy("pos").collect():
        assert r.pos == at
        at += r.length


def test_packing_of_sources_without_a_proportion(spark):
    text = " ".join(["word"] * 302)
    docs = documents(spark, [(i, text) for i in range(40)]).withColumn("source", F.when(F.col("doc_id") == 7, "unlisted").when(F.col("doc_id") == 8, "small").otherwise("s"))
    rows = packing.digests(packing.pack(docs, {"s": 1.0, "small": 1e-7})).collect()
    assert all(sum(r.doc_id == i for r in rows) <= 2 for i in (7, 8)) and sum(r.length for r in rows) == 40 * 303
    check_pieces(rows, dict.fromkeys(range(40), tokens_of(text)), 1024)


# ---- 4 html


def test_main_text():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=1>Menu</a></nav><div class="cookie-notice">We use cookies, many, many</div>
    <article><h1>Title &amp; more</h1><p>First, paragraph,  with <a href=x>link</a>
    text<p>Second &eacute;</p><ul><li>item one<li>item two</ul><div id="comments"><p>I, a reader, say, so</p></div><script>var t = "</p>";</script></article>
    <aside>Side, bar</aside><form>Name <input></form><footer>Foot</footer>"""
    assert html.main_text(page) == "Title & more\nFirst, paragraph, with link text\nSecond é\nitem one\nitem two"
    assert [html.main_text(x) for x in (None, "", "<p></p>", "just  text", "<b>x</b> < y")] == ["", "", "", "just text", "x < y"]
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert html.main_text(deep) == "deep text"


def test_main_text_keeps_whole_articles():
    for n in (1, 12):  # short and long pages
        body = "".join(f"<p>{'long text, ' * 50}{i}</p>" for i in range(n))
        page = f"<div><ul><li><a href=x>elsewhere</a></li></ul></div><article><p>Lead.</p><h3>Part</h3><div>{body}</div><p>End.</p></article>"
        said = html.main_text(page).split("\n")
        assert said[:2] == ["Lead.", "Part"] and said[-1] == "End." and len(said) == n + 3
    parts = '<section id="discussion"><p>We discuss.</p></section><p class="notice">Note this.</p><div id="related-work"><p>Others did.</p></div><p>At <span class="share-price">12</span> a share.</p>'
    gone = '<div class="related-posts"><ul><li><a href=x>More of it</a></li></ul></div><div class="search"><p>Find</p><input></div><div class="comments"><p>first!</p></div>'
    assert html.main_text(f"<article><p>Body text.</p>{parts}{gone}</article>") == "Body text.\nWe discuss.\nNote this.\nOthers did.\nAt 12 a share."


def test_main_text_of_hostile_pages_in_little_time():
    import time

    n = 100_000
    pages = ["<div>x" * n, "<a " * n, '<a "' * n, "<p>" * n + "x", "<b>" * n + "<p>x" * 50, "<aside>" * n, "<script>" * n, "<!--" * n, "</div>" * n, "<nav><div>" * n + "</nav>", '<div class="share">' * n + "<input>" * n, "<p>a<b><i><u><s><em>b" * (n // 10)]
    for page in pages:
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 8, page[:20]
    assert html.main_text("<div>" * 20_000 + "<p>deep, deep text</p>") == "deep, deep text"
    assert html.main_text('<p>x <y and "more') == 'x <y and "more' and html.main_text('<p title="a>b">c</p>') == "c"


def test_main_text_after_unclosed_parts():
    assert html.main_text("<div><div><aside>ad</div></div><article><p>Kept, all of it.</p></article>") == "Kept, all of it."
    assert html.main_text("<article><p>One.<b><i><u><s><em>deep</p><p>Two.</p></article>") == "One.deep\nTwo."


@pytest.mark.parametrize("seed", range(8))
def test_main_text_of_pages_made_of_known_parts(seed):
    """Pages put together from an article and what stands around it: exactly the article's blocks come out."""
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(["alpha", "béta", "gamma,", "delta", "x&amp;y", "t &lt; u"]) for _ in range(n))
    blocks = [words(rng.randrange(20, 90)) for _ in range(rng.randrange(4, 12))]
    marked = [f"<p>{b.replace('delta', '<em>delta</em>')}</p>" if rng.random() < 0.7 else f"<blockquote>{b}</blockquote>" for b in blocks]
    links = lambda n: "".join(f'<li><a href="/{i}">{words(3)}</a></li>' for i in range(n))
    rest = [
        f"<nav><ul>{links(9)}</ul></nav>", f'<div class="sidebar"><p>{words(30)}</p></div>', f"<footer><p>{words(25)}</p></footer>", f'<div id="comments"><p>{words(40)}</p><p>{words(40)}</p></div>',
        f"<form><p>{words(12)}</p><input name=q></form>", f'<div class="advert">{words(20)}</div>', f"<script>var x = '<p>{words(9)}</p>';</script>", "<!-- <p>no</p> -->", f"<header><h2>{words(4)}</h2></header>",
    ]
    rng.shuffle(rest)
    cut = rng.randrange(len(rest))
    body = "\n  ".join(marked)
    wrap = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", '<div class="content">{}</div>', "<table><tr><td>{}</td></tr></table>"])
    page = f"<html><body>{''.join(rest[:cut])}{wrap.format(body)}{''.join(rest[cut:])}</body></html>"
    assert html.main_text(page) == "\n".join(" ".join(b.split()).replace("&amp;", "&").replace("&lt;", "<") for b in blocks)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a, b</p>"), (1, "u", "<p>a, b</p>"), (None, None, None)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract(pages).collect()) == [(0, "", 0), (1, "a, b", 4), (1, "a, b", 4)]
    clash = pages.withColumns({"text": F.lit("no"), "n_chars": F.lit(-1)})
    assert {r.text for r in html.extract(clash).collect()} == {"", "a, b"} and html.extract(pages.limit(0)).count() == 0


# ---- 5 simhash


def naive_print(text):
    import xxhash

    table = {c: c + 32 for c in range(65, 91)}
    words = "".join(" " if c in " \t\n\x0b\f\r" else c for c in (text or "").translate(table)).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = list(prints.items())
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in prints}


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(900)]
    texts = [(0, None), (1, "   "), (2, "One Two"), (3, "one two"), (4, "É one two three")]
    for i in range(40):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(900)] = "zz"
        texts.append((10 + i, " ".join(words) if i % 3 else " ".join(rng.choice(base) for _ in range(200))))
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.clusters(documents(spark, texts)).collect()}
    prints = {i: naive_print(t) for i, t in texts}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == naive_components(prints)


def test_links_are_all_found(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps |= {x, x ^ (1 << rng.randrange(64)), x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    fps |= {0, 1, 3, 7, 15, 2**63}
    fps = {simhash._signed(x) for x in fps}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in simhash.components(chain).collect()} == {0}


def test_near_dedup_by_five_word_shingles(spark, monkeypatch):
    """Equals brute force: links at 0.8 or more and no others, in a large group with centres too, and judges rows of one id by their words."""
    monkeypatch.setattr(simhash, "CENTRES", 2)
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 200))) for _ in range(40)]
    for i in range(60):  # edits at all degrees, around 0.8 too
        w = texts[i % 20].split()
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w).upper() if i % 5 == 0 else " ".join(w))
    for i in range(40):  # one loose group
        w = texts[39].split()
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    grams = []
    for t in texts:
        w = t.lower().split()
        grams.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i, a in enumerate(grams):
        for j in range(i):
            if 5 * len(a & grams[j]) >= 4 * len(a | grams[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    want = sorted({r for r in root})
    assert 40 < len(want) < 120
    assert sorted(r.doc_id for r in simhash.near_dedup(documents(spark, list(enumerate(texts)))).collect()) == want
    two = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[0])]
    assert sorted(r.text for r in simhash.near_dedup(documents(spark, two)).collect()) == sorted(texts[:2])


def test_shingles_and_digests_equal_plain_ones(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    texts = [None, "", " \n", "One", "a b c d", "A\tb\x0bc\x0cd\re", "Ä a\x85b c\xa0d É e f", "x " * 3000]
    texts += [" ".join(rng.choice("abcD") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    said = [r.s for r in documents(spark, list(enumerate(texts))).orderBy("doc_id").select(F.array(*simhash._said(F.col("text"))).alias("s")).collect()]
    for chunk in (1, 100, 1 << 20):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = list(simhash._shingled(pa.array(texts, pa.string())))
        assert [[d, e] for d, e, _ in got] == said
        for t, (_, _, h) in zip(texts, got, strict=True):
            w = (t or "").encode().lower().split()
            assert len(h) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) and (h[1:] > h[:-1]).all()


def test_near_dedup_of_rows_that_share_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    near, other = [*base[:-1], "end"], [f"v{i}" for i in range(40)]
    rows = [(1, other), (2, base), (2, other), (2, base), (3, near), (4, near), (4, [f"u{i}" for i in range(30)])]
    kept = simhash.near_dedup(documents(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    assert sorted((r.doc_id, r.text.split()[0], len(r.text.split())) for r in kept) == [(1, "v0", 40), (2, "w0", 60), (4, "u0", 30)]


def test_shared_folder_where_none_is_named():
    """One folder for a local application; any other is told by an error."""
    session = lambda master, app: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId=app))
    first = common.shared_dir(session("local[2]", "a"))
    assert first.startswith("file:///") and common.shared_dir(session("local[2]", "a")) == first != common.shared_dir(session("local[2]", "b"))
    for master in ("local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(session(master, "c"))


def test_near_dedup_leaves_only_what_its_result_reads(spark, monkeypatch, tmp_path):
    """Texts whose first digests are all equal are still told apart, and tables on the way are removed."""
    monkeypatch.setattr(simhash, "_said", lambda t, f=simhash._said: (F.lit(7).cast("long"), f(t)[1]))
    monkeypatch.setattr(simhash, "_shingled", lambda t, f=simhash._shingled: ((7, e, h) for _, e, h in f(t)))
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    base = [f"w{i}" for i in range(60)]
    rows = [(1, base), (2, [*base[:-1], "end"]), (3, [f"v{i}" for i in range(40)]), (4, base), (4, [f"u{i}" for i in range(30)])]
    kept = simhash.near_dedup(documents(spark, [(i, " ".join(w)) for i, w in rows]))
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["kept", "shared-ids"]
    assert sorted((r.doc_id, r.text.split()[0]) for r in kept.collect()) == [(1, "w0"), (3, "v0"), (4, "u0")]


def test_near_dedup_odd_rows(spark):
    kept = simhash.near_dedup(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert ids == [-1, 1, 4, 5, 7, 8]
    assert simhash.near_dedup(empty(spark)).count() == 0 and simhash.clusters(odd(spark)).count() == len(ODD)


# ---- 6 mixing


def test_poisson_counts_and_rates(spark):
    docs = documents(spark, [(i, "x" * 10) for i in range(4000)]).withColumn("source", F.when(F.col("doc_id") < 3000, "a").otherwise("b"))
    counts = {r.doc_id: r.n for r in mixing.mix(docs, {"a": 0.25, "b": 0.75}, with_copy=True).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for lo, hi, rate in ((0, 3000, 1 / 3), (3000, 4000, 3.0)):
        own = [counts.get(i, 0) for i in range(lo, hi)]
        assert abs(sum(own) / len(own) - rate) < 5 * math.sqrt(rate / len(own))
        assert abs(own.count(0) / len(own) - math.exp(-rate)) < 0.04
    assert counts == {r.doc_id: r.n for r in mixing.mix(docs.repartition(7), {"a": 0.25, "b": 0.75}, with_copy=True).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(odd(spark)).columns == odd(spark).columns


# ---- 7 token files


@pytest.mark.parametrize("bits", [1, 7, 11, 16, 17, 31])
def test_bit_packing_round_trip(bits):
    import numpy as np

    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 9000).astype(np.uint32)
    parts = np.split(ids, [0, 5, 5, 4096, 8000])
    f = tokenfile.TokenFile(tokenfile.to_file([None, 3, 4, 5, 6, 7], parts, 2**bits))
    assert f.bits == bits
    for i, p in enumerate(parts):
        assert f.ids(i).tolist() == p.tolist()


def test_ids_beyond_the_vocabulary_are_an_error():
    import numpy as np

    with pytest.raises(ValueError):
        tokenfile.pack_bits(np.array([5000], np.uint16), 10)
    with pytest.raises(ValueError):
        tokenfile.to_file([1], [np.array([1001], np.uint16)], 1001)


@pytest.mark.parametrize("most", [1 << 24, 2000])
def test_token_files(spark, tmp_path, most):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenfile.tokenizer_path())
    folder = f"file://{tmp_path}/files"
    rows = [*ODD, *[(100 + i, f"Some {i} text, of words!") for i in range(300)]]
    docs = odd(spark).select("doc_id", "text", "ids").union(spark.createDataFrame([(i, t, "x") for i, t in rows[len(ODD) :]], "doc_id long, text string, ids string"))
    files = tokenfile.write_files(docs, folder, most=most).persist()
    assert sum(r.n_docs for r in files.collect()) == len(rows) and all(r.n_ids < most + 12_100 for r in files.collect())
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in tokenfile.read_files(files, folder).orderBy("start").collect()]
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, b"".join(x.to_bytes(4, "little") for x in ids)))
        at += len(ids)
    assert got == want
    assert tokenfile.write_files(empty(spark), f"{folder}-none").count() == 0


# ---- 8 neighbours


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1 + 4 * (rng.random() < 0.1)) for _ in range(16)]
    same = vec()
    rows = [(i, same if 100 <= i < 180 else vec()) for i in range(1500)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, [1.0]), (None, vec())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in forest.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    data = {i: v for i, v in rows if i is not None and i < 1500}
    recall = []
    assert set(got) == {i for i in data if i % 20 == 0}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        dot = {i: sum(a * b for a, b in zip(v, data[q], strict=True)) for i, v in data.items() if i != q}
        best = sorted(dot, key=lambda i: (-round(dot[i], 9), i))[:20]
        assert all(abs(s - dot[i]) < 1e-9 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        recall.append(len(set(best) & {f[1] for f in found}) / 20)
    assert sum(recall) / len(recall) >= 0.9
    alike = [f[1] for f in got[100] if f[1] in range(100, 180)]
    assert alike == sorted(alike) and alike[0] == 101  # equal scores: smaller ids first, whole
    many = forest.nearest(spark.createDataFrame([(i, [3.0, 4.0]) for i in range(300)] + [(i, [3.0, 4.0]) for i in range(5)], "vec_id long, embedding array<double>")).where("query_id = 40").orderBy("rank").collect()
    assert [r.vec_id for r in many] == list(range(20))
    blocks = {}
    for r in forest.nearest(df, asked_at_once=9).collect():  # queries in nine blocks: the same rows
        blocks.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(x) for q, x in blocks.items()} == {q: sorted(x) for q, x in got.items()}
    clash = df.withColumns({c: F.lit(c) for c in ("tree", "sub", "part", "block", "query_id", "leaf", "score")})
    assert forest.nearest(clash).count() == 20 * len(got)
    huge = forest.nearest(spark.createDataFrame([(i, [1e200 * i, 1.0]) for i in range(3)], "vec_id long, embedding array<double>"))
    assert [(r.query_id, r.rank) for r in huge.orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert forest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    few = forest.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 1, 1.0)]


def test_recall_and_work_at_the_shipped_settings(spark):
    """Random directions in 64 dimensions, as in the given tables: recall of 0.9, with fewer inner products than brute force."""
    import numpy as np

    x = np.random.default_rng(5).normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in forest.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = x[::20] @ x.T
    score[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    assert sum(len(got[20 * i] & set(b)) for i, b in enumerate(best.tolist())) / 6000 >= 0.9
    wood = forest.Forest(x, 7)
    of = wood.leaves(x)
    sizes = [np.bincount(of[:, t], minlength=128) for t in range(forest.TREES)]
    work = [sum(sizes[t][v] for t, v in wood.search(q, (forest.TREES << 7) // forest.PART)) / 6000 for q in x[:100]]
    assert sum(work) / 100 < 0.85


# ---- 9 repeats


def naive_repeats(texts, n=100):
    seen, out = set(), {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            seen.add(b[k : k + n])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [5000, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    passage = " ".join(word() for _ in range(60))
    texts = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 500), (5, "ab" * 300)]
    for i in range(10, 60):
        own = [" ".join(word() for _ in range(rng.randrange(5, 80)))]
        if i % 2:
            cut = rng.randrange(len(passage) // 2)
            own.append(passage[cut : cut + rng.randrange(90, len(passage))])
        own.append(" ".join(word() for _ in range(10)))
        texts.append((i, "".join(own)))
    texts += [(70, texts[20][1]), (71, texts[20][1][:-3] + "xyz")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(documents(spark, texts)).collect()}
    assert got == naive_repeats(texts)


def test_repeats_of_repeated_rows(spark):
    """Rows that repeat an id with the same text get one result; later documents lose what they share with it."""
    rng = random.Random(6)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(3))
    rows = [(1, a), (1, a), (2, b), (2, b + c), (3, a + c), (None, c), (None, c)]
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(documents(spark, rows)).collect()))
    assert [x for x in got if x[0] in (0, 1)] == [(0, 400, 0), (0, 400, 0), (1, 400, 0), (1, 400, 0)]
    assert [x for x in got if x[0] == 3] == [(3, 800, 800)] and sorted(x[2] for x in got if x[0] == 2) in ([0, 800], [400, 400])


def test_repeats_odd_rows(spark):
    rows = repeats.remove_repeats(odd(spark)).collect()
    assert len(rows) == len(ODD) and repeats.remove_repeats(empty(spark)).count() == 0
    assert {r.n_removed for r in rows if r.doc_id != 7} == {0}


# ---- 10 secrets


def test_secrets_spans_and_links(spark):
    key40 = "Ab1" + "xYz9/+" * 6 + "Q"
    texts = [
        (1, f'😀 PassWord: "hunter22" token=abc {"a" * 24} {"f" * 23}'),
        (2, f"AKIA{'A1' * 8} then {key40} at https://db.example.com/x"),
        (3, f"alone {key40} and https://db.example.com"),
        (4, "AKIA123"), (5, None), (6, "password=token: abcdefgh"),
        (7, f"AKIA{'A1' * 8}" + " far" * 80 + f" {key40}"),
    ]
    got = {r.doc_id: r for r in secrets.scan(documents(spark, texts)).collect()}
    kinds = lambda i: [(secrets.KINDS[s.kind], texts[i - 1][1][s.start : s.end]) for s in got[i].spans]
    assert kinds(1) == [("assign", 'PassWord: "hunter22'), ("hex", "a" * 24)]
    assert [k for k, _ in kinds(2)] == ["access", "key", "endpoint"]
    assert kinds(3) == [("key", key40)] and got[3].base == []  # an endpoint complements a key; the endpoint itself lacks an identifier
    assert kinds(4) == [] and got[5].spans == [] and kinds(6) == []
    assert [k for k, _ in kinds(7)] == ["access"]
    clean = {r.doc_id: r.text for r in secrets.redact(documents(spark, texts)).collect()}
    assert clean[1] == f'😀 [SECRET]" token=abc [SECRET] {"f" * 23}' and clean[4] == "AKIA123" and clean[5] is None
    assert secrets.redact(odd(spark)).count() == len(ODD) and secrets.scan(empty(spark)).count() == 0


def naive_linked(spans):
    near = lambda w, p: p[0] <= w[2] + secrets.SCOPE and p[2] >= w[0] - secrets.SCOPE
    hit = lambda w, *kinds: any(near(w, p) for p in spans if p[1] in kinds)
    good = {3: lambda w: hit(w, 0, 2, 4, 5), 4: lambda w: hit(w, 1, 3, 5), 5: lambda w: hit(w, 1, 3) and hit(w, 0, 2, 4)}
    return [w for w in spans if w[1] >= 3 and good[w[1]](w)]


def test_secret_links_equal_all_pairs(spark):
    rng = random.Random(8)
    docs = []
    for i in range(60):
        starts = [rng.randrange(4000) for _ in range(rng.randrange(1, 30))]
        docs.append((i, [(a, rng.randrange(6), a + rng.choice([8, 40, 500])) for a in starts]))
    df = spark.createDataFrame(docs, f"id long, spans array<{secrets._SPAN}>")
    for r in df.select("id", secrets._linked(F.col("spans")).alias("got")).collect():
        assert sorted(tuple(x) for x in r.got) == sorted(naive_linked(docs[r.id][1]))


def naive_redact(text, spans):
    out, at = [], 0
    for a, e in sorted((s.start, s.end) for s in spans):
        if a >= at:
            out += [text[at:a], secrets.REDACTED]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_many_secrets_in_long_texts(spark):
    """A hundred thousand spans in a text are found in a sweep, and redaction equals a plain loop."""
    assert secrets.scan(documents(spark, [(1, "token=abcdefgh " * 100_000)])).collect()[0].n_assign == 100_000
    rng = random.Random(3)
    far = "".join("😀x"[rng.randrange(2)] for _ in range(30_000))
    texts = [(1, "password=hunter22 " * 10_000), (2, (f"AKIA{'A1' * 8} https://a.b token: abcdefgh\n" * 2000)), (3, far + "secret=abcdefgh" + far + f" {'f' * 9000} tail"), (4, "password=token=abcdefgh" + " x" * 5000)]
    docs = documents(spark, texts)
    spans = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    assert len(spans[1]) == 10_000 and len(spans[2]) == 6000
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(docs).collect()}
    for i, t in texts:
        want = naive_redact(t, spans[i])
        assert got[i] == (want, len(want) if spans[i] else len(t))


CLASHES = ["row", "text_", "n_words", "n_lines", "n_symbols", "n_exclamations", "failure_bits", "of_words", "found", "base", "spans", "n_hex", "clean", "_w", "_assign", "_cdf", "_key", "_n", "cdf", "n", "u", "place", "copy", "source_key", "said_", "id_", "place_", "node", "root", "k"]


@pytest.mark.parametrize("stage", ["quality", "near", "secrets", "mixing"])
def test_stages_keep_columns_of_any_name(spark, stage):
    """Names that operators use inside pass through unread, with their values."""
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{long} {i} password=hunter22", "en", "s", 7, *[f"{c}{i}" for c in CLASHES]) for i in (1, 20, 300)]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in CLASHES))
    run = {"quality": quality.quality_filter, "near": simhash.near_dedup, "secrets": secrets.redact, "mixing": lambda d: mixing.mix(d, size=3.0)}[stage]
    out = run(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHES)
    assert secrets.scan(docs).count() == 3 and quality.ledger(docs).count() == 3 and mixing.mix(docs, with_copy=True).columns == [*[c for c in docs.columns if c != "copy"], "copy"]


# ---- 2 toxicity


@needs_data
def test_toxicity_on_held_out_rows(spark):
    from pyspark.sql import SparkSession  # noqa: F401

    folder = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else DIR
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op2_toxicity(spark, folder).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / max(1, sum(r.toxic for r in rows)) >= 0.85 and hit / max(1, sum(r.predicted for r in rows)) >= 0.85
    assert all(0 <= r.score <= 1 for r in rows) and docs.count() == toxicity.op2_toxicity(spark, folder).count()


def test_toxicity_near_you_at_any_length():
    lexicon, at = {"idiot": (50, 0)}, toxicity.FEATURES.index("near_you")
    for n in (100, 1999, 2000, 3000):
        words = "you a b c d e f g h i j k idiot l m n o p q r s t".split() * n + ["idiot", "x", "you"]
        near = {j for i, w in enumerate(words) if w == "you" for j in range(i - 5, i + 6)}
        want = sum(w == "idiot" and i in near for i, w in enumerate(words))
        assert want and toxicity.features(" ".join(words), lexicon, (100, 100))[at] == pytest.approx(100.0 * want / len(words))


def test_toxicity_counts_all_hits_and_terms():
    lexicon, at = {"idiot": (50, 0), **{f"w{i}": (50, 0) for i in range(300)}}, toxicity.FEATURES.index
    for n in (49, 50, 51, 300):
        got = toxicity.features(" ".join(f"w{i}" for i in range(n)), lexicon, (100, 100))
        assert got[at("hits")] == got[at("kinds")] == pytest.approx(math.log1p(n))


def test_calibration_lies_on_the_curve(spark):
    xs, ys = toxicity.middles([0.1, 0.3, 0.4, 0.8, 0.9], [0.0, 0.0, 0.5, 0.5, 1.0])
    assert (xs, ys) == ([0.2, pytest.approx(0.6), 0.9], [0.0, 0.5, 1.0])
    rows = spark.createDataFrame([(0.0,), (0.2,), (0.4,), (0.6,), (0.75,), (1.0,)], "raw double")
    assert [r.s for r in rows.select(toxicity.on_curve(F.col("raw"), xs, ys).alias("s")).collect()] == pytest.approx([0, 0, 0.25, 0.5, 0.75, 1])
    assert rows.select(toxicity.on_curve(F.col("raw"), [0.5], [0.7]).alias("s")).distinct().collect()[0].s == 0.7


def test_toxicity_of_repeated_rows_and_long_texts(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(300))
    rows = [(i, " ".join(word() for _ in range(40)) + (" zorp glim" * (1 + i % 3) if i % 4 == 0 else "")) for i in range(400)]
    rows += [(4, rows[4][1]), (1000, "calm words " * 30_000 + "zorp glim"), (1001, ""), (1001, None)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(4, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.score) for r in toxicity.score(docs, labels).collect()]
    assert len(got) == len(rows) and len({s for i, s in got if i == 4}) == 1 and len({s for i, s in got if i == 1001}) == 1
    held = [(s >= 0.3) == (i % 4 == 0) for i, s in got if i < 400 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(held) / len(held) > 0.95


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(odd(spark), none).collect()} == {0.0}
    assert toxicity.score(empty(spark), none).count() == 0


# ---- registered queries


@needs_data
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_registered_query_equals_sql(spark, name):
    from tests.test_entry import against_sql

    against_sql(spark, name, registry.QUERIES, registry.SQL)


def naive_kept(text):
    """The production policy in a plain loop."""
    import re

    import regex

    words = [w for w in re.split("[ \\t-\\r]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^ \\t-\\r]", x)]
    n = len(words)
    bad = [
        n < 20, 100 * naive_repeat(words) > 30 * n, 100 * len(re.findall("[#*$%&|<>]", text)) > 10 * n, 100 * (len(lines) - len(set(lines))) > 50 * len(lines),
        len("".join(words)) > 12 * n, len("".join(words)) < 2 * n, 100 * len(re.findall("[A-Z][A-Z]+", text)) > 50 * n, 100 * text.count("!") > 50 * n, 100 * len(regex.findall(r"\p{L}+", text)) < 60 * n,
    ]
    return not any(bad)


def naive_near(texts):
    """The smallest id of each group of texts linked at 0.8 or more over five-word shingles, by all pairs."""
    grams = {}
    for i, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in texts}
    items = list(grams.items())
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    return {i for i in texts if root[i] == i}


def naive_scan(text):
    """All reported spans by Python's own regular expressions and all pairs."""
    import re

    spans = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, text)]
    spans += [(m.start(), 3, m.end()) for m in re.finditer(secrets.SESSION, text)]
    spans += [(m.start(), 4, m.end()) for m in re.finditer(secrets.KEY, text) if len(m[0]) == 40 and all(re.search(c, m[0]) for c in ("[a-z]", "[A-Z]", "[0-9]"))]
    spans += [(m.start(), 5, m.end()) for m in re.finditer(secrets.ENDPOINT, text)]
    return sorted([x for x in spans if x[1] < 3] + naive_linked(spans))


def naive_copies(rows, seed=mixing.SEED):
    """Copies of each document: the Poisson distribution of its source, inverted at its own number."""
    size, out = {}, {}
    for r in rows:
        size[r[1]] = size.get(r[1], 0) + max(1, len(r[2]))
    weight = {k: n**mixing.FLATTEN for k, n in size.items()}
    for doc, source, _ in rows:
        rate = weight[source] / sum(weight.values()) * sum(size.values()) / size[source]
        u = (int(hashlib.md5(f"{seed}:{doc}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p = 0, math.exp(-rate)
        c = p
        while c < u and k < 500:
            k += 1
            p *= rate / k
            c += p
        out[doc] = k
    return out


@needs_data
def test_pipeline_equals_a_plain_version(spark):
    """Every stage again in plain Python, on what the stage before kept: no code of the pipeline but its patterns and constants."""
    from types import SimpleNamespace

    import corpus_pipeline

    rows = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    texts = {i: r.text for i, r in rows.items() if naive_kept(r.text or "")}
    once = naive_near(texts)
    clean = {i: naive_redact(texts[i], [SimpleNamespace(start=a, end=e) for a, _, e in naive_scan(texts[i])]) for i in once}
    copies = naive_copies([(i, rows[i].source or "", t) for i, t in clean.items()])
    want = {}
    for i, n in copies.items():
        if n:
            want[i] = (n, tokens_of(clean[i]))
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == set(want)
    total = 0
    for i, (n, ids) in want.items():
        own = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert sum(x[1] for x in own) == n * len(ids) and [x[0] for x in own].count(0) == n
        assert all(c == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + m])) for a, m, c in own)
        total += n * len(ids)
    assert len({r.sequence_id for r in got}) == math.ceil(total / 1024)
