"""The corpus build bound to papers that are made from ``orders``; the SQL tells the results from the orders themselves.

Four orders in a row are one exam: a subject in C++, its guide, the same subject in Pascal, and a second
file of the first. Every seventh paper lacks an item, every seventeenth has a glyph nobody knows, every
fifty-third lacks its profile, and every thirteenth exam has a guide of another variant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import corpus as C
from spindrift.operators import papers as A
from spindrift.operators import progress as P
from spindrift.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_NAME = "'paper-' || lpad(k::VARCHAR, 12, '0')"
_PAPER = f"""base AS (SELECT o_orderkey AS k, o_orderkey // 4 AS v, o_orderkey % 4 AS r FROM orders),
p AS (SELECT k, v, r, {_NAME} AS source, (2016 + v % 5)::INTEGER AS year, CASE WHEN k % 53 <> 0 THEN CASE WHEN v % 2 = 0 THEN 'SN' ELSE 'MI' END END AS profile,
  CASE WHEN r = 1 THEN 'grading' ELSE 'subject' END AS document_type, CASE r WHEN 1 THEN 'C/C++ + Pascal' WHEN 2 THEN 'Pascal' ELSE 'C/C++' END AS language,
  CASE v % 3 WHEN 0 THEN 'simulation' WHEN 1 THEN 'model' END AS session, (v + CASE WHEN r = 1 AND v % 13 = 0 THEN 10000000 ELSE 0 END)::VARCHAR AS variant FROM base),
c AS (SELECT *, CASE WHEN year > 2018 THEN [5, 3, 3] WHEN v % 2 = 0 THEN [2, 4, 4] ELSE [2, 5, 4] END AS n, k % 7 = 0 AS short, k % 17 = 0 AS glyph FROM p),
got AS (SELECT *, [n[1], n[2] - short::INTEGER, n[3]] AS have FROM c),
secs AS (SELECT *, unnest(range(1, 4)) AS s FROM got),
items AS (SELECT *, unnest(range(1, have[s] + 1))::INTEGER AS i FROM secs),
x AS (SELECT *, ['I', 'II', 'III'][s] AS section, (k + 3 * i + s) % 11 = 0 AS bad FROM items),
err AS (SELECT *, CASE WHEN profile IS NULL THEN 'missing or ambiguous profile' WHEN glyph THEN 'PDF skipped because unresolved embedded-font glyphs remain'
  WHEN short THEN 'expected ' || n[2] || CASE WHEN r = 1 THEN ' barem entries' ELSE ' exercises' END || ' in section II, found ' || have[2] END AS early FROM got),
fin AS (SELECT e.*, coalesce(e.early, CASE WHEN e.r = 3 AND f.k IS NOT NULL THEN 'duplicate retrieval IDs' END) AS error FROM err e LEFT JOIN err f ON f.k = e.k - 3 AND f.early IS NULL),
doc AS (SELECT x.*, 'bac-' || year || '-' || coalesce(session, 'exam') || '-v' || lpad(variant, greatest(2, length(variant))::INTEGER, '0') || '-' || lower(profile) || '-' || CASE WHEN language = 'Pascal' THEN 'pascal' ELSE 'cpp' END || '-s' || s || '-ex' || i AS id,
  i || '. ' || CASE WHEN bad THEN 'Graful reprezentat în figura alăturată are ' || (k + i) || ' muchii.' WHEN (k + i) % 3 = 0 THEN 'Scrieți programul care citește o matrice cu ' || (k + i) || ' valori.' ELSE 'Se citește un număr natural n = ' || (k + i) || '.' END AS item FROM x)"""


def _item(k: Column, s: int, i: Column) -> Column:
    n = (k + i).cast("string")
    bad, program = (k + 3 * i + s) % 11 == 0, (k + i) % 3 == 0
    said = F.when(bad, F.concat(F.lit("Graful reprezentat în figura alăturată are "), n, F.lit(" muchii."))).when(program, F.concat(F.lit("Scrieți programul care citește o matrice cu "), n, F.lit(" valori.")))
    return F.concat(i.cast("string"), F.lit(".  "), said.otherwise(F.concat(F.lit("Se citește un număr natural n = "), n, F.lit("."))))


def _items(k: Column, s: int, have: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), have), lambda i: _item(k, s, i)), "\n\n\nPagina 1 din 3\n")


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """source and text of a paper for every order."""
    k = F.col("o_orderkey")
    v, r = F.floor(k / 4).cast("long"), k % 4
    year = (2016 + v % 5).cast("int")
    n = F.when(year > 2018, F.array(F.lit(5), F.lit(3), F.lit(3))).when(v % 2 == 0, F.array(F.lit(2), F.lit(4), F.lit(4))).otherwise(F.array(F.lit(2), F.lit(5), F.lit(4)))
    profile = F.when(k % 53 == 0, "necunoscută").when(v % 2 == 0, "Științe ale naturii").otherwise("Matematică-informatică")
    session = F.when(v % 3 == 0, "Simulare").when(v % 3 == 1, "Model").otherwise("")
    head = F.concat_ws(
        "\n", F.concat(F.lit("Examenul de bacalaureat național "), year), F.when(r == 1, "Barem de evaluare și de notare").otherwise("Toate subiectele sunt obligatorii"), F.concat(F.lit("Specializarea "), profile),
        F.when(r == 1, "comun pentru limbajele C/C++ și Pascal").when(r == 2, "Limbajul Pascal").otherwise("Limbajul C/C++"), session, F.concat(F.lit("Varianta "), v + F.when((r == 1) & (v % 13 == 0), 10_000_000).otherwise(0)),
    )
    parts = [head]
    for s, title in enumerate(("SUBIECTUL I (20 de puncte)", "SUBIECTUL al II-lea", " SUBIECTUL al III - lea (30 de puncte) "), 1):
        have = F.get(n, F.lit(s - 1)) - (F.when(k % 7 == 0, 1).otherwise(0) if s == 2 else F.lit(0))
        parts += [F.lit(title), F.lit("Scrieți pe foaia de examen răspunsul pentru fiecare dintre cerințele următoare."), _items(k, s, have)]
    tail = F.when(k % 17 == 0, "x (cid:77) y")
    # a paper is hundreds of times its key, so the keys are spread before papers are made of them
    keys = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    return keys.select(F.concat(F.lit("paper-"), F.lpad(k.cast("string"), 12, "0")).alias("source"), F.concat_ws("\n", *parts, tail).alias("text"))


@query(f"WITH {_PAPER} SELECT source, year, document_type, profile, language, session, variant, CASE WHEN profile IS NULL THEN 'profile' ELSE '' END AS missing, CASE WHEN session IS NULL THEN 'exam session is not stated in the PDF' END AS warning FROM p")
def classify_document(s, d):
    return _papers(s, d).select("source", A.classify_document(F.col("text")).alias("m")).select("source", "m.*")


@query(f"WITH {_PAPER} SELECT source, section, i AS number, item FROM doc")
def split_sections(s, d):
    bare = _papers(s, d).withColumn("text", F.regexp_replace("text", r"\nx \(cid:77\) y", ""))
    cut = T.each(A.normalize_extracted(bare), A.split_sections(F.col("text"))["sections"], "x")
    return T.each(cut.select("source", "x.section", "x.body"), A.numbered_items(F.col("body")), "e").select("source", "section", "e.number", "e.item")


@query(f"WITH {_PAPER} SELECT source, section, i AS number, item FROM doc")
def split_items(s, d):
    """The items of the sections of all papers, shared instructions left out."""
    bare = _papers(s, d).withColumn("text", F.regexp_replace("text", r"\nx \(cid:77\) y", ""))
    cut = T.each(A.normalize_extracted(bare), A.split_sections(F.col("text"))["sections"], "x")
    bodies = cut.select(F.struct("source", "x.section").alias("id"), A.own_lines(F.col("x.body")).alias("text"))
    return C.split_items(bodies).select("id.source", "id.section", "number", "item")


@query(f"WITH {_PAPER} SELECT source, len(n) AS n_sections, have[2] AS n_items, CASE WHEN short THEN 'expected ' || n[2] || ' exercises in section II, found ' || have[2] END AS error FROM got WHERE profile IS NOT NULL")
def check_items(s, d):
    known = A.normalize_extracted(_papers(s, d).withColumn("m", A.classify_document(F.col("text")))).select("source", "m.year", "m.profile", "text")
    cut = A.parsed(known.withColumn("source", F.struct("source", "profile")))
    # a filter would be moved below all steps and repeat those that give the profile
    some = T.each(cut, F.when(F.col("source.profile").isNotNull(), F.array(F.struct("source.source", F.size("II").alias("n_items"), "error"))), "x")
    return some.select("x.source", F.lit(3).cast("long").alias("n_sections"), "x.n_items", "x.error")


@query(f"WITH {_PAPER} SELECT d.source, section, i AS number, item FROM doc d JOIN err e ON e.k = d.k WHERE e.early IS NULL AND d.r = 1")
def parse_grading(s, d):
    return A.read_papers(_papers(s, d)).select("source", F.explode("graded").alias("x")).select("source", "x.section", "x.number", "x.item")


@query(f"WITH {_PAPER} SELECT d.source, section, i AS number, CASE WHEN bad THEN 'missing_required_visual' END AS reason FROM doc d JOIN err e ON e.k = d.k WHERE e.early IS NULL AND d.r <> 1")
def exclusion_reason(s, d):
    return A.read_papers(_papers(s, d)).select("source", F.explode(F.concat("kept", "excluded")).alias("x")).select("source", "x.section", "x.number", "x.reason")


_CONTEXT = "concat_ws('; ', 'Context: Bacalaureat ' || d.year, CASE d.session WHEN 'simulation' THEN 'simulare' WHEN 'model' THEN 'model' ELSE 'sesiune nespecificată' END, 'varianta ' || d.variant, 'profil ' || d.profile, 'limbaj ' || d.language, 'Subiectul ' || section, 'exercițiul ' || i || '.')"
_DOCS = f"""{_PAPER}, docs AS (SELECT d.id, {_CONTEXT} || chr(10) || chr(10) || item AS text, d.source, CASE WHEN (d.k + i) % 3 = 0 THEN 'matrices' ELSE 'number processing' END AS topic, d.year, 'subiectul_' || section AS bac_section,
  CASE WHEN (d.k + i) % 3 = 0 THEN 'program_implementation' ELSE 'open_response' END AS exercise_type, NULL::VARCHAR AS difficulty, 'ro' AS language FROM doc d JOIN fin f ON f.k = d.k WHERE f.error IS NULL AND d.r <> 1 AND NOT bad)"""


@query(f"WITH {_DOCS} SELECT * FROM docs")
def map_document(s, d):
    return A.corpus_documents(A.read_papers(_papers(s, d)))


@query(f"WITH {_PAPER} SELECT d.source, section, i AS number, {_CONTEXT} AS context FROM doc d JOIN err e ON e.k = d.k WHERE e.early IS NULL AND d.r <> 1 AND NOT bad")
def context_prefix(s, d):
    each = A.named_exercises(A.read_papers(_papers(s, d)))
    return each.select("source", "section", "number", A.context_prefix(F.col("m"), F.col("section"), F.col("number")).alias("context"))


@query(f"WITH {_PAPER} SELECT d.source, section, i AS number, d.id FROM doc d JOIN err e ON e.k = d.k WHERE e.early IS NULL AND d.r <> 1 AND NOT bad")
def stable_id(s, d):
    each = A.named_exercises(A.read_papers(_papers(s, d)))
    return each.select("source", "section", "number", A.document_id(F.col("m"), F.col("section"), F.col("number")).alias("id"))


@query(f"WITH {_DOCS} SELECT id, array_to_string(list_sort(list_filter(['bac_section=' || bac_section, 'difficulty=' || difficulty, 'exercise_type=' || exercise_type, 'language=' || language, 'source=' || source, 'text=' || text, 'topic=' || topic, 'year=' || year], lambda x: x IS NOT NULL)), '|') AS metadata FROM docs")
def metadata_build(s, d):
    made = A.metadata_build(map_document(s, d))
    return made.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("metadata"))


@query(f"WITH {_PAPER} SELECT source, coalesce(error = 'duplicate retrieval IDs', false) AS skipped FROM fin WHERE early IS NULL AND r <> 1")
def dedup_documents_by_id(s, d):
    return A._accepted(A.read_papers(_papers(s, d))).select("source", F.col("clash").alias("skipped"))


_AUDIT = f"""{_PAPER}, ok AS (SELECT * FROM fin WHERE error IS NULL),
lone AS (SELECT a.k, CASE WHEN a.r = 1 THEN 'no matching subject found' ELSE 'no matching grading guide found' END AS lone FROM ok a WHERE NOT EXISTS
  (SELECT 1 FROM ok b WHERE (a.r = 1) <> (b.r = 1) AND a.year = b.year AND a.profile = b.profile AND a.session IS NOT DISTINCT FROM b.session AND a.variant = b.variant)),
cnt AS (SELECT k, count(*) AS n_items, count(*) FILTER (bad) AS n_bad FROM x GROUP BY 1),
aud AS (SELECT f.source, f.error IS NOT NULL AS skipped, CASE WHEN f.error IS NULL AND f.r <> 1 THEN n_items - n_bad ELSE 0 END AS n_exercises, CASE WHEN f.error IS NULL AND f.r <> 1 THEN n_bad ELSE 0 END AS n_excluded, CASE WHEN f.error IS NULL AND f.r = 1 THEN n_items ELSE 0 END AS n_graded,
  list_filter([CASE WHEN f.session IS NULL AND f.profile IS NOT NULL THEN 'exam session is not stated in the PDF' END, CASE WHEN f.glyph AND f.profile IS NOT NULL THEN 'unresolved embedded-font glyph: (cid:77)' END, f.error, lone], lambda x: x IS NOT NULL) AS w
  FROM fin f JOIN cnt USING (k) LEFT JOIN lone USING (k))"""


@query(f"WITH {_AUDIT} SELECT source, skipped, n_exercises, n_excluded, n_graded, array_to_string(w, '; ') AS warnings, len(w) AS n_warnings FROM aud")
def audit_records(s, d):
    return A.audit_records(A.read_papers(_papers(s, d)))


@query(f"WITH {_AUDIT} SELECT count(*) AS scanned, count(*) FILTER (NOT skipped) AS parsed, count(*) FILTER (skipped) AS skipped, sum(n_exercises)::BIGINT AS extracted, sum(n_excluded)::BIGINT AS excluded, sum(len(w))::BIGINT AS warnings FROM aud")
def build_summary(s, d):
    return A.build_summary(audit_records(s, d))


@query("""WITH r(low, high, profile, a, b, c) AS (VALUES (2016, 2018, 'SN', 2, 4, 4), (2016, 2018, 'MI', 2, 5, 4), (2019, 2020, 'SN', 5, 3, 3), (2019, 2020, 'MI', 5, 3, 3)),
    o AS (SELECT o_orderkey AS id, (2014 + o_orderkey % 8)::INTEGER AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'SN' ELSE 'MI' END AS profile, ['I', 'II', 'III'][o_orderkey % 3 + 1] AS section FROM orders)
    SELECT id, year, o.profile, section, CASE section WHEN 'I' THEN a WHEN 'II' THEN b ELSE c END AS expected FROM o LEFT JOIN r ON year BETWEEN low AND high AND o.profile = r.profile""")
def expected_counts(s, d):
    k = F.col("o_orderkey")
    rows = s.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), (2014 + k % 8).cast("int").alias("year"), F.when(k % 2 == 0, "SN").otherwise("MI").alias("profile"), F.get(F.array(*map(F.lit, A.SECTIONS)), (k % 3).cast("int")).alias("section"))
    named = [(low, high, own) for low, high, own, _ in A.LAYOUTS]
    rules = [(low, high, own or other, sec, counts[i]) for low, high, own, counts in A.LAYOUTS for other in ("SN", "MI") if own in (None, other) and (own or (low, high, other) not in named) for i, sec in enumerate(A.SECTIONS)]
    return C.expected_counts(rows, s.createDataFrame(rules, "low int, high int, profile string, section string, expected int"))


_FORM = "^(Ministerul Educa|Centrul Na|Examenul de bacalaureat|Probă scrisă la informatică|Barem de evaluare şi de notare$|Limbajul (C/C\\+\\+|Pascal)$|Filier[ăa] (teoretică|vocaţională|vocațională))"


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(replace(replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), chr(160), ' '), chr(173), ''), '‹+', ' ← ', 'g') AS x FROM documents),
    l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(x, '[\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda l: trim(regexp_replace(l, '[ \\t]+', ' ', 'g'))), lambda l: NOT regexp_matches(l, '(?i)^(Pagina\\s+)?[0-9]+\\s+(din|/|of)\\s+[0-9]+$') AND NOT regexp_matches(l, '(?i){_FORM}')) AS l FROM t)
    SELECT doc_id, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '^\\n+|\\n+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS text FROM l""")
def normalize_extracted(s, d):
    return A.normalize_extracted(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


@query("""SELECT doc_id, 'Topic: ' || lang || CASE WHEN length(source) % 2 = 0 THEN chr(10) || 'Context:' || chr(10) || source || chr(10) ELSE '' END || chr(10) || 'Write about ' || n_chars || ' characters.' AS prompt FROM documents""")
def render_prompt(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").withColumn("context", F.when(F.length("source") % 2 == 0, F.col("source")))
    return A.render_prompt(docs, "Topic: {lang}{context}\nWrite about {n_chars} characters.", {"context": "\nContext:\n{context}\n"}).select("doc_id", "prompt")


@query("""SELECT doc_id, 'Topic: ' || lang || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Rejected: too close to ' || source ELSE '' END || chr(10) || 'Candidate:' || chr(10) || coalesce(text, '') AS prompt FROM documents""")
def render_repair_prompt(s, d):
    """A repair is a template with the reason, where there is one, and the whole candidate."""
    docs = s.read.parquet(f"{d}/documents.parquet").withColumn("reason", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("too close to "), "source")))
    return A.render_prompt(docs, "Topic: {lang}{reason}\nCandidate:\n{text}", {"reason": "\nRejected: {reason}"}).select("doc_id", "prompt")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'no_main' ELSE 'file_access' END AS contract FROM documents")
def executable_contract(s, d):
    """Programs of which each holds a document, a main and a file in a comment, where they don't count."""
    k, body = F.col("doc_id") % 4, ["int main() { return 0; }", "void f() {}", "int main() { std::ifstream in; }", 'int main() { read("data.TXT"); }']
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[*]/", "")
    code = F.concat(F.lit("/* "), text, F.lit(" int main( ifstream */\n// int main( freopen(\n"), F.element_at(F.array(*map(F.lit, body)), (k + 1).cast("int")))
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.executable_contract(code).alias("contract"))


@query("SELECT l_orderkey AS submission_id, l_linenumber AS test_no, l_linestatus = l_returnflag AND l_linenumber % 3 <> 0 AND l_quantity < 45 AS passed FROM lineitem")
def output_match(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    passed = P.output_match(F.concat(F.lit(" \n"), "l_linestatus"), F.concat("l_returnflag", F.lit("\t\n")), (F.col("l_linenumber") % 3 == 0).cast("int"), F.col("l_quantity") >= 45)
    return li.select(F.col("l_orderkey").alias("submission_id"), F.col("l_linenumber").alias("test_no"), passed.alias("passed"))


_TOKENS = "regexp_extract_all(replace(lower(coalesce({}, '')), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""WITH t AS (SELECT conv_id, turn, {_TOKENS.format("text")} AS w FROM conversations)
    SELECT a.conv_id, a.turn, array_to_string(list_sort(list_distinct(list_filter(list_intersect(a.w, b.w), lambda x: regexp_matches(x, '^[0-9]+$')))), ',') AS copied FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def copied_constants(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.array_join(F.array_sort(F.array_intersect(T.constants(F.col("text")), T.constants(F.col("before")))), ",").alias("copied"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
    SELECT doc_id, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: NOT ((z[2] > len(l) - 2 AND regexp_matches(z[1], '^\\s*[0-9]{1,3}\\s*$')) OR regexp_matches(z[1], '^(Page|Pagina) '))), lambda z: z[1]), chr(10)) AS text FROM l""")
def strip_page_furniture(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("source"), F.lit(1).alias("page_no"), "text")
    return C.strip_page_furniture(docs).select(F.col("source").alias("doc_id"), "text")


@query()
def stream_novelty_guard(s, d):
    table = f"{d}/documents.parque[t]"  # a pattern, since a stream takes no single file
    docs = s.readStream.schema(s.read.parquet(f"{d}/documents.parquet").schema).parquet(table).select(F.col("doc_id").alias("id"), "text")
    return streams.stream_novelty_guard(s, docs, s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), "text"))
