"""From page text to an audited corpus of exercises: normalise, classify, split, check, exclude, name, audit.

Everything up to the audit is expressions inside a row. The one group that is folded, files that
could take the same ids, holds files of one year, session, variant, profile and language only. Files are
known by ``source``, whose lower-cased form is also their order.
"""

from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spindrift.functions.text import COMMON, bare, compact_answers, fold_text, fragmented_line, once, stable_id, stable_prefix
from spindrift.operators.corpus import accepted_files, topic_of, type_of
from spindrift.sources.io import work_dir

# Repairs of extracted glyphs, in order. ``(?U)`` gives \w and \s their Unicode meaning.
REPAIRS = [
    (r"(?imd)^[ \t]*Limbajul (?:C/C\+\+|Pascal)[ \t]*\n[ \t]*[123][ \t]*(?:\n|$)", ""),
    (r"(?i)(?:\(cid:1\))+", " ← "),
    (r"(?i)(?:\(cid:215\))+", " × "),
    (r"(?U)‹\s+(?=[A-Za-z]\w*\s*‹)", ""),
    (r"‹+", " ← "),
    ("\uf0df", "←"),
    (r"(?U)˛\s*([A-Za-z])\s*˛+\s*(?=\[)", "$1∈"),
    (r"(?U)∈(?:\s*∈)+(?=\s*[\[(])", "∈"),
    (r"(?U)([\w)])\s*×(?:\s*×)+(?=\s*[\w(])", "$1 ×"),
    (r"(?U)£(?:\s*£)+", "≤"),
    (r"(?U)«\s*([A-Za-z]\w*)\s*«+\s*([A-Za-z]\w*)", "$1 ↔ $2"),
    (r"¨(?=\])", ""),
    (r"¨+", "∪"),
]
# Lines that belong to the form and not to the exercise.
PAGE_LINE = r"(?iU)^(?:Pagina\s+)?\d+\s+(?:din|/|of)\s+\d+$"
FORM_LINES = [
    r"Ministerul Educa",
    r"Centrul Na",
    r"Examenul de bacalaureat",
    r"Probă scrisă la informatică",
    r"Barem de evaluare şi de notare$",
    r"Limbajul (?:C/C\+\+|Pascal)$",
    r"Filier[ăa] (?:teoretică|vocaţională|vocațională)",
]
FORM = PAGE_LINE.replace("^", "^(?:", 1) + "|(?:" + "|".join(FORM_LINES) + "))"
# Fixed value: a text of ASCII (of what is no letter or sign, line feeds alone) and common letters, which is in composed
# form and met by no repair but those of the language's line and of glyphs by number. Long runs are told by one loop each.
SIMPLE = rf"^(?:[\n\x20-\x7e]++|[{COMMON}]++)*+\z"
# Fixed value: what a line of the form, or of a page with its word, begins with.
FORM_FIRST = "MCEPBLFmcepblf"
# Exercises by first and last year, profile (null: any other) and section.
LAYOUTS = [
    (2016, 2018, "SN", (2, 4, 4)),
    (2016, 2018, None, (2, 5, 4)),
    (2019, 2020, None, (5, 3, 3)),
]
SECTIONS = ["I", "II", "III"]
HEADING = r"(?imdU)^[ \t]*SUBIECTUL\s+(?:al\s+)?(III|II|I)(?:\s*[-–]\s*lea)?(?:\s*\([^\n)]*\))?[ \t]*$"
SHARED_LINE = "scrieti pe foaia de examen raspunsul pentru fiecare dintre cerintele urmatoare."
# Marks and patterns of exercises that can't be used.
UNSAFE = {"⟦unsafe:ambiguous_math_notation⟧": "ambiguous_math_notation", "⟦unsafe:unreliable_pseudocode_layout⟧": "unreliable_pseudocode_layout"}
LONE_DIACRITICS = r"(?mdU)^\s*[ăâîșşțţĂÂÎȘŞȚŢ](?:\s+[ăâîșşțţĂÂÎȘŞȚŢ]){2,}+\s*$"
MAYBE_GRAPH = rf"[gG][rR][aAăâĂÂ][fF]|[rR][bB][oO][rR][eE]"
GRAPH = r"\b(?:graf|graful|arbore|arborele)\b"
BESIDE = r"\b(?:reprezentat(?:a)?|graful|arborele)\b[^.]{0,160}\balaturat(?:a)?\b"
BINARY = r"(?<!\d)[01](?!\d)"
PARENTS = r"""vector(?:ul)?\s+de\s+["']?tati["']?[^\n]{0,100}\([\d,\s-]+\)"""
EDGES = r"(?:muchiile|arcele)\s+(?:sunt|grafului)[^\n]{0,120}[{(][\d,()\s-]+[})]"
HEADER = 2500


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder."""
    path = work_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        return texts
    return pa.array([t if t is None else normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def odd(t: Column) -> Column:
    """Whether ``t`` may need more than ``_plain`` does."""
    return ~t.rlike(SIMPLE) | F.contains(t, F.lit(":1)")) | F.contains(t, F.lit(":215)"))


def _whole(t: Column) -> Column:
    out = F.replace(F.replace(F.regexp_replace(t, "\r\n?", "\n"), F.lit("\u00a0"), F.lit(" ")), F.lit("\u00ad"))
    for pattern, by in REPAIRS:
        out = F.regexp_replace(out, pattern, by)
    return _without_form(F.transform(F.split(out, "[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: bare(F.regexp_replace(x, "[ \t]+", " "))))


def _plain(t: Column) -> Column:
    # nothing but line feeds parts lines here, of white space there are only blanks, and one repair alone finds anything,
    # where a line is one of three digits
    lines = F.transform(F.split(_fewer(t, "  ", " {2,}", " "), "\n"), lambda x: F.trim(x))
    return once(lines, lambda x: F.when(F.arrays_overlap(x, F.array(*map(F.lit, "123"))), _whole(t)).otherwise(_without_form(x)))


def _fewer(t: Column, many: str, pattern: str, by: str) -> Column:
    """``t`` with ``by`` for every ``pattern``, a run of a letter that is at least ``many``; runs of ``many`` itself are found without a pattern."""
    return once(t, lambda x: once(F.replace(x, F.lit(many), F.lit(by)), lambda y: F.when(F.contains(y, F.lit(many)), F.regexp_replace(x, pattern, by)).otherwise(y)))


def _without_form(lines: Column) -> Column:
    # lines of the form begin with few letters, or a digit, and letters beyond ASCII are left to the pattern
    first = lambda x: F.ascii(x)
    may = lambda x: first(x).isin(*map(ord, FORM_FIRST)) | (first(x) > 127)
    last = lambda x: F.ascii(F.substring(x, -1, 1))
    page = lambda x: first(x).between(48, 57) & (last(x).between(48, 57) | (last(x) > 127))
    kept = F.filter(lines, lambda x: ~((may(x) | page(x) | first(x).isNull()) & x.rlike(FORM)))
    return _fewer(F.btrim(F.array_join(kept, "\n"), F.lit("\n")), "\n\n\n", "\n{3,}", "\n\n")


def normalize_extracted(rows: DataFrame) -> DataFrame:
    """``rows`` whose ``text`` has repaired glyphs, no form lines and no needless white space; null stays null."""
    told = rows.withColumn("text", F.struct(F.col("text").alias("t"), odd(F.col("text")).alias("odd")))
    # composed form (NFC), which no built-in function gives; only texts that may change travel to Python
    done = told.withColumn("text", F.struct("text.odd", F.coalesce(_nfc(F.when(F.col("text.odd"), F.col("text.t"))), F.col("text.t")).alias("t")))
    return done.withColumn("text", once(F.col("text"), lambda x: F.when(x["odd"], _whole(x["t"])).otherwise(_plain(x["t"]))))


def unresolved_glyphs(t: Column) -> Column:
    """Sorted distinct warnings of glyphs that no repair knows."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?i)\(cid:\d+\)"), F.lit(0))))
    named = F.transform(found, lambda x: F.concat(F.lit("unresolved embedded-font glyph: "), x))
    return F.when(F.contains(t, F.lit(":")), named).otherwise(F.when(t.isNotNull(), F.array().cast("array<string>")))


def classify_document(text: Column) -> Column:
    """Struct of year, document_type, profile, language, session, variant, missing (fields, joined) and warning.

    Only the header counts. What is missing is null; a session that isn't stated is a warning alone if there is a variant.
    """
    return once(F.substring(text, 1, HEADER), lambda t: once(fold_text(t, t.rlike(SIMPLE)), _of_header))


def _of_header(head: Column) -> Column:
    has = lambda s: F.contains(head, F.lit(s))
    some = lambda pattern: F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))
    year = some(r"bacalaureat(?:ul)? national\s+(20[0-9]{2})").cast("int")
    kind = F.when(has("barem de evaluare"), "grading").when(has("toate subiectele sunt obligatorii"), "subject")
    profile = F.when(has("stiinte ale naturii"), "SN").when(has("matematica-informatica"), "MI")
    both = has("comun pentru limbajele c/c++")
    language = F.when(has("limbajul c/c++"), "C/C++").when(has("limbajul pascal"), "Pascal")
    session = F.when(has("simulare") & head.rlike(r"\bsimulare\b"), "simulation").when(has("model") & head.rlike(r"\bmodel\b"), "model")
    variant = F.when(has("varianta"), some(r"varianta\s+([0-9]+)"))

    # every part is looked for once, and then told from what was found
    def told(r: Column) -> Column:
        spoken = F.when((r["kind"] == "grading") & r["both"], "C/C++ + Pascal").otherwise(r["language"])
        fields = {"year": r["year"], "document type": r["kind"], "profile": r["profile"], "programming language": spoken, "variant": F.coalesce(r["session"], r["variant"])}
        missing = F.concat_ws(", ", *[F.when(c.isNull(), name) for name, c in fields.items()])
        unstated = F.when(r["session"].isNull(), "exam session is not stated in the PDF")
        return F.struct(r["year"].alias("year"), r["kind"].alias("document_type"), r["profile"].alias("profile"), spoken.alias("language"), r["session"].alias("session"), r["variant"].alias("variant"), missing.alias("missing"), unstated.alias("warning"))

    found = {"year": year, "kind": kind, "profile": profile, "both": both, "language": language, "session": session, "variant": variant}
    return once(F.struct(*[c.alias(name) for name, c in found.items()]), told)


def split_sections(text: Column) -> Column:
    """Struct of sections (array of section and body, in order) and error (null: I, II and III, once each)."""
    def cut(names: Column) -> Column:
        # the body of a heading is what follows it, so the part before the first heading is passed over
        return once(F.split(text, HEADING), lambda bodies: F.transform(names, lambda n, i: F.struct(n.alias("section"), bare(F.get(bodies, i + 1)).alias("body"))))

    def judged(sections: Column) -> Column:
        names = F.transform(sections, lambda x: x["section"])
        twice = F.get(F.filter(names, lambda n, i: F.array_position(names, n) <= i), F.lit(0))
        wanted = F.array(*map(F.lit, SECTIONS))
        wrong = (F.size(names) != len(SECTIONS)) | (F.size(F.array_except(wanted, names)) > 0)
        error = F.when(twice.isNotNull(), F.concat(F.lit("duplicate section marker: "), twice)).when(wrong, F.concat(F.lit("expected sections I, II, III; found "), F.when(F.size(names) == 0, "none").otherwise(F.array_join(names, ", "))))
        return F.struct(sections.alias("sections"), error.alias("error"))

    return once(once(F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)), cut), judged)


def own_lines(body: Column) -> Column:
    """The lines of a section's body but for shared instructions."""
    # folding drops letters or makes them ASCII, so only a line whose first letter is an S or beyond ASCII can be folded to the shared one
    shared = lambda x: x.rlike(r"^\s*[Ss\x{80}-\x{10ffff}]") & (F.btrim(fold_text(x), F.lit(" \t\n\x0b\f\r")) == SHARED_LINE)
    return F.array_join(F.filter(F.split(body, "\n"), lambda x: ~shared(x)), "\n")


def numbered_items(body: Column) -> Column:
    """Array of number and item (its number included) of a section's body; shared instructions are left out."""
    parts = F.filter(F.split(own_lines(body), r"(?md)^(?=[ \t]*[1-9]\.\s)"), lambda x: x.rlike(r"^[ \t]*[1-9]\.\s"))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^[ \t]*([1-9])", 1).cast("int").alias("number"), bare(x).alias("item")))


def layout(year: Column, profile: Column) -> Column:
    """Expected exercises of sections I, II and III; null for years of no known layout."""
    out = F.lit(None).cast("array<int>")
    for low, high, own, counts in reversed(LAYOUTS):
        fits = year.between(low, high) & (F.lit(True) if own is None else profile.eqNullSafe(F.lit(own)))
        out = F.when(fits, F.array(*map(F.lit, counts))).otherwise(out)
    return out


def _of_section(name: str) -> Column:
    return F.transform(name, lambda x: F.struct(F.lit(name).alias("section"), x["number"].alias("number"), x["item"].alias("item")))


def parse(papers: DataFrame, grading: bool | Column = False) -> DataFrame:
    """``papers`` (source, year, profile, text): entries (array of section, number, item) or error.

    A grading guide may give section I as ``1a 2b …`` instead.
    """
    cut = parsed(papers, grading)
    return cut.select("source", "entries", "error")


def parsed(papers: DataFrame, grading: bool | Column = False) -> DataFrame:
    """``parse`` with the items found in each section beside it, in columns I, II and III. ``grading``, as a column, is one of ``papers``."""
    guide = F.lit(grading) if isinstance(grading, bool) else grading
    cut = papers.select("source", "year", "profile", guide.alias("guide"), split_sections(F.col("text")).alias("s"), layout(F.col("year"), F.col("profile")).alias("layout"))
    body = lambda name: F.get(F.filter("s.sections", lambda x: x["section"] == name), F.lit(0))["body"]
    for name in SECTIONS:
        items = numbered_items(body(name))
        if name == "I" and grading is not False:
            short = F.transform(F.split(compact_answers(body(name)), ","), lambda x: F.struct(F.substring(x, 1, 1).cast("int").alias("number"), F.concat(F.lit("Răspuns: "), F.substring(x, -1, 1)).alias("item")))
            few = lambda found: F.when(F.col("guide") & (F.size(found) != F.get("layout", F.lit(0))) & (compact_answers(body("I")) != "") & (F.size(short) == F.get("layout", F.lit(0))), short).otherwise(found)
            items = once(items, few)
        cut = cut.withColumn(name, items)
    what = F.when(F.col("guide"), "barem entries").otherwise("exercises")
    error = F.when(F.col("s.error").isNotNull(), F.col("s.error")).when(F.col("layout").isNull(), F.concat(F.lit("unsupported Bac layout year: "), F.coalesce(F.col("year").cast("string"), F.lit("none"))))
    for i, name in enumerate(SECTIONS):
        n, numbers = F.get("layout", F.lit(i)), F.transform(name, lambda x: x["number"])
        error = error.when(F.size(name) != n, F.concat(F.lit("expected "), n, F.lit(" "), what, F.lit(f" in section {name}, found "), F.size(name)))
        error = error.when(numbers != F.sequence(F.lit(1), n), F.concat(F.lit("non-sequential "), what, F.lit(f" in section {name}: ["), F.array_join(numbers.cast("array<string>"), ", "), F.lit("]")))
    entries = F.concat(*[_of_section(name) for name in SECTIONS])
    return cut.withColumn("error", error).select("source", F.when(F.col("error").isNull(), entries).alias("entries"), "error", *SECTIONS)


def exclusion_reason(item: Column) -> Column:
    """Why an exercise can't be used, the first reason that holds; null: it can."""

    def visual(folded: Column) -> Column:
        drawn = folded.rlike(GRAPH) & folded.rlike(BESIDE)
        told = (F.contains(folded, F.lit("matrice")) & (F.regexp_count(item, F.lit(BINARY)) >= 9)) | folded.rlike(PARENTS) | folded.rlike(EDGES)
        return F.when(drawn & ~told, "missing_required_visual")

    out = None
    for mark, reason in UNSAFE.items():
        out = (F if out is None else out).when(F.contains(item, F.lit(mark)), reason)
    return out.when(item.rlike(LONE_DIACRITICS) | fragmented_line(item), "unreliable_text_layout").when(item.rlike(MAYBE_GRAPH) | ~item.rlike(SIMPLE), once(fold_text(item), visual))


def context_prefix(m: Column, section: Column, number: Column) -> Column:
    """One line that says where an exercise comes from; ``m`` is the struct of ``classify_document``."""
    session = F.when(m["session"] == "simulation", "simulare").when(m["session"] == "model", "model").otherwise("sesiune nespecificată")
    parts = [F.concat(F.lit("Context: Bacalaureat "), m["year"]), session, F.concat(F.lit("varianta "), m["variant"]), F.concat(F.lit("profil "), m["profile"]), F.concat(F.lit("limbaj "), m["language"]), F.concat(F.lit("Subiectul "), section), F.concat(F.lit("exercițiul "), number, F.lit("."))]
    return F.concat_ws("; ", *parts)


def document_id(m: Column, section: Column, number: Column) -> Column:
    """Stable id of a subject's exercise; null where the paper can't name one (guides, both languages, unknown sections)."""
    slug = _slug(m)
    place = F.nullif(F.array_position(F.array(*map(F.lit, SECTIONS)), section), F.lit(0))
    made = stable_id(m["year"], m["session"], m["variant"], m["profile"], slug, place, number)
    return F.when((m["document_type"] == "subject") & slug.isNotNull() & place.isNotNull(), made)


def id_prefix(m: Column) -> Column:
    """What the ids of a subject's exercises begin with; null where the paper can't name one."""
    return F.when((m["document_type"] == "subject") & _slug(m).isNotNull(), stable_prefix(m["year"], m["session"], m["variant"], m["profile"], _slug(m)))


def _slug(m: Column) -> Column:
    return F.when(m["language"] == "C/C++", "cpp").when(m["language"] == "Pascal", "pascal")


def map_document(exercises: DataFrame) -> DataFrame:
    """``exercises`` (source, m, section, number, item) as documents of the corpus; difficulty is not known."""
    m, item = F.col("m"), F.col("item")
    # both labels are told from one folded text
    exercises = exercises.select("*", once(fold_text(item), lambda x: F.struct(topic_of(x).alias("topic"), type_of(x).alias("type"))).alias("labels"))
    text = F.concat(context_prefix(m, F.col("section"), F.col("number")), F.lit("\n\n"), item)
    return exercises.select(
        document_id(m, F.col("section"), F.col("number")).alias("id"), text.alias("text"), "source", F.col("labels.topic").alias("topic"), m["year"].alias("year"),
        F.concat(F.lit("subiectul_"), "section").alias("bac_section"), F.col("labels.type").alias("exercise_type"), F.lit(None).cast("string").alias("difficulty"), F.lit("ro").alias("language"),
    )


def metadata_build(docs: DataFrame, columns: tuple[str, ...] = ("text", "source", "topic", "language", "year", "bac_section", "exercise_type", "difficulty")) -> DataFrame:
    """id and metadata, a map of the columns that are not null."""
    whole = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))
    return docs.select("id", F.map_filter(whole, lambda k, v: v.isNotNull()).alias("metadata"))


def read_papers(pages: DataFrame) -> DataFrame:
    """``pages`` (source, text) classified and parsed: source, m, kept and excluded (arrays of section, number, item, reason), graded, warnings, error.

    What is read is written as a table in the shared folder: the steps after it use it more than once, and a filter that
    the optimizer moves below them would repeat every expression it passes.
    """
    first = pages.select("source", classify_document(F.col("text")).alias("m"), "text")
    ready = normalize_extracted(first).withColumn("glyphs", unresolved_glyphs(F.col("text")))
    glyph = F.when(F.size("glyphs") > 0, "PDF skipped because unresolved embedded-font glyphs remain")
    unclear = F.when(F.col("m.missing") != "", F.concat(F.lit("missing or ambiguous "), F.col("m.missing")))
    ready = ready.withColumn("early", F.when(F.col("text").isNull(), "no text").otherwise(F.coalesce(unclear, glyph)))
    # a paper is one row, so its parse is kept beside it by carrying its columns along, without a join
    grading = F.coalesce(F.col("m.document_type") == "grading", F.lit(False))
    wide = ready.select(F.struct("source", "m", "glyphs", "early", grading.alias("grading")).alias("source"), F.col("m.year").alias("year"), F.col("m.profile").alias("profile"), "text")
    both = parse(wide, F.col("source.grading")).select("source.*", "entries", "error").withColumn("error", F.coalesce("early", "error"))
    judged = F.transform("entries", lambda x: F.struct(x["section"].alias("section"), x["number"].alias("number"), x["item"].alias("item"), exclusion_reason(x["item"]).alias("reason")))
    both = both.withColumn("entries", F.when(F.col("error").isNull(), judged))
    # a paper that can't be classified has no metadata, and so neither the warnings drawn from it nor from its text
    warnings = F.when(F.col("m.missing") == "", F.concat(F.array_compact(F.array("m.warning")), F.coalesce("glyphs", F.array().cast("array<string>")))).otherwise(F.array().cast("array<string>"))
    whole = both.select(
        "source", "m", F.when(~F.col("grading"), F.filter("entries", lambda x: x["reason"].isNull())).alias("kept"), F.when(~F.col("grading"), F.filter("entries", lambda x: x["reason"].isNotNull())).alias("excluded"),
        F.when(F.col("grading"), F.col("entries")).alias("graded"), warnings.alias("warnings"), "error",
    )
    return kept(whole, "papers")


def named_exercises(papers: DataFrame) -> DataFrame:
    """The kept exercises of ``read_papers``, one a row, as ``map_document`` takes them."""
    return papers.select("source", "m", F.explode("kept").alias("x")).select("source", "m", "x.section", "x.number", "x.item")


def _accepted(papers: DataFrame) -> DataFrame:
    """source of subjects, and whether an earlier accepted one has taken any of their ids."""
    # the ids of a paper differ in section and number only, so these stand for them
    places = F.transform("kept", lambda x: F.concat_ws("-", x["section"], x["number"].cast("string")))
    files = papers.where(F.size("kept") > 0).select(id_prefix(F.col("m")).alias("prefix"), F.col("source").alias("path"), places.alias("ids"))
    return accepted_files(files).select(F.col("path").alias("source"), F.col("skipped").alias("clash"))


def audit_records(papers: DataFrame) -> DataFrame:
    """One row for each paper of ``read_papers``: skipped, counts, and its warnings in order, once each."""
    # counts and no texts are dealt
    slim = papers.select("source", "m.document_type", "m.year", "m.profile", "m.session", "m.variant", *[F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0).alias(c) for c in ("kept", "excluded", "graded")], "warnings", "error")
    some = slim.join(_accepted(papers), "source", "left").withColumn("error", F.coalesce("error", F.when(F.col("clash"), "duplicate retrieval IDs")))
    # papers of one exam stand in one window; those with an error pair with none and stay by themselves
    exam = Window.partitionBy("year", "profile", "session", "variant", F.when(F.col("error").isNotNull(), F.col("source")))
    has = lambda kind: F.coalesce(F.max(F.col("document_type") == kind).over(exam), F.lit(False))
    good, kind = F.col("error").isNull(), F.col("document_type")
    lone = F.when(good & (kind == "subject") & ~has("grading"), "no matching grading guide found").when(good & (kind == "grading") & ~has("subject"), "no matching subject found")
    count = lambda c: F.when(good, F.col(c)).otherwise(0)
    told = F.array_distinct(F.concat("warnings", F.array_compact(F.array("error", "lone"))))
    return some.withColumn("lone", lone).select(
        "source", (~good).alias("skipped"), count("kept").alias("n_exercises"), count("excluded").alias("n_excluded"), count("graded").alias("n_graded"), F.array_join(told, "; ").alias("warnings"),
        F.size(told).alias("n_warnings"),
    )


def corpus_documents(papers: DataFrame) -> DataFrame:
    """Documents of the papers that are neither broken nor hold an id already taken."""
    # whether a paper stays is told before its exercises, which are several times as many rows
    taken = _accepted(papers).where("clash").select("source")
    return map_document(named_exercises(papers.where(F.size("kept") > 0).select("source", "m", "kept").join(taken, "source", "left_anti")))


def build_summary(audit: DataFrame) -> DataFrame:
    """One row of totals over ``audit_records``."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0).cast("long"))
    return audit.agg(F.count("*").alias("scanned"), F.count_if(~F.col("skipped")).alias("parsed"), F.count_if("skipped").alias("skipped"), total("n_exercises").alias("extracted"), total("n_excluded").alias("excluded"), total("n_warnings").alias("warnings"))


def render_prompt(rows: DataFrame, template: str, blocks: dict[str, str]) -> DataFrame:
    """``rows`` with ``prompt``: ``template`` with each ``{column}`` filled in.

    ``blocks`` gives, by column, the text around a value that may be missing; without a value (null or empty) the
    block is left out. A repair is a template with more columns (reason, candidate).
    """
    pieces, rest = [], template
    while "{" in rest:
        before, _, after = rest.partition("{")
        name, _, rest = after.partition("}")
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        if name in blocks:
            left, _, right = blocks[name].partition("{" + name + "}")
            value = F.when(value != "", F.concat(F.lit(left), value, F.lit(right))).otherwise("")
        pieces += [F.lit(before), value]
    return rows.withColumn("prompt", F.concat(*pieces, F.lit(rest)))
