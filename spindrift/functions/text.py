"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import unicode as U

# Letters of Romanian texts beyond ASCII, each of which folds to one, and Unicode's white space.
COMMON = "ăâîșțşţĂÂÎȘȚŞŢ"
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def fold_text(t: Column, common: Column | None = None) -> Column:
    """Lower-cased ASCII of the compatibility decomposition: accents dropped, other letters removed.

    ``common``: whether ``t`` is known to hold ASCII and ``COMMON`` alone, which spares a look at every letter.
    """

    # ``t`` may be an expression of any cost and is named often below, so it is made once
    def folded(x: Column) -> Column:
        far = F.regexp_replace(U.each(x, U.ascii_form), "[^\\x00-\\x7F]", "")
        near = ~x.rlike(U.beyond(U.near_class()))
        return F.lower(F.when(~x.rlike("[^\\x00-\\x7F]"), x).when(near if common is None else common | near, U.near_ascii(x)).otherwise(far))

    return once(t, folded)


def bare(t: Column) -> Column:
    """``t`` without Unicode's white space at both ends, as the pattern ``(?U)^\\s+|\\s+$`` takes it away."""
    return F.btrim(t, F.lit(WHITE))


def once(t: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of ``t``, which is computed once however often it stands in ``made``."""
    return F.get(F.transform(F.array(t), made), F.lit(0))


def each(rows: DataFrame, array: Column, name: str) -> DataFrame:
    """``rows`` with one row for each element of ``array``, as column ``name``; null elements are left out.

    ``explode`` adds a filter of its argument, which the optimizer moves below the steps that make it, so these run twice.
    """
    return rows.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())


def normalize_for_similarity(t: Column) -> Column:
    """Case-folded runs of letters and digits joined by one space."""
    return F.array_join(tokens(t), " ")


def tokens(t: Column) -> Column:
    """Runs of letters and digits of the case-folded compatibility form; null has none."""
    said = F.coalesce(t, F.lit(""))
    folded = F.when(said.rlike(U.beyond(U.plain())), U.folded(said)).otherwise(F.replace(F.lower(said), F.lit("ß"), F.lit("ss")))
    return F.regexp_extract_all(folded, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def constants(t: Column) -> Column:
    """Sorted distinct tokens of digits only."""
    return F.array_sort(F.array_distinct(F.filter(tokens(t), lambda x: x.rlike("^[0-9]+$"))))


def fragmented_line(t: Column) -> Column:
    """Whether a line of letters only has 8 tokens or more, 5 or more of one letter, in 3 runs or more."""

    # repeated groups are possessive: others take a stack frame for each word of a long line
    def bad(line: Column) -> Column:
        w = F.regexp_extract_all(line, F.lit("\\p{L}+"), F.lit(0))
        shape = F.array_join(F.transform(w, lambda x: F.when(F.length(x) == 1, "s").otherwise("l")), "")  # a letter for each token
        return line.rlike("^\\s*\\p{L}+(?:\\s+\\p{L}+)*+:?\\s*$") & (F.size(w) >= 8) & (F.regexp_count(shape, F.lit("s")) >= 5) & (F.regexp_count(shape, F.lit("s+")) >= 3)

    return F.exists(F.split(t, "\n"), bad)


def compact_answers(t: Column) -> Column:
    """Answers of the form ``1a 2b`` as number:letter, in order."""
    found = F.regexp_extract_all(t, F.lit("(?<![0-9])[1-9]\\s*[a-d](?=\\s|$)"), F.lit(0))
    return F.array_join(F.transform(found, lambda x: F.concat(F.substring(x, 1, 1), F.lit(":"), F.substring(x, -1, 1))), ",")


# What a solution must have and must not use.
MAIN = r"\b(?:int|signed)\s+main\s*\("
FILES = r"\b(?:std\s*::\s*)?(?:ifstream|ofstream|fstream)\b|\bfreopen\s*\(|\.\s*open\s*\("
NAMED_FILES = r"""(?i)["'][^"'\n]+\.(?:txt|in|out|dat|csv)["']"""


def executable_contract(code: Column) -> Column:
    """ok, no_main or file_access of program text, comments aside."""
    bare = F.regexp_replace(code, "//[^\\n]*|(?s:/\\*.*?\\*/)", " ")
    return F.when(~bare.rlike(MAIN), "no_main").when(bare.rlike(FILES) | bare.rlike(NAMED_FILES), "file_access").otherwise("ok")


def stable_id(year: Column, session: Column, variant: Column, profile: Column, lang: Column, section: Column, number: Column) -> Column:
    """bac-{year}-{session or exam}[-vNN]-{profile}-{lang}-s{n}-ex{m}; a variant that is no number gives v-{its slug}."""
    return F.concat_ws("-", stable_prefix(year, session, variant, profile, lang), F.concat(F.lit("s"), section.cast("string")), F.concat(F.lit("ex"), number.cast("string")))


def stable_prefix(year: Column, session: Column, variant: Column, profile: Column, lang: Column) -> Column:
    """What all ids of one paper begin with."""
    made = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = lambda c: F.when(F.lower(c).rlike("^[a-z0-9]+\\z"), F.lower(c)).otherwise(made(c))
    said = variant.cast("string")
    two = F.when(said.rlike("^[1-9][0-9]{1,17}\\z"), F.concat(F.lit("v"), said)).otherwise(F.format_string("v%02d", said.try_cast("long")))
    named = F.when(said.rlike("^[0-9]+$"), two).when(said.isNotNull(), F.concat(F.lit("v-"), slug(said)))
    return F.concat_ws("-", F.lit("bac"), year.cast("string"), F.coalesce(slug(session), F.lit("exam")), named, slug(profile), slug(lang))
