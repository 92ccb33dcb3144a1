"""Unicode's compatibility forms and case folding as column expressions, from tables that Python's own database gives."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a mark's combining class is told: this code point and the class.
CLASSES = 0xE000


@cache
def _forms(form: Callable[[str], str]) -> tuple[str, str, list[str], str]:
    """What ``form`` does to single code points: those that become one (from, to), those that become several or none
    (longest first) and, place by place, what they become; the last as ranges of a pattern."""
    one, many = [], []
    for i in range(0x80, 0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c, by = chr(i), form(chr(i))
        if c != by:
            (one if len(by) == 1 else many).append((c, by))
    many.sort(key=lambda x: -len(x[1]))
    width = max((len(by) for _, by in many), default=0)
    at = ["".join(by[j] for _, by in many if len(by) > j) for j in range(width)]
    return "".join(c for c, _ in one), "".join(by for _, by in one), ["".join(c for c, _ in many), *at], ranges([c for c, _ in many])


def ranges(chars: list[str]) -> str:
    """The inside of a character class that holds ``chars``."""
    out, points = [], sorted(map(ord, chars))
    for i, p in enumerate(points):
        if i and p == points[i - 1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def beyond(inside: str) -> str:
    """A class of what is neither ASCII nor in ``inside``. Ranges are tried one after another, so ASCII is told before them."""
    return f"[\\x{{80}}-\\x{{10ffff}}&&[^{inside}]]"


def each(t: Column, form: Callable[[str], str]) -> Column:
    """``form`` of every code point beyond ASCII. What becomes several code points is cut out first."""
    one, by, (many, *at), inside = _forms(form)
    simple = lambda x: F.translate(x, one, by)
    if not many:
        return simple(t)
    # code points of ``many`` without a counterpart at a place are deleted there
    spelled = lambda x: F.concat(*[F.translate(x, many, to) for to in at])
    cut = lambda x: F.when(x.rlike(f"^[{inside}]$"), spelled(x)).otherwise(simple(x))
    # one piece where there are none to cut out; a class of many ranges is tried range by range, so ASCII is told first
    some = f"[\\x{{80}}-\\x{{10ffff}}&&[{inside}]]"
    return F.when(t.rlike(some), F.array_join(F.transform(F.split(t, f"(?<={some})|(?={some})"), cut), "")).otherwise(simple(t))


def compatible(c: str) -> str:
    return unicodedata.normalize("NFKC", c)


def taken_apart(c: str) -> str:
    """The compatibility decomposition, but of Hangul syllables, which are whole letters here."""
    return c if "가" <= c <= "힣" else unicodedata.normalize("NFKD", c)


def ascii_form(c: str) -> str:
    """What of the decomposition is ASCII; what has nothing of it stays, to be dropped by one pattern."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80") or c


@cache
def _near() -> tuple[str, str, str]:
    """Letters and signs beyond ASCII of European texts that have one ASCII character or none: those with one, their characters, and those without."""
    near = [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2028)]
    own = {chr(i): "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if x < "\x80") for i in near}
    one = [c for c, by in own.items() if len(by) == 1]
    return "".join(one), "".join(own[c] for c in one), "".join(c for c, by in own.items() if not by)


def near_class() -> str:
    """The inside of a class of what ``near_ascii`` folds by itself beside ASCII."""
    one, _, none = _near()
    return ranges([*one, *none])


def near_ascii(t: Column) -> Column:
    """What of the decomposition is ASCII, for texts of ASCII and ``near_class`` alone: one pass with a short table."""
    one, by, none = _near()
    return F.translate(t, one + none, by)


@cache
def _pairs() -> str:
    """All pairs of code points that compose, and what they make, as lines."""
    out = []
    for i in range(0x80, 0x110000):
        parts = unicodedata.decomposition(chr(i)).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", chr(i)) == chr(i):
            out.append("".join(chr(int(p, 16)) for p in parts) + "\t" + chr(i))
    return "\n".join(out)


@cache
def _marks() -> tuple[str, str]:
    found = [chr(i) for i in range(0x300, 0x110000) if unicodedata.combining(chr(i))]
    return "".join(found), "".join(chr(CLASSES + unicodedata.combining(c)) for c in found)


def composed(t: Column) -> Column:
    """``t``, taken apart, with every letter and its marks put together.

    Marks are ordered by their classes but where one of class zero stands among them, which keep their order.
    """
    marks, classes = _marks()
    made = F.str_to_map(F.lit(_pairs()), F.lit("\n"), F.lit("\t"))

    def kind(m: Column) -> Column:
        at = F.ascii(F.translate(m, marks, classes)) - CLASSES
        return F.when((at > 0) & (at < 255), at).otherwise(0)

    def step(s: Column, m: Column) -> Column:
        got = F.try_element_at(made, F.concat(s["base"], m["m"]))
        met = got.isNotNull() & ((s["last"] < m["k"]) | (s["last"] == -1))
        return F.struct(
            F.when(met | (m["k"] > 0), s["done"]).otherwise(F.concat(s["done"], s["base"], s["rest"])).alias("done"),
            F.when(met, got).when(m["k"] > 0, s["base"]).otherwise(m["m"]).alias("base"),
            F.when(met, s["rest"]).when(m["k"] > 0, F.concat(s["rest"], m["m"])).otherwise("").alias("rest"),
            F.when(met, s["last"]).when(m["k"] > 0, m["k"]).otherwise(-1).alias("last"),
        )

    def put(x: Column) -> Column:
        own = F.transform(F.split(F.substr(x, F.lit(2)), ""), lambda m, i: F.struct(kind(m).alias("k"), i.alias("i"), m.alias("m")))
        order = F.when(F.exists(own, lambda m: m["k"] == 0), own).otherwise(F.array_sort(own))
        start = F.struct(F.lit("").alias("done"), F.substring(x, 1, 1).alias("base"), F.lit("").alias("rest"), F.lit(-1).alias("last"))
        return F.aggregate(order, start, step, lambda s: F.concat(s["done"], s["base"], s["rest"]))

    # surrogates are left out, as a pattern may also start in the middle of a pair
    pieces = F.split(t, r"(?=[^\p{M}\p{Cs}]\p{M})|(?<=\p{M})(?!\p{M})")
    return F.array_join(F.transform(pieces, lambda x: F.when(x.rlike(r"^\P{M}\p{M}"), put(x)).otherwise(x)), "")


def folded(t: Column) -> Column:
    """The NFKC form, case-folded. Hangul letters that stand apart are not put together."""
    compat = F.when(t.rlike(r"[\p{M}\x{ff9e}\x{ff9f}]"), composed(each(t, taken_apart))).otherwise(each(t, compatible))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return each(F.translate(compat, upper, upper.lower()), str.casefold)


@cache
def plain() -> str:
    """A class of letters and signs of which lower case (with ss for ß) is all that ``folded`` changes."""
    near = [*range(0x250), *range(0x2010, 0x2028)]
    return ranges([chr(i) for i in near if compatible(chr(i)).casefold() == chr(i).lower().replace("ß", "ss") and chr(i) != "İ"])
