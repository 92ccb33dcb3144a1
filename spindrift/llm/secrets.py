"""Secret scans with multipart credential linking (native).

Parts of a credential are found one kind at a time, leftmost and non-overlapping. Strong parts
(an assignment to a telling name, an access identifier, a long run of hexadecimal digits) are
secrets in themselves. Weak parts (a bare 40-character key, a temporary access identifier, an
endpoint) are only candidates: an interval join inside the document, which is the scope, links
parts at most ``SCOPE`` code points apart, and a weak part is reported only when it links
to the parts it complements.

The join runs inside the row as one sweep over the document's sorted parts, so it is as long as they are many, texts are never
shuffled, a hot source costs nothing, and a lost executor costs only its own rows. A null text
counts as empty: no spans, and the digest of the empty string. Rows are independent; repeated
rows and null ids come out as often as they went in. Other columns pass unread, whatever their names; in ``scan`` a column
with the name of a result gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import let, table

SCOPE = 200
#: Elements of a list, and code points of a text, that are folded together.
CHUNK = 64
WINDOW = 8192
REDACTED = "[SECRET]"

# The patterns of the kinds, in the order of the kinds.
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"""({NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{24,}"  # a run of 24 or more; shorter runs would be dropped
SESSION = "(?:ASIA|ABIA|ACCA)[A-Z0-9]{16,}"
KEY = "[A-Za-z0-9+/]{40,}"  # then exactly 40, with both cases and a digit
ENDPOINT = "https?://[A-Za-z0-9.-]+"
KINDS = ["assign", "access", "hex", "session", "key", "endpoint"]

_SPAN = "struct<start:int,kind:int,end:int>"


def _listed(rows: Column, state: dict[str, Column], step, kind: str) -> Column:
    """A fold over ``rows`` that lists elements: ``step`` gives the next state and an element or null.

    A fold copies what it holds at every step, so a list is not grown in one: the state is carried over parts of ``CHUNK`` rows
    first, and each part then lists its own elements.
    """
    none = F.array().cast(f"array<{kind}>")
    given = lambda a: {k: a[k] for k in state}
    pack = lambda s: F.struct(*[v.alias(k) for k, v in s.items()])

    def carry(a: Column, part: Column) -> Column:
        after = F.aggregate(part, a["now"], lambda b, r: pack(step(given(b), r)[0]))
        return F.struct(after.alias("now"), F.concat(a["starts"], F.array(a["now"])).alias("starts"))

    def listed(part: Column, start: Column) -> Column:
        def run(a: Column, r: Column) -> Column:
            after, one = step(given(a["now"]), r)
            return F.struct(pack(after).alias("now"), F.when(one.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(one))).alias("out"))

        return F.aggregate(part, F.struct(start.alias("now"), none.alias("out")), run, lambda a: a["out"])

    def whole(every: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(every), F.lit(CHUNK)), lambda i: F.slice(every, i, F.lit(CHUNK)))
        return F.when(F.size(every) == 0, none).otherwise(let(cut, parts_listed))

    def parts_listed(cut: Column) -> Column:
        zero = pack(state)
        starts = F.aggregate(cut, F.struct(zero.alias("now"), F.filter(F.array(zero), lambda x: F.lit(False)).alias("starts")), carry, lambda a: a["starts"])
        return F.flatten(F.zip_with(cut, starts, listed))

    return let(rows, whole)


def _spans(text: Column, kind: int, pattern: str, picky: bool = False, group: int = 0) -> Column:
    """Spans of the matches: a match begins where the gaps and matches before it end."""
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found(0).alias("hit"), found(group).alias("part"))

    def step(a: Column, r: Column) -> tuple[dict[str, Column], Column]:
        start = a["at"] + F.length(r["gap"])
        end = start + F.coalesce(F.length(r["hit"]), F.lit(0))
        good = r["hit"].isNotNull()
        if picky:
            good &= F.coalesce(_keep(kind, r["hit"], r["part"]), F.lit(False))
        return {"at": end}, F.when(good, F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))

    return F.when(text.rlike(pattern), _listed(rows, {"at": F.lit(0)}, step, _SPAN)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _keep(kind: int, hit: Column, part: Column) -> Column:
    if KINDS[kind] == "assign":
        return F.length(part) >= 6
    if KINDS[kind] == "access":
        return F.length(hit) >= 20
    return (F.length(hit) == 40) & hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9]")


def parts(text: Column) -> dict[str, Column]:
    """The spans of each kind; starts and ends are code points, ends exclusive."""
    t = F.coalesce(text, F.lit(""))
    return {
        "assign": _spans(t, 0, ASSIGN, True, 2),
        "access": _spans(t, 1, ACCESS, True),
        "hex": _spans(t, 2, HEX),
        "session": _spans(t, 3, SESSION),
        "key": _spans(t, 4, KEY, True),
        "endpoint": _spans(t, 5, ENDPOINT),
    }


def _linked(spans: Column) -> Column:
    """The weak spans of ``spans`` that lie in the scope of what they complement.

    Spans are met in order of where their scope begins, weak ones once more in order of where they end: a weak span is in the
    scope of a class if the latest end of that class, of all whose scope has begun, is not more than the scope before it.
    """
    one_of = lambda s, *names: s["kind"].isin([KINDS.index(n) for n in names])
    event = lambda s, at, asks: F.struct(at.alias("at"), F.lit(asks).alias("asks"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    begins = F.transform(spans, lambda s: event(s, s["start"] - SCOPE, 0))
    asks = F.transform(F.filter(spans, lambda s: s["kind"] >= 3), lambda s: event(s, s["end"], 1))

    def step(a: Column, e: Column) -> tuple[dict[str, Column], Column]:
        known = {"ids": one_of(e, "access", "session"), "keys": one_of(e, "assign", "hex", "key"), "ends": one_of(e, "endpoint")}
        after = {k: F.when((e["asks"] == 0) & c, F.greatest(a[k], e["end"])).otherwise(a[k]) for k, c in known.items()}
        near = {k: a[k] >= e["start"] - SCOPE for k in known}
        good = F.when(one_of(e, "session"), near["keys"] | near["ends"]).when(one_of(e, "key"), near["ids"] | near["ends"]).otherwise(near["ids"] & near["keys"])
        return after, F.when((e["asks"] == 1) & good, F.struct(e["start"].alias("start"), e["kind"].alias("kind"), e["end"].alias("end")))

    never = F.lit(-(2**31) + SCOPE)
    return _listed(F.array_sort(F.concat(begins, asks)), {"ids": never, "keys": never, "ends": never}, step, _SPAN)


def _scanned(docs: DataFrame) -> DataFrame:
    """``row`` (all of a row of ``docs``), ``base`` (strong spans), ``spans`` (these and the linked weak ones), each in order, and counts."""
    found = docs.select(F.struct("*").alias("row"), F.struct(*[c.alias(k) for k, c in parts(F.col("text")).items()]).alias("found"))
    c = {k: F.col("found")[k] for k in KINDS}
    base = F.concat(c["assign"], c["access"], c["hex"])
    weak = F.size(c["session"]) + F.size(c["key"]) + F.size(c["endpoint"]) > 0
    linked = F.when(weak, _linked(F.concat(*[c[k] for k in KINDS]))).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return found.select("row", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, linked)).alias("spans"), *[F.size(c[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]])


FOUND = ["base", "spans", *[f"n_{k}" for k in KINDS[:3]]]


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base``, ``spans`` and how many strong spans of each kind there are."""
    return _scanned(docs).select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in FOUND], *FOUND)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every reported span replaced by a mark, and ``n_chars`` (if there) to fit; overlapping spans become one.

    A text is cut into windows of ``WINDOW`` code points, and each is rewritten with the spans that reach into it.
    """
    text = F.col("row")["text"]

    def merge(a: Column, s: Column) -> tuple[dict[str, Column], Column]:
        """Spans that no span before reaches into, each up to where the next such one begins at the latest."""
        return {"end": F.greatest(a["end"], s["end"])}, F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["start"] >= a["end"]).alias("fresh"))

    marked = _listed(F.col("spans"), {"end": F.lit(0)}, merge, "struct<start:int,end:int,fresh:boolean>")

    def window(cut: Column, lo: Column, own: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            gap = F.substr(cut, a["at"] - lo + 1, F.greatest(F.lit(0), s["start"] - a["at"]))
            mark = F.when(s["fresh"] & (s["start"] >= lo), F.lit(REDACTED)).otherwise(F.lit(""))
            return F.struct(F.greatest(a["at"], F.least(s["end"], lo + WINDOW)).alias("at"), F.concat(a["out"], gap, mark).alias("out"))

        return F.aggregate(own, F.struct(lo.alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(cut, a["at"] - lo + 1, F.lit(WINDOW))))

    def cut(size: int, of: Column) -> Column:
        """``of`` in parts of ``size`` code points."""
        return F.transform(F.sequence(F.lit(0), F.length(of) - 1, F.lit(size)), lambda i: F.substr(of, i + 1, F.lit(size)))

    windows = F.flatten(F.transform(cut(128 * WINDOW, text), lambda t: cut(WINDOW, t)))
    reach = lambda spans, lo: F.filter(spans, lambda s: (s["end"] > lo) & (s["start"] < lo + WINDOW))
    rewritten = let(marked, lambda m: F.array_join(F.transform(windows, lambda w, j: window(w, j * WINDOW, reach(m, j * WINDOW))), ""))
    some = F.size("spans") > 0
    out = _scanned(docs).select("row", some.alias("some"), F.when(some, rewritten).otherwise(text).alias("clean"))
    fresh = {"text": F.col("clean"), "n_chars": F.when(F.col("some"), F.length("clean").cast("long")).otherwise(F.col("row")["n_chars"].cast("long"))}
    return out.select(*[fresh.get(c.lower(), F.col("row")[c]).alias(c) for c in docs.columns])


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _sql(kind: int, pattern: str, good: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, unnest(list_filter(list_transform(range(1, len(hit) + 1), lambda i: {{
        'start': list_sum(list_transform(gap[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: length(x))), 0)::BIGINT,
        'hit': hit[i], 'part': part[i]}}), lambda m: {good.replace('hit', 'm.hit').replace('part', 'm.part')})) AS m
      FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gap, regexp_extract_all(t, '{p}') AS hit, regexp_extract_all(t, '{p}', {group}) AS part
            FROM d WHERE regexp_matches(t, '{p}'))"""


_KEY_SQL = "length(hit) = 40 AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[0-9]')"
_NEAR = f"EXISTS (SELECT 1 FROM s p WHERE p.doc_id = w.doc_id AND p.kind IN %s AND p.start <= w.stop + {SCOPE} AND p.stop >= w.start - {SCOPE})"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  {_sql(0, ASSIGN, "length(part) >= 6", 2)} UNION ALL
  {_sql(1, ACCESS, "length(hit) >= 20")} UNION ALL
  {_sql(2, HEX, "true")} UNION ALL
  {_sql(3, SESSION, "true")} UNION ALL
  {_sql(4, KEY, _KEY_SQL)} UNION ALL
  {_sql(5, ENDPOINT, "true")}),
s AS (SELECT doc_id, kind, m.start AS start, m.start + length(m.hit) AS stop,
             {KINDS}[kind + 1] || ':' || m.start || ':' || (m.start + length(m.hit)) AS said FROM f),
k AS (
  SELECT * FROM s WHERE kind < 3 UNION ALL
  SELECT * FROM s w WHERE kind = 3 AND {_NEAR % "(0, 2, 4, 5)"} UNION ALL
  SELECT * FROM s w WHERE kind = 4 AND {_NEAR % "(1, 3, 5)"} UNION ALL
  SELECT * FROM s w WHERE kind = 5 AND {_NEAR % "(1, 3)"} AND {_NEAR % "(0, 2, 4)"}),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
             string_agg(said, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind, stop) AS spans
      FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
