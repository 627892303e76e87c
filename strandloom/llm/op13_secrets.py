"""Finding secrets: patterns, and the entropy of windows over candidate strings.

Candidates are runs of the characters that keys are written in. Each is of a
class (hexadecimal, letters only, digits only, or mixed) with a window and a
least entropy. A window slides over the candidate and keeps how often it holds each character;
at each step one count goes up and one down, and the sum of c log2 c, from which
the entropy follows, changes by two table entries. Sums are whole numbers, so that
thresholds are exact. Windows of high entropy that touch make one span.
Candidates on the allow list, such as published sample keys, sequences of the
alphabet and names made of words, make none. All of it is built from DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Kinds in the order in which spans that begin together are listed.
ASSIGN, ACCESS, HEX, ENTROPY = "assign", "access", "hex", "entropy"
KINDS = (ASSIGN, ACCESS, HEX, ENTROPY)
#: The names before an assigned value, in either case (spelled out, as engines differ in what they fold).
NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGNED = f"({NAMES})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than these are no matches, and a run has no other match in it: the least length can stand in the pattern.
ACCESS_KEY, HEX_RUN = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"
LEAST_VALUE = 12
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
#: (class, pattern of the whole candidate, window, least entropy in bits a character), the first that fits.
CLASSES = (
    ("digits", "^[0-9]+$", 16, 3.3),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 2.9),
    ("letters", "^[A-Za-z]+$", 20, 4.05),
    ("mixed", "^.*$", 20, 3.7),
)
#: Candidates that are no secrets (sample keys, digests of nothing, sequences, UUIDs, words and numbers joined by signs).
ALLOWED = (
    "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]",
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
    "(?:0123456789|1234567890|9876543210|abcdefghij|ABCDEFGHIJ)",
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "^(?:[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Z]?[a-z]*|[A-Z]+|[0-9]{1,4}))+$",
)
#: Codes of candidate characters begin here, and there are so many.
FIRST, SLOTS = ord("+"), ord("z") - ord("+") + 1
SCALE = 1_000_000


def weights(window: int) -> list[int]:
    """c log2 c for each count, as whole numbers."""
    return [0, *(round(c * math.log2(c) * SCALE) for c in range(1, window + 1))]


def most_weight(window: int, least: float) -> int:
    """The greatest sum of weights with which a window has the least entropy."""
    return math.floor(window * (math.log2(window) - least) * SCALE)


def found(text: Column, pattern: str, kind: str, value: Column | None = None) -> Column:
    """The matches of a pattern, from left to right: (kind, start, end, text, value); value is that of the i-th match in a parallel array."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if value is None else value
    # What lies before each match, and the matches, give the places.
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), values.alias("value"))
    empty = F.expr("struct(cast(0 as bigint) as at, cast(array() as array<struct<kind:int,start:bigint,end:bigint,text:string,value:string>>) as spans)")

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["gap"])
        end = start + F.length(part["match"])
        span = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), part["match"].alias("text"), part["value"].alias("value"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    spans = F.aggregate(F.filter(parts, lambda p: p["match"].isNotNull()), empty, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint,text:string,value:string>>)"))


def windows(candidate: Column, window: int, least: float) -> Column:
    """Spans (start, end) within a candidate string of windows with at least the given entropy; those that touch are one."""
    table, most = F.array(*map(F.lit, weights(window))), F.lit(most_weight(window, least))
    codes = F.transform(F.split(candidate, ""), lambda c: F.ascii(c) - FIRST)
    before = F.concat(F.array_repeat(F.lit(-1), window), codes)
    steps = F.arrays_zip(codes.alias("x"), F.slice(before, F.lit(1), F.length(candidate)).alias("y"))
    start = F.struct(
        F.array_repeat(F.lit(0), SLOTS).alias("counts"), F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("at"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"),
    )

    def step(acc: Column, s: Column) -> Column:
        out = F.when(s["y"] >= 0, F.get(acc["counts"], s["y"])).otherwise(0)
        counted = F.get(acc["counts"], s["x"]) - F.when(s["x"] == s["y"], 1).otherwise(0)
        total = acc["sum"] - F.get(table, out) + F.get(table, F.greatest(out - 1, F.lit(0))) - F.get(table, counted) + F.get(table, counted + 1)
        counts = F.transform(acc["counts"], lambda c, i: c + F.when(i == s["x"], 1).otherwise(0) - F.when(i == s["y"], 1).otherwise(0))
        end, spans = acc["at"] + 1, acc["spans"]
        last = F.element_at(spans, -1)
        own = F.struct((end - window).alias("start"), end.alias("end"))
        longer = F.struct(last["start"].alias("start"), end.alias("end"))
        grown = F.when(F.size(spans) == 0, F.array(own)).when(last["end"] >= end - window, F.concat(F.slice(spans, F.lit(1), F.size(spans) - 1), F.array(longer))).otherwise(F.concat(spans, F.array(own)))
        return F.struct(counts.alias("counts"), total.alias("sum"), end.alias("at"), F.when((end >= window) & (total <= most), grown).otherwise(spans).alias("spans"))

    return F.aggregate(steps, start, step, lambda acc: acc["spans"])


def entropy_spans(text: Column, classes=CLASSES, allowed=ALLOWED) -> Column:
    """(kind, start, end) of spans of high entropy in a text."""

    def of(candidate: Column) -> Column:
        spans, rest = F.lit(None), F.lit(True)
        for _, pattern, window, least in reversed(classes):
            able = F.length(candidate["text"]) >= window
            spans = F.when(candidate["text"].rlike(pattern), F.when(able, windows(candidate["text"], window, least))).otherwise(spans)
        for pattern in allowed:
            rest = rest & ~candidate["text"].rlike(pattern)
        own = F.when(rest, spans)
        none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
        return F.transform(F.coalesce(own, none), lambda s: F.struct(F.lit(KINDS.index(ENTROPY)).alias("kind"), (candidate["start"] + s["start"]).alias("start"), (candidate["start"] + s["end"]).alias("end")))

    return F.flatten(F.transform(found(text, CANDIDATE, ENTROPY), of))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """Per row the id and `secrets`, an array of (kind, start, end) in code points, end exclusive, by start, then kind; also `base_spans` and `all_spans` as text.

    kind is one of KINDS: values assigned to a name, access keys and long
    hexadecimal runs, each from left to right without overlaps, and spans of high
    entropy, which may overlap those. A null or empty text has none; a null id
    stays; repeated rows get equal answers; other columns are not looked at.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    assigned = F.filter(found(text, ASSIGNED, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(2))), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    order = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(F.signum(a["end"] - b["end"]).cast("int"))
    spans = df.select(F.col(f"`{id_col}`"), F.concat(bare(assigned), bare(found(text, ACCESS_KEY, ACCESS)), bare(found(text, HEX_RUN, HEX))).alias("base"), entropy_spans(text, classes, allowed).alias("more"))
    spans = spans.select(F.col(f"`{id_col}`"), F.array_sort("base", order).alias("base"), F.array_sort(F.concat("base", "more"), order).alias("every"))
    names = F.array(*map(F.lit, KINDS))
    secrets = F.transform("every", lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return spans.select(F.col(f"`{id_col}`"), secrets.alias("secrets"), _joined(F.col("base")).alias("base_spans"), _joined(F.col("every")).alias("all_spans"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = find_secrets(documents(spark, sf_dir))
    many = [F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in (ASSIGN, ACCESS, HEX)]
    return of.select("doc_id", *many, F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), F.col("all_spans").alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql() -> str:
    """Each kind by its places, and the entropy of every window counted anew."""
    of_class = " ".join(f"WHEN regexp_matches(c, {_quoted(p)}) THEN {k}" for k, (_, p, _, _) in enumerate(CLASSES))
    window = " ".join(f"WHEN {k} THEN {w}" for k, (_, _, w, _) in enumerate(CLASSES))
    most = " ".join(f"WHEN {k} THEN {most_weight(w, t)}" for k, (_, _, w, t) in enumerate(CLASSES))
    allowed = " OR ".join(f"regexp_matches(c, {_quoted(p)})" for p in ALLOWED)
    table = weights(max(w for _, _, w, _ in CLASSES))[1:]

    def places(name: str, pattern: str, group: int = 0) -> str:
        return f"""
{name}_parts AS (
  SELECT doc_row, regexp_split_to_array(t, {_quoted(pattern)}) AS g, regexp_extract_all(t, {_quoted(pattern)}) AS m,
    regexp_extract_all(t, {_quoted(pattern)}, {group}) AS v FROM docs WHERE regexp_matches(t, {_quoted(pattern)})),
{name}_each AS (SELECT doc_row, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(v) AS v, unnest(g[1:len(m)]) AS g FROM {name}_parts),
{name} AS (
  SELECT doc_row, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_row ORDER BY i) - length(m) AS s,
    sum(length(g) + length(m)) OVER (PARTITION BY doc_row ORDER BY i) AS e FROM {name}_each),"""

    return f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS doc_row, coalesce(text, '') AS t FROM documents),
{places("found_assign", ASSIGNED, 2)}
{places("found_access", ACCESS_KEY)}
{places("found_hex", HEX_RUN)}
{places("cand", CANDIDATE)}
classed AS (SELECT doc_row, s, m AS c, CASE {of_class.replace("(c,", "(m,")} END AS k FROM cand WHERE NOT ({allowed.replace("(c,", "(m,")})),
slid AS (
  SELECT doc_row, s, c, k, CASE k {window} END AS w, unnest(range(0, length(c) - CASE k {window} END + 1)) AS i FROM classed),
counted AS (
  SELECT doc_row, s, i, k, w, x, count(*) AS n FROM (
    SELECT *, unnest(string_split(substring(c, i + 1, w), '')) AS x FROM slid) GROUP BY ALL),
high AS (
  SELECT doc_row, s + i AS a, s + i + w AS b, s FROM counted GROUP BY doc_row, s, i, k, w
  HAVING sum({table}[n]) <= CASE k {most} END),
fresh AS (
  SELECT *, CASE WHEN max(b) OVER (PARTITION BY doc_row, s ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS new FROM high),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_row, s ORDER BY a) AS island FROM fresh),
spans AS (
  SELECT doc_row, 0 AS kind, 'assign' AS name, s, e FROM found_assign WHERE length(v) >= {LEAST_VALUE}
  UNION ALL SELECT doc_row, 1, 'access', s, e FROM found_access
  UNION ALL SELECT doc_row, 2, 'hex', s, e FROM found_hex
  UNION ALL SELECT doc_row, 3, 'entropy', min(a), max(b) FROM grouped GROUP BY doc_row, s, island),
each_doc AS (
  SELECT doc_row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS base,
    string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans FROM spans GROUP BY doc_row)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN each_doc e ON d.doc_row = e.doc_row
"""


OP13_SQL = _sql()
