"""Secret scans with multipart credential linking.

1. One pass over whole texts finds parts. Strong ones stand on their own: assignments (`assign`), access ids (`access`) and
   hexadecimal runs (`hex`). Weak ones mean little alone: named identifiers (`identifier`), short or otherwise named
   assignments and bare runs of mixed characters (`secret`), addresses of services (`endpoint`).
2. A text falls into scopes, its paragraphs (between two line feeds in a row). Parts of one scope are linked by an interval
   join: every part stands in the bins of REACH code points that it touches, every weak part asks the bins within REACH of
   it, and the distance is checked exactly. A bin holds a bounded number of parts, so neither a long text nor a hot one
   makes many pairs.
3. A weak part is reported only beside its complement: an identifier beside a secret (strong or weak), a secret beside an
   identifier or an access id, an endpoint beside both. Digits alone (card and phone numbers) are a `hex` span, but no secret
   that supports others.

A weak part that overlaps a strong one is none; a bare run inside an identifier, assignment or endpoint is none either.

Defined cases: null or empty text has no spans (counts 0, the hash of the empty text); a null id, repeated ids and rows are
documents of their own; ties of start go by kind, then end; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded, documents, id_text, text_of, with_ids
from fieldloom.session import stored

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT = range(6)
#: Code points between two parts of one credential, at most.
REACH = 160
#: Shortest values: a strong assignment's, an access id, a hexadecimal run (fixed by the contract); then a weak assignment's,
#: another named secret's, an identifier's and a bare run.
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
SHORT_CHARS, NAMED_CHARS, IDENTIFIER_CHARS, BARE_CHARS = 6, 8, 3, 20


def _either(names: str) -> str:
    """The pattern with each letter in either case; by classes, as case folding would add letters outside ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", names)


def _named(names: str, value: str) -> str:
    return rf"""({_either(names)})["']?\x20*[:=]\x20*["']?({value}+)"""


_VALUE = "[A-Za-z0-9+/_.=-]"
#: The patterns are in the part of the syntax that Python, RE2 and Java read alike.
ASSIGN_PATTERN = _named("password|passwd|secret|token|api_?key", _VALUE)
ACCESS_PATTERN = "AKIA[A-Z0-9]+"
HEX_PATTERN = f"[0-9a-f]{{{HEX_CHARS},}}"
IDENTIFIER_PATTERN = _named("access_?key_?id|client_?id|account_?id|user_?name|login", "[A-Za-z0-9@._+-]")
NAMED_PATTERN = _named("passphrase|pwd|private_?key|credential", _VALUE)
BARE_PATTERN = f"[A-Za-z0-9+/]{{{BARE_CHARS},}}={{0,2}}"
ENDPOINT_PATTERN = r"""(https?|wss?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]{1,5})?"""

_assign, _access, _hex, _identifier, _secret, _bare, _endpoint = (re.compile(p) for p in (ASSIGN_PATTERN, ACCESS_PATTERN, HEX_PATTERN, IDENTIFIER_PATTERN, NAMED_PATTERN, BARE_PATTERN, ENDPOINT_PATTERN))
#: Texts without any of these (in lower case) hold no named part, and their patterns needn't run.
_HINTS_ASSIGN = ("passw", "secret", "token", "key")
_HINTS_WEAK = ("id", "user", "login", "passphrase", "pwd", "key", "credential")


def _overlaps(taken: list[tuple[int, int]], reach: list[int], start: int, end: int) -> bool:
    """Whether a sorted list of spans overlaps one; reach: the running maximum of their ends."""
    i = bisect_left(taken, (end,))
    return i > 0 and reach[i - 1] > start


def _sorted(spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    spans, reach = sorted(spans), []
    for _, end in spans:
        reach.append(max(end, reach[-1]) if reach else end)
    return spans, reach


def parts(text: str) -> list[tuple[int, int, int, int, bool]]:
    """(kind, start, end, scope, backs) of all strong and weak parts; backs: whether it can support another part."""
    low = text.lower()
    assigned = [(m, len(m[2])) for m in _assign.finditer(text)] if any(h in low for h in _HINTS_ASSIGN) else []
    strong = [(ASSIGN, *m.span(), True) for m, n in assigned if n >= ASSIGN_CHARS]
    if "AKIA" in text:
        strong += [(ACCESS, *m.span(), True) for m in _access.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    strong += [(HEX, *m.span(), not m[0].isdigit()) for m in _hex.finditer(text)]
    weak = [(SECRET, *m.span()) for m, n in assigned if SHORT_CHARS <= n < ASSIGN_CHARS]
    if any(h in low for h in _HINTS_WEAK):
        weak += [(IDENTIFIER, *m.span()) for m in _identifier.finditer(text) if len(m[2]) >= IDENTIFIER_CHARS]
        weak += [(SECRET, *m.span()) for m in _secret.finditer(text) if len(m[2]) >= NAMED_CHARS]
    if "://" in text or "." in text:
        weak += [(ENDPOINT, *m.span()) for m in _endpoint.finditer(text)]
    taken = _sorted([(a, b) for _, a, b, _ in strong])
    weak = [w for w in weak if not _overlaps(*taken, w[1], w[2])]
    bare = [m.span() for m in _bare.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])]
    taken = _sorted([(a, b) for _, a, b, _ in strong] + [(a, b) for _, a, b in weak])
    weak += [(SECRET, a, b) for a, b in bare if not _overlaps(*taken, a, b)]
    if not strong and not weak:
        return []
    breaks = [m.start() for m in re.finditer("\n\n", text)] if weak else []
    found = sorted({*strong, *[(k, a, b, k != ENDPOINT) for k, a, b in weak]}, key=lambda p: (p[1], p[0], p[2]))
    return [(k, a, b, bisect_right(breaks, a), backs) for k, a, b, backs in found]


FOUND = "doc_id string, parts array<struct<start: long, kind: int, end: long, scope: long, backs: boolean>>"


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ("kind", "start", "end", "scope", "backs")
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "parts": [[dict(zip(names, p, strict=True)) for p in parts(t)] for t in batch["text"]]})


def _bins(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / REACH), F.floor(last / REACH))).alias("bin")


def linked(found: DataFrame) -> DataFrame:
    """row, start, kind, end of the weak parts that stand beside their complement. found: row and parts, see FOUND."""
    each = found.select("row", F.inline("parts"))
    weak = each.filter(F.col("kind") >= IDENTIFIER).select("row", "scope", "kind", "start", "end", _bins(F.col("start") - REACH, F.col("end") - 1 + REACH))
    names = F.col("kind").isin(ACCESS, IDENTIFIER)
    backing = each.filter("backs").select("row", "scope", names.alias("names"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), _bins(F.col("start"), F.col("end") - 1))
    gap = F.greatest(F.col("b_start") - F.col("end"), F.col("start") - F.col("b_end"))
    met = weak.join(backing, ["row", "scope", "bin"]).filter(gap.between(0, REACH))
    by = met.groupBy("row", "start", "kind", "end").agg(F.max("names").alias("named"), F.max(~F.col("names")).alias("keyed"))
    return by.filter((F.col("named") | (F.col("kind") == IDENTIFIER)) & (F.col("keyed") | (F.col("kind") == SECRET))).select("row", "start", "kind", "end")


def _listed(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts and hash of the strong spans, and `spans`, all of them: strong ones and linked weak ones."""
    bounded(docs.sparkSession)
    rows = docs.select(id_text(), text_of().alias("text"))
    found = stored(with_ids(rows.mapInPandas(_found, FOUND), "doc_id").withColumn("row", F.monotonically_increasing_id()))
    more = linked(found.filter(F.exists("parts", lambda p: p["kind"] >= IDENTIFIER)))
    more = more.groupBy(F.col("row").alias("m_row")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    strong = F.transform(F.filter("parts", lambda p: p["kind"] < IDENTIFIER), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    out = found.select("doc_id", "row", strong.alias("strong")).join(more, F.col("row") == F.col("m_row"), "left")
    count = lambda kind: F.size(F.filter("strong", lambda p: p["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", count(ASSIGN).alias("n_assign"), count(ACCESS).alias("n_access"), count(HEX).alias("n_hex"),
        F.sha2(_listed(F.col("strong")), 256).alias("base_sha256"),
        _listed(F.when(F.col("more").isNull(), F.col("strong")).otherwise(F.concat("strong", "more"))).alias("spans"),
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


def _sql() -> str:
    q = lambda p: p.replace("'", "''")

    def matches(name: str, pattern: str) -> str:
        """Matches of a pattern in order, with their places: the lengths of what lies between them and of themselves add up."""
        return rf"""{name} AS (SELECT u, m, CAST(coalesce(sum(length(gap) + length(m)) OVER (PARTITION BY u ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS BIGINT) AS s
  FROM (SELECT u, unnest(ms) AS m, unnest(gs[1 : len(ms)]) AS gap, unnest(range(1, len(ms) + 1)) AS i
    FROM (SELECT u, regexp_extract_all(t, '{q(pattern)}') AS ms, string_split_regex(t, '{q(pattern)}') AS gs FROM d)))"""

    group = lambda p: f"length(regexp_extract(m, '{q(p)}', 2))"
    ctes = ",\n".join(matches(n, p) for n, p in (("m_as", ASSIGN_PATTERN), ("m_ac", ACCESS_PATTERN), ("m_hx", HEX_PATTERN), ("m_id", IDENTIFIER_PATTERN), ("m_nm", NAMED_PATTERN), ("m_br", BARE_PATTERN), ("m_ep", ENDPOINT_PATTERN)))
    names = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    clear = lambda a, b: f"NOT EXISTS (SELECT 1 FROM {b} WHERE {b}.u = {a}.u AND {b}.s < {a}.e AND {a}.s < {b}.e)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
{ctes},
st AS (
  SELECT u, 0 AS k, s, s + length(m) AS e, true AS backs FROM m_as WHERE {group(ASSIGN_PATTERN)} >= {ASSIGN_CHARS}
  UNION ALL SELECT u, 1, s, s + length(m), true FROM m_ac WHERE length(m) >= {ACCESS_CHARS}
  UNION ALL SELECT u, 2, s, s + length(m), regexp_matches(m, '[a-f]') FROM m_hx),
w0 AS (
  SELECT u, 4 AS k, s, s + length(m) AS e FROM m_as WHERE {group(ASSIGN_PATTERN)} BETWEEN {SHORT_CHARS} AND {ASSIGN_CHARS - 1}
  UNION SELECT u, 3, s, s + length(m) FROM m_id WHERE {group(IDENTIFIER_PATTERN)} >= {IDENTIFIER_CHARS}
  UNION SELECT u, 4, s, s + length(m) FROM m_nm WHERE {group(NAMED_PATTERN)} >= {NAMED_CHARS}
  UNION SELECT u, 5, s, s + length(m) FROM m_ep),
w1 AS (SELECT * FROM w0 WHERE {clear('w0', 'st')}),
br AS (SELECT u, 4 AS k, s, s + length(m) AS e FROM m_br WHERE regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')),
w AS (SELECT * FROM w1 UNION SELECT * FROM br WHERE {clear('br', 'st')} AND {clear('br', 'w1')}),
p AS (SELECT x.*, (length(substr(t, 1, x.s)) - length(replace(substr(t, 1, x.s), chr(10) || chr(10), ''))) // 2 AS scope
  FROM (SELECT u, k, s, e, backs FROM st UNION ALL SELECT u, k, s, e, k <> 5 FROM w) x JOIN d USING (u)),
l AS (SELECT a.u, a.k, a.s, a.e FROM p a JOIN p b ON a.u = b.u AND a.scope = b.scope AND b.backs AND a.k >= 3 AND greatest(b.s - a.e, a.s - b.e) BETWEEN 0 AND {REACH}
  GROUP BY ALL HAVING (bool_or(b.k IN (1, 3)) OR a.k = 3) AND (bool_or(b.k NOT IN (1, 3)) OR a.k = 4)),
o AS (SELECT u, k, s, e FROM st UNION ALL SELECT * FROM l),
g AS (SELECT u, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS base, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM o GROUP BY u)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (u)
"""


OP11_SQL = _sql()
