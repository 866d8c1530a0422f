"""Personal data: regular expressions propose spans, checksums confirm them, words nearby move the score.

Kinds email, ip, card and phone are the base: each leftmost, without overlaps within the kind, dropped when its check fails
(parts up to 255, Luhn, number of digits). The method adds iban, confirmed by mod 97, and secret, a long run of letters and
digits of any length, dots between such runs included. A span's score is its kind's own, raised by a fifth when a word that names the kind stands shortly before it (after
the last span of that kind) and lowered by a fifth when one does that names something else; base spans are reported whatever
their score, added ones from `least` on: an iban needs no word but is dropped by a wrong one, a secret needs one.

Places come from the text between matches, so a text is scanned twice where it holds a kind at all and once, by a plain
search, where it doesn't. Patterns are possessive and start where a run starts, so that long runs stay linear. Matches are
folded in parts of PART, so that a text with very many of them doesn't copy the list of all for each.

Defined results: null is an empty text; an empty text has no spans; repeated rows each get a row; places count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, packed, unpacked

SPAN = "array<struct<kind:string,start:int,end:int,said:string,score:double>>"
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SECRET = r"[A-Za-z0-9+/_-]{20,}+(?:\.[A-Za-z0-9+/_-]{10,}+)*+"
#: Reach of the words nearby, in code points; matches folded at once.
NEAR, PART = 40, 256


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def mod97(said: Column) -> Column:
    """An IBAN's number, its first four signs moved to the end and letters counted from 10, leaves 1."""
    flat = F.replace(said, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(signs, lambda c: c != ""), F.lit(0), lambda a, c: ((a * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97).cast("int")) == 1


#: kind: (plain search that any match satisfies, pattern, check, score, words that raise it, words that lower it)
KINDS = {
    "email": (lambda t: F.contains(t, F.lit("@")), EMAIL, lambda s: F.lit(True), 0.8, "mail|contact|kontakt|correo|courriel|write|reply", "example|sample"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), IP, lambda s: s.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), 0.6, "ip|host|server|address|adresse|direcci", "version|release|section|kapitel"),
    "card": (lambda t: t.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), CARD, lambda s: F.length(_digits(s)).between(16, 19) & F.call_function("luhn_check", _digits(s)), 0.7, "card|karte|carte|tarjeta|visa|credit|kredit|pay", "order|isbn|serial|tracking|bestell"),
    "phone": (lambda t: F.contains(t, F.lit("+")), PHONE, lambda s: F.length(_digits(s)).between(8, 15), 0.6, "phone|tel|call|fax|mobil|anruf|appel|llam", "formula|score|sum"),
    "iban": (lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), IBAN, lambda s: F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & mod97(s), 0.7, "iban|bank|account|konto|compte|cuenta", "serial|part no"),
    "secret": (lambda t: t.rlike("[A-Za-z0-9+/_-]{20}"), SECRET, lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]"), 0.5, "token|secret|passw|api.?key|access.?key|private.?key|bearer|credential", "commit|checksum|digest|sha[0-9]|md5"),
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret")


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of a kind, by place."""
    has, pattern, check, score, more, less = KINDS[kind]
    # text between matches and matches, side by side; the last piece has no match after it
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("said"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / PART).cast("int")), lambda i: F.slice(pieces, i * PART + 1, F.lit(PART)))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        gap, said = x["gap"], x["said"]
        at = acc["pos"] + F.length(gap)
        near = F.lower(F.right(gap, F.lit(NEAR)))
        moved = F.lit(score) + F.when(near.rlike(more), 0.2).otherwise(0.0) - F.when(near.rlike(less), 0.2).otherwise(0.0)
        one = F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(said)).alias("end"), said.alias("said"), F.round(moved, 2).alias("score"))
        good = said.isNotNull() & check(said)
        return F.struct((at + F.coalesce(F.length(said), F.lit(0))).alias("pos"), F.when(good, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    folded = F.transform(parts, lambda p: F.aggregate(p, start, step))
    places = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def follow(acc, part):
        shifted = F.transform(part["out"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + acc["pos"]).alias("start"), (s["end"] + acc["pos"]).alias("end"), s["said"].alias("said"), s["score"].alias("score")))
        return F.struct((acc["pos"] + part["pos"]).alias("pos"), F.concat(acc["out"], F.array(shifted)).alias("out"))

    return F.when(has(text), F.flatten(F.aggregate(folded, places, follow)["out"])).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id and one array of spans for each kind (kind, start, end, said, score)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = only(docs, "doc_id", "text")
    out = rows.select("doc_id", *[spans_of(text, k).alias(k) for k in KINDS])
    return out.withColumns({k: F.filter(k, lambda s: s["score"] >= least) for k in ADDED})


def listed(*kinds: str) -> Column:
    """kind:start:end of all spans of the kinds, by kind and place, joined by commas."""
    return F.array_join(F.transform(F.concat(*kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(*kinds: str) -> Column:
    """Scores of all spans of the kinds in hundredths, in the order of listed()."""
    return F.array_join(F.transform(F.concat(*kinds), lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")


def redact(docs: DataFrame, least: float = 0.7) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; columns unchanged. Where spans overlap, the one that
    begins first wins, then the longer one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.filter(F.concat(*[spans_of(text, k) for k in KINDS]), lambda s: s["kind"].isin(*BASE) | (s["score"] >= least))
    order = F.array_sort(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    said = F.col("row.text")

    def step(acc, s):
        free = s["start"] >= acc["pos"]
        part = F.array(F.substring(said, acc["pos"] + 1, s["start"] - acc["pos"]), F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.struct(F.when(free, -s["neg"]).otherwise(acc["pos"]).alias("pos"), F.when(free, F.concat(acc["out"], part)).otherwise(acc["out"]).alias("out"))

    done = packed(docs, order=order).withColumn("done", F.aggregate("order", start, step))
    new = F.concat(F.array_join(F.col("done.out"), ""), F.substring(said, F.col("done.pos") + 1, F.length(said)))
    return unpacked(done, F.when(F.size("order") > 0, new).otherwise(said))


def op4_checked_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and places of personal data in every document."""
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed(*BASE), 256).alias("base_sha256"), listed(*KINDS).alias("spans"), *[F.size(k).cast("long").alias(f"n_{k}") for k in ADDED], F.size(F.concat(*KINDS)).cast("long").alias("n_spans"), scores(*KINDS).alias("scores"))


ORACLE = {
    "op4_checked_pii": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT k, 1 AS o, 'email' AS kind, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gaps, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS ms FROM d
  UNION ALL SELECT k, 2, 'ip', string_split_regex(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') FROM d
  UNION ALL SELECT k, 3, 'card', string_split_regex(t, '[0-9](?:[\x20-]?[0-9])+'), regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+') FROM d
  UNION ALL SELECT k, 4, 'phone', string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]'), regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
  UNION ALL SELECT k, 5, 'iban', string_split_regex(t, '\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b'), regexp_extract_all(t, '\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b') FROM d
  UNION ALL SELECT k, 6, 'secret', string_split_regex(t, '[A-Za-z0-9+/_-]{20,}(?:\.[A-Za-z0-9+/_-]{10,})*'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}(?:\.[A-Za-z0-9+/_-]{10,})*') FROM d),
x AS (SELECT * FROM (VALUES
  ('email', 80, 'mail|contact|kontakt|correo|courriel|write|reply', 'example|sample'), ('ip', 60, 'ip|host|server|address|adresse|direcci', 'version|release|section|kapitel'),
  ('card', 70, 'card|karte|carte|tarjeta|visa|credit|kredit|pay', 'order|isbn|serial|tracking|bestell'), ('phone', 60, 'phone|tel|call|fax|mobil|anruf|appel|llam', 'formula|score|sum'),
  ('iban', 70, 'iban|bank|account|konto|compte|cuenta', 'serial|part no'), ('secret', 50, 'token|secret|passw|api.?key|access.?key|private.?key|bearer|credential', 'commit|checksum|digest|sha[0-9]|md5')) v(kind, own, more, less)),
u AS (SELECT k, o, kind, unnest(ms) AS m, unnest(list_slice(gaps, 1, len(ms))) AS gap, unnest(range(1, len(ms) + 1)) AS i FROM p WHERE len(ms) > 0),
s AS (SELECT u.*, sum(length(gap) + length(m)) OVER (PARTITION BY k, o ORDER BY i) AS e, regexp_replace(m, '[^0-9]', '', 'g') AS dg, replace(m, ' ', '') AS flat,
  own + CASE WHEN regexp_matches(lower(right(gap, 40)), more) THEN 20 ELSE 0 END - CASE WHEN regexp_matches(lower(right(gap, 40)), less) THEN 20 ELSE 0 END AS score FROM u JOIN x USING (kind)),
c AS (SELECT k, o, kind, (e - length(m))::BIGINT AS st, e::BIGINT AS en, score FROM s WHERE (o < 5 OR score >= 70) AND CASE kind WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255)) = 4
  WHEN 'card' THEN length(dg) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(dg)), lambda j: CASE WHEN j % 2 = 0 THEN substr(reverse(dg), j + 1, 1)::INT WHEN substr(reverse(dg), j + 1, 1)::INT > 4 THEN 2 * substr(reverse(dg), j + 1, 1)::INT - 9 ELSE 2 * substr(reverse(dg), j + 1, 1)::INT END)) % 10 = 0
  WHEN 'phone' THEN length(dg) BETWEEN 8 AND 15
  WHEN 'secret' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
  ELSE length(flat) BETWEEN 15 AND 34 AND array_to_string(list_transform(string_split(substr(flat, 5) || substr(flat, 1, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE (ascii(x) - 55)::VARCHAR END), '')::HUGEINT % 97 = 1 END),
g AS (SELECT k, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, count(*) FILTER (o = 3) AS n3, count(*) FILTER (o = 4) AS n4, count(*) FILTER (o = 5) AS n5, count(*) FILTER (o = 6) AS n6, count(*) AS n, string_agg(score::VARCHAR, ',' ORDER BY o, st) AS scores,
  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY o, st) FILTER (o < 5) AS base, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY o, st) AS every FROM c GROUP BY k)
SELECT doc_id, coalesce(n1, 0)::BIGINT AS n_email, coalesce(n2, 0)::BIGINT AS n_ip, coalesce(n3, 0)::BIGINT AS n_card, coalesce(n4, 0)::BIGINT AS n_phone, coalesce(n5, 0)::BIGINT AS n_iban, coalesce(n6, 0)::BIGINT AS n_secret, coalesce(n, 0)::BIGINT AS n_spans, coalesce(scores, '') AS scores,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN g USING (k)""",
}
