"""Personal data: pattern proposals, checksum validators, context scores.

Native: every step is a built-in column function. A kind's matches and the gaps
between them come from one pattern; running sums of their lengths give spans.

Patterns that repeat a group (``(\\.x)+``) recurse once per repetition in the
JVM's engine and overflow its stack on long texts. Each is therefore run on a
text of the same length in which an inner separator is masked, so that a single
possessive character class matches the whole of it, in linear time:

* email: a dot between two domain characters is masked; a match starts where a
  run of local characters does, or at the end of the match before it.
* card: a blank or dash between two digits is masked.
* ip, phone: no repeated group is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

MASK = "\x01"
LOCAL = r"A-Za-z0-9._%+\-"
DOMAIN = r"A-Za-z0-9\-"
#: Kinds in output order; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]
#: kind -> (score of a validated span, further score if a context word is near)
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.7, 0.3), "iban": (0.9, 0.1), "ssn": (0.2, 0.7)}
#: Context words, looked for in the CONTEXT code points before a span, through two
#: earlier spans of its kind ("cards: A, B"), and in the first AFTER behind it.
CONTEXT, AFTER = 48, 24
CONTEXT_WORDS = {
    "email": r"(?i)\b(?:e-?mail|mailto|contact|write)",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)",
    "phone": r"(?i)\b(?:tel|phone|mobile|call|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)",
    "ssn": r"(?i)\b(?:ssn|social security|tax id)",
}
#: Spans that only the method adds are kept from this score on.
LEAST_SCORE = 0.5
_CHUNK = 128


def _pattern(kind: str) -> str:
    return {
        "email": rf"(?:(?<![{LOCAL}{MASK}])|\G)[{LOCAL}{MASK}]++@[{DOMAIN}]++{MASK}[{DOMAIN}{MASK}]*+",
        "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        "card": rf"[0-9][0-9{MASK}]++",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    }[kind]


def _scanned(kind: str, text: Column) -> Column:
    """The text that the kind's pattern runs on; same length, same digits."""
    clean = F.translate(text, MASK, "\x02")
    if kind == "email":
        return F.regexp_replace(clean, rf"(?<=[{DOMAIN}])\.(?=[{DOMAIN}])", MASK)
    if kind == "card":
        return F.regexp_replace(clean, r"(?<=[0-9])[\x20-](?=[0-9])", MASK)
    return text


def _possible(kind: str, text: Column) -> Column:
    """False where a cheap look shows that no match is possible."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
        "phone": F.contains(text, F.lit("+")),
        "iban": text.rlike(r"[A-Z]{2}[0-9]{2}"),
        "ssn": text.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
    }[kind]


def _scan(values: Column) -> Column:
    """[0, v1, v1+v2, ...] of a short array."""
    return F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def running_sums(values: Column) -> Column:
    """Inclusive running sums, in chunks so that long arrays stay cheap."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")), lambda k: F.slice(values, k * _CHUNK + 1, F.lit(_CHUNK)))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
    inner = F.zip_with(chunks, F.slice(_scan(totals), 1, F.size(totals)), lambda c, off: F.transform(F.slice(_scan(c), 2, F.size(c)), lambda y: y + off))
    return F.when(F.size(values) > 0, F.flatten(inner)).otherwise(F.array().cast("array<int>"))


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """True if an account number without blanks passes the mod-97 check."""
    turned = F.concat(F.substr(code, F.lit(5), F.length(code)), F.substr(code, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), F.lit(0), add) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = F.split(value, r"\.")
        return F.forall(F.transform(part, lambda p: F.regexp_replace(p, "^0+(?=.)", "")), lambda p: (F.length(p) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        code = F.regexp_replace(value, "\\x20", "")
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    # Numbers that are never given out: an area of 000, 666 or from 900 on, parts of noughts.
    return ~value.rlike(r"^(?:000|666|9)|-00-|-0000$")


def _gap(text: Column) -> Column:
    """The text between two matches: its length and its ends."""
    return F.struct(F.length(text).alias("n"), F.right(text, F.lit(CONTEXT)).alias("tail"), F.left(text, F.lit(AFTER)).alias("head"))


def _near(kind: str, values: Column, gaps: Column, i: Column) -> Column:
    """True if a context word stands near match ``i``."""

    def part(k: int) -> Column:
        return F.concat(F.coalesce(F.get(gaps, i - k)["tail"], F.lit("")), F.coalesce(F.get(values, i - k), F.lit("")))

    before = F.right(F.concat(part(2), part(1), F.get(gaps, i)["tail"]), F.lit(CONTEXT))
    return before.rlike(CONTEXT_WORDS[kind]) | F.get(gaps, i + 1)["head"].rlike(CONTEXT_WORDS[kind])


def _span(kind: str, rank: int, values: Column, gaps: Column):
    """Maps the end and place of a match to its span, or null if it fails."""
    score, more = SCORES[kind]

    def span(end: Column, i: Column) -> Column:
        value = F.get(values, i)
        total = F.lit(score) + F.when(_near(kind, values, gaps, i), more).otherwise(0.0)
        ok = _valid(kind, value) if kind in BASE_KINDS else _valid(kind, value) & (total >= LEAST_SCORE)
        return F.when(ok, F.struct((end - F.length(value)).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.round(total, 3).alias("score")))

    return span


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and ``spans``.

    ``spans`` is an array of (start, rank, end, kind, score), ordered by start
    and then by kind as in KINDS; positions count code points, ends are
    exclusive. Within a kind matches are leftmost and do not overlap; a match
    that fails its validator is dropped and not tried again.

    Null text: no spans. Ties and repeated rows: each row by itself. Empty
    table: no rows. Other columns are ignored.
    """
    out = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    for kind in KINDS:
        scanned, pattern = _scanned(kind, F.col("text")), F.lit(_pattern(kind))
        out = out.withColumn(f"{kind}_v", F.when(_possible(kind, F.col("text")), F.regexp_extract_all(scanned, pattern, F.lit(0))))
        gaps = F.transform(F.split(scanned, _pattern(kind), -1), _gap)
        out = out.withColumn(f"{kind}_g", F.when(F.size(f"{kind}_v") > 0, gaps))
    for rank, kind in enumerate(KINDS):
        v, g = F.col(f"{kind}_v"), F.col(f"{kind}_g")
        steps = F.zip_with(F.slice(g, 1, F.size(v)), v, lambda a, b: a["n"] + F.length(b))
        out = out.withColumn(f"{kind}_e", F.when(F.size(v) > 0, running_sums(steps)))
        found = F.filter(F.transform(F.col(f"{kind}_e"), _span(kind, rank, v, g)), lambda s: s.isNotNull())
        none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>")
        out = out.withColumn(f"{kind}_s", F.coalesce(found, none))
    spans = F.array_sort(F.concat(*[F.col(f"{k}_s") for k in KINDS]))
    return out.select(F.col("id").alias(id_col), spans.alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.aggregate("spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"))


QUERIES = {"op2_pii": op2_pii}
ORACLES: dict[str, str] = {}
