"""Personal data in whole texts with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod 97 for IBANs, ranges
for IP parts, digit counts for phones), and words nearby raise or lower a span's score. The base kinds
(email, ip, card, phone) are reported whenever valid, whatever their score; the further kinds (iban,
ssn, local_phone, access_key, secret) need a valid form and a score of at least `min_score`.

A match's place comes from splitting the text by the same pattern: the gaps and the matches alternate,
and their lengths add up to code-point offsets. The patterns are possessive and start only at a run's
start or where the last match ended (\\G), which finds what the plain leftmost patterns find and keeps
the work linear in runs of any length. An IBAN's pattern proposes only where it starts; what follows may be
capitals and digits that don't belong to it, so its end is looked for among the ends of words.

Defined results: null and empty texts have no spans. Spans of different kinds may overlap; those of a
kind don't. Rows and extra columns stay as they are; a column named pii is replaced. The work is linear in a text and its
matches but for blocks' arrays, one for every 256 matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the kinds, base kinds first, in the order in which spans of one start are listed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9.+-])\(?[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9.-])",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i)(?<![a-z])(?:password|passwd|token|secret|api[_-]?key)\x20?[=:]\x20?[\"']?[a-z0-9_+/.-]{8,}+",
}
BASE = ("email", "ip", "card", "phone")
#: Matches that are gathered at once, and code points of a text's pieces.
BLOCK, PIECE = 256, 4096
#: Words that speak for a kind within `reach` characters before or after, and a kind's score without them.
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|address|server|host|adresse",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|anruf|appel",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|social-security",
    "local_phone": "phone|call|tel|mobile|fax",
    "access_key": "key|aws|secret",
    "secret": "login|user|account|auth",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.8, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3, "access_key": 0.9, "secret": 0.6}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
        "GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 "
        "MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_AGAINST = "version|invoice|order no|isbn|serial"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check: from the right, every second digit doubled (less 9 over 9)."""

    def add(total, i):
        d = F.substring(digits, -i, 1).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN (spaces allowed) leaves 1: four first characters to the end, letters as 10 to 35, remainder by 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest, i):
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: x.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        digits = _digits(match)
        # nested, so that long runs of digits aren't summed
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "secret":
        return match.rlike("[0-9]")  # of names and words alone, most are none
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(items: Column, step, none: Column) -> Column:
    """The structs (start, match) that step(at, item) -> (at, start, match) gives in order, at from 0 on; those with a null match are left out.

    Items are folded `BLOCK` at a time, so that what is found is copied to its block's end only, and the blocks' arrays once each.
    """
    kind = "array<struct<start: int, match: string>>"
    empty, empties = F.expr(f"cast(array() as {kind})"), F.expr(f"cast(array() as array<{kind}>)")

    def one(state, item):
        def told(x):
            pair = F.struct(x["start"].alias("start"), x["match"].alias("match"))
            return F.struct(x["at"].alias("at"), F.when(x["match"].isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(pair))).alias("found"))

        return _let(step(state["at"], item), told)

    def blocks(every):
        def block(state, i):
            inner = F.aggregate(F.slice(every, i * BLOCK + 1, F.lit(BLOCK)), F.struct(state["at"].alias("at"), empty.alias("found")), one)
            return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["found"], F.array(x["found"])).alias("found")))

        return F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int")), F.struct(F.lit(0).alias("at"), empties.alias("found")), block)["found"])

    return _let(items, lambda x: F.when(F.size(x) > 0, blocks(x)).otherwise(none))


def candidates(kind: str, text: Column, check: bool = True) -> Column:
    """Array of (start, match) of the kind's pattern; offsets from the gaps between matches. With check, of valid ones only."""
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("match"))

    def step(at, pair):
        begin = at + F.length(pair["gap"])
        match = F.when(pair["match"].isNotNull() & valid(kind, pair["match"]), pair["match"]) if check else pair["match"]
        return F.struct((begin + F.coalesce(F.length(pair["match"]), F.lit(0))).alias("at"), begin.alias("start"), match.alias("match"))

    return _fold(pairs, step, F.expr("cast(array() as array<struct<start: int, match: string>>)"))


def _cut(pieces: Column, start: Column, n: Column) -> Column:
    """n <= PIECE code points of a text from start on (from 0), without reading all that lies before them."""
    i = F.floor(start / PIECE).cast("int")
    return F.substr(F.concat_ws("", F.get(pieces, i), F.get(pieces, i + 1)), start - i * PIECE + 1, n)


def ibans(text: Column, pieces: Column) -> Column:
    """Array of (start, match) of valid IBANs, those that start inside the one before left out.

    Of a country's IBANs the end is at its length, or where the whole run ends; of unknown countries at the last end that is valid.
    """
    lengths = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))

    def ended(x):
        def chosen(near):
            around, run = near["around"], near["run"]

            def ends(n):
                match = F.substr(run, F.lit(1), n)
                size, usual = F.length(F.replace(match, F.lit(" "), F.lit(""))), F.element_at(lengths, F.substring(run, 1, 2))
                fits = (size >= 15) & (usual.isNull() | (size == usual) | (n == F.length(run)))
                # nested, so that only few ends are summed
                return F.when(~F.endswith(match, F.lit(" ")) & ~F.substr(around, n + 1, F.lit(1)).rlike("[A-Za-z0-9]") & fits, mod97(match)).otherwise(F.lit(False))

            found = F.filter(F.sequence(F.length(run), F.lit(15), F.lit(-1)), ends)
            usual = F.filter(found, lambda n: F.length(F.replace(F.substr(run, F.lit(1), n), F.lit(" "), F.lit(""))) == F.element_at(lengths, F.substring(run, 1, 2)))
            return F.struct(x["start"].alias("start"), F.substr(run, F.lit(1), F.coalesce(F.get(usual, F.lit(0)), F.get(found, F.lit(0)))).alias("match"))

        around = _cut(pieces, x["start"], F.lit(65))
        return _let(F.struct(around.alias("around"), F.regexp_extract(around, r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", 0).alias("run")), chosen)

    valid_ones = F.filter(F.transform(candidates("iban", text, check=False), ended), lambda x: x["match"].isNotNull())

    def step(at, x):
        free = x["start"] >= at
        return F.struct(F.when(free, x["start"] + F.length(x["match"])).otherwise(at).alias("at"), x["start"].alias("start"), F.when(free, x["match"]).alias("match"))

    return _fold(valid_ones, step, F.expr("cast(array() as array<struct<start: int, match: string>>)"))


def spans_of(kind: str, text: Column, pieces: Column, min_score: float, reach: int) -> Column:
    """Array of (start, place of the kind, kind, end, score)."""
    order = list(PATTERNS).index(kind)
    found = ibans(text, pieces) if kind == "iban" else candidates(kind, text)

    def scored(x):
        before = _cut(pieces, F.greatest(x["start"] - reach, F.lit(0)), F.least(x["start"], F.lit(reach)))
        around = F.lower(F.concat_ws("\n", before, _cut(pieces, x["start"] + F.length(x["match"]), F.lit(reach))))
        score = F.lit(PRIOR[kind]) + F.when(around.rlike(CONTEXT[kind]), 0.3).otherwise(0.0) - F.when(around.rlike(_AGAINST), 0.3).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(order).alias("place"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("end"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    out = F.transform(found, scored)
    return out if kind in BASE else F.filter(out, lambda x: x["score"] >= min_score)


#: What a text must hold for a kind to be looked for: cheap tests before the patterns.
_NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
_LOOKS = {"ip": r"[0-9]\.[0-9]", "iban": "[A-Z][0-9][0-9]", "access_key": "A[KS]IA", "secret": "(?i)passw|token|secret|api[_-]?key"}


def find_pii(docs: DataFrame, text_col: str = "text", min_score: float = 0.5, reach: int = 40) -> DataFrame:
    """docs with pii: an array of (start, place, kind, end, score) in order of start, then kind."""
    empty = F.expr("cast(array() as array<struct<start: int, place: int, kind: string, end: int, score: double>>)")
    work = docs.withColumn("_pii_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    work = work.withColumn("_pii_pieces", F.regexp_extract_all("_pii_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    text, pieces = F.col("_pii_text"), F.col("_pii_pieces")
    columns = []
    for kind in PATTERNS:
        needs = text.contains(_NEEDS[kind]) if kind in _NEEDS else text.rlike(_LOOKS.get(kind, "[0-9]"))
        columns.append(F.when(needs, spans_of(kind, text, pieces, min_score, reach)).otherwise(empty))
    found = F.array_sort(F.concat(*columns))
    return work.withColumn("pii", found).drop("_pii_text", "_pii_pieces")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _is(kind: str):
    return lambda x: x["kind"] == kind


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    found = find_pii(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text")
    base = F.filter("pii", lambda x: x["place"] < len(BASE))
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
