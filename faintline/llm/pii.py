"""Personal data: patterns propose, checksums confirm, nearby words weigh; DataFrame functions only.

``find(df)`` adds ``spans``, an array of (kind, start, end, score) in code points, ordered by start and
then by the order of KINDS. ``redact(df)`` replaces every span by its kind in brackets.

Defined results: null text counts as empty and has no spans; a text of any length is read whole, in time
linear in its length and in the number of matches; repeated rows get equal spans; an empty table gives an
empty table; other columns stay as they are, whatever their names. A score is the kind's prior, raised by words of
its kind within 40 characters; credentials that are hexadecimal digits alone need such words to pass ``LEAST``.

A base match that fails its check is dropped and not tried again at a later start. All repetitions are
possessive, so no text can exhaust the stack, and a start inside a run that already failed is never tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintline.llm.common import fresh

#: Countries by the length of their IBANs (ISO 13616).
_IBAN = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(" ".join(_IBAN.values()).split())
#: As long as the country says, whatever follows; where the country is none of these, as far as the run goes.
_BY_LENGTH = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?+[A-Z0-9]){{{n - 4}}}+" for n, c in _IBAN.items()) + rf"|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}+"

KINDS = ("email", "ip", "card", "phone", "iban", "id", "secret")
BASE = KINDS[:4]
#: The score from which a span counts as personal data where no other bound is given.
LEAST = 0.5
#: Letters of Spanish identity numbers by the remainder of the number by 23; fixed values.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_BY_LENGTH})(?![A-Za-z0-9])",
    # Spanish DNI and NIE, French NIR
    "id": r"(?<![A-Za-z0-9])(?:[0-9]{8}-?+[A-Z]|[XYZ]-?+[0-9]{7}-?+[A-Z]|[12]\x20?+[0-9]{2}\x20?+(?:0[1-9]|1[0-2])\x20?+[0-9]{2}\x20?+[0-9]{3}\x20?+[0-9]{3}\x20?+[0-9]{2})(?![A-Za-z0-9])",
    # published forms of keys, signed tokens and private keys; else hexadecimal digits of 128 bits or more
    "secret": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|[0-9A-Fa-f]{32,128}+)(?![A-Za-z0-9_-])|-----BEGIN\x20(?:[A-Z]++\x20)?+PRIVATE\x20KEY-----[A-Za-z0-9+/=\s]++-----END\x20(?:[A-Z]++\x20)?+PRIVATE\x20KEY-----",
}
#: What a text needs at least for a match that can pass its check: a cheap test before positions are worked out.
_HINT = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
    "id": r"[0-9]{7}-?[A-Z]|[12]\x20?[0-9]{2}\x20?[01][0-9]\x20?[0-9]{2}\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}",
    "secret": r"[0-9A-Fa-f]{32}|A[KS]IA[A-Z0-9]{16}|gh[opsur]_|xox[abprs]-|AIza|sk-|eyJ|-----BEGIN\x20",
}
#: Words near a match that make its kind likelier.
_CONTEXT = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|address|server|host|adresse",
    "card": r"(?i)card|visa|credit|debit|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|tel|mobile|fax|appel|llam",
    "iban": r"(?i)iban|bank|account|konto|compte|cuenta",
    "id": r"(?i)\bdni\b|\bnie\b|\bnir\b|ident|passport|social|sécu",
    "secret": r"(?i)token|key|secret|passw|pwd|credential|bearer|auth",
}
_PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8, "id": 0.7, "secret": 0.8}
#: Hexadecimal digits may as well be a checksum: words nearby decide.
_BARE, _RAISE = 0.35, 0.2
_NEAR, _BLOCK, _CHUNK = 40, 256, 1024
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)


def _blocks(a: Column) -> Column:
    """An array cut into arrays of _BLOCK, so that building a result element by element stays linear."""
    last = F.floor((F.size(a) - 1) / _BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))


def _before(a: Column) -> Column:
    """For each element of a non-empty array of numbers, the sum of those before it."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def spread(parts: Column, at: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, i: F.slice(F.aggregate(p, F.array(F.get(at, i)), grow), F.lit(1), F.size(p))))

    zero = F.array(F.lit(0).cast("bigint"))
    return let(let(a, _blocks), lambda parts: let(F.aggregate(F.transform(parts, _sum), zero, grow), lambda at: spread(parts, at)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit counts double, less 9 above 9; the sum ends in 0."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.pmod(d.cast("int") * 2 - 1, F.lit(9)) + F.when(d == "0", -8).otherwise(1)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _mod97(iban: Column) -> Column:
    """First four characters to the end, letters as 10 to 35, remainder 1 by 97."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value >= 65, (rest * 100 + value - 55) % 97).otherwise((rest * 10 + value - 48) % 97).cast("int")

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "id":
        return let(F.regexp_replace(m, "[ -]", ""), lambda i: F.when(i.rlike("[A-Z]$"), _mod23(i)).otherwise(F.lit(97) - F.left(i, F.lit(13)).cast("bigint") % 97 == F.right(i, F.lit(2)).cast("int")))
    if kind == "secret":
        return ~m.rlike("^[0-9A-Fa-f]+$") | (m.rlike("[0-9]") & m.rlike("[A-Fa-f]"))
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda i: F.when(F.length(i).between(15, 34), _mod97(i)).otherwise(False))


def _mod23(ident: Column) -> Column:
    """The last letter tells the remainder of the number by 23; X, Y and Z at its head stand for 0, 1 and 2."""
    number = F.translate(F.left(ident, F.lit(1)), "XYZ", "012")
    number = F.concat(number, F.substr(ident, F.lit(2), F.length(ident) - 2)).cast("bigint")
    return F.substr(F.lit(_DNI), (number % 23 + 1).cast("int"), F.lit(1)) == F.right(ident, F.lit(1))


def _prior(kind: str, m: Column) -> Column:
    return F.when(m.rlike("^[0-9A-Fa-f]+$"), _BARE).otherwise(_PRIOR[kind]) if kind == "secret" else F.lit(_PRIOR[kind])


def _spans(text: Column, kind: str) -> Column:
    pattern = PATTERNS[kind]

    def made(found: Column, gaps: Column, starts: Column) -> Column:
        def one(i: Column) -> Column:
            m, start = F.get(found, i), F.get(starts, i) + F.length(F.get(gaps, i))
            near = F.concat_ws(" ", F.right(F.get(gaps, i), F.lit(_NEAR)), F.left(F.get(gaps, i + 1), F.lit(_NEAR)))
            score = F.least(F.lit(1.0), _prior(kind, m) + F.when(near.rlike(_CONTEXT[kind]), _RAISE).otherwise(0.0))
            return F.when(_valid(kind, m), F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score")))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(found) - 1), one), lambda s: s.isNotNull())

    def placed(found: Column) -> Column:
        # the text between matches, with the matches' lengths, gives the positions without a second search
        return let(
            F.split(text, pattern, -1),
            lambda gaps: let(_before(F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("bigint"))), lambda starts: made(found, gaps, starts)),
        )

    none = F.array().cast(_SPAN)
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none))
    return F.when(text.rlike(_HINT[kind]), found.cast(_SPAN)).otherwise(none)


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """df with the column ``out``: all spans of ``text``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rank = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*(F.lit(i) for i in range(len(KINDS)))))
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.element_at(rank, a["kind"]) - F.element_at(rank, b["kind"]))
    parts = [fresh(df, f"of_{k}") for k in KINDS]
    found = df.withColumns({p: _spans(whole, k) for p, k in zip(parts, KINDS, strict=True)})
    every = F.concat(*map(F.col, parts))
    compare = F.array_sort(every, order)
    return found.withColumn(out, F.when(F.size(every) > 1, compare).otherwise(every)).drop(*parts)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is given in chunks of _CHUNK."""
    first = F.floor(start / _CHUNK).cast("int")
    count = (F.floor((end - 1) / _CHUNK) - first + 1).cast("int")
    joined = F.array_join(F.slice(chunks, first + 1, count), "")
    return F.when(end > start, F.substring(joined, (start % _CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def redact(df: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """df with each span of at least the score ``least`` replaced; overlapping spans become one, named for the first."""
    spans = fresh(df, "spans")
    whole = F.coalesce(F.col(text), F.lit(""))

    def fold(chunks: Column, acc: Column, s: Column) -> Column:
        # what overlaps the text already written only moves the end
        more = F.concat(acc["parts"], F.array(F.concat(_cut(chunks, acc["at"], s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["parts"]).alias("parts"))

    empty = F.array().cast("array<string>")

    def block(chunks: Column, acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("parts")), lambda a, s: fold(chunks, a, s))
        return let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["parts"], F.array(F.array_join(i["parts"], ""))).alias("parts")))

    def rebuilt(chunks: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("parts"))
        done = F.aggregate(_blocks(F.col(spans)), start, lambda acc, part: block(chunks, acc, part))
        return let(done, lambda d: F.concat(F.array_join(d["parts"], ""), _cut(chunks, d["at"], F.length(whole).cast("bigint"))))

    found = find(df, text, spans)
    kept = found.withColumn(spans, F.filter(spans, lambda s: s["score"] >= least))
    chunks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    return kept.withColumn(text, F.when(F.size(spans) > 0, let(chunks, rebuilt)).otherwise(F.col(text))).drop(spans)


def report(documents: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, the digest of the base spans, all spans, and the score of each in hundredths."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    found = find(documents.select("doc_id", "text"))
    likely = F.size(F.filter("spans", lambda s: s["score"] >= LEAST)).cast("bigint")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"), likely.alias("n_likely"))
