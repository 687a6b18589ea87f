"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score.

Built-in functions only. The start of each match is the running sum over what ``split`` leaves between
matches and the matches themselves, so a text is read twice per kind and never once per match.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import bind

# Matches summed up in one go; running sums go over blocks of so many.
BLOCK = 256
# Characters on each side of a span in which context words count.
NEAR = 48


class Kind(NamedTuple):
    """``pattern`` proposes, ``confirm`` is a condition on the match, ``score`` is what the match alone is worth.

    A match with a score below 1 stays if it, plus 0.4 if a word of ``context`` is near and less 0.4 if one of
    ``against`` is, reaches 0.5. ``needs`` is a substring, ``hint`` a pattern, that every text with a match has.
    """

    name: str
    pattern: str
    confirm: object
    score: float = 1.0
    context: str = ""
    needs: str = ""
    against: str = ""
    hint: str = ""


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def small_parts(match: Column) -> Column:
    """Every part of a dotted number is at most 255."""
    return F.forall(F.split(match, r"\."), lambda p: bind(
        F.regexp_replace(p, "^0+", ""), lambda v: (F.length(v) < 3) | ((F.length(v) == 3) & (v <= "255"))))


def luhn(number: Column) -> Column:
    """Luhn's sum over a string of at most 19 digits, from the right, is a multiple of ten."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda d, k: F.when(k % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def is_card(match: Column) -> Column:
    return bind(digits(match), lambda n: F.when(F.length(n).between(13, 19), luhn(n)).otherwise(F.lit(False)))


def is_phone(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


def is_iban(match: Column) -> Column:
    """ISO 7064 mod 97-10 over the number with its head moved to the end, letters as 10 to 35."""
    def remainder(plain: Column) -> Column:
        turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
        step = lambda a, c: F.when(
            c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
        return F.aggregate(turned, F.lit(0), step)

    return bind(F.regexp_replace(match, " ", ""),
                lambda plain: F.length(plain).between(15, 34) & (remainder(plain) == 1))


# What follows country code and check digits, by country: so many digits (n), capitals (a), or either (c).
IBANS = {
    "11n": "NO", "12n": "BE", "14n": "DK FI FO GL SD", "15n": "SI", "16n": "AT BA EE LT MN XK", "17n": "HR",
    "18n": "CR DE ME RS VA", "19n": "AE IL SO TL", "20n": "CZ ES SE SK TN", "21n": "AO CV LY MZ PT ST",
    "22n": "DZ IR IS", "23n": "BI CF CG CM DJ GA GQ KM MG MR TD", "24n": "HU MA PL", "25n": "EG",
    "2a12n": "FK", "2a16n": "GE", "4a10n": "NL", "4a14n": "GB IE", "4a16n": "VG", "4a20n": "HN NI SV",
    "3n10c2n": "MK", "3n13c": "KZ LU", "3n16c": "OM", "5n12c": "CH LI", "7n16c": "GR", "8n12c": "AD",
    "8n16c": "AL CY", "6n16c": "TR", "6n19c": "UA", "4n20c": "LB", "14n15c": "RU", "10n11c2n": "FR MC", "2n18c": "SA",
    "1a10n12c": "IT SM", "4a13c": "LV", "4a14c": "BH", "4a15c": "GI", "4a15n": "IQ", "4a16c": "PK RO",
    "4a6n8c": "BG", "4a5n18c": "MT", "4a4n18c": "JO YE", "4a19n3a": "MU", "4a20n3a": "SC", "4a20c": "AZ",
    "4a21c": "PS QA", "4a22c": "KW", "4a24c": "LC", "4c4n16c": "BY", "4c20n": "DO", "4c20c": "GT", "2c18c": "MD",
    "23n1a1c": "BR", "2c22n": "BF BJ CI ML NE SN TG", "2c19n": "GW",
}


def iban_pattern() -> str:
    """A country's code and as many characters as its IBANs have, each after at most one space: no word behind it."""
    kinds = {"n": "[0-9]", "a": "[A-Z]", "c": "[A-Z0-9]"}
    each = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}" + "".join(
        f"(?: ?{kinds[kind]}){{{n}}}" for n, kind in re.findall("([0-9]+)([nac])", shape))
        for shape, codes in IBANS.items()]
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(each)})(?![A-Za-z0-9])"


def is_national_number(match: Column) -> Column:
    """Groups that are never issued are no such number."""
    return ~match.rlike("^(000|666|9)") & ~match.rlike("-00-") & ~match.rlike("0000$")


def is_routing_number(match: Column) -> Column:
    """Weights 3, 7, 1 over nine digits give a multiple of ten; the first two digits name a district or a use."""
    values = F.transform(F.split(match, ""), lambda d: d.cast("int"))
    total = F.aggregate(F.transform(values, lambda d, k: d * F.when(k % 3 == 0, 3).when(k % 3 == 1, 7).otherwise(1)),
                        F.lit(0), lambda a, d: a + d)
    return match.rlike("^(0[0-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)") & (total % 10 == 0)


def is_dni(match: Column) -> Column:
    """The letter stands for the number modulo 23; X, Y and Z in front stand for 0, 1 and 2."""
    number = F.translate(F.substring(match, 1, 8), "XYZ", "012").cast("int")
    return F.substring(F.lit(DNI_LETTERS), number % 23 + 1, F.lit(1)) == F.substring(match, 9, 1)


def is_random(match: Column) -> Column:
    """Letters and digits, at least six different ones, and not one character for most of it."""
    return match.rlike("[A-Za-z]") & match.rlike("[0-9]") & (
        F.size(F.array_distinct(F.split(match, ""))) >= F.least(F.lit(8), F.floor(F.length(match) / 2) + 2))


# The letters of Spanish identity numbers by remainder.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
# Words that say that what stands nearby is nobody's.
MADE_UP = r"\b(example|sample|dummy|placeholder|fake|changeme|fictitious)\b"
# A name under which secrets are kept, and what stands between it and its value.
NAMED = (r"""(?:pass(?:word|wd|phrase)|pwd|secret|token|(?:api|access|private|secret|auth)[_-]?key|credentials?)"""
         r"""["']{0,1}\s{0,3}[=:]\s{0,3}["']{0,1}""")
VALUE = "[A-Za-z0-9_./+~-]"
# Forms of keys that can be told without a name.
KEY_FORMS = [r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"xox[abprs]-[A-Za-z0-9-]{10,}+",
             r"AIza[A-Za-z0-9_-]{35}", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"]

# Group repetitions are possessive, which changes no match here and needs no stack for long ones. A match can only
# begin where a run of its first characters does, or where the match before it ended.
BASE = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda m: F.lit(True), needs="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", small_parts, needs="."),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", is_card),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", is_phone, needs="+"),
]
ADDED = [
    Kind("iban", iban_pattern(), is_iban, 0.6, "iban|account|konto|compte|cuenta|bank", against=MADE_UP),
    Kind("national", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", is_national_number, 0.2,
         r"ssn|social security|\bid\b|taxpayer", needs="-", against=MADE_UP),
    Kind("routing", r"(?<![A-Za-z0-9.-])[0-9]{9}(?![A-Za-z0-9-])", is_routing_number, 0.2, r"routing|\baba\b|\brtn\b",
         against=MADE_UP),
    Kind("dni", r"(?<![A-Za-z0-9])(?:[0-9]{8}|[XYZ][0-9]{7})[A-Z](?![A-Za-z0-9])", is_dni, 0.4,
         r"\b(dni|nie|nif|documento|identidad)\b", against=MADE_UP),
    # Only the value is the span. A run of its characters is looked at once, where it begins.
    Kind("secret", rf"(?<=[=:\"'\s])(?={VALUE}{{8}})(?<=(?i:{NAMED})){VALUE}{{8,}}+", is_random, 0.6,
         r"password|login|credential|secret|bearer", against=MADE_UP, hint=rf"(?i){NAMED}"),
    Kind("key", rf"(?<![A-Za-z0-9_-])(?:{'|'.join(KEY_FORMS)})(?![A-Za-z0-9_-])", is_random, 0.8,
         r"password|login|credential|secret|bearer", against=MADE_UP, hint="AKIA|ASIA|gh[pousr]_|xox[abprs]-|AIza|eyJ"),
]


def running_sums(values: Column) -> Column:
    """Sum of all values before each, in time that grows with the length, block by block."""
    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def before(part: Column, start: Column) -> Column:
        grown = F.aggregate(
            part, F.struct(start.cast("int").alias("sum"), F.array().cast("array<int>").alias("all")),
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"])).alias("all")))
        return grown["all"]

    def by_blocks(all_values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(all_values) - 1) / BLOCK).cast("int"))
        parts = F.transform(numbers, lambda b: F.slice(all_values, b * BLOCK + 1, F.lit(BLOCK)))
        return bind(parts, lambda p: bind(before(F.transform(p, total), F.lit(0)), lambda starts: F.flatten(
            F.zip_with(p, starts, before))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(bind(values, by_blocks))


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end>> of the confirmed matches, in order; positions are code points."""
    def found(text: Column) -> Column:
        return bind(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda matches: F.when(
            F.size(matches) == 0, none).otherwise(placed(text, matches)))

    def placed(text: Column, matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(matches)), F.length)
        rows = bind(gaps, lambda g: F.transform(
            F.arrays_zip(running_sums(F.zip_with(g, matches, lambda a, m: a + F.length(m))).alias("sum"),
                         g.alias("gap"), matches.alias("match")),
            lambda r: F.struct((r["sum"] + r["gap"]).alias("start"),
                               (r["sum"] + r["gap"] + F.length(r["match"])).alias("end"), r["match"].alias("match"))))
        good = F.filter(rows, lambda r: kind.confirm(r["match"]))
        if kind.score < 1.0:
            around = lambda r: F.substring(text, F.greatest(r["start"] - NEAR, F.lit(0)) + 1,
                                           r["end"] - r["start"] + 2 * NEAR)
            good = F.filter(good, lambda r: bind(F.lower(around(r)), lambda near: F.lit(kind.score) + F.when(
                near.rlike(kind.context), 0.4).otherwise(0.0) - F.when(
                near.rlike(kind.against or "$^"), 0.4).otherwise(0.0) >= 0.5 - 1e-9))
        return F.transform(good, lambda r: F.struct(F.lit(kind.name).alias("kind"), r["start"].cast("int").alias("start"),
                                                    r["end"].cast("int").alias("end")))

    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    worth = text.contains(kind.needs) if kind.needs else text.rlike(kind.hint or "[0-9]")
    if kind.score < 0.5:
        worth = worth & F.lower(text).rlike(kind.context)
    return F.when(worth, found(text)).otherwise(none)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, one array of spans per kind, ``base`` and ``spans`` (all, as kind:start:end).

    Matches of one kind are leftmost and do not overlap; those that a validator refuses are dropped without another
    try. Spans of different kinds may overlap: what is a key by its form and stands behind a name is told twice. A null
    text is empty and has none; an empty table gives an empty one. Repeated rows are judged each. Texts of any length
    are read whole, and columns other than the two are left alone, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("body"))
    found = rows.select("id", *[spans_of(F.col("body"), k).alias(k.name) for k in BASE + ADDED])
    base = F.concat(*[F.col(k.name) for k in BASE])
    spans = F.concat(*[F.col(k.name) for k in BASE + ADDED])
    return found.select(F.col("id").alias(id_col), *[k.name for k in BASE + ADDED],
                        joined(base).alias("base"), joined(spans).alias("spans"))
