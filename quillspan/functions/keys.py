"""Identifier keys: look-alike letters, digit keys, state suffixes, class chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that scanning takes for digits, with those digits.
LOOKALIKES = ("OolI|SsgqGBZz", "0011155996822")
# The 27 states.
STATES = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()
#: A state's letters as scanned: S may be 5, O may be 0.
_STATE = "|".join(s.replace("S", "[S5]").replace("O", "[O0]") for s in sorted(STATES))
_TAIL = rf"(?:(?:\s{{0,4}}[/\-–—]\s{{0,4}}|\s{{0,4}}\(\s{{0,4}}|\s{{1,4}})(?:{_STATE})|(?<=[0-9])(?:{'|'.join(sorted(STATES))}))\s{{0,4}}\)?\s{{0,4}}[.,;]?\s{{0,4}}$"
#: How near the end a state stands.
TAIL = 32
# Classes that count as one another.
SAME_CLASS = (("RESP", "RESPE"), ("ARESP", "ARESPE"), ("AGR", "AGINT", "AG"), ("RR", "AIRR", "ARR", "RRAG", "ROT", "E", "EDCIV"))
# The court that the 14th digit of a 20-digit key names, and the classes that only one court has.
COURT_OF_DIGIT = {"5": "TST", "6": "TSE", "7": "STM"}
CLASSES_OF_COURT = {
    "STJ": ("RESP", "ARESP", "ERESP", "EARESP", "RHC"),
    "STF": ("RE", "ARE", "ADI", "ADPF", "ADC"),
    "TSE": ("RESPE", "ARESPE", "RO", "AI", "AIJE", "RCED", "PC", "LT", "RP", "RRP", "TUTCAUT"),
    "TST": ("RR", "AIRR", "ARR", "RRAG", "ROT"),
    "STM": ("APL", "RSE", "EI", "RDI", "CJ", "CP"),
}


def fix_group(group: Column) -> Column:
    """A group's digits with look-alikes replaced; null if it has no digit or more letters than digits. A digit never changes."""
    digits = F.length(F.regexp_replace(group, "[^0-9]", ""))
    return F.when((digits > 0) & (F.length(group) - digits <= digits), F.translate(group, *LOOKALIKES))


def key_format(digits: Column) -> Column:
    """cnj (14 to 20 digits), registro (12 that start with a year), outro (none or over 20), else sequencial."""
    n = F.length(digits)
    return F.when((n == 0) | (n > 20), "outro").when(n.between(14, 20), "cnj").when((n == 12) & digits.rlike("^(19|20)"), "registro").otherwise("sequencial")


def digit_key(digits: Column) -> Column:
    """The key that identifiers are joined on: text, never a number, because 20 digits and leading zeros matter."""
    n = F.length(digits)
    short = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(n.between(14, 20), F.lpad(digits, 20, "0")).when((n > 20) | ((n == 12) & digits.rlike("^(19|20)")), digits).otherwise(short)


def split_state(piece: Column) -> tuple[Column, Column]:
    """What stands before a state suffix, and the state; the state is null and the text whole without one or without a digit before it."""
    head = F.substr(piece, F.lit(1), F.greatest(F.length(piece) - TAIL, F.lit(0)))
    end = F.right(piece, F.lit(TAIL))
    tail = F.regexp_extract(end, _TAIL, 0)
    rest = F.concat(head, F.substr(end, F.lit(1), F.length(end) - F.length(tail)))
    found = (tail != "") & rest.rlike("[0-9]")
    state = F.translate(F.regexp_extract(tail, rf"({_STATE})\s{{0,4}}\)?\s{{0,4}}[.,;]?\s{{0,4}}$", 1), "50", "SO")
    return F.when(found, rest).otherwise(piece), F.when(found, state)


def main_class(chain: Column) -> Column:
    """The last element of a class chain that is no ordinal."""
    return F.get(F.reverse(F.filter(chain, lambda x: ~x.rlike("^[0-9]+O$"))), F.lit(0))


def class_group(c: Column) -> Column:
    """A name for all classes that count as one another."""
    out = c
    for first, *others in SAME_CLASS:
        out = F.when(c.isin(*others), first).otherwise(out)
    return out


def inferred_court(main: Column, key: Column) -> Column:
    """The court that a 20-digit key or else an exclusive class implies; null where neither does."""
    digit, cls = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d, court in COURT_OF_DIGIT.items():
        digit = F.when((F.length(key) == 20) & (F.substring(key, 14, 1) == d), court).otherwise(digit)
    for court, classes in CLASSES_OF_COURT.items():
        cls = F.when(main.isin(*classes), court).otherwise(cls)
    return F.coalesce(digit, cls)


def class_tier(cited: Column, own: Column) -> Column:
    """1 same class, 2 compatible class, 3 another; a missing class is compatible."""
    return F.when(cited == own, 1).when(cited.isNull() | own.isNull() | (class_group(cited) == class_group(own)), 2).otherwise(3)


def near_word(a: Column, b: Column) -> Column:
    """Equal, or one edit apart with five letters or more each."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(a, b, 1) == 1))


def all_near(cited: Column, own: Column) -> Column:
    """Every cited word is near some own word; no cited words match nothing."""
    return (F.size(cited) > 0) & F.forall(cited, lambda x: F.exists(own, lambda y: near_word(x, y)))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of parts joined by the unit separator; null parts are empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
