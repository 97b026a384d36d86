"""Personal data replaced by format-preserving Feistel pseudonyms.

Native column functions only.  One regular expression finds candidates; each is
validated (Luhn check digit, octets up to 255, real calendar dates, issued
social-security ranges, ten national phone digits), and a valid one is permuted
within its own format by a keyed Feistel network over the exact size of its
domain.  A permutation is one-to-one, so equal values get equal pseudonyms in
all documents and different values never meet.  What fails validation stays as
it is.

=========  ======================================  =========================================
kind       domain permuted                         kept
=========  ======================================  =========================================
card       all digits but the check digit          separators; the new check digit is valid
phone      the last ten digits                     digits before them, separators
ip         all 2**32 addresses                     dotted form
ssn        all issued (area, group, serial)        separators
date       73,000 days from 1900-01-01             notation; time of day of a time stamp
email      no finite domain: keyed 64-bit digests  the top-level domain
=========  ======================================  =========================================

Day-first slash dates (those that cannot be month-first) are permuted among
themselves, by repeating the permutation until a day over 12 comes up, so no two
dates of a notation meet.  Phones are 3-3-4 groups with separators, or E.164
numbers of 10 to 15 digits with their plus sign.

Round function: SHA-256 of the kind's key, round and half.  Eight rounds alternate
``left = (left + f(right)) mod a`` and ``right = (right + f(left)) mod b`` on a
value ``left * b + right`` below ``a * b``.

Defined results: a null text stays null with zero counts; empty texts and texts
without a valid candidate stay as they are; repeated rows are treated alike;
empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "card", "ip", "phone", "ssn", "date")
# A host has 126 labels at most; the bound also keeps the regular expression's stack small.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}+"
_CARD = r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![A-Za-z0-9])"
_IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
_PHONE = (r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
          r"|\+[1-9]\d{9,14}|\+[1-9]\d{0,2}(?: \d{2,8}){2,4})(?![\w-])")
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?:(?![\w/-]|\.\d)|(?=T\d{2}:\d{2}))"
CANDIDATE = "|".join((_EMAIL, _CARD, _IP, _PHONE, _SSN, _DATE))
FIRST_DAY, DAY_A, DAY_B = "1900-01-01", 365, 200


def subkey(key: str, kind: str) -> str:
    """A kind's own key; plans and event logs show only these, never the secret."""
    return hashlib.sha256(f"{key}|{kind}".encode()).hexdigest()


def feistel(value: Column, a, b, key: str, kind: str) -> Column:
    """Keyed permutation of ``0 .. a * b - 1`` (long columns or numbers)."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    own = F.lit(subkey(key, kind))

    def f(r: Column, half: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", own, r, half), 256), 1, 15), 16, 10).cast("long")

    def step(acc: Column, r: Column) -> Column:
        left, right = acc["l"], acc["r"]
        even = r % 2 == 0
        return F.struct(F.when(even, (left + f(r, right)) % a).otherwise(left).alias("l"), F.when(even, right).otherwise((right + f(r, left)) % b).alias("r"))

    start = F.struct(F.call_function("div", value, b).alias("l"), (value % b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["l"] * b + acc["r"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""

    def step(acc: Column, i: Column) -> Column:
        c = m.substr(i, F.lit(1))
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["o"], F.when(is_digit, digits.substr(acc["k"], F.lit(1))).otherwise(c)).alias("o"), (acc["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), F.length(m)), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), step, lambda acc: acc["o"])


def check_digit(payload: Column) -> Column:
    """Luhn check digit of a string of digits."""
    back = F.reverse(payload)

    def step(acc: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return (10 - F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), step) % 10) % 10


def _octets(m: Column) -> list[Column]:
    return [F.split_part(m, F.lit("."), F.lit(i + 1)).cast("long") for i in range(4)]


def _ssn_parts(m: Column) -> tuple[Column, Column, Column]:
    return tuple(m.substr(a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))


def _date(m: Column) -> tuple[Column, Column]:
    """(date or null, its notation)."""
    month_first = F.try_to_date(m, "MM/dd/yyyy").isNotNull()
    notation = F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").when(month_first, "MM/dd/yyyy").otherwise("dd/MM/yyyy")
    day = F.when(m.contains("-"), F.try_to_date(m, "yyyy-MM-dd")).when(m.contains("."), F.try_to_date(m, "dd.MM.yyyy")).otherwise(
        F.coalesce(F.try_to_date(m, "MM/dd/yyyy"), F.try_to_date(m, "dd/MM/yyyy")))
    return day, notation


def kind_of(m: Column) -> Column:
    """Kind of a candidate, null if it is not valid."""
    d = _digits(m)
    payload = d.substr(F.lit(1), F.length(d) - 1)
    card = (F.length(d).between(13, 19)) & ~d.rlike(r"^(\d)\1*$") & (check_digit(payload) == d.substr(F.length(d), F.lit(1)).cast("int"))
    area, group, serial = _ssn_parts(m)
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d+(\.\d+){3}$"), F.when(F.greatest(*_octets(m)) <= 255, "ip"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), "ssn"))
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$"),
              F.when(F.date_diff(_date(m)[0], F.lit(FIRST_DAY).cast("date")).between(0, DAY_A * DAY_B - 1), "date"))
        .when(m.rlike(r"^\d{4}[ -]?\d{4}") & (F.length(d) >= 13), F.when(card, "card"))
        .when(F.length(d) >= 13, F.when(m.rlike(r"^\d{4}[ -]\d{6}|^\d+$"), F.when(card, "card")).otherwise(F.when(F.length(d) <= 15, "phone")))
        .otherwise(F.when(F.length(d).between(10, 15), "phone"))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The candidate ``m`` with its value permuted, or as it is where ``kind`` is null."""
    d = _digits(m)
    n = F.length(d) - 1
    b = F.pow(F.lit(10), F.floor(n / 2)).cast("long")
    payload = F.lpad(feistel(d.substr(F.lit(1), n).cast("long"), F.pow(F.lit(10), n - F.floor(n / 2)).cast("long"), b, key, "card").cast("string"), n, F.lit("0"))
    card = _refill(m, F.transform(F.array(payload), lambda p: F.concat(p, check_digit(p).cast("string")))[0])
    code = F.length(d) - 10
    national = F.lpad(feistel(d.substr(code + 1, F.lit(10)).cast("long"), 10**5, 10**5, key, "phone").cast("string"), 10, "0")
    phone = _refill(m, F.concat(d.substr(F.lit(1), code), national))
    o = _octets(m)
    address = feistel(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, key, "ip")
    ip = F.transform(F.array(address), lambda v: F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))[0]
    area, group, serial = _ssn_parts(m)
    number = ((area - F.when(area < 666, 1).otherwise(2)) * 99 + group - 1) * 9999 + serial - 1

    def ssn_text(v: Column) -> Column:
        at = F.floor(v / F.lit(99 * 9999)).cast("long")
        parts = ((at + F.when(at < 665, 1).otherwise(2), 3), (F.floor(v / F.lit(9999)).cast("long") % 99 + 1, 2), (v % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), w, "0") for x, w in parts])

    ssn = F.transform(F.array(feistel(number, 898 * 99, 9999, key, "ssn")), ssn_text)[0]
    day, notation = _date(m)
    first = F.lit(FIRST_DAY).cast("date")

    def day_of(v: Column) -> Column:
        return F.date_add(first, v.cast("int"))

    def walk(acc: Column, _: Column) -> Column:
        """Day-first slash dates have days over 12, and so do their pseudonyms: permuted on until one has."""
        again = acc["n"].isNull() | ((notation == "dd/MM/yyyy") & (F.dayofmonth(day_of(acc["n"])) <= 12))
        return F.when(again, F.struct(feistel(F.coalesce(acc["n"], acc["v"]), DAY_A, DAY_B, key, "date").alias("n"), acc["v"].alias("v"))).otherwise(acc)

    start = F.struct(F.lit(None).cast("long").alias("n"), F.date_diff(day, first).cast("long").alias("v"))
    moved = day_of(F.aggregate(F.sequence(F.lit(1), F.when(notation == "dd/MM/yyyy", 200).otherwise(1)), start, walk, lambda acc: acc["n"]))
    date = F.when(notation == "yyyy-MM-dd", F.date_format(moved, "yyyy-MM-dd")).when(notation == "dd.MM.yyyy", F.date_format(moved, "dd.MM.yyyy")).when(
        notation == "MM/dd/yyyy", F.date_format(moved, "MM/dd/yyyy")).otherwise(F.date_format(moved, "dd/MM/yyyy"))

    def digest(label: str, part: Column) -> Column:
        return F.substring(F.sha2(F.concat_ws("|", F.lit(subkey(key, label)), F.lower(part)), 256), 1, 16)

    email = F.concat(F.lit("u"), digest("user", m), F.lit("@d"), digest("domain", F.substring_index(m, "@", -1)), F.lit("."), F.substring_index(m, ".", -1))
    return F.when(kind.isNull(), m).when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "ssn", ssn).when(
        kind == "date", date).otherwise(phone)


def _same(kind: str):
    return lambda x: F.when(x == kind, x)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text's personal data replaced, plus the number found of each kind (n_email, n_card, ...)."""
    names = docs.columns
    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(f"`{text_col}`").alias("_text"))
    none = F.array().cast("array<string>")
    found = safe.withColumn("_m", F.when(F.col("_text").rlike(r"[0-9@]"), F.regexp_extract_all(F.col("_text"), F.lit(CANDIDATE), F.lit(0))).otherwise(none))
    found = found.withColumn("_kinds", F.transform("_m", kind_of))
    new = F.zip_with("_m", "_kinds", lambda m, k: pseudonym(m, k, key))
    pieces = F.split(F.col("_text"), CANDIDATE, -1)
    joined = F.array_join(F.zip_with(pieces, new, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    text = F.when(F.exists("_kinds", lambda k: k.isNotNull()), joined).otherwise(F.col("_text"))
    counts = [F.size(F.array_compact(F.transform("_kinds", _same(k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(*[(text if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)], *counts)
