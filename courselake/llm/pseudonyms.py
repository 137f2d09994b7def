"""Format-preserving pseudonyms: validated numbers and dates under a keyed Feistel permutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
ADDRESS = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
DATE = (
    r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})"
    r"(?![0-9A-Za-z]|[/.-][0-9])"
)
PERSON = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
CARD = (
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
    r"(?![0-9A-Za-z])"
)
CANDIDATE = "|".join((EMAIL, PHONE, ADDRESS, DATE, PERSON, CARD))


def feistel(hi: Column, lo: Column, hi_size: Column | int, lo_size: Column | int, tag: Column, key: str) -> Column:
    """struct(a, b): a keyed permutation of the pairs with 0 <= a < hi_size, 0 <= b < lo_size.

    Unbalanced Feistel network: in turn, each half gets a keyed digest of the other added to it,
    modulo its own size. Subtracting in reverse order undoes it.
    """
    hi_size, lo_size = (x if isinstance(x, Column) else F.lit(x) for x in (hi_size, lo_size))

    def mix(number: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tag, number.cast("string"), other.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")

    def turn(acc: Column, r: Column) -> Column:
        a, b = acc["a"], acc["b"]
        even = r % 2 == 0
        return F.struct(
            F.when(even, (a + mix(r, b)) % hi_size.cast("long")).otherwise(a).alias("a"),
            F.when(even, b).otherwise((b + mix(r, a)) % lo_size.cast("long")).alias("b"),
        )

    start = F.struct(hi.cast("long").alias("a"), lo.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _number(digits: Column, start: Column | int, length: Column | int) -> Column:
    start, length = (x if isinstance(x, Column) else F.lit(x) for x in (start, length))
    return F.substring(digits, start, length).cast("long")


def _padded(number: Column, length: Column | int) -> Column:
    length = length if isinstance(length, Column) else F.lit(length)
    return F.lpad(number.cast("string"), length, F.lit("0"))


def _power(n: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), n)).cast("long")


def _permuted_digits(digits: Column, tag: str, key: str) -> Column:
    """The whole digit string under the permutation of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    pair = feistel(
        _number(digits, 1, half), _number(digits, half + 1, n - half), _power(half), _power(n - half),
        F.concat(F.lit(tag), n.cast("string")), key,
    )
    return F.concat(_padded(pair["a"], half), _padded(pair["b"], n - half))


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum modulo 10 of a digit string, its last digit not doubled."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, d).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10


def _card(digits: Column, key: str) -> Column:
    """First digit kept, the others permuted, the check digit made new."""
    payload = F.concat(
        F.substring(digits, F.lit(1), F.lit(1)),
        _permuted_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), "card", key),
    )
    check = (10 - luhn_sum(F.concat(payload, F.lit("0")))) % 10
    return F.concat(payload, check.cast("string"))


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    spots = F.split(shape, "")

    def fill(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["text"], F.when(digit, F.substring(digits, acc["at"], F.lit(1))).otherwise(c)).alias("text"),
            (acc["at"] + digit.cast("int")).alias("at"),
        )

    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    return F.aggregate(spots, start, fill, lambda acc: acc["text"])


def _phone(found: Column, key: str) -> Column:
    """The last ten digits permuted. With country code 1, numbers with area and exchange from 200 are
    permuted among themselves, and so are the others, so that no two numbers share a pseudonym."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    code, ten = F.substring(digits, F.lit(1), n - 10), F.substring(digits, n - 9, F.lit(10))
    area, rest = _number(ten, 1, 3), _number(ten, 4, 7)
    pair = feistel(area - 200, rest - 2_000_000, 800, 8_000_000, F.lit("phone"), key)
    american = F.concat((pair["a"] + 200).cast("string"), (pair["b"] + 2_000_000).cast("string"))
    fits = (code == "1") & (area >= 200) & (rest >= 2_000_000)
    # the other numbers with code 1: 200 areas of ten million, then 800 areas of two million
    rank = F.when(area < 200, area * 10_000_000 + rest).otherwise(2_000_000_000 + (area - 200) * 2_000_000 + rest)
    odd = feistel(F.floor(rank / 60_000).cast("long"), rank % 60_000, 60_000, 60_000, F.lit("other"), key)

    def spelled(pair: Column) -> Column:
        at = pair["a"] * 60_000 + pair["b"]
        above = at - 2_000_000_000
        first = F.when(above < 0, F.floor(at / 10_000_000)).otherwise(200 + F.floor(above / 2_000_000))
        last = F.when(above < 0, at % 10_000_000).otherwise(F.pmod(above, F.lit(2_000_000)))
        return F.concat(_padded(first.cast("long"), F.lit(3)), _padded(last, F.lit(7)))

    other = F.transform(F.array(odd), spelled)[0]  # the pair is computed once
    new = F.when(fits, american).when(code == "1", other).otherwise(_permuted_digits(ten, "line", key))
    return _refilled(found, F.concat(code, new))


def _address(found: Column, key: str) -> Column:
    part = F.transform(F.split(found, r"\."), lambda x: x.cast("int"))
    pair = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536, F.lit("address"), key)
    return F.concat_ws(
        ".", *(x.cast("int").cast("string") for x in (
            F.floor(pair["a"] / 256), pair["a"] % 256, F.floor(pair["b"] / 256), pair["b"] % 256
        ))
    )


def _person(found: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group from 01, serial from 0001."""
    area, group, serial = (F.split_part(found, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    pair = feistel(
        area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, F.lit("person"), key
    )
    new = pair["a"] + 1 + (pair["a"] >= 665).cast("long")
    return F.concat_ws(
        "-", _padded(new, 3), _padded(F.floor(pair["b"] / 9999) + 1, 2), _padded(pair["b"] % 9999 + 1, 4)
    )


FORMATS = (("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{2}/", "MM/dd/yyyy"), (r"^[0-9]{2}\.", "dd.MM.yyyy"))


def _day(found: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(found, F.lit(form)).cast("date"), F.lit("1800-01-01").cast("date"))


def _date(found: Column, form: str, key: str) -> Column:
    """The day moved within the 400 years from 1800, which have 189 x 773 days."""
    day = _day(found, form)
    pair = feistel(F.floor(day / 773), day % 773, 189, 773, F.lit("day"), key)
    new = F.date_add(F.lit("1800-01-01").cast("date"), (pair["a"] * 773 + pair["b"]).cast("int"))
    return F.date_format(new, form)


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of a candidate, or null if it isn't valid in its format.

    Card numbers must pass Luhn's check, addresses have parts to 255, dates exist, person numbers
    use assigned ranges. An e-mail address is no number: it gets a keyed digest of its lower-case form.
    """
    digits = F.regexp_replace(found, "[^0-9]", "")
    octets = F.forall(F.split(found, r"\."), lambda x: x.cast("int") <= 255)
    area = F.substring(found, 1, 3)
    assigned = (
        ~area.isin("000", "666") & (area < "900") & (F.substring(found, 5, 2) != "00") & (F.substring(found, 8, 4) != "0000")
    )
    mail = F.concat(
        F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(found)), 256), 1, 14),
        F.lit("@mail.invalid"),
    )
    out = F.when(F.contains(found, F.lit("@")), mail).when(found.startswith("+"), _phone(found, key))
    out = out.when(found.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(octets, _address(found, key)))
    for shape, form in FORMATS:
        length = found.rlike(shape) & (F.length(found) == 10) & (F.length(digits) == 8)
        known = F.coalesce(_day(found, form).between(0, 146096), F.lit(False))
        out = out.when(length, F.when(known, _date(found, form, key)))
    out = out.when(found.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(assigned, _person(found, key)))
    return out.otherwise(F.when(luhn_sum(digits) == 0, _refilled(found, _card(digits, key))))


def pseudonymised(docs: DataFrame, key: str = "courselake") -> DataFrame:
    """``docs`` with its text pseudonymised, and ``n_replaced``.

    Every valid number, date and address found in the whole text is replaced in place by its
    pseudonym under ``key``; equal values get equal pseudonyms in every document, different ones
    of a format different pseudonyms. What isn't valid is left alone. A null text stays null with
    0 replacements. Rows stand for themselves; other columns are kept, an n_replaced column is
    replaced. An empty table gives no rows.
    """
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    gaps = F.split("text", CANDIDATE, -1)
    joined = F.zip_with(
        F.concat(F.array(F.lit("")), F.transform("_all", lambda m: F.coalesce(m["new"], m["old"]))), gaps,
        lambda m, g: F.concat(m, g),
    )
    return (
        docs.drop("n_replaced")
        .withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
        .withColumn(
            "_all", F.transform("_found", lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
        )
        .withColumn("text", F.when(F.size("_found") == 0, F.col("text")).otherwise(F.concat_ws("", joined)))
        .withColumn("n_replaced", F.size(F.filter("_all", lambda m: m["new"].isNotNull())))
        .drop("_found", "_all")
    )
