"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Candidates come from one regular expression.  A candidate counts only if it is valid for its kind:
card numbers by the Luhn digit, IBANs by their remainder modulo 97, social security numbers, IP
addresses and dates by their ranges.  Each valid value is written as a tuple of symbols, every
one with its radix (ten for a digit, 256 for a part of an address, 189 and 773 for the days of 400
years, ...), and permuted by a keyed Feistel network over the two halves of the tuple: each
symbol of a half moves by a hash of the key, the round, its place and the other half, modulo its
radix.  So the result has the same format, check digits are computed anew, equal values get equal
pseudonyms in every document however they are spaced, and whoever has the key can go back.

Rows are worked on one by one: no shuffle, no lookup table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsflow.llm.common import let

ROUNDS = 8  # even, so that the halves end in their places
EPOCH = "1700-01-01"
DAYS = (189, 773)  # 189 * 773 days are the 400 years from EPOCH
KINDS = ("email", "secret", "iban", "ip", "phone", "ssn", "card", "date")

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
_SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])"
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])"
_IP = r"(?<![0-9.])(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})(?![0-9]|\.[0-9])"
_PHONE = (r"(?:\+1[ .-]?|(?<![0-9]))\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{8,15}(?![0-9])|"
          r"(?:\+1[ .-]|(?<![0-9.-]))[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])")
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
_CARD = (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|"
         r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])")
_DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
CANDIDATE = "|".join((_EMAIL, _SECRET, _IBAN, _IP, _PHONE, _SSN, _CARD, _DATE))


def _ints(text: Column, pattern: str = "[0-9]+") -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: x.cast("int"))


def feistel(values: Column, radixes: Column, kind: str, key: str, back: bool = False) -> Column:
    """Keyed permutation of tuples of symbols, ``0 <= values[i] < radixes[i]``; ``back`` inverts it."""
    def move(half: Column, other: Column, radix: Column, r: Column) -> Column:
        said = F.concat_ws(",", F.lit(key), F.lit(kind), r.cast("string"), F.concat_ws(".", F.transform(other, lambda x: x.cast("string"))))

        def one(x: Column, j: Column) -> Column:
            draw = F.conv(F.substring(F.sha2(F.encode(F.concat_ws(",", said, j.cast("string")), "UTF-8"), 256), 1, 13), 16, 10).cast("long")
            shift = F.pmod(draw, F.get(radix, j))
            return F.pmod(x - shift if back else x + shift, F.get(radix, j)).cast("int")
        return F.transform(half, one)

    def turn(s: Column, r: Column) -> Column:
        if back:  # the round's output (a, b) came from (left, right) = (unmoved b, a)
            return F.struct(move(s["b"], s["a"], s["rb"], r).alias("a"), s["a"].alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))
        return F.struct(s["b"].alias("a"), move(s["a"], s["b"], s["ra"], r).alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))

    def split(x: Column) -> Column:
        v, r = x["v"], x["r"]
        half = F.floor(F.size(v) / 2).cast("int")
        rest = F.size(v) - half
        return F.struct(F.slice(v, F.lit(1), half).alias("a"), F.slice(v, half + 1, rest).alias("b"),
                        F.slice(r, F.lit(1), half).alias("ra"), F.slice(r, half + 1, rest).alias("rb"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(ROUNDS))
    start = let(F.struct(values.alias("v"), radixes.alias("r")), split)
    return F.aggregate(rounds, start, turn, lambda s: F.concat(s["a"], s["b"]))


def _symbols(text: Column, hexadecimal: bool = False) -> Column:
    """(value, radix) of each letter and digit of an ASCII text."""
    def one(c: Column) -> Column:
        code = F.ascii(c)
        if hexadecimal:
            return F.struct(F.conv(c, 16, 10).cast("int").alias("v"), F.lit(16).alias("r"))
        return (F.when(code < 58, F.struct((code - 48).alias("v"), F.lit(10).alias("r")))
                .when(code < 91, F.struct((code - 65).alias("v"), F.lit(26).alias("r")))
                .otherwise(F.struct((code - 97).alias("v"), F.lit(26).alias("r"))))
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9A-Za-z]"), 0), one)


def _refill(mask: Column, values: Column, hexadecimal: bool = False) -> Column:
    """``mask`` with its letters and digits replaced, in order, by symbols of the same class."""
    def put(a: Column, c: Column) -> Column:
        v, code = F.get(values, a["i"]), F.ascii(c)
        new = F.lower(F.hex(v)) if hexadecimal else F.char(v + F.when(code < 58, 48).when(code < 91, 65).otherwise(97))
        return F.when(c.rlike("^[0-9A-Za-z]$"), F.struct(F.concat(a["s"], new).alias("s"), (a["i"] + 1).alias("i"))).otherwise(
            F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i")))
    return F.aggregate(F.regexp_extract_all(mask, F.lit("(?s)."), 0), F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), put, lambda a: a["s"])


def _permuted(text: Column, kind: str, key: str, back: bool, hexadecimal: bool = False) -> Column:
    def go(s: Column) -> Column:
        return _refill(text, feistel(F.transform(s, lambda x: x["v"]), F.transform(s, lambda x: x["r"]), kind, key, back), hexadecimal)
    return let(_symbols(text, hexadecimal), go)


def _luhn(digits: Column) -> Column:
    """Luhn sum, the last digit counted once."""
    n = F.size(digits)
    weighted = F.transform(digits, lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(weighted, F.lit(0), lambda a, d: a + d)


def _card(m: Column, key: str, back: bool) -> Column:
    body = _permuted(F.substring(m, F.lit(1), F.length(m) - 1), "card", key, back)
    return let(body, lambda b: F.concat(b, F.pmod(-_luhn(F.concat(_ints(b, "[0-9]"), F.array(F.lit(0)))), F.lit(10)).cast("string")))


def _mod97(iban: Column) -> Column:
    """Remainder of an IBAN (no blanks) with its first four characters moved to the end."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    codes = F.transform(F.regexp_extract_all(turned, F.lit("."), 0), lambda c: F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0), lambda a, v: F.pmod(a * F.when(v < 10, 10).otherwise(100) + v, F.lit(97)))


def _iban(m: Column, key: str, back: bool) -> Column:
    body = _permuted(F.substring(m, F.lit(5), F.length(m)), "iban", key, back)
    country = F.substring(m, 1, 2)

    def checked(b: Column) -> Column:
        check = F.lit(98) - _mod97(F.concat(country, F.lit("00"), F.regexp_replace(b, " ", "")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b)
    return let(body, checked)


def _dates(m: Column) -> Column:
    """(year, month, day, order) of a date that exists within the 400 years, else null.  A date with
    slashes is month first, else day first; with points day first."""
    def exists(y: Column, mo: Column, d: Column) -> Column:
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        last = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
        return y.between(1700, 2099) & mo.between(1, 12) & (d >= 1) & (d <= last)

    def pick(p: Column) -> Column:
        a, b, c = (F.get(p, F.lit(i)) for i in range(3))
        order = (F.when(m.rlike("^[0-9]{4}-"), F.when(exists(a, b, c), "ymd"))
                 .when(m.contains("/") & exists(c, a, b), "mdy").when(exists(c, b, a), "dmy"))
        return let(order, lambda o: F.when(o == "ymd", F.struct(a.alias("y"), b.alias("m"), c.alias("d"), o.alias("o")))
                   .when(o == "mdy", F.struct(c.alias("y"), a.alias("m"), b.alias("d"), o.alias("o")))
                   .when(o == "dmy", F.struct(c.alias("y"), b.alias("m"), a.alias("d"), o.alias("o"))))
    return let(_ints(m), pick)


def _date(m: Column, key: str, back: bool) -> Column:
    def go(x: Column) -> Column:
        day = F.datediff(F.make_date(x["y"], x["m"], x["d"]), F.lit(EPOCH).cast("date"))
        pair = F.array(F.floor(day / DAYS[1]).cast("int"), (day % DAYS[1]).cast("int"))
        moved = feistel(pair, F.array(F.lit(DAYS[0]), F.lit(DAYS[1])), "date", key, back)
        new = let(moved, lambda v: F.date_add(F.lit(EPOCH).cast("date"), F.get(v, F.lit(0)) * DAYS[1] + F.get(v, F.lit(1))))
        sep = F.when(m.contains("/"), "/").otherwise(".")
        return let(new, lambda n: F.when(x["o"] == "ymd", F.date_format(n, "yyyy-MM-dd"))
                   .when(x["o"] == "mdy", F.date_format(n, "MM/dd/yyyy"))
                   .otherwise(F.concat(F.date_format(n, "dd"), sep, F.date_format(n, "MM"), sep, F.date_format(n, "yyyy"))))
    return let(_dates(m), go)


def _ssn_rank(p: Column) -> Column:
    area = F.get(p, F.lit(0))
    return F.array(F.when(area > 666, area - 2).otherwise(area - 1), F.get(p, F.lit(1)) - 1, F.get(p, F.lit(2)) - 1)


def _ssn(m: Column, key: str, back: bool) -> Column:
    def write(v: Column) -> Column:
        area = F.get(v, F.lit(0)) + 1
        parts = (F.when(area >= 666, area + 1).otherwise(area), F.get(v, F.lit(1)) + 1, F.get(v, F.lit(2)) + 1)
        return F.concat_ws("-", *(F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4), strict=True)))
    return let(feistel(let(_ints(m), _ssn_rank), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key, back), write)


def kind_of(m: Column) -> Column:
    """Kind of a candidate, null if it is not valid."""
    def is_(pattern: str) -> Column:
        return m.rlike(f"^(?:{pattern})$")
    octets = F.forall(_ints(m), lambda x: x < 256)
    ssn = let(_ints(m), lambda p: (F.get(p, F.lit(0)) > 0) & (F.get(p, F.lit(0)) < 900) & (F.get(p, F.lit(0)) != 666)
              & (F.get(p, F.lit(1)) > 0) & (F.get(p, F.lit(2)) > 0))
    iban = F.regexp_replace(m, " ", "")
    return (F.when(m.contains("@"), "email").when(is_(_SECRET), "secret")
            .when(is_(_IP), F.when(octets, "ip"))
            .when(is_(_SSN), F.when(ssn, "ssn"))
            .when(is_(_CARD), F.when(F.pmod(_luhn(_ints(m, "[0-9]")), F.lit(10)) == 0, "card"))
            .when(is_(_DATE), F.when(_dates(m).isNotNull(), "date"))
            .when(is_(_IBAN), F.when((F.length(iban) >= 15) & (_mod97(iban) == 1), "iban"))
            .otherwise("phone"))


def pseudonym(m: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of a valid value; with ``back``, the value of a pseudonym."""
    local, domain = F.regexp_extract(m, "^[^@]*", 0), F.regexp_extract(m, "@.*$", 0)
    country = F.regexp_extract(m, r"^\+[0-9]", 0)
    ip = let(_ints(m), lambda p: F.concat_ws(".", F.transform(
        feistel(p, F.array_repeat(F.lit(256), 4), "ip", key, back), lambda x: x.cast("string"))))
    return (F.when(kind == "email", F.concat(_permuted(local, "email", key, back), domain))
            .when(kind == "secret", _permuted(m, "secret", key, back, hexadecimal=True))
            .when(kind == "ip", ip).when(kind == "ssn", _ssn(m, key, back)).when(kind == "card", _card(m, key, back))
            .when(kind == "date", _date(m, key, back)).when(kind == "iban", _iban(m, key, back))
            .when(kind == "phone", F.concat(country, _permuted(F.regexp_replace(m, r"^\+[0-9]", ""), "phone", key, back))))


def pseudonymise(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """``(doc_id, text, n_email, ..., n_date)`` per row: the text with pseudonyms, and how many values
    of each kind it held.

    A null text stays null and counts nothing; a text without personal data stays as it is.
    Rows are independent: repeated rows, null ids and very long texts need no care.  ``back``
    restores the texts, but for dates like 31/12/1999: their pseudonym may read month first, and
    the padding of one-digit days and months is not restored.
    """
    body = F.col("t")
    found = F.transform(F.regexp_extract_all(body, F.lit(CANDIDATE), 0),
                        lambda m: let(kind_of(m), lambda k: F.struct(k.alias("k"), F.coalesce(pseudonym(m, k, key, back), m).alias("new"))))

    def of(kind: str):
        return lambda x: x["k"] == kind

    def write(f: Column) -> Column:
        ends = F.concat(F.transform(f, lambda x: x["new"]), F.array(F.lit("")))
        whole = F.concat_ws("", F.zip_with(F.split(body, CANDIDATE, -1), ends, lambda a, b: F.concat(a, b)))
        return F.struct(F.when(F.size(f) == 0, body).otherwise(whole).alias("text"),
                        *(F.size(F.filter(f, of(k))).cast("long").alias(f"n_{k}") for k in KINDS))

    got = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).select("id", "t", let(found, write).alias("x"))
    return got.select(F.col("id").alias(doc_id), F.when(body.isNotNull(), F.col("x.text")).alias(text),
                      *(F.coalesce(F.col(f"x.n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS))
