"""Personal data replaced by format-preserving Feistel pseudonyms, with SQL functions only.

A validated value (a number whose check digits hold, a real date, an address in range) is
written as digits, each with its own modulus; two halves of these are permuted by a keyed
Feistel network, a digit-wise sum modulo each.  That is a permutation of all values of the
format: equal values get equal pseudonyms in every document, different ones stay
different, and check digits are made anew.  What fails validation is left alone.

====== ===========================================================================
email  letters and digits of the local part; the domain stays
secret the hexadecimal value after token, key, secret or password
iban   letters and digits of the account; check digits by modulo 97
date   the day, within 1900-2099; day first, else month first
ssn    all digits; invalid results are permuted again until one is valid
ip     the four octets
phone  the digits after the country code
card   the digits before the check digit; check digit by Luhn
====== ===========================================================================

Defined cases: a null text stays null with nothing found; an empty text stays empty; a text of any
length is treated whole; repeated rows are treated alike; an empty table gives an empty result;
a column ``pii`` of the input is replaced, all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS, WALKS = 8, 64
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
SECRET = r"(?<![A-Za-z])(?i:token|api[_-]?key|secret|password)[ ]{0,3}[=:][ ]{0,3}[\"']?[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
#: The whole length of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI NL", 19: "MK SI", 20: "AT BA EE LT LU", 21: "CH HR LI LV", 22: "BG DE GB GE IE ME RS", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN",
    25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ CY DO HU LB PL", 29: "BR PS QA", 31: "MT",
}


def _iban_pattern() -> str:
    """Countries at their own length, in fours or unbroken; others at any."""
    forms, known = [], "|".join(c for names in IBAN_LENGTHS.values() for c in names.split())
    for n, names in IBAN_LENGTHS.items():
        fours, rest = divmod(n - 4, 4)
        forms.append(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    forms.append(rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?")
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(forms)})(?![A-Za-z0-9])"


IBAN = _iban_pattern()
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/][0-9]{1,2}[/](?:19|20)[0-9]{2}|[0-9]{1,2}[.][0-9]{1,2}[.](?:19|20)[0-9]{2})(?![0-9/-]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])|(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ ]?|(?<=\+[0-9]{1,3}[ .-]?)[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
CARD = r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5})(?![0-9-])"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "date": DATE, "ssn": SSN, "ip": IP, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What every match has a part of: a text without it has none.
SIGN = r"[0-9@]|(?i:token|api[_-]?key|secret|password)"
#: Days of 1900-2099 are 17 x 4297.
FIRST_DAY, DAY_PARTS = "1900-01-01", (17, 4297)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _value(c: Column) -> Column:
    """0-9, a-z and A-Z as their place in their own alphabet; null for others."""
    at = F.ascii(c)
    return F.when(c.rlike("^[0-9]$"), at - 48).when(c.rlike("^[a-z]$"), at - 97).when(c.rlike("^[A-Z]$"), at - 65)


def _modulus(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), 10).otherwise(26)


def _letter(value: Column, like: Column) -> Column:
    return F.chr(value + F.when(like.rlike("^[0-9]$"), 48).when(like.rlike("^[a-z]$"), 97).otherwise(65))


def feistel(values: Column, moduli: Column, tweak: Column, key: Column) -> Column:
    """A keyed permutation of all ``values`` (ints) below ``moduli``; ``tweak`` tells formats apart."""
    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half
    start = F.struct(
        F.slice(values, 1, half).alias("a"), F.slice(moduli, 1, half).alias("am"), F.slice(values, half + 1, rest).alias("b"), F.slice(moduli, half + 1, rest).alias("bm")
    )

    def turn(state: Column, number: Column) -> Column:
        said = F.concat_ws(",", F.transform(state["b"], lambda v: v.cast("string")))
        stream = F.sha2(F.concat_ws("|", key, tweak, number.cast("string"), said), 512)

        def shifted(v: Column, i: Column) -> Column:
            more = F.conv(F.substr(stream, i % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return ((v + more) % F.get(state["am"], i)).cast("int")

        return F.struct(state["b"].alias("a"), state["bm"].alias("am"), F.transform(state["a"], shifted).alias("b"), state["am"].alias("bm"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _permute_marks(text: Column, kind: str, key: Column) -> Column:
    """``text`` with its letters and digits permuted and all else in place."""
    chars = _chars(text)
    marks = F.filter(chars, lambda c: _value(c).isNotNull())
    new = feistel(F.transform(marks, lambda c: _value(c).cast("int")), F.transform(marks, lambda c: _modulus(c).cast("int")), F.concat_ws(":", F.lit(kind), F.size(marks).cast("string")), key)
    places = F.filter(F.transform(chars, lambda c, i: F.when(_value(c).isNotNull(), i)), lambda i: i.isNotNull())
    return _with(chars, places, new, lambda v, c: _letter(v, c))


def _with(chars: Column, places: Column, new: Column, letter) -> Column:
    """``chars`` joined, those at ``places`` made of ``new`` in turn."""
    bound = F.array(F.struct(chars.alias("chars"), places.alias("places"), new.alias("new")))

    def build(s: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            at = F.array_position(s["places"], i).cast("int")
            return F.when(at > 0, letter(F.get(s["new"], at - 1), c)).otherwise(c)

        return F.array_join(F.transform(s["chars"], one), "")

    return F.get(F.transform(bound, build), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum's last digit when a check digit follows ``digits``; the check digit is 10 less it, modulo 10."""
    turned = _chars(F.reverse(digits))
    doubled = F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn(digits)) % 10).cast("string")


def _refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced by ``digits`` in turn."""
    chars = _chars(text)
    places = F.filter(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), i)), lambda i: i.isNotNull())
    return _with(chars, places, _chars(digits), lambda v, c: v)


def _card(m: Column, key: Column) -> Column:
    digits = _digits(m)
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    new = _permute_marks(payload, "card", key)
    return F.when(F.right(digits, F.lit(1)) == _check_digit(payload), _refill(m, F.concat(new, _check_digit(new))))


def _mod97(text: Column) -> Column:
    """Of letters and digits, letters as 10 to 35."""
    return F.aggregate(
        _chars(text), F.lit(0), lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    )


def _iban(m: Column, key: Column) -> Column:
    flat = F.regexp_replace(m, " ", "")
    land, account = F.substr(flat, F.lit(1), F.lit(2)), F.substr(flat, F.lit(5))
    valid = _mod97(F.concat(account, F.substr(flat, F.lit(1), F.lit(4)))) == 1
    body = _permute_marks(account, "iban", key)
    check = F.lpad((98 - _mod97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(land, check, body)
    chars = _chars(m)
    places = F.filter(F.transform(chars, lambda c, i: F.when(c != " ", i)), lambda i: i.isNotNull())
    return F.when(valid, _with(chars, places, _chars(whole), lambda v, c: v))


def _ssn_valid(digits: Column) -> Column:
    return ~digits.rlike("^(?:000|666|9)|^[0-9]{3}00|0000$")


def _ssn(m: Column, key: Column) -> Column:
    digits = _digits(m)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), _permute_marks(digits, "ssn", key), lambda s, _: F.when(_ssn_valid(s), s).otherwise(_permute_marks(s, "ssn", key))
    )
    return F.when(_ssn_valid(digits), _refill(m, walked))


def _ip(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    new = feistel(octets, F.array_repeat(F.lit(256), 4), F.lit("ip"), key)
    return F.when(F.forall(octets, lambda o: o < 256), F.array_join(F.transform(new, lambda o: o.cast("string")), "."))


def _phone(m: Column, key: Column) -> Column:
    country = F.regexp_extract(m, r"^(\+[0-9]{1,3}[ .-]?)?(.*)$", 1)
    return F.concat(country, _permute_marks(F.regexp_extract(m, r"^(\+[0-9]{1,3}[ .-]?)?(.*)$", 2), "phone", key))


def _email(m: Column, key: Column) -> Column:
    parts = F.split(m, "@")
    return F.concat_ws("@", _permute_marks(parts[0], "email", key), parts[1])


def _secret(m: Column, key: Column) -> Column:
    value = F.regexp_extract(m, "([0-9A-Fa-f]+)$", 1)
    hexes = F.transform(_chars(value), lambda c: F.conv(c, 16, 10).cast("int"))
    new = feistel(hexes, F.transform(hexes, lambda v: F.lit(16)), F.concat_ws(":", F.lit("secret"), F.size(hexes).cast("string")), key)
    text = F.array_join(F.transform(new, lambda v: F.hex(v.cast("long"))), "")
    lead = F.substr(m, F.lit(1), F.length(m) - F.length(value))
    return F.concat(lead, F.when(value == F.upper(value), text).otherwise(F.lower(text)))


def _date(m: Column, key: Column) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    part = F.transform(F.split(m, "[-/.]"), lambda p: p.cast("int"))
    sep = F.when(m.contains("/"), "/").otherwise(".")

    def day(year: Column, month: Column, of: Column) -> Column:
        return F.to_date(F.format_string("%04d-%02d-%02d", year, month, of), "yyyy-MM-dd")

    def valid(year: Column, month: Column, of: Column) -> Column:
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        return month.between(1, 12) & of.between(1, last)

    p0, p1, p2 = F.get(part, F.lit(0)), F.get(part, F.lit(1)), F.get(part, F.lit(2))
    read = (
        F.when(iso & valid(p0, p1, p2), F.struct(day(p0, p1, p2).alias("day"), F.lit("iso").alias("form")))
        .when(~iso & valid(p2, p1, p0), F.struct(day(p2, p1, p0).alias("day"), F.lit("dmy").alias("form")))
        .when(~iso & valid(p2, p0, p1), F.struct(day(p2, p0, p1).alias("day"), F.lit("mdy").alias("form")))
    )

    def moved(s: Column) -> Column:
        at = F.datediff(s["day"], F.lit(FIRST_DAY).cast("date"))
        new = feistel(F.array(F.floor(at / DAY_PARTS[1]).cast("int"), (at % DAY_PARTS[1]).cast("int")), F.array(*map(F.lit, DAY_PARTS)), F.lit("date"), key)
        to = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(new, F.lit(0)) * DAY_PARTS[1] + F.get(new, F.lit(1))).cast("int"))
        short = m.rlike("^[0-9][/.]|[/.][0-9][/.]")
        two = lambda c: F.when(short, c.cast("string")).otherwise(F.lpad(c.cast("string"), 2, "0"))
        dmy = F.concat(two(F.dayofmonth(to)), sep, two(F.month(to)), sep, F.year(to).cast("string"))
        mdy = F.concat(two(F.month(to)), sep, two(F.dayofmonth(to)), sep, F.year(to).cast("string"))
        return F.when(s["form"] == "iso", F.date_format(to, "yyyy-MM-dd")).when(s["form"] == "dmy", dmy).otherwise(mdy)

    bound = F.filter(F.array(read), lambda s: s.isNotNull())
    return F.get(F.transform(bound, moved), F.lit(0))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}


def _pseudonym(m: Column, key: Column) -> Column:
    """(kind, text) of a match; kind null and the match itself where it isn't valid."""
    out = None
    for kind, pattern in KINDS.items():
        made = MAKERS[kind](m, key)
        pair = F.struct(F.lit(kind).alias("kind"), made.alias("text"))
        fits = m.rlike(rf"\A(?:{pattern})\z")
        out = F.when(fits, pair) if out is None else out.when(fits, pair)
    found = F.array(out)
    return F.get(
        F.transform(found, lambda s: F.struct(F.when(s["text"].isNotNull(), s["kind"]).alias("kind"), F.coalesce(s["text"], m).alias("text"))), F.lit(0)
    )


def pseudonymise(docs: DataFrame, *, text_col: str = "text", key: str) -> DataFrame:
    """``docs`` with the text's personal data replaced, and ``pii`` (kind -> count) of what was.

    key: the secret under which values are permuted; with it they can be turned back.  It is the value of a one-row table, so plans, logs and
    Spark's UI show a column's name, never the key.
    """
    text = F.col(text_col)
    kept = docs.drop("pii")
    found, secret = fresh(kept, "pii__found", "pii__key")
    kept = kept.crossJoin(F.broadcast(docs.sparkSession.createDataFrame([(key,)], f"{secret} string")))  # one row
    matches = F.when(text.rlike(SIGN), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    staged = kept.withColumn(found, F.transform(matches, lambda m: _pseudonym(m, F.col(secret))))
    between = F.split(text, ANY, -1)
    joined = F.zip_with(between, found, lambda gap, s: F.concat(gap, F.coalesce(s["text"], F.lit(""))))
    staged = staged.withColumn(text_col, F.when(F.size(found) > 0, F.array_join(joined, "")).otherwise(text))
    kinds = F.filter(F.transform(found, lambda s: s["kind"]), lambda k: k.isNotNull())
    count = F.map_from_entries(F.transform(F.array_distinct(kinds), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)))))
    return staged.withColumn("pii", F.coalesce(count, F.create_map().cast("map<string,int>"))).drop(found, secret)
