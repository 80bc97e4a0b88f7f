"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

A value found in a text and validated is read as a list of places with a radix each (the ten digits, the days of 400 years, ...). A keyed
Feistel network permutes that list: in turn one half of the places is shifted, place by place, by a hash of the other half. The result
has the same format, the same check digits rule, and equal values get equal pseudonyms in every document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of the network, and the key of the registered query. A production run passes its own secret.
ROUNDS = 8
KEY = "registered-query-key"

# The formats looked for, as patterns.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
ISO_DATE = r"(?<![\d/-])\d{4}-\d{2}-\d{2}(?![\d/-])"
DAY_DATE = r"(?<![\d./-])\d{2}([./])\d{2}\1\d{4}(?![\d/-])"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!-?\d)"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d.-])\d{3}\.\d{3}\.\d{4}(?![\d-])(?!\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"

# The digits of cards as they are set in groups, and the lengths of IBANs. Longest first.
CARD_SHAPES = (r"\d{4}([ -])\d{4}\2\d{4}\2\d{4}\2\d{3}", r"\d{4}([ -])\d{4}\2\d{4}\2\d{4}", r"\d{4}([ -])\d{6}\2\d{5}", r"\d{4}([ -])\d{6}\2\d{4}", r"\d{13,19}")
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
                23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
                29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}

#: In order of precedence.
FORMATS = {"email": EMAIL, "iban": IBAN, "ip": IP, "iso_date": ISO_DATE, "day_date": DAY_DATE, "ssn": SSN, "phone": PHONE, "card": CARD, "secret": SECRET}
#: Days move within their 400 years, 189 * 773 of them, of which 24 spans begin here; the days of the calendar before and after, the first
#: of which is here and which are EARLY at the beginning, are 93 * 1567.
FIRST_DAY, SPANS, DAYS = "0200-01-01", 24, (189, 773)
CALENDAR, EARLY, OUTER_DAYS = "0001-01-01", 72_683, (93, 1567)
#: Numbers of the areas of a social security number: 1 to 899 without 666.
AREAS, LEFT_OUT = 898, 666


def _any_format() -> str:
    return "|".join(FORMATS.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def feistel(values: Column, radices: Column, key: str | Column, rounds: int = ROUNDS) -> Column:
    """The permuted values: arrays of integers, each below its radix. At most 64 places in either half."""

    def network(v: Column, r: Column) -> Column:
        places = F.size(v)
        half = F.ceil(places / 2).cast("int")
        start = F.struct(F.slice(v, 1, half).alias("a"), F.slice(v, half + 1, places - half).alias("b"))
        shape = F.struct(
            F.slice(r, 1, half).alias("a"), F.slice(r, half + 1, places - half).alias("b"), F.array_join(r.cast("array<string>"), ".").alias("all"))
        return let(shape, lambda w: F.aggregate(
            F.sequence(F.lit(0), F.lit(rounds - 1)), start, lambda state, turn: turned(state, turn, w), lambda s: F.concat(s["a"], s["b"])))

    def shifted(own: Column, radix: Column, other: Column, turn: Column, shape: Column) -> Column:
        seed = F.concat_ws(",", F.lit(key), turn.cast("string"), shape, F.array_join(other.cast("array<string>"), "."))
        stream = let(seed, lambda s: F.concat(F.sha2(s.cast("binary"), 512), F.sha2(F.concat(s, F.lit("+")).cast("binary"), 512)))
        return let(stream, lambda bits: F.zip_with(
            F.transform(own, lambda x, i: x + F.conv(F.substring(bits, 1 + 4 * i, 4), 16, 10).cast("int")), radix, lambda x, r: F.pmod(x, r).cast("int")))

    def turned(state: Column, turn: Column, w: Column) -> Column:
        even = turn % 2 == 0
        return F.struct(
            F.when(even, shifted(state["a"], w["a"], state["b"], turn, w["all"])).otherwise(state["a"]).alias("a"),
            F.when(~even, shifted(state["b"], w["b"], state["a"], turn, w["all"])).otherwise(state["b"]).alias("b"))

    return let(F.struct(values.alias("v"), radices.alias("r")), lambda x: network(x["v"], x["r"]))


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, r"\D", "")), lambda c: c.cast("int"))


def _constant(values: Column, radix: int) -> Column:
    return F.transform(values, lambda _: F.lit(radix))


def _poured(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by digits in order."""
    return let(digits, lambda d: F.aggregate(
        _chars(shape), F.struct(F.lit("").alias("t"), F.lit(1).alias("n")),
        lambda s, c: F.when(c.rlike(r"\d"), F.struct(F.concat(s["t"], F.get(d, s["n"] - 1).cast("string")).alias("t"), (s["n"] + 1).alias("n")))
        .otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["n"].alias("n"))), lambda s: s["t"]))


def _luhn(digits: Column) -> Column:
    """The sum of Luhn's rule; a number is valid where it is a multiple of 10."""
    size = F.size(digits)
    return F.aggregate(F.transform(digits, lambda d, i: F.when((size - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)), F.lit(0), lambda a, d: a + d)


def _card(m: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        payload = F.slice(digits, 1, F.size(digits) - 1)
        full = let(feistel(payload, _constant(payload, 10), key + "card"), lambda moved: F.concat(
            moved, F.array(F.pmod(-_luhn(F.concat(moved, F.array(F.lit(0)))), F.lit(10)).cast("int"))))
        return F.when((_luhn(digits) % 10 == 0) & m.rlike("[1-9]"), _poured(m, full))

    return let(_digits(m), made)


def _phone(m: Column, key: str) -> Column:
    """A country code stays; of ten digits behind it, area and exchange begin with 2 to 9."""

    def made(x: Column) -> Column:
        own, code = x["own"], x["code"]
        american = (F.size(own) == 10) & (F.get(own, F.lit(0)) >= 2) & (F.get(own, F.lit(3)) >= 2)
        low = F.transform(own, lambda _, i: F.when(american & i.isin(0, 3), 2).otherwise(0))
        return let(low, lambda low_: let(
            feistel(F.zip_with(own, low_, lambda d, a: d - a), F.transform(low_, lambda a: 10 - a), key + "phone"),
            lambda moved: _poured(m, F.concat(code, F.zip_with(moved, low_, lambda d, a: d + a)))))

    def parted(digits: Column) -> Column:
        size = F.size(digits)
        code = F.when(m.startswith("+"), F.greatest(F.lit(1), size - 10)).otherwise(0)
        return F.when(size.between(7, 15), let(F.struct(F.slice(digits, 1, code).alias("code"), F.slice(digits, code + 1, size - code).alias("own")), made))

    return let(_digits(m), parted)


def _ssn(m: Column, key: str) -> Column:
    """Area, group and serial number permuted among the valid ones."""
    valid = ~m.rlike(r"^(000|666|9)|-00-|-0000$")
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    values = F.array(F.when(area < LEFT_OUT, area - 1).otherwise(area - 2), group - 1, serial - 1)
    moved = feistel(values, F.array(F.lit(AREAS), F.lit(99), F.lit(9999)), key + "ssn")

    def written(v: Column) -> Column:
        first = F.get(v, F.lit(0))
        parts = ((F.when(first < LEFT_OUT - 1, first + 1).otherwise(first + 2), 3), (F.get(v, F.lit(1)) + 1, 2), (F.get(v, F.lit(2)) + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(valid, let(moved, written))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("int"))
    return let(octets, lambda o: F.when(
        F.forall(o, lambda x: x < 256), F.array_join(feistel(o, _constant(o, 256), key + "ip").cast("array<string>"), ".")))


def _moved_day(day: Column, key: str) -> Column:
    """Another day of the same 400 years; one before 0200 or after 9799, another of these."""
    span = DAYS[0] * DAYS[1]

    def moved(n: Column, radices: tuple[int, int], name: str) -> Column:
        values = F.array((n / radices[1]).cast("int"), F.pmod(n, F.lit(radices[1])).cast("int"))
        found = feistel(values, F.array(F.lit(radices[0]), F.lit(radices[1])), key + name)
        return let(found, lambda v: F.get(v, F.lit(0)) * radices[1] + F.get(v, F.lit(1)))

    def made(n: Column) -> Column:
        inner = F.date_add(F.lit(FIRST_DAY).cast("date"), moved(F.pmod(n, F.lit(span)), DAYS, "day") + F.floor(n / span).cast("int") * span)
        at = n + EARLY
        outer = let(moved(F.when(at < EARLY, at).otherwise(at - SPANS * span), OUTER_DAYS, "outer"),
                    lambda v: F.date_add(F.lit(CALENDAR).cast("date"), F.when(v < EARLY, v).otherwise(v + SPANS * span)))
        return F.when(n.between(0, SPANS * span - 1), inner).otherwise(outer)

    calendar = F.when(F.year(day).between(1, 9999), day)
    return let(F.datediff(calendar, F.lit(FIRST_DAY).cast("date")), made)


def _iso_date(m: Column, key: str) -> Column:
    return _moved_day(m.try_cast("date"), key).cast("string")


def _day_date(m: Column, key: str) -> Column:
    """Day before month; where only the other reading is a date, month before day."""
    first, second, year, mark = F.substring(m, 1, 2), F.substring(m, 4, 2), F.substring(m, 7, 4), F.substring(m, 3, 1)
    by_day = F.concat_ws("-", year, second, first).try_cast("date")
    by_month = F.concat_ws("-", year, first, second).try_cast("date")

    def shaped(day: Column, a: str, b: str) -> Column:
        return let(_moved_day(day, key), lambda d: F.concat(F.date_format(d, a), mark, F.date_format(d, b), mark, F.date_format(d, "yyyy")))

    return F.when(by_day.isNotNull(), shaped(by_day, "dd", "MM")).when(by_month.isNotNull(), shaped(by_month, "MM", "dd"))


def _lettered(m: Column, key: str | Column) -> Column:
    """Letters permuted among letters of their case and digits among digits; other characters stay."""
    kinds = F.transform(_chars(m), lambda c: F.when(c.rlike("[0-9]"), F.struct(F.lit(48).alias("low"), F.lit(10).alias("radix"), F.ascii(c).alias("code")))
                        .when(c.rlike("[a-z]"), F.struct(F.lit(97).alias("low"), F.lit(26).alias("radix"), F.ascii(c).alias("code")))
                        .when(c.rlike("[A-Z]"), F.struct(F.lit(65).alias("low"), F.lit(26).alias("radix"), F.ascii(c).alias("code")))
                        .otherwise(F.struct(F.ascii(c).alias("low"), F.lit(1).alias("radix"), F.ascii(c).alias("code"))))
    return let(kinds, lambda ks: F.array_join(F.zip_with(
        ks, feistel(F.transform(ks, lambda k: k["code"] - k["low"]), F.transform(ks, lambda k: k["radix"]), key), lambda k, v: F.char(k["low"] + v)), ""))


def _email(m: Column, key: str) -> Column:
    # Beyond the places of a network the rest of the local part is permuted by itself, in as many pieces as it has.
    def moved(local: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(local) - 1) / 64).cast("int")))
        name = lambda n: F.when(n == 0, key + "email").when(n == 1, key + "rest").otherwise(F.concat(F.lit(key + "rest"), n.cast("string")))
        return F.array_join(F.transform(numbers, lambda n: _lettered(F.substring(local, 64 * n + 1, F.lit(64)), name(n))), "")

    return F.concat(let(F.substring_index(m, "@", 1), moved), F.lit("@"), F.substring_index(m, "@", -1))


def _mod97(text: Column) -> Column:
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _iban(m: Column, key: str) -> Column:
    def made(plain: Column) -> Column:
        country, rest = F.substring(plain, 1, 2), F.substring(plain, 5, 40)
        full = let(_lettered(rest, key + "iban"), lambda moved: F.concat(
            country, F.lpad((98 - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0"), moved))
        spaced = let(_chars(full), lambda chars: F.aggregate(_chars(m), F.struct(F.lit("").alias("t"), F.lit(1).alias("n")), lambda s, c: F.when(
            c == " ", F.struct(F.concat(s["t"], F.lit(" ")).alias("t"), s["n"].alias("n"))).otherwise(
            F.struct(F.concat(s["t"], F.get(chars, s["n"] - 1)).alias("t"), (s["n"] + 1).alias("n"))), lambda s: s["t"]))
        return F.when(_mod97(F.concat(rest, country, F.substring(plain, 3, 2))) == 1, spaced)

    return let(F.regexp_replace(m, " ", ""), made)


def _secret(m: Column, key: str) -> Column:
    """Hexadecimal digits permuted in pieces of 64, in the letters' own case."""
    def piece(n: Column) -> Column:
        codes = F.transform(_chars(F.substring(m, 64 * n + 1, F.lit(64))), lambda c: F.conv(c, 16, 10).cast("int"))
        name = F.when(n == 0, key + "secret").otherwise(F.concat(F.lit(key + "secret"), n.cast("string")))
        moved = let(codes, lambda v: feistel(v, _constant(v, 16), name))
        return F.array_join(F.transform(moved, lambda v: F.hex(v)), "")

    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 64).cast("int")), piece), "")
    return F.when(m.rlike("[a-fA-F]") & m.rlike("[0-9]"), F.when(m.rlike("[a-f]"), F.lower(whole)).otherwise(whole))


MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "iso_date": _iso_date, "day_date": _day_date, "ssn": _ssn, "phone": _phone, "card": _card, "secret": _secret}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of a value in one of FORMATS, null where it is not valid. A value is read by the first format it fills."""
    made = None
    for name, pattern in FORMATS.items():
        whole = m.rlike(rf"^(?:{pattern})$")
        made = F.when(whole, MAKERS[name](m, key)) if made is None else made.when(whole, MAKERS[name](m, key))
    return made


def standing(text: Column) -> Column:
    """The valid IBANs of their country's length and valid cards set in groups or unbroken in a text, wherever a longer match would begin or end."""

    def extracted(pattern: str, after: str) -> Column:
        # A lookahead finds values that overlap.
        return F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z0-9.+@])(?=({pattern})(?![A-Za-z0-9]){after})"), F.lit(1))

    ibans = "|".join(rf"(?:{'|'.join(c.split())})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
                     for n, c in IBAN_LENGTHS.items())
    no_mail = r"(?!\.\d)(?![A-Za-z0-9._%+-]*@)"
    cards = F.concat(*[extracted(shape, no_mail) for shape in CARD_SHAPES])

    def valid_iban(m: Column) -> Column:
        return let(F.regexp_replace(m, " ", ""), lambda p: _mod97(F.concat(F.substring(p, 5, 40), F.substring(p, 1, 4))) == 1)

    def valid_card(m: Column) -> Column:
        return (let(_digits(m), _luhn) % 10 == 0) & m.rlike("[1-9]")

    return F.array_distinct(F.concat(F.filter(extracted(ibans, ""), valid_iban), F.filter(cards, valid_card)))


def _pieces(text: Column, pattern: Column, inside: Callable[[Column], Column]) -> Column:
    """text cut at pattern: inside of what stands between matches, and the matches as values."""
    fill = F.concat(F.regexp_extract_all(text, pattern, F.lit(0)), F.array(F.lit(None).cast("string")))
    return F.flatten(F.zip_with(F.split(text, pattern, -1), fill, lambda a, b: F.concat(
        inside(a), F.when(b.isNotNull(), F.array(F.struct(b.alias("old"), F.lit(True).alias("value")))).otherwise(F.array().cast("array<struct<old:string,value:boolean>>")))))


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text, n_found and n_replaced for every row of docs: the whole text with each valid value replaced, all else as it was.

    Values that fail their format's rule (Luhn, mod 97, octets, calendar) stay. A null text stays null with no values. Rows that repeat are
    rewritten each, alike. An empty table gives no rows. Other columns of docs are not read.
    """
    wanted = _any_format()
    text = F.col("text")
    # A text without @ and without seven digits, or as many hexadecimal ones, in a stretch of 40 characters cannot hold a value.
    may = text.contains("@") | text.rlike(r"\d[^A-Za-z]{0,3}\d[^A-Za-z]{0,3}\d[^A-Za-z]{0,3}\d") | text.rlike("[0-9a-f]{32}|[0-9A-F]{32}")
    plain = lambda t: F.array(F.struct(t.alias("old"), F.lit(False).alias("value")))
    # Values that are sure by themselves leave the text first, so that no looser match takes them in; then those of all formats. Each is
    # replaced once, and the text is put together again.
    sure = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(may, standing(text)).alias("sure"))
    # Digits, capitals, blanks and hyphens only: safe in a pattern.
    exact = F.concat(F.lit("(?<![A-Za-z0-9.+@])(?:"), F.array_join("sure", "|"), F.lit(r")(?![A-Za-z0-9])(?!\.\d)(?![A-Za-z0-9._%+-]*@)"))
    usual = lambda t: _pieces(t, F.lit(wanted), plain)
    found = sure.select("doc_id", "text", F.when(may, F.when(F.size("sure") > 0, _pieces(text, exact, usual)).otherwise(usual(text))).alias("found"))
    made = found.withColumn("made", F.when(F.size("found") > 1, F.transform("found", lambda m: F.struct(
        m["old"].alias("old"), m["value"].alias("value"), F.when(m["value"], pseudonym(m["old"], key)).alias("new")))))
    joined = F.array_join(F.transform("made", lambda x: F.coalesce(x["new"], x["old"])), "")
    return made.select(
        "doc_id", F.when(F.col("made").isNotNull(), joined).otherwise(text).alias("text"),
        F.coalesce(F.size(F.filter("made", lambda x: x["value"])), F.lit(0)).alias("n_found"),
        F.coalesce(F.size(F.filter("made", lambda x: x["new"].isNotNull())), F.lit(0)).alias("n_replaced"))
