"""Format-preserving pseudonyms for personal data, in built-in Spark expressions only.

Numbers and dates are found by pattern and validated (check digits, octets, calendar). A valid one
is permuted by a keyed Feistel network within the set of valid values of its format, and keeps its
punctuation: a card number stays a card number with a right check digit, a date a date. As it is a
permutation, equal values get equal pseudonyms in all documents and different ones different
pseudonyms, without any table of them and without a shuffle. E-mail addresses have no such numbered
set; they get a keyed digest as address. The network's rounds are an ``aggregate`` over their
numbers, each adding a keyed digest of one half to the other, modulo that half's size, so a set of
a x b values needs no powers of two and no retries.

Defined results: a null text stays null; a text without valid personal data is returned unchanged;
a value that matches a pattern but is not valid stays (numbers in the shape of a telephone number
have no check and count as valid), but hides none: where a text holds one, the leftmost valid value of
any kind is looked for at every place of it, piece by piece (see CUTS); overlapping matches: the leftmost counts; repeated rows give
equal results; columns beyond the text are passed through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Most steps of a walk. At least a fifth of the values it goes through are inside.
WALK = 256
#: Days that dates are permuted within, as two factors of their number.
FIRST_DAY, DAY_FACTORS = "1900-01-01", (17, 4297)
LAST_DAY = "2099-12-31"

#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{tail}"


#: Of other countries as long as can be.
_IBAN = "|".join(
    [*(_iban_of(*x) for x in IBAN_LENGTHS.items()), "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"]
)

#: Fixed patterns by kind, the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
    r"|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}"
    r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def feistel(
    left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: str
) -> Column:
    """struct<l, r>: a keyed permutation of the pairs (l, r) with l < left_size, r < right_size."""

    def added(to: Column, other: Column, size: Column, number: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(tweak), number.cast("string"), other.cast("string"))
        noise = F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long")
        return F.pmod(to + F.pmod(noise, size), size)

    def one(state: Column, number: Column) -> Column:
        even = number % 2 == 0
        return F.struct(
            F.when(even, added(state["l"], state["r"], left_size, number)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(added(state["r"], state["l"], right_size, number)).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one)


def walked(start: Column, step: Callable[[Column], Column], inside: Callable[[Column], Column]) -> Column:
    """A permutation of the values inside a set out of one of a larger set: its steps until they are inside
    again. Null if that takes more than WALK steps, of which the chance is below 1e-24."""
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        step(start),
        lambda state, _: F.when(inside(state), state).otherwise(step(state)),
    )
    return _with(end, lambda e: F.when(inside(e), e))


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def _with(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """Another string of as many digits."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    sizes = [F.pow(F.lit(10.0), w).cast("long") for w in (half, n - half)]
    halves = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, n - half)
    moved = feistel(_number(halves[0]), _number(halves[1]), *sizes, key, tweak)
    return _with(moved, lambda m: F.concat(_padded(m["l"], half), _padded(m["r"], n - half)))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(value: Column, digits: Column) -> Column:
    """The value with its digits replaced in order."""

    def one(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(
                state["out"],
                F.when(is_digit, F.substring(state["left"], F.lit(1), F.lit(1))).otherwise(c),
            ).alias("out"),
            F.when(is_digit, F.substring(state["left"], F.lit(2), F.length(state["left"])))
            .otherwise(state["left"])
            .alias("left"),
        )

    start = F.struct(F.lit("").alias("out"), digits.alias("left"))
    return F.aggregate(characters(value), start, one, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of 10 for a valid number."""

    def part(c: Column, at: Column) -> Column:
        d = c.cast("int")
        return F.when(at % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(characters(F.reverse(digits)), part), F.lit(0), lambda a, d: a + d)


def _card(value: Column, key: str) -> Column:
    """All digits but the first and the check digit are permuted."""
    digits = _digits(value)
    n = F.length(digits)

    def moved(digits: Column) -> Column:
        inner = permuted_digits(F.substring(digits, F.lit(2), n - 2), key, "card")
        body = F.concat(F.substring(digits, 1, 1), inner)
        return _with(
            body,
            lambda b: F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")),
        )

    return F.when(_luhn(digits) % 10 == 0, _refilled(value, _with(digits, moved)))


def _mod97(text: Column) -> Column:
    """A number of letters (10 to 35) and digits, modulo 97."""

    def one(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        letter = rest * 100 + code - 55
        return F.when(code >= 65, letter).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(characters(text), F.lit(0), one)


def _iban(value: Column, key: str) -> Column:
    """The account's digits are permuted and the check digits made anew."""
    plain = F.regexp_replace(value, " ", "")
    country, account = F.substring(plain, 1, 2), F.substring(plain, 5, 40)
    check = F.substring(plain, 3, 2)
    valid = _mod97(F.concat(account, country, check)) == 1

    def moved(account: Column) -> Column:
        fresh = 98 - _mod97(F.concat(account, country, F.lit("00")))
        return F.concat(country, _padded(fresh, F.lit(2)), account)

    body = _refilled(account, permuted_digits(_digits(account), key, "iban"))

    def spaced(made: Column) -> Column:
        # Characters go back in order; spaces stay where they were.
        def one(state: Column, c: Column) -> Column:
            return F.struct(
                F.concat(
                    state["out"],
                    F.when(c == " ", c).otherwise(F.substring(state["left"], F.lit(1), F.lit(1))),
                ).alias("out"),
                F.when(c == " ", state["left"])
                .otherwise(F.substring(state["left"], F.lit(2), F.length(state["left"])))
                .alias("left"),
            )

        start = F.struct(F.lit("").alias("out"), made.alias("left"))
        return F.aggregate(characters(value), start, one, lambda s: s["out"])

    return F.when(valid, _with(_with(body, moved), spaced))


def _ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))
    size = F.lit(65536)
    moved = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], size, size, key, "ip")

    def dotted(m: Column) -> Column:
        parts = [F.floor(m["l"] / 256), m["l"] % 256, F.floor(m["r"] / 256), m["r"] % 256]
        return F.concat_ws(".", *(p.cast("long").cast("string") for p in parts))

    return F.when(F.forall(octets, lambda o: o < 256), _with(moved, dotted))


def _ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (_number(F.substring(value, *at)) for at in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    moved = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def made(m: Column) -> Column:
        place = F.floor(m["l"] / 99)
        area = place + 1 + F.when(place >= 665, 1).otherwise(0)
        group, serial = m["l"] % 99 + 1, m["r"] + 1
        return F.concat_ws("-", _padded(area, F.lit(3)), _padded(group, F.lit(2)), _padded(serial, F.lit(4)))

    return F.when(valid, _with(moved, made))


def _phone(value: Column, key: str) -> Column:
    """Ten digits of the North American plan (area and exchange from 200) stay in that plan, with
    their country code; of other numbers all digits behind the first two are permuted, and they stay
    outside of it."""
    digits = _digits(value)

    def plan(ten: Column) -> Column:
        area, exchange, line = (_number(F.substring(ten, *at)) for at in ((1, 3), (4, 3), (7, 4)))
        place = (area - 200) * 800 + exchange - 200
        moved = feistel(place, line, F.lit(640_000), F.lit(10_000), key, "phone")

        def made(m: Column) -> Column:
            return F.concat(
                _padded(F.floor(m["l"] / 800) + 200, F.lit(3)),
                _padded(m["l"] % 800 + 200, F.lit(3)),
                _padded(m["r"], F.lit(4)),
            )

        return _with(moved, made)

    def in_plan(number: Column) -> Column:
        return number.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$")

    def other(number: Column) -> Column:
        tail = F.substring(number, F.lit(3), F.length(number))
        return F.concat(F.substring(number, 1, 2), permuted_digits(tail, key, "digits"))

    kept = F.substring(digits, F.lit(1), F.length(digits) - 10)
    inside = F.concat(kept, _with(F.right(digits, F.lit(10)), plan))
    outside = walked(digits, other, lambda number: ~in_plan(number))
    moved = F.when(in_plan(digits), inside).otherwise(outside)
    return F.when(F.length(digits).between(8, 15), _refilled(value, moved))


def _date(value: Column, key: str) -> Column:
    """Year first, day first, or where only that makes a date, month first: those are the dates with a day
    above 12, and they stay among these, so that no two ways of reading share a pseudonym."""
    a, b, year = F.substring(value, 1, 2), F.substring(value, 4, 2), F.substring(value, 7, 4)
    iso = value.rlike("^[0-9]{4}-")
    day_first = F.concat_ws("-", year, b, a).try_cast("date")
    month_first = F.concat_ws("-", year, a, b).try_cast("date")
    day = F.when(iso, value.try_cast("date")).otherwise(F.coalesce(day_first, month_first))
    first, last = F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")
    number = F.datediff(day, first).cast("long")
    small, large = DAY_FACTORS

    def step(n: Column) -> Column:
        moved = feistel(F.floor(n / large), n % large, F.lit(small), F.lit(large), key, "date")
        return _with(moved, lambda m: m["l"] * large + m["r"])

    def late(n: Column) -> Column:
        return F.dayofmonth(F.date_add(first, n.cast("int"))) > 12

    moved = F.when(iso | day_first.isNotNull(), step(number)).otherwise(walked(number, step, late))

    def made(m: Column) -> Column:
        to = F.date_add(first, m.cast("int"))
        mark = F.substring(value, 3, 1)
        d, mo, y = (F.date_format(to, x) for x in ("dd", "MM", "yyyy"))
        return (
            F.when(iso, F.date_format(to, "yyyy-MM-dd"))
            .when(day_first.isNotNull(), F.concat(d, mark, mo, mark, y))
            .otherwise(F.concat(mo, mark, d, mark, y))
        )

    return F.when(day.between(first, last), _with(moved, made))


def _email(value: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256)
    return _with(
        digest,
        lambda d: F.concat(F.lit("u"), F.substring(d, 1, 14), F.lit("@m"), F.substring(d, 15, 6), F.lit(".example")),
    )


MAKERS = {
    "email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card,
}


def kind_of(value: Column) -> Column:
    """The kind a match of ANY belongs to; the value stands alone here."""
    return reduce(
        lambda so_far, kind: so_far.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind),
        list(PATTERNS)[1:],
        F.when(value.rlike(f"^(?:{PATTERNS['email']})$"), "email"),
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a match, or null where it is not valid."""
    first, *rest = MAKERS.items()
    made = F.when(kind == first[0], first[1](value, key))
    for name, maker in rest:
        made = made.when(kind == name, maker(value, key))
    return made


#: Characters that patterns are made of, and places that no pattern goes across: behind any other
#: character, and at a space beside a small letter.
_OF_PATTERNS = "A-Za-z0-9._%+@ /()-"
CUTS = rf"(?<=[^{_OF_PATTERNS}])|(?<=[a-z] )|(?= [a-z])"


def rescanned(line: Column, key: str) -> Column:
    """struct<text, kinds>: a piece of text with its leftmost valid values replaced, though matches that
    are not valid overlap them."""

    def candidates(kind: str, pattern: str) -> Column:
        def one(v: Column) -> Column:
            fixed = F.lit(kind).alias("kind"), F.lit(pattern).alias("pattern")
            return F.struct(v.alias("value"), *fixed, MAKERS[kind](v, key).alias("new"))

        return F.transform(F.regexp_extract_all(line, F.lit(f"(?=({pattern}))"), 1), one)

    found = [candidates(*x) for x in PATTERNS.items()]
    valid = F.filter(F.array_distinct(F.concat(*found)), lambda m: m["new"].isNotNull())

    def replaced(valid: Column) -> Column:
        # Of values that begin at the same place, the longest.
        longest = F.array_sort(F.transform(valid, lambda m: F.struct(-F.length(m["value"]), m["pattern"], m["value"])))
        each = F.transform(longest, lambda m: F.concat(F.lit("(?="), m["pattern"], F.lit(r")\Q"), m["value"], F.lit(r"\E")))
        marks = F.array_join(each, "|")
        values = F.transform(
            F.regexp_extract_all(line, marks, F.lit(0)),
            lambda v: F.filter(valid, lambda m: m["value"] == v)[0],
        )

        def joined(values: Column) -> Column:
            pieces = F.split(line, marks, -1)
            heads = F.zip_with(F.slice(pieces, F.lit(1), F.size(values)), values, lambda p, m: F.concat(p, m["new"]))
            text = F.concat(F.array_join(heads, ""), F.element_at(pieces, -1))
            return F.struct(text.alias("text"), F.transform(values, lambda m: m["kind"]).alias("kinds"))

        none = F.struct(line.alias("text"), F.array().cast("array<string>").alias("kinds"))
        return F.when(F.size(valid) > 0, _with(values, joined)).otherwise(none)

    return _with(valid, replaced)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """The documents with personal data replaced in the text. ``kinds_col`` adds the kinds of the
    replaced values in the order of their places; a column of that name goes."""
    text = F.col(text_col)
    found = F.transform(
        F.regexp_extract_all(text, F.lit(ANY), 0),
        lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")),
    )
    made = F.transform(
        found,
        lambda m: F.struct(
            m["value"].alias("value"), m["kind"].alias("kind"), pseudonym(m["value"], m["kind"], key).alias("new")
        ),
    )
    has = F.coalesce(F.regexp_like(text, F.lit(ANY)), F.lit(False))
    work = docs.withColumn("__made", F.when(has, made))
    pieces = F.split(text, ANY, -1)
    joined = F.concat(
        F.array_join(
            F.zip_with(
                F.slice(pieces, F.lit(1), F.size("__made")),
                F.col("__made"),
                lambda piece, m: F.concat(piece, F.coalesce(m["new"], m["value"])),
            ),
            "",
        ),
        F.element_at(pieces, -1),
    )
    again = F.exists("__made", lambda m: m["new"].isNull())
    # The work on a piece grows with the square of its matches, so pieces are as short as can be.
    unchanged = F.array().cast("array<string>").alias("kinds")
    pieces = F.transform(
        F.split(text, CUTS, -1),
        lambda piece: F.when(F.regexp_like(piece, F.lit(ANY)), rescanned(piece, key)).otherwise(
            F.struct(piece.alias("text"), unchanged)
        ),
    )
    work = work.withColumn("__lines", F.when(again, pieces))
    whole = F.array_join(F.transform("__lines", lambda x: x["text"]), "")
    changed = F.when(F.col("__lines").isNotNull(), whole).when(F.col("__made").isNotNull(), joined).otherwise(text)
    work = work.withColumn(text_col, changed)
    if kinds_col is not None:
        none = F.array().cast("array<string>")
        kinds = F.when(F.col("__lines").isNotNull(), F.flatten(F.transform("__lines", lambda x: x["kinds"])))
        kinds = kinds.otherwise(F.transform("__made", lambda m: m["kind"]))
        work = work.withColumn(kinds_col, F.coalesce(kinds, none))
    return work.drop("__made", "__lines")
