"""Personal data: format-preserving pseudonyms by a keyed Feistel network, in DataFrame operations only.

Card, phone and social security numbers, IPv4 addresses and dates are found by pattern and validated (Luhn digit, number
plans, octets, calendar). A valid value is mapped to a number pair of its format, permuted by a keyed Feistel network over
exactly the values of that format, and written back with the separators it had. So a pseudonym is again a valid value
of its format, equal values get equal pseudonyms in all documents, different values different ones, and who has the key can undo it
(``reveal``). E-mail addresses have no fixed range; they get a keyed hash instead, which links equal ones but can't be undone. What
fails validation is left as it is.

Ranges: cards of 13 to 19 digits (all but the check digit permuted, which is then computed anew), unbroken or grouped 4-6-5, 4-6-4 or in fours; phone
numbers of ten digits with area code 200-999 (those with a code below, which no plan gives out, only if it stands in brackets, and then among
each other); other international numbers of 8 to 15 digits, whose first two stay; social security numbers as issued (no area 000, 666 or
9xx, group 00, serial 0000); all IPv4 addresses; dates of the 400 years from 1800 on, a whole calendar cycle. Of xx/xx/xxxx dates the month comes
first; those that are no date then have the day first, and are permuted among each other. dd.mm.yyyy has the day first.

A run of groups of four digits is searched for a card from left to right, so that a card beside other numbers is found. In a run of five groups and more
a pseudonym may make an earlier stretch look like a card; such a run can't always be undone. All other values can. Runs are cut at 64 groups.

Defined results: a null text stays null with 0 replacements; empty texts and texts without values stay as they are. Rows are treated one by one.
Other columns are carried in the struct ``doc``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemine.llm.common import pack

ROUNDS = 10
WALK = 64  # steps to a day of the same class; more are needed once in 10^25 dates
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773  # 189 * 773 = 146097 days in 400 years

#: Fixed patterns; tried in this order at each place. Repetitions are bounded, so a long run of letters or digits is passed over in linear time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "cards": r"(?<![0-9])(?:[0-9]{4}(?: [0-9]{4}){3,63}(?: [0-9]{3}(?![ .-]?[0-9]))?|[0-9]{4}(?:-[0-9]{4}){3,63}(?:-[0-9]{3}(?![ .-]?[0-9]))?)(?![0-9])",
    "intl": r"(?<![0-9+])\+[2-9][0-9](?:[ .()-]{0,2}[0-9]){6,13}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "phone10": r"(?<![0-9A-Za-z._-])(?:\+1)?(?:\([0-9]{3}\) ?[0-9]{7}|[2-9][0-9]{9})(?![0-9A-Za-z_]|[.-][0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4} [0-9]{6} [0-9]{4,5}|[0-9]{4}-[0-9]{6}-[0-9]{4,5})(?![0-9])",
}
#: Layouts of one kind have one name in results.
NAMES = {"cards": "card", "intl": "phone", "phone10": "phone"}
ANY = "|".join(PATTERNS.values())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for all its uses: a transform over the one value."""
    return F.transform(F.array(value), use)[0]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def number(value: Column) -> Column:
    return value.cast("bigint")


def padded(value: Column, width: int | Column) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def feistel(kind: str, a: Column, b: Column, range_a: int | Column, range_b: int | Column, key: str, undo: bool = False) -> Column:
    """A keyed permutation of the pairs (a, b) with a < range_a and b < range_b; even rounds move a by a hash of b, odd ones b."""
    sign = -1 if undo else 1
    range_a, range_b = (F.lit(r).cast("bigint") if isinstance(r, int) else r.cast("bigint") for r in (range_a, range_b))

    def moved(value: Column, other: Column, turn: Column, size: Column) -> Column:
        hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string")), 256)
        step = F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint") % size
        return F.pmod(value + sign * step, size)

    def turned(state: Column, turn: Column) -> Column:
        return F.when(turn % 2 == 0, F.struct(moved(state["a"], state["b"], turn, range_a).alias("a"), state["b"].alias("b"))).otherwise(
            F.struct(state["a"].alias("a"), moved(state["b"], state["a"], turn, range_b).alias("b"))
        )

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), turned)


def luhn_sum(value: Column, doubled: int) -> Column:
    """The Luhn sum from the right, doubling places whose number from 0 has this parity."""
    weighed = F.transform(
        F.regexp_extract_all(F.reverse(value), F.lit("[0-9]"), F.lit(0)),
        lambda x, i: F.when(i % 2 == doubled, number(x) * 2 - F.when(x >= "5", 9).otherwise(0)).otherwise(number(x)),
    )
    return F.aggregate(weighed, F.lit(0).cast("bigint"), lambda total, x: total + x)


def refill(shape: Column, new: Column) -> Column:
    """``shape`` with its digits replaced, in order, by the digits ``new``."""
    return F.aggregate(
        F.regexp_extract_all(shape, F.lit("(?s)."), F.lit(0)),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda s, c: F.when(
            (c >= "0") & (c <= "9"), F.struct(F.concat(s["out"], F.substring(new, s["next"], 1)).alias("out"), (s["next"] + 1).alias("next"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next"))),
        lambda s: s["out"],
    )


def split_number(value: Column, width: Column) -> tuple[Column, Column, Column, Column]:
    """The halves of a digit string and their ranges."""
    left = F.floor(width / 2).cast("int")
    return number(F.substring(value, F.lit(1), left)), number(F.substring(value, left + 1, width - left)), F.pow(F.lit(10.0), left), F.pow(F.lit(10.0), width - left)


def new_card(value: Column, key: str, undo: bool) -> Column:
    """Null unless the Luhn digit is right."""
    plain = digits(value)
    width = F.length(plain) - 1
    a, b, range_a, range_b = split_number(F.substring(plain, F.lit(1), width), width)
    left = F.floor(width / 2).cast("int")

    def written(pair: Column) -> Column:
        body = F.concat(padded(pair["a"], left), padded(pair["b"], width - left))
        return refill(value, F.concat(body, ((10 - luhn_sum(body, 0) % 10) % 10).cast("string")))

    # A transform over the one pair computes it once for all its uses.
    return F.when(luhn_sum(plain, 1) % 10 == 0, F.transform(F.array(feistel("card", a, b, range_a, range_b, key, undo)), written)[0])


def new_cards(value: Column, key: str, undo: bool) -> Column:
    """A run of groups of four digits with the cards in it, from left to right, replaced; null if there are none."""
    separator = F.substring(value, 5, 1)

    def joined(parts: Column) -> Column:
        return F.replace(F.array_join(parts, " "), F.lit(" "), separator)

    def searched(groups: Column) -> Column:
        def step(state: Column, at: Column) -> Column:
            left = F.size(groups) - at + 1

            def stretch(n: int, last: int) -> Column:
                text = joined(F.slice(groups, at, n))
                return F.when((left >= n) & (F.length(groups[at + n - 2]) == last) & (luhn_sum(digits(text), 1) % 10 == 0), text)

            card = bound(F.when(state["skip"] == 0, F.coalesce(stretch(4, 4), stretch(5, 3))), lambda c: F.struct(new_card(c, key, undo).alias("new"), F.length(c).alias("n")))
            return bound(
                card,
                lambda c: F.when(state["skip"] > 0, F.struct(state["out"].alias("out"), (state["skip"] - 1).alias("skip"), state["found"].alias("found")))
                .when(c["new"].isNotNull(), F.struct(F.array_append(state["out"], c["new"]).alias("out"), F.when(c["n"] == 19, 3).otherwise(4).alias("skip"), F.lit(True).alias("found")))
                .otherwise(F.struct(F.array_append(state["out"], groups[at - 1]).alias("out"), F.lit(0).alias("skip"), state["found"].alias("found"))),
            )

        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"), F.lit(False).alias("found"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda s: F.when(s["found"], joined(s["out"])))

    return bound(F.split(value, "[ -]"), searched)


def new_international(value: Column, key: str, undo: bool) -> Column:
    """The digits behind the first two, permuted among the numbers of that many digits."""
    plain = digits(value)
    width = F.length(plain) - 2
    a, b, range_a, range_b = split_number(F.substring(plain, F.lit(3), width), width)
    left = F.floor(width / 2).cast("int")

    def written(pair: Column) -> Column:
        return refill(value, F.concat(F.substring(plain, 1, 2), padded(pair["a"], left), padded(pair["b"], width - left)))

    return F.when((width >= 6) & (width <= 13), F.transform(F.array(feistel("intl", a, b, range_a, range_b, key, undo)), written)[0])


def new_phone(value: Column, key: str, undo: bool) -> Column:
    plain = F.substring(digits(value), -10, 10)
    lead = F.when(F.length(digits(value)) > 10, "1").otherwise("")
    area = number(F.substring(plain, 1, 3))
    first = F.when(area >= 200, 200).otherwise(0)
    pair = feistel("phone", area - first, number(F.substring(plain, 4, 7)), F.when(area >= 200, 800).otherwise(200), 10_000_000, key, undo)
    return F.transform(F.array(pair), lambda p: refill(value, F.concat(lead, padded(p["a"] + first, 3), padded(p["b"], 7))))[0]


def new_ssn(value: Column, key: str, undo: bool) -> Column:
    area, group, serial = (number(F.substring(value, s, n)) for s, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    pair = feistel("ssn", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, undo)

    def written(p: Column) -> Column:
        new_area = p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)
        return F.concat_ws("-", padded(new_area, 3), padded(F.floor(p["b"] / 9999) + 1, 2), padded(p["b"] % 9999 + 1, 4))

    return F.when(valid, F.transform(F.array(pair), written)[0])


def new_ip(value: Column, key: str, undo: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), number)
    a, b = octets[0] * 256 + octets[1], octets[2] * 256 + octets[3]
    pair = feistel("ip", a, b, 65536, 65536, key, undo)

    def written(p: Column) -> Column:
        return F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)])

    return F.when(F.forall(octets, lambda o: o <= 255), F.transform(F.array(pair), written)[0])


def new_date(value: Column, key: str, undo: bool) -> Column:
    """Null unless it is a day of the calendar in the 400 years."""
    begin = F.lit(FIRST_DAY).cast("date")

    def read(*places: tuple[int, int]) -> Column:
        date = F.concat_ws("-", *[F.substring(value, *p) for p in places]).try_cast("date")
        return bound(F.datediff(date, begin), lambda n: F.when((n >= 0) & (n < DAYS_A * DAYS_B), n))

    def turned(at: Column) -> Column:
        def moved(day: Column) -> Column:
            pair = feistel("date", F.floor(day / DAYS_B), day % DAYS_B, DAYS_A, DAYS_B, key, undo)
            return bound(pair, lambda p: (p["a"] * DAYS_B + p["b"]).cast("int"))

        return bound(at, moved)

    def day(at: Column) -> Column:
        return F.date_add(begin, at)

    def walked(at: Column) -> Column:
        """The next day in the permutation's cycle that is no month; more than half of all days are none."""
        no_month = lambda n: F.dayofmonth(day(n)) > 12
        start = F.struct(at.alias("at"), F.lit(False).alias("done"))
        state = F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)),
            start,
            lambda s, _: F.when(s["done"], s).otherwise(bound(turned(s["at"]), lambda n: F.struct(n.alias("at"), no_month(n).alias("done")))),
        )
        return bound(state, lambda s: F.when(s["done"], s["at"]))

    year_first, month_first, day_first = ((1, 4), (6, 2), (9, 2)), ((7, 4), (1, 2), (4, 2)), ((7, 4), (4, 2), (1, 2))
    slashes = F.substring(value, 3, 1) == "/"
    turned_days = bound(
        F.when(slashes, read(*month_first)).when(F.substring(value, 3, 1) == ".", read(*day_first)).otherwise(read(*year_first)),
        lambda at: bound(
            day(turned(at)),
            lambda new: F.when(slashes, F.date_format(new, "MM/dd/yyyy"))
            .when(F.substring(value, 3, 1) == ".", F.date_format(new, "dd.MM.yyyy"))
            .when(F.substring(value, 5, 1) == "/", F.date_format(new, "yyyy/MM/dd"))
            .otherwise(F.date_format(new, "yyyy-MM-dd")),
        ),
    )
    return F.coalesce(turned_days, F.when(slashes & (F.substring(value, 1, 2) > "12"), F.date_format(day(walked(read(*day_first))), "dd/MM/yyyy")))


def new_email(value: Column, key: str, undo: bool) -> Column:
    if undo:
        return F.lit(None).cast("string")
    hashed = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256)
    return F.concat(F.lit("u"), F.substring(hashed, 1, 16), F.lit("@mail.invalid"))


WRITERS = {
    "email": new_email,
    "ip": new_ip,
    "date": new_date,
    "ssn": new_ssn,
    "cards": new_cards,
    "intl": new_international,
    "phone": new_phone,
    "phone10": new_phone,
    "card": new_card,
}


def replaced(value: Column, key: str, undo: bool) -> Column:
    """(kind, text) of the pseudonym of a match; a null kind and the match itself if it isn't valid."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(kind)

    def written(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, writer in WRITERS.items():
            out = F.when(k == name, writer(value, key, undo)).otherwise(out)
        named = k
        for layout, name in NAMES.items():
            named = F.when(k == layout, name).otherwise(named)
        return F.transform(F.array(out), lambda new: F.struct(F.when(new.isNotNull(), named).alias("kind"), F.coalesce(new, value).alias("text")))[0]

    return F.transform(F.array(kind), written)[0]


def rewrite(docs: DataFrame, text: str, key: str, undo: bool) -> DataFrame:
    rows = docs.select(pack(docs, "doc"), F.col(text).alias("_text"))
    # Most texts hold nothing to look at.
    found = F.when(F.col("_text").rlike("[0-9@]"), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_found", F.transform(found, lambda m: replaced(m, key, undo)))
    between = F.split("_text", ANY, -1)
    filled = F.array_join(F.zip_with(between, F.concat(F.col("_found.text"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    kinds = F.filter("_found.kind", lambda k: k.isNotNull())
    return rows.select("doc", F.when(F.size("_found") > 0, filled).otherwise(F.col("_text")).alias("text"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(doc, text, kinds): the rewritten text of each row, and the kinds of the values replaced, in order."""
    return rewrite(docs, text, key, undo=False)


def reveal(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The same columns, with numbers and dates restored; e-mail pseudonyms stay."""
    return rewrite(docs, text, key, undo=True)
