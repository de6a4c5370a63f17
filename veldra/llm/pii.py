"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

Found in whole texts by one pattern: payment card numbers (13 to 19 digits with a valid Luhn digit;
alone, or in groups joined by spaces or hyphens: fours with a last group of 1 to 7, or 4, 6 and 4 or
5), North American telephone numbers with +1 (area and exchange codes from 200 to 999 without those
that end in 11), IPv4 addresses (octets up to 255), dates (ISO, or with slashes or dots; they must
exist), and e-mail addresses. Each valid value is permuted by a keyed Feistel network within its
format, so that equal values stay linked across documents and different ones stay different
(but for month-first dates, which may meet the pseudonym of a day-first one):

* cards: all digits but the last, which becomes the new Luhn digit; groups stay. In a run of more
  groups every group may begin a number, and the first that makes a valid one does, the longest first
* telephones: the number among the 792 * 792 * 10,000 valid ones; the punctuation stays
* addresses: the 32-bit number
* dates of the years 1 to 9999: the day within its hundred years (1940 to 2039 and so on; the first
  39 and the last 60 years are blocks of their own), whose days are the product of the two halves'
  sizes; the layout stays
* e-mail addresses: their digits are too few to hide them, so the local part becomes a keyed
  64-bit value, itself permuted, and the domain ``example.invalid``

Numbers that aren't valid (most 16-digit numbers) are left alone. Round functions are SHA-256 of
key, kind, round and half. The halves of n digits are of n // 2 and n - n // 2 digits, so the
network is a bijection on them, whatever the rounds. ``mask`` reads the key from a one-row frame,
so that no plan, and so neither the UI nor an event log, shows it.

Defined results: a null text stays null, an empty one empty; a text of any length is searched
whole; where two values could begin, the order of the pattern decides; repeated rows are treated
alike; a text without valid values is returned as it is; any other columns stay, whatever their
names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import free_name

ROUNDS = 10
_CARD_RUN = r"(?<![\p{L}\p{N}.\-+])(?=(?:[0-9][ \-]?){12}[0-9])[0-9]++(?:[ \-](?![0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]))[0-9]++(?![\p{L}\p{N}]|\.\p{N}))*+(?![\p{L}\p{N}]|[.\-]\p{N})"
#: Of one number in a run.
_CARD = r"^(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1(?:[0-9]{1,7}|[0-9]{4}\1[0-9]{1,3})|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{4,5})$"
#: Groups of a number, the most first.
_CARD_GROUPS = (5, 4, 3, 1)
#: Groups of a run that are put together at a time.
_BLOCK = 64
_PHONE = r"(?<![\p{L}\p{N}+])\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![\p{L}\p{N}])"
_IP = r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])"
_DATE = r"(?<![\p{L}\p{N}.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\p{L}\p{N}]|[.\-/][0-9])"
_MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++"
#: The order decides where two could begin at one place.
PATTERN = "|".join((_MAIL, _PHONE, _IP, _DATE, _CARD_RUN))


def _round(key: str | Column, kind: str, i: Column, half: Column) -> Column:
    """Sixty bits of SHA-256."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str | Column, kind: str | Callable, rounds: int = ROUNDS) -> Column:
    """Struct ``l, r``: a keyed permutation of the pairs below (left_size, right_size), rounds even.

    Each round adds a function of one half to the other, modulo its size, and swaps them.
    """
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"), left_size.cast("bigint").alias("m"), right_size.cast("bigint").alias("n"))
    step = lambda a, i: F.struct(a["r"].alias("l"), ((a["l"] + F.pmod(_round(key, kind, i, a["r"]), a["m"])) % a["m"]).alias("r"), a["n"].alias("m"), a["m"].alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)


def _digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("bigint")


def permute_digits(digits: Column, key: str | Column, kind: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    left, right = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
    made = feistel(F.substring(digits, F.lit(1), left).cast("bigint"), F.substring(digits, left + 1, right).cast("bigint"), _power(left), _power(right), key, kind)
    return F.transform(F.array(made), lambda x: F.concat(F.lpad(x["l"].cast("string"), left, "0"), F.lpad(x["r"].cast("string"), right, "0")))[0]


def _luhn(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, every second doubled; ``doubled``: the first one (0: the last digit)."""
    digit = lambda k: F.substring(digits, -k, F.lit(1)).cast("int")
    twice = lambda d: F.floor(d * 2 / 10).cast("int") + d * 2 % 10
    places = F.sequence(F.lit(1), F.length(digits))
    values = F.transform(places, lambda k: F.when((k + doubled) % 2 == 1, twice(digit(k))).otherwise(digit(k)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _refill(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced in order; it must have as many."""
    chars = F.transform(F.sequence(F.lit(1), F.length(layout)), lambda k: F.substring(layout, k, F.lit(1)))
    step = lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a["s"], F.substring(digits, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step, lambda a: a["s"])


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def card(value: Column, key: str | Column) -> Column:
    """Of a number in any layout; null if the Luhn digit is wrong."""

    def of(digits):
        body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return F.when(_luhn(digits, 1) % 10 == 0, _bind(body, lambda b: _refill(value, F.concat(b, F.pmod(-_luhn(b, 0), F.lit(10)).cast("string")))))

    return _bind(_digits_of(value), of)


def cards(run: Column, key: str | Column) -> Column:
    """A run of groups of digits with every valid number in it replaced; null if there is none.

    Places with a layout and a right Luhn digit are found first, so most runs end there. The fold
    then goes over the groups: one that begins a number takes that number's groups along.
    """
    valid = lambda x: x.rlike(_CARD) & (_luhn(_digits_of(x), 1) % 10 == 0)

    def of(parts):
        # every second part is a separator, so n groups are 2 n - 1 parts
        some = lambda i, n: F.array_join(F.slice(parts, i, 2 * n - 1), "")
        fits = lambda i: F.filter(F.array(*map(F.lit, _CARD_GROUPS)), lambda n: (i + 2 * n - 2 <= F.size(parts)) & _bind(some(i, n), valid))
        count = lambda i: F.coalesce(F.try_element_at(fits(i), F.lit(1)), F.lit(0))
        counts = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(2)), count)

        def fold(found):
            group = lambda i: F.element_at(parts, 2 * i - 1)
            before = lambda i: F.when(i > 1, F.element_at(parts, F.greatest(2 * i - 2, F.lit(1)))).otherwise("")
            taken = lambda i, n: _bind(some(2 * i - 1, n), lambda x: card(x, key))

            def step(a, i):
                n = F.element_at(found, i)
                plain = F.struct(F.concat(a["s"], before(i), group(i)).alias("s"), F.lit(0).alias("skip"))
                new = F.struct(F.concat(a["s"], before(i), taken(i, n)).alias("s"), (n - 1).alias("skip"))
                return F.when(a["skip"] > 0, F.struct(a["s"].alias("s"), (a["skip"] - 1).alias("skip"))).when(n > 0, new).otherwise(plain)

            def block(a, begin):
                # pieces of a block at a time, so that a run of any length isn't copied for every group
                start = F.struct(F.lit("").alias("s"), a["skip"].alias("skip"))
                some = F.sequence(begin, F.least(begin + _BLOCK - 1, F.size(found)))
                piece = F.aggregate(some, start, step)
                return _bind(piece, lambda x: F.struct(F.concat(a["pieces"], F.array(x["s"])).alias("pieces"), x["skip"].alias("skip")))

            blocks = F.sequence(F.lit(1), F.size(found), F.lit(_BLOCK))
            made = F.aggregate(blocks, F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("skip")), block, lambda a: F.array_join(a["pieces"], ""))
            return F.when(F.array_max(found) > 0, made)

        return _bind(counts, fold)

    return _bind(F.split(run, "(?<=[0-9])(?=[ \\-])|(?<=[ \\-])(?=[0-9])"), of)


def _code_rank(code: Column) -> Column:
    """Of an area or exchange code among the 792 valid ones; null if it isn't one."""
    return F.when((code >= 200) & (code % 100 != 11), code - 200 - F.floor((code - 112) / 100).cast("int"))


def _code_at(rank: Column) -> Column:
    within = rank % 99
    return 200 + F.floor(rank / 99) * 100 + within + F.when(within >= 11, 1).otherwise(0)


def phone(value: Column, key: str | Column) -> Column:
    """Null if a code isn't valid. The 792 * 792 * 10**4 numbers are 79,200 * 79,200."""

    def of(d):
        part = lambda at, n: F.substring(d, at, n).cast("bigint")
        number = (_code_rank(part(2, 3)) * 792 + _code_rank(part(5, 3))) * 10000 + part(8, 4)
        moved = _bind(number, lambda x: feistel(F.floor(x / 79200), x % 79200, F.lit(79200), F.lit(79200), key, "phone"))

        def digits(x):
            codes = F.floor(x / 10000)
            three = lambda c: F.lpad(_code_at(c).cast("bigint").cast("string"), 3, "0")
            return F.concat(three(F.floor(codes / 792)), three(codes % 792), F.lpad((x % 10000).cast("string"), 4, "0"))

        made = _bind(moved, lambda x: _bind(x["l"] * 79200 + x["r"], digits))
        return F.when(number.isNotNull(), F.concat(F.lit("+1"), _refill(F.substring(value, F.lit(3), F.length(value)), made)))

    return _bind(_digits_of(value), of)


def address(value: Column, key: str | Column) -> Column:
    """Null if an octet is over 255."""

    def of(o):
        made = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
        return F.when(F.array_max(o) <= 255, _bind(made, lambda x: F.concat_ws(".", *[F.floor(h / 256).cast("bigint").cast("string") if k == 0 else (h % 256).cast("string") for h in (x["l"], x["r"]) for k in (0, 1)])))

    return _bind(F.transform(F.split(value, "\\."), lambda x: x.cast("int")), of)


#: Days of a block of years, and the sizes of the halves whose product they are.
_HALVES = {36525: (75, 487), 36524: (92, 397), 14244: (12, 1187), 21915: (45, 487)}


def _block(year: Column) -> tuple[Column, Column]:
    """First year of the block, and the year after it: hundred years from 1940 on either way, within 1 to 9999."""
    first = F.floor((year - 1940) / 100).cast("int") * 100 + 1940
    return F.greatest(first, F.lit(1)), F.least(first + 100, F.lit(10000))


def _move_day(day: Column, key: str | Column) -> Column:
    """The halves' sizes give every day of the block once."""
    sizes = F.create_map(*[x for n, (tall, wide) in _HALVES.items() for x in (F.lit(n), F.struct(F.lit(tall).alias("tall"), F.lit(wide).alias("wide")))])

    def of(d):
        first = lambda y: F.make_date(y, F.lit(1), F.lit(1))
        begin, end = _block(F.year(d))
        whole = _bind(F.struct(first(begin).alias("begin"), first(end).alias("end")), lambda x: F.struct(x["begin"].alias("begin"), F.element_at(sizes, F.datediff(x["end"], x["begin"])).alias("size"), F.datediff(d, x["begin"]).alias("at")))

        def moved(x):
            tall, wide = x["size"]["tall"], x["size"]["wide"]
            return _bind(feistel(F.floor(x["at"] / wide), x["at"] % wide, tall, wide, key, "date"), lambda y: F.date_add(x["begin"], (y["l"] * wide + y["r"]).cast("int")))

        return _bind(whole, moved)

    return _bind(day, of)


def date(value: Column, key: str | Column) -> Column:
    """ISO, or day first, or if that doesn't exist month first; null if neither does, or in year 0."""
    read = lambda text: F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    mark = F.when(F.instr(value, "/") > 0, "/").when(F.instr(value, ".") > 0, ".").otherwise("-")
    text = lambda n: n.cast("string")

    def of(parts):
        whole = lambda a, b: read(F.concat_ws("-", parts[2], F.lpad(parts[a], 2, "0"), F.lpad(parts[b], 2, "0")))
        slashed = F.array(whole(1, 0), whole(0, 1))
        found = F.when(F.size(parts) == 3, F.filter(F.transform(slashed, lambda d, k: F.struct(d.alias("day"), (k + 1).alias("order"))), lambda x: x["day"].isNotNull() & F.year(x["day"]).between(1, 9999)))
        iso = F.filter(F.array(F.struct(read(value).alias("day"), F.lit(0).alias("order"))), lambda x: x["day"].isNotNull() & F.year(x["day"]).between(1, 9999))
        one = F.try_element_at(F.when(mark == "-", iso).otherwise(found), F.lit(1))

        def shown(x):
            wide = lambda k, n: F.lpad(n, F.greatest(F.length(parts[k]), F.length(n)), "0")
            year = F.lpad(text(F.year(x["day"])), 4, "0")
            two = F.when(x["order"] == 1, F.array(text(F.day(x["day"])), text(F.month(x["day"])))).otherwise(F.array(text(F.month(x["day"])), text(F.day(x["day"]))))
            by_mark = _bind(two, lambda t: F.concat(wide(0, t[0]), mark, wide(1, t[1]), mark, year))
            return F.when(x["order"] == 0, F.date_format(x["day"], "yyyy-MM-dd")).otherwise(by_mark)

        moved = lambda x: F.struct(_move_day(x["day"], key).alias("day"), x["order"].alias("order"))
        return _bind(one, lambda x: F.when(x.isNotNull(), _bind(moved(x), shown)))

    return _bind(F.split(value, "[./]"), of)


def date(value: Column, key: str | Column) -> Column:
    """ISO, or day first, or if that doesn't exist month first; null if neither does."""
    iso = F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date")
    parts = F.split(value, "[./]")
    whole = lambda a, b: F.try_to_timestamp(F.concat_ws("-", parts[2], F.lpad(parts[a], 2, "0"), F.lpad(parts[b], 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    mark = F.when(F.instr(value, "/") > 0, "/").otherwise(".")
    wide = lambda k, x: F.lpad(x, F.greatest(F.length(parts[k]), F.length(x)), "0")
    layout = lambda a, b: lambda d: F.concat(wide(0, a(d)), mark, wide(1, b(d)), mark, F.lpad(F.year(d).cast("string"), 4, "0"))
    day, month = (lambda d: F.day(d).cast("string")), (lambda d: F.month(d).cast("string"))
    first = F.when(F.size(parts) == 3, whole(1, 0))
    other = F.when(F.size(parts) == 3, whole(0, 1))
    known = lambda d: F.year(d).between(1, 9999)
    return F.when(iso.isNotNull() & known(iso), F.date_format(_move_day(iso, key), "yyyy-MM-dd")).when(first.isNotNull() & known(first), _bind(_move_day(first, key), layout(day, month))).when(other.isNotNull() & known(other), _bind(_move_day(other, key), layout(month, day)))


def mail(value: Column, key: str | Column) -> Column:
    plain = F.lower(value)
    half = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), plain), 256), i, 8), 16, 10)
    made = feistel(half(1), half(9), F.lit(2**32), F.lit(2**32), key, "mail")
    return _bind(made, lambda x: F.concat(F.lit("u"), F.lower(F.lpad(F.hex(x["l"]), 8, "0")), F.lower(F.lpad(F.hex(x["r"]), 8, "0")), F.lit("@example.invalid")))


def kind(value: Column) -> Column:
    """Which of the formats a match of the pattern has."""
    return F.when(F.instr(value, "@") > 0, "mail").when(value.startswith("+"), "phone").when(value.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip").when(value.rlike(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})$"), "date").otherwise("card")


def pseudonym(value: Column, key: str | Column) -> Column:
    """Of one match; itself if it isn't valid."""
    of = _bind(kind(value), lambda k: F.when(k == "mail", mail(value, key)).when(k == "phone", phone(value, key)).when(k == "ip", address(value, key)).when(k == "date", date(value, key)).otherwise(cards(value, key)))
    return F.coalesce(of, value)


def pseudonymize(text: Column, key: str | Column) -> Column:
    """A text with every valid value replaced. Texts without a match are passed through."""
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    gaps = F.split(text, PATTERN, -1)
    made = F.transform(matches, lambda v: pseudonym(v, key))
    joined = F.array_join(F.zip_with(gaps, made, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(text.rlike("[0-9@]") & text.rlike(PATTERN), joined).otherwise(text)


def mask(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with the texts of ``column`` pseudonymized."""
    hidden = free_name(docs.columns, "pii_key")
    secret = docs.sparkSession.createDataFrame([(key,)], "k string").scalar()
    return docs.withColumn(hidden, secret).withColumn(column, pseudonymize(F.col(f"`{column}`").cast("string"), F.col(hidden))).drop(hidden)
