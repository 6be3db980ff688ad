"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipcurate.llm.common import free_name

#: What is looked for, in this order at each place of a text.
PATTERNS = {
    # Runs are possessive and begin where a run of such characters does, or after a value: linear, and no stack for long ones.
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{1,1024}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])\+[0-9]{8,15}(?![0-9]|[.-][0-9])|(?<![0-9A-Za-z+.-])(?![0-9]{1,4}[ -](?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9]))(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{2,4}[ .-]?[0-9]{2,6}(?:[ .-][0-9]{2,4})?(?![0-9]|[.-][0-9])",
}
#: 400 Gregorian years from this day, 189 * 773 days.
FIRST_YEAR, DAY_RADICES = 1800, (189, 773)
#: Steps of a walk to a day over 12; 3 in 5 days are, so a walk that is longer has odds of 1 in 10^12.
WALK = 30
SSN_RADICES = (898 * 99, 9999)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _round(key: str, tweak: str, i: Column, half: Column, bits: int = 512) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), half.cast("string")), bits)


def feistel_number(value: Column, radices: tuple[int, int], key: str, tweak: str, rounds: int = 8) -> Column:
    """A keyed permutation of 0 .. radices[0] * radices[1] - 1: the halves take turns in moving by a keyed hash of the other."""
    ra, rb = radices
    move = lambda i, half: F.conv(F.substring(_round(key, tweak, i, half), 1, 15), 16, 10).cast("long")
    start = F.struct(F.floor(value / rb).cast("long").alias("a"), (value % rb).cast("long").alias("b"))
    step = lambda s, i: F.struct(F.when(i % 2 == 0, (s.a + move(i, s.b)) % ra).otherwise(s.a).alias("a"), F.when(i % 2 == 1, (s.b + move(i, s.a)) % rb).otherwise(s.b).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s.a * rb + s.b)


def _shift(text: Column, stream: Column) -> Column:
    """Each digit and ASCII letter moved within its class by a byte of the hexadecimal stream; all else stays."""

    def one(j: Column) -> Column:
        c = F.substring(text, j, F.lit(1))
        o = F.ascii(c)
        by = F.conv(F.substring(stream, (j - 1) % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")
        turn = lambda low, n: F.char(((o - low + by) % n + low).cast("long"))
        return F.when(o.between(48, 57), turn(48, 10)).when(o.between(97, 122), turn(97, 26)).when(o.between(65, 90), turn(65, 26)).otherwise(c)

    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), ""))


def feistel_text(text: Column, key: str, tweak: str, rounds: int = 8) -> Column:
    """A keyed permutation of the texts that have the same class of character in each place (even number of rounds)."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    step = lambda s, i: F.struct(s.b.alias("a"), _shift(s.a, _round(key, tweak, i, s.b)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: F.concat(s.a, s.b))


def feistel_digits(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the digit strings of the same length."""
    return feistel_text(digits, key, tweak)


def _spelled(text: Column, digits: Column) -> Column:
    """``text`` with its digits, from left to right, replaced by ``digits``; separators stay where they are."""

    def one(j: Column) -> Column:
        c = F.substring(text, j, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(text, F.lit(1), j))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that makes a card number of these digits valid."""
    n = F.length(payload)

    def weigh(j: Column) -> Column:
        d = F.substring(payload, j, F.lit(1)).cast("int")
        return F.when((n - j) % 2 == 0, F.floor(d * 2 / 10).cast("int") + d * 2 % 10).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), weigh), F.lit(0), lambda a, b: a + b)
    return ((10 - total % 10) % 10).cast("string")


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted, whatever stands between them; the last is their check digit again."""
    spell = lambda new: _spelled(m, F.concat(new, luhn_digit(new)))

    def judged(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        return F.when(luhn_digit(body) == F.substring(digits, F.length(digits), F.lit(1)), _let(feistel_digits(body, key, "card"), spell))

    return _let(_digits(m), judged)


def _ip(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    new = feistel_number(F.aggregate(o, F.lit(0).cast("long"), lambda a, b: a * 256 + b), (65536, 65536), key, "ip")
    part = lambda x, k: (F.floor(x / 256**k) % 256).cast("string")
    return F.when(F.forall(o, lambda x: x <= 255), _let(new, lambda x: F.concat_ws(".", *[part(x, k) for k in (3, 2, 1, 0)])))


def _date(m: Column, key: str) -> Column:
    """ISO dates, day.month.year, month/day/year, and day/month/year where the day is over 12. The new date is written the same
    way, with as wide fields. The last kind walks along the permutation to the next such day, so it stays of its kind."""
    iso, dotted = m.contains("-"), m.contains(".")
    first = F.to_date(F.lit(f"{FIRST_YEAR}-01-01"))
    wide = F.length(F.regexp_extract(m, "^([0-9]+)", 1)) == 2
    sep = F.when(dotted, F.lit(".")).otherwise(F.lit("/"))
    field = lambda x: F.when(wide, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    next_ = lambda x: feistel_number(x, DAY_RADICES, key, "date")
    late = lambda x: F.dayofmonth(F.date_add(first, x.cast("int"))) > 12

    def number(x: Column) -> Column:
        valid = x.y.between(FIRST_YEAR, FIRST_YEAR + 399) & x.m.between(1, 12)
        in_month = F.dayofmonth(F.last_day(F.make_date(x.y, x.m, F.lit(1))))
        return F.when(valid, F.when(x.d.between(1, in_month), F.datediff(F.make_date(x.y, x.m, x.d), first))).cast("long")

    def fields(p: Column) -> Column:
        late_day = ~iso & ~dotted & (p[0] > 12)
        y, mo, d = F.when(iso, p[0]).otherwise(p[2]), F.when(iso | dotted | late_day, p[1]).otherwise(p[0]), F.when(iso, p[2]).when(dotted | late_day, p[0]).otherwise(p[1])
        return _let(F.struct(y.alias("y"), mo.alias("m"), d.alias("d")), lambda x: F.struct(number(x).alias("n"), late_day.alias("late")))

    def moved(x: Column) -> Column:
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), next_(x.n), lambda v, i: F.when(late(v), v).otherwise(next_(v)))
        new = F.date_add(first, F.when(x.late, walked).otherwise(next_(x.n)).cast("int"))
        return F.when(x.n.isNotNull(), _let(F.struct(new.alias("t"), (dotted | x.late).alias("day_first")), written))

    def written(x: Column) -> Column:
        d, mo, y = field(F.dayofmonth(x.t)), field(F.month(x.t)), F.year(x.t).cast("string")
        return F.when(iso, F.date_format(x.t, "yyyy-MM-dd")).when(x.day_first, F.concat(d, sep, mo, sep, y)).otherwise(F.concat(mo, sep, d, sep, y))

    parts = F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    return _let(_let(parts, fields), moved)


def _ssn(m: Column, key: str) -> Column:
    """The valid numbers (area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999) are permuted by their index."""
    area, group, serial = (F.substring(m, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    part = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def written(new: Column) -> Column:
        a = F.floor(new / (99 * 9999)) + 1
        return F.concat_ws("-", part(a + (a >= 666).cast("long"), 3), part(F.floor(new / 9999) % 99 + 1, 2), part(new % 9999 + 1, 4))

    return F.when(valid, _let(feistel_number(index, SSN_RADICES, key, "ssn"), written))


def _phone(m: Column, key: str) -> Column:
    """The last nine digits (all, of a shorter number) are permuted: the country code and an area's first digit stay, and a
    number is linked with and without its country code, in whatever spelling. What looks like a date, an address or a
    social security number is no phone number, even if it isn't a valid one of those."""
    other = m.rlike("^(?:" + "|".join(PATTERNS[k] for k in ("ip", "ssn")) + ")$") | m.rlike(f"^(?:{PATTERNS['date']})$")

    def moved(digits: Column) -> Column:
        n = F.length(digits)
        kept = F.greatest(n - 9, F.lit(0))
        new = F.concat(F.substring(digits, F.lit(1), kept), feistel_digits(F.substring(digits, kept + 1, n), key, "phone"))
        return F.when(n.between(8, 15) & ~other, _let(new, lambda x: _spelled(m, x)))

    return _let(_digits(m), moved)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(feistel_text(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m)))


KINDS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonymize(docs: DataFrame, key: str, text: str = "text", kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """``docs`` with the personal values in ``text`` replaced, and a struct column ``pii`` of how many of each kind were (if
    there is a column of that name, see ``free_name``).

    Candidates are found by pattern and validated: card numbers by their check digit, addresses by their octets, dates by
    the calendar (1800 to 2199), social security numbers by their blocked ranges, phone numbers by 8 to 15 digits. A
    candidate that several kinds fit is of the first that validates it. A valid value is replaced by its image under a
    keyed permutation of the valid values of its format: numbers by their digits alone, so that a number in several
    spellings stays linked; separators and field widths stay. Equal values have equal pseudonyms in all documents, and
    different ones different pseudonyms. E-mail addresses keep their domain; what is longer than 1024 before the @ is none. Invalid candidates are left as they are.

    Null and empty texts stay as they are, with counts of 0. Every row and column is returned; there is no shuffle.
    """
    free = lambda p: p.replace(r"\1", "[./ -]").replace("([./])", "[./]").replace("([ -])", "[ -]")
    pattern = "|".join(free(PATTERNS[k]) for k in kinds)
    found = F.regexp_extract_all(F.col(text), F.lit(f"(?:{pattern})"), F.lit(0))

    def judge(m: Column) -> Column:
        is_k = lambda k: m.rlike(f"^(?:{PATTERNS[k]})$")
        return F.struct(m.alias("old"), F.coalesce(*[F.when(is_k(k), F.concat(F.lit(f"{k}:"), KINDS[k](m, key))) for k in kinds]).alias("tagged"))

    def untag(x: Column) -> Column:
        at = F.instr(x.tagged, ":")
        return F.struct(x.old.alias("old"), F.substring(x.tagged, at + 1, F.length(x.tagged)).alias("new"), F.substring(x.tagged, F.lit(1), at - 1).alias("kind"))

    some = F.col(text).rlike("[0-9]{2}|[0-9][./-][0-9]|@")
    empty = F.array().cast("array<struct<old:string,new:string,kind:string>>")
    at, into = free_name(docs, "__found"), free_name(docs, "pii")
    out = docs.withColumn(at, F.when(some, F.transform(F.transform(found, judge), untag)).otherwise(empty))
    gaps = F.split(F.col(text), f"(?:{pattern})", -1)
    joined = F.array_join(F.zip_with(gaps, F.col(at), lambda g, m: F.concat(g, F.coalesce(m.new, m.old, F.lit("")))), "")
    count = lambda k: F.size(F.filter(F.coalesce(F.col(at), empty), lambda m: (m.kind == k) & m.new.isNotNull())).alias(k)
    out = out.withColumn(into, F.struct(*[count(k) for k in kinds]))
    return out.withColumn(text, F.when(F.size(at) > 0, joined).otherwise(F.col(text))).drop(at)
