"""Personal data as format-preserving pseudonyms, with DataFrame functions only.

Numbers and dates that pass their own validation (check digits, ranges, the calendar) are permuted by a keyed Feistel
network over exactly the values that are valid in their format. Equal values get equal pseudonyms in every document, no
two values of a format share one, and the holder of the key can go back. Mail addresses keep their domain; the name part,
which has no fixed format, becomes a keyed digest.

A Feistel network over a product of two ranges, a x b: a value is a pair (l, r); rounds add, by turns, a keyed hash of r
to l modulo a, and of l to r modulo b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Fixed patterns. They need no match before or after of a longer number or word.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){1,5}(?!\w)"
NANP = r"(?<![\w.+-])(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.-])[2-9]\d{2}[.-]\d{4}(?![\w-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
DATE_YMD = r"(?<![\w./-])\d{4}([-/.])\d{1,2}\1\d{1,2}(?![\w/-])"
DATE_DMY = r"(?<![\w./-])\d{1,2}([-/.])\d{1,2}\1\d{4}(?![\w/-])"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"

KINDS = ("email", "date", "ssn", "phone", "ip", "iban", "card")


def _candidates() -> str:
    return "|".join([EMAIL, DATE_YMD, DATE_DMY.replace(r"\1", r"\2"), SSN, NANP, PHONE, IPV4, IBAN, CARD])


def feistel(l: Column, r: Column, a: Column, b: Column, key: str, kind: Column | str, back: bool = False) -> Column:  # noqa: E741
    """The pair ``(l, r)``, 0 <= l < a and 0 <= r < b, permuted (or, with ``back``, the other way) as ``struct<l, r>``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    a, b = a.cast("long"), b.cast("long")

    def noise(i: Column, half: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), kind, a.cast("string"), b.cast("string"), i.cast("string"), half.cast("string"), F.lit(key))
        return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        by = F.when(even, noise(i, s.r) % a).otherwise(noise(i, s.l) % b)
        by = -by if back else by
        return F.struct(F.when(even, F.pmod(s.l + by, a)).otherwise(s.l).alias("l"), F.when(even, s.r).otherwise(F.pmod(s.r + by, b)).alias("r"))

    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, rounds)), F.struct(l.cast("long").alias("l"), r.cast("long").alias("r")), step)


def digits_permuted(digits: Column, key: str, kind: Column | str, back: bool = False) -> Column:
    """A string of 2 to 30 digits as another of the same length."""
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")

    def made(d: Column) -> Column:
        n = F.length(d)
        half = (n / 2).cast("int")
        s = feistel(F.substr(d, F.lit(1), half), F.substr(d, half + 1), size(half), size(n - half), key, kind, back)
        return let(s, lambda s: F.concat(F.lpad(s.l.cast("string"), half, "0"), F.lpad(s.r.cast("string"), n - half, "0")))

    return let(digits, made)


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a number whose last digit counts single."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """A string of digits and capital letters (A is 10, ..., Z is 35), read as a number, modulo 97."""

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c)))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by those of ``digits``."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s.out, F.when(is_digit, F.substr(digits, s.k, F.lit(1))).otherwise(c)).alias("out"),
            F.when(is_digit, s.k + 1).otherwise(s.k).alias("k"),
        )

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")), put, lambda s: s.out)


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _parts(x: Column, names: str) -> Column:
    """The first runs of digits, as numbers: a struct of one field for each letter of ``names``."""
    runs = F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0))
    return let(runs, lambda r: F.struct(*[F.element_at(r, i + 1).cast("long").alias(n) for i, n in enumerate(names)]))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def _card(x: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = digits_permuted(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        check = lambda b: ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")
        return F.when(_luhn_sum(d) % 10 == 0, let(body, lambda b: _refill(x, F.concat(b, check(b)))))

    return let(_only_digits(x), made)


def _ssn(x: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        valid = (p.a >= 1) & (p.a <= 899) & (p.a != 666) & (p.b >= 1) & (p.c >= 1)
        left = (p.a - F.when(p.a > 666, 2).otherwise(1)) * 99 + p.b - 1
        return F.when(valid, let(feistel(left, p.c - 1, F.lit(898 * 99), F.lit(9999), key, "ssn"), shown))

    def shown(s: Column) -> Column:
        area = (s.l / 99).cast("long")
        return F.format_string("%03d-%02d-%04d", area + F.when(area >= 665, 2).otherwise(1), s.l % 99 + 1, s.r + 1)

    return let(_parts(x, "abc"), made)


def _ip(x: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        valid = (p.a <= 255) & (p.b <= 255) & (p.c <= 255) & (p.d <= 255)
        return F.when(valid, let(feistel(p.a * 256 + p.b, p.c * 256 + p.d, F.lit(65536), F.lit(65536), key, "ip"), shown))

    def shown(s: Column) -> Column:
        return F.format_string("%d.%d.%d.%d", F.shiftright(s.l, 8), s.l % 256, F.shiftright(s.r, 8), s.r % 256)

    return let(_parts(x, "abcd"), made)


def _nanp(x: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        return let(feistel((p.a - 200) * 800 + p.b - 200, p.c, F.lit(640_000), F.lit(10_000), key, "nanp"), shown)

    def shown(s: Column) -> Column:
        return _refill(x, F.format_string("%03d%03d%04d", (s.l / 800).cast("long") + 200, s.l % 800 + 200, s.r))

    return let(_parts(x, "abc"), made)


def _phone(x: Column, key: str) -> Column:
    """A plus sign and 7 to 15 digits: the country code, one digit for 1 and 7 and two for others, stays."""

    def made(d: Column) -> Column:
        code = F.when(d.rlike("^[17]"), 1).otherwise(2)
        kept = F.substr(d, F.lit(1), code)
        new = F.concat(kept, digits_permuted(F.substr(d, code + 1), key, F.concat(F.lit("phone"), kept)))
        return F.when((F.length(d) >= 7) & (F.length(d) <= 15), _refill(x, new))

    return let(_only_digits(x), made)


def _iban(x: Column, key: str) -> Column:
    """Letters stay; the account's digits are permuted and the check digits made anew."""

    def made(s: Column) -> Column:
        body, land = F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(2))
        digits = _only_digits(body)
        valid = (_mod97(F.concat(body, F.substr(s, F.lit(1), F.lit(4)))) == 1) & (F.length(s) >= 15) & (F.length(s) <= 34) & (F.length(digits) >= 2)
        shape = F.concat(F.lit("iban"), land, F.regexp_replace(body, "[0-9]", "0"))
        check = lambda new: F.lpad((98 - _mod97(F.concat(_refill(body, new), land, F.lit("00")))).cast("string"), 2, "0")
        return F.when(valid, let(digits_permuted(digits, key, shape), lambda new: _refill(x, F.concat(check(new), new))))

    return let(F.regexp_replace(x, " ", ""), made)


def _date(x: Column, key: str) -> Column:
    """A day of 1900 to 2099 becomes another of the same century, written alike.

    Day first or month first, where strokes leave it open, is read as month first if that is a date. A date that can
    only be read day first stays so (the permutation is repeated until it is), so that no two dates share a pseudonym.
    """
    stroke, ymd = x.contains("/"), x.rlike("^[0-9]{4}")

    def read(p: Column) -> Column:
        month_first = stroke & ~ymd & (p.a <= 12)
        year = F.when(ymd, p.a).otherwise(p.c)
        month = F.when(ymd | ~month_first, p.b).otherwise(p.a)
        day = F.when(ymd, p.c).otherwise(F.when(month_first, p.b).otherwise(p.a))
        order = F.when(ymd, "ymd").when(month_first, "mdy").when(stroke, "day first").otherwise("dmy")
        real = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
        return let(F.struct(real.alias("day"), order.alias("order")), moved)

    def moved(p: Column) -> Column:
        late = F.year(p.day) >= 2000  # 36,524 = 92 x 397 days from 1900, 36,525 = 75 x 487 from 2000
        wide, height = F.when(late, 487).otherwise(397), F.when(late, 75).otherwise(92)
        start = F.when(late, F.lit("2000-01-01")).otherwise(F.lit("1900-01-01")).cast("date")
        on = lambda n: F.date_add(start, n.cast("int"))
        once = lambda n: let(feistel((n / wide).cast("long"), n % wide, height, wide, key, "date"), lambda s: s.l * wide + s.r)
        again = lambda n, _: F.when(F.dayofmonth(on(n)) > 12, n).otherwise(once(n))
        first = once(F.datediff(p.day, start).cast("long"))
        new = F.when(p.order == "day first", F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, again)).otherwise(first)
        valid = p.day.isNotNull() & (F.year(p.day) >= 1900) & (F.year(p.day) <= 2099)
        return F.when(valid, let(on(new), lambda d: shown(d, p.order)))

    def shown(d: Column, order: Column) -> Column:
        mark, was = F.regexp_extract(x, "([-/.])", 1), F.split(x, "[-/.]")
        text = lambda f, i: F.lpad(f(d).cast("string"), F.when((F.length(F.element_at(was, i)) > 1) | (f(d) > 9), 2).otherwise(1), "0")
        year, month, day = F.year(d).cast("string"), F.month, F.dayofmonth
        return (
            F.when(order == "ymd", F.concat(year, mark, text(month, 2), mark, text(day, 3)))
            .when(order == "mdy", F.concat(text(month, 1), mark, text(day, 2), mark, year))
            .otherwise(F.concat(text(day, 1), mark, text(month, 2), mark, year))
        )

    return let(_parts(x, "abc"), read)


def _email(x: Column, key: str) -> Column:
    name = F.lower(F.substring_index(x, "@", 1))
    domain = F.lower(F.substring_index(x, "@", -1))
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), name, domain, F.lit(key)), 256), 1, 16), F.lit("@"), domain)


def _replaced(x: Column, key: str) -> Column:
    """``struct<kind, text>`` of a candidate; kind null and the text as it was where validation fails."""
    tests = (
        ("email", x.contains("@"), _email(x, key)),
        ("phone", x.startswith("+"), _phone(x, key)),
        ("iban", x.rlike("^[A-Z]"), _iban(x, key)),
        ("ssn", x.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(x, key)),
        ("date", x.rlike(r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$"), _date(x, key)),
        ("ip", x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), _ip(x, key)),
        ("phone", x.rlike(r"^(\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}$"), _nanp(x, key)),
    )
    new, kind = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for name, test, made in tests:
        new, kind = new.when(test, made), kind.when(test, F.lit(name))
    new, kind = new.otherwise(_card(x, key)), kind.otherwise(F.lit("card"))
    return F.struct(kind.alias("kind"), new.alias("new"), x.alias("old"))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and a column ``pii`` of counts by kind, ``map<string, int>``.

    Found are mail addresses, IPv4 addresses, telephone numbers (international, or in North American form with valid
    area and exchange), IBANs (modulo 97), US social security numbers (valid ranges), dates of 1900 to 2099 and card
    numbers (13 to 19 digits, Luhn). What fails its validation stays. Whole texts are searched, of any length. A null
    text stays null, an empty one empty, both with an empty map. Rows that repeat come out alike, each. An empty table
    gives no rows. All other columns stay; one named ``pii`` is replaced. Addresses that differ in case alone are one, so
    their domains come out in lower case; dates stay within their century. The key is a literal of the plan: whoever may
    see plans and event logs of the job sees it, so run it where they are as secret as the key.
    """
    text = F.col(text_col)
    pattern = _candidates()
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: _replaced(x, key))
    some = text.rlike(r"@|[0-9][^\p{L}]{0,4}[0-9]|[0-9]{2}") & text.rlike(pattern)
    # the columns in between have names that no table has by chance, and go again
    pieces, made = "__pii_pieces", "__pii_made"
    df = docs.withColumn(made, F.when(some, found)).withColumn(pieces, F.when(some, F.split(text, pattern, -1)))
    joined = F.concat(
        F.element_at(pieces, 1),
        F.array_join(F.transform(made, lambda m, i: F.concat(F.coalesce(m.new, m.old), F.element_at(F.col(pieces), i + 2))), ""),
    )
    count = lambda k: F.size(F.filter(made, lambda m: (m.kind == k) & m.new.isNotNull()))
    counts = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*map(count, KINDS)))
    counts = F.map_filter(F.coalesce(counts, F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*[F.lit(0)] * len(KINDS)))), lambda _, n: n > 0)
    return df.withColumn(text_col, F.coalesce(joined, text)).withColumn("pii", counts).drop(pieces, made)
