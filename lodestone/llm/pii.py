"""Format-preserving Feistel pseudonyms, with DataFrame functions only.

One pattern finds candidates; each kind has its own validation: payment cards by length and check digit, IBANs by
their remainder, phone numbers by their plan, IPv4 addresses by their octets, dates by the calendar, e-mail addresses
by their shape. A value that passes is permuted by a keyed Feistel network over exactly the values of its format, so
it is replaced by another valid value of that format, two values never meet in one pseudonym, and equal values stay
equal in every document. Check digits are computed anew. A value that fails its validation is ordinary text.

A date's format is its marks, their order and the number of digits of day and month: the days that share these counts
(and the side of 13 on which the day is, beyond which it can't be a month) are permuted among themselves, 29 February
among the leap years. So day-first and month-first dates keep apart, and one day has one pseudonym however written.
IPv4 addresses are permuted among those that `is_ipv4` takes, so private ones are neither changed nor made.

A network works on a pair of numbers (a below m, b below n) for each format: in turn a += F(b) mod m, b += F(a) mod n,
F being a keyed SHA-256. That is a permutation of the m * n pairs, of even or uneven halves, with no cycle walking.

Labelled secrets (access keys, passwords, tokens) have no format to keep valid; each letter and digit is replaced
within its class under a keyed hash of the whole value.

The key comes from the session's `spark.lodestone.pii.secret`, a name that Spark redacts in its configuration. Plans hold
a digest of it; `spark.sql.redaction.string.regex` set to `pii-key-[0-9a-f]+` hides that in explained plans and event logs.

Cases: null stays null, text without a validated value stays as it is, and so does what only looks like an address (more
than 126 labels). All columns are kept, whatever their names; only `text` changes. Repeated rows, and rows that share an
id, change each on its own and alike. Texts of any length are read whole, in time linear in them. An empty table gives
an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import load

#: Years of dates, and rounds of a network.
FIRST_YEAR, YEARS, ROUNDS = 1900, 200, 8

EMAIL = r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,126}[A-Za-z]{2,24}(?![\w-])"
CARD = r"(?<![\d.+-])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-]|\.\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\d-])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?![\d/-]|\.\d)"
SECRET = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?i:(?<![A-Za-z0-9])(?:password|passwd|secret|token|api[_-]?key)\s?[=:]\s?\"?)[A-Za-z0-9_/+.-]{8,}(?<![.])"
#: What a text must hold for ANY to be tried on it.
HINT = r"\d[\d .()/-]{5,}\d|@|AKIA|(?i:passw|secret|token|api.?key)|[A-Z]{2}\d{2}"
ANY = "|".join([EMAIL, SECRET, IBAN, IPV4, SSN, DATE, CARD, PHONE])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value evaluated once, however often it is used (a column expression repeats what it names)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def feistel(a: Column, b: Column, m: Column | int, n: Column | int, key: str, kind: str | Column, use: Callable[[Column, Column], Column]) -> Column:
    """What `use` makes of the keyed permutation of the pairs (a below m, b below n)."""
    label = kind if isinstance(kind, Column) else F.lit(kind)
    wide = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("bigint")
    given = F.struct(wide(a).alias("a"), wide(b).alias("b"), wide(m).alias("m"), wide(n).alias("n"), F.concat(F.lit(f"{key}|"), label, F.lit("|")).alias("k"))

    def rounds(x: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            def mixed(half: Column, most: Column) -> Column:
                h = F.sha2(F.concat(x["k"], i.cast("string"), F.lit("|"), half.cast("string")), 256)
                return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint"), most)

            left = F.when(i % 2 == 0, F.pmod(s["a"] + mixed(s["b"], x["m"]), x["m"])).otherwise(s["a"])
            right = F.when(i % 2 == 1, F.pmod(s["b"] + mixed(s["a"], x["n"]), x["n"])).otherwise(s["b"])
            return F.struct(left.alias("a"), right.alias("b"))

        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), F.struct(x["a"].alias("a"), x["b"].alias("b")), turn)

    return let(let(given, rounds), lambda s: use(s["a"], s["b"]))


def _power(n: Column) -> Column:
    """10**n as a whole number."""
    return F.element_at(F.array(*[F.lit(10**i).cast("bigint") for i in range(19)]), (n + 1).cast("int"))


def digits_permuted(d: Column, key: str, kind: str | Column) -> Column:
    """A string of 2 to 36 digits, permuted among the strings of its length."""
    u = F.floor(F.length(d) / 2).cast("int")
    v = F.length(d) - u
    join = lambda a, b: F.concat(F.lpad(a.cast("string"), u, "0"), F.lpad(b.cast("string"), v, "0"))
    return feistel(F.substr(d, F.lit(1), u), F.substr(d, u + 1, v), _power(u), _power(v), key, kind, join)


def _put_digits(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced in order by `digits`; what stands between them stays."""
    return _filled(F.split(shape, r"\d", -1), F.split(digits, ""))


def _filled(gaps: Column, values: Column) -> Column:
    """Gaps with a value after each but the last."""
    both = F.struct(gaps.alias("g"), values.alias("v"))
    return let(both, lambda s: F.array_join(F.transform(s["g"], lambda g, i: F.concat(g, F.coalesce(F.get(s["v"], i), F.lit("")))), ""))


def luhn_sum(d: Column) -> Column:
    """The weighted digit sum of a number that ends in its check digit."""
    chars = F.reverse(F.split(d, ""))

    def add(s: Column, x: Column) -> Column:
        v = x.cast("int") * (1 + s["i"] % 2)
        return F.struct((s["i"] + 1).alias("i"), (s["t"] + v - F.when(v > 9, 9).otherwise(0)).alias("t"))

    return F.aggregate(chars, F.struct(F.lit(0).alias("i"), F.lit(0).alias("t")), add)["t"]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def card_pseudonym(v: Column, key: str) -> Column:
    """The issuer's digit stays, the check digit is computed; the digits between are permuted."""
    inner = lambda d: digits_permuted(F.substr(d, F.lit(2), F.length(d) - 2), key, F.concat(F.lit("card"), F.substring(d, 1, 1), F.length(d).cast("string")))
    check = lambda head: F.pmod(10 - F.pmod(luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    new = let(let(_digits(v), lambda d: F.concat(F.substring(d, 1, 1), inner(d))), lambda head: F.concat(head, check(head)))
    return _put_digits(v, new)


def is_card(v: Column) -> Column:
    d = _digits(v)
    return F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1*$") & (F.pmod(luhn_sum(d), F.lit(10)) == 0)


def _iban_mod(v: Column) -> Column:
    """The remainder by 97 of country code and check digits moved to the end, letters as 10 to 35."""
    s = F.concat(F.substring(v, 5, 40), F.substring(v, 1, 4))
    step = lambda acc, c: F.when(c.rlike(r"\d"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97).cast("int")
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def iban_pseudonym(v: Column, key: str) -> Column:
    """Country, bank code letters and spacing stay; digits after the check digits are permuted, these computed anew."""
    c = F.replace(v, F.lit(" "), F.lit(""))
    body = F.substring(c, 5, 40)
    new = _put_digits(body, let(_digits(body), lambda d: F.when(F.length(d) >= 2, digits_permuted(d, key, "iban")).otherwise(d)))
    check = lambda x: F.lpad((98 - _iban_mod(F.concat(F.substring(c, 1, 2), F.lit("00"), x))).cast("string"), 2, "0")
    plain = let(new, lambda x: F.concat(F.substring(c, 1, 2), check(x), x))
    return _filled(F.split(v, "[A-Z0-9]", -1), F.split(plain, ""))


def phone_pseudonym(v: Column, key: str) -> Column:
    """The country code and first digit stay, so that the plan does; the other digits are permuted."""
    head = F.regexp_extract(v, r"^(\+\d{1,3}(?=[ .(-])[ .-]?\(?\d|\+\d{2}|\(?\d)", 1)
    rest = F.substr(v, F.length(head) + 1)
    return F.concat(head, _put_digits(rest, digits_permuted(_digits(rest), key, F.concat(F.lit("phone"), _digits(head)))))


def ipv4_pseudonym(v: Column, key: str) -> Column:
    o = F.split(v, r"\.")
    n = lambda i: F.get(o, i).try_cast("bigint")
    # First octets 1 to 223 but 10 and 127 are numbered 0 to 220; of the first two octets' pairs 192.168 is left out.
    first = n(0) - 1 - F.when(n(0) > 127, 2).when(n(0) > 10, 1).otherwise(0)
    out = 189 * 256 + 168
    pair = first * 256 + n(1)
    part = lambda x: x.cast("string")

    def address(a: Column, b: Column) -> Column:
        pair = a + F.when(a >= out, 1).otherwise(0)
        first = F.floor(pair / 256)
        return F.concat_ws(".", part(first + 1 + F.when(first >= 125, 2).when(first >= 9, 1).otherwise(0)), part(F.pmod(pair, F.lit(256))), part(F.floor(b / 256)), part(F.pmod(b, F.lit(256))))

    return feistel(pair - F.when(pair > out, 1).otherwise(0), n(2) * 256 + n(3), 221 * 256 - 1, 65536, key, "ipv4", address)


def is_ipv4(v: Column) -> Column:
    return v.rlike(r"^([1-9]|[1-9]\d|1\d\d|2[01]\d|22[0-3])(\.(\d|[1-9]\d|1\d\d|2[0-4]\d|25[0-5])){3}$") & ~v.rlike(r"^(127\.|10\.|192\.168\.)")


def ssn_pseudonym(v: Column, key: str) -> Column:
    """Area 001-665 or 667-899, group 01-99, serial 0001-9999, permuted among these."""
    n = lambda i, k: F.substring(v, i, k).try_cast("bigint")
    area = n(1, 3)
    area = area - F.when(area > 666, 2).otherwise(1)
    two = lambda x, k: F.lpad(x.cast("string"), k, "0")
    number = lambda a, b: F.concat_ws("-", two(a + F.when(a >= 665, 2).otherwise(1), 3), two(F.floor(b / 9999) + 1, 2), two(F.pmod(b, F.lit(9999)) + 1, 4))
    return feistel(area, (n(5, 2) - 1) * 9999 + n(8, 4) - 1, 898, 99 * 9999, key, "ssn", number)


def is_ssn(v: Column) -> Column:
    return v.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def _date_of(v: Column) -> Column:
    """The day a date names: ISO, or day/month (month/day where only that is a day) with slashes or dots."""
    p = F.split(v, "[/.]")
    two = lambda i: F.lpad(F.get(p, i), 2, "0")
    named = lambda d, m: F.try_to_date(F.concat_ws("-", F.get(p, 2), two(m), two(d)), "yyyy-MM-dd")
    return F.when(v.contains("-"), F.try_to_date(v, "yyyy-MM-dd")).otherwise(F.coalesce(named(0, 1), named(1, 0)))


def is_date(v: Column) -> Column:
    return F.coalesce(F.year(_date_of(v)).between(FIRST_YEAR, FIRST_YEAR + YEARS - 1), F.lit(False))


#: Days after the 12th of each month but 29 February: 165 of January to September, 56 of the rest.
_LATE = (19, 16, 19, 18, 19, 18, 19, 19, 18, 19, 18, 19)


def date_pseudonym(v: Column, key: str) -> Column:
    """Another day with as many digits of day and month, written as the date is; 29 February among 49 leap years."""
    before = F.array(*[F.lit(sum(_LATE[9 if i >= 9 else 0 : i])) for i in range(12)])
    p = F.split(v, "[/.-]")
    mark = F.regexp_extract(v, "[/.-]", 0)
    as_wide = lambda x, like: F.lpad(x.cast("string"), F.length(like), "0")

    def written(day: Column, month: Column, year: Column) -> Column:
        month_first = F.get(p, 1).try_cast("int") > 12
        one, two = F.when(month_first, month).otherwise(day), F.when(month_first, day).otherwise(month)
        slashed = F.concat_ws("", as_wide(one, F.get(p, 0)), mark, as_wide(two, F.get(p, 1)), mark, year.cast("string"))
        iso = F.concat_ws("-", year.cast("string"), as_wide(month, F.lit("00")), as_wide(day, F.lit("00")))
        return F.when(F.length(F.get(p, 0)) == 4, iso).otherwise(slashed)

    def permuted(x: Column) -> Column:
        d, m, y = x["d"], x["m"], x["y"]
        leap, late, autumn = (d == 29) & (m == 2), d > 12, m > 9
        d0, dn = F.when(d > 9, 10).otherwise(1), F.when(d > 9, 3).otherwise(9)
        m0, mn = F.when(autumn, 10).otherwise(1), F.when(autumn, 3).otherwise(9)
        cycle = F.floor((y - 1904) / 4)
        a = F.when(leap, F.floor(cycle / 7)).when(late, F.element_at(before, m) + d - 13).otherwise((m - m0) * dn + d - d0)
        most = F.when(leap, 7).when(late, F.when(autumn, 56).otherwise(165)).otherwise(dn * mn)
        b = F.when(leap, F.pmod(cycle, F.lit(7))).otherwise(y - FIRST_YEAR)
        kind = F.when(leap, "leap").otherwise(F.concat(F.when(late, "late").otherwise(d0.cast("string")), F.lit("-"), m0.cast("string")))

        def new_date(a: Column, b: Column) -> Column:
            # The late day's month is the last whose days begin at or before its number.
            begun = lambda months: sum((F.when(a >= sum(_LATE[months[0] : i]), 1).otherwise(0) for i in months[1:]), F.lit(months[0] + 1))
            month = F.when(leap, 2).when(late, F.when(autumn, begun((9, 10, 11))).otherwise(begun(tuple(range(9))))).otherwise(m0 + F.floor(a / dn)).cast("int")
            year = F.when(leap, 1904 + 4 * (a * 7 + b)).otherwise(b + FIRST_YEAR)
            return let(month, lambda w: written(F.when(leap, 29).when(late, a - F.element_at(before, w) + 13).otherwise(d0 + F.pmod(a, dn)), w, year))

        return feistel(a, b, most, F.when(leap, 7).otherwise(YEARS), key, F.concat(F.lit("date"), kind), new_date)

    return let(_date_of(v), lambda day: let(F.struct(F.dayofmonth(day).alias("d"), F.month(day).alias("m"), F.year(day).alias("y")), permuted))


def chars_permuted(v: Column, key: str, kind: str) -> Column:
    """Each ASCII letter and digit shifted within its class by a keyed stream drawn from the value's other half.

    Two halves in a Feistel network over strings: each round shifts one half's characters by a hash of the other.
    """
    alphabets = (("0123456789", r"\d"), ("abcdefghijklmnopqrstuvwxyz", "[a-z]"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[A-Z]"))

    def shifted(s: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 512)

        def moved(stream: Column) -> Column:
            def one(c: Column, at: Column) -> Column:
                step = F.conv(F.substr(stream, F.pmod(at * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int") + at
                out = c
                for letters, cls in alphabets:
                    place = F.pmod(F.instr(F.lit(letters), c) - 1 + step, F.lit(len(letters)))
                    out = F.when(c.rlike(f"^{cls}$"), F.substr(F.lit(letters), place.cast("int") + 1, F.lit(1))).otherwise(out)
                return out

            return F.array_join(F.transform(F.split(s, ""), one), "")

        return let(stream, moved)

    half = F.floor(F.length(v) / 2).cast("int")

    def turn(s: Column, i: Column) -> Column:
        a = F.when(i % 2 == 0, shifted(s["a"], s["b"], i)).otherwise(s["a"])
        b = F.when(i % 2 == 1, shifted(s["b"], s["a"], i)).otherwise(s["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    start = F.struct(F.substr(v, F.lit(1), half).alias("a"), F.substr(v, half + 1).alias("b"))
    return let(F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn), lambda done: F.concat(done["a"], done["b"]))


def email_pseudonym(v: Column, key: str) -> Column:
    """Local part and domain labels are permuted within their characters; the top-level domain stays."""
    parts = F.split(F.lower(v), "@")
    domain = F.get(parts, 1)
    top = F.element_at(F.split(domain, r"\."), -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.concat(chars_permuted(F.get(parts, 0), key, "mail"), F.lit("@"), chars_permuted(host, key, "host"), F.lit("."), top)


def secret_pseudonym(v: Column, key: str) -> Column:
    head = F.regexp_extract(v, r"^(AKIA|(?i:(?:password|passwd|secret|token|api[_-]?key)\s?[=:]\s?\"?))", 1)
    return F.concat(head, chars_permuted(F.substr(v, F.length(head) + 1), key, "secret"))


def pseudonym(v: Column, key: str) -> Column:
    """What replaces a candidate: the pseudonym of the first kind that it is valid for, else itself."""
    return (
        F.when(v.rlike(r"^[A-Za-z0-9][^@\s=:\"]*@[^@]*$"), email_pseudonym(v, key))
        .when(v.rlike(r"^(AKIA[A-Z0-9]{16}$|(?i:password|passwd|secret|token|api))"), secret_pseudonym(v, key))
        .when(v.rlike(r"^[A-Z]{2}\d{2}"), F.when((_iban_mod(F.replace(v, F.lit(" "), F.lit(""))) == 1) & F.substring(v, 3, 2).between("02", "98"), iban_pseudonym(v, key)).otherwise(v))
        .when(v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(is_ipv4(v), ipv4_pseudonym(v, key)).otherwise(v))
        .when(v.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(is_ssn(v), ssn_pseudonym(v, key)).otherwise(v))
        .when(v.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})$"), F.when(is_date(v), date_pseudonym(v, key)).otherwise(v))
        .when(v.startswith("+") | v.startswith("(") | v.rlike(r"^\d{3}-\d{3}-\d{4}$"), F.when(F.length(_digits(v)).between(9, 15), phone_pseudonym(v, key)).otherwise(v))
        .when(F.coalesce(is_card(v), F.lit(False)), card_pseudonym(v, key))
        .otherwise(v)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with every validated value in `text` replaced; all columns and rows kept."""
    hidden = "pii-key-" + hashlib.sha256(key.encode()).hexdigest()
    t = F.col(f"`{text}`").cast("string")
    found = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    joined = _filled(F.split(t, ANY, -1), F.transform(found, lambda v: pseudonym(v, hidden)))
    return docs.select(*[F.when(t.rlike(HINT), joined).otherwise(t).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def session_key(spark: SparkSession) -> str:
    """The session's key; the queries' own, which is public, only where it names none."""
    return spark.conf.get("spark.lodestone.pii.secret", "lodestone")


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return pseudonymise(docs, session_key(spark)).select("doc_id", "text")
