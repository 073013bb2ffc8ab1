"""PII pseudonyms that keep their format, with DataFrame functions only.

E-mail names, IPv4 addresses, card numbers (Luhn), social security and phone numbers and calendar dates are found in
one pass over the text, validated, and replaced by a keyed Feistel permutation of the values of their format: the
same value becomes the same pseudonym in every document, no two values share one, and whoever has the key can go back
(`reveal`). Letters stay letters of their case and script block, digits digits, separators stay; a card keeps a right check
digit, an address stays an address, a date stays a date of 1700 to 2099, a social security number a valid one (its
permutation is walked until it comes to a valid number, so that it stays a permutation of these), a phone number keeps
its + and the first digit behind it. Cards, phone and social security numbers are permuted as digits and get their separators back, so that all spellings of one number are
linked. Candidates that fail validation stay as they are.

Defined cases: a null text stays null with counts of 0; an empty text stays empty. Repeated rows are treated alike.
All other columns stay; an input column that has the name of a count is replaced by the count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The key of the registered query only; callers of pseudonymise() bring their own.
QUERY_KEY = "key of the registered query"
#: Most steps of a walk: fewer than one in eight of the numbers are not valid, so longer walks do not occur.
WALK = 24
KINDS = ("email", "ip", "date", "ssn", "card", "phone")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,20}"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}|\d{4}/\d{2}/\d{2})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![0-9])"
_NANP = r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4}"
PHONE = rf"(?<![0-9+])(?:{_NANP}|\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{1,4}}(?:[ .-]?\d{{2,4}}){{1,4}})(?![0-9]|\.[0-9])"
ANY = "|".join((EMAIL, IP, DATE, SSN, CARD, PHONE))
#: The 400-year cycle of dates has 189 x 773 days.
FIRST_DAY, DAY_MODULI = "1700-01-01", (189, 773)
#: Character classes that are permuted in themselves: first code point and size.
CLASSES = ((48, 10), (97, 26), (65, 26), (0xE0, 23), (0xC0, 23), (0x3B1, 17), (0x391, 17), (0x430, 32), (0x410, 32))


def _let(x: Column, use) -> Column:
    """use(x) with x computed once, however often and in whatever loop it is used."""
    return F.get(F.transform(F.array(x), use), 0)


def _rounds(a: Column, b: Column, mixed, back: bool) -> Column:
    """Alternating Feistel rounds on (a, b); mixed(part, other, round) is the changed part."""
    order = F.array(*(F.lit(r) for r in (reversed(range(ROUNDS)) if back else range(ROUNDS))))
    step = lambda s, r: F.struct(F.when(r % 2 == 0, mixed(s["a"], s["b"], r, 0)).otherwise(s["a"]).alias("a"), F.when(r % 2 == 1, mixed(s["b"], s["a"], r, 1)).otherwise(s["b"]).alias("b"))
    return F.aggregate(order, F.struct(a.alias("a"), b.alias("b")), step)


def _digest(key: str, kind: str, other: Column, r: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other.cast("string")), 256)


def permute_numbers(a: Column, b: Column, moduli: tuple[int, int], key: str, kind: str, back: bool = False) -> Column:
    """A permutation of all pairs (a, b) below the moduli."""

    def mixed(part, other, r, which):
        value = F.conv(F.substring(_digest(key, kind, other, r), 1, 13), 16, 10).cast("long")
        return F.pmod(part - value if back else part + value, F.lit(moduli[which]).cast("long"))

    return _rounds(a.cast("long"), b.cast("long"), mixed, back)


def _two_bytes(code: Column) -> Column:
    """The character of a code point from 128 to 2047."""
    lead, tail = F.lpad(F.hex(F.floor(code / 64).cast("int") + 0xC0), 2, "0"), F.lpad(F.hex(code % 64 + 0x80), 2, "0")
    return F.decode(F.unhex(F.concat(lead, tail)), "UTF-8")


def permute_text(text: Column, key: str, kind: str, back: bool = False) -> Column:
    """A permutation of all strings with the same classes of characters in the same places."""

    def mixed(part, other, r, which):
        def moved(k, ks):
            c = F.substr(part, k, F.lit(1))
            code = F.ascii(c)  # the code point, also above ASCII
            add = F.conv(F.substr(ks, F.pmod(k - 1, F.lit(31)) * 2 + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for first, size in CLASSES:
                now = F.pmod(code - first - add if back else code - first + add, F.lit(size)) + first
                out = F.when((code >= first) & (code < first + size), F.char(now) if first < 128 else _two_bytes(now)).otherwise(out)
            return out

        every = lambda ks: F.array_join(F.transform(F.sequence(F.lit(1), F.length(part)), lambda k: moved(k, ks)), "")
        return F.when(F.length(part) > 0, _let(_digest(key, kind, other, r), every)).otherwise(part)

    half = F.ceil(F.length(text) / 2).cast("int")
    s = _rounds(F.substr(text, F.lit(1), half), F.substr(text, half + 1, F.length(text)), mixed, back)
    return _let(s, lambda x: F.concat(x["a"], x["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _respaced(text: Column, digits: Column) -> Column:
    """text with its digits replaced by others, in order."""
    return F.array_join(F.zip_with(F.split(text, "[0-9]", -1), F.split(digits, "(?<=[0-9])", -1), lambda a, b: F.concat(a, b)), "")


def _ssn_valid(digits: Column) -> Column:
    return ~digits.rlike(r"^(?:000|666|9)|^\d{3}00|0000$")


def _ssn(text: Column, key: str, back: bool) -> Column:
    """The next valid number of the permutation's cycle."""
    step = lambda d: permute_text(d, key, "ssn", back)
    walk = lambda d, i: F.when((i == 0) | ~_ssn_valid(d), step(d)).otherwise(d)
    return _respaced(text, F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), _digits(text), walk))


def _phone(text: Column, key: str, back: bool) -> Column:
    """Digits but for the first one of the country code; national spellings of +1 numbers are linked to the international one."""
    first = F.when(text.startswith("+"), F.lit(1)).otherwise(F.lit(0))
    digits = lambda d: F.concat(F.substr(d, F.lit(1), first), _let(F.substr(d, first + 1, F.length(d)), lambda x: permute_text(x, key, "phone", back)))
    return _respaced(text, _let(_digits(text), digits))


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    """Luhn's sum, doubling every second digit from the end; doubled_last: beginning with the last."""
    n = F.length(digits)

    def worth(k):
        d = F.substr(digits, n - k, F.lit(1)).cast("int")
        twice = (k % 2 == 0) if doubled_last else (k % 2 == 1)
        return F.when(twice, F.floor(d * 2 / 10).cast("int") + (d * 2) % 10).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda s, x: s + x)


def _card(text: Column, key: str, back: bool) -> Column:
    body = _let(_digits(text), lambda d: permute_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", back))
    return _respaced(text, _let(body, lambda b: F.concat(b, ((_luhn_sum(b, True) * 9) % 10).cast("string"))))


def _ip(text: Column, key: str, back: bool) -> Column:
    o = lambda k: F.get(F.split(text, r"\."), k).cast("long")
    s = permute_numbers(o(0) * 256 + o(1), o(2) * 256 + o(3), (65536, 65536), key, "ip", back)
    return F.concat_ws(".", *(x.cast("string") for p in (s["a"], s["b"]) for x in (F.floor(p / 256).cast("long"), p % 256)))


def _day(text: Column) -> Column:
    """The date of a candidate, null where there is none."""
    iso = F.when(text.rlike(r"^\d{4}"), F.translate(text, "/", "-")).otherwise(F.concat_ws("-", F.substring(text, 7, 4), F.substring(text, 4, 2), F.substring(text, 1, 2)))
    return F.when(text.rlike(rf"^(?:{DATE})$"), F.try_to_date(iso, "yyyy-MM-dd"))


def _date(text: Column, key: str, back: bool) -> Column:
    n = F.datediff(_day(text), F.lit(FIRST_DAY).cast("date"))
    s = permute_numbers(F.floor(n / DAY_MODULI[1]), n % DAY_MODULI[1], DAY_MODULI, key, "date", back)
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * DAY_MODULI[1] + s["b"]).cast("int"))
    out = F.date_format(day, "yyyy-MM-dd")
    sep = F.when(text.contains("/"), F.lit("/")).when(text.contains("."), F.lit(".")).otherwise(F.lit("-"))
    parts = [F.substring(out, *x) for x in ((1, 4), (6, 2), (9, 2))]
    joined = lambda p: F.concat(p[0], sep, p[1], sep, p[2])
    return F.when(text.rlike(r"^\d{4}"), joined(parts)).otherwise(joined(parts[::-1]))


def kind_of(x: Column) -> Column:
    """The kind of a candidate that is valid, else null."""
    days = F.datediff(_day(x), F.lit(FIRST_DAY).cast("date"))
    return (
        F.when(x.contains("@"), F.lit("email"))
        .when(x.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), F.lit("ip"))
        .when(x.rlike(rf"^(?:{DATE})$"), F.when(days.between(0, DAY_MODULI[0] * DAY_MODULI[1] - 1), F.lit("date")))
        .when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(_ssn_valid(_digits(x)), F.lit("ssn")))
        .when(x.rlike(rf"^(?:{CARD})$"), F.when(_let(_digits(x), lambda d: _luhn_sum(d, False)) % 10 == 0, F.lit("card")))
        .when(F.length(_digits(x)).between(7, 15), F.lit("phone"))
    )


def _replaced(x: Column, kind: Column, key: str, back: bool) -> Column:
    at = F.instr(x, "@")
    email = F.concat(permute_text(F.substr(x, F.lit(1), at - 1), key, "email", back), F.substr(x, at, F.length(x)))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", _ip(x, key, back))
        .when(kind == "date", _date(x, key, back))
        .when(kind == "ssn", _ssn(x, key, back))
        .when(kind == "card", _card(x, key, back))
        .when(kind == "phone", _phone(x, key, back))
        .otherwise(x)
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """df with its text replaced, and n_<kind> counts of what was replaced."""
    if not key:
        raise ValueError("a key is required")
    t = F.col(text)
    out = df.withColumn("__found", F.when(t.rlike("[0-9@]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    out = out.withColumn("__found", F.when(F.size("__found") > 0, F.transform("__found", lambda x: F.struct(x.alias("x"), kind_of(x).alias("kind")))))
    new = F.transform("__found", lambda y: _replaced(y["x"], y["kind"], key, back))
    whole = F.array_join(F.zip_with(F.split(t, ANY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    out = out.withColumn(text, F.when(F.col("__found").isNull(), t).otherwise(whole))
    has = lambda kind: F.size(F.filter("__found", lambda y: F.coalesce(y["kind"] == kind, F.lit(False))))
    for kind in KINDS:
        out = out.withColumn(f"n_{kind}", F.when(F.col("__found").isNull(), F.lit(0)).otherwise(has(kind)).cast("long"))
    return out.drop("__found")


def reveal(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The inverse of pseudonymise() for whoever has the key."""
    return pseudonymise(df, key, text, back=True)


def query(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), QUERY_KEY)
