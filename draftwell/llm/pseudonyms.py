"""PII replaced by format-preserving Feistel pseudonyms, with DataFrame operations only.

A found value that passes its validation is written as a list of digits in mixed radices (card digits in base 10,
letters in base 26, octets in base 256, dates as year and day). An alternating Feistel network permutes that list:
in each round one half is shifted, digit by digit, by numbers drawn from SHA-512 over the key, the kind, the round
and the other half. Shifting is invertible whatever the draws, so each kind is permuted within its own valid values;
check digits are computed anew. The key and the value alone decide the pseudonym, so equal values stay linked across
documents and across ways of punctuating them. With ``backwards`` the rounds run in reverse and give the text back.

Kinds: payment cards (13 to 19 digits in one run, or grouped 4-4-4-4 or 4-6-5; Luhn), IBANs (mod 97), social security numbers (assignable ones), phone
numbers (country code, told by the table of codes, with groups of any usual size, or the ten-digit form with separators), IPv4 addresses, dates from 1900 to 2099 (year
first with hyphens, day first with dots, month first with slashes), e-mail addresses (the local part), and secrets
given as ``token = ...`` in any case, of 16 characters or more, with further segments after dots. What fails validation, a version number or a card number off by one, stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import table

ROUNDS = 8
KEY = "draftwell-demonstration-key"
# the order is that of the alternatives at one place; each begins and ends where no longer run of its kind goes on
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])(?:\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?(?:[0-9](?:(?:[ .-][0-9]{2}){4}|(?:[ .-][0-9]{3,4}){2})|[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3})|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9]|-[0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "secret": r"(?<=(?i:token|secret|password|api_key|apikey) ?[=:] ?[\"']?)[A-Za-z0-9_-]{16,}(?:\.[A-Za-z0-9_-]+)*",
}
ANY = "|".join(PATTERNS.values())
# The country codes of one and two digits; all others have three. No code begins another.
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
KINDS = list(PATTERNS)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def feistel(values: Column, bases: Column, kind: str, key: str, backwards: bool = False) -> Column:
    """``values`` (digits, each below the base at its place) permuted; a bijection for every list of bases.

    Even places and odd places are the two halves. A list of one digit has an empty half and is shifted by the key.
    """
    rounds = range(ROUNDS - 1, -1, -1) if backwards else range(ROUNDS)

    def one(state: Column, r: Column) -> Column:
        other = F.filter(state, lambda x, i: (i + r) % 2 == 1)
        draw = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.size(state).cast("string"), F.array_join(other.cast("array<string>"), ",")), 512)
        # a digest serves 18 digits of 28 bits; further digests hang on the first one and a counter
        more = F.transform(F.sequence(F.lit(0), (F.size(state) / 36).cast("int")), lambda b: F.when(b == 0, draw).otherwise(F.sha2(F.concat_ws("|", draw, b.cast("string")), 512)))

        def moved(d: Column) -> Column:
            def step(x: Column, i: Column) -> Column:
                nth = (i / 2).cast("int")
                shift = F.conv(F.get(d, (nth / 18).cast("int")).substr(nth % 18 * 7 + 1, F.lit(7)), 16, 10).cast("bigint")
                goes = x - shift if backwards else x + shift
                return F.when((i + r) % 2 == 0, F.pmod(goes, F.get(bases, i))).otherwise(x)

            return F.transform(state, step)

        return F.get(F.transform(F.array(more), moved), 0)

    order = F.array(*[F.lit(r) for r in rounds])
    return F.aggregate(order, values.cast("array<bigint>"), one)


def _digits(text: Column) -> Column:
    return F.transform(_chars(text), lambda c: c.cast("bigint"))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its 0-9 replaced, from the left, by ``digits``."""
    parts = F.split(shape, "[0-9]", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.get(digits, i - 1).cast("string")).otherwise(F.lit("")), p)), "")


def _luhn_check(body: Column) -> Column:
    """The digit that makes ``body`` + digit pass."""
    n = F.size(body)
    total = _sum(F.transform(body, lambda d, i: F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)))
    return F.pmod(-total, F.lit(10))


def _mod97(text: Column) -> Column:
    codes = F.array_join(F.transform(_chars(text), lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string"))), "")
    return F.aggregate(_chars(codes), F.lit(0).cast("bigint"), lambda a, c: (a * 10 + c.cast("bigint")) % 97)


def _alnum(text: Column) -> tuple[Column, Column]:
    """Values and bases of the characters: digits 10, letters 26 of either case, all else 1."""
    chars = _chars(text)
    values = F.transform(
        chars,
        lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).when(c.rlike("^[a-z]$"), F.ascii(c) - 97).when(c.rlike("^[A-Z]$"), F.ascii(c) - 65).otherwise(0),
    )
    bases = F.transform(chars, lambda c: F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1))
    return values, bases


def _spell(shape: Column, values: Column) -> Column:
    return F.array_join(
        F.zip_with(
            _chars(shape),
            values,
            lambda c, v: F.when(c.rlike("^[0-9]$"), F.char(v + 48)).when(c.rlike("^[a-z]$"), F.char(v + 97)).when(c.rlike("^[A-Z]$"), F.char(v + 65)).otherwise(c),
        ),
        "",
    )


def _permuted_text(text: Column, kind: str, key: str, backwards: bool, hexed: bool = False) -> Column:
    values, bases = _alnum(text)
    if hexed:
        values = F.transform(_digits_hex(text), lambda v: v)
        bases = F.transform(_chars(text), lambda c: F.lit(16))
        new = feistel(values, bases, kind, key, backwards)
        return F.array_join(F.transform(new, lambda v: F.lower(F.hex(v))), "")
    return _spell(text, feistel(values, bases, kind, key, backwards))


def _digits_hex(text: Column) -> Column:
    return F.transform(_chars(text), lambda c: F.conv(c, 16, 10).cast("bigint"))


def _tens(n: Column) -> Column:
    return F.array_repeat(F.lit(10), n)


def _card(m: Column, key: str, back: bool) -> Column:
    digits = _digits(F.regexp_replace(m, "[^0-9]", ""))
    body = F.slice(digits, 1, F.size(digits) - 1)
    new = feistel(body, _tens(F.size(body)), "card", key, back)
    whole = F.get(F.transform(F.array(new), lambda b: F.concat(b, F.array(_luhn_check(b)))), 0)
    return F.when(_luhn_check(body) == F.element_at(digits, -1), _refill(m, whole))


def _iban(m: Column, key: str, back: bool) -> Column:
    tight = F.regexp_replace(m, " ", "")
    land, bban = tight.substr(1, 2), F.substring(tight, 5, 40)
    new = _permuted_text(bban, "iban", key, back)
    made = F.get(
        F.transform(
            F.array(new), lambda b: F.concat(land, F.lpad((F.lit(98) - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b)
        ),
        0,
    )
    # the blanks of the original come back at their places
    spaced = F.when(m.contains(" "), F.rtrim(F.regexp_replace(made, "(.{4})", "$1 "))).otherwise(made)
    good = (_mod97(F.concat(bban, tight.substr(1, 4))) == 1) & F.length(tight).between(15, 34)
    return F.when(good, spaced)


def _ssn(m: Column, key: str, back: bool) -> Column:
    a, g, s = (m.substr(*x).cast("bigint") for x in ((1, 3), (5, 2), (8, 4)))
    good = (a > 0) & (a < 900) & (a != 666) & (g > 0) & (s > 0)
    area = F.when(a > 666, a - 2).otherwise(a - 1)
    new = feistel(F.array(area, g - 1, s - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key, back)
    text = F.get(
        F.transform(
            F.array(new),
            lambda v: F.concat_ws(
                "-",
                F.lpad(F.when(F.get(v, 0) >= 665, F.get(v, 0) + 2).otherwise(F.get(v, 0) + 1).cast("string"), 3, "0"),
                F.lpad((F.get(v, 1) + 1).cast("string"), 2, "0"),
                F.lpad((F.get(v, 2) + 1).cast("string"), 4, "0"),
            ),
        ),
        0,
    )
    return F.when(good, text)


def _phone(m: Column, key: str, back: bool) -> Column:
    # the country code stays, however the digits are grouped, and so does a trunk zero in parentheses; a national number is
    # permuted among numbers of its length
    head = F.regexp_extract(m, rf"^\+(?:{COUNTRY})(?:[ .-]?\(0\))?", 0)
    tail = F.substring(m, F.length(head) + 1, F.length(m))
    digits = _digits(F.regexp_replace(tail, "[^0-9]", ""))
    total = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return F.when(total.between(7, 15), F.concat(head, _refill(tail, feistel(digits, _tens(F.size(digits)), "phone", key, back))))


def _ip(m: Column, key: str, back: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("bigint"))
    tidy = F.array_join(parts.cast("array<string>"), ".") == m
    new = feistel(parts, F.array_repeat(F.lit(256), 4), "ip", key, back)
    return F.when(F.forall(parts, lambda p: p < 256) & tidy, F.array_join(new.cast("array<string>"), "."))


def _date(m: Column, key: str, back: bool) -> Column:
    iso, dots = m.rlike("^....-"), m.contains(".")
    y = F.when(iso, m.substr(1, 4)).otherwise(m.substr(7, 4)).cast("bigint")
    mo = F.when(iso | dots, F.when(iso, m.substr(6, 2)).otherwise(m.substr(4, 2))).otherwise(m.substr(1, 2)).cast("bigint")
    d = F.when(iso, m.substr(9, 2)).when(dots, m.substr(1, 2)).otherwise(m.substr(4, 2)).cast("bigint")
    day = F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, mo, d), F.lit("yyyy-MM-dd")))
    leap = lambda yr: ((yr % 4 == 0) & (yr % 100 != 0)) | (yr % 400 == 0)
    odd = (mo == 2) & (d == 29)
    doy = F.dayofyear(day) - 1 - F.when(leap(y) & (F.dayofyear(day) > 60), 1).otherwise(0)
    usual = feistel(F.array((y - 1900), doy.cast("bigint")), F.array(F.lit(200), F.lit(365)), "date", key, back)
    # 29 February moves among the 49 of them, 1904 to 2096
    rare = feistel(F.array(((y - 1904) / 4).cast("bigint")), F.array(F.lit(49)), "leap day", key, back)

    def written(dt: Column) -> Column:
        return F.when(iso, F.date_format(dt, "yyyy-MM-dd")).when(dots, F.date_format(dt, "dd.MM.yyyy")).otherwise(F.date_format(dt, "MM/dd/yyyy"))

    def of(v: Column) -> Column:
        yr = F.get(v, 0) + 1900
        shift = F.get(v, 1) + F.when(leap(yr) & (F.get(v, 1) >= 59), 1).otherwise(0)
        return written(F.date_add(F.to_date(F.concat(yr.cast("string"), F.lit("-01-01"))), shift.cast("int")))

    common = F.get(F.transform(F.array(usual), of), 0)
    special = F.get(F.transform(F.array(rare), lambda v: written(F.to_date(F.concat((F.get(v, 0) * 4 + 1904).cast("string"), F.lit("-02-29"))))), 0)
    return F.when(y.between(1900, 2099) & day.isNotNull(), F.when(odd, special).otherwise(common))


def _email(m: Column, key: str, back: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(_permuted_text(local, "email", key, back), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str, back: bool) -> Column:
    return F.when(m.rlike("^[0-9a-f]+$"), _permuted_text(m, "hex", key, back, hexed=True)).otherwise(_permuted_text(m, "secret", key, back))


_MAKERS = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card, "secret": _secret}
# what a match is, told from the match alone
_SHAPES = {
    "email": "@",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$",
    "date": r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})$",
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "card": r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^(?:\+[0-9 ().-]+|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})$",
}


def kind_of(match: Column) -> Column:
    """Kind of a matched string; strings of digits that follow ``token =`` count as what they look like."""
    out = None
    for kind, shape in _SHAPES.items():
        out = F.when(match.rlike(shape), kind) if out is None else out.when(match.rlike(shape), kind)
    return out.otherwise("secret")


def pseudonym(match: Column, key: str = KEY, backwards: bool = False) -> Column:
    """The pseudonym of a matched string; null if it fails the validation of its kind."""
    out = None
    for kind in [*_SHAPES, "secret"]:
        made = _MAKERS[kind](match, key, backwards)
        is_ = kind_of(match) == kind
        out = F.when(is_, made) if out is None else out.when(is_, made)
    return out


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, backwards: bool = False) -> DataFrame:
    """``id, text, found`` for every row: the text with its values replaced, and structs (kind, value, pseudonym).

    ``found`` lists the values that passed validation in the order of the text, those that stand for themselves too, ``text`` keeps everything else as it
    was. Null text stays null and has nothing found; repeated rows are all answered; other columns are not read. A very long
    text is matched whole, in time in proportion to its length. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("hits", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ANY), F.lit(0)))
    rows = rows.withColumn("new", F.transform("hits", lambda m: pseudonym(m, key, backwards)))
    pieces = F.split("text", ANY, -1)
    put = lambda i: F.coalesce(F.get(F.col("new"), i - 1), F.get(F.col("hits"), i - 1))
    woven = F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, put(i)).otherwise(F.lit("")), p)), "")
    pairs = F.filter(F.zip_with("hits", "new", lambda a, b: F.struct(kind_of(a).alias("kind"), a.alias("value"), b.alias("pseudonym"))), lambda x: x["pseudonym"].isNotNull())
    return rows.select("id", F.when(F.size("hits") == 0, F.col("text")).otherwise(woven).alias("text"), F.when(F.size("hits") == 0, F.slice(pairs, 1, 0)).otherwise(pairs).alias("found"))


def query(spark, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "text", F.size("found").cast("long").alias("n_replaced"), F.to_json(F.transform("found", lambda x: F.struct(x["kind"], x["pseudonym"]))).alias("pseudonyms"))
