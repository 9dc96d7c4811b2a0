"""Format-preserving pseudonyms: validated personal values are permuted by a keyed Feistel network, in Spark SQL functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8  # even, so both halves end where they began
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Leading digits of area codes and exchanges keep to their class.
HIGH, LOW, NONZERO = "23456789", "01", "123456789"

#: The part before the @ has 64 characters at most (so the standard for addresses has it); of a longer run the last
#: words that fit are taken. Groups without end are possessive, so that a match needs neither stack nor a second try.
EMAIL = r"\b[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
IP = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
DATE = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b|\b\d{1,2}\.\d{1,2}\.\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
#: Length of an IBAN -> countries; others are taken at any length.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Groups of four behind country and check digits, a space before each or not."""
    known = "|".join(" ".join(IBANS.values()).split())
    sized = [
        f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
        for n, c in IBANS.items()
    ]
    return rf"\b(?:{'|'.join(sized)}|(?!{known})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)\b"


IBAN = _iban_pattern()
#: Card numbers as they are written, longest first, and those in any groups.
CARDS = [rf"\b\d{{4}}{x}\d{{4}}{x}\d{{4}}{x}\d{{4}}{x}\d{{3}}\b" for x in " -"]
CARDS += [rf"\b\d{{4}}{x}\d{{4}}{x}\d{{4}}{x}\d{{4}}\b" for x in " -"]
CARDS += [rf"\b\d{{4}}{x}\d{{6}}{x}\d{{{n}}}\b" for n in (5, 4) for x in " -"] + [r"\b\d{13,19}\b"]
CARD = r"\b\d(?:[ \-]?\d){12,18}\b"
#: All that stands together from 13 digits on, and an IBAN with the digits behind it; no part of a mail address.
_NO_MAIL = r"(?![A-Za-z0-9._%+\-]{0,64}+@)"
RUN = rf"\b(?=\d(?:[ .\-/]*\d){{12}})\d[\d .\-/]*\d\b{_NO_MAIL}"
IBAN_RUN = rf"{IBAN}(?:[ .\-/][\d .\-/]*\d\b|){_NO_MAIL}"
PHONE = r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\b\d{3}[ .\-])\d{3}[ .\-]\d{4}\b|\+\d{1,3}(?:[ .\-]?\(?\d{2,4}\)?){2,5}\b"
SECRET = r"""\b(?:[Pp]assword|[Pp]asswd|[Ss]ecret|[Tt]oken|[Aa]pi[_\-]?[Kk]ey) ?[:=] ?["']?[A-Za-z0-9_\-/+]{8,}"""
PLAIN_PHONE = r"\b\d{3}[ .\-]\d{3}[ .\-]\d{4}\b"
ANY = "|".join((EMAIL, SECRET, RUN, IBAN_RUN, IP, DATE, SSN, PHONE))
#: What may stand inside such a run, in the order in which it is tried at each of its words.
INSIDE = [("iban", IBAN), *(("card", x) for x in CARDS), ("ip", IP), ("date", DATE), ("ssn", SSN), ("phone", PLAIN_PHONE)]
#: Words of a run that one of them has at most, and the fewest characters of a run.
INSIDE_WORDS, LEAST_RUN = 9, 13
_FIRST = rf"^(?:{'|'.join(p for _, p in INSIDE)})"
#: Words of a run that are gone through together, so that no list grows a word at a time.
WORDS_AT_ONCE = 256
#: Halves longer than this enter the hash as a digest.
LONG_HALF = 64
#: Every value holds one of these.
HINT = "[0-9@=:]"

FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
#: Those days are 17 x 4297 in number.
DAYS = (17, 4297)


def feistel(values: Column, sizes: Column, kind: str, key: str) -> Column:
    """A keyed permutation of the number lists with ``0 <= values[i] < sizes[i]``.

    The list is cut in two; each round adds a hash of one half (of a long one's digest), element by element and modulo
    the sizes, to the other. Every round can be undone, so different lists stay different.
    """
    half = F.floor(F.size(values) / 2).cast("int")
    rest = F.size(values) - half

    def part(x: Column, right: bool) -> Column:
        return F.slice(x, half + 1, rest) if right else F.slice(x, F.lit(1), half)

    start = F.struct(
        part(values, False).alias("l"), part(values, True).alias("r"), part(sizes, False).alias("m"), part(sizes, True).alias("n")
    )

    def round_(s: Column, i: Column) -> Column:
        joined = F.concat_ws(",", s["r"].cast("array<string>"))
        other = F.when(F.size(s["r"]) > LONG_HALF, F.sha2(joined, 256)).otherwise(joined)

        def shifted(other: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), j.cast("string"), other), 256)
                return F.pmod(x + F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.get(s["m"], j))

            return F.transform(s["l"], one)

        return F.struct(s["r"].alias("l"), _let(other, shifted).alias("r"), s["n"].alias("m"), s["m"].alias("n"))

    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, round_, lambda s: F.concat(s["l"], s["r"]))


def _symbols(text: Column, alphabet_of) -> Column:
    """Characters as (alphabet, place in it)."""
    named = F.transform(_chars(text), lambda c, i: F.struct(c.alias("c"), alphabet_of(c, i).alias("a")))
    return F.transform(
        named, lambda x: F.struct(x["a"].alias("a"), (F.call_function("instr", x["a"], x["c"]) - 1).cast("long").alias("v"))
    )


def _permuted(symbols: Column, kind: str, key: str) -> Column:
    """The symbols' text after the permutation."""
    values = F.transform(symbols, lambda x: x["v"])
    sizes = F.transform(symbols, lambda x: F.length(x["a"]).cast("long"))
    moved = F.zip_with(symbols, feistel(values, sizes, kind, key), lambda x, v: F.call_function("substring", x["a"], (v + 1).cast("int"), F.lit(1)))
    return F.array_join(moved, "")


def _refill(shape: Column, wanted: str, filling: Column) -> Column:
    """``shape`` with its characters of the class ``wanted`` replaced in order by those of ``filling``."""

    def merged(chars: Column) -> Column:
        numbered = F.transform(chars, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
        fits = lambda x: x["c"].rlike(f"[{wanted}]")
        filled = F.zip_with(F.filter(numbered, fits), _chars(filling), lambda x, c: F.struct(x["i"].alias("i"), c.alias("c")))
        return F.array_join(F.transform(F.array_sort(F.concat(filled, F.filter(numbered, lambda x: ~fits(x)))), lambda x: x["c"]), "")

    return _let(_chars(shape), merged)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _by_class(c: Column, i: Column) -> Column:
    return F.when(c.rlike("[0-9]"), F.lit(DIGITS)).when(c.rlike("[a-z]"), F.lit(LOWER)).otherwise(F.lit(UPPER))


def _digit_sum(digits: Column) -> Column:
    """Luhn sum of a digit text whose last digit counts once."""
    chars = F.reverse(_chars(digits))

    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(chars, worth), F.lit(0), lambda a, b: a + b)


def luhn(text: Column) -> Column:
    return _digit_sum(F.regexp_replace(text, "[^0-9]", "")) % 10 == 0


def _card(m: Column, key: str) -> Column:
    """All digits but the last are permuted, a leading digit other than 0 stays so; the last makes it valid again."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.call_function("substring", digits, F.lit(1), F.length(digits) - 1)
    first = lambda c, i: F.when((i == 0) & (c != "0"), F.lit(NONZERO)).when(i == 0, F.lit("0")).otherwise(F.lit(DIGITS))
    moved = _permuted(_symbols(body, first), "card", key)
    check = F.pmod(-_digit_sum(F.concat(moved, F.lit("0"))), F.lit(10))
    return _refill(m, "0-9", F.concat(moved, check.cast("string")))


def _mod97(text: Column) -> Column:
    chars = _chars(text)

    def step(a: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + letter) % 97)

    return F.aggregate(chars, F.lit(0), step)


def iban_valid(text: Column) -> Column:
    plain = F.regexp_replace(text, " ", "")
    n = F.length(plain)
    turned = F.concat(F.call_function("substring", plain, F.lit(5), n), F.substring(plain, 1, 4))
    return n.between(15, 34) & (_mod97(turned) == 1)


def _iban(m: Column, key: str) -> Column:
    """The account part is permuted by character class; the country stays and the check digits are made anew."""
    plain = F.regexp_replace(m, " ", "")
    account = _permuted(_symbols(F.call_function("substring", plain, F.lit(5), F.length(plain)), _by_class), "iban", key)
    country = F.substring(plain, 1, 2)
    check = F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))
    return _refill(m, "A-Z0-9", F.concat(country, F.lpad(check.cast("string"), 2, "0"), account))


def _phone(m: Column, key: str) -> Column:
    """The last ten digits (all after the country code) are permuted; those that lead an area code or an exchange
    stay among 2-9 or among 0-1."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    head = F.greatest(F.length(digits) - 10, F.when(m.startswith("+"), F.lit(1)).otherwise(F.lit(0)))
    local = F.call_function("substring", digits, head + 1, F.lit(20))
    lead = lambda c, i: (
        F.when(~i.isin(0, 3), F.lit(DIGITS)).when(c.rlike("[01]"), F.lit(LOW)).otherwise(F.lit(HIGH))
    )
    moved = _permuted(_symbols(local, lead), "phone", key)
    return _refill(m, "0-9", F.concat(F.call_function("substring", digits, F.lit(1), head), moved))


def _ssn_parts(m: Column) -> list[Column]:
    return [F.get(F.split(m, "-"), i).cast("long") for i in range(3)]


def ssn_valid(m: Column) -> Column:
    area, group, serial = _ssn_parts(m)
    return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)


def _ssn(m: Column, key: str) -> Column:
    """Permuted among the valid areas (1-899 without 666), groups (1-99) and serials (1-9999)."""
    area, group, serial = _ssn_parts(m)
    values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
    sizes = F.array(*[F.lit(x).cast("long") for x in (898, 99, 9999)])

    def shown(x: Column) -> Column:
        area = F.get(x, 0) + F.when(F.get(x, 0) >= 665, 2).otherwise(1)
        parts = zip((area, F.get(x, 1) + 1, F.get(x, 2) + 1), (3, 2, 4))
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])

    return F.get(F.transform(F.array(feistel(values, sizes, "ssn", key)), shown), 0)


def _octets(m: Column) -> Column:
    return F.split(m, r"\.").cast("array<bigint>")


def ip_valid(m: Column) -> Column:
    return F.forall(_octets(m), lambda x: x < 256)


def _ip(m: Column, key: str) -> Column:
    sizes = F.array_repeat(F.lit(256).cast("long"), 4)
    return F.concat_ws(".", feistel(_octets(m), sizes, "ip", key).cast("array<string>"))


def _date_of(m: Column) -> Column:
    """ISO dates, month/day/year (or day/month/year where the first number is over 12) and day.month.year."""
    parts = F.split(m, "[-/.]")
    a, b, c = (F.get(parts, i) for i in range(3))
    iso = F.concat_ws("-", a, b, c)
    slashed = F.when(a.cast("int") > 12, F.concat_ws("-", c, b, a)).otherwise(F.concat_ws("-", c, a, b))
    dotted = F.concat_ws("-", c, b, a)
    return F.call_function(
        "try_to_date", F.when(m.contains("-"), iso).when(m.contains("/"), slashed).otherwise(dotted), F.lit("yyyy-M-d")
    )


def date_valid(m: Column) -> Column:
    return F.coalesce(_date_of(m).between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), F.lit(False))


def _date(m: Column, key: str) -> Column:
    """Permuted among all days of 1900 to 2099, written in the same order, with leading zeros if there were any
    or if the number was of two digits."""
    first = F.lit(FIRST_DAY).cast("date")
    day = F.datediff(_date_of(m), first).cast("long")
    n = F.lit(DAYS[1]).cast("long")
    sizes = F.array(*[F.lit(x).cast("long") for x in DAYS])
    moved = feistel(F.array(F.floor(day / n).cast("long"), day % n), sizes, "date", key)
    short = F.split(m, "[-/.]")
    day_first = F.get(short, 0).cast("int") > 12

    def shown(x: Column) -> Column:
        date = F.date_add(first, (F.get(x, 0) * n + F.get(x, 1)).cast("int"))
        d = F.lpad(F.dayofmonth(date).cast("string"), 2, "0")
        mo = F.lpad(F.month(date).cast("string"), 2, "0")
        y = F.year(date).cast("string")
        slash = F.when(day_first, F.concat_ws("/", d, mo, y)).otherwise(F.concat_ws("/", mo, d, y))
        return F.when(m.contains("-"), F.concat_ws("-", y, mo, d)).when(m.contains("/"), slash).otherwise(F.concat_ws(".", d, mo, y))

    return F.get(F.transform(F.array(moved), shown), 0)


def _email(m: Column, key: str) -> Column:
    """Letters and digits before the @ are permuted by class; the domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    moved = _permuted(_symbols(F.regexp_replace(local, "[^A-Za-z0-9]", ""), _by_class), "email", key)
    return F.concat(_refill(local, "A-Za-z0-9", moved), F.lit("@"), domain)


def _secret(m: Column, key: str) -> Column:
    """The value after the name: hexadecimal digits stay such, else letters and digits keep their class."""
    value = F.regexp_extract(m, "[A-Za-z0-9_\\-/+]+$", 0)
    name = F.call_function("substring", m, F.lit(1), F.length(m) - F.length(value))

    def moved(plain: Column) -> Column:
        def by(hexadecimal: Column) -> Column:
            alphabet = lambda c, i: F.when(hexadecimal, F.lit(HEX)).otherwise(_by_class(c, i))
            return _permuted(_symbols(plain, alphabet), "secret", key)

        return _let(plain.rlike("^[0-9a-f]+$"), by)

    return F.concat(name, _refill(value, "A-Za-z0-9", _let(F.regexp_replace(value, "[^A-Za-z0-9]", ""), moved)))


def kind_of(m: Column) -> Column:
    """Kind of a matched value; null for one that is not valid as a whole."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(whole(EMAIL), "email")
        .when(whole(SECRET), "secret")
        .when(whole(IP), F.when(ip_valid(m), F.lit("ip")))
        .when(whole(DATE), F.when(date_valid(m), F.lit("date")))
        .when(whole(SSN), F.when(ssn_valid(m), F.lit("ssn")))
        .when(whole(IBAN), F.when(iban_valid(m), F.lit("iban")))
        .when(whole("|".join(CARDS)) & luhn(m), "card")
        .when(whole(PHONE), "phone")
    )


PIECES = "array<struct<b:string,m:string,k:string>>"
VALID = {"iban": iban_valid, "card": luhn, "ip": ip_valid, "date": date_valid, "ssn": ssn_valid}


def _let(value: Column, function) -> Column:
    """``function`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), function), 0)


def running_sums(numbers: Column) -> Column:
    """Each number plus all before it: in round s every sum takes in that of the place 2^s before it."""

    def step(sums: Column, s: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), s)
        moved = F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - back), F.lit(0).cast("long")))
        return F.when(back < F.size(sums), moved).otherwise(sums)

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), numbers, step)


def _piece(before: Column, m: Column, kind: Column) -> Column:
    return F.struct(before.alias("b"), m.alias("m"), kind.cast("string").alias("k"))


def _first_valid(window: Column) -> Column:
    """The first kind of ``INSIDE`` with a valid value at the beginning of the text; null if there is none."""
    tried = F.array(*[F.struct(F.lit(k).alias("k"), F.regexp_extract(window, f"^(?:{p})", 0).alias("m")) for k, p in INSIDE])

    def valid(x: Column) -> Column:
        return (x["m"] != "") & reduce(lambda out, k: out.when(x["k"] == k, VALID[k](x["m"])), VALID, F.when(F.lit(False), F.lit(True))).otherwise(True)

    return F.get(F.filter(tried, valid), 0)


def _loose_cards(p: Column) -> Column:
    """A piece whose text before may hold card numbers in groups of any size."""
    gaps, found = F.split(p["b"], CARD, -1), F.regexp_extract_all(p["b"], F.lit(CARD), F.lit(0))
    cards = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda b, m: _piece(b, m, F.when(luhn(m), F.lit("card"))))
    rest = F.array(_piece(F.element_at(gaps, -1), p["m"], p["k"]))
    return F.when(p["b"].rlike(CARD), F.concat(cards, rest).cast(PIECES)).otherwise(F.array(p).cast(PIECES))


def inside(run: Column) -> Column:
    """Pieces (text before, value, kind) of a run: at each word in turn the first valid kind, which may begin inside
    of what is not valid, then card numbers in any groups between them."""
    hits_kind = "array<struct<i:int,n:int,m:string,k:string>>"

    def at(words: Column, i: Column) -> Column:
        window = F.array_join(F.slice(words, i + 1, F.lit(INSIDE_WORDS)), "")
        found = lambda w: F.when(w.rlike(_FIRST), _first_valid(w))
        return F.struct(i.alias("i"), _let(window, found).alias("x"))

    def taken(s: Column, c: Column) -> Column:
        n = F.size(F.split(c["x"]["m"], "[^A-Z0-9]+"))
        hit = F.struct(c["i"].alias("i"), n.alias("n"), c["x"]["m"].alias("m"), c["x"]["k"].alias("k"))
        longer = F.struct((c["i"] + n).alias("next"), F.concat(s["hits"], F.array(hit)).cast(hits_kind).alias("hits"))
        return F.when(c["i"] >= s["next"], longer).otherwise(s)

    def hits(words: Column) -> Column:
        tried = F.filter(F.transform(words, lambda _, i: at(words, i)), lambda c: c["x"].isNotNull())

        def chosen(tried: Column) -> Column:
            none = F.array().cast(hits_kind)
            start = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{hits_kind}>").alias("hits"))

            def some(s: Column, a: Column) -> Column:
                own = F.aggregate(F.slice(tried, a, F.lit(WORDS_AT_ONCE)), F.struct(s["next"].alias("next"), none.alias("hits")), taken)
                more = lambda x: F.struct(x["next"].alias("next"), F.concat(s["hits"], F.array(x["hits"])).alias("hits"))
                return _let(own, more)

            firsts = F.sequence(F.lit(1), F.greatest(F.size(tried), F.lit(1)), F.lit(WORDS_AT_ONCE))
            return F.aggregate(firsts, start, some, lambda s: F.flatten(s["hits"]))

        return _let(tried, chosen)

    def pieces(words: Column, found: Column) -> Column:
        def before(j: Column, end: Column) -> Column:
            last = F.get(found, j - 1)
            first = F.coalesce(last["i"] + last["n"], F.lit(0))
            gap = F.regexp_extract(F.get(words, first - 1), "[^A-Z0-9]*$", 0)
            return F.concat(F.coalesce(gap, F.lit("")), F.array_join(F.slice(words, first + 1, end - first), ""))

        parts = F.transform(found, lambda h, j: _piece(before(j, h["i"]), h["m"], h["k"]))
        rest = F.array(_piece(before(F.size(found), F.size(words)), F.lit(""), F.lit(None)))
        return F.flatten(F.transform(F.concat(parts, rest), _loose_cards))

    words = F.regexp_extract_all(run, F.lit("[A-Z0-9]+[^A-Z0-9]*"), F.lit(0))
    return _let(words, lambda w: _let(hits(w), lambda h: pieces(w, h)))


MAKERS = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban, "card": _card, "phone": _phone}


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return reduce(lambda out, k: out.when(kind == k, MAKERS[k](m, key)), MAKERS, F.when(F.lit(False), m)).otherwise(m)


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with personal values in ``column`` replaced, and ``pii`` (kind, start, pseudonym) of each (``pii_`` if
    there is a column of that name).

    Values: card numbers (Luhn), IBANs (mod 97), social security numbers, IP addresses, dates, phone numbers,
    e-mail addresses and values after password or token names. The same value gives the same pseudonym in every
    document whatever its spacing, under one ``key`` (kept by the caller); lengths and formats stay, except that
    an IP address may change its length. Values that fail their check are left, but what is valid inside of them or
    beside them is found (see :func:`inside`). ``start`` counts code points of the new text from 0. A null text stays null
    with no values. Other columns stay; rows are independent, so skew, order and repeats do not matter.
    """
    kind = "array<struct<kind:string,start:int,value:string>>"
    listed_as = "pii"
    while listed_as in docs.columns:
        listed_as += "_"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(column).alias("old"))
    guarded = F.when(F.col("old").rlike(HINT), F.regexp_extract_all("old", F.lit(ANY), F.lit(0)))
    found = rows.withColumn("found", F.when(F.size(guarded) > 0, guarded))
    between = F.when(F.col("found").isNotNull(), F.split("old", ANY, -1))
    named = F.transform("found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("k")))
    cut = found.withColumns({"named": named, "between": between})
    whole = F.zip_with("between", "named", lambda b, x: _piece(b, F.coalesce(x["m"], F.lit("")), x["k"]))

    def searched(p: Column) -> Column:
        again = p["k"].isNull() & (F.length(p["m"]) >= LEAST_RUN)
        first = F.array(_piece(p["b"], F.lit(""), F.lit(None)))
        return F.when(again, F.concat(first, inside(p["m"])).cast(PIECES)).otherwise(F.array(p).cast(PIECES))

    cut = cut.withColumn("whole", whole).withColumn("parts", F.flatten(F.transform("whole", searched)))
    made = F.transform(
        "parts", lambda p: F.struct(p["b"].alias("b"), p["k"].alias("kind"), pseudonym(p["m"], p["k"], key).alias("value"))
    )
    cut = cut.withColumn("pieces", made)
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["b"], p["value"])), "")

    # bound by a lambda: a column used once would be computed anew for every piece
    ends = running_sums(F.transform("pieces", lambda p: (F.length(p["b"]) + F.length(p["value"])).cast("long")))

    def placed(ends: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            first = (F.get(ends, i) - F.length(p["value"])).cast("int")
            return F.struct(p["kind"].alias("kind"), first.alias("start"), p["value"].alias("value"))

        return F.transform("pieces", one)

    numbered = _let(ends, placed)
    listed = F.filter(numbered, lambda x: x["kind"].isNotNull())
    return cut.select(
        *[(F.coalesce(text, F.col("old")) if c == column else F.col("row").getField(c)).alias(c) for c in docs.columns],
        F.coalesce(listed, F.array().cast(kind)).alias(listed_as),
    )
