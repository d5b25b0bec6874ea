"""Format-preserving pseudonyms for personal data.

Each value is found by its format, validated, and replaced by a keyed permutation of its
format: the pseudonym has the same length, separators and check digits, and equal values
have equal pseudonyms in all documents, so links survive while the values are gone.

The permutation is an alternating Feistel network over the two halves of a value, as in FF1:
each round adds a keyed hash of one half to the other, modulo the number of values that
half can take.  Every round is a bijection, so the whole is one, on exactly the pairs of
halves: strings of one length and alphabet, valid social security numbers, days.  Rounds
are keyed by SHA-256 over key, kind, format and round.

Found and validated:

* card numbers of the known issuers' lengths, Luhn valid: 12 to 19 digits in one group, in the
  groups cards are printed in (4-4-4-4, 4-4-4-4-3, 4-6-5, 4-6-4), or in any groups of three or
  more digits that stand by themselves; a space or hyphen between groups.  Every run of digits
  is tried from each of its groups on, the longest number first, so other digits before or
  behind hide nothing.  The first two digits and the separators stay, the check digit is made anew;
* international bank account numbers of the length their country gives them, valid modulo 97;
  country, letters and layout stay;
* dates that exist and lie in the 65536 days from 1900-01-01: year first with hyphens or
  slashes, day first with dots or slashes, month first with slashes where the day is above 12,
  and written ones with an English month; the day number is permuted;
* phone numbers with a country code or an area code in parentheses; country code and
  separators stay; social security numbers of valid ranges, permuted among those;
* IPv4 addresses with numbers to 255, permuted as 32-bit numbers;
* e-mail addresses: letters and digits of the part before the @ are permuted, class by class;
* credentials: access-key ids, and values of password, token, secret or key assignments.

All of it is DataFrame expressions; text without a digit or @ is passed through.  No pattern
repeats a group without a bound, so texts of any length are safe to match, and the work on
a text grows with its length and its matches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY = "1900-01-01"
DAYS = 65536
#: Symbols that one Feistel network takes; longer strings are cut, and each piece is keyed by its place.
PIECE = 16
#: Groups of digits that one card number may have.
GROUPS = 6

# Lengths of international bank account numbers by country (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
# Leading digits and lengths of card numbers by issuer.
CARD = r"^(?:4\d{12}(?:\d{3}){0,2}|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3[0689]\d{12}(?:\d\d)?|35\d{14}|(?:50|5[6-9]|6\d)\d{10,17})$"
PRINTED = ("4,4,4,4,3", "4,4,4,4", "4,6,5", "4,6,4")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_SECRETS = "password|passwd|pwd|secret|token|api_?key|access_key"


def _iban() -> str:
    """Each country's code with as many characters as it has, in groups of four with or without spaces."""
    forms = []
    for length, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        forms.append(f"(?:{countries.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(forms)})(?![A-Za-z0-9])"


#: Kind and pattern, the first that matches at a place counts.  Patterns are Java's; none has a capturing group.
KINDS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,16}[A-Za-z]{2,63}"),
    ("secret", rf"(?<![A-Za-z])(?i:{_SECRETS}) ?[=:] ?[\"']?[A-Za-z0-9_+/-]{{8,}}+"),
    ("access", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", _iban()),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"),
    ("ymd", r"(?<![\d-])(?:19|20)\d\d(?:-[01]\d-[0-3]\d|/[01]\d/[0-3]\d)(?![\d-])"),
    ("dmy", r"(?<![\d.])(?:[0-3]\d\.[01]\d\.|[0-3]\d/[0-3]\d/)(?:19|20)\d\d(?![\d.]?\d)"),
    ("written", rf"(?<![\dA-Za-z])(?:[0-3]?\d (?:{MONTHS})|(?:{MONTHS}) [0-3]?\d,) (?:19|20)\d\d(?!\d)"),
    ("phone", r"(?<![\dA-Za-z])\+(?:1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-]?)\d{3}[ .-]?\d{4}|(?!1)\d{1,3}[ -]?(?:\(\d{1,4}\)|\d{1,4})(?:[ -]?\d{2,4}){1,4})(?!\d)"),
    ("area", r"(?<![\dA-Za-z])\(\d{3}\) ?\d{3}-\d{4}(?!\d)"),
    ("ssn", r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"),
    ("group", r"(?<![\dA-Za-z])\d{3,19}(?![\dA-Za-z])"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hash(key: str, kind: str, *parts: Column) -> Column:
    """60 bits of SHA-256."""
    text = F.concat_ws(":", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel_pair(a: Column, a_size: Column, b: Column, b_size: Column, key: str, kind: str, tweak: Column) -> Column:
    """Keyed permutation of the pairs ``(a, b)`` with a below ``a_size`` and b below ``b_size``: a struct of both."""

    def turn(acc: Column, r: Column) -> Column:
        odd = r % 2 == 1
        new = F.pmod(F.when(odd, acc["b"]).otherwise(acc["a"]) + _hash(key, kind, tweak, r, F.when(odd, acc["a"]).otherwise(acc["b"])), F.when(odd, b_size).otherwise(a_size))
        return let(new, lambda x: F.struct(F.when(odd, acc["a"]).otherwise(x).alias("a"), F.when(odd, x).otherwise(acc["b"]).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def feistel(symbols: Column, key: str, kind: str, base: int = 10, place: Column | None = None) -> Column:
    """Keyed permutation of a string of digits in ``base`` (to 36, lower case), within its length (at most ``PIECE``)."""

    def one(s: Column) -> Column:
        n = F.length(s)
        u = F.floor(n / 2).cast("int")
        power = lambda k: F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(PIECE // 2 + 1)]), (k + 1).cast("int"))
        number = lambda x: F.coalesce(F.conv(x, base, 10).cast("long"), F.lit(0).cast("long"))
        text = lambda x, width: F.when(width == 0, "").otherwise(F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), width, "0"))
        tweak = F.concat_ws(".", F.lit(str(base)), n.cast("string"), (F.lit(0) if place is None else place).cast("string"))
        pair = feistel_pair(number(F.substring(s, F.lit(1), u)), power(u), number(F.substring(s, u + 1, n)), power(n - u), key, kind, tweak)
        return F.when(n == 0, s).otherwise(let(pair, lambda p: F.concat(text(p["a"], u), text(p["b"], n - u))))

    return let(symbols, one)


def long_feistel(symbols: Column, key: str, kind: str, base: int = 10) -> Column:
    """``feistel`` for any length, ``PIECE`` symbols at a time, each piece keyed by its place."""

    def cut(s: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / PIECE).cast("int"))
        return F.when(F.length(s) <= PIECE, feistel(s, key, kind, base)).otherwise(F.array_join(F.transform(pieces, lambda i: feistel(F.substring(s, i * PIECE + 1, F.lit(PIECE)), key, kind, base, i)), ""))

    return let(symbols, cut)


def _into(shape: Column, wanted: str, new: Column) -> Column:
    """``shape`` (a short string) with its characters of the class ``wanted`` replaced in turn by those of ``new``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        fits = c.rlike(f"^{wanted}$")
        return F.struct(F.concat(acc["out"], F.when(fits, F.substring(new, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + fits.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step)["out"]


def _only(s: Column, wanted: str) -> Column:
    return F.regexp_replace(s, f"[^{wanted}]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of digits whose last one is the check digit."""
    double = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)

    def add(acc: Column, i: Column) -> Column:
        return acc + let(F.substring(digits, -i, F.lit(1)).cast("int"), lambda d: F.when(i % 2 == 0, double(d)).otherwise(d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def _mod97(rearranged: Column) -> Column:
    """Value modulo 97 of an account number with its head moved to the end (letters count 10 to 35)."""

    def add(acc: Column, c: Column) -> Column:
        return let(F.conv(c, 36, 10).cast("int"), lambda v: F.pmod(F.when(v < 10, acc * 10).otherwise(acc * 100) + v, F.lit(97)))

    return F.aggregate(F.filter(F.split(rearranged, ""), lambda c: c != ""), F.lit(0), add)


_LETTERS, _AS_DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"


def _letters(s: Column, key: str, kind: str) -> Column:
    """At most ``PIECE`` letters permuted as digits in base 26; upper case stays where it is."""
    moved = F.translate(feistel(F.translate(F.lower(s), _LETTERS, _AS_DIGITS), key, kind, 26), _AS_DIGITS, _LETTERS)
    at = lambda x, i: F.substring(x, i, F.lit(1))
    cased = let(moved, lambda m: F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(at(s, i).rlike("[A-Z]"), F.upper(at(m, i))).otherwise(at(m, i))), ""))
    return F.when(s == F.lower(s), moved).otherwise(cased)


def _mixed(s: Column, key: str, kind: str) -> Column:
    """Digits permuted among the digits and letters among the letters, ``PIECE`` characters at a time; all else stays."""

    def piece(text: Column, i: Column) -> Column:
        digits = feistel(_only(text, "0-9"), key, kind, 10, i)
        inner = let(digits, lambda d: _into(text, "[0-9]", d))
        return let(inner, lambda x: let(_letters(_only(x, "A-Za-z"), key, kind), lambda new: _into(x, "[A-Za-z]", new)))

    pieces = F.sequence(F.lit(0), F.floor((F.greatest(F.length(s), F.lit(1)) - 1) / PIECE).cast("int"))
    return F.array_join(F.transform(pieces, lambda i: let(F.substring(s, i * PIECE + 1, F.lit(PIECE)), lambda text: piece(text, i))), "")


def card_pseudonym(digits: Column, key: str) -> Column:
    """Digits of another card of the issuer: the first two stay, the others but the last are permuted, the last is the check digit."""
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 2), long_feistel(F.substring(digits, F.lit(3), n - 3), key, "card"))
    return let(body, lambda b: F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def _day(text: Column, pattern: str) -> Column:
    return F.datediff(F.to_date(F.try_to_timestamp(text, F.lit(pattern))), F.lit(FIRST_DAY).cast("date"))


def _date(text: Column, key: str, *patterns: str) -> Column:
    """The date moved, written by the first pattern that reads it; null where none does or the day is out of range."""

    def moved(day: Column, pattern: str) -> Column:
        pair = feistel_pair(F.floor(day / 256), F.lit(256), day % 256, F.lit(256), key, "date", F.lit(""))
        new = let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * 256 + p["b"]).cast("int")))
        return F.when((day >= 0) & (day < DAYS), F.date_format(new, pattern))

    def read(pattern: str) -> Column:
        return let(_day(text, pattern), lambda day: moved(day, pattern))

    return F.coalesce(*map(read, patterns))


def _ssn(digits: Column, key: str) -> Column:
    """Another number of the valid ones: areas 001 to 899 without 666, groups from 01, serials from 0001."""
    area = F.substring(digits, 1, 3).cast("int")
    rank = (area - 1 - (area > 666).cast("int")) * 99 + F.substring(digits, 4, 2).cast("int") - 1
    pair = feistel_pair(rank, F.lit(898 * 99), F.substring(digits, 6, 4).cast("int") - 1, F.lit(9999), key, "ssn", F.lit(""))

    def written(p: Column) -> Column:
        low = F.floor(p["a"] / 99) + 1
        parts = (low + (low >= 666).cast("int"), 3), (p["a"] % 99 + 1, 2), (p["b"] + 1, 4)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), width, "0") for x, width in parts])

    return let(pair, written)


def _account(value: Column, key: str) -> Column:
    """Another account in the country: digits permuted, letters stay, new check digits; null where they are wrong."""

    def remade(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        moved = _into(account, "[0-9]", long_feistel(_only(account, "0-9"), key, "iban"))
        new = let(moved, lambda m: F.concat(country, F.lpad((98 - _mod97(F.concat(m, country, F.lit("00")))).cast("string"), 2, "0"), m))
        return F.when(_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1, let(new, lambda n: _into(value, "[A-Z0-9]", n)))

    return let(F.regexp_replace(value, " ", ""), remade)


def _phone(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, r"^(?:\+1|\+\d{1,3})?", 0)
    tail = F.substring(value, F.length(head) + 1, F.length(value))
    return F.concat(head, let(long_feistel(_only(tail, "0-9"), key, "phone"), lambda new: _into(tail, "[0-9]", new)))


def _address(value: Column, key: str) -> Column:
    octet = lambda i: F.get(F.split(value, r"\."), F.lit(i)).cast("int")
    pair = feistel_pair(octet(0) * 256 + octet(1), F.lit(65536), octet(2) * 256 + octet(3), F.lit(65536), key, "ip", F.lit(""))
    return let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for half in (p["a"], p["b"]) for x in (F.floor(half / 256), half % 256)]))


def _hidden(value: Column, key: str) -> Column:
    named = F.regexp_extract(value, r"^[A-Za-z_]+ ?[=:] ?[\"']?", 0)
    return let(F.substring(value, F.length(named) + 1, F.length(value)), lambda v: F.concat(named, F.when(v.rlike("^[0-9a-f]++$"), long_feistel(v, key, "hex", 16)).otherwise(_mixed(v, key, "secret"))))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a matched value that is no group of digits; the value itself where validation fails.

    The kind follows from the characters at fixed places, as the patterns are told apart by them.
    """
    first, has = F.substring(value, 1, 1), lambda c: F.contains(value, F.lit(c))
    second = F.substring(value, 3, 1)  # of dd.mm.yyyy and dd/mm/yyyy
    local = F.substring_index(value, "@", 1)
    access = F.concat(F.substring(value, 1, 4), F.upper(long_feistel(F.lower(F.substring(value, F.lit(5), F.length(value))), key, "access", 36)))
    numeric = first.rlike("[0-9]")
    found = (
        F.when(has("@"), F.concat(_mixed(local, key, "email"), F.substring(value, F.length(local) + 1, F.length(value))))
        .when(first.isin("+", "("), _phone(value, key))
        .when(has(" ") & value.rlike(MONTHS), F.when(numeric, _date(value, key, "d MMMM yyyy")).otherwise(_date(value, key, "MMMM d, yyyy")))
        .when(numeric & (F.length(value) == 11) & (F.substring(value, 4, 1) == "-"), _ssn(_only(value, "0-9"), key))
        .when(numeric & (F.substring(value, 5, 1) == "-"), _date(value, key, "yyyy-MM-dd"))
        .when(numeric & (F.substring(value, 5, 1) == "/"), _date(value, key, "yyyy/MM/dd"))
        .when(numeric & (second == "/"), _date(value, key, "dd/MM/yyyy", "MM/dd/yyyy"))
        .when(numeric & (second == ".") & (F.length(value) == 10) & ~value.rlike(r"\..*\..*\."), _date(value, key, "dd.MM.yyyy"))
        .when(numeric, _address(value, key))
        .when(has("=") | has(":"), _hidden(value, key))
        .when(value.rlike("^A[KS]IA[A-Z0-9]{16}$"), access)
        .otherwise(_account(value, key))
    )
    return F.coalesce(found, value)


def _cards(found: Column, gaps: Column) -> Column:
    """For each matched value, how many of them from it on are one card number (0 for none).

    ``gaps`` has the text before the first value and after each.
    """
    is_group = lambda v: F.translate(v, "0123456789", "") == ""
    next_to = lambda i: F.get(gaps, i).isin(" ", "-") & is_group(F.get(found, i)) & is_group(F.get(found, i - 1)) & (i > 0)

    def number(i: Column, k: Column) -> Column:
        """Whether the k groups from i on are a card number."""

        def valid(groups: Column, digits: Column) -> Column:
            printed = F.array_join(F.transform(groups, lambda g: F.length(g).cast("string")), ",").isin(*PRINTED)
            alone = ~F.coalesce(next_to(i), F.lit(False)) & ~F.coalesce(next_to(i + k), F.lit(False))
            joined = F.forall(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda m: (k == 1) | F.coalesce(next_to(i + m), F.lit(False)))
            # the cheap conditions first: the others are not evaluated where these fail
            return F.length(digits).between(12, 19) & digits.rlike(CARD) & ((k == 1) | (joined & (printed | alone))) & (_luhn(digits) == 0)

        return let(F.slice(found, i + 1, k), lambda groups: let(F.array_join(groups, ""), lambda digits: valid(groups, digits)))

    def longest(v: Column, i: Column) -> Column:
        may = is_group(v) & ((F.length(v) >= 12) | F.coalesce(next_to(i + 1), F.lit(False)))
        sizes = F.filter(F.sequence(F.lit(GROUPS), F.lit(1), F.lit(-1)), lambda k: (i + k <= F.size(found)) & number(i, k))
        return F.when(may, F.coalesce(F.get(sizes, F.lit(0)), F.lit(0))).otherwise(0)

    return F.transform(found, longest)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", replaced: str = "n_replaced") -> DataFrame:
    """The input's columns with personal data in ``text`` replaced, and ``n_replaced`` (an input column of that name gives way).

    Null text stays null with 0 replacements; text without personal data is unchanged, byte
    for byte.  Repeated rows give equal results, an empty table an empty one.  A group of
    digits that two card numbers share takes its new digits from the first.
    """
    found, gaps, cards, new = (f"pii_{uuid.uuid4().hex}" for _ in range(4))
    keep = [c for c in docs.columns if c.lower() != replaced.lower()]
    some = F.col(text).rlike(rf"[0-9@]|(?i:{_SECRETS})")
    step = docs.select(*[F.col(f"`{c}`") for c in keep], F.when(some, F.regexp_extract_all(F.col(text), F.lit(f"({PATTERN})"), F.lit(1))).alias(found))
    step = step.withColumn(gaps, F.when(F.size(found) > 0, F.split(F.col(text), PATTERN, -1)))
    step = step.withColumn(cards, F.when(F.size(found) > 0, _cards(F.col(found), F.col(gaps))))

    def value(v: Column, i: Column) -> Column:
        before = F.filter(F.sequence(F.greatest(i - (GROUPS - 1), F.lit(0)), i), lambda s: F.get(cards, s) > i - s)

        def of(start: Column) -> Column:
            skipped = F.when(start < i, F.length(F.array_join(F.slice(found, start + 1, F.greatest(i - start, F.lit(1))), ""))).otherwise(0)
            number = card_pseudonym(F.array_join(F.slice(found, start + 1, F.get(cards, start)), ""), key)
            return F.struct(F.substring(number, skipped + 1, F.length(v)).alias("new"), (start == i).cast("long").alias("n"))

        other = let(pseudonym(v, key), lambda p: F.struct(p.alias("new"), (p != v).cast("long").alias("n")))
        is_group = F.translate(v, "0123456789", "") == ""
        return F.when(~is_group, other).otherwise(let(F.get(before, F.lit(0)), lambda start: F.when(start.isNull(), F.struct(v.alias("new"), F.lit(0).cast("long").alias("n"))).otherwise(of(start))))

    step = step.withColumn(new, F.transform(F.col(found), value))
    joined = F.concat(F.element_at(gaps, 1), F.array_join(F.transform(F.col(new), lambda v, i: F.concat(v["new"], F.element_at(gaps, i + 2))), ""))
    count = F.aggregate(F.col(new), F.lit(0).cast("long"), lambda acc, v: acc + v["n"])
    out = {c: F.col(f"`{c}`") for c in keep} | {text: F.when(F.size(found) > 0, joined).otherwise(F.col(text))}
    return step.select(*[v.alias(k) for k, v in out.items()], F.coalesce(F.when(F.size(found) > 0, count), F.lit(0).cast("long")).alias(replaced))


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """One row per input row: doc_id, text (pseudonymised), n_replaced."""
    return pseudonymised(docs.select("doc_id", F.col("text").cast("string").alias("text")), key)
