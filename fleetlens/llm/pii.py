"""Format-preserving pseudonyms for private values, by keyed Feistel permutations.

A value is found by its pattern and taken only if it is valid: card numbers by their check digit,
addresses by their octets, dates by the calendar, phone numbers by their number of digits. Its characters are permuted within their own
alphabets: the halves of the value take turns, and each character of one half moves on by an
amount that a keyed hash of the other half gives. So a pseudonym has the value's format, equal
values have equal pseudonyms in all documents, and the key leads back. Only built-in functions run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns of a Feistel permutation; even, so that both halves move equally often.
ROUNDS = 6
#: Dates move within 1900-01-01 to 2099-12-31, a grid of 17 by 4297 days.
FIRST_DAY, DAY_GRID = "1900-01-01", (17, 4297)

_DIGITS, _HEX, _HEX_UPPER = "0123456789", "0123456789abcdef", "0123456789ABCDEF"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Runs of letters beyond ASCII, each permuted within itself: Latin, Greek, Cyrillic, Hebrew, Arabic,
#: Devanagari, Thai, Hiragana, Katakana, Han, Hangul. Other letters become ASCII ones.
LETTER_RUNS = [
    (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3AC, 0x3CE), (0x400, 0x481),
    (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE30), (0x3041, 0x3096), (0x30A1, 0x30FA),
    (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]

# Every pattern starts behind a character that cannot be part of a value, so that a long run of
# such characters is looked through once and not from each of its places.
PATTERNS = {
    # A domain has 127 labels at most; without a bound the search would go one call deeper for each.
    "email": r"(?<![A-Za-z0-9._%+\-\p{L}\p{M}])[A-Za-z0-9._%+\-\p{L}\p{M}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){0,125}\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "date": r"(?<![0-9A-Za-z./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?!(?!T[0-9])[0-9A-Za-z/\-]|\.[0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+]|[0-9][.\-])(?:\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}"
    r"|\+[1-9][0-9]{0,2}(?:[ .\-]?\([0-9]{1,4}\))?(?:[ .\-]?[0-9]){5,12}"
    r"|(?:1[ .\-])?(?:\([2-9][0-9]{2}\)[ .\-]?|[2-9][0-9]{2}[ .\-])[0-9]{3}[ .\-][0-9]{4})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])",
}
KINDS = list(PATTERNS)
ANY = "|".join(PATTERNS.values())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _feistel(left: Column, right: Column, move: Callable, inverse: bool, join: Callable) -> Column:
    """join(left, right) after all turns; move(half, other, turn, sign, side) gives a half's successor."""
    sign = -1 if inverse else 1

    def play(turn: int) -> Callable[[Column], Column]:
        def one(s: Column) -> Column:
            if turn % 2 == 0:
                return F.struct(move(s["l"], s["r"], turn, sign, 0).alias("l"), s["r"].alias("r"))
            return F.struct(s["l"].alias("l"), move(s["r"], s["l"], turn, sign, 1).alias("r"))

        return one

    state = F.array(F.struct(left.alias("l"), right.alias("r")))
    for turn in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        state = F.transform(state, play(turn))
    return F.element_at(F.transform(state, lambda s: join(s["l"], s["r"])), 1)


def _amount(digest: Column, place: Column, digits: int) -> Column:
    """A number from the hexadecimal digits of `digest` that belong to a place."""
    first = (F.pmod(place, F.lit(128 // digits)) * digits + 1).cast("int")
    return F.conv(F.substring(digest, first, F.lit(digits)), 16, 10).cast("long")


def _letter_beyond(char: Column, amount: Column) -> Column:
    """What stands for a letter of `LETTER_RUNS` that moves on by `amount`, or for any other letter."""
    runs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in LETTER_RUNS))

    def moved(code: Column) -> Column:
        def within(run: Column) -> Column:
            to = run["a"] + F.pmod(code - run["a"] + amount, run["b"] - run["a"] + 1)
            return F.decode(F.unhex(F.lpad(F.hex(to), 4, "0")), "UTF-16BE")

        return F.get(F.transform(F.filter(runs, lambda run: code.between(run["a"], run["b"])), within), F.lit(0))

    other = F.substring(F.lit(_LOWER), (F.pmod(amount, F.lit(26)) + 1).cast("int"), F.lit(1))
    return F.coalesce(_let(F.ascii(char), moved), F.when(char.rlike("\\p{L}"), other).otherwise(char))


def permuted_text(
    value: Column, key: str, kind: str, alphabets: list[str], inverse: bool = False, beyond: bool = False
) -> Column:
    """`value` with each character permuted within the alphabet that has it; others stay.

    With `beyond` letters that are not ASCII move too, within their run of letters.
    """

    def move(half: Column, other: Column, turn: int, sign: int, _side: int) -> Column:
        def with_digest(digest: Column) -> Column:
            def step(char: Column, i: Column) -> Column:
                out = _letter_beyond(char, sign * _amount(digest, i, 4)) if beyond else char
                for letters in alphabets:
                    at = F.instr(F.lit(letters), char)
                    to = F.pmod(at - 1 + sign * _amount(digest, i, 4), F.lit(len(letters))) + 1
                    moved = F.substring(F.lit(letters), to.cast("int"), F.lit(1))
                    out = F.when((char != "") & (at > 0), moved).otherwise(out)
                return out

            return F.array_join(F.transform(F.split(half, ""), step), "")

        return _let(F.sha2(F.concat(F.lit(f"{key}|{kind}|{turn}|"), other), 512), with_digest)

    size = F.floor(F.length(value) / 2).cast("int")
    left, right = F.substring(value, F.lit(1), size), F.substring(value, size + 1, F.length(value))
    return _feistel(left, right, move, inverse, F.concat)


def permuted_numbers(values: list[Column], sizes: list[int], key: str, kind: str, inverse: bool = False) -> Column:
    """An array of the numbers `values`, each below its size, permuted over all combinations."""
    cut = len(values) // 2
    sides = (sizes[:cut], sizes[cut:])

    def move(half: Column, other: Column, turn: int, sign: int, side: int) -> Column:
        def with_digest(digest: Column) -> Column:
            return F.array(*(
                F.pmod(F.get(half, F.lit(i)) + sign * _amount(digest, F.lit(i), 12), F.lit(size))
                for i, size in enumerate(sides[side])
            ))

        return _let(F.sha2(F.concat(F.lit(f"{key}|{kind}|{turn}|"), F.array_join(other.cast("array<string>"), ".")), 512), with_digest)

    left, right = (F.array(*(v.cast("long") for v in part)) for part in (values[:cut], values[cut:]))
    return _feistel(left, right, move, inverse, F.concat)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, every second one (from place `doubled`) doubled."""

    def worth(char: Column, i: Column) -> Column:
        own = char.cast("int")
        twice = F.when(own > 4, 2 * own - 9).otherwise(2 * own)
        return F.when(F.pmod(i, F.lit(2)) == doubled, twice).otherwise(own)

    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda total, x: total + x
    )


def _with_check_digit(payload: Column) -> Column:
    return F.concat(payload, F.pmod(10 - F.pmod(_luhn(payload, 0), F.lit(10)), F.lit(10)).cast("string"))


def _into(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced in turn by `digits` (no digit of it is left over)."""
    by_four = F.regexp_replace(digits, "(.{4})(?=.)", "$1-")
    grouped = F.when(F.length(digits) == 15, F.regexp_replace(digits, "^(.{4})(.{6})", "$1-$2-")).otherwise(by_four)
    return (
        F.when(F.instr(shape, " ") > 0, F.replace(grouped, F.lit("-"), F.lit(" ")))
        .when(F.instr(shape, "-") > 0, grouped)
        .otherwise(digits)
    )


def _day(value: Column) -> Column:
    """Days from the first day of the grid, null for what is no date."""
    return F.datediff(
        F.coalesce(
            F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "yyyy/MM/dd"), F.try_to_date(value, "dd.MM.yyyy")
        ),
        F.lit(FIRST_DAY).cast("date"),
    )


def _parts(value: Column, mark: str, n: int) -> list[Column]:
    cut = F.split(value, mark)
    return [F.get(cut, F.lit(i)).cast("long") for i in range(n)]


def kind_of(value: Column) -> Column:
    """The kind of a found value, null if it is not a valid one."""
    octets = _parts(value, "\\.", 4)
    area, group, serial = _parts(value, "-", 3)
    grid = DAY_GRID[0] * DAY_GRID[1]
    valid = {
        "email": F.lit(True),
        "secret": value.rlike("[0-9]") & value.rlike("[A-Fa-f]"),
        "date": _day(value).between(0, grid - 1),
        "ip": (octets[0] < 256) & (octets[1] < 256) & (octets[2] < 256) & (octets[3] < 256),
        "phone": F.length(_digits(value)).between(8, 15),
        "ssn": (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0),
        "card": F.pmod(_luhn(_digits(value), 1), F.lit(10)) == 0,
    }
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), F.when(valid[kind], F.lit(kind))).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """What stands for a value of a kind; the value itself where the kind is null."""

    def numbers(name: str, values: list[Column], sizes: list[int], show: Callable[[Column], Column]) -> Column:
        return _let(permuted_numbers(values, sizes, key, name, inverse), show)

    at = F.instr(value, "@")
    local = F.substring(value, F.lit(1), at - 1)
    ascii_parts = [_DIGITS, _LOWER, _UPPER]
    hidden = F.when(
        local.rlike("[^\\x00-\\x7F]"), permuted_text(local, key, "email", ascii_parts, inverse, beyond=True)
    ).otherwise(permuted_text(local, key, "email", ascii_parts, inverse))
    email = F.concat(hidden, F.substring(value, at, F.length(value)))
    letters = F.when(value.rlike("[a-f]"), permuted_text(value, key, "secret", [_HEX], inverse)).otherwise(
        permuted_text(value, key, "secret", [_HEX_UPPER], inverse)
    )
    # Leading zeros of an octet are dropped, so equal addresses are linked however they are written.
    ip = numbers("ip", _parts(value, "\\.", 4), [256] * 4, lambda n: F.array_join(n.cast("array<string>"), "."))
    # A country code, or the first digit of an area, which is never 0 or 1, stays.
    head = F.regexp_extract(value, r"^(?:\+1|\+[1-9][0-9]{0,2}(?=[ .\-(])|\+[1-9]|(?:1[ .\-])?\(?[2-9])", 0)
    phone = F.concat(
        head, permuted_text(F.substring(value, F.length(head) + 1, F.length(value)), key, "phone", [_DIGITS], inverse)
    )
    area, group, serial = _parts(value, "-", 3)
    ssn = numbers(
        "ssn",
        [area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1],
        [898, 99, 9999],
        lambda n: F.concat_ws(
            "-",
            F.lpad((F.get(n, F.lit(0)) + F.when(F.get(n, F.lit(0)) >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.get(n, F.lit(1)) + 1).cast("string"), 2, "0"),
            F.lpad((F.get(n, F.lit(2)) + 1).cast("string"), 4, "0"),
        ),
    )
    digits = _digits(value)
    payload = permuted_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", [_DIGITS], inverse)
    card = _into(value, _let(payload, _with_check_digit))
    day = _day(value)
    width = DAY_GRID[1]
    shape = (
        F.when(F.instr(value, "-") > 0, F.lit("yyyy-MM-dd"))
        .when(F.instr(value, "/") > 0, F.lit("yyyy/MM/dd"))
        .otherwise(F.lit("dd.MM.yyyy"))
    )

    def shown(n: Column) -> Column:
        own = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(n, F.lit(0)) * width + F.get(n, F.lit(1))).cast("int"))
        iso = own.cast("string")
        return (
            F.when(shape == "yyyy-MM-dd", iso)
            .when(shape == "yyyy/MM/dd", F.replace(iso, F.lit("-"), F.lit("/")))
            .otherwise(F.concat_ws(".", F.substring(iso, 9, 2), F.substring(iso, 6, 2), F.substring(iso, 1, 4)))
        )

    date = numbers("date", [F.floor(day / width), F.pmod(day, F.lit(width))], list(DAY_GRID), shown)
    made = {"email": email, "secret": letters, "date": date, "ip": ip, "phone": phone, "ssn": ssn, "card": card}
    out = value
    for name, column in made.items():
        out = F.when(kind == name, column).otherwise(out)
    return out


def with_pseudonyms(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """`docs` with the text pseudonymized, and `_kinds`, the kinds of its values in their order.

    With `inverse` a text of pseudonyms is led back (but for leading zeros of octets).
    """
    text = F.col(f"`{text_col}`")
    some = text.rlike("[0-9@]")
    found = (
        docs.withColumn("_found", F.when(some, F.regexp_extract_all(text, F.lit(ANY), 0)))
        .withColumn("_kinds", F.transform("_found", kind_of))
        .withColumn("_new", F.zip_with("_found", "_kinds", lambda value, kind: pseudonym(value, kind, key, inverse)))
    )
    between = F.split(text, ANY, -1)
    joined = F.array_join(
        F.zip_with(between, F.concat("_new", F.array(F.lit(""))), lambda part, new: F.concat(part, new)), ""
    )
    changed = F.exists("_kinds", lambda kind: kind.isNotNull())
    return found.withColumn(text_col, F.when(changed, joined).otherwise(text)).drop("_found", "_new")


def pseudonymize_documents(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_email, n_secret, n_date, n_ip, n_phone, n_ssn, n_card) of every document.

    Valid values are replaced, all else stays as it is: numbers whose check digit is wrong, octets
    over 255, days that no calendar has or outside of 1900 to 2099. Not known are dates as d/m/yyyy or
    m/d/yyyy, with names of months or two digits for the year, and phone numbers without a country code
    other than in groups of 3, 3 and 4 digits; nor are IPv6 addresses and IBANs. Letters of an e-mail
    address beyond `LETTER_RUNS` become ASCII ones, and such an address is not led back by the key; its
    combining marks stay. A domain of over 127 labels is none. The domain of an e-mail address, the country code of a
    phone number (its first digit, where nothing parts it from the rest) and the first digit of an area
    without one stay. A null text stays null with no values. Repeated
    rows get equal results; an empty table gives no rows.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def counted(kind: str) -> Column:
        n = F.size(F.filter("_kinds", lambda k: k == kind))
        return F.when(F.col("_kinds").isNull(), 0).otherwise(n).cast("long").alias(f"n_{kind}")

    return with_pseudonyms(own, key).select("doc_id", "text", *(counted(kind) for kind in KINDS))


def private_documents(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs`, same columns, with the text pseudonymized."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text_col}`").alias("_given"))
    return with_pseudonyms(whole, key, "_given").select(
        *(F.col("_given").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns)
    )
