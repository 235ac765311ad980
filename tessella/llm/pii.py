"""Format-preserving Feistel pseudonyms for personal data.

One pattern finds candidates; each is validated by its kind (Luhn and mod-97 checks, octets, calendar,
number ranges).  Numbers are permuted by a keyed Feistel network over exactly their domain: as many
digits, 32-bit addresses, days of two centuries.  Where a domain is smaller than the network's, the
permutation is walked along its cycle until it meets a valid value.  So a value always becomes the same
other value of the same format, equal values stay linked across documents, and the key's holder can
invert it.  E-mail addresses, which are neither numbers nor dates, get keyed hashes of the same shape.

Dates are year first or year last, with dashes, slashes or dots, and days and months of one or two digits.  Year
last, the day comes first unless there is no such day; then the month does, as in 12/31/1999, and the pseudonym is
again a date that can only be read that way.  Other orders (year, day, month) and years of two digits are left.

A candidate that fails validation is looked at again: of the runs of its groups the leftmost, and of these
the longest, that is valid by any kind is taken, and so on behind it; cards must then have the grouping
of cards, as a long row of numbers holds many runs with a right check digit.

Everything is built of DataFrame functions: texts are split and put together again by the one pattern,
and the networks are aggregates over their rounds.  Texts without a digit or an @ are passed on as they are.

Defined results: a null text stays null; what fails validation stays as it is; an empty table gives no
rows; repeated rows are treated alike; where several kinds fit, the first of PATTERNS is taken; a very long
text is read whole, in one row; all columns of the input are kept, whatever their names, but for one
named found, in whose place the operator's own comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, others, pick, read_table

#: The default key; a deployment passes its own.
KEY = "tessella-demonstration-key"
ROUNDS = 8
#: Steps along a cycle; the smallest domain, of days that must come after their month, fills a third of its network's,
#: so that 128 steps fail once in 2^75, the others once in 2^100.
WALK = 128

# The length of an account number by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28"
    " HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29"
    " PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()


def iban_pattern() -> str:
    """Account numbers of just the length of their country, whole or in groups of four."""
    by_length: dict[int, list[str]] = {}
    for x in IBAN_LENGTHS:
        by_length.setdefault(int(x[2:]), []).append(x[:2])
    each = []
    for n, codes in sorted(by_length.items()):
        fours, rest = divmod(n - 4, 4)
        either = "|".join([*codes, *(c.lower() for c in codes)])
        each.append(f"(?:{either})[0-9]{{2}}(?: ?[A-Za-z0-9]{{4}}){{{fours}}}" + (f" ?[A-Za-z0-9]{{{rest}}}" if rest else ""))
    return rf"(?<![0-9A-Za-z])(?:{'|'.join(each)})(?![0-9A-Za-z])"


def date_pattern() -> str:
    """Days with one mark throughout, at the end of no longer row of numbers; a time may follow behind a T."""
    each = [x for mark in ("-", "/", r"\.") for x in (f"[0-9]{{4}}{mark}[0-9]{{1,2}}{mark}[0-9]{{1,2}}", f"[0-9]{{1,2}}{mark}[0-9]{{1,2}}{mark}[0-9]{{4}}")]
    return rf"(?<![0-9A-Za-z])(?<![0-9][-/.])(?:{'|'.join(each)})(?!(?!T[0-9])[0-9A-Za-z])(?![-/.][0-9])"


# The patterns of candidates, in order of preference.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,30}\.[A-Za-z][A-Za-z0-9-]++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9])",
    "date": date_pattern(),
    "iban": iban_pattern(),
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+(])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9A-Za-z])",
    # a whole row of numbers; those that end in what may be a date aren't part of it
    "card": r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){11})[0-9]++(?![A-Za-z]|[./][0-9])(?:[ -][0-9]++(?![A-Za-z]|[./][0-9]))*+",
}
#: How cards are written; asked of the parts of a candidate that failed as a whole.
CARD_GROUPS = r"^(?:[0-9]{12,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})$"
#: Groups and single marks of a candidate, each of a character at least.
PIECE = "([0-9A-Za-z]++|[^0-9A-Za-z])"
#: The characters of the shortest and the longest value of a kind but e-mail addresses (an account number of 33 in groups), which never fail.
SHORTEST, LONGEST = 7, 42
ANY = "|".join(PATTERNS.values())
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, F.lit("0")).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column, key: str = KEY, inverse: bool = False) -> Column:
    """(l, r) permuted over left_size x right_size: each round adds a keyed hash of one half to the other."""

    def hashed(i: Column, half: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size

    def rounds(s: Column, i: Column) -> Column:
        sign = -1 if inverse else 1
        on_left = F.pmod(s["l"] + sign * hashed(i, s["r"], left_size), left_size)
        on_right = F.pmod(s["r"] + sign * hashed(i, s["l"], right_size), right_size)
        even = i % 2 == 0
        return F.struct(F.when(even, on_left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(on_right).alias("r"))

    order = [F.lit(i) for i in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))]
    return F.aggregate(F.array(*order), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), rounds)


def digits_permuted(d: Column, tweak: str, key: str = KEY, inverse: bool = False) -> Column:
    """A string of digits as another of the same length; a single digit is permuted as the right half."""
    n = F.length(d)
    u = n.bitwiseAND(F.lit(~1)) / 2
    u = u.cast("int")
    left = F.when(u > 0, F.substring(d, F.lit(1), u)).otherwise("0").cast("long")
    right = F.substring(d, u + 1, n - u).cast("long")
    joined = lambda s: F.concat(F.when(u > 0, F.lpad(s["l"].cast("string"), u, F.lit("0"))).otherwise(""), F.lpad(s["r"].cast("string"), n - u, F.lit("0")))
    return bind(feistel(left, right, power_of_ten(u), power_of_ten(n - u), F.concat(F.lit(tweak), n.cast("string")), key, inverse), joined)


def walked(start: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """The first valid value after ``start`` along the cycle of ``step``."""
    begin = F.struct(start.alias("v"), F.lit(False).alias("ok"))

    def move(s: Column, _: Column) -> Column:
        return F.when(s["ok"], s).otherwise(bind(step(s["v"]), lambda v: F.struct(v.alias("v"), valid(v).alias("ok"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), begin, move, lambda s: F.when(s["ok"], s["v"]).otherwise(start))


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def in_place(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    chars = F.split(m, "")
    one = lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(digits, F.length(only_digits(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(chars, one), "")


def luhn_sum(d: Column) -> Column:
    """Luhn's sum of a string of digits, its last one not doubled."""
    n = F.length(d)
    term = lambda i: bind(F.substring(d, n - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + term(i))


def card_permuted(m: Column, key: str) -> Column:
    head = bind(only_digits(m), lambda d: digits_permuted(F.substring(d, F.lit(1), F.length(d) - 1), "card", key))
    return bind(head, lambda h: in_place(m, F.concat(h, F.pmod(10 - luhn_sum(F.concat(h, F.lit("0"))) % 10, F.lit(10)).cast("string"))))


def mod97(s: Column) -> Column:
    """The remainder of an account number's characters, letters of either case counting from A = 10."""
    step = lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(F.upper(s), ""), lambda c: c != ""), F.lit(0), step)


def iban_permuted(m: Column, key: str) -> Column:
    """The digits of the account part, with new check digits."""
    body = lambda v: F.regexp_replace(F.substring(v, F.lit(5), F.length(v)), " ", "")
    moved = F.concat(F.substring(m, F.lit(1), F.lit(4)), F.substring(in_place(F.concat(F.lit("XX"), F.substring(m, F.lit(5), F.length(m))), digits_permuted(only_digits(F.substring(m, F.lit(5), F.length(m))), "iban", key)), F.lit(3), F.length(m)))
    return bind(moved, lambda v: F.concat(F.substring(v, F.lit(1), F.lit(2)), F.lpad((98 - mod97(F.concat(body(v), F.substring(v, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), F.substring(v, F.lit(5), F.length(v))))


def ssn_valid(d: Column) -> Column:
    return ~d.rlike("^(000|666|9..)|^...00|0000$")


def octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda o: o.cast("int"))


def ip_permuted(m: Column, key: str) -> Column:
    half = lambda o, i: F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1))
    size = F.lit(65536).cast("long")
    moved = bind(octets(m), lambda o: feistel(half(o, 0), half(o, 2), size, size, F.lit("ip"), key))
    return bind(moved, lambda s: F.concat_ws(".", F.shiftright(s["l"], 8), s["l"] % 256, F.shiftright(s["r"], 8), s["r"] % 256))


def read_day(m: Column) -> Column:
    """(day, order) of a date: ymd, dmy, or mdy where the day can't come first; the day is null if there is none."""

    def read(p: Column) -> Column:
        at = lambda i: F.lpad(F.get(p, F.lit(i)), 2, "0")
        year_first = F.length(F.get(p, F.lit(0))) == 4
        day = lambda y, mo, d: F.concat_ws("-", F.get(p, F.lit(y)), at(mo), at(d)).try_cast("date")
        first = F.when(year_first, day(0, 1, 2)).otherwise(day(2, 1, 0))
        order = F.when(year_first, "ymd").when(first.isNotNull(), "dmy").otherwise("mdy")
        return F.struct(F.coalesce(first, F.when(~year_first, day(2, 0, 1))).alias("day"), order.alias("order"))

    return bind(F.split(m, "[-/.]"), read)


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(FIRST_DAY).cast("date"))


def date_permuted(m: Column, key: str) -> Column:
    size = F.lit(512).cast("long")
    step = lambda v: bind(feistel(F.shiftright(v, 9), v % 512, F.lit(256).cast("long"), size, F.lit("date"), key), lambda s: s["l"] * 512 + s["r"])
    date = lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int"))
    mark = F.regexp_extract(m, "[-/.]", 0)
    short = m.rlike("(?<![0-9])[0-9](?![0-9])")  # as the value, without leading noughts

    def written(d: Column, order: Column) -> Column:
        y, mo, da = F.substring(d, 1, 4), *(F.when(short, F.substring(d, k, 2).cast("int").cast("string")).otherwise(F.substring(d, k, 2)) for k in (6, 9))
        return F.when(order == "ymd", F.concat(y, mark, mo, mark, da)).when(order == "dmy", F.concat(da, mark, mo, mark, y)).otherwise(F.concat(mo, mark, da, mark, y))

    def moved(r: Column) -> Column:
        fits = lambda v: (v < DAYS) & ((r["order"] != "mdy") | (F.dayofmonth(date(v)) > 12))
        return bind(date(walked(day_number(r["day"]).cast("long"), step, fits)).cast("string"), lambda d: written(d, r["order"]))

    return bind(read_day(m), moved)


def ssn_permuted(m: Column, key: str) -> Column:
    return in_place(m, walked(only_digits(m), lambda v: digits_permuted(v, "ssn", key), ssn_valid))


def phone_permuted(m: Column, key: str) -> Column:
    """All digits after the country code."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[^0-9])|^\+[0-9](?=[0-9])", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, in_place(rest, digits_permuted(only_digits(rest), "phone", key)))


def email_hashed(m: Column, key: str) -> Column:
    low = F.lower(m)
    part = lambda what, n: F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), what), 256), 1, n), "0123456789", "ghijklmnop")
    return F.concat(part(low, 12), F.lit("@"), part(F.substring_index(low, "@", -1), 8), F.lit(".example"))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: ~F.exists(octets(m), lambda o: o > 255),
    "date": lambda m: F.coalesce(day_number(read_day(m)["day"]).between(0, DAYS - 1), F.lit(False)),
    "iban": lambda m: bind(F.regexp_replace(m, " ", ""), lambda v: mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, F.lit(1), F.lit(4)))) == 1),
    "ssn": lambda m: ssn_valid(only_digits(m)),
    "phone": lambda m: F.length(only_digits(m)).between(9, 15),
    "card": lambda m: bind(only_digits(m), lambda d: F.length(d).between(12, 19) & (luhn_sum(d) % 10 == 0)),
}
PERMUTED: dict[str, Callable[[Column, str], Column]] = {"email": email_hashed, "ip": ip_permuted, "date": date_permuted, "iban": iban_permuted, "ssn": ssn_permuted, "phone": phone_permuted, "card": card_permuted}
KINDS = list(PATTERNS)


def kind_of(m: Column) -> Column:
    """The first kind whose pattern the candidate is and which it is valid for; null if none."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        own = f"^(?:{PATTERNS[kind]})$"
        out = F.when(m.rlike(own) & VALID[kind](m), F.lit(kind)).otherwise(out)
    return out


PART = "array<struct<text:string,kind:string>>"


def part(text: Column, kind: Column) -> Column:
    return F.struct(text.alias("text"), kind.cast("string").alias("kind"))


def looked_at_again(m: Column) -> Column:
    """A failed candidate as parts (text, kind): the valid runs of its groups, and what lies between them."""

    def parts(t: Column) -> Column:
        def longest(i: Column) -> Column:
            """(last, part) of the longest valid run from ``i``; null if there is none."""
            ends = F.filter(F.sequence(F.lit(0), F.least(F.lit(LONGEST - 1), F.size(t) - 1 - i)), lambda n: F.get(t, i + n).rlike("^[0-9A-Za-z]"))
            run = lambda n: bind(F.array_join(F.slice(t, i + 1, n + 1), ""), lambda x: F.struct((i + n).alias("last"), part(x, F.when(F.length(x).between(SHORTEST, LONGEST), kind_of(x))).alias("part")))
            return F.get(F.filter(F.transform(F.reverse(ends), run), lambda r: r["part"]["kind"].isNotNull() & ((r["part"]["kind"] != "card") | r["part"]["text"].rlike(CARD_GROUPS))), F.lit(0))

        def step(s: Column, i: Column) -> Column:
            begins = F.get(t, i).rlike("^[0-9A-Za-z+(]") & (i > s["last"])
            plain = F.struct(i.alias("last"), F.concat(s["parts"], F.array(part(F.get(t, i), F.lit(None)))).alias("parts"))
            taken = lambda r: F.when(r.isNull(), plain).otherwise(F.struct(r["last"].alias("last"), F.concat(s["parts"], F.array(r["part"])).alias("parts")))
            return F.when(i <= s["last"], s).when(begins, bind(longest(i), taken)).otherwise(plain)

        start = F.struct(F.lit(-1).alias("last"), F.array().cast(PART).alias("parts"))
        return F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), start, step, lambda s: s["parts"])

    return bind(F.regexp_extract_all(m, F.lit(PIECE), F.lit(1)), lambda t: F.when(F.size(t) < 3, F.array(part(m, F.lit(None)))).otherwise(parts(t)))


def pseudonym(m: Column, kind: Column, key: str = KEY) -> Column:
    out = m
    for k in KINDS:
        out = F.when(kind == k, PERMUTED[k](m, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with its text pseudonymised, and ``found``: (kind, value, pseudonym) of each valid value in order."""
    d = held(docs, "text").withColumn("matches", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))))
    d = d.withColumn("kinds", F.transform("matches", kind_of))
    d = d.withColumn("parts", F.zip_with("matches", "kinds", lambda m, k: F.when(k.isNull(), looked_at_again(m)).otherwise(F.array(part(m, k)))))
    new = lambda p: F.struct(p["kind"].alias("kind"), p["text"].alias("value"), F.when(p["kind"].isNull(), p["text"]).otherwise(pseudonym(p["text"], p["kind"], key)).alias("pseudonym"))
    d = d.withColumn("parts", F.transform("parts", lambda ps: F.transform(ps, new)))
    rest = F.split("text", ANY, -1)
    joined = F.transform("parts", lambda ps: F.array_join(F.transform(ps, lambda p: p["pseudonym"]), ""))
    whole = F.array_join(F.zip_with(F.concat(F.array(F.lit("")), joined), rest, lambda m, r: F.concat(m, r)), "")
    text = F.when(F.size(F.coalesce("matches", F.array().cast("array<string>"))) > 0, whole).otherwise(F.col("text"))
    d = d.select("row", text.alias("text"), F.filter(F.flatten("parts"), lambda p: p["kind"].isNotNull()).alias("found"))
    return d.select(*[F.col("text") if n == "text" else F.col(f"row.`{n}`") for n in others(docs, "found")], "found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymised(pick(read_table(spark, sf_dir, "documents"), "doc_id", "text"))

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("found", lambda x: x["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", "text", *map(count, KINDS))
