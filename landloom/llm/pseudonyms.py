"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

One pattern finds candidates; each is validated (Luhn, mod 97, octets up to 255, real dates, provinces of national
numbers, phone and e-mail forms). The symbols of a valid one are permuted by a keyed Feistel network over its own
alphabet: two halves, eight rounds, each round adds keyed digests of one half to the other, symbol by symbol. So digits
stay digits and letters letters, check digits are made anew, and equal values have equal pseudonyms in all documents,
whatever separators they are written with. A date keeps its 400-year cycle, whether its year is a leap year, whether its
month has one digit or two, and whether its day is below 10, below 13 or above: so any way to write it, month first too,
stays that way and names the same new date. An e-mail's domain keeps its dots and its last label.

Defined cases: a null text stays null and has no finds; candidates that don't validate stay as they are; overlapping
candidates are taken from the left, the longest valid run of groups of a number or account first; very long texts are split at their finds only, never cut;
repeated rows, null ids and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The registered query's key, unless the session names one under KEY_SETTING; the operator has no default.
QUERY_KEY, KEY_SETTING = "landloom", "spark.landloom.pseudonymKey"
ROUNDS = 8
#: A year that a 400-year cycle of dates begins with; dates have the years 1 to 9999.
CYCLE_START, CYCLE = 1800, 400
PROVINCES = 96  # first three digits of a national number: 001 to this
KINDS = ("email", "iban", "card", "ip", "phone", "ssn", "date", "national")
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
_IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
_PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}"
_PLUS = r"\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}"
_NATIONAL = r"[0-9]{12}"
CANDIDATE = rf"(?<![A-Za-z0-9._%+-]){_EMAIL}|(?<![A-Za-z0-9+(])(?:{_IBAN}|{_DATE}|{_IP}|{_SSN}|{_PHONE}|{_PLUS}|{_CARD}|{_NATIONAL})(?![A-Za-z0-9]|-[0-9])"


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits with every second one doubled, counted from the right; the last is not doubled."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def mod97(account: Column) -> Column:
    """The remainder that makes an account number valid when 1; letters count as 10 to 35, the first four come last."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def permuted(values: Column, radices: Column, label: Column, key: str) -> Column:
    """A keyed permutation of arrays of numbers, each below its radix; label names the format."""

    def mixed(target: Column, source: Column, rad: Column, label: Column, k: Column) -> Column:
        def add(seed: Column) -> Column:
            drawn = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", seed, F.floor(i / 7).cast("string")), 256), (i % 7) * 9 + 1, F.lit(9)), 16, 10).cast("bigint")
            return F.transform(target, lambda x, i: ((x + drawn(i)) % F.element_at(rad, i + 1)).cast("int"))

        return let(F.concat_ws("|", F.lit(key), label, k.cast("string"), F.array_join(source.cast("array<string>"), ",")), add)

    def network(given: Column) -> Column:
        half = F.floor(F.size(given["v"]) / 2).cast("int")
        low, high = (lambda x: F.slice(x, F.lit(1), half)), (lambda x: F.slice(x, half + 1, F.size(x)))
        start = F.struct(low(given["v"]).alias("a"), high(given["v"]).alias("b"), low(given["r"]).alias("ra"), high(given["r"]).alias("rb"), given["l"].alias("l"))

        def turn(s: Column, k: Column) -> Column:
            left = F.when(k % 2 == 0, mixed(s["a"], s["b"], s["ra"], s["l"], k)).otherwise(s["a"])
            right = F.when(k % 2 == 1, mixed(s["b"], s["a"], s["rb"], s["l"], k)).otherwise(s["b"])
            return F.struct(left.alias("a"), right.alias("b"), s["ra"].alias("ra"), s["rb"].alias("rb"), s["l"].alias("l"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))

    return let(F.struct(values.alias("v"), radices.alias("r"), label.alias("l")), network)


def permuted_symbols(value: Column, label: str, key: str) -> Column:
    """The value's letters and digits, permuted each in its class."""
    base = lambda c: F.when(c <= 57, 48).when(c <= 90, 65).otherwise(97)

    def move(codes: Column) -> Column:
        numbers = F.transform(codes, lambda c: c - base(c))
        radices = F.transform(codes, lambda c: F.when(c <= 57, 10).otherwise(26))
        shape = F.array_join(F.transform(codes, lambda c: F.when(c <= 57, "0").when(c <= 90, "A").otherwise("a")), "")
        return F.array_join(F.zip_with(permuted(numbers, radices, F.concat(F.lit(f"{label}:"), shape), key), codes, lambda x, c: F.char(x + base(c))), "")

    return let(F.transform(F.filter(F.split(value, ""), lambda c: c.rlike("^[A-Za-z0-9]$")), lambda c: F.ascii(c)), move)


def laid_out(symbols: Column, value: Column) -> Column:
    """The symbols put in the places of the value's letters and digits."""

    def place(given: Column) -> Column:
        at = lambda i: F.substring(given["v"], i, F.lit(1))
        before = lambda i: F.length(F.regexp_replace(F.substring(given["v"], F.lit(1), i), "[^A-Za-z0-9]", ""))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(given["v"])), lambda i: F.when(at(i).rlike("[A-Za-z0-9]"), F.substring(given["s"], before(i), F.lit(1))).otherwise(at(i))), "")

    return let(F.struct(symbols.alias("s"), value.alias("v")), place)


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, "[^A-Za-z0-9]", "")


_ISO, _PARTS = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})$"


def _date(value: Column) -> Column:
    """The date that a value writes: year first, else day first, else month first; null if it is none."""
    part = lambda p, i: F.nullif(F.regexp_extract(value, p, i), F.lit(""))
    day = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    a, b, year = (part(_PARTS, i) for i in (1, 2, 3))
    found = F.when(value.contains("-"), day(part(_ISO, 1), part(_ISO, 2), part(_ISO, 3))).otherwise(F.coalesce(day(year, b, a), day(year, a, b)))
    return F.when(F.coalesce(part(_ISO, 1), year) != "0000", found)


def _leap(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def _day_class(month: Column, day: Column) -> Column:
    """What a way of writing a date depends on: digits of the month and of the day, and whether the day can be a month."""
    return F.when(month < 10, 0).otherwise(3) + F.when(day < 10, 0).when(day < 13, 1).otherwise(2)


def moved_date(date: Column, key: str) -> Column:
    """struct(y, m, d): the date permuted among those of its class."""

    def move(g: Column) -> Column:
        years = F.filter(F.sequence(F.greatest(g["low"], F.lit(1)), F.least(g["low"] + CYCLE - 1, F.lit(9999))), lambda y: _leap(y) == g["leap"])
        in_month = lambda m: F.when(m == 2, F.when(g["leap"], 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        days = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.transform(F.sequence(F.lit(1), in_month(m)), lambda d: m * 100 + d)))
        days = F.filter(days, lambda x: _day_class(F.floor(x / 100), x % 100) == g["kind"])
        both = F.struct(years.alias("years"), days.alias("days"))

        def drawn(s: Column) -> Column:
            at = F.array((F.array_position(s["years"], g["y"]) - 1).cast("int"), (F.array_position(s["days"], g["m"] * 100 + g["d"]) - 1).cast("int"))
            label = F.concat_ws(":", F.lit("date"), g["low"].cast("string"), g["leap"].cast("string"), g["kind"].cast("string"))
            new = permuted(at, F.array(F.size(s["years"]), F.size(s["days"])), label, key)
            return let(new, lambda n: F.struct(F.element_at(s["years"], n[0] + 1).alias("y"), F.floor(F.element_at(s["days"], n[1] + 1) / 100).cast("int").alias("m"), (F.element_at(s["days"], n[1] + 1) % 100).cast("int").alias("d")))

        return let(both, drawn)

    y, m, d = F.year(date), F.month(date), F.dayofmonth(date)
    low = (F.floor((y - CYCLE_START) / CYCLE) * CYCLE + CYCLE_START).cast("int")
    return let(F.struct(y.alias("y"), m.alias("m"), d.alias("d"), low.alias("low"), _leap(y).alias("leap"), _day_class(m, d).alias("kind")), move)


def _written(value: Column, new: Column) -> Column:
    """The new date, written as the value is."""
    sign, first = F.when(value.contains("/"), "/").otherwise("."), F.regexp_extract(value, _PARTS, 1)
    second, year = F.regexp_extract(value, _PARTS, 2), F.lpad(new["y"].cast("string"), 4, "0")
    in_width = lambda n, like: F.lpad(n.cast("string"), F.length(like), "0")
    month_first = second.cast("int") > 12
    a, b = F.when(month_first, new["m"]).otherwise(new["d"]), F.when(month_first, new["d"]).otherwise(new["m"])
    iso = F.concat_ws("-", year, F.lpad(new["m"].cast("string"), 2, "0"), F.lpad(new["d"].cast("string"), 2, "0"))
    return F.when(value.contains("-"), iso).otherwise(F.concat(in_width(a, first), sign, in_width(b, second), sign, year))


def kind_of(value: Column) -> Column:
    """The kind of a valid candidate, else null."""
    digits = _plain(value)
    return (
        F.when(value.rlike(_full(_EMAIL)), "email")
        .when(value.rlike(_full(_DATE)), F.when(_date(value).isNotNull(), "date"))
        .when(value.rlike(_full(_IP)), F.when(F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255), "ip"))
        .when(value.rlike(_full(_SSN)), "ssn")
        .when(value.rlike(_full(_IBAN)), F.when(mod97(digits) == 1, "iban"))
        .when(value.rlike(_full(_CARD)) & (luhn_sum(digits) % 10 == 0), "card")
        .when(value.rlike(_full(_NATIONAL)), F.when(F.substring(value, 1, 3).cast("int").between(1, PROVINCES), "national"))
        .when(value.rlike(_full(_PHONE)) | value.rlike(_full(_PLUS)), "phone")
    )


def pieces_of(value: Column) -> Column:
    """A candidate as an array of (value, kind) that joined give it again. Where a number or account is not valid whole,
    its runs of groups are tried from the left, the longest first, and what follows a valid one is tried on."""
    number = _full(f"{_CARD}|{_IBAN}")
    none = F.lit(None).cast("string")
    piece = lambda v, k: F.struct(v.alias("value"), k.alias("kind"))

    def parts(v: Column) -> Column:
        gap = lambda i: F.substring(v, i, F.lit(1)).isin(" ", "-")
        places = F.sequence(F.lit(1), F.length(v))
        starts = F.filter(places, lambda i: ~gap(i) & ((i == 1) | gap(i - 1)))
        ends = F.reverse(F.filter(places, lambda i: ~gap(i) & ((i == F.length(v)) | gap(i + 1))))
        runs = F.flatten(F.transform(starts, lambda s: F.transform(F.filter(ends, lambda e: e - s >= 11), lambda e: F.struct(s.alias("s"), e.alias("e"), F.substring(v, s, e - s + 1).alias("value")))))
        tried = F.transform(runs, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["value"].alias("value"), F.when(r["value"].rlike(number), kind_of(r["value"])).alias("kind")))
        start = F.struct(F.lit(1).alias("next"), F.expr("CAST(array() AS array<struct<value:string,kind:string>>)").alias("out"))

        def take(t: Column, r: Column) -> Column:
            before = piece(F.substring(v, t["next"], r["s"] - t["next"]), none)
            taken = F.struct((r["e"] + 1).alias("next"), F.concat(t["out"], F.array(before, piece(r["value"], r["kind"]))).alias("out"))
            return F.when(r["s"] >= t["next"], taken).otherwise(t)

        rest = lambda t: F.concat(t["out"], F.array(piece(F.substring(v, t["next"], F.length(v)), none)))
        return F.aggregate(F.filter(tried, lambda r: r["kind"].isin("card", "iban")), start, take, rest)

    return let(piece(value, kind_of(value)), lambda f: F.when(f["kind"].isNull() & f["value"].rlike(number), parts(f["value"])).otherwise(F.array(f)))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of that kind; the value itself where kind is null."""
    digits = _plain(value)
    card = let(permuted_symbols(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key), lambda head: F.concat(head, ((10 - luhn_sum(F.concat(head, F.lit("0"))) % 10) % 10).cast("string")))
    country = F.substring(digits, 1, 2)
    iban = let(permuted_symbols(F.substring(digits, F.lit(5), F.length(digits)), "iban", key), lambda account: F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account))
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    ip = F.array_join(permuted(octets, F.array_repeat(F.lit(256), 4), F.lit("ip"), key).cast("array<string>"), ".")
    day = let(moved_date(_date(value), key), lambda new: _written(value, new))
    cut = [F.substring(value, i, n).cast("int") for i, n in ((1, 3), (4, 1), (5, 2), (7, 3), (10, 3))]
    moved = permuted(F.array(cut[0] - 1, *cut[1:]), F.array(*map(F.lit, (PROVINCES, 10, 100, 1000, 1000))), F.lit("national"), key)
    national = let(moved, lambda n: F.concat(*(F.lpad((n[i] + int(i == 0)).cast("string"), w, "0") for i, w in enumerate((3, 1, 2, 3, 3)))))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    last = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}[ .-]?", 0)
    number = F.substring(value, F.length(code) + 1, F.length(value))
    return (
        F.when(kind == "email", F.concat(laid_out(permuted_symbols(local, "email", key), local), F.lit("@"), laid_out(permuted_symbols(host, "domain", key), host), F.lit("."), last))
        .when(kind == "date", day)
        .when(kind == "national", national)
        .when(kind == "ip", ip)
        .when(kind == "ssn", laid_out(permuted_symbols(digits, "ssn", key), value))
        .when(kind == "iban", laid_out(iban, value))
        .when(kind == "card", laid_out(card, value))
        .when(kind == "phone", F.concat(code, laid_out(permuted_symbols(_plain(number), "phone", key), number)))
        .otherwise(value)
    )


def _is(kind: str):
    return lambda f: f["kind"] == kind


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text replaced, and n_private and one count for each kind added."""
    has = F.col(text_col).rlike("[0-9@]")
    base = docs.withColumn("_parts", F.when(has, F.transform(F.regexp_extract_all(text_col, F.lit(CANDIDATE), F.lit(0)), pieces_of)))
    base = base.withColumn("_found", F.flatten("_parts"))
    pieces = F.split(F.col(text_col), CANDIDATE, -1)
    new = F.concat(F.transform(F.col("_parts"), lambda c: F.array_join(F.transform(c, lambda f: pseudonym(f["value"], f["kind"], key)), "")), F.array(F.lit("")))
    any_valid = F.coalesce(F.exists("_found", lambda f: f["kind"].isNotNull()), F.lit(False))
    text = F.when(any_valid, F.array_join(F.zip_with(pieces, new, lambda p, v: F.concat(p, v)), "")).otherwise(F.col(text_col))
    count = lambda test: F.coalesce(F.size(F.filter("_found", test)), F.lit(0)).cast("bigint")
    counts = {"n_private": F.when(F.col("_found").isNull(), 0).otherwise(count(lambda f: f["kind"].isNotNull())).cast("bigint")}
    counts |= {f"n_{k}": F.when(F.col("_found").isNull(), 0).otherwise(count(_is(k))).cast("bigint") for k in KINDS}
    return base.withColumns({text_col: text} | counts).drop("_found", "_parts")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document with its private values replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, spark.conf.get(KEY_SETTING, QUERY_KEY))
