"""Format-preserving pseudonyms of personal data by keyed Feistel permutations, in column expressions alone."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels and their number are bounded as domain names are; Java's matcher takes a stack frame for each label.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.[A-Za-z]{2,63}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
DATE = r"(?<![\d-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])"
SOCIAL = r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"
PHONE = "(?:" + "|".join([
    r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"\+[1-9](?:[ .-]?\(?\d\)?){7,14}(?!\d)",
    r"\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
    r"(?<!\d)(?<!\d[.-])(?:1[ .-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|[2-9]\d\d[ .-][2-9]\d\d[ .-]\d{4})(?!\d|[.-]\d)",
    r"(?<!\d)(?<!\d[.-])\(?0[1-9](?:\d{0,3}\)?[ .-]\d{3,4}[ .-]\d{3,4}|(?:[ .-]\d\d){4})(?!\d|[.-]\d)",
]) + ")"
#: Cards are found first, in runs of digit groups, and stand between two noncharacters of Unicode when all else is sought.
MARKS = "\ufdd0", "\ufdd1"
CARD = f"{MARKS[0]}[0-9 -]+{MARKS[1]}"
RUN = r"(?<![\d.])(?=\d(?:[ -]?\d){12})\d++(?!\.\d)(?:[ -]\d++(?!\.\d))*+"
#: Numbers that issuers give out, with their lengths. Other numbers count as cards if they stand alone.
ISSUED = "^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12,17}|35[0-9]{14,17}|5[0678][0-9]{11,17}|6[0-9]{12,18}|8[12][0-9]{14}|9792[0-9]{12}|1[0-9]{14})$"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "ip": IP, "date": DATE, "social": SOCIAL, "phone": PHONE, "card": CARD, "secret": SECRET}
ANY = "|".join(KINDS.values())
#: Country codes of one and two digits; others have three.
SHORT_CODES = "1|7", "20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ROUNDS = 8
#: Days from FIRST_DAY on that dates are permuted in, 150 * 487; the last of them is past 2099.
FIRST_DAY, DAYS = "1900-01-01", (150, 487)
LAST_DAY = DAYS[0] * DAYS[1] - 1
_CUT = "_tidemark_cut"
#: Groups of digits of which one pass over a run holds the text.
CHUNK = 256


def _mac(key: str, *parts) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)), 256)


def feistel(a: Column, b: Column, ma: Column, mb: Column, tag: Column, key: str, skip: Column | None = None) -> Column:
    """struct(a, b): a keyed permutation of pairs with 0 <= a < ma and 0 <= b < mb, another one for each tag.

    Rounds add a keyed hash of one half to the other in turn, which subtraction in reverse order undoes. The pair numbered
    `skip` (a * mb + b) is left out of the permutation if given and not null: what would become it goes through all rounds
    once more.
    """
    again = F.lit(None).cast("long") if skip is None else skip.cast("long")

    def turn(s: Column, i: Column) -> Column:
        h = lambda x: F.conv(F.substring(_mac(key, tag, i % ROUNDS, x), 1, 13), 16, 10).cast("long")
        even = F.struct(((s["a"] + h(s["b"])) % ma).alias("a"), s["b"].alias("b"), s["on"].alias("on"))
        made = F.when(i % 2 == 0, even).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + h(s["a"])) % mb).alias("b"), s["on"].alias("on")))
        if skip is None:
            return made
        on = F.when(i == ROUNDS, s["a"] * mb + s["b"] == again).otherwise(s["on"])
        return F.when(on, made).otherwise(F.struct(s["a"].alias("a"), s["b"].alias("b"), F.lit(False).alias("on")))

    last = F.lit(ROUNDS - 1) if skip is None else F.when(again.isNull(), ROUNDS - 1).otherwise(2 * ROUNDS - 1)
    return F.aggregate(F.sequence(F.lit(0), last), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(True).alias("on")), turn, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum of a digit string; digits at places of parity `doubled`, counted from the right, count twice."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _let(value: Column, f) -> Column:
    """f(value), with value evaluated once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _valid_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (_luhn_sum(digits, 1) % 10 == 0)


def _bare(m: Column) -> Column:
    return F.regexp_replace(m, "[ -]", "")


def _cards_marked(run: Column) -> Column:
    """A run of digit groups with MARKS around the cards in it: whole groups of 13 to 19 digits by Luhn's check.

    From left to right, numbers of issuers count first, the longest first, and then single groups; where no number of an
    issuer is found the whole run may be one card. Groups are passed in chunks, so that the work grows with the run.
    """
    return _let(F.regexp_extract_all(run, F.lit("([0-9]+[ -]?)"), F.lit(1)), lambda parts: _groups_marked(run, parts))


def _groups_marked(run: Column, parts: Column) -> Column:
    def issued(i: Column) -> Column:
        rest = F.array_join(F.slice(parts, i, F.lit(19)), "")
        forms = _let(rest, lambda r: F.array(*(F.regexp_extract(r, f"^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])", 0) for n in range(19, 12, -1))))
        return F.try_element_at(F.filter(forms, lambda m: (m != "") & _bare(m).rlike(ISSUED) & _valid_card(_bare(m))), F.lit(1))

    def told(s: Column, m: Column, groups: Column, i: Column, known: Column) -> Column:
        after = F.regexp_extract(F.element_at(parts, i + groups - 1), "[ -]$", 0)
        return F.struct(F.concat(s["out"], F.lit(MARKS[0]), m, F.lit(MARKS[1]), after).alias("out"), (i + groups).alias("next"), known.alias("known"))

    def step(s: Column, i: Column) -> Column:
        own = _bare(F.element_at(parts, i))
        as_it_is = F.struct(F.concat(s["out"], F.element_at(parts, i)).alias("out"), (i + 1).alias("next"), s["known"].alias("known"))
        chosen = _let(issued(i), lambda m: F.when(m.isNotNull(), told(s, m, F.size(F.split(m, "[ -]")), i, F.lit(True))).when(_valid_card(own), told(s, own, F.lit(1), i, s["known"])).otherwise(as_it_is))
        return F.when(i < s["next"], s).otherwise(chosen)

    def chunk(s: Column, first: Column) -> Column:
        places = F.sequence(first, F.least(first + CHUNK - 1, F.size(parts)))
        begun = F.struct(F.lit("").alias("out"), s["next"].alias("next"), s["known"].alias("known"))
        return _let(F.aggregate(places, begun, step), lambda c: F.struct(F.concat(s["out"], c["out"]).alias("out"), c["next"].alias("next"), c["known"].alias("known")))

    begun = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"), F.lit(False).alias("known"))
    made = F.aggregate(F.sequence(F.lit(1), F.size(parts), F.lit(CHUNK)), begun, chunk)
    whole = F.concat(F.lit(MARKS[0]), run, F.lit(MARKS[1]))
    return _let(made, lambda c: F.when(~c["known"] & (F.length(run) <= 37) & _valid_card(_bare(run)), whole).otherwise(c["out"]))


def _marked(text: Column) -> Column:
    """text with MARKS around cards; e-mail addresses and secrets are passed over."""
    seen = f"{EMAIL}|{SECRET}|{RUN}"
    new = F.transform(F.regexp_extract_all(text, F.lit(seen), F.lit(0)), lambda m: F.when(m.rlike("^[0-9 -]+$"), _cards_marked(m)).otherwise(m))
    made = F.array_join(F.transform(F.arrays_zip(F.split(text, seen, -1).alias("t"), new.alias("n")), lambda z: F.concat(z["t"], F.coalesce(z["n"], F.lit("")))), "")
    return F.when(text.rlike(RUN), made).otherwise(text)


def _refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by those of digits."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["n"] + 1, F.lit(1))).alias("out"), (s["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["n"].alias("n")))
    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step)["out"]


def _pseudonym(m: Column, key: str) -> Column:
    """What stands for one match of ANY; the match itself if its value is not valid."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    kind = F.lit(None).cast("string")
    for name in reversed(KINDS):
        kind = F.when(m.rlike(f"^(?:{KINDS[name]})$"), F.lit(name)).otherwise(kind)
    bound = F.transform(F.array(F.struct(m.alias("m"), kind.alias("kind"), digits.alias("d"), F.length(digits).alias("n"), F.try_to_date(m, "yyyy-MM-dd").alias("day"))), lambda s: _of_kind(s, key))
    return F.element_at(bound, 1)


def _number(x: Column, at: Column | int, n: Column | int) -> Column:
    return F.substring(x, at if isinstance(at, Column) else F.lit(at), n if isinstance(n, Column) else F.lit(n)).cast("long")


def _padded(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _power(e: Column) -> Column:
    return F.pow(F.lit(10.0), e).cast("long")


def _forms(kind: Column, body: Column, m: Column, day: Column) -> list[tuple]:
    """Forms: a condition, a name, a value's two halves, how many values either half has, and what halves are written as.

    Where a condition is the first that holds, the form's numbers are permuted among themselves.

    Forms hold just the numbers that are valid in them, so every pseudonym is valid: social security numbers by area, group
    and serial number; telephone numbers of ten digits by how area and exchange begin, others by whether they begin with 0.
    """
    size = F.length(body)
    half = (size / 2).cast("int")
    octets = F.split(m, "\\.")
    octet = lambda i: F.try_element_at(octets, F.lit(i)).cast("long")
    days = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
    area, exchange, line = _number(body, 1, 3), _number(body, 4, 3), _number(body, 7, 4)
    group, serial = _number(body, 4, 2), _number(body, 6, 4)
    by_area = area - F.when(area > 666, 2).otherwise(1)  # 1 to 665 and 667 to 899
    ten = (kind == "phone") & (size == 10)
    pair = lambda c: F.concat(_padded(F.floor(c / 1000), 3), _padded(c % 1000, 3))
    third = lambda c: F.when(c < 100_000, c + 100_000).otherwise((F.floor((c - 100_000) / 200) + 200) * 1000 + (c - 100_000) % 200)
    rest, tail = _number(body, half + 1, size - half), size - half
    head = _number(body, 1, half)
    least = _power(half - 1)
    return [
        (kind == "ip", "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)),
        (kind == "date", "date", F.floor(days / DAYS[1]), days % DAYS[1], *DAYS, lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS[1] + p["b"]).cast("int")), "yyyy-MM-dd")),
        (kind == "social", "social", by_area * 99 + group - 1, serial - 1, 898 * 99, 9999, lambda p: _let(F.floor(p["a"] / 99), lambda x: F.concat(_padded(x + F.when(x < 665, 1).otherwise(2), 3), _padded(p["a"] % 99 + 1, 2), _padded(p["b"] + 1, 4)))),
        (ten & (area >= 200) & (exchange >= 200), "phone:ab", (area - 200) * 800 + exchange - 200, line, 640_000, 10_000, lambda p: F.concat(_padded(F.floor(p["a"] / 800) + 200, 3), _padded(p["a"] % 800 + 200, 3), _padded(p["b"], 4))),
        (ten & (area < 100), "phone:0", area * 1000 + exchange, line, 100_000, 10_000, lambda p: F.concat(pair(p["a"]), _padded(p["b"], 4))),
        (ten, "phone:1", F.when(area < 200, (area - 100) * 1000 + exchange).otherwise(100_000 + (area - 200) * 200 + exchange), line, 260_000, 10_000, lambda p: F.concat(pair(third(p["a"])), _padded(p["b"], 4))),
        ((kind == "phone") & body.startswith("0"), "phone:zero", head, rest, least, _power(tail), lambda p: F.concat(_padded(p["a"], half), _padded(p["b"], tail))),
        (kind == "phone", "phone:other", head - least, rest, 9 * least, _power(tail), lambda p: F.concat(_padded(p["a"] + least, half), _padded(p["b"], tail))),
        (kind == "card", "card", head, rest, _power(half), _power(tail), lambda p: F.concat(_padded(p["a"], half), _padded(p["b"], tail))),
    ]


def _of_kind(s: Column, key: str) -> Column:
    m, kind, d, n = s["m"], s["kind"], s["d"], s["n"]
    # the digits that change: cards keep no check digit, telephone numbers their country or the 0 before their area
    grouped = F.regexp_extract(m, "^\\+(\\d{1,3})[ .(-]", 1)
    by_table = F.when(d.rlike(f"^(?:{SHORT_CODES[0]})"), 1).when(d.rlike(f"^(?:{SHORT_CODES[1]})"), 2).otherwise(3)
    code = F.when(grouped != "", F.length(grouped)).otherwise(by_table)
    local = n - F.when(m.startswith("+"), code).when(d.startswith("0"), 1).otherwise(F.greatest(n - 10, F.lit(0)))
    body = F.when(kind == "card", F.substring(d, F.lit(1), n - 1)).when(kind == "phone", F.substring(d, n - local + 1, local)).otherwise(d)
    forms = _forms(kind, body, m, s["day"])
    long = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    picked, made = F.lit(None), F.lit(None).cast("string")
    for i, (holds, form, a, b, ma, mb, _) in reversed(list(enumerate(forms))):
        picked = F.when(holds, F.struct(F.lit(i).alias("i"), F.lit(form).alias("form"), long(a).alias("a"), long(b).alias("b"), long(ma).alias("ma"), long(mb).alias("mb"))).otherwise(picked)

    def told(p: Column) -> Column:
        tag = F.concat_ws(":", p["form"], F.when(kind.isin("card", "phone"), F.length(body)))
        skip = F.when(p["form"] == "date", F.lit(LAST_DAY))
        return _let(feistel(p["a"], p["b"], p["ma"], p["mb"], tag, key, skip), lambda q: functools.reduce(lambda rest, f: F.when(p["i"] == f[0], f[1][6](q)).otherwise(rest), reversed(list(enumerate(forms))), made))

    chosen = _let(picked, told)

    def written(made: Column) -> Column:
        check = ((10 - _luhn_sum(made, 0) % 10) % 10).cast("string")
        card = _refilled(F.regexp_replace(m, f"[{MARKS[0]}{MARKS[1]}]", ""), F.concat(made, check))
        phone = _refilled(m, F.concat(F.substring(d, F.lit(1), n - F.length(body)), made))
        return F.when(kind.isin("ip", "date"), made).when(kind == "card", card).when(kind == "phone", phone).otherwise(_refilled(m, made))

    at = F.locate("@", m)
    email = F.concat(F.lit("u"), F.substring(_mac(key, "email", F.lower(m)), 1, 20), m.substr(at, F.length(m)))
    mac = F.concat(_mac(key, "secret", F.lower(m)), _mac(key, "secret2", F.lower(m)))
    secret = F.substring(F.when(m == F.upper(m), F.upper(mac)).otherwise(mac), F.lit(1), F.length(m))
    valid = F.when(kind == "card", _luhn_sum(d, 1) % 10 == 0).when(kind == "date", s["day"].isNotNull()).otherwise(kind.isNotNull())
    return F.when(~F.coalesce(valid, F.lit(False)), m).when(kind == "email", email).when(kind == "secret", secret).otherwise(_let(chosen, written))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with personal data in text_col replaced by pseudonyms of the same form; all other columns are kept.

    Numbers and dates count if they are valid: cards (Luhn's check digit, computed anew; also beside other numbers),
    telephone numbers (the country stays; ten bare digits are no telephone number), social security numbers, IPv4 addresses
    and ISO dates. Within its format each is permuted by a Feistel network keyed with `key` over just the valid values, so
    equal values get equal pseudonyms in all documents, whatever their separators, different values different ones, and
    pseudonyms are valid again (a card's issuer is not kept). Names before an e-mail's domain and long hexadecimal secrets
    become keyed digests of 80 bits and more, which differ but for chance. count_col, if given, gets the number of matches
    that changed. Null and empty texts stay; invalid numbers stay; all other rows and columns are kept as they are,
    repeated ones too. The work grows with a text's length, and no pattern's depth does.
    """
    docs = docs.withColumn(text_col, _marked(F.col(text_col)))
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    made = F.struct(F.split(text, ANY, -1).alias("t"), found.alias("m"), F.transform(found, lambda m: _pseudonym(m, key)).alias("n"))
    cut = docs.withColumn(_CUT, F.when(text.rlike("[0-9@]"), made))  # a projection of its own, so that it is made once
    new = F.array_join(F.transform(F.arrays_zip(F.col(_CUT)["t"].alias("t"), F.col(_CUT)["n"].alias("n")), lambda z: F.concat(z["t"], F.coalesce(z["n"], F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with(F.col(_CUT)["m"], F.col(_CUT)["n"], lambda m, n: m != n), lambda x: x))
    out = {text_col: F.when(F.col(_CUT).isNull(), text).otherwise(new)}
    if count_col is not None:
        out[count_col] = F.when(F.col(_CUT).isNull(), 0).otherwise(changed)
    return cut.withColumns(out).drop(_CUT)
