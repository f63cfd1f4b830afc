"""PII: surrogates for personal data, with DataFrame functions only."""

from __future__ import annotations

import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Given names that are recognised and stand in for each other, by script and gender.
GIVEN = {
    ("latin", "m"): tuple("James John Robert Michael William David Thomas Peter Richard Joseph Charles Daniel Matthew Anthony Mark Steven Andrew Paul Kevin Brian George Edward Ahmed Mohammed Omar Ali Wei Raj Hans Klaus Jürgen Stefan Wolfgang Pierre Jean Luc Marcel Carlos Juan Miguel Pablo José Javier Luis Antonio".split()),
    ("latin", "f"): tuple("Mary Patricia Jennifer Linda Elizabeth Susan Sarah Barbara Jessica Karen Nancy Lisa Margaret Sandra Emily Michelle Laura Anna Alice Emma Julia Fatima Aisha Mei Priya Greta Ursula Monika Sabine Heike Marie Sophie Chloé Camille Claire Lucía Carmen Elena Isabel María Ana Rosa".split()),
    ("cyrillic", "m"): tuple("Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Павел".split()),
    ("cyrillic", "f"): tuple("Анна Мария Ольга Татьяна Наталья Елена Ирина Светлана Екатерина Юлия".split()),
}
#: Titles that lead a name, and those of women among them.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Señora", "Señorita", "господин", "госпожа")
LADIES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "госпожа")
#: Words that end a street's name.
STREETS = ("Street", "Road", "Avenue", "Lane", "Drive", "Boulevard", "Court", "Square")

#: Surnames that are words of the calendar, and mean it where they stand alone.
CALENDAR = "January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Januar Februar März Mai Juni Juli Mars Avril".split()

#: An apostrophe is part of a name (O'Brien), unless it leads a possessive s.
_POSSESSIVE = r"['’][sS](?!\p{L})"
_NAME = rf"\p{{Lu}}(?:[\p{{L}}\-]+|(?=['’]\p{{L}}{{2}}))(?:(?!{_POSSESSIVE})['’]\p{{L}}[\p{{L}}\-]*)*"
#: A surname alone ends where no further part of a name follows.
_END = rf"(?![\p{{L}}\-])(?!(?!{_POSSESSIVE})['’]\p{{L}})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
#: What counts as personal data or a secret, the first that fits at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<=[=:\s\"'])(?=[A-Za-z0-9+/_\-]{8})(?<=(?i:password|passwd|pwd|secret|token|api_key|apikey|api-key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_\-]{8,}",
    "access": r"(?=A)(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z]{2}\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![0-9A-Za-z:])(?=[0-9A-Fa-f:]{0,38}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "address": rf"(?=\d)(?<![\d.,]|\p{{L}})\d{{1,5}} (?:{_NAME} ){{1,3}}(?:{'|'.join(STREETS)})(?!\p{{L}})|(?=\p{{Lu}})(?<!\p{{L}})\p{{L}}+(?:straße|strasse|gasse|platz) \d{{1,4}}(?!\d)",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?=\d{3}-)(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?=\d{4})(?<!\d)(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?!\d)",
    "phone": r"(?=[+(\d])(?:(?:\+\d{1,3}[ .\-]?)?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|\+\d{1,3}([ .\-])\d{1,4}(?:\1\d{2,8}){1,4}(?!\d)|\+\d{8,15}(?!\d)|(?<![\d\-.])\d{3}([ \-.])\d{3}\2\d{4}(?!\d))",
    "name": rf"(?=[\p{{Lu}}г])(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME})?|(?:{_ALL_GIVEN}) {_NAME})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Characters of a text that can't be part of anything above need no look at it.
_HINT = r"[@\d]|(?=[pPsStTaA])(?i:password|passwd|pwd|secret|token|api)|(?=[\p{Lu}г])(?<!\p{L})(?:AKIA|" + "|".join(TITLES) + "|" + _ALL_GIVEN + ")"

_HEX = "0123456789abcdef"
_LETTERS = "bcdfghjkmnpqrstv"
_DIGITS = "0123456789012345"
_ONSETS = "bdfgklmnprstvzhj"
_CYRILLIC = ("бвгдзклмнпрстфхш", "аеиоуыаеиоуыаеио")
_ROUNDS = 40
#: Kinds of given names that no list has, by gender.
_OTHER_GIVEN = ("given_m", "given_f")


def kind(e: Column) -> Column:
    """Type of a matched text."""
    full = lambda name: e.rlike(rf"^(?:{PATTERNS[name]})$")
    out = F.when(e.contains("@"), "email").when(e.rlike("^AKIA[0-9A-Z]{16}$"), "access")
    for name in ("iban", "ip6", "ip", "ssn", "card", "phone", "address", "name"):
        out = out.when(full(name), name)
    return out.otherwise("secret")


def _surname(e: Column) -> Column:
    return F.element_at(F.split(e, " "), -1)


def canonical(e: Column, k: Column) -> Column:
    """What all spellings of one entity share: case and separators don't count; of a name it is the surname, in its masculine form."""
    name = F.regexp_replace(F.lower(_surname(e)), "(ов|ев|ин)а$", "$1")
    return F.when(k.isin("email", "ip6", "address"), F.lower(e)).when(k == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(k.isin("ssn", "card", "phone"), F.regexp_replace(e, r"\D", "")).when(k == "name", name).otherwise(e)


def _reshaped(v: Column, h: Column) -> Column:
    """v with each letter and digit replaced by one that the hash gives; case, marks and length stay."""

    def one(i):
        c, x = F.substr(v, i, F.lit(1)), F.substr(h, F.pmod(i - 1, F.lit(128)) + 1, F.lit(1))
        letter = F.translate(x, _HEX, _LETTERS)
        return F.when(c.rlike(r"\d"), F.translate(x, _HEX, _DIGITS)).when(c.rlike(r"\p{Lu}"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.when(F.length(v) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(v))), one), "")).otherwise(v)


def _hex(v: Column, h: Column) -> Column:
    """v with each of its hexadecimal digits replaced by one of the hash."""
    one = lambda i: F.when(F.substr(v, i, F.lit(1)) == ":", ":").otherwise(F.substr(h, F.pmod(i - 1, F.lit(96)) + 1, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(v))), one), "")


def _luhn(digits: Column) -> Column:
    """The check digit that follows these digits."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(F.pmod(n - i, F.lit(2)) == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def surrogate(k: Column, c: Column, attempt: Column, key: str) -> Column:
    """A replacement for the canonical form of an entity, from a keyed hash of type, form and attempt. Attempts from the fourth on may lengthen short ones."""
    h = F.sha2(F.concat_ws("|", F.lit(key), k, attempt.cast("string"), c).cast("binary"), 512)
    digits, letters = F.translate(h, _HEX, _DIGITS), F.translate(h, _HEX, _LETTERS)
    more = F.when(attempt >= 3, F.substring(digits, 100, 6)).otherwise("")
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    hd = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain).cast("binary"), 512)
    email = F.concat(_reshaped(local, h), more, F.lit("@"), _reshaped(F.regexp_replace(domain, r"\.[^.]*$", ""), hd), F.lit(".example"))
    octet = lambda at, low, span: F.concat((F.pmod(F.conv(F.substring(h, at, 6), 16, 10).cast("long"), F.lit(span)) + low).cast("string"))
    # 240.0.0.0/4 and fd00::/8 are nobody's on the network
    ip = F.concat_ws(".", octet(1, 240, 15), octet(9, 0, 256), octet(17, 0, 256), octet(25, 1, 254))
    ip6 = F.concat(F.lit("fd"), F.substring(h, 100, 2), F.regexp_replace(_hex(c, h), "^[0-9a-f]+", ""))
    # the number, and what tells that it is a street, stay
    kept = F.regexp_extract(c, rf"(?i)( (?:{'|'.join(STREETS)})|(?:straße|strasse|gasse|platz) \d+)$", 1)
    front = F.regexp_extract(c, r"^(\d+ )?", 0)
    address = F.concat(front, more, F.when(more != "", " ").otherwise(""), _reshaped(F.substr(c, F.length(front) + 1, F.length(c) - F.length(front) - F.length(kept)), h), kept)
    card = F.concat(F.substring(c, 1, 1), F.substr(digits, F.lit(1), F.length(c) - 2))
    card = F.concat(card, _luhn(card))
    # the country code of a number written with one stays
    phone = F.concat(F.substr(c, F.lit(1), F.greatest(F.lit(0), F.length(c) - 10)), F.translate(F.substring(digits, 1, 1), "01", "23"), F.substr(digits, F.lit(2), F.least(F.length(c), F.lit(10)) - 1))
    ssn = F.concat(F.lit("9"), F.substring(digits, 1, 8))
    pair = lambda at, a, b: F.concat(F.translate(F.substring(h, at, 1), _HEX, a), F.translate(F.substring(h, at + 1, 1), _HEX, b))
    latin = F.concat(*(pair(i, _ONSETS, "aeiouaeiouaeioua") for i in (1, 3, 5)), F.translate(F.substring(h, 7, 1), _HEX, "lnrstmlnrstmlnrs"))
    cyrillic = F.concat(*(pair(i, *_CYRILLIC) for i in (1, 3)), F.translate(F.substring(h, 5, 1), _HEX, _CYRILLIC[0]), F.lit("ов"))
    longer = F.when(attempt >= 3, pair(20, _ONSETS, "aeiouaeiouaeioua")).otherwise("")
    name = F.when(c.rlike(r"\p{IsCyrillic}"), F.concat(F.when(attempt >= 3, pair(20, *_CYRILLIC)).otherwise(""), cyrillic)).otherwise(F.concat(longer, latin))
    # these end in a consonant, or in an a of a lady's, and have the form of no listed name
    short = F.concat(F.when(attempt >= 3, pair(20, *_CYRILLIC)).otherwise(""), *(pair(i, *_CYRILLIC) for i in (1, 3)), F.translate(F.substring(h, 5, 1), _HEX, _CYRILLIC[0]))
    given_m = F.when(c.rlike(r"\p{IsCyrillic}"), short).otherwise(F.concat(longer, latin))
    given_f = F.concat(given_m, F.when(c.rlike(r"\p{IsCyrillic}"), "а").otherwise("a"))
    secret = F.when(c.rlike("^[0-9a-f]+$"), F.array_join(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(h, F.pmod(i - 1, F.lit(128)) + 1, F.lit(1))), "")).otherwise(_reshaped(c, h))
    access = F.concat(F.lit("AKIA"), _reshaped(F.substring(c, 5, 16), h))
    iban = F.concat(F.substring(c, 1, 2), _reshaped(F.substr(c, F.lit(3)), h))
    out = secret
    for name_of, value in (("email", email), ("ip", ip), ("ip6", ip6), ("address", address), ("card", card), ("phone", phone), ("ssn", ssn), ("name", name), ("access", access), ("iban", iban), ("given_m", given_m), ("given_f", given_f)):
        out = F.when(k == name_of, value).otherwise(out)
    return out


def _given(word: Column, key: str) -> Column:
    """Another given name of the same script and gender: the next one of the list in an order that only the key tells, so different names stay different and none stays itself. Null for other words."""
    pairs = []
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hmac.new(key.encode(), n.encode(), "sha256").digest())
        pairs += zip(order, order[1:] + order[:1])
    return F.element_at(F.create_map(*(F.lit(x) for pair in pairs for x in pair)), word)


def _titled(words: Column) -> Column:
    return F.element_at(words, 1).rlike(rf"^(?:{'|'.join(TITLES)})\.?$")


def other_given(e: Column, k: Column) -> Column:
    """(k, c) of the given name between title and surname, as an entity of its own, where no list has it; else null."""
    words = F.split(e, " ")
    word = F.try_element_at(words, F.lit(2))
    lady = F.element_at(words, 1).rlike(rf"^(?:{'|'.join(LADIES)})\.?$")
    listed = word.isin(*(n for names in GIVEN.values() for n in names))
    return F.when((k == "name") & _titled(words) & (F.size(words) == 3) & ~listed, F.struct(F.when(lady, _OTHER_GIVEN[1]).otherwise(_OTHER_GIVEN[0]).alias("k"), F.lower(word).alias("c")))


def render(e: Column, k: Column, s: Column, given: Column, key: str) -> Column:
    """The surrogate in the format of this occurrence: its separators, case, title and gender. `given`: that of other_given(), or null."""
    chars = F.split(e, "")
    zero = F.struct(F.lit("").alias("t"), F.lit(1).alias("i"))
    digits = F.aggregate(chars, zero, lambda a, c: F.when(c.rlike(r"\d"), F.struct(F.concat(a["t"], F.substr(s, a["i"], F.lit(1))).alias("t"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["t"], c).alias("t"), a["i"].alias("i"))))["t"]
    spaced = F.aggregate(chars, zero, lambda a, c: F.when(c != " ", F.struct(F.concat(a["t"], F.substr(s, a["i"], F.lit(1))).alias("t"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["t"], c).alias("t"), a["i"].alias("i"))))["t"]
    cased = F.when(e == F.upper(e), F.upper(s)).when((k == "address") & ~e.rlike(r"^\p{Lu}\p{L}+ \d"), F.initcap(s)).when(k == "address", F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))).otherwise(s)
    words = F.split(e, " ")
    last = F.when(_surname(e).rlike("(?:ова|ева|ина)$") & s.endswith("ов"), F.concat(s, F.lit("а"))).otherwise(s)
    last = F.when(_surname(e) == F.upper(_surname(e)), F.upper(last)).otherwise(F.concat(F.upper(F.substring(last, 1, 1)), F.substr(last, F.lit(2))))
    titled = _titled(words)
    other = lambda w: F.when(w == F.upper(w), F.upper(given)).otherwise(F.concat(F.upper(F.substring(given, 1, 1)), F.substr(given, F.lit(2))))
    front = F.transform(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), lambda w, i: F.when(titled & (i == 0), w).otherwise(F.coalesce(_given(w, key), other(w))))
    name = F.concat(F.array_join(front, " "), F.when(F.size(words) > 1, " ").otherwise(""), last)
    return F.when(k.isin("ssn", "card", "phone"), digits).when(k == "iban", spaced).when(k.isin("email", "ip6", "address"), cased).when(k == "name", name).otherwise(s)


def _entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def assign(scratch: Scratch, found: DataFrame, key: str) -> DataFrame:
    """(k, c, s) of distinct entities (k, c), with surrogates that differ from each other and from every entity that is there. Those that clash (all but one of each clash) try again, until none does."""
    mine = scratch.keep(found.distinct().withColumn("attempt", F.lit(0)).withColumn("s", surrogate(F.col("k"), F.col("c"), F.lit(0), key)))
    for _ in range(_ROUNDS):
        owner = mine.groupBy("k", "s").agg(F.min(F.struct("attempt", "c")).alias("o"), F.count("*").alias("n")).where("n > 1").select("k", "s", F.col("o.c").alias("owner"))
        # a given name is there for either gender
        kinds = F.when(F.col("k").isin(*_OTHER_GIVEN), F.array(*map(F.lit, _OTHER_GIVEN))).otherwise(F.array("k"))
        real = mine.select(F.explode(kinds).alias("k"), F.col("c").alias("s"), F.lit(True).alias("real")).distinct()
        clash = mine.join(owner, ["k", "s"], "left").join(real, ["k", "s"], "left").where("real or (owner is not null and owner <> c)").select("k", "c")
        clash = scratch.keep(clash)
        if clash.isEmpty():
            return mine
        again = mine.join(clash.withColumn("again", F.lit(1)), ["k", "c"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        mine = scratch.keep(again.withColumn("s", F.when(F.col("again") == 1, surrogate(F.col("k"), F.col("c"), F.col("attempt"), key)).otherwise(F.col("s"))).drop("again"))
    raise RuntimeError("surrogates keep clashing: a type has more entities than replacements")


#: The session's setting that holds the secret key of surrogates, and what queries take where it is unset, as in tests: then anyone can tell which surrogate stands for a guess.
KEY_SETTING, TEST_KEY = "spark.trendlake.pii.key", "for tests only"


def session_key(spark) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


#: Stands around what is found; a text that holds it itself is searched twice instead.
_MARK = "\x01\x02\x03"


def _uid(text: Column) -> Column:
    return F.concat_ws(":", F.xxhash64(text).cast("string"), F.crc32(text.cast("binary")).cast("string"))


def surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The rows of docs(text string, ...) with all their columns, personal data in text replaced, and a struct `pii` (number of replacements `n`, types in order of place `kinds`).

    An entity's replacement depends on `key` (None: the session's, see KEY_SETTING), its type and its canonical form alone, so it is the same in all documents; different entities of a type get different ones, and none equals an entity that is in the documents (see assign()). Replacements keep type, length, separators, case, a name's script, title and gender, a phone's country code, a card's first digit; cards have a valid check digit, network addresses are in ranges that nobody has. A name is found by its title or a given name of the list; where a document has one, its surname alone counts as the same person there.

    Only documents that may hold something are shuffled, keyed by a hash of all their text; the others pass through. A document's own entities alone meet in one row. Null, empty and other texts without finds: unchanged, n = 0. Repeated rows: each one replaced. An empty table gives no rows. Any other columns pass through, except ones named `pii`.
    """
    scratch, key = Scratch(docs.sparkSession, "pii"), key or session_key(docs.sparkSession)
    docs = docs.drop("pii")
    names = docs.columns
    text = F.col("text")
    maybe = F.coalesce(text.rlike(_HINT), F.lit(False))
    none = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kinds"))
    rest = docs.where(~maybe).select(*names, none.alias("pii"))
    own = docs.where(maybe).select(F.struct(*names).alias("row"), _uid(text).alias("uid"))
    seen = docs.where(maybe).select(_uid(text).alias("uid"), F.explode(F.array_distinct(_entities(text))).alias("e"))
    seen = seen.withColumn("k", kind(F.col("e"))).withColumn("c", canonical(F.col("e"), F.col("k"))).select("uid", "e", "k", "c").distinct()
    seen = scratch.keep(seen.withColumn("other", other_given(F.col("e"), F.col("k"))))
    known = assign(scratch, seen.select("k", "c").unionByName(seen.where("other is not null").select("other.*")), key).select("k", "c", "s")
    told = seen.join(known, ["k", "c"])
    given = known.where(F.col("k").isin(*_OTHER_GIVEN)).select(F.struct("k", "c").alias("other"), F.col("s").alias("given"))
    told = told.where("other is null").withColumn("given", F.lit(None).cast("string")).unionByName(told.where("other is not null").join(given, "other"))
    told = told.withColumn("new", render(F.col("e"), F.col("k"), F.col("s"), F.col("given"), key))
    # a surname that stands alone is the same person's
    alone = F.when(F.col("k") == "name", F.struct(_surname(F.col("e")).alias("e"), F.struct(_surname(F.col("new")).alias("new"), F.col("k").alias("k")).alias("v")))
    by_text = told.groupBy("uid").agg(F.collect_list(F.struct("e", F.struct("new", "k").alias("v"))).alias("m"), F.collect_set(alone).alias("bare"))
    said = lambda e, new, k: F.struct(e.alias("e"), F.struct(new.alias("new"), k.alias("k")).alias("v"))
    # a person's name in capitals, or in small letters where it was found in capitals, is that person's too
    spelled = lambda b: F.array_compact(F.array(b, said(F.upper(b["e"]), F.upper(b["v"]["new"]), b["v"]["k"]), F.when(b["e"] == F.upper(b["e"]), said(F.initcap(F.lower(b["e"])), F.initcap(F.lower(b["v"]["new"])), b["v"]["k"]))))
    months = [x for w in CALENDAR for x in (w, w.upper())]
    bare = F.array_sort(F.filter(F.flatten(F.transform("bare", spelled)), lambda b: ~F.exists("m", lambda x: x["e"] == b["e"]) & ~b["e"].isin(*months)))
    # two spellings of a surname may differ in gender: the first one counts
    by_text = by_text.withColumn("bare", bare).withColumn("bare", F.filter("bare", lambda b, i: (i == 0) | (b["e"] != F.get("bare", i - 1)["e"])))
    by_text = by_text.select("uid", F.map_from_entries(F.concat("m", "bare")).alias("m"), F.transform("bare", lambda b: b["e"]).alias("bare"))
    text = F.col("row.text")
    # a word that the text has in small letters is one where it stands alone
    common = lambda w: F.regexp_like(text, F.concat(F.lit(r"(?<!\p{L})"), F.lower(w), F.lit(r"(?!\p{L})")))
    alone = F.array_join(F.filter("bare", lambda w: ~common(w)), "|")
    rows = own.join(by_text, "uid", "left").withColumn("alone", F.coalesce(alone, F.lit("")))
    pattern = F.when(F.col("alone") == "", F.lit(PATTERN)).otherwise(F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), "alone", F.lit(f"){_END}")))
    parts = F.split(F.regexp_replace(text, pattern, F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    twice = F.zip_with(F.split(text, pattern, -1), F.concat(F.regexp_extract_all(text, pattern, F.lit(0)), F.array(F.lit(None).cast("string"))), lambda g, e: F.array(g, e))
    parts = F.when(text.contains(_MARK), F.filter(F.flatten(twice), lambda x: x.isNotNull())).otherwise(parts)
    rows = rows.withColumn("parts", F.when(F.col("m").isNotNull(), parts))
    put = F.transform("parts", lambda x, i: F.when(i % 2 == 0, x).otherwise(F.coalesce(F.element_at(F.col("m"), x)["new"], x)))
    kinds = F.transform(F.filter("parts", lambda x, i: i % 2 == 1), lambda e: F.element_at(F.col("m"), e)["k"])
    rows = rows.select("row", F.coalesce(F.array_join(put, ""), text).alias("text"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))
    return rest.unionByName(rows.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names), F.struct(F.size("kinds").alias("n"), "kinds").alias("pii")))
