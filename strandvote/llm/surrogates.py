"""Surrogates for personal data, by DataFrame functions only.

Mentions are found by one pattern and reduced to a canonical form, so that mentions of one entity
share one. Each distinct entity gets a surrogate core from a keyed digest: same kind, alphabet, case,
length and checksum; names keep gender and script. Surnames that are declined by gender share the entity of
their masculine form, and a mention gets the ending of its own gender. Cores that meet another core or a real
entity are drawn again; those that still meet one take the free forms of their shape in turn. Each mention is
then written in its own format from the core. A full name that stands with a title once is replaced in its
whole document, with or without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import internal, spread, table, written

KEY, ROUNDS = "surrogates-1", 25

_TITLES = {"m": "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Dra|Госпожа|Κυρία", "any": "Dr|Prof|Доктор|Профессор"}
_TITLE = "|".join(_TITLES.values())
#: A part of a name; an apostrophe before a last s is no part of it.
_NAME = r"\p{Lu}(?:[\p{L}-]|['’](?!s(?!\p{L}))){1,40}+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kinds in the order in which they are tried, all at a place that follows no letter or digit, so that the inside
#: of words is passed over by one check; no part holds a group that could run back over a long text.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+(?<![.-])",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ip6": r"(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{0,39}\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?:[0-9a-f]{32,}+|(?:AKIA|ghp_|sk-)[A-Za-z0-9_-]{16,}+)(?![A-Za-z0-9])|(?<=[=:] ?[\"'])[^\"'\s]{8,}+(?=[\"'])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<!\+)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "card": r"(?<!-)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)",
    "name": rf"(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,3}}",
}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"

_LATIN, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
#: Alphabets by the class of letters that each replaces.
_ALPHABETS = {r"\p{IsCyrillic}": _CYRILLIC, r"\p{IsGreek}": _GREEK, r"\p{IsLatin}": _LATIN}
_GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leon Martin Oscar Paul Simon Victor".split(),
    ("f", "latin"): "Alma Bella Clara Diana Elena Flora Helena Irene Julia Laura Maria Nora Paula Rosa Vera".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Денис Егор Иван Кирилл Леонид Марк Олег Павел Роман".split(),
    ("f", "cyrillic"): "Алла Вера Галина Дарья Елена Зоя Ирина Лариса Мария Нина Ольга София".split(),
    ("m", "greek"): "Αλέξης Γιάννης Δημήτρης Κώστας Λευτέρης Μανώλης Νίκος Πέτρος Σπύρος Τάσος Φίλιππος Χρήστος".split(),
    ("f", "greek"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Σοφία".split(),
}
#: Endings of given names that are drawn again.
_ENDINGS = {("m", "latin"): "us", ("f", "latin"): "a", ("m", "cyrillic"): "ан", ("f", "cyrillic"): "а", ("m", "greek"): "ος", ("f", "greek"): "α"}
#: Endings of declined surnames: feminine ones, with what the masculine form has in their place.
_FEMININE = {"cyrillic": [(r"(ов|ев|ёв|ин|ын)а$", "$1"), (r"(ск|цк)ая$", "$1ий")], "greek": [(r"(ιδ|αδ)ου$", "$1ης"), (r"πουλου$", "πουλος"), (r"ακη$", "ακης")]}
_MASCULINE_CYRILLIC = r"(?:ов|ев|ёв|ин|ын|ский|цкий)$"
_SYLLABLES = {"latin": "ba be bo da del dor fa fen gar gol ha hol ja kar kel la len lor ma mer mon na nor pa per ra rin ro sa sel ta tor va wen".split(), "cyrillic": "ба бе во га гор да дол ев жа зор ка кол ла лен ма мир на нов па пет ра рин са сел та тор ха цел ша".split(), "greek": "βα γε δο ζα θε κα κο λα λε μα μι να νε πα πε ρα ρο σα τα τι φα χα".split()}


def _pick(choices: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (number % len(choices)).cast("int") + 1)


def _byte(digest: Column, i: Column | int) -> Column:
    """Byte i of a hex digest of 64 bytes, from 0 and around."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64 * 2 + 1
    return F.conv(F.substring(digest, at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _digest(key: str, *parts: Column) -> Column:
    text = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(F.concat(text, F.lit("\x1f1")), 256), F.sha2(F.concat(text, F.lit("\x1f2")), 256))


def _swapped(text: Column, digest: Column, hexadecimal: Column) -> Column:
    """text with each digit and letter replaced by one of its own class and script."""

    def swap(c: Column, i: Column) -> Column:
        n = _byte(digest, i)
        small = F.lower(c)
        new = F.when(hexadecimal & small.between("a", "f"), _pick(list("abcdef"), n)).when(small.between("a", "z"), _pick(list(_LATIN), n))
        for script, letters in _ALPHABETS.items():
            new = new.when(small.rlike(script), _pick(list(letters), n))
        return F.when(c.between("0", "9"), _pick(list("0123456789"), n)).when(new.isNotNull(), F.when(c != small, F.upper(new)).otherwise(new)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def _luhn_sum(digits: Column, first: int) -> Column:
    """Luhn sum of a digit string read from the right; first: 1 if its last digit is doubled."""

    def part(c: Column, i: Column) -> Column:
        n = c.cast("int") * F.when((i + first) % 2 == 1, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, b: a + b)


def _name_core(kind: Column, digest: Column, attempt: Column) -> Column:
    more = lambda script, a, b: F.concat(*[_pick(_SYLLABLES[script], _byte(digest, i) * 7 + _byte(digest, i + 20)) for i in range(a, b)])
    longer = lambda script, a: F.when(attempt > 8, more(script, a, a + 4)).otherwise(F.lit(""))  # noqa: E731  # short forms run out
    ending = {"surname_cyrillic": ("cyrillic", "ов"), "surname_plain": ("cyrillic", "енко"), "surname_greek": ("greek", "ιδης"), "surname_latin": ("latin", "")}
    out = F.when(F.lit(False), F.lit(""))
    for name, (script, last) in ending.items():
        out = out.when(kind == name, F.concat(more(script, 0, 5 if script == "latin" else 4), longer(script, 6), F.lit(last)))
    for (gender, script), names in _GIVEN.items():
        again = F.concat(more(script, 1, 4), longer(script, 5), F.lit(_ENDINGS[gender, script]))
        out = out.when(kind == f"given_{gender}_{script}", F.lower(F.concat(_pick(names, _byte(digest, 0)), F.when(attempt > 0, again).otherwise(F.lit("")))))
    return out


def _ip6_core(canon: Column, digest: Column) -> Column:
    """Groups of the same lengths without leading zeros; zeros stay, so that what :: stands for does too."""
    digit = lambda i: lambda c, j: F.when(c == "0", c).otherwise(_pick(list("123456789abcdef"), _byte(digest, i * 4 + j)))
    return F.array_join(F.transform(F.split(canon, ":"), lambda g, i: F.array_join(F.transform(F.split(g, ""), digit(i)), "")), ":")


def _ip6_groups(mention: Column) -> Column:
    """All groups of an address, without leading zeros, joined by colons."""
    part = lambda i: F.filter(F.split(F.split_part(F.lower(mention), F.lit("::"), F.lit(i)), ":"), lambda g: g != "")
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(part(1)) - F.size(part(2))))
    return F.array_join(F.transform(F.concat(part(1), zeros, part(2)), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def _ip6_like(mention: Column, core_1: Column) -> Column:
    """core_1 with the groups, leading zeros and case of mention."""
    tokens, groups = F.split(mention, ":", -1), F.split(core_1, ":")
    gap = F.array_position(tokens, "")

    def put(t: Column, i: Column) -> Column:
        at = F.when((gap == 0) | (i < gap - 1), i).otherwise(F.size(groups) - F.size(tokens) + i)
        own = F.try_element_at(groups, (at + 1).cast("int"))
        own = F.lpad(own, F.greatest(F.length(t), F.length(own)), F.lit("0"))
        return F.when(t == "", t).when((t != F.lower(t)), F.upper(own)).otherwise(own)

    return F.array_join(F.transform(tokens, put), ":")


def _domain(canon: Column, key: str) -> Column:
    """The surrogate of an e-mail's domain, the same for all of its addresses."""
    domain = F.substring_index(canon, "@", -1)
    cut = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(cut))
    return F.concat(_swapped(host, _digest(key, F.lit("domain"), domain), F.lit(False)), cut)


def core(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of a canonical form: a canonical form of the same kind."""
    digest = _digest(key, kind, canon, attempt.cast("string"))
    no = F.lit(False)
    email = F.concat(_swapped(F.substring_index(canon, "@", 1), digest, no), F.lit("@"), _domain(canon, key))
    ip = F.concat_ws(".", *[(_byte(digest, i) % 254 + 1).cast("string") for i in range(4)])
    swapped = _swapped(canon, digest, canon.rlike("^[0-9a-f]+$"))
    phone = F.concat((_byte(digest, 63) % 8 + 2).cast("string"), F.substring(swapped, 2, 100))
    body = F.concat(F.substring(canon, 1, 1), F.substring(swapped, F.lit(2), F.length(canon) - 2))
    check = ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string")
    card = F.concat(body, F.when(_luhn_sum(canon, 0) % 10 == 0, check).otherwise(F.substring(swapped, -1, 1)))
    iban = F.concat(F.substring(canon, 1, 2), F.substring(swapped, 3, 100))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", _ip6_core(canon, digest)).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban).when(kind.isin("secret", "ssn"), swapped).otherwise(_name_core(kind, digest, attempt))


def _kind(mention: Column) -> Column:
    """The first kind of PATTERNS that the mention is, judged without what stands around it."""
    out = F.when(mention.rlike(r"^[^@\s]+@[^@\s]+$"), "email").when(mention.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
    out = out.when(mention.rlike(r"^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|^[0-9A-Fa-f:]+::[0-9A-Fa-f:]+$"), "ip6").when(mention.rlike(rf"^(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,3}}$"), "name")
    out = out.when(mention.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4})+$"), "iban").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
    out = out.when(mention.rlike(r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})$"), "card")
    return out.when(mention.rlike(r"^[+(\d][\d .()+-]*$") & (F.length(F.regexp_replace(mention, r"\D", "")) <= 13), "phone").otherwise("secret")


def _bare(mention: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(mention, rf"^(?:{_TITLE})\.? ", "")


def _toneless(surname: Column) -> Column:
    return F.translate(surname, "άέήίόύώϊΐϋΰ", "αεηιουωιιυυ")


def _masculine(surname: Column) -> Column:
    """The masculine form, in lower case and Greek without accents, of a surname."""
    out = _toneless(surname)
    for ending, own in [x for rules in _FEMININE.values() for x in rules]:
        out = F.regexp_replace(out, ending, own)
    return out


def entities(mentions: DataFrame) -> DataFrame:
    """mentions (columns mention and, of several rows, row) with kind_1, canon_1 and, for names of two words and more, kind_2, canon_2.

    The last word is the surname. A full name has one gender in a row: that of its own title, else that of another
    mention's title, else what the first word's ending says.
    """
    m, kind = F.col("mention"), F.col("_kind")
    bare = _bare(m)
    two = (kind == "name") & bare.contains(" ")
    by_ending = F.when(F.substring_index(bare, " ", 1).rlike("[aаяαη]$"), "f").otherwise("m")
    titled = F.when(m.rlike(rf"^(?:{_TITLES['m']})\.? "), "m").when(m.rlike(rf"^(?:{_TITLES['f']})\.? "), "f")
    of_row = ["row"] if "row" in mentions.columns else []
    gender = F.coalesce("_titled", F.max("_titled").over(W.partitionBy(*of_row, F.lower(bare))), by_ending)
    script = F.when(bare.rlike(r"\p{IsCyrillic}"), "cyrillic").when(bare.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    digits, first, last = F.regexp_replace(m, r"\D", ""), F.lower(F.regexp_replace(bare, " [^ ]+$", "")), _masculine(F.lower(F.substring_index(bare, " ", -1)))
    canon = F.when(kind == "email", F.lower(m)).when(kind == "ip6", _ip6_groups(m)).when(kind == "phone", F.substring(digits, -10, 10)).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(kind == "name", F.when(two, first).otherwise(last)).otherwise(m)
    plain = (script == "cyrillic") & ~last.rlike(_MASCULINE_CYRILLIC)
    surname = F.when(plain, "surname_plain").otherwise(F.concat(F.lit("surname_"), script))
    out = mentions.withColumns({"_kind": _kind(m), "_titled": titled})
    return out.select(
        *mentions.columns, F.when(two, F.concat_ws("_", F.lit("given"), gender, script)).when(kind == "name", surname).otherwise(kind).alias("kind_1"),
        canon.alias("canon_1"), F.when(two, surname).alias("kind_2"), F.when(two, last).alias("canon_2"),
    )


def _shape(kind: Column, canon: Column, domain: Column) -> Column:
    """What the forms of a core have in common: head and tail, the characters that may stand at each place between, and
    whether a check digit follows."""
    luhn = (kind == "card") & (_luhn_sum(canon, 0) % 10 == 0)
    head = F.when(kind == "iban", F.substring(canon, 1, 2)).when(kind == "card", F.substring(canon, 1, 1)).otherwise(F.lit(""))
    body = F.when(kind == "email", F.substring_index(canon, "@", 1)).otherwise(F.substring(canon, F.length(head) + 1, F.length(canon) - F.length(head) - luhn.cast("int")))
    hexadecimal = (kind != "email") & canon.rlike("^[0-9a-f]+$")

    def choices(c: Column, i: Column) -> Column:
        small = F.lower(c)
        letters = F.when(hexadecimal & small.between("a", "f"), F.lit("abcdef")).when(small.between("a", "z"), F.lit(_LATIN))
        for script, alphabet in _ALPHABETS.items():
            letters = letters.when(small.rlike(script), F.lit(alphabet))
        letters = F.when(c != small, F.upper(letters)).otherwise(letters)
        digits = F.when((kind == "phone") & (i == 0), F.lit("23456789")).otherwise(F.lit("0123456789"))
        ip6 = F.when(c.isin("0", ":"), c).otherwise(F.lit("123456789abcdef"))
        return F.when(kind == "ip6", ip6).when(c.between("0", "9"), digits).otherwise(F.coalesce(letters, c))

    return F.struct(kind.alias("kind"), head.alias("head"), F.transform(F.split(body, ""), choices).alias("places"), F.when(kind == "email", F.concat(F.lit("@"), domain)).otherwise(F.lit("")).alias("tail"), luhn.alias("luhn"))


def _form(shape: Column, number: Column) -> Column:
    """Form number, from 0, of a shape."""
    start = F.struct(F.lit("").alias("text"), number.cast("long").alias("left"))

    def put(acc: Column, choices: Column) -> Column:
        n = F.length(choices)
        digit = (acc["left"] % n).cast("int")
        return F.struct(F.concat(acc["text"], F.substring(choices, digit + 1, F.lit(1))).alias("text"), F.floor((acc["left"] - digit) / n).cast("long").alias("left"))

    text = F.concat(shape["head"], F.aggregate(shape["places"], start, put)["text"])
    return F.concat(text, F.when(shape["luhn"], ((10 - _luhn_sum(text, 1) % 10) % 10).cast("string")).otherwise(F.lit("")), shape["tail"])


def _free_forms(stuck: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """kind, canon and core of the stuck entities (kind, canon): by shape, the first free forms from a keyed one on.

    Of as many forms as are taken or asked for in a shape, enough are free, unless the shape has no more.
    """
    asked = stuck.withColumn("shape", _shape(F.col("kind"), F.col("canon"), _domain(F.col("canon"), key)))
    asked = asked.withColumn("rank", F.row_number().over(W.partitionBy("shape").orderBy("canon")))
    used = taken.select(_shape(F.col("kind"), F.col("core"), F.substring_index("core", "@", -1)).alias("shape")).groupBy("shape").agg(F.count("*").alias("used"))
    shapes = asked.groupBy("shape").agg(F.count("*").alias("asked")).join(used, "shape", "left")
    space = F.least(F.aggregate("shape.places", F.lit(1.0), lambda a, b: a * F.length(b)), F.lit(2.0**52)).cast("long")
    shapes = shapes.withColumn("space", space).withColumn("tried", F.least("space", F.col("asked") + F.coalesce("used", F.lit(0))))
    tries = shapes.select("shape", "space", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tried") - 1)).alias("i"))
    first = F.pmod(F.xxhash64(F.lit(key), "shape.kind", "shape.head", F.array_join("shape.places", ""), "shape.tail"), "space")
    forms = tries.select("shape", "i", F.col("shape.kind").alias("kind"), _form(F.col("shape"), (first + F.col("i")) % F.col("space")).alias("core"))
    free = forms.join(taken, ["kind", "core"], "left_anti").withColumn("rank", F.row_number().over(W.partitionBy("shape").orderBy("i")))
    return asked.join(free.select("shape", "rank", "core"), ["shape", "rank"]).select("kind", "canon", "core")


def cores(found: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon and core of every distinct entity; cores are distinct, and none is an entity of the corpus.

    Entities whose core is taken draw again, ROUNDS times; the one with the least canonical form keeps it. Those
    that are left take free forms of their shape. A shape with more entities than forms can't be served, which is
    an error.
    """
    every = found.select(F.col("kind_1").alias("kind"), F.col("canon_1").alias("canon")).union(found.where("kind_2 IS NOT NULL").select("kind_2", "canon_2"))
    every = written(every.distinct(), "entities")
    state = written(every.withColumn("attempt", F.lit(0)).withColumn("core", core(F.col("kind"), F.col("canon"), F.lit(0), key)), "cores")
    for attempt in range(ROUNDS + 1):
        keeper = state.groupBy("kind", "core").agg(F.min("canon").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
        real = state.join(every.select("kind", F.col("canon").alias("core")), ["kind", "core"], "left_semi").select("kind", "canon")
        bad = state.join(keeper, ["kind", "core"]).where("canon <> keeper").select("kind", "canon").union(real).distinct()
        bad = written(bad.withColumn("again", F.lit(1)), "collisions")
        if bad.isEmpty():
            return state.select("kind", "canon", "core")
        if attempt == ROUNDS:
            break
        state = state.join(bad, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        drawn = F.when(F.col("again").isNotNull(), core(F.col("kind"), F.col("canon"), F.col("attempt"), key)).otherwise(F.col("core"))
        state = written(state.select("kind", "canon", "attempt", drawn.alias("core")), "cores")
    stuck = bad.select("kind", "canon")
    settled = state.join(stuck, ["kind", "canon"], "left_anti").select("kind", "canon", "core")
    taken = settled.select("kind", "core").union(every.select("kind", "canon")).distinct()
    given = written(_free_forms(stuck, taken, key), "free-forms")
    if given.count() < stuck.count():
        raise ValueError("some entities still share a surrogate: a shape has too few forms")
    return settled.union(given)


def _like(mention: Column, core_1: Column) -> Column:
    """core_1 in the letter case of mention, character by character."""
    case = lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(core_1, i + 1, F.lit(1)))).otherwise(F.substring(core_1, i + 1, F.lit(1)))
    return F.array_join(F.transform(F.split(mention, ""), case), "")


def _filled(mention: Column, pattern: str, core_1: Column) -> Column:
    """mention with its characters of the pattern replaced, from the right, by those of core_1; what is left over stays."""
    size = F.length(F.regexp_replace(mention, f"[^{pattern}]", ""))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("seen"))

    def put(acc: Column, c: Column) -> Column:
        mine = c.rlike(f"[{pattern}]")
        at = acc["seen"] - (size - F.length(core_1))
        new = F.when(mine & (at >= 0), F.substring(core_1, at + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["text"], new).alias("text"), (acc["seen"] + mine.cast("int")).alias("seen"))

    return F.aggregate(F.split(mention, ""), start, put)["text"]


def _declined(mention: Column, surname: Column) -> Column:
    """A surname's core with the ending of the mention's gender."""
    last = _toneless(F.lower(mention))
    cyrillic = F.lit(False)
    for ending, _ in _FEMININE["cyrillic"]:
        cyrillic = cyrillic | last.rlike(ending)
    greek = mention.rlike(rf"^(?:{_TITLES['f']})\.? ")
    for ending, _ in _FEMININE["greek"]:
        greek = greek | last.rlike(ending)
    return F.when(surname.rlike("ов$") & cyrillic, F.concat(surname, F.lit("а"))).otherwise(F.regexp_replace(surname, "ιδης$", F.when(greek, "ίδου").otherwise("ίδης")))


def _new_name(mention: Column, core_1: Column, core_2: Column) -> Column:
    """The surrogate of a name, without its title."""
    one, two = F.when(core_2.isNull(), _declined(mention, core_1)).otherwise(core_1), _declined(mention, core_2)
    bare = _bare(mention)
    first, last = F.regexp_replace(bare, " [^ ]+$", ""), F.substring_index(bare, " ", -1)
    return F.concat_ws(" ", _in_form(F.when(core_2.isNull(), last).otherwise(first), one), _in_form(last, two))


def _in_form(mention: Column, core_1: Column) -> Column:
    """A name's core in capitals if the mention is, and in two parts if the mention has a hyphen."""
    half = F.floor(F.length(core_1) / 2).cast("int")
    name = F.when(mention.contains("-"), F.concat(F.initcap(F.substring(core_1, F.lit(1), half)), F.lit("-"), F.initcap(F.substring(core_1, half + 1, F.length(core_1))))).otherwise(F.initcap(core_1))
    return F.when(mention == F.upper(mention), F.upper(name)).otherwise(name)


def rendered(kind: Column, mention: Column, core_1: Column, core_2: Column) -> Column:
    title = F.regexp_extract(mention, rf"^(?:{_TITLE})\.? ", 0)
    return (
        F.when(kind == "email", _like(mention, core_1))
        .when(kind.isin("phone", "card", "ssn"), _filled(mention, "0-9", core_1))
        .when(kind == "iban", _filled(mention, "0-9A-Z", core_1))
        .when(kind == "ip6", _ip6_like(mention, core_1))
        .when(kind.isin("ip", "secret"), core_1)
        .otherwise(F.concat(title, _new_name(mention, core_1, core_2)))
    )


def _whole(name: Column) -> Column:
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])"), name, F.lit(r"(?![\p{L}\p{N}])"))


def _of_part(known: DataFrame, found: DataFrame, part: int) -> DataFrame:
    """Cores of the first or second parts of mentions, with n, the mentions of each; an entity of very many is spread."""
    kind, canon = f"kind_{part}", f"canon_{part}"
    counts = found.where(f"{kind} IS NOT NULL").groupBy(kind, canon).agg(F.count("*").alias("n"))
    cores_of_part = known.select(F.col("kind").alias(kind), F.col("canon").alias(canon), F.col("core").alias(f"core_{part}"))
    return written(counts.join(cores_of_part, [kind, canon]), "part-cores")


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with surrogates, n_entities (mentions replaced) and kinds (distinct, sorted), one row a document.

    A null text stays null and an empty one empty, both without entities. Rows are told apart by a number
    given when they are written, so repeated ids and repeated rows are harmless.
    """
    docs = internal(docs, "doc_id", "text")
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    hits = docs.where(has).select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("text", PATTERN, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("mentions"))
    hits = written(hits, "mentions")
    found = written(entities(hits.select("row", F.posexplode("mentions").alias("at", "mention"))), "found")
    known = cores(found, key)
    map_1, map_2 = _of_part(known, found, 1), _of_part(known, found, 2)
    with_1 = spread(found, map_1, ["kind_1", "canon_1"], "row", "n")
    single = with_1.where("kind_2 IS NULL").withColumn("core_2", F.lit(None).cast("string"))
    double = spread(with_1.where("kind_2 IS NOT NULL"), map_2, ["kind_2", "canon_2"], "row", "n")
    m, c1, c2 = F.col("mention"), F.col("core_1"), F.col("core_2")
    full = F.when(c2.isNotNull(), F.struct(_bare(m).alias("old"), _new_name(m, c1, c2).alias("new")))
    new = single.unionByName(double).select("row", "at", F.regexp_extract("kind_1", "^[a-z0-9]+", 0).alias("kind"), rendered(F.col("kind_1"), m, c1, c2).alias("new"), full.alias("full"))
    of_row = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("new"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.array_sort(F.collect_set("full")).alias("names"))
    # full names of the document that stand without a title, between the mentions
    untitled = F.aggregate("names", F.lit(0), lambda n, x: n + F.aggregate("gaps", F.lit(0), lambda k, g: k + F.regexp_count(g, _whole(x["old"]))))
    gaps = F.transform("gaps", lambda g: F.aggregate("names", g, lambda t, x: F.regexp_replace(t, _whole(x["old"]), x["new"])))
    of_row = hits.join(of_row, "row").select("doc_id", "new", "kinds", (F.size("new") + untitled).cast("long").alias("n_entities"), F.when(F.size("names") > 0, gaps).otherwise(F.col("gaps")).alias("gaps"))
    text = F.concat(F.array_join(F.zip_with(F.slice("gaps", F.lit(1), F.size("new")), "new", lambda g, n: F.concat(g, n["new"])), ""), F.element_at("gaps", -1))
    changed = of_row.select("doc_id", text.alias("text"), "n_entities", "kinds")
    return docs.where(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds")).union(changed)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(table(spark, sf_dir, "documents"))


