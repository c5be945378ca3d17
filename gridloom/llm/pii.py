"""Personal data replaced by keyed surrogates of the same type and format.

Only DataFrame functions are used.  One pattern finds all entities; each is
brought to a canonical form (digits of a phone or card number, lower-case mail
address), so that the same entity written differently keeps one identity.  The
distinct entities of the corpus get surrogates from a keyed hash: digits stay
digits, letters keep script and case, cards keep their first digit and bank
accounts their country, both whether their check digits hold, mail addresses get
reserved domains, private network addresses stay private, names keep number of
words, gender and script.  Surrogates that meet each other or a
real entity are drawn anew until all are distinct, and every mention of an
entity, in whatever document, gets the same one in its own format.  A name
found behind a form of address is replaced without one too in its document, and
a surname alone stands for the full name that has it there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, row_key
from .quality_rules import _let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
MALE, FEMALE = "Mr|Herr|Monsieur|Señor|Sr|Г-н", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа"
_WORD = r"\p{Lu}(?:[\p{Ll}-]|[’'](?!s(?!\p{L})))*\p{Ll}"

#: In the order in which they are tried at one place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9_-])"
    r"|(?<=[=:\"']|[=:] |[=:]  )(?=[A-Za-z0-9+/_.=-]{8})(?<=(?i:token|secret|passwd|password|apikey|api_key|api-key|access_key)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9+/_.=-]{8,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\w]|\.\d)",
    "ipv6": rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{6}}(?:{_OCTET}\.){{3}}{_OCTET}|(?=[0-9A-Fa-f:]*(?:\d|[A-Fa-f]{{4}}))(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:(?:{_HEX}:){{0,6}}(?:(?:{_OCTET}\.){{3}}{_OCTET}|{_HEX}))?)(?!\w|:[0-9A-Fa-f:]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\w)"
    r"|(?<![\w+.-])(?<!\d )\d{3} \d{3}[ .-]\d{4}(?!\w|[ .,-]\d)"
    r"|(?<![\w+./:-])(?<!\d )(?=\(?0(?:[ /)-]{0,2}\d){7,13}(?!\w))(?:\(0\d{1,4}\)|0\d{2,4})(?:[ /] ?\d{2,8}(?:[ -]\d{2,5}){0,4}|-\d{5,8})(?!\w|[./:-]\d)",
    "card": r"(?<![\w-])(?:\d{4}[ -]?){3}\d{1,7}(?![\w-])|(?<![\w-])\d{4}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "name": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? {_WORD}(?: {_WORD})?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds: a digit, an at sign, an assignment, a known prefix, a long hex run or a form of address.  It spares most texts the full pattern.
HINT = rf"[0-9@=:]|sk-|gh[pousr]_|A[KS]IA|[a-f]{{32}}|[A-F]{{32}}|(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? \p{{Lu}}"

SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so".split(),
    "cyrillic": "ба бе бо да де до фа фе фо га го ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со".split(),
}
#: Endings of made-up names by script and gender.
ENDINGS = {("latin", "m"): "rdo", ("latin", "f"): "lina", ("cyrillic", "m"): "слав", ("cyrillic", "f"): "лина"}
DOMAINS = ("example.com", "example.net", "example.org")
#: Surrogates of so many characters in all are broadcast to the documents; more are joined by a shuffle, with equal results.
BROADCAST_BYTES = 32 << 20


def kind_of(value: Column) -> Column:
    """The type of a found entity: the first whose pattern fits it alone, secrets by default."""
    out = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k != "secret"]):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def canonical_of(kind: Column, value: Column) -> Column:
    """What identifies an entity, however it is written."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    name = F.regexp_replace(value, rf"^(?:{MALE}|{FEMALE})\.? ", "")
    gender = F.when(value.rlike(rf"^(?:{FEMALE})\.? "), "f").otherwise("m")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind.isin("email", "ipv6"), F.lower(value))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .when(kind == "name", F.concat(gender, F.lit(" "), name))
        .otherwise(value)
    )


def _full(name: Column) -> Column:
    return name.contains(" ")


def people_of(text: Column) -> Column:
    """The canonical names found in a text, full ones first, else in their order."""
    name = rf"^(?:{PATTERNS['name']})$"
    found = F.filter(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda x: x.rlike(name))
    people = F.array_distinct(F.transform(found, lambda x: canonical_of(F.lit("name"), x)))
    return _let(people, lambda p: F.concat(F.filter(p, lambda x: _full(F.substring(x, F.lit(3), F.length(x)))), F.filter(p, lambda x: ~_full(F.substring(x, F.lit(3), F.length(x))))))


def pattern_with(people: Column) -> Column:
    """PATTERN, and the names and surnames of ``people`` without a form of address, the longest first."""
    names = F.transform(people, lambda p: F.substring(p, F.lit(3), F.length(p)))
    forms = F.array_distinct(F.concat(names, F.transform(names, lambda n: F.substring_index(n, " ", -1))))
    longest = F.array_sort(forms, lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(people) > 0, F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))).otherwise(PATTERN)


def person_of(people: Column, value: Column) -> Column:
    """Whom of ``people`` a mention names, by full name or surname and, behind a form of address, gender; else null."""
    title = rf"^(?:{MALE}|{FEMALE})\.? "
    name = F.regexp_replace(value, title, "")
    gender = F.when(value.rlike(title), F.substring(canonical_of(F.lit("name"), value), 1, 1))
    fits = lambda p: F.coalesce(F.substring(p, 1, 1) == gender, F.lit(True)) & ((F.substring(p, F.lit(3), F.length(p)) == name) | (F.substring_index(F.substring(p, F.lit(3), F.length(p)), " ", -1) == name))
    return F.get(F.filter(people, fits), F.lit(0))


def _number(h: Column, place: Column, below: int) -> Column:
    """A pseudorandom number below 256 at one place of a hex digest."""
    return F.conv(F.substring(h, F.pmod(place * 2, F.lit(128)).cast("int") + 1, F.lit(2)), 16, 10).cast("int") % below


def _alike(value: Column, h: Column) -> Column:
    """``value`` with every digit and letter replaced by one of its kind."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: F.substring(F.lit(letters), _number(h, i, len(letters)) + 1, F.lit(1))
        return (
            F.when(c.rlike("^[0-9]$"), pick("0123456789"))
            .when(c.rlike("^[a-f]$"), pick("abcdef"))
            .when(c.rlike("^[A-F]$"), pick("ABCDEF"))
            .when(c.rlike("^[g-z]$"), pick("ghijklmnopqrstuvwxyz"))
            .when(c.rlike("^[G-Z]$"), pick("GHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"^[\p{IsCyrillic}&&\p{Ll}]$"), pick("абвгдежзиклмнопрстуф"))
            .when(c.rlike(r"^[\p{IsCyrillic}&&\p{Lu}]$"), pick("АБВГДЕЖЗИКЛМНОПРСТУФ"))
            .when(c.rlike(r"^\p{Ll}$"), pick("àáâäèéêëìíîïòóôöùúûü"))
            .when(c.rlike(r"^\p{Lu}$"), pick("ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 for a valid card number."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _card(value: Column, h: Column) -> Column:
    body = F.concat(F.substring(value, 1, 1), _alike(F.substring(value, F.lit(2), F.length(value) - 2), h))
    last = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10 + _luhn(value) % 10, F.lit(10))
    return F.concat(body, last.cast("string"))


def _mod_97(text: Column) -> Column:
    """The remainder by 97 of a number in which letters stand for 10 to 35."""
    one = lambda s, c: F.when(c.rlike("^[0-9]$"), s * 10 + c.cast("int")).otherwise(s * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: one(s, c).cast("int"))


def _iban(value: Column, h: Column) -> Column:
    """Country as before, check digits that hold if and only if they did."""
    country, body = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))
    new = _alike(body, h)
    check = lambda body: 98 - _mod_97(F.concat(body, country, F.lit("00")))
    held = F.lpad(check(body).cast("string"), 2, "0") == F.substring(value, 3, 2)
    return F.concat(country, F.lpad((check(new) - F.when(held, 0).otherwise(1)).cast("string"), 2, "0"), new)


#: Private and local networks, as (pattern, fixed part, octets to fill); other addresses stay public.
NETWORKS = [(r"^10\.", "10", 3), (r"^192\.168\.", "192.168", 2), (r"^127\.", "127", 3), (r"^169\.254\.", "169.254", 2), (r"^172\.(1[6-9]|2\d|3[01])\.", "172", 3)]


def _ip(value: Column, h: Column, attempt: Column) -> Column:
    """An address of the same network if that is private, else a public one; later attempts leave networks that have no free address."""
    octet = lambda i, below, least: (_number(h, F.lit(i), below) + least).cast("string")
    out = F.concat_ws(".", octet(0, 89, 11), *(octet(i, 254, 1) for i in (1, 2, 3)))
    for pattern, fixed, n in NETWORKS:
        filled = [octet(i, 16, 16) if fixed == "172" and i == 1 else octet(i, 254, 1) for i in range(4 - n, 4)]
        out = F.when(value.rlike(pattern) & (attempt < 10), F.concat_ws(".", F.lit(fixed), *filled)).otherwise(out)
    return out


def _name(value: Column, h: Column, attempt: Column) -> Column:
    gender = F.substring(value, 1, 1)
    words = F.split(F.substring(value, F.lit(3), F.length(value)), " ")
    made = lambda script: F.array_join(
        F.transform(
            words,
            lambda w, i: F.initcap(
                F.concat(
                    F.array_join(F.transform(F.sequence(F.lit(0), attempt + 1), lambda k: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), _number(h, i * 16 + k, len(SYLLABLES[script])) + 1)), ""),
                    F.when((i == 0) & (gender == "f"), ENDINGS[script, "f"]).when(i == 0, ENDINGS[script, "m"]).otherwise(SYLLABLES[script][-1]),
                )
            ),
        ),
        " ",
    )
    return F.concat(gender, F.lit(" "), F.when(value.rlike(r"\p{IsCyrillic}"), made("cyrillic")).otherwise(made("latin")))


def surrogate_of(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form at the given attempt."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string")), 512)
    more = F.when(attempt > 1, F.substring(digest, F.lit(1), attempt * 2)).otherwise("")

    def made(h: Column) -> Column:
        mail = F.concat(_alike(F.substring_index(value, "@", 1), h), more, F.lit("@"), F.element_at(F.array(*map(F.lit, DOMAINS)), _number(h, F.lit(63), len(DOMAINS)) + 1))
        groups = [F.substring(h, 4 * i + 1, 4) for i in range(6)]
        keep = F.when(kind == "phone", F.greatest(F.length(value) - 10, F.when(value.startswith("0"), 1).otherwise(0))).otherwise(0)
        return (
            F.when(kind == "email", mail)
            .when(kind == "ip", _ip(value, h, attempt))
            .when(kind == "iban", _iban(value, h))
            .when(kind == "ipv6", F.concat_ws(":", F.lit("2001:db8"), *groups))
            .when(kind == "card", _card(value, h))
            .when(kind == "name", _name(value, h, attempt))
            .otherwise(F.concat(F.substring(value, F.lit(1), keep), _alike(F.substring(value, keep + 1, F.length(value)), h)))
        )

    return _let(digest, made)


def written(kind: Column, value: Column, surrogate: Column) -> Column:
    """A surrogate in the format of the mention that it replaces."""
    before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", ""))
    digits = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(surrogate, before(i), F.lit(1))).otherwise(c)), "")
    letters = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, F.length(F.replace(F.substring(value, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    honorific = F.regexp_extract(value, rf"^(?:{MALE}|{FEMALE})\.? ", 0)
    name = F.substring(surrogate, F.lit(3), F.length(surrogate))
    name = F.when(_full(F.regexp_replace(value, rf"^(?:{MALE}|{FEMALE})\.? ", "")), name).otherwise(F.substring_index(name, " ", -1))
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", letters)
        .when(kind == "name", F.concat(honorific, name))
        .otherwise(surrogate)
    )


def assign(entities: DataFrame, key: str, rounds: int = 30) -> DataFrame:
    """(kind, canonical, surrogate) of distinct entities, all surrogates of a kind distinct from each other and from all entities.

    An entity whose surrogate is taken draws again; of those that meet, the
    least keeps it.  The rounds are a guard against a kind with more entities
    than values; then an error is raised rather than two entities merged.
    """
    now = entities.withColumn("attempt", F.lit(0))
    for _ in range(rounds):
        drawn = now.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("canonical"), F.col("attempt"), key))
        drawn = checkpoint(drawn)
        owner = drawn.groupBy("kind", "surrogate").agg(F.min_by("canonical", F.struct("attempt", "canonical")).alias("owner"), F.count("*").alias("n"))
        real = entities.select("kind", F.col("canonical").alias("surrogate"))
        taken = owner.where("n > 1").unionByName(real.join(drawn.select("kind", "surrogate"), ["kind", "surrogate"], "left_semi").selectExpr("kind", "surrogate", "cast(null as string) as owner", "1L as n"))
        taken = checkpoint(taken.groupBy("kind", "surrogate").agg(F.when(F.count_if(F.col("owner").isNull()) == 0, F.min("owner")).alias("owner")))
        if taken.isEmpty():
            return drawn.drop("attempt")
        lost = F.col("taken") & ~F.coalesce(F.col("owner") == F.col("canonical"), F.lit(False))
        now = again_columns(drawn, taken, lost)
    raise RuntimeError("surrogates stay in conflict")


def again_columns(drawn: DataFrame, taken: DataFrame, lost: Column) -> DataFrame:
    """The entities with their next attempt."""
    marked = drawn.join(taken.withColumn("taken", F.lit(True)), ["kind", "surrogate"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    return marked.select("kind", "canonical", F.when(lost, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities in the text replaced, and the column ``n_entities`` (mentions, long).

    Null texts stay null and have 0 mentions.  Repeated rows give the same
    text; null ids are carried through; other columns are left alone, but for one
    of the name n_entities.  An empty table gives an empty result.
    """
    text = F.col(text_col)
    row = row_key(F.col(id_col), text)
    has = text.rlike(HINT) & text.rlike(PATTERN)
    named = docs.where(has).select(row.alias("__row"), text.alias("text"), F.when(text.rlike(PATTERNS["name"]), people_of(text)).otherwise(F.array().cast("array<string>")).alias("people"))
    found = named.select("__row", "people", F.posexplode(F.regexp_extract_all("text", pattern_with(F.col("people")), F.lit(0))).alias("place", "value"))
    found = found.withColumn("person", F.when(F.size("people") > 0, person_of(F.col("people"), F.col("value"))))
    mentions = found.withColumn("kind", F.when(F.col("person").isNotNull(), "name").otherwise(kind_of(F.col("value")))).withColumn("canonical", F.coalesce("person", canonical_of(F.col("kind"), F.col("value"))))
    mentions = checkpoint(mentions.dropDuplicates(["__row", "place"]))
    surrogates = checkpoint(assign(mentions.select("kind", "canonical").distinct(), key))
    filled = mentions.join(surrogates, ["kind", "canonical"]).select("__row", "people", "place", written(F.col("kind"), F.col("value"), F.col("surrogate")).alias("new"))
    filled = checkpoint(filled.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]).alias("__new"), F.first("people").alias("__people")))
    held = filled.agg(F.sum(64 + F.length(F.array_join("__new", "")) + F.length(F.array_join("__people", "")))).first()[0] or 0
    whole = F.array_join(F.transform(F.split(text, pattern_with(F.col("__people")), -1), lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col("__new"), i), F.lit("")))), "")
    out = docs.withColumn("__row", row).join(F.broadcast(filled) if held <= BROADCAST_BYTES else filled, "__row", "left")
    found = F.col("__new").isNotNull()
    out = out.withColumn("n_entities", F.when(found, F.size("__new").cast("long")).otherwise(F.lit(0).cast("long"))).withColumn(text_col, F.when(found, whole).otherwise(text))
    return out.select(*docs.columns, *["n_entities"] * ("n_entities" not in docs.columns))
