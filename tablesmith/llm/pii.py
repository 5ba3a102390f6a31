"""Personal data replaced by surrogates of the same kind, in DataFrame and SQL functions alone.

Entities are e-mail addresses, phone numbers, IP addresses, long card or account numbers, IBANs, social security
numbers and names after a form of address. A surrogate is drawn by an HMAC of the entity and keeps its format; names
keep gender and script. A name is its word: each word of a name has one surrogate wherever it stands, its gender and
its being a given name come from all mentions in the corpus, and in a document that has a name, every later or earlier
mention of its words is replaced, with or without a form of address. All distinct entities of the corpus get their surrogates in one table, where
a surrogate that two entities share, or that is itself an entity, is drawn again until none is left: so equal
entities have equal surrogates in all documents, and different ones have different surrogates.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, ready

#: Draws for an entity at most; each round leaves only entities whose surrogates clash.
ROUNDS = 40
#: What an entity becomes if the table of surrogates lacks it, which only a clash of the hashes of two texts can cause.
MASK = "[PRIVATE]"

# Forms of address with their genders, and given names by gender and script. Family names are made by rule.
MEN = ["Mr", "Herr", "Monsieur", "M", "Señor", "Sr", "Don", "Господин", "Г-н", "Κύριος", "Sir"]
WOMEN = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "Госпожа", "Г-жа", "Κυρία", "Madam"]
EITHER = ["Dr", "Prof"]
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "George", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"],
    ("f", "latin"): ["Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("x", "latin"): ["Alex", "Charlie", "Dominique", "Kim", "Robin", "Sascha", "Toni", "Sam"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Максим"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("x", "cyrillic"): ["Саша", "Женя", "Валя", "Слава"],
    ("m", "greek"): ["Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος"],
    ("f", "greek"): ["Άννα", "Ελένη", "Ζωή", "Κατερίνα", "Μαρία", "Σοφία"],
    ("x", "greek"): ["Άγγελος", "Φώτης"],
}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wa", "ze"],
    "cyrillic": ["ба", "ве", "ги", "до", "жу", "за", "ке", "ли", "мо", "ну", "па", "ре", "си", "то", "фу", "ча"],
    "greek": ["βα", "γε", "δι", "ζο", "θα", "κε", "λι", "μο", "νυ", "πα", "ρε", "σι", "το", "φα", "χε", "ψι"],
}

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,6}(?![\p{L}\p{N}@])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![\p{L}\p{N}._+-])[0-9]{13,19}(?![\p{L}\p{N}_]|[.-][0-9])|(?<![\p{L}\p{N}._+-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![\p{L}\p{N}_]|-[0-9])"
TITLE = "(?:" + "|".join(sorted(MEN + WOMEN + EITHER, key=len, reverse=True)) + r")\.?"
NAME = rf"(?<![\p{{L}}]){TITLE}(?: \p{{Lu}}[\p{{L}}'’-]{{1,30}}){{1,3}}(?![\p{{L}}])"
ENTITY = f"{EMAIL}|{IBAN}|{PHONE}|{IP}|{SSN}|{CARD.replace(chr(92) + '1', chr(92) + 'k<s>').replace('([ -])', '(?<s>[ -])')}|{NAME}"
#: A word that may be a name, too, in documents that have names.
WORD = r"(?<![\p{L}\p{N}_@.-])\p{Lu}[\p{L}'’-]{1,30}(?![\p{L}\p{N}_@])"
MENTION = f"{ENTITY}|{WORD}"
#: A cheap test that a text can hold an entity at all.
HINT = rf"[@0-9]|(?:^|[^\p{{L}}]){TITLE} \p{{Lu}}"


def kind(entity: Column) -> Column:
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(entity.contains("@"), "email").when(entity.rlike(f"^{IBAN}$"), "iban").when(entity.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(entity.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(entity.rlike("^[0-9 -]+$") & (F.length(digits) >= 13), "card").when(entity.rlike(r"^\p{L}"), "name").otherwise("phone")
    )


def _digest(key: str, *parts: Column) -> Column:
    """256 hexadecimal digits drawn by the key from what identifies an entity, and from the number of the draw."""
    said = F.concat_ws("\u0001", *[p.cast("string") for p in parts])
    return F.concat(*[_hmac(key, F.concat(F.lit(f"{i}:"), said)) for i in range(2)])


def _hmac(key: str, text: Column) -> Column:
    """HMAC-SHA-512 in hexadecimal digits."""
    block = key.encode() if len(key.encode()) <= 128 else hashlib.sha512(key.encode()).digest()
    inner, outer = (bytes(b ^ x for b in block.ljust(128, b"\0")) for x in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 512))), 512)


def _iban_rest(text: Column) -> Column:
    """The number that an IBAN stands for, modulo 97: its first four characters last, letters as two digits."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    codes = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0), lambda r, c: F.pmod(r * F.when(c > 9, 100).otherwise(10) + c, F.lit(97)).cast("int"))


def _iban(text: Column, digest: Column) -> Column:
    """The same country and shape; check digits that were right are right again."""
    country, rest = F.substr(text, F.lit(1), F.lit(2)), F.substr(_shaped(text, digest), F.lit(5))
    check = F.lpad((98 - _iban_rest(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
    return F.concat(country, F.when(_iban_rest(text) == 1, check).otherwise(F.substr(_shaped(text, digest), F.lit(3), F.lit(2))), rest)


def _number(digest: Column, at: Column, below: int) -> Column:
    """A number below ``below`` from four hexadecimal digits, the ``at``-th four of the digest."""
    return F.pmod(F.conv(F.substr(digest, (F.pmod(at, F.lit(60)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("long"), F.lit(below)).cast("int")


def _shaped(text: Column, digest: Column) -> Column:
    """The text with digits for digits, letters for letters of the same case and script, and all else as it is."""

    def swap(c: Column, i: Column) -> Column:
        def of(letters: str) -> Column:
            return F.substr(F.lit(letters), _number(digest, i, len(letters)) + 1, F.lit(1))

        return (
            F.when(c.rlike("[0-9]"), of("0123456789")).when(c.rlike("[a-z]"), of("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"[\p{IsCyrillic}&&\p{Ll}]"), of("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), of("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
            .when(c.rlike(r"\p{Ll}"), of("àáâäçèéêëíîïñóôöùúûü")).when(c.rlike(r"\p{Lu}"), of("ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ")).otherwise(c)
        )

    return F.concat_ws("", F.transform(F.filter(F.split(text, ""), lambda c: c != ""), swap))


def _luhn(text: Column, digest: Column) -> Column:
    """Digits for digits; a number that passed the check of its last digit passes it again."""
    new = F.concat(F.substr(F.lit("123456789"), _number(digest, F.lit(59), 9) + 1, F.lit(1)), F.substr(_shaped(text, digest), F.lit(2)))
    head = F.substr(new, F.lit(1), F.length(new) - 1)
    bare = F.regexp_replace(head, "[^0-9]", "")
    last = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")), lambda d: F.call_function("luhn_check", F.concat(bare, d)))
    return F.when(F.call_function("luhn_check", F.regexp_replace(text, "[^0-9]", "")), F.concat(head, F.coalesce(F.try_element_at(last, F.lit(1)), F.lit("0")))).otherwise(new)


def script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def drawn(entities: DataFrame, key: str, draw: int) -> DataFrame:
    """``entities`` (type, value, shape) with their ``draw``-th surrogates. The digest is a column of its own, taken once."""
    domain = F.lower(F.regexp_replace("value", "^.*@", ""))
    rows = entities.withColumn("__digest", _digest(key, F.col("type"), F.col("value"), F.lit(draw)))
    rows = rows.withColumn("__host", F.substr(_hmac(key, F.concat_ws("\u0001", F.lit("domain"), domain)), F.lit(1), F.lit(10)))
    return rows.withColumn("surrogate", _surrogate(F.col("shape"), F.col("value"), F.col("__digest"), F.col("__host"), draw)).drop("__digest", "__host")


def _surrogate(type_: Column, value: Column, digest: Column, mark: Column, draw: int) -> Column:
    """Shapes of names are given_m, given_f, given_x or family, which grow with the draws; other shapes are types."""
    local = F.regexp_replace(value, "@.*$", "")
    host = F.concat(F.lit("m"), mark, F.lit(".example.org"))
    shaped_local = _shaped(local, digest) if draw < 6 else F.concat(_shaped(local, digest), F.lit(str(draw)))
    octets = F.concat_ws(".", *[(_number(digest, F.lit(i), 254) + 1).cast("string") for i in range(4)])
    country = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .(-])|)", 1)
    phone = F.concat(country, _shaped(F.substr(value, F.length(country) + 1), digest))
    iban = _iban(value, digest)
    sets = {s: F.array(*map(F.lit, words)) for s, words in SYLLABLES.items()}

    def family(of: str) -> Column:
        return F.initcap(F.concat(*[F.element_at(sets[of], _number(digest, F.lit(i), 16) + 1) for i in range(3 + min(draw, 3))]))

    def given(gender: str, of: str) -> Column:
        names = GIVEN[gender, of]
        first = F.element_at(F.array(*map(F.lit, names)), _number(digest, F.lit(50), len(names)) + 1)
        return first if draw < 3 else F.concat(first, F.lit("-"), family(of))

    where = script(value)
    name = F.coalesce(*[F.when((where == s) & (type_ == f"given_{g}"), given(g, s)) for g, s in GIVEN], *[F.when((where == s) & (type_ == "family"), family(s)) for s in SYLLABLES])
    return (
        F.when(type_ == "email", F.concat(shaped_local, F.lit("@"), host)).when(type_ == "ip", octets).when(type_ == "card", _luhn(value, digest))
        .when(type_ == "phone", phone).when(type_ == "iban", iban).when(type_ == "ssn", _shaped(value, digest)).otherwise(name)
    )


def _title_gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(bare.isin(MEN), "m").when(bare.isin(WOMEN), "f").otherwise("x")


def parts(entity: Column) -> Column:
    """An array of (type, value, use): the entity itself, or a name's words, of which all but the last are given names of a gender."""
    words = F.split(entity, " ")
    gender, rest = _title_gender(words[0]), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    named = F.transform(rest, lambda w, i: F.struct(F.lit("name").alias("type"), w.alias("value"), F.when(i + 1 == F.size(rest), F.lit("last")).otherwise(gender).alias("use")))
    return F.when(kind(entity) == "name", named).otherwise(F.array(F.struct(kind(entity).alias("type"), entity.alias("value"), F.lit(None).cast("string").alias("use"))))


def table(entities: DataFrame, key: str) -> DataFrame:
    """(type, value, surrogate) of all distinct (type, value): no two values share a surrogate, and none is a value.

    ``entities`` has (type, value, use); a word that any mention uses as a given name is one, of the gender that most of
    these mentions have, and of neither where as many have the other.
    """
    men, women = F.count_if(F.col("use") == "m"), F.count_if(F.col("use") == "f")
    given = F.when(men > women, "given_m").when(women > men, "given_f").when(F.count_if(F.col("use") == "x") + men > 0, "given_x").otherwise("family")
    left = cut(entities.groupBy("type", "value").agg(F.when(F.col("type") == "name", given).otherwise(F.col("type")).alias("shape")))
    known = left.select(F.lower("value").alias("s")).distinct()
    settled, taken = None, cut(known)
    for draw in range(ROUNDS):
        now = cut(drawn(left, key, draw).withColumn("s", F.lower("surrogate")))
        first = now.groupBy("s").agg(F.min(F.struct("type", "value")).alias("w")).join(taken, "s", "left_anti")
        done = cut(first.select(F.col("w.type").alias("type"), F.col("w.value").alias("value"), "s").join(now.select("type", "value", "surrogate"), ["type", "value"]))
        settled = done if settled is None else settled.unionByName(done)
        left = cut(left.join(done, ["type", "value"], "left_anti"))
        if left.limit(1).count() == 0:
            return settled.select("type", "value", "surrogate")
        taken = taken.unionByName(done.select("s"))
    raise RuntimeError("surrogates clash after all draws; lengthen the names made by rule")


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in their texts, n_entities, and n_chars, where there, counted anew.

    Null and empty texts, and texts without entities, stay as they are with 0 entities; texts of any length are searched
    whole, and an empty table gives no rows. Rows are matched with their surrogates by the hash of their text, so ids may
    be null or repeated. A column named n_entities is replaced; other columns pass through, whatever their names.
    """
    ready(docs.sparkSession)
    names = [c for c in docs.columns if c != "n_entities"]
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    rows = docs.select(*names, F.coalesce(found, F.array().cast("array<string>")).alias("__found"))
    clean = rows.where(F.size("__found") == 0).select(*names, F.lit(0).alias("n_entities"))
    held = rows.where(F.size("__found") > 0).withColumn("__key", F.xxhash64("text"))
    each = held.select("__key", F.explode(F.array_distinct(F.flatten(F.transform("__found", parts)))).alias("p")).select("__key", "p.type", "p.value", "p.use").distinct()
    each = cut(each)
    made = cut(table(each, key))
    mapped = each.select("__key", "type", "value").distinct().join(made.hint("merge"), ["type", "value"])
    maps = cut(mapped.groupBy("__key").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\u0001", "type", "value"), "surrogate"))).alias("__map")))
    both = held.join(maps.hint("merge"), "__key", "left")

    def replaced(e: Column) -> Column:
        of = lambda p: F.coalesce(F.try_element_at(F.col("__map"), F.concat_ws("\u0001", p["type"], p["value"])), F.lit(MASK))
        named = F.concat_ws(" ", F.concat(F.array(F.split(e, " ")[0]), F.transform(parts(e), of)))
        word = F.coalesce(F.try_element_at(F.col("__map"), F.concat_ws("\u0001", F.lit("name"), e)), e)
        return F.when(kind(e) != "name", of(parts(e)[0])).when(e.contains(" "), named).otherwise(word)

    new = F.transform(F.regexp_extract_all("text", F.lit(MENTION), F.lit(0)), replaced)
    text = F.concat_ws("", F.zip_with(F.split("text", MENTION, -1), new, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))
    changed = both.withColumn("text", text).select(*names, F.size("__found").alias("n_entities"))
    out = clean.unionByName(changed)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out
