"""Surrogates for personal data; DataFrame functions only.

Entities (e-mail addresses, phone numbers, IP addresses, card and account numbers, social security numbers, IBANs,
titled names) are found with one regular expression.  Each distinct entity, in a canonical form that ignores case or
separators, gets one surrogate from a keyed hash: digits for digits, letters of the same script and case for letters,
first names of the gender that the title states, valid octets, a check digit that holds where the original's does.
Occurrences keep their own format, so one entity written two ways stays one entity.  Names are replaced by part, without
title, full stop and case: a family name has one surrogate whatever stands before it, a first name one for its gender
(of a title that states none: the gender that the corpus's other titles give the name, else by its ending); initials
are exchanged by a keyed shift of the alphabet, particles stay.

Collision checks: surrogates that two entities would share, or that are an entity of the corpus themselves, are
drawn again with the next attempt number (all but the entity first in order), until none is left.  After ``KEEP_FORMAT``
attempts the space grows with each: any octets, first digits that may change, further digits, letters or syllables.
Where all of that is taken (more than half of all numbers of a format are entities), those left exchange their places
by a keyed cycle within kind and format, so that each still has one surrogate of its own that is not itself.

Defined cases: null text stays null; texts without an entity stay as they are; repeated rows are replaced alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TITLE = ("(?:Mr|Mrs|Ms|Miss|Mister|Madam|Sir|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Господин|Госпожа|Dr|Prof)")
TITLES = rf"{TITLE}\.?(?: {TITLE}\.?){{0,2}}"
LETTER = r"[\p{L}\p{M}]"
#: Small words inside a name, and small prefixes joined to it.
PARTICLE = ("(?:(?:von|vom|van|zu|zum|zur|der|den|dem|de|del|della|di|da|das|dos|do|du|des|la|le|las|los|ter|ten|af|av|bin|"
            "ibn|ben|bint|al|el|y|['’]t) )")
PREFIX = r"(?:(?:dell|d|l|al|el|ad|ar|as|ash|at|az|an|abd|ben|bin|ibn)['’-](?=\p{Lu}))"
#: A capital word with inner capitals, apostrophes (but not a genitive's) and hyphens; before it initials and particles.
WORD = (rf"(?:\p{{Lu}}\.(?:[ -]?\p{{Lu}}\.){{0,3}} ?)?{PARTICLE}{{0,3}}{PREFIX}?\p{{Lu}}{LETTER}{{0,60}}+"
        rf"(?:['’](?!s(?!{LETTER})){LETTER}{{1,60}}+|[-‐‑]{LETTER}{{1,60}}+){{0,4}}")
#: A part of a name: an initial, a particle, or a word between hyphens.
PART = rf"{LETTER}+(?:['’](?!s(?!{LETTER})){LETTER}+)*"
SMALL_PART = PARTICLE.replace("['’]t) )", "t|dell|d|l|ad|ar|as|ash|at|az|an|abd))")
#: A title before a name; the look-ahead turns most characters away at once.
TITLED = rf"(?=[MHFSDPГ]){TITLE}\.? (?:\p{{Lu}}|{PARTICLE}|{PREFIX})"
FEMALE = "(?:Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Госпожа)"
MALE = "(?:Mr|Mister|Sir|Herr|Monsieur|Señor|Sr|Господин)"
#: In the order in which a match is judged.  Every alternative starts where a token starts and has a bounded reach, so
#: that a long run of characters costs no more than its length.
TYPES = (
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}@[\p{L}0-9-]{1,63}(?:\.[\p{L}0-9-]{1,63}){0,8}\.\p{L}{2,24}"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[ .-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z])"
              r"|(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("name", rf"(?<!\p{{L}}){TITLES} {WORD}(?: (?!{TITLE}(?!{LETTER})){WORD}){{0,4}}(?!{LETTER})"),
)
ANY = "|".join(f"(?:{p})" for _, p in TYPES)
#: Attempts that keep every format; after them a surrogate has up to ``MOST_MORE`` further characters.
KEEP_FORMAT, MOST_MORE = 8, 12
INITIALS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
            "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞĆČĐŁŃŘŚŞŠŹŻŽİ")
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"
GREEK, HAN = "αβγδεζηθικλμνξοπρστυφχψω", "安白成大方高海江林明青山石田文心新星月中"
FIRST = {
    ("latin", "f"): "Alma Berta Clara Dora Elsa Flora Greta Helga Irma Julia Karla Lena Marta Nora Olga Paula Rosa Sonja Tilda Vera",
    ("latin", "m"): "Anton Bruno Carlos Detlef Emil Felix Gustav Hugo Ivan Jonas Konrad Leo Martin Nils Oskar Pedro Ralf Stefan Tomas Viktor",
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Инна Лидия Мария Нина Ольга Раиса Софья Тамара Юлия",
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Олег Павел Роман Семён Юрий",
}
SYLLABLES = {"latin": "ba del for gan hel kin lor men nar os pel ram sol tan ver wim",
             "cyrillic": "ба вел гор дан зим кин лов мен нор пел рам сол тан фор чер шим"}


def keyed(key: str, *what: Column) -> Column:
    """A number below 2 ** 48 from a keyed hash."""
    text = F.concat_ws("\x1f", F.lit(key), *[w.cast("string") for w in what])
    return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(12)), 16, 10).cast("long")


def pick(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


def word_of(words: str, n: Column) -> Column:
    items = words.split()
    return F.element_at(F.array(*[F.lit(w) for w in items]), (n % len(items) + 1).cast("int"))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def like_char(c: Column, n: Column) -> Column:
    """A character of the kind of ``c``: digit, or letter of the same script and case; others stay."""
    low = F.lower(c)
    letter = (F.when(F.rlike(low, F.lit(r"^\p{IsCyrillic}$")), pick(CYRILLIC, n)).when(
        F.rlike(low, F.lit(r"^\p{IsGreek}$")), pick(GREEK, n)).when(
        F.rlike(low, F.lit(r"^\p{IsHan}$")), pick(HAN, n)).otherwise(pick(LATIN, n)))
    return F.when(F.rlike(c, F.lit("^[0-9]$")), (n % 10).cast("string")).when(
        F.rlike(c, F.lit(r"^\p{L}$")), F.when(c == low, letter).otherwise(F.upper(letter))).otherwise(c)


def like_text(text: Column, key: str, *salt: Column) -> Column:
    return F.array_join(F.transform(chars(text), lambda c, i: like_char(c, keyed(key, *salt, i))), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, modulo 10 (0: valid)."""
    back = F.reverse(chars(digits))
    twice = F.transform(back, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10


def may_hold_entity(text: str) -> Column:
    """What every entity needs (an @ sign, a digit or a title), found far faster than the entities: most texts have
    none and are read once."""
    return F.contains(F.col(text), F.lit("@")) | F.rlike(text, F.lit("[0-9]")) | F.rlike(text, F.lit(TITLED))


def entity_type(match: Column) -> Column:
    out = None
    for name, pattern in TYPES:
        test = F.rlike(match, F.lit(f"^(?:{pattern})$"))
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit(TYPES[-1][0]))


def canonical(kind: Column, match: Column) -> Column:
    return F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(match, "[^0-9]", "")).when(
        kind == "iban", F.replace(match, F.lit(" "), F.lit(""))).when(kind == "email", F.lower(match)).otherwise(match)


def grown(attempt: int) -> int:
    return min(MOST_MORE, max(0, attempt - KEEP_FORMAT + 1))


def name_part(kind: Column, part: Column, attempt: int, key: str) -> Column:
    """A family name of syllables; a first name of the gender that ``kind`` states from a list, then of syllables too."""
    def of(script: str) -> Column:
        def syllables(n):
            return F.concat(*[word_of(SYLLABLES[script], keyed(key, kind, part, F.lit(attempt), F.lit(k))) for k in range(n)])

        def first(sex, ending):
            if attempt < 2:
                return F.lower(word_of(FIRST[script, sex], keyed(key, part, F.lit(attempt), F.lit("first"))))
            return F.concat(syllables(min(attempt, 2 + MOST_MORE)), F.lit(ending))

        endings = {"latin": ("a", "o"), "cyrillic": ("а", "ий")}[script]
        return F.when(kind == "first f", first("f", endings[0])).when(kind == "first m", first("m", endings[1])).otherwise(
            syllables(4 + grown(attempt)))

    return F.when(F.rlike(part, F.lit(r"\p{IsCyrillic}$")), of("cyrillic")).otherwise(of("latin"))


def name_parts(names: DataFrame) -> DataFrame:
    """(match, head, before, pos, part, after, kind, entity) of every part of the names ``match``; kind is ``initial`` or
    ``small`` (a particle) for those without a surrogate of their own."""
    head = F.regexp_extract("match", rf"^({TITLES} ){WORD}", 1)
    names = names.withColumn("head", head).withColumn("body", F.substr("match", F.length("head") + 1))
    sex = F.when(F.rlike("head", F.lit(rf"^{FEMALE}(?!{LETTER})")), F.lit("f")).when(
        F.rlike("head", F.lit(rf"^{MALE}(?!{LETTER})")), F.lit("m"))
    parts = names.select("match", "head", sex.alias("sex"), F.split("body", PART, -1).alias("between"), F.posexplode(
        F.regexp_extract_all("body", F.lit(PART), F.lit(0))).alias("pos", "part"))
    after = F.element_at("between", F.col("pos") + 2)
    later = F.exists(F.slice("between", F.col("pos") + 2, F.size("between")), lambda x: F.contains(x, F.lit(" ")))
    kind = F.when(F.rlike("part", F.lit(rf"^{SMALL_PART}$")), F.lit("small")).when(
        (F.length("part") == 1) & F.startswith(after, F.lit(".")), F.lit("initial")).when(
        later, F.lit("first")).otherwise(F.lit("family"))
    parts = parts.select("match", "head", "sex", F.element_at("between", 1).alias("before"), "pos", "part", after.alias("after"),
                         kind.alias("kind"), F.replace(F.lower("part"), F.lit("’"), F.lit("'")).alias("entity"))
    parts = stored(parts, "name-parts")
    female = F.sum(F.when(F.col("sex") == "f", 1).otherwise(-1))
    known = parts.where("kind = 'first' and sex is not null").groupBy("entity").agg(
        F.when(female > 0, F.lit("f")).otherwise(F.lit("m")).alias("known"))
    by_ending = F.when(F.rlike("entity", F.lit("[aа]$")), F.lit("f")).otherwise(F.lit("m"))
    return parts.join(known, "entity", "left").withColumn("kind", F.when(F.col("kind") == "first", F.concat(
        F.lit("first "), F.coalesce("sex", "known", by_ending))).otherwise(F.col("kind"))).drop("sex", "known")


def whole_names(parts: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) of every name: title, separators and particles kept, the parts' surrogates in its case."""
    part, drawn = F.col("part"), F.col("surrogate")
    shift = int(hashlib.sha256(key.encode()).hexdigest(), 16)
    turned = "".join(x[(k := 1 + shift % (len(x) - 1)):] + x[:k] for x in INITIALS)
    new = F.when(F.col("kind") == "initial", F.translate(part, "".join(INITIALS), turned)).when(
        F.col("kind") == "small", part).when((F.length(part) > 1) & (part == F.upper(part)), F.upper(drawn)).when(
        part == F.lower(part), drawn).otherwise(F.initcap(drawn))
    whole = parts.join(table, ["kind", "entity"], "left").groupBy("match", "head", "before").agg(F.array_sort(
        F.collect_list(F.struct("pos", F.concat(new, "after").alias("new")))).alias("new"))
    return whole.select(F.lit("name").alias("kind"), F.col("match").alias("entity"), F.concat(
        "head", "before", F.array_join(F.transform("new", lambda x: x["new"]), "")).alias("surrogate"))


def octet(o: Column, n: Column, any_width: bool) -> Column:
    if any_width:
        return (n % 254 + 1).cast("string")
    return F.when(F.length(o) == 1, n % 9 + 1).when(F.length(o) == 2, n % 90 + 10).otherwise(n % 155 + 100).cast("string")


def surrogate(kind: Column, entity: Column, attempt: int, key: str) -> Column:
    """The canonical surrogate of a canonical entity."""
    more, tried, attempt = grown(attempt), attempt, F.lit(attempt)
    drawn = like_text(entity, key, kind, entity, attempt)
    # A number's first digits say its kind (country, card network): the first one stays as long as the format does.
    number = drawn if more else F.concat(F.substr(entity, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2)))

    def further(alphabet: str) -> Column:
        return F.concat(F.lit(""), *[pick(alphabet, keyed(key, F.lit("more"), entity, attempt, F.lit(k))) for k in range(more)])

    short = F.substr(number, F.lit(1), F.length(number) - 1)
    check = ((10 - luhn(F.concat(short, F.lit("0")))) % 10).cast("string")
    card = F.when(luhn(entity) == 0, F.concat(short, check)).otherwise(number)
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    site = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    email = F.concat(like_text(local, key, F.lit("local"), entity, attempt), further(LATIN), F.lit("@"),
                     like_text(site, key, F.lit("domain"), domain), top)
    ip = F.array_join(F.transform(F.split(entity, r"\."), lambda o, i: octet(o, keyed(key, entity, attempt, i), more > 0)), ".")
    iban = F.concat(F.substr(entity, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(3)))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(
        kind == "phone", F.concat(number, further("0123456789"))).when(kind == "ssn", number).when(
        kind == "iban", iban).otherwise(name_part(kind, entity, tried, key))


def in_format(kind: Column, match: Column, drawn: Column) -> Column:
    """The surrogate written as the occurrence was: its separators, its case; further characters follow."""
    kept = F.when(kind == "iban", F.lit("[^A-Z0-9]")).otherwise(F.lit("[^0-9]"))
    spaced = F.array_join(F.transform(chars(match), lambda c, i: F.when(F.rlike(c, kept), c).otherwise(
        F.substr(drawn, F.length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), kept, F.lit(""))), F.lit(1)))), "")
    spaced = F.concat(spaced, F.substr(drawn, F.length(F.regexp_replace(match, kept, F.lit(""))) + 1))
    cased = F.array_join(F.zip_with(chars(match), chars(drawn), lambda a, b: F.when(
        (a != F.lower(a)), F.upper(b)).otherwise(b)), "")
    return F.when(kind.isin("card", "phone", "ssn", "iban"), spaced).when(kind == "email", cased).otherwise(drawn)


def exchanged(left: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``done`` and the entities ``left`` over: in a keyed order of each format, each takes the next one as surrogate.
    One entity that has a surrogate joins each cycle, so that no entity is alone in it."""
    digits = F.regexp_replace("entity", "[^0-9]", "")
    form = F.when(F.col("kind") == "card", F.concat_ws("-", F.length("entity"), luhn(digits) == 0)).when(
        F.col("kind") == "iban", F.concat_ws("-", F.length("entity"), F.substring("entity", 1, 2))).when(
        F.col("kind").isin("phone", "ssn"), F.length("entity").cast("string")).otherwise(F.lit(""))
    left, done = left.select("kind", "entity").withColumn("form", form), done.withColumn("form", form)
    joins = done.join(left.select("kind", "form").distinct(), ["kind", "form"], "left_semi").groupBy("kind", "form").agg(
        F.min("entity").alias("entity"))
    order = Window.partitionBy("kind", "form").orderBy(keyed(key, F.lit("order"), F.col("entity")), "entity")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = left.unionByName(joins).withColumn("surrogate", F.coalesce(
        F.lead("entity").over(order), F.first("entity").over(whole)))
    cycle = stored(cycle.select("kind", "entity", "surrogate"), "exchanged")
    if not cycle.where("entity = surrogate").isEmpty():
        raise ValueError("an entity without another one of its format has no surrogate")
    return done.join(joins.select("kind", "entity"), ["kind", "entity"], "left_anti").select(
        "kind", "entity", "surrogate").unionByName(cycle)


def surrogate_table(entities: DataFrame, key: str, max_attempts: int = 64) -> DataFrame:
    """(kind, entity, surrogate): one row per distinct entity, no surrogate twice, none that is an entity itself
    (except where a format is used up, see ``exchanged``)."""
    real = stored(entities.select("kind", "entity").distinct(), "entities")
    todo, done = real, None
    for attempt in range(max_attempts):
        drawn = todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("entity"), attempt, key))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        taken = real.withColumnRenamed("entity", "surrogate")
        fine = first.join(taken, ["kind", "surrogate"], "left_anti")
        if done is not None:
            fine = fine.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        fine = stored(fine.select("kind", "entity", "surrogate"), f"surrogates-{attempt}")
        done = fine if done is None else done.unionByName(fine)
        todo = real.join(done.select("kind", "entity"), ["kind", "entity"], "left_anti")
        if todo.isEmpty():
            return done
    return exchanged(todo, done, key)


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, text, entities): the rewritten text, and one struct (kind, surrogate) per occurrence in order.

    Only texts with an entity are shuffled; entity rows are aggregated before they are.
    """
    docs = docs.select(F.col(id_col), F.col(text).alias("text"))
    hit = F.coalesce(may_hold_entity("text") & F.rlike("text", F.lit(ANY)), F.lit(False))
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64("text").alias("hash"), F.length("text").alias("n"))
    some = docs.where(hit).withColumn("row", F.sha2(F.to_json(row), 256))
    found = some.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("pos", "match"))
    found = found.groupBy("row", "pos").agg(F.first("match").alias("match")).withColumn(
        "kind", entity_type(F.col("match")))
    found = stored(found.withColumn("entity", canonical(F.col("kind"), F.col("match"))), "occurrences")
    parts = stored(name_parts(found.where("kind = 'name'").select("match").distinct()), "parts")
    own = parts.where(~F.col("kind").isin("small", "initial")).select("kind", "entity")
    table = surrogate_table(found.where("kind != 'name'").select("kind", "entity").unionByName(own), key)
    table = table.unionByName(whole_names(parts, table, key))
    new = found.join(table, ["kind", "entity"]).withColumn("new", in_format(F.col("kind"), F.col("match"), F.col("surrogate")))
    per_row = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "new"))).alias("found"))
    pieces = F.split("text", ANY, -1)
    filled = F.concat(F.transform("found", lambda f: f["new"]), F.array(F.lit("")))
    rewritten = some.join(per_row, "row").select(
        id_col, F.array_join(F.zip_with(pieces, filled, lambda p, f: F.concat(p, f)), "").alias("text"),
        F.transform("found", lambda f: F.struct(f["kind"].alias("kind"), f["new"].alias("surrogate"))).alias("entities"))
    nothing = F.array().cast(rewritten.schema["entities"].dataType)
    return rewritten.unionByName(docs.where(~hit).select(id_col, "text", nothing.alias("entities")))
