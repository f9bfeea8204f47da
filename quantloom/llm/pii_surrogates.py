"""PII surrogates: every detected entity gets a keyed replacement of its own kind.

Detection, canonical forms and replacements are SQL expressions. Entities of the whole corpus are made distinct, each gets
a candidate from a keyed hash, and rounds of collision checks (against other candidates, earlier winners and all real
entities) raise the attempt number of those that lose, so different entities stay different and equal ones stay equal in
all documents. Documents then look up their own entities; documents without any are never shuffled.

Persons are found behind a title. In capitals (MR. JOHN SMITH) two words follow it at most, as nothing shows where a name ends
there; a single name takes the word behind it along. The words of the names that a document shows there are then replaced all over that
document, wherever they stand as whole capitalised words (also where such a word means something else). A word that is
both a surname and a given name counts as the surname where it has no title.

A given name is one entity for each gender that titles show of it. Where a title shows none (Dr), the gender is that of the same
name elsewhere in the document, else the commoner one of it in the corpus (female if both are as common), so one person keeps
one name under all titles.

Kept of an entity: its kind, length, punctuation, letter case and script; the country code of a phone, the first digit
and the Luhn check of a card, the last label of a domain, the country of an IBAN; the gender that a title shows, the parts
of a person's name with hyphens, apostrophes and particles. Initials become another letter, which need not be their own.
Names in scripts without syllables here get Latin ones. Where replacements of a form become scarce, those of names and of the
local parts of e-mail addresses get longer.
"""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.shared import materialize, read, set_aside

#: The key of surrogates is in the session's setting of this name; without it, each run draws its own and forgets it.
SECRET_SETTING = "quantloom.pii.secret"
MOST_ATTEMPTS = 64
#: Titles by gender.
TITLES = {"m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа"], "n": ["Dr", "Prof"]}
#: Titles in capitals, before names in capitals; MS takes its point, as it is also another word.
LOUD = [t.upper() + (r"\." if t == "Ms" else "") for names in TITLES.values() for t in names]
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: One part of a name: a capital and more letters, with hyphens and apostrophes; words that stand between such parts.
_NAME = r"(?:\p{Ll}{1,2}['’])?\p{Lu}(?:\p{L}|['’-](?=\p{L}))+"
_PARTICLE = "(?:van|von|zu|de|der|den|del|da|di|du|la|le|el|al|bin)"
_LOUD_NAME = r"\p{Lu}(?:\p{Lu}|['’-](?=\p{Lu}))+(?!\p{L})"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "person": r"(?<!\p{L})(?:" + "|".join(t for names in TITLES.values() for t in names) + rf")\.? (?:(?:(?:\p{{Lu}}\.-?)+|{_NAME}|{_PARTICLE}) ){{0,5}}{_NAME}"
    + r"|(?<!\p{L})(?:" + "|".join(LOUD) + rf")\.? (?:(?:\p{{Lu}}\.-?)+ )*(?:{_LOUD_NAME} )?(?:(?:\p{{Lu}}\.-?)+ )*{_LOUD_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What given names and surnames are put together from, by script, and how given names end by gender.
SYLLABLES = {"latin": "ba be da do fe ga ho ja ka la le ma mi na no pe ra re sa si ta te vi wa".split(), "cyrillic": "ба ве га да же зи ка ла ме на по ре са ти фе ва".split(), "greek": "βα γε δα ζε θα κα λα με να πο ρε σα τι φε χα ψι".split(), "armenian": "բա գե դա զե կա լա մե նա պո րե սա տի վե".split()}
ENDINGS = {"latin": {"m": "rik", "f": "lia", "n": "sen"}, "cyrillic": {"m": "мир", "f": "лия", "n": "рен"}, "greek": {"m": "ρικ", "f": "λια", "n": "σεν"}, "armenian": {"m": "րիկ", "f": "լիա", "n": "սեն"}}

#: Words of a text, and those of them that can be a name rather than an initial or a particle.
WORD, NAMED = r"\p{L}+", r"^\p{Lu}\p{L}+$"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _only(surface: Column, keep: str) -> Column:
    return F.regexp_replace(surface, f"[^{keep}]", "")


def kind_of(surface: Column) -> Column:
    """The first pattern that fits the whole of a detected string."""
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        found = F.when(surface.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(found)
    return found


def _person(surface: Column) -> tuple[Column, Column, Column, Column]:
    """Title with its point, gender, the parts before the last one (empty if only one name stands there), the last part."""
    title, name = F.substring_index(surface, " ", 1), F.regexp_replace(surface, "^[^ ]+ ", "")
    gender = reduce(lambda rest, g: F.when(F.lower(F.regexp_replace(title, r"\.", "")).isin([t.lower() for t in TITLES[g]]), F.lit(g)).otherwise(rest), TITLES, F.lit("n"))
    return title, gender, F.regexp_replace(name, " ?[^ ]+$", ""), F.substring_index(name, " ", -1)


def entity_keys(surface: Column) -> Column:
    """The entities of a detected string, as ``kind:canonical form``; equal keys are the same entity."""
    kind = kind_of(surface)
    _, gender, given, surname = _person(surface)
    words = lambda part, key: F.transform(F.filter(F.regexp_extract_all(part, F.lit(WORD), F.lit(0)), lambda w: w.rlike(NAMED)), lambda w: F.concat(key, F.lower(w)))
    person = F.concat(words(given, F.concat(F.lit("given_"), gender, F.lit(":"))), words(surname, F.lit("surname:")))
    plain = F.when(kind.isin("email", "ipv4"), F.lower(surface)).when(kind == "iban", _only(surface, "A-Z0-9")).otherwise(_only(surface, "0-9"))
    return F.when(kind == "person", person).otherwise(F.array(F.concat(kind, F.lit(":"), plain)))


def _stream(message: Column, secret: str) -> Column:
    """128 hex digits that only the holder of ``secret`` can compute from the message."""
    return F.sha2(F.concat(F.lit(secret), F.sha2(F.concat(F.lit(secret), message), 512)), 512)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 60) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _characters(plain: Column, stream: Column) -> Column:
    """Digits become digits, letters letters of the same case; everything else stays."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), F.char(b % 26 + 97)).when(c.rlike("[A-Z]"), F.char(b % 26 + 65)).otherwise(c)

    return F.array_join(F.transform(F.split(plain, ""), one), "")


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum, counted from the right; ``double_last`` if the check digit is not among ``digits``."""

    def one(c: Column, i: Column) -> Column:
        d, odd = c.cast("int"), (i % 2 == (0 if double_last else 1))
        return F.when(odd, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _by_script(word: Column, made) -> Column:
    """``made`` with the script of a word; Latin for scripts without syllables here."""
    return reduce(lambda rest, script: F.when(word.rlike(rf"\p{{Is{script.capitalize()}}}"), made(script)).otherwise(rest), [s for s in SYLLABLES if s != "latin"], made("latin"))


def candidate(key: Column, attempt: Column, secret: str) -> Column:
    """The replacement key of an entity at an attempt."""
    kind, plain = F.substring_index(key, ":", 1), F.expr("substring(key, instr(key, ':') + 1)")
    stream = _stream(F.concat_ws("|", key, attempt.cast("string")), secret)
    mapped = _characters(plain, stream)
    local, domain = F.substring_index(plain, "@", 1), F.substring_index(plain, "@", -1)
    labels = F.regexp_extract(domain, r"^(.*)(\.[^.]*)$", 1)
    # later attempts draw from longer local parts, so a crowded space opens
    longer = F.when(attempt > 3, F.array_join(F.transform(F.sequence(F.lit(1), F.ceil(attempt / 4).cast("int")), lambda i: F.char(_byte(stream, 59 - i) % 26 + 97)), "")).otherwise(F.lit(""))
    email = F.concat(_characters(local, stream), longer, F.lit("@"), _characters(labels, _stream(F.concat(F.lit("domain:"), domain), secret)), F.regexp_extract(domain, r"(\.[^.]*)$", 1))
    ipv4 = F.concat_ws(".", *((_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)))
    body = F.expr("substring(substring(key, instr(key, ':') + 1), 1, 1)")
    card_body = F.concat(body, F.substring(mapped, F.lit(2), F.length(plain) - 2))
    check = F.pmod(-_luhn_sum(card_body, True), F.lit(10)).cast("string")
    card = F.when(_luhn_sum(plain, False) % 10 == 0, F.concat(card_body, check)).otherwise(F.concat(body, F.substring(mapped, F.lit(2), F.length(plain))))
    code = F.greatest(F.length(plain) - 10, F.lit(0))
    area = (_byte(stream, F.lit(50)) % 8 + 2).cast("string")
    phone = F.concat(F.substring(plain, F.lit(1), code), area, F.substring(mapped, code + 2, F.length(plain)))
    iban = F.concat(F.substring(plain, 1, 2), F.substring(mapped, F.lit(3), F.length(plain)))

    def name(script: str) -> Column:
        every = F.array(*map(F.lit, SYLLABLES[script]))
        pick = lambda i: F.get(every, _byte(stream, F.lit(i)) % len(SYLLABLES[script]))
        # later attempts draw from longer names, so a crowded space opens
        more = lambda after, *places: F.when(attempt > after, F.concat(*map(pick, places))).otherwise(F.lit(""))
        stems = F.concat(pick(0), pick(1), pick(2), more(2, 3, 4), more(8, 5, 6, 7, 8))
        ends = reduce(lambda rest, g: F.when(kind == f"given_{g}", F.lit(ENDINGS[script][g])).otherwise(rest), ENDINGS[script], F.lit(""))
        return F.concat(stems, ends)

    person = _by_script(plain, name)
    made = F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "ssn", mapped).otherwise(person)
    return F.concat(kind, F.lit(":"), made)


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """(key, surrogate) of distinct entities (key); no surrogate is another's, nor a real entity of the corpus."""
    done, todo, attempt = None, entities, 0
    while True:
        made = todo.select("key", candidate(F.col("key"), F.lit(attempt), secret).alias("surrogate"))
        first = made.groupBy("surrogate").agg(F.min("key").alias("key"))
        free = first.join(entities.select(F.col("key").alias("surrogate")), "surrogate", "left_anti")
        if done is not None:
            free = free.join(done.select("surrogate"), "surrogate", "left_anti")
        won = materialize(free.select("key", "surrogate"))
        done = won if done is None else done.unionByName(won)
        todo = materialize(todo.join(won.select("key"), "key", "left_anti"))
        if todo.isEmpty():
            return done
        attempt += 1
        if attempt == MOST_ATTEMPTS:
            raise ValueError(f"no free surrogates after {attempt} attempts")


def gendered(key_sets: DataFrame) -> DataFrame:
    """(_set, key, target): each key of the sets (_set, keys) with the entity that it stands for. That is the key itself but for
    given names behind titles of no gender."""
    word = F.substring_index("key", ":", -1)
    asked = key_sets.select("_set", "keys", F.explode("keys").alias("key")).withColumn("word", F.when(F.col("key").startswith("given_"), word))
    has = lambda g: F.array_contains("keys", F.concat(F.lit(f"given_{g}:"), "word"))
    here = F.when(F.col("key").startswith("given_n:") & (has("f") != has("m")), F.when(has("f"), "f").otherwise("m"))
    asked = asked.withColumn("here", here).select("_set", "key", "word", "here")
    count = lambda g: F.count_if(F.col("key").startswith(f"given_{g}:"))
    common = asked.where("word is not null").groupBy("word").agg(count("m").alias("m"), count("f").alias("f"))
    common = common.where("m + f > 0").select("word", F.when(F.col("m") > F.col("f"), "m").otherwise("f").alias("common"))
    open_ = F.col("key").startswith("given_n:") & F.col("here").isNull()
    # only the open ones meet the corpus, so other keys are not shuffled by their word
    settled = asked.where(~open_).select("_set", "key", F.when(F.col("here").isNotNull(), F.concat(F.lit("given_"), "here", F.lit(":"), "word")).otherwise(F.col("key")).alias("target"))
    rest = asked.where(open_).join(common, "word", "left").select("_set", "key", F.concat(F.lit("given_"), F.coalesce("common", F.lit("n")), F.lit(":"), "word").alias("target"))
    return settled.unionByName(rest)


def _named(word: Column, of: Column, kinds: list[str | Column]) -> Column:
    """The replacement of a word that is one of the document's names of these kinds, the first that it is; else null."""
    found = F.coalesce(*(F.element_at(of, F.concat(F.lit(k) if isinstance(k, str) else k, F.lower(word))) for k in kinds))
    new = F.substring_index(found, ":", -1)
    return F.when(word.rlike(NAMED), F.when(F.upper(word) == word, F.upper(new)).otherwise(F.initcap(new)))


def _each_word(text: Column, change) -> Column:
    """A text with ``change`` of each word; what stands between words stays."""
    between = F.split(text, WORD, -1)
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.coalesce(change(w), w))
    return F.concat(F.element_at(between, 1), F.array_join(F.zip_with(words, F.slice(between, F.lit(2), F.size(between)), lambda w, rest: F.concat(w, rest)), ""))


#: The kinds of a name without title, in the order in which they are looked up.
BARE = ["surname:", "given_m:", "given_f:", "given_n:"]


def bare_names(text: Column, of: Column) -> Column:
    """Text outside the detected strings with the document's own names replaced, as struct (text, n)."""
    n = F.size(F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: _named(w, of, BARE).isNotNull()))
    return F.when(n > 0, F.struct(_each_word(text, lambda w: _named(w, of, BARE)).alias("text"), n.alias("n"))).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def render(surface: Column, of: Column, secret: str) -> Column:
    """A detected string with its replacement in its own format. ``of``: map of the document's keys."""
    kind = kind_of(surface)
    value = F.substring_index(F.element_at(of, F.element_at(entity_keys(surface), 1)), ":", -1)
    each = F.split(surface, "")

    def pour(pattern: str) -> Column:
        before = lambda i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i), f"[^{pattern}]", ""))
        return F.array_join(F.transform(each, lambda c, i: F.when(c.rlike(f"[{pattern}]"), F.substring(value, before(i + 1), F.lit(1))).otherwise(c)), "")

    cased = F.array_join(F.transform(each, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(value, i + 1, F.lit(1)))).otherwise(F.substring(value, i + 1, F.lit(1)))), "")
    title, gender, given, surname = _person(surface)
    letter = lambda w: F.upper(_by_script(w, lambda script: F.substring(F.get(F.array(*map(F.lit, SYLLABLES[script])), _byte(_stream(F.concat(F.lit("initial:"), F.lower(w)), secret), F.lit(0)) % len(SYLLABLES[script])), 1, 1)))
    part = lambda text, key: _each_word(text, lambda w: F.when(w.rlike(r"^\p{Lu}$"), letter(w)).otherwise(_named(w, of, [key])))
    person = F.concat_ws(" ", title, F.when(given != "", part(given, F.concat(F.lit("given_"), gender, F.lit(":")))), part(surname, F.lit("surname:")))
    return F.when(kind == "person", person).when(kind == "email", F.when(F.length(value) == F.length(surface), cased).otherwise(value)).when(kind == "ipv4", value).when(kind == "iban", pour("A-Z0-9")).otherwise(pour("0-9"))


def replace_pii(docs: DataFrame, secret: str | None = None) -> DataFrame:
    """``docs``, all columns, with replaced entities in ``text`` and their number in ``n_entities``.

    Null and empty texts and texts without entities stay as they are, with 0 entities. Repeated rows stay repeated. A
    column of docs named n_entities is replaced; other extra columns may have any name. Without ``secret`` and setting the key is
    drawn at random: replacements are consistent within the run, differ in the next, and nobody can compute them again.
    """
    secret = secret or docs.sparkSession.conf.get(SECRET_SETTING, None) or secrets.token_hex(32)
    docs, back = set_aside(docs.drop("n_entities"), "text")
    back.append(F.col("n_entities"))
    surfaces = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    # cheap tests that every detected string passes, so most texts never meet the patterns
    may = F.coalesce(reduce(lambda rest, t: rest | F.contains(F.col("text"), F.lit(t)), [t for names in TITLES.values() for t in names] + [t.replace("\\", "") for t in LOUD], F.contains(F.col("text"), F.lit("@")) | F.col("text").rlike("[0-9][ .-]?[0-9]")), F.lit(False))
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform(surfaces, entity_keys))))
    own = docs.withColumn("_keys", F.when(may, keys).otherwise(F.array().cast("array<string>"))).withColumn("_set", F.when(F.size("_keys") > 0, F.sha2(F.array_join("_keys", "\n"), 256)))
    key_sets = materialize(own.where("_set is not null").groupBy("_set").agg(F.first("_keys").alias("keys")))
    asked = materialize(gendered(key_sets))
    assigned = assign(materialize(asked.select(F.col("target").alias("key")).distinct()), secret).withColumnRenamed("key", "target")
    maps = asked.join(assigned, "target").groupBy("_set").agg(F.map_from_entries(F.collect_list(F.struct("key", "surrogate"))).alias("_of"))

    hit = own.where("_set is not null").join(maps, "_set")
    # only documents with names look at the words between the detected strings
    people = F.exists(F.col("_keys"), lambda k: k.startswith("surname:") | k.startswith("given_"))
    pieces = F.transform(F.split("text", ANY, -1), lambda p: F.when(people, bare_names(p, F.col("_of"))).otherwise(F.struct(p.alias("text"), F.lit(0).alias("n"))))
    rendered = F.transform(surfaces, lambda s: render(s, F.col("_of"), secret))
    hit = hit.withColumn("_pieces", pieces).withColumn("_rendered", rendered)
    between = F.col("_pieces.text")
    text = F.concat(F.element_at(between, 1), F.array_join(F.zip_with("_rendered", F.slice(between, F.lit(2), F.size(between)), lambda r, rest: F.concat(r, rest)), ""))
    found = F.size("_rendered") + F.aggregate("_pieces", F.lit(0), lambda n, p: n + p["n"])
    changed = hit.withColumn("n_entities", found.cast("long")).withColumn("text", text)
    same = own.where("_set is null").withColumn("n_entities", F.lit(0).cast("long"))
    return same.select(*back).unionByName(changed.select(*back))


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
