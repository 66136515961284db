"""PII: keyed surrogates for detected entities, with DataFrame functions alone.

Entities are e-mail addresses, IPv4 and IPv6 and phone numbers (international, and
the national forms of ``PATTERNS``), US social security numbers, IBANs, runs of 13 to
19 digits (cards, accounts), assigned secrets (``token = "..."``, key words in any
case and in JSON, at least six letters or digits), keys of known form (``AKIA...``,
``sk_live_...`` and the like, whose prefix stays) and names: capitalised words after a
title, or after a given name of ``GIVEN``.

A surrogate has its original's form: digits become digits, letters become letters
of the same script and case, everything else stays; octets stay octets, IBANs get
valid check digits and numbers that pass the Luhn check pass it again. Names are
replaced part by part - given names by given names of the same gender and script,
family names by family names of the same script - so "Mr. John Smith" and "Smith"
in ``Mr. Smith`` still go together.

All distinct (kind, value) pairs of the corpus are drawn together. A draw is a
SHA-256 stream of the key, the kind, the value and the round. It is accepted if no
original of the corpus and no accepted surrogate equals it, and if the value is the
smallest of those that drew it in this round; the others draw again. So distinct
values get distinct surrogates, equal values equal ones, in every document, and no
surrogate is somebody's real value. Every kind widens with the rounds - names get
parts, all others a sign more after ``SAME_FORM`` rounds, then two, and so on - so
the space of a form that the corpus itself fills does not run out; where
``MOST_ROUNDS`` do not suffice an error is raised and nothing is replaced.

The pattern runs over every text once; the rows are staged with what it found. Only
documents with entities are joined; occurrences are what is shuffled, and
their values - a common one may fill a third of all rows - are joined by sort-merge,
whose skewed partitions Spark splits.

Cases: null and empty texts stay; rows with null doc_id are treated as any other;
repeated rows are replaced alike; a text without entities stays byte for byte;
extra columns, whatever their names, stay; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import staged

MOST_ROUNDS = 64
#: Rounds in which a surrogate has exactly its original's form, and those for each sign more.
SAME_FORM, MORE = 4, 3

# ---- fixed values: given names by gender and script, family names by script, titles by gender
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carmen Charlotte Claire Elena Emma Greta Hannah Ingrid Isabel Julia Karin Laura Lucia Maria Marie Mary Nadine Olivia Paula Sarah Sofia Sophie Susan Teresa Ursula",
    ("m", "latin"): "Antonio Bernard Carlos David Diego Emil Felix Fritz Georg Henri Hugo James Javier John Jorge Jules Karl Louis Lukas Manuel Michael Otto Pablo Paul Peter Pierre Robert Thomas",
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна",
    ("m", "cyrillic"): "Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей",
    ("f", "greek"): "Αικατερίνη Βασιλική Ειρήνη Ελένη Μαρία Σοφία",
    ("m", "greek"): "Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης",
}
FAMILY = {
    "latin": "Adler Bauer Bennett Blanc Brooks Castillo Chevalier Cooper Dubois Ellis Fischer Fuentes Garnier Hayes Herrera Hofmann Keller Lambert Lorenz Marchand Mercer Molina Navarro Perrin Quinn Rivas Rousseau Sanders Schubert Serrano Turner Vidal Vogel Walsh Winkler Zeller",
    "cyrillic": "Белов Волков Голубев Зайцев Козлов Лебедев Морозов Новиков Орлов Соколов",
    "greek": "Αλεξίου Βασιλείου Δημητρίου Ιωάννου Νικολάου Οικονόμου Παππάς",
}
TITLES = {
    "f": "Mrs. Ms. Miss Frau Señora Sra. Madame Mme Mademoiselle госпожа κυρία",
    "m": "Mr. Mister Herr Señor Sr. Monsieur господин κύριος",
    "u": "Dr. Prof. Doctor Doctora",
}
ALPHABETS = {
    "digit": "0123456789", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "latin": "abcdefghijklmnopqrstuvwxyz", "LATIN": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщыэюя", "CYRILLIC": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "GREEK": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
}
# ----

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}\p{M}]++(?:[-'’]\p{Lu}[\p{L}\p{M}]++)*+"


def _any_of(words) -> str:
    return "|".join(sorted((w.replace(".", r"\.") for w in words), key=lambda w: (-len(w), w)))


#: Signs of a secret, the quote around one, and a key word with what separates it from its value.
_SIGN = "[A-Za-z0-9_/+-]"
_QUOTE = r"\\?[\"']"
_KEY = rf"(?i:{{}})(?:{_QUOTE})?\s{{{{0,3}}}}[=:]\s{{{{0,3}}}}"

#: Kinds in the order in which they are tried at a place; names last. Each starts at a
#: fixed sign or cannot start inside a run of its own signs, so a scan stays linear.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "quoted": rf"(?<={_KEY.format('password|passwd|secret|token')}{_QUOTE})(?=(?:[^\s\"'\\A-Za-z0-9]*+[A-Za-z0-9]){{6}})[^\s\"'\\]++(?=\\?[\"'])",
    "secret": rf"(?<!{_SIGN})(?={_SIGN}{{16}}|(?={_SIGN}{{6}})(?=[0-9_/+-]*+[A-Za-z])[A-Za-z_/+-]*+[0-9])(?=(?:[_/+-]*+[A-Za-z0-9]){{6}})(?<={_KEY.format('token|secret|key|password|passwd')}(?:{_QUOTE})?){_SIGN}++(?:\.{_SIGN}++)*+={{0,2}}",
    "ip": rf"(?<![\p{{L}}0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ip6": r"(?<![\p{L}0-9:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=(?:[0-9A-Fa-f]*:){2,7}[0-9A-Fa-f]+(?![:0-9A-Fa-f]))(?:[0-9A-Fa-f]{1,4}:)+(?::[0-9A-Fa-f]{1,4})+)(?![\p{L}0-9:])",
    "key": r"(?:(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+)(?![\p{L}0-9_-])",
    "iban": r"(?<![\p{L}0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}0-9])",
    "phone": (
        r"(?=[+(0-9])(?:(?<![\p{L}0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}"
        r"|(?<![\p{L}0-9+-]|[0-9]\.)(?:(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?[0-9]{3}[ .-]|[2-9][0-9]{2}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3}[ -]))[0-9]{4}"
        r"|0[1-9](?:[ .-][0-9]{2}){4}|(?:\(0[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,5})(?![.-][0-9]))(?![0-9])"
    ),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9.+-])(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2})(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:(?:{_any_of(' '.join(TITLES.values()).split())}) {_NAME}(?: {_NAME}){{0,2}}|(?:{_any_of(' '.join(GIVEN.values()).split())}) {_NAME})",
}
#: Names and numbers begin with a letter or digit that none stands before; addresses and
#: secrets with any of their signs; quoted secrets and phone numbers where they say.
_REST = "|".join(p for k, p in PATTERNS.items() if k not in ("email", "quoted", "secret", "phone"))
PII = (
    rf"(?<![\p{{L}}\p{{N}}])(?:(?<=[\"']){PATTERNS['quoted']}|(?=[\p{{L}}\p{{N}}._%+/-])(?:{PATTERNS['email']}|{PATTERNS['secret']})"
    rf"|(?=[\p{{L}}\p{{N}}])(?:{_REST}))|{PATTERNS['phone']}"
)


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once although a lambda function uses it often."""
    return F.transform(F.array(value), use)[0]


def _kind(found: Column) -> Column:
    out = F.lit("name")
    # one by one, on the few strings found; a secret has lost what stood before it and takes the rest
    for kind in ("number", "ssn", "phone", "iban", "key", "ip6", "ip", "email"):
        out = F.when(found.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return F.when((out == "name") & ~found.rlike(f"^(?:{PATTERNS['name']})$"), "secret").otherwise(out)


def _one_of(word: Column, words: str) -> Column:
    return word.isin(*words.split())


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _parts(found: Column, kind: Column) -> Column:
    """Array of (kind, value, fixed): what is replaced on its own, and what stays."""
    words = F.split(found, " ")
    title = words[0]
    titled = _one_of(title, " ".join(TITLES.values()))
    gender = F.when(_one_of(title, TITLES["f"]), "f").when(_one_of(title, TITLES["m"]), "m").otherwise("u")

    def part(word: Column, i: Column) -> Column:
        own = F.when(_one_of(word, " ".join(v for (g, _), v in GIVEN.items() if g == "f")), "f").when(_one_of(word, " ".join(v for (g, _), v in GIVEN.items() if g == "m")), "m").otherwise(gender)
        first = F.when(titled, i == 1).otherwise(i == 0)
        last = i == F.size(words) - 1
        known = _one_of(word, " ".join(GIVEN.values()))
        given = known | (first & ~last)
        kind = F.when(given, F.concat_ws("/", F.lit("given"), own, _script(word))).otherwise(F.concat_ws("/", F.lit("family"), _script(word)))
        return F.struct(F.when(titled & (i == 0), F.lit("")).otherwise(kind).alias("kind"), word.alias("value"))

    plain = F.array(F.struct(kind.alias("kind"), found.alias("value")))
    return F.when(kind == "name", F.transform(words, part)).otherwise(plain)


def _same(kind: Column, value: Column) -> Column:
    """What occurrences of one entity have in common: case does not matter for addresses and names."""
    return F.when((kind == "email") | kind.contains("/"), F.lower(value)).otherwise(value)


def _stream(key: str, kind: Column, value: Column, draw: Column, n: Column) -> Column:
    """At least ``n`` numbers below 2**24 that only the key gives away."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, value, draw.cast("string"))
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), F.sha2(seed, 256)), 256)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 10).cast("int")), lambda b: F.sha2(F.concat_ws("\u0001", seed, b.cast("string")), 256))
    return F.flatten(F.transform(blocks, lambda h: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.conv(F.substring(h, i * 6 + 1, F.lit(6)), 16, 10).cast("int"))))


def _pick(signs: str, number: Column) -> Column:
    return F.substring(F.lit(signs), F.pmod(number, F.lit(len(signs))) + 1, F.lit(1))


def _letter(sign: Column, number: Column, hexadecimal: Column) -> Column:
    """A sign of the same sort; digits other than 0 stay other than 0."""
    holds = {name: F.contains(F.lit(signs), sign) for name, signs in ALPHABETS.items()}
    out = F.when(hexadecimal & holds["hex"], _pick(ALPHABETS["hex"], number)).when(hexadecimal & holds["HEX"], _pick(ALPHABETS["HEX"], number))
    out = out.when(sign == "0", _pick(ALPHABETS["digit"], number)).when(holds["digit"], _pick(ALPHABETS["digit"][1:], number))
    for name in ("latin", "LATIN", "cyrillic", "CYRILLIC", "greek", "GREEK"):
        out = out.when(holds[name], _pick(ALPHABETS[name], number))
    # accented letters become plain ones of their case; signs that are no letters stay
    return out.when(sign.rlike(r"^\p{Ll}$"), _pick(ALPHABETS["latin"], number)).when(sign.rlike(r"^\p{Lu}$"), _pick(ALPHABETS["LATIN"], number)).otherwise(sign)


def _alike(value: Column, stream: Column, stays: Column) -> Column:
    """``value`` with all but its first ``stays`` signs replaced by signs of their sort."""
    signs = F.filter(F.split(value, ""), lambda s: s != "")
    hexadecimal = value.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,}|[0-9a-f:]*:[0-9a-f:]*|[0-9A-F:]*:[0-9A-F:]*)$") & value.rlike("[A-Fa-f:]")
    return _let(hexadecimal, lambda h: F.array_join(F.transform(signs, lambda s, i: F.when(i < stays, s).otherwise(_letter(s, stream[i], h))), ""))


def _check_digit(digits: Column, original: Column) -> Column:
    """``digits`` with the last one made such that the Luhn check passes, if it does for ``original``."""
    plain = F.regexp_replace(digits, "[^0-9]", "")
    head = plain.substr(F.lit(1), F.length(plain) - 1)
    right = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(head, d.cast("string"))))[0]
    valid = F.call_function("luhn_check", F.regexp_replace(original, "[^0-9]", ""))
    return F.when(valid, F.concat(digits.substr(F.lit(1), F.length(digits) - 1), right.cast("string"))).otherwise(digits)


def _iban(drawn: Column) -> Column:
    """``drawn`` with valid check digits."""
    body = F.regexp_replace(drawn.substr(F.lit(5), F.length(drawn)), " ", "")
    signs = F.filter(F.split(F.concat(body, drawn.substr(1, 2), F.lit("00")), ""), lambda s: s != "")
    digits = F.array_join(F.transform(signs, lambda s: F.when(s.rlike("[A-Z]"), (F.ascii(s) - 55).cast("string")).otherwise(s)), "")
    digits = F.filter(F.split(digits, ""), lambda s: s != "")
    rest = F.aggregate(digits, F.lit(0), lambda acc, d: F.pmod(acc * 10 + d.cast("int"), F.lit(97)))
    return F.concat(drawn.substr(1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), drawn.substr(F.lit(5), F.length(drawn)))


def _draw(key: str, kind: Column, value: Column, draw: Column) -> Column:
    return _let(_stream(key, kind, value, draw, F.length(value) + 8), lambda stream: _drawn(kind, value, draw, stream))


def _drawn(kind: Column, value: Column, draw: Column, stream: Column) -> Column:
    country = F.length(F.regexp_extract(value, r"^\+(?:1|7|[2-9][0-9])", 0))
    prefix = F.length(F.regexp_extract(value, "^(?:[a-z]+_live_|[a-z]+_test_|AKIA|gh[pousr]_|xox[abprs]-)", 0))
    stays = F.when(kind == "phone", country).when(kind == "iban", 2).when(kind == "key", prefix).otherwise(0)
    alike = _alike(value, stream, stays)
    # wider forms of later rounds: more signs in front of an address, behind all else
    more = F.greatest(F.lit(0), F.ceil((draw - SAME_FORM + 1) / MORE)).cast("int")
    places = F.filter(F.sequence(F.lit(0), more), lambda i: i > 0)
    letters, digits = (F.array_join(F.transform(places, lambda i: _pick(signs, stream[F.pmod(i * 3, F.lit(8))] + i)), "") for signs in (ALPHABETS["latin"], ALPHABETS["digit"]))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(stream[i], F.lit(254)) + 1).cast("string")), ".")
    tail = F.regexp_extract(value, r"\.[^.]+$", 0)  # the top-level domain stays
    address = F.concat(letters, alike.substr(F.lit(1), F.length(value) - F.length(tail)), tail)
    out = F.when(kind == "ip", octets).when(kind == "email", address).when(kind == "number", _let(F.concat(digits, alike), lambda x: _check_digit(x, value))).when(kind == "iban", _let(F.concat(alike, F.upper(letters)), _iban))
    out = out.when(kind == "ip6", alike).when(kind.isin("secret", "key"), F.concat(alike, letters)).otherwise(F.concat(alike, digits))
    count = F.floor(draw / 2).cast("int") + 1  # parts of a name: more with later rounds
    tables = {f"family/{script}": names for script, names in FAMILY.items()} | {f"given/{g}/{script}": names for (g, script), names in GIVEN.items()}
    tables |= {f"given/u/{script}": " ".join(n for (_, s), n in GIVEN.items() if s == script) for script in FAMILY}
    for name, names in tables.items():
        listed = F.array(*[F.lit(x) for x in names.split()])
        picked = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.element_at(listed, F.pmod(stream[F.pmod(i, F.lit(8))] + i, F.lit(len(names.split()))).cast("int") + 1)), "-")
        out = F.when(kind == name, picked).otherwise(out)
    return out


def _sort(kind: Column) -> Column:
    """Kinds whose surrogates must differ from each other and from each other's originals."""
    return F.split(kind, "/")[0]


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate for distinct (kind, value): no two of a kind alike, none an original."""
    entities = staged(entities.select("kind", "value").distinct(), "entities")
    taken = entities.select(_sort(F.col("kind")).alias("sort"), F.lower("value").alias("drawn")).distinct()
    done, open_ = None, entities
    for draw in range(MOST_ROUNDS):
        drawn = open_.withColumn("surrogate", _draw(key, F.col("kind"), F.col("value"), F.lit(draw)))
        drawn = staged(drawn.select("*", _sort(F.col("kind")).alias("sort"), F.lower("surrogate").alias("drawn")), "drawn")
        first = drawn.groupBy("sort", "drawn").agg(F.min(F.struct("kind", "value")).alias("first")).join(taken, ["sort", "drawn"], "left_anti")
        judged = drawn.join(first, ["sort", "drawn"], "left").withColumn("ok", F.coalesce(F.struct("kind", "value") == F.col("first"), F.lit(False)))
        judged = staged(judged.select("kind", "value", "surrogate", "sort", "drawn", "ok"), "judged")
        good = judged.where("ok")
        done = good.select("kind", "value", "surrogate") if done is None else done.unionByName(good.select("kind", "value", "surrogate"))
        open_ = judged.where("not ok").select("kind", "value")
        if not open_.head(1):
            return done
        taken = taken.unionByName(good.select("sort", "drawn"))
    raise ValueError(f"surrogates still collide after {MOST_ROUNDS} rounds")


def replace(docs: DataFrame, key: str = "surrogates", text: str = "text") -> DataFrame:
    """``docs`` with every entity of ``text`` replaced; all rows and columns stay."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{n}`") for n in names])
    # the one look at every text; what follows reads the texts with entities alone
    scanned = staged(docs.select(row.alias("row"), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(PII), F.lit(0)).alias("found")), "scanned")
    has = F.coalesce(F.size("found"), F.lit(0)) > 0
    column = F.col("row").getField(text)
    some = scanned.where(has).withColumns({"a": F.xxhash64(column), "b": F.hash(column), "c": F.length(column)})
    found = some.select("a", "b", "c", "found").distinct().select("a", "b", "c", F.posexplode("found").alias("place", "entity"))
    parts = found.select("a", "b", "c", "place", F.posexplode(_parts(F.col("entity"), _kind(F.col("entity")))).alias("part", "x"))
    parts = staged(parts.select("a", "b", "c", "place", "part", F.col("x.kind").alias("kind"), F.col("x.value").alias("seen"), _same(F.col("x.kind"), F.col("x.value")).alias("value")), "parts")
    table = assign(parts.where("kind != ''"), key)
    joined = parts.join(table, ["kind", "value"], "left")
    upper = (F.col("seen") == F.upper("seen")) & F.col("kind").contains("/") & (F.length("seen") > 1)
    new = F.when(F.col("kind") == "", F.col("seen")).when(upper, F.upper("surrogate")).otherwise(F.col("surrogate"))
    joined = joined.select("a", "b", "c", F.struct("place", "part", new.alias("new")).alias("x"))
    listed = staged(joined.groupBy("a", "b", "c").agg(F.sort_array(F.collect_list("x")).alias("xs")), "listed")

    def rebuilt(new: Column) -> list[Column]:
        return [(new if n == text else F.col("row").getField(n)).alias(n) for n in names]

    changed = some.join(listed, ["a", "b", "c"]).select(*rebuilt(_rewritten(column)))
    return scanned.where(~has).select(*rebuilt(column)).unionByName(changed)


def _rewritten(text: Column) -> Column:
    """A text put together again: what stands between its entities, and the new parts ``xs`` in turn."""
    # parts of one entity (a title and names) are joined with the blanks they had
    pieces = F.transform("xs", lambda x: F.concat(F.when(x["part"] > 0, F.lit(" ")).otherwise(F.lit("")), x["new"]))
    begins = F.transform("xs", lambda x: F.when(x["part"] == 0, x["place"]).otherwise(F.lit(-1)))

    def whole(gaps: Column) -> Column:
        marked = F.zip_with(begins, pieces, lambda p, s: F.when(p >= 0, F.concat(F.element_at(gaps, p + 1), s)).otherwise(s))
        return F.concat(F.array_join(marked, ""), F.element_at(gaps, -1))

    return _let(F.split(text, PII, -1), whole)


def count(text: Column) -> Column:
    """How many entities a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(PII)), F.lit(0)).cast("long")
