"""Surrogates for personal data: detect, replace by keyed look-alikes, check for collisions.

Entities are found by one pattern: e-mail and IP addresses, IBANs, phone and card
numbers, social security numbers, secrets, and person names after a form of address or
with a known given name. Each becomes units (a name: given name and surname), and equal units get
equal surrogates everywhere, so mentions stay coreferent in and across documents; "Ms
Weber" and "Anna Weber" share the surname. A surrogate is derived from a secret key and the unit's
canonical form: letters stay letters of their script and case, digits digits, hex hex,
separators stay where each mention has them, and given names keep the gender.

All distinct units of the corpus are checked together: a surrogate that another unit
has got, or that is itself an original of its kind, is refused, and the unit tries its next
one, until every unit has its own.

Null text stays null, with no entities. Repeated rows are all rewritten alike. Other columns of the
input are kept, whatever their names; a domain may have any number of labels. All of it is column expressions, joins and aggregates; only a
document's own entities are gathered, in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdwright.llm.tables import stored, unused
from holdwright.operators.skew import skewed_lookup

FEMALE = "Anna|Maria|Sophie|Emma|Julia|Laura|Sarah|Elena|Carmen|Lucía|Claire|Camille|Ingrid|Katharina|Ольга|Анна|Мария|Елена|Ελένη|Μαρία"
MALE = "John|James|Thomas|Peter|Paul|David|Michael|Carlos|José|Pierre|Jean|Hans|Stefan|Иван|Пётр|Сергей|Γιώργος|Νίκος"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|г-жа|κυρία"
MALE_TITLES = "Mr|Herr|Señor|Sr|Monsieur|г-н|κύριος"
ANY_TITLES = "Dr|Prof"
WORD = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5}|\d{13,19})(?![\d-])",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}|(?:sk|pk|ghp|gho|AKIA|xox[bp])[-_A-Za-z0-9]{16,})(?![\p{L}\p{N}])",
    "name": rf"(?<!\p{{L}})(?:(?:{FEMALE_TITLES}|{MALE_TITLES}|{ANY_TITLES})\.? {WORD}(?: {WORD})?|(?:{FEMALE}|{MALE}) {WORD})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = rf"[@\d]|(?<!\p{{L}})(?:{FEMALE_TITLES}|{MALE_TITLES}|{ANY_TITLES}|{FEMALE}|{MALE})\.? |[0-9a-fA-F]{{32}}|(?:sk|pk|ghp|gho|AKIA|xox[bp])[-_A-Za-z0-9]{{16}}"
NAME_PARTS = rf"^(?:({FEMALE_TITLES}|{MALE_TITLES}|{ANY_TITLES})(\.? ))?({WORD})(?: ({WORD}))?$"
# Letters by script, and syllables and gendered endings for made-up names.
LATIN, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
SYLLABLES = {"latin": "ba re mi do lu ka ne so ti va ro le ma ni du sa", "cyrillic": "ба ре ми до лу ка не со ти ва ро ле ма ни ду са", "greek": "βα ρε μι δο λυ κα νε σο τι βα ρο λε μα νι δυ σα"}
ENDINGS = {
    ("latin", "f"): "ra lia na ssa", ("latin", "m"): "rus rd nek lo", ("latin", ""): "ley ner son mar",
    ("cyrillic", "f"): "ра лия на са", ("cyrillic", "m"): "рий дор ней лан", ("cyrillic", ""): "ич енко ук ян",
    ("greek", "f"): "ρα λια νη σα", ("greek", "m"): "ρος δης νης λος", ("greek", ""): "ίδης άκης ου άτος",
}
MOST_ATTEMPTS = 64


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _kind(match: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())):
        if kind != "name":
            out = F.when(match.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _gender(title: Column, given: Column) -> Column:
    out = F.lit("")
    for gender, titles, names in (("f", FEMALE_TITLES, FEMALE), ("m", MALE_TITLES, MALE)):
        out = F.when(title.isin(titles.split("|")) | ((title == "") & given.isin(names.split("|"))), gender).otherwise(out)
    return out


def _units(match: Column) -> Column:
    """Array of (kind, canonical, raw, before) of a match; `before` is kept as it is."""

    def unit(kind: Column, canonical: Column, raw: Column, before: Column) -> Column:
        return F.struct(kind.alias("kind"), canonical.alias("canonical"), raw.alias("raw"), before.alias("before"))

    kind = _kind(match)
    title, gap, first, second = (F.regexp_extract(match, NAME_PARTS, k) for k in range(1, 5))
    given = F.concat(F.lit("given"), _gender(title, first))
    surname = F.lit("surname")
    alone = F.array(unit(surname, F.lower(first), first, F.concat(title, gap)))
    both = F.array(unit(given, F.lower(first), first, F.concat(title, gap)), unit(surname, F.lower(second), second, F.lit(" ")))
    canonical = F.when(kind.isin("phone", "card", "ssn"), _digits(match)).when(kind == "email", F.lower(match)).when(kind == "iban", F.regexp_replace(match, " ", "")).otherwise(match)
    plain = F.array(unit(kind, canonical, match, F.lit("")))
    return F.when(kind != "name", plain).when(second == "", alone).otherwise(both)


def _number(digest: Column, at: Column) -> Column:
    """16-bit number from the digest, by position."""
    return F.conv(F.substring(digest, F.pmod(at * F.lit(4), F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))


def _swapped(text: Column, digest: Column, fixed_from: Column | None = None, hexadecimal: bool = False) -> Column:
    """Every letter and digit exchanged for another of its kind; from `fixed_from` on kept."""

    def one(c: Column, at: Column) -> Column:
        n = _number(digest, at)
        low = F.lower(c)
        out = c
        for letters in (GREEK, CYRILLIC, "abcdef" if hexadecimal else LATIN):
            new = _pick(letters, n)
            out = F.when(F.instr(F.lit(letters), low) > 0, F.when(c == low, new).otherwise(F.upper(new))).otherwise(out)
        out = F.when(c.rlike(r"^\p{L}$") & (out == c) & (F.instr(F.lit(LATIN + CYRILLIC + GREEK), low) == 0), _pick(LATIN, n)).otherwise(out)
        out = F.when(c.rlike("^[1-9]$"), F.when(at == 0, _pick("123456789", n)).otherwise(_pick("0123456789", n))).when(c == "0", F.when(at == 0, F.lit("0")).otherwise(_pick("0123456789", n))).otherwise(out)
        return F.when(at >= fixed_from, c).otherwise(out) if fixed_from is not None else out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _made_name(canonical: Column, gender: str, digest: Column, attempt: Column) -> Column:
    """Syllables and an ending of the name's script; later attempts get longer."""
    out = F.lit("")
    for script, sample in (("greek", "Greek"), ("cyrillic", "Cyrillic"), ("latin", None)):
        def drawn(words: str, at: Column) -> Column:
            parts = words.split(" ")
            return F.element_at(F.array(*map(F.lit, parts)), F.pmod(_number(digest, at), F.lit(len(parts))) + 1)

        body = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.lit(6), F.lit(1) + attempt)), lambda k: drawn(SYLLABLES[script], k)), "")
        name = F.initcap(F.concat(body, drawn(ENDINGS[script, gender], F.lit(9))))
        out = F.when(canonical.rlike(rf"^\p{{Is{sample}}}"), name).otherwise(out) if sample else F.when(out == "", name).otherwise(out)
    return out


def surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """Look-alike of a unit, fixed by key, kind, canonical form and attempt."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, canonical, attempt.cast("string"))
    digest = F.sha2(seed, 512)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.pmod(_number(digest, k), F.lit(254)) + 1).cast("string")), ".")
    last_label = F.length(canonical) - F.instr(F.reverse(canonical), ".")
    hexadecimal = canonical.rlike("^[0-9a-fA-F]+$")
    out = F.when(kind == "ip", octets).when(kind == "email", _swapped(canonical, digest, last_label))
    out = out.when((kind == "secret") & hexadecimal, _swapped(canonical, digest, hexadecimal=True))
    out = out.when(kind == "iban", F.concat(F.substring(canonical, 1, 2), _swapped(F.substring(canonical, F.lit(3), F.length(canonical)), digest)))
    out = out.when(kind == "surname", _made_name(canonical, "", digest, attempt)).when(kind == "givenf", _made_name(canonical, "f", digest, attempt))
    return out.when(kind.isin("givenm", "given"), _made_name(canonical, "m", digest, attempt)).otherwise(_swapped(canonical, digest))


def _dressed(kind: Column, raw: Column, replacement: Column) -> Column:
    """The surrogate in the format of this mention: separators, and capitals of a name or e-mail."""
    spread = F.array_join(
        F.transform(F.split(raw, ""), lambda c, at: F.when(c.rlike("^[0-9A-Z]$"), F.substring(replacement, F.length(F.regexp_replace(F.substring(raw, F.lit(1), at + 1), "[^0-9A-Z]", "")), F.lit(1))).otherwise(c)), ""
    )
    capitals = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(replacement)).otherwise(replacement)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spread).when(kind.isin("email", "surname", "given", "givenf", "givenm"), capitals).otherwise(replacement)


def assign(units: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) with no surrogate twice in a kind, and none that is an original."""
    every = stored(units.select("kind", "canonical").distinct())
    shape = F.when(F.col("kind").startswith("given"), F.lit("given")).otherwise(F.col("kind"))
    originals = every.select(shape.alias("shape"), F.lower("canonical").alias("taken")).distinct()
    pending, done = every, None
    for attempt in range(MOST_ATTEMPTS):
        tried = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.lit(attempt), key)).withColumn("shape", shape).withColumn("taken", F.lower("surrogate"))
        free = tried.join(originals, ["shape", "taken"], "left_anti")
        if done is not None:
            free = free.join(done.select("shape", "taken"), ["shape", "taken"], "left_anti")
        first = free.groupBy("shape", "taken").agg(F.min(F.struct("canonical", "kind", "surrogate")).alias("f"))
        won = stored(first.select("shape", "taken", "f.kind", "f.canonical", "f.surrogate"))
        done = won if done is None else done.unionByName(won)
        pending = stored(pending.join(won, ["kind", "canonical"], "left_anti"))
        if pending.isEmpty():
            return done.select("kind", "canonical", "surrogate")
    raise ValueError("no free surrogates left; use longer names or another key")


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with surrogates in their texts, and `n_entities` (in place of a column of that name)."""
    source = docs.drop("n_entities")
    row, found_matches, found_parts = unused(source, "row", "matches", "parts")
    matches, parts = F.col(found_matches), F.col(found_parts)
    suspect = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    marked = source.withColumn(found_matches, F.when(suspect, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    hit = source.where(suspect).select(F.sha2(text, 256).alias("row"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("matches")).where(F.size("matches") > 0)
    mentions = hit.select("row", F.posexplode("matches").alias("at", "match")).select("row", "at", F.posexplode(_units(F.col("match"))).alias("part", "u"))
    mentions = stored(mentions.select("row", "at", "part", "u.*").distinct())
    given = assign(mentions, key)
    dressed = skewed_lookup(mentions, stored(given), ["kind", "canonical"], ["row", "at"])
    new = dressed.select("row", "at", "part", F.concat("before", _dressed(F.col("kind"), F.col("raw"), F.col("surrogate"))).alias("new"))
    found = stored(new.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("at", "part", "new"))).alias(found_parts)))
    clean = marked.where(F.size(matches) == 0).drop(found_matches).withColumn("n_entities", F.lit(0).cast("long"))
    dirty = marked.where(F.size(matches) > 0).join(found, F.sha2(text, 256) == F.col(row))
    pieces = F.split(text, ANY, -1)
    filled = F.transform(pieces, lambda p, at: F.concat(p, F.array_join(F.transform(F.filter(parts, lambda x: x["at"] == at), lambda x: x["new"]), "")))
    rewritten = dirty.withColumn("n_entities", F.size(matches).cast("long")).withColumn(text, F.array_join(filled, ""))
    return clean.unionByName(rewritten.select(*source.columns, "n_entities"))
