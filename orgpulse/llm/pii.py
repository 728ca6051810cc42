"""Surrogates for personal data, with DataFrame functions only.

Entities are found by one regular expression and cut into parts: an e-mail address into local part
and domain, a titled name into first names, initials and surnames. Each part gets a replacement of its
own kind derived from a keyed hash of its canonical form (no case, no separators), so it gets the same
one wherever and however it is written: "Mr Ivan Petrov" and "Mr Petrov" keep sharing a surname. The
surrogate takes over separators, upper and lower case, script, the gender a title tells, and check
digits. Capitalised words of a text that are part of a titled name in it are replaced alike.

A collision check over all distinct parts derives anew what equals another surrogate or a part of the
corpus, so distinct parts stay distinct. Later attempts draw from wider shapes (more characters, more
syllables, longer octets and at last the documentation range of IPv6), so the rounds always end.
Initials are turned round their alphabet, which keeps them distinct without a check.

Names are found behind a title only; a capitalised noun right behind a name counts as part of it.
First names behind titles without a gender (Dr) are given one by their last letter.

A null text stays null and an empty one empty; texts without entities are unchanged. Very long texts
are whole; a text's work grows with its titled names times its capitalised words. Rows with equal or
null ids are treated alike, since surrogates don't depend on ids. An empty table gives an empty one.
Other columns are kept as they are, whatever their names; ``n_pii`` replaces a column of that name.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgpulse.llm.columns import free_name
from orgpulse.session import cut_lineage

# Titles, by the gender they tell, and small words inside surnames.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor")
PARTICLES = ("von", "van", "der", "den", "de", "del", "la", "di", "da", "dos", "zu", "al", "bin")
FIRST = {
    ("latin", "m"): "Adrian Bruno Conrad Dario Emil Felix Gregor Hugo Ivan Jonas Karl Leon Mario Nico Oscar Paul".split(),
    ("latin", "f"): "Alba Bianca Clara Daria Elena Flora Greta Hanna Irina Julia Karla Lena Maria Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Марк Никита Олег Павел Роман Степан Тимур".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Инна Ксения Лидия Мария Нина Ольга Полина Раиса София Тамара".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιάννης Δημήτρης Ευάγγελος Ζήσης Ηλίας Θωμάς Ιάσων Κώστας Λάμπρος Μάριος Νίκος Πέτρος Στέφανος Φώτης".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ήρα Θεοδώρα Ιωάννα Κατερίνα Λίνα Μαρία Νίκη Πηνελόπη Σοφία Φανή".split(),
}
SYLLABLES = {
    "latin": "ba be bo da do fa ga ka la le ma mi no ra ri sa".split(),
    "cyrillic": "ба бе бо да до фа га ка ла ле ма ми но ра ри са".split(),
    "greek": "βα βε βο δα δο φα γα κα λα λε μα μι νο ρα ρι σα".split(),
}
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω")

# A word of a name may hold apostrophes and hyphens, but no possessive ending.
LETTERS = r"[\p{L}\p{M}]*+"
JOINED = r"['’](?!s(?!\p{L}))"
WORD = rf"\p{{Lu}}(?=['’]?\p{{L}}){LETTERS}(?:(?:{JOINED}|-)\p{{L}}{LETTERS}){{0,4}}"
TITLE = "(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.? (?:(?:Dr|Prof)\.? ){0,2}"
# Each pattern forbids before it what could belong to the entity itself, so that texts without spaces are read too.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})(?:\.[A-Za-z0-9][A-Za-z0-9\-]{0,62}){1,8}",
    "ip": r"(?=[0-9])(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "secret": r"(?=[a-fA-F]{0,128}[0-9])(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<!\d)\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)",
    "card": r"(?=[0-9])(?<![A-Za-z0-9+])\d(?:[ \-]?\d){12,18}(?!\d)",
    "ssn": r"(?=[0-9])(?<![A-Za-z0-9\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "national": r"(?=[0-9(])(?<![A-Za-z0-9.+\-])(?:\(\d{3}\) ?\d{3}[ .\-]|\d{3}-\d{3}-|\d{3}\.\d{3}\.)\d{4}(?![\d\-])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{IsLatin}}\p{{IsCyrillic}}\p{{IsGreek}}\d]){TITLE}(?:(?:\p{{Lu}}\. ?|(?:{'|'.join(PARTICLES)}) |{WORD} )){{0,4}}{WORD}",
}
ANY = "(?:" + "|".join(PATTERNS.values()) + ")"
HINT = r"[0-9@]|(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.? "
# A later mention of a name, and what a name is cut into: initials, words and what stands between them.
MENTION = rf"(?<![\p{{L}}\p{{M}}'’])\p{{Lu}}(?=['’]?\p{{L}}){LETTERS}(?:{JOINED}\p{{L}}{LETTERS})?"
TOKEN = rf"\p{{Lu}}\.|[\p{{L}}\p{{M}}]++(?:{JOINED}\p{{L}}{LETTERS})?|[^\p{{L}}\p{{M}}]+"
WIDER, WIDEST = 3, 8  # attempts from which shapes grow, and from which addresses take the long form


def _kind(entity: Column) -> Column:
    """Which pattern an entity is of."""
    kind = F.lit("card")
    for name in ("name", "national", "ssn", "phone", "iban", "secret", "ip", "email"):
        kind = F.when(entity.rlike("^(?:" + PATTERNS[name] + ")$"), name).otherwise(kind)
    return kind


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[ .()\-]", "")


def _part(role: str, word: Column, canonical: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), word.alias("word"), canonical.alias("canonical"))


def _name_parts(entity: Column) -> Column:
    """Title and separators as they are, initials, first names (keyed with their gender) and the parts of the surname."""
    title = F.regexp_extract(entity, "^" + TITLE, 0)
    tail = F.substring(entity, F.length(title) + 1, F.length(entity))
    surname = F.substring_index(F.substring_index(tail, " ", -1), ".", -1)
    given = F.substring(tail, F.lit(1), F.length(tail) - F.length(surname))
    said = F.regexp_extract(title, r"^[^ .]+", 0)

    def one(first: bool):
        def part(token: Column) -> Column:
            if first:
                sex = F.when(said.isin(*FEMALE), "f").when(said.isin(*MALE), "m").when(token.rlike("[aаяαη]$"), "f").otherwise("m")
                named = _part("first", token, F.concat(F.lit("first:"), sex, F.lit(":"), F.lower(token)))
            else:
                named = _part("surname", token, F.concat(F.lit("surname:"), F.lower(token)))
            kept = F.lit(None).cast("string")
            return F.when(token.rlike(r"^\p{Lu}\.$"), _part("initial", token, kept)).when(token.rlike(r"^\p{Lu}[\p{L}'’]"), named).otherwise(_part("kept", token, kept))

        return part

    kept = F.array(_part("kept", title, F.lit(None).cast("string")))
    return F.concat(kept, F.transform(F.regexp_extract_all(given, F.lit(TOKEN), F.lit(0)), one(True)), F.transform(F.regexp_extract_all(surname, F.lit(TOKEN), F.lit(0)), one(False)))


def _parts(entities: Column) -> Column:
    """For each entity the array of its parts (role, word, canonical); parts that stay have no canonical form."""
    kinds = F.transform(entities, lambda e: F.struct(e.alias("entity"), _kind(e).alias("kind")))

    def cut(x: Column) -> Column:
        entity, kind = x["entity"], x["kind"]
        site = F.substring_index(entity, "@", -1)
        at = _part("kept", F.lit("@"), F.lit(None).cast("string"))
        email = F.array(_part("local", F.substring_index(entity, "@", 1), F.concat(F.lit("local:"), F.lower(entity))), at, _part("site", site, F.concat(F.lit("site:"), F.lower(site))))
        parts = F.when(kind == "email", email).when(kind == "name", _name_parts(entity))
        for role in ("ip", "secret", "iban", "phone", "card", "ssn"):
            is_role = kind.isin("phone", "national") if role == "phone" else kind == role
            parts = parts.when(is_role, F.array(_part(role, entity, F.concat(F.lit(role + ":"), _written(role, entity)))))
        return parts

    return F.transform(kinds, cut)


def _written(role: str, word: Column) -> Column:
    return {"ip": word, "secret": F.lower(word), "site": F.lower(word), "first": F.lower(word), "surname": F.lower(word)}.get(role, _bare(word))


def _byte(digest: Column, at: Column) -> Column:
    """A number from 0 to 65535 at a place of a hash of 128 hex digits, which is used round and round."""
    return F.conv(F.substring(digest, (F.pmod(at * 3, F.lit(125)) + 1).cast("int"), 4), 16, 10).cast("int")


def _digest(key: str, canonical: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), canonical, attempt.cast("string"), F.lit(key)), 512)


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def _characters(text: Column, digest: Column, hexadecimal: Column | None = None) -> Column:
    """Every letter and digit replaced by another of its script and case; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        number = _byte(digest, i)
        out = F.when(c.rlike("[0-9]"), _pick(list(string.digits), number))
        for alphabet in ALPHABETS:
            small = _pick(list(alphabet), number)
            out = out.when(F.instr(F.lit(alphabet), c) > 0, small).when(F.instr(F.lit(alphabet), F.lower(c)) > 0, F.upper(small))
        if hexadecimal is not None:
            small = _pick(list(string.hexdigits[:16]), number)
            out = F.when(hexadecimal & c.rlike("[0-9a-f]"), small).when(hexadecimal & c.rlike("[A-F]"), F.upper(small)).otherwise(out.otherwise(c))
            return out
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a text of digits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + F.when(c == "0", -8).otherwise(1)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))


def _card(bare: Column, valid: Column, digest: Column) -> Column:
    """Digits with the same first one (the issuer's kind) and the same validity of the check digit."""
    changed = F.concat(F.substring(bare, 1, 1), _characters(F.substring(bare, 2, 1 << 20), digest))

    def checked(made: Column) -> Column:
        head = F.substring(made, 1, F.length(made) - 1)
        return F.when(valid, F.concat(head, F.pmod(-_luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))).otherwise(made)

    return _let(changed, checked)


def _ip(entity: Column, digest: Column, attempt: Column) -> Column:
    """Octets of as many digits, then octets of any length, then an address of the documentation range of IPv6."""

    def octet(o: Column, i: Column) -> Column:
        number = _byte(digest, i)
        alike = F.when(F.length(o) == 1, F.pmod(number, F.lit(9)) + 1).when(F.length(o) == 2, F.pmod(number, F.lit(90)) + 10).otherwise(F.pmod(number, F.lit(155)) + 100)
        return F.when(attempt < WIDER, alike).otherwise(F.pmod(number, F.lit(255)) + 1).cast("string")

    long = F.concat_ws(":", F.lit("2001:db8"), *[F.substring(digest, 4 * i + 1, 4) for i in range(6)])
    return F.when(attempt < WIDEST, F.array_join(F.transform(F.split(entity, r"\."), octet), ".")).otherwise(long)


def _spoken(count: Column, syllables: list[str], digest: Column) -> Column:
    """So many keyed syllables."""
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: _pick(syllables, _byte(digest, i))), "")


def _cased(made: Column, like: Column) -> Column:
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(made)).otherwise(made)


def _named(x: Column) -> Column:
    """First name of the gender and the script, or surname of keyed syllables; longer with each attempt."""
    word, digest, attempt = x["word"], x["digest"], x["attempt"]
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    female = F.substring(x["canonical"], 7, 1) == "f"
    made = F.lit("")
    for name, syllables in SYLLABLES.items():
        male_or_female = F.when(female, _pick(FIRST[name, "f"], _byte(digest, F.lit(0)))).otherwise(_pick(FIRST[name, "m"], _byte(digest, F.lit(0))))
        first = F.concat(_spoken(attempt * 2, syllables, digest), F.when(attempt > 0, F.lower(male_or_female)).otherwise(male_or_female))
        made = F.when(script == name, F.when(x["role"] == "first", first).otherwise(_spoken(attempt * 2 + 5, syllables, digest))).otherwise(made)
    return F.concat(F.regexp_extract(word, r"^\p{Lu}['’]", 0), _cased(F.initcap(made), word))


def _turned(key: str, initial: Column) -> Column:
    """Letters moved round their alphabet by a keyed step, so that different ones stay different."""
    source, target = "", ""
    for alphabet in ALPHABETS:
        letters = alphabet.replace("ς", "")
        step = 1 + int(hashlib.sha256(f"{key}|{letters}".encode()).hexdigest(), 16) % (len(letters) - 1)
        turned = letters[step:] + letters[:step]
        source, target = source + letters.upper(), target + turned.upper()
    return F.translate(initial, source, target)


def _weave(shape: Column, bare: Column) -> Column:
    """The characters of ``bare`` in the places that ``shape`` has letters and digits in; separators stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), bare.alias("bare"))

    def step(acc: Column, c: Column) -> Column:
        gap = c.rlike(r"[ .()\-]")
        return F.struct(F.concat(acc["out"], F.when(gap, c).otherwise(acc["bare"].substr(acc["at"], F.lit(1)))).alias("out"), (acc["at"] + F.when(gap, 0).otherwise(1)).alias("at"), acc["bare"].alias("bare"))

    return F.aggregate(F.split(shape, ""), start, step, lambda acc: acc["out"])


def _surrogate(x: Column) -> Column:
    """Surrogate of a struct of role, word, canonical, attempt and digest; later attempts lengthen the word first."""
    role, digest, attempt = x["role"], x["digest"], x["attempt"]
    more = F.greatest(attempt - (WIDER - 1), F.lit(0))
    word = F.concat(x["word"], F.repeat(F.lit("0"), more))
    # The top-level name of a domain, the country of an IBAN and the country code of a phone number stay.
    site = F.concat(_characters(F.concat(F.regexp_extract(x["word"], r"^(.*)\.[^.]+$", 1), F.repeat(F.lit("a"), more)), digest), F.lit("."), F.substring_index(x["word"], ".", -1))
    lead = F.when(role == "iban", F.substring(word, 1, 2)).when(role == "phone", F.regexp_extract(word, r"^\+\d{1,3}(?=[^\d])", 0)).otherwise("")
    rest = F.substring(word, F.length(lead) + 1, F.length(word))
    plain = F.concat(lead, _weave(rest, _characters(_bare(rest), digest, role == "secret")))
    card = _weave(word, _card(F.regexp_replace(word, r"[ \-]", ""), _luhn_sum(_bare(x["word"])) % 10 == 0, digest))
    made = F.when(role == "local", _characters(word, digest)).when(role == "site", site).when(role == "card", card).when(role == "ip", _ip(x["word"], digest, attempt))
    return made.when(role.isin("first", "surname"), _named(x)).otherwise(plain)


def _made(part: Column, key: str, attempt) -> Column:
    """The part with what takes its place, as ``made``."""
    role, word, canonical = part["role"], part["word"], part["canonical"]

    def keyed(tried: Column) -> Column:
        return F.struct(role.alias("role"), word.alias("word"), canonical.alias("canonical"), tried.alias("attempt"), _digest(key, canonical, tried).alias("digest"))

    made = F.when(role == "kept", word).when(role == "initial", _turned(key, word)).otherwise(_let(_let(attempt(canonical), keyed), _surrogate))
    return F.struct(role.alias("role"), word.alias("word"), made.alias("made"))


def _as_claim(role: Column, word: Column, canonical: Column) -> Column:
    """What a part claims for itself: no two may claim the same. Local parts claim within their domain."""
    local = F.concat(F.lower(word), F.lit("@"), F.substring_index(canonical, "@", -1))
    said = F.when(role == "local", local)
    for name in ("ip", "secret", "site", "first", "surname"):
        said = said.when(role == name, _written(name, word))
    return F.concat(role, F.lit(":"), said.otherwise(_bare(word)))


def _claims(parts: DataFrame, key: str) -> DataFrame:
    made = parts.withColumn("made", _made(F.struct("role", "word", "canonical"), key, lambda _: F.col("attempt"))["made"])
    return made.withColumn("claimed", _as_claim(F.col("role"), F.col("made"), F.col("canonical"))).drop("made")


def collision_attempts(parts: DataFrame, key: str) -> DataFrame:
    """Parts (canonical, role, word) whose first surrogate is taken, with the attempt that is free.

    Each round derives the losers of the round before anew; a surrogate is taken if it is
    a part of the corpus or is claimed by an earlier or smaller one. Shapes widen with the
    attempts, so each round leaves a smaller share of losers and the loop ends.
    """
    names = cut_lineage(parts.select(_as_claim(F.col("role"), F.col("word"), F.col("canonical")).alias("claimed")).distinct())
    state = cut_lineage(_claims(parts.withColumn("attempt", F.lit(0)), key))
    while True:
        winner = state.groupBy("claimed").agg(F.min(F.struct("attempt", F.xxhash64("canonical"), "canonical")).alias("w"), F.count(F.lit(1)).alias("n"))
        lost = state.join(winner.where("n > 1"), "claimed").where("canonical <> w.canonical").select("canonical")
        taken = state.join(names, "claimed", "left_semi").select("canonical")
        redo = cut_lineage(lost.union(taken).distinct())
        if redo.isEmpty():
            return state.where("attempt > 0").select("canonical", "attempt")
        again = state.join(redo.withColumn("again", F.lit(1)), "canonical", "left")
        state = cut_lineage(_claims(again.select("canonical", "role", "word", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")), key))


def _entities(text: Column) -> Column:
    """All entities of a text in order. The simple test first spares texts that can't hold any the long pattern."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _mentioned(piece: Column, known: Column) -> Column:
    """The words of a text between entities, those of known names replaced, and how many they are."""
    words = F.transform(F.regexp_extract_all(piece, F.lit(MENTION), F.lit(0)), lambda w: F.struct(w.alias("word"), F.array_position(known["words"], F.lower(w)).alias("at")))

    def woven(found: Column) -> Column:
        new = F.transform(found, lambda x: F.when(x["at"] > 0, _cased(F.element_at(known["made"], F.greatest(x["at"], F.lit(1)).cast("int")), x["word"])).otherwise(x["word"]))
        text = F.array_join(F.zip_with(F.split(piece, MENTION, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.struct(text.alias("text"), F.size(F.filter(found, lambda x: x["at"] > 0)).alias("n"))

    return _let(words, woven)


def _replaced(text: Column, entities: Column, key: str, attempt) -> Column:
    """Struct of the new text and the number of replacements, of a text that holds entities."""
    pieces = F.split(text, ANY, -1)

    def weave(made: Column) -> Column:
        names = F.filter(F.flatten(made), lambda p: p["role"].isin("first", "surname"))
        new = F.transform(made, lambda parts: F.array_join(F.transform(parts, lambda p: p["made"]), ""))

        def between(known: Column) -> Column:
            return F.when(F.size(known["words"]) > 0, F.transform(pieces, lambda p: _mentioned(p, known))).otherwise(F.transform(pieces, lambda p: F.struct(p.alias("text"), F.lit(0).alias("n"))))

        def whole(parts: Column) -> Column:
            joined = F.array_join(F.zip_with(parts, new, lambda a, b: F.concat(a["text"], F.coalesce(b, F.lit("")))), "")
            return F.struct(joined.alias("text"), (F.size(made) + F.aggregate(parts, F.lit(0), lambda n, p: n + p["n"])).alias("n"))

        known = _let(names, lambda p: F.struct(F.transform(p, lambda x: F.lower(x["word"])).alias("words"), F.transform(p, lambda x: x["made"]).alias("made")))
        return _let(_let(known, between), whole)

    return _let(F.transform(_parts(entities), lambda parts: F.transform(parts, lambda p: _made(p, key, attempt))), weave)


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Documents with surrogates in place of their personal data, and the number of replacements as ``n_pii``."""
    text = F.col(text_col)
    # A text's own content is the join key, so null and repeated ids need no care.
    uses = docs.select(F.sha2(text, 256).alias("hash"), F.explode(F.flatten(_parts(F.array_distinct(_entities(text))))).alias("part")).where("part.canonical IS NOT NULL")
    parts = uses.groupBy("part.canonical").agg(F.min("part.role").alias("role"), F.min("part.word").alias("word"))
    retried = collision_attempts(parts, key)
    found, hashed, attempts, out = (free_name(docs, name) for name in ("_found", "_hash", "_attempts", "_out"))
    marked = docs.withColumn(found, _entities(text))
    if retried.isEmpty():
        marked = marked.withColumn(attempts, F.lit(None).cast("map<string,int>"))
    else:
        again = uses.select("hash", "part.canonical").distinct().join(retried, "canonical")
        again = again.groupBy(F.col("hash").alias(hashed)).agg(F.map_from_entries(F.collect_list(F.struct("canonical", "attempt"))).alias(attempts))
        marked = marked.withColumn(hashed, F.sha2(text, 256)).join(again, hashed, "left")

    def attempt(canonical: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(attempts), canonical), F.lit(0))

    same = F.struct(text.alias("text"), F.lit(0).alias("n"))
    marked = marked.withColumn(out, F.when(F.size(found) > 0, _replaced(text, F.col(found), key, attempt)).otherwise(same))
    kept = [F.col(out)["text"].alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "n_pii"]
    return marked.select(*kept, F.col(out)["n"].alias("n_pii"))
