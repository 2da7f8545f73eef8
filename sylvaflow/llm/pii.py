"""Surrogates for personal data, in DataFrame and SQL functions only.

One pattern finds all entities of a text. An entity has one or two parts (an address's local part and
domain, a person's given name and surname), and every distinct part of the corpus gets one surrogate:
its characters are replaced by others of their class. So mentions of the same part agree everywhere,
whatever their case or separators.

Numbers and secrets are permuted: half of the characters are shifted within their classes by SHA-256 of a key
and the other half, in turns, so two parts of a shape never get the same surrogate. Names and addresses
are drawn by the same rounds and then shaped, and grow by a syllable after GROWTH attempts. Surrogates are
checked: one that two parts share, or that is itself a part found in the corpus, is drawn again for
all but the least of them. Where real numbers fill over a quarter of a shape's space (short phone numbers) that
can't be had; there the permutation alone keeps them distinct, and a surrogate may be another's number.

Only texts with an entity are shuffled; only the parts that needed another attempt are joined to the
mentions, salted, so a part that a third of all rows mention is spread over SALTS keys.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvaflow.llm.tables import stored

# Titles that announce a person, by the gender that they say.
TITLES = {
    "m": "Mr Mister Herr Herrn Monsieur Señor Signor господин Κύριος",
    "f": "Mrs Ms Miss Frau Madame Mme Señora Señorita Signora госпожа Κυρία",
    "x": "Dr Prof Professor Doktor",
}
# Letters that stand in for each other, by script, case and sound.
ALPHABETS = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "AEIOU",
    "BCDFGHJKLMNPQRSTVWXYZ",
    "àâäéèêëîïôöùûüáíóúñçß",
    "ÀÂÄÉÈÊËÎÏÔÖÙÛÜÁÍÓÚÑÇ",
    "аеиоуыэюяё",
    "бвгджзйклмнпрстфхцчшщьъ",
    "АЕИОУЫЭЮЯЁ",
    "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
    "αεηιουωάέήίόύώ",
    "βγδζθκλμνξπρσςτφχψ",
    "ΑΕΗΙΟΥΩΆΈΉΊΌΎΏ",
    "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
)
# Endings of given names, by script (a letter of it) and gender.
ENDINGS = (("[a-z]", "a", "o"), ("[а-яё]", "а", "ий"), ("[α-ω]", "α", "ος"))
VOWEL_END = "[aeiouаеиоуыэюяёαεηιουω]+$"

_titles = "|".join(name for names in TITLES.values() for name in names.split())
_initials = "".join(sorted({name[0] for names in TITLES.values() for name in names.split()}))
# Each pattern is tried only where a cheap look at one character allows it, and long runs are read once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"""(?<=["'=:\s])(?=[A-Za-z0-9/+_=-]{16})(?<=(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?)[A-Za-z0-9/+_=-]++|(?=[Ag])(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])""",
    "number": r"(?=[0-9+(])(?:"
    + "|".join(
        (
            r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",  # address
            r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",  # social security
            r"(?<![\d.+-])\d(?:[ -]?\d){12,18}(?![\d-])",  # card
            r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{1,4}){2,5}(?!\w)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",  # phone
        )
    )
    + ")",
    "person": rf"(?=[{_initials}])(?<![\p{{L}}\d])(?:{_titles})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# What a secret's surroundings must hold, so that texts without are not searched further.
SECRET_HINT = r"(?=[tspaAgTSP])(?i:token|secret|passw|api[_-]?key|access[_-]?key|AKIA|gh[pousr]_)"
COUNTRY = r"^\+(?:1|7|\d\d)"
#: Keys that the mentions of one part are spread over.
SALTS = 16
#: Attempts after which a surrogate grows by a syllable, so that short parts can't run out of them, and
#: attempts after which all must be distinct: each leaves half of the clashes at most.
GROWTH, MOST_ATTEMPTS = 4, 64
#: Kinds whose surrogates are permutations of a shape's space: they don't grow.
NUMBERS = ("ip", "card", "ssn", "phone")


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda s, x: s + x)


def _any_entity(text: Column) -> Column:
    """Whether a text holds an entity: the dear patterns only where a cheap sign of them is."""
    found = (text.contains("@") & text.rlike(PATTERNS["email"])) | text.rlike(PATTERNS["number"]) | text.rlike(PATTERNS["person"])
    return F.coalesce(found | (text.rlike(SECRET_HINT) & text.rlike(PATTERNS["secret"])), F.lit(False))


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _check_digit(body: Column) -> Column:
    """The digit that ends a payment card's number."""
    n = F.length(body)
    value = lambda c, i: F.when((n - 1 - i) % 2 == 0, c.cast("int") * 2 - F.when(c > "4", 9).otherwise(0)).otherwise(c.cast("int"))
    return ((F.lit(10) - _sum(F.transform(_chars(body), value)) % 10) % 10).cast("string")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _kind(mention: Column) -> Column:
    digits = _digits(mention)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    valid = F.concat(body, _check_digit(body)) == digits
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
        .when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(rf"^(?:{_titles})\.? "), "person")
        .when(mention.rlike(r"^\d[\d -]*$") & F.length(digits).between(13, 19), F.when(valid, "card"))
        .when(mention.rlike(r"^[+(\d][\d ().-]*$"), "phone")
        .otherwise("secret")
    )


def _parts(mention: Column, kind: Column) -> Column:
    """array of (kind, canon, shown, lead, trail): what a surrogate is made for, how it stands in the
    text, and what stands unchanged around it."""
    part = lambda k, canon, shown, lead="", trail="": F.struct(*(x.cast("string").alias(n) for n, x in zip(("kind", "canon", "shown", "lead", "trail"), (k if isinstance(k, Column) else F.lit(k), canon, shown, F.lit(lead) if isinstance(lead, str) else lead, F.lit(trail) if isinstance(trail, str) else trail))))
    local, domain = F.substring_index(mention, "@", 1), F.substring_index(mention, "@", -1)
    title = F.regexp_extract(mention, r"^\S+ ", 0)
    names = F.split(F.regexp_replace(mention, r"^\S+ ", ""), " ")
    plain = F.regexp_replace(title, r"\.? $", "")
    gender = reduce(lambda w, g: w.when(plain.isin(*TITLES[g].split()), g), ("m", "f"), F.when(F.lit(False), "")).otherwise(F.when(F.lower(names[0]).rlike("[aаα]$"), "f").otherwise("m"))
    country = F.regexp_extract(mention, COUNTRY, 0)
    national = F.regexp_replace(mention, COUNTRY, "")
    number = F.concat(F.when(country == "+1", "").otherwise(country), _digits(national))
    surname = F.try_element_at(names, F.lit(-1))
    return (
        F.when(kind == "email", F.array(part("local", F.lower(local), local, trail="@"), part("domain", F.lower(domain), domain)))
        .when((kind == "person") & (F.size(names) > 1), F.array(part(F.concat(F.lit("given_"), gender), F.lower(names[0]), names[0], lead=title, trail=" "), part("surname", F.lower(surname), surname)))
        .when(kind == "person", F.array(part("surname", F.lower(surname), surname, lead=title)))
        .when(kind == "phone", F.array(part("phone", number, national, lead=country)))
        .when(kind.isin("card", "ssn"), F.array(part(kind, _digits(mention), mention)))
        .when(kind.isNull(), F.array(part(F.lit(None), mention, mention)))
        .when(kind == "ip", F.array(part("ip", F.array_join(F.transform(F.split(mention, r"\."), lambda o: o.cast("int").cast("string")), "."), mention)))
        .otherwise(F.array(part(kind, mention, mention)))
    )


def _let(value: Column, f) -> Column:
    """f(value), the value computed once."""
    return F.transform(F.array(value), f)[0]


def _stream(seed: Column, length: Column) -> Column:
    """Hexadecimal digits, two a character."""
    blocks = F.sequence(F.lit(0), F.floor(length / 32).cast("int"))
    return F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")), 256)), "")


def _byte(stream: Column, i: Column | int) -> Column:
    return F.conv(F.substring(stream, F.lit(2) * i + 1, F.lit(2)), 16, 10).cast("int")


def _shifted(text: Column, seed: Column, table: Column) -> Column:
    """Each character moved within its class by the stream of a seed; others stay. `table`: the class of all
    characters, or null for those of ALPHABETS."""
    classes = F.from_json(F.lit(json.dumps({c: a for a in ALPHABETS for c in a}, ensure_ascii=False)), "map<string,string>")

    def one(stream: Column):
        def move(c: Column, i: Column) -> Column:
            letters = F.coalesce(table, F.try_element_at(classes, c), c)
            return F.substring(letters, (F.position(c, letters) - 1 + _byte(stream, i)) % F.length(letters) + 1, F.lit(1))

        return F.when(text == "", "").otherwise(F.array_join(F.transform(_chars(text), move), ""))

    return _let(_stream(seed, F.length(text)), one)


def _permuted(text: Column, seed: Column, table: Column) -> Column:
    """A keyed permutation of the texts that have the same class at every place."""
    half = F.floor(F.length(text) / 2).cast("int")
    tagged = lambda k, other: F.concat_ws("\x1f", seed, F.lit(str(k)), other)
    state = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    state = _let(state, lambda s: F.struct(s["a"].alias("a"), _shifted(s["b"], tagged(1, s["a"]), table).alias("b")))
    state = _let(state, lambda s: F.struct(_shifted(s["a"], tagged(2, s["b"]), table).alias("a"), s["b"].alias("b")))
    state = _let(state, lambda s: F.struct(s["a"].alias("a"), _shifted(s["b"], tagged(3, s["a"]), table).alias("b")))
    return _let(state, lambda s: F.concat(s["a"], s["b"]))


def _address(canon: Column, seed: Column) -> Column:
    """A keyed permutation of addresses, octet by octet; outer octets stay within what is common there."""
    octet = lambda k: F.split(canon, r"\.")[k].cast("int")
    state = F.struct(*(octet(k).alias(f"o{k}") for k in range(4)))

    def moving(k: int, size: int, least: int):
        def step(s: Column) -> Column:
            others = F.concat_ws(".", seed, *(s[f"o{j}"].cast("string") if j != k else F.lit("x") for j in range(4)))
            moved = (s[f"o{k}"] - least + F.conv(F.substring(F.sha2(others, 256), 1, 6), 16, 10).cast("int")) % size + least
            moved = F.when(s[f"o{k}"].between(least, least + size - 1), moved).otherwise(s[f"o{k}"])
            return F.struct(*((moved if j == k else s[f"o{j}"]).alias(f"o{j}") for j in range(4)))

        return step

    for k, size, least in ((0, 223, 1), (1, 256, 0), (2, 256, 0), (3, 254, 1)):
        state = _let(state, moving(k, size, least))
    return _let(state, lambda s: F.concat_ws(".", *(s[f"o{j}"].cast("string") for j in range(4))))


def _surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """A part's surrogate of an attempt: like it in length, script, case of letters and separators."""
    growth = F.when(kind.isin(*NUMBERS), 0).otherwise(F.floor(attempt / GROWTH)).cast("int")
    seed = F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"))
    hexadecimal = F.when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), "0123456789abcdef").when((kind == "secret") & canon.rlike("^[0-9A-F]+$"), "0123456789ABCDEF")
    country = F.when(kind == "phone", F.regexp_extract(canon, COUNTRY, 0)).otherwise("")
    body = (
        F.when(kind == "card", F.substring(canon, F.lit(2), F.length(canon) - 2))
        .when(kind == "phone", F.substring(canon, F.length(country) + 2, F.length(canon)))
        .when(kind == "secret", F.concat(canon, F.repeat(F.lit("na"), growth)))
        .otherwise(F.concat(F.repeat(F.lit("na"), growth), canon))
    )
    lead = F.when(kind == "card", F.substring(canon, F.lit(1), F.lit(1))).when(kind == "phone", F.substring(canon, F.length(country) + 1, F.lit(1))).otherwise("")
    shape = F.struct(lead.alias("lead"), country.alias("c"), body.alias("b"), hexadecimal.alias("t"))
    drawn = _let(shape, lambda x: F.struct(x["lead"].alias("lead"), x["c"].alias("c"), _permuted(x["b"], F.concat_ws("\x1f", seed, x["c"], x["lead"].rlike("[2-9]").cast("string")), x["t"]).alias("r")))

    def shaped(x: Column) -> Column:
        r, lead = x["r"], x["lead"]
        turn = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", seed, F.lit("lead"), x["c"], r), 256), 1, 6), 16, 10).cast("int")
        digit = lead.try_cast("int")
        first = F.when(digit >= 2, (digit - 2 + turn) % 8 + 2).otherwise((digit + turn) % 2).cast("string")
        whole = F.concat(lead, r)
        stem = F.regexp_replace(r, VOWEL_END, "")
        stem = F.when(stem == "", r).otherwise(stem)
        ended = reduce(lambda w, e: w.when(r.rlike(e[0]), F.concat(stem, F.when(kind == "given_f", e[1]).otherwise(e[2]))), ENDINGS, F.when(F.lit(False), r)).otherwise(r)
        return (
            F.when(kind == "card", F.concat(whole, _check_digit(whole)))
            .when(kind == "phone", F.concat(x["c"], first, r))
            .when(kind == "domain", F.concat_ws(".", F.regexp_replace(r, r"\.[^.]*$", ""), F.substring_index(canon, ".", -1)))
            .when(kind.startswith("given_"), ended)
            .otherwise(r)
        )

    return F.when(kind.isNull(), canon).when(kind == "ip", _address(canon, seed)).otherwise(_let(drawn, shaped))


def _space(kind: Column, canon: Column) -> tuple[Column, Column]:
    """Shape of a number, and how many numbers have it; null for other kinds."""
    country = F.regexp_extract(canon, COUNTRY, 0)
    n = F.length(canon) - F.length(country)
    low = F.substring(canon, F.length(country) + 1, F.lit(1)) < "2"
    octets = F.split(canon, r"\.")
    outer = octets[0].try_cast("int").between(1, 223), F.try_element_at(octets, F.lit(4)).try_cast("int").between(1, 254)
    shape = (
        F.when(kind == "phone", F.concat_ws(" ", country, n.cast("string"), low.cast("string")))
        .when(kind == "card", F.concat_ws(" ", F.substring(canon, F.lit(1), F.lit(1)), F.length(canon).cast("string")))
        .when(kind == "ip", F.concat_ws(" ", *(o.cast("string") for o in outer)))
        .when(kind == "ssn", "")
    )
    size = (
        F.when(kind == "phone", F.when(low, 2.0).otherwise(8.0) * F.pow(F.lit(10.0), n - 1))
        .when(kind == "card", F.pow(F.lit(10.0), F.length(canon) - 2))
        .when(kind == "ip", 65536.0 * F.when(outer[0], 223).otherwise(1) * F.when(outer[1], 254).otherwise(1))
        .when(kind == "ssn", 1e9)
    )
    return shape, size


def _shown(kind: Column, shown: Column, surrogate: Column) -> Column:
    """A surrogate in the case or with the separators of what it stands for."""
    digits = F.regexp_replace(surrogate, COUNTRY, "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct((a["i"] + 1).alias("i"), F.concat(a["o"], F.substring(digits, a["i"], F.lit(1))).alias("o"))).otherwise(F.struct(a["i"].alias("i"), F.concat(a["o"], c).alias("o")))
    filled = F.aggregate(_chars(shown), F.struct(F.lit(1).alias("i"), F.lit("").alias("o")), step)["o"]
    upper = lambda c, i: F.when(F.substring(shown, i + 1, F.lit(1)) != F.lower(F.substring(shown, i + 1, F.lit(1))), F.upper(c)).otherwise(c)
    cased = F.when((F.length(shown) > 1) & (shown == F.upper(shown)) & (shown != F.lower(shown)), F.upper(surrogate)).otherwise(F.array_join(F.transform(_chars(surrogate), upper), ""))
    return F.when(kind.isin("phone", "card", "ssn"), filled).when(kind.isin("secret", "ip") | kind.isNull(), surrogate).otherwise(cased)


def assigned(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, surrogate) of the distinct rows of parts(kind, canon), no two of a kind with
    the same surrogate and none with one that is a canon, but for numbers of a shape that is over a quarter
    full. An empty table gives an empty result."""
    shape, size = _space(F.col("kind"), F.col("canon"))
    real = parts.filter("kind is not null").select("kind", "canon").distinct()
    real = stored(real.select("kind", "canon", shape.alias("shape"), size.alias("size")), "parts")
    full = real.filter("shape is not null").groupBy("kind", "shape").agg(F.count("*").alias("n"), F.first("size").alias("size")).filter("4 * n > size")
    full = full.select("kind", "shape", F.lit(True).alias("full"))
    surrogate = lambda frame, attempt: frame.withColumn("attempt", F.lit(attempt)).withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("canon"), F.lit(attempt)))
    sides = real.join(full, ["kind", "shape"], "left")
    settled = stored(surrogate(sides.filter("full").select("kind", "canon"), 0), "settled")
    left, attempt = sides.filter("full is null").select("kind", "canon"), 0
    while attempt < MOST_ATTEMPTS:
        tried = stored(surrogate(left, attempt), "tried")
        free = tried.join(real.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = stored(free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"), F.first("attempt").alias("attempt")).select("kind", "canon", "attempt", "surrogate"), "settled")
        settled = settled.unionByName(won)
        left = stored(tried.select("kind", "canon").join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "clashes")
        if left.isEmpty():
            return settled
        attempt += 1
    raise RuntimeError(f"no distinct surrogates after {MOST_ATTEMPTS} attempts")


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs(doc_id, text, ...), all columns, with surrogates in the text, and a column `entities`
    (named apart if docs has one): array of (entity, kind, surrogate) of the replaced parts in text order,
    entity being the number of the mention that a part belongs to.

    Texts without an entity, null and empty ones stay as they are, with an empty array. Numbers that only
    look like cards (the check digit fails) stay. Repeated rows and null ids are kept, equal texts getting
    equal results; an empty table gives an empty result. The same key gives the same surrogates for the
    same table; keep it secret, as it stands in the plan. All texts are searched twice, for those with an
    entity and those without; what is written between is the first of these, cut at their entities.
    """
    name = "entities"
    while name in docs.columns:
        name += "_"
    spare = iter(f"_{k}_{'_'.join(docs.columns)}" for k in "abcde")
    c_id, c_hash, c_pieces, c_gaps, c_mentions = (next(spare) for _ in range(5))
    has = _any_entity(F.col("text"))
    mentions, gaps = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)), F.split("text", ENTITY, -1)
    others = [c for c in docs.columns if c != "text"]
    hits = stored(docs.filter(has).select(*others, F.col("doc_id").alias(c_id), F.xxhash64("text").alias(c_hash), mentions.alias(c_mentions), gaps.alias(c_gaps)), "mentions")
    found = hits.groupBy(F.col(c_id).alias("doc_id"), F.col(c_hash).alias("h")).agg(F.first(c_mentions).alias("m"))
    each = found.select("doc_id", "h", F.posexplode("m").alias("pos", "mention")).withColumn("k", _kind(F.col("mention")))
    each = each.select("doc_id", "h", "pos", F.posexplode(_parts(F.col("mention"), F.col("k"))).alias("sub", "p")).select("doc_id", "h", "pos", "sub", "p.*")
    again = stored(assigned(each, key).filter("attempt > 0").select("kind", "canon", "attempt"), "again")
    salts = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salts, ["kind", "canon", "salt"], "left")
    each = each.withColumn("s", _surrogate(key, F.col("kind"), F.col("canon"), F.coalesce("attempt", F.lit(0))))
    piece = F.concat("lead", _shown(F.col("kind"), F.col("shown"), F.col("s")), "trail")
    pieces = each.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("pos", "sub", piece.alias("piece"), "kind", "s"))).alias("pieces"))
    pieces = pieces.select(F.col("doc_id").alias(f"{c_id}r"), F.col("h").alias(f"{c_hash}r"), F.col("pieces").alias(c_pieces))
    woven = lambda p: F.concat(F.when(p["sub"] == 0, F.element_at(c_gaps, p["pos"] + 1)).otherwise(""), p["piece"])
    text = F.concat(F.array_join(F.transform(c_pieces, woven), ""), F.element_at(c_gaps, -1))
    real = lambda p: p["kind"].isNotNull()
    listed = F.transform(F.filter(c_pieces, real), lambda p: F.struct(p["pos"].alias("entity"), p["kind"].alias("kind"), p["s"].alias("surrogate")))
    hit = hits.join(pieces, hits[c_id].eqNullSafe(pieces[f"{c_id}r"]) & (hits[c_hash] == pieces[f"{c_hash}r"]))
    hit = hit.withColumns({"text": text, name: listed}).select(*docs.columns, name)
    rest = docs.filter(~has).withColumn(name, F.array().cast("array<struct<entity:int,kind:string,surrogate:string>>"))
    return hit.unionByName(rest)
