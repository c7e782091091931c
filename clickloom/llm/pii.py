"""Personal data replaced by keyed surrogates of the same type, format and distinctness."""

from __future__ import annotations

import secrets

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import few_rows, stored, table

#: Rounds in which colliding surrogates are drawn anew.
MAX_ROUNDS = 40
#: Rounds after which a surrogate may be longer than what it stands for.
SAME_LENGTH_ROUNDS = 4

# Lengths are bounded as addresses are, so that no long run of letters is read again
# and again.
_LABEL = r"[\p{L}\d](?:[\p{L}\d-]{0,61}[\p{L}\d])?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Titles before names, by the gender they tell.
TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Señora|Madame",
    "m": "Mr|Herr|Señor|Monsieur",
    "n": "Mx|Dr|Prof",
}
# Calling codes of one and two digits; all others have three.
CODES_1 = ["1", "7"]
CODES_2 = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 "
    "60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
).split()
_TITLE = {k: f"{t}|{t.upper()}" for k, t in TITLES.items()}
#: A name, without the `'s` of a possessive.
_NAME = r"\p{Lu}(?:\p{L}|[-'’](?!s(?!\p{L}))(?=\p{L}))+"
_ANY_TITLE = "|".join(_TITLE.values())

#: Kinds in the order in which they are tried at a place of the text.
PATTERNS = {
    "email": rf"(?<![\p{{L}}\d])[\p{{L}}\d][\p{{L}}\d._%+-]{{0,63}}+@{_LABEL}(?:\.{_LABEL}){{0,8}}\.\p{{L}}{{2,24}}(?![\p{{L}}\d])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){3,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"
    r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}(?: \d{4}){3}(?: \d{1,3})?|\d{4}(?:-\d{4}){3}(?:-\d{1,3})?"
    r"|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\d])",
    "person": rf"(?<![\p{{L}}\d])(?:{_ANY_TITLE})\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap sign that some pattern may match: a digit, an at-sign or a title.
SIGN = rf"[@\d]|(?:{_ANY_TITLE})\.? "

# Syllables of names, by script.
SYLLABLES = {
    "latin": "ba be do fa ga ha jo ka le li ma mi na ne no pa ra ri ro sa se ta te to va vi wa za".split(),
    "cyrillic": "ба бе ва ве га да ди ка ле ли ма ми на не но па ра ри ро са се та те то фа".split(),
    "greek": "βα γε δα δι θε κα κο λα λε λι μα μι να νε νο πα ρα ρι ρο σα σε τα τε το".split(),
}
ENDINGS = {
    "latin": {"f": "lina", "m": "ldo", "n": "ren", "s": "nsted"},
    "cyrillic": {"f": "лина", "m": "слав", "n": "рен", "s": "нов"},
    "greek": {"f": "λινα", "m": "νος", "n": "ρις", "s": "δης"},
}


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def kind_of(found: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(found.rlike(_whole(pattern)), kind).otherwise(out)
    return out


def _script(name: Column) -> Column:
    return (
        F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic")
        .when(name.rlike(r"\p{IsGreek}"), "greek")
        .otherwise("latin")
    )


def entities(found: Column) -> Column:
    """What a mention names: array of (kind, norm, gender); kind and norm are equal for all
    mentions of one thing.

    A person has a surname and, if two names stand there, a given name before it, with
    the gender that the title tells (n if it tells none); both kinds tell the script.
    Groups of digits, and runs of other lengths than 16, are no card number but years,
    times and the like if they fail the Luhn check.
    """
    kind = kind_of(found)
    no_gender = F.lit(None).cast("string").alias("gender")
    one = lambda norm: F.array(F.struct(kind.alias("kind"), norm.alias("norm"), no_gender))
    names = F.filter(F.split(found, " "), lambda w: w != "")
    given, surname = F.get(names, F.lit(1)), F.get(names, F.lit(2))
    gender = F.when(found.rlike(rf"^(?:{_TITLE['f']})\.? "), "f")
    gender = gender.when(found.rlike(rf"^(?:{_TITLE['m']})\.? "), "m").otherwise("n")
    part = lambda sort, name, told: F.struct(
        F.concat_ws("_", F.lit("name"), F.lit(sort), _script(name)).alias("kind"),
        F.lower(name).alias("norm"),
        told.cast("string").alias("gender"),
    )
    none = F.array().cast("array<struct<kind:string,norm:string,gender:string>>")
    loose = ~found.rlike(r"^\d{16}$") & ~F.call_function(
        "luhn_check", F.regexp_replace(found, r"\D", "")
    )
    return (
        F.when((kind == "card") & loose, none)
        .when(kind.isin("email"), one(F.lower(found)))
        .when(kind.isin("ip"), one(found))
        .when(kind == "phone", one(F.regexp_replace(found, r"[^+\d]", "")))
        .when(kind.isin("iban", "ssn", "card"), one(F.regexp_replace(found, r"[^A-Z\d]", "")))
        .when((kind == "person") & surname.isNull(), F.array(part("s", given, F.lit(None))))
        .when(kind == "person", F.array(part("g", given, gender), part("s", surname, F.lit(None))))
        .otherwise(none)
    )


def _byte(digest: Column, i: Column) -> Column:
    """Byte i (from 0, around again at the end) of a digest of 64 bytes in hexadecimal."""
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(norm: Column, digest: Column, from_place: Column) -> Column:
    """Letters for letters and digits for digits, from a place (0 first) on."""
    chars = F.transform(
        F.split(norm, ""),
        lambda c, i: F.when(i < from_place, c)
        .when(c.rlike(r"\d"), F.chr(48 + _byte(digest, i) % 10))
        .when(c.rlike(r"\p{Lu}"), F.chr(65 + _byte(digest, i) % 26))
        .when(c.rlike(r"\p{L}"), F.chr(97 + _byte(digest, i) % 26))
        .otherwise(c),
    )
    return F.array_join(chars, "")


def _with_check_digit(norm: Column, shaped: Column) -> Column:
    """The card number with a last digit that passes the Luhn check if the original does."""
    head = F.expr("left(shaped, char_length(shaped) - 1)")
    fitting = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(head, d.cast("string"))),
        lambda s: F.call_function("luhn_check", s) == F.call_function("luhn_check", norm),
    )
    return F.get(fitting, _byte(F.col("digest"), F.lit(40)) % F.greatest(F.size(fitting), F.lit(1)))


def _name(kind: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """A made-up name of the kind's script, a given name's ending by the gender."""
    told = F.when(kind.startswith("name_s_"), "s").otherwise(F.coalesce(gender, F.lit("n")))
    out = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        parts = F.array(*[F.lit(s) for s in syllables])
        drawn = _drawn(parts, len(syllables), digest, attempt)
        for sort, ending in ENDINGS[script].items():
            name = F.initcap(F.concat(F.array_join(drawn, ""), F.lit(ending)))
            out = F.when(kind.endswith(f"_{script}") & (told == sort), name).otherwise(out)
    return out


def _drawn(parts: Column, n: int, digest: Column, attempt: Column) -> Column:
    """Syllables of a name: three, and one more for each later attempt."""
    return F.transform(
        F.sequence(F.lit(0), attempt + 2), lambda i: F.get(parts, _byte(digest, i) % n)
    )


def _drafts(things: DataFrame, keys: DataFrame) -> DataFrame:
    """A surrogate for each (kind, norm, attempt), by its kind's key."""
    digest = F.sha2(F.concat_ws("\0", "key", "kind", "norm", F.col("attempt").cast("string")).cast("binary"), 512)
    norm, kind, drawn, attempt = F.col("norm"), F.col("kind"), F.col("digest"), F.col("attempt")
    abroad = (
        F.when(F.substring(norm, 2, 1).isin(CODES_1), 2)
        .when(F.substring(norm, 2, 2).isin(CODES_2), 3)
        .otherwise(4)
    )
    code = F.when(kind == "iban", 2).when((kind == "phone") & norm.startswith("+"), abroad)
    longer = F.when(
        attempt >= SAME_LENGTH_ROUNDS,
        F.substring(drawn, F.lit(1), attempt),
    ).otherwise("")
    local = _shaped(F.expr("left(norm, instr(norm, '@') - 1)"), drawn, F.lit(0))
    site = F.regexp_extract(norm, r"@(.*)\.[^.]*$", 1)
    email = F.concat(
        local, longer, F.lit("@"), _shaped(site, F.reverse(drawn), F.lit(0)), F.regexp_extract(norm, r"\.[^.]*$", 0)
    )
    private = norm.rlike(r"^(10|127|192\.168|172\.(1[6-9]|2\d|3[01]))\.")
    first = F.when(private, F.lit(10)).otherwise(11 + _byte(drawn, F.lit(0)) % 89)
    octets = [first, *[_byte(drawn, F.lit(k)) for k in (1, 2)], 1 + _byte(drawn, F.lit(3)) % 254]
    ip = F.concat_ws(".", *[o.cast("string") for o in octets])
    surrogate = (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", _with_check_digit(norm, F.col("shaped")))
        .when(kind.startswith("name_"), _name(kind, F.col("gender"), drawn, attempt))
        .otherwise(F.col("shaped"))
    )
    return (
        things.join(F.broadcast(keys), "kind")  # one row per kind
        .withColumn("digest", digest)
        .withColumn("shaped", _shaped(norm, drawn, F.coalesce(code, F.lit(0))))
        .select("kind", "norm", "attempt", surrogate.alias("surrogate"))
    )


def _kinds() -> list[str]:
    names = [f"name_{part}_{s}" for s in SYLLABLES for part in ("g", "s")]
    return [k for k in PATTERNS if k != "person"] + names


def registry(things: DataFrame, key: str) -> DataFrame:
    """kind, norm and surrogate of each distinct thing (kind, norm, and gender if there is one).

    A given name with several genders has the first of f, m and n. A surrogate is drawn by a keyed hash. It may neither be a thing of the corpus nor
    the surrogate of another thing of its kind: of things with one surrogate the
    smallest keeps it, the others are drawn again, until none collide. After MAX_ROUNDS
    rounds it is an error: some kind has no room for that many surrogates.
    """
    spark = things.sparkSession
    keys = few_rows(
        spark,
        [(k, f"{key}/{k}") for k in _kinds()],
        pa.schema([("kind", pa.string()), ("key", pa.string())]),
    )
    gender = F.col("gender") if "gender" in things.columns else F.lit(None).cast("string")
    real = stored(things.groupBy("kind", "norm").agg(F.min(gender).alias("gender")), "things")
    taken = real.select("kind", F.lower("norm").alias("surrogate"))
    pending = real.withColumn("attempt", F.lit(0))
    settled: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        drafts = _drafts(pending, keys)
        free = drafts.withColumn("form", F.lower("surrogate")).join(
            taken.withColumnRenamed("surrogate", "form"), ["kind", "form"], "left_anti"
        )
        first = free.groupBy("kind", "form").agg(F.min_by("surrogate", "norm").alias("surrogate"), F.min("norm").alias("norm"))
        good = stored(first.select("kind", "norm", "surrogate"), "surrogates")
        settled.append(good)
        pending = stored(
            pending.join(good, ["kind", "norm"], "left_anti").withColumn("attempt", F.col("attempt") + 1),
            "pending",
        )
        if pending.isEmpty():
            break
        taken = taken.union(good.select("kind", F.lower("surrogate").alias("surrogate")))
    else:
        raise RuntimeError("surrogates of some kind have run out")
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def _woven(found: Column, surrogate: Column) -> Column:
    """A mention's signs between letters and digits, with the surrogate's letters and digits."""
    return F.aggregate(
        F.split(found, ""),
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda acc, c: F.when(
            c.rlike(r"[A-Z\d]"),
            F.struct(
                (acc["at"] + 1).alias("at"),
                F.concat(acc["out"], F.substring(surrogate, acc["at"], F.lit(1))).alias("out"),
            ),
        ).otherwise(F.struct(acc["at"].alias("at"), F.concat(acc["out"], c).alias("out"))),
        lambda acc: acc["out"],
    )


def _cased(like: Column, surrogate: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.lower(like) != like), F.upper(surrogate)).otherwise(surrogate)


def _replaced(found: Column, known: Column) -> Column:
    """A mention rewritten with the surrogates of a map from `kind:norm`."""
    own = entities(found)
    look = lambda i: F.element_at(
        known, F.concat_ws(":", F.get(own, F.lit(i))["kind"], F.get(own, F.lit(i))["norm"])
    )
    kind = kind_of(found)
    words = F.filter(F.split(found, " "), lambda w: w != "")
    name = F.concat_ws(
        " ",
        F.get(words, F.lit(0)),
        _cased(F.get(words, F.lit(1)), look(0)),
        F.when(F.size(own) > 1, _cased(F.get(words, F.lit(2)), look(1))),
    )
    made = (
        F.when(kind == "email", _cased(found, look(0)))
        .when(kind == "ip", look(0))
        .when(kind == "person", name)
        .otherwise(_woven(found, F.ltrim(look(0), F.lit("+"))))
    )
    return F.coalesce(made, found)


def _names_again(known: Column) -> Column:
    """A pattern for the names of a map where they stand without a title; null without names."""
    names = F.filter(F.map_keys(known), lambda k: k.startswith("name_"))
    norms = F.transform(names, lambda k: F.regexp_replace(k, "^[^:]*:", ""))
    # Longer names first, so that none is cut by one that it begins with.
    longest = F.transform(F.sort_array(F.transform(norms, lambda n: F.struct(-F.length(n), n.alias("n")))), lambda x: x["n"])
    return F.when(
        F.size(names) > 0,
        F.concat(
            F.lit(r"(?<![\p{L}\d@._%+-])(?=\p{Lu})(?iu:"),
            F.array_join(F.array_distinct(longest), "|"),
            F.lit(r")(?![\p{L}\d@])(?![-'’](?!s(?!\p{L}))\p{L})"),
        ),
    )


def _renamed(gap: Column, pattern: Column, known: Column) -> Column:
    """A text between mentions with the names of a map replaced, each by its surrogate."""

    def again(word: Column) -> Column:
        look = lambda part: F.element_at(
            known, F.concat(F.lit(f"name_{part}_"), _script(word), F.lit(":"), F.lower(word))
        )
        return F.coalesce(_cased(word, F.coalesce(look("s"), look("g"))), word, F.lit(""))

    spoken = F.zip_with(
        F.split(gap, pattern, -1),
        F.regexp_extract_all(gap, pattern, F.lit(0)),
        lambda between, word: F.concat(F.coalesce(between, F.lit("")), again(word)),
    )
    return F.when(pattern.isNull() | ~gap.rlike(r"\p{Lu}"), gap).otherwise(F.array_join(spoken, ""))


def _mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def replace_personal(docs: DataFrame, key: str) -> DataFrame:
    """The documents with personal data replaced in `text`, and a column n_entities.

    Mentions of one thing get one surrogate in all documents, different things get
    different ones, none of them a thing of the corpus. A person is found by a title; the
    names found are replaced in the same document where they stand without one, too,
    with a capital letter. E-mail addresses keep their
    shape and last label, numbers their signs (phones the country code, cards whether
    they pass the Luhn check), addresses whether they are private, names script,
    gender and case. The key is in a table, not in the plan. DataFrame functions only.

    Only documents with a mention are shuffled, by a hash of the row; a mention that
    very many documents share is one row of the registry and a key that Spark splits
    where it is large. Null and empty texts stay; repeated rows get the same result;
    a null doc_id is a value like others; other columns stay as they are, but for
    `n_entities`, which is replaced; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*others)
    text = F.col("text")
    has = F.coalesce(text.rlike(SIGN), F.lit(False)) & F.coalesce(text.rlike(ANY), F.lit(False))
    row = F.xxhash64(F.col("doc_id"), text)
    hit = stored(
        docs.where(has).select(row.alias("row"), F.explode(_mentions(text)).alias("found"))
        .select("row", F.explode(entities(F.col("found"))).alias("e"))
        .groupBy("row", "e.kind", "e.norm")
        .agg(F.min("e.gender").alias("gender")),
        "mentions",
    )
    known = registry(hit, key)
    maps = (
        hit.drop("gender")
        .join(known, ["kind", "norm"])
        .groupBy("row")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct(F.concat_ws(":", "kind", "norm"), F.col("surrogate")))
            ).alias("known_map")
        )
        .withColumnRenamed("row", "known_row")
        .withColumn("known_names", _names_again(F.col("known_map")))
    )
    inner = [F.col(f"d.{c}") for c in others]
    marked = docs.where(has).select(F.struct(*others).alias("d"), row.alias("known_row"))
    joined = marked.join(maps, "known_row", "left")
    body = F.col("d.text")
    spoken = F.zip_with(
        F.split(body, ANY, -1),
        _mentions(body),
        lambda gap, found: F.concat(
            F.coalesce(_renamed(gap, F.col("known_names"), F.col("known_map")), F.lit("")),
            F.coalesce(_replaced(found, F.col("known_map")), F.lit("")),
        ),
    )
    replaced = F.when(F.col("known_map").isNull(), body).otherwise(F.array_join(spoken, ""))
    changed = joined.select(
        *[replaced.alias("text") if c == "text" else x.alias(c) for c, x in zip(others, inner, strict=True)],
        F.size(F.filter(_mentions(body), lambda m: F.size(entities(m)) > 0))
        .cast("long")
        .alias("n_entities"),
    )
    return changed.union(docs.where(~has).withColumn("n_entities", F.lit(0).cast("long")))


#: Key of the registered query, whose result is to be the same each time. Not for real data.
QUERY_KEY = "clickloom"
#: Session setting that holds a secret key.
KEY_SETTING = "clickloom.personalDataKey"


def session_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING; without one a fresh key that is forgotten, so that
    surrogates cannot be told apart from others, nor be the same in another run."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_personal(docs, QUERY_KEY).select("doc_id", "n_entities", "text")
