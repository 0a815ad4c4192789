"""PII surrogates: keyed, type-consistent replacements for detected entities.

Everything is DataFrame expressions. A surrogate is a function of a secret key,
the type and the entity, not of the mention: all mentions of an entity get the
same one, in the format of each mention. Two entities never share a surrogate
and no surrogate is an entity of the data: the distinct entities are checked
against each other, and those that collide try their next hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspan.llm.common import stored

# Titles, by gender, and the patterns of the entity types.
MALE = ("Mr", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Госпожа", "Κυρία")
TITLES = "|".join(MALE + FEMALE)
PATTERNS: dict[str, str] = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": "(?<![0-9A-Za-z.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\\.[0-9])",
    "phone": (
        "(?<![0-9A-Za-z])(?:\\+[0-9]{1,3}[ -]?)?(?:\\([0-9]{2,4}\\) ?|[0-9]{2,4}[ -])"
        "[0-9]{3,4}[ -][0-9]{3,4}(?![0-9A-Za-z]|-[0-9])"
    ),
    "card": "(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "ssn": "(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "iban": "(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": f"(?<!\\p{{L}})(?:{TITLES})\\.? \\p{{Lu}}\\p{{L}}+(?: \\p{{Lu}}\\p{{L}}+)?",
}
# No entity begins behind a letter or digit, which most places are.
ANY = "(?<![0-9A-Za-z])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
# Syllables and endings of names, by script.
NAMES: dict[str, tuple[str, tuple[str, ...], str, str]] = {
    "cyrillic": ("\\p{IsCyrillic}", ("ба", "ве", "ги", "до", "ку", "ли", "ма", "но", "ри", "се", "та", "ве"), "н", "на"),
    "greek": ("\\p{IsGreek}", ("βα", "γε", "δι", "κο", "λυ", "μα", "νε", "πι", "ρο", "σα", "τε", "φι"), "ος", "α"),
    "latin": (".", ("ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru", "sa", "ti"), "n", "na"),
}
# After so many hashes the format gives way to distinctness.
PATIENCE = 8

_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _spans(text: Column) -> Column:
    """(start, size, value) of every entity, leftmost first, in code points."""
    values = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    gaps = F.slice(F.split(text, ANY, -1), F.lit(1), F.greatest(F.size(values), F.lit(0)))
    pairs = F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    kind = "array<struct<start:int,value:string>>"
    walked = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda acc, p: F.struct(
            (acc.at + p.gap + F.length(p.value)).alias("at"),
            F.concat(acc.out, F.array(F.struct((acc.at + p.gap).alias("start"), p.value.alias("value")))).alias("out"),
        ),
    )
    # Without a digit, an at sign or a title there is nothing to look for.
    possible = text.rlike("[0-9@]")
    for title in MALE + FEMALE:
        possible = possible | text.contains(title)
    return F.when(possible, walked.out).otherwise(F.array().cast(kind))


def type_of(value: Column) -> Column:
    """The first type whose pattern the whole value has."""
    return F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), F.lit(t)) for t, p in PATTERNS.items()], F.lit("name"))


def identity(kind: Column, value: Column) -> Column:
    """What makes two mentions the same entity: digits of numbers, the rest in lower case."""
    numbers = kind.isin("phone", "card", "ssn")
    title = F.regexp_extract(value, f"^(?:{TITLES})\\.? ", 0)
    name = F.lower(F.substr(value, F.length(title) + 1))
    return (
        F.when(numbers, F.regexp_replace(value, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "name", F.concat(_gender(value), F.lit(":"), name))
        .otherwise(F.lower(value))
    )


def _gender(value: Column) -> Column:
    return F.when(value.rlike(f"^(?:{'|'.join(FEMALE)})\\.? "), F.lit("f")).otherwise(F.lit("m"))


def _stream(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """Hex digits, two for each character of the entity and a few more."""
    blocks = F.sequence(F.lit(0), F.floor(F.length(entity) / 24).cast("int") + 1)
    return F.array_join(
        F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, entity, attempt, b), 256)), ""
    )


def _characters(text: Column) -> Column:
    return F.transform(
        F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(text, i, F.lit(1)),
    )


def _number(stream: Column, i: Column) -> Column:
    """The i-th number, 0 to 65535, of a stream."""
    return F.conv(F.substring(stream, (i * 2 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _like(chars: Column, stream: Column) -> Column:
    """Digits for digits and letters for letters, in the same case; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i)
        letter = F.substring(F.lit(_LOWER), n % 26 + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike("[a-z]"), letter)
            .when(c.rlike("[A-Z]"), F.upper(letter))
            .otherwise(c)
        )

    return F.array_join(F.transform(_characters(chars), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's check over a string of digits, its last digit counted once."""
    reverse = _characters(F.reverse(digits))
    counted = F.transform(
        reverse,
        lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(
            c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(counted, F.lit(0), lambda a, x: a + x)


def _name(entity: Column, stream: Column, attempt: Column, script: str) -> Column:
    """As many words as the entity has, made of a script's syllables and its gender's ending."""
    _, syllables, male, female = NAMES[script]
    parts = F.array(*[F.lit(x) for x in syllables])
    ending = F.when(entity.startswith("f:"), female).otherwise(male)
    last = F.floor(attempt / PATIENCE).cast("int") + 2

    def word(i: Column) -> Column:
        middle = F.transform(
            F.sequence(F.lit(0), last),
            lambda j: F.element_at(parts, _number(stream, i * 8 + j * 2) % len(syllables) + 1),
        )
        return F.initcap(F.concat(F.array_join(middle, ""), ending))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(F.split(entity, " ")) - 1), word), " ")


def surrogate(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """The replacement of an entity: of the same type, length and make-up.

    Cards keep their first digit and whether Luhn's check holds, phones their
    first digit, addresses the digits of each part, e-mails their
    punctuation and top-level domain (equal domains stay equal), names their
    gender and script.
    """
    s = _stream(key, kind, entity, attempt)
    first = F.substring(entity, 1, 1)
    digits = F.concat(first, F.substr(_like(entity, s), F.lit(2)))
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.when(_luhn(entity) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(digits)

    def octet(part: Column, i: Column) -> Column:
        n, size = _number(s, i * 2), F.when(attempt < PATIENCE, F.length(part)).otherwise(0)
        return (
            F.when(size == 1, n % 9 + 1).when(size == 2, n % 90 + 10).when(size == 3, n % 155 + 100).otherwise(n % 254 + 1)
        ).cast("string")

    ip = F.array_join(F.transform(F.split(entity, "\\."), octet), ".")
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.regexp_extract(domain, "\\.[a-z0-9-]+$", 0)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    zero = F.lit(0)
    email = F.concat(
        _like(local, s),
        F.when(attempt >= PATIENCE, F.substring(s, 1, 8)).otherwise(F.lit("")),
        F.lit("@"),
        _like(host, _stream(key, F.lit("domain"), host, zero)),
        top,
    )
    name = F.lit(None)
    for script in reversed(NAMES):
        name = F.when(entity.rlike(NAMES[script][0]), _name(entity, s, attempt, script)).otherwise(name)
    return (
        F.when(kind == "card", card)
        .when(kind == "ip", ip)
        .when(kind == "email", email)
        .when(kind == "name", name)
        .when(kind == "iban", F.concat(F.substring(entity, 1, 2), F.substr(_like(entity, s), F.lit(3))))
        .otherwise(digits)
    )


def formatted(kind: Column, value: Column, replacement: Column) -> Column:
    """A replacement in the format of one mention of its entity."""
    numbers = kind.isin("phone", "card", "ssn", "iban")
    chars = _characters(value)
    counted = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("n"), F.lit("").alias("out")),
        lambda acc, c: F.when(
            c.rlike("[0-9A-Z]"),
            F.struct((acc.n + 1).alias("n"), F.concat(acc.out, F.substring(replacement, acc.n + 1, F.lit(1))).alias("out")),
        ).otherwise(F.struct(acc.n.alias("n"), F.concat(acc.out, c).alias("out"))),
    ).out
    title = F.regexp_extract(value, f"^(?:{TITLES})\\.? ", 0)
    bare = F.substr(value, F.length(title) + 1)
    name = F.concat(title, F.when(bare == F.upper(bare), F.upper(replacement)).otherwise(replacement))
    email = F.when(value == F.upper(value), F.upper(replacement)).otherwise(replacement)
    return F.when(numbers, counted).when(kind == "name", name).when(kind == "email", email).otherwise(replacement)


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, attempt) of the entities that may not take their first hash.

    ``entities`` (kind, entity) are distinct. Of those that would share a
    surrogate the smallest keeps it; whoever would take the name of an entity of
    the data moves on. Only those who moved are looked at again, against all
    surrogates that are settled.
    """
    given = F.col("given")

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumn("given", surrogate(key, F.col("kind"), F.col("entity"), F.col("attempt")))

    trying = named(entities.withColumn("attempt", F.lit(0)))
    settled: DataFrame | None = None
    moved: DataFrame | None = None
    while True:
        first = trying.groupBy("kind", "given").agg(F.min("entity").alias("__owner"))
        real = entities.select("kind", F.col("entity").alias("given"), F.lit(True).alias("__real"))
        checked = trying.join(first, ["kind", "given"]).join(real, ["kind", "given"], "left")
        if settled is not None:
            taken = settled.select("kind", "given").distinct().withColumn("__taken", F.lit(True))
            checked = checked.join(taken, ["kind", "given"], "left")
        else:
            checked = checked.withColumn("__taken", F.lit(None).cast("boolean"))
        fine = (F.col("entity") == F.col("__owner")) & F.col("__real").isNull() & F.col("__taken").isNull()
        checked = stored(checked.select("kind", "entity", "attempt", given, fine.alias("fine")), "pii-names")
        done = checked.where("fine").drop("fine")
        settled = done if settled is None else settled.unionByName(done)
        late = done.where("attempt > 0").select("kind", "entity", "attempt")
        moved = late if moved is None else moved.unionByName(late)
        again = checked.where("NOT fine")
        if again.isEmpty():
            return moved
        trying = named(again.select("kind", "entity", (F.col("attempt") + 1).alias("attempt")))


def with_surrogates(docs: DataFrame, keep: list[Column], text: Column, key: str = "topicspan") -> DataFrame:
    """``keep`` columns with ``__text``, the text with surrogates, and ``entities``.

    ``entities`` lists (start, end, kind) of what was found in the input, in code
    points, end exclusive. Null texts stay null and have none. Rows are neither
    lost nor merged; equal texts give equal results. Nothing but the entities
    changes. ``key`` is the secret of the deployment.
    """
    rows = docs.select(*keep, text.alias("__text")).withColumn("__found", _spans(F.coalesce("__text", F.lit(""))))
    mention = F.transform(
        "__found",
        lambda m: F.struct(
            m.start.alias("start"),
            (m.start + F.length(m.value)).alias("end"),
            type_of(m.value).alias("kind"),
            m.value.alias("value"),
        ),
    )
    mentions = F.transform(
        mention,
        lambda m: F.struct(m.start, m.end, m.kind, m.value, identity(m.kind, m.value).alias("entity")),
    )
    detected = rows.withColumn("__m", mentions).drop("__found")
    of_text = F.sha2("__text", 256)
    listed = stored(
        detected.where(F.size("__m") > 0)
        .select(of_text.alias("__digest"), F.explode(F.array_distinct(F.transform("__m", lambda m: F.struct(m.kind, m.entity)))).alias("e"))
        .select("__digest", "e.kind", "e.entity")
        .distinct(),
        "pii-mentions",
    )
    entities = stored(listed.select("kind", "entity").distinct(), "pii-entities")
    moved = stored(attempts(entities, key), "pii-moved")
    # Texts that hold an entity whose first hash was taken, with its number of attempts.
    label = F.concat_ws("|", "kind", "entity")
    late = stored(
        listed.join(moved, ["kind", "entity"])
        .groupBy("__digest")
        .agg(F.map_from_entries(F.collect_list(F.struct(label.alias("k"), F.col("attempt")))).alias("__late")),
        "pii-late",
    )
    known = detected.withColumn("__key", of_text).join(late, F.col("__key") == F.col("__digest"), "left")
    replaced = F.transform(
        "__m",
        lambda m: F.struct(
            m.start.alias("start"),
            m.end.alias("end"),
            formatted(
                m.kind,
                m.value,
                surrogate(
                    key,
                    m.kind,
                    m.entity,
                    F.coalesce(F.element_at("__late", F.concat_ws("|", m.kind, m.entity)), F.lit(0)),
                ),
            ).alias("given"),
        ),
    )
    t = F.col("__text")
    walked = F.aggregate(
        "__r",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, r: F.struct(
            r.end.alias("at"), F.concat(acc.out, F.substring(t, acc.at + 1, r.start - acc.at), r.given).alias("out")
        ),
    )
    names = [c for c in rows.columns if c not in ("__text", "__found")]
    return (
        known.withColumn("__r", replaced)
        .withColumn("__w", walked)
        .select(
            *names,
            F.when(F.size("__m") > 0, F.concat("__w.out", F.substr(t, F.col("__w.at") + 1))).otherwise(t).alias("__text"),
            F.transform("__m", lambda m: F.struct(m.start, m.end, m.kind)).alias("entities"),
        )
    )
