"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import discard, join_skewed, staged

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme|г-жа|г-н|Госпожа|Господин)"
#: Java patterns by type, in order of precedence where two could start at one place. Groups repeat a bounded
#: number of times (a host has at most 127 labels), as Java's matcher goes one call deeper each time.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,126}\.\p{L}{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])|(?<=(?:token|secret|password|api_key) ?[=:] ?\"?)[0-9A-Za-z_+/-]{12,}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)",
    "name": rf"(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What any match contains; most texts have none of it and skip the long pattern.
TRIGGER = rf"@|\d{{2}}|\d\.\d|AKIA[0-9A-Z]{{16}}|gh[pousr]_[0-9A-Za-z]{{20}}|sk-[0-9A-Za-z]{{20}}|[0-9A-Fa-f]{{32}}|(?:token|secret|password|api_key) ?[=:]|{_TITLE}\.? \p{{Lu}}"

#: Titles of women (others but the neutral ones are of men), and syllables names are made of.
_WOMEN = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа", "Госпожа")
_LATIN_STARTS = ("Al", "Be", "Co", "Da", "El", "Fa", "Ga", "He", "Is", "Jo", "Ka", "Le", "Ma", "No", "Or", "Pa", "Ro", "Sa", "Te", "Vi")
_LATIN_MIDDLES = ("ban", "dor", "fel", "gar", "lin", "mar", "nes", "ral", "ser", "tin", "van", "wen", "bel", "dri", "lor", "mon")
_LATIN_ENDS = {"f": ("a", "ia", "ina", "elle"), "m": ("o", "us", "ert", "ik"), "s": ("son", "er", "mann", "ez")}
_CYRILLIC_STARTS = ("Ал", "Бо", "Ва", "Га", "Да", "Ев", "Зо", "Ил", "Ки", "Ла", "Ма", "Ни", "Ол", "Па", "Ро", "Са")
_CYRILLIC_MIDDLES = ("бан", "вор", "дел", "гар", "лин", "мар", "нес", "рал", "сер", "тин", "ван", "бел", "дри", "лор", "мон", "зан")
_CYRILLIC_ENDS = {"f": ("а", "ия", "ина", "ела"), "m": ("ий", "ан", "ор", "ик"), "s": ("ов", "ин", "ев", "ский")}
#: Draws in an entity's own layout. Each later one has a digit or syllable more to draw, so that there is room for any number.
NARROW = 4


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


_KNOWN = r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,}|sk-[0-9A-Za-z]{20,}|[0-9a-f]{32,}|[0-9A-F]{32,}"


def entity_type(entity: Column) -> Column:
    """The type of a found entity; what has no form of its own stood behind a word for a secret."""
    out = F.when(entity.rlike(rf"^{_TITLE}\.? \p{{Lu}}"), F.lit("name")).otherwise(F.lit("secret"))
    for kind in ("card", "ssn", "phone", "ip", "iban"):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    out = F.when(entity.rlike(f"^(?:{_KNOWN})$"), F.lit("secret")).otherwise(out)
    return F.when(entity.rlike(f"^(?:{PATTERNS['email']})$"), F.lit("email")).otherwise(out)


def _pick(h: Column, at, n: int) -> Column:
    """A number below n from hash h at hex position `at`."""
    at = at if isinstance(at, Column) else F.lit(at)
    return (F.conv(h.substr(at + F.lit(1), F.lit(4)), 16, 10).cast("int") % F.lit(n)).cast("int")


def _same_shape(text: Column, h: Column, hexa: bool = False) -> Column:
    """text with each digit and letter replaced by another of its kind: digit, case, script. Marks stay."""

    def one(c: Column, i: Column) -> Column:
        at = (i * 3) % 124
        letter = lambda values: F.substring(F.lit(values), _pick(h, at, len(values)) + 1, 1)
        lower = "abcdef" if hexa else "abcdefghijklmnopqrstuvwxyz"
        return (
            F.when(c.rlike("[0-9]"), letter("0123456789"))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), letter("АБВГДЕЖЗИКЛМНОПРСТУФХ")).otherwise(letter("абвгдежзиклмнопрстуфх")))
            .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), letter("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦ")).otherwise(letter("αβγδεζηθικλμνξοπρστυφ")))
            .when(c.rlike(r"\p{Lu}"), letter(lower.upper()))
            .when(c.rlike(r"\p{L}"), letter(lower))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one not doubled."""
    each = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _title(entity: Column) -> Column:
    return F.regexp_extract(entity, rf"^{_TITLE}\.? ", 0)


def _domain(entity: Column) -> tuple[Column, Column, Column]:
    """local part, host and last label of an email."""
    domain = F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    return F.substring_index(entity, "@", 1), F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1), top


def parts_of(kind: Column, entity: Column) -> Column:
    """array of (cls, part): what of an entity gets surrogates of its own, so that they agree between entities.

    Emails have a local part and a host, in lower case; names their words, the last of which is a surname,
    others given names of a gender; "SMITH" is the part of "Smith". Phones and cards are their digits in
    any layout, accounts their characters without spaces. All else is one part."""
    local, host, _ = _domain(entity)
    part = lambda cls, text: F.struct(cls.alias("cls"), text.alias("part"))
    title = _title(entity)
    words = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")
    given = F.when(F.regexp_replace(title, r"[. ]", "").isin(*_WOMEN), F.lit("given_f")).otherwise(F.lit("given_m"))
    usual = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w) - 1)))
    names = F.transform(words, lambda w, i: part(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(given), F.when(w == F.upper(w), usual(w)).otherwise(w)))
    bare = F.when(kind == "phone", F.regexp_replace(entity, r"[^+\d]", "")).when(kind == "card", F.regexp_replace(entity, r"\D", "")).when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(entity)
    return (
        F.when(kind == "email", F.array(part(F.lit("local"), F.lower(local)), part(F.lit("host"), F.lower(host))))
        .when(kind == "name", names).otherwise(F.array(part(kind, bare)))
    )


def draw(cls: Column, part: Column, attempt: Column, h: Column) -> Column:
    """The surrogate of a part at its n-th attempt, from a keyed hash h of all three.

    Letters and digits become others of their kind: case, script, length; phones keep their country code;
    addresses stay valid; cards keep their first digit and whether their Luhn sum holds; secrets and
    accounts keep known prefixes; names keep gender and script.

    Some layouts have few surrogates (one letter before an @, four free digits, marks only). From draw
    NARROW on, each draw is longer by one more digit, or syllable of a name; an address becomes an IPv6 one.
    """
    extra, wide = attempt - F.lit(NARROW - 1), attempt >= NARROW
    digits = F.when(wide, _same_shape(F.repeat(F.lit("0"), extra), F.reverse(h))).otherwise(F.lit(""))
    ipv6 = F.regexp_replace(F.concat(F.lit("fd"), F.substring(h, 1, 30)), "(.{4})(?=.)", "$1:")
    ip = F.array_join(F.transform(F.split(part, r"\."), lambda _, i: (_pick(h, i * 5, 254) + 1).cast("string")), ".")
    ip = F.when(wide, ipv6).otherwise(ip)
    # the part has lost the layout that shows where the country code ends: one digit after the + is kept, as of any country
    country = F.regexp_extract(part, r"^\+\d", 0)
    phone = F.concat(country, _same_shape(F.substring(part, F.length(country) + 1, F.length(part)), h), digits)
    drawn = F.concat(F.substring(part, 1, 1), _same_shape(F.substring(part, F.lit(2), F.length(part) - 2), h), digits)
    due = (10 - _luhn_sum(F.concat(drawn, F.lit("0"))) % 10) % 10
    last = F.when(_luhn_sum(part) % 10 == 0, due).otherwise((due + 1 + _pick(h, 120, 9)) % 10)
    card = F.concat(drawn, last.cast("string"))
    known = F.regexp_extract(part, r"^(?:AKIA|gh[pousr]_|sk-)", 0)
    hexa = part.rlike(r"^[0-9a-f]+$|^[0-9A-F]+$")
    rest = F.substring(part, F.length(known) + 1, F.length(part))
    token = F.concat(known, F.when(hexa, _same_shape(rest, h, True)).otherwise(_same_shape(rest, h)), digits)
    iban = F.concat(F.substring(part, 1, 2), _same_shape(F.substring(part, F.lit(3), F.length(part) - 2), h), digits)

    def made(starts, middles, ends) -> Column:
        end = lambda of: F.element_at(_strings(ends[of]), _pick(h, 16, 4) + 1)
        mid = [F.element_at(_strings(middles), _pick(h, at, len(middles)) + 1) for at in (4, 8)]
        more = F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: F.element_at(_strings(middles), _pick(h, F.lit(20) + i * 4 % 104, len(middles)) + 1))
        mid.append(F.when(wide, F.array_join(more, "")).otherwise(F.lit("")))
        return F.concat(F.element_at(_strings(starts), _pick(h, 0, len(starts)) + 1), *mid, F.when(cls == "surname", end("s")).when(cls == "given_f", end("f")).otherwise(end("m")))

    other = _same_shape(F.concat(part, F.when(wide, F.repeat(F.lower(F.substring(part, 1, 1)), extra)).otherwise(F.lit(""))), h)
    name = F.when(part.rlike(r"\p{IsCyrillic}"), made(_CYRILLIC_STARTS, _CYRILLIC_MIDDLES, _CYRILLIC_ENDS)).when(part.rlike(r"^[\p{IsLatin}'-]+$"), made(_LATIN_STARTS, _LATIN_MIDDLES, _LATIN_ENDS)).otherwise(other)
    return (
        F.when(cls.isin("given_f", "given_m", "surname"), name).when(cls == "ip", ip).when(cls == "phone", phone).when(cls == "card", card)
        .when(cls == "secret", token).when(cls == "iban", iban).otherwise(F.concat(_same_shape(part, h), digits))
    )


#: Classes of parts that make a pool of their own. Parts of different pools stand at different places of an entity.
_POOLS = ("local", "host", "given_f", "given_m", "surname")


def part_surrogates(parts: DataFrame, secret: str) -> DataFrame:
    """(cls, part, held, surrogate) for staged distinct parts (cls, part, held): in a pool, no two share a
    surrogate, and none is itself a part.

    All draw; of those that collide with each other the smallest keeps its draw, and the others, like
    those that hit a part of the corpus, draw again, until no collision is left. As later draws are from
    ever larger spaces, that ends at any number of parts. A part is hashed once a draw, however long.
    """
    parts = parts.select("*", F.when(F.col("cls").isin(*_POOLS), F.col("cls")).otherwise(F.lit("whole")).alias("pool"))
    now, last = parts.select("*", F.lit(0).alias("attempt")), None
    while True:
        h = F.sha2(F.concat_ws("\x1f", F.lit(secret), "cls", "part", F.col("attempt").cast("string")), 512)
        hashed = staged(now.withColumn("h", h))
        drawn = staged(hashed.withColumn("surrogate", draw(F.col("cls"), F.col("part"), F.col("attempt"), F.col("h"))).drop("h"))
        discard(*filter(None, (hashed, last)))
        last, key = drawn, ["cls", "part"]
        shared = drawn.groupBy("pool", "surrogate").agg(F.min(F.struct(*key)).alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = drawn.join(shared, ["pool", "surrogate"]).where(F.struct(*key) != F.col("holder")).select(*key)
        known = drawn.join(parts.select("pool", F.col("part").alias("surrogate")).distinct(), ["pool", "surrogate"], "left_semi").select(*key)
        again = twice.union(known).distinct().withColumn("lost", F.lit(1))
        if again.isEmpty():
            return drawn.select(*key, "held", "surrogate")
        now = drawn.join(again, key, "left").select(*key, "held", "pool", (F.col("attempt") + F.coalesce("lost", F.lit(0))).alias("attempt"))


def _recased(original: Column, new: Column) -> Column:
    """new, with capitals where original has them."""
    cased = F.transform(F.split(new, ""), lambda c, i: F.when(F.substring(original, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c))
    return F.when(original.rlike(r"\p{Lu}"), F.array_join(cased, "")).otherwise(new)


def _laid_out(entity: Column, new: Column, what: str) -> Column:
    """The characters of new, in the layout that entity has around its own characters of the kind `what`; more than those follow."""
    marks, chars = F.split(entity, what, -1), F.split(new, "")
    n = F.size(marks) - 1
    woven = F.array_join(F.zip_with(marks, F.slice(chars, F.lit(1), n), lambda m, c: F.concat(m, F.coalesce(c, F.lit("")))), "")
    return F.concat(woven, F.substring(new, n + 1, F.length(new)))


def assemble(kind: Column, entity: Column, new: Column) -> Column:
    """The surrogate of an entity from those of its parts, an array in order."""
    local, host, top = _domain(entity)
    title = _title(entity)
    words = F.split(F.substring(entity, F.length(title) + 1, F.length(entity)), " ")
    name = F.zip_with(words, new, lambda w, x: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(x)).otherwise(x))
    one = new[0]
    return (
        F.when(kind == "email", F.concat(_recased(local, one), F.lit("@"), _recased(host, F.element_at(new, -1)), F.lit("."), top))
        .when(kind == "name", F.concat(title, F.array_join(name, " ")))
        .when(kind == "phone", _laid_out(entity, one, r"[+\d]")).when(kind == "card", _laid_out(entity, one, r"\d"))
        .when(kind == "iban", _laid_out(entity, one, r"[^ ]")).otherwise(one)
    )


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """(entity, kind, surrogate, held), a row per distinct entity; held counts its rows.

    As the surrogates of parts are distinct and new (see part_surrogates), so are those of entities, and a
    surname, an email's host or its person is the same wherever it stands."""
    one = staged(entities.groupBy("entity").agg(F.count(F.lit(1)).alias("held")).withColumn("kind", entity_type(F.col("entity"))))
    each = staged(one.select("entity", "kind", F.col("held").alias("rows"), F.posexplode(parts_of(F.col("kind"), F.col("entity"))).alias("i", "p")).select("entity", "kind", "rows", "i", "p.*"))
    parts = staged(each.groupBy("cls", "part").agg(F.count(F.lit(1)).alias("held")))
    mapping = part_surrogates(parts, secret)
    met = join_skewed(each, mapping, ["cls", "part"], "held")
    new = met.groupBy("entity", "kind", "rows").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "surrogate"))), lambda x: x["surrogate"]).alias("new"))
    return staged(new.select("entity", "kind", assemble(F.col("kind"), F.col("entity"), F.col("new")).alias("surrogate"), F.col("rows").alias("held")))


def session_key(spark) -> str:
    """The key of the registered queries: spark.pointmill.pii.key of the session; a public one, for tests only, where it is unset."""
    return spark.conf.get("spark.pointmill.pii.key", "not a secret")


def replace_pii(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """docs as struct `r`, with the new text and n_replaced.

    secret: the key; who has it can redo the mapping, so it has no default. Detection covers whole texts
    of any length, which are searched once. An entity gets one surrogate wherever it stands, in all
    documents. Null texts stay null and count 0; equal rows are treated alike and all kept; extra columns
    of any name stay inside `r`; an empty table gives no rows.
    """
    if not secret:
        raise ValueError("surrogates need a key")
    r = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    t = F.col("r")[text]
    found = F.when(t.rlike(TRIGGER), F.regexp_extract_all(t, F.lit(ALL), F.lit(0)))
    r = staged(r.withColumn("found", F.coalesce(found, F.array().cast("array<string>"))))
    without, having = r.where(F.size("found") == 0), staged(r.where(F.size("found") > 0).withColumn("mark", F.md5(t)))
    marks = having.groupBy("mark").agg(F.first("found").alias("found"), F.count(F.lit(1)).alias("held"))
    occurrences = staged(marks.select("mark", F.col("held").alias("rows"), F.posexplode("found").alias("at", "entity")))
    mapping = surrogates(occurrences, secret).drop("kind")
    met = join_skewed(occurrences, mapping, ["entity"], "held")
    per_text = staged(met.groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias("new"), F.max("rows").alias("held")))
    parts = F.split(t, ALL, -1)
    whole = F.array_join(F.zip_with(parts, F.concat(F.col("new.surrogate"), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = join_skewed(having, per_text, ["mark"], "held").select("r", whole.alias("new_text"), F.size("found").alias("n_replaced"))
    return without.select("r", t.alias("new_text"), F.lit(0).alias("n_replaced")).unionByName(changed)
