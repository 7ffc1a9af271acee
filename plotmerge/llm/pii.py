"""Surrogates for personal data, in DataFrame functions only.

One pattern finds the entities of a text. Each is cut into parts that stand for something
of their own (the domain of an address, the surname of a person), so equal things get equal
replacements in every document. A replacement is drawn from a keyed hash of what it
replaces, in the form of the original: digits for digits under the same punctuation, a
check digit where there was one, letters of the same script and case, a given name of the
same gender, an address octet in range, a private network again. Draws that collide with
each other, or with anything that occurs in the corpus, are drawn again until all
replacements are distinct. Of a form with few values (short phone numbers, private networks)
whose originals fill much of it, unused values are dealt out in a keyed order; if they do not
suffice, the originals are permuted without a fixed point, and a replacement is then another
original of its form. Texts without an entity are never shuffled.

Defined results: a null text stays null and has no entities; texts without entities are
returned as they are; rows that repeat an id and text get equal results; an empty table
gives no rows. An entity is what the pattern matches in whole; person names are recognised
behind a form of address. Other columns pass through or are never read.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotmerge.llm.common import free_name, partitions, rank_in_class, stored

#: Key of the hash for tests and examples; pass a secret one.
KEY = "surrogate-key"
#: A form is not drawn from once its originals are one in so many of its values.
FULL = 4
_BLOCK = 1 << 14

# Forms of address by gender.
MALE = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "госпожа", "Госпожа"]
NEUTRAL = ["Dr", "Prof"]

_TITLES = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Type and pattern, the first that matches counts. None backtracks over more than a word.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": r"(?<![0-9A-Za-z])(?:(?=[0-9a-fA-F]{0,128}?\d)(?=\d{0,128}[a-fA-F])[0-9a-fA-F]{32,128}"
              r"|AKIA[0-9A-Z]{16}|gh[a-z]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])",
    # 11 to 30 letters and digits in groups of four; a last group without a digit is a word behind it.
    "iban": r"(?<![\p{L}\p{N}])(?=[A-Z]{2}\d{2})(?:SC\d{2}(?: ?[A-Z0-9]{4}){6} ?[A-Z]{3}|[A-Z]{2}\d{2}(?=(?: ?[A-Z0-9]){11})"
            r"(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?<=\d[A-Z]{0,3}|\d[A-Z]{1,3} UR)"
            r"|[A-Z]{2}\d{2} ?(?:[A-Z]{4} ?)?(?:\d{4} ?){2,7}(?:\d{1,3})?(?<! ))(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<!\d)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\1\d{4,5}|\d{13,19})(?!\d)".replace(r"([ -])", "[ -]").replace(r"\1", "[ -]"),
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}"
             r"|\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4}[ /-]\d{3,8})(?!\d)",
    "person": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'-]++(?: \p{{Lu}}[\p{{L}}'-]++)?",
}


def _any_of(*kinds: str) -> str:
    return "(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in kinds) + ")"


#: All patterns, in their order. Inside a word one look back rules most of them out.
_NOT_INSIDE = r"(?<![\p{L}\p{N}])"
PATTERN = (
    f"{_NOT_INSIDE}{_any_of('email', 'secret', 'iban')}|(?=\\d){_any_of('ip', 'card', 'ssn')}"
    f"|{_NOT_INSIDE}{_any_of('phone', 'person')}"
)


def may_hold_entity(text: Column) -> Column:
    """What every entity needs: a digit, an at sign, a key's beginning or a form of address."""
    marks = text.rlike("[0-9@]|gh[a-z]_")
    for word in ("sk-", "AKIA", *MALE, *FEMALE, *NEUTRAL):
        marks = marks | text.contains(word)
    return marks

_SCRIPTS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "ba do fe gi ka lo mi nu pe ra so ti ve wo zu sha", ("a", "o", "e")),
    "cyrillic": ("абвгдежзиклмнопрстуфхцчшэюя", "ба до ве ги ка ло ми ну пе ра со ти фе хо зу ша", ("а", "ов", "ей")),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψω", "βα δο φε γι κα λο μι νυ πε ρα σο τι θε χο ζου ψα", ("α", "ος", "ις")),
}


def type_of(raw: Column) -> Column:
    whole = [(name, raw.rlike(f"^(?:{p})$")) for name, p in PATTERNS.items()]
    return reduce(lambda c, x: c.when(x[1], x[0]), whole[1:], F.when(whole[0][1], whole[0][0]))


def _number(stream: Column, at: Column) -> Column:
    """The byte of a hex stream at a position, which wraps around."""
    return F.conv(F.substring(stream, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _of_list(values: list[str] | str, number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _like_letters(text: Column, stream: Column) -> Column:
    """Each letter and digit replaced by one of its kind."""

    def one(c: Column, k: Column) -> Column:
        n = _number(stream, k)
        low = F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
        for name, (letters, _, _) in _SCRIPTS.items():
            if name != "latin":
                low = low.when(c.rlike(rf"\p{{Is{name.title()}}}"), _of_list(letters, n))
        low = low.when(c.rlike(r"\p{L}"), _of_list(_SCRIPTS["latin"][0], n)).otherwise(c)
        return F.when(c.rlike(r"\p{Lu}"), F.upper(low)).otherwise(low)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(n: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda k: (_number(stream, k) % 10).cast("string")), "")


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 for a number with a right check digit."""

    def one(k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((F.length(digits) - k) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), one), F.lit(0), lambda a, b: a + b)


def _card(digits: Column, stream: Column) -> Column:
    """Same network digit and length; a right check digit stays right, a wrong one wrong."""
    n = F.length(digits)
    drawn = F.concat(F.substring(digits, 1, 1), F.substring(_digits(n, stream), F.lit(2), n - 2))
    right = F.pmod(-_luhn(F.concat(drawn, F.lit("0"))), F.lit(10))
    wrong = (right + 1 + _number(stream, F.lit(63)) % 9) % 10
    return F.concat(drawn, F.when(_luhn(digits) % 10 == 0, right).otherwise(wrong).cast("string"))


def _address(ip: Column, stream: Column) -> Column:
    part = F.split(ip, r"\.")
    octet = [(_number(stream, F.lit(k)) % 254 + 1).cast("string") for k in range(4)]
    keep = F.when(ip.rlike(r"^(10|127)\."), 1).when(ip.rlike(r"^192\.168\.|^172\.(1[6-9]|2\d|3[01])\."), 2).otherwise(0)
    return F.concat_ws(".", *[F.when(keep > k, part[k]).otherwise(octet[k]) for k in range(4)])


def _name(text: Column, kind: Column, stream: Column, attempt: int) -> Column:
    """Syllables of the text's script; a given name ends by gender. Redraws are longer."""
    found = F.lit(None).cast("string")
    for script, (_, syllables, (female, male, neutral)) in _SCRIPTS.items():
        parts = [_of_list(syllables.split(), _number(stream, F.lit(k))) for k in range(4 + attempt)]
        ending = F.when(kind == "given-f", female).when(kind == "given-m", male).when(kind == "given-n", neutral).otherwise("")
        found = F.when(_script(text) == script, F.concat(*parts, ending)).otherwise(found)
    return found


def surrogate(kind: Column, norm: Column, key: str, attempt: int) -> Column:
    """The draw for an entity, in the normal form of its type."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, F.lit(str(attempt)))
    stream = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f")), 256))
    longer = F.substring(stream, 1, max(0, attempt - 2))
    hexes = F.translate(longer, "0123456789", "ghijklmnop")
    tld = F.regexp_extract(norm, r"\.(com|net|org)$", 1)
    letters = F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(8 + attempt)), lambda k: _of_list(_SCRIPTS["latin"][0], _number(stream, k))), "")
    domain = F.concat(letters, F.lit(".example"), F.when(tld != "", F.concat(F.lit("."), tld)).otherwise(""))
    local = F.regexp_extract(norm, "^([^@]+)@", 1)
    return (
        F.when(kind == "local", F.concat(_like_letters(local, stream), hexes))
        .when(kind == "domain", domain)
        .when(kind == "secret", F.when(
            norm.rlike("^[0-9a-f]+$"), F.substring(stream, F.lit(1), F.length(norm))
        ).otherwise(F.concat(F.substring(norm, 1, 4), _like_letters(F.substring(norm, 5, 200), stream))))
        .when(kind == "iban", F.concat(F.substring(norm, 1, 2), _like_letters(F.substring(norm, 3, 60), stream)))
        .when(kind == "ip", _address(norm, stream))
        .when(kind == "card", _card(norm, stream))
        .when(kind.isin("ssn", "phone"), _digits(F.length(norm), stream))
        .otherwise(_name(norm, kind, stream, attempt))
    )


def parts_of(raw: Column) -> Column:
    """Parts of an entity in order: (kind, scope, norm, piece); kind null is left as it is."""
    kind = type_of(raw)

    def part(kind, scope, norm, piece) -> Column:
        return F.struct(
            (F.lit(kind) if kind is None or isinstance(kind, str) else kind).cast("string").alias("kind"),
            scope.cast("string").alias("scope"), norm.cast("string").alias("norm"), piece.alias("piece"),
        )

    none, empty = F.lit(None), F.lit("")
    low = F.lower(raw)
    domain = F.regexp_extract(raw, "@(.*)$", 1)
    email = F.array(
        part("local", F.lower(domain), low, F.regexp_extract(raw, "^([^@]+)@", 1)),
        part(None, none, none, F.lit("@")), part("domain", empty, F.lower(domain), domain),
    )
    title, first, last = (F.regexp_extract(raw, r"^(\S+ )(\S+)( \S+)?$", k) for k in (1, 2, 3))
    bare = F.regexp_replace(title, r"[. ]", "")
    gender = F.when(bare.isin(MALE), "given-m").when(bare.isin(FEMALE), "given-f").otherwise("given-n")
    one_name = F.array(part(None, none, none, title), part("surname", empty, F.lower(first), first))
    two_names = F.array(
        part(None, none, none, title), part(gender, empty, F.lower(first), first),
        part(None, none, none, F.lit(" ")), part("surname", empty, F.lower(F.trim(last)), F.trim(last)),
    )
    country = F.regexp_extract(raw, r"^(\+\d{1,3})(?=[ .(-])|^(\+\d{2})", 0)
    rest = F.substring(raw, F.length(country) + 1, F.lit(1000))

    def digits(text: Column) -> Column:
        return F.regexp_replace(text, r"\D", "")

    phone = F.array(part(None, none, none, country), part("phone", F.length(digits(rest)), digits(rest), rest))
    plain = F.when(kind.isin("card", "ssn"), digits(raw)).when(kind == "iban", F.regexp_replace(raw, " ", "")).when(
        (kind == "secret") & low.rlike("^[0-9a-f]+$"), low
    ).otherwise(raw)
    return (
        F.when(kind == "email", email).when(kind == "phone", phone)
        .when((kind == "person") & (last == ""), one_name).when(kind == "person", two_names)
        # Addresses of all lengths share a scope: a draw may be longer or shorter than its original.
        .otherwise(F.array(part(kind, F.when(kind == "ip", "").otherwise(F.length(plain).cast("string")), plain, raw)))
    )


def in_form_of(piece: Column, kind: Column, drawn: Column) -> Column:
    """The draw in the punctuation and case of the piece that it replaces."""

    def lay(c: Column, k: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(piece, F.lit(1), k + 1), "[^0-9A-Z]", ""))
        return F.when(c.rlike("[0-9A-Z]"), F.substring(drawn, before, F.lit(1))).otherwise(c)

    upper = piece.rlike(r"\p{Lu}\P{Ll}*$") & ~piece.rlike(r"\p{Ll}") & (F.length(piece) > 1)
    cased = F.when(upper, F.upper(drawn)).when(kind.isin("surname", "given-m", "given-f", "given-n"), F.initcap(drawn)).otherwise(drawn)
    numbers = kind.isin("card", "ssn", "phone", "iban")
    return F.when(kind.isNull(), piece).when(
        numbers, F.array_join(F.transform(F.split(piece, ""), lay), "")
    ).otherwise(cased)


def _form(kind: Column, norm: Column) -> tuple[Column, Column]:
    """The fixed part and the number of values of a form that has few; null for all others.

    The draws of cards, account numbers and keys have 10^10 values at least, and mail
    addresses, domains and names grow with every redraw.
    """
    digits = kind.isin("phone", "ssn")
    private = F.coalesce(
        F.nullif(F.regexp_extract(norm, r"^(192\.168\.|172\.(1[6-9]|2\d|3[01])\.)", 1), F.lit("")),
        F.nullif(F.regexp_extract(norm, r"^(10\.|127\.)", 1), F.lit("")),
    )
    form = F.when(digits, "").when(kind == "ip", private)
    free = 4 - F.size(F.split(private, r"\.")) + 1
    return form, F.when(digits, F.pow(F.lit(10.0), F.length(norm))).when(kind == "ip", F.pow(F.lit(254.0), free))


def _dense(entities: DataFrame, taken: DataFrame, key: str) -> tuple[DataFrame | None, DataFrame]:
    """Replacements for forms that are too full to draw from, and the entities of all others.

    All values of such a form are listed. If enough of them occur nowhere, the originals get
    those in a keyed order; otherwise each original gets the next one in a keyed order.
    """
    form, values = _form(F.col("kind"), F.col("norm"))
    same = ["kind", "scope", "form"]
    formed = stored(entities.withColumn("form", form).withColumn("values", values), "pii-forms")
    sizes = formed.where("form is not null").groupBy(*same).agg(F.count("*").alias("n"), F.max("values").alias("values"))
    full = stored(sizes.where(F.col("n") * FULL > F.col("values")), "pii-full")
    if full.isEmpty():
        return None, entities

    def ranked(rows: DataFrame, name: str) -> DataFrame:
        h = F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "value"), 256)
        return stored(rank_in_class(rows.withColumn("_h", h), same, f"{name}-ranked").drop("_h"), name)

    old = ranked(formed.join(full.drop("values", "n"), same).select(*same, F.col("norm").alias("value")), "pii-old")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("values") / _BLOCK) - 1)).alias("block")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_BLOCK - 1).cast("long"))).alias("at")
    places = full.select(*same, "values", block).repartition("kind", "scope", "form", "block").select(*same, "values", "block", at)
    places = places.select(*same, (F.col("block") * _BLOCK + F.col("at")).alias("k"), "values").where("k < values")
    octet = [(F.floor(F.col("k") / 254**j) % 254 + 1).cast("string") for j in range(3)]
    address = F.when(F.length("form") > 4, F.concat("form", octet[1], F.lit("."), octet[0])).otherwise(
        F.concat("form", octet[2], F.lit("."), octet[1], F.lit("."), octet[0])
    )
    value = F.when(F.col("kind") == "ip", address).otherwise(F.lpad(F.col("k").cast("string"), F.col("scope").cast("int"), "0"))
    unused = places.select(*same, value.alias("value")).join(
        taken.withColumnRenamed("drawn", "value"), ["kind", "scope", "value"], "left_anti"
    ).select(*same, "value")
    unused = ranked(unused, "pii-unused")
    enough = unused.groupBy(*same).agg(F.count("*").alias("unused"))
    old = old.join(full.select(*same, "n"), same).join(enough, same, "left")
    fits = F.coalesce(F.col("unused") >= F.col("n"), F.lit(False))
    to_unused = old.where(fits).join(unused.withColumnRenamed("value", "drawn"), [*same, "_rank"])
    following = old.select(*same, F.col("value").alias("drawn"), F.pmod(F.col("_rank") - 1, F.col("n")).alias("_rank"))
    permuted = old.where(~fits).join(following, [*same, "_rank"])
    columns = ["kind", "scope", F.col("value").alias("norm"), "drawn"]
    done = stored(to_unused.select(*columns).union(permuted.select(*columns)), "pii-accepted")
    return done, stored(entities.join(done, ["kind", "scope", "norm"], "left_anti"), "pii-pending")


#: Draws of one task.
DRAWS = 2_000


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, scope, norm, drawn): draws that differ from each other and from all originals.

    Where the originals leave too few values of their form, they are permuted.
    """
    same = ["kind", "scope"]
    taken = entities.select(*same, F.col("norm").alias("drawn"))
    # Addresses are compared by their part before the sign, within their domain.
    taken = taken.withColumn("drawn", F.when(F.col("kind") == "local", F.regexp_extract("drawn", "^([^@]+)@", 1)).otherwise(F.col("drawn")))
    accepted, pending = _dense(entities, taken, key)
    for attempt in count():
        # A small table is read back as one task, and a draw takes long.
        dealt = pending.repartition(partitions(pending.count(), DRAWS), *same, "norm")
        drawn = stored(dealt.withColumn("drawn", surrogate(F.col("kind"), F.col("norm"), key, attempt)), "pii-drawn")
        good = drawn.groupBy(*same, "drawn").agg(F.min("norm").alias("norm")).join(taken, [*same, "drawn"], "left_anti")
        if accepted is not None:
            good = good.join(accepted, [*same, "drawn"], "left_anti")
        good = stored(good.select(*same, "norm", "drawn"), "pii-accepted")
        accepted = good if accepted is None else accepted.union(good)
        pending = stored(drawn.join(good, [*same, "norm"], "left_anti").drop("drawn"), "pii-pending")
        if pending.isEmpty():
            return accepted


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY,
                 count_col: str = "n_entities") -> DataFrame:
    """All columns of ``docs`` with the text replaced, and the number of its entities."""
    text = F.col(text_col)
    matches = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    has = F.coalesce(may_hold_entity(text) & text.rlike(PATTERN), F.lit(False))
    found = stored(docs.where(has).select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), matches.alias("raws")
    ).dropDuplicates(["id", "h"]), "pii-found")
    places = found.select("id", "h", F.posexplode("raws").alias("at", "raw"))
    parts = stored(places.select("raw").distinct().select(
        "raw", F.posexplode(parts_of(F.col("raw"))).alias("k", "p")
    ).select("raw", "k", "p.*"), "pii-parts")
    entities = stored(parts.where("kind is not null").select("kind", "scope", "norm").distinct(), "pii-entities")
    draws = distinct_surrogates(entities, key)
    new = F.col("new")
    replaced = parts.join(draws, ["kind", "scope", "norm"], "left").select(
        "raw", "k", in_form_of(F.col("piece"), F.col("kind"), F.col("drawn")).alias("new")
    ).groupBy("raw").agg(F.sort_array(F.collect_list(F.struct("k", "new"))).alias("parts")).select(
        "raw", F.array_join(F.col("parts.new"), "").alias("new")
    )
    name = {k: free_name(docs, f"_pii_{k}") for k in ("id", "h", "news")}
    per_text = places.join(stored(replaced, "pii-replaced"), "raw").groupBy("id", "h").agg(
        F.sort_array(F.collect_list(F.struct("at", new))).alias("news")
    ).select(F.col("id").alias(name["id"]), F.col("h").alias(name["h"]), F.col("news.new").alias(name["news"]))
    same = F.col(id_col).eqNullSafe(F.col(name["id"])) & (F.xxhash64(text) == F.col(name["h"]))
    news = F.col(name["news"])
    between = F.split(text, PATTERN, -1)
    rebuilt = F.array_join(F.zip_with(between, F.array_append(news, F.lit("")), lambda a, b: F.concat(a, b)), "")
    touched = docs.where(has).join(stored(per_text, "pii-texts"), same).withColumns(
        {text_col: rebuilt, count_col: F.size(news).cast("long")}
    )
    columns = [c for c in docs.columns if c != count_col] + [count_col]
    untouched = docs.where(~has).withColumn(count_col, F.lit(0).cast("long"))
    return touched.select(*columns).union(untouched.select(*columns))
