"""PII: surrogate generation for what patterns detect (DataFrame functions only).

Detected are e-mail addresses, IPv4 addresses, phone numbers, payment card
numbers, IBANs, social security numbers, and names after one or more titles: any
number of initials and name words, the last being the surname. The words of these
names are replaced wherever else they stand in the same document, without a title
too. A name that has no title anywhere in its document is not found, nor is a word
beside a known surname that stands in no titled name. A text is split at the matches and joined again with a surrogate in each match's place, so texts
are not shuffled.

A surrogate depends on a secret key, the kind and the value's normal form alone: mail
addresses in lower case, numbers without separators, phone numbers without country
code, names word by word and hyphenated words part by part. So the same value has the
same surrogate in all documents and formats (coreference, also of "Mr Smith" with "Mr
John Smith"). It is written in the format of the value it replaces: digits for digits,
letters for letters of the same case, punctuation as it stands; mail domains become
names reserved for examples, IPv4 addresses lie in 240.0.0.0/4, phone numbers keep
their country code, card numbers their first digit and whether the check digit is
right. Names follow the title's gender and the value's script (Latin or Cyrillic); a
given name after a neutral title ("Dr John") is that of the gender it has elsewhere in
the corpus, if it has one only.

The key comes from the setting ``spark.pagequarry.pii.key`` of the session, or from the
caller. Where neither gives one, each call draws a key of its own: nobody can find
surrogates by trying values, but two calls do not agree.

Collision checks: over the distinct values of the whole corpus, a surrogate that
two values share, or that is itself a value found in the corpus, is drawn again
with the next attempt number (``exceptions``) until all are distinct; values that still
collide after ``MAX_ROUNDS`` draws end the job, which only a kind with nearly as many
values as surrogates can bring about. Documents look up only values with an attempt
number above 0, and neutral given names of a known gender.

Nulls: a null text stays null; a null doc_id is an id of its own. Rows with equal doc_id
and text get equal texts. An empty table gives no rows. Columns n_<kind> of the input
are replaced, others pass through.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import broadcast_if_small, text_or_empty, written

KEY_SETTING = "spark.pagequarry.pii.key"
MAX_ROUNDS = 20
BROADCAST_ROWS = 100_000
KINDS = ("email", "iban", "ip", "card", "ssn", "phone", "name")

#: Titles by gender, and given names by gender and script.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа", "г-жа")
NEUTRAL = ("Dr", "Prof")
GIVEN = {
    ("m", "latin"): "Adam Anton Bruno Carl David Edgar Felix Georg Hugo Ivan Jonas Konrad Leo Martin Noel Oscar".split(),
    ("f", "latin"): "Ada Berta Clara Diana Elena Flora Greta Hanna Irene Julia Klara Laura Marta Nora Olga Paula".split(),
    ("n", "latin"): "Alex Charlie Chris Dominique Jean Jo Kim Lee Luca Maxime Nicola Robin Sam Sascha Toni Yannick".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Игорь".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Ирина Ольга".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава Шура Паша Мика Ники".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga go ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta".split(),
    "cyrillic": "ба бо ва во га го да до жа за ка ко ла ло ма мо на но па по ра ро са со та то фа хо ча ша ща зо".split(),
}

_TITLES = "|".join(sorted([*MALE, *FEMALE, *NEUTRAL], key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Words of a name; a possessive s is no part of it.
_NAME_WORD = r"\p{Lu}(?:\p{L}|['’-](?!s(?!\p{L}))\p{L})+"
_INITIALS = r"\p{Lu}(?:\.(?:-?\p{Lu}\.)*)?"
_TITLE_CHAIN = rf"(?:(?:{_TITLES})\.?\x20)+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?<![A-Za-z0-9])(?:\d{4}[ -]){3}\d{1,7}(?![A-Za-z0-9])|(?<![A-Za-z0-9])\d{13,19}(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![A-Za-z0-9+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![A-Za-z0-9+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![A-Za-z0-9.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "name": rf"(?<!\p{{L}}){_TITLE_CHAIN}(?:(?:{_NAME_WORD}|{_INITIALS})\x20)*{_NAME_WORD}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


_COUNTRY = r"^\+(?:1(?=\D)|[0-9]{1,3}(?=\D)|[0-9]{2})"


def key_of(spark: SparkSession) -> str:
    """The key that the session names, or a new one."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def kind_of(value: Column) -> Column:
    """The kind of a whole match, by its form."""
    out = F.lit("name")
    for kind in ("phone", "ssn", "card", "ip", "iban", "email"):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _digest(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """128 hex digits."""
    first = F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 256)
    return F.concat(first, F.sha2(F.concat(first, F.lit("+")), 256))


def _byte(digest: Column, i: Column) -> Column:
    """Byte i (from 0, wrapping) of a digest."""
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in options]), (number % len(options)).cast("int"))


def _chars(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, F.lit(1)))


def _scrambled(value: Column, digest: Column, keep: Column | None = None) -> Column:
    """Digits for digits and letters for letters of the same case; the first ``keep`` characters stay."""
    keep = F.lit(0) if keep is None else keep
    letter = lambda first, b: F.char((F.lit(ord(first)) + b % 26).cast("long"))

    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        return F.when(i < keep, c).when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), letter("a", b)).when(c.rlike("[A-Z]"), letter("A", b)).otherwise(c)

    return F.array_join(F.transform(_chars(value), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits whose last is the check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((n - i) % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(plain: Column, digest: Column) -> Column:
    n = F.length(plain)
    body = F.substring(_scrambled(plain, digest, F.lit(1)), F.lit(1), n - 1)
    right = ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    random = (_byte(digest, n) % 10).cast("string")
    return F.concat(body, F.when(_luhn_sum(plain) % 10 == 0, right).otherwise(random))


def _name_word(kind: Column, value: Column, digest: Column, attempt: Column) -> Column:
    """A given name (kind given-m, given-f, given-n) or a surname; each further attempt adds a syllable."""
    script = F.when(value.rlike("\\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    number = lambda k: _byte(digest, F.lit(2 * k)) * 256 + _byte(digest, F.lit(2 * k + 1))
    out = None
    for s in ("cyrillic", "latin"):

        def many(n: Column, syllables: list[str] = SYLLABLES[s]) -> Column:
            """n + 1 syllables, from bytes 9 onward."""
            return F.array_join(F.transform(F.sequence(F.lit(0), n), lambda k: F.get(F.array(*[F.lit(x) for x in syllables]), (_byte(digest, k + 9) % len(syllables)).cast("int"))), "")

        made = F.initcap(many(attempt + 2))
        for g in "mfn":
            given = F.concat(_pick(GIVEN[g, s], number(0)), F.when(attempt > 0, many(attempt - 1)).otherwise(F.lit("")))
            made = F.when(kind == f"given-{g}", given).otherwise(made)
        out = made if out is None else F.when(script == "cyrillic", out).otherwise(made)
    return out


def normal(kind: Column, value: Column) -> Column:
    """What a value has in common with its other formats."""
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.isin("card", "ssn"), digits(value))
        .when(kind == "phone", digits(F.regexp_replace(value, _COUNTRY, "")))
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .otherwise(value)
    )


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a value in its normal form; names come here in parts (kinds given-m, given-f, given-n, surname)."""
    d = _digest(key, kind, value, attempt)
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    inner = F.array_join(F.slice(F.split(domain, "\\."), F.lit(1), F.greatest(F.size(F.split(domain, "\\.")) - 2, F.lit(0))), ".")
    reserved = _pick(["example.com", "example.net", "example.org"], _byte(d, F.lit(63)))
    email = F.concat(_scrambled(local, d), F.lit("@"), F.when(inner == "", F.lit("")).otherwise(F.concat(_scrambled(inner, F.reverse(d)), F.lit("."))), reserved)
    ip = F.concat_ws(".", (240 + _byte(d, F.lit(0)) % 15).cast("string"), *[_byte(d, F.lit(k)).cast("string") for k in (1, 2, 3)])
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", _card(value, d))
        .when(kind == "phone", _scrambled(value, d))
        .when(kind == "iban", _scrambled(value, d, F.lit(2)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_scrambled(value, d), 2, 20)))
        .otherwise(_name_word(kind, value, d, attempt))
    )


def _filled(value: Column, made: Column) -> Column:
    """The letters and digits of ``made`` in the places that letters and digits have in value."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def add(done: Column, c: Column) -> Column:
        of = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(done["s"], F.when(of, F.substring(made, done["k"] + 1, F.lit(1))).otherwise(c)).alias("s"), (done["k"] + of.cast("int")).alias("k"))

    return F.when(F.length(value) == F.length(made), made).otherwise(F.aggregate(_chars(value), start, add, lambda done: done["s"]))


def formatted(kind: Column, value: Column, made: Column) -> Column:
    """A surrogate in the format of the value that it replaces."""
    country = F.regexp_extract(value, _COUNTRY, 0)
    n = F.length(F.substring_index(value, "@", 1))
    cased = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substring(value, i, F.lit(1)).rlike("[A-Z]"), F.upper(F.substring(made, i, F.lit(1)))).otherwise(F.substring(made, i, F.lit(1))))
    return (
        F.when(kind == "email", F.when(value == F.lower(value), made).otherwise(F.concat(F.array_join(cased, ""), F.substring(made, n + 1, F.length(made)))))
        .when(kind.isin("card", "ssn", "iban"), _filled(value, made))
        .when(kind == "phone", F.concat(country, _filled(F.substring(value, F.length(country) + 1, F.length(value)), made)))
        .otherwise(made)
    )


def _gender(match: Column) -> Column:
    title = F.regexp_extract(match, rf"^(?:(?:{'|'.join(NEUTRAL)})\.?\x20)*({_TITLES})(?!\p{{L}})", 1)  # the first that has a gender, if any
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def _words(match: Column) -> Column:
    """The (kind, value) of each word of a name, without its titles."""
    words = F.split(F.regexp_replace(match, rf"^{_TITLE_CHAIN}", ""), " ")
    return F.transform(words, lambda w, i: F.struct(F.when(i == F.size(words) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given-"), _gender(match))).alias("kind"), w.alias("value")))


def _parts(words: Column) -> Column:
    """The (kind, value) of the parts of words that have hyphens, and of whole words that have none."""
    return F.flatten(F.transform(words, lambda u: F.transform(F.split(u["value"], "-"), lambda p: F.struct(u["kind"].alias("kind"), p.alias("value")))))


def _units(match: Column) -> Column:
    """The (kind, normal value) pairs of a match: itself, or the parts of a name."""
    kind = kind_of(match)
    return F.when(kind == "name", _parts(_words(match))).otherwise(F.array(F.struct(kind.alias("kind"), normal(kind, match).alias("value"))))


def _may_match(text: Column) -> Column:
    """A cheap condition that every text with a match meets: a digit, an @, or a title."""
    out = text.rlike("[0-9@]")
    for title in (*MALE, *FEMALE, *NEUTRAL):
        if not any(title != t and title.startswith(t) for t in (*MALE, *FEMALE, *NEUTRAL)):
            out = out | F.contains(text, F.lit(title))
    return out


def matches(text: Column) -> Column:
    """The matches in a text, in order."""
    return F.when(_may_match(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _known_words(found: Column) -> Column:
    """The (kind, value) of the name words among a document's matches and of their parts, longest first, surnames before given names; initials are left out."""
    words = F.flatten(F.transform(F.filter(found, lambda m: kind_of(m) == "name"), _words))
    words = F.filter(F.array_distinct(F.concat(words, _parts(words))), lambda u: u["value"].rlike(f"^{_NAME_WORD}$"))
    keyed = F.transform(words, lambda u: F.struct(F.length(u["value"]).alias("n"), u["kind"].alias("kind"), u["value"].alias("value")))
    return F.sort_array(keyed, asc=False)


def entities(docs: DataFrame) -> DataFrame:
    """(kind, value): the distinct values of the corpus."""
    found = docs.select(F.explode(matches(text_or_empty())).alias("m")).select(F.explode(_units(F.col("m"))).alias("u"))
    return found.groupBy("u.kind", "u.value").agg(F.lit(1).alias("one")).select("kind", "value")


def exceptions(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt, as): how to draw the values whose first surrogate collides or that are drawn as another kind.

    In each round the value with the lower attempt, then the smaller value, keeps a
    shared surrogate; only counts reach the driver. ``as`` is the kind itself, but for
    given names after neutral titles that have one gender elsewhere.
    """
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gendered = values.where("kind IN ('given-m', 'given-f')").groupBy("value").agg(F.count("*").alias("n"), F.min("kind").alias("as")).where("n = 1").drop("n")
    alias = written(values.where("kind = 'given-n'").join(gendered, "value").select("kind", "value", "as"), "pii-genders")
    values = values.join(alias.select("kind", "value"), ["kind", "value"], "left_anti")
    # Few rows with much work each: dealt to a stated number of tasks.
    values = written(values.repartition(tasks, "kind", "value"), "pii-drawn")
    at = values.repartition(tasks, "kind", "value").withColumn("attempt", F.lit(0))
    at = written(at.withColumn("s", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)), "pii-surrogates")
    for _ in range(MAX_ROUNDS):
        first = at.groupBy("kind", "s").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "value")).alias("keeper")).where("n > 1")
        shared = at.join(first, ["kind", "s"]).where(F.struct("attempt", "value") != F.col("keeper")).select("kind", "value")
        real = values.select("kind", F.col("value").alias("s"))
        known = at.join(real, ["kind", "s"], "left_semi").select("kind", "value")
        again = written(shared.union(known).distinct(), "pii-again")
        if again.isEmpty():
            break
        again = again.withColumn("lost", F.lit(1))
        at = at.join(again, ["kind", "value"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("lost", F.lit(0))).drop("lost")
        moved = F.when(F.col("attempt") > 0, surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).otherwise(F.col("s"))
        at = written(at.withColumn("s", moved), "pii-surrogates")
    else:
        raise RuntimeError("surrogates still collide")
    odd = at.where("attempt > 0").select("kind", "value", "attempt", F.col("kind").alias("as"))
    drawn = odd.select(F.col("kind").alias("as"), "value", "attempt")
    return odd.union(alias.join(drawn, ["as", "value"], "left").select("kind", "value", F.coalesce("attempt", F.lit(0)), "as"))


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs (doc_id, text and any other columns) with surrogates in text, and n_<kind> for each kind.

    Columns n_<kind> of docs are replaced.
    """
    key = key or key_of(docs.sparkSession)
    values = written(entities(docs), "pii-values")
    odd = written(exceptions(values, key), "pii-exceptions")
    keyed = docs.withColumns({"__pq_th": F.xxhash64("text"), "__pq_id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    if odd.isEmpty():
        df = keyed.withColumn("__pq_odd", F.lit(None).cast("map<string,struct<attempt:int,as:string>>"))
    else:
        used = keyed.select("__pq_th", "__pq_id", F.explode(matches(text_or_empty())).alias("m")).select("__pq_th", "__pq_id", F.explode(_units(F.col("m"))).alias("u"))
        used = used.select("__pq_th", "__pq_id", F.col("u.kind").alias("kind"), F.col("u.value").alias("value")).join(broadcast_if_small(odd, BROADCAST_ROWS), ["kind", "value"])
        per_doc = used.groupBy("__pq_th", "__pq_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "value"), F.struct("attempt", "as")))).alias("__pq_odd"))
        df = keyed.join(broadcast_if_small(written(per_doc, "pii-documents"), BROADCAST_ROWS), ["__pq_th", "__pq_id"], "left")
    df = df.withColumn("__pq_matches", matches(text_or_empty())).withColumn("__pq_words", _known_words(F.col("__pq_matches")))
    # Where names are known, a second pattern finds their words as well.
    known = F.size("__pq_words") > 0
    words = F.array_join(F.array_distinct(F.transform("__pq_words", lambda u: u["value"])), "|")
    pattern = F.concat(F.lit(rf"{ANY}|(?<![\p{{L}}\p{{N}}])(?:"), words, F.lit(r")(?![\p{L}\p{N}])"))
    df = df.withColumn("__pq_pattern", F.when(known, pattern).otherwise(F.lit(ANY)))
    df = df.withColumn("__pq_matches", F.when(known, F.regexp_extract_all(text_or_empty(), F.col("__pq_pattern"), F.lit(0))).otherwise(F.col("__pq_matches")))

    # Column by column, so that each step reads fields: an item (match, kind, title, words) per match, then the distinct parts
    # of all words, each drawn once for its document.
    df = df.withColumn("__pq_items", F.transform("__pq_matches", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))

    def words_of_item(x: Column) -> Column:
        bare = F.filter("__pq_words", lambda u: u["value"] == x["m"])
        bare = F.transform(F.slice(bare, 1, 1), lambda u: F.struct(u["kind"].alias("kind"), u["value"].alias("value")))
        of_name = F.when(F.size(bare) > 0, bare).otherwise(_words(x["m"]))
        return F.when(x["kind"] == "name", of_name).otherwise(F.array(F.struct(x["kind"].alias("kind"), normal(x["kind"], x["m"]).alias("value"))))

    title = lambda x: F.when((x["kind"] == "name"), F.regexp_extract(x["m"], rf"^{_TITLE_CHAIN}", 0)).otherwise(F.lit(""))
    df = df.withColumn("__pq_items", F.transform("__pq_items", lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), title(x).alias("title"), words_of_item(x).alias("words"))))
    all_parts = F.flatten(F.transform("__pq_items", lambda x: F.when(x["kind"] == "name", _parts(x["words"])).otherwise(x["words"])))
    df = df.withColumn("__pq_parts", F.array_distinct(all_parts))
    name_of = lambda u: F.concat_ws(":", u["kind"], u["value"])
    df = df.withColumn("__pq_parts", F.transform("__pq_parts", lambda u: F.struct(name_of(u).alias("name"), u["kind"].alias("kind"), u["value"].alias("value"), F.try_element_at(F.col("__pq_odd"), name_of(u)).alias("odd"))))
    df = df.withColumn("__pq_parts", F.transform("__pq_parts", lambda u: F.struct(u["name"].alias("name"), F.coalesce(u["odd"]["as"], u["kind"]).alias("kind"), u["value"].alias("value"), F.coalesce(u["odd"]["attempt"], F.lit(0)).alias("attempt"))))
    df = df.withColumn("__pq_drawn", F.map_from_entries(F.transform("__pq_parts", lambda u: F.struct(u["name"].alias("name"), surrogate(u["kind"], u["value"], u["attempt"], key).alias("made")))))

    def replaced(x: Column) -> Column:
        made = lambda kind, part: F.try_element_at(F.col("__pq_drawn"), F.concat_ws(":", kind, part))
        words = F.transform(x["words"], lambda u: F.array_join(F.transform(F.split(u["value"], "-"), lambda p: made(u["kind"], p)), "-"))
        first = F.get(x["words"], 0)
        return F.struct(x["m"].alias("m"), x["kind"].alias("kind"), F.when(x["kind"] == "name", F.concat(x["title"], F.array_join(words, " "))).otherwise(made(first["kind"], first["value"])).alias("made"))

    df = df.withColumn("__pq_made", F.transform("__pq_items", replaced))
    df = df.withColumn("__pq_made", F.transform("__pq_made", lambda x: formatted(x["kind"], x["m"], x["made"])))
    pieces = F.when(known, F.split(F.col("text"), F.col("__pq_pattern"), -1)).otherwise(F.split(F.col("text"), ANY, -1))
    joined = F.array_join(F.zip_with(pieces, F.col("__pq_made"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    df = df.withColumn("__pq_kinds", F.transform("__pq_items", lambda x: x["kind"]))
    df = df.withColumns({f"n_{k}": (F.size("__pq_kinds") - F.size(F.array_remove("__pq_kinds", k))).cast("long") for k in KINDS})
    df = df.withColumn("text", F.when(F.size("__pq_matches") == 0, F.col("text")).otherwise(joined))
    return df.drop(*[c for c in df.columns if c.startswith("__pq_")])
