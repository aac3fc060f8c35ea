"""Surrogates for personal data (DataFrame functions only).

Entities are found by patterns, all of which are linear: what repeats without end is possessive, so a text of any length
and alphabet is scanned in linear time. Names are known by the titles before them and have up to 25 words, with initials
and particles (which stay). Each entity consists of atoms (kind, canonical value): a number's digits whatever its
punctuation, an e-mail address in lower case, the value behind "token =", each given name and the surname behind a title. The corpus's distinct atoms form one table, each with a keyed surrogate of
its type: as long, of the same classes of characters and the same script, a card number with a valid check digit, an
address with valid octets, a name with the gender that the title tells (titles like Dr. tell none). Equal atoms have
equal surrogates everywhere (coreference). Two atoms of a kind never share one and none equals a real value of its kind:
those that would are drawn anew with the next attempt until none is left; where a kind has no free value of its length
any more, a longer one is taken. Every distinct entity is rewritten once, and texts are rebuilt from the stretches
between entities, so nothing is replaced twice.

Texts are scanned once and written with what was found; only rows with entities are joined, and cut by the patterns.
An initial becomes the first letter of a drawn name, so different initials may share one; all other atoms stay distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_aware_join, written

#: Patterns, in order of preference. Keys and secrets have no largest length; a secret may have full stops inside.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.(?=\p{L}{2}|[\p{L}\p{N}-]++\.))++\p{L}{2,}+[\p{L}\p{N}]*+"
TOKEN = r"(?<![\p{L}\p{N}])(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Aa]pi[ _-]?[Kk]ey|API[ _-]?KEY|[Aa]ccess[ _-]?[Kk]ey)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{7,}(?<!\.)"
PASSWORD = r"(?<![\p{L}\p{N}])(?:[Pp]assword|PASSWORD|[Pp]asswd)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"'<>,;]{4,}(?<![.:!?)\]}])"
SECRET = f"{TOKEN}|{PASSWORD}"
HEX_KEY = r"(?<![\p{L}\p{N}])(?=[0-9a-fA-F]{0,31}[0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])"
CLOUD_KEY = r"(?<![\p{L}\p{N}])(?:A[KS]IA[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35,}+|sk-(?:(?:proj|svcacct|admin|ant|live|test)[_-][A-Za-z0-9_-]{20,}+|[A-Za-z0-9]{20,}+))"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
#: Eight groups, or fewer around a double colon with a digit somewhere.
IP6 = r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]{0,38}[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}:])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
CARD = r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])"
PHONE = r"(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,5}){1,4}|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}|(?<![\d./-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
MALE = r"Mr|MR|Herr|HERR|Herrn|Monsieur|Señor|Sr|Господин|Κύριος"
FEMALE = r"Mrs|MRS|Ms|MS|Miss|Frau|FRAU|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Госпожа|Κυρία"
NEUTRAL = r"Dr|DR|Prof|PROF|Доктор|Профессор|Δρ"
#: A capital and letters, with apostrophes and hyphens inside.
NAME = r"\p{Lu}(?:[\p{L}\p{M}]|['’-](?=\p{L}))++"
#: What has more capitalised words behind a title isn't a name as a whole.
MOST_WORDS = 25
#: What stands between a name's words and stays, and initials.
PARTICLES = "von|van|vom|zu|zur|zum|der|den|de|del|della|di|da|du|des|dos|das|la|le|el|al|bin|ibn|ter|ten|af|av"
BEFORE = rf"(?:(?:{PARTICLES}|(?:\p{{Lu}}\.)++) ){{0,6}}+"
TITLES = rf"(?:(?:{MALE}|{FEMALE}|{NEUTRAL})\.? ){{1,3}}+"
PERSON = rf"(?<![\p{{L}}\p{{N}}]){TITLES}{BEFORE}{NAME}(?: {BEFORE}{NAME}){{0,{MOST_WORDS - 1}}}+"
PATTERNS = {"email": EMAIL, "secret": SECRET, "key": f"{HEX_KEY}|{CLOUD_KEY}", "ip": IP, "ip6": IP6, "iban": IBAN, "ssn": SSN, "phone": PHONE, "card": CARD, "person": PERSON}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity contains: a cheap test before ANY.
HINT = rf"[0-9@=:]|{MALE}|{FEMALE}|{NEUTRAL}"

#: Alphabets from which a character's surrogate is drawn, by the class of the character.
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
#: Syllables of invented names by script.
SYLLABLES = {
    "latin": ("ba", "ce", "do", "fa", "ga", "he", "ja", "ko", "la", "me", "no", "pa", "ra", "se", "ta", "vo"),
    "cyrillic": ("ба", "ве", "га", "до", "же", "за", "ка", "ло", "ма", "не", "по", "ра", "со", "те", "фи", "шу"),
    "greek": ("βα", "γε", "δο", "ζα", "θε", "κα", "λο", "μα", "νε", "πο", "ρα", "σε", "τα", "φι", "χο", "ψα"),
}
#: Endings of invented names: (script, part, gender).
ENDINGS = {
    ("latin", "given", "f"): "lia", ("latin", "given", "m"): "rin", ("latin", "surname", "f"): "ner", ("latin", "surname", "m"): "ner",
    ("cyrillic", "given", "f"): "ния", ("cyrillic", "given", "m"): "слав", ("cyrillic", "surname", "f"): "ова", ("cyrillic", "surname", "m"): "ов",
    ("latin", "given", "n"): "kim", ("latin", "surname", "n"): "ner", ("cyrillic", "given", "n"): "ша", ("cyrillic", "surname", "n"): "ко", ("greek", "given", "n"): "ι", ("greek", "surname", "n"): "άκη",
    ("greek", "given", "f"): "ία", ("greek", "given", "m"): "ος", ("greek", "surname", "f"): "ίδου", ("greek", "surname", "m"): "ίδης",
}
#: Attempts at a surrogate of the value's own length.
MOST_ATTEMPTS = 20
#: Atoms that a task draws surrogates for.
DRAWN_AT_ONCE = 20_000


def kind_of(match: Column) -> Column:
    """The kind of an entity's text."""
    return F.coalesce(*[F.when(match.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()], F.lit("key"))


def secret_prefix(match: Column) -> Column:
    """What stands before the value, as in `token = "`."""
    return F.regexp_extract(match, r"^([^=:]*[=:]\s*[\"']?)", 1)


def _gender(match: Column) -> Column:
    """By the first title that tells it."""
    told = rf"^(?:(?:{NEUTRAL})\.? ){{0,2}}(?:%s)\.? "
    return F.when(match.rlike(told % FEMALE), F.lit("f")).when(match.rlike(told % MALE), F.lit("m")).otherwise(F.lit("n"))


def _names(match: Column) -> Column:
    """The words behind the titles."""
    return F.split(F.regexp_replace(match, f"^{TITLES}", ""), " ")


def _each_name(match: Column, do) -> Column:
    """do(word, whether it is the last, gender) for each word behind the titles; these are worked out once."""
    bound = F.array(F.struct(_names(match).alias("words"), _gender(match).alias("gender")))
    return F.get(F.transform(bound, lambda b: F.transform(b["words"], lambda w, i: do(w, i == F.size(b["words"]) - 1, b["gender"]))), F.lit(0))


def _named(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def _name_kind(word: Column, last: Column, gender: Column) -> Column:
    """The last word is the surname; Latin surnames are the same for all."""
    script = _script(F.lower(word))
    return F.when(last, F.concat(F.lit("surname_"), script, F.lit("_"), F.when(script == "latin", F.lit("m")).otherwise(gender))).otherwise(F.concat(F.lit("given_"), script, F.lit("_"), gender))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic")).when(value.rlike(r"^\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def atoms_of(match: Column, kind: Column) -> Column:
    """An entity's atoms: an array of (kind, value)."""

    def one(k: Column, value: Column) -> Column:
        return F.array(F.struct(k.alias("kind"), value.alias("value")))

    words = _each_name(match, lambda w, last, gender: F.struct(_name_kind(w, last, gender).alias("kind"), F.lower(w).alias("value"), _named(w).alias("own")))
    person = F.transform(F.filter(words, lambda w: w["own"]), lambda w: F.struct(w["kind"].alias("kind"), w["value"].alias("value")))
    return (
        F.when(kind == "person", person)
        .when(kind.isin("email", "ip6"), one(kind, F.lower(match)))
        .when(kind == "secret", one(F.lit("key"), F.regexp_replace(match, r"^[^=:]*[=:]\s*[\"']?", "")))
        .when(kind.isin("phone", "card", "ssn", "iban"), one(kind, F.regexp_replace(match, r"[^\p{L}\p{N}]", "")))
        .otherwise(one(kind, match))
    )


def _pick(alphabet: str, value: Column) -> Column:
    return F.substring(F.lit(alphabet), value % len(alphabet) + 1, F.lit(1))


def _mapped(value: Column, stream: Column, first: Column, skip: Column | None = None) -> Column:
    """Every character becomes another of its class, drawn with the bytes of `stream` from `skip` on; `first` characters stay."""
    def draw(by_class: bool):
        def one(c: Column, i: Column) -> Column:
            v = F.get(stream, i if skip is None else i + skip)
            if not by_class:
                return F.when(i < first, c).otherwise(_pick(HEX, v))
            return F.when(i < first, c).when(c.rlike("[0-9]"), _pick(DIGITS, v)).when(c.rlike(r"\p{Lu}"), _pick(UPPER, v)).when(c.rlike(r"\p{L}"), _pick(LOWER, v)).otherwise(c)

        return F.array_join(F.transform(F.split(value, ""), one), "")

    return F.when(value.rlike("^[0-9a-f]*+$") & value.rlike("[a-f]"), draw(False)).otherwise(draw(True))


def _luhn(body: Column) -> Column:
    """The digit that makes `body` and it a valid card number."""

    def add(acc: Column, x: Column) -> Column:
        d = x["c"].cast("int") * F.when((F.length(body) - x["i"]) % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    digits = F.transform(F.split(body, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    total = F.aggregate(digits, F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def _name(kind: Column, stream: Column, attempt: Column) -> Column:
    """An invented name: three syllables, one more for every five attempts, and the ending of its part and gender."""
    out = F.lit(None).cast("string")
    for (script, part, gender), ending in ENDINGS.items():
        sounds = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        size = F.lit(3) + F.floor(attempt / 5).cast("int")
        body = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: F.element_at(sounds, F.get(stream, i) % 16 + 1)), "")
        whole = F.concat(body, F.lit(ending))
        out = F.when(kind == f"{part}_{script}_{gender}", F.concat(F.upper(F.substring(whole, 1, 1)), whole.substr(F.lit(2), F.length(whole)))).otherwise(out)
    return out


def surrogate_of(kind: Column, value: Column, stream: Column, attempt: Column) -> Column:
    """The keyed surrogate of an atom; stream: bytes, 16 more at least than the value has characters, from key, atom and attempt."""
    local = F.substring_index(value, "@", 1)
    label = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: _pick(LOWER, F.get(stream, i + F.length(local)))), "")
    email = F.concat(_mapped(local, stream, F.lit(0)), F.lit("@"), label, F.lit(".example.com"))
    octet = [F.get(stream, F.lit(n)) for n in range(4)]
    ip = F.concat_ws(".", (octet[0] % 223 + 1).cast("string"), octet[1].cast("string"), octet[2].cast("string"), (octet[3] % 254 + 1).cast("string"))
    ip6 = F.concat(F.lit("2001:db8"), *[p for n in range(24) for p in ([F.lit(":")] if n % 4 == 0 else []) + [_pick(HEX, F.get(stream, F.lit(n)))]])
    body = _mapped(value.substr(F.lit(1), F.length(value) - 1), stream, F.lit(1))
    card = F.concat(body, _luhn(body))
    first = F.when(kind == "iban", F.lit(2)).otherwise(F.lit(0))
    named = kind.startswith("given_") | kind.startswith("surname_")
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", card).when(named, _name(kind, stream, attempt)).otherwise(_mapped(value, stream, first))
    # no value of this length is free: two digits more for every ten attempts
    more = F.array_join(F.transform(F.slice(stream, 1, F.greatest(F.lit(0), F.ceil((attempt - MOST_ATTEMPTS) / 5)).cast("int")), lambda b: (b % 10).cast("string")), "")
    return F.when((attempt > MOST_ATTEMPTS) & ~named, F.concat(out, more)).otherwise(out)


def surrogates(atoms: DataFrame, key: str) -> DataFrame:
    """`atoms` (kind, value, n; written) with distinct surrogates: kind, value, n, surrogate."""
    spark = atoms.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-atoms.count() // DRAWN_AT_ONCE))

    def drawn(rows: DataFrame) -> DataFrame:
        seed = F.sha2(F.concat_ws("\x00", F.lit(key), "kind", "value", F.col("attempt").cast("string")), 256)
        rows = rows.withColumn("__seed", seed).repartition(tasks, "kind", "value")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil((F.length("value") + 16) / 32).cast("int")), lambda b: F.sha2(F.concat("__seed", b.cast("string")), 256))
        pairs = F.regexp_extract_all(F.array_join(blocks, ""), F.lit(".."), F.lit(0))
        rows = rows.withColumn("__stream", F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int")))
        return rows.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("value"), F.col("__stream"), F.col("attempt"))).drop("__seed", "__stream")

    real = atoms.select("kind", F.lower("value").alias("shown"), F.lit(True).alias("real"))
    table = written(drawn(atoms.withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        # of the atoms with one surrogate the smallest value keeps it; none may look like a real value of its kind
        first = table.groupBy("kind", F.lower("surrogate").alias("shown")).agg(F.min(F.struct("attempt", "value")).alias("owner"), F.count(F.lit(1)).alias("k"))
        taken = first.join(real, ["kind", "shown"], "left").where("k > 1 or real").select(F.col("kind").alias("__kind"), F.col("shown").alias("__shown"), F.when(F.col("real"), None).otherwise(F.col("owner.value")).alias("__owner"), F.lit(True).alias("__met"))
        if taken.isEmpty():
            return table.drop("attempt")
        joined = table.join(taken, (F.col("kind") == F.col("__kind")) & (F.lower("surrogate") == F.col("__shown")), "left")
        again = F.col("__met") & ~F.col("value").eqNullSafe(F.col("__owner"))
        moved = joined.select("kind", "value", "n", F.when(F.coalesce(again, F.lit(False)), F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))
        table = written(drawn(moved), "surrogates")


def _placed(match: Column, core: Column) -> Column:
    """`core` character by character in place of the letters and digits of `match`; what `core` has more goes behind."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        own = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(acc["s"], F.when(own, F.substring(core, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("s"), F.when(own, acc["k"] + 1).otherwise(acc["k"]).alias("k"))

    return F.aggregate(F.split(match, ""), start, step, lambda acc: F.concat(acc["s"], core.substr(acc["k"] + 1, F.length(core))))


def replacement(match: Column, kind: Column, known: Column) -> Column:
    """An entity's replacement; known: map of kind and value, with a zero byte between, to surrogate. A name in capitals stays so."""
    cores = F.transform(atoms_of(match, kind), lambda a: F.element_at(known, F.concat(a["kind"], F.lit("\x00"), a["value"])))

    def shown(w: Column, last: Column, gender: Column) -> Column:
        core = F.element_at(known, F.concat(_name_kind(w, last, gender), F.lit("\x00"), F.lower(w)))
        initials = F.regexp_replace(w, r"\p{Lu}", F.substring(core, 1, 1))
        return F.when(~_named(w), w).when(w.endswith("."), initials).when(w == F.upper(w), F.upper(core)).otherwise(core)

    return (
        F.when(kind == "person", F.concat(F.regexp_extract(match, f"^{TITLES}", 0), F.array_join(_each_name(match, shown), " ")))
        .when(kind == "secret", F.concat(secret_prefix(match), F.get(cores, F.lit(0))))
        .when(kind.isin("phone", "card", "ssn", "iban"), _placed(match, F.get(cores, F.lit(0))))
        .otherwise(F.get(cores, F.lit(0)))
    )


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with the column `text_col` rewritten and n_entities (long) added; all other columns stay.

    Null and empty texts stay as they are, with 0 entities; repeated rows are rewritten alike. A column n_entities of
    `docs` is replaced; other names may be those used here. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    matches = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    scanned = written(docs.select(F.struct(*names).alias("row"), F.monotonically_increasing_id().alias("uid"), matches.alias("matches")), "scanned")
    found = scanned.where(F.size("matches") > 0)
    uses = found.select("uid", F.posexplode("matches").alias("pos", "entity"))
    entities = written(uses.groupBy("entity").agg(F.count(F.lit(1)).alias("uses")).withColumn("type", kind_of(F.col("entity"))), "entities")
    atoms = entities.select("entity", "type", "uses", F.explode(F.array_distinct(atoms_of(F.col("entity"), F.col("type")))).alias("a")).select("entity", "type", "uses", "a.kind", "a.value")
    table = surrogates(written(atoms.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")), "atoms"), key)
    met = hot_aware_join(atoms, table, ["kind", "value"], "n", F.xxhash64("entity"))
    known = F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit("\x00"), "value"), F.col("surrogate"))))
    replaced = written(met.groupBy("entity", "type").agg(F.max("uses").alias("n"), known.alias("known")).select("entity", "n", replacement(F.col("entity"), F.col("type"), F.col("known")).alias("new")), "replaced")
    done = hot_aware_join(uses, replaced, ["entity"], "n", F.xxhash64("uid", "pos"))
    done = done.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("new"))  # a text's own
    parts = F.split(F.col(f"row.`{text_col}`"), ANY, -1)
    rows = found.join(done, "uid").withColumn("parts", parts)
    whole = F.array_join(F.transform("parts", lambda s, i: F.concat(s, F.coalesce(F.get(F.col("new"), i), F.lit("")))), "")
    rows = rows.select(*[whole.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names], F.size("matches").cast("long").alias("n_entities"))
    clean = scanned.where(F.size("matches") == 0).select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.lit(0).cast("long").alias("n_entities"))
    return clean.unionByName(rows)
