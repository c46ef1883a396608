"""Operator 2 [native] - surrogates for personal data.

Entities are found by patterns: e-mail addresses, phone numbers, payment cards
(valid check digit), social security numbers, IPv4 addresses, access keys and
assigned secrets, and names behind a title.  Each distinct entity gets a
surrogate drawn from a keyed SHA-512 stream: same kind, same length and
format, valid check digit, a name of the same gender and script; a secret
whose format has no or too few others is drawn in letters of its script, of
the same length and then longer.  Entities
written differently but equal once normalised (a phone with or without
separators) share their surrogate, everywhere in the corpus.

Names are kept part by part: the last word behind a title is a family name,
the one before it a given name of the title's gender, and each part has one
surrogate in the whole corpus.  Within a document the parts found behind
titles are replaced wherever they stand as words, so 'Mr John Smith', 'Mr
Smith', 'John Smith' and 'Smith' stay one person; a single word behind a title
that is a given name elsewhere in the document is taken for it.  A part that
no title introduces in its document is not found.  Surrogates are
checked against each other and against the real entities: of entities that
drew the same one a single entity keeps it, the others draw anew, until all
are distinct.  The table of distinct entities is distributed throughout, and
only built-in functions run.

Defined results: a null text stays null; texts without entities stay as they
are; numbers that fail the check digit are no cards; repeated rows are each
replaced alike; of entities that drew the same surrogate the smallest keeps
it; a very long text is searched and rewritten whole, in its row; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlens.llm.common import Scratch, located, table

_TITLES = {"m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа"]}
_TITLE = "|".join(sorted((t for ts in _TITLES.values() for t in ts), key=len, reverse=True))
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?"
PATTERNS = {
    "assigned": _SECRET + r"[^\s\"']{6,}",
    "key": _EDGE + r"AKIA[0-9A-Z]{16}" + _END,
    "email": r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{1,64}@[0-9A-Za-z-]{1,63}(?:\.[0-9A-Za-z-]{1,63}){0,8}\.[A-Za-z]{2,24}" + _END,
    "ip": r"(?<![0-9A-Za-z.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": _EDGE + r"(?:[0-9]{4}[ -]){3}[0-9]{4}" + _END + "|" + _EDGE + r"[0-9]{13,19}" + _END,
    "phone": r"(?<![0-9A-Za-z+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _END,
    "name": r"(?<![\p{L}])(?:" + _TITLE + r")\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity has a digit or one of these; texts without them are not searched.
MAYBE = r"[0-9@=:]|(?:" + _TITLE + r")\.? \p{Lu}"

#: Syllables of surrogate names by script; given names end by gender.
SYLLABLES = {
    "latin": (["ba", "de", "fi", "ga", "ho", "ju", "ka", "le", "mi", "no", "pe", "ra", "sa", "ti", "vo", "za"], {"m": "n", "f": "a"}),
    "cyrillic": (["ба", "де", "фи", "га", "хо", "жу", "ка", "ле", "ми", "но", "пе", "ра", "са", "ти", "во", "за"], {"m": "н", "f": "а"}),
    "greek": (["βα", "δε", "φι", "γα", "χο", "ζυ", "κα", "λε", "μι", "νο", "πε", "ρα", "σα", "τι", "βο", "ζα"], {"m": "ς", "f": "α"}),
}
NAME_PARTS = ("family", "given_m", "given_f")
#: What secrets are drawn from.
CYRILLIC, GREEK = "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _ends_at(digits: Column, doubled_from: int = 1) -> Column:
    """Luhn sum of a digit string; doubled_from 1 doubles every second digit from the right, 0 the right one too."""
    def add(total, i):
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == (1 if doubled_from else 0), twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def entities(found: DataFrame) -> DataFrame:
    """Adds kind and norm to rows with ``value``; kind is null for what is no entity after all."""
    v = F.col("value")
    kind = reduce(lambda rest, k: F.when(v.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(rest), reversed(PATTERNS), F.lit(None))
    d = _digits(v)
    norm = (F.when(F.col("kind") == "assigned", F.regexp_replace(v, "^" + _SECRET, ""))
            .when(F.col("kind") == "email", F.lower(v)).when(F.col("kind").isin("ssn", "card"), d)
            .when(F.col("kind") == "phone", F.substring(d, F.greatest(F.lit(1), F.length(d) - 9), F.lit(10)))
            .otherwise(v))
    out = found.withColumn("kind", kind)
    out = out.withColumn("kind", F.when((F.col("kind") == "card") & (_ends_at(d) % 10 != 0), None).otherwise(F.col("kind")))
    return out.withColumn("norm", F.when(F.col("kind").isNotNull(), norm))


def name_parts(found: DataFrame) -> DataFrame:
    """(file, row, word, kind, norm): the name parts of each document; kind is family, given_m or given_f."""
    v = F.col("value")
    words = F.split(F.regexp_replace(v, rf"^(?:{_TITLE})\.? ", ""), " ")
    gender = F.when(F.regexp_extract(v, f"^(?:{_TITLE})", 0).isin(_TITLES["f"]), "given_f").otherwise("given_m")
    named = found.where("kind = 'name'").select("file", "row", F.array(
        F.struct(F.element_at(words, -1).alias("word"), F.lit("family").alias("kind")),
        F.when(F.size(words) > 1, F.struct(words[0].alias("word"), gender.alias("kind")))).alias("parts"))
    parts = named.select("file", "row", F.explode(F.filter("parts", lambda p: p.isNotNull())).alias("p"))
    # a word is one part of its document: a given name if it ever is one
    return (parts.groupBy("file", "row", F.col("p.word").alias("word")).agg(F.max("p.kind").alias("kind"))
            .withColumn("norm", F.lower("word")))


def surrogate(key: str, attempt: int) -> Column:
    """The surrogate of (kind, norm) at the given attempt."""
    norm, kind = F.col("norm"), F.col("kind")
    seed = F.concat_ws("|", F.lit(key), kind, norm, F.lit(str(attempt)))
    stream = F.concat(F.sha2(F.concat(seed, F.lit("#0")), 512), F.sha2(F.concat(seed, F.lit("#1")), 512))

    def byte(i: Column) -> Column:  # two hex digits of the stream, of which there are 128 pairs
        return F.conv(F.substring(F.col("stream"), (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def pick(letters: str, i: Column) -> Column:
        return F.substring(F.lit(letters), byte(i) % len(letters) + 1, F.lit(1))

    def shaped(text: Column, hexadecimal: bool = False) -> Column:
        def one(c, i):
            if hexadecimal:
                return pick("0123456789abcdef", i)
            return (F.when(c.rlike("[0-9]"), pick("0123456789", i)).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i))
                    .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).otherwise(other(c, i)))

        def other(c, i):  # letters and digits beyond ASCII
            return (F.when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), pick(CYRILLIC.upper(), i)).otherwise(pick(CYRILLIC, i)))
                    .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), pick(GREEK.upper(), i)).otherwise(pick(GREEK, i)))
                    .when(c.rlike(r"\p{N}"), pick("0123456789", i)).when(c.rlike(r"\p{Lu}"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
                    .when(c.rlike(r"[\p{L}\p{M}]"), pick("abcdefghijklmnopqrstuvwxyz", i)).otherwise(c))

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def drawn(length: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), length - 1), lambda i: pick("0123456789", i)), "")

    phone = F.concat(pick("23456789", F.lit(100)), drawn(F.lit(2)), pick("23456789", F.lit(101)),
                     F.substring(drawn(F.lit(10)), 5, 6))
    body = F.concat(F.substring(norm, 1, 1), drawn(F.length(norm) - 2))
    card = F.concat(body, F.pmod(-_ends_at(body, 0), F.lit(10)).cast("string"))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (byte(i) % 254 + 1).cast("string")), ".")
    domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(norm, "@", -1)), 256)
    more = shaped(F.lit("abcdefgh")) if attempt >= 4 else F.lit("")  # short local parts run out of names
    email = F.concat(shaped(F.substring_index(norm, "@", 1)), more, F.lit("@h"), F.substring(domain, 1, 10), F.lit(".example.com"))

    def free(letters: str) -> Column:  # any of the letters at every place: first of the same length, then longer
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(norm) + 4 * max(0, attempt - 7)), lambda i: pick(letters, i)), "")

    anew = F.when(norm.rlike(r"\p{IsCyrillic}"), free(CYRILLIC)).when(norm.rlike(r"\p{IsGreek}"), free(GREEK)).otherwise(free(ALNUM))
    secret = anew
    if attempt < 4:  # a secret of marks alone has no other of its shape, and a shape may have few
        secret = (F.when(norm.rlike("^[0-9a-f]+$"), shaped(norm, True)).when(norm.rlike(r"[\p{L}\p{N}]"), shaped(norm)).otherwise(anew))
    script = F.when(norm.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")

    def name_in(syllables: list[str], ends: dict[str, str]) -> Column:
        def some(n: int) -> Column:
            return F.concat(*(F.element_at(F.array(*map(F.lit, syllables)), byte(F.lit(i)) % len(syllables) + 1) for i in range(n)))

        longer = attempt // 3
        return F.when(kind == "family", some(4 + longer)).otherwise(
            F.concat(some(2 + longer), F.when(kind == "given_f", ends["f"]).otherwise(ends["m"])))

    name = reduce(lambda rest, s: F.when(script == s, name_in(*SYLLABLES[s])).otherwise(rest), SYLLABLES, F.lit(None))
    made = (F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", drawn(F.lit(9))).when(kind == "ip", ip)
            .when(kind == "email", email).when(kind == "key", F.concat(F.lit("AKIA"), shaped(F.substring(norm, 5, 16))))
            .when(kind.isin(*NAME_PARTS), name).otherwise(secret))
    return F.transform(F.array(stream), lambda s: s)[0], made


def assign(distinct: DataFrame, key: str, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(kind, norm, surrogate) for the distinct (kind, norm): no two alike, none a real entity."""
    # all name parts share one space: a surrogate given name is no real family name either
    space = F.when(F.col("kind").isin(*NAME_PARTS), "name").otherwise(F.col("kind"))
    real = distinct.select(space.alias("space"), F.col("norm").alias("surrogate")).distinct()
    pending, taken = distinct, None
    for attempt in range(rounds):
        stream, made = surrogate(key, attempt)
        drawn = pending.withColumn("stream", stream).withColumn("surrogate", made).drop("stream").withColumn("space", space)
        drawn = drawn.join(real, ["space", "surrogate"], "left_anti")
        if taken is not None:
            drawn = drawn.join(taken.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        first = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("kind", "norm")).alias("who"))
        won = scratch.write(first.select("space", "surrogate", "who.kind", "who.norm"), f"won-{attempt}")
        taken = won if taken is None else taken.unionByName(won)
        pending = scratch.write(pending.join(won, ["kind", "norm"], "left_anti"), f"pending-{attempt}")
        if pending.isEmpty():
            return taken.drop("space")
    raise ValueError("a format has too few surrogates for the entities written in it")


def rendered() -> Column:
    """The surrogate in the format of the value it stands for."""
    v, s, kind = F.col("value"), F.col("surrogate"), F.col("kind")

    def digit(c, i):  # digits are replaced from the right, so a country code in front stays
        left = F.length(_digits(F.substring(v, i + 1, F.length(v))))
        return F.when(c.rlike("[0-9]") & (left <= F.length(s)), F.substring(s, F.length(s) - left + 1, F.lit(1))).otherwise(c)

    digits = F.array_join(F.transform(F.split(v, ""), digit), "")
    assigned = F.concat(F.substring(v, F.lit(1), F.length(v) - F.length("norm")), s)
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "assigned", assigned).otherwise(F.coalesce(s, v))


def renamed(text: Column, parts: Column) -> Column:
    """``text`` with each of the document's name parts (word, new) replaced where it stands as a word.

    No surrogate is a real part, so what one replacement puts in no other one finds."""
    return F.aggregate(F.coalesce(parts, F.array().cast(PARTS)), text, lambda t, p: F.regexp_replace(
        t, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), p["word"], F.lit(r"(?![\p{L}\p{N}])")), p["new"]))


PARTS = "array<struct<word:string,new:string>>"


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text with surrogates, n_entities."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    try:
        rows = located(docs, scratch, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        searched = rows.where(F.col("text").rlike(MAYBE))
        found = searched.select("file", "row", F.posexplode(F.regexp_extract_all("text", F.lit(ALL), F.lit(0))).alias("pos", "value"))
        found = scratch.write(entities(found), "found")
        parts = scratch.write(name_parts(found), "parts")
        distinct = scratch.write(found.where("kind IS NOT NULL AND kind <> 'name'").select("kind", "norm")
                                 .unionByName(parts.select("kind", "norm")).distinct(), "distinct")
        chosen = assign(distinct, key, scratch)
        # a document has few names; each comes once
        people = (parts.join(chosen, ["kind", "norm"]).groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct(
            F.col("word"), F.initcap("surrogate").alias("new")))).alias("parts")))
        new = (found.join(chosen, ["kind", "norm"], "left").withColumn("new", rendered()).groupBy("file", "row")
               .agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("kind") == "name").alias("name"), "new"))).alias("new"),
                    F.count("kind").alias("n")).join(people, ["file", "row"], "left"))
        # a name is rewritten by its parts, as the text between the entities is
        new = new.withColumn("new", F.transform("new", lambda x: F.when(x["name"], renamed(x["new"], F.col("parts"))).otherwise(x["new"])))
        # only what stands in the texts is kept; the real values go with the scratch folder
        new = scratch.finish(new.where("n > 0")) if not scratch.holds("copy") else new.where("n > 0")
    except BaseException:
        scratch.remove()
        raise
    pieces = F.when(F.col("parts").isNull(), F.split("text", ALL, -1)).otherwise(
        F.transform(F.split("text", ALL, -1), lambda x: renamed(x, F.col("parts"))))
    text = F.array_join(F.zip_with(pieces, F.concat(F.col("new"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = searched.join(new, ["file", "row"], "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce("n", F.lit(0)).alias("n_entities"))
    clean = rows.where(~F.coalesce(F.col("text").rlike(MAYBE), F.lit(False)))
    out = changed.unionByName(clean.select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))
    return scratch.finish(out) if scratch.holds("copy") else out


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), key="corpus-2024")
