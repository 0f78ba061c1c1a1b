"""Personal data: patterns, and terms that give away what the patterns protect.

Base kinds are e-mail addresses, IP addresses, card numbers and phone numbers. Beyond them, corpus co-occurrence tells how
strongly the terms of a document reveal a protected value in it: events are documents, PMI(value, term) = log2(n(value, term) N /
(n(value) n(term))), and a term whose PMI is at least `disclosure` of the value's own information -log2(n(value) / N) is a span
of kind `term` in every document that holds the value, however far from it. All four counts are sums over the same documents,
each with its weight: exact copies weigh one document together, and so do near copies (by min-hashes of their terms) among the
texts that hold a value of several texts, so copying alone reveals nothing; `support` is the least n(value, term).
Sanitising generalises spans to the kind's label.

Only DataFrame expressions are used. Single separators and inner dots are marked first, so every pattern is a run of character
classes: Java's matcher then needs no stack and no second look at long runs.

Nulls: a null text counts as empty, without spans. Null ids and repeated rows stay. Spans are code points, the end exclusive;
spans of different kinds may overlap, those that start together are in the order of kinds. Texts of any length are read whole.
Without rows nothing is learned. Further columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import cut, fresh
from loomwork.llm.graph import components

KINDS = ("email", "ip", "card", "phone", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
#: Marks of one code point each for a separator between digits and a dot between domain labels; in texts they are replaced.
SEP, DOT, OTHER = "\ue000", "\ue001", "\u00a4"
_LOCAL = f"A-Za-z0-9._%+{DOT}-"
EMAIL = f"(?:\\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
CARD = f"[0-9{SEP}]{{12,}}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"[^\x20\x09-\x0D]+"
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"
SUPPORT, DISCLOSURE = 4, 0.6
#: Min-hashes of a band and bands: texts that share a band are near copies (0.997 of those of similarity 0.8, 0.008 at 0.1).
BAND, BANDS = 3, 8
#: Rows of keys and terms up to which they are broadcast: some hundred bytes each.
SMALL = 100_000


def places(text: Column, pattern: str, kind: int) -> Column:
    """The spans of all matches: what lies between matches and the matches themselves, laid end to end."""
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.array().cast(SPAN)

    def step(acc, x):
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), F.lit(kind).alias("kind"), b.alias("stop"), x["hit"].alias("value")))).cast(SPAN).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Every second digit from the right doubled, less 9 above 9; the sum ends in 0."""
    back = F.reverse(number)

    def worth(i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(back)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(docs: DataFrame, text_col: str = "text", out: str = "base") -> DataFrame:
    """docs with `out`: the spans of the base kinds, by start and then kind."""
    none = F.array().cast(SPAN)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.when(t.contains(SEP) | t.contains(DOT), F.translate(t, SEP + DOT, OTHER * 2)).otherwise(t)
    text, digit, mail, email, ip, card, phone = (fresh([*docs.columns, out], f"_{x}") for x in ("text", "digit", "mail", "email", "ip", "card", "phone"))
    df = docs.withColumn(text, plain)
    t = F.col(text)
    df = df.withColumns({
        digit: F.when(t.rlike("[0-9]"), F.regexp_replace(t, "(?<=[0-9])[ -](?=[0-9])", SEP)),
        mail: F.when(t.contains("@"), F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)),
    })
    df = df.withColumns({
        email: F.when(F.col(mail).isNotNull(), places(F.col(mail), EMAIL, 0)).otherwise(none),
        ip: F.when(t.rlike(IP), places(t, IP, 1)).otherwise(none),
        card: F.when(F.col(digit).rlike(CARD), places(F.col(digit), CARD, 2)).otherwise(none),
        phone: F.when(t.rlike(PHONE), places(t, PHONE, 3)).otherwise(none),
    })

    def is_card(x):
        n = digits(x["value"])
        return F.when(F.length(n).between(12, 19), luhn(n)).otherwise(False)

    df = df.withColumn(out, F.array_sort(F.concat(
        F.transform(F.col(email), lambda x: x.withField("value", F.translate(x["value"], DOT, "."))),
        F.filter(ip, lambda x: x["value"].rlike(IP_PARTS)),
        F.filter(card, is_card),
        F.filter(phone, lambda x: F.length(digits(x["value"])).between(9, 15)),
    )))
    return df.drop(text, digit, mail, email, ip, card, phone)


def entity(span: Column) -> Column:
    """A protected value whatever its writing: lower-case addresses, numbers by their digits."""
    return F.xxhash64(span["kind"], F.when(span["kind"] < 2, F.lower(span["value"])).otherwise(digits(span["value"])))


def terms_of(words: Column) -> Column:
    """Distinct words in lower case without marks around them, two characters at least and no numbers."""
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) > 1) & w.rlike(r"\p{L}")))


def key_of(text: Column) -> Column:
    return F.xxhash64(F.lit(5), text)


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def words_of(text: Column) -> Column:
    return terms_of(F.split(text, r"[\x20\x09-\x0D]+"))


def holders(texts: DataFrame, support: int) -> DataFrame:
    """texts(key, text) -> key, entity: the values that at least `support` different texts hold, and these texts."""
    found = base_spans(texts, "text", "base").where(F.size("base") > 0).select("key", F.array_distinct(F.transform("base", entity)).alias("entities"))
    held = cut(found.groupBy("key").agg(F.first("entities").alias("entities")), "held").select("key", F.explode("entities").alias("entity"))
    several = held.groupBy("entity").agg(F.count("*").alias("texts")).where(F.col("texts") >= support).select("entity")
    return cut(held.join(small(cut(several, "several")), "entity"), "holders")


def near_copies(terms: DataFrame) -> DataFrame:
    """terms(key, terms) -> node, root: texts that share a band of min-hashes, directly or by others."""
    hashed = lambda k: lambda w: F.xxhash64(F.lit(k), w)
    least = [F.array_min(F.transform("terms", hashed(k))) for k in range(BAND * BANDS)]
    bands = F.array(*(F.xxhash64(F.lit(i), *least[i * BAND : (i + 1) * BAND]) for i in range(BANDS)))
    of = cut(terms.where(F.size("terms") > 0).select("key", F.explode(bands).alias("band")), "bands")
    hubs = of.groupBy("band").agg(F.min("key").alias("hub"), F.max("key").alias("last")).where("hub <> last")
    return components(of.join(hubs, "band").where("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")))


def revealing(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """entity, term, pmi, information: the terms that give a protected value away; and (key, entity) of the texts that hold these values."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(key_of(F.col("text")).alias("key"), "text")
    held = holders(texts, support)
    schema = "entity long, term string, pmi double, information double"
    if held.isEmpty():
        return docs.sparkSession.createDataFrame([], schema), held
    keys = small(cut(held.select("key").distinct(), "keys"))
    terms = cut(texts.join(keys, "key").groupBy("key").agg(F.first("text").alias("text")).select("key", words_of(F.col("text")).alias("terms")), "terms")
    # weights: one document for all copies of a text, and for all near copies of those that hold a value
    copies = cut(texts.groupBy("key").agg(F.count("*").alias("copies")), "copies")
    placed = copies.join(near_copies(terms).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = placed.groupBy("root").agg(F.sum("copies").alias("rows"))
    total = sizes.count()
    uneven = cut(placed.join(sizes.where("rows > 1"), "root").select("key", "copies", (1.0 / F.col("rows")).alias("w")), "uneven")
    weight = held.join(uneven, "key", "left").select("key", "entity", F.coalesce(F.col("copies") * F.col("w"), F.lit(1.0)).alias("w"))
    n_entity = weight.groupBy("entity").agg(F.sum("w").alias("n_entity"))
    each = weight.join(terms, "key").select("entity", "w", F.explode("terms").alias("term"))
    pairs = cut(each.groupBy("entity", "term").agg(F.sum("w").alias("together")).where(F.col("together") >= support - 1e-9), "pairs")
    asked = small(cut(pairs.select("term").distinct(), "asked"))
    all_words = texts.join(small(uneven.select("key", "w")), "key", "left").select(F.coalesce("w", F.lit(1.0)).alias("w"), F.explode(words_of(F.col("text"))).alias("term"))
    n_term = all_words.join(asked, "term").groupBy("term").agg(F.sum("w").alias("n_term"))
    got = pairs.join(n_term, "term").join(n_entity, "entity")
    got = got.withColumns({"pmi": F.log2(F.col("together") * float(total) / (F.col("n_entity") * F.col("n_term"))), "information": F.log2(float(total) / F.col("n_entity"))})
    return cut(got.where((F.col("pmi") > 0) & (F.col("pmi") >= disclosure * F.col("information"))).select("entity", "term", "pmi", "information"), "revealing"), held


def find(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, text_col: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """docs with columns `base` and `spans` (base and terms), each array<struct<start, kind, stop, value>> in order; docs may not have these names."""
    tell, held = revealing(docs, support, disclosure, text_col)
    key, terms = fresh([*docs.columns, base, spans], "_key"), fresh([*docs.columns, base, spans], "_terms")
    by_text = cut(held.join(small(tell.select("entity", "term")), "entity").groupBy("key").agg(F.collect_set("term").alias(terms)).withColumnRenamed("key", key), "by_text")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = base_spans(docs, text_col, base).withColumn(key, key_of(text)).join(small(by_text), key, "left")
    hit = F.filter(places(text, WORD, 4), lambda x: F.size(F.array_intersect(terms_of(F.array(x["value"])), F.col(terms))) > 0)
    own = F.filter(hit, lambda x: ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return df.withColumn(spans, F.when(F.col(terms).isNull(), F.col(base)).otherwise(F.array_sort(F.concat(base, own)))).drop(key, terms)


def clean(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs with all their columns; spans of the text are generalised to their labels."""
    base, spans = fresh(docs.columns, "base"), fresh(docs.columns, "spans")
    return sanitise(find(docs, text_col=text_col, base=base, spans=spans, **how), text_col, spans).select(*(F.col(f"`{c}`") for c in docs.columns))


def spell(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def sanitise(found: DataFrame, text_col: str = "text", spans: str = "spans") -> DataFrame:
    """found (see `find`) with each span of the text generalised to its label; what overlaps becomes one label."""
    labels, text = F.array(*map(F.lit, LABELS)), F.col(text_col)

    def step(acc, x):
        new = x["start"] >= acc["at"]
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(labels, x["kind"] + 1))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(new, put).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text))
