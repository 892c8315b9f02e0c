"""Personal data and the terms that give it away, by information content.

DataFrame functions throughout. Patterns find e-mail addresses, IP addresses, card and phone
numbers. Each distinct value is a protected entity. Corpus statistics then say how strongly a term
in the same text as an entity reveals it: the information about the entity that the term gives is
log(p / p0), with p the share of the term's documents that hold the entity, and p0 the entity's share of all
documents. A term is generalised to its class beyond one threshold of p, removed beyond a higher
one, wherever in the text it stands; both need at least log(``LIFT``) nats as well, so that an entity that stands
nearly everywhere makes no term telling.

How often a term comes with the entity is only known from the texts at hand, so p is a lower
confidence bound: few different texts prove little, and copies prove no more than one text. Every
rare word of a text meets every entity of it, so the first text that shows a pair proves nothing; only
further ones count. Unrelated documents change p0 alone: no verdict turns on how many there are.

Spans and terms of the texts that hold an entity leave the first pass, and only counts of terms the
second. Entities that stand in the same texts have the same counts with every term, so they are one
class, and so are terms; a text meets its pairs of classes, not of names. A list of thousands of
addresses in one text is one class. Counts combine before their shuffles, so a value or term that a
third of all documents hold is one row a task.

Every pattern is linear: a run is tried from its first character only and never given back, which
finds the same leftmost matches, since what follows the run decides and is the same for all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .rows import text_key, whole_text

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # a match may begin where the one before ended, inside a run
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A byte without which a text has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Stands for a character of a base span. A term is a whole run that touches none.
FILL = "\uffff"
TERM = rf"(?<![\p{{L}}\p{{N}}{FILL}])[\p{{L}}\p{{N}}]{{3,}}+(?!{FILL})"
#: Shares of a term's documents with the entity, and the normal quantile of the one-sided bound (95 %) on what the texts prove.
GENERALISE, REMOVE, SURE = 0.25, 0.5, 1.645
#: How many times likelier the term must make the entity.
LIFT = 2.0


def _spans(matches: Column, gaps: Column) -> Column:
    """Matches with their places, in code points: struct(start, end, value).

    Stretches of about the root of all are placed each by itself, so that no long list is copied
    for every match.
    """
    nothing = F.array().cast("array<struct<start:int,end:int,value:string>>")
    n = F.size(matches)
    step = F.ceil(F.sqrt(n)).cast("int")
    stretches = F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int"))

    def pairs(i: Column) -> Column:
        of = lambda x: F.slice(x, i * step + 1, F.least(step, n - i * step))
        return F.zip_with(of(gaps), of(matches), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))

    def add(so_far: Column, pair: Column) -> Column:
        start = so_far["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        found = F.concat(so_far["found"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("value"))))
        return F.struct(end.alias("at"), found.alias("found"))

    lengths = F.transform(stretches, lambda i: F.aggregate(pairs(i), F.lit(0), lambda t, p: t + F.length(p["gap"]) + F.length(p["match"])))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
    begins = F.aggregate(
        lengths, begin, lambda x, n: F.struct((x["at"] + n).alias("at"), F.concat(x["begins"], F.array(x["at"])).alias("begins")), lambda x: x["begins"]
    )
    placed = F.zip_with(stretches, begins, lambda i, at: F.aggregate(pairs(i), F.struct(at.alias("at"), nothing.alias("found")), add, lambda x: x["found"]))
    return F.when(n > 0, F.flatten(placed)).otherwise(nothing)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def worth(i: Column) -> Column:      # i counts from the right
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern is a value of that kind."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits(value)).between(13, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _of_kind(kind: str, spans: Column) -> Column:
    """The spans whose value is one of the kind, with the kind in front."""
    right = F.filter(spans, lambda s: valid(kind, s["value"]))
    return F.transform(right, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def entity(span: Column) -> Column:
    """What makes two spans the same protected entity: kind, and value without its punctuation."""
    plain = F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _filled(text: Column, base: Column) -> Column:
    """The text with FILL for every character of a base span."""
    def write(so_far: Column, s: Column) -> Column:
        start, end = F.greatest(s["start"], so_far["at"]), F.greatest(s["end"], so_far["at"])
        piece = F.concat(F.substring(text, so_far["at"] + 1, start - so_far["at"]), F.repeat(F.lit(FILL), end - start))
        return F.struct(end.alias("at"), F.concat(so_far["text"], F.array(piece)).alias("text"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("text"))
    spans = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(spans, begin, write, lambda x: F.concat(F.array_join(x["text"], ""), F.substring(text, x["at"] + 1, F.length(text))))


def find_base(docs: DataFrame) -> DataFrame:
    """(doc, k1, k2, base, terms) for every row: its base spans, and the terms of a text that has some.

    ``base`` holds struct(kind, start, end, value) by kind as listed, then start; ``terms`` holds
    struct(term, start, end), none of them touching a base span. ``k1, k2`` stand for the text.
    """
    k1, k2 = text_key(whole_text())
    found = docs.select(F.col("doc_id").cast("long").alias("doc"), k1.alias("k1"), k2.alias("k2"), whole_text().alias("whole"))
    for kind in KINDS:
        matches = F.regexp_extract_all("whole", F.lit(PATTERNS[kind]), F.lit(0))
        if NEEDS[kind]:
            matches = F.when(F.contains("whole", F.lit(NEEDS[kind])), matches).otherwise(F.array().cast("array<string>"))
        found = found.withColumn(kind, matches)
    for kind in KINDS:
        gaps = F.when(F.size(kind) > 0, F.split("whole", PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>"))
        found = found.withColumn(f"{kind}_gaps", gaps)
    spans = [_of_kind(kind, _spans(F.col(kind), F.col(f"{kind}_gaps"))) for kind in KINDS]
    found = found.withColumn("base", F.concat(*spans))
    found = found.withColumn("filled", F.when(F.size("base") > 0, _filled(F.col("whole"), F.col("base"))).otherwise(""))
    found = found.withColumn("words", F.regexp_extract_all("filled", F.lit(TERM), F.lit(0))).withColumn("word_gaps", F.split("filled", TERM, -1))
    terms = F.transform(_spans(F.col("words"), F.col("word_gaps")), lambda t: F.struct(F.lower(t["value"]).alias("term"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select("doc", "k1", "k2", "base", terms.alias("terms"))


def least_share(seen: Column, texts: Column) -> Column:
    """The Wilson lower bound of a share that was ``seen`` where ``texts`` different texts show the pair.

    The first of them is how the pair was met, so one less is what they prove; one text proves nothing.
    """
    m, z = (texts - 1) / seen, F.lit(SURE)
    bound = (seen + z * z / (2 * m) - z * F.sqrt(seen * (1 - seen) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    return F.when(texts > 1, bound).otherwise(0.0)


def _named_texts(texts: DataFrame, names: str) -> DataFrame:
    """(k1, k2, n, name) rows of a column of names, with ``n_held``, the name's documents, and ``c1, c2``, which stand for its texts."""
    rows = texts.select("k1", "k2", "n", F.explode(names).alias("name"))
    told = rows.groupBy("name").agg(F.sum("n").alias("n_held"), *[F.bit_xor(F.xxhash64("k1", "k2", F.lit(i))).alias(f"c{i}") for i in (1, 2)])
    return rows.join(told, "name")


def disclosing_terms(docs: DataFrame, base: DataFrame, share: float = GENERALISE) -> DataFrame | None:
    """(k1, k2, term, share) of terms that give an entity of the text away by ``share`` or more; None if none can.

    share is ``least_share`` of n(c,t) / n(t), counts of documents: n(t) with the term, n(c,t) with
    the entity too. It must also be ``LIFT`` times the entity's share of all documents. Of a text's
    entities the one counts that the term gives away most.
    """
    held = base.filter(F.size("base") > 0).select(
        "k1", "k2", F.array_distinct(F.transform("base", entity)).alias("entities"), F.array_distinct(F.transform("terms", lambda t: t["term"])).alias("words")
    )
    texts = stage(held.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("words").alias("words")), "texts")
    if texts.isEmpty():
        return None
    n = float(base.count())
    entities = _named_texts(texts, "entities").filter(F.col("n_held") < n)
    entities = entities.select("k1", "k2", "n", F.col("c1").alias("e1"), F.col("c2").alias("e2"), F.col("n_held").alias("n_entity")).distinct()
    own = _named_texts(texts, "words").withColumnRenamed("name", "term").drop("n", "n_held")
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(whole_text(), F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    # counted before the join: a join of the words themselves would grow with both sides
    n_term = words.groupBy("term").agg(F.count("*").alias("n_term")).join(own.select("term").distinct(), "term", "left_semi")
    own = stage(own.join(n_term, "term"), "terms")
    kind = ["c1", "c2", "n_term"]
    # n(c,t) is n(c) at most: with more documents than this the term is below the share whatever the texts say
    met = entities.join(own.select("k1", "k2", *kind).distinct(), ["k1", "k2"]).filter(F.col("n_term") <= F.col("n_entity") / share * 1.000001)
    met = stage(met, "pairs")
    pairs = met.groupBy("e1", "e2", "n_entity", *kind).agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"))
    told = least_share(F.col("n_both") / F.col("n_term"), F.col("texts"))
    scored = pairs.select("e1", "e2", "n_entity", *kind, told.alias("share")).filter((F.col("share") >= share) & (F.col("share") >= LIFT * F.col("n_entity") / n))
    telling = met.join(scored, ["e1", "e2", "n_entity", *kind]).groupBy("k1", "k2", *kind).agg(F.max("share").alias("share"))
    return own.join(telling, ["k1", "k2", *kind]).select("k1", "k2", "term", "share")


def find_personal_data(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc_id, k1, k2, base, added) for every row of ``docs``.

    ``base`` holds the base spans, by kind and start. ``added`` holds struct(kind, start, end) of
    disclosing terms in the texts of the entities that they give away, by kind and start: kind ``generalise``
    or ``remove``. Places are code points, the end exclusive. A missing or empty text has no spans.
    Repeated rows are found alike, and count each. No rows: no rows.
    """
    base = stage(find_base(docs), "personal")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    telling = disclosing_terms(docs, base, generalise)
    if telling is None:
        return base.select(F.col("doc").alias("doc_id"), "k1", "k2", "base", none.alias("added"))
    hits = base.select("doc", "k1", "k2", F.explode("terms").alias("x")).select("doc", "k1", "k2", "x.*").join(telling, ["k1", "k2", "term"])
    spans = hits.groupBy("doc", "k1", "k2", "start", "end").agg(F.max("share").alias("share"))
    kind = F.when(F.col("share") >= remove, "remove").otherwise("generalise")
    added = spans.groupBy("doc", "k1", "k2").agg(F.array_sort(F.collect_list(F.struct(kind.alias("kind"), "start", "end"))).alias("added"))
    added = added.select(F.col("doc").alias("d"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), "added")
    met = base.join(added, F.col("doc").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2")), "left")
    return met.select(F.col("doc").alias("doc_id"), "k1", "k2", "base", F.coalesce("added", none).alias("added"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """(row, doc_id, text, spans): every document's text with its spans replaced.

    A missing or empty text comes out empty; repeated rows come out alike; no rows: no rows.

    Base values become their kind in brackets, generalised terms their class ([NUMBER] if they hold
    a digit, else [NAME] with a capital, else [WORD]), removed ones nothing. ``row`` is the
    document's own row. Of overlapping spans of different kinds the one that starts first counts,
    then the longer one.
    """
    found = find_personal_data(docs, **settings).distinct()
    k1, k2 = text_key(whole_text())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d"), whole_text().alias("whole"), k1.alias("t1"), k2.alias("t2"))
    met = whole.join(found, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")))
    plain = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("last"), s["kind"].alias("kind"))
    spans = F.array_sort(F.concat(F.transform("base", plain), F.transform("added", plain)))

    def shown(s: Column, value: Column) -> Column:
        general = F.when(value.rlike(r"\p{N}"), "[NUMBER]").when(value.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
        return F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", general).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def write(so_far: Column, s: Column) -> Column:
        until = F.substring("whole", so_far["at"] + 1, s["start"] - so_far["at"])
        value = F.substring("whole", s["start"] + 1, -s["last"] - s["start"])
        longer = F.concat(so_far["text"], F.array(until, shown(s, value)))
        return F.when(s["start"] < so_far["at"], so_far).otherwise(F.struct((-s["last"]).alias("at"), longer.alias("text")))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("text"))
    written = F.aggregate(spans, begin, write, lambda x: F.concat(F.array_join(x["text"], ""), F.substring("whole", x["at"] + 1, F.length("whole"))))
    return met.select("row", "doc_id", written.alias("text"), span_list(F.concat("base", F.transform("added", lambda s: F.struct(s["kind"], s["start"], s["end"], F.lit("").alias("value"))))).alias("spans"))
