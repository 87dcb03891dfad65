"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers found by pattern. They are the
protected entities. A term (a word of letters) reveals an entity as far as documents that hold the term hold the
entity: with p = n(term, entity) / n(term) over all documents, the term gives log2(p / P(entity)) bits of the
-log2 P(entity) that the entity is worth. A term that gives at least GENERALISE of them with p of at least
LEAST_P, and does so in LEAST_SUPPORT different texts, is a span in every document: generalised to its kind, or removed from REMOVE on.
Copies of a text are one voice: least hashes of three-word shingles, which near copies mostly share, say how many different texts
the documents with term and entity amount to (the inverse of the chance that two of them agree, the middle one of VOICES hashes).

Matching runs linear in the text: possessive repeats, and anchors where a leftmost match can begin. Offsets
come from the lengths of the pieces between the matches, in code points.

Defined cases: a null text is the empty text and stays null when rewritten; a null doc_id is a row like any
other, but its terms are found by its text alone; overlapping spans are replaced together, by the kind that begins
first; repeated rows have equal spans; other columns, whatever their names, are kept by ``sanitise``;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import BROADCAST_IDS, Workspace

KINDS = ("email", "ip", "card", "phone", "term")
#: Each pattern finds what the plain one finds leftmost, without stepping back; for cards the number of digits is in it.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
WORD = r"\p{L}++"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
GENERALISE, REMOVE, LEAST_P, LEAST_SUPPORT = 0.8, 0.95, 0.5, 3
LEAST_LETTERS = 3
VOICES = 3


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    d = F.split(F.reverse(digits), "")

    def value(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).otherwise(2 * n - F.when(n > 4, 9).otherwise(0))

    return F.aggregate(F.transform(d, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: int, m: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = F.regexp_replace(m, "[^0-9]", "")
    return luhn(digits) if kind == 2 else F.length(digits).between(9, 15)


_SPANS = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def _spans(text: Column, pattern: str, kind: int, holds) -> Column:
    """Spans (start, end, kind, value) of a pattern's matches that hold, in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).cast("bigint").alias("gap"), m.alias("m")))

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + p["gap"]
        end = start + F.length(p["m"])
        new = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), p["m"].alias("value")))
        return F.struct(end.alias("at"), F.concat(state["out"], F.when(holds(p["m"]), new).otherwise(F.array().cast(_SPANS))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out")), add, lambda s: s["out"])


def _base(text: Column) -> Column:
    """All base spans of a text, by start and kind. Cheap tests come first, as most texts have none of a kind."""
    none = F.array().cast(_SPANS)
    may = (F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]"), text.rlike(r"(?:[0-9][\x20-]?){12}"), F.contains(text, F.lit("+")))
    each = (F.when(may[k], _spans(text, PATTERNS[k], k, lambda m, k=k: _holds(k, m))).otherwise(none) for k in range(4))
    key = lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"])
    return F.transform(F.array_sort(F.transform(F.concat(*each), key)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))


def terms_of(text: Column) -> Column:
    """Distinct words of at least LEAST_LETTERS letters, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= LEAST_LETTERS)


def revealing_terms(docs: DataFrame, based: DataFrame, ws: Workspace) -> DataFrame:
    """(term, share): terms and the largest share of an entity's information that they give away.

    ``based`` holds doc_id, text and spans of the documents with base spans.
    """
    clean = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")), lambda s, p: F.struct(F.greatest(s["at"], p["end"]).alias("at"), F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.greatest(p["start"] - s["at"], F.lit(0)).cast("int")), F.lit(" ")).alias("out")), lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))))
    held = based.select(F.xxhash64("text").alias("doc"), clean.alias("text"), F.array_distinct(F.transform("spans", lambda s: F.lower(s["value"]))).alias("entities"))
    entities = held.select("doc", F.explode("entities").alias("entity"))
    often = entities.groupBy("entity").agg(F.count_distinct("doc").alias("texts"), F.count("*").alias("n_entity")).where(F.col("texts") >= LEAST_SUPPORT)
    often = ws.save(often.select("entity", "n_entity"), "entities")
    words = F.filter(F.split(F.lower(F.col("text")), r"[^\p{L}]+"), lambda w: w != "")
    texts = held.groupBy("doc").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    near = entities.join(often, "entity").select("doc", "entity", "n_entity").distinct()
    voice = lambda k: F.array_min(F.transform("w", lambda w, i: F.xxhash64(w, F.get("w", i + 1), F.get("w", i + 2), F.lit(k))))
    texts = ws.save(texts.join(near.select("doc").distinct(), "doc", "left_semi").withColumn("w", words).drop("text"), "words")  # so that words are split once, not for each neighbour
    texts = ws.save(texts.select("doc", "copies", *(voice(k).alias(f"voice{k}") for k in range(VOICES)), F.array_distinct("w").alias("w")), "voices")  # and hashed once, not for each term
    near = near.join(texts.withColumn("term", F.explode("w")).drop("w"), "doc").where(F.length("term") >= LEAST_LETTERS)
    near = ws.save(near, "near")
    pair = ["entity", "n_entity", "term"]
    support = near.groupBy(*pair).agg(F.count("*").alias("support"), F.sum("copies").alias("both")).where(F.col("support") >= LEAST_SUPPORT)
    # a term is in all documents at least as often as in those with entities, which bounds what it can tell before the corpus is read
    inside = based.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_inside"))
    n = docs.count()
    worth = F.greatest(F.log2(F.lit(float(max(n, 2))) / F.col("n_entity")), F.lit(1e-9))
    share = lambda p: 1 + F.log2(p) / worth
    most = F.col("both") / F.col("n_inside")
    pairs = support.join(inside, "term").where((most >= LEAST_P) & (share(most) >= GENERALISE)).drop("n_inside")
    pairs = ws.save(pairs, "likely")
    said = near.join(F.broadcast(pairs.select(*pair)) if pairs.count() <= BROADCAST_IDS // 10 else pairs.select(*pair), pair, "left_semi")
    each = said.select(*pair, F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"voice{k}").alias("voice")) for k in range(VOICES)))).alias("v"))
    each = each.groupBy(*pair, "v.k", "v.voice").agg(F.count("*").alias("n")).groupBy(*pair, "k").agg((F.sum("n") * F.sum("n") / F.sum(F.col("n") * F.col("n"))).alias("texts"))
    voices = each.groupBy(*pair).agg(F.array_sort(F.collect_list("texts"))[VOICES // 2].alias("texts")).where(F.col("texts") >= LEAST_SUPPORT)  # VOICES figures a pair
    pairs = ws.save(pairs.join(voices.drop("texts"), pair), "pairs")
    wanted = ws.save(pairs.select("term").distinct(), "terms")
    if wanted.isEmpty():
        return ws.save(wanted.withColumn("share", F.lit(0.0)), "revealing")
    few = wanted.count() <= BROADCAST_IDS // 10
    every = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    every = every.groupBy("term").agg(F.count("*").alias("n_term"))
    p = F.col("both") / F.col("n_term")
    told = pairs.join(every, "term").where(p >= LEAST_P).select("term", share(p).alias("share")).where(F.col("share") >= GENERALISE)
    return ws.save(told.groupBy("term").agg(F.max("share").alias("share")), "revealing")


def find(docs: DataFrame) -> DataFrame:
    """The documents with _spans, all spans by start and kind (values of terms are 'removed' or 'generalised'), and _base, the base spans."""
    ws = Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = ws.save(docs.select(F.xxhash64(text).alias("_key"), F.col("doc_id").alias("_id"), text.alias("_text")).withColumn("_base", _base(F.col("_text"))).where(F.size("_base") > 0), "based")
    revealing = revealing_terms(docs.select(text.alias("text")), own.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"), F.col("_base").alias("spans")), ws)
    number = revealing.count()
    found = docs.withColumn("_text", text).withColumn("_base", _base(F.col("_text")))
    if not number:
        return found.withColumn("_spans", F.col("_base")).drop("_text")
    terms = docs.select(F.xxhash64(text).alias("_key"), F.explode(terms_of(text)).alias("term"))
    terms = terms.join(F.broadcast(revealing) if number <= BROADCAST_IDS // 10 else revealing, "term")
    terms = ws.save(terms.groupBy("_key").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("term", "share")))).alias("_terms")), "holders")
    found = found.withColumn("_key", F.xxhash64(text))
    found = found.join(F.broadcast(terms) if terms.count() <= BROADCAST_IDS // 10 else terms, "_key", "left").drop("_key")
    words = F.when(F.col("_terms").isNotNull(), _spans(F.col("_text"), WORD, 4, lambda m: F.map_contains_key("_terms", F.lower(m))))
    words = F.transform(words, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.when(F.element_at("_terms", F.lower(s["value"])) >= REMOVE, "removed").otherwise("generalised").alias("value")))
    inside = F.filter(words, lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    every = F.array_sort(F.transform(F.concat("_base", inside), lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"])))
    every = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return found.withColumn("_spans", F.when(F.col("_terms").isNull(), F.col("_base")).otherwise(every)).drop("_text", "_terms")


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op9(docs: DataFrame) -> DataFrame:
    """Counts of base kinds, SHA-256 of the base spans, and all spans, of each whole text."""
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(_written("_base").cast("binary"), 256).alias("base_sha256"), _written("_spans").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with spans replaced in their texts: base kinds by their names, terms by a general word or nothing."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS[:4]), F.lit("<TERM>"))

    def add(state: Column, s: Column) -> Column:
        put = F.when(s["start"] < state["at"], "").when((s["kind"] == 4) & (s["value"] == "removed"), "").otherwise(F.element_at(names, s["kind"] + 1))
        gap = F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, put).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    text = F.aggregate("_spans", start, add, lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))))
    return find(docs).withColumn("text", F.when(F.size("_spans") > 0, text).otherwise(F.col("text"))).select(*docs.columns)
