"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give it away.

The values that the patterns find, and key-like runs of letters and digits (secrets), are the protected entities. A
term's disclosure of an entity is their pointwise mutual information over the information content of the entity, from
the number of distinct texts with the term, with the entity and with both, anywhere in the text; it is 1 if the term
names the entity for certain, less a discount for few texts: c / (c + 1) for the texts with both, and for the rarer of
the two. A term whose disclosure exceeds a threshold is generalised wherever it stands in a text with the entity, and
beyond a higher one removed. So a pair needs three texts: two leave a disclosure of 4/9 at most. Only entities and
terms that can reach the threshold are paired, which spares most texts and loses nothing.

Everything is DataFrame operations. Spans are gathered in chunks of a text's matches and terms are joined by row, so
a text with very many mentions takes time in proportion to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.llm.common import materialize

#: Kinds in their order. Quantifiers are possessive where nothing could be given back, and a match starts
#: at the head of its run or at the end of the last match, so no text takes quadratic time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
KINDS = (*PATTERNS, "secret", "removed", "generalised")
#: A secret is a run of letters and digits with three or more of each.
SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+"
TERM = r"\p{L}[\p{L}\p{M}\p{N}]{2,}+"
GENERALISE, REMOVE = 0.5, 0.8
#: Texts with both that a pair needs: fewer are discounted below GENERALISE.
LEAST_TEXTS = 3
#: Matches that are taken together.
CHUNK = 64
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(OCTETS)
    if kind == "card":
        return F.when(F.char_length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    if kind == "secret":
        return F.char_length(digits).between(3, F.char_length(match) - 3)
    return F.lit(True)


def _value(kind: str, match: Column) -> Column:
    if kind == "secret":
        return match
    return F.lower(match) if kind in ("email", "ip") else F.regexp_replace(match, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _found(text: Column, pattern: str, kind: int, valid, value) -> Column:
    """Spans of a pattern's matches that are valid: the pieces between matches give the places.

    An aggregate copies its state at each step, so matches are taken CHUNK at a time, each chunk from its own place.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    size = lambda part: F.char_length(part["gap"]) + F.coalesce(F.char_length(part["match"]), F.lit(0))

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value(part["match"]).alias("value"))
        more = F.when(part["match"].isNotNull() & valid(part["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(F.coalesce(end, state["at"]).alias("at"), more.alias("spans"))

    def chunk_spans(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans")), add, lambda s: s["spans"])

    def spans(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda s, part: s + size(part)))
        starts = F.aggregate(totals, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(starts, 1, F.size(chunks)), chunk_spans))

    def cut(of: Column) -> Column:
        last = F.floor((F.size(of) - 1) / CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(of, k * CHUNK + 1, CHUNK))

    return _let(parts, lambda of: _let(cut(of), spans))


def _spans(text: Column, kinds: list[tuple[int, str, str]]) -> Column:
    none = F.array().cast(_SPAN)
    out = []
    for k, kind, pattern in kinds:
        found = _found(text, pattern, k, lambda m, kind=kind: _valid(kind, m), lambda m, kind=kind: _value(kind, m))
        if kind in NEEDED:
            wanted = text.rlike("[0-9]{2}|[0-9][ -][0-9]") if NEEDED[kind] is None else F.contains(text, F.lit(NEEDED[kind]))
        else:
            wanted = text.rlike("[A-Za-z0-9]{16}")
        out.append(F.when(wanted, found).otherwise(none))
    return F.array_sort(F.flatten(F.array(*out)))


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end, value) of all fixed patterns, by start and kind; places are code points."""
    return _spans(text, [(k, kind, pattern) for k, (kind, pattern) in enumerate(PATTERNS.items())])


def secret_spans(text: Column) -> Column:
    return _spans(text, [(KINDS.index("secret"), "secret", SECRET)])


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def _classes(rows: DataFrame, name: str, count: str, of: str) -> DataFrame:
    """(`name`, `of`, `count`): what is in the same rows, and in as many texts, is of one class; written."""
    mark = [F.bit_xor(F.xxhash64("row")), F.bit_xor(F.xxhash64("row", F.lit(1))), F.count("*"), F.first(count)]
    of_name = rows.groupBy(name).agg(*[m.alias(f"m{k}") for k, m in enumerate(mark)])
    return materialize(of_name.select(name, F.concat_ws(":", *[f"m{k}" for k in range(4)]).alias(of), F.col("m3").alias(count)))


def disclosures(mentions: DataFrame, held: DataFrame, texts: DataFrame, total: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(entity, of_entity), (term, of_term) and (of_entity, of_term, disclosure) of those at or over GENERALISE, if any.

    `mentions` is (row, entity) without repeats, `held` (row, text) of their rows, `texts` all (row, text), each of
    `total` distinct texts. Entities that
    are in the same texts are one class, and so are terms, so a list of very many makes no pair of each with each.
    """
    entities = mentions.groupBy("entity").agg(F.count("*").alias("with_entity")).where(F.col("with_entity") >= LEAST_TEXTS)
    known = materialize(mentions.join(entities, "entity"))
    # Of two counts the mutual information is at most log(total / larger), so a term in over sqrt(total x texts with
    # the entity) texts cannot reach half of the entity's information content.
    most = known.agg(F.max("with_entity")).first()[0]
    if most is None:
        return None
    terms = texts.select(F.explode(F.transform(_terms(F.col("text")), lambda w: F.xxhash64(w))).alias("hash"))
    terms = terms.groupBy("hash").agg(F.count("*").alias("with_term"))
    terms = terms.where((F.col("with_term") >= LEAST_TEXTS) & (F.col("with_term") <= (total * most) ** 0.5 * (1 + 1e-9)))
    own = held.join(known.select("row").distinct(), "row", "left_semi").select("row", F.explode(_terms(F.col("text"))).alias("term"))
    own = materialize(own.withColumn("hash", F.xxhash64("term")).join(materialize(terms), "hash").select("row", "term", "with_term"))
    of_entity, of_term = _classes(known, "entity", "with_entity", "of_entity"), _classes(own, "term", "with_term", "of_term")
    left = known.select("row", "entity").join(of_entity, "entity").select("row", "of_entity", "with_entity").distinct()
    right = own.select("row", "term").join(of_term, "term").select("row", "of_term", "with_term").distinct()
    pairs = left.join(right, "row").groupBy("of_entity", "of_term").agg(
        F.count("*").alias("both"), F.first("with_entity").alias("with_entity"), F.first("with_term").alias("with_term")
    )
    gain = F.log(F.col("both") * F.lit(float(total)) / (F.col("with_entity") * F.col("with_term")))
    content = F.log(F.lit(float(total)) / F.col("with_entity"))
    fewer = F.least("with_entity", "with_term")
    trust = F.col("both") / (F.col("both") + 1) * fewer / (fewer + 1)
    share = F.when(content > 0, gain / content * trust).otherwise(F.lit(0.0))
    strong = pairs.where(F.col("both") >= LEAST_TEXTS).select("of_entity", "of_term", share.alias("disclosure"))
    strong = materialize(strong.where(F.col("disclosure") >= GENERALISE))
    return None if strong.isEmpty() else (of_entity, of_term, strong)


def _added(known: DataFrame, of_entity: DataFrame, of_term: DataFrame, strong: DataFrame) -> DataFrame:
    """(row, added): spans of the disclosing terms of `known` (row, found, text), where no found span stands."""
    entity = F.explode(F.array_distinct(F.transform("found", _entity))).alias("entity")
    told = known.select("row", entity).join(of_entity, "entity").select("row", "of_entity").distinct().join(strong, "of_entity")
    told = told.groupBy("row", "of_term").agg(F.max("disclosure").alias("d")).join(of_term, "of_term").select("row", "term", "d")
    told = materialize(told)
    texts = known.join(told.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"]).select("row", "found", "text")
    all_terms = texts.select("row", F.explode(_found(F.col("text"), TERM, 0, lambda m: F.lit(True), F.lower)).alias("s")).select("row", "s.*")
    hits = all_terms.withColumnRenamed("value", "term").join(told, ["row", "term"]).select("row", "start", "end", "term", "d")
    base = texts.select("row", F.explode("found").alias("s"))
    base = base.select("row", "s.start", "s.end", F.lit(None).cast("string").alias("term"), F.lit(None).cast("double").alias("d"))
    # A text's spans in order: one overlaps if a found span before it ends after its start, or one behind it starts before its end.
    up_to = lambda *order: Window.partitionBy("row").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.max(F.when(F.col("term").isNull(), F.col("end"))).over(up_to("start"))
    # The other way round, as a frame that ends at the last row would be read anew for each row.
    behind = F.min(F.when(F.col("term").isNull(), F.col("start"))).over(up_to(F.desc("start")))
    placed = hits.unionByName(base).withColumns({"before": before, "behind": behind})
    free = placed.where(F.col("term").isNotNull() & (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("behind", F.col("end")) >= F.col("end")))
    kind = F.when(F.col("d") >= REMOVE, KINDS.index("removed")).otherwise(KINDS.index("generalised"))
    span = F.struct(F.col("start"), kind.cast("int").alias("kind"), F.col("end"), F.col("term").alias("value"))
    return materialize(free.groupBy("row").agg(F.collect_list(span).alias("added")))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"].cast("string"), span["value"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, `row` (a hash of id and text), `base` and `spans` (start, kind, end, value), base and method alike.

    Null and empty texts have no spans. Rows of equal texts count as one text, and all stay; rows that repeat an id and
    a text are two texts to the counts if no other id has the text. Ties of start go by kind, in the order of KINDS.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), text).alias("row"), F.xxhash64(text).alias("digest"), text.alias("text"))
    known = rows.withColumns({"base": base_spans(F.col("text")), "secrets": secret_spans(F.col("text"))})
    found = F.concat("base", "secrets")
    # The text goes along where it has an entity: nothing else is read of it later.
    known = materialize(known.select("id", "row", "digest", "base", found.alias("found"), F.when(F.size(found) > 0, F.col("text")).alias("text")))
    # One row stands for each text.
    first = known.groupBy("digest").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    total = first.count()
    several = materialize(first.where("first < last").select("digest", "first"))
    copies = materialize(known.select("row", "digest").join(several, "digest").where("row > first").select("row").distinct())
    held = known.where(F.size("found") > 0)
    once = held.join(copies, "row", "left_anti")
    mentions = once.select("row", F.explode(F.array_distinct(F.transform("found", _entity))).alias("entity")).distinct()
    strong = disclosures(mentions, once.dropDuplicates(["row"]).select("row", "text"), rows.select("row", "text").join(copies, "row", "left_anti"), total)
    out = known.drop("text")
    if strong is None:
        out = out.withColumn("added", F.array().cast(_SPAN))
    else:
        out = out.join(_added(held, *strong), "row", "left")
    spans = F.array_sort(F.concat("found", F.coalesce("added", F.array().cast(_SPAN))))
    return out.select(F.col("id").alias(id_col), "row", "base", spans.alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the spans of `text_col` masked: entities as [EMAIL] and so on, terms removed as [-] or generalised as [TERM].

    Of overlapping spans the first by start and kind is masked. A null text stays null. Other columns are kept, whatever
    their names.
    """
    spans = find(docs, id_col, text_col).select("row", "spans").dropDuplicates(["row"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), F.xxhash64(F.col(id_col).cast("string"), text).alias("row"), text.alias("text"))
    joined = rows.join(spans, "row", "left")
    masks = F.array(*[F.lit(m) for m in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[SECRET]", "[-]", "[TERM]")])

    def add(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        between = F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], F.array(between, F.element_at(masks, s["kind"] + 1)))).otherwise(state["out"])
        return F.struct(F.when(fresh, s["end"]).otherwise(state["at"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), s["at"] + 1, F.char_length("text")))
    masked = F.when(F.size("spans") > 0, F.aggregate("spans", start, add, rest)).otherwise(F.col("text"))
    new = F.when(F.col(f"kept.`{text_col}`").isNotNull(), masked)
    return joined.select(*[new.alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns])
