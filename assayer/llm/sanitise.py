"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

Base spans come from four patterns with checks. Beyond them, a term in a document of a protected entity can give the entity
away. How much is estimated from the corpus: with document frequencies, PMI(entity; term) is the information that the
term gives about the entity, IC(entity) all there is to know, and their ratio the disclosure, 1 if the term occurs with
the entity alone. Terms over ``remove`` are removed, terms over ``generalise`` replaced by what they are, at every place
in every document that holds the entity. A pair counts from ``support`` documents on, as one document is no evidence
of an association; so only the documents of entities that recur are taken apart into terms.

Columns and SQL functions only. Positions are code points: what lies between matches is split off with the same
pattern, and lengths are added up, so a text is scanned a fixed number of times. The patterns equal those of the
docstring below; possessive loops and the conditions on their start only keep the matching linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.rows import fresh, row_key
from assayer.session import materialize

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this holds no valid match of the kind.
NEEDED = {
    "email": "[A-Za-z0-9._%+-]@[A-Za-z0-9-]+[.][A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[^\x20\x09-\x0D\p{Punct}]+"
NOT_TERM = r"[\x20\x09-\x0D\p{Punct}]+"
SPAN = "array<struct<kind: string, start: int, end: int>>"


@dataclass(frozen=True)
class Settings:
    """Thresholds of the disclosure; support: least documents."""

    support: int = 2
    generalise: float = 0.7
    remove: float = 0.9


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
        double = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda part: F.coalesce(F.ltrim(part, F.lit("0")).try_cast("int"), F.when(F.ltrim(part, F.lit("0")) == "", 0), F.lit(256)) <= 255
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)))
    return F.length(_digits(match)).between(9, 15)


def _spans(text: Column, pattern: str, kind: str, valid) -> Column:
    """Places of the valid matches, in order."""

    def walk(both: Column) -> Column:
        matches, between = both["matches"], both["between"]

        def step(state: Column, i: Column) -> Column:
            match = F.get(matches, i)
            start = state["at"] + F.length(F.get(between, i))
            end = start + F.length(match)
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
            return F.struct(
                end.alias("at"),
                F.when(valid(match), F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"),
            )

        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step, lambda state: state["found"])

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("between")
    )
    return F.when(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) > 0, _let(both, walk)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All base spans of a text by kind, then start."""
    none = F.array().cast(SPAN)
    return F.concat(
        *(
            F.when(
                F.rlike(text, F.lit(NEEDED[kind])), _spans(text, PATTERNS[kind], kind, lambda m, k=kind: _valid(k, m))
            ).otherwise(none)
            for kind in KINDS
        )
    )


def find(docs: DataFrame) -> DataFrame:
    """key, doc_id, text, base spans and entities (kind:value, each once) of each row; equal rows have equal keys."""
    text = F.coalesce("text", F.lit(""))

    def entity(e: Column) -> Column:
        value = F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"])
        name = F.when(e["kind"].isin("card", "phone"), _digits(value)).otherwise(F.lower(value))
        return F.concat(e["kind"], F.lit(":"), name)

    found = docs.select(row_key().alias("key"), "doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    return found.withColumn("entities", F.array_distinct(F.transform("base", entity)))


def holders(found: DataFrame, settings: Settings) -> DataFrame:
    """(entity, key, n_entity) of the entities that ``support`` documents hold, with their number."""
    held = found.select(F.explode("entities").alias("entity"), "key").dropDuplicates()
    number = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    return held.join(number.where(F.col("n_entity") >= settings.support), "entity")


def mentions(found: DataFrame, settings: Settings, held: DataFrame | None = None) -> DataFrame:
    """(key, term, start, end) of all terms of the texts with a recurring entity, whole terms outside all base spans only."""
    held = holders(found, settings) if held is None else held
    one = found.join(held.select("key").dropDuplicates(), "key", "left_semi").select("key", "text", "base").dropDuplicates(["key"])
    match, gap = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    parts = one.select("key", match.alias("match"), gap.alias("gap"))
    parts = parts.select("key", F.posexplode(F.arrays_zip("match", "gap")).alias("n", "t")).select("key", "n", "t.*")
    so_far = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("gap") + F.coalesce(F.length("match"), F.lit(0))).over(so_far).cast("int")
    terms = parts.withColumn("end", end).where(F.col("match").isNotNull())
    terms = terms.select(
        "key", F.lower("match").alias("term"), (F.col("end") - F.length("match")).alias("start"), "end",
        F.col("end").alias("at"), F.lit(None).cast("int").alias("until"),
    )
    # A base span overlaps a term if it starts before the term's end and ends after its start.
    spans = one.select("key", F.explode("base").alias("b")).select(
        "key", *(F.lit(None).cast(kind).alias(name) for name, kind in (("term", "string"), ("start", "int"), ("end", "int"))),
        F.col("b.start").alias("at"), F.col("b.end").alias("until"),
    )
    before = Window.partitionBy("key").orderBy("at", F.col("until").asc_nulls_first())
    until = F.max("until").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = terms.unionByName(spans).withColumn("until", F.coalesce(until, F.lit(0)))
    return placed.where(F.col("term").isNotNull() & (F.col("until") <= F.col("start"))).select("key", "term", "start", "end")


def disclosing(found: DataFrame, near: DataFrame, settings: Settings, held: DataFrame | None = None) -> DataFrame:
    """(entity, term, disclosure) of the pairs over the lower threshold, from document frequencies of all texts."""
    held = holders(found, settings) if held is None else held
    words = F.array_distinct(F.split(F.lower("text"), NOT_TERM))
    terms = found.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    total = F.lit(float(found.count()))
    # With n_both <= n_entity, a pair of a more frequent term is under the threshold.
    most = F.pow("n_entity", F.lit(settings.generalise)) * F.pow(total, F.lit(1 - settings.generalise)) * 1.000001
    pairs = near.select("key", "term").dropDuplicates().join(terms, "term").join(held, "key").where(F.col("n_term") <= most)
    rated = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both"))
    rated = rated.where(F.col("n_both") >= settings.support)
    pmi = F.log(total * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    rated = rated.withColumn("disclosure", F.try_divide(pmi, F.log(total / F.col("n_entity"))))
    return rated.where(F.col("disclosure") >= settings.generalise).select("entity", "term", "disclosure")


def sanitise(docs: DataFrame, settings: Settings = Settings(), keep_text: bool = False) -> DataFrame:
    """key, doc_id, base and all spans (kind, start, end; code points, end exclusive) per row, on request the text.

    Base kinds, leftmost and without overlap in each kind: email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``;
    ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of at most 255; card ``[0-9]([\\x20-]?[0-9])+`` of 13 to 19
    digits that pass Luhn; phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` of 9 to 15 digits. ``remove`` and ``generalise`` spans
    follow them. Null texts have no span; a null id stays null; repeated rows are treated each and count once
    as a document; an empty table gives no row.
    """
    found = find(docs)
    base = materialize(found.select("key", "doc_id", "base", "entities"), "base-spans")
    held = materialize(holders(base, settings), "entities")
    near = materialize(mentions(found, settings, held), "mentions")
    rated = materialize(disclosing(found, near, settings, held), "disclosing")
    chosen = rated.join(held, "entity").groupBy("key", "term").agg(F.max("disclosure").alias("d"))
    strongest = near.join(chosen, ["key", "term"])
    kind = F.when(F.col("d") >= settings.remove, F.lit("remove")).otherwise(F.lit("generalise"))
    extra = strongest.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct(kind.alias("kind"), "start", "end"))).cast(SPAN).alias("extra")
    )
    order = F.transform("extra", lambda x: F.struct((x["kind"] == "generalise").alias("later"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    sorted_extra = F.transform(F.array_sort(order), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    rows = found if keep_text else base
    joined = rows.join(extra, "key", "left")
    spans = F.concat("base", F.coalesce(sorted_extra.cast(SPAN), F.array().cast(SPAN)))
    return joined.select("key", "doc_id", "base", spans.alias("spans"), *(["text"] if keep_text else []))


def number(spans: Column, kind: str) -> Column:
    """Spans of one kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with removed terms left out and every other span replaced by its kind in brackets.

    Where spans of several kinds overlap, the one that starts first (then the longer one) is replaced, and what
    another one covers beyond it goes with it.
    """
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus_end"), x["kind"].alias("kind"))))

    def step(state: Column, x: Column) -> Column:
        start, end = x["start"], -x["minus_end"]
        mark = F.when(x["kind"] == "remove", F.lit("")).when(x["kind"] == "generalise", F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        fresh = start >= state["at"]
        return F.struct(
            F.greatest(end, state["at"]).alias("at"),
            F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, start - state["at"]), mark)).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    last = lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, begin, step, last))


def clean(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` with all their columns, texts redacted, n_chars (if there) counted anew; null texts stay."""
    key, held = (fresh(name, docs.columns) for name in ("row_key", "row_spans"))
    spans = sanitise(docs, settings).where(F.size("spans") > 0).select(F.col("key").alias(key), F.col("spans").alias(held))
    spans = materialize(spans.dropDuplicates([key]), "spans")
    joined = docs.withColumn(key, row_key()).join(spans, key, "left")
    text = F.when(F.col(held).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(held)))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(held).isNull(), F.col("n_chars")).otherwise(F.length("text"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
