"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base entities are e-mail addresses, IP addresses, payment cards and phone numbers, found by pattern and validated.
Terms that reveal an entity are found from how they occur with it in the corpus: with n documents, n_t of them holding
term t, n_e entity e and n_te both, wherever they stand in it, the term discloses log(n n_te / (n_t n_e)) of the entity's
log(n / n_e) bits. Terms are runs of letters and digits of any length that are not part of an entity. Terms over ``REMOVE``
of that are removed, over ``GENERALISE`` replaced by a general word. A term needs three different contexts of the entity: three
that hold the term, or three documents that do and differ in their context, so that copies of one document are not evidence.

A null or empty text has no spans. Rows with equal id and text are one document and get the same spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.llm import common
from freshet.session import store

#: Fixed patterns of the kinds, in their order. Possessive repeats and the borders in front keep matching linear;
#: they match what the plain patterns match.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
#: A kind's texts hold this.
TRIGGERS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
ORDER = [*KINDS, TERM]
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
MARK, PLAIN = "\x01", "\x02"
#: Code points on either side of an entity that tell its contexts apart.
AROUND = 120
MIN_CONTEXTS = 3
GENERALISE = 0.85
REMOVE = 0.95
WORD = r"[\p{L}\p{N}]++"
#: Stands for a generalised term.
GENERAL_WORD = "[WORD]"


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(kind == "card", n.between(13, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", n.between(9, 15))
    )


def _matches(df: DataFrame, kind: str, pattern: Column) -> DataFrame:
    """Every match in ``text`` with its place and up to ``AROUND`` code points on both sides.

    Matches are set between marks and the text is split there, so every second part is a match; a part's place is
    the running sum of the lengths before it.
    """
    plain = F.translate("text", MARK, PLAIN)
    parts = df.withColumn("parts", F.split(F.regexp_replace(plain, pattern, F.lit(f"{MARK}$0{MARK}")), MARK)).where(F.size("parts") > 1)
    place = F.posexplode(
        F.transform(
            "parts",
            lambda x, i: F.struct(
                F.length(x).alias("n"),
                F.when(i % 2 == 1, x).alias("value"),
                F.when(i % 2 == 1, F.right(F.element_at("parts", i), F.lit(AROUND))).alias("before"),
                F.when(i % 2 == 1, F.left(F.element_at("parts", i + 2), F.lit(AROUND))).alias("after"),
            ),
        )
    ).alias("i", "part")
    order = Window.partitionBy("doc_id", "row").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.select("doc_id", "row", place).select("doc_id", "row", "i", "part.*")
    rows = rows.withColumn("begin", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long")).where("value IS NOT NULL")
    return rows.select(
        "doc_id", "row", F.lit(kind).alias("kind"), "begin", (F.col("begin") + F.col("n")).alias("end"), "value",
        F.concat_ws(" ", "before", "after").alias("context"),
    )


def base_spans(df: DataFrame) -> DataFrame:
    """``doc_id, row, kind, begin, end, value, context`` of the valid matches of ``doc_id, row, text``.

    Rows with equal id and text are one; only texts that hold a kind's trigger are searched and shuffled.
    """
    out = None
    for kind, pattern in KINDS.items():
        trigger = TRIGGERS[kind]
        held = df.where(F.col("text").rlike("[0-9]") if trigger is None else F.contains("text", F.lit(trigger)))
        if kind == "card":
            held = held.where(F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){12}"))
        elif kind == "ip":
            held = held.where(F.col("text").rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))
        found = _matches(held.dropDuplicates(["doc_id", "row"]), kind, F.lit(pattern))
        found = found.where(_valid(F.col("kind"), F.col("value")))
        out = found if out is None else out.union(found)
    return out


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)))


def disclosing_terms(df: DataFrame, base: DataFrame) -> DataFrame | None:
    """``term, share`` of terms that disclose an entity, and ``doc_id, row, term`` where they stand; None if none.

    ``share`` is the largest part of an entity's information that the term gives.
    """
    entity = F.when(F.col("kind") == "email", F.lower("value")).otherwise(F.regexp_replace("value", "[^0-9.]", ""))
    near = base.select("doc_id", "row", "kind", entity.alias("entity"), F.xxhash64("context").alias("at"), "context")
    entities = near.groupBy("kind", "entity").agg(F.count_distinct("doc_id").alias("n_e"), F.count_distinct("at").alias("contexts"))
    entities = store(entities.where(F.col("contexts") >= MIN_CONTEXTS).select("kind", "entity", "n_e"), "entities")
    near = common.join_small(near, entities, ["kind", "entity"], "inner")
    beside = near.select("kind", "entity", "n_e", "at", F.explode(_terms(F.col("context"))).alias("term"))
    beside = beside.groupBy("kind", "entity", "n_e", "term").agg(F.count_distinct("at").alias("contexts"))
    # An entity's several places in a row are one context of the whole text.
    rows = store(near.groupBy("doc_id", "row", "kind", "entity", "n_e").agg(F.min("at").alias("at")), "entity-rows")
    inside = common.join_small(base, store(rows.select("doc_id", "row").distinct(), "entity-texts"), ["doc_id", "row"], "left_semi")
    inside = store(inside.groupBy("doc_id", "row").agg(F.array_join(F.collect_set("value"), MARK).alias("inside")), "inside")
    texts = common.join_small(df, inside, ["doc_id", "row"], "inner").dropDuplicates(["doc_id", "row"])
    outside = F.aggregate(F.split("inside", MARK), F.col("text"), lambda text, value: F.replace(text, value, F.lit("\n")))
    texts = texts.select("doc_id", "row", _terms(outside).alias("terms"))
    whole = common.join_small(texts, rows, ["doc_id", "row"], "inner").select("doc_id", "kind", "entity", "n_e", "at", F.explode("terms").alias("term"))
    whole = whole.groupBy("kind", "entity", "n_e", "term").agg(F.count_distinct("doc_id").alias("n_te"), F.count_distinct("at").alias("apart"))
    together = whole.join(beside, ["kind", "entity", "n_e", "term"], "left")
    enough = (F.least("n_te", "apart") >= MIN_CONTEXTS) | (F.col("contexts") >= MIN_CONTEXTS)
    together = store(together.where(enough).select("kind", "entity", "n_e", "term", "n_te"), "together")
    if together.isEmpty():
        return None
    candidates = store(together.select("term").distinct(), "candidates")
    n = df.count()
    held = df.select("doc_id", "row", F.explode(_terms(F.col("text"))).alias("term"))
    n_t = store(_holders(df, common.join_small(held, candidates, ["term"], "left_semi")), "n-t")
    known = common.join_small(together, n_t, ["term"], "inner")
    bits = F.log(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(float(n) + 1) / F.col("n_e"))
    shares = known.select("term", bits.alias("share")).groupBy("term").agg(F.max("share").alias("share")).where(F.col("share") >= GENERALISE)
    # only the few terms that disclose something are listed with where they stand
    return store(common.join_small(held, store(shares, "shares"), ["term"], "inner").distinct(), "occurrences")


def _holders(df: DataFrame, held: DataFrame) -> DataFrame:
    """``term, n_t``: the number of distinct ids with each term of ``doc_id, row, term``.

    Rows whose id stands alone in ``df`` are counted where they are, so only counts are shuffled; the rows of repeated
    ids, if there are any, are told apart by their id.
    """
    held = held.where("doc_id IS NOT NULL")
    again = store(df.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return held.groupBy("term").agg(F.count("*").alias("n_t"))
    once = common.join_small(held, again, ["doc_id"], "left_anti").groupBy("term").agg(F.count("*").alias("n_t"))
    more = common.join_small(held, again, ["doc_id"], "left_semi").groupBy("term").agg(F.count_distinct("doc_id").alias("n_t"))
    return once.union(more).groupBy("term").agg(F.sum("n_t").alias("n_t"))


def term_spans(df: DataFrame, terms: DataFrame) -> DataFrame:
    """Spans of disclosing terms, like those of ``base_spans``; ``value`` is the term, ``share`` what it discloses."""
    per_row = store(terms.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("term")).alias("terms")), "terms")
    held = common.join_small(df, per_row, ["doc_id", "row"], "inner").dropDuplicates(["doc_id", "row"])
    any_of = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?iu:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    found = _matches(held, TERM, any_of)
    shares = store(terms.select("term", "share").distinct(), "shares")
    return common.join_small(found.withColumn("term", F.lower("value")), shares, ["term"], "inner").select(*found.columns, "share")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, kind, begin, end, value, share`` of all spans; ``share`` is null for base spans; stored.

    Places are code points, the end exclusive. Base spans never overlap within their kind and are all kept.
    """
    df = common.with_row(common.documents(docs, id_col, text_col))
    base = store(base_spans(df), "base-spans")
    out = base.select("doc_id", "row", "kind", "begin", "end", "value", F.lit(None).cast("double").alias("share"))
    terms = disclosing_terms(df, base)
    if terms is None:
        return out
    added = term_spans(df, terms).select("doc_id", "row", "kind", "begin", "end", "value", "share")
    return store(out.union(added), "spans")


def digest(found: DataFrame) -> DataFrame:
    """Per ``doc_id, row``: counts by kind, and the spans by kind and place as ``kind:begin:end``, base ones and all."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    one = F.struct(rank.alias("rank"), "begin", "end", "kind")
    written = lambda x: F.concat_ws(":", x["kind"], x["begin"], x["end"])
    grouped = found.groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_list(one)).alias("all"), *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in ORDER]
    )
    return grouped.select(
        "doc_id", "row", *[f"n_{k}" for k in ORDER],
        F.array_join(F.transform(F.filter("all", lambda x: x["kind"] != TERM), written), ",").alias("base"),
        F.array_join(F.transform("all", written), ",").alias("spans"),
    )


def sanitise(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``sanitised``: entities replaced by their kind, terms generalised or removed; one row per input row.

    Where spans overlap, a code point belongs to the one that begins first, the longer one at equal places.
    """
    df = common.with_row(common.documents(docs, id_col, text_col))
    order = Window.partitionBy("doc_id", "row").orderBy("begin", F.desc("end"), "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("from", F.greatest("begin", F.coalesce(before, F.lit(0)))).where(F.col("from") < F.col("end"))
    word = F.when(F.col("kind") != TERM, F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).when(F.col("share") >= REMOVE, "").otherwise(GENERAL_WORD)
    cuts = apart.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("from", "end", word.alias("word")))).alias("cuts"))
    joined = common.join_small(df, store(cuts, "cuts"), ["doc_id", "row"], "left")
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1)["end"]).cast("int")
    pieces = F.transform("cuts", lambda x, i: F.concat(F.substring(F.col("text"), begin(i) + 1, x["from"].cast("int") - begin(i)), x["word"]))
    last = F.element_at("cuts", -1)["end"].cast("int")
    rest = F.substring(F.col("text"), last + 1, F.length("text"))
    return joined.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest)).alias("sanitised"))
