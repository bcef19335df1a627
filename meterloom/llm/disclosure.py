"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are what the base patterns find: e-mail addresses, IP addresses, card and phone numbers. How strongly a
term t reveals an entity e is their pointwise mutual information over the documents of the corpus, against the entity's own
information: ln(n_et * N / (n_e * n_t)) / ln(N / n_e), 1 if t occurs only where e does. Terms near mentions of an entity
whose share exceeds the thresholds are generalised or removed in the documents that mention it.

Positions come from the texts between matches: what a split leaves and the matches alternate, and a running sum of their
lengths in code points is where each match starts. The patterns are possessive and start only where a run starts or the
last match ended, so they are linear on any text and match what the plain patterns match.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import BROADCAST_ROWS, matched, settle, written

KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have to have a match, as cheaper tests.
NEEDS = {"email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: F.contains(t, F.lit(".")) & t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": lambda t: F.contains(t, F.lit("+"))}
TERM = r"\p{L}{3,}"
NO_ID = -(1 << 63)
KEY = ["row_id", "row_hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id and its text; equal rows have equal results."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"row_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "row_hash": F.xxhash64(text)})


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda sum_, i: sum_ + value(i)) % 10 == 0


def _valid() -> Column:
    digits, match = _digits(F.col("match")), F.col("match")
    parts = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    n = F.length(digits)
    return (F.when(F.col("kind") == "email", True).when(F.col("kind") == "ip", parts)
            .when(F.col("kind") == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False)).otherwise(n.between(9, 15)))


def _placed(pieces: DataFrame, by: list[str], *more: str) -> DataFrame:
    """Rows with arrays `pieces` (n + 1), `found` and those of `more` (n): a row for each match with start and end."""
    z = F.arrays_zip(F.col("pieces").alias("gap"), F.col("found").alias("match"), *more)
    rows = pieces.select(*by, F.posexplode(z).alias("i", "at")).where("at.match is not null")
    rows = rows.select(*by, "i", F.col("at.match").alias("match"), F.length("at.gap").alias("gap"), F.length("at.match").alias("len"), *[f"at.{c}" for c in more])
    rows = rows.repartition(*by).dropDuplicates([*by, "i"])  # equal rows of the input, without a shuffle more
    w = Window.partitionBy(*by).orderBy("i")
    return rows.withColumn("end", (F.sum(F.col("gap") + F.col("len")).over(w)).cast("long")).withColumn("start", F.col("end") - F.col("len"))


def mentions(keyed: DataFrame) -> DataFrame:
    """KEY, kind, start, end and entity of each valid match of the base patterns."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def struct(kind):
        split, found = F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        has = NEEDS[kind](text)
        return F.struct(F.lit(kind).alias("kind"), F.when(has, split).alias("pieces"), F.when(has, found).alias("found"))

    some = NEEDS["email"](text) | NEEDS["phone"](text) | NEEDS["card"](text) | NEEDS["ip"](text)
    rows = keyed.select(*KEY, "text").where(some).select(*KEY, F.explode(F.array(*map(struct, PATTERNS))).alias("x")).select(*KEY, "x.*").where("size(found) > 0")
    found = _placed(rows, [*KEY, "kind"]).where(_valid())
    entity = F.concat_ws(":", "kind", F.when(F.col("kind").isin("card", "phone"), _digits(F.col("match"))).otherwise(F.lower("match")))
    return found.select(*KEY, "kind", "start", "end", entity.alias("entity"))


def _terms(rows: DataFrame, *more: str) -> DataFrame:
    """`more` columns and term: the distinct terms of each text."""
    return rows.select(*more, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))


def revealing(keyed: DataFrame, found: DataFrame, generalise: float, least: int) -> tuple[DataFrame, DataFrame]:
    """term, share (the largest over entities of the entity's information that it gives away), inside (no document without
    a mention holds it); and KEY, term of documents with mentions. Counts are those of whole texts of the corpus.

    As n_both <= n_entity, a term in more than N * (n_entity / N)^generalise documents can't reach the share: such pairs
    are dropped before they are counted, which changes no result.
    """
    n = keyed.count()
    pairs = found.select(*KEY, "entity").distinct()
    of_entity = written(pairs.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") < n), "entities")
    reach = F.lit(float(n)) * F.pow(F.col("n_entity") / F.lit(float(max(n, 1))), F.lit(generalise)) * (1 + 1e-9)
    own = written(matched(pairs, of_entity, "entity").withColumn("reach", reach), "entity-rows")
    counts = written(_terms(keyed).groupBy("term").agg(F.count("*").alias("n_term")), "terms")
    # At most a thousand times the mean number of terms of a text; the others have no hot key.
    limit = n / 1000
    common = counts.where(F.col("n_term") > limit).select("term", F.col("n_term").alias("n_common"))
    bound = written(own.groupBy(*KEY).agg(F.max("reach").alias("row_reach")), "mention-rows")
    held = _terms(matched(keyed.select(*KEY, "text"), bound, KEY), *KEY, "row_reach").join(F.broadcast(common), "term", "left")
    held = written(held.where("n_common is null or n_common <= row_reach"), "held-terms")
    rare = held.where("n_common is null").join(counts.where(F.col("n_term") <= limit), "term").where("n_term <= row_reach")
    terms = held.where("n_common is not null").select(*KEY, "term", F.col("n_common").alias("n_term")).union(rare.select(*KEY, "term", "n_term"))
    terms = written(terms.distinct(), "mention-terms")
    both = terms.join(own, KEY).where("n_term <= reach").groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term"))
    share = F.log(F.col("n_both") * n / (F.col("n_entity") * F.greatest("n_term", "n_both"))) / F.log(n / F.col("n_entity"))
    strong = both.where(F.col("n_both") >= least).withColumn("share", share).where(F.col("share") >= generalise)
    strong = strong.groupBy("term").agg(F.max("share").alias("share"), F.max("n_term").alias("n_term"))
    seen = terms.groupBy("term").agg(F.count("*").alias("n_seen"))
    return written(strong.join(seen, "term").select("term", "share", (F.col("n_seen") >= F.col("n_term")).alias("inside")), "revealing"), terms.select(*KEY, "term")


def spans(docs: DataFrame, generalise: float = 0.9, remove: float = 0.98, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """`docs` with the columns KEY; and KEY, kind, start, end (code points, end exclusive), share of all spans found.

    A term needs `least` documents with the entity. Terms inside base spans have no span of their own. Null
    and empty texts have none; rows of one doc_id and text have the same spans.
    """
    settle(docs.sparkSession)
    keyed = _keyed(docs)
    found = written(mentions(keyed), "mentions")
    strong, held = revealing(keyed, found, generalise, least)
    # Only terms that other documents hold as well are looked for in the whole corpus.
    wide = written(strong.where("not inside").select("term", "share"), "wide-terms")
    wanted = matched(held, written(strong.where("inside").select("term", "share"), "inside-terms"), "term").unionByName(matched(_terms(keyed, *KEY), wide, "term").distinct())
    wanted = written(wanted, "wanted-terms")
    each = wanted.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_list("term")), "|").alias("terms"), F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    each = F.broadcast(each) if wanted.count() <= BROADCAST_ROWS else each.hint("shuffle_merge")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("terms"), F.lit(r")(?!\p{L})"))
    rows = keyed.select(*KEY, "text").join(each, KEY).select(*KEY, "shares", F.split("text", pattern, -1).alias("pieces"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("found"))
    # What only the pattern takes for the same letters (long s) gets the largest share.
    rows = rows.withColumn("share", F.transform("found", lambda m: F.coalesce(F.try_element_at("shares", F.lower(m)), F.array_max(F.map_values("shares")))))
    terms = _placed(rows, KEY, "share").select(*KEY, F.lit("term").alias("kind"), "start", "end", "share")
    base = found.select(*KEY, "kind", "start", "end", F.lit(1.0).alias("share")).distinct()
    taken = base.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("taken"))
    over = F.exists("taken", lambda x: (x["start"] < F.col("end")) & (x["end"] > F.col("start")))
    free = terms.join(taken, KEY, "left").where(~F.coalesce(over, F.lit(False))).drop("taken")
    return keyed, base.unionByName(free)


def digest(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_spans, spans (kind:start:end by kind as listed, then start,
    joined by commas) of every row of `docs`."""
    keyed, all_spans = spans(docs, **limits)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct(order.alias("order"), "start", "end", F.concat_ws(":", "kind", "start", "end").alias("span"))
    each = all_spans.groupBy(*KEY).agg(F.sort_array(F.collect_set(one)).alias("own"))
    own = F.coalesce("own", F.array().cast("array<struct<order:bigint,start:bigint,end:bigint,span:string>>"))
    rows = keyed.select("doc_id", *KEY).join(each, KEY, "left").withColumn("own", own)

    def joined(keep):
        return F.array_join(F.transform(F.filter("own", keep), lambda x: x["span"]), ",")

    def of(k):
        return lambda x: x["order"] == k

    counts = [F.size(F.filter("own", of(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS, 1)]
    return rows.select("doc_id", *counts, joined(lambda x: x["order"] < len(KINDS)).alias("base_spans"), joined(lambda x: F.lit(True)).alias("spans"))


def sanitised(docs: DataFrame, generalise: float = 0.9, remove: float = 0.98, least: int = 1) -> DataFrame:
    """`docs` with base spans masked by their kind, revealing terms generalised to [TERM] or removed; n_chars, if there, is
    recounted. Overlapping spans are masked as the one that starts first."""
    keyed, all_spans = spans(docs, generalise, remove, least)
    label = F.when(F.col("kind") != "term", F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).when(F.col("share") >= remove, F.lit("")).otherwise(F.lit("[TERM]"))
    w = Window.partitionBy(*KEY).orderBy("start", F.col("end").desc(), "kind")
    reach = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = all_spans.withColumn("label", label).withColumn("reach", reach).where("end > reach")
    cut = cut.withColumn("label", F.when(F.col("start") < F.col("reach"), F.lit("")).otherwise(F.col("label")))
    each = cut.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end", "reach", "label"))).alias("cuts"))
    text = F.concat(F.array_join(F.transform("cuts", lambda x: F.concat(F.substring("text", (x["reach"] + 1).cast("int"), F.greatest(x["start"] - x["reach"], F.lit(0)).cast("int")), x["label"])), ""),
                    F.substring("text", (F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length("text")))
    out = keyed.join(each, KEY, "left").withColumn("text", F.when(F.col("cuts").isNotNull(), text).otherwise(F.col("text"))).drop("cuts", *KEY)
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(*docs.columns)
