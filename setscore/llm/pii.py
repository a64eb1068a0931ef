"""Personal data, and terms that reveal it: information-theoretic sanitisation.

Base spans are e-mail addresses, IPs, payment cards and phone numbers. They are the protected
entities. The method estimates from the whole corpus how strongly a term of an entity's texts gives
it away. With document frequencies over N documents, an entity e carries IC(e) = -log2 p(e), and a
term t discloses PMI(t; e) = log2(p(t, e) / (p(t) p(e))) of it; all three count documents by their
whole texts, the words inside entities included. A term whose share PMI / IC reaches ``GENERALISE``
is exchanged for its class, and one that reaches ``REMOVE`` is taken out, at every place outside
entities in each text that holds the entity. Pairs that fewer than ``SUPPORT`` different texts show
say nothing and are left.

Everything is DataFrame functions. Entities are written once, with the texts that have any.
Frequencies are partial sums per term before their shuffle; pairs likewise, so a hot entity or a
frequent word is one row per task. Pairs are made only where they can reach a threshold: the entity
and the term stand in ``SUPPORT`` texts or more, and n(t) <= n(e) (N / n(e)) ** (1 - GENERALISE), as
n(t, e) <= n(e). A text with very many pairs is dealt over several tasks by its terms. Terms depend
on the text alone, so they are found once per different text and joined back by its hash; copies
aren't expanded.

Nulls and empty texts have no spans. Repeated rows each give their own row and each count in the
frequencies. Other columns are left out; their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setscore.llm import spans as S
from setscore.llm.common import LOWER, UPPER, materialise, table

# The base patterns. In a marked copy of the text, S.MARK stands for a dot between two
# characters of a host name, or for a blank or hyphen between two digits; so no group repeats.
# An address can only begin where its run of characters begins, or where the match before it ended.
EMAIL_DOT = r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"
EMAIL = (rf"(?:\G|(?<![A-Za-z0-9._%+{S.MARK}-]))[A-Za-z0-9._%+{S.MARK}-]++@"
         rf"[A-Za-z0-9-]+{S.MARK}[A-Za-z0-9{S.MARK}-]+")
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD_GAP = r"(?<=[0-9])[\x20-](?=[0-9])"
CARD = rf"[0-9][0-9{S.MARK}]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{N}]+"
KINDS = ["email", "ip", "card", "phone"]

PAIRS = 1 << 20          # pairs of a text that one task makes
SUPPORT = 3              # different texts that must show a pair
GENERALISE = 0.8         # share of an entity's information
REMOVE = 0.95


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(d)).alias("sum"), (~acc["odd"]).alias("odd"))
    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, step, lambda a: a["sum"] % 10 == 0)


def entity_spans(text: Column) -> Column:
    """Spans of all four kinds, sorted by kind as listed, then start."""
    def card(m: Column) -> Column:
        d = _digits(m)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)

    return S.by_kind(F.concat(
        S.match_spans(S.marked(text, EMAIL_DOT), EMAIL, 0, "email", lambda m: F.lit(True), F.contains(text, F.lit("@")), text),
        S.match_spans(text, IP, 1, "ip", lambda m: m.rlike(rf"^{BYTE}(\.{BYTE}){{3}}$"), text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        S.match_spans(S.marked(text, CARD_GAP), CARD, 2, "card", card, text.rlike(r"[0-9]([\x20-]?[0-9]){15}"), text),
        S.match_spans(text, PHONE, 3, "phone", lambda m: F.length(_digits(m)).between(8, 15), text.rlike(r"\+[0-9]"))))


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def find_entities(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(row, base, text_key, text) per document, written once. text is null without entities; text_key
    is then the row's own, so that such rows spread over the join that follows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"))
    found = found.withColumn("base", entity_spans(F.col("text")))
    has = F.size("base") > 0
    return materialise(found.select("row", "base", F.when(has, F.md5("text")).otherwise(
                                        F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).alias("text_key"),
                                    F.when(has, F.col("text")).alias("text")), "pii")


def _terms(text: Column) -> Column:
    """The different words of a text, A-Z lower-cased."""
    return F.array_distinct(F.regexp_extract_all(_lower(text), F.lit(TERM), F.lit(0)))


def held_entities(found: DataFrame) -> DataFrame:
    """(text_key, n, kind, value, n_entity, total): the entities of each different text with entities
    that SUPPORT texts or more hold; n documents have the text, n_entity hold the entity, of total."""
    held = found.where(F.col("text").isNotNull()).groupBy("text_key").agg(F.count(F.lit(1)).alias("n"), F.first("base").alias("base"))
    every = held.select("text_key", "n", F.explode(F.array_distinct(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))).alias("e"))
    every = materialise(every.select("text_key", "n", "e.kind", "e.value"), "pii-held")
    known = (every.groupBy("kind", "value").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("n_texts"))
                  .where(F.col("n_texts") >= SUPPORT).select("kind", "value", "n_entity"))
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return materialise(every.join(known, ["kind", "value"]).withColumn("total", total), "pii-known")


def texts_of_entities(found: DataFrame, held: DataFrame) -> DataFrame:
    """(text_key, text) of the different texts that hold a known entity."""
    keys = held.select("text_key").distinct()
    return found.where(F.col("text").isNotNull()).join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))


def disclosures(docs: DataFrame, texts: DataFrame, held: DataFrame) -> DataFrame:
    """(kind, value, term, action): pairs whose disclosed share reaches a threshold."""
    n_term = docs.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    # the most frequent term that can reach a threshold for an entity
    reach = F.pow(F.col("n_entity").cast("double"), F.lit(GENERALISE)) * F.pow(F.col("total").cast("double"), F.lit(1 - GENERALISE)) * (1 + 1e-9)
    held = held.withColumn("reach", reach)
    per_text = held.groupBy("text_key").agg(F.max("reach").alias("text_reach"), F.count(F.lit(1)).alias("n_entities"))
    rows = texts.join(per_text, "text_key").select("text_key", "text_reach", "n_entities", _terms(F.col("text")).alias("terms"))
    parts = F.ceil(F.col("n_entities") * F.size("terms") / PAIRS).cast("int")
    rows = materialise(rows.withColumn("parts", F.greatest(F.lit(1), parts)), "pii-terms")
    some = rows.select("text_key", "text_reach", "parts", F.explode("terms").alias("term")).join(n_term.where(F.col("n_term") >= SUPPORT), "term")
    some = some.where(F.col("n_term") <= F.col("text_reach")).select(
        "text_key", "term", "n_term", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"))
    dealt = held.join(rows.select("text_key", "parts"), "text_key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = some.join(dealt, ["text_key", "part"]).where(F.col("n_term") <= F.col("reach"))
    pairs = (pairs.groupBy("kind", "value", "term", "n_term", "n_entity", "total").agg(F.sum("n").alias("n_pair"), F.count(F.lit(1)).alias("n_texts"))
                  .where(F.col("n_texts") >= SUPPORT))
    # IC - PMI = -log2 p(e|t)
    ic = F.log2(F.col("total") / F.col("n_entity"))
    share = F.when(ic > 0, 1 - F.log2(F.col("n_term") / F.least("n_pair", "n_term")) / ic)
    return pairs.withColumn("share", share).where(F.col("share") >= GENERALISE).select(
        "kind", "value", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def disclosing_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, with base (entities) and terms (what reveals them)."""
    found = find_entities(docs, keep)
    held = held_entities(found)
    texts = materialise(texts_of_entities(found, held), "pii-texts")
    pairs = materialise(disclosures(docs, texts, held), "pii-pairs")
    marks = (held.join(pairs, ["kind", "value"]).groupBy("text_key", "term").agg(F.max("action").alias("action"))
                 .groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("marks")))
    places = S.match_spans(_lower(F.col("text")), TERM, len(KINDS), "term", lambda m: F.map_contains_key(F.col("marks"), m), F.lit(True))
    told = texts.join(marks, "text_key").select("text_key", "marks", places.alias("places"))
    told = told.select("text_key", F.transform("places", lambda s: F.struct(
        s["start"].alias("start"), s["kind_no"].alias("kind_no"), F.try_element_at(F.col("marks"), s["value"]).alias("kind"),
        s["end"].alias("end"), s["value"].alias("value"))).alias("told"))
    out = found.join(told, "text_key", "left")
    return out.select("row.*", "base", S.beside(F.coalesce("told", S.no_spans()), F.col("base")).alias("terms"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and the text with entities and generalised terms exchanged for their classes, and
    removed terms taken out; null stays null."""
    word = lambda s: (F.when(s["kind"] == "remove", "")
                      .when(s["kind"] != "generalise", F.concat(F.lit("["), s["kind"], F.lit("]")))
                      .when(s["value"].rlike(r"^\p{N}+$"), "[number]").when(s["value"].rlike(r"\p{N}"), "[code]").otherwise("[term]"))
    found = disclosing_spans(docs, keep=("doc_id", "text"))
    return found.select("doc_id", S.replaced(F.col("text"), F.concat("base", "terms"), word).alias("text"))


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosing_spans(table(spark, sf_dir, "documents"))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind_no"].alias("kind_no"),
                                                    F.lit("term").alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return found.select("doc_id", *[S.count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
                        F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"),
                        S.joined(F.concat("base", terms)).alias("spans"), F.size("terms").cast("long").alias("n_term"))


QUERIES = {"op6_disclosure": op6_disclosure}
