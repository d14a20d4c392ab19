"""One form for texts that look the same.

The look-alike map turns full-width and joined forms, kinds of spaces, characters
without width and letters of another script into one character each; Spark's
accent-sensitive, case-sensitive ``UNICODE`` collation then makes composed and
decomposed accents equal. Texts of one class are grouped under that collation, the
smallest text (by bytes) is the class's canonical member, and it is joined back.

Collated keys are compared by a collator, which is slow, and carry whole texts. So
texts are first grouped by the hash of a skeleton without accents, which equal
looking texts always share; only skeletons with two different texts, few of all, go
on. The first grouping moves a few numbers per text and combines on the map side,
so a text repeated in a third of all rows costs one row per task. Texts are told apart, and
joined, by 128 hashed bits, never by their characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import lookalike
from sightline.session import cut

COLLATION = "UNICODE"
#: A text without such a character is blank.
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}]"
#: Parts that the rows of one text are joined in.
SALTS = 16


def _mapped(text: Column, table: dict[str, str | None]) -> Column:
    """``text`` with single characters translated, joined forms spelt out, characters without width dropped."""
    single = {k: v for k, v in table.items() if v is not None and len(v) == 1}
    longer = {k: v for k, v in table.items() if v is not None and len(v) > 1}
    dropped = [k for k, v in lookalike.character_map().items() if v is None]
    # translate() drops characters that have no counterpart
    out = F.translate(text, "".join([*single, *dropped]), "".join(single.values()))
    if longer:
        spelt = out
        for char, parts in longer.items():
            spelt = F.replace(spelt, F.lit(char), F.lit(parts))
        any_joined = "[" + "".join(longer) + "]"
        out = F.when(out.rlike(any_joined), spelt).otherwise(out)
    return F.when(text.rlike(r"[^\x00-\x7f]"), out).otherwise(text)


def look_column(text: Column) -> Column:
    """The look-alike-mapped text, to be compared under ``COLLATION``."""
    return _mapped(text, lookalike.character_map())


def skeleton_column(text: Column) -> Column:
    """What remains equal for all texts that look the same; many others share it too."""
    joined = {k: v for k, v in lookalike.character_map().items() if v is not None and len(v) > 1}
    plain = {k: "".join(lookalike.base_map().get(c, c) for c in v) for k, v in joined.items()}
    folded = _mapped(text, lookalike.base_map() | {k: v for k, v in plain.items() if k not in lookalike.base_map()})
    return F.regexp_replace(folded, r"[\p{M}\p{C}\p{IsHangul}]", "")


def text_key(text: Column) -> Column:
    """128 hashed bits of a text: what joins and groups compare."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(0x5BD1E995), text).alias("b"))


def suspects(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, skeleton, key) and (key, skeleton, text) of texts that share a skeleton with a different text.

    Skeletons are made once a row and written without the text; texts are fetched by key for suspects only.
    """
    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(VISIBLE))
    keyed = cut(named.select("doc_id", text_key(F.col("text")).alias("key"), F.xxhash64(skeleton_column(F.col("text"))).alias("skeleton")), "skeletons")
    shared = keyed.groupBy("skeleton").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("skeleton")
    rows = cut(keyed.join(shared, "skeleton", "left_semi"), "suspects")
    first = rows.groupBy("key", "skeleton").agg(F.count("*").alias("_n")).select("key", "skeleton")
    texts = named.select("text", text_key(F.col("text")).alias("key")).join(first, "key").groupBy("key", "skeleton").agg(F.min("text").alias("text"))
    return rows, texts


def variants(texts: DataFrame) -> DataFrame:
    """(key, class, canonical) of suspect texts that look like another: the least text of the class, whose key names it."""
    looked = texts.withColumn("look", F.collate(look_column(F.col("text")), COLLATION))
    classes = looked.groupBy("skeleton", "look").agg(F.min("text").alias("canonical"), F.count("*").alias("members")).where("members > 1")
    return looked.join(classes, ["skeleton", "look"]).select("key", text_key(F.col("canonical")).alias("class"), "canonical")


def canonical_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, canonical) of every row: the canonical member of its class.

    Texts that look like no other text are their own canonical member; null, empty
    and blank texts stay as they are. Repeated rows stay repeated; other columns are
    left behind, whatever their names.
    """
    named = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    changed = cut(variants(suspects(documents, doc_id, text)[1]).where("key <> class").select("key", "canonical"), "changed")
    # rows of a text, and those without one, are spread over parts; the few changed texts are in all
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    keyed = named.select("doc_id", "text", text_key(F.col("text")).alias("key"), salt.alias("salt"))
    everywhere = changed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.join(everywhere, ["key", "salt"], "left").select("doc_id", "text", F.coalesce("canonical", "text").alias("canonical"))


def same_look_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: documents that look the same with different characters.

    Pairs of identical texts are none; null, empty and blank texts and null ids take
    no part; each pair comes once, however often rows are repeated.
    """
    rows, texts = suspects(documents, doc_id, text)
    members = cut(variants(texts).select("key", "class"), "classes")
    holders = rows.where("doc_id IS NOT NULL").select("doc_id", "key").distinct()
    # pairs of different texts of a class, each once; then the documents that hold them
    one = members.select("class", F.col("key").alias("key_a"))
    two = members.select("class", F.col("key").alias("key_b"))
    pairs = one.join(two, "class").where("key_a < key_b").select("key_a", "key_b")
    left = holders.select(F.col("doc_id").alias("one"), F.col("key").alias("key_a"))
    right = holders.select(F.col("doc_id").alias("two"), F.col("key").alias("key_b"))
    both = pairs.join(left, "key_a").join(right, "key_b").where("one <> two")
    return both.select(F.least("one", "two").alias("doc_id_a"), F.greatest("one", "two").alias("doc_id_b")).distinct()
