"""Document fingerprints from closed syncmers (DataFrame operations only).

A text is read as pieces: each word of up to `piece` characters is one, and in longer runs without white space (scripts without spaces,
sequences, junk) every character starts one, of GRAM characters of the run, so that a k-mer spans as much there as its alphabet may need and an edit
in front shifts nothing. A k-mer is k consecutive pieces; its s-mers are the runs of two pieces in it, hashed with xxhash64. A
k-mer is an anchor (a closed syncmer) if its smallest s-mer is the first or the last; that looks at the k-mer alone, so an
edit changes no anchor but those of the k-mers around its own word. About half of all k-mers are anchors. The
fingerprint is all anchors of the text, each with its position, in that order: 12 hex digits of the hash of the k-mer, '@', the
number of its first piece; of neighbouring anchors with the same hash (a run of one word, say) the first counts. The
likeness of two fingerprints is the Jaccard similarity of their sets of hashes.

A text without an anchor (shorter than k pieces, or without a closed k-mer) has one, at 0: the hash of the whole text.

Defined cases: null text is the empty text, which alone has the empty fingerprint; two empty fingerprints are alike (1.0), an
empty and another aren't (0.0); rows that repeat an id follow each other in order of text; null ids come last; an
empty table gives an empty result; a single document is its own next one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import parts

ANCHORS = "array<struct<at:int,hash:bigint>>"
GRAM = 8
MOST = 1 << 15  # ranges of ids; the cuts between them are part of the plan
SOLID = r"[^\x20\x09-\x0D]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once; an expression that a lambda names is evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def pieces(text: Column, piece: int = 12) -> Column:
    """Group 1 looks ahead, so that pieces of a long run overlap; the rest of the pattern says how far to go on."""
    return F.regexp_extract_all(text, F.lit(rf"(?=((?<!{SOLID}){SOLID}{{1,{piece}}}(?!{SOLID})|{SOLID}{{1,{GRAM}}}))(?:(?<!{SOLID}){SOLID}{{1,{piece}}}(?!{SOLID})|{SOLID})"), F.lit(1))


def _closed(h: Column, pairs: Column, k: int) -> Column:
    """Closed syncmers (at, hash) from the hashes of pieces and of their s-mers."""
    last = k - 2  # of the s-mers 0 .. k - 2 of a k-mer
    at = lambda i, d: F.get(pairs, i + d)
    edge = lambda i: F.least(at(i, 0), at(i, last)) <= F.least(*[at(i, d) for d in range(1, last)])
    name = lambda i: F.shiftrightunsigned(F.xxhash64(*[at(i, d) for d in range(0, k - 1, 2)], F.get(h, i + k - 1)), 16)
    spots = F.when(F.size(h) >= k, F.sequence(F.lit(0), F.size(h) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(spots, edge), lambda i: F.struct(i.alias("at"), name(i).alias("hash")))


def anchors(text: Column, k: int = 5, piece: int = 12) -> Column:
    """The fingerprint of a text, as (at, hash) in order of position."""
    hashes = F.transform(pieces(text, piece), lambda w: F.xxhash64(w))
    pairs = lambda h: F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    found = bind(hashes, lambda h: bind(pairs(h), lambda p: _closed(h, p, k)))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.shiftrightunsigned(F.xxhash64(text), 16).alias("hash")))
    fresh = lambda f: F.filter(f, lambda x, i: (i == 0) | (x["hash"] != F.get(f, i - 1)["hash"]))
    return bind(found, lambda f: F.when(F.size(f) > 0, fresh(f)).when(F.length(text) > 0, whole).otherwise(F.array().cast(ANCHORS)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints."""
    both = bind(F.struct(F.array_distinct(a["hash"]).alias("a"), F.array_distinct(b["hash"]).alias("b")), lambda x: F.struct(F.size(x["a"]).alias("a"), F.size(x["b"]).alias("b"), F.size(F.array_intersect(x["a"], x["b"])).alias("shared")))
    return bind(both, lambda x: F.when(x["a"] + x["b"] == 0, F.lit(1.0)).otherwise(x["shared"] / (x["a"] + x["b"] - x["shared"])))


def render(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 12, "0"), F.lit("@"), x["at"].cast("string"))), " ")


def with_next(rows: DataFrame, derived: dict[str, Column], columns: list[str], n: int) -> DataFrame:
    """Adds the derived columns, and next_<column> of the row after each in descending order of doc_id; after the last comes the first.

    rows: doc_id, text. Ids are cut into n ranges at ids that occur (one aggregate, n numbers); the row at the
    top of a range is the one after the lowest of the range above, so it is dealt to that range as well, and the
    highest row of all to the lowest range. Each range is sorted by itself: one shuffle of the texts alone, no global sort;
    what is derived from them is made behind it."""
    spans = rows.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(10 * n)).alias("cuts") if n > 1 else F.array().cast("array<bigint>").alias("cuts"), F.max("doc_id").alias("top")).first()
    cuts, top = sorted(set(spans["cuts"] or [])), spans["top"]
    cut_at = F.from_json(F.lit(str(cuts)), "array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))]) if cuts else F.array().cast("array<int>")
    below = F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(F.get(cut_at, at + s - 1) < F.col("doc_id"), s).otherwise(0))  # cuts below the id, by halving
    own = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(below)
    dealt = F.array(F.struct(own.alias("range"), F.lit(0).alias("turn")))
    dealt = F.concat(dealt, F.when(F.get(cut_at, own) == F.col("doc_id"), F.array(F.struct((own + 1).alias("range"), F.lit(1).alias("turn")))).otherwise(F.array().cast(dealt_type := "array<struct<range:int,turn:int>>")),
                     F.when(F.col("doc_id").eqNullSafe(F.lit(top).cast("bigint")), F.array(F.struct(F.lit(0).alias("range"), F.lit(2).alias("turn")))).otherwise(F.array().cast(dealt_type)))
    copies = rows.select("*", F.explode(dealt).alias("_dealt")).select("*", F.col("_dealt.range").alias("_range"), F.col("_dealt.turn").alias("_turn")).drop("_dealt")
    order = [F.col("_turn"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    sorted_ = copies.repartitionById(n, "_range").sortWithinPartitions("_range", *order).withColumns(derived)
    down = Window.partitionBy("_range").orderBy(*order)
    return sorted_.select("*", *[F.lead(c).over(down).alias(f"next_{c}") for c in columns]).where("_turn = 0").drop("_range", "_turn")


def fingerprints(docs: DataFrame, k: int = 5, piece: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its
    last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document, in
    descending order of id; after the last comes the first."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, {"own": anchors(F.col("text"), k, piece)}, ["text", "own"], min(parts(docs), MOST))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own").withColumn("changed", anchors(F.col("edited"), k, piece))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), render(F.col("own")).alias("fingerprint"), render(F.col("changed")).alias("edited_fingerprint"),
                       likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
