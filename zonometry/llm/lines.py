"""Line dedup by a deletion-neighbourhood join, in words.

Two lines are the same line when their words are equal, and near-equal when one word is inserted, deleted
or replaced between them. Every line emits the hashes of itself and of all its variants with one word
deleted; lines within the bound meet in an equal variant, and the edit is verified on the words. Of each
set of lines that meet, only the earliest is compared with the others, so copies never become pairs. A
line goes if an earlier line lies within the bound (judged on the input); the earliest stays.

Only lines that can have a partner emit variants: one edit leaves the first or the last half of the words as they
are, so lines that share no half with another line are put aside first, without loss. A variant's hash is
an exclusive or of word-and-place hashes, so running exclusive ors give all variants of a line without
hashing any word twice. Bloom filters keep lines and texts that a join cannot need out of its shuffle. Only DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonometry.llm import bloom
from zonometry.llm import common as C
from zonometry.session import scratch, stage

MIN_WORDS = 3  # shorter lines are never touched, unless every line is asked for
EDIT_WORDS = 10  # lines of fewer words must be equal to be dropped, or one character apart if every line is asked for
EDIT_CHARS = 40  # and they have so many characters
LAST_ID = "9223372036854775807"


def words(line: str | Column, every: bool = False) -> Column:
    """What blanks separate; with ``every``, what any white space separates."""
    return F.filter(F.split(line, r"(?U)\s+" if every else " "), lambda w: w != "")


def _half(side: int, size: Column) -> Column:
    part = F.slice("w", F.lit(1), size) if side == 0 else F.slice("w", F.col("n") - size + 1, size)
    return F.when(F.col("n") >= EDIT_WORDS, F.xxhash64(F.lit(side), size, part))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``row, pos, line, raw`` of all lines: ``row`` names the row, ``pos`` orders all lines."""
    ident = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID).cast("long"))
    rows = docs.select(ident.alias("id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("line", "raw"))
    return rows.select("row", (F.col("id").cast("decimal(20,0)") * F.lit(10_000_000_000).cast("decimal(11,0)") + F.col("line")).cast("decimal(38,0)").alias("pos"), "line", "raw")


def _hashed(rows: DataFrame, every: bool = False) -> DataFrame:
    """Lines of ``MIN_WORDS`` words or more, with words ``w``, their number ``n`` and two hashes of them.

    With ``every``, all lines that are not blank; in those of few words and ``EDIT_CHARS`` characters or more, ``w`` becomes
    their characters after two line feeds, which keep them two edits away from any words.
    """
    rows = rows.withColumn("w", words("raw", every)).withColumn("n", F.size("w")).where(F.col("n") >= (1 if every else MIN_WORDS))
    rows = rows.withColumn("h1", F.xxhash64("w")).withColumn("h2", F.xxhash64(F.lit(2), "w"))
    if not every:
        return rows
    flat = F.array_join("w", " ")
    chars = F.concat(F.array(F.lit("\n"), F.lit("\n")), F.filter(F.split(flat, ""), lambda c: c != ""))
    w = F.when(F.col("n") >= EDIT_WORDS, F.col("w")).when(F.length(flat) >= EDIT_CHARS, chars).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("w", w).withColumn("n", F.size("w"))


def _upto(values: Column) -> Column:
    """Running exclusive or of a short array."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.array().cast("array<long>").alias("out"))

    def add(acc: Column, v: Column) -> Column:
        return F.struct(acc.x.bitwiseXOR(v).alias("x"), F.array_append(acc.out, acc.x.bitwiseXOR(v)).alias("out"))

    return F.aggregate(values, start, add, lambda acc: acc.out)


def _running_xor(values: Column) -> Column:
    """Running exclusive or of an array, by blocks of about the root of its size, so that no array grows one by one to full length."""
    size = F.ceil(F.sqrt(F.size(values))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / size).cast("int") - 1), lambda b: _upto(F.slice(values, b * size + 1, size)))
    return F.transform(F.array(blocks), lambda inner: F.flatten(F.zip_with(
        inner, F.slice(F.concat(F.array(F.lit(0).cast("long")), _upto(F.transform(inner, lambda x: F.element_at(x, -1)))), 1, F.size(inner)),
        lambda x, off: F.transform(x, lambda v: v.bitwiseXOR(off)))))[0]


def _variants(kept: DataFrame) -> DataFrame:
    """``key, at, h1``: each line itself (``at`` -1) and without its word ``at``."""
    here, left = F.transform("w", lambda x, i: F.xxhash64(i, x)), F.transform("w", lambda x, i: F.xxhash64(i - 1, x))
    runs = kept.select("h1", "n", here.alias("here"), left.alias("left")).select("*", _running_xor(F.col("here")).alias("a"), _running_xor(F.col("left")).alias("b"))
    whole = F.element_at("a", -1)
    cut = F.transform("here", lambda x, i: F.xxhash64(F.get("a", i).bitwiseXOR(x).bitwiseXOR(F.element_at("b", -1)).bitwiseXOR(F.get("b", i)), F.col("n") - 1))
    both = runs.select("h1", F.posexplode(F.array_append(cut, F.xxhash64(whole, F.col("n")))).alias("at", "key"), "n")
    return both.select("key", F.when(F.col("at") == F.col("n"), F.lit(-1)).otherwise(F.col("at")).alias("at"), "h1")


def within_one_edit(a: Column, b: Column) -> Column:
    """True if one word inserted, deleted or replaced turns array ``a`` into ``b``, or none."""
    n, m = F.size(a), F.size(b)
    split = F.array_position(F.zip_with(a, F.slice(b, 1, F.least(n, m)), lambda x, y: x.eqNullSafe(y)), False).cast("int")
    at = F.when(split == 0, F.least(n, m) + 1).otherwise(split)  # first place, from 1, where the words differ
    rest = lambda x, skip: F.slice(x, at + skip, F.greatest(F.size(x), F.lit(1)))
    return F.when(n == m, rest(a, 1) == rest(b, 1)).when(n == m + 1, rest(a, 1) == rest(b, 0)).when(n + 1 == m, rest(a, 0) == rest(b, 1)).otherwise(False)


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """``row, line`` of every line to drop; ``row`` is ``xxhash64(doc_id, text)``, ``line`` counts from 0.

    Lines are ordered by the id (null last), then by their number. Rows that repeat an id and a text are one
    document, and none of them drops the others' lines. Null and empty texts have no lines to drop.
    """
    half = F.floor(F.col("n") / 2).cast("int")
    less = F.when(F.col("n") % 2 == 0, half - 1)  # as the longer one of a pair whose shorter one has an odd number of words
    keys = [_half(0, half), _half(1, half), *[F.when(less.isNotNull(), _half(s, less)) for s in (0, 1)]]
    lines = stage(_hashed(_lines(docs, doc_id, text), every).select("row", "pos", "line", "h1", "h2", *[k.alias(f"k{i}") for i, k in enumerate(keys)]), "lines")
    each = lines.groupBy("h1", "h2").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)])
    each = stage(each, "distinct-lines")

    # one row a distinct line and key: a key that stands once has no second line
    halves = each.select("h1", F.explode(F.array_compact(F.array(*[F.col(f"k{i}") for i in range(4)]))).alias("k"))
    shared = halves.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    able = stage(halves.join(shared, "k", "left_semi").select("h1").distinct(), "partnered-hashes")
    at = stage(each.select("h1", F.col("first").alias("pos")).join(able, "h1", "left_semi").select("pos"), "partnered-places")
    blocks, n_blocks = bloom.build(at, "pos")
    raw = bloom.probe(_lines(docs, doc_id, text).select("pos", "raw"), "pos", blocks, n_blocks, "may").where("may").select("pos", "raw").join(at, "pos", "left_semi")
    kept = stage(_hashed(raw, every).where(F.col("n") >= EDIT_WORDS).dropDuplicates(["h1"]).select("h1", "h2", "pos", "n", "w"), "partnered-lines")

    variants = stage(_variants(kept), "variants")
    meet = variants.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    met = stage(variants.join(meet, "key", "left_semi").join(kept.select("h1", "pos"), "h1"), "equal-variants")
    cut, self = met.where("at >= 0"), met.where("at < 0").select("key", F.col("h1").alias("s1"), F.col("pos").alias("sp"))
    head = cut.groupBy("key", "at").agg(F.min("pos").alias("to"), F.max("pos").alias("hi")).where("to < hi").drop("hi")
    replaced = cut.join(head, ["key", "at"]).where("pos > to").select("h1", "to")
    longer = cut.join(self, "key").where("pos > sp").select("h1", F.col("sp").alias("to"))
    shorter = cut.groupBy("key").agg(F.min("pos").alias("to")).join(self, "key").where("to < sp").select(F.col("s1").alias("h1"), "to")
    found = replaced.union(longer).union(shorter).distinct()
    own, other = kept.select("h1", "h2", "w"), kept.select(F.col("pos").alias("to"), F.col("w").alias("w2"))
    near = found.join(own, "h1").join(other, "to").where(within_one_edit(F.col("w"), F.col("w2"))).select("h1", "h2").distinct()

    told = each.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("near or first < last").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    told = stage(told, "told-lines")
    return lines.select("row", "line", "pos", "h1", "h2").join(told, ["h1", "h2"]).where("near or pos > first").select("row", "line").distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: bool = False) -> DataFrame:
    """Documents with ``text`` reduced to the lines that stay, and ``n_lines, n_dropped``.

    Lines of fewer than ``MIN_WORDS`` words always stay, unless ``every`` line is asked for: then words end at any white space,
    copies of all lines that are not blank go, and lines of few words but ``EDIT_CHARS`` characters go also when one character
    makes the difference. A text of which no line stays is empty, a null text
    stays null with 0 lines. Extra columns pass through; names that the result adds are refused.
    """
    C.require_free(docs, "n_lines", "n_dropped", "__row", "__may", "__drop", "__lines")
    with scratch(docs.sparkSession):
        gone = duplicate_lines(docs, doc_id, text, every).groupBy("row").agg(F.collect_set("line").alias("__drop"))
        gone = stage(gone, "dropped-lines", keep=True)
    blocks, n_blocks = bloom.build(gone, "row")
    keyed = bloom.probe(docs.withColumn("__row", F.xxhash64(F.col(doc_id), F.col(text))), "__row", blocks, n_blocks, "__may")
    whole = keyed.where("not __may").withColumn("__drop", F.lit(None).cast("array<int>"))  # these surely lose nothing, and stay where they are
    joined = keyed.where("__may").join(gone.withColumnRenamed("row", "__row"), "__row", "left")
    joined = whole.unionByName(joined).withColumn("__lines", F.split(text, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    new = F.when(F.col("__drop").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n"))
    n_lines = F.coalesce(F.size("__lines"), F.lit(0))
    counts = [F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return joined.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns], *counts)
