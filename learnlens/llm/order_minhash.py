"""Document fingerprints by Order MinHash, with built-in functions only.

The symbols of a text are its words (runs without white space, cut after
``WORD_CHARS`` characters, so a text without spaces has symbols too); its
k-mers are ``K`` words in a row. Equal k-mers are numbered by their occurrence,
which makes every element of a text different, and each numbered k-mer gets a
hash. The one-permutation form of the sketch is used: the hash's leading bits
deal the elements into ``2 ** BIN_BITS`` bins, and of every bin the ``L`` with the
minimal hashes are selected, put back into the order of the text, and hashed as
a tuple. Two texts agree in a bin if the same numbered k-mers are minimal there
*and* stand in the same order; so, unlike a plain MinHash, moved passages
lower the likeness, as they raise the edit distance.

Likeness: agreeing bins over the bins that are not empty in both; 1 for two
texts without words.

Everything happens inside arrays of long integers, in time n log n for a text
of n words: a sort brings equal k-mers together, and sorts and slices replace
every look-up (see ``runs``).

Cases: a null text is the empty text, whose fingerprint is empty; equal texts
have equal fingerprints; a text of fewer than K words is one k-mer. Documents are
in descending order of id (null last), equal ids by the texts' hash; the next
document of the last is the first, so a single one is its own next. An empty
table gives no rows; other columns are not read. Positions count modulo 2**24
words.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnlens.llm.common import text_of

K, L, BIN_BITS = 3, 2, 5
WORD_CHARS = 16
POSITION_BITS = 24
# Rows of one range of ids, about, and the most ranges.
RANGE_ROWS, MAX_RANGES = 2_000, 8_192


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def shifted(a: Column, by: int) -> Column:
    """The element ``by`` places before each one, null at the beginning."""
    return F.slice(F.concat(F.array_repeat(F.lit(None).cast("long"), by), a), F.lit(1), F.size(a))


def runs(a: Column, key: Callable[[Column], Column]) -> Column:
    """(b, e) of every run of equal keys in a sorted array, from 0, e exclusive."""
    first = F.zip_with(a, shifted(a, 1), lambda x, y: y.isNull() | (key(x) != key(y)))
    starts = F.filter(F.transform(first, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())

    def ends(s: Column) -> Column:
        after = F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), F.array(F.size(a)))
        # An empty array has an end and no start.
        return F.filter(F.zip_with(s, after, lambda b, e: F.struct(b.alias("b"), e.alias("e"))), lambda r: r["b"].isNotNull())

    return let(starts, ends)


def fingerprint(text: Column) -> Column:
    """One long for each bin that is not empty: the bin's number, then 32 bits
    of its tuple's hash; in the order of the bins."""
    low = (1 << POSITION_BITS) - 1
    words = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{WORD_CHARS}}}"), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    # A k-mer is its words' hashes; beyond the end there are none.
    kmers = lambda h: F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - (K - 1), F.least(F.size(h), F.lit(1)))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)]).bitwiseAND(F.lit(~low)).bitwiseOR(i.bitwiseAND(low).cast("long")),
    )
    in_order = F.sort_array(let(hashes, kmers))

    def elements(s: Column) -> Column:
        """Numbered k-mers: 40 bits of hash, then the position."""
        numbered = lambda x, o: F.xxhash64(F.shiftright(x, POSITION_BITS), o).bitwiseAND(F.lit(~low)).bitwiseOR(x.bitwiseAND(low))
        return F.flatten(
            F.transform(runs(s, lambda x: F.shiftright(x, POSITION_BITS)), lambda r: F.transform(F.slice(s, r["b"] + 1, r["e"] - r["b"]), numbered))
        )

    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    # Sorted, the elements of a bin lie together; the first L of a bin have none of it L places before.
    smallest = lambda s: F.array_compact(
        F.zip_with(s, shifted(s, L), lambda x, y: F.when(y.isNull() | (bin_of(x) != bin_of(y)), x))
    )
    chosen = let(F.sort_array(let(in_order, elements)), smallest)

    def tuples(s: Column) -> Column:
        def one(r: Column) -> Column:
            own = F.slice(s, r["b"] + 1, r["e"] - r["b"])
            placed = F.sort_array(F.transform(own, lambda x: F.struct(x.bitwiseAND(low).alias("p"), F.shiftright(x, POSITION_BITS).alias("h"))))
            value = F.xxhash64(F.transform(placed, lambda x: x["h"])).bitwiseAND(F.lit(0xFFFFFFFF))
            number = bin_of(F.get(s, r["b"])) + (1 << (BIN_BITS - 1))
            return F.shiftleft(number, 32).bitwiseOR(value)

        return F.transform(runs(s, bin_of), one)

    return let(chosen, tuples)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / used)


def as_string(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda v: F.lpad(F.hex(v), 10, "0")), ""))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): every document and the one after
    it, without a task that sees all of them.

    Ranges of ids (their limits are percentiles) are windows of their own; the
    first document of a range is also sent to the range before it, as the next
    one of that range's last document.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("h", F.xxhash64("text"))
    n = docs.count()
    parts = min(MAX_RANGES, max(1, math.ceil(n / RANGE_ROWS)))
    wanted = [i / parts for i in range(1, parts)]
    limits = docs.agg(F.percentile_approx("doc_id", wanted, 10 * parts).alias("p")).first().p if wanted and n else None
    below = F.array(*[F.lit(x) for x in sorted(set(limits or []))]).cast("array<long>")
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(below, lambda x: x < F.col("doc_id"))))
    rows = rows.withColumn("range", place)
    heads = rows.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("head")).orderBy(F.desc("range")).collect()
    # The head of a range follows the last document of the range before it; the first head follows the very last.
    follows = [(h.head.doc_id, h.head.h, heads[i - 1].range) for i, h in enumerate(heads)]
    follows = F.broadcast(docs.sparkSession.createDataFrame(follows, "id long, hh long, before int"))  # MAX_RANGES rows at most
    guests = rows.join(follows, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hh"))).select(
        "doc_id", "text", "h", F.col("before").alias("range"), F.lit(1).alias("guest")
    )
    everyone = rows.withColumn("guest", F.lit(0)).unionByName(guests).withColumn("fp", fingerprint(F.col("text")))
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("h"))
    return (
        everyone.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_fp", F.lead("fp").over(order))
        .where("guest = 0")
        .select("doc_id", "text", "fp", "next_text", "next_fp")
    )


def edited(text: Column, after: Column) -> Column:
    """The second half (rounded down) replaced by as much of the next text's beginning."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(after, F.lit(1), half))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) per row of ``docs`` (doc_id, text)."""
    rows = with_next(docs)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_fp", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
