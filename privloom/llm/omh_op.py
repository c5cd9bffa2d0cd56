"""Order MinHash fingerprints, with DataFrame functions only.

A text's tokens (runs of at most eight characters that aren't white space) give k-mers of two tokens, each with its occurrence
number. A hash of both orders the numbered k-mers on a circle; from each of ``BINS`` evenly spaced places a draw selects the ``TUPLE`` next on
the circle, so that every draw holds a whole tuple however few k-mers there are. The selected k-mers are put back into text order and hashed. Two
texts' likeness is the share of equal draws: it falls with k-mers that differ and with k-mers in another order.

Texts of up to ``SHORT`` characters also have a signature of character k-mers, by which two short texts are compared: an edit of a few
words leaves too few k-mers of whole tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.llm.common import let, table

#: Tokens of a k-mer, k-mers of a tuple, draws (a power of two).
KMER, TUPLE, BINS = 2, 2, 64
#: Characters of a k-mer of a short text, and of the longest short text.
SHORT_KMER, SHORT = 3, 400
#: Low bits that hold a position: texts of up to 2^29 tokens.
POSITION_BITS = 29
BLANK = "-" * 8


def signature(tokens: Column, kmer: int, bins: int = BINS) -> Column:
    """Eight hexadecimal digits for each draw over an array of tokens; dashes if there are none."""
    position = (1 << POSITION_BITS) - 1
    clear = ~position & (2**63 - 1)
    shift = 63 - (bins.bit_length() - 1)
    hash_part = lambda x: F.shiftright(x, POSITION_BITS)
    place = lambda x: x.bitwiseAND(F.lit(position))
    bin_of = lambda x: F.shiftright(x, shift).cast("int")
    item = F.get

    def packed(tokens: Column) -> Column:
        """Sorted (k-mer hash, position); a text of fewer tokens than a k-mer has is one k-mer."""
        n = F.greatest(F.size(tokens) - (kmer - 1), F.lit(1))
        one = lambda i: F.xxhash64(*[item(tokens, i + j) for j in range(kmer)]).bitwiseAND(F.lit(clear)).bitwiseOR(i.cast("long"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), one))

    def occurrences(kmers: Column) -> Column:
        """Numbers from 0 for equal k-mers: the lengths of the runs, each counted up."""
        n = F.size(kmers)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (hash_part(item(kmers, i)) != hash_part(item(kmers, i - 1))))
        runs = let(starts, lambda s: F.transform(s, lambda at, j: F.sequence(F.lit(0), F.coalesce(item(s, j + 1), n) - at - 1)))
        return F.flatten(runs)

    def numbered(kmers: Column) -> Column:
        """Sorted (hash of k-mer and occurrence, position): the circle."""
        mixed = F.zip_with(kmers, occurrences(kmers), lambda x, o: F.xxhash64(hash_part(x), o).bitwiseAND(F.lit(clear)).bitwiseOR(place(x)))
        return F.sort_array(mixed)

    def draws(circle: Column) -> Column:
        n = F.size(circle)
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (bin_of(item(circle, i)) != bin_of(item(circle, i - 1))))

        def code(i: Column) -> Column:
            """The digits of the tuple at one place of the circle, in text order."""
            pair = F.struct(item(circle, i).alias("x"), item(circle, F.pmod(i + 1, n)).alias("y"))
            digest = lambda p: F.when(n == 1, F.xxhash64(hash_part(p["x"]))).when(place(p["x"]) < place(p["y"]), F.xxhash64(hash_part(p["x"]), hash_part(p["y"]))).otherwise(F.xxhash64(hash_part(p["y"]), hash_part(p["x"])))
            return F.substring(F.lpad(F.lower(F.hex(let(pair, digest))), 16, "0"), 1, 8)

        def filled(starts: Column) -> Column:
            """Each draw takes the first k-mer at or after its place: bins without one take that of the next that has one."""
            last = bin_of(item(circle, item(starts, F.size(starts) - 1)))
            own = F.transform(starts, lambda i, j: F.repeat(code(i), bin_of(item(circle, i)) - F.when(j == 0, F.lit(-1)).otherwise(bin_of(item(circle, i - 1)))))
            return F.concat(F.array_join(own, ""), F.repeat(code(item(starts, F.lit(0))), F.lit(bins - 1) - last))

        return let(firsts, filled)

    return F.when(F.size(tokens) == 0, F.lit(BLANK * bins)).otherwise(let(packed(tokens), lambda kmers: let(numbered(kmers), draws)))


def fingerprint(text: Column, bins: int = BINS) -> Column:
    """The fingerprint of a text, equal for equal texts: the signature of its tokens, and for a short text that of its characters, in which a run of
    white space is one space."""
    text = F.coalesce(text, F.lit(""))
    letters = F.regexp_extract_all(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("(?s)(.)"), F.lit(1))
    short = F.when(F.char_length(text) <= SHORT, let(letters, lambda x: signature(x, SHORT_KMER, bins))).otherwise(F.lit(""))
    return F.concat(let(F.regexp_extract_all(text, F.lit(r"(\S{1,8})"), F.lit(1)), lambda x: signature(x, KMER, bins)), short)


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Share of equal draws: of characters if both texts are short, else of tokens. 1 for two texts without tokens, 0 if one alone has none."""
    n = 8 * bins
    both = (F.length(a) > n) & (F.length(b) > n)
    part = lambda x: F.when(both, F.substring(x, n + 1, n)).otherwise(F.substring(x, 1, n))
    draw = lambda x, i: F.substr(x, 8 * i + 1, F.lit(8))
    same = lambda x: F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: (draw(x["a"], i) == draw(x["b"], i)) & (draw(x["a"], i) != F.lit(BLANK))))
    return F.when(a == b, 1.0).otherwise(let(F.struct(part(a).alias("a"), part(b).alias("b")), same) / F.lit(float(bins)))


def _cuts_below(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below ``value``: a coarse look at every k-th, then a fine one at the k after it."""
    k = max(1, int(len(cuts) ** 0.5))
    literal = lambda xs: F.from_json(F.lit(str(xs)), "array<bigint>")  # noqa: E731  folded once
    below = lambda xs, v: F.size(F.filter(xs, lambda c: c < v))
    coarse = below(literal(cuts[::k]), value)
    return let(F.struct(value.alias("v"), coarse.alias("c")), lambda x: F.when(x["c"] == 0, 0).otherwise((x["c"] - 1) * k + below(F.slice(literal(cuts), (x["c"] - 1) * k + 1, k), x["v"]))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h, part, sub, guest, turn): the rows of one range of (doc_id, h), and as a guest the first row of the range after it.

    ``h`` is the text's hash, which orders rows of one doc_id. There are as many ranges as the square root of the number of rows, so that ranges
    and what is known of them grow alike. Ranges are cut at percentiles of doc_id; rows of an id that would fill several (and those without
    an id) are cut further by their hashes. The first row of each range is also a guest of the range before (of the last
    range, for the first), and so each row finds the next one at home.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    n = rows.count()
    ranges = max(1, int(n**0.5))
    found = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges), F.count_if(F.col("doc_id").isNull())).first() if ranges > 1 else ([], 0)
    cuts = sorted(set(found[0] or []))
    heavy = [(c, found[0].count(c)) for c in cuts if found[0].count(c) > 1] if len(cuts) < len(found[0] or []) else []
    if found[1] * ranges > n:
        heavy.append((None, found[1] * ranges // n))
    home = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_cuts_below(F.col("doc_id"), cuts))
    rows = rows.withColumn("part", home)
    if heavy:  # fewer ids than ranges
        pieces = F.broadcast(spark.createDataFrame(heavy, "heavy long, pieces int"))
        rows = rows.join(pieces, F.col("doc_id").eqNullSafe(F.col("heavy")), "left").drop("heavy")
        unit = F.col("h").cast("double") / F.lit(2.0**64) + F.lit(0.5)
        # the rest of the range has smaller ids than its cut, so they come first
        rows = rows.withColumn("sub", F.coalesce(F.lit(1) + F.least(F.floor(unit * F.col("pieces")).cast("int"), F.col("pieces") - 1), F.lit(0))).drop("pieces")
    else:
        rows = rows.withColumn("sub", F.lit(0))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "h")).alias("first")
    ends = rows.groupBy("part", "sub").agg(first).orderBy("part", "sub").collect()  # one row a range
    home_of = [(e["first"]["doc_id"], e["first"]["h"], ends[i - 1].part, ends[i - 1].sub, i == 0) for i, e in enumerate(ends)]
    known = F.broadcast(spark.createDataFrame(home_of, "first_id long, first_h long, to_part int, to_sub int, turn boolean"))
    guests = rows.join(known, (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("first_id")) & (F.col("h") == F.col("first_h")))
    guests = guests.select("doc_id", "text", "h", F.col("to_part").alias("part"), F.col("to_sub").alias("sub"), F.lit(True).alias("guest"), "turn")
    return rows.select("doc_id", "text", "h", "part", "sub", F.lit(False).alias("guest"), F.lit(False).alias("turn")).unionByName(guests)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text and of its edited text, as the query ``op2`` defines them.

    A null text is an empty one (an empty text has a fingerprint of dashes). Repeated rows are judged each; rows of one doc_id follow each
    other in the order of their texts' hashes, and rows without an id come first. The next of the last row is the first, which with a single row is
    itself. Very long texts are taken whole; an empty table gives an empty one. Other columns of ``docs`` are not read.
    """
    rows = with_next(docs).withColumn("print", fingerprint(F.col("text")))
    ahead = Window.partitionBy("part", "sub").orderBy("guest", "turn", "doc_id", "h")
    rows = rows.withColumn("next_text", F.lead("text").over(ahead)).withColumn("next_print", F.lead("print").over(ahead)).filter(~F.col("guest"))
    n = F.char_length("text")
    half = F.floor(n / F.lit(2)).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("next_text", "text"), F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), F.coalesce("next_print", "print").alias("next_print"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
