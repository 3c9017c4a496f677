"""Operator 3, line deduplication: an exact set-similarity join over lines, in
DataFrame functions alone.

Tokens of a line are its 5-word shingles. A line of which too many tokens occur in no
other line is near none and is set aside first. Of those left, tokens are ordered by
rarity; lines that share a token of their prefixes are paired if the length and
positional filters let them reach the threshold, and are verified on their whole token
sets.

A row of ``documents`` is known by its id (d) and the hash of its text (c), a line by
two hashes of its lower-cased text (u, v) of 64 bits each. The lines left are numbered in
the order in which they first stand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, marked, stored, table

#: Counters of the rarity sketch. The order they give is only a matter of speed.
SKETCH = 1 << 16
#: Sixteenths of the words that begin a run in ``_not_lone``; and from how many copies on a line
#: is read once there, for the HOT most frequent ones. Results are the same with any.
LOOK, COPIES, HOT = 4, 32, 1 << 14
#: Tokens are counted and lines paired in parts of the token space, one after another, so
#: that only one part's rows lie in shuffle files: one part more for every PART_ROWS rows
#: of prefixes, PARTS at most, as each part reads all prefixes.
PART_ROWS, PARTS = 6_000_000, 4
_SPACE = r"[\x20\x09-\x0D]+"


def _words() -> Column:
    """The words of ``low``, which has some. Single spaces are split at without a
    pattern, which is faster; other lines are brought to that form."""
    odd = F.startswith("low", F.lit(" ")) | F.endswith("low", F.lit(" "))
    for x in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd |= F.contains("low", F.lit(x))
    return F.split(F.when(odd, F.trim(F.regexp_replace("low", _SPACE, " "))).otherwise(F.col("low")), " ")


def _shingle(at: Column, words: int) -> Column:
    """The hash of the words from ``at`` on, by their own hashes h; those past the line's
    end don't count."""
    return F.xxhash64(*(F.get("h", at + k) for k in range(words)))


def _with_tokens(lines: DataFrame, words: int) -> DataFrame:
    """Column ``tokens`` from ``low``: distinct hashes of its shingles; of its whole
    sequence if it is shorter. The words' hashes are a column of their own, else every
    shingle would split the line anew."""
    lines = lines.withColumn("w", _words()).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    last = F.greatest(F.size("h") - words, F.lit(0))
    return lines.withColumn("tokens", F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: _shingle(i, words)))).drop("w", "h", "low")


def _runs(lines: DataFrame, words: int) -> DataFrame:
    """The runs of words in ``low`` that begin at an anchor, which a word is by its own
    hash: their hash t, the other columns, the number of places n of a shingle in the line,
    and k, for how many of these the run stands: those around it that no anchor before it
    is in. So no place counts twice, and which run a shingle counts for depends on its own
    words. Every shingle that has the run has it among its words, so where the run is in no
    other line these shingles are not either. Hashing so stays in generated code."""
    size = words // 2 + 1
    most = words - size + 1  # places around a run
    others = [x for x in lines.columns if x != "low"]
    lines = lines.select(*others, _words().alias("w")).withColumn("n", F.greatest(F.size("w") - words, F.lit(0)) + 1)
    # explode_outer: explode's filter on the size would be pushed below the split and run it again.
    # A line too short for a run has one with what it has.
    places = lines.select("*", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("i"))

    def anchor(at: Column) -> Column:
        return F.xxhash64(F.get("w", at)).bitwiseAND(F.lit(15)) < LOOK

    before = F.col("i") - most
    for back in range(most - 1, 0, -1):
        before = F.when(anchor(F.col("i") - back), F.col("i") - back).otherwise(before)
    k = F.least(F.col("i"), F.col("n") - 1) - F.greatest(before, F.lit(-1))
    t = F.xxhash64(*(F.get("w", F.col("i") + x) for x in range(size)))
    return places.where(anchor(F.col("i"))).select(*others, "n", t.alias("t"), F.greatest(k, F.lit(0)).alias("k"))


#: 40 bits of a line's u.
_LINE = "shiftrightunsigned(u, 24)"


def _not_lone(lines: DataFrame, firsts: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v, o) of ``firsts`` without the lines of which more tokens than the threshold
    lets differ are in no other line. A line that reaches it with x has ``percent`` / 100
    of x's tokens at least, so such an x has none.

    Runs of words (``_runs``) stand for the tokens around them. Repeats in a line raise its
    n, and runs that share 40 bits are taken for one; both only spare lines. Lines that
    share 40 bits of u are all spared."""
    hot = firsts.where(F.col("times") >= COPIES).orderBy(F.desc("times")).limit(HOT).select("u", "v", F.xxhash64("o.d", "o.c", "o.p").alias("at"))
    lines = lines.join(F.broadcast(hot), ["u", "v"], "left").where("at is null or at = place")
    most = (1 << 20) - 1  # n has 20 bits beside the line's and four of k; a longer line is spared
    some = _runs(lines.select("u", "low"), words)
    some = some.select(F.expr(f"shiftleft({_LINE}, 24) | shiftleft(least(n, {most}), 4) | least(k, 15)").alias("x"), F.shiftrightunsigned("t", 24).alias("t"))
    # Dealt out before they are grouped: runs hardly ever repeat within a task.
    own = some.repartition("t").groupBy("t").agg(F.min("x").alias("x"), F.max("x").alias("high")).where("shiftright(x, 4) = shiftright(high, 4)").select("x")
    own = own.select(F.shiftrightunsigned("x", 4).alias("x"), F.col("x").bitwiseAND(F.lit(15)).alias("k"))
    n = F.col("x").bitwiseAND(F.lit(most))
    lone = own.repartition("x").groupBy("x").agg(F.sum("k").alias("k")).where((n < most) & (100 * F.col("k") > (100 - percent) * n))
    lone = stored(lone.select(F.shiftrightunsigned("x", 20).alias("line")), "lone")
    firsts = firsts.select(F.expr(_LINE).alias("line"), "u", "v", "o")
    twins = firsts.groupBy("line").agg(F.count("*").alias("k")).where("k > 1").select("line")
    # Hashed, so that the many rows beside them need not be sorted.
    lone_ones = lone.join(twins.hint("shuffle_hash"), "line", "left_anti").hint("shuffle_hash")
    out = stored(firsts.join(lone_ones, "line", "left_anti").drop("line"), "names")
    discard(lone)
    return out


def _rarity(sets: DataFrame) -> Column:
    """An array of SKETCH ranks (0-127, in the highest byte) that rise with how often
    tokens of that counter occur in all of ``tokens``."""
    counts = sets.select(F.explode("tokens").alias("t")).groupBy(F.col("t").bitwiseAND(F.lit(SKETCH - 1)).alias("k")).agg(F.count("*").alias("n")).collect()
    ranks = [0] * SKETCH
    for k, n in counts:  # at most SKETCH rows
        ranks[k] = min(127, 3 * n.bit_length()) << 56
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def _ordered(tokens: Column, ranks: Column) -> Column:
    """Tokens as numbers that sort by rarity. None is null, so that Spark sorts them as
    plain numbers."""

    def number(token: Column) -> Column:
        rank = F.coalesce(F.get(ranks, token.bitwiseAND(F.lit(SKETCH - 1)).cast("int")), F.lit(0))
        return rank.bitwiseOR(token.bitwiseAND(F.lit((1 << 56) - 1)))

    return F.sort_array(F.transform(tokens, number))


def _parity(tokens: str) -> Column:
    """64 bits: of how many tokens each is the hash, odd or even. As many bits as two sets
    differ in, so many tokens at least are in one of them alone."""
    one = F.lit(1).cast("long")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63)).cast("int"))))


def _row_hash() -> Column:
    """128 bits of a row's text; two hashes of 64 bits take a fraction of md5's time."""
    text = F.col("text").cast("string")
    return F.unhex(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit(7), text)))))


def line_marks(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(d, c, removed): for each id and text hash of ``docs`` (doc_id, text) with lines
    to remove, the sorted positions of those. See ``dedup_lines``."""
    docs = docs.select(F.col("doc_id").alias("d"), _row_hash().alias("c"), F.col("text").cast("string").alias("text"))
    raw = docs.select("d", "c", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    # Trimmed at the left alone, which ends at the first letter; trimming the right reads the whole line.
    lines = raw.where(F.ltrim("line", F.lit(" \t\r\x0b\x0c")) != "").select("d", "c", "p", F.lower("line").alias("low"))
    u, v = F.xxhash64("low").alias("u"), F.xxhash64(F.lit(7), "low").alias("v")

    # All lines and where each stands first; these go to disk before the prefixes do, else
    # their shuffle would lie beside those.
    every = stored(lines.select("d", "c", "p", u, v), "lines")
    firsts = stored(every.groupBy("u", "v").agg(F.min(F.struct("d", "c", "p")).alias("o"), F.count("*").alias("times")), "firsts")

    # Lines that may be near another, and their token sets. A line is read where it stands
    # first, so one that stands in very many rows is fetched once; rows that repeat both
    # id and text are one.
    placed = lines.select(F.xxhash64("d", "c", "p").alias("place"), u, v, "low")
    left = _not_lone(placed, firsts, words, percent)
    # Numbered by where they first stand: from ``tokens`` to ``more`` a line is known by
    # its number alone, as u.
    names = stored(left.orderBy("o.d", "o.c", "o.p").select(F.monotonically_increasing_id().alias("r"), "u", "v", F.xxhash64("o.d", "o.c", "o.p").alias("place")), "numbers")
    discard(left)
    texts = marked(raw.select(F.xxhash64("d", "c", "p").alias("place"), "line"), names, "place").select("place", F.lower("line").alias("low")).select("place", u, v, "low")
    texts = texts.join(names.hint("shuffle_hash"), ["place", "u", "v"])
    tokens = stored(_with_tokens(texts.dropDuplicates(["place", "u", "v"]).select(F.col("r").alias("u"), "low"), words), "tokens")

    # Their prefixes, and the tokens that the prefixes of different lines share, with the
    # earliest line (low) of each.
    ordered = tokens.select("u", _ordered(F.col("tokens"), _rarity(tokens)).alias("tokens"))
    n = F.size("tokens")
    prefix = F.slice("tokens", F.lit(1), n - F.floor((n * percent + 99) / 100).cast("int") + 1)
    # Before the explode, else Spark would count the bits of a line anew for each row of its
    # prefix. Its filter for empty arrays would sort anew; no prefix is empty.
    ordered = ordered.select("u", n.alias("n"), _parity("tokens").alias("bits"), prefix.alias("prefix"))
    prefixes = stored(ordered.select("u", "n", "bits", F.posexplode_outer("prefix").alias("i", "t")), "prefixes")
    parts = min(PARTS, 1 + prefixes.count() // PART_ROWS)

    def part(df: DataFrame, k: int) -> DataFrame:
        """Rows of the k-th part of the tokens, by bits that ``marked`` doesn't use."""
        return df if parts == 1 else df.where(F.pmod(F.shiftright("t", 32), F.lit(parts)) == k)

    def shared_in(k: int) -> DataFrame:
        some = part(prefixes, k)
        met = stored(some.groupBy("t").agg(F.min("u").alias("low"), F.max("u").alias("high")).where("low <> high").select("t", "low"), "met")
        out = stored(marked(some, met, "t").join(met.hint("shuffle_hash"), "t"), "shared")
        discard(met)
        return out

    shared_parts = [shared_in(k) for k in range(parts)]
    discard(prefixes)

    def can_reach(n1: str, i1: str, bits1: str, n2: str, i2: str, bits2: str) -> Column:
        """The length and positional filters, and what the sets' parities leave for the overlap."""
        need = f"({percent} * (cast({n1} as long) + {n2})) / {100 + percent}.0"  # overlap that the threshold asks for
        return F.expr(f"100 * cast({n1} as long) >= {percent} * cast({n2} as long) and 100 * cast({n2} as long) >= {percent} * cast({n1} as long) and 1 + least({n1} - 1 - {i1}, {n2} - 1 - {i2}) >= {need} - 1e-9 and (cast({n1} as long) + {n2} - bit_count({bits1} ^ {bits2})) / 2.0 >= {need} - 1e-9")

    def verified(pairs: DataFrame) -> DataFrame:
        """The later lines (u) of ``pairs`` (a, b; a is earlier) that reach the threshold.
        Sets are fetched for the lines of these pairs alone."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct()
        sets = stored(tokens.join(wanted.hint("shuffle_hash"), "u"), "sets")
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        # The threshold on the union, written so that the intersection is made once.
        both = both.where((100 + percent) * F.size(F.array_intersect("x", "y")) >= percent * (F.size("x") + F.size("y")))
        out = stored(both.select(F.col("b").alias("u")).distinct(), "gone")
        discard(sets)
        return out

    # First each line against the earliest of each of its prefix tokens, which settles
    # a group of near copies in as many pairs as it has lines.
    def star_in(k: int) -> DataFrame:
        some = shared_parts[k]
        first = some.where("u = low").groupBy("u").agg(F.first("n").alias("na"), F.first("bits").alias("bits_a")).withColumnRenamed("u", "low")
        pairs = some.where("u <> low").groupBy("low", "u", "n", "bits").agg(F.min("i").alias("i"))
        pairs = pairs.join(first.hint("shuffle_hash"), "low").where(can_reach("n", "i", "bits", "na", "0", "bits_a"))
        return stored(pairs.select(F.col("low").alias("a"), F.col("u").alias("b")), "star")

    star_parts = [star_in(k) for k in range(parts)]
    star = stored(reduce(DataFrame.union, star_parts).distinct(), "star") if parts > 1 else star_parts[0]
    gone = verified(star)
    # Then what is left against all earlier lines that share a prefix token.
    def rest_in(k: int) -> DataFrame:
        later = shared_parts[k].where("u <> low").join(gone.hint("shuffle_hash"), "u", "left_anti").select("t", F.col("u").alias("b"), "n", "i", "bits")
        earlier = shared_parts[k].select("t", F.col("u").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("bits").alias("bits_a"))
        pairs = later.join(earlier, "t").where("a < b").where(can_reach("n", "i", "bits", "na", "ia", "bits_a")).select("a", "b").distinct()
        return stored(pairs.join(star, ["a", "b"], "left_anti"), "rest")

    rest_parts = [rest_in(k) for k in range(parts)]
    rest = stored(reduce(DataFrame.union, rest_parts).distinct(), "rest") if parts > 1 else rest_parts[0]
    discard(*shared_parts, *{x.stored_at: x for x in [star, *star_parts]}.values())
    more = verified(rest)
    discard(tokens, *{x.stored_at: x for x in [rest, *rest_parts]}.values())

    # Lines that stand once and are near no earlier one need not be looked up.
    near = names.join(gone.union(more).distinct().toDF("r"), "r", "left_semi").select("u", "v", F.lit(True).alias("near"))
    judged = firsts.join(near.hint("shuffle_hash"), ["u", "v"], "left").where("near or times > 1").select("u", "v", F.when(F.col("near").isNull(), F.col("o")).alias("stays"))
    out = every.join(judged.hint("shuffle_hash"), ["u", "v"]).where("stays is null or stays <> struct(d, c, p)")
    marks = stored(out.groupBy("d", "c").agg(F.sort_array(F.collect_set("p")).alias("removed")), "marks")
    discard(every, firsts, names, gone, more)
    return marks


def dedup_lines(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with its text cleaned of repeated lines; ``n_lines`` and
    ``n_removed`` are added (names lengthened by _ where they are taken).

    Lines end at line feeds and stand in the order of (doc_id, hash of the text,
    position), null ids first. A line goes if an earlier line has a Jaccard similarity of at least
    ``percent`` / 100 between the sets of lower-cased ``words``-word shingles
    (fewer words: the whole sequence as one), equal lines included; whether the
    earlier one is itself removed doesn't matter. Lines without words stay. A null
    text stays null and has no lines. ``doc_id`` may be of any type that can be
    ordered. Rows that repeat both doc_id (null too) and text count as one document:
    what equals itself at the same place is no repetition, and a position removed from
    one is removed from all. Different texts of one doc_id, or without one, are
    documents of their own. Empty tables give empty ones.

    Scale: about a quarter of the places of runs of three words are dealt out once, to set
    aside the lines that have too many of their own; a run in very many different lines is
    one task's, which only counts it. Of the lines left only prefixes (about a fifth of the tokens) are
    stored and counted, and only those that two lines share go further, part of the token
    space by part. 64 parity bits of a line's whole set bound the
    overlap of two lines, so lines that share a token by chance are no candidates, and
    candidates grow with the near copies there are; token sets are fetched for the lines of
    candidate pairs alone. A hot group of similar lines is first held against its
    earliest line. Tables go as soon as their readers are written. A document's own
    positions are the only thing that is gathered.
    """
    out, n_lines, n_removed, removed = _cleaned(docs, words, percent)
    return out.select(*docs.columns, n_lines, n_removed)


def _cleaned(docs: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, str, str, str]:
    """The result of ``dedup_lines`` with the sorted positions of the removed lines,
    and the names of the added columns."""
    marks = line_marks(docs, words, percent)
    c, lines, gone, own_id, own_c = (free_name(docs, x) for x in ("c", "lines", "gone", "_id", "_c"))
    n_lines, n_removed, removed = (free_name(docs, x) for x in ("n_lines", "n_removed", "removed"))
    # Marks are small beside the texts, which so need not be sorted.
    marks = marks.toDF(own_id, own_c, gone).hint("shuffle_hash")
    out = docs.withColumn(c, _row_hash()).join(marks, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(c) == F.col(own_c)), "left")
    out = out.withColumn(lines, F.split(F.col("text").cast("string"), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    counts = {n_lines: F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)), removed: F.coalesce(gone, F.array().cast("array<int>")), n_removed: F.coalesce(F.size(gone), F.lit(0)), "text": text}
    return out.withColumns(counts).select(*docs.columns, n_lines, n_removed, removed), n_lines, n_removed, removed


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cleaned text and the positions that went from it."""
    out, n_lines, n_removed, removed = _cleaned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col(n_lines).cast("long").alias("n_lines"), F.col(n_removed).cast("long").alias("n_removed"), F.col(removed).alias("removed"))
