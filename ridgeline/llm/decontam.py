"""Benchmark decontamination in Spark SQL functions alone: SimHash windows, multi-index Hamming blocks, exact check.

A document leaks an item if one of its windows, of as many words as the item, has a weighted-shingle similarity of at
least the threshold with it. Windows are laid at every word and in every item's length; each gets a SimHash, and what the
Hamming index finds within RADIUS of it is verified.

1. A window can only match if most of its shingles are some item's. A bit array of all items' shingles tells where that may
   be so: stretches of the text around such places are cut out inside the row, the rest is passed over. Nothing that could
   be verified is lost by it, and it says neither which item nor which window.
2. In a stretch, running sums of the words' hash bits, many bit counts in one long, give each window's SimHash in a few
   operations, however long it is. Windows of which too many shingles are no item's are left out.
3. Fingerprints of BITS bits are cut into BLOCKS blocks, and an item is filed under every block value within FLIPS bits of
   its own. Two fingerprints within RADIUS = (FLIPS + 1) * BLOCKS - 1 bits differ by at most FLIPS in some block, so the
   index finds every fingerprint within the radius.
4. What it finds is verified exactly: shared weight of the shingles over the weight of all, an item's shingle weighing
   1 / (items that have it), any other 1. That alone asks the more of a copy the more items hold its passage; so a window
   also matches if its plain shingle similarity, all weighing alike, reaches the threshold, and then has that as its
   similarity if the weighted one is below.

No text is shuffled. Shingles are five words (all words of a shorter item), words are runs of letters and digits,
lower-cased; words and shingles are compared by 64-bit hashes. A document shorter than an item is one window. What is
broadcast is a slice of the items of bounded size; with more slices than one, the stretches are kept in the shared folder
and read once a slice. Nulls: a null text has no words; null ids take part; an item without words matches nothing. Very
long texts are one row like any other, very long items make longer stretches. Of equal similarities the nearer
fingerprint and then the first window is told. Repeated rows give one result, empty tables give an empty one, other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import settle, text_or_empty, unused

SIZE, THRESHOLD = 5, 0.8
BITS, BLOCKS, FLIPS = 60, 6, 2
RADIUS = (FLIPS + 1) * BLOCKS - 1
#: Shingles of the items of one slice, about.
SLICE_SHINGLES = 100_000
#: Bits of the array of shingles for each shingle, places that each sets, and the most bits.
MARK_BITS, PROBES, MOST_MARK_BITS = 64, 4, 1 << 24
#: Starts of windows in one stretch are 2 to this power, or more if an item is longer.
STRETCH = 6

_BLOCK_BITS = BITS // BLOCKS


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns computed once a row. What comes later reads them; as outputs of a generator they are never
    put in place of their names (which inside a lambda would compute them for each element) nor moved into a filter."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle(hashes: Column, at: Column, size: int) -> Column:
    """The hash of the `size` words from a place on, of hashed words."""
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(size)))


def shingles_at(hashes: Column, size: int) -> Column:
    """Hashes of the runs of `size` words, by place; none if there are fewer words."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - size + 1, F.lit(0)))
    return F.transform(starts, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, size))))


def own_shingles(hashes: Column) -> Column:
    """Distinct shingles of a window or item: of five words, or of all if they are fewer."""
    short = reduce(lambda rest, k: F.when(F.size(hashes) == k, shingles_at(hashes, k)).otherwise(rest), range(1, SIZE), shingles_at(hashes, SIZE))
    return F.array_distinct(short)


def simhash(hashes: Column) -> Column:
    """SimHash of hashed words, BITS bits: a bit is set if more than half of the words have it."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
        return F.when(2 * ones > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda total, b: total.bitwiseOR(bit(b)))


def _block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, k * _BLOCK_BITS).bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1).cast("bigint"))


def blocks(fingerprint: Column) -> Column:
    """array of (block, value)."""
    return F.array(*(F.struct(F.lit(k).alias("block"), _block(fingerprint, k).cast("int").alias("value")) for k in range(BLOCKS)))


def index(items: DataFrame) -> DataFrame:
    """block, value, n_words, item_id, fingerprint: an item under each value within FLIPS bits of its own, block by block."""
    near = F.array(*(F.lit(sum(1 << b for b in flips)) for n in range(FLIPS + 1) for flips in combinations(range(_BLOCK_BITS), n)))
    filed = items.select("item_id", "n_words", "fingerprint", F.explode(blocks(F.col("fingerprint"))).alias("b"))
    filed = filed.select("item_id", "n_words", "fingerprint", "b.block", "b.value", F.explode(near).alias("flip"))
    return filed.select("block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), "n_words", "item_id", "fingerprint")


def prepare(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words, shingles (array), weights (array, alike), fingerprint, row."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), words_of(text_or_empty()).alias("words")).distinct()
    items = settle(items.where(F.size("words") > 0).select("item_id", F.xxhash64("item_id", "words").alias("row"), hashed(F.col("words")).alias("hashes")))
    spread = items.select("row", F.explode(own_shingles(F.col("hashes"))).alias("shingle"))
    counts = spread.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    weighed = spread.join(counts, "shingle").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("shingle", (1 / F.col("n")).alias("weight")))).alias("s"))
    return items.join(weighed, "row").select(
        "item_id", F.size("hashes").alias("n_words"), F.col("s.shingle").alias("shingles"), F.col("s.weight").alias("weights"), simhash(F.col("hashes")).alias("fingerprint"), "row")


class Marks:
    """Bits that tell of a hash whether it may be an item's shingle: PROBES places of each are set."""

    def __init__(self, items: DataFrame, total: int):
        bits = MOST_MARK_BITS
        while bits // 2 >= max(1 << 12, MARK_BITS * total):
            bits //= 2
        self.bits = bits
        places = items.select(F.explode("shingles").alias("h")).select(F.explode(F.array(*(self._place(F.col("h"), k) for k in range(PROBES)))).alias("at"))
        word = F.shiftrightunsigned("at", 6).alias("word")
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(F.lit(63).cast("bigint")).cast("int"))
        longs = [0] * (bits // 64)
        for r in places.groupBy(word).agg(F.bit_or(one).alias("marks")).collect():  # bits / 64 rows at most
            longs[r.word] = r.marks
        # a column and no literal: plans, of which the driver keeps and tells many, would spell it out each time
        self.table = items.sparkSession.createDataFrame([(0, longs)], "zero int, marks array<bigint>")

    def beside(self, rows: DataFrame, number: str) -> DataFrame:
        """rows with the bits as a column, marks. number: a column that is never below 0."""
        return rows.join(F.broadcast(self.table), F.least(number, F.lit(0)) == F.col("zero")).drop("zero")  # bits / 8 bytes

    def _place(self, h: Column, k: int) -> Column:
        return F.shiftrightunsigned(h, 13 * k).bitwiseAND(F.lit(self.bits - 1).cast("bigint"))

    def may_hold(self, h: Column) -> Column:
        at = [self._place(h, k) for k in range(PROBES)]
        return reduce(Column.__and__, (F.getbit(F.get(F.col("marks"), F.shiftrightunsigned(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1 for p in at))


def stretches(docs: DataFrame, marks: Marks, sizes: list[int], longest: int) -> DataFrame:
    """doc_id, row (hash of id and text), size (words of the document), first (the stretch's place), hashes: stretches of
    hashed words with all windows that hold a shingle that may be an item's. sizes: those of the items' shingles."""
    step = max(STRETCH, (longest - 1).bit_length())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    rows = held(rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text"), words=hashed(words_of(F.col("text")))).drop("text")
    words = F.col("words")
    hit = lambda i: reduce(Column.__or__, ((i <= F.col("size") - k) & marks.may_hold(shingle(words, i, k)) for k in sizes))
    # every place is looked at in generated code; what follows is for the first of a run of hits in a stretch
    rows = marks.beside(rows.withColumn("size", F.size("words")).where(F.col("size") >= sizes[0]), "size")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - sizes[0])).alias("at"))
    if sizes == [SIZE]:
        rows = held(rows, gram=shingle(words, F.col("at"), SIZE)).where(marks.may_hold(F.col("gram")))
        rows = held(rows, before=shingle(words, F.col("at") - 1, SIZE)).where((F.col("at") % (1 << step) == 0) | ~marks.may_hold(F.col("before")))
    else:
        rows = rows.where(hit(F.col("at")))
    # a stretch is cut out at the first hit in it, or in the words that its last windows reach
    own = F.shiftright("at", step)
    none_since = lambda k: (F.col("at") <= k * (1 << step)) | ~F.exists(F.sequence(F.greatest(F.col("at") - 1, F.lit(0)), k * (1 << step)), hit)
    before = F.when((own > 0) & (F.col("at") - own * (1 << step) < longest) & none_since(own - 1), F.array(own - 1)).otherwise(F.array().cast("array<int>"))
    numbers = F.concat(before, F.when(none_since(own), F.array(own)).otherwise(F.array().cast("array<int>")))
    cut = F.transform(numbers, lambda k: F.struct((k * (1 << step)).alias("first"), F.slice(words, k * (1 << step) + 1, F.lit((1 << step) + longest)).alias("hashes")))
    return rows.select("doc_id", "row", "size", F.explode(cut).alias("s")).select("doc_id", "row", "size", "s.first", "s.hashes")


def windows(cut: DataFrame, marks: Marks, lengths: list[int], longest: int, threshold: float) -> DataFrame:
    """doc_id, row, first, hashes, grams (its shingles), n_words, at (start in the stretch), size (words of the window), print (its SimHash): every
    window of the stretches, but those of which too many shingles are surely no item's."""
    step = max(STRETCH, (longest - 1).bit_length())
    # bit counts in lanes, as wide as the running sums of a stretch need: lane j of the k-th long counts bit k + j * width
    width = next(w for w in (10, 12, 15, 20, 30) if (1 << step) + longest < 1 << w)
    lanes = sum(1 << (width * j) for j in range(BITS // width))
    long = lambda x: F.lit(x).cast("bigint")
    of_word = lambda h, k: F.shiftrightunsigned(h, k).bitwiseAND(long(lanes))
    zero = F.array(F.struct(*(long(0).alias(f"k{k}") for k in range(width))))
    add = lambda done, h: F.concat(done, F.array(F.struct(*((F.element_at(done, -1)[f"k{k}"] + of_word(h, k)).alias(f"k{k}") for k in range(width)))))
    rows = held(marks.beside(cut, "first"), grams=shingles_at(F.col("hashes"), SIZE))
    foreign = F.transform("grams", lambda g, i: F.when(marks.may_hold(g) | (F.array_position("grams", g) != i + 1), 0).otherwise(1))
    rows = held(rows, foreign=F.aggregate(foreign, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))).drop("marks")
    rows = held(rows, sums=F.aggregate("hashes", zero, add))
    rows = held(rows, c=F.struct(*(F.col(f"sums.k{k}").alias(f"k{k}") for k in range(width)))).drop("sums")
    rows = rows.withColumnRenamed("size", "of_doc").select("*", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("n_words"))
    rows = rows.withColumn("size", F.least("n_words", "of_doc")).withColumn("last", F.least(F.lit((1 << step) - 1), F.col("of_doc") - F.col("size") - F.col("first")))
    rows = rows.where((F.col("last") >= 0) & ((F.col("n_words") < SIZE) | (F.col("size") >= SIZE)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("at"))
    strange = F.get("foreign", F.col("at") + F.col("size") - (SIZE - 1)) - F.get("foreign", F.col("at"))
    rows = rows.where((F.col("n_words") < SIZE) | (strange <= (1 / threshold - 1) * (F.col("n_words") - (SIZE - 1)) + 1e-9))
    rows = held(rows, end=F.col("at") + F.col("size"), half=(long((1 << (width - 1)) - 1) - F.shiftright("size", 1)) * long(lanes))
    count = lambda k: F.get(F.col(f"c.k{k}"), F.col("end")) - F.get(F.col(f"c.k{k}"), F.col("at"))
    most = lambda k: F.shiftrightunsigned(count(k) + F.col("half"), width - 1).bitwiseAND(long(lanes))
    fingerprint = reduce(Column.bitwiseOR, (F.shiftleft(most(k), k) for k in range(width)))
    return rows.select("doc_id", "row", "first", "hashes", "grams", "n_words", "at", "size", fingerprint.alias("print"))


def matches(laid: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """doc_id, row, item_id, start, n_words, distance, similarity of the windows that the index and the check let through."""
    key = lambda n_words, block, value: (n_words * BLOCKS + block).cast("bigint") * (1 << _BLOCK_BITS) + value
    filed = index(items.select(F.col("row").alias("item_id"), "n_words", "fingerprint")).select(key(F.col("n_words"), F.col("block"), F.col("value")).alias("key"), "block", F.col("item_id").alias("item"), "fingerprint")
    # a lambda ends the generated method here: one that also lays the windows is too long to be compiled
    value = lambda k: F.call_function("shiftrightunsigned", F.col("print"), k * _BLOCK_BITS).bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1).cast("bigint"))
    looked = laid.select("*", F.explode(F.transform(F.array(*map(F.lit, range(BLOCKS))), lambda k: key(F.col("n_words"), k, value(k)))).alias("key"))
    found = looked.join(F.broadcast(filed), "key").where(F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint"))) <= RADIUS)  # one slice of items
    found = held(found, off=F.col("print").bitwiseXOR(F.col("fingerprint")))
    near = lambda k: F.bit_count(F.call_function("shiftrightunsigned", F.col("off"), k * _BLOCK_BITS).bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1).cast("bigint"))) <= FLIPS
    found = found.where(~F.exists(F.array(*map(F.lit, range(BLOCKS))), lambda k: (k < F.col("block")) & near(k)))  # found once, by its first block
    found = found.withColumn("distance", F.bit_count("off"))
    against = F.broadcast(items.select(F.col("row").alias("item"), "item_id", "shingles", "weights"))
    own = F.when(F.col("size") >= SIZE, F.array_distinct(F.slice("grams", F.col("at") + 1, F.col("size") - (SIZE - 1)))).otherwise(own_shingles(F.slice("hashes", F.col("at") + 1, F.col("size"))))
    found = found.select("doc_id", "row", (F.col("first") + F.col("at")).alias("start"), "n_words", "item", "distance", own.alias("own"))
    both = held(found.join(against, "item"), more=F.size(F.array_except("own", "shingles")))
    both = both.where(F.col("more") <= (1 / threshold - 1) * F.size("shingles") + 1e-9)  # no similarity is enough beyond it
    pairs = F.arrays_zip("shingles", "weights")
    both = held(both, shared=F.aggregate(pairs, F.lit(0.0), lambda total, p: total + F.when(F.array_contains("own", p.shingles), p.weights).otherwise(0.0)))
    weighted = F.col("shared") / (F.aggregate("weights", F.lit(0.0), lambda total, w: total + w) + F.col("more"))
    plain = (F.size("own") - F.col("more")) / (F.size("shingles") + F.col("more"))
    similarity = F.when(weighted >= threshold, weighted).otherwise(plain)
    return held(both, similarity=similarity).where(F.col("similarity") >= threshold).select("doc_id", "row", "item_id", "start", "n_words", "distance", "similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, slice_shingles: int = SLICE_SHINGLES) -> DataFrame:
    """doc_id, row, item_id, start (word), n_words, distance, similarity: each document's best window for each item."""
    items = settle(prepare(benchmark))
    total, longest, lengths = items.agg(F.sum(F.size("shingles")), F.max("n_words"), F.sort_array(F.collect_set("n_words"))).first()
    longest, lengths = longest or 1, lengths or [1]
    marks = Marks(items, total or 0)
    cut = stretches(docs, marks, sorted({min(n, SIZE) for n in lengths}), longest)
    n = max(1, -(-(total or 0) // slice_shingles))  # the query set in blocks
    cut, found = (settle(cut) if n > 1 else cut), None
    for k in range(n):
        part = items.where(F.pmod("row", F.lit(n)) == k) if n > 1 else items
        hit = matches(windows(cut, marks, lengths, longest, threshold), part, threshold)
        found = hit if found is None else found.unionByName(hit)
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("d"), (-F.col("start")).alias("s"), "n_words")).alias("best")
    out = found.groupBy("doc_id", "row", "item_id").agg(best)
    return out.select("doc_id", "row", "item_id", (-F.col("best.s")).cast("bigint").alias("start"), F.col("best.n_words").cast("bigint").alias("n_words"), (-F.col("best.d")).cast("int").alias("distance"), "best.similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that leak no item, all columns kept."""
    hit = leaks(docs, benchmark, threshold).select("row").distinct().withColumnRenamed("row", name := unused(docs, "leaked"))
    mark = F.xxhash64(docs["doc_id"].cast("bigint"), F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(hit, mark == F.col(name), "left_anti")
