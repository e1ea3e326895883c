"""Operator 9: benchmark decontamination by template windows.

Words become canonical: numbers, units behind a number and names turn into typed
placeholders, others into their lower-case core. Windows of ``WINDOW`` canonical
words of documents and benchmark items are joined by hash, so a question asked again
with other numbers or names still meets its item.

A window is read in three ways, each joined with the same reading of the items: word
for word; with capital words inside a sentence as names; and with all capital words
but common ``OPENERS`` as names, whatever stands before them. The readings with
placeholders need ``LITERAL`` of their words without. The slots then decide: along one alignment of document and item, every
value of the item must stand for one value of the document and the other way
round. Windows of an alignment that fails count only where they repeat the item
word for word. Items shorter than a window have one window of their own length.

A pair is reported when accepted windows cover ``COVER`` words of the item, or all
of a shorter one. Items under ``SHORTEST`` words prove nothing and are left out.

Most windows of documents are in no item. A bit table of the items' hashes, of
fixed size whatever the tables hold, is sent to the tasks and passes every window
that may match; the exact join follows. Documents whose matching windows are alike make
one class, and only one document of a class is joined with the items.

Null texts: empty, no windows. Rows that share an id but not a text are judged
apart and reported under that id. A null id is reported as null. Repeated rows: one
row per pair of ids. Empty tables: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.llm.common import NO_ID, id_back, keyed
from usagelens.llm.names import Rolling
from usagelens.llm.words import bounds, row_slices
from usagelens.session import materialize

WINDOW, COVER, SHORTEST = 8, 12, 4
#: Words of a window that must be no placeholders.
LITERAL = 0.5
#: The bit table has 2 ** FILTER bits, 2 MB.
FILTER = 24
#: Units and number words that become placeholders, fixed values.
UNITS = frozenset(
    b"mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres mg g kg gram grams kilogram kilograms ounce ounces "
    b"pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks "
    b"month months year years percent dollar dollars euro euros cent cents degree degrees mph kph watt watts volt volts".split()
)
#: Words that often open a sentence and are no names, fixed values.
OPENERS = frozenset(
    b"what which who whom whose when where why how if is are was were do does did can could will would should has have had the a an this that "
    b"these those there it its he she they we you his her their our your my in on at of for from to by with as and or but not no after before "
    b"during each every all some any many most both let given suppose assume find calculate compute determine solve consider choose select "
    b"explain describe name write then".split()
)
NUMBER_WORDS = frozenset(b"two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())



def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGITS, _SMALL, _LARGE = (_bytes(bytes(range(ord(a), ord(b) + 1))) for a, b in ("09", "az", "AZ"))
#: Bytes that a word's core may start and end with; those of numbers; ends of sentences and what may follow them.
_CORE = _DIGITS | _SMALL | _LARGE | _bytes(bytes(range(128, 256)))
_IN_NUMBER, _ENDS, _CLOSING = _DIGITS | _bytes(b".,:/"), _bytes(b".!?:"), _bytes(b"\"')]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[_LARGE] += 32


def _hash(word: bytes) -> np.uint64:
    """The hash that the word has inside texts."""
    return Rolling(np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1))(np.array([0]), np.array([len(word)]))[0]


_UNITS, _NUMBERS, _OPENERS = (np.sort(np.array([_hash(w) for w in words], np.uint64)) for words in (UNITS, NUMBER_WORDS, OPENERS))
#: Hashes that stand for numbers, units and names.
_SLOTS = [_hash(name) for name in (b"<number>", b"<unit>", b"<name>")]


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def _before(flags: np.ndarray) -> np.ndarray:
    """How many flags stand before each place, and at the end."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:])
    return out


class Canonical:
    """Texts as canonical words, one after the other."""

    def __init__(self, raws: list[bytes]):
        data, starts, stops, self.sizes = bounds(raws)
        self.stops = np.cumsum(self.sizes)
        core = _CORE[data]
        places, count = np.flatnonzero(core), _before(core)
        has = count[stops] > count[starts]
        # A word without letters and digits is its own core.
        self.start, self.stop = starts.copy(), stops.copy()
        self.start[has] = places[count[starts[has]]]
        self.stop[has] = places[count[stops[has]] - 1] + 1
        self.low = _LOWER[data]
        self.hashes = Rolling(self.low.astype(np.uint64) + np.uint64(1))(self.start, self.stop)
        size = self.stop - self.start
        numeric, small = _before(_IN_NUMBER[data]), _before(_SMALL[data])
        head = data[self.start]
        number = _DIGITS[head] & (numeric[self.stop] - numeric[self.start] == size)
        number |= _among(self.hashes, _NUMBERS)
        ends = _ENDS[data[stops - 1]] | (_CLOSING[data[stops - 1]] & (stops - starts > 1) & _ENDS[data[stops - 2]])
        first = np.zeros(len(starts), bool)
        first[(self.stops - self.sizes)[self.sizes > 0]] = True
        behind = lambda flags: np.concatenate([[False], flags[:-1]])[: len(flags)]
        opens = first | behind(ends)
        unit = _among(self.hashes, _UNITS) & behind(number) & ~first & ~number
        capital = _LARGE[head] & (size > 1) & (small[self.stop] - small[self.start] == size - 1) & ~number & ~unit
        # By reading: the words' hashes and which are placeholders.
        self.slot, self.rolling = [np.zeros(len(starts), bool)], [Rolling(self.hashes)]
        for name in (capital & ~opens, capital & ~_among(self.hashes, _OPENERS)):
            hashes = self.hashes.copy()
            for value, mask in zip(_SLOTS, (number, unit, name), strict=True):
                hashes[mask] = value
            self.slot.append(number | unit | name)
            self.rolling.append(Rolling(hashes))

    def windows(self, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(reading, text, place in it, hash) of all windows word for word, and with placeholders where these are some and not too many."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)[:n]
        fits = np.arange(n) + size <= self.stops[owner]
        for reading, (slot, rolling) in enumerate(zip(self.slot, self.rolling, strict=True)):
            at = fits
            if reading:
                slots = _before(slot)
                held = slots[size : size + n] - slots[:n]
                at = fits & (held > 0) & (held <= size * (1 - LITERAL))
            at = np.flatnonzero(at)
            found = rolling(at, at + size)
            yield reading, owner[at], at - (self.stops - self.sizes)[owner[at]], found

    def slots_of(self, reading: int, text: int, place: int, size: int) -> list[str]:
        """The values of the window's placeholders, in order."""
        at = int(self.stops[text] - self.sizes[text]) + place
        slot = self.slot[reading]
        return [self.low[self.start[k] : self.stop[k]].tobytes().decode("utf-8", "replace") for k in range(at, at + size) if slot[k]]


ROWS = pa.schema([
    ("_id", pa.int64()), ("_row", pa.int64()), ("reading", pa.int32()), ("place", pa.int64()), ("size", pa.int32()), ("hash", pa.int64()),
    ("slots", pa.list_(pa.string())), ("n_words", pa.int64()),
])
ROWS_DDL = "_id long, _row long, reading int, place long, size int, hash long, slots array<string>, n_words long"


def _rows(batch: pa.RecordBatch, sizes: list[int], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows of a batch; for documents those that the bit table passes, for items the one size that fits."""
    for part, raws in row_slices(batch):
        text = Canonical(raws)
        ids, rows = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_row"))
        for size, (reading, owner, place, found) in ((size, w) for size in sizes for w in text.windows(size)):
            if bits is None:
                keep = np.minimum(text.sizes, WINDOW)[owner] == size
            else:
                low = (found & np.uint64((1 << FILTER) - 1)).astype(np.int64)
                keep = (bits[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) > 0
            owner, place, found = owner[keep], place[keep], found[keep]
            if len(owner):
                slots = [text.slots_of(reading, t, p, size) for t, p in zip(owner.tolist(), place.tolist(), strict=True)]
                sized, read = np.full(len(owner), size), np.full(len(owner), reading)
                columns = [ids[owner], rows[owner], read, place, sized, found.view(np.int64), slots, text.sizes[owner]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROWS, strict=True)], schema=ROWS)


def _bit_table(items: DataFrame) -> np.ndarray:
    """2 ** FILTER bits, set where an item's hash falls; at most 2 ** (FILTER - 6) rows come to the driver."""
    low = F.col("hash").bitwiseAND(F.lit((1 << FILTER) - 1))
    words = items.select(F.shiftright(low, 6).alias("word"), F.expr(f"shiftleft(1L, cast((hash & {(1 << FILTER) - 1}) & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint64)


def item_windows(items: DataFrame) -> DataFrame:
    """Every window of every item."""
    rows = keyed(items.select(F.col("item_id").alias("doc_id"), "text"))
    sizes = list(range(SHORTEST, WINDOW + 1))

    def run(batches):
        for batch in batches:
            yield from _rows(batch, sizes, None)

    return rows.mapInArrow(run, ROWS_DDL)


def _found(docs: DataFrame, items: DataFrame, cover: int) -> DataFrame:
    """One row per document row and item row that leaked into it; ids as ``keyed`` has them."""
    spark = docs.sparkSession
    mine = item_windows(items)
    bits = spark.sparkContext.broadcast(_bit_table(mine))
    sizes = list(range(SHORTEST, WINDOW + 1))
    present = [r["size"] for r in mine.select("size").distinct().collect()]  # at most WINDOW values
    sizes = [s for s in sizes if s in present]

    def run(batches):
        for batch in batches:
            yield from _rows(batch, sizes, bits.value)

    theirs = keyed(docs).mapInArrow(run, ROWS_DDL).drop("n_words")
    key = ["hash", "size", "reading"]
    theirs = materialize(theirs.join(mine.select(*key).distinct(), key, "left_semi"), "leak-windows")
    members = _classes(theirs, mine.agg(F.coalesce(F.max("n_words"), F.lit(0))).first()[0])
    chosen = members.groupBy("_class").agg(F.min(F.struct("_id", "_row")).alias("_first")).select("_class", "_first.*")
    judged = _judged(theirs.join(chosen, ["_id", "_row"]).drop("_id", "_row"), mine, cover)
    return members.join(judged, "_class").drop("_class")


def _classes(windows: DataFrame, longest: int) -> DataFrame:
    """_id, _row and class of document rows that every item treats alike.

    An alignment spans no more words than the longest item, so windows further apart
    never meet in one. What stands between such gaps is a fragment, and a document
    is to the items the set of its fragments, wherever they stand and however often.
    A wording that many documents and many items share is so compared once for each
    set of wordings, not for each document. Sets are told apart by 2 x 64 bits.
    """
    row = Window.partitionBy("_id", "_row")
    along = row.orderBy("place", "reading", "size")
    gap = F.col("place") - F.lag("place").over(along) > longest
    cut = windows.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("_fragment", F.sum("_gap").over(along))
    placed = cut.withColumn("_first", F.min("place").over(Window.partitionBy("_id", "_row", "_fragment")))
    parts = [F.col("place") - F.col("_first"), "reading", "size", "hash", "slots"]

    def name(salt: int, *values) -> Column:
        # A sum does not depend on order; as decimals no sum overflows.
        return F.sum(F.xxhash64(F.lit(salt), *values).cast("decimal(20,0)"))

    fragments = placed.groupBy("_id", "_row", "_fragment").agg(name(0, *parts).alias("_a"), name(1, *parts).alias("_b"))
    fragments = fragments.select("_id", "_row", "_a", "_b").distinct()
    whole = fragments.groupBy("_id", "_row").agg(name(2, "_a", "_b").alias("a"), name(3, "_a", "_b").alias("b"), F.count("*").alias("n"))
    return whole.select("_id", "_row", F.struct("a", "b", "n").alias("_class"))


def _judged(theirs: DataFrame, mine: DataFrame, cover: int) -> DataFrame:
    """One row per class of documents, given by one's windows, and item row that leaked into it."""
    b = mine.select(
        F.col("_id").alias("_item"), F.col("_row").alias("_item_row"), F.col("place").alias("_at"), "reading", "size", "hash",
        F.col("slots").alias("_values"), F.col("n_words").alias("_item_words"),
    )
    met = theirs.join(b, ["hash", "size", "reading"]).where(F.size("slots") == F.size("_values"))
    met = met.withColumn("_line", F.col("place") - F.col("_at"))
    line = ["_class", "_item", "_item_row", "_line", "reading"]
    # One row per alignment, reading and pair of values; a value with two partners breaks the alignment.
    pairs = met.select(*line, F.explode(F.arrays_zip("slots", "_values")).alias("_p")).select(*line, "_p.slots", "_p._values").distinct()
    sides = [
        pairs.groupBy(*line, side).count().where("count > 1").select(*line) for side in ("slots", "_values")
    ]
    broken = sides[0].union(sides[1]).distinct().withColumn("_broken", F.lit(True))
    judged = met.join(broken, line, "left").withColumn("_same", F.col("slots") == F.col("_values"))
    accepted = judged.where(F.col("_broken").isNull() | F.col("_same"))
    words = accepted.select("_class", "_item", "_item_row", "_item_words", "_same", F.explode(F.sequence("_at", F.col("_at") + F.col("size") - 1)).alias("_word"))
    words = words.groupBy("_class", "_item", "_item_row", "_item_words", "_word").agg(F.max("_same").alias("_same"))
    found = words.groupBy("_class", "_item", "_item_row", "_item_words").agg(
        F.count("*").alias("template_words"), F.count_if("_same").alias("exact_words")
    )
    return found.where(F.col("template_words") >= F.least(F.lit(cover), F.col("_item_words")))


def find_leaks(docs: DataFrame, items: DataFrame, cover: int = COVER) -> DataFrame:
    """doc_id, item_id and how much of the item the document holds, per contaminated pair.

    ``exact_words`` counts covered words in windows that repeat the item's values,
    ``template_words`` all covered words; ``reparameterised`` marks pairs that only
    the placeholders found.
    """
    best = _found(docs, items, cover).groupBy("_id", "_item").agg(
        F.max("exact_words").alias("exact_words"), F.max("template_words").alias("template_words"),
        F.max(F.col("template_words") / F.col("_item_words")).alias("coverage"),
        F.min(F.col("exact_words") < F.least(F.lit(cover), F.col("_item_words"))).alias("reparameterised"),
    )
    item_id = F.when(F.col("_item") != NO_ID, F.col("_item")).alias("item_id")
    return best.select(id_back(), item_id, "exact_words", "template_words", "coverage", "reparameterised")


def drop_leaks(docs: DataFrame, items: DataFrame, cover: int = COVER) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark item."""
    leaked = _found(docs, items, cover).select("_id", "_row").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select(
        F.struct("*").alias("_all"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_row")
    )
    return marked.join(leaked, ["_id", "_row"], "left_anti").select("_all.*")
