"""Operator 13: a mix of documents whose sources come near given weights.

Sources share ``share`` times all words by weight; weights repeat over the sources
in order of their names, null last. A target above ``most`` times its source stops
there and the excess is shared anew by weight among the others, until none is above.

Each document of a source is wanted the same number of times, target over size. The
whole part of that is taken at once; the fraction is rounded by pivots. Two
documents with fractions x and y and sizes a and b move words between them, x a + y b
staying as it is, until one fraction is 0 or 1: either as many words as can go to
the first, or as many as can go to the second, with chances that leave the expected
fractions as they were. The settled one is done, the other meets the next document.
So only one document of a source is left at the end; it is taken or not, whichever
is nearer. A source's taken words miss its target by half that document at most.

Pivots run in a tree: 64 documents of a source, largest first, leave one, and 64 of
those leave one again. Largest first, because a large fraction is settled by others
of its size and the one left at the end is then mostly small. Every group holds 64
rows however large its source is, and one row in 64 goes on to the next round.

Draws hash the two documents' keys (id, source, text and seed), so reruns agree
however rows are dealt out. Only DataFrame functions are used.

Null text has size 0 and is taken 0 times; null doc_id is a value like any other;
equal rows are documents of their own, which may be told apart by nothing: they
take what falls to their place. An empty table gives no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.llm.ranks import group_key, ranked
from usagelens.session import materialize

#: Fixed values of the contract: weights by source, words in all against the corpus, most words of a source against its size.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Documents that one group settles but for one.
GROUP = 64
#: A word stands between spaces and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, _source, size and the key of each document's draws."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    whole = F.concat_ws("\n", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), group_key("source"), "text")
    return names.select(
        "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64(whole).alias("key")
    ).withColumn("_source", group_key("source"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """_source, source_size and target of each source of sized documents.

    Each turn stops the targets that are above and shares the rest anew; only sums
    over the sources reach the driver.
    """
    totals = rows.groupBy("_source", "source").agg(F.sum("size").alias("source_size")).withColumn("_all", F.lit("all"))
    placed = ranked(totals, "_all", [F.col("source").asc_nulls_last()], "sources")
    nth = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    sources = materialize(placed.select("_source", "source_size", nth.alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    words, rate, stopped = None, 0.0, -1
    while True:
        above = F.col("weight") * F.lit(rate) > F.col("cap")
        words, held, open_, now = sources.agg(
            F.sum("source_size") * F.lit(share), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)), F.count_if(above),
        ).first()
        if now == stopped or not open_:
            return sources.select("_source", "source_size", F.when(above, F.col("cap")).otherwise(F.col("weight") * F.lit(rate)).alias("target"))
        rate, stopped = (words - held) / open_, now


def _pivot(carry: Column, new: Column) -> Column:
    """The carried document meets a new one: one is settled, the other carried on."""
    x, y = carry["p"], new["p"]
    a, b = carry["size"].cast("double"), new["size"].cast("double")
    up, down = F.least((1 - x) * a, y * b), F.least(x * a, (1 - y) * b)
    draw = F.shiftrightunsigned(F.xxhash64(carry["key"], new["key"]), 11) / F.lit(float(1 << 53))
    gains = draw * (up + down) < down
    settled = F.when(gains, (1 - x) * a <= y * b).otherwise(x * a <= (1 - y) * b)
    moved = F.when(gains, up).otherwise(-down)
    p = F.when(settled, y - moved / b).otherwise(x + moved / a)
    # The carried one ends full where it gains and empty where it loses, the new one the other way round.
    extra = F.when(settled == gains, F.lit(1)).otherwise(F.lit(0))
    pick = lambda name: F.when(settled, new[name]).otherwise(carry[name])
    done = F.struct(
        F.when(settled, carry["doc_id"]).otherwise(new["doc_id"]).alias("doc_id"),
        F.when(settled, carry["size"]).otherwise(new["size"]).alias("size"), extra.alias("extra"),
    )
    return F.struct(
        pick("key").alias("key"), pick("doc_id").alias("doc_id"), pick("size").alias("size"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), F.concat(carry["settled"], F.array(done)).alias("settled"),
    )


def _settle(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One round: groups of ``GROUP`` neighbours leave one document each."""
    none = F.array().cast("array<struct<doc_id:bigint,size:bigint,extra:int>>")
    one = F.struct("pos", "key", "doc_id", "size", "p", none.alias("settled"))
    groups = rows.groupBy(*keep, F.floor(F.col("pos") / GROUP).alias("_group")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    first = F.col("all")[0]
    start = F.struct(*[first[c].alias(c) for c in ("key", "doc_id", "size", "p", "settled")])
    folded = F.aggregate(F.slice("all", 2, GROUP), start, _pivot)
    return groups.select(*keep, F.col("_group").alias("pos"), folded.alias("left"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix"
) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and copies and words taken, of every document."""
    rows = materialize(sized(docs, seed), "sizes")
    wanted = source_targets(rows, weights, share, most)
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = wanted.withColumn("whole", F.floor(times)).withColumn("p", times - F.floor(times))
    keep = ["_source", "source_size", "target", "whole"]
    known = rows.drop("source").join(wanted, "_source")
    plain = (F.col("size") == 0) | (F.col("p") == 0)
    out = known.where(plain).select(*keep, "doc_id", "size", F.lit(0).alias("extra"))
    left = ranked(known.where(~plain), "_source", [F.col("size").desc(), F.col("key")], "mix")
    most_rows = left.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    left = left.drop("n")
    while most_rows:
        folded = materialize(_settle(left, keep), "settled")
        out = out.unionByName(folded.select(*keep, F.inline("left.settled")))
        left = folded.select(*keep, "pos", "left.key", "left.doc_id", "left.size", "left.p")
        if most_rows <= GROUP:
            out = out.unionByName(left.select(*keep, "doc_id", "size", (F.col("p") >= 0.5).cast("int").alias("extra")))
            break
        most_rows = -(-most_rows // GROUP)
    copies = F.col("whole") + F.col("extra")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
