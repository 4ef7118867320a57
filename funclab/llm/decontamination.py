"""Benchmark passages in training texts, by a positional inverted index. DataFrame operations only.

The index holds postings (row, position) of training words, for those test terms that are the
rarest of some window, as counted over all training texts. A window's postings are aligned by
subtracting the term's place in its item; where both lists meet, the window is compared in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from funclab.plans.settle import free_name, lookup_join, settle_table

WINDOW = 13
#: Terms of a window whose postings are intersected, rarest first.
RAREST = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What stands between words, before letters are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def split_words(text):
    """Words as they stand, with an empty one before or after them where the text has other signs there."""
    return F.split(F.coalesce(text, F.lit("")), _BETWEEN)


def n_words(words):
    ends = F.when(F.element_at(words, 1) == "", 1).otherwise(0)
    return F.size(words) - ends - F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)


def row_key(docs: DataFrame):
    return F.xxhash64("doc_id", "text")


def windows_of(tests: DataFrame, window=WINDOW) -> DataFrame:
    """item, key (of the item and its words), at, length and words (lower-cased) of each window; an item of fewer words is one window."""
    words = F.filter(split_words(F.translate("text", _UPPER, _LOWER)), lambda x: x != "")
    items = tests.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - window, F.lit(0))
    # Other texts under the same id are items of their own.
    rows = items.select("item", F.xxhash64("item", "w").alias("key"), "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    part = F.slice("w", F.col("at") + 1, window)
    return rows.select("item", "key", "at", F.size(part).alias("length"), part.alias("words")).distinct()


class Index:
    """Postings of the terms that windows are looked up by.

    Terms are words lower-cased letter by letter, so that words that are equal once A-Z are
    lower-cased have one term; other words may share it, which the full comparison sorts out.
    """

    def __init__(self, docs: DataFrame, tests: DataFrame, window=WINDOW, rarest=RAREST):
        self.rarest = rarest
        self.docs = docs.select("doc_id", "text", row_key(docs).alias("row"))
        # An item text that stands twice under one id has its windows once.
        items = windows_of(tests, window)
        terms = items.select("key", "at", "length", F.posexplode("words").alias("place", "word"))
        terms = terms.select("key", "at", (F.col("at") + F.col("place")).alias("offset"), F.lower("word").alias("term"))
        terms, items = settle_table(terms, "terms"), settle_table(items, "windows")
        vocabulary = settle_table(terms.select("term").distinct(), "vocabulary")
        counts = lookup_join(self._tokens().select("row", "term"), vocabulary, ["term"], spread="row").groupBy("term").count()
        rank = Window.partitionBy("key", "at").orderBy(F.coalesce("count", F.lit(0)), "offset")
        ranked = terms.join(settle_table(counts, "counts"), "term", "left").withColumn("rank", F.row_number().over(rank))
        anchors = settle_table(ranked.filter(F.col("rank") <= rarest).select("key", "at", "offset", "term", "rank"), "anchors")
        needed = anchors.groupBy("key", "at").agg(F.collect_set("offset").alias("needed"))
        self.windows = settle_table(items.join(needed, ["key", "at"]), "windows")
        self.anchors = settle_table(anchors.select("key", "offset", "term").distinct(), "anchors")
        chosen = settle_table(anchors.select("term").distinct(), "terms")
        self.postings = settle_table(lookup_join(self._tokens(), chosen, ["term"], spread="row").distinct(), "postings")

    def _tokens(self):
        rows = self.docs.select("row", F.posexplode(split_words(F.col("text"))).alias("pos", "word"))
        return rows.select("row", "pos", F.lower("word").alias("term"))

    def aligned(self) -> DataFrame:
        """row, start and a window whose looked-up terms all stand in their places, not yet compared in full."""
        met = lookup_join(self.postings, self.anchors, ["term"], spread="row")
        met = met.groupBy("row", "key", (F.col("pos") - F.col("offset")).alias("shift")).agg(F.collect_set("offset").alias("met"))
        rows = lookup_join(met, self.windows, ["key"], spread="row")
        rows = rows.filter(F.size(F.array_intersect("needed", "met")) == F.size("needed"))
        return rows.select("row", (F.col("shift") + F.col("at")).cast("int").alias("start"), "length", "item", "words").filter("start >= 0")

    def phrases(self) -> DataFrame:
        """doc_id, row, n_words and ``hits`` (start, length, item) of exact windows, for every row of the texts."""
        found = self.aligned().groupBy("row").agg(F.collect_set(F.struct("start", "length", "item", "words")).alias("found"))
        rows = lookup_join(self.docs, settle_table(found, "found"), ["row"], "left", spread="doc_id")
        words = split_words(F.col("text"))
        exact = F.when(F.col("found").isNotNull(), split_words(F.translate("text", _UPPER, _LOWER)))
        rows = rows.select("doc_id", "row", n_words(words).cast("long").alias("n_words"), "found", exact.alias("exact"))
        same = lambda f: F.slice(F.col("exact"), f["start"] + 1, f["length"]) == f["words"]
        hits = F.transform(F.filter("found", same), lambda f: F.struct(f["start"], f["length"], f["item"]))
        return rows.select("doc_id", "row", "n_words", F.when(F.col("found").isNotNull(), hits).alias("hits"))

    def proximity(self, slop: int) -> DataFrame:
        """row, item, at, and places of a window's two rarest terms that stand within ``slop`` of their distance.

        Windows of one word, and words in other texts that only differ in letters beyond A-Z, are
        met as they are. Positions are met by ranges of ``slop`` words, not by all pairs of a text.
        """
        pairs = self.windows.filter(F.size("needed") == 2).select("item", "key", "at", F.array_sort("needed").alias("n"))
        pairs = pairs.select("item", "key", "at", F.col("n")[0].alias("o1"), F.col("n")[1].alias("o2"))
        side = lambda k: self.anchors.select("key", F.col("offset").alias(f"o{k}"), F.col("term").alias(f"term{k}"))
        pairs = settle_table(pairs.join(side(1), ["key", "o1"]).join(side(2), ["key", "o2"]), "pairs")
        width = slop + 1
        place = lambda k: self.postings.select("row", F.col("term").alias(f"term{k}"), F.col("pos").alias(f"pos{k}"))
        first = lookup_join(place(1), pairs, ["term1"], spread="row").withColumn("due", F.expr("pos1 + o2 - o1"))
        first = first.withColumn("range", F.explode(F.sequence(F.floor((F.col("due") - slop) / width), F.floor((F.col("due") + slop) / width))))
        second = place(2).withColumn("range", F.floor(F.col("pos2") / width))
        met = first.join(second, ["row", "term2", "range"]).filter(F.abs(F.col("pos2") - F.col("due")) <= slop)
        return met.select("row", "item", "at", "pos1", "pos2").distinct()


def _covered(spans):
    """Words covered by spans sorted by start."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], acc["end"]))).alias("n"),
        F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step)["n"]


def contamination(docs: DataFrame, tests: DataFrame, window=WINDOW, least=0.05) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``.

    A null text, and a null or empty item text, has no words. Rows that repeat an id are judged one
    by one, a null item id is named by an empty string, and other columns are not read. A text is
    contaminated where words in windows are at least ``least`` of its words (and there are any).
    """
    rows = Index(docs, tests, window).phrases()
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    n_hit = F.coalesce(F.when(F.size("hits") > 0, _covered(F.array_sort("hits"))), F.lit(0)).cast("long")
    items = F.coalesce(items, F.array().cast("array<string>"))
    out = rows.select("doc_id", "row", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    share = F.col("n_hit") >= F.ceil(F.col("n_words") * F.lit(least).cast("decimal(6,4)"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & share)


def clean(docs: DataFrame, tests: DataFrame, window=WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names.

    Texts without words are kept, repeated rows are judged alike, and an empty table gives no rows.
    """
    judged = contamination(docs, tests, window).filter("contaminated").select("row").distinct()
    row, bad = free_name("row", docs), free_name("bad", docs)
    kept = docs.withColumn(row, row_key(docs))
    table = settle_table(judged.select(F.col("row").alias(row), F.lit(True).alias(bad)), "bad")
    return lookup_join(kept, table, [row], "left", spread="doc_id").filter(F.col(bad).isNull()).select(*docs.columns)
