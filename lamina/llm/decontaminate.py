"""Benchmark decontamination over a positional inverted index of the training text.

All of it is expressions of DataFrames."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, ascii_lower, packed, row_key, scratch, sized_join, stored, unpacked

WINDOW = 10
#: Rarest terms of a window whose postings are intersected; the other words are compared where these agree.
RAREST = 2
#: Words by which a proximity match may be wider than a window.
SLOP = 5
#: A word, before A-Z are put in lower case: all but the ASCII characters that are no letter or digit. The ASCII ones that count are
#: named one by one, for then the JVM looks them up in a table.
WORD = rf"[{string.digits}{string.ascii_letters}\x80-\x{{10FFFF}}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


@dataclass
class Index:
    """postings (_k1, _k2, tid, pos) of every word of the training texts, in order of term within each file, so that a reader of few
    terms skips the rest by the files' statistics; windows (wid, n, words, items) of the test set. tid: a number of the term."""

    postings: DataFrame
    windows: DataFrame


def term(word: Column) -> Column:
    """A term's number. Terms are words in lower case as Spark has it, a little wider than A-Z: the comparison of words is what decides."""
    return F.xxhash64(F.lower(word))


def build(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW) -> Index:
    """A window is `width` consecutive words of an item, or all words of a shorter one; items without words have none. Both tables are stored."""
    tokens = items.select(F.col(item_col).alias("item"), words(ascii_lower(F.col(item_text))).alias("ws")).where(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(width))
    each = tokens.select("item", n.alias("n"), "ws", F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - width + 1, F.lit(1)))).alias("at")).select("item", "n", F.slice("ws", F.col("at"), F.col("n")).alias("words"))
    windows = stored(each.groupBy("words", "n").agg(F.collect_set("item").alias("items")).select(F.xxhash64("words").alias("wid"), "n", "words", "items"), "windows")
    text = F.col(text_col)
    each = docs.select(*row_key(F.col(id_col), text), words(text).alias("_ws"))  # keys before words: once a text, not once a word
    postings = each.select(*KEY, F.posexplode("_ws").alias("pos", "w")).select(*KEY, term(F.col("w")).alias("tid"), "pos")
    return Index(stored(postings.sortWithinPartitions("tid", *KEY, "pos"), "postings"), windows)


def frequencies(index: Index) -> DataFrame:
    """tid, df: postings of the test set's terms that the training text has."""
    asked = stored(index.windows.select(F.explode("words").alias("w")).select(term(F.col("w")).alias("tid")).distinct(), "terms")
    return stored(sized_join(index.postings.select("tid"), asked, ["tid"], "left_semi").groupBy("tid").agg(F.count(F.lit(1)).alias("df")), "frequencies")


def anchors(index: Index, rarest: int) -> DataFrame:
    """wid, n, tid, off, rank: each window's rarest terms by the number of postings, with their places in it. Windows with a term
    that the training text lacks have none."""
    places = index.windows.select("wid", "n", F.posexplode("words").alias("off", "w")).withColumn("tid", term(F.col("w")))
    known = places.join(frequencies(index), "tid", "left")
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy("df", "tid", "off"))).withColumn("least", F.min(F.coalesce("df", F.lit(0))).over(Window.partitionBy("wid")))
    return ranked.where((F.col("least") > 0) & (F.col("rank") <= rarest)).select("wid", "n", "tid", "off", "rank", F.least("n", F.lit(rarest)).alias("need"))


def phrase_matches(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", rarest: int = RAREST) -> DataFrame:
    """_k1, _k2 and found: for each text with a match, its matches (start, n, items), start counted in words from 0.

    The rarest terms' postings, less the terms' places in the window, are intersected; where they agree, the text's
    words are compared with the window's. A text's matches are no more than its words times the windows that it holds."""
    chosen = stored(anchors(index, rarest), "anchors")
    starts = sized_join(index.postings, chosen, ["tid"]).select(*KEY, "wid", (F.col("pos") - F.col("off")).alias("start"), "need", F.expr("shiftleft(1, rank - 1)").alias("bit"))
    agreed = starts.where("start >= 0").groupBy(*KEY, "wid", "start").agg(F.bit_or("bit").alias("bits"), F.max("need").alias("need")).where(F.col("bits") == F.expr("shiftleft(1, need) - 1"))
    agreed = stored(agreed.select(*KEY, "wid", "start"), "agreed")
    keys = stored(agreed.select(*KEY).distinct(), "agreed-keys")
    text = F.col(text_col)
    texts = sized_join(docs.select(*row_key(F.col(id_col), text), text.alias("_text")), keys, KEY, "left_semi").dropDuplicates(KEY)
    asked = sized_join(agreed, index.windows, ["wid"]).groupBy(*KEY).agg(F.collect_list(F.struct("start", "n", "words", "items")).alias("_asked"))
    both = texts.join(asked, KEY).select(*KEY, "_asked", F.array(words(ascii_lower(F.col("_text")))).alias("_words"))
    same = F.transform("_words", lambda ws: F.filter("_asked", lambda x: F.slice(ws, x["start"] + 1, x["n"]) == x["words"]))
    return both.select(*KEY, F.transform(F.element_at(same, 1), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), x["items"].alias("items"))).alias("found")).where(F.size("found") > 0)


def proximity_matches(index: Index, slop: int, rarest: int = 3, width: int = WINDOW) -> DataFrame:
    """_k1, _k2, wid, pos: places from which each of a window's rarest different terms occurs within width + slop words, in any order.

    The rarest are taken among the terms that the training text has, so that words it lacks don't hide a near copy; a window
    with fewer such terms than are asked for has no matches."""
    each = Window.partitionBy("wid")
    places = index.windows.select("wid", F.explode("words").alias("w")).select("wid", term(F.col("w")).alias("tid")).distinct().withColumn("need", F.least(F.count(F.lit(1)).over(each), F.lit(rarest)))
    known = places.join(frequencies(index), "tid").withColumn("rank", F.row_number().over(each.orderBy("df", "tid"))).withColumn("some", F.count(F.lit(1)).over(each))
    chosen = known.where((F.col("rank") <= rarest) & (F.col("some") >= F.col("need")))
    # windows of one passage have the same rarest terms mostly: each set of terms is looked for once
    sets = chosen.groupBy("wid").agg(F.array_sort(F.collect_set("tid")).alias("tids")).groupBy("tids").agg(F.collect_list("wid").alias("wids"))
    sets = stored(sets.select(F.monotonically_increasing_id().alias("set"), "tids", "wids", F.size("tids").alias("need")), "near-anchors")
    near = Window.partitionBy(*KEY, "set").orderBy("pos").rangeBetween(0, width + slop - 1)
    rows = sized_join(index.postings, sets.select("set", F.explode("tids").alias("tid"), "need"), ["tid"]).select(*KEY, "set", "tid", "pos", "need")
    found = rows.withColumn("n", F.size(F.collect_set("tid").over(near))).where("n = need").select(*KEY, "set", "pos").distinct()
    return sized_join(found, sets.select("set", "wids"), ["set"]).select(*KEY, F.explode("wids").alias("wid"), "pos")


def near_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", slop: int = SLOP) -> DataFrame:
    """id, n_near (proximity matches: windows and places) and items (ids of their items, as strings, sorted) of each row.

    A null text has no words and no matches; null or empty items none either, and a null item id is left out of items. Null ids are
    kept; repeated rows give a row each with the same matches; an empty table gives no rows. Other columns are left out."""
    with scratch(docs.sparkSession) as kept:
        index = build(docs, items, id_col, text_col, item_col, item_text)
        found = sized_join(proximity_matches(index, slop), index.windows.select("wid", "items"), ["wid"])
        ids = F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda x: x.cast("string"))))
        results = kept(found.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), ids.alias("_items")), "near-hits")
    rows = sized_join(docs.select(F.col(id_col).alias("_id"), *row_key(F.col(id_col), F.col(text_col))), results, KEY, "left")
    return rows.select(F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).alias("n_near"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """id, n_words, n_hit (words inside a match), items (ids of items with matches, as strings, sorted) of each row.

    A null text has no words; null or empty items none either. Null ids are kept; a null item id is left out of items.
    Repeated rows give a row each; empty tables give no rows, or no hits. Other columns are left out."""
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("m"))
    ordered = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("s"), (x["start"] + x["n"]).alias("e"))))
    hit = F.aggregate(ordered, zero, lambda a, x: F.struct((a["c"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["m"]))).alias("c"), F.greatest(a["m"], x["e"]).alias("m")), lambda a: a["c"])
    ids = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))), lambda x: x.cast("string")))
    with scratch(docs.sparkSession) as kept:
        found = phrase_matches(docs, build(docs, items, id_col, text_col, item_col, item_text, width), id_col, text_col)
        results = kept(found.select(*KEY, hit.cast("long").alias("_hit"), ids.alias("_items")), "hits")
    text = F.col(text_col)
    rows = sized_join(docs.select(F.col(id_col).alias("_id"), *row_key(F.col(id_col), text), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long").alias("_n")), results, KEY, "left")
    return rows.select(F.col("_id").alias(id_col), F.col("_n").alias("n_words"), F.coalesce("_hit", F.lit(0)).alias("n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))


def drop_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a window of an item; all columns as they were, whatever their names.

    A null text holds none, and stays; so does every row where items are empty, null or without words. Null ids are kept; rows that share id
    and text stay or go together; an empty table gives an empty one."""
    with scratch(docs.sparkSession) as kept:
        found = phrase_matches(docs, build(docs, items, id_col, text_col, item_col, item_text), id_col, text_col)
        hit = kept(found.select(*KEY), "hit-keys")
    marked = sized_join(packed(docs, id_col, text_col), hit.withColumn("_hit", F.lit(True)), KEY, "left")
    return unpacked(marked.where(F.col("_hit").isNull()))
