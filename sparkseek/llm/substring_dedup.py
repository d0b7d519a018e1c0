"""Substring de-duplication: winnowed anchors that documents share, extended both ways to maximal repeated passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import _power_tables, arrow_map, materialise, mix, of_all, pruned, settle, slices, text_buffer, words

#: Words that a passage must have at least to count as a repeat.
MIN_WORDS = 50
#: Runs whose anchor has more places are counted with a combine before the exchange, and not in one task's window.
HOT = 1 << 16


def anchor_words(min_words: int) -> int:
    """Words of an anchor. A window of min_words words then holds min_words - anchor + 1 anchors' places."""
    return max(1, (min_words + 1) // 2)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place on; 0 where fewer are left in h."""
    n = len(h)
    out = np.zeros(n, np.uint64)
    if n >= k:
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(h * up[:n], out=total[1:])
            out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1] + np.uint64(k))
    return out


def again(h: np.ndarray) -> np.ndarray:
    """Other hashes of the same words, for the second half of 128 bits."""
    return mix(h ^ np.uint64(0x5851F42D4C957F2D))


def sliding(a: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each a[i : i + w], in log w passes; shorter near the end."""
    out, have = a.copy(), 1
    while have < w:
        step = min(have, w - have)
        if step < len(out):
            out[: len(out) - step] = pick(out[: len(out) - step], out[step:].copy())
        have += step
    return out


def winnow(h: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors: the least hash of every window of min_words words, all of them at ties."""
    k = anchor_words(min_words)
    w = min_words - k + 1
    n = len(h)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    grams = rolling(h, k)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = sliding(np.where(left >= k, grams, top), w, np.minimum)
    least = np.where(left >= min_words, least, np.uint64(0))
    most = sliding(least[::-1], w, np.maximum)[::-1]
    chosen = np.flatnonzero((left >= k) & (most == grams) & (most > 0))
    return chosen, grams[chosen]


def _places(data: np.ndarray) -> np.ndarray:
    """Characters before each byte."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """(hash, check, id, of, place, extent): an anchor has its place, and check 0, as it is but a candidate; a whole text
    of min_words words or more has place -1 - words, the second half of 128 bits in check, and in extent the first
    character of its first word and the last of its last. `of` tells the texts of an id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                ids = batch.column("id").slice(lo, hi - lo)
                data, off = text_buffer(batch.column("text").slice(lo, hi - lo))
                h, start, end, first = words(data, off)
                count = np.diff(first)
                place, key = winnow(h, first, min_words)
                doc = np.searchsorted(first, place, side="right") - 1
                whole = np.flatnonzero(count >= min_words)
                own = of_all(h, first[:-1], first[1:]).view(np.int64)
                chars = _places(data)
                a, b = chars[start[first[whole]]] - chars[off[whole]], chars[end[first[whole + 1] - 1]] - chars[off[whole]]
                every = np.concatenate([doc, whole])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key.view(np.int64), own[whole]])),
                        pa.array(np.concatenate([np.zeros(len(key), np.int64), of_all(again(h), first[whole], first[whole + 1]).view(np.int64)])),
                        ids.take(pa.array(every)),
                        pa.array((own[every] >> 33).astype(np.int32)),
                        pa.array(np.concatenate([place - first[doc], -1 - count[whole]]).astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(len(key), np.int64), a << 32 | b])),
                    ],
                    names=["hash", "check", "id", "of", "place", "extent"],
                )

    return arrow_map(docs, run, f"hash bigint, check bigint, id {docs.schema['id'].dataType.simpleString()}, of int, place int, extent bigint")


def _extended(seeded: DataFrame, min_words: int, hot: bool) -> DataFrame:
    """(hash, check, id, head, tail) of every passage of min_words words around a seed: as far left and right as holds it.

    head is the passage's first word and first character, tail its text and last character. Only passages whose least
    anchor is hot, or those whose isn't: equal passages have the same anchor.
    """
    k = anchor_words(min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                ids, seeds = part.column("id"), part.column("seeds")
                data, off = text_buffer(part.column("text"))
                h, start, end, first = words(data, off)
                n = len(h)
                own = of_all(h, first[:-1], first[1:]).view(np.int64) >> 33
                doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
                of, places = np.repeat(np.arange(len(seeds)), np.diff(np.asarray(seeds.offsets.to_numpy()))), seeds.flatten().to_numpy()
                right = own[of] == part.column("of").to_numpy()[of]
                of, places = of[right], places[right]
                at = first[of] + (places >> 1)
                change = np.zeros(n + 1, np.int64)
                np.add.at(change, np.maximum(at - (min_words - k), first[of]), 1)
                np.add.at(change, at + 1, -1)
                near = np.cumsum(change[:n]) > 0
                begin = np.flatnonzero(near & (np.arange(n) + min_words <= first[doc + 1]))
                is_hot = np.zeros(len(begin), bool)
                if (places & 1).any():
                    grams = rolling(h, k)
                    is_hot = np.isin(sliding(grams, min_words - k + 1, np.minimum)[begin], grams[at[(places & 1) == 1]])
                begin = begin[is_hot == hot]
                key, check = rolling(h, min_words)[begin], rolling(again(h), min_words)[begin]
                chars = _places(data)
                d = doc[begin]
                head = (begin - first[d]) << 32 | (chars[start[begin]] - chars[off[d]])
                tail = own[d] << 32 | (chars[end[begin + min_words - 1]] - chars[off[d]])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(check.view(np.int64)), ids.take(pa.array(d)), pa.array(head), pa.array(tail)], names=["hash", "check", "id", "head", "tail"])

    return arrow_map(seeded, run, f"hash bigint, check bigint, id {seeded.schema['id'].dataType.simpleString()}, head bigint, tail bigint")


def _by_window(rows: DataFrame) -> DataFrame:
    """Rows whose run several ids have, with lo and hi, the smallest and largest of them, and group, a hash of their set."""
    by = Window.partitionBy("hash", "check")
    several = rows.withColumns({"lo": F.min("id").over(by), "hi": F.max("id").over(by)}).where("lo <> hi")
    once = F.when(F.lag("id").over(by.orderBy("id")) == F.col("id"), 0).otherwise(F.xxhash64("id"))
    return several.withColumn("once", once).withColumn("group", F.expr("bit_xor(once)").over(by)).drop("once")


def _by_combining(rows: DataFrame) -> DataFrame:
    """The same, for runs that so many documents share that no task can hold them."""
    known = rows.select("hash", "check", "id").distinct().groupBy("hash", "check").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("group"))
    return rows.join(known.where("lo <> hi"), ["hash", "check"])


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, n_words, start_char, end_char, partner, pieces): the maximal repeated passages of each document.

    A passage of a document repeats if each run of min_words successive words in it also stands in a document of
    another id, word for word but for case and what is between words; it is maximal if it can't be extended by a word
    either way. start_char and end_char count characters, the end is exclusive. partner is another id that shares some
    such run of the passage: of each run's ids the smallest, or the largest for the smallest itself, and of those the
    smallest; if others have all the words of the text and no more, it is one of these. A passage repeated only within
    one document is none.

    pieces, array<struct<start_word, n_words, group>>, splits a passage where the set of documents that share its runs of
    min_words words changes: all documents with a piece of a group share that piece, so every pair and its maximal
    repeats, which are successive pieces of groups that both have, can be told without a row a pair. The first piece of a
    text that others have whole is the whole, and its group is that of these copies; the one that stands for them has
    the pieces that it shares with other texts too.

    Seeds are the anchors (winnowed runs of about half min_words words, one at least in every min_words words) that
    documents of two ids share, joined by hash. Each is extended both ways; what others share at full length stays, and
    what overlaps by all but a word is one passage. All partners count, without a pair for each. Texts with the same
    words throughout are one whole repeat each, and one of them stands for all. Runs are equal if 128 bits of hashes
    are: among 10^14 runs, a false match has a chance of about 10^-11.

    Null texts, texts of fewer words and rows with a null id have no repeats. Rows that repeat an id are one document,
    which isn't its own partner; identical ones give one result. Other columns don't matter. An empty table gives an
    empty result.
    """
    some = pruned(docs, id=id_col, text=text_col).where("id IS NOT NULL AND text IS NOT NULL")
    anchors = _anchors(some, min_words)
    known = anchors.groupBy("hash", "check").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), (F.count("*") > HOT).alias("hot")).where("lo <> hi")
    shared = materialise(anchors.join(known, ["hash", "check"]), "anchors")
    settle(docs.sparkSession)
    partner = F.when(F.col("lo") == F.col("id"), F.col("hi")).otherwise(F.col("lo"))
    whole = shared.where("place < 0")
    place = F.shiftleft("place", 1) + F.col("hot").cast("int")
    seeds = shared.where("place >= 0").join(whole.where("id <> lo").select("id", "of"), ["id", "of"], "left_anti").groupBy("id", "of").agg(F.collect_set(place).alias("seeds"), F.max("hot").alias("hot"))
    seeded = lambda these: some.join(these, "id").select("id", "text", "of", "seeds")
    found = _by_window(_extended(seeded(seeds), min_words, False))
    if not shared.where("place >= 0 AND hot").isEmpty():
        found = found.unionByName(_by_combining(_extended(seeded(seeds.where("hot")), min_words, True)))
    split = lambda c: (F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    (word, begin), (of, end) = split("head"), split("tail")
    each = found.select("id", of.cast("int").alias("of"), word.alias("word"), begin.alias("begin"), end.alias("end"), partner.alias("partner"), "group")
    in_text = Window.partitionBy("id", "of").orderBy("word")
    ahead = each.withColumn("new", F.when(F.col("word") - F.lag("word").over(in_text) <= 1, 0).otherwise(1)).withColumn("turn", F.when((F.col("new") == 0) & (F.col("group") == F.lag("group").over(in_text)), 0).otherwise(1))
    so_far = in_text.rowsBetween(Window.unboundedPreceding, 0)
    runs = ahead.withColumns({"run": F.sum("new").over(so_far), "piece": F.sum("turn").over(so_far)})
    own = [F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("partner").alias("partner")]
    pieces = runs.groupBy("id", "of", "run", "piece", "group").agg(F.min("word").alias("a"), F.max("word").alias("b"), *own)
    piece = F.struct(F.col("a").alias("start_word"), (F.col("b") - F.col("a") + min_words).alias("n_words"), "group")
    passages = materialise(pieces.groupBy("id", "of", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), *own, F.array_sort(F.collect_list(piece)).alias("pieces")), "passages")
    parts = passages.join(whole.select("id", "of").distinct(), ["id", "of"], "left_anti").select(
        "id", F.col("a").alias("start_word"), (F.col("b") - F.col("a") + min_words).alias("n_words"), F.col("begin").alias("start_char"), F.col("end").alias("end_char"), "partner", "pieces"
    )
    copies = whole.select(
        "id", "of", F.lit(0).cast("bigint").alias("start_word"), (-1 - F.col("place")).cast("bigint").alias("n_words"), split("extent")[0].alias("start_char"), split("extent")[1].alias("end_char"), partner.alias("partner"), "hash"
    ).groupBy("id", "of", "start_word", "n_words", "start_char", "end_char").agg(F.min("partner").alias("partner"), F.min("hash").alias("hash"))
    within = passages.groupBy("id", "of").agg(F.array_sort(F.flatten(F.collect_list("pieces"))).alias("pieces"))
    all_of_it = F.struct("start_word", "n_words", F.col("hash").alias("group"))
    copies = copies.join(within, ["id", "of"], "left").withColumn("pieces", F.concat(F.array(all_of_it), F.coalesce("pieces", F.array().cast(within.schema["pieces"].dataType)))).drop("hash", "of")
    return parts.union(copies).withColumnRenamed("id", id_col)
