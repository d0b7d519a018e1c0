"""Personal identifiers by bootstrapped contextual extraction: seeds induce patterns, good patterns find more."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, build_filter, column, held_by, materialise, mix, of_all, pruned, release, slices, text_buffer, words

KINDS = ("email", "phone", "card", "ip", "secret")
ROUNDS = 3
#: A pattern counts from this confidence on, an identifier is reported from that one on.
PATTERN_FROM = 0.5
REPORT_FROM = 0.6
#: What an instance of unknown kind counts for against a pattern with a shape, and against one of context alone.
UNKNOWN_SHAPED, UNKNOWN_BARE = 0.05, 1.0
#: Distinct seeds that a context has at least if tokens without a digit or @ are looked for in it: with one such token
#: of unknown kind and DOUBT against it, fewer can't make it a pattern.
CONTEXT_SEEDS = 2
#: Added to the evidence against every pattern, so that few instances prove little.
DOUBT = 1.0
#: The share of rows that contexts are looked at in first, and (context, value) pairs that a task holds before it sends them.
FIRST_SHARE = 1 / 16
HELD_PAIRS = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(48, 58), 64]] = True
_LEFT, _RIGHT = "\"'`[{<*_#|", ".,;:!?\"'`]}>*&%$#|_"
_PIECE = re.compile(r"[+(]?\(?\d{1,4}(?:[)\-]+\d{1,4})*\)?")
#: What may not stand before a form of digits: a word, or a number that goes on.
_OPEN, _SHUT = r"(?<!\w)(?<!\d[.\-+])", r"(?!\w|[.\-]\d)"
_EMAIL = re.compile(r"(?<![\w.+\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[A-Za-z]{2,}")
_SECRET = re.compile(
    r"(?<![0-9A-Za-z/])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|github_pat_\w{22,255}|glpat-[\w\-]{20,}|[sr]k_(?:live|test)_[0-9A-Za-z]{16,}|sk-[\w\-]{20,}|xox[abprs]-[0-9A-Za-z\-]{10,}|AIza[\w\-]{35}|eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,})(?![0-9A-Za-z])"
)
_CARD = re.compile(_OPEN + r"(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ \-])\d{6}\2\d{5})" + _SHUT)
_PHONE = re.compile(_OPEN + r"(?:\+?\d{1,3}[ \-]?\(\d{3}\)[ \-]?\d{3}-\d{4}|\(\d{3}\)[ \-]?\d{3}-\d{4}|(?:\+?1[ .\-])?\d{3}([.\-])\d{3}\1\d{4}|\+[1-9]\d{0,2}(?:[ .\-]?(?:\(\d{1,4}\)|\d{1,4})){2,6})" + _SHUT)
_IP = re.compile(r"(?<![\w.])[1-9]\d{0,2}(?:\.\d{1,3}){3}(?!\w|\.\d)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(value: str) -> str:
    return re.sub(r"\D", "", value)


_FORMS = (
    ("email", _EMAIL, lambda v: True),
    ("secret", _SECRET, lambda v: True),
    ("card", _CARD, lambda v: luhn(_digits(v))),
    ("phone", _PHONE, lambda v: 8 <= len(_digits(v)) <= 15),
    ("ip", _IP, lambda v: all(int(x) < 256 for x in v.split("."))),
)


def seeds_in(text: str) -> list[tuple[int, int]]:
    """(begin, end) of what is beyond doubt by its form alone, wherever it stands; of two that overlap the first form's."""
    out: list[tuple[int, int]] = []
    for kind, form, right in _FORMS:
        if kind == "email" and "@" not in text:
            continue
        more = [m.span() for m in form.finditer(text) if right(m[0])]
        if out and more:
            begins = [a for a, _ in out]
            more = [(a, b) for a, b in more if not ((i := bisect.bisect_left(begins, b)) and out[i - 1][1] > a)]
        out = sorted(out + more) if more else out
    return out


def seed_kind(value: str) -> str | None:
    """The kind of a value that is beyond doubt by its form alone."""
    return next((kind for kind, form, right in _FORMS if form.fullmatch(value) and right(value)), None)


def shape(value: str) -> str:
    """What kinds of characters follow each other: h for long hexadecimal runs, d for up to three digits, a for letters."""
    value = re.sub(r"(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{16,}", "\x00", value)
    value = re.sub(r"[^\W\d_]+", "a", value)
    value = re.sub(r"\d+", lambda m: "d" if len(m[0]) < 4 else f"d{len(m[0])}", value)
    return value.replace("\x00", "h")


def stripped(token: str) -> tuple[int, int]:
    """Where the token begins and ends without quotes and marks around it; a bracket stays if its partner is inside."""
    a, b = 0, len(token)
    changed = True
    while changed and a < b:
        changed = False
        if token[a] in _LEFT or token[a] == "(" and ")" not in token[a:b]:
            a, changed = a + 1, True
        if a < b and (token[b - 1] in _RIGHT or token[b - 1] == ")" and "(" not in token[a:b]):
            b, changed = b - 1, True
    return a, b


def _word(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    a, b = stripped(text)
    return (text[a:b] or text).lower()


def _around(text: str, begin: int, end: int) -> tuple[str, str, str]:
    """(two words before, word before, word after) of a place in a text, within its line; a part of a word is a word."""
    # a word of more than 1000 characters is cut
    left = text[max(text.rfind("\n", 0, begin) + 1, begin - 1000) : begin].split()[-2:]
    right = text[end : end + 1000].split("\n", 1)[0].split()[:1]
    left = ["^"] * (2 - len(left)) + left
    one = _word(left[1].encode("utf-8", "replace"))
    return f"{_word(left[0].encode('utf-8', 'replace'))} {one}", one, _word(right[0].encode("utf-8", "replace")) if right else "$"


def _spans(text: str, given: re.Pattern | None) -> list[tuple[int, int]]:
    """(begin, end) of the seeds in a text, those given too."""
    spans = seeds_in(text)
    if given is not None:
        spans = sorted(spans + [m.span() for m in given.finditer(text) if not any(a < m.end() and m.start() < b for a, b in spans)])
    return spans


def candidates(texts: pa.Array, given: re.Pattern | None = None) -> Iterator[tuple[int, str, str, str, str, int, int]]:
    """(row, value, two words before, word before, word after, first character, end) of each seed and each other token
    with a digit or @.

    Seeds are found wherever they stand, so in JSON, CSV and URLs too; a token that holds or touches one, and isn't one
    itself, is no candidate. given finds the values that the caller has given as seeds.
    """
    held: dict[int, list[tuple[int, int]]] = {}
    strings = texts.to_pylist()
    for i, text in enumerate(strings):
        if not text:
            continue
        spans = _spans(text, given)
        if spans:
            held[i] = spans
    whole: dict[int, set[tuple[int, int]]] = {}
    for token in _tokens(texts):
        spans = held.get(token[0])
        if spans:
            lo, hi = token[5], token[6]
            i = bisect.bisect_left(spans, (hi, 0))
            if i and spans[i - 1][1] > lo:
                if spans[i - 1] != (lo, hi):
                    continue
                whole.setdefault(token[0], set()).add((lo, hi))
        yield token
    for doc, spans in held.items():
        done = whole.get(doc, ())
        for a, b in spans:
            if (a, b) not in done:
                yield doc, strings[doc][a:b], *_around(strings[doc], a, b), a, b


def _contexts(strings: list[str]) -> np.ndarray:
    """A hash of the words in each of some contexts, whatever marks are around them."""
    data, off = text_buffer(pa.array(strings, pa.string()))
    data = np.where(data == 95, 32, data).astype(np.uint8)
    h, _, _, first = words(data, off)
    return of_all(h, first[:-1], first[1:]).view(np.int64)


def _level(keys: np.ndarray, i: int) -> np.ndarray:
    """What stands in a filter for contexts whose limit has i binary digits or more."""
    return (keys.view(np.uint64) ^ mix(np.array([i], np.uint64))).view(np.int64) if i else keys


def _most(filter_words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The limits of contexts by the filter, which rounds them up."""
    digits, at, i = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    while i < 32 and len(at := at[held_by(filter_words, _level(keys[at], i))]):
        digits[at] = i
        i += 1
    return (1 << digits) - 1


def plain_tokens(texts: pa.Array, filter_words: np.ndarray, values: np.ndarray | None = None, given: re.Pattern | None = None) -> Iterator[tuple[int, str, str, int, int, int]]:
    """(row, value, two words before, first character, end, limit of the context) of each token without a digit or @ in a
    context that the filter may hold; with `values`, of those alone that this filter may hold.

    What holds or touches a seed is none: those are the first kind of candidates, or parts of one.
    """
    data, off = text_buffer(texts)
    if not len(data):
        return
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.append(True, space[:-1] | edge[1:-1]))
    ends = np.flatnonzero(~space & np.append(space[1:] | edge[1:-1], True)) + 1
    marks = np.concatenate([[0], np.cumsum(_MARK[data])])
    line = np.concatenate([[0], np.cumsum((data == 10) | edge[1:])])[starts]  # which line of which text
    h, word, _, _ = words(np.where(data == 95, 32, data).astype(np.uint8), off)
    back = lambda n: np.maximum(np.arange(len(starts)) - n, 0)
    one, two = (line[back(n)] == line for n in (1, 2))
    one[:1] = two[:2] = False
    begin = starts[np.where(two, back(2), np.where(one, back(1), np.arange(len(starts))))]
    context = of_all(h, np.searchsorted(word, begin), np.searchsorted(word, starts)).view(np.int64)
    likely = np.flatnonzero(one & (marks[ends] == marks[starts]))
    likely = likely[held_by(filter_words, context[likely])]
    if values is not None:
        likely = likely[held_by(values, of_all(h, np.searchsorted(word, starts[likely]), np.searchsorted(word, ends[likely])).view(np.int64))]
    if not len(likely):
        return
    each, which = np.unique(context[likely], return_inverse=True)
    most = _most(filter_words, each)[which]
    spans: dict[int, list[tuple[int, int]]] = {}
    raw, chars = data.tobytes(), np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.searchsorted(off, starts[likely], side="right") - 1
    for i, doc, limit in zip(likely.tolist(), row.tolist(), most.tolist()):
        text = raw[starts[i] : ends[i]].decode("utf-8", "replace")
        lo, hi = stripped(text)
        if not any(c.isalpha() for c in text[lo:hi]) or len(text) >= 20 and _SECRET.search(text):
            continue
        before = [_word(raw[starts[i - n] : ends[i - n]]) if i >= n and same[i] else "^" for n, same in ((2, two), (1, one))]
        at = int(chars[starts[i]] - chars[off[doc]]) + lo
        if given is not None:
            if doc not in spans:
                spans = {doc: _spans(raw[off[doc] : off[doc + 1]].decode("utf-8", "replace"), given)}
            if any(a < at + hi - lo and at < b for a, b in spans[doc]):
                continue
        yield doc, text[lo:hi], " ".join(before), at, at + hi - lo, limit


def _tokens(texts: pa.Array) -> Iterator[tuple[int, str, str, str, str, int, int]]:
    """(row, value, two words before, word before, word after, first character, end) of each token with a digit or @.

    Tokens are what lies between white space; pieces of a phone number with a space between are one.
    """
    data, off = text_buffer(texts)
    if not len(data):
        return
    marks = np.flatnonzero(_MARK[data])
    if not len(marks):
        return
    raw = data.tobytes()
    space = np.flatnonzero(_SPACE[data])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.searchsorted(off, marks, side="right") - 1
    at = np.searchsorted(space, marks)
    begin = np.maximum(np.where(at > 0, space[np.maximum(at - 1, 0)] + 1, 0), off[row]) if len(space) else off[row]
    end = np.minimum(np.where(at < len(space), space[np.minimum(at, len(space) - 1)], len(data)), off[row + 1]) if len(space) else off[row + 1]
    _, first = np.unique(begin, return_index=True)
    tokens = [(int(row[i]), int(begin[i]), int(end[i])) for i in first]

    def before(doc: int, place: int) -> tuple[bytes, int]:
        lo, stop = int(off[doc]), place
        while stop > lo and raw[stop - 1] in b" \t\r\x0b\x0c":
            stop -= 1
        if stop == lo or raw[stop - 1] == 10:
            return b"^", lo
        i = int(np.searchsorted(space, stop))
        start = max(lo, int(space[i - 1]) + 1 if i else 0)
        return raw[start:stop], start

    def after(doc: int, place: int) -> bytes:
        hi = int(off[doc + 1])
        while place < hi and raw[place] in b" \t\r\x0b\x0c":
            place += 1
        if place == hi or raw[place] == 10:
            return b"$"
        i = int(np.searchsorted(space, place))
        return raw[place : min(hi, int(space[i])) if i < len(space) else hi]

    i = 0
    while i < len(tokens):
        doc, a, b = tokens[i]
        i += 1
        text = raw[a:b].decode("utf-8", "replace")
        while _PIECE.fullmatch(text.rsplit(" ", 1)[-1]) and i < len(tokens) and tokens[i][0] == doc and tokens[i][1] == b + 1 and raw[b] == 32:
            more = raw[tokens[i][1] : tokens[i][2]].decode("utf-8", "replace")
            if not _PIECE.fullmatch(more.rstrip(_RIGHT)):
                break
            text, b = f"{text} {more}", tokens[i][2]
            i += 1
        lo, hi = stripped(text)
        value = text[lo:hi]
        if not value or not any(c.isdigit() or c == "@" for c in value):
            continue
        one, start = before(doc, a)
        two = before(doc, start)[0] if one != b"^" else b"^"
        start_char = int(chars[a] - chars[off[doc]]) + lo
        yield doc, value, f"{_word(two)} {_word(one)}", _word(one), _word(after(doc, b)), start_char, start_char + len(value)


_KINDS_OF = "value string, seed string, patterns array<string>, start bigint, end bigint"


def _batch(ids: pa.Array, rows: list[int], *columns: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), *[pa.array(c, kind) for c, kind in zip(columns, kinds)]], names=["id", "value", "seed", "patterns", "start", "end"])


def _left(two: str) -> list[str]:
    """The pattern of the words before; that nothing is before, at the start of a line, is none."""
    return [] if two == "^ ^" else [f"L {two}"]


def _form(given: list[str]) -> re.Pattern | None:
    return re.compile("|".join(rf"(?<!\w){re.escape(v)}(?!\w)" for v in sorted(given, key=len, reverse=True))) if given else None


def _candidates(docs: DataFrame, given: re.Pattern | None) -> DataFrame:
    """(id, value, seed, patterns, start, end) of the seeds and of the tokens with a digit or @."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text"), 8 << 20):
                rows = [*candidates(batch.column("text").slice(lo, hi - lo), given)]
                shapes = [shape(r[1]) for r in rows]
                patterns = [[*_left(two), f"S {s}", f"LS {one} {s}", f"SR {s} {after}"] for (_, _, two, one, after, _, _), s in zip(rows, shapes)]
                yield _batch(batch.column("id").slice(lo, hi - lo), [r[0] for r in rows], [r[1] for r in rows], [seed_kind(r[1]) for r in rows], patterns, [r[5] for r in rows], [r[6] for r in rows])

    return arrow_map(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, {_KINDS_OF}")


def _seed_contexts(found: DataFrame) -> DataFrame:
    """(context, most): the contexts of CONTEXT_SEEDS distinct seeds or more, and how many plain values without any
    confidence one may have and still be a pattern, when all others of its candidates are of its commonest kind.

    A pattern's confidence is PATTERN_FROM, a half, where that of its kind is at least that of the others, the unknown
    ones and DOUBT; an unknown plain value counts UNKNOWN_BARE, which is 1 as DOUBT is.
    """
    first = F.element_at("patterns", 1)
    sides = found.where(first.startswith("L ")).select(F.substring(first, 3, 1 << 30).alias("context"), "value", "seed").distinct().groupBy("context", "seed").agg(F.count("*").alias("n"))
    known, n = F.col("seed").isNotNull(), F.col("n")
    of = lambda total, which: F.coalesce(total(F.when(which, n)), F.lit(0))
    return sides.groupBy("context").agg(of(F.sum, known).alias("seeds"), (2 * of(F.max, known) + of(F.sum, ~known) - of(F.sum, known) - 1).alias("most")).where(F.col("seeds") >= CONTEXT_SEEDS).select("context", "most")


def _filter(df: DataFrame, text: str, most: str | None = None) -> np.ndarray:
    """A filter of the words in a column; with a column of limits, of these too."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = _contexts(batch.column(0).to_pylist())
            digits = np.array([n.bit_length() for n in batch.column(1).to_pylist()], np.int64)
            for i in range(int(digits.max(initial=0)) + 1):
                yield pa.RecordBatch.from_arrays([pa.array(_level(each[digits >= i], i))], names=["key"])

    table = materialise(arrow_map(df.select(text, column(most).cast("bigint").alias("most") if most else F.lit(0).cast("bigint").alias("most")), keys, "key bigint").distinct(), "contexts")
    out = build_filter(table)
    release(table)
    return out


def _pairs(docs: DataFrame, contexts: DataFrame, given: re.Pattern | None, values: DataFrame | None = None) -> DataFrame:
    """(context, value) of the plain tokens in contexts; a context with more values in a task than its limit `most` has a null
    instead. With `values`, the pairs of these, without limits.

    Contexts and values go to the tasks as filters of bounded size, so there are pairs of some others too.
    """
    bounded = values is None
    words_of = docs.sparkSession.sparkContext.broadcast((_filter(contexts, "context", "most" if bounded else None), None if bounded else _filter(values, "value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, set[str]] = {}
        over: set[str] = set()
        n = 0

        def out() -> pa.RecordBatch:
            pairs = [(context, value) for context, some in held.items() for value in some]
            pairs += [(context, None) for context in over]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in range(2)], names=["context", "value"])

        for batch in batches:
            for lo, hi in slices(batch.column("text"), 4 << 20):
                for _, value, context, _, _, most in plain_tokens(batch.column("text").slice(lo, hi - lo), *words_of.value, given):
                    if context in over:
                        continue
                    some = held.setdefault(context, set())
                    if value not in some:
                        some.add(value)
                        n += 1
                        if bounded and len(some) > most:
                            n -= len(held.pop(context))
                            over.add(context)
                if n + len(over) > HELD_PAIRS:
                    yield out()
                    held, over, n = {}, set(), 0
        yield out()

    return arrow_map(docs, run, "context string, value string")


def _within(docs: DataFrame, contexts: DataFrame, given: re.Pattern | None) -> tuple[DataFrame, DataFrame]:
    """Those of the contexts that have at most `most` plain values, and all their (context, value) pairs.

    Most contexts have more in a small share of the rows, and aren't looked at in the rest.
    """
    left, pairs = contexts.where("most >= 0"), None
    for some in (docs.sample(FIRST_SHARE, seed=0), docs):
        if pairs is not None:
            release(pairs)
        pairs = materialise(_pairs(some, left, given).distinct(), "pairs")
        count = pairs.groupBy("context").agg(F.count("value").alias("n"), F.max(F.col("value").isNull()).alias("over"))
        left = materialise(left.join(count, "context", "left").where("n IS NULL OR NOT over AND n <= most").select("context", "most"), "contexts")
    return left, materialise(pairs.join(left, "context", "left_semi"), "pairs")


def _plain_rows(docs: DataFrame, contexts: DataFrame, values: DataFrame, given: re.Pattern | None) -> DataFrame:
    """(id, value, start, end) of where the values stand as plain tokens in the contexts; of some others too."""
    words_of = docs.sparkSession.sparkContext.broadcast((_filter(contexts, "context"), _filter(values, "value")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column("text"), 4 << 20):
                rows = [*plain_tokens(batch.column("text").slice(lo, hi - lo), *words_of.value, given)]
                yield _batch(batch.column("id").slice(lo, hi - lo), [r[0] for r in rows], [r[1] for r in rows], [None] * len(rows), [[r[2]] for r in rows], [r[3] for r in rows], [r[4] for r in rows])

    rows = arrow_map(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, {_KINDS_OF}")
    return rows.withColumn("context", F.element_at("patterns", 1)).join(contexts, "context", "left_semi").select("id", "value", "start", "end")


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, seeds: dict[str, str] | None = None) -> DataFrame:
    """(id, kind, value, start, end, score, seed): every identifier found; start and end count characters.

    Candidates are what has a form that alone tells its kind, wherever it stands in a text, the tokens with a digit or
    an @, and each other token in a context (the two words before) that CONTEXT_SEEDS seeds or more have: a name or
    a word can be an identifier by what stands before it. The first of these are seeds, and so are the values given as
    keys of seeds (value -> kind). Each candidate's occurrences give patterns: the two words before, if one is in the line; and, with a digit
    or @, its shape; the word before with the shape; the shape with the word after. In each round a pattern's
    confidence in a kind is the confidence of its distinct instances in that kind, against that in others, the unknown
    ones and DOUBT; an instance's is 1 - product(1 - confidence of its patterns from PATTERN_FROM on). Seeds keep 1.
    What ends at REPORT_FROM or more is reported, of its surest kind; at ties the first of KINDS.

    The graph's edges are distinct (pattern, value) pairs, so hot values and repeated rows weigh once. Null and empty
    texts have no candidates. Rows with a null id are reported with it. Repeated rows are each reported. Other columns
    don't matter. An empty table, or one without seeds, gives an empty result.

    Most contexts of seeds are common words with so many other values that they can't become a pattern: their values are
    counted in the tasks up to that number and not gathered. Such a context is looked at again in a round before which
    plain values gained confidence, up to the number that those which it has of them allow. So nothing is lost by it.
    """
    spark = docs.sparkSession
    some = pruned(docs, id=id_col, text=text_col).where("text IS NOT NULL")
    form = _form([*(seeds or {})])
    found = materialise(_candidates(some, form), "candidates")
    if seeds:
        given = spark.createDataFrame([*seeds.items()], "value string, given string")
        found = materialise(found.join(F.broadcast(given), "value", "left").withColumn("seed", F.coalesce("given", "seed")).select(*found.columns), "candidates")
    marked = materialise(found.select("value", F.explode("patterns").alias("pattern")).distinct(), "edges")
    # a value that is given can be a plain token too, and is sure from the start
    contexts = materialise(_seed_contexts(found).withColumn("most", F.col("most") + 2 * len(seeds or {})), "contexts")
    opened, pairs = _within(some, contexts, form)
    zeros = [F.lit(0.0).alias(k) for k in KINDS]

    def edges_of(opened: DataFrame, pairs: DataFrame) -> DataFrame:
        name = F.concat(F.lit("L "), "context").alias("pattern")
        shut = contexts.join(opened, "context", "left_anti").select(name)
        return materialise(marked.join(shut, "pattern", "left_anti").select("value", "pattern").unionByName(pairs.select("value", name)).distinct(), "edges")

    edges = edges_of(opened, pairs)
    start = found.select("value", "seed").unionByName(pairs.select("value", F.lit(None).cast("string").alias("seed"))).groupBy("value").agg(F.max("seed").alias("seed"))
    scores = materialise(start.select("value", "seed", *[F.when(F.col("seed") == k, 1.0).otherwise(0.0).alias(k) for k in KINDS]), "scores")
    plain = ~F.col("value").rlike("[0-9@]") & (F.lit(bool(seeds)) | F.col("seed").isNull())
    looked = 0
    every = reduce(lambda a, b: a + b, [F.col(f"s_{k}") for k in KINDS])
    for turn in range(rounds):
        sure = scores.where(plain & (F.greatest(*[F.col(k) for k in KINDS]) > 0)).select("value")
        if turn and (n := sure.count()) > looked:
            looked = n
            shut = contexts.join(opened, "context", "left_anti")
            has = _pairs(some, shut, form, sure).distinct().join(sure, "value", "left_semi").groupBy("context").agg(F.count("*").alias("n"))
            again = materialise(shut.join(has, "context").select("context", (F.col("most") + 2 * F.col("n")).alias("most")), "contexts")
            also, more = _within(some, again, form)
            if not also.isEmpty():
                opened, pairs = opened.unionByName(also), pairs.unionByName(more)
                edges = edges_of(opened, pairs)
                new = more.select("value").distinct().join(scores, "value", "left_anti").select("value", F.lit(None).cast("string").alias("seed"), *zeros)
                scores = materialise(scores.unionByName(new), "scores")
        sums = edges.join(scores, "value").groupBy("pattern").agg(F.sum(F.lit(1.0) - F.least(F.lit(1.0), reduce(lambda a, b: a + b, [F.col(k) for k in KINDS]))).alias("unknown"), *[F.sum(k).alias(f"s_{k}") for k in KINDS])
        weight = F.when(F.col("pattern").startswith("L "), UNKNOWN_BARE).otherwise(UNKNOWN_SHAPED)
        trust = {k: F.col(f"s_{k}") / (every + weight * F.col("unknown") + DOUBT) for k in KINDS}
        patterns = sums.select("pattern", *[F.when(t >= PATTERN_FROM, t).otherwise(0.0).alias(k) for k, t in trust.items()]).where(reduce(lambda a, b: a | b, [F.col(k) > 0 for k in KINDS]))
        gained = edges.join(patterns, "pattern").groupBy("value").agg(*[(1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col(k)))))).alias(f"g_{k}") for k in KINDS])
        before, scores = scores, materialise(
            scores.join(gained, "value", "left").select("value", "seed", *[F.when(F.col("seed").isNotNull(), F.col(k)).otherwise(F.round(F.coalesce(f"g_{k}", F.lit(0.0)), 9)).alias(k) for k in KINDS]), "scores"
        )
        release(before)
    score = F.greatest(*[F.col(k) for k in KINDS])
    surest = reduce(lambda rest, k: F.when(F.col(k) == score, k).otherwise(rest), KINDS[-2::-1], F.lit(KINDS[-1]))
    kept = materialise(scores.where(score >= REPORT_FROM).select("value", surest.alias("kind"), score.alias("score"), F.col("seed").isNotNull().alias("seed")), "kept")
    rows = found.select("id", "value", "start", "end")
    words_kept = kept.where(~F.col("value").rlike("[0-9@]") & (F.lit(bool(seeds)) | ~F.col("seed"))).select("value")
    if not words_kept.isEmpty():
        rows = rows.unionByName(_plain_rows(some, contexts, words_kept, form))
    return rows.join(kept, "value").select(F.col("id").alias(id_col), "kind", "value", "start", "end", "score", "seed")
