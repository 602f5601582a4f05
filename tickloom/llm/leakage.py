"""Held-out evaluation texts inside a training corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import ship

WORDS = 13
BLOCK_ITEMS = 20_000
CHUNK_CHARS = 32_000_000

# Characters without width, among them the soft hyphen.
INVISIBLE = "­᠎​‌‍‎‏⁠⁡⁢⁣⁤︎️﻿"
_DROP = dict.fromkeys(map(ord, INVISIBLE))
_HYPHEN = "-‐‑"
_JOIN = re.compile(rf"(?<=\w)[{_HYPHEN}][^\S\n]*\r?\n\s*(?=\w)|(?<=\w)[{_HYPHEN}][^\S\r]*\r\s*(?=\w)")
_WORD = re.compile(r"[^\W_]+")
_ASCII = {i: (chr(i).lower() if chr(i).isalnum() else " ") for i in range(128)}
# the pieces of words with their places: invisible characters and combining marks may stand inside one
_PIECE = re.compile(rf"[^\W_](?:[{INVISIBLE}\u0300-\u036f]*[^\W_])*[\u0300-\u036f]*")
_BREAK = re.compile(rf"[{INVISIBLE}]*[{_HYPHEN}][{INVISIBLE}]*[^\S\r\n]*(?:\r?\n|\r)[\s{INVISIBLE}]*")


def words_of(text: str, join: bool = True) -> list[str]:
    """The words of a text in folded case. join: a hyphen at a line end is dropped with the break; else it parts words."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_DROP)).casefold()
    if join and "\n" in text or "\r" in text and join:
        text = _JOIN.sub("", text)
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text)


def pieces(text: str) -> list[tuple[str, int, int, bool]]:
    """The words of a text as it is written, (word, first character, end, broken): broken if a hyphen at a line end parts it from the next one."""
    out: list[tuple[str, int, int, bool]] = []
    spans = [m.span() for m in _PIECE.finditer(text)]
    for k, (a, z) in enumerate(spans):
        words = words_of(text[a:z], False)
        broken = k + 1 < len(spans) and _BREAK.fullmatch(text, z, spans[k + 1][0]) is not None
        out += [(w, a, z, broken and n == len(words) - 1) for n, w in enumerate(words)]
    return out


class Matcher:
    """One automaton over all runs of `words` words of the items, on word numbers. Building it takes memory in proportion to the items only."""

    def __init__(self, items: list[tuple[int, str]], words: int) -> None:
        self.words, self.numbers = words, {}
        self.runs: dict[tuple[int, ...], list[int]] = {}
        for item, text in items:
            for reading in {tuple(words_of(text, join)) for join in (True, False)}:
                numbers = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in reading]
                for i in range(len(numbers) - words + 1):
                    owners = self.runs.setdefault(tuple(numbers[i : i + words]), [])
                    if item not in owners[-1:]:
                        owners.append(item)
        self.pairs = {p for run in self.runs for p in zip(run, run[1:])}
        self.longest = max(map(len, self.numbers), default=0)
        self.automaton = None
        if self.runs:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for run, owners in self.runs.items():
                self.automaton.add_word(run, owners)
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Of each item in the text its longest passage: (words, first character, end)."""
        if self.automaton is None:
            return {}
        # a hyphen before a line end may split a word or belong to it; each one is read both ways
        if any(h in text for h in _HYPHEN) and ("\n" in text or "\r" in text):
            parts = pieces(text)
            if any(p[3] for p in parts):
                return self._both_ways(parts)
        found: dict[int, tuple[int, int]] = {}
        numbers = tuple([self.numbers.get(w, 0) for w in words_of(text)])
        if len(numbers) < self.words:
            return {}
        open_runs: dict[int, list[int]] = {}
        for end, owners in self.automaton.iter(numbers):
            for item in owners:
                run = open_runs.get(item)
                if run is not None and run[1] == end - 1:
                    run[1] = end
                else:
                    run = open_runs[item] = [end - self.words + 1, end]
                if item not in found or found[item][1] < run[1] - run[0] + 1:
                    found[item] = (run[0], run[1] - run[0] + 1)
        if not found:
            return {}
        parts = pieces(text)
        place = lambda k, side: parts[k][side] if k < len(parts) else len(text)
        return {item: (count, place(first, 1), place(first + count - 1, 2)) for item, (first, count) in found.items()}

    def _both_ways(self, parts: list[tuple[str, int, int, bool]]) -> dict[int, tuple[int, int, int]]:
        """find() over all readings at once: a walk over the places between words that keeps, per place, the different last words - only as far as they
        follow each other in some item, so that in ordinary text one reading is left, and never more than two per hyphen within a run."""
        best: dict[int, tuple[int, int, int]] = {}
        at: list[dict] = [{} for _ in range(len(parts) + 1)]
        keep = self.words - 1
        for i, (word, start, _, _) in enumerate(parts):
            paths, at[i] = at[i], {}
            joined, j = word, i
            while True:
                number = self.numbers.get(joined, 0)
                end, after = parts[j][2], at[j + 1]
                if number:
                    fresh = ((), (), {})
                    reached = [p for p in paths.values() if p[0] and (p[0][-1], number) in self.pairs] or [fresh]
                    for words, starts, open_ in reached:
                        still: dict[int, tuple[int, int]] = {}
                        if len(words) == keep:
                            for item in self.runs.get((*words, number), ()):
                                first, count = open_.get(item, (starts[0], keep))
                                still[item] = (first, count + 1)
                                if item not in best or best[item][0] < count + 1:
                                    best[item] = (count + 1, first, end)
                        words, starts = (*words, number)[-keep:], (*starts, start)[-keep:]
                        known = after.get(words)
                        if known is not None:
                            for item, (first, count) in known[2].items():
                                if item not in still or still[item][1] < count:
                                    still[item] = (first, count)
                        after[words] = (words, starts, still)
                if not parts[j][3] or j + 1 >= len(parts) or len(joined) >= self.longest:
                    break
                j += 1
                joined += parts[j][0]
        return best


@lru_cache(maxsize=2)
def _matcher(key: int, items: Broadcast, words: int) -> Matcher:
    return Matcher(items.value, words)


def leaks(docs: DataFrame, items: DataFrame, words: int = WORDS, block_items: int = BLOCK_ITEMS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, item_id, words, first_char, last_char) for each document that holds `words` or more consecutive words of an item.

    docs: doc_id, text; items: item_id, text. Words are runs of letters and digits; case, punctuation, spacing, line breaks,
    hyphens that split a word at a line end, soft hyphens and characters without width don't matter; each hyphen at a line end is read both as a
    split and as a compound's own. words is the length of the longest passage, the offsets (end exclusive) are places in the original
    text. Null texts and items shorter than that match nothing; repeated document rows give one row; empty tables give no rows.

    The items are the stated query set; they are broadcast in blocks of block_items (a hash of item_id decides), and no worker holds more than two
    blocks' automata. The corpus is scanned once, where it lies, whatever the number of blocks: texts pass each block in chunks of about chunk_chars. Nothing shuffles but the hits.
    """
    spark = docs.sparkSession
    ship(spark)
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    blocks = -(-known.count() // block_items)
    schema = "doc_id long, item_id long, words int, first_char long, last_char long"
    if not blocks:
        return spark.createDataFrame([], schema)
    part = lambda block: known.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
    shared = [spark.sparkContext.broadcast([(r[0], r[1]) for r in part(block)]) for block in range(blocks)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, str]]]:
        held, size = [], 0
        for batch in batches:
            for row in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                held.append(row)
                size += len(row[1])
                if size >= chunk_chars:
                    yield held
                    held, size = [], 0
        yield held

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches):
            for block in shared:
                matcher = _matcher(id(block.value), block, words)
                rows = [(doc, item, *hit) for doc, text in chunk for item, hit in matcher.find(text).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words", "first_char", "last_char"])

    best = F.max(F.struct("words", (-F.col("first_char")).alias("f"), "last_char")).alias("m")
    return texts.mapInPandas(scan, schema).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.words", (-F.col("m.f")).alias("first_char"), "m.last_char")
