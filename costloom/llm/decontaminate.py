"""Benchmark passages in documents, by pigeonhole edit matching.

A test item of m characters is looked for with up to k = ``ERROR_RATE`` x m edits.
It is split into k + 1 pieces: k edits can't touch them all, so wherever the item
occurs at least one piece occurs exactly.  One automaton finds all pieces of all
items in one scan of a text; each hit says where the item would have to lie, and
Myers' bit-parallel distance decides there.  Hits that point to the same place are
decided once.

Items and texts are compared in lower case with single spaces.  Short items are
ordinary phrases with a letter changed, so they are looked for as they are, at word
ends: a budget of no edits and one piece.  The test items go
to the tasks in blocks of at most ``BLOCK_CHARS`` characters, each block with a scan
of its own, so the automaton is bounded whatever the benchmark's size.  No text is
shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import map_texts, spread, strings, table
from costloom.llm.registry import query

ERROR_RATE = 0.06
LEAST_CHARS = 40           # shorter items must be there without an edit, as whole words
BLOCK_CHARS = 4_000_000    # characters of test items in one automaton


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(rate * length)


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def distances(masks: dict[str, int], length: int, text: str, anchored: bool) -> Iterator[int]:
    """Edit distance of the pattern and the best piece of ``text`` ending at each character.

    ``anchored``: the piece begins where ``text`` does.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, carry = full, 0, length, int(anchored)
    for c in text:
        same = masks.get(c, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | carry) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        yield score


def occurrences(pattern: str, masks: dict[str, int], text: str, errors: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the places where ``pattern`` is in ``text`` within ``errors``.

    A run of ends within the budget is one place, that with the least distance (the first of equals).
    """
    ends, best = [], None
    for j, score in enumerate(distances(masks, len(pattern), text, anchored=False)):
        if score <= errors:
            if best is None or score < best[1]:
                best = (j + 1, score)
        elif best is not None:
            ends.append(best)
            best = None
    if best is not None:
        ends.append(best)
    back = masks_of(pattern[::-1]) if ends else {}
    out = []
    for end, score in ends:
        head = text[max(0, end - len(pattern) - errors):end][::-1]
        sizes = [j + 1 for j, d in enumerate(distances(back, len(pattern), head, anchored=True)) if d == score]
        out.append((end - (sizes[0] if sizes else len(head)), end, score))
    return out


def at_word_ends(text: str, start: int, end: int) -> bool:
    """No letter or digit goes on at either end of the span."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum() or end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


class Finder:
    """Finds a block of test items, given as (item_id, text), in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS):
        self.items, self.errors, self.whole, self.masks = [], [], [], {}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            text = normal(text or "")
            if not text:
                continue
            whole = len(text) < least_chars
            number, k = len(self.items), 0 if whole else budget(len(text), rate)
            self.items.append((item_id, text))
            self.errors.append(k)
            self.whole.append(whole)
            for i in range(k + 1):
                a, b = len(text) * i // (k + 1), len(text) * (i + 1) // (k + 1)
                pieces[text[a:b]].append((number, a))
        self.automaton = None
        if pieces:
            self.automaton = ahocorasick.Automaton()
            for piece, found in pieces.items():
                self.automaton.add_word(piece, (len(piece), found))
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) in the normal form of ``text``, which is passed in."""
        if self.automaton is None:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, found) in self.automaton.iter(text):
            for number, offset in found:
                starts[number].add(end + 1 - size - offset)
        out = []
        for number, places in starts.items():
            item_id, item = self.items[number]
            if self.whole[number]:
                out += [(item_id, a, a + len(item), 0) for a in places if at_word_ends(text, a, a + len(item))]
                continue
            k = self.errors[number]
            if number not in self.masks:
                self.masks[number] = masks_of(item)
            windows: list[list[int]] = []
            for start in sorted(places):
                low, high = max(0, start - k), start + len(item) + k
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = high
                else:
                    windows.append([low, high])
            for low, high in windows:
                out += [(item_id, low + a, low + b, d) for a, b, d in occurrences(item, self.masks[number], text[low:high], k)]
        return sorted(out, key=lambda x: (x[1], x[0] is None, x[0], x[2]))


def original_places(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the normal form as spans of ``text`` itself."""
    origin: list[int] = []
    for m in re.finditer(r"\S+", text):
        if origin:
            origin.append(origin[-1] + 1)
        for i in range(m.start(), m.end()):
            origin += [i] * len(text[i].lower())
    return [(origin[a], origin[b - 1] + 1) for a, b in spans]


def blocks_of(items: DataFrame, block_chars: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """The test items in blocks of about ``block_chars`` characters, dealt by hash."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    count = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(count)))
    return [[(r.item_id, r.text) for r in dealt.filter(F.col("block") == i).distinct().orderBy("item_id", "text").collect()] for i in range(count)]


def find_items(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per place of a test item in a document: ``doc_id``, ``item_id``, ``start``, ``end``, ``distance``.

    Places are code points of the text, end exclusive; the distance is in edits of
    the normal forms.  Null or empty texts and items match nothing; items under
    ``least_chars`` match whole words without an edit.  Repeated documents match each;
    an item that is there twice under one item_id counts once.  Only ``doc_id``,
    ``item_id`` and ``text`` are read.
    """
    plain = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))

    def scan(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(block, rate, least_chars)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                    found = finder.find(normal(text))
                    if found:
                        at = original_places(text, [x[1:3] for x in found])
                        rows += [(doc_id, x[0], a, b, x[3]) for x, (a, b) in zip(found, at)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                                                 names=["doc_id", "item_id", "start", "end", "distance"])

        return map_texts(plain, run, "doc_id long, item_id long, start int, end int, distance int")

    out = None
    for block in blocks_of(items, block_chars):
        out = scan(block) if out is None else out.unionByName(scan(block))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs``, all columns, in whose text no test item is found."""
    at = docs.columns.index("text")

    def scan(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(block, rate, least_chars)
            for batch in batches:
                yield batch.filter(pa.array([not finder.find(normal(t)) for t in strings(batch.column(at).cast(pa.string()))], pa.bool_()))

        return run

    docs = spread(docs)
    for block in blocks_of(items, block_chars):
        docs = map_texts(docs, scan(block), docs.schema)
    return docs


@query("op7_decontaminate")
def op7_decontaminate(spark, sf_dir):
    """Every place of a benchmark item in a document."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
