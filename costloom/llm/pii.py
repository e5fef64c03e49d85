"""Personal data: base patterns, and identifiers found by the company they keep.

Base spans (e-mail, IP, card, phone) come from fixed patterns.  They seed a
bootstrap.  The words around every seed form lexical patterns: the two words
before it, and the word on either side.  A pattern that enough different seeds
share is counted over every text: how often its slot occurs, and which
identifier-like tokens (with a digit or an @) fill it.  That gives a graph of
patterns and instances, scored in turns in Spark:

* a pattern's confidence is the confidence of all that fills its slot, over the
  number of times the slot occurs; a plain word counts against it;
* an instance's confidence is one for a seed, else one minus the product of its
  patterns' doubts.

Patterns that stay confident mark the tokens in their slots as personal data of
the kind of their seeds, unseen ones included.

Three scans of the texts, no shuffle of texts.  Patterns are a table; a scan takes
them in blocks of ``PATTERNS``, so what travels to the tasks is bounded, and every
pattern with ``LEAST_SEEDS`` seeds counts, however many others there are.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costloom.llm.common import map_texts, spread, staged, strings, table
from costloom.llm.registry import query

KINDS = ("email", "ip", "card", "phone")
LEAST_SEEDS = 5       # different seeds a pattern needs
PATTERNS = 500_000    # in one block, and one scan of the texts
ROUNDS = 4
CONFIDENT = 0.5       # confidence a pattern needs to mark what fills its slot
PRIOR = 2.0           # slots a pattern is assumed to have failed in beforehand
HELD = 100_000        # counts a task holds before it lets them go

# Possessive repeats and the look-behinds keep every scan linear; they change no match,
# because the part that follows can't begin inside what they took.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
MARK = "\x1c"  # white space, so no word of a text holds it
_EDGE = ".,;:!?()[]{}<>\"'|*"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _is_ip(found: str) -> bool:
    return all(len(x := part.lstrip("0")) < 4 and int(x or 0) <= 255 for part in found.split("."))


def _is_card(found: str) -> bool:
    digits = [int(c) for c in found if c not in " -"]
    if not 14 <= len(digits) <= 19:
        return False
    twice = [d * 2 - 9 if d > 4 else d * 2 for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(twice)) % 10 == 0


def _is_phone(found: str) -> bool:
    return 10 <= sum(c in "0123456789" for c in found) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern, test in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if test(m[0])]
    return sorted(out)


# Tokens in context

def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans without those that overlap an earlier one."""
    out: list[tuple[int, int, int]] = []
    for span in spans:
        if not out or span[0] >= out[-1][2]:
            out.append(span)
    return out


def tokens(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """Lower-case words of a text; every span is a word of its own, ``MARK`` and its kind."""
    out, done = [], 0
    for start, kind, end in spans:
        out += text[done:start].lower().split()
        out.append(MARK + KINDS[kind])
        done = end
    return out + text[done:].lower().split()


def places(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Start and end of every word of ``tokens``."""
    out, done = [], 0
    for start, _, end in [*spans, (len(text), 0, len(text))]:
        out += [(m.start() + done, m.end() + done) for m in re.finditer(r"\S+", text[done:start])]
        out.append((start, end))
        done = end
    return out


def slots(words: list[str], i: int) -> tuple[str, str]:
    """The two patterns of the slot at ``i``: both words before it, and one on either side."""
    before = words[i - 1] if i else "^"
    return f"1 {words[i - 2] if i > 1 else '^'} {before}", f"2 {before} {words[i + 1] if i + 1 < len(words) else '$'}"


def identifier(word: str) -> str | None:
    """The word without marks around it if it looks like an identifier."""
    word = word.strip(_EDGE)
    return word if len(word) > 3 and (_DIGIT.search(word) or "@" in word) else None


def _texts(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()))


def seed_patterns(docs: DataFrame, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """``pattern``, ``kind`` and ``seeds``: patterns that enough different seeds share.

    The kind is that of most seeds, of equals the one listed first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            a, b, c, n = zip(*((*k, n) for k, n in seen.items())) if seen else ((), (), (), ())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(n, pa.int64())],
                                              names=["pattern", "kind", "seed", "n"])

        for batch in batches:
            for text in strings(batch.column(0)):
                spans = _apart(base_spans(text))
                if not spans:
                    continue
                words = tokens(text, spans)
                marked = (i for i, w in enumerate(words) if w[0] == MARK)
                for i, (start, kind, end) in zip(marked, spans):
                    seed = int.from_bytes(hashlib.blake2b(text[start:end].lower().encode(), digest_size=8).digest(), "little", signed=True)
                    for pattern in slots(words, i):
                        seen[pattern, kind, seed] += 1
            if len(seen) > HELD:
                yield out()
        yield out()

    found = map_texts(_texts(docs), run, "pattern string, kind int, seed long, n long")
    by_seed = found.groupBy("pattern", "kind", "seed").agg(F.sum("n").alias("n"))
    by_kind = by_seed.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    each = by_kind.groupBy("pattern").agg(F.sum("seeds").alias("seeds"), F.max_by("kind", F.struct("seeds", -F.col("kind"))).alias("kind"))
    return each.filter(F.col("seeds") >= least_seeds)


def pattern_blocks(patterns: DataFrame, size: int = PATTERNS) -> Iterator[dict[str, int]]:
    """``pattern`` and ``kind`` in blocks of about ``size``, dealt by hash; none for no pattern."""
    count = -(-patterns.count() // size)
    for i in range(count):
        block = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(count)) == i)
        yield {r.pattern: r.kind for r in block.select("pattern", "kind").collect()}


def slot_fillers(docs: DataFrame, patterns: set[str]) -> DataFrame:
    """``pattern``, ``instance``, ``seed`` and ``n``: what fills the slots over all texts.

    ``instance`` is null for plain words, and ``seed`` says that it is a base span.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = {p[2:] for p in patterns if p[0] == "1"}
        around = {p[2:] for p in patterns if p[0] == "2"}
        seen: Counter = Counter()

        def out():
            a, b, c, n = zip(*((*k, n) for k, n in seen.items())) if seen else ((), (), (), ())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.bool_()), pa.array(n, pa.int64())],
                                              names=["pattern", "instance", "seed", "n"])

        for batch in batches if patterns else ():
            for text in strings(batch.column(0)):
                words = ["^", "^", *tokens(text, _apart(base_spans(text))), "$"]
                pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
                wide = [f"{a} {b}" for a, b in zip(words[1:], words[3:])]
                for i in [i for i, p in enumerate(pairs[:-2]) if p in before]:
                    seen[(f"1 {pairs[i]}", *_filler(words[i + 2]))] += 1
                for i in [i for i, p in enumerate(wide) if p in around]:
                    seen[(f"2 {wide[i]}", *_filler(words[i + 2]))] += 1
            if len(seen) > HELD:
                yield out()
        yield out()

    found = map_texts(_texts(docs), run, "pattern string, instance string, seed boolean, n long")
    return found.groupBy("pattern", "instance", "seed").agg(F.sum("n").alias("n"))


def _filler(word: str) -> tuple[str | None, bool]:
    if word[0] == MARK:
        return word, True
    return identifier(word), False


def score_patterns(fillers: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern`` and ``confidence`` after ``rounds`` turns over the graph of ``fillers``."""
    fillers = staged(fillers)
    total = fillers.groupBy("pattern").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("seed"), F.col("n")).otherwise(0)).alias("sure"))
    total = staged(total)
    edges = fillers.filter(F.col("instance").isNotNull() & ~F.col("seed")).select("pattern", "instance", "n")
    scored = total.select("pattern", (F.col("sure") / (F.col("total") + PRIOR)).alias("confidence"))
    for _ in range(rounds):
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        instances = edges.join(scored, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("belief"))
        weighed = edges.join(instances, "instance").groupBy("pattern").agg(F.sum(F.col("n") * F.col("belief")).alias("found"))
        scored = staged(total.join(weighed, "pattern", "left").select(
            "pattern", ((F.col("sure") + F.coalesce("found", F.lit(0.0))) / (F.col("total") + PRIOR)).alias("confidence")))
    return scored


def learned(docs: DataFrame, least_seeds: int = LEAST_SEEDS, confident: float = CONFIDENT, block: int = PATTERNS) -> DataFrame:
    """``pattern`` and ``kind`` (a number) of the confident patterns."""
    seeds = staged(seed_patterns(docs, least_seeds))
    # Each block's counts are a table before the next block is read.
    fillers = [staged(slot_fillers(docs, set(patterns))) for patterns in pattern_blocks(seeds, block)] or [slot_fillers(docs, set())]
    scored = score_patterns(reduce(DataFrame.unionByName, fillers))
    return staged(seeds.join(scored, "pattern").filter(F.col("confidence") >= confident).select("pattern", "kind"))


def learn(docs: DataFrame, least_seeds: int = LEAST_SEEDS, confident: float = CONFIDENT) -> dict[str, int]:
    """``learned`` as a list of its own, for corpora with few patterns."""
    return {r.pattern: r.kind for r in learned(docs, least_seeds, confident).collect()}


def added_spans(text: str, base: list[tuple[int, int, int]], patterns: dict[str, int]) -> list[tuple[int, int, int]]:
    """Spans of identifiers in the slots of ``patterns`` that no base span touches."""
    if not patterns or not (_DIGIT.search(text) or "@" in text):
        return []
    apart = _apart(base)
    words = tokens(text, apart)
    found = []
    for i, word in enumerate(words):
        if word[0] != MARK and identifier(word):
            kinds = [patterns[p] for p in slots(words, i) if p in patterns]
            if kinds:
                found.append((i, min(kinds)))
    at = places(text, apart) if found else []
    out = []
    for i, kind in found:
        start, end = at[i]
        while start < end and text[start] in _EDGE:
            start += 1
        while start < end and text[end - 1] in _EDGE:
            end -= 1
        out.append((start, kind, end))
    return out


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, patterns: DataFrame | dict[str, int], block: int = PATTERNS) -> DataFrame:
    """``doc_id``, ``base`` and ``added`` spans (kind, start, end) of every row.

    ``patterns``: ``learned`` or ``learn``; of a table, every block is one pass over a
    text within the same scan.  Offsets count code points, ends are exclusive.  A null
    text counts as empty; empty texts have no spans.  Repeated rows stay rows.  Only
    ``doc_id`` and ``text`` are read.
    """
    blocks = [patterns] if isinstance(patterns, dict) else list(pattern_blocks(patterns, block)) or [{}]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(own: dict[str, int], last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                base, added, texts = [], [], strings(batch.column(1))
                for text, before in zip(texts, batch.column(3).to_pylist()):
                    fixed = base_spans(text)
                    # A slot that several patterns mark has the kind listed first.
                    kinds = {(x["start"], x["end"]): KINDS.index(x["kind"]) for x in before or []}
                    for a, k, b in added_spans(text, fixed, own):
                        kinds[a, b] = min(k, kinds.get((a, b), k))
                    base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in fixed] if last else None)
                    added.append([{"kind": KINDS[k], "start": a, "end": b} for (a, b), k in sorted(kinds.items())])
                text = pa.nulls(len(batch), pa.string()) if last else batch.column(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(base, span), pa.array(added, span)], names=["doc_id", "text", "base", "added"])

        return run

    nothing = F.lit(None).cast(SPANS)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), nothing.alias("base"), nothing.alias("added")))
    for i, own in enumerate(blocks):
        rows = map_texts(rows, scan(own, i + 1 == len(blocks)), f"doc_id long, text string, base {SPANS}, added {SPANS}")
    return rows.drop("text")


@query("op2_personal_data")
def op2_personal_data(spark, sf_dir):
    """Personal data of every document: the fixed patterns and what the bootstrap adds."""
    docs = table(spark, sf_dir, "documents")
    found = find(docs, learned(docs))

    def joined(spans):
        order = F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
