"""Operator 4, benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Edits allowed for each character of an item.
RATE = 0.1
#: Characters of items held by one automaton; larger sets are searched in blocks.
BLOCK_CHARS = 8_000_000
ADDED = ("contaminated", "n_items", "item_ids", "least_distance")


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space, trimmed."""
    return " ".join(text.lower().split()) if text else ""


class Pattern:
    """A text to be found with at most ``budget`` edits, by Myers' bit-parallel matcher."""

    def __init__(self, text: str, budget: int) -> None:
        self.text, self.size, self.budget = text, len(text), budget
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        """The least edit distance between the pattern and a substring of ``text``."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, best = full, 0, self.size, self.size
        for c in text:
            eq = self.masks.get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
            ph, mh = (ph << 1) & full, (mh << 1) & full
            plus, minus = mh | (full & ~(xv | ph)), ph & xv
        return best


class Item(Pattern):
    """A test item. It is split into budget + 1 pieces, of which any copy within the
    budget holds one unchanged. Pieces are joined two by two up to the whole item;
    what joins n of them is allowed n - 1 edits. The pigeonhole holds at every level:
    some piece of the copy is unchanged and all that is joined from it keeps its
    budget, so a chance hit is dropped at the first level that fails."""

    def __init__(self, ident: object, text: str, rate: float) -> None:
        super().__init__(text, int(rate * len(text)))
        self.ident = ident
        self.levels: list[list[tuple[int, Pattern]]] = [[] for _ in range(self.budget + 1)]
        self._join(0, self.budget + 1)

    def _place(self, piece: int) -> int:
        return piece * self.size // (self.budget + 1)

    def _join(self, low: int, high: int) -> None:
        if high - low < 2:
            return
        middle = (low + high) // 2
        self._join(low, middle)
        self._join(middle, high)
        if high - low <= self.budget:
            a, b = self._place(low), self._place(high)
            joined = (a, Pattern(self.text[a:b], high - low - 1))
            for piece in range(low, high):
                self.levels[piece].append(joined)

    def pieces(self) -> Iterator[tuple[int, str]]:
        for i in range(self.budget + 1):
            yield self._place(i), self.text[self._place(i) : self._place(i + 1)]

    def plausible(self, piece: int, text: str, start: int) -> bool:
        """Whether all that is joined from a piece may stand in ``text``, if the item
        would start at ``start``."""
        for a, p in self.levels[piece]:
            low = start + a - p.budget
            if p.distance(text[max(0, low) : start + a + p.size + p.budget]) > p.budget:
                return False
        return True


class Matcher:
    """Finds the items that a text contains within their budgets."""

    def __init__(self, items: list[tuple[object, str]], rate: float) -> None:
        import ahocorasick

        self.items = [Item(i, t, rate) for i, x in items if (t := normal(x))]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int, int]]] = {}
        for k, item in enumerate(self.items):
            for n, (at, piece) in enumerate(item.pieces()):
                places.setdefault(piece, []).append((k, n, at))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> dict[int, int]:
        """Item number -> least distance, for the items within budget."""
        text, starts = normal(text), {}
        if not self.items or not text:
            return {}
        for end, (size, found) in self.automaton.iter(text):
            for k, n, at in found:
                start = end - size + 1 - at
                if start not in starts.get(k, ()) and self.items[k].plausible(n, text, start):
                    starts.setdefault(k, set()).add(start)
        out = {}
        for k, where in starts.items():
            item = self.items[k]
            if any(a >= 0 and text.startswith(item.text, a) for a in where):
                out[k] = 0
                continue
            best, reach, begin = item.budget + 1, None, 0
            for a in [*sorted(where), None]:  # windows that touch are searched as one
                if reach is not None and (a is None or a - item.budget > reach):
                    best = min(best, item.distance(text[max(0, begin) : reach]))
                    reach = None
                if a is not None:
                    begin = a - item.budget if reach is None else begin
                    reach = a + item.size + item.budget
            if best <= item.budget:
                out[k] = best
        return out


_matchers: dict[str, Matcher] = {}  # of the worker's last block


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + chars // BLOCK_CHARS
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b)
        yield [tuple(r) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` with ``contaminated``, ``n_items``, ``item_ids`` (ascending, joined
    by commas) and ``least_distance`` (null if none) in place of such columns.

    A document is contaminated by an item if the edit distance between the item
    and some passage of the document's whole text is at most rate * length, both
    lower-cased with white space collapsed. Null or empty texts contain nothing;
    null or empty items are in nothing; items with equal texts all count; an item
    without an id shows as an empty one. Rows that repeat each get the same answer, and
    of several passages near one item the least distance counts. Empty tables give no
    match; other columns pass unchanged.

    Every item is split into budget + 1 pieces; an automaton finds exact piece
    hits, and Myers' bit-parallel distance verifies the passage around each, from the
    piece outwards. Only
    the items are broadcast, in blocks of at most BLOCK_CHARS characters (one pass
    over the documents for each block); no document is shuffled.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    out = docs.select(*kept).withColumn("contaminated", F.lit(False)).withColumn("n_items", F.lit(0).cast("long")).withColumn("item_ids", F.lit("")).withColumn("least_distance", F.lit(None).cast("long"))
    text_at = kept.index("text")
    for block in _blocks(benchmark.select("item_id", F.col("text").cast("string").alias("text"))):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, text_at=text_at, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            matcher = _matchers.get(key)
            if matcher is None:
                _matchers.clear()
                matcher = _matchers[key] = Matcher(shared.value, rate)
            for batch in batches:
                for part in slices(batch, text_at, 2_000_000):
                    had = part.select(list(ADDED)).to_pydict()
                    for i, text in enumerate(part.column(text_at).to_pylist()):
                        if found := matcher.matches(text):
                            names = [x for x in had["item_ids"][i].split(",") if x] + ["" if (x := matcher.items[k].ident) is None else str(x) for k in found]
                            had["item_ids"][i] = ",".join(sorted(names, key=lambda x: (len(x), x)))
                            had["n_items"][i] += len(found)
                            had["contaminated"][i] = True
                            least = min(found.values())
                            had["least_distance"][i] = least if had["least_distance"][i] is None else min(least, had["least_distance"][i])
                    columns = [part.column(c) for c in range(part.num_columns - 4)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(had[c], batch.schema.field(c).type) for c in ADDED)], schema=batch.schema)

        out = out.mapInArrow(run, out.schema)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
