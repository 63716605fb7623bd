"""Benchmark decontamination: a broadcast hash set of test n-grams against every window of training words.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. Items give windows of ``n``
words; an item with fewer words is one window, an item without words none. Every document's windows are hashed and
looked up; a hit counts only after its words equal those of the item window.

Items are broadcast in slices of at most ``slice_bytes`` of text. More slices mean more passes over the same rows in
the same task, never a larger broadcast and never a shuffle.

Nulls and edges: a null or empty text has no words and is never contaminated; items with a null text give no window, items
with a null id count as hits without an id; repeated rows are judged one by one; an empty benchmark finds nothing; other columns
of the documents pass through untouched, whatever their names, except the result columns, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bondwise.llm.text import LOW_BYTE, packed, rolling, spans_of_words, unpacked, word_hashes

N = 10
SLICE_BYTES = 8 << 20
SIFT_BITS = 20
SPAN = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def _words(raw: np.ndarray) -> list[bytes]:
    low = LOW_BYTE[raw].astype(np.uint8).tobytes()
    return [low[a:b] for a, b in zip(*spans_of_words(raw))]


class Windows:
    """The windows of one slice of items: by width, a sift of hash prefixes and the exact words by hash."""

    def __init__(self, items: list[tuple[int | None, str]], n: int):
        self.by_width: dict[int, dict[int, list[tuple[tuple[bytes, ...], set]]]] = {}
        self.sift: dict[int, np.ndarray] = {}
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = _words(raw)
            width = min(n, len(words))
            if not width:
                continue
            table = self.by_width.setdefault(width, {})
            for at, h in enumerate(rolling(word_hashes(raw), width).tolist()):
                key = tuple(words[at : at + width])
                same = table.setdefault(h, [])
                owners = next((ids for words_there, ids in same if words_there == key), None)
                if owners is None:
                    same.append((key, owners := set()))
                if item is not None:
                    owners.add(item)
        for width, table in self.by_width.items():
            mask = np.zeros(1 << SIFT_BITS, bool)
            mask[np.fromiter(table, np.uint64, len(table)) >> np.uint64(64 - SIFT_BITS)] = True
            self.sift[width] = mask

    def hits(self, raw: np.ndarray, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """(first, last) of each verified window, and the items they come from."""
        found, items, words = [], set(), None
        for width, table in self.by_width.items():
            rolled = rolling(hashes, width)
            for at in np.flatnonzero(self.sift[width][rolled >> np.uint64(64 - SIFT_BITS)]).tolist():
                same = table.get(int(rolled[at]))
                if same:
                    words = words if words is not None else _words(raw)
                    own = tuple(words[at : at + width])
                    for key, owners in same:
                        if key == own:
                            found.append((at, at + width - 1))
                            items |= owners
        return found, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the words of ``spans`` and what stands between them taken out."""
    data = text.encode()
    start, end = spans_of_words(np.frombuffer(data, np.uint8))
    keep, at = [], 0
    for first, last in spans:
        keep.append(data[at : start[first]])
        at = int(end[last])
    return b"".join([*keep, data[at:]]).decode()


def slices(bench: DataFrame, slice_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in slices of bounded size, streamed to the driver one partition at a time; each slice becomes one broadcast."""
    part, size = [], 0
    rows = bench.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    for item, text in rows.toLocalIterator():
        part.append((item, text))
        size += len(text)
        if size >= slice_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def scan(docs: DataFrame, bench: DataFrame, n: int = N, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs`` (its column ``text``) with ``n_words``, ``hit_spans`` (word ranges, merged) and ``hit_items`` (sorted ids)."""
    spark = docs.sparkSession
    out = docs.drop("n_words", "hit_spans", "hit_items").withColumns(
        {"text": F.col("text").cast("string"), "n_words": F.lit(None).cast("long"), "hit_spans": F.lit(None).cast(SPAN), "hit_items": F.lit(None).cast("array<long>")}
    )
    schema = out.schema
    passes = 0
    for part in slices(bench, slice_bytes):
        out, passes = out.mapInArrow(_pass(spark.sparkContext.broadcast(part), n), schema), passes + 1
    return out if passes else out.mapInArrow(_pass(spark.sparkContext.broadcast([]), n), schema)


def _pass(shared, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, n)
        for batch in batches:
            names = batch.schema.names
            counts, spans, items = [], [], []
            was_spans, was_items = batch.column(names.index("hit_spans")), batch.column(names.index("hit_items"))
            for k, value in enumerate(batch.column(names.index("text"))):
                data = value.as_buffer() if value.is_valid else None
                raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
                hashes = word_hashes(raw)
                found, owners = windows.hits(raw, hashes)
                before = [(x["first"], x["last"]) for x in was_spans[k].as_py() or []]
                counts.append(len(hashes))
                spans.append([{"first": a, "last": b} for a, b in merged(found + before)])
                items.append(sorted(owners | set(was_items[k].as_py() or [])))
            new = {"n_words": counts, "hit_spans": spans, "hit_items": items}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[c], batch.schema.field(c).type) if c in new else batch.column(i) for i, c in enumerate(names)], schema=batch.schema
            )

    return run


def report(scanned: DataFrame) -> DataFrame:
    """One row per scanned document: how much of it the benchmark covers, and a digest of the items found."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    ids = F.concat_ws(",", F.sort_array(F.transform("hit_items", lambda x: x.cast("string"))))
    return scanned.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"), "hit_spans",
    )


def clean_documents(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """The documents without any benchmark window. All their columns stay as they are, whatever their names."""
    found = scan(packed(docs, "text"), bench, n).filter(F.size("hit_spans") == 0)
    return found.select(*unpacked(found, docs, ("text",)))


def clean_spans(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """All documents, with the words of benchmark windows cut out of their text."""
    found = scan(packed(docs, "text"), bench, n)
    schema = found.schema

    def cut_out(batches):
        for batch in batches:
            names = batch.schema.names
            spans = batch.column(names.index("hit_spans"))
            at = names.index("text")
            texts = [
                t if not (s := [(x["first"], x["last"]) for x in spans[k].as_py()]) else without(t, s)
                for k, t in enumerate(batch.column(at).to_pylist())
            ]
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    done = found.mapInArrow(cut_out, schema)
    return done.select(*unpacked(done, docs, ("text",)))
