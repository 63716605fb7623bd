"""Personal data and the terms that give it away: information-theoretic sanitisation.

E-mail addresses, IP addresses, card and phone numbers are found by fixed patterns and are the protected entities. The corpus tells how strongly
a term near an entity reveals it: with N documents, a term class c in df(c) of them, an entity e in df(e), and c near e in df(c, e),

    PMI(c, e) = log2(N df(c, e) / (df(c) df(e)))   and   IC(e) = log2(N / df(e)).

A class whose PMI is at least ``DISCLOSED`` of the entity's own information discloses it. A term that does is generalised to the longest of its
prefixes (``PREFIXES`` code points) that does not, or removed when all of them do, wherever it stands in a document that holds the entity near it.
Estimates rest on at least ``SUPPORT`` different texts in which entity and class meet, so copies of a text are no evidence, and documents without a
protected entity stay as they are.

Two passes read the texts: one finds entities and the classes of the ``WINDOW`` words on either side, one counts in how many documents each class
occurs, summed in each task before the shuffle. Only texts that hold entities are kept for the last step, once per different text; spans go back to
documents by a salted join. Classes, entities and texts are told apart by 64 and 128 bit hashes.

Nulls and edges: a null text is empty and has no spans; matches that fail their rule are dropped and not tried again; spans of different kinds may overlap,
terms never overlap base spans; repeated rows and rows with equal ids each get a result; an empty table gives no rows; further columns pass through
``sanitise`` and are ignored by ``report``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bondwise.llm.text import BLOCK, LOW_BYTE, WORD_ANY_CASE, WORD_BYTE, ensure, powers, spans_of_words
from bondwise.session import cut

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("generalised", "removed")
# fixed values: the patterns. Runs that no other start could match are taken whole, which keeps long runs linear.
LOCAL = "[A-Za-z0-9._%+-]+"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

WINDOW, SUPPORT, DISCLOSED, PREFIXES, SALTS = 10, 3, 0.75, (6, 4, 2), 16
_LOCAL_BEFORE, _AHEAD, _BEHIND = regex.compile(f"(?r){LOCAL}"), regex.compile(WORD_ANY_CASE), regex.compile(f"(?r){WORD_ANY_CASE}")
_ODD = 0x9E3779B97F4A7C15


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ looks back for its local part, not beyond the match before, and ahead for its domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        local = _LOCAL_BEFORE.match(text, done, at)
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            done = domain.end()
            yield local.start(), done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, entity) of all base matches, by kind and start."""
    out = [(0, s, e, text[s:e].lower()) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end(), m.group()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end(), d))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(d := _digits(m.group())) <= 15:
                out.append((3, m.start(), m.end(), d))
    return out


def joined(spans) -> str:
    """kind:start:end of spans (kind name, start, end), comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def class_hashes(raw: np.ndarray, prefixes: tuple[int, ...] = PREFIXES) -> np.ndarray:
    """Hashes of all words of UTF-8 bytes, one row per word: the word itself, then its prefixes from long to short.

    A word no longer than a prefix is its own class there. Works block by block, cut between words.
    """
    out, at = [], 0
    while at < len(raw):
        stop = min(at + BLOCK, len(raw))
        while stop < len(raw):
            gap = np.flatnonzero(~WORD_BYTE[raw[at:stop]])
            if len(gap):
                stop = at + int(gap[-1]) + 1
                break
            stop = min(stop + BLOCK, len(raw))
        part = raw[at:stop]
        start, end = spans_of_words(part)
        if len(start):
            up, down = powers(_ODD, len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((LOW_BYTE[part] + np.uint64(1)) * up[: len(part)], out=total[1:])
            # where code points begin, and which of them each word begins with
            points = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
            first = np.searchsorted(points, start)
            rows = np.empty((len(start), 1 + len(prefixes)), np.uint64)
            for level, size in enumerate((None, *prefixes)):
                tail = end if size is None else np.minimum(end, points[np.minimum(first + size, len(points) - 1)])
                # whole words and prefixes of one spelling are different classes
                rows[:, level] = (total[tail] - total[start]) * down[start] + np.uint64(0 if size is None else size * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
            rows ^= rows >> np.uint64(29)
            rows *= np.uint64(0xBF58476D1CE4E5B9)
            rows ^= rows >> np.uint64(32)
            out.append(rows)
        at = stop
    return np.concatenate(out) if out else np.zeros((0, 1 + len(prefixes)), np.uint64)


def _clear(spans: list[tuple[int, int]]):
    """A test whether a stretch of text keeps clear of all spans."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    starts, ends = np.array([m[0] for m in merged]), np.array([m[1] for m in merged])

    def test(s: int, e: int) -> bool:
        k = int(np.searchsorted(ends, s, "right"))
        return k == len(starts) or starts[k] >= e

    return test


def contexts(text: str, spans: list[tuple[int, int, int, str]], window: int = WINDOW) -> dict[tuple[int, str], np.ndarray]:
    """Classes near each entity of a text, each once; words that touch a base span take no part."""
    clear, found = _clear([s[1:3] for s in spans]), {}
    for kind, start, end, entity in spans:
        words = [m.group() for m in islice(_AHEAD.finditer(text, end), window) if clear(*m.span())]
        words += [m.group() for m in islice(_BEHIND.finditer(text, 0, start), window) if clear(*m.span())]
        found.setdefault((kind, entity), []).extend(words)
    return {e: np.unique(class_hashes(np.frombuffer(" ".join(words).encode(), np.uint8))) for e, words in found.items()}


def _text_key(text: str) -> bytes:
    return xxhash.xxh128(text.encode("utf-8", "surrogatepass")).digest()


SCANNED = "n_email long, n_ip long, n_card long, n_phone long, base string, key binary, held string, near array<struct<e:long,c:array<long>>>"


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without ``text``, with base counts and spans; texts that hold an entity stay as ``held``, with the classes near each."""
    kept = [c for c in docs.columns if c != "text"]
    docs = ensure(docs, text="string")
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept] + T.StructType.fromDDL(SCANNED).fields)

    def each(batches):
        for batch in batches:
            rows = {name: [] for name in ("n_email", "n_ip", "n_card", "n_phone", "base", "key", "held", "near")}
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                for k, kind in enumerate(KINDS):
                    rows[f"n_{kind}"].append(sum(s[0] == k for s in spans))
                rows["base"].append(joined((KINDS[k], s, e) for k, s, e, _ in spans))
                rows["key"].append(_text_key(text) if spans else None)
                rows["held"].append(text if spans else None)
                near = contexts(text, spans, window) if spans else {}
                rows["near"].append([{"e": xxhash.xxh64_intdigest(f"{kind} {e}") - (1 << 63), "c": c.view(np.int64).tolist()} for (kind, e), c in near.items()] if near else None)
            columns = [batch.column(name) for name in kept]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.string(), pa.list_(pa.struct([("e", pa.int64()), ("c", pa.list_(pa.int64()))]))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=kept + list(rows))

    return docs.select(*[F.col(f"`{c}`") for c in [*kept, "text"]]).mapInArrow(each, schema)


def class_counts(docs: DataFrame) -> DataFrame:
    """(c, df): in how many documents each class occurs. Tasks add up a bounded number of documents before they send anything."""

    def each(batches):
        held, size = [], 0
        schema = pa.schema([("c", pa.int64()), ("df", pa.int64())])

        def sums():
            c, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

        for batch in batches:
            for value in batch.column("text"):
                if value.is_valid:
                    own = np.unique(class_hashes(np.frombuffer(value.as_buffer() or b"", np.uint8)))
                    held.append(own)
                    size += len(own)
                    if size > 4_000_000:
                        yield sums()
                        held, size = [], 0
        if size:
            yield sums()

    return ensure(docs.select("text"), text="string").mapInArrow(each, "c long, df long").groupBy("c").agg(F.sum("df").alias("df"))


def disclosing(scanned: DataFrame, counts: DataFrame, n_docs: int, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """(e, c): classes that disclose an entity near which they stand."""
    pairs = scanned.filter("near is not null").select("key", F.explode("near").alias("near")).select("key", "near.*")
    per_text = pairs.select("key", "e", F.explode(F.concat("c", F.array(F.lit(None).cast("long")))).alias("c")).groupBy("e", "c", "key").agg(F.count(F.lit(1)).alias("docs"))
    met = per_text.groupBy("e", "c").agg(F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    met = cut(met, "met")
    # the row without a class counts the entity's own documents
    salt = F.array(*[F.lit(k) for k in range(SALTS)])
    own = met.filter("c is null").select("e", F.col("docs").alias("df_e"), F.explode(salt).alias("salt"))
    near = met.filter("c is not null").withColumn("salt", F.pmod("c", F.lit(SALTS)).cast("int")).join(own, ["e", "salt"]).drop("salt")
    # a class near very many entities is a hot key; its count is copied to all salts
    spread = counts.join(near.select("c").distinct(), "c", "left_semi").withColumn("salt", F.explode(salt))
    both = near.withColumn("salt", F.pmod("e", F.lit(SALTS)).cast("int")).join(spread, ["c", "salt"])
    pmi = F.log2(F.lit(float(n_docs)) * F.col("docs") / (F.col("df").cast("double") * F.col("df_e")))
    own_bits = F.log2(F.lit(float(n_docs)) / F.col("df_e"))
    return both.filter((own_bits > 0) & (pmi >= F.lit(disclosed) * own_bits - 1e-9)).select("e", "c")


def term_spans(text: str, flagged: set[int], prefixes: tuple[int, ...] = PREFIXES) -> list[tuple[int, int, int]]:
    """(start, end, kept code points) of the terms to change: 0 kept where every prefix discloses too."""
    hashes = class_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), prefixes).view(np.int64)
    bad = np.isin(hashes, np.fromiter(flagged, np.int64, len(flagged)))
    if not bad[:, 0].any():
        return []
    clear, out = _clear([s[1:3] for s in base_spans(text)]), []
    for row, m in zip(bad, _AHEAD.finditer(text)):
        if row[0] and clear(*m.span()):
            size = m.end() - m.start()
            kept = next((p for p, b in zip(prefixes, row[1:]) if not b and p < size), 0)
            out.append((m.start(), m.end(), kept))
    return out


def found(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, disclosed: float = DISCLOSED) -> DataFrame:
    """``docs`` without ``text``, with base counts, ``base`` and ``terms``, an array of (start, end, kept) of disclosing terms."""
    scanned = cut(scan(docs, window), "scanned")
    flags = disclosing(scanned, class_counts(docs), scanned.count(), support, disclosed)
    private = scanned.filter("near is not null").select("key", "held", "near").groupBy("key").agg(F.first("held").alias("held"), F.first("near").alias("near"))
    private = cut(private, "private")
    near = private.select("key", F.explode("near").alias("near")).select("key", "near.e", F.explode("near.c").alias("c"))
    own = near.join(flags, ["e", "c"]).groupBy("key").agg(F.collect_set("c").alias("c"))

    def each(batches):
        for batch in batches:
            terms = [term_spans(t, set(c)) for t, c in zip(batch.column("held").to_pylist(), batch.column("c").to_pylist())]
            rows = [[{"start": s, "end": e, "kept": k} for s, e, k in t] for t in terms]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kept", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, kind)], names=["key", "terms"])

    terms = private.select("key", "held").join(own, "key").mapInArrow(each, "key binary, terms array<struct<start:long,end:long,kept:int>>").filter(F.size("terms") > 0)
    spread = terms.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    # copies of one text may be very many, so they meet its terms in several tasks; rows without entities join nothing
    dealt = scanned.drop("near").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    met = dealt.filter("key is not null").join(spread, ["key", "salt"], "left")
    return met.unionByName(dealt.filter("key is null"), allowMissingColumns=True).drop("key", "salt")


def report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms) of every document."""
    rows = found(docs.select("doc_id", "text"), **settings)
    none = F.array().cast("array<struct<start:long,end:long,kept:int>>")
    terms = F.coalesce("terms", none)
    text_of = lambda kind, test: F.transform(F.filter(terms, test), lambda t: F.concat_ws(":", F.lit(kind), t["start"].cast("string"), t["end"].cast("string")))
    extra = F.concat(text_of(TERM_KINDS[0], lambda t: t["kept"] > 0), text_of(TERM_KINDS[1], lambda t: t["kept"] == 0))
    base = F.filter(F.array("base"), lambda b: b != "")
    counts = [f"n_{k}" for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", base, extra).alias("spans"), F.size(terms).cast("long").alias("n_terms"))


def masked(text: str, base: str, terms: list[tuple[int, int, int]]) -> str:
    """The text with base matches replaced by their kind and disclosing terms by a prefix and a star, or nothing."""
    changes = [(int(s), int(e), f"[{kind}]") for kind, s, e in (b.split(":") for b in base.split(",") if b)]
    changes += [(s, e, text[s : s + kept] + "*" if kept else "") for s, e, kept in terms]
    out, at = [], 0
    for s, e, new in sorted(changes):
        if s >= at:
            out += [text[at:s], new]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every text masked; texts without entities are untouched. Rows and all other columns stay."""
    everything = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").alias("text")).alias("row")
    rows = found(docs.select(everything, F.col("text").cast("string").alias("text")), **settings)

    def each(batches):
        for batch in batches:
            held, base, terms = (batch.column(c).to_pylist() for c in ("held", "base", "terms"))
            new = [None if h is None else masked(h, b, [(t["start"], t["end"], t["kept"]) for t in ts or []]) for h, b, ts in zip(held, base, terms)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(new, pa.string())], names=["row", "new"])

    schema = T.StructType([rows.schema["row"], T.StructField("new", T.StringType())])
    done = rows.select("row", "held", "base", "terms").mapInArrow(each, schema)
    return done.select(*[F.coalesce(F.col("new"), F.col("row.text").cast("string")).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
