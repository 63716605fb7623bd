"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point. An n-gram's vector is the product of its letters'
vectors, each rotated by its place; a text's vector is the sum over its n-grams, a language's that over its training texts.
A text takes the language whose prototype has the largest cosine with it.

Texts are lower-cased; runs of anything but letters become one blank, which counts as a letter at word edges. Texts are
worked on whole, a block at a time: n-grams are counted, and the counts times the n-gram vectors give the text's vector.

``fit`` uses a sample of about ``per_language`` labelled rows of each language, by a hash of doc_id;
prototypes are the only thing sent to the driver and to the tasks (languages x ``DIM`` numbers, ``max_languages`` at most).

Nulls and edges: a null text or one without letters is ``und`` with score 0; rows without a language or text teach nothing; ties go to the
language first in order; without training rows every text is ``und``; repeated rows are judged one by one; other columns pass through
except ``lang_pred`` and ``score``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
GRAM = 3
SEED = 20250
PER_LANGUAGE = 4000
MAX_LANGUAGES = 1000
UNKNOWN = "und"
BLOCK = 1 << 19  # letters worked on at once
_BLANK = 32


def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Space:
    """Letter and n-gram vectors, made when first needed and kept for the worker's life."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED):
        self.dim, self.gram, self.seed = dim, gram, seed
        self.letter = _is_letter()
        self.letters: dict[int, np.ndarray] = {}
        self.keys = np.zeros(0, np.uint64)
        self.vectors = np.zeros((0, dim), np.float32)

    def letter_vector(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim).astype(np.int8) * 2 - 1
        return self.letters[code]

    def gram_vector(self, key: int) -> np.ndarray:
        out = np.ones(self.dim, np.int8)
        for place in range(self.gram):
            code = (key >> (21 * (self.gram - 1 - place))) & 0x1FFFFF
            out = out * np.roll(self.letter_vector(code), self.gram - 1 - place)
        return out

    def codes(self, text: str) -> np.ndarray:
        """Letters' code points with single blanks between and around words; empty if there is no letter."""
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[raw]
        if not letter.any():
            return np.zeros(0, np.uint32)
        raw = np.concatenate([[_BLANK], np.where(letter, raw, _BLANK), [_BLANK]]).astype(np.uint32)
        blank = raw == _BLANK
        return raw[~(blank & np.concatenate([[False], blank[:-1]]))]

    def grams(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes) - self.gram + 1
        key = np.zeros(max(n, 0), np.uint64)
        for place in range(self.gram):
            key = (key << np.uint64(21)) | codes[place : place + n].astype(np.uint64)
        return key

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for sorted distinct keys, adding those not seen before. Kept vectors stay below a bound."""
        new = np.setdiff1d(keys, self.keys, assume_unique=True)
        if len(new):
            if len(self.keys) + len(new) > 30_000:
                self.keys, self.vectors, new = np.zeros(0, np.uint64), np.zeros((0, self.dim), np.float32), keys
            made = np.stack([self.gram_vector(int(k)) for k in new]).astype(np.float32)
            keys_all = np.concatenate([self.keys, new])
            order = np.argsort(keys_all)
            self.keys, self.vectors = keys_all[order], np.concatenate([self.vectors, made])[order]
        return np.searchsorted(self.keys, keys)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """The vector of each text; zero where there are no letters."""
        out = np.zeros((len(texts), self.dim), np.float32)
        rows, parts, size = [], [], 0

        def add() -> None:
            nonlocal rows, parts, size
            if rows:
                keys, at = np.unique(np.concatenate(parts), return_inverse=True)
                which = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
                counts = np.bincount(which * len(keys) + at, minlength=len(rows) * len(keys)).reshape(len(rows), len(keys))
                total = np.zeros((len(rows), self.dim), np.float32)
                for lo in range(0, len(keys), 8192):
                    some = self.places(keys[lo : lo + 8192])
                    total += counts[:, lo : lo + 8192].astype(np.float32) @ self.vectors[some]
                np.add.at(out, rows, total)
            rows, parts, size = [], [], 0

        for k, text in enumerate(texts):
            codes = self.codes(text) if text else np.zeros(0, np.uint32)
            for lo in range(0, max(0, len(codes) - self.gram + 1), BLOCK):
                keys = self.grams(codes[lo : lo + BLOCK + self.gram - 1])
                rows.append(k)
                parts.append(keys)
                size += len(keys)
                if size >= BLOCK or len(rows) >= 256:
                    add()
        add()
        return out


_SPACES: dict[tuple, Space] = {}


def space(dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> Space:
    if (dim, gram, seed) not in _SPACES:
        _SPACES[dim, gram, seed] = Space(dim, gram, seed)
    return _SPACES[dim, gram, seed]


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(text, lang): about ``per_language`` rows of each language, all of a rarer one, by a hash of doc_id. Only counts per language meet."""
    part = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string")), 33) / float(1 << 31)
    keyed = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string"), part.alias("part")).filter("text is not null and lang is not null")
    sizes = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1)
    return keyed.join(F.broadcast(sizes), "lang").filter(F.col("part") * F.col("n") < per_language).select("text", "lang")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """(languages in order, one unit prototype each)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 512):
                found = space(dim, gram, seed).bundle(texts[lo : lo + 512])
                norm = np.linalg.norm(found, axis=1, keepdims=True)
                found = found / np.where(norm > 0, norm, 1)  # a long text teaches as much as a short one
                for lang in set(langs[lo : lo + 512]):
                    own = found[[x == lang for x in langs[lo : lo + 512]]].sum(0, dtype=np.float64)
                    total[lang] = total.get(lang, 0) + own
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()])], ["lang", "v"])

    per_task = sample(labelled, per_language).repartition(16).mapInArrow(sums, "lang string, v array<double>")
    spread = per_task.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = spread.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = sorted(rows, key=lambda r: r["lang"])
    matrix = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), dim)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return [r["lang"] for r in rows], matrix / np.where(norm > 0, norm, 1)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with the best prototype (0 where negative)."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(np.float32)))
    out = docs.drop("lang_pred", "score").withColumns({"text": F.col("text").cast("string"), "lang_pred": F.lit(None).cast("string"), "score": F.lit(None).cast("double")})
    schema = out.schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes = shared.value
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            pred, score = [], []
            for lo in range(0, batch.num_rows, 512):
                vectors = space(dim, gram, seed).bundle(texts.slice(lo, 512).to_pylist())
                norm = np.linalg.norm(vectors, axis=1)
                if len(langs):
                    cos = (vectors / np.where(norm > 0, norm, 1)[:, None]) @ prototypes.T
                    best = cos.argmax(1)
                    pred += [langs[b] if n > 0 else UNKNOWN for b, n in zip(best, norm)]
                    score += [float(min(1.0, max(0.0, c))) if n > 0 else 0.0 for c, n in zip(cos[np.arange(len(best)), best], norm)]
                else:
                    pred += [UNKNOWN] * len(norm)
                    score += [0.0] * len(norm)
            new = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], schema=batch.schema)

    return out.mapInArrow(judge, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
