"""Language identification with bit-sliced Bloom filters over character n-grams.

Training keeps, for every language, the n-grams that are typical of it; a filter slot holds one
bit per language, so that one lookup (the AND of the slots of an n-gram's hashes) returns the
bitmask of all languages that contain the n-gram. A text's n-grams are looked up at once; the
number of set bits per language, corrected for the filter's false positives, decides.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no training
rows every text is ``und``; whole texts of any length count; ties go to the language that sorts
first; equal texts get equal results; an empty table gives an empty result; further columns are
ignored. Only text and lang of the training rows are learned from.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.rows import map_rows, texts

#: Lengths of the n-grams, over words padded with a space.
GRAMS = (2, 3, 4)
#: Rows of each language that are learned from, at most (by hash order of doc_id).
SAMPLE_ROWS = 400
#: Languages in one word of a mask.
WORD = 64
#: An n-gram belongs to a language if it was seen so often there, at a rate of at least this part of its highest rate.
MIN_COUNT, MIN_RATE = 2, 0.3
HASHES = 3
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of all words of a text."""
    words = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    out = []
    for n in GRAMS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h ^= points[i : i + m] * _ODD[i]
            h *= _ODD[4]
            h ^= h >> np.uint64(29)
        if n > 2:  # an n-gram lies inside one word, with one space at an end at most
            space = points == 32
            inner = np.zeros(m, bool)
            for i in range(1, n - 1):
                inner |= space[i : i + m]
            h = h[~inner]
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def has(masks: np.ndarray, i: int) -> np.ndarray:
    """The bit of language i in every mask; masks of more than one word have an axis for them."""
    return (masks if masks.ndim == 1 else masks[:, i // WORD]) >> np.uint64(i % WORD) & np.uint64(1)


@dataclass
class Filter:
    """Slots of language bits, a word for each 64 languages; ``false_rate`` is, per language, how often an unseen n-gram passes."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The language bitmask of every n-gram."""
        bits = np.uint64(len(self.slots) - 1)
        out = self.slots[(hashes & bits).astype(np.int64)]
        for i in range(1, HASHES):
            out = out & self.slots[((hashes >> np.uint64(20 * i)) * _ODD[i] >> np.uint64(17) & bits).astype(np.int64)]
        return out

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not _LETTER.search(text):
            return "und", 0.0
        hashes = gram_hashes(text)
        masks = self.masks(hashes)
        if len(self.languages) <= 8:  # counts of every mask value, then of its bits
            seen = np.bincount(masks.astype(np.int64), minlength=1 << len(self.languages))
            values = np.arange(len(seen))
            hits = np.array([seen[values >> i & 1 == 1].sum() for i in range(len(self.languages))], float)
        else:
            hits = np.array([np.count_nonzero(has(masks, i)) for i in range(len(self.languages))], float)
        n = max(1, len(hashes))
        rates = ((hits / n - self.false_rate) / (1 - self.false_rate)).clip(0, 1)
        best = int(rates.argmax())
        return self.languages[best], float(round(rates[best], 6))


def build(samples: list[tuple[str, str]]) -> Filter:
    """A filter from (language, text) pairs."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return Filter([], np.zeros(1, np.uint64), np.zeros(0))
    counts = []
    for lang in languages:
        grams = [gram_hashes(t) for x, t in samples if x == lang]
        counts.append(np.unique(np.concatenate(grams), return_counts=True))
    grams = np.unique(np.concatenate([g for g, _ in counts]))
    highest, rates = np.zeros(len(grams)), []
    for g, c in counts:
        kept = c >= MIN_COUNT
        at, rate = np.searchsorted(grams, g[kept]), c[kept] / max(1, c.sum())
        highest[at] = np.maximum(highest[at], rate)
        rates.append((at, rate))
    size = 1 << max(10, math.ceil(math.log2(max(1, len(grams)) * 8)))
    words = -(-len(languages) // WORD)
    out = Filter(languages, np.zeros(size if words == 1 else (size, words), np.uint64), np.zeros(len(languages)))
    bits = np.uint64(size - 1)
    for i, (at, rate) in enumerate(rates):
        own = grams[at[rate >= MIN_RATE * highest[at]]]
        slots = out.slots if words == 1 else out.slots[:, i // WORD]
        for k in range(HASHES):
            at = (own & bits) if k == 0 else ((own >> np.uint64(20 * k)) * _ODD[k] >> np.uint64(17) & bits)
            slots[np.unique(at.astype(np.int64))] |= np.uint64(1) << np.uint64(i % WORD)
    fill = np.array([np.count_nonzero(has(out.slots, i)) / size for i in range(len(languages))])
    out.false_rate = np.minimum(fill**HASHES, 0.999)
    return out


def held_out() -> F.Column:
    """Whether a document is never learned from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filter:
    """Learn from at most ``sample_rows`` labelled rows of every language.

    The rows are those with the smallest hashes of their ids; a running choice per language
    (``min_by`` over hashed slots) sends one row per slot at most, however large a language is.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "doc_id")
    key = F.xxhash64("doc_id", F.lit(17))
    ids = rows.groupBy("lang", F.pmod(key, F.lit(sample_rows)).alias("slot")).agg(F.min_by("doc_id", key).alias("doc_id")).select("lang", "doc_id")
    # At most sample_rows ids of each label.
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").filter(F.col("text").isNotNull())
    return build(sorted((r.lang, r.text) for r in sample.select("lang", "text").toLocalIterator()))


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the corrected share of n-grams that the language contains)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        m = shared.value
        got = [m.predict(t) for t in batch["text"].to_pylist()]
        return [batch["doc_id"], batch["held_out"], [g[0] for g in got], [g[1] for g in got]]

    return map_rows(texts(docs, held_out().alias("held_out")), run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Filter, min_score: float = 0.25) -> DataFrame:
    """The documents of a learned language, their columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            keep = [lang != "und" and score >= min_score for lang, score in (m.predict(t or "") for t in batch.column("text").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
