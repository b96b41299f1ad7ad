"""Language identification with bit-sliced n-gram Bloom filters.

Every language has a Bloom filter over the byte 4-grams typical of it.  The
filters are sliced: one array holds, at each hash position, a bitmask of the
languages whose filter has that bit.  Two lookups and one AND thus give all
languages that contain an n-gram.  Per document the hits of each language are
counted, corrected for the filter's false positives, and the largest share of
n-grams decides.

An n-gram is typical of a language if its share among that language's n-grams
is at least ``TYPICAL`` times its largest share in any language, and if it was
seen ``MIN_COUNT`` times.

``fit`` reads a bounded sample of labelled rows: about ``TRAIN_DOCS`` whole
texts a language, drawn by a hash of the id.  ``fit_all`` counts every labelled
row, and ``least_scores`` judges every one.  Prediction reads the text only.

Defined results: a null text and a text without any letter give ``und`` with
score 0; a text with letters but no n-gram known anywhere gets the most
frequent training language with score 0; ties go to the language that comes
first by name; without any training row everything is ``und``; rows with a
null language are never trained on; repeated rows, null ids and other columns
pass through in ``record``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, materialize, passing, raw_texts

UNKNOWN = "und"
TRAIN_DOCS = 3000
TYPICAL = 0.5
MIN_COUNT = 3
#: A text is none of its language below this share of the score that all but this part of its labelled texts reach.
LEAST_SHARE, LEAST_QUANTILE = 0.9, 0.001
#: Steps of a score from 0 to 1 in which ``least_scores`` counts.
SCORE_STEPS = 1 << 16
#: Distinct n-grams that a task of ``fit_all`` holds; it emits their counts beyond.
HELD_GRAMS = 2_000_000
#: How far a share may fall short by chance, times the root of the number of n-grams.
SLACK = 2.0
#: log2 of the filters' length in bits.
FILTER_BITS = 21
#: Odd multipliers of the filters' hash functions.
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
GROUP_BYTES = 4 << 20
_LETTER = regex.compile(r"\p{L}")
_LETTERS_ONLY = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _prepare(text: bytes | None) -> bytes:
    return text.decode(errors="replace").lower().encode().translate(_LETTERS_ONLY) if text else b""


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of all texts in a row as numbers, and where each text's begin.

    A gram may begin or end with a blank; blanks inside it, and with them
    grams that run from one word or text into the next, are left out.
    """
    data = np.frombuffer(b" " + b"   ".join(texts) + b"   ", np.uint8)
    sizes = np.array([len(t) + 3 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    wide = data.astype(np.uint64)
    whole = (data[1:-2] != 32) & (data[2:-1] != 32)
    keys = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24)
    before = np.concatenate([[0], np.cumsum(whole)])
    return keys[whole], before[np.minimum(starts, len(whole))]


@dataclass
class Slices:
    """Filters of up to 64 languages."""

    languages: list[str]
    bits: np.ndarray
    false_positive: np.ndarray

    def count(self, keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Corrected share of each text's n-grams in each language."""
        found = None
        for h in HASHES:
            hit = self.bits[_position(keys, h)]
            found = hit if found is None else found & hit
        out = np.zeros((len(cuts) - 1, len(self.languages)))
        n = np.maximum(np.diff(cuts), 1)
        for k in range(len(self.languages)):
            run = np.concatenate([[0], np.cumsum((found >> self.bits.dtype.type(k)) & self.bits.dtype.type(1), dtype=np.int64)])
            share = (run[cuts[1:]] - run[cuts[:-1]]) / n
            out[:, k] = (share - self.false_positive[k]) / (1 - self.false_positive[k])
        return np.clip(out, 0, 1)


def _position(keys: np.ndarray, multiplier: int) -> np.ndarray:
    return ((keys * np.uint64(multiplier)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


@dataclass
class Model:
    slices: list[Slices]
    fallback: str

    @property
    def languages(self) -> list[str]:
        return [x for s in self.slices for x in s.languages]

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        return [(lang, score) for lang, score, _ in self.judge(texts)]

    def judge(self, texts: list[bytes | None]) -> list[tuple[str, float, int]]:
        """Language, score and number of n-grams of each text."""
        letters = [bool(t) and _LETTER.search(t.decode(errors="replace")) is not None for t in texts]
        if not self.slices:
            return [(UNKNOWN, 0.0, 0)] * len(texts)
        keys, cuts = _grams([_prepare(t) for t in texts])
        shares = np.concatenate([s.count(keys, cuts) for s in self.slices], axis=1)
        best, names, sizes = shares.argmax(axis=1), self.languages, np.diff(cuts).tolist()
        out = []
        for k, is_text in enumerate(letters):
            score = float(shares[k, best[k]])
            out.append((names[best[k]] if score > 0 else self.fallback, score, sizes[k]) if is_text else (UNKNOWN, 0.0, 0))
        return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a language.  The driver gets the n-gram counts of the sample only."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return Model([], UNKNOWN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[bytes]] = defaultdict(list)
        for batch in batches:
            for text, lang in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
                seen[lang].append(_prepare(text))
        for lang, texts in seen.items():
            keys, n = np.unique(_grams(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([keys.tobytes()]), pa.array([n.astype(np.int64).tobytes()])], names=["lang", "keys", "n"])

    sample = rows.where(_drawn(totals, train_docs)).select("text", "lang").repartition(max(4, len(totals)))
    parts: dict[str, list] = defaultdict(list)
    for r in map_batches(sample, count, "lang string, keys binary, n binary").collect():
        parts[r["lang"]].append((np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["n"], np.int64)))
    return _model(parts, totals)


def _drawn(totals: dict[str, int], train_docs: int) -> Column:
    """About ``train_docs`` rows of each language, by a hash of the id."""
    chosen: Column = F.lit(False)
    draw = F.pmod(F.xxhash64(F.lit(77), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    for lang, n in totals.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < train_docs / n))
    return chosen


def fit_all(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row with a language: the model that ``fit`` would give if its sample were all of them.

    Counts meet in Spark; the driver gets the filters' set bits, at most one number a bit and language.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return Model([], UNKNOWN)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def counts() -> Iterator[pa.RecordBatch]:
            for lang, (keys, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "key", "n"])

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, texts in grouped(raw_texts(batch.column(0)), GROUP_BYTES):
                of: dict[str, list[bytes]] = defaultdict(list)
                for text, lang in zip(texts, langs[lo : lo + len(texts)]):
                    of[lang].append(_prepare(text))
                for lang, own in of.items():
                    keys, n = np.unique(_grams(own)[0], return_counts=True)
                    if lang in held:
                        both = np.concatenate([held[lang][0], keys])
                        keys, at = np.unique(both, return_inverse=True)
                        n = np.bincount(at, np.concatenate([held[lang][1], n]), len(keys)).astype(np.int64)
                    held[lang] = keys, n
            if sum(len(keys) for keys, _ in held.values()) > HELD_GRAMS:
                yield from counts()
                held.clear()
        yield from counts()

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_numpy().astype(np.uint64)
            at = np.concatenate([_position(keys, h) for h in HASHES])
            langs = pa.concat_arrays([batch.column(0)] * len(HASHES))
            yield pa.RecordBatch.from_arrays([langs, pa.array(at)], names=["lang", "bit"])

    with passing(docs.sparkSession):
        grams = materialize(map_batches(rows, count, "lang string, key long, n long").groupBy("key", "lang").agg(F.sum("n").alias("n")), "grams")
        sizes = grams.groupBy("lang").agg(F.sum("n").alias("size"))
        shares = grams.join(F.broadcast(sizes), "lang").select("key", "lang", "n", (F.col("n") / F.col("size")).alias("share"))
        # as many entries as languages
        per = shares.groupBy("key").agg(F.collect_list(F.struct("lang", "n", "share")).alias("of"), F.max("share").alias("most"))
        member = per.select("key", "most", F.inline("of")).where(f"share >= {TYPICAL}D * most and n >= {MIN_COUNT}").select("lang", "key")
        found = map_batches(member, set_bits, "lang string, bit long").distinct().groupBy("lang").agg(F.collect_list(F.col("bit").cast("int")).alias("bits")).toArrow()
    # a language whose texts have no n-gram has a filter without bits
    bits = {lang: np.zeros(0, np.int64) for lang in sorted(totals)}
    for lang, own in zip(found.column(0).to_pylist(), found.column(1)):
        bits[lang] = own.values.to_numpy().astype(np.int64)
    return Model(_slices(bits), max(sorted(totals), key=totals.get))


def least_scores(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """For each language the score under which a text is no text of it: ``LEAST_SHARE`` of the ``LEAST_QUANTILE`` of all labelled rows that the model gets right.

    Exact counts by steps of the score, so the quantile is rounded down to a step.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    judged = identify(rows, model, carry=["lang"]).where("record.lang = lang_pred")
    steps = judged.groupBy("lang_pred", F.floor(F.col("score") * SCORE_STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    # at most SCORE_STEPS + 1 rows a language
    own = Window.partitionBy("lang_pred")
    below = F.sum("n").over(own.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    ranked = steps.select("lang_pred", "step", below.alias("below"), F.sum("n").over(own).alias("of"))
    lows = ranked.where(F.col("below") >= F.col("of") * LEAST_QUANTILE).groupBy("lang_pred").agg(F.min("step").alias("step"))
    return {r["lang_pred"]: LEAST_SHARE * r["step"] / SCORE_STEPS for r in lows.collect()}


def fits(least: dict[str, float]) -> Column:
    """Whether a judged text (lang_pred, score, n_grams) is one of its language, given ``least_scores``.

    The fewer n-grams, the more a share may fall short by chance, so ``SLACK``
    over the root of their number is allowed: one rule for texts of any length.
    """
    limit = F.lit(0.0)
    for lang, low in least.items():
        limit = F.when(F.col("lang_pred") == lang, F.lit(low)).otherwise(limit)
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") + SLACK / F.sqrt(F.greatest("n_grams", F.lit(1))) >= limit)


def _model(parts: dict, totals: dict[str, int]) -> Model:
    languages = sorted(parts)
    every = np.unique(np.concatenate([k for x in parts.values() for k, _ in x])) if parts else np.zeros(0, np.uint64)
    counts = np.zeros((len(languages), len(every)))
    for row, lang in enumerate(languages):
        for keys, n in parts[lang]:
            np.add.at(counts[row], np.searchsorted(every, keys), n)
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    member = (shares >= TYPICAL * shares.max(axis=0, initial=0)) & (counts >= MIN_COUNT)
    bits = {lang: np.concatenate([_position(every[member[row]], h) for h in HASHES]) for row, lang in enumerate(languages)}
    return Model(_slices(bits), max(sorted(totals), key=totals.get))


def _slices(found: dict[str, np.ndarray]) -> list[Slices]:
    """Filters from the set bits of each language, languages in order."""
    languages, slices = list(found), []
    for at in range(0, len(languages), 64):
        names = languages[at : at + 64]
        bits = np.zeros(1 << FILTER_BITS, np.uint8 if len(names) <= 8 else np.uint64)
        for k, name in enumerate(names):
            bits[found[name]] |= bits.dtype.type(1 << k)
        fill = np.array([np.count_nonzero(bits >> bits.dtype.type(k) & bits.dtype.type(1)) / len(bits) for k in range(len(names))])
        slices.append(Slices(names, bits, fill ** len(HASHES)))
    return slices


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``record`` (the columns in ``carry``, by default all), ``lang_pred``, ``score`` and ``n_grams``.  The model has a fixed size."""
    carry = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("record"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in grouped(raw_texts(batch.column(1)), GROUP_BYTES):
                got = shared.value.judge(texts)
                columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *columns], names=["record", "lang_pred", "score", "n_grams"])

    judged = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_grams", T.LongType())]
    schema = T.StructType([source.schema["record"], *judged])
    return map_batches(source, run, schema)


def grouped(texts: list, size: int) -> Iterator[tuple[int, list]]:
    """Consecutive runs of about ``size`` bytes with where they begin; never parts of a text."""
    lo = 0
    while lo < len(texts):
        hi, got = lo, 0
        while hi < len(texts) and got < size:
            got += len(texts[hi] or b"")
            hi += 1
        yield lo, texts[lo:hi]
        lo = hi
