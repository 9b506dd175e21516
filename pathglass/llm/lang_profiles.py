"""Language identification by rank-order n-gram profiles (operator 7).

A profile is the list of a language's most frequent letter n-grams (1 to 3, with
word ends), most frequent first. A document's own list is compared to each by the
out-of-place distance: the sum over its n-grams of how far the ranks lie apart,
the list's length for n-grams that the profile lacks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathglass.llm.common import task_tables, text_stream

#: N-grams in a profile.
RANKS = 400
#: About as many labelled rows are learned from, an equal share for each language, and
#: SPARE_ROWS more for each, chosen by a hash of their id and text.
SAMPLE_ROWS = 20_000
SPARE_ROWS = 30

#: A learning task counts so many n-grams before it hands on their sums.
FLUSH_CODES = 2_000_000

_SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_codes(text: str) -> np.ndarray:
    """The n-grams of a text as 63-bit codes, one for each occurrence; empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[c]
    # Runs of other characters become one space, with one in front and behind.
    c = np.where(letter, c, _SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate([[_SPACE], c[keep], [_SPACE]])
    if len(c) < 3:
        return np.zeros(0, np.int64)
    inner = c != _SPACE
    one = c[inner]
    two = (c[:-1] << 21 | c[1:])[inner[:-1] | inner[1:]]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[inner[1:-1]]
    return np.concatenate([one, two, three])


def ranked(text: str, ranks: int) -> np.ndarray:
    """The codes of the most frequent n-grams, by falling count and rising code."""
    codes, counts = np.unique(ngram_codes(text), return_counts=True)
    return codes[np.argsort(-counts, kind="stable")[:ranks]]


def learn_profiles(labelled: DataFrame, ranks: int = RANKS, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """A ranked list of n-gram codes for each language of the rows with a text and a language.

    Every language is learned, rare ones from all of their rows: each has an equal
    share of the sample, which bounds what is learned from whatever the table.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sizes.count()
    share = sample_rows // max(1, languages) + SPARE_ROWS
    sizes = sizes.select("lang", F.greatest(F.lit(1), F.floor(F.col("n") / share)).alias("every"))
    rows = rows.join(F.broadcast(sizes) if languages <= sample_rows else sizes, "lang").filter(F.pmod("h", "every") == 0).select("lang", "text")

    def count(batches):
        with task_tables("languages"):
            for b in batches:
                found, held = {}, 0
                for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
                    found.setdefault(lang.as_py(), []).append(ngram_codes(text.as_py()))
                    held += len(found[lang.as_py()][-1])
                    if held > FLUSH_CODES:
                        yield from partial_counts(found)
                        found, held = {}, 0
                yield from partial_counts(found)

    def partial_counts(found):
        for lang, parts in found.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            if len(codes):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(n, pa.int64())], ["lang", "code", "n"])

    counts = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.select("lang", "code", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= ranks)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["code"])
    return out


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], ranks: int):
        self.ranks, self.tables = ranks, []
        for lang in sorted(profiles):
            codes = np.asarray(profiles[lang], np.int64)
            order = np.argsort(codes)
            self.tables.append((lang, codes[order], order))

    def predict(self, text: str) -> tuple[str, float]:
        own = ranked(text, self.ranks)
        if not len(own) or not self.tables:
            return "und", 0.0
        at, best = np.arange(len(own)), ("und", 0.0, None)
        for lang, codes, rank in self.tables:
            k = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            apart = np.where(codes[k] == own, np.abs(rank[k] - at), self.ranks)
            distance = int(np.minimum(apart, self.ranks).sum())
            if best[2] is None or distance < best[2]:
                best = (lang, 1 - distance / (self.ranks * len(own)), distance)
        return best[:2]


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], ranks: int = RANKS, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the two columns behind its own; columns of these names are replaced.

    Prediction uses the whole text and nothing else. ``und`` and score 0 for a null
    text or one without a letter, or if nothing was learned; of languages at the
    same distance the first by name. Every row stays, in place; no shuffle.
    """

    docs = docs.drop(pred_col, score_col)

    def run(batches):
        model = Profiles(profiles, ranks)
        with task_tables("languages"):
            for b in batches:
                got = [model.predict(x) for x in text_stream(b, text_col)]
                names = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays([*b.columns, *names], [*b.schema.names, pred_col, score_col])

    fields = [*docs.schema.fields]
    schema = type(docs.schema)(fields).add(pred_col, "string").add(score_col, "double")
    return docs.mapInArrow(run, schema)


def held_out(id_col: str):
    """Rows kept away from learning: crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS) -> DataFrame:
    """Learn from the rows that are not held out, predict all: (id_col, held_out, lang_pred, score)."""
    profiles = learn_profiles(docs.filter(~held_out(id_col)), ranks, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col).alias("__id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("__text"))
    return predict_languages(rows, profiles, ranks, "__text").select(F.col("__id").alias(id_col), "held_out", "lang_pred", "score")
