"""Language identification as inference of a multilingual mixture.

A document is a mixture of languages over hashed byte trigrams. Expectation-maximisation estimates the proportions
for a set of languages; sets grow from the best single language as long as the penalised likelihood rises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, without

#: Hashed trigrams of a model; with the number of languages this bounds the model.
BINS = 1 << 15
SMOOTHING = 0.5
#: Charge in log-likelihood for each further language, per log of the number of trigrams.
PENALTY = 4.0
ROUNDS = 25
OUTPUTS = ("lang_pred", "score", "languages")

_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    """``logs``: log-probability of each trigram bin by language."""

    languages: tuple[str, ...]
    logs: np.ndarray


def trigrams(text: str) -> np.ndarray:
    """Bins of the byte trigrams of the lower-cased text, anything but letters read as one space each."""
    code = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)]
    grams = (code[:-2] << 16) | (code[1:-1] << 8) | code[2:]
    grams = grams[grams != 0x202020]
    return (grams * np.uint32(2654435761)) >> np.uint32(17)


def _count_batches(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            table = counts.setdefault(lang.as_py(), np.zeros(BINS, np.int64))
            table += np.bincount(trigrams(text.as_py()), minlength=BINS)
    for lang, table in counts.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])],
            names=["lang", "bin", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram model of all rows whose text and language are known.

    Every task counts its rows; counts meet by (language, bin). The driver gets one row per language and bin
    that occurs: at most languages x 32,768. No labelled row gives a model without languages.
    """
    known = docs.select(F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).alias("text")).dropna()
    counts = known.mapInArrow(_count_batches, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    names = got.column("lang").to_numpy(zero_copy_only=False)
    languages = tuple(sorted(set(names)))
    place = {x: i for i, x in enumerate(languages)}
    table = np.zeros((len(languages), BINS))
    table[[place[x] for x in names], got.column("bin").to_numpy()] = got.column("n").to_numpy()
    table += SMOOTHING
    return Model(languages, np.log(table / table.sum(1, keepdims=True)))


def _mixture(like: np.ndarray, n: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, float]:
    """EM for the shares of the rows of ``like`` (languages x trigrams, seen ``n`` times); shares and log-likelihood."""
    total, last = n.sum(), -np.inf
    for _ in range(ROUNDS):
        mixed = shares @ like
        now = float(n @ np.log(mixed))
        if now - last < 1e-3:
            break
        last = now
        shares = shares * (like @ (n / mixed)) / total
    return shares, now


def infer(text: str | None, model: Model) -> tuple[str, float, list[tuple[str, float]]]:
    """The language with the largest share, its share, and all selected languages with theirs.

    ``und`` with score 0 and no languages where the text is null or has no letter, or nothing was learned.
    Equal shares go to the language first by code point.
    """
    if text is None or not model.languages or not _LETTER.search(text):
        return "und", 0.0, []
    bins, n = np.unique(trigrams(text), return_counts=True)
    logs = model.logs[:, bins]
    total = logs @ n
    best = int(np.argmax(total))
    chosen, shares, score = [best], np.ones(1), float(total[best])
    # probabilities relative to the best language, so that no exponent underflows
    like = np.exp(np.clip(logs - logs.max(0), -60, 0))
    base = float(n @ logs.max(0))
    charge = PENALTY * np.log(n.sum() + 1.0)
    while len(chosen) < len(model.languages):
        gain = like @ (n / (shares @ like[chosen])) / n.sum()
        gain[chosen] = 0
        found = None
        for other in np.flatnonzero(gain > 1.0):
            trial = [*chosen, int(other)]
            got, loglike = _mixture(like[trial], n, np.append(shares * 0.8, 0.2))
            if loglike + base > (found[2] if found else score + charge):
                found = (trial, got, loglike + base)
        if found is None:
            break
        chosen, shares, score = found
    named = sorted(((model.languages[c], float(s)) for c, s in zip(chosen, shares)), key=lambda p: (-p[1], p[0]))
    return named[0][0], min(1.0, named[0][1]), named


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (share of that language, 0 to 1) and ``languages`` (all selected, with shares).

    Only the text is read for a prediction, and all of it. No shuffle; the model is sent to every executor once. Null and letterless
    texts get ``und`` and 0. Input columns named like an output are replaced, all others pass through; ties and
    repeated rows get equal answers; an empty table gives no rows.
    """
    docs = without(docs, OUTPUTS)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, = fresh(docs, "_whole_text")

    def batches(rows):
        model = shared.value
        for batch in rows:
            got = [infer(t.as_py(), model) for t in batch.column(batch.num_columns - 1)]
            spans = pa.array([[{"lang": a, "share": s} for a, s in g[2]] for g in got],
                             pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            arrays = [*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()),
                      pa.array([g[1] for g in got], pa.float64()), spans]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], *OUTPUTS])

    schema = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema),
                        "lang_pred string, score double, languages array<struct<lang: string, share: double>>"])
    return docs.withColumn(text, F.col(quoted(text_col))).mapInArrow(batches, schema)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 5 == 0, F.lit(False))
