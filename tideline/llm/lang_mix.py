"""Language ID: each document as a mixture of languages, by expectation-maximisation.

Training counts hashed four-byte grams of lower-cased letters for each language over all
labelled rows outside the held-out fold; a model is languages x ``GRAMS`` numbers, however
large the corpus. A text is cut into segments of ``SEGMENT`` bytes; a segment's likelihood
under a language is that of its grams, and EM finds the document's language proportions.
Then languages are dropped, rarest first, for as long as the likelihood penalised by
``PENALTY`` x log(segments) for each language does not fall. Likelihoods are compared after EM has
come to the same ``TOLERANCE`` with each set. More than ``LANGUAGES`` different labels are an error:
the model, which the driver and each worker hold, would have no bound.

Results: one row per row. A text that is null or empty or has no letters gets ``und`` with score
0, as does everything when there is no labelled row. A text of any length is read whole. The
score is the proportion of the language named; ties go to the language first in order. lang,
source and doc_id take no part in a prediction; doc_id may be null (then not held out) or
repeated, and equal texts get equal languages. An empty table gives an empty result. Columns
other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops

GRAMS = 1 << 16
COUNTED_BYTES = 1 << 20  # of texts that are counted at once
SEGMENT = 48
PENALTY = 2.0
TOLERANCE = 0.01  # of a log likelihood, against a penalty of 1.4 and more
LANGUAGES = 500  # at most: 131 MB of model
_HASH = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A gram for each byte that starts one (-1 where no letter is in it), and its document."""
    b = np.where(textops.letters()[data], data, np.uint8(32)).astype(np.uint32)
    n = len(b)
    padded = np.concatenate([b, np.full(3, 32, np.uint32)])
    h = np.zeros(n, np.uint32)
    for k in range(4):
        h += padded[k : k + n] * _HASH[k]
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    gram = h.astype(np.int64)
    gram[(padded[:n] == 32) & (padded[1 : n + 1] == 32)] = -1  # runs of what isn't letters
    return gram, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for first, data, offsets in textops.chunks(batch.column(1), size=COUNTED_BYTES):
            gram, doc = _grams(data, offsets)
            names, which = np.unique(langs[first : first + len(offsets) - 1].astype(str), return_inverse=True)
            ok = gram >= 0
            seen = np.bincount(which[doc[ok]] * GRAMS + gram[ok], minlength=len(names) * GRAMS).reshape(len(names), GRAMS)
            for name, row in zip(names, seen, strict=True):
                total[name] = total.get(name, 0) + row
    for name, row in total.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(row[at])], ["lang", "gram", "n"])


def fit(labelled: DataFrame, most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (languages, GRAMS), from (lang, text)."""
    if labelled.where("lang is not null").select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} different languages among the labelled rows")
    counts = labelled.select("lang", "text").where("lang is not null and text is not null").mapInArrow(_count, "lang string, gram long, n long")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # languages x GRAMS at most
    names = sorted(rows["lang"].unique())
    table = np.zeros((len(names), GRAMS))
    table[rows["lang"].map({x: k for k, x in enumerate(names)}).to_numpy(int), rows["gram"].to_numpy(int)] = rows["n"]
    shared = (table.sum(0) + 0.5) / (table.sum() + 0.5 * GRAMS)
    smooth = 1000.0 * shared
    return names, np.log((table + smooth) / (table.sum(1, keepdims=True) + smooth.sum())).astype(np.float32) if names else np.zeros((0, GRAMS), np.float32)


def proportions(like: np.ndarray, doc: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for each document, until a round adds less than ``TOLERANCE`` to its log likelihood:
    (documents, languages) proportions and log likelihoods.
    like: (segments, languages) likelihoods, the best of a segment 1; doc: sorted."""
    n, langs = active.shape
    share = active / np.maximum(active.sum(1, keepdims=True), 1)
    size = np.bincount(doc, minlength=n)
    level = np.where(size > 0, -np.inf, 0.0)
    while len(doc):
        r = like * share[doc]
        total = np.maximum(r.sum(1), 1e-300)
        here = np.zeros(n, bool)
        here[doc] = True
        now = np.where(here, np.bincount(doc, np.log(total), n), level)
        moving = here & ~(now - level < TOLERANCE)
        level = now
        rows = moving[doc]
        if not rows.all():  # a document stops by itself, whatever is beside it
            like, doc, r, total = like[rows], doc[rows], r[rows], total[rows]
        r /= total[:, None]
        share[moving] = np.stack([np.bincount(doc, r[:, k], n) for k in range(langs)], 1)[moving] / size[moving, None]
    return share, level


def mixtures(like: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Proportions after selection of each document's set of languages."""
    langs = like.shape[1]
    active = np.ones((n, langs), bool)
    share, level = proportions(like, doc, active)
    price = PENALTY * np.log(np.bincount(doc, minlength=n) + 1.0)
    trying = np.full(n, langs > 1)
    for _ in range(langs - 1):
        rarest = np.where(active, share, np.inf).argmin(1)
        fewer = active.copy()
        fewer[np.arange(n), rarest] = False
        rows = trying[doc]
        share_, level_ = proportions(like[rows], doc[rows], fewer)
        trying &= level_ + price >= level
        if not trying.any():
            break
        active[trying], share[trying], level[trying] = fewer[trying], share_[trying], level_[trying]
    return share


def _predict(names: list[str], model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            langs, scores = [], []
            for first, data, offsets in textops.chunks(batch.column(1), size=COUNTED_BYTES):
                n = len(offsets) - 1
                ascii_ = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])[offsets]
                lettered = np.diff(ascii_) > 0
                for k in np.flatnonzero(~lettered):
                    lettered[k] = any(map(str.isalpha, data[offsets[k] : offsets[k + 1]].tobytes().decode()))
                gram, doc = _grams(data, offsets)
                place = (np.arange(len(data)) - offsets[doc]) // SEGMENT
                edge = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])) if len(data) else np.zeros(0, int)
                owner = doc[edge]
                if len(edge) and names:
                    known = (gram >= 0).astype(np.float32)
                    logs = np.stack([np.add.reduceat(row[gram] * known, edge) for row in table], 1).astype(np.float64)
                    logs -= logs.max(1, keepdims=True)
                    share = mixtures(np.exp(np.maximum(logs, -200)), owner, n)
                else:
                    share = np.zeros((n, max(1, len(names))))
                best = share.argmax(1)
                sure = lettered & bool(names)
                langs += [names[k] if ok else "und" for k, ok in zip(best, sure, strict=True)]
                scores.append(np.where(sure, np.clip(share[np.arange(n), best], 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    names, table = fit(rows.where("not held_out"))
    model = docs.sparkSession.sparkContext.broadcast(table)
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predict(names, model), "doc_id long, held_out boolean, lang_pred string, score double")
