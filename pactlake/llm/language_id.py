"""Language identification of mixed texts by expectation-maximisation.

Training counts hashed byte n-grams (1 to 4, with word borders) of labelled rows per language. The fit may
use a bounded sample: about `sample_per_lang` labelled texts of each language, taken by a hash of the id;
counts are summed in Spark and the model is languages * 2**bits numbers.

A text is a bag of words; each word's likelihood under a language is that of its n-grams. For every text,
expectation-maximisation estimates the mixing proportions of the languages. The language set is selected by
penalised likelihood: starting from all languages, the one with the smallest proportion is left out as long
as log-likelihood minus `penalty` * |set| * log(words) / 2 grows. The prediction is the language with the
largest proportion, the score that proportion. All texts of a slice are estimated together, in numpy, inside
tasks; nothing is shuffled at prediction.

Null texts and texts without a letter get `und` and score 0. Rows without a language teach nothing. Without
any labelled row every text is `und`. Ties go to the alphabetically first language. Repeated rows get equal
results. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.llm import bytewise
from pactlake.llm.common import written

BITS, SAMPLE_PER_LANG, PENALTY, STEPS, MAX_LANGS = 16, 3000, 1.0, 12, 1000
UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
#: Anything that is not a letter in ASCII parts words here; letters outside ASCII are bytes of 128 and more.
_BREAK = np.ones(256, bool)
_BREAK[128:] = False
_BREAK[ord("A") : ord("Z") + 1] = _BREAK[ord("a") : ord("z") + 1] = False
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[_BREAK] = 32
#: Unicode letters; numbers such as one half or Roman four are none.
LETTER = r"\p{L}"


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams ending at every byte of every word or its right border: (cells by order, byte's word, word's row bounds, word lengths)."""
    starts, ends, bounds = bytewise.words(data, offsets, _BREAK)
    lengths = ends - starts + 1  # with one border byte
    total = int(lengths.sum())
    word = np.repeat(np.arange(len(starts)), lengths)
    firsts = np.cumsum(lengths) - lengths
    inner = np.arange(total) - firsts[word]
    at = starts[word] + inner
    codes = np.where(inner == lengths[word] - 1, np.uint32(32), _FOLD[data[np.minimum(at, max(len(data) - 1, 0))]]) if total else np.zeros(0, np.uint32)
    cells, rolling = [], np.zeros(total, np.uint32)
    shift = np.uint32(32 - bits)
    for order in ORDERS:
        back = np.full(total, 32, np.uint32)  # a border before the word
        if order > 1:
            back[order - 1 :] = codes[: total - order + 1]
            back[inner < order - 1] = 32
        else:
            back = codes
        rolling = rolling * np.uint32(0x01000193) + back + np.uint32(order)
        cells.append(((rolling * np.uint32(0x9E3779B1)) ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> shift)
    return np.array(cells), word, bounds, firsts


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


class Model:
    """Log-likelihoods of hashed n-grams by language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=2, keepdims=True)).astype(np.float32).transpose(1, 2, 0).copy()  # order, cell, lang


def fit(labelled: DataFrame, bits: int = BITS, sample_per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model of labelled rows (non-null language and text)."""
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[lang_col]: r["count"] for r in labelled.groupBy(lang_col).count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, len(ORDERS), 1 << bits)))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_per_lang / sizes[k]))])
    place = F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) / 1_000_000.0
    sample = labelled.filter(place < share[F.col(lang_col)]).select(F.col(text_col), F.col(lang_col))
    index = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), len(ORDERS), 1 << bits), np.int64)
        for batch in batches:
            kinds = np.array([index[k] for k in batch.column(1).to_pylist()], np.int64)
            for lo, hi, data, offsets in bytewise.slices(batch.column(0)):
                cells, word, bounds, _ = features(data, offsets, bits)
                row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                lang = kinds[lo:hi][row][word]
                for o in range(len(ORDERS)):
                    total[:, o] += np.bincount(lang << bits | cells[o], minlength=len(langs) << bits).reshape(len(langs), -1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(total.ravel()[at], pa.int64())})

    sums = written(sample.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")), "lang-counts").toPandas()
    counts = np.zeros(len(langs) * len(ORDERS) << bits)
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return Model(langs, counts.reshape(len(langs), len(ORDERS), 1 << bits))


def estimate(logs: np.ndarray, bounds: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Proportions (rows, languages) for words' log-likelihoods (words, languages) and the rows' bounds in them."""
    n = np.diff(bounds)
    filled = np.flatnonzero(n)
    rows, langs = len(n), logs.shape[1]
    out = np.zeros((rows, langs))
    if not len(filled):
        return out
    row = np.repeat(np.arange(len(filled)), n[filled])
    at = bounds[:-1][filled]
    likes = np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-12
    size = n[filled].astype(float)

    def em(active: np.ndarray, rows_of: np.ndarray, words_of: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = active / active.sum(axis=1, keepdims=True)
        part = likes[words_of]
        for _ in range(steps):
            joint = pi[rows_of] * part
            joint /= joint.sum(axis=1, keepdims=True)
            pi = np.add.reduceat(joint, starts, axis=0) / sizes[:, None]
        fit = np.add.reduceat(np.log((pi[rows_of] * part).sum(axis=1)), starts)
        return pi, fit

    active = np.ones((len(filled), langs))
    pi, fit = em(active, row, np.arange(len(row)), at - at[0] if len(at) else at, size)
    cost = penalty * np.log(np.maximum(size, 2)) / 2
    open_rows = np.arange(len(filled)) if langs > 1 else np.zeros(0, int)
    starts_all = np.concatenate(([0], np.cumsum(n[filled])))
    while len(open_rows):
        weakest = np.where(active[open_rows] > 0, pi[open_rows], np.inf).argmin(axis=1)
        tried = active[open_rows].copy()
        tried[np.arange(len(open_rows)), weakest] = 0
        lengths = n[filled][open_rows]
        starts = np.cumsum(lengths) - lengths
        words_of = np.repeat(starts_all[open_rows] - starts, lengths) + np.arange(int(lengths.sum()))
        new_pi, new_fit = em(tried, np.repeat(np.arange(len(open_rows)), lengths), words_of, starts, size[open_rows])
        better = new_fit + cost[open_rows] >= fit[open_rows]
        done = open_rows[better]
        active[done], pi[done], fit[done] = tried[better], new_pi[better], new_fit[better]
        open_rows = done[active[done].sum(axis=1) > 1]
    out[filled] = pi
    return out


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY, steps: int = STEPS, text_col: str = "text") -> DataFrame:
    """docs without its text, with lang_pred, score and n_langs (size of the selected set)."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        bits = known.logs.shape[1].bit_length() - 1 if known.langs else 0
        for batch in batches:
            texts, lettered = batch.column(0), batch.column(1).to_pylist()
            preds, scores, sizes = [], [], []
            for lo, hi, data, offsets in bytewise.slices(texts):
                if not known.langs:
                    preds += [UNKNOWN] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    sizes += [0] * (hi - lo)
                    continue
                cells, _, bounds, firsts = features(data, offsets, bits)
                logs = np.zeros((len(firsts), len(known.langs)), np.float64)
                if len(firsts):
                    each = sum(known.logs[o][cells[o]] for o in range(len(ORDERS)))
                    logs = np.add.reduceat(each, firsts, axis=0).astype(np.float64)
                pi = estimate(logs, bounds, penalty, steps)
                best = pi.argmax(axis=1)
                for i in range(hi - lo):
                    if not lettered[lo + i] or not pi[i].any():
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        sizes.append(0)
                    else:
                        preds.append(known.langs[best[i]])
                        scores.append(float(min(1.0, pi[i, best[i]])))
                        sizes.append(int((pi[i] > 0).sum()))
            extra = {"lang_pred": pa.array(preds, pa.string()), "score": pa.array(scores, pa.float64()), "n_langs": pa.array(sizes, pa.int32())}
            yield pa.RecordBatch.from_pydict({f.name: batch.column(i + 2) for i, f in enumerate(kept)} | extra)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string, score double, n_langs int"])
    lettered = F.coalesce(F.col(f"`{text_col}`").rlike(LETTER), F.lit(False)).alias("has a letter")
    return docs.select(f"`{text_col}`", lettered, *[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Train on the labelled rows that are not held out and predict every row from its text alone."""
    model = fit(docs.filter(~F.coalesce(held_out(F.col(id_col)), F.lit(False))), id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(F.col(id_col), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col))
    return predict(rows, model, text_col=text_col, **options)
