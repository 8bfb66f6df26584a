"""Language identification: blended-spectrum n-gram presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, with_columns

#: The model is fitted on at most this many labelled rows in all, spread evenly over the languages, with so many landmarks.
SAMPLE_ROWS, LANDMARKS = 2400, 96
#: n-gram lengths of the blend, bits of the n-gram space, ridge, texts a matrix product.
ORDERS, BITS, RIDGE, BATCH = (1, 2, 3), 14, 1e-2, 64
UNDETERMINED = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)


def presence(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """Flags of the n-grams that occur in the whole text (lower-cased, runs of other characters than letters as one gap); None without letters."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = c < 0x10000
    is_letter = letters[np.where(low, c, 0)]
    if not low.all():
        high = np.unique(c[~low])
        is_letter = is_letter & low | np.isin(c, high[[chr(x).isalpha() for x in high.tolist()]])
    if not is_letter.any():
        return None
    c = np.where(is_letter, c, 32)
    gap = c == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    c = c[keep]
    c = np.concatenate([[32], c[int(c[0] == 32) : len(c) - int(c[-1] == 32)], [32]]).astype(np.uint64)  # one gap at either end
    flags = np.zeros(1 << BITS, bool)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * _STEP
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            flags[((h + np.uint64(n)) * _MIX) >> np.uint64(64 - BITS)] = True
    return flags


@dataclass
class KernelModel:
    """languages: in order of code points; landmarks: unit presence vectors as columns; weights: kernel values to scores."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, flags: np.ndarray) -> np.ndarray:
        """Regressed memberships of texts given as rows of presence flags: two matrix products."""
        x = flags.astype(np.float32)
        kernel = (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return kernel @ self.weights + self.bias


def fit(texts: list[str | None], languages: list[str]) -> KernelModel:
    """``fitted`` to texts."""
    letters = _letter_table()
    return fitted([presence(t, letters) for t in texts], languages)


def fitted(flags: list[np.ndarray | None], languages: list[str]) -> KernelModel:
    """Kernel ridge regression of each language against the rest, in the span of landmarks taken evenly from the languages. Texts
    without letters (None) teach nothing; without any others the model knows no language."""
    rows = [(f, lang) for f, lang in zip(flags, languages, strict=True) if f is not None]
    known = sorted({lang for _, lang in rows})
    if not known:
        return KernelModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    x = np.array([f for f, _ in rows], np.float32)
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    of = np.array([known.index(lang) for _, lang in rows])
    share = max(1, LANDMARKS // len(known))
    marks = x[np.concatenate([np.flatnonzero(of == k)[:share] for k in range(len(known))])]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = (x @ marks.T).astype(np.float64) @ root
    y = (of[:, None] == np.arange(len(known))).astype(np.float64)
    balance = 1 / np.bincount(of, minlength=len(known))[of]  # each language weighs alike
    zm, ym = np.average(z, axis=0, weights=balance), np.average(y, axis=0, weights=balance)
    zc = (z - zm) * np.sqrt(balance)[:, None]
    a = np.linalg.solve(zc.T @ zc + RIDGE * np.eye(z.shape[1]) * len(known) / 100, zc.T @ ((y - ym) * np.sqrt(balance)[:, None]))
    return KernelModel(known, np.ascontiguousarray(marks.T), root @ a, ym - zm @ a)


def training_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[np.ndarray | None], list[str]]:
    """A sample of labelled texts, at most SAMPLE_ROWS: as many of each language, those with the smallest key hashes. Their whole texts
    are turned into presence flags where they are; two kilobytes a text reach the driver, whatever its length."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.md5(F.concat_ws(":", F.lit("fit"), F.col(key).cast("string")).cast("binary")).alias("h")).where("t is not null and l is not null")
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(SAMPLE_ROWS).collect()}
    if not counts:
        return [], []
    each = SAMPLE_ROWS // len(counts)
    # A hash threshold a language keeps somewhat more than wanted, so that no task sorts a language.
    limit = F.create_map(*[F.lit(v) for l, n in counts.items() for v in (l, f"{min(0xFFFFFFFF, int(0x100000000 * (1.5 * each + 50) / n)):08x}g")])

    def make():
        letters = _letter_table()
        return lambda texts: [pa.array([None if f is None else np.packbits(f).tobytes() for f in (presence(t, letters) for t in texts.to_pylist())], pa.binary())]

    near = with_columns(rows.where(F.col("h") < limit[F.col("l")]), ["t"], "f binary", make).select("l", "h", "f")
    near = near.orderBy("h").limit(SAMPLE_ROWS * 3 + 60 * len(counts)).collect()
    taken = [r for lang in counts for r in [r for r in near if r.l == lang][:each]]
    return [None if r.f is None else np.unpackbits(np.frombuffer(r.f, np.uint8)).astype(bool) for r in taken], [r.l for r in taken]


def identify(docs: DataFrame, model: KernelModel, text: str = "text", name: str = "language") -> DataFrame:
    """Adds ``name``: struct(lang_pred, score) of each whole text. A scan without a shuffle.

    Null and empty texts and texts without a letter are ``und`` with score 0, as is everything under a model of no language. Very
    long texts are read whole. The score is the regressed membership, cut to 0..1. Equal scores go to the first language by code
    point. Repeated rows are judged alike; an empty table gives an empty result. Other columns pass through untouched; one called
    ``name`` is replaced.
    """
    batches_of(docs.sparkSession, 1000)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))  # a fixed size: 2 ** BITS x LANDMARKS floats

    def make():
        model, letters = KernelModel(*shared.value), _letter_table()

        def predicted(texts: pa.Array) -> list[pa.Array]:
            langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for at in range(0, len(texts), BATCH):
                flags = [presence(t, letters) for t in texts.slice(at, BATCH).to_pylist()]
                there = [i for i, f in enumerate(flags) if f is not None]
                if there and model.languages:
                    got = model.scores(np.array([flags[i] for i in there]))
                    for i, k, v in zip(there, got.argmax(axis=1).tolist(), got.max(axis=1).tolist(), strict=True):
                        langs[at + i], scores[at + i] = model.languages[k], min(1.0, max(0.0, v))
            return [pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])]

        return predicted

    return with_columns(docs, [text], f"`{name}` struct<lang_pred:string,score:double>", make)


def held_out(key: str = "doc_id"):
    """Whether a row may not be learnt from: crc32 of the key as text, mod 3, is 1. Null keys are not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(*training_rows(docs.where(~held_out())))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
