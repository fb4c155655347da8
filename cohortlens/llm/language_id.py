"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword of +1 and -1. Each bit has a binary classifier, linear in the shares of hashed byte
trigrams (log odds of the two groups of languages, smoothed, then scaled by a logistic fit on other rows of the sample).
A text goes to the codeword of least loss, each bit weighted by how well its classifier did on those other rows; the
answer is flagged ambiguous where the second codeword comes close. Up to five languages get all distinct bits, more get
about ten bits per doubling, drawn to keep codewords far apart.

The model is fitted on a bounded sample (``per_language`` rows of each language); it holds BUCKETS weights per bit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import free_name, slices, text_bytes, text_column, written

BUCKETS = 1 << 16
#: Bytes of text whose trigrams are held at once; each takes some 40 bytes.
SLICE = 1 << 20
UNDETERMINED = "und"


def codewords(k: int) -> np.ndarray:
    """(k, bits) of +1 and -1: rows differ, no column is constant or the opposite of another."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 5:
        rows = [[1] + [1 if (c >> (k - 2 - i)) & 1 else -1 for i in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(rows, float).T
    best, far = None, -1
    bits = int(np.ceil(10 * np.log2(k)))
    for seed in range(50):
        m = np.random.default_rng(seed).choice([-1.0, 1.0], (k, bits))
        m[:2, np.abs(m.sum(axis=0)) == k] = [[1.0], [-1.0]]
        apart = (bits - m @ m.T) / 2 + bits * np.eye(k)
        if apart.min() > far:
            best, far = m, apart.min()
    return best


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of the trigram at each byte of the padded texts, text starts, trigrams of each text).

    A-Z are lower-cased, all other bytes below 128 that are no letters are one sign. The last bytes of a text start no
    trigram and have the bucket BUCKETS, whose weight is 0; so has a trigram without letters.
    """
    fold = np.full(256, 32, np.uint32)
    fold[128:], fold[97:123], fold[65:91] = np.arange(128, 256), np.arange(97, 123), np.arange(97, 123)
    before, after, glue = (pa.scalar(x, pa.large_string()) for x in (" ", "  ", ""))
    offsets, data = text_bytes(pc.binary_join_element_wise(before, texts, after, glue))
    b = fold[data]
    gram = np.zeros(len(b), np.uint32)
    gram[:-2] = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    ends = offsets[1:]
    empty = gram == 0x202020
    bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    bucket[empty] = BUCKETS
    bucket[ends - 1] = bucket[ends - 2] = BUCKETS
    counted = np.concatenate(([0], np.cumsum(bucket != BUCKETS)))
    return bucket, offsets[:-1], counted[ends] - counted[offsets[:-1]]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bits x (BUCKETS + 1)
    scale: np.ndarray  # bits x 2: factor, shift
    trust: np.ndarray  # bits

    def bits(self, texts: pa.Array) -> np.ndarray:
        """(texts, bits): mean weight of each text's trigrams."""
        bucket, starts, n = trigrams(texts)
        out = np.empty((len(texts), len(self.weights)))
        for j, w in enumerate(self.weights):
            out[:, j] = np.add.reduceat(w[bucket], starts)
        return out / np.maximum(n, 1)[:, None]

    def decode(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, probability-like score, lead over the second codeword)."""
        z = bits * self.scale[:, 0] + self.scale[:, 1]
        loss = np.stack([np.logaddexp(0, -z * c) @ self.trust for c in self.code], axis=1) / self.trust.sum()
        best = loss.argmin(axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        top = np.sort(share, axis=1)
        lead = top[:, -1] - top[:, -2] if share.shape[1] > 1 else np.ones(len(share))
        return best, np.clip(share.max(axis=1), 0, 1), lead


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """Up to per_language rows (lang, half, text) of each language, chosen by a hash of the id."""
    rows = docs.where("lang is not null and id is not null and fold <> 2")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.3 * per_language + 100) / n))])
    order = F.xxhash64(F.col("id").cast("string"), F.lit(7))
    thinned = rows.where("text is not null").withColumn("h", order).where(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * (1 << 40))
    # the thinned rows of a language are about as many as are wanted
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    return thinned.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", (F.col("rank") % 2).alias("half"), "text")


def fit(docs: DataFrame, per_language: int = 1500) -> Model | None:
    """Model from rows (id, text, lang, fold) with a language and fold other than 2; None if there are none. Runs jobs."""
    sample = _sample(docs, per_language)
    if sample is None:
        return None
    sample = written(sample, "sample")

    def count(table: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS + 1, np.int64)
        texts = text_column(table.combine_chunks().to_batches()[0], "text")
        for a, b in slices(texts, SLICE):
            total += np.bincount(trigrams(texts.slice(a, b - a))[0], minlength=BUCKETS + 1)
        return pa.table({"lang": table["lang"].slice(0, 1), "counts": pa.array([total[:BUCKETS].astype(np.uint32).tobytes()], pa.binary())})

    # a group is at most per_language / 2 texts; a language sends one row of 256 KB
    got = sample.where("half = 1").groupBy("lang").applyInArrow(count, "lang string, counts binary").collect()
    got.sort(key=lambda r: r[0])
    languages = [r[0] for r in got]
    counts = np.stack([np.frombuffer(r[1], np.uint32) for r in got]).astype(float)
    shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    weights = np.zeros((code.shape[1], BUCKETS + 1), np.float32)
    for j, bit in enumerate(code.T):
        if (bit > 0).any() and (bit < 0).any():
            weights[j, :BUCKETS] = np.log(shares[bit > 0].mean(axis=0)) - np.log(shares[bit < 0].mean(axis=0))
    raw = Model(languages, code, weights, np.tile([1.0, 0.0], (len(weights), 1)), np.ones(len(weights)))

    def score(batches):
        for batch in batches:
            texts = text_column(batch, "text")
            for a, b in slices(texts, SLICE):
                bits = raw.bits(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(list(bits), pa.list_(pa.float64()))], names=["lang", "bits"])

    held = [r for r in sample.where("half = 0").select("lang", "text").mapInArrow(score, "lang string, bits array<double>").collect() if r[0] in languages]
    scale, trust = raw.scale.copy(), raw.trust.copy()
    if held:
        z, truth = np.array([r[1] for r in held]), np.array([languages.index(r[0]) for r in held])
        for j in range(len(weights)):
            y = code[truth, j]
            scale[j] = _logistic(z[:, j], y)
            wrong = np.mean(np.sign(z[:, j] * scale[j, 0] + scale[j, 1]) != y)
            trust[j] = max(0.01, 1 - 2 * wrong)
    return Model(languages, code, weights, scale, trust)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Factor and shift of a lightly penalised logistic fit of y (+1, -1) on x."""
    unit = x.std() or 1.0
    a = np.stack((x / unit, np.ones(len(x))), axis=1)
    w = np.array([1.0, 0.0])
    penalty = np.array([0.01, 0.01]) * len(x) / 10
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(y * (a @ w), -500, 500)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty) + 1e-9 * np.eye(2), a.T @ (y * p) - penalty * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[0] / unit, w[1]


def identify(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 1500,
             close: float = 0.02, labelled: DataFrame | None = None, all_columns: bool = False,
             prefix: str = "") -> DataFrame:
    """Per row: id (or all columns), held_out, lang_pred, score (0 to 1), ambiguous. Fits first, which runs jobs.

    Learns from rows of ``labelled`` (default docs) with a text, a language and crc32(id as text) mod 4 other than 2, at
    most per_language of each language; the prediction reads the text only. A null text, one without a letter, or any
    text if nothing could be learned is ``und`` with score 0 and not ambiguous. Ambiguous: the second codeword's share
    comes within ``close``. Repeated rows are judged each, texts of any length whole; an empty table gives no rows. A null id is not held out and not learned from. ``prefix``
    stands before the results' names; with all_columns, columns that still have such a name are replaced.
    """
    fold = lambda df: F.crc32(df[id].cast("string").cast("binary")) % 4
    source = docs if labelled is None else labelled
    model = fit(source.select(source[id].alias("id"), source[text].cast("string").alias("text"), source[lang].cast("string").alias("lang"),
                              fold(source).alias("fold")), per_language)
    names = [prefix + x for x in ("held_out", "lang_pred", "score", "ambiguous")]
    keep = [c for c in docs.columns if c.lower() not in names] if all_columns else [id]
    # a text column that is kept is sent to the workers once
    one = text in keep and isinstance(docs.schema[text].dataType, T.StringType)
    at = text if one else free_name(docs, "text_read")

    def predict(batches):
        for batch in batches:
            texts = text_column(batch, at)
            for a, b in slices(texts, SLICE):
                part = texts.slice(a, b - a)
                letters = pc.match_substring_regex(part, r"\p{L}").to_numpy(zero_copy_only=False)
                if model is None:
                    lang_pred, score, lead = np.full(len(part), UNDETERMINED, object), np.zeros(len(part)), np.ones(len(part))
                else:
                    best, score, lead = model.decode(model.bits(part))
                    lang_pred = np.array(model.languages, object)[best]
                    lang_pred[~letters], score[~letters], lead[~letters] = UNDETERMINED, 0.0, 1.0
                cols = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns) if one or batch.schema.names[i] != at]
                cols += [pa.array(lang_pred, pa.string()), pa.array(score), pa.array(lead < close)]
                yield pa.RecordBatch.from_arrays(cols, names=[*(c for c in batch.schema.names if one or c != at), *names[1:]])

    read = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(fold(docs) == 2, F.lit(False)).alias(names[0]), *([] if one else [docs[text].cast("string").alias(at)]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if one or f.name != at)
    return read.mapInArrow(predict, kinds + f", `{names[1]}` string, `{names[2]}` double, `{names[3]}` boolean")
