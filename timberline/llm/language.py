"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training documents. The weights are fitted by follow-the-regularised-
leader with elastic-net penalties on a bounded sample (SAMPLE_PER_LANGUAGE documents of each language, whole
texts), a part of which is kept back for the temperature of the calibrated probabilities. Prediction reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.llm.common import BROADCAST_ROWS, pieces

#: Buckets of hashed n-grams, their lengths, and the documented bound of the training sample.
BUCKETS, LENGTHS, SAMPLE_PER_LANGUAGE = 1 << 14, (1, 2, 3), 600
#: Documents of the sample over all languages: where there are more than SAMPLE_MOST / SAMPLE_PER_LANGUAGE languages, each has fewer.
SAMPLE_MOST = 600_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 2e-4, 1e-4
#: Code points handled at once, so that a very long text needs bounded memory.
CHUNK = 1 << 20
UNKNOWN = "und"

_letters = None


def letter_table():
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        import numpy as np

        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: bytes | None):
    """(buckets, counts) of the n-grams of a text: letters in lower case, all else one blank. None without letters."""
    import numpy as np

    points = np.frombuffer((text or b"").decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    total, letters, rest = None, letter_table(), np.empty(0, np.uint32)
    for at in range(0, len(points), CHUNK):
        part = points[at : at + CHUNK]
        part = np.where(letters[part], part, np.uint32(32))
        part = np.concatenate([rest if at else np.array([32], np.uint32), part, np.array([32] if at + CHUNK >= len(points) else [], np.uint32)])
        part = part[np.concatenate([[True], (part[1:] != 32) | (part[:-1] != 32)])]
        if total is None:
            total = np.zeros(BUCKETS, np.int64)
        fresh, mixed = len(rest) if at else 0, part.astype(np.uint64)
        for n in range(1, max(LENGTHS) + 1):
            if n > 1:
                mixed = mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :].astype(np.uint64)
            if n in LENGTHS and len(mixed):
                new = mixed[max(0, fresh - n + 1) :]  # those that end in the letters carried over are counted already
                total += np.bincount(((new * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
        rest = part[-(max(LENGTHS) - 1) :]
    if total is None or not letters[points].any():
        return None
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    languages: list[str]
    idf: "object"
    weights: "object"
    bias: "object"
    temperature: float

    def vector(self, found, counts):
        import numpy as np

        x = (1 + np.log(counts)) * self.idf[found]
        return x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        import numpy as np

        got = grams(text)
        if got is None or not self.languages:
            return UNKNOWN, 0.0
        logits = (self.vector(*got) @ self.weights[got[0]] + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3))


def document_frequencies(docs: DataFrame, text_col: str):
    """(documents, array of documents by bucket): one pass over all of docs, summed before anything is shuffled."""
    import pyarrow as pa

    def run(batches):
        import numpy as np

        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in pieces(batches):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if (got := grams(text)) is not None:
                    total[got[0]] += 1
                    total[BUCKETS] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    import numpy as np

    out = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return int(out[BUCKETS]), out[:BUCKETS]


def sampled(docs: DataFrame, per_language: int) -> list:
    """At most per_language rows of each language, by a hash of id and text, SAMPLE_MOST over all: (language, place, buckets, counts). Equal rows count once; of equal hashes the smaller text stands. An empty table gives none."""
    import pyarrow as pa

    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("_lang"), F.xxhash64("doc_id", "text", F.lit(17)).alias("_order"))
    sizes = known.select("_lang", "_order").distinct().groupBy("_lang").count()
    languages = sizes.count()
    if not languages:
        return []
    per_language = max(1, min(per_language, SAMPLE_MOST // languages))
    # only the smallest hashes go on, about twice as many as are taken, so that no task ranks a whole language
    least = F.least(F.lit(2.0**63), (2.0 * per_language + 100) / F.col("count") * 2.0**64 - 2.0**63)
    limits = sizes.select("_lang", least.alias("_least"))
    near = known.join(F.broadcast(limits) if languages <= BROADCAST_ROWS else limits, "_lang").where("_order <= _least").groupBy("_lang", "_order").agg(F.min("text").alias("text"))
    texts = near.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_order"))).where(F.col("_n") <= per_language).select("_lang", "_n", "text")

    def run(batches):
        import numpy as np

        for batch in pieces(batches):
            rows = [(*x, grams(t)) for *x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist())]
            rows = [(lang, n, got[0].astype(np.int32).tobytes(), got[1].astype(np.int32).tobytes()) for lang, n, got in rows if got is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["lang", "n", "buckets", "counts"])

    return sorted(map(tuple, texts.mapInArrow(run, "lang string, n long, buckets binary, counts binary").collect()))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from (doc_id, text, lang) rows; rows with a null id or language teach nothing. Without any, all is unknown."""
    import numpy as np

    known = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null")
    n, df = document_frequencies(known, "text")
    rows = sampled(known, per_language)
    languages = sorted({r[0] for r in rows})
    model = Model(languages, np.log((1.0 + n) / (1.0 + df)) + 1.0, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), 1.0)
    parsed = []
    for lang, place, found, counts in rows:
        found = np.frombuffer(found, np.int32).astype(np.int64)
        parsed.append((place, languages.index(lang), found, model.vector(found, np.frombuffer(counts, np.int32).astype(float))))
    held = [r for r in parsed if r[0] % 5 == 0]
    train(model, [r for r in parsed if r[0] % 5] or parsed)
    model.temperature = temperature(model, held or parsed)
    return model


def train(model: Model, rows: list) -> None:
    """Follow-the-regularised-leader with per-coordinate rates and elastic-net penalties; the bias has no penalty."""
    import numpy as np

    classes = len(model.languages)
    z, seen = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(5)
    l1 = np.append(np.full(BUCKETS, L1 * len(rows)), 0.0)[:, None]
    solve = lambda zi, ni, l1i: -np.sign(zi) * np.maximum(np.abs(zi) - l1i, 0) / ((BETA + np.sqrt(ni)) / ALPHA + L2 * len(rows))
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            _, label, found, x = rows[i]
            at, x = np.append(found, BUCKETS), np.append(x, 1.0)
            w = solve(z[at], seen[at], l1[at])
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(seen[at] + g * g) - np.sqrt(seen[at])) / ALPHA
            z[at] += g - step * w
            seen[at] += g * g
    w = solve(z, seen, l1)
    model.weights, model.bias = w[:BUCKETS], w[BUCKETS]


def temperature(model: Model, rows: list) -> float:
    """The divisor of the logits with the least log loss on rows, by golden section over its logarithm."""
    import numpy as np

    if not rows:
        return 1.0
    logits = np.array([x @ model.weights[found] + model.bias for _, _, found, x in rows])
    labels = np.array([r[1] for r in rows])

    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        scaled = scaled - scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(labels)), labels]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: Model, text_col: str = "text", added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two columns `added`, a string and a double (0 to 1); `und` and 0 for a null text or one without letters.

    One row per row; repeated rows are judged alike, equal scores go to the language first by name. A column of docs named as one of `added` is an error.
    """
    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StringType, StructType

    place, names = docs.columns.index(text_col), docs.columns
    if set(added) & set(names):
        raise ValueError(f"columns {sorted(set(added) & set(names))} are there already; name others in `added`")
    schema = StructType([*docs.schema.fields]).add(added[0], StringType()).add(added[1], DoubleType())

    def run(batches):
        for batch in pieces(batches):
            got = [model.predict(t.as_py()) for t in batch.column(place).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, *added])

    return docs.mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns whatever their names, whose predicted language is known and has least_score at least."""
    import pyarrow as pa

    place = docs.columns.index(text_col)

    def run(batches):
        for batch in pieces(batches):
            got = (model.predict(t.as_py()) for t in batch.column(place).cast(pa.binary()))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(fold(F.col("doc_id")) != 1))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
