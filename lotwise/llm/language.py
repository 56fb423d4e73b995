"""Language identification: sparse multinomial logistic regression on character n-grams.

Features are TF-IDF weights of hashed character n-grams (1 to 3 letters, words
apart). The model is trained by follow-the-regularised-leader with L1 and L2
penalties: shards of the training rows advance the same state side by side and
are averaged after each round. A temperature fitted on rows kept out of training
turns scores into probabilities.

Training rows are a bounded sample (``PER_LANGUAGE`` rows of each language,
chosen by a hash of doc_id and text, whole texts); every row is scored. The model has
``2**FEATURE_BITS`` rows and one column per language, whatever the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.arrow import batch, text_slices
from lotwise.llm.rolling import mix
from lotwise.staging import Staging

FEATURE_BITS = 15
LONGEST = 3
PER_LANGUAGE = 1500
SHARDS = 6
ROUNDS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
SCALE = 20.0
TEMPERATURES = np.geomspace(0.25, 8, 41)
UNDETERMINED = "und"


class Letters:
    """Lower-case letters of code points; everything else is a blank."""

    def __init__(self):
        self.table = np.full(0x110000, -1, np.int32)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        found = self.table[points]
        if (found < 0).any():
            for p in np.unique(points[found < 0]):
                lower = chr(p).lower()
                self.table[p] = (ord(lower) if len(lower) == 1 else p) if chr(p).isalpha() else 0x20
            found = self.table[points]
        return found


class Grams:
    """Hashed n-grams of documents: (document of each, feature of each, has a letter)."""

    def __init__(self):
        self.letters = Letters()

    def __call__(self, data: np.ndarray, bounds: np.ndarray):
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
        n_docs = len(bounds) - 1
        doc = np.repeat(np.arange(n_docs), np.diff(leads))
        chars = self.letters(points)
        lettered = np.bincount(doc[chars != 0x20], minlength=n_docs) > 0
        # a blank before each document; runs of blanks become one
        chars = np.insert(chars, leads[:-1], 0x20).astype(np.uint64)
        doc = np.insert(doc, leads[:-1], np.arange(n_docs))
        keep = np.ones(len(chars), bool)
        keep[1:] = (chars[1:] != 0x20) | (chars[:-1] != 0x20) | (doc[1:] != doc[:-1])
        chars, doc = chars[keep], doc[keep]
        docs, features, code = [], [], np.zeros(len(chars), np.uint64)
        for n in range(1, LONGEST + 1):
            size = max(len(chars) - n + 1, 0)
            code = code[:size] * np.uint64(0x110000 + 1) + chars[n - 1 :] + np.uint64(1)
            inside = doc[:size] == doc[n - 1 :]
            if n == 1:
                inside &= chars != 0x20
            docs.append(doc[:size][inside])
            features.append((mix(code[inside]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))
        return docs, features, lettered


def _examples(batches):
    """Task: sparse counts of the n-grams of each row."""
    grams = Grams()
    schema = pa.schema([("lang", pa.string()), ("fold", pa.int32()), ("feature", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])
    for rows in batches:
        for first, last, data, bounds in text_slices(rows["text"]):
            docs, features, _ = grams(data, bounds)
            docs, features = np.concatenate(docs), np.concatenate(features)
            cells, counts = np.unique(docs.astype(np.int64) << FEATURE_BITS | features, return_counts=True)
            ends = np.searchsorted(cells, np.arange(last - first + 1) << FEATURE_BITS)
            names = cells & ((1 << FEATURE_BITS) - 1)
            parts = [(names[a:b], counts[a:b] / max(counts[a:b].sum(), 1)) for a, b in zip(ends[:-1], ends[1:])]
            own = rows.slice(first, last - first)
            yield batch(schema, own["lang"], own["fold"], [p[0] for p in parts], [p[1] for p in parts])


def _frequencies(batches):
    """Task: (f, c), how many of its rows have each feature."""
    grams = Grams()
    seen = np.zeros(1 << FEATURE_BITS, np.int64)
    for rows in batches:
        for _, _, data, bounds in text_slices(rows["text"]):
            docs, features, _ = grams(data, bounds)
            cells = np.unique(np.concatenate(docs).astype(np.int64) << FEATURE_BITS | np.concatenate(features))
            seen += np.bincount(cells & (len(seen) - 1), minlength=len(seen))
    used = np.flatnonzero(seen)
    yield batch(pa.schema([("f", pa.int32()), ("c", pa.int64())]), used, seen[used])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return scores / scores.sum(axis=-1, keepdims=True)


def _advance(z: np.ndarray, n: np.ndarray, idf: np.ndarray, languages: list[str]):
    """One pass of FTRL over a shard, from the given state."""

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        own_z, own_n = z.copy(), n.copy()
        bias = len(idf)
        for r in np.random.default_rng(1).permutation(len(rows)):
            feature = np.append(rows["feature"].iloc[r], bias)
            x = np.append(rows["share"].iloc[r] * idf[feature[:-1]] * SCALE, 1.0)
            w = _weights(own_z[feature], own_n[feature])
            error = _softmax(x @ w)
            error[languages.index(rows["lang"].iloc[r])] -= 1
            g = np.outer(x, error)
            grown = own_n[feature] + g * g
            own_z[feature] += g - (np.sqrt(grown) - np.sqrt(own_n[feature])) / ALPHA * w
            own_n[feature] = grown
        return pd.DataFrame({"z": [own_z.tobytes()], "n": [own_n.tobytes()]})

    return train


class Model:
    """Languages in order, feature scores (the last row is the bias), temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, temperature: float = 1.0):
        self.languages, self.table, self.temperature = languages, table, temperature


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, staging: Staging | None = None) -> Model:
    """Fit a model on rows with text and lang. Without any, it knows no language.

    About ``per_language`` rows a language, drawn and dealt to shards by a hash of
    doc_id and text, so copies of a text under other ids are drawn like any rows.
    Document frequencies are counted over all rows.
    """
    staging = staging or Staging(docs.sparkSession)
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, 0), np.float32))
    rates = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / sizes[k]))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(draw < F.element_at(rates, F.col("lang")))
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id", "text", F.lit(37)), F.lit(SHARDS + 2)).cast("int"))
    fields = "lang STRING, fold INT, feature ARRAY<INT>, share ARRAY<FLOAT>"
    sample = staging.table(sample.drop("doc_id").mapInArrow(_examples, fields), "examples")
    training = sample.where(f"fold < {SHARDS}")
    seen = usable.select("text").mapInArrow(_frequencies, "f INT, c BIGINT").groupBy("f").agg(F.sum("c").alias("c")).collect()
    idf = np.zeros(1 << FEATURE_BITS)
    total = sum(sizes.values())
    for r in seen:  # one row per feature at most
        idf[r["f"]] = np.log((1 + total) / (1 + r["c"])) + 1
    shape = (len(idf) + 1, len(languages))
    z, n = np.zeros(shape), np.zeros(shape)
    for _ in range(ROUNDS):
        states = training.groupBy("fold").applyInPandas(_advance(z, n, idf, languages), "z BINARY, n BINARY").collect()
        if not states:
            break
        z = np.mean([np.frombuffer(s["z"]).reshape(shape) for s in states], axis=0)
        n = np.mean([np.frombuffer(s["n"]).reshape(shape) for s in states], axis=0)
    w = _weights(z, n)

    def losses(frames):
        for rows in frames:
            scores = np.array([(s * idf[f] * SCALE) @ w[f] + w[-1] for f, s in zip(rows["feature"], rows["share"])]).reshape(-1, shape[1])
            true = np.array([languages.index(k) for k in rows["lang"]], np.int64)
            lost = [-np.log(_softmax(scores / t)[np.arange(len(true)), true] + 1e-12).sum() for t in TEMPERATURES]
            yield pd.DataFrame({"t": np.arange(len(lost)), "loss": lost})

    held = sample.where(f"fold >= {SHARDS}").mapInPandas(losses, "t INT, loss DOUBLE")
    loss = {r["t"]: r["loss"] for r in held.groupBy("t").agg(F.sum("loss").alias("loss")).collect()}
    temperature = float(TEMPERATURES[min(loss, key=lambda t: (loss[t], t))]) if loss else 1.0
    table = np.vstack([w[:-1] * idf[:, None] * SCALE, w[-1:]]).astype(np.float32)
    return Model(languages, table, temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (in place of columns of these names).

    Only the text is looked at.

    A row without text or letters, or a model without languages, gives ``und``
    with score 0.
    """
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    languages = np.array([*model.languages, UNDETERMINED], dtype=object)

    def task(batches):
        grams = Grams()
        k = len(model.languages)
        for rows in batches:
            for first, last, data, bounds in text_slices(rows["text"]):
                docs, features, lettered = grams(data, bounds)
                n = last - first
                totals = sum(np.bincount(d, minlength=n) for d in docs)
                scores = np.zeros((n, k))
                for d, f in zip(docs, features):
                    present, starts = np.unique(d, return_index=True)
                    if len(d) and k:
                        scores[present] += np.add.reduceat(model.table[f], starts, axis=0)
                scores = scores / np.maximum(totals, 1)[:, None] + model.table[-1]
                known = lettered & (k > 0)
                sure = _softmax(scores / model.temperature) if k else np.zeros((n, 1))
                best = np.where(known, sure.argmax(1), k)
                own = rows.slice(first, n)
                columns = [*own.columns, pa.array(languages[best], pa.string()), pa.array(np.where(known, sure.max(1), 0.0))]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(task, f"{fields}, lang_pred STRING, score DOUBLE")


def held_out(doc_id: str = "doc_id") -> str:
    """SQL text: is the row kept out of training by its doc_id."""
    return f"coalesce(crc32(CAST(CAST({doc_id} AS STRING) AS BINARY)) % 4 = 2, false)"


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(f"doc_id IS NOT NULL AND NOT {held_out()}")
