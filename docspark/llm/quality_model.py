"""A quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

A text's features are the n-grams (one and two words) of its words, and of its words' shapes: letters, digits and
signs, runs collapsed, so that words never seen still tell.  Features are hashed into ``2**BITS`` slots; their
values are damped counts, scaled to length one.  Training is online (FTRL-Proximal, one pass over a bounded
sample, in hash order of the ids); scoring is a sparse dot product, and runs where the texts are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches, tidy
from docspark.llm.words import gram_hashes, mix, text_groups, word_hashes

BITS = 18
MAX_TRAINING_ROWS = 10_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1


def _shape_table() -> bytes:
    table = bytearray(range(256))
    for i in range(256):
        c = chr(i)
        table[i] = ord("a") if i >= 128 or "a" <= c <= "z" else ord("A") if "A" <= c <= "Z" else ord("0") if "0" <= c <= "9" else i
    return bytes(table)


_SHAPES = _shape_table()


def features(texts: list[str | None]) -> list[tuple]:
    """(slots, values) of each text; an empty text has only the constant slot 0."""
    import numpy as np

    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    shapes = []
    for r in raw:
        b = np.frombuffer(r.translate(_SHAPES), np.uint8)
        shapes.append(b[np.concatenate([[True], b[1:] != b[:-1]])].tobytes() if len(b) else b"")
    views = []
    for kind, side in enumerate((raw, shapes)):
        words, bounds = word_hashes(side)
        views.append((kind, words, gram_hashes(words, 2), bounds))
    out = []
    for i in range(len(texts)):
        parts, values = [np.zeros(1, np.int64)], [np.ones(1)]
        for kind, words, pairs, bounds in views:
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            for salt, h in ((2 * kind, words[lo:hi]), (2 * kind + 1, pairs[lo : max(lo, hi - 1)])):
                if len(h):
                    slots = (mix(h + np.uint64(salt)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    slots, counts = np.unique(slots, return_counts=True)
                    v = np.sqrt(counts)
                    parts.append(slots)
                    values.append(v / np.sqrt((v * v).sum()))
        out.append((np.concatenate(parts), np.concatenate(values)))
    return out


class Ftrl:
    """FTRL-Proximal for logistic loss over ``2**BITS`` slots."""

    def __init__(self):
        import numpy as np

        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, slots=slice(None)):
        import numpy as np

        z, n = self.z[slots], self.n[slots]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, slots, values, label: int) -> None:
        import numpy as np

        w = self.weights(slots)
        g = (probability(w @ values) - label) * values
        n = self.n[slots]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        np.add.at(self.z, slots, g - sigma * w)
        np.add.at(self.n, slots, g * g)


def probability(x: float) -> float:
    import math

    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves remainder 1 by 3: such rows never train.  False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = MAX_TRAINING_ROWS,
) -> bytes:
    """Weights (little-endian 32-bit floats) learnt from at most ``max_rows`` labelled rows that are not held out.

    The rows are those with the smallest hashes of their ids, in that order; ids labelled both ways count with the
    smaller label.  Neither the id nor any column but the text is a feature.  No labelled row: all weights are zero.
    """
    bounded_batches(df.sparkSession)
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
        .where(~held_out("_id") & F.col("_label").isin(0, 1) & F.col("_id").isNotNull())
        .groupBy("_id").agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # max_rows ids and labels: bounded by the parameter
    rows = texts.join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text"), "_text").limit(max_rows)

    def learn(batches):
        import numpy as np
        import pyarrow as pa

        model = Ftrl()
        for batch in batches:
            answers = iter(batch.column("_label").to_pylist())
            for group in text_groups(batch.column("_text").to_pylist()):
                for slots, values in features(group):
                    model.learn(slots, values, next(answers))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], ["weights"])

    got = rows.select("_text", "_label").coalesce(1).mapInArrow(learn, "weights binary").collect()
    return bytes(got[0].weights) if got else bytes(4 << BITS)


def score(df: DataFrame, weights: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Result, one row a document: ``<id_col>``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if score >= 0.5).

    The columns in ``keep`` go along unread, so that a row need not be looked for again by its id.  A null or empty text
    scores by the constant alone; an empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(weights)  # 4 bytes a slot: one MB
    carried = [F.col(c).alias(f"_kept{i}") for i, c in enumerate(keep)]
    slim = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *carried)

    def rate(batches):
        import numpy as np
        import pyarrow as pa

        w = np.frombuffer(model.value, "<f4").astype(np.float64)
        for batch in batches:
            out = []
            for group in text_groups(batch.column(1).to_pylist()):
                out += [probability(float(w[slots] @ values)) for slots, values in features(group)]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out, pa.float64())], [*names, "score"])

    schema = "".join(f"{name} {kind}, " for name, kind in slim.dtypes if name != "_text")
    got = slim.mapInArrow(tidy(rate), f"{schema}score double")
    kept = [F.col(f"_kept{i}").alias(c) for i, c in enumerate(keep)]
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return got.select(*([] if id_col in keep else [F.col("_id").alias(id_col)]), *kept, held_out("_id").alias("held_out"), "score", predicted)


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``score`` over ``df`` with weights fitted on its labelled rows."""
    return score(df, fit(df, labels, id_col, text_col), id_col, text_col, keep)
