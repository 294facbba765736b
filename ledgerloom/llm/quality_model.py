"""Quality classifier: a linear support vector machine on naive-Bayes-scaled n-gram indicators.

Features are indicators of hashed n-grams: one and two words, and one to three word shapes. A shape tells the kind of a word's
first character, its capitals, its last character, whether it holds a symbol, and whether the word repeats the one before.

1. Over all labelled training rows, counts of each feature by class give its log-count ratio.
2. Indicators are scaled by these ratios and each document's vector to length one; a hinge-loss
   model with squared loss is fitted by dual coordinate descent, one document's multiplier at a time.
   The fit takes a bounded sample: the ``SAMPLE`` labelled training rows of the smallest 128-bit hashes of id, text and label.
3. On a fifth of the sample, kept out of the fit, a logistic curve turns margins into scores.

The sample, its order in the fit and the fifth all go by that hash, so the model does not depend on how rows are laid out or
on tasks that are repeated.

The model has a fixed size (one weight per hashed feature). All documents are scored on whole texts.

Defined results: a null or empty text, having no features, gets the score of the constant term; labels that are null are ignored;
without both labels in the training rows every score is 0.5; repeated rows are scored each for themselves; a null id is
not held out; an empty table gives an empty table; further columns are kept, except that columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.hashing import BLANKS, joined, lut, mixed, powers, runs, span_hashes
from ledgerloom.llm.shared import split_by_ids, stored, text_blocks

FEATURES = 1 << 18
SAMPLE = 20_000
EPOCHS, COST = 12, 1.0
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(texts: list[bytes]):
    """The distinct features of each text."""
    import numpy as np

    data, starts = joined(texts)
    inside = ~BLANKS[data]
    begins, ends = runs(inside)
    words = span_hashes(data[inside], ends - begins)
    bounds = np.searchsorted(begins, starts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))

    def among(chars: bytes):
        """How many bytes of each word are among ``chars``."""
        total = np.concatenate([[0], np.cumsum(lut(chars)[data])])
        return total[ends] - total[begins]

    upper, digits = bytes(range(65, 91)), bytes(range(48, 58))
    kind = np.zeros(256, np.uint64)
    kind[list(upper)], kind[list(digits)], kind[128:] = 1, 2, 3
    kind[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
    last = data[ends - 1].astype(np.uint64)
    last = np.where(kind[data[ends - 1]] == 4, last, np.uint64(0))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (text_of[1:] == text_of[:-1])
    capitals = np.minimum(among(upper), 2) + 3 * (2 * among(upper) >= ends - begins)
    symbols = among(b"#*$%&|<>") > 0
    shape = kind[data[begins]] + np.uint64(8) * (capitals.astype(np.uint64) + np.uint64(8) * (last + np.uint64(256) * (symbols + 2 * again).astype(np.uint64)))
    shape = mixed(shape + np.uint64(1))

    grams = []
    for sequence, longest, salt in ((words, 2, 11), (shape, 3, 23)):
        for size in range(1, longest + 1):
            count = max(0, len(sequence) - size + 1)
            total = np.full(len(sequence), salt + size, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(size):
                    total[:count] += sequence[k : k + count] * powers(8)[k + 1]
            ids = (mixed(total) % np.uint64(FEATURES)).astype(np.int64)
            # A gram must end within its text.
            whole = np.zeros(len(sequence), bool)
            whole[:count] = text_of[:count] == text_of[size - 1 :]
            grams.append(np.where(whole, ids, -1))
    grams = np.stack(grams, axis=1) if len(words) else np.empty((0, 5), np.int64)
    seen = np.empty(FEATURES, np.int64)
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        ids = grams[a:b].ravel()
        ids = ids[ids >= 0]
        # Of equal ids the one written last stays.
        seen[ids] = np.arange(len(ids))
        found.append(ids[seen[ids] == np.arange(len(ids))])
    return found


def vector(ids, ratios):
    """Places and values of a document's scaled vector, the constant term last."""
    import numpy as np

    values = ratios[ids]
    return np.append(ids, FEATURES), np.append(values / (np.sqrt(values @ values) or 1.0), 1.0)


def dual_descent(rows, labels, epochs: int, cost: float, seed: int = 0):
    """Weights of the L2-regularized squared-hinge machine over ``rows`` (places, values); labels are 1 and -1."""
    import numpy as np

    weights, alpha = np.zeros(FEATURES + 1), np.zeros(len(rows))
    # Positives and negatives weigh the same in sum.
    share = np.where(labels > 0, (labels > 0).mean(), (labels < 0).mean())
    diagonal = share * 2 / (2 * cost)
    squares = np.array([v @ v for _, v in rows]) + diagonal
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            places, values = rows[i]
            gradient = labels[i] * (weights[places] @ values) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / squares[i])
            if new != alpha[i]:
                weights[places] += (new - alpha[i]) * labels[i] * values
                alpha[i] = new
    return weights


def logistic_curve(margins, labels, steps: int = 50):
    """Slope and intercept of the curve that gives the labels' odds, by Newton steps with smoothed targets."""
    import numpy as np

    positive, negative = (labels > 0).sum(), (labels < 0).sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hessian, [(g * margins).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fold(draw: str) -> int:
    """Which fifth of the sample a row's draw, 32 hexadecimal digits, falls into."""
    return int(draw[-8:], 16) % 5


def log_count_ratios(training: DataFrame):
    """The ratio of each feature from all training rows (``text``, ``label``); all zero unless both labels occur."""
    import numpy as np

    def counted(batches):
        import pyarrow as pa

        counts = np.zeros((2, FEATURES), np.int64)
        rows_of = np.zeros(2, np.int64)
        for rows, texts in text_blocks(batches):
            for label, ids in zip(rows.column(rows.schema.get_field_index("label")).to_pylist(), features(texts)):
                counts[label][ids] += 1
                rows_of[label] += 1
        used = np.flatnonzero(counts.any(axis=0))
        columns = [np.append(used, FEATURES), *(np.append(counts[k][used], rows_of[k]) for k in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["feature", "n0", "n1"])

    counts = training.mapInArrow(counted, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    # At most one row per hashed feature, and one with the numbers of documents.
    table = counts.toArrow()
    totals = np.zeros((2, FEATURES + 1))
    for k in (0, 1):
        totals[k][np.asarray(table["feature"])] = np.asarray(table[f"n{k}"])
    if not totals[:, FEATURES].all():
        return np.zeros(FEATURES)
    smoothed = totals[:, :FEATURES] + 1.0
    smoothed /= smoothed.sum(axis=1, keepdims=True)
    return np.log(smoothed[1] / smoothed[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """``(ratios, weights, slope, intercept)`` learnt from the labelled rows that are not held out."""
    import numpy as np

    known = labels.filter(~held_out(F.col("doc_id"))).filter("quality IN (0, 1)")
    known = known.select("doc_id", F.col("quality").cast("int").alias("label"))
    # Only texts that have a label are shuffled, and once.
    labelled, _ = split_by_ids(docs.select("doc_id", "text"), "doc_id", known)
    draw = F.md5(F.concat_ws("\n", F.col("doc_id").cast("string"), F.col("label").cast("string"), "text"))
    training = stored(labelled.join(known, "doc_id").withColumn("draw", draw), "training")
    ratios = log_count_ratios(training.select("text", "label"))
    if not ratios.any():
        return ratios, np.zeros(FEATURES + 1), 0.0, 0.0
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    # The sample's last draw is found among draws alone, so only the sample's features move. Rows of one draw are equal.
    last = training.select("draw").orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    drawn = training.filter(F.col("draw") <= last).select("draw", "text", "label")

    def featured(batches):
        import pyarrow as pa

        for block, texts in text_blocks(batches):
            kept = [block.column(block.schema.get_field_index(c)) for c in ("draw", "label")]
            ids = pa.array([ids.astype("<i4").tobytes() for ids in features(texts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, ids], ["draw", "label", "ids"])

    chosen = drawn.mapInArrow(featured, "draw string, label int, ids binary").orderBy("draw").limit(sample)

    def fitted(batches):
        import numpy as np
        import pyarrow as pa

        sample = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        rows = [vector(np.frombuffer(ids, "<i4").astype(np.int64), shared.value) for _, _, ids in sample]
        labels = np.array([label for _, label, _ in sample]) * 2 - 1
        aside = np.array([fold(draw) == 4 for draw, _, _ in sample])
        if len(set(labels[~aside])) < 2:
            aside[:] = False
        weights = dual_descent([r for r, x in zip(rows, aside) if not x], labels[~aside], EPOCHS, COST)
        curve = aside if len(set(labels[aside])) == 2 else ~aside
        margins = np.array([weights[p] @ v for (p, v), x in zip(rows, curve) if x])
        a, b = logistic_curve(margins, labels[curve])
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()], pa.binary()), pa.array([a]), pa.array([b])], ["weights", "slope", "intercept"]
        )

    model = chosen.repartition(1).mapInArrow(fitted, "weights binary, slope double, intercept double").first()
    return ratios, np.frombuffer(model["weights"], np.float64), model["slope"], model["intercept"]


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the text, with ``held_out``, ``score`` (higher: better) and ``predicted``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    results = ("held_out", "score", "predicted")
    columns = [c for c in docs.columns if c not in ("text", *results)]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("score", T.DoubleType())])

    def scored(batches):
        import numpy as np
        import pyarrow as pa

        ratios, weights, slope, intercept = model.value
        scaled = weights[:FEATURES] * ratios
        for rows, texts in text_blocks(batches):
            margins = np.array([
                scaled[ids].sum() / (np.sqrt((ratios[ids] ** 2).sum()) or 1.0) + weights[FEATURES] for ids in features(texts)
            ])
            score = 1 / (1 + np.exp(-np.clip(slope * margins + intercept, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in columns), pa.array(score)], [*columns, "score"])

    read = docs.select(*[F.col(f"`{c}`") for c in columns], "text").mapInArrow(scored, schema)
    return read.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
