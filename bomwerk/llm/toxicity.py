"""Toxic passages as maximum-scoring segments of token log-odds.

A token is a word or the beginning of one. Its score is the log-odds of toxic against other
documents under a Dirichlet prior that follows the token's frequency in all labelled
documents, taken at the cautious end of its interval, so tokens that a few copies of a
document share weigh little. A word has the strongest score of its tokens; words without
significant tokens have a common, slightly negative score. The linear scan of Ruzzo and Tompa finds all maximal-scoring segments of a text. As scores are
log-likelihood ratios, the best score of n unrelated words has an extreme-value
distribution with scale 1, which turns a segment's score into the number of such
segments expected by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomwerk.llm import batches
from bomwerk.llm.tables import kept, stored

PRIOR = 0.05  # weight of the prior, as a share of the labelled documents
CAUTION = (2.0, 2.5, 3.0, 3.5)  # a token's score is how far its log-odds are beyond so many standard errors; the best number is taken
BEGINNINGS = (7, 6, 5)  # letters
MOST_LABELLED = 40_000  # documents that the word counts use, drawn by hash; bounds the fit only
CALIBRATION = 4  # one labelled document in so many is kept from the counts for the calibration
K = 0.1  # of the extreme-value law
MOST_EVIDENCE = 6.0  # more of it does not bend the calibration; the score still grows with it
EXPECTED = 0.01  # a segment is significant if fewer than so many are expected by chance


class Model:
    """Scores of tokens, the common score of words without one, and the calibration."""

    def __init__(self, scores: dict[str, float], drift: float, weights: Sequence[float] = (0.0, 0.0)):
        self.scores, self.drift, self.weights = scores, drift, weights


def segments(scores: np.ndarray, places: np.ndarray, length: int, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a text of ``length`` words.

    ``places`` are the words with a score of their own, all others have ``drift`` below
    0. One pass with a list of candidates; each step drops or joins candidates, so the
    time is linear in the number of places.
    """
    found: list[list] = []  # start, end, sum before it, sum up to its end
    total, at = 0.0, 0
    for place, score in zip(places.tolist(), scores.tolist(), strict=True):
        total += drift * (place - at)
        at = place + 1
        if score <= 0:
            total += score
            continue
        start, before = place, total
        total += score
        while True:
            # the nearest candidate whose sum before it is lower; those passed over stay
            n = len(found) - 1
            while n >= 0 and found[n][2] >= before:
                n = found[n][4]
            if n < 0 or found[n][3] >= total:
                found.append([start, place + 1, before, total, n])
                break
            start, before = found[n][0], found[n][2]
            del found[n:]
    return [(start, end, total - before) for start, end, before, total, _ in found]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    Counts documents per token over about ``MOST_LABELLED`` labelled ones; the tokens stay
    in Spark but for the significant ones, which are the model. A part of the documents is not counted: on it
    the scores are calibrated, and the caution is chosen that fits best. A document with several labels is toxic if
    one says so; null labels and texts do not count. With one label only, every text
    gets the same score.
    """
    labels = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {row.toxic: row["count"] for row in labels.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Model({}, -1e-6, (0.0, 4.0 if toxic else -4.0))
    # some MOST_LABELLED pairs of two numbers, less than a megabyte, go to every task; no text is shuffled
    drawn = F.broadcast(_drawn(labels, MOST_LABELLED, toxic + clean))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(drawn, "doc_id")
    kept_back = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(CALIBRATION)) == 0
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " ")), " "))
    begun = [F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.lit("^"), F.left(w, F.lit(n)))) for n in BEGINNINGS]
    tokens = rows.where(~kept_back).select("toxic", F.explode(F.array_distinct(F.concat(words, *begun))).alias("token"))
    counts = tokens.where(F.col("token") != "").groupBy("token").agg(F.sum("toxic").alias("in_toxic"), F.count("*").alias("in_all"))
    share = min(1.0, MOST_LABELLED / (toxic + clean)) * (1 - 1 / CALIBRATION)
    n1, n0 = toxic * share, clean * share
    weight = PRIOR * (n1 + n0)
    prior = PRIOR * F.col("in_all")
    y1, y0 = F.col("in_toxic") + prior, F.col("in_all") - F.col("in_toxic") + prior
    odds = F.log(y1 / F.greatest(F.lit(n1 + weight) - y1, F.lit(0.5))) - F.log(y0 / F.greatest(F.lit(n0 + weight) - y0, F.lit(0.5)))
    z = odds / F.sqrt(1 / y1 + 1 / y0)
    strong = (
        counts.where(F.col("in_all") > 1).select("token", odds.alias("odds"), z.alias("z"))
        .where(F.abs("z") >= CAUTION[0]).collect()  # of the words of a bounded sample
    )
    # in a toxic passage about one word in twenty is one of the model's
    drift = math.log(0.95)
    examples = stored(rows.where(kept_back).select("text", "toxic"), "toxic-examples")  # a quarter of a bounded sample
    best = None
    for caution in CAUTION:
        model = Model({row.token: row.odds * (1 - caution / abs(row.z)) for row in strong if abs(row.z) >= caution}, drift)
        points = evidence(examples, model).select("evidence", "toxic").collect()
        *model.weights, loss = _logistic(np.array([p[0] for p in points]), np.array([p[1] for p in points], dtype=float))
        if best is None or loss < best[0]:
            best = loss, model
    return best[1]


def _drawn(rows: DataFrame, most: int, count: int) -> DataFrame:
    if count <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / count))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, offset and mean loss of a logistic curve through the points, slightly regularised, by damped Newton steps."""
    if not len(x) or y.min() == y.max():
        return 0.0, (4.0 if len(y) and y[0] else -4.0), 0.0
    x = np.clip(x, -50.0, MOST_EVIDENCE)

    def loss(at: np.ndarray) -> float:
        z = at[0] * x + at[1]
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.05 * at[0] ** 2)

    at = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        w = p * (1 - p) + 1e-9
        slope = np.array([((y - p) * x).sum() - 0.1 * at[0], (y - p).sum()])
        curve = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(curve + 1e-6 * np.eye(2), slope)
        while np.abs(step).max() > 1e-7 and loss(at + step) > loss(at):
            step = step / 2
        if np.abs(step).max() <= 1e-7:
            break
        at = at + step
    return float(at[0]), float(at[1]), loss(at) / len(y)


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``evidence`` and ``passages`` (start, end, score, expected) beside all other columns.

    Start and end count words, runs of letters; the end is exclusive. ``passages`` are
    all significant segments in order. ``evidence`` adds up minus the logarithm of the
    expected number of chance segments over them, or is that of the best segment if none
    is significant. A null or empty text has no passage. Columns with the names of the
    results are replaced.
    """
    columns = kept(docs, "evidence", "passages")
    rows = docs.select(*columns)
    kind = "array<struct<start:int,end:int,score:double,expected:double>>"
    schema = rows.withColumns({"evidence": F.lit(0.0), "passages": F.array().cast(kind)}).schema
    scores, drift = model.scores, model.drift
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in batches.slices(batch):
                codes, words, starts = batches.split(batches.plain(part.column("text")))
                own = np.array([_strongest(word, scores) for word in words])
                scored = own[codes] if len(codes) else np.zeros(0)
                hits = np.flatnonzero(scored)
                edges = np.searchsorted(hits, starts)
                totals, lists = [], []
                for n in range(part.num_rows):
                    places = hits[edges[n] : edges[n + 1]]
                    length = int(starts[n + 1] - starts[n])
                    found = segments(scored[places], places - starts[n], length, drift) if len(places) else []
                    total, passages = _aggregate(found, length)
                    totals.append(total)
                    lists.append(passages)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(totals, pa.float64()), pa.array(lists, pa.list_(passage))], names=[*columns, "evidence", "passages"]
                )

    return rows.mapInArrow(run, schema)


def _strongest(word: str, scores: dict[str, float]) -> float:
    own = [scores.get(word, 0.0), *(scores.get("^" + word[:n], 0.0) for n in BEGINNINGS if len(word) > n)]
    return max(own, key=abs)


def _aggregate(found: list[tuple[int, int, float]], length: int) -> tuple[float, list[dict]]:
    chance = math.log(K * max(1, length))
    passages = [
        {"start": start, "end": end, "score": score, "expected": math.exp(min(50.0, chance - score))}
        for start, end, score in found
        if chance - score <= math.log(EXPECTED)
    ]
    best = max((score for *_, score in found), default=0.0)
    return (sum(p["score"] - chance for p in passages) if passages else best - chance), passages


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``evidence``, ``passages`` and the calibrated ``score`` from 0 to 1.

    An empty text has a score too, that of a text without evidence. A column named
    ``score`` is replaced.
    """
    slope, offset = model.weights
    # beyond the fitted range the curve runs out slowly, so that no two evidences share a score
    beyond = F.greatest(F.col("evidence") - MOST_EVIDENCE, F.lit(0.0))
    inner = F.greatest(F.least(F.col("evidence"), F.lit(MOST_EVIDENCE)), F.lit(-50.0)) + F.log1p(beyond)
    curve = 1 / (1 + F.exp(-(F.lit(slope) * inner + F.lit(offset))))
    rows = evidence(docs, model)
    return rows.select(*kept(rows, "score"), curve.alias("score"))
