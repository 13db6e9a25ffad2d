"""A quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import PUNCTUATION, SPACES, Scan, as_bytes, groups, mix, slices

#: Most labelled rows that a model is fitted on, taken in the order of a hash of their ids.
FIT_ROWS = 30_000
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "letters", "upper", "digits", "other_ascii", "beyond_ascii",
    "strokes", "exclaims", "commas", "stops", "upper_words", "same_as_last", "different_words", "different_windows",
    "lines", "same_lines", "line_words", "ended_words", "marked_words",
)


def _flags(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


UPPER = _flags(bytes(range(65, 91)))
LETTER = UPPER | _flags(bytes(range(97, 123)))
DIGIT, STROKE, EXCLAIM, COMMA, STOP = (_flags(x) for x in (b"0123456789", b"#*$%&|<>", b"!", b",", b"."))
BEYOND = np.arange(256) >= 128
MARK = PUNCTUATION & ~SPACES


def _different(s: Scan, hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many different hashes each text has."""
    keys = np.unique(mix(hashes ^ mix(of.astype(np.uint64) + np.uint64(1))))
    # The text is found again through its place in the sorted keys of one row each.
    every = mix(hashes ^ mix(of.astype(np.uint64) + np.uint64(1)))
    at = np.searchsorted(keys, every)
    owner = np.empty(len(keys), np.int64)
    owner[at] = of
    return np.bincount(owner, minlength=len(s.texts))


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text. Ratios of an empty text are 0."""
    s = Scan(texts, SPACES)
    words, size = s.n_words.astype(float), (s.ends - s.starts).astype(float)
    lengths = (s.word_ends - s.word_starts).astype(float)
    hashes = s.word_hashes()
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(texts)), where=np.asarray(b) > 0)
    count = lambda table: s.per_text(table[s.buf]).astype(float)
    mean = ratio(s.per_text_words(lengths), words)
    spread = np.sqrt(np.maximum(ratio(s.per_text_words(lengths**2), words) - mean**2, 0))
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (s.text_of[1:] == s.text_of[:-1])
    windows, at = s.windows(hashes, 3)
    letters, marks = count(LETTER), np.concatenate(([0], np.cumsum(MARK[s.buf])))
    upper = np.concatenate(([0], np.cumsum(UPPER[s.buf])))
    in_word = upper[s.word_ends] - upper[s.word_starts]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines], float)
    last = s.buf[np.maximum(s.word_ends - 1, 0)] if len(hashes) else np.zeros(0, np.uint8)
    return np.stack(
        [
            np.log1p(size), np.log1p(words), mean, spread, ratio(letters, size), ratio(count(UPPER), letters), ratio(count(DIGIT), size),
            ratio(count(MARK), size), ratio(count(BEYOND), size), ratio(count(STROKE), words), ratio(count(EXCLAIM), words),
            ratio(count(COMMA), words), ratio(count(STOP), words), ratio(s.per_text_words((in_word > 1).astype(float)), words),
            ratio(s.per_text_words(same), words), ratio(_different(s, hashes, s.text_of), words),
            ratio(_different(s, windows, s.text_of[at]), np.bincount(s.text_of[at], minlength=len(texts))),
            np.log1p(n_lines), ratio(np.array([len(x) - len(set(x)) for x in lines], float), n_lines), ratio(words, n_lines),
            ratio(s.per_text_words(MARK[last].astype(float)), words),
            ratio(s.per_text_words((marks[s.word_ends] - marks[s.word_starts] > 1).astype(float)), words),
        ],
        1,
    ).astype(np.float32)


class Trees:
    """Complete binary trees of one depth in flat arrays: feature and cut of every inner node, value of every leaf."""

    def __init__(self, depth: int, base: float):
        self.depth, self.base = depth, base
        self.feature, self.cut, self.leaf = np.zeros((0, (1 << depth) - 1), np.int32), np.zeros((0, (1 << depth) - 1), np.float32), np.zeros((0, 1 << depth))

    def add(self, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.feature, self.cut, self.leaf = (np.vstack((a, b[None])).astype(a.dtype) for a, b in ((self.feature, feature), (self.cut, cut), (self.leaf, leaf)))

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        return node - ((1 << self.depth) - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in range(len(self.feature)):
            total += self.leaf[tree, self.leaves(x, tree)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boosts trees on the logistic loss, with gradients summed in histograms over `bins` quantile bins.

    With no rows, or one class only, every score is the (smoothed) share of label 1.
    """
    share = (float(y.sum()) + 0.5) / (len(y) + 1.0)
    model = Trees(depth, float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])  # code > b exactly if x > edges[b]
    total = np.full(len(y), model.base)
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            best = np.full(n, 1e-9)
            local = node - first
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = local * bins + codes[f]
                g, h, c = (np.bincount(cell, w, n * bins).reshape(n, bins).cumsum(1) for w in (grad, hess, None))
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain[(c < least) | (ct - c < least)] = -1
                at = gain[:, : len(e)].argmax(1)
                top = gain[np.arange(n), at]
                better = top > best
                best = np.where(better, top, best)
                feature[first : first + n][better], cut[first : first + n][better] = f, e[at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        place = node - inner
        g, h = np.bincount(place, grad, 1 << depth), np.bincount(place, hess, 1 << depth)
        leaf = -rate * g / (h + ridge)
        model.add(feature, cut, leaf)
        total += leaf[place]
    return model


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _measured(rows: DataFrame, extra: str, kind: str) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            texts = as_bytes(batch.column(1))
            for a, b in groups(texts):
                x = statistics(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(2)[a:b], *(pa.array(x[:, k]) for k in range(len(FEATURES)))], [extra, *FEATURES])

    return rows.mapInArrow(run, f"{extra} {kind}, " + ", ".join(f"{k} float" for k in FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", most: int = FIT_ROWS) -> Trees:
    """Fits the trees on at most `most` labelled rows outside the held-out fold.

    Labels other than 0 and 1, null ids and ids without a document are left out. The sample is the
    first rows by a hash of the id, the same at every size of the corpus; only it is sent to the
    executors (as a broadcast, bounded by `most`), and only its statistics come to the driver, one row for
    an id: of several texts or labels that an id has, the one whose text has the least hash, then the least label.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id", "_label").limit(most)
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    order = F.struct(F.xxhash64("_text").alias("hash"), F.col("_label").alias("label"))
    tagged = rows.select("_doc", "_text", F.struct(F.col("_doc").alias("id"), order.alias("order")).alias("tag"))
    measured = _measured(tagged, "tag", tagged.schema["tag"].dataType.simpleString())
    one = measured.groupBy("tag.id").agg(F.min_by(F.struct(*FEATURES), F.col("tag.order")).alias("x"), F.min("tag.order")["label"].alias("label"))
    table = one.select("label", "x.*").toPandas()
    table = table.sort_values(list(table.columns), kind="stable")
    return fit(table[list(FEATURES)].to_numpy(np.float32), table["label"].to_numpy(float))


def classify(docs: DataFrame, model: Trees, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= threshold).

    Scores come from statistics of the whole text alone, however long it is: a very long text is scanned
    alone. A null text counts as empty; a null id isn't held out; repeated rows each keep a row and get
    the same score; extra columns are ignored, whatever their names; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            texts = as_bytes(batch.column(1))
            for a, b in groups(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(shared.value.score(statistics(texts[a:b])))], [doc_id, "score"])

    source = docs.select(doc_id, F.col(text).cast("string").alias("_text"))
    scored = source.mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, score double")
    return scored.select(doc_id, held_out(F.col(doc_id)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Trees, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            texts = as_bytes(batch.column(place))
            for a, b in groups(texts):
                yield batch.slice(a, b - a).filter(pa.array(shared.value.score(statistics(texts[a:b])) >= threshold))

    return docs.mapInArrow(run, docs.schema)
