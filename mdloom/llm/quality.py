"""Quality classifier (8): a linear-chain conditional random field over the lines of a document.

Each line is good (1) or bad (0). Its score comes from features of the line and of both neighbours; a 2 x 2 table scores
neighbouring labels. A document's quality is the mean of its lines' forward-backward marginals, weighted by length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import mix, pieces, resident, small_batches, texts

#: Kinds of bytes: a-z, A-Z, digits, spaces, sentence marks, "!", "|", other ASCII marks, bytes from 0x80, controls.
KINDS = 10
KIND = np.full(256, 9, np.uint8)
for _at, _kind in ((range(0x21, 0x7F), 7), (range(0x61, 0x7B), 0), (range(0x41, 0x5B), 1), (range(0x30, 0x3A), 2), (b" \t\r\x0b\x0c\n", 3), (b".,;:?'\"-()", 4), (b"!", 5), (b"|", 6), (range(0x80, 0x100), 8)):
    KIND[list(_at)] = _kind
OWN = KINDS + 8
WIDTH = 3 * OWN + 3


def line_features(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features [line, WIDTH], bytes of each line, lines of each document); blank lines are left out, but a document
    without other lines has one of no bytes."""
    lines: list[bytes] = []
    counts, again, varied = [], [], []
    for text in docs:
        own = [x for x in text.encode().split(b"\n") if x and not x.isspace()] or [b""]
        seen: dict[bytes, int] = {}
        for x in own:
            seen[x] = seen.get(x, 0) + 1
        again.extend(seen[x] > 1 for x in own)
        for x in own:
            w = x.split()
            varied.append((len(set(w)) / max(1, len(w)), len(w)))
        lines.extend(own)
        counts.append(len(own))
    size = np.array([len(x) for x in lines], np.int64)
    kind = KIND[np.frombuffer(b"\n".join([*lines, b""]), np.uint8)]
    line = np.repeat(np.arange(len(lines)), size + 1)
    per = np.bincount(line * KINDS + kind, minlength=len(lines) * KINDS).reshape(-1, KINDS).astype(float)
    per[:, 3] -= 1  # the line's own end
    blank = kind == 3
    ended = blank[1:] & ~blank[:-1]
    words = np.bincount(line[:-1][ended], minlength=len(lines)).astype(float)
    odd = np.isin(kind[:-1], (2, 5, 6, 7)) & ended
    odd_words = np.bincount(line[:-1][odd], minlength=len(lines))
    n = np.maximum(size, 1)[:, None]
    distinct, in_line = np.array(varied, float).T
    own = np.concatenate([per / n, np.stack([np.log1p(size) / 6, words / n[:, 0] * 4, odd_words / np.maximum(words, 1), np.array(again, float), per[:, 1] / np.maximum(per[:, 0] + per[:, 1], 1), size < 20, distinct, distinct < np.minimum(0.5, 1.5 / np.log2(in_line + 2))], 1)], 1)
    counts = np.array(counts, np.int64)
    first = np.zeros(len(lines), bool)
    first[np.cumsum(counts) - counts] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after, np.ones((len(lines), 1)), first[:, None], last[:, None]], 1), size, counts


def padded(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[document, line] from a flat array, and which places are filled."""
    longest = int(counts.max())
    mask = np.arange(longest) < counts[:, None]
    out = np.zeros((len(counts), longest), values.dtype)
    out[mask] = values
    return out, mask


def forward_backward(score: np.ndarray, mask: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of label 1 [document, line], expected counts of label pairs [document, 2, 2], log of the partition
    function); score: of label 1, with 0 for label 0."""
    docs, longest = score.shape
    unary = np.stack([np.zeros_like(score), score], 2)
    ahead, back = np.empty_like(unary), np.zeros_like(unary)
    ahead[:, 0] = unary[:, 0]
    for t in range(1, longest):
        to = np.logaddexp(ahead[:, t - 1, 0, None] + move[0], ahead[:, t - 1, 1, None] + move[1]) + unary[:, t]
        ahead[:, t] = np.where(mask[:, t, None], to, ahead[:, t - 1])
    pairs = np.zeros((docs, 2, 2))
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    for t in range(longest - 2, -1, -1):
        next_ = unary[:, t + 1] + back[:, t + 1]
        to = np.logaddexp(next_[:, 0, None] + move[:, 0], next_[:, 1, None] + move[:, 1])
        back[:, t] = np.where(mask[:, t + 1, None], to, 0)
        joint = np.exp(ahead[:, t, :, None] + move + next_[:, None, :] - total[:, None, None])
        pairs += np.where(mask[:, t + 1, None, None], joint, 0)
    marginal = np.exp(ahead[:, :, 1] + back[:, :, 1] - total[:, None])
    return np.where(mask, np.clip(marginal, 0, 1), 0), pairs, total


def fit(features: list[np.ndarray], labels: list[int], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, moves) of the most likely labelling in which all lines of a document have its label; Adam over all
    documents, each weighted by one over its lines."""
    counts = np.array([len(x) for x in features], np.int64)
    flat = np.concatenate(features).astype(float)
    y = np.array(labels, float)
    line_y = np.repeat(y, counts)
    share = np.repeat(1 / counts, counts)
    groups = []
    order = np.argsort(counts, kind="stable")
    begin = np.cumsum(counts) - counts
    at = 0
    while at < len(order):  # documents of like length together
        end = at + 1
        while end < len(order) and (end - at + 1) * counts[order[end]] <= max(20_000, 2 * counts[order[at]] * (end - at + 1)):
            end += 1
        groups.append(order[at:end])
        at = end
    index = [np.concatenate([np.arange(begin[d], begin[d] + counts[d]) for d in g]) for g in groups]
    theta = np.zeros(WIDTH + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        move = theta[WIDTH:].reshape(2, 2)
        score = flat @ theta[:WIDTH]
        expected, grad_move = np.empty(len(flat)), np.zeros((2, 2))
        for g, i in zip(groups, index, strict=True):
            s, mask = padded(score[i], counts[g])
            marginal, pairs, _ = forward_backward(s, mask, move)
            expected[i] = marginal[mask]
            seen = (counts[g] - 1).astype(float)
            truth = np.zeros((len(g), 2, 2))
            truth[:, 0, 0], truth[:, 1, 1] = seen * (1 - y[g]), seen * y[g]
            grad_move += ((pairs - truth) / counts[g][:, None, None]).sum(0)
        grad = np.concatenate([((expected - line_y) * share) @ flat, grad_move.ravel()]) / len(counts)
        grad[:WIDTH] += decay * theta[:WIDTH]
        grad[WIDTH:] += 0.05 * theta[WIDTH:]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:WIDTH], theta[WIDTH:].reshape(2, 2)


def line_sample(docs: DataFrame, labels: DataFrame, max_docs: int, max_lines: int) -> DataFrame:
    """Labelled documents to learn from: doc_id, label, features of at most max_lines successive lines, from a place that a hash
    chooses; the first max_docs labelled ids in the order of a hash. labels: doc_id, label."""
    share = min(1.0, (1.2 * max_docs + 100) / max(1, labels.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = labels.where(place <= int(share * (1 << 30))).orderBy(place, "doc_id", "label").limit(max_docs)
    chosen = texts(docs).join(F.broadcast(few), "doc_id")  # at most max_docs rows

    def run(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            x, _, counts = line_features(batch.column("text").to_pylist())
            begin = np.cumsum(counts) - counts + place_in(batch.column("doc_id").to_numpy(), counts - max_lines)
            raw = [x[a : a + n].astype(np.float32).tobytes() for a, n in zip(begin, np.minimum(counts, max_lines), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(raw, pa.binary())], ["doc_id", "label", "features"])

    return chosen.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(run, "doc_id long, label int, features binary")


def place_in(ids: np.ndarray, room: np.ndarray) -> np.ndarray:
    """A place from 0 to room for each id."""
    return (mix(ids.astype(np.uint64)) % (np.maximum(room, 0) + 1).astype(np.uint64)).astype(np.int64)


def learn_quality(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_lines: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """A model from a bounded sample: at most max_lines lines of each of at most max_docs documents reach the driver (of
    rows that repeat an id, each). Labels other than 0 and 1 and null ids are left out; without any, all scores are 0.5."""
    rows = sorted(line_sample(docs, labels.where("doc_id is not null and label in (0, 1)"), max_docs, max_lines).collect(), key=lambda r: (r.doc_id, r.label, r.features))
    if not rows:
        return np.zeros(WIDTH), np.zeros((2, 2))
    return fit([np.frombuffer(r.features, np.float32).reshape(-1, WIDTH) for r in rows], [r.label for r in rows])


def scores_of(texts_: list[str], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    weights, move = model
    x, size, counts = line_features(texts_)
    score = x @ weights
    begin = np.cumsum(counts) - counts
    out = np.empty(len(counts))
    order = np.argsort(counts, kind="stable")
    at = 0
    while at < len(order):
        end = len(order)
        while end - at > 1 and (end - at) * counts[order[end - 1]] > 200_000:
            end = at + (end - at + 1) // 2
        g = order[at:end]
        i = np.concatenate([np.arange(begin[d], begin[d] + counts[d]) for d in g])
        s, mask = padded(score[i], counts[g])
        marginal, _, _ = forward_backward(s, mask, move)
        weight, _ = padded(np.maximum(size[i], 1).astype(float), counts[g])
        out[g] = (marginal * weight).sum(1) / weight.sum(1)
        at = end
    return np.clip(out, 0, 1)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; null, empty and blank texts count as one line of no bytes. Repeated rows
    and null ids are scored like others, equal texts alike; an empty table gives an empty one. Only the id and the text are read,
    so further columns may have any name. No shuffle; long documents are chained line by line in groups of like length, so
    a task's memory follows its longest document."""

    def run(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores_of(batch.column("text").to_pylist(), model))], ["doc_id", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, that score at least least. Each row is judged by its own text, whatever its id; no shuffle."""

    def run(batches):
        import pyarrow as pa

        resident(tuple)
        for batch in batches:
            text = pa.RecordBatch.from_arrays([batch.column(text_col).fill_null("")], ["text"])
            score = [scores_of(piece.column("text").to_pylist(), model) for piece in pieces([text])]
            if score:
                yield batch.filter(pa.array(np.concatenate(score) >= least))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
