"""Secrets in texts: three fixed patterns, and a character convolutional network that looks at every other candidate too.

The patterns (see KINDS) give the base findings. A candidate is a longest stretch of the characters of CANDIDATE, LEAST or more of
them, that holds a digit, a capital after a small letter, or LONG characters, or that a base finding touches. It is read in chunks of
CHUNK characters, each with AROUND characters of text on both sides, to its end however long it is.

The network, in numpy: an embedding of each character, a convolution over five of them, the maximum over each zone (before, chunk,
after), one hidden layer, and a logit for each kind. It learns which kinds of base findings touch a chunk, from all distinct chunks of
all rows but those held back (a quarter, by hash); each also with its surroundings blanked. The chunks are dealt by hash into buckets of
about BUCKET, to which those of a rare label are copied until each bucket has some. In each of ROUNDS rounds every bucket goes on from
the common state over all of its chunks, and the next state is the mean over the buckets, summed in whole numbers so that the order of
tasks doesn't count. From all chunks held back come a logistic curve for each kind (calibration) and the kind's threshold, the highest
probability that still finds `recall` of the held-back findings. A kind without findings to learn from is never added.

A candidate that no base finding touches gets the kinds whose threshold its best chunk reaches, as further findings. Offsets are code
points. A null text is an empty one, without findings; rows are judged by themselves, so null and repeated ids and rows do no harm;
further columns are not read; an empty table gives an empty one. Findings are in order of start, then kind as listed, so ties are settled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import pieces, texts, written

#: The base patterns, in order, and the least length of what counts (of group 2 for the first, of the whole for the others).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "api")

LEAST, LONG, CHUNK, AROUND, STEP = 8, 20, 64, 32, 48
RECALL, WIDTH, FILTERS, HIDDEN, DIM = 0.95, 5, 16, 16, 8
BUCKET, ROUNDS, STEPS, BATCH, SOME, SCALE, BINS = 2048, 8, 100, 64, 16, 1 << 40, 1000
RATE = 0.005
ZONES = ((0, AROUND - 2), (AROUND - 2, AROUND - 2 + CHUNK), (AROUND - 2 + CHUNK, 2 * AROUND + CHUNK - WIDTH + 1))
_OF = np.zeros(128, np.uint8)  # 1 small letter, 2 capital, 3 digit, 4 sign
_OF[[*range(97, 123)]], _OF[[*range(65, 91)]], _OF[[*range(48, 58)]], _OF[[ord(c) for c in "+/_.=-"]] = 1, 2, 3, 4


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base findings, in order."""
    low = text.lower()
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def characters(text: str) -> np.ndarray:
    """Code points, those beyond ASCII (and the null) as 1."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((codes > 127) | (codes == 0), 1, codes).astype(np.uint8)


def candidates(chars: np.ndarray, base: list[tuple[int, int, int]]) -> np.ndarray:
    """(start, end) of the candidates."""
    kind = _OF[chars]
    inside = np.concatenate([[0], (kind > 0).view(np.int8), [0]])
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - start >= LEAST
    start, end = start[keep], end[keep]
    mark = kind == 3
    mark[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
    marks = np.concatenate([[0], np.cumsum(mark)])
    keep = (marks[end] - marks[start] > 0) | (end - start >= LONG)
    for a, _, b in base:
        keep |= (start < b) & (end > a)
    return np.stack([start[keep], end[keep]], axis=1)


def windows(chars: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidate number, window) of the chunks of candidates; a window is what is before, the chunk, what is after, each filled up with 0."""
    owner, start = [], []
    for k, (a, b) in enumerate(found.tolist()):
        at = range(a, max(a + 1, b - CHUNK + STEP), STEP)
        owner += [k] * len(at)
        start += at
    owner, start = np.array(owner, np.int64), np.array(start, np.int64)
    end = np.minimum(start + CHUNK, found[owner, 1]) if len(owner) else start
    out = np.zeros((len(start), 2 * AROUND + CHUNK), np.uint8)
    padded = np.concatenate([np.zeros(AROUND, np.uint8), chars, np.zeros(CHUNK + AROUND, np.uint8)])
    out[:, :AROUND] = padded[start[:, None] + np.arange(AROUND)]
    chunk = padded[AROUND + start[:, None] + np.arange(CHUNK)]
    out[:, AROUND : AROUND + CHUNK] = np.where(np.arange(CHUNK) < (end - start)[:, None], chunk, 0)
    out[:, AROUND + CHUNK :] = padded[AROUND + end[:, None] + np.arange(AROUND)]
    return owner, out


class Network:
    """The convolutional network: logits of windows, and a fit by Adam."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        shapes = {"embed": (128, DIM), "conv": (WIDTH * DIM, FILTERS), "conv_b": (FILTERS,), "hidden": (3 * FILTERS + 1, HIDDEN), "hidden_b": (HIDDEN,), "out": (HIDDEN, len(KINDS)), "out_b": (len(KINDS),)}
        self.p = {k: (r.normal(0, 1 / np.sqrt(s[0] if k != "embed" else 1), s) if len(s) == 2 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.p["embed"][0] = 0
        self.first, self.second = {k: 0 * v for k, v in self.p.items()}, {k: 0 * v for k, v in self.p.items()}

    def forward(self, x: np.ndarray) -> tuple:
        p = self.p
        e = p["embed"][x]
        n = x.shape[1] - WIDTH + 1
        columns = np.concatenate([e[:, j : j + n] for j in range(WIDTH)], axis=2)
        z = columns @ p["conv"] + p["conv_b"]
        best = np.stack([a + z[:, a:b].argmax(axis=1) for a, b in ZONES], axis=1)
        top = np.take_along_axis(z, best.reshape(len(x), -1)[:, :, None].reshape(len(x), 3, FILTERS), axis=1)
        size = (x[:, AROUND : AROUND + CHUNK] > 0).mean(axis=1, keepdims=True, dtype=np.float32)
        features = np.concatenate([np.maximum(top, 0).reshape(len(x), -1), size], axis=1)
        h = np.maximum(features @ p["hidden"] + p["hidden_b"], 0)
        return columns, best, top, features, h, h @ p["out"] + p["out_b"]

    def logits(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + block])[-1] for i in range(0, len(x), block)]) if len(x) else np.empty((0, len(KINDS)), np.float32)

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean of weight * cross entropy."""
        p = self.p
        columns, best, top, features, h, out = self.forward(x)
        d = (1 / (1 + np.exp(-out)) - y) * weight / len(x)
        g = {"out": h.T @ d, "out_b": d.sum(axis=0)}
        dh = (d @ p["out"].T) * (h > 0)
        g |= {"hidden": features.T @ dh, "hidden_b": dh.sum(axis=0)}
        dtop = (dh @ p["hidden"].T)[:, :-1].reshape(top.shape) * (top > 0)
        rows = np.arange(len(x))[:, None, None]
        used = columns[rows, best]
        g |= {"conv": np.matmul(used.transpose(2, 3, 0, 1).reshape(FILTERS, WIDTH * DIM, -1), dtop.transpose(2, 0, 1).reshape(FILTERS, -1, 1))[..., 0].T, "conv_b": dtop.sum(axis=(0, 1))}
        dused = dtop[..., None] * p["conv"].T[None, None]
        at = x[rows[..., None], best[..., None] + np.arange(WIDTH)].astype(np.int64)[..., None] * DIM + np.arange(DIM)
        g["embed"] = np.bincount(at.ravel(), dused.ravel(), p["embed"].size).reshape(p["embed"].shape).astype(p["embed"].dtype)
        g["embed"][0] = 0
        return g

    def state(self) -> np.ndarray:
        """Weights and the two means of Adam, in one row."""
        return np.concatenate([v.ravel() for part in (self.p, self.first, self.second) for v in part.values()]).astype(np.float64)

    def take(self, state: np.ndarray) -> Network:
        at = 0
        for part in (self.p, self.first, self.second):
            for k, v in part.items():
                part[k] = state[at : at + v.size].reshape(v.shape).astype(np.float32)
                at += v.size
        return self

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, done: int = 0, seed: int = 7) -> int:
        """One round over all windows by Adam, after so many steps; returns the steps done. Half of each batch has a label, so that few
        findings count as much as many; the fewer come round more than once, and a small set is gone through until STEPS steps are."""
        r = np.random.default_rng(seed)
        sides = [s for s in (np.flatnonzero(y.any(axis=1)), np.flatnonzero(~y.any(axis=1))) if len(s)]
        share = BATCH // len(sides)
        steps = max(STEPS, -(-max(map(len, sides)) // share))
        order = [np.concatenate([r.permutation(s) for _ in range(-(-steps * share // len(s)))]) for s in sides]
        for i in range(steps):
            at = np.concatenate([o[i * share : (i + 1) * share] for o in order])
            t = done + i + 1
            for k, g in self.gradient(x[at], y[at], weight[at]).items():
                self.first[k] = 0.9 * self.first[k] + 0.1 * g
                self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
                self.p[k] = (self.p[k] - RATE * (self.first[k] / (1 - 0.9**t)) / (np.sqrt(self.second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return done + steps


class Scanner:
    """A network with a logistic curve and a threshold for each kind; off where a kind had nothing to learn from."""

    def __init__(self) -> None:
        self.curve, self.threshold = np.tile(np.array([1.0, 0.0]), (len(KINDS), 1)), np.full(len(KINDS), 2.0)
        self.network = Network()

    def probability(self, logit: np.ndarray, kind: int) -> np.ndarray:
        a, b = self.curve[kind]
        return 1 / (1 + np.exp(-np.clip(a * logit + b, -500, 500)))

    def kinds(self, x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Which of n candidates reach which kind's threshold with some chunk."""
        out = np.zeros((n, len(KINDS)), bool)
        logits = self.network.logits(x).astype(np.float64)
        for k in range(len(KINDS)):
            np.logical_or.at(out[:, k], owner, self.probability(logits[:, k], k) >= self.threshold[k])
        return out


def labelled_chunks(docs: DataFrame) -> DataFrame:
    """Chunks of all candidates: chunk (its window), label (a bit for each kind of base finding that touches it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            chunks, labels = [], []
            for text in batch.column("text").to_pylist():
                base = base_findings(text)
                chars = characters(text)
                found = candidates(chars, base)
                owner, x = windows(chars, found)
                bits = np.zeros(len(found), np.int32)
                for a, kind, b in base:
                    bits |= np.where((found[:, 0] < b) & (found[:, 1] > a), 1 << kind, 0).astype(np.int32)
                chunks += [row.tobytes() for row in x]
                labels.append(bits[owner])
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array(np.concatenate(labels) if labels else [], pa.int32())], ["chunk", "label"])

    return texts(docs).select("text").mapInArrow(run, "chunk binary, label int")


def dealt(chunks: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """bucket, rows: chunks (chunk, label, hash) in buckets of about BUCKET, one row each; sizes: how many there are of each label.
    Chunks of a label that is too rare to give SOME to each bucket go to several, those of fewer to all."""
    n = max(1, -(-sum(sizes.values()) // BUCKET))
    copies = F.coalesce(*(F.when(F.col("label") == k, min(n, max(1, -(-SOME * n // size)))) for k, size in sorted(sizes.items())))
    there = chunks.withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int")))).withColumn("bucket", F.pmod(F.pmod("hash", F.lit(n)) + F.floor(F.col("copy") * n / copies), F.lit(n)))
    return there.repartition(min(n, 4096), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("hash", "label", "chunk"))).alias("rows")).select("bucket", "rows.label", "rows.chunk")


def windows_of(chunks: list[bytes], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Windows and, for each, what kinds of findings touch it."""
    x = np.frombuffer(b"".join(chunks), np.uint8).reshape(len(chunks), 2 * AROUND + CHUNK)
    return x, (np.array(labels, np.int64)[:, None] >> np.arange(len(KINDS)) & 1).astype(np.float32)


def trained(buckets: DataFrame) -> Network:
    """The network after ROUNDS rounds over all buckets; the driver gets the sums of their states, one number per weight."""
    network, done = Network(), 0
    for number in range(ROUNDS):
        state = network.state()

        def run(batches: Iterator[pa.RecordBatch], state: np.ndarray = state, done: int = done, number: int = number) -> Iterator[pa.RecordBatch]:
            total, n, steps = np.zeros(len(state), np.int64), 0, 0
            for batch in batches:
                for row in range(batch.num_rows):
                    bucket, labels, chunks = (batch.column(c)[row].as_py() for c in range(3))
                    x, y = windows_of(chunks, labels)
                    blank = x.copy()
                    blank[:, :AROUND] = blank[:, AROUND + CHUNK :] = 0
                    weight = np.ones_like(y)
                    blind = weight.copy()
                    blind[:, 0] = y[:, 0] == 0  # without its surroundings, an assigned value needn't be known for one
                    own = Network().take(state)
                    steps += own.learn(np.concatenate([x, blank]), np.concatenate([y, y]), np.concatenate([weight, blind]), done, bucket * ROUNDS + number) - done
                    total += np.rint(own.state() * SCALE).astype(np.int64)
                    n += 1
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([steps], pa.int64())], ["total", "n", "steps"])

        parts = buckets.mapInArrow(run, "total array<long>, n long, steps long")
        sums = parts.select(F.posexplode(F.concat("total", F.array("n", "steps")))).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()
        *total, n, steps = (r.s for r in sums)
        network.take(np.array(total, np.float64) / SCALE / n)
        done += steps // n
    return network


def logits_of(chunks: DataFrame, network: Network) -> DataFrame:
    """z (a logit for each kind), label, held: of chunks (chunk, label, held)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, _ = windows_of(part.column(0).to_pylist(), part.column(1).to_pylist())
                z = pa.array(network.logits(x).astype(np.float64).ravel())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(KINDS), pa.int32()), z), part.column(1), part.column(2)], ["z", "label", "held"])

    return chunks.select("chunk", "label", "held").mapInArrow(run, "z array<double>, label int, held boolean")


def logistic(scores: DataFrame, rounds: int = 50) -> np.ndarray:
    """(a, b) of 1 / (1 + exp(-(a z + b))) over scores (z, hit) by Newton's method, with targets drawn in from 0 and 1 so that it has
    an end; each step takes the sums over all scores, grouped by no key."""
    n, hits = scores.agg(F.count("*"), F.count_if("hit")).first()
    goal = F.when(F.col("hit"), (hits + 1) / (hits + 2)).otherwise(1 / (n - hits + 2))
    z, ab = F.col("z"), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z * float(ab[0]) + float(ab[1])))))
        sums = scores.select("z", (p * (1 - p)).alias("w"), (p - goal).alias("e")).agg(*(F.sum(c) for c in (F.col("w") * z * z, F.col("w") * z, F.col("w"), F.col("e") * z, F.col("e")))).first()
        step = np.linalg.solve(np.array([[sums[0], sums[1]], [sums[1], sums[2]]]) + 1e-6 * np.eye(2), np.array(sums[3:]))
        ab = ab - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-7:
            break
    return ab


def nth_least(values: DataFrame, n: int) -> float:
    """The n-th least (from 1) of a column v, exactly: the values are counted in BINS bins, then those of the bin that holds it."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        bins = values.where(F.col("v").between(low, high)).groupBy(F.floor((F.col("v") - low) / (high - low) * BINS).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for r in sorted(bins.collect()):
            if n <= r.n:
                low, high = r.low, r.high
                break
            n -= r.n
    return low


def learn_secrets(docs: DataFrame, recall: float = RECALL) -> Scanner:
    """A scanner from all distinct chunks; the driver gets counts, sums and one number per weight."""
    chunks = labelled_chunks(docs).groupBy("chunk").agg(F.bit_or("label").alias("label")).withColumn("hash", F.xxhash64("chunk"))
    chunks = written(chunks.withColumn("held", F.pmod(F.shiftright("hash", 20), F.lit(4)) == 0), "secret-chunks")
    sizes = {(r.label, r.held): r.n for r in chunks.groupBy("label", "held").agg(F.count("*").alias("n")).collect()}
    scanner = Scanner()
    if not any(label for label, _ in sizes):
        return scanner
    learn = all(held for _, held in sizes)  # what is learned from: those not held back, if any
    scanner.network = trained(written(dealt(chunks.where(F.col("held") == learn), {k: n for (k, held), n in sizes.items() if held == learn}), "secret-buckets"))
    scores = written(logits_of(chunks, scanner.network), "secret-scores")
    for k in range(len(KINDS)):
        hits = {held: sum(n for (label, h), n in sizes.items() if h == held and label >> k & 1) for held in (True, learn)}
        at = True if hits[True] else learn
        if not hits[at]:
            continue
        own = scores.where(F.col("held") == at).select(F.col("z")[k].alias("z"), (F.col("label").bitwiseAND(1 << k) > 0).alias("hit"))
        scanner.curve[k] = a, b = logistic(own)
        line = nth_least(own.where("hit").select((F.col("z") * float(a) + float(b)).alias("v")), hits[at] - int(np.ceil(recall * hits[at])) + 1)
        scanner.threshold[k] = 1 / (1 + np.exp(-np.clip(line, -500, 500)))
    return scanner


def find_secrets(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, base, findings: the base findings, and these with what the scanner adds; each (kind, start, end). docs: doc_id, text."""

    def listed(found: list[list[tuple[int, int, int]]]) -> pa.Array:
        flat = [f for row in found for f in row]
        items = pa.StructArray.from_arrays([pa.array([KINDS[k] for _, k, _ in flat], pa.string()), pa.array([a for a, _, _ in flat], pa.int64()), pa.array([b for _, _, b in flat], pa.int64())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32()), items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            base, found, chunks, owners = [], [], [], []
            for text in batch.column("text").to_pylist():
                known = base_findings(text)
                chars = characters(text)
                spans = candidates(chars, known)
                owner, x = windows(chars, spans)
                base.append(known)
                found.append(spans)
                chunks.append(x)
                owners.append(owner)
            first = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
            owner = np.concatenate([o + f for o, f in zip(owners, first[:-1], strict=True)]) if owners else np.empty(0, np.int64)
            reach = scanner.kinds(np.concatenate(chunks) if chunks else np.empty((0, 2 * AROUND + CHUNK), np.uint8), owner, int(first[-1]))
            every = []
            for known, spans, at in zip(base, found, first[:-1].tolist(), strict=True):
                added = [(a, k, b) for i, (a, b) in enumerate(spans.tolist()) for k in np.flatnonzero(reach[at + i]).tolist() if not any(s < b and e > a for s, _, e in known)]
                every.append(sorted(known + added))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed(base), listed(every)], ["doc_id", "base", "findings"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    return texts(docs).mapInArrow(run, f"doc_id long, base {kind}, findings {kind}")
