"""Subject areas of documents (averaged word and subword embeddings, independent logistic outputs).

A word's vector is the average of the vectors of the word and of its character n-grams, all hashed
into ``BUCKETS`` rows; a sentence's vector is the average of its words'; every subject has its own
logistic output. The model is trained on hand labels, at most ``MOST_LABELLED`` labelled documents
(the documented bound; a hash of doc_id chooses them), cut into ``SHARDS`` shards by that hash. In
each round every shard runs over its sentences from the same weights, in a task of its own, and the
sums of its gradient steps are averaged into the next weights: what is broadcast and what returns
has the model's fixed size. Gradients are thus synchronised once a round of local steps, not once a step,
which would take a job for each of some thousand steps.

Labels belong to documents, say nothing about the single sentence, and some are missing or wrong.
The first ``PLAIN_ROUNDS`` rounds teach every sentence its document's labels; later rounds teach a
sentence what the weights of the round before hold it to be, so that sentences about something
else or about nothing don't blur a subject. Every document is then scored by sentences: its
subjects are those of at least ``SHARE`` of its sentences, two at most.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.session import written

BUCKETS, DIM, SHARDS, MOST_LABELLED = 1 << 15, 24, 4, 6_000
ROUNDS, PLAIN_ROUNDS, PASSES, RATE, SMOOTH, BATCH, SEED = 10, 6, 2, 0.3, 0.02, 64, 17
#: What a sentence the model isn't sure of is taught of its document's labels in later rounds.
UNSURE = 0.1
#: Least align_score from which the other side of a labelled pair is taught the same labels.
ALIGNED = 0.6
GRAMS = (3, 5)
#: A sentence is about its best subject from this probability on.
SURE = 0.4
#: Least share of the sentences for a subject.
SHARE = 1 / 3
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\s\"')\]»”]+|\n+")
_MARKS = re.compile("[̀-ͯ]+")
MOST_SUBJECTS = 1000


def sentences(text: str) -> list[list[str]]:
    """Words of every sentence that holds one, without case and accents."""
    low = text.lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKD", low))
    found = map(_WORD.findall, _SENTENCE.split(low))
    return [[w for w in own if len(w) > 1] for own in found if own]


def rows_of(word: str, buckets: int = BUCKETS) -> list[int]:
    """Rows of a word, of whatever length: its own and its n-grams'."""
    marked = f"<{word}>"
    parts = [word] + [marked[i : i + n] for n in range(GRAMS[0], GRAMS[1] + 1) for i in range(len(marked) - n + 1)]
    return [xxhash.xxh32_intdigest(p) % buckets for p in parts]


class Model:
    """Embedding rows and logistic outputs."""

    def __init__(self, subjects: list[str], embed: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.subjects, self.embed, self.out, self.bias = subjects, embed, out, bias
        self._at: dict[str, int] = {}
        self._vectors = np.zeros((1024, embed.shape[1]), np.float32)

    @classmethod
    def new(cls, subjects: list[str], buckets: int = BUCKETS, dim: int = DIM, seed: int = SEED) -> Model:
        rng = np.random.default_rng(seed)
        return cls(subjects, rng.uniform(-0.5, 0.5, (buckets, dim)).astype(np.float32) / dim, np.zeros((dim, len(subjects)), np.float32), np.full(len(subjects), -2.0, np.float32))

    def _vector(self, word: str) -> int:
        at = self._at.get(word)
        if at is None:
            at = self._at[word] = len(self._at)
            if at >= len(self._vectors):
                self._vectors = np.concatenate((self._vectors, np.zeros_like(self._vectors)))
            rows = np.bincount(rows_of(word, len(self.embed)))  # a very long word has many n-grams but no more rows than the table
            used = np.flatnonzero(rows)
            self._vectors[at] = rows[used].astype(np.float32) @ self.embed[used] / rows.sum()
        return at

    def probabilities(self, many: list[list[str]]) -> np.ndarray:
        """A row of subject probabilities for each sentence (a list of words)."""
        if not many:
            return np.zeros((0, len(self.subjects)), np.float32)
        out = []
        for k in range(0, len(many), 4096):
            part = many[k : k + 4096]
            sizes = np.array([len(s) for s in part])
            if len(self._at) >= 500_000:
                self._at.clear()
            words = [w for s in part for w in s]
            for w in set(words).difference(self._at):
                self._vector(w)
            at = np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))
            sums = np.zeros((len(part), self.embed.shape[1]), np.float32)
            if len(at):
                has = np.flatnonzero(sizes)
                sums[has] = np.add.reduceat(self._vectors[at], (np.cumsum(sizes) - sizes)[has], axis=0)
            z = sums / np.maximum(sizes, 1)[:, None] @ self.out + self.bias
            out.append(1 / (1 + np.exp(-z)))
        return np.concatenate(out)


def sentence_targets(p: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """What sentences are taught in later rounds: their best subject if the model is sure of it, else little
    of their document's labels. A label counts for more than an equally likely other subject."""
    best = (p * np.where(labels > 0, 1.5, 1.0)).argmax(1)
    at = np.arange(len(p))
    sure = p[at, best] >= SURE
    target = labels * UNSURE
    target[sure] = 0
    target[at[sure], best[sure]] = 1
    return target


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + n[i] - 1 of every i, one after the other."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums of the rows of each group; every group has a row."""
    order = np.argsort(group, kind="stable")
    counts = np.bincount(group, minlength=groups)
    return np.add.reduceat(values[order], np.cumsum(counts) - counts, axis=0)


def run_shard(model: Model, many: list[list[str]], labels: np.ndarray, plain: bool, rate: float, seed: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some passes over a shard's sentences with per-coordinate step sizes; the changes of the
    three arrays of weights."""
    embed, out, bias = model.embed.copy(), model.out.copy(), model.bias.copy()
    if plain:
        target = labels * (1 - 2 * SMOOTH) + SMOOTH
    else:
        target = sentence_targets(model.probabilities(many), labels) * (1 - 2 * SMOOTH) + SMOOTH
    target = target.astype(np.float32)
    code: dict[str, int] = {}
    tokens = np.array([code.setdefault(w, len(code)) for s in many for w in s], np.int64)
    sizes = np.array([len(s) for s in many], np.int64)
    first = np.cumsum(sizes) - sizes
    of_word = [rows_of(w, len(embed)) for w in code]
    n_rows = np.array([len(r) for r in of_word], np.int64)
    rows = np.array([r for own in of_word for r in own], np.int64)
    first_row = np.cumsum(n_rows) - n_rows
    seen_e, seen_o, seen_b = np.full(embed.shape, 1e-6, np.float32), np.full(out.shape, 1e-6, np.float32), np.full(bias.shape, 1e-6, np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for batch in np.array_split(rng.permutation(len(many)), max(1, len(many) // BATCH)):
            batch = batch[sizes[batch] > 0]
            if not len(batch):
                continue
            n = sizes[batch]
            at = _ranges(first[batch], n)
            used, where = np.unique(tokens[at], return_inverse=True)
            k = n_rows[used]
            own = rows[_ranges(first_row[used], k)]
            vectors = np.add.reduceat(embed[own], np.cumsum(k) - k, axis=0) / k[:, None].astype(np.float32)
            mean = np.add.reduceat(vectors[where], np.cumsum(n) - n, axis=0) / n[:, None].astype(np.float32)
            error = (1 / (1 + np.exp(-(mean @ out + bias))) - target[batch]) / len(batch)
            back = np.repeat(error @ out.T / n[:, None].astype(np.float32), n, axis=0)
            grad = np.repeat(_sums(back, where, len(used)) / k[:, None].astype(np.float32), k, axis=0)
            touched, to = np.unique(own, return_inverse=True)
            for x, seen, g, at_rows in ((embed, seen_e, _sums(grad, to, len(touched)), touched), (out, seen_o, mean.T @ error, slice(None)), (bias, seen_b, error.sum(0), slice(None))):
                seen[at_rows] += g * g
                x[at_rows] -= rate * g / np.sqrt(seen[at_rows])
    return embed - model.embed, out - model.out, bias - model.bias


def doc_subjects(p: np.ndarray, sure: float = SURE, share: float = SHARE) -> list[tuple[int, float]]:
    """At most two ``(subject, share of the sentences)`` of a document given its sentences' probabilities."""
    if not len(p):
        return []
    best = p.argmax(1)
    counts = np.bincount(best[p[np.arange(len(p)), best] >= sure], minlength=p.shape[1])
    order = np.argsort(-counts, kind="stable")[:2]
    return [(int(k), counts[k] / len(p)) for k in order if counts[k] and counts[k] >= share * len(p) - 1e-9]


def _examples(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int) -> DataFrame:
    """``shard, doc_id, texts, subjects`` of at most about ``most`` labelled documents."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    known = written(known, "labels")
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))
    other = F.when(F.col("align_score") >= ALIGNED, F.col("tgt_text")) if {"align_score", "tgt_text"} <= set(documents.columns) else F.lit(None)
    rows = documents.select("doc_id", F.array_compact(F.array("text", other)).alias("texts")).join(chosen, "doc_id")
    return rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("shard"), "doc_id", "texts", "subjects")


def _round(names: list[str], sent, k: int):
    """The tasks of round ``k``: a task reads whole shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        for shard, frame in pd.concat(frames).groupby("shard") if frames else ():
            frame = frame.assign(order=frame["texts"].map(lambda t: "\n".join(t))).sort_values(["doc_id", "order"], ignore_index=True)
            many, target = [], []
            for texts, own in zip(frame["texts"], frame["subjects"]):
                row = np.isin(names, list(own)).astype(np.float32)
                own_words = [s for text in texts for s in sentences(text)]
                many += own_words
                target += [row] * len(own_words)
            if many:
                change = run_shard(Model(names, *sent.value), many, np.array(target), k < PLAIN_ROUNDS, RATE, 1000 * k + int(shard))
                yield pd.DataFrame({"shard": [int(shard)], "n": [len(many)], "change": [np.concatenate([c.ravel() for c in change]).astype(np.float32).tobytes()]})

    return run


def train(documents: DataFrame, labels: DataFrame, areas: DataFrame, most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS) -> Model:
    """The model; weights start from a fixed seed and shards are sorted, so equal tables give equal
    weights. Labels of unknown subjects or documents are left out; without any label no document
    gets a subject."""
    spark = documents.sparkSession
    names = [r[0] for r in areas.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").limit(MOST_SUBJECTS + 1).collect()]
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    model = Model.new(names)
    if not names:
        return model
    examples = written(_examples(documents, labels, names, most_labelled).repartitionById(SHARDS, F.col("shard")), "examples")

    for k in range(rounds):
        sent = spark.sparkContext.broadcast((model.embed, model.out, model.bias))
        got = sorted(examples.mapInPandas(_round(names, sent, k), "shard int, n long, change binary").collect())  # SHARDS rows of the model's size
        sent.unpersist()
        if not got:
            break
        weight = np.array([r["n"] for r in got], np.float64)
        change = sum(w * np.frombuffer(r["change"], np.float32) for w, r in zip(weight / weight.sum(), got))
        e, o = model.embed.size, model.out.size
        model = Model(names, (model.embed + change[:e].reshape(model.embed.shape)).astype(np.float32), (model.out + change[e : e + o].reshape(model.out.shape)).astype(np.float32), (model.bias + change[e + o :]).astype(np.float32))
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, subject, share, n_chars`` for every subject of every document; a document without a subject has one
    row with null subject. Null and blank texts have none."""
    sent = documents.sparkSession.sparkContext.broadcast((model.subjects, model.embed, model.out, model.bias))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*sent.value)
        for batch in batches:
            of_doc = [sentences(t) if t else [] for t in batch["text"]]
            p = model.probabilities([s for d in of_doc for s in d])
            at, out = 0, []
            for doc, text, own in zip(batch["doc_id"], batch["text"], of_doc):
                size = len(text) if text else 0
                found = doc_subjects(p[at : at + len(own)]) if model.subjects else []
                at += len(own)
                out += [(doc, model.subjects[k], float(x), size) for k, x in found] or [(doc, None, None, size)]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "share", "n_chars"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, subject string, share double, n_chars long")


def scored(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """:func:`train`, then :func:`score` of every document."""
    return score(documents, train(documents, labels, areas))


def composition(scores: DataFrame) -> DataFrame:
    """``subject, documents, chars``: size of the corpus by subject; a document with two subjects counts
    under both, the group without subject has null."""
    return scores.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
