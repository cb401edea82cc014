"""Toxicity: gap-weighted subsequence kernel, Nystroem landmarks, support vector machine."""

from __future__ import annotations

import ctypes
import gc
import math
import re
from collections import Counter
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, one_per_id, portions, row_and_text, sample_labelled
from .qda import _platt

#: Letters are a to z (1 to 26); characters outside ASCII share 27 to 31.
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27 + np.arange(128) % 5
_CODES = bytes(_CODE.astype(np.uint8))
_KEPT = bytes(i for i in range(256) if not _CODE[i])
_SPELLED = re.compile(rb"(?<![^\x20\x09-\x0d])(?:[a-z][\x20\x09-\x0d]+){3,}[a-z](?![^\x20\x09-\x0d])")
_SENTENCE = re.compile(rb"[.!?]+(?=[\x20\x09-\x0d])|\n+")
DIM, GAP = 32**3, 0.6
#: Cost of a clean text's word that occurs once, and of an altered insult, against 1 for all insults together.
NEGATIVE, BENT = 0.05, 0.02
JOIN = 10_000
#: Letters that a foreign one is drawn from when a word is altered for training.
FOREIGN = 6


def letters(token: bytes) -> bytes:
    """A mark of the word's start (code 0) and the codes of its letters; what stands between them (digits, dots, stars) is passed over.

    Marks follow a word of one or two letters, so that subsequences of these give triples too.
    """
    word = token.translate(_CODES, _KEPT)
    return b"\0" + (word.ljust(3, b"\0") if word else b"")


def altered(word: bytes) -> list[bytes]:
    """The word with a doubled letter, or one of FOREIGN others, put in at each inner place."""
    return [word[:i] + bytes([c]) + word[i:] for i in range(2, len(word)) for c in dict.fromkeys((word[i - 1], *(1 + (7 * i + word[i - 1] + 5 * k) % 26 for k in range(FOREIGN))))]


def triples(words: np.ndarray, reach: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of all subsequences of three letters within a reach of five: a letter skipped costs a factor GAP.

    words: (n, length) of letter codes. The kernel is normalised by norms().
    """
    length = words.shape[1]
    at = np.array([(i, i + a, i + b) for i in range(length) for a in range(1, reach - 1) for b in range(a + 1, reach) if i + b < length], np.int64).reshape(-1, 3)
    weight = GAP ** (at[:, 2] - at[:, 0] - 2.0)
    return (words[:, at[:, 0]] * 32 + words[:, at[:, 1]]) * 32 + words[:, at[:, 2]], weight


def by_length(words: list[bytes], most: int = 100_000):
    """Index arrays and (n, length) code arrays of the words of each length; a token without a letter is none."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) > 1:
            groups.setdefault(len(w), []).append(i)
    for length, at in groups.items():
        for k in range(0, len(at), step := max(1, most // length)):
            part = at[k : k + step]
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(-1, length).astype(np.int64)


def norms(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Norms of the words' features: weights of equal triples add up."""
    order = np.argsort(code, axis=1)
    code = np.take_along_axis(code, order, 1)
    total = np.cumsum(weight[order], axis=1)
    last = np.ones(code.shape, bool)
    last[:, :-1] = code[:, 1:] != code[:, :-1]
    before = np.zeros(code.shape)
    before[:, 1:] = np.maximum.accumulate(np.where(last, total, 0), axis=1)[:, :-1]
    return np.sqrt((np.where(last, total - before, 0) ** 2).sum(1))


def project(words: list[bytes], onto: np.ndarray, one: bool = False) -> np.ndarray:
    """Inner products of the words' features, scaled to norm 1, with the columns of onto (DIM, m); with `one`, a column of ones behind them."""
    m = onto.shape[1]
    out = np.ones((len(words), m + one), np.float32 if m > 1 else float)
    out[:, :m] = 0
    for at, codes in by_length(words, 100_000 // onto.shape[1]):
        code, weight = triples(codes)
        got = np.einsum("ntm,t->nm", onto[code], weight) if onto.shape[1] > 1 else (onto[:, 0][code] @ weight)[:, None]
        out[np.array(at), :m] = got / norms(code, weight)[:, None]
    return out


def features(words: list[bytes]) -> np.ndarray:
    out = np.zeros((len(words), DIM), np.float32)
    for at, codes in by_length(words):
        code, weight = triples(codes)
        np.add.at(out, (np.array(at)[:, None], code), weight[None, :] / norms(code, weight)[:, None])
    return out


def tokens(text: bytes) -> list[bytes]:
    """Tokens of a lower-cased text, and letters that were spelled apart, joined."""
    found = text.split()
    found += [b"".join(m.split()) for m in _SPELLED.findall(text)]
    return found


class InsultMachine:
    """A linear machine on Nystroem features of words; a text has the three highest margins of its sentences' words.

    Labels belong to texts, of which most sentences are harmless, so training goes round: the word with the
    highest margin stands for a sentence of a positive text, then the machine is fitted anew. Every word of a clean text is a
    negative: those that violate the margin join the rows that are fitted, the worst JOIN of them in a round, those well beyond it leave them,
    and rounds go on, `more` at most, until none is left out. What is held grows with the rows fitted, not with the words.
    """

    def __init__(self, texts: list[str], y: np.ndarray, landmarks: int = 600, rounds: int = 8, more: int = 12):
        self.weight, self.bias, self.slope, self.offset = np.zeros(DIM), 0.0, 0.0, 0.0
        if len(y) == 0 or y.min() == y.max():
            self.offset = 0.0 if len(y) == 0 else (6.0 if y[0] else -6.0)
            return
        index: dict[bytes, int] = {}
        bags, sentences = [], []  # (ids, times) of each text's words; ids of each sentence of a positive text
        for t, k in zip(texts, y, strict=True):
            raw = lower(t)
            ids = [index.setdefault(w, len(index)) for w in map(letters, tokens(raw)) if len(w) > 1]
            bags.append(np.unique(np.array(ids, np.int64), return_counts=True))
            if k:
                found = (np.array([index[w] for w in map(letters, tokens(s)) if w in index], np.int64) for s in _SENTENCE.split(raw))
                sentences += [x for x in found if len(x)]
        words = list(index)
        if not words:
            self.offset = float(np.log(y.mean() / (1 - y.mean())))
            return
        of = lambda c: np.bincount(np.concatenate([b[0] for b, k in zip(bags, y, strict=True) if k == c]), minlength=len(words)).astype(float)
        clean, toxic = of(0), of(1)
        n_clean, n_toxic = int((y == 0).sum()), int((y == 1).sum())
        odds = np.log((toxic + 0.5) / n_toxic) - np.log((clean + 0.5) / n_clean)
        # The labels are noisy, and words are many: only those that positives have far too often (a G test) can stand for one.
        share, both = n_toxic / len(y), toxic + clean
        g = toxic * np.log(np.maximum(toxic, 1) / (share * both)) + clean * np.log(np.maximum(clean, 1) / ((1 - share) * both))
        telling = (2 * g > 20) & (odds > 1)
        third = landmarks // 3
        strong = [i for i in np.argsort(-np.where(telling, g, 0), kind="stable")[:third].tolist() if telling[i]]
        common = np.argsort(-clean, kind="stable")[:third].tolist()
        alike = np.zeros(len(words))
        if strong:
            onto = features([words[i] for i in strong]).T
            for k in range(0, len(words), 4000):
                alike[k : k + 4000] = project(words[k : k + 4000], onto).max(axis=1)
            del onto
        close = np.argsort(-alike * np.log1p(clean) * ~telling, kind="stable")[:third].tolist()
        phi = features([words[i] for i in dict.fromkeys(strong + close + common)])
        seen = np.flatnonzero(phi.any(axis=0))  # triples of no landmark have no part in the map
        value, vector = np.linalg.eigh((phi[:, seen] @ phi[:, seen].T).astype(float))
        keep = value > 1e-6 * value.max()
        basis = np.zeros((DIM, int(keep.sum())), np.float32)  # the Nystroem map
        basis[seen] = phi[:, seen].T @ (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
        del phi
        margin = odds * np.log1p(toxic)
        negatives = np.flatnonzero(clean)
        held = np.union1d(common, negatives[:: max(1, len(negatives) // 4000)])
        low = project([words[i] for i in held], basis, one=True)
        w, before = np.zeros(low.shape[1]), None
        for k in range(rounds + more):
            if k < rounds:
                stands = np.bincount([s[margin[s].argmax()] for s in sentences], minlength=len(words)) if sentences else np.zeros(len(words))
                best = np.flatnonzero((stands > 0) & telling)
                best = best if len(best) else np.flatnonzero(stands)
                if not np.array_equal(best, before):
                    before, bent = best, [v for i in best for v in altered(words[i])]
                    high = project([words[i] for i in best] + bent, basis, one=True)
                times = np.minimum(stands[best], 30.0)
            cost = np.r_[times / max(1.0, times.sum()), np.full(len(bent), BENT), NEGATIVE * np.sqrt(clean[held])]
            w = svm([high, low], np.r_[np.ones(len(high)), -np.ones(len(low))], cost, w)
            self.weight, self.bias = basis @ w[:-1], float(w[-1])
            margin = self.margins(words)
            close = margin[held] > -1.2
            held, low = held[close], low[close]
            new = np.setdiff1d(negatives[margin[negatives] > -1], held)
            new = new[np.argsort(-margin[new], kind="stable")[:JOIN]]
            if len(new):
                low = np.concatenate([low, project([words[i] for i in new], basis, one=True)])
                held = np.r_[held, new]
            elif k >= rounds:
                break
        self.slope, self.offset = _platt(np.array([pooled(zip(margin[ids].tolist(), times.tolist(), strict=True)) for ids, times in bags]), y)
        self.slope = max(self.slope, 0.0)

    def margins(self, words: list[bytes]) -> np.ndarray:
        return project(words, self.weight[:, None])[:, 0] + self.bias

    def score(self, margins) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * pooled(margins) + self.offset, -30, 30))))


def pooled(margins) -> float:
    """Of (margin, times) of a text's words: the three highest occurrences, limited to -1 to 1, the first counting eightfold: one insult is enough."""
    top: list[float] = []
    for m, times in nlargest(3, margins):
        top += [max(-1.0, min(1.0, m))] * min(3 - len(top), times)
    top += [-1.0] * (3 - len(top))
    return (8 * top[0] + top[1] + top[2]) / 10


def svm(parts: list[np.ndarray], y: np.ndarray, cost: np.ndarray, w: np.ndarray, c: float = 1000.0, steps: int = 40, block: int = 4000) -> np.ndarray:
    """Squared-hinge machine by Newton's method from w on. parts: rows, of which the last column is the bias's; cost weighs them; `block` rows at a time are multiplied out."""
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    ends = np.cumsum([0, *map(len, parts)])
    margins = lambda v: np.concatenate([a @ v.astype(a.dtype) for a in parts]).astype(float)
    loss = lambda v, m: 0.5 * v @ (ridge * v) + c * (cost * np.maximum(0, 1 - y * m) ** 2).sum()
    at = margins(w)
    now = loss(w, at)
    for _ in range(steps):
        slack = 1 - y * at
        grad, curve = ridge * w, np.diag(ridge)
        for a, first, last in zip(parts, ends[:-1], ends[1:], strict=True):
            on = first + np.flatnonzero(slack[first:last] > 0)
            for k in range(0, len(on), block):
                i = on[k : k + block]
                part = a[i - first].astype(float)
                grad -= 2 * c * part.T @ (cost[i] * y[i] * slack[i])
                curve += 2 * c * (part.T * cost[i]) @ part
        move = np.linalg.solve(curve, grad)
        step = margins(move)
        rate = 1.0
        while (then := loss(w - rate * move, at - rate * step)) > now and rate > 1e-4:
            rate /= 2
        gain, w, at, now = now - then, w - rate * move, at - rate * step, then
        if gain < 1e-6 * now:
            break
    return w


def lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def _give_back() -> None:
    """Returns what fitting held to the system: the worker lives on, and serves the stages that follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps it for itself


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_chars: int = 20_000) -> InsultMachine:
    """Of labelled documents whose crc32 of the id is not 2 modulo 4: one text of each of at most per_class ids of either class, of at most most_chars.

    So the one task that fits on them holds 2 * per_class texts at most, however often an id is repeated (of its texts that of the smallest hash is taken). Longer texts are scored, but not
    learnt from. Empty texts are learnt from like others; without documents of both classes the score is the same for all.
    """
    schema = pa.schema([("weight", pa.binary()), ("bias", pa.float64()), ("slope", pa.float64()), ("offset", pa.float64()), ("odds", pa.float64())])

    def work(batches):
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True))
        m = InsultMachine([r[1] for r in rows], np.array([r[2] for r in rows], float))
        toxic = sum(r[2] for r in rows)
        odds = math.log(toxic / (len(rows) - toxic)) if 0 < toxic < len(rows) else None
        out = (m.weight.astype(float).tobytes(), m.bias, m.slope, m.offset, odds)
        del rows, m
        _give_back()
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    # The sample goes to one task, not to the driver, which only gets the weights.
    rows = sample_labelled(docs, labels, "toxic", fold(4) != 2, per_class, most_chars).withColumn("h", F.xxhash64("text"))
    found = one_per_id(rows, "text", "h").repartition(1).mapInArrow(work, "weight binary, bias double, slope double, offset double, odds double").collect()
    machine = InsultMachine([], np.zeros(0))
    if found:
        machine.weight, machine.bias, machine.slope, machine.offset = np.frombuffer(found[0].weight), found[0].bias, found[0].slope, found[0].offset
        # The sample has more of the rarer class than the labels have; scores go by the labels' share.
        share = labels.filter((fold(4) != 2) & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
        if found[0].odds is not None and share and 0 < share < 1:
            machine.offset += math.log(share / (1 - share)) - found[0].odds
    return machine


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, keep: list[str] | None = None, **fitting) -> DataFrame:
    """The columns of docs (of keep, if given) as struct `row`, with held_out, score, predicted, for each row.

    Whole texts are scored, a few at a time, however long. Null texts count as empty, whose score is that of a text without insults; empty labels give the
    score one half; an empty table gives no rows; repeated rows and ids are scored alike; the columns of docs are kept in `row`, so no name clashes.
    """
    machine = fit(docs, labels, **fitting)
    schema = pa.schema([("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def work(batches):
        known: dict[bytes, float] = {}
        for batch, texts in portions(batches):
            bags = [Counter(tokens(lower(t))) for t in texts]
            if len(known) > 150_000:
                known.clear()
            new = list(set().union(*bags).difference(known))
            known.update(zip(new, machine.margins([letters(w) for w in new]).tolist(), strict=True))
            score = np.array([machine.score((known[w], k) for w, k in b.items()) for b in bags])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], names=["row", *schema.names])

    rows = row_and_text(docs, keep, (fold(4) == 2).alias("held_out"))
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, held_out boolean, score double, predicted int")
