"""Toxicity by a noisy channel: Viterbi decoding of character lattices, then a score of the restored text.

A token that is plain letters is its own only reading. Any other token (leetspeak, marks between letters, letters
set apart by blanks, letters repeated) becomes a lattice: each character can stand for itself or for letters it
is used for, a mark or blank between letters for nothing or for the end of a word, a run of one letter for one or two
of it. A character trigram model, trained on the labelled texts, and fixed channel costs choose the reading, once as
one word and once with words ended. The token is scored as written, as read, by each word read, and by each part
between its marks or its wider blanks. A word without weight that has doubled letters is scored as any word that it
gives with its runs shortened, too.

Words and word beginnings carry P(toxic | it occurs in the text), estimated on labelled texts and shrunk to the base
rate. A text's score is the highest of its words, so length neither hides nor adds toxicity; without any such word it
is the share of toxic texts among the labelled ones that have none.

Defined cases: null, empty and letterless texts get that share. Rows that repeat are scored alike. Without labelled
rows every score is 0.1, a fixed prior. Other columns are never read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_shared

# The letters that a character is commonly written for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "µ": "u", "*": "aeiou",
}

#: Costs in nats: of a lookalike, of leaving a mark out, of shortening a run, of keeping a character that is no letter.
SWAP, SKIP, SHORTEN, ALIEN = 1.0, 0.5, 0.7, 9.0
#: Beginnings of these lengths are features beside whole words.
BEGINNINGS = (4, 5, 6)
CACHED_TOKENS = 300_000
#: Labels up to this many are broadcast, some 20 MB.
BROADCAST_LABELS = 1_000_000
#: Texts whose features are counted in a task before the counts go to Spark.
COUNTED_TEXTS = 2_000
#: The reading of marks and blanks that ends a word.
BREAK = " "
APART = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S(?!\S)){2,}")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: What parts of a token are apart by: marks without blanks, or blanks wider than those between its letters.
RUNS, DOUBLED = re.compile(r"(.)\1*", re.S), re.compile(r"(.)\1", re.S)
MARKS, WIDE = re.compile(r"[\W_]+"), re.compile(r"\s{2,}")
PRIOR = 0.1


def parts_of(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [word, *[word[:n] + "*" for n in BEGINNINGS if len(word) > n]]


def runs_of(word: str) -> tuple[str, list[int]]:
    """A word with each run of a letter as one letter, and the lengths of the runs."""
    runs = [(m.group(1), len(m.group())) for m in RUNS.finditer(word)]
    return "".join([c for c, _ in runs]), [n for _, n in runs]


def tokens(text: str) -> set[str]:
    """Distinct lower-cased tokens without marks at their ends; letters set apart by blanks are one token, blanks kept."""
    text = text.lower()
    out = set()
    for t in set(text.split()):
        if t.isalpha():
            out.add(t)
        else:
            out.add(EDGES.sub("", t))
            if t[0] in LOOKALIKES or t[-1] in LOOKALIKES:
                out.add(t)
    if APART.search(text):
        out.update(m.group() for m in APART.finditer(text))
    out.discard("")
    return out


class CharacterModel:
    """Trigrams of letters in words, with add-one smoothing on bigrams below them."""

    def __init__(self, trigrams: dict[str, int]):
        self.three = trigrams
        self.two: Counter = Counter()
        self.after: Counter = Counter()
        for t, n in trigrams.items():
            self.two[t[:2]] += n
            self.after[t[1:]] += n
        self.letters = max(26, len({c for t in trigrams for c in t}))
        self.total = sum(trigrams.values()) or 1
        self.known: dict[str, float] = {}

    def cost(self, trigram: str) -> float:
        found = self.known.get(trigram)
        if found is None:
            low = (self.after.get(trigram[1:], 0) + 1) / (self.total + self.letters * self.letters)
            found = self.known[trigram] = -math.log((self.three.get(trigram, 0) + 20 * low * self.letters) / (self.two.get(trigram[:2], 0) + 20))
        return found


def lattice(token: str, breaks: bool = False) -> list[list[tuple[str, float]]]:
    """For each run of a character its readings with their costs; with breaks, marks and blanks can end a word."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m.group(1), len(m.group())
        if c.isalpha():
            out.append([(c, 0.0 if n == 1 else SHORTEN * (4 - min(n, 3))), *([(c * 2, 0.0 if n == 2 else SHORTEN)] if n > 1 else [])])
        else:
            readings = [(x, SWAP * n) for x in LOOKALIKES.get(c, "")] + ([(x * 2, SWAP * 2) for x in LOOKALIKES.get(c, "")] if n > 1 else [])
            if not (c.isalnum() and readings):
                readings.append(("", 0.0 if c.isspace() else ALIEN if c.isalnum() else SKIP))
            if breaks and not c.isalnum():
                readings.append((BREAK, 0.0 if c.isspace() else SKIP))
            out.append(readings)
    return out


def decode(token: str, model: CharacterModel, breaks: bool = False) -> str:
    """The cheapest reading of a token under the channel and the character model; with breaks, its words with BREAK between them.

    A break costs what the model asks for the end of one word and the start of the next. Texts are kept as chains of
    their letters, so time is in proportion to the token's length.
    """
    states: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    for readings in lattice(token, breaks):
        best: dict[str, tuple[float, tuple | None]] = {}
        for state, (cost, text) in states.items():
            for letters, extra in readings:
                total, s = cost + extra, state
                if letters == BREAK:
                    if s == "^^":  # no word has begun
                        continue
                    total += model.cost(s + "$")
                    s = "^^"
                else:
                    for c in letters:
                        total += model.cost(s + c)
                        s = s[1] + c
                if s not in best or total < best[s][0]:
                    best[s] = (total, (text, letters) if letters else text)
        states = best
    _, text = min(((cost + (0.0 if breaks and s == "^^" else model.cost(s + "$")), text) for s, (cost, text) in states.items()), key=lambda x: x[0], default=(0.0, None))
    out = []
    while text is not None:
        text, letters = text
        out.append(letters)
    return "".join(reversed(out))


class Scorer:
    def __init__(self, model: dict):
        self.weights: dict[str, float] = model["weights"]
        self.base: float = model["base"]
        self.characters = CharacterModel(model["trigrams"])
        self.known: dict[str, float] = {}
        self.before: dict[str, float] = {}
        # what words and beginnings become with runs as one letter -> their runs and weights
        self.short: dict[str, list[tuple[list[int], float]]] = {}
        for part, weight in self.weights.items():
            letters, runs = runs_of(part.rstrip("*"))
            self.short.setdefault(letters + part[len(part.rstrip("*")) :], []).append((runs, weight))

    def shortened(self, word: str) -> float:
        """The highest weight of the words and beginnings that the word gives with its runs shortened."""
        letters, runs = runs_of(word)
        found = [w for n, w in self.short.get(letters, ()) if all(map(int.__ge__, runs, n))]
        for k in range(1, min(len(letters), max(BEGINNINGS)) + 1):
            for n, w in self.short.get(letters[:k] + "*", ()):
                if all(map(int.__ge__, runs, n)) and (k < len(letters) or runs[k - 1] > n[-1]):
                    found.append(w)
        return max(found, default=0.0)

    def word(self, word: str) -> float:
        found = max([self.weights.get(p, 0.0) for p in parts_of(word)])
        return found if found or not DOUBLED.search(word) else self.shortened(word)

    def readings(self, token: str) -> list[str]:
        if token.isascii() and token.isalpha() and not re.search(r"(.)\1\1", token):
            return [token]
        plain = re.sub(r"[^\w]|_", "", "".join(c for c in unicodedata.normalize("NFKC", token) if unicodedata.category(c) != "Cf"))
        if plain == token and plain.isalpha() and not re.search(r"(.)\1\1", plain):
            return [token]
        normal = unicodedata.normalize("NFKC", token)
        words = decode(normal, self.characters, breaks=True).split(BREAK) if MARKS.search(normal) else []
        return list(dict.fromkeys([token, decode(normal, self.characters), *words]))

    def parts(self, token: str) -> list[str]:
        """The parts between the marks of a token without blanks, between the wider blanks of one with blanks."""
        found = [x for x in (WIDE if any(map(str.isspace, token)) else MARKS).split(token) if x]
        return found if len(found) > 1 else []

    def token(self, token: str) -> float:
        found = self.before.get(token)
        if found is None:
            found = max([self.word(word) for word in self.readings(token)], default=0.0)
            for part in self.parts(token):
                found = max(found, self.token(part) if part not in self.known else self.known[part])
        if len(self.known) >= CACHED_TOKENS:
            self.known, self.before = {}, self.known
        self.known[token] = found
        return found

    def text(self, text: str | None) -> float:
        best = 0.0
        for t in tokens(text or ""):
            found = self.known.get(t)
            if found is None:
                found = self.token(t)
            if found > best:
                best = found
        return max(best, self.base)


def known_labels(labels: DataFrame, label: str = "toxic", id_col: str = "doc_id") -> DataFrame:
    """(id, label): labels other than 0 and 1 are left out; of several labels of an id the highest counts."""
    return labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("label"))


def labelled_texts(docs: DataFrame, known: DataFrame, labels: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(label, text) of every labelled document. Up to BROADCAST_LABELS labels are broadcast, so no text is shuffled; more go through a shuffle with the texts."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return texts.join(F.broadcast(known) if labels <= BROADCAST_LABELS else known, "id").select("label", "text")


def learn(labelled: DataFrame, base: float, least_texts: int = 8, least_chance: float = 0.9, most_features: int = 20_000, shrink: float = 0.5) -> dict:
    """Features and trigrams, counted over all of labelled(label, text); the model's base is 0 yet. base: the share of toxic texts.

    Texts that hold a feature are counted in tasks and summed by Spark; the driver gets at most most_features features,
    and the letter trigrams of the alphabet seen (a closed set, cut at 200,000), the highest of the whole counts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, COUNTED_TEXTS) for b in batches for i in range(0, b.num_rows, COUNTED_TEXTS)):
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            letters: Counter = Counter()
            known: dict[str, list[str]] = {}  # words -> their parts
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for w in tokens(t) if w.isalpha()]
                for w in words:
                    if w not in known:
                        known[w] = parts_of(w)
                counts[y].update(set().union(*[known[w] for w in words]))
            for w in known:
                k = counts[0][w] + counts[1][w]
                w = f"^^{w}$"
                for i in range(len(w) - 2):
                    letters[w[i : i + 3]] += k
            features = list(counts[0].keys() | counts[1].keys())
            columns = [["f"] * len(features) + ["t"] * len(letters), [*features, *letters], [*[counts[1][f] for f in features], *letters.values()], [counts[0][f] for f in features] + [0] * len(letters)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i > 1 else pa.string()) for i, c in enumerate(columns)], names=["kind", "what", "yes", "no"])

    sums = labelled.mapInArrow(count, "kind string, what string, yes long, no long").groupBy("kind", "what").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    chance = (F.col("yes") + shrink * base) / (F.col("yes") + F.col("no") + shrink)
    useful = F.when(F.col("kind") == "f", (F.col("yes") >= least_texts) & (chance >= least_chance)).otherwise(F.col("yes") >= 2)
    found = write_shared(sums.where(useful).withColumn("p", chance), "features")
    features = {r.what: r.p for r in found.where("kind = 'f'").orderBy(F.desc("p"), F.desc("yes"), "what").limit(most_features).collect()}
    trigrams = {r.what: r.yes for r in found.where("kind = 't'").orderBy(F.desc("yes"), "what").limit(200_000).collect()}
    return {"weights": features, "base": 0.0, "trigrams": trigrams}


def base_score(scored: DataFrame) -> float:
    """How often a labelled text without any of the features is toxic, from (label, score) of all labelled texts."""
    toxic, n = scored.where("score = 0").agg(F.sum("label"), F.count(F.lit(1))).first()
    return min(0.49, ((toxic or 0) + 0.05) / (n + 1))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_col: str = "doc_id", **options) -> dict:
    """The model from all labelled documents. options: those of learn."""
    known = known_labels(labels, label, id_col)
    total, toxic = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total:
        return {"weights": {}, "base": PRIOR, "trigrams": {}}
    labelled = write_shared(labelled_texts(docs, known, total, text, id_col), "labelled")
    model = learn(labelled, toxic / total, **options)
    return model | {"base": base_score(score(labelled, model, "label"))}


def judge(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """score(docs, train(docs, labels)), but each text is scored once: the base score comes from the scores of all rows."""
    known = known_labels(labels, label, id_col)
    total, toxic = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total:
        return score(docs, {"weights": {}, "base": PRIOR, "trigrams": {}}, id_col, text)
    model = learn(labelled_texts(docs, known, total, text, id_col), toxic / total, **options)
    found = write_shared(score(docs, model, id_col, text), "scores")
    base = base_score(found.where("score = 0").select(F.col(id_col).alias("id"), "score").join(known, "id"))
    return predicted(found.withColumn("score", F.greatest("score", F.lit(base))))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, score, predicted) for each row; predicted is 1 from 0.5 on."""
    rows = docs.select(id_col, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_features and 200,000 trigrams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.text(t) for t in batch.column(1).to_pylist()], pa.float64())], names=[id_col, "score"])

    out = rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, score double")
    return predicted(out)


def predicted(scored: DataFrame) -> DataFrame:
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
