"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon, whole terms and stems that begin a word, is learned from a bounded sample of labelled documents. Its
trie is intersected with the Levenshtein automaton of each word read: the product is made deterministic as it is
walked, so a word costs one table step per letter and most words end in the dead state after three or four. Every hit is scored
by a window of words around it: other hits nearby raise the score, quotation marks and words of reporting lower it.
A logistic model over the summed window scores, fitted on the same sample, gives the document's score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from folioforge.llm.common import SpanHash, bytes_of, crc_of_id, labelled_sample, mix, read, row_blocks, stage, word_spans

#: At most so many labelled rows are fitted on, and so many lexicon entries kept.
SAMPLE = 12_000
ENTRIES = 1_000
MODULUS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: Words on each side of a hit that its context holds.
WINDOW = 8
STEM_LENGTHS = range(4, 9)
EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "“”«»„‚‘’…–—¡¿"
QUOTES = frozenset("\"“”«»„")
#: Words that report what someone else said.
REPORTING = frozenset(
    "said says quoted quote wrote called calling term word insult slur reported "
    "dit disait cité écrit appelé mot sagte sagt zitiert schrieb genannt wort dijo dice citó escribió llamado palabra".split())
#: The usual stand-ins for letters, read as the letters; a one has two readings.
LOOKALIKES = [str.maketrans("0134578@$!", one) for one in ("oleastbasi", "oieastbasi")]
_STANDING_IN = frozenset("0134578@$!")
#: How a word meets the lexicon, the surest first. LOOSE: edits on the first letter, exchanged neighbours, a second edit or a short term.
MISS, EXACT, STEM, NEAR, FAR_NEAR, LOOSE = 0, 1, 2, 3, 4, 5
#: What a hit of each kind counts.
COUNTS = (1.0, 1.0, 0.6, 0.4, 0.4)
FEATURES = len(COUNTS) + 3


class LexiconAutomaton:
    """Deterministic product of a trie of terms and stems with Levenshtein automata.

    A state is a set of (trie node, edits so far, letter owed, loose): an edit is a letter too many, too few or another, or two
    neighbours exchanged, of which the second is owed then. How many are allowed depends on the length of the entry at the end: one
    from four letters, two from nine. read(word) gives EXACT, STEM (a stem begins it), NEAR (a term of five letters with one edit behind its
    first letter), FAR_NEAR (a stem so), LOOSE (the other terms within their edits, and stems of six letters with one) or MISS.
    """

    def __init__(self, terms: list[str], stems: list[str], long_word: int = 5):
        self.next: list[dict[str, int]] = [{}]
        self.term, self.stem, self.length = [0], [0], [0]
        for kind, words in ((self.term, terms), (self.stem, stems)):
            for w in words:
                node = 0
                for c in w:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        self.term.append(0)
                        self.stem.append(0)
                        self.length.append(self.length[node] + 1)
                    node = self.next[node][c]
                kind[node] = 1
        self.long_word = long_word
        # The length of the longest entry through each node: more edits than that allows lead nowhere.
        self.longest = list(self.length)
        for node in range(len(self.next) - 1, -1, -1):  # a child's number is larger than its parent's
            for child in self.next[node].values():
                self.longest[node] = max(self.longest[node], self.longest[child])
        start = self._close({(0, 0, "", False)})
        self.ids: dict[frozenset, int] = {frozenset(): 0, start: 1}
        self.sets: list[frozenset] = [frozenset(), start]
        self.steps: list[dict[str, int]] = [{}, {}]
        self.final: list[int] = [MISS, MISS]
        self.stemmed: list[int] = [MISS, MISS]

    def edits(self, length: int) -> int:
        return 2 if length >= 9 else 1 if length >= 4 else 0

    def _close(self, states: set[tuple]) -> frozenset:
        """With letters of the entry that the word lacks."""
        more = list(states)
        while more:
            node, e, owed, loose = more.pop()
            if not owed:
                for child in self.next[node].values():
                    new = (child, e + 1, "", loose or not node or e > 0)
                    if e < self.edits(self.longest[child]) and new not in states:
                        states.add(new)
                        more.append(new)
        return frozenset(states)

    def _kind(self, node: int, e: int, owed: str, loose: bool) -> tuple[int, int]:
        """What a state says if the word ends here, and if it goes on."""
        n = self.length[node]
        if owed:
            return MISS, MISS
        ends = begun = MISS
        if self.term[node] and e <= self.edits(n):
            ends = EXACT if e == 0 else NEAR if n >= self.long_word and e == 1 and not loose else LOOSE
        if self.stem[node] and (e == 0 or e == 1 and n > self.long_word):
            begun = STEM if e == 0 else LOOSE if loose else FAR_NEAR
        return ends, begun

    def step(self, state: int, c: str) -> int:
        found = self.steps[state].get(c)
        if found is not None:
            return found
        out: set[tuple] = set()
        for node, e, owed, loose in self.sets[state]:
            if owed:
                if c == owed:
                    out.add((node, e, "", True))
                continue
            if c in self.next[node]:
                out.add((self.next[node][c], e, "", loose))
            if e < self.edits(self.longest[node]):
                out.add((node, e + 1, "", loose or not node or e > 0))  # a letter too many
                for x, child in self.next[node].items():
                    if e < self.edits(self.longest[child]):
                        out.add((child, e + 1, "", loose or not node or e > 0))  # another letter
                        if x != c and c in self.next[child]:
                            out.add((self.next[child][c], e + 1, x, True))  # exchanged with the one behind it
        key = self._close(out)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            kinds = [self._kind(*s) for s in key]
            self.final.append(min((k for k, _ in kinds if k), default=MISS))
            self.stemmed.append(min((k for _, k in kinds if k), default=MISS))
        self.steps[state][c] = self.ids[key]
        return self.ids[key]

    def read(self, word: str) -> int:
        state, begun = 1, MISS
        steps, stemmed = self.steps, self.stemmed
        for c in word:
            nxt = steps[state].get(c)
            state = self.step(state, c) if nxt is None else nxt
            if not state:
                return begun
            if stemmed[state] and (not begun or stemmed[state] < begun):
                begun = stemmed[state]
        ends = self.final[state]
        return min(ends, begun) if ends and begun else ends or begun


def bare(word: str) -> str:
    return word.strip(EDGE)


class Reader:
    """Features of a text; remembers the class of words it has met, up to a bound."""

    def __init__(self, automaton: LexiconAutomaton, remember: int = 200_000):
        self.automaton, self.seen, self.remember = automaton, {}, remember

    def kind(self, token: str) -> int:
        k = self.seen.get(token)
        if k is None:
            word = bare(token)
            k = self.automaton.read(word) if word else MISS
            # Marks that stand for letters are read as such before marks are stripped.
            if k in (MISS, LOOSE) and not _STANDING_IN.isdisjoint(token) and any(c.isalpha() for c in token):
                read = [self.automaton.read(bare(token.translate(t))) for t in LOOKALIKES]
                k = min((NEAR if r == EXACT else r for r in (*read, k) if r), default=MISS)
            if len(self.seen) >= self.remember:
                self.seen.clear()
            self.seen[token] = k
        return k

    def features(self, text: str) -> np.ndarray:
        """Per kind the log of the hits' number, then the log of the summed window scores, their mean, and hits per 100 words."""
        tokens = text.lower().split()
        kind = self.kind
        hits = [(i, k) for i, t in enumerate(tokens) if (k := kind(t))]
        out = np.zeros(FEATURES, np.float64)
        if not hits:
            return out
        quoted = 0.0
        total = 0.0
        for j, (i, k) in enumerate(hits):
            near = 0
            for step in (-1, 1):
                m = j + step
                while 0 <= m < len(hits) and abs(hits[m][0] - i) <= WINDOW:
                    near += 1
                    m += step
            around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
            marks = sum(1 for t in around if t[0] in QUOTES or t[-1] in QUOTES)
            told = sum(1 for t in around if bare(t) in REPORTING)
            score = COUNTS[k - 1] * (1 + 0.5 * min(near, 4)) * (0.3 if marks >= 2 or told else 1.0)
            quoted += marks >= 2 or bool(told)
            total += score
            out[k - 1] += 1
        out[:LOOSE] = np.log1p(out[:LOOSE])
        out[LOOSE] = np.log1p(total)
        out[LOOSE + 1] = 1 - quoted / len(hits)
        out[LOOSE + 2] = np.log1p(100 * total / len(tokens))
        return out


def independent(sample: DataFrame, sketches: int = 4) -> DataFrame:
    """The sample without copies and near copies: of rows that share one of a few minima over word pairs, the first.

    Else the rare words of one much-copied toxic document would look like a lexicon. Only the sketches of the
    sample's rows, whose number is bounded, come to the driver.
    """

    @arrow_udf("array<long>")
    def sketch(texts: pa.Array) -> pa.Array:
        data, off = bytes_of(texts)
        out = np.zeros((len(texts), sketches), np.int64)
        for a, b in row_blocks(off):
            starts, ends, row = word_spans(data[off[a] : off[b]], off[a : b + 1] - off[a])
            if len(row) < 3:
                continue
            same = row[:-2] == row[2:]
            pair = SpanHash(data[off[a] : off[b]])(starts[:-2][same], ends[2:][same])
            at, first = np.unique(row[:-2][same], return_index=True)
            for k in range(sketches if len(at) else 0):
                out[a + at, k] = np.minimum.reduceat(mix(pair + np.uint64(k)), first).astype(np.int64)
        return pa.array(list(out), pa.list_(pa.int64()))

    rows = sample.select("doc_id", "label", sketch("text").alias("s")).collect()
    met: set[tuple] = set()
    ids = []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.s)):
        own = {(r.label, k, v) for k, v in enumerate(r.s) if v}
        if own and not own & met:
            ids.append((r.doc_id,))
        met |= own
    return sample.join(F.broadcast(sample.sparkSession.createDataFrame(ids, "doc_id long")), "doc_id", "left_semi")


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Terms and stems that toxic documents have far more often, from (doc_id, text, label), at most ENTRIES.

    The executors count documents per word and word beginning; only what at least five toxic documents have
    and what is at least 90 % toxic after smoothing by the sample's share comes to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter = Counter()
        neg: Counter = Counter()
        docs = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                words = {w for t in set(text.lower().split()) if 2 < len(w := bare(t)) <= 40}
                found = words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}
                (pos if label else neg).update(found)
                docs[1 if label else 0] += 1
        pos[""], neg[""] = docs[1], docs[0]
        # What is only in clean documents can't become an entry unless other tasks have it in toxic ones: counted there.
        keys = list({*pos, *neg})
        for a in range(0, len(keys), 50_000):
            part = keys[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([pos[k] for k in part], pa.int64()), pa.array([neg[k] for k in part], pa.int64())], ["term", "pos", "neg"])

    counted = sample.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    top = counted.where("term = '' OR (pos >= 5 AND pos >= 6 * neg)").orderBy((F.col("term") != ""), F.desc("pos"), "term").limit(20 * ENTRIES).collect()
    total = next(((r.pos, r.neg) for r in top if r.term == ""), (0, 0))
    if not total[0]:
        return [], []
    odds = total[1] / total[0]
    # Precision as if both classes were of one size, less a clean document as smoothing.
    good = {r.term: (r.pos, r.neg) for r in top if r.term and r.pos * odds >= 9 * (r.neg + 0.5) and r.pos >= max(8, 0.01 * total[0])}
    stems: list[str] = []
    for t in sorted((t for t in good if t.endswith("*")), key=lambda t: (len(t), t)):
        if not any(t[:-1].startswith(s) for s in stems):
            stems.append(t[:-1])
    whole = [t for t in good if not t.endswith("*")]
    # A stem that only one word has says no more than the word itself.
    stems = [s for s in stems if len({w for w in whole if w.startswith(s)}) != 1 or not any(good[w][0] >= 0.9 * good[s + "*"][0] for w in whole if w.startswith(s))]
    terms = [w for w in whole if not any(w.startswith(s) for s in stems)]
    ranked = sorted([(good[t][0], t, 0) for t in terms] + [(good[s + "*"][0], s, 1) for s in stems], key=lambda x: (-x[0], x[1]))[:ENTRIES]
    return [t for _, t, k in ranked if not k], [t for _, t, k in ranked if k]


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the constant last, by Newton steps."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: list[str], stems: list[str], weights: np.ndarray):
        self.terms, self.stems, self.weights, self._reader = terms, stems, weights, None

    def __getstate__(self):
        return self.terms, self.stems, self.weights, None

    def __setstate__(self, state):
        self.terms, self.stems, self.weights, self._reader = state

    def score(self, text: str) -> float:
        if self._reader is None:
            self._reader = Reader(LexiconAutomaton(self.terms, self.stems))
        x = self._reader.features(text)
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))


def fit(sample: DataFrame) -> Model | None:
    """The model from (doc_id, text, label); None if there is no labelled row."""
    sample = stage(sample, "sample")  # read four times below; the whole table is scanned for it once
    terms, stems = learn_lexicon(independent(sample))
    blank = Model(terms, stems, np.zeros(FEATURES + 1))

    @arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        reader = Reader(LexiconAutomaton(blank.terms, blank.stems))
        return pa.array([reader.features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    rows = sample.select("doc_id", "label", features("text").alias("x")).toPandas()
    if rows.empty:
        return None
    blank.weights = fit_logistic(np.stack(rows.x.to_numpy()), rows.label.to_numpy(np.float64))
    return blank


def with_score(docs: DataFrame, model: Model | None, column: str = "toxic_score") -> DataFrame:
    """docs with a score column. Null text counts as empty; without a model every score is 0."""
    if model is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn(column, score(F.coalesce("text", F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Only labels of the other folds are learned from. Null or empty text gets the score of a text without hits;
    null doc_id counts as not held out; repeated rows and rows of equal texts get equal scores; an empty table gives no rows. Texts
    of any length are scored whole, one at a time. Columns other than doc_id and text are not looked at.
    """
    model = fit(labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, SAMPLE))
    return with_score(docs.select("doc_id", "text"), model, "score").select(
        "doc_id", F.coalesce(crc_of_id() % MODULUS == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict = {}
