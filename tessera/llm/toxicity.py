"""Toxicity by a lexicon that tolerates misspelling, and the context of its hits.

The lexicon (whole words and word stems) is learned from labelled texts. Levenshtein automata of all its longer terms, intersected with its trie, run as one
deterministic table, made as far as words need it, that reads all distinct words of a group of texts a character at a time, in numpy; a word whose state dies is dropped. What a misspelt
hit of a term is worth is learned too. Each hit gets a context score from the words and quotation marks around it, whose weights are learned from hits in clean and in
toxic texts. A logistic model over a text's hits gives its score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_groups, worker_cache
from tessera.llm.langid import Words

#: Labelled training texts of each class, those with the smallest hashes, and the characters of a longer text that teach, at a place its hash chooses.
TRAIN_DOCS, TRAIN_CHARS = 1_500, 20_000
#: Terms learned at most (the strongest; on the test corpora some 150 qualify), texts that a term needs, how much more often toxic texts must hold it, and the least log
#: likelihood ratio, above what chance makes of some 100,000 candidate terms.
TERMS, SUPPORT, LIFT, RATIO = 2_000, 4, 6.0, 20.0
#: Shortest and longest stem, and the shortest term that may be misspelt by one edit.
STEM, LONGEST, FUZZY = 4, 9, 5
#: Words on either side of a hit that make its context, how many context words are learned at most, and how much more often they must stand by hits in clean texts.
WINDOW, CONTEXTS, CONTEXT_LIFT = 6, 500, 3.0
#: Pseudo-counts: of hits of a misspelt term, and of quoted hits in clean texts (so marks on both sides speak for quotation before any evidence).
PRIOR, QUOTED = 2.0, 4.0
THRESHOLD = 0.3
QUOTES = "\"'“”„«»‘’‹›"
#: The mark context, listed beside the context words.
MARKED = "\x00marks"


class Automaton:
    """Trie of the lexicon times Levenshtein automata, made deterministic as far as the words read so far need it.

    An item is (trie node, edits so far), or (-1 - term, edits) in a stem's tail. Terms of at least FUZZY letters may be reached with one edit (substitution, insertion or
    deletion); a stem needs only the beginning of a word. ``accept`` holds for each state the term and edits of the best match when the word ends there: fewest edits, then the first term."""

    def __init__(self, words: list[str], stems: list[str]):
        self.terms = [*words, *stems]
        self.children: list[dict[str, int]] = [{}]
        self.fuzzy = [False]
        self.ends: dict[int, int] = {}
        self.stem_ends: dict[int, int] = {}
        for i, term in enumerate(self.terms):
            node = 0
            self.fuzzy[0] |= len(term) >= FUZZY
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.fuzzy.append(False)
                node = self.children[node][c]
                self.fuzzy[node] |= len(term) >= FUZZY
            (self.ends if i < len(words) else self.stem_ends)[node] = i
        self.alphabet = ["", *sorted({c for t in self.terms for c in t})]  # class 0: any other character
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.table = np.full((64, len(self.alphabet)), -1, np.int32)
        self.accept = np.full((64, 2), -1, np.int32)
        self._number(frozenset())
        self._number(self._entered([(0, 0)]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "classes"}

    def __getattr__(self, name: str):
        if name != "classes":
            raise AttributeError(name)
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in self.alphabet[1:]]] = np.arange(1, len(self.alphabet))
        return self.classes

    def _entered(self, items: list[tuple[int, int]]) -> frozenset:
        """The items, what deletions (a letter of the term left out) reach from them, and the tails of stems that end here; of two with the same place the one with fewer edits."""
        items = items + [(child, 1) for node, edits in items if edits == 0 and node >= 0 for child in self.children[node].values() if self.fuzzy[child]]
        for node, edits in list(items):
            term = self.stem_ends.get(node)
            if term is not None and (edits == 0 or len(self.terms[term]) >= FUZZY):
                items.append((-1 - term, edits))
        exact = {node for node, edits in items if edits == 0}
        return frozenset(x for x in items if x[1] == 0 or x[0] not in exact)

    def _moved(self, state: frozenset, c: str) -> frozenset:
        out = []
        for node, edits in state:
            if node < 0:
                out.append((node, edits))
                continue
            if c in self.children[node]:
                out.append((self.children[node][c], edits))
            if edits == 0:
                out += [(child, 1) for letter, child in self.children[node].items() if letter != c and self.fuzzy[child]]
                if self.fuzzy[node]:
                    out.append((node, 1))
        return self._entered(out)

    def _number(self, state: frozenset) -> int:
        if state in self.numbers:
            return self.numbers[state]
        number = self.numbers[state] = len(self.states)
        self.states.append(state)
        if number == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.accept = np.concatenate([self.accept, np.full_like(self.accept, -1)])
        found = [(edits, self.ends[node]) for node, edits in state if node in self.ends and (edits == 0 or len(self.terms[self.ends[node]]) >= FUZZY)]
        found += [(edits, -1 - node) for node, edits in state if node < 0]
        if found:
            edits, term = min(found)
            self.accept[number] = term, edits
        return number

    def _step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        after = self.table[states, codes]
        missing = np.flatnonzero(after < 0)
        if len(missing):
            for key in np.unique(states[missing].astype(np.int64) << 16 | codes[missing]).tolist():
                state, code = key >> 16, key & 0xFFFF
                number = self._number(self._moved(self.states[state], self.alphabet[code]))
                self.table[state, code] = number
            after = self.table[states, codes]
        return after

    def match(self, words: pa.Array) -> np.ndarray:
        """Term and edits of each word; -1 where none."""
        joined = "\n".join(words.to_numpy(zero_copy_only=False).tolist())
        codes = self.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        state = np.ones(len(sizes), np.int32)
        out = np.full((len(sizes), 2), -1, np.int32)
        active, step = np.arange(len(sizes)), 0
        while len(active):
            done = sizes[active] == step
            out[active[done]] = self.accept[state[active[done]]]
            active = active[~done]
            state[active] = self._step(state[active], codes[starts[active] + step])
            active = active[state[active] > 0]
            step += 1
        return out


def cores(distinct: pa.Array) -> pa.Array:
    """Words without what stands around their letters."""
    return pc.replace_substring_regex(distinct, r"^[^\p{L}]+|[^\p{L}]+$", "")


def _holders(rows: list[tuple[int, str]]) -> dict[str, tuple[int, int]]:
    """For each word and stem that toxic texts hold, how many clean and how many toxic texts hold it."""
    held: dict[str, np.ndarray] = {}
    labels, begin = np.array([label for label, _ in rows], np.int64), 0
    for texts in text_groups(pa.array([t for _, t in rows], pa.large_string()), 1 << 21):
        words = Words(texts)
        bare = cores(words.distinct)
        for n in [None, *range(STEM, LONGEST + 1)]:
            long = pc.greater_equal(pc.utf8_length(bare), n or 1)
            coded = pc.if_else(long, pc.utf8_slice_codeunits(bare, 0, n) if n else bare, None).dictionary_encode()
            index = pc.fill_null(coded.indices, -1).to_numpy()[words.place]
            pairs = np.unique(words.document_of[index >= 0] * np.int64(1 << 32) + index[index >= 0])
            of = labels[begin + (pairs >> 32)]
            counts = np.stack([np.bincount(pairs[of == one] & 0xFFFFFFFF, minlength=len(coded.dictionary)) for one in (0, 1)], axis=1)
            for term, count in zip(coded.dictionary.to_pylist(), counts, strict=True):
                key = term + "*" if n else term
                held[key] = held[key] + count if key in held else count
        begin += len(texts)
    return {t: (int(c[0]), int(c[1])) for t, c in held.items() if c[1]}


def learn_terms(rows: list[tuple[int, str]]) -> tuple[list[str], list[str], dict[str, float]]:
    """Words and stems (marked by a star in the odds) that toxic texts hold far more often than others, with their log odds. A term is left out where a longer one is
    held by as many texts of either class: it would say the same and match more."""
    sizes = Counter(label for label, _ in rows)
    held = _holders(rows)
    toxic, clean = {t: n for t, (_, n) in held.items() if n}, {t: n for t, (n, _) in held.items()}
    odds = {}
    for term, n in toxic.items():
        if n >= SUPPORT:
            lift = (n / (sizes[1] + 1)) / ((clean[term] + 0.5) / (sizes[0] + 1))
            other, every = clean[term], len(rows)
            expected = (n + other) * sizes[1] / every
            ratio = 2 * (n * math.log(n / expected) + (other * math.log(other / (n + other - expected)) if other else 0.0))
            if lift >= LIFT and ratio >= RATIO:
                odds[term] = math.log(lift)
    said = {(t[:n], toxic[t], clean[t]) for t in odds for n in range(STEM, len(t.rstrip("*")) + (not t.endswith("*")))}
    ranked = sorted((t for t in odds if not t.endswith("*") or (t[:-1], toxic[t], clean[t]) not in said), key=lambda t: (-odds[t] * math.sqrt(toxic[t]), t))[:TERMS]
    return [t for t in ranked if not t.endswith("*")], [t[:-1] for t in ranked if t.endswith("*")], odds


class Model:
    def __init__(self, rows: list[tuple[int, str]]):
        rows = sorted(rows)
        words, stems, odds = learn_terms(rows)
        self.automaton = Automaton(words, stems)
        exact = np.array([odds[w] for w in words] + [odds[f"{s}*"] for s in stems] + [0.0])
        self.odds = np.c_[exact, exact / 2]
        self.context = {MARKED: 1.0}
        self.coefficients = None
        labels = np.array([label for label, _ in rows], float)
        groups = list(text_groups(pa.array([t for _, t in rows], pa.large_string()), 1 << 21))
        self._learn_hits(groups, labels)
        x = np.concatenate([self.features(t) for t in groups] or [np.zeros((0, 8))])
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(8), np.ones(8))
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton's method on the penalised logistic likelihood
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (labels - p) - 1e-1 * w
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-1 * np.eye(len(w)), gradient)
        self.coefficients = w

    def _learn_hits(self, groups: list[list[str]], labels: np.ndarray) -> None:
        """What misspelt hits of each term are worth, by the texts of either class that hold them; and which words and marks around hits speak for quotation: those
        around hits in clean texts far more often than around hits in toxic ones."""
        misspelt = np.zeros((2, len(self.odds)))
        around, hits, begin = (Counter(), Counter()), np.zeros(2), 0
        for texts in groups:
            words = Words(texts)
            at, term, edits, first, last, marked = self.found(words)
            label = labels[begin + words.document_of[at]].astype(int)
            begin += len(texts)
            once = np.unique(np.c_[words.document_of[at], term, label][edits > 0], axis=0)
            np.add.at(misspelt, (once[:, 2], once[:, 1]), 1)
            names = cores(words.distinct).to_numpy(zero_copy_only=False)
            met: dict[int, set[str]] = {}
            for i, owner, low, high, mark in zip(*(x[edits == 0].tolist() for x in (at, words.document_of[at], first, last, marked)), strict=True):
                near = met.setdefault(owner, set())
                near.update(names[p] for j, p in enumerate(words.place[low:high].tolist(), low) if j != i)
                near |= {MARKED} if mark else set()
            for owner, near in met.items():  # a text counts once, however many hits it has
                one = int(labels[begin - len(texts) + owner])
                hits[one] += 1
                around[one].update(near - {""})
        docs = np.array([max(1, (labels == 0).sum()), max(1, (labels == 1).sum())])
        exact = self.odds[:, 0]
        learnt = np.log((misspelt[1] + PRIOR) / docs[1]) - np.log(misspelt[0] / docs[0] + PRIOR * np.exp(-exact / 2) / docs[1])
        self.odds[:, 1] = np.clip(learnt, 0, exact)
        around[0][MARKED] += QUOTED
        share = lambda one, word, total: (around[one][word] + 0.5) / (total + 1)
        weights = {w: math.log(share(0, w, hits[0] + QUOTED) / share(1, w, hits[1])) for w, n in around[0].items() if n >= SUPPORT}
        known = sorted((w for w in weights if weights[w] >= math.log(CONTEXT_LIFT)), key=lambda w: (-weights[w] * math.sqrt(around[0][w]), w))[:CONTEXTS]
        self.context = {w: weights[w] for w in known}

    def found(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position, term and edits of each hit, where its window begins and ends within its own text, and whether marks stand on both sides."""
        matched = self.automaton.match(cores(words.distinct))
        at = np.flatnonzero(matched[words.place, 0] >= 0)
        owner = words.document_of[at]
        first = np.maximum(at - WINDOW, np.searchsorted(words.document_of, owner))
        last = np.minimum(at + WINDOW + 1, np.searchsorted(words.document_of, owner, "right"))
        marks = np.cumsum(np.r_[0, pc.match_substring_regex(words.distinct, f"[{QUOTES}]").to_numpy(zero_copy_only=False)[words.place]])
        marked = (marks[np.minimum(at + 1, len(words.place))] > marks[first]) & (marks[last] > marks[at])
        return at, matched[words.place[at], 0], matched[words.place[at], 1], first, last, marked

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position, term, edits and context score (near 1: quotation) of each hit."""
        at, term, edits, first, last, marked = self.found(words)
        names = [w for w in self.context if w != MARKED]
        spoken = np.zeros(len(words.place) + 1)
        if names and len(at):
            index = pc.fill_null(pc.index_in(cores(words.distinct), pa.array(names, words.distinct.type)), len(names)).to_numpy()
            np.cumsum(np.array([self.context[w] for w in names] + [0.0])[index][words.place], out=spoken[1:])
        evidence = spoken[last] - spoken[first] + self.context.get(MARKED, 0.0) * marked
        return at, term, edits, 1 - np.exp(-evidence)

    def features(self, texts: list[str]) -> np.ndarray:
        words = Words(texts)
        at, term, edits, quoted = self.hits(words)
        owner = words.document_of[at]
        n = len(texts)
        whole = self.odds[term, np.minimum(edits, 1)]
        weight = whole * (1 - quoted)
        total = np.bincount(owner, weight, n)
        most = np.zeros(n)
        np.maximum.at(most, owner, weight)
        exact, misspelt = np.bincount(owner, (edits == 0) * (1 - quoted), n), np.bincount(owner, (edits > 0) * weight, n)
        size = np.bincount(words.document_of, minlength=n)
        kinds = np.zeros(n)
        if len(at):
            pairs = np.unique((owner * np.int64(len(self.odds)) + term)[weight > 0.5])
            kinds = np.bincount(pairs // len(self.odds), minlength=n)
        return np.c_[np.log1p(total), most, np.log1p(exact), np.log1p(misspelt), np.log1p(kinds), np.log1p(np.bincount(owner, whole * quoted, n)), np.log1p(size), np.log1p(100 * total / (size + 10))]

    def score(self, texts: list[str], shift: float = 0.0) -> np.ndarray:
        """The scores, with the log odds moved by the shift."""
        x = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients[:-1] + self.coefficients[-1] + shift, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, train: Column, per_class: int, id_col: str, text_col: str, label_col: str) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """A bounded sample of labelled texts, about as many of either class, chosen by hashes of ids; only their ids join the texts. And how many ids of either class teach in all."""
    known = labels.filter(train & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) != 0).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    chance = F.when(F.col("label") == 1, min(1.0, per_class / counts.get(1, 1))).otherwise(min(1.0, per_class / counts.get(0, 1)))
    some = known.withColumn("spot", spot).filter(F.col("spot") < chance).orderBy("spot", "id").limit(3 * per_class)
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1)).cast("long")).cast("int") + 1
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most 3 * per_class ids are broadcast
    found = rows.join(F.broadcast(some), "id").select("id", "label", "spot", F.substring("text", at, F.lit(TRAIN_CHARS)).alias("text")).orderBy("spot", "id", "text").limit(3 * per_class)
    return [(r["label"], r["text"]) for r in found.collect()], counts


def prior_shift(rows: list[tuple[int, str]], counts: dict[int, int]) -> float:
    """What the sample's share of toxic texts adds to the log odds beside that of all labels: a model that learnt from as many of either class takes clean texts for likelier toxic than they are."""
    toxic = sum(label for label, _ in rows)
    return math.log(counts[1] / counts[0]) - math.log(toxic / (len(rows) - toxic))


def score(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for each row of docs. ``train`` selects the rows of labels that teach.

    The score depends on the text alone, and is the chance at the share of toxic labels among all that teach; a null text scores as an empty one. An id labelled more than once is toxic if any of its labels is. Without labels of both
    classes the score is the share of toxic labels (0 without any). Very long texts are read whole; repeated rows each get a row."""
    rows, counts = training_rows(docs, labels, train, per_class, id_col, text_col, label_col)
    toxic = sum(label for label, _ in rows)
    model = docs.sparkSession.sparkContext.broadcast(Model(rows) if 0 < toxic < len(rows) else None)
    constant = toxic / len(rows) if rows else 0.0
    shift = prior_shift(rows, counts) if model.value else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        for batch in batches:
            done = 0
            for texts in text_groups(batch.column(1), 1 << 21):
                scores = model.value.score(texts, shift) if model.value else np.full(len(texts), constant)
                yield pa.record_batch([batch.column(0).slice(done, len(texts)), pa.array(scores, pa.float64())], ["doc_id", "score"])
                done += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
