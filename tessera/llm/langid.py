"""Language identification by a linear-chain conditional random field over the words of a line.

A word's scores are sums of learned weights of its features: character n-grams inside word marks (those that touch a mark are its affixes) and the word
itself (the lexicon), all hashed into one table. Learned transitions tie neighbours; forward-backward gives each word's marginals, so
text that switches language within a line is labelled word by word. A document's language is the one with the largest sum of marginals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import in_small_batches, text_groups, worker_cache

UNKNOWN = "und"
#: Training texts of each language, and characters of all of them together: with many languages fewer characters of each text teach, then fewer texts. All
#: languages are learned; the model holds a column of weights for each.
TRAIN_DOCS, SAMPLE_CHARS = 200, 8_000_000
LEAST_DOCS, LEAST_CHARS, MOST_CHARS = 20, 500, 20_000
#: Characters of the texts that a task works on at once.
GROUP = 1 << 19
TABLE_BITS, ORDERS = 17, (1, 2, 3, 4)
#: Words of a line that are walked one after another; stretches of longer lines are walked at the same time, with the messages carried over.
STRETCH = 256
ROUNDS, RATE, DECAY = 20, 0.5, 1e-6


class Words:
    """The words of texts: distinct ones, which word stands where, and where lines (chains) and documents end."""

    def __init__(self, texts: list[str]):
        lines = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
        flat = pc.utf8_lower(lines.flatten())
        for space in "\t\x0b\x0c\r":
            flat = pc.replace_substring(flat, space, " ")
        words = pc.split_pattern(flat, " ")
        coded = words.flatten().dictionary_encode()
        self.distinct = coded.dictionary
        self.place = coded.indices.to_numpy()
        per_line = pc.list_value_length(words).to_numpy()
        self.line_of = np.repeat(np.arange(len(per_line)), per_line)
        self.document_of = np.repeat(np.repeat(np.arange(len(texts)), pc.list_value_length(lines).to_numpy()), per_line)
        self.has_letter = pc.match_substring_regex(self.distinct, r"\p{L}").to_numpy(zero_copy_only=False)

    def only_words(self) -> None:
        """Drop what has no letter; it neither carries a language nor parts its neighbours."""
        keep = self.has_letter[self.place]
        self.place, self.line_of, self.document_of = self.place[keep], self.line_of[keep], self.document_of[keep]


def features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words end to end, and where each word's begin."""
    mark, nothing = pa.scalar("\x02", pa.large_string()), pa.scalar("", pa.large_string())
    marked = pc.binary_join_element_wise(mark, distinct.cast(pa.large_string()), mark, nothing)
    ends = np.frombuffer(marked.buffers()[1], np.int64)[marked.offset : marked.offset + len(marked) + 1]
    raw = np.frombuffer(marked.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    starts, sizes = ends[:-1] - ends[0], np.diff(ends)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(ends[1:] - ends[0], sizes) - np.arange(len(raw))  # bytes of the word from here on
    hashed = np.zeros(len(raw), np.uint64)
    found, owners = [], []
    for n in range(1, max(ORDERS) + 1):
        hashed[: len(raw) - n + 1 or None] = hashed[: len(raw) - n + 1 or None] * np.uint64(0x100000001B3) + raw[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            whole = np.flatnonzero(left >= n)
            found.append(hashed[whole] * np.uint64(2) + np.uint64(1))
            owners.append(owner[whole])
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max(initial=1)), np.uint64(0x9E3779B97F4A7C15))])
    word = np.add.reduceat(raw * powers[np.arange(len(raw)) - np.repeat(starts, sizes)], starts) if len(raw) else raw
    found.append(word * np.uint64(2))
    owners.append(np.arange(len(sizes)))
    mixed = np.concatenate(found) * np.uint64(0x9E3779B97F4A7C15)
    slots, owners = (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int32), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.searchsorted(owners[order], np.arange(len(sizes)))


def chains(line_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chains begin and how long they are: whole lines."""
    begins = np.flatnonzero(np.r_[True, line_of[1:] != line_of[:-1]][: len(line_of)])
    return begins, np.diff(np.r_[begins, len(line_of)])


def forward_backward(emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of every position, and the expected transitions if asked. Long chains are walked in stretches at the same time: first each stretch as a matrix from the message that enters it to the one that leaves
    it, then the messages from stretch to stretch, then all positions. The result is that of one walk over the chain."""
    pieces = -(-lengths // STRETCH)
    nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begins = np.repeat(starts, pieces) + nth * STRETCH
    sizes = np.minimum(STRETCH, np.repeat(starts + lengths, pieces) - begins)
    order = np.argsort(-sizes, kind="stable")
    begins, sizes, nth = begins[order], sizes[order], nth[order]
    number = np.empty(len(order), np.int64)  # of each stretch in the order of the text
    number[order] = np.arange(len(order))
    scores = np.exp(np.clip(emissions - emissions.max(axis=1, keepdims=True), -30, 0))
    step = np.exp(transitions)
    alive = np.searchsorted(-sizes, -np.arange(1, (int(sizes[0]) if len(sizes) else 0) + 1), side="right")
    entering, leaving = _between(scores, step, begins, alive, nth, number, pieces)
    ahead, marginals = np.empty_like(scores), np.empty_like(scores)
    held, first = None, (nth == 0)[:, None]
    for t, n in enumerate(alive.tolist()):
        at = begins[:n] + t
        held = np.where(first, scores[at], (entering @ step) * scores[at]) if t == 0 else (held[:n] @ step) * scores[at]
        held /= held.sum(axis=1, keepdims=True)
        ahead[at] = held
    expected = np.zeros_like(step) if pairs else None
    back = leaving
    for t in range(len(alive) - 1, -1, -1):
        at = begins[: alive[t]] + t
        both = ahead[at] * back[: alive[t]]
        marginals[at] = both / both.sum(axis=1, keepdims=True)
        inner = np.ones(len(at), bool) if t else nth > 0
        if inner.any() and (t or pairs):
            into = scores[at] * back[: alive[t]]
            if pairs:
                before = (ahead[at - 1] if t else entering)[inner]
                norm = ((before @ step) * into[inner]).sum(axis=1, keepdims=True)
                expected += step * (before.T @ (into[inner] / norm))
            into = into @ step.T
            back[: alive[t]] = into / into.sum(axis=1, keepdims=True)
    return marginals, expected


def _between(scores: np.ndarray, step: np.ndarray, begins: np.ndarray, alive: np.ndarray, nth: np.ndarray, number: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward message before each stretch and the backward one behind it."""
    entering, leaving = np.ones((len(begins), len(step))), np.ones((len(begins), len(step)))
    if not (pieces > 1).any():
        return entering, leaving
    through = np.broadcast_to(step, (len(begins), *step.shape)).copy()
    through[nth == 0] = np.eye(len(step))
    for t, n in enumerate(alive.tolist()):
        moved = (through[:n] if t == 0 else through[:n] @ step) * scores[begins[:n] + t][:, None, :]
        through[:n] = moved / moved.max(axis=(1, 2), keepdims=True)
    base, most = np.cumsum(pieces) - pieces, int(pieces.max())
    for k in range(1, most):  # all chains with so many stretches
        here = base[pieces > k] + k
        held = np.einsum("ni,nij->nj", entering[number[here - 1]], through[number[here - 1]])
        entering[number[here]] = held / held.sum(axis=1, keepdims=True)
    for k in range(most - 1, 0, -1):
        here = base[pieces > k] + k
        held = np.einsum("nij,nj->ni", through[number[here]], leaving[number[here]])
        leaving[number[here - 1]] = held / held.sum(axis=1, keepdims=True)
    return entering, leaving


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.labels, self.weights, self.transitions = labels, weights, transitions

    def emissions(self, distinct: pa.Array) -> np.ndarray:
        slots, starts = features(distinct)
        return np.add.reduceat(self.weights[slots], starts, axis=0)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        words = Words(texts)
        words.only_words()
        share = np.zeros((len(texts), len(self.labels)))
        if len(words.place) and self.labels:
            emissions = self.emissions(words.distinct)[words.place]
            marginals, _ = forward_backward(emissions, *chains(words.line_of), self.transitions)
            begins = np.flatnonzero(np.r_[True, words.document_of[1:] != words.document_of[:-1]])
            share[words.document_of[begins]] = np.add.reduceat(marginals, begins, axis=0)
        total = share.sum(axis=1)
        best = share.argmax(axis=1) if self.labels else np.zeros(len(texts), int)
        names = [self.labels[b] if t > 0 else UNKNOWN for b, t in zip(best, total, strict=True)]
        return names, [float(min(1.0, s[b] / t)) if t > 0 else 0.0 for s, b, t in zip(share, best, total, strict=True)]

    def words(self, text: str) -> list[tuple[str, str]]:
        """The language of each word that has a letter."""
        words = Words([text])
        words.only_words()
        if not len(words.place):
            return []
        marginals, _ = forward_backward(self.emissions(words.distinct)[words.place], *chains(words.line_of), self.transitions)
        names = words.distinct.to_pylist()
        return [(names[p], self.labels[m]) for p, m in zip(words.place.tolist(), marginals.argmax(axis=1).tolist(), strict=True)]


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Maximise the chains' conditional likelihood by AdaGrad over (language, text) rows. A word's label is its document's language; a third of
    the lines are joined to another one, so that switches are seen too."""
    labels = sorted({lang for lang, _ in rows})
    rows = sorted(rows)
    words = Words([text for _, text in rows])
    words.only_words()
    weights, transitions = np.zeros((1 << TABLE_BITS, len(labels)), np.float32), np.zeros((len(labels), len(labels)))
    if not len(words.place):
        return Model(labels, weights, transitions)
    number = {x: i for i, x in enumerate(labels)}
    gold = np.array([number[lang] for lang, _ in rows])[words.document_of]
    random = np.random.default_rng(seed)
    begins = np.flatnonzero(np.r_[True, words.line_of[1:] != words.line_of[:-1]])
    spans = np.split(np.arange(len(words.place)), begins[1:])
    shuffled = [spans[i] for i in random.permutation(len(spans))]
    joined, line_of, line = [], [], 0
    for i, span in enumerate(shuffled):
        joined.append(span)
        line_of.append(np.full(len(span), line))
        line += i % 3 != 0
    order, line_of = np.concatenate(joined), np.concatenate(line_of)
    place, gold = words.place[order], gold[order]
    starts, lengths = chains(line_of)
    slots, first = features(words.distinct)
    per_word = np.diff(np.r_[first, len(slots)])
    counted = np.zeros((len(words.distinct), len(labels)))
    np.add.at(counted, (place, gold), 1)
    inner = np.ones(len(place), bool)
    inner[starts] = False
    seen = np.zeros_like(transitions)
    np.add.at(seen, (gold[:-1][inner[1:]], gold[1:][inner[1:]]), 1)
    by_slot = np.argsort(slots, kind="stable")
    used, slot_begins = np.unique(slots[by_slot], return_index=True)
    owner = np.repeat(np.arange(len(first)), per_word)[by_slot]
    squares, transition_squares = np.full((len(used), len(labels)), 1e-6), np.full_like(transitions, 1e-6)
    for _ in range(ROUNDS):
        emissions = np.add.reduceat(weights[slots], first, axis=0)[place]
        marginals, expected = forward_backward(emissions, starts, lengths, transitions, pairs=True)
        missing = counted.copy()
        for label in range(len(labels)):
            missing[:, label] -= np.bincount(place, marginals[:, label], len(missing))
        gradient = np.add.reduceat((missing / len(place))[owner], slot_begins, axis=0) - DECAY * weights[used]
        squares += gradient**2
        weights[used] += (RATE * 0.2 * gradient / np.sqrt(squares)).astype(np.float32)
        gradient = (seen - expected) / len(place) - DECAY * transitions
        transition_squares += gradient**2
        transitions += RATE * gradient / np.sqrt(transition_squares)
    return Model(labels, weights, transitions)


def training_rows(docs: DataFrame, text_col: str, lang_col: str, train: Column, per_language: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts: distinct ones with the smallest hashes, up to ``per_language`` of each language. Of a long text a part at a place that its
    hash chooses teaches, so no row is barred for its length and the sample holds about SAMPLE_CHARS characters."""
    known = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("hash"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}  # a row a language
    if not counts:
        return []
    chars = min(MOST_CHARS, max(LEAST_CHARS, SAMPLE_CHARS // (per_language * len(counts))))
    per_language = min(per_language, max(LEAST_DOCS, SAMPLE_CHARS // (chars * len(counts))))
    spot = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    chances = docs.sparkSession.createDataFrame([(lang, min(1.0, 2.0 * per_language / n)) for lang, n in counts.items()], "lang string, chance double")
    some = rows.join(F.broadcast(chances), "lang").withColumn("spot", spot).filter(F.col("spot") < F.col("chance"))
    at = F.pmod(F.xxhash64("hash"), F.greatest(F.length("text") - chars + 1, F.lit(1)).cast("long")).cast("int") + 1
    once = some.groupBy("lang", "spot").agg(F.first(F.substring("text", at, F.lit(chars))).alias("text"))  # copies count once, before the shuffle
    ranked = once.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("spot")))
    return [(r["lang"], r["text"]) for r in ranked.filter(F.col("place") <= per_language).select("lang", "text").collect()]


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row. Rows of ``train`` with a language teach; predictions see the text alone.

    The score is the language's share of the words' marginals. A text that is null or has no letter is ``und`` with score 0, as is every text where nothing
    was learned. Very long texts are read in full, a line at a time; repeated rows each get a row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, text_col, lang_col, train)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid")
        for batch in batches:
            done = 0
            for texts in text_groups(batch.column(1), GROUP):
                names, scores = model.value.predict(texts)
                yield pa.record_batch([batch.column(0).slice(done, len(texts)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
                done += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def tag(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", pred_col: str = "lang_pred", score_col: str = "lang_score") -> DataFrame:
    """The input rows with ``pred_col`` and ``score_col`` added as the last columns, in one pass without a join. Input columns of these names are replaced: give other names to keep
    them. Nulls, empty and very long texts, repeated rows and empty tables are as in ``identify``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, text_col, lang_col, train)))
    kept = docs.drop(*[c for c in docs.columns if c in (pred_col, score_col) and c != text_col])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid")
        for batch in batches:
            done = 0
            for texts in text_groups(batch.column(at), GROUP):
                names, scores = model.value.predict(texts)
                rows = batch.slice(done, len(texts))
                yield pa.record_batch([*rows.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*rows.schema.names, pred_col, score_col])
                done += len(texts)

    schema = T.StructType([*kept.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return in_small_batches(kept).mapInArrow(run, schema)
