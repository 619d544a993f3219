"""Hard negatives, alignment of tokenizers and removal of repeated passages against brute force, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, dedup, langid, mixing, negatives, partenum, pii, queries, substrings, warc
from tests.conftest import SF

DOC = "doc_id long, text string"
ODD = [None, "", " ", "  two  spaces ", " \n\t", "...", "word", "é" * 300, "日本語 テキスト🙂 " * 50, "a b c d e f g " * 300, "x" * 5_000, "<|endoftext|> <s> x</s>", "low▁line ▁ end", "᠎ a ᠎b", "nul\x00 here", "é ́a", "tab\tnew\nline\r\n  end  "]


def _vocabularies():
    return queries._vocabulary("byte_bpe_50k.json"), queries._vocabulary("piece_bpe_32k.model")


# --- alignment -------------------------------------------------------------------------------------------------------------------------------------------


def _plain_alignment(texts):
    """Ends of both libraries' whole encodings, compared one by one."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = _vocabularies()
    a, b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    level, out = alignment._byte_level(), []
    for text in texts:
        rows = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(level[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [alignment._piece_bytes(b.id_to_piece(i)) for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                rows = [ids_a, ids_b, np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()]
        out.append(rows)
    counts = collections.Counter()
    links = []
    for r in out:
        found = []
        if r:
            at = dict(zip(r[3], r[1], strict=True))
            found = [(i, at[e]) for i, e in zip(r[0], r[2], strict=True) if e in at]
        links.append(found)
        counts.update(found)
    most = collections.defaultdict(int)
    for (_, i), n in counts.items():
        most[i] = max(most[i], n)
    result = []
    for r, found in zip(out, links, strict=True):
        if not r:
            result.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends, groups, i, j = sorted(set(r[2]) & set(r[3])), [], 0, 0
        for e in ends:
            i2, j2 = r[2].index(e) + 1, r[3].index(e) + 1
            groups.append(",".join(map(str, r[0][i:i2])) + "|" + ",".join(map(str, r[1][j:j2])))
            i, j = i2, j2
        result.append((len(r[0]), len(r[1]), len(groups), len(found), sum(counts[x] == most[x[1]] for x in found), sum(counts[x] for x in found), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return result


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_documents_and_odd_texts(spark):
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    letters = "ab é ß 日本 ▁ \t\n     ᠎ 🙂 <0x0A> 12 's \x00 ́ \x1c".split(" ") + [" ", "  ", " "]
    texts = real + ODD + ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(1500)] + ["", "word"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("n_a", F.lit("clash")).repartition(5)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.link_strengths(docs, *_vocabularies()).collect()}
    want = _plain_alignment(texts)
    assert {i: w for i, w in enumerate(want)} == got
    query = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, SF).collect()}
    ids = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    assert query == dict(zip(ids, _plain_alignment(real), strict=True))


def test_alignment_edges(spark):
    assert alignment.link_strengths(spark.createDataFrame([], DOC), *_vocabularies()).collect() == []
    repeated = spark.createDataFrame([(None, "one two"), (None, "one two"), (1, None)], DOC)
    rows = alignment.link_strengths(repeated, *_vocabularies()).collect()
    assert len(rows) == 3 and {(r["n_groups"], r["n_best"], r["count_sum"]) for r in rows} == {(2, 2, 4), (0, 0, 0)}
    groups = alignment.token_groups(repeated.filter("text is not null").limit(1), *_vocabularies()).orderBy("place").collect()
    assert [(g["start"], g["end"]) for g in groups] == [(0, 4), (4, 8)]


def test_owner_arrays():
    found = alignment.owners(np.array([1, 2, 3]), np.array([2, 1, 1, 2]))
    assert found.a_ends.tolist() == [2, 3] and found.b_ends.tolist() == [2, 4]
    assert found.overlaps.tolist() == [[0, 0], [1, 0], [1, 1], [2, 2], [2, 3]]


def test_linked_pairs_are_bounded_by_the_vocabularies():
    """The tokens that can end together: the bytes of one end with those of the other."""
    a_path, b_path = _vocabularies()
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        made = alignment.Aligner(a.read(), b.read())
    counts = [collections.Counter(x) for x in (made.a_bytes, made.b_bytes)]
    linked = sum(n * counts[1][t[k:]] for t, n in counts[0].items() for k in range(len(t))) + sum(n * counts[0][t[k:]] for t, n in counts[1].items() for k in range(1, len(t)))
    assert linked < 1_000_000


# --- hard negatives --------------------------------------------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<double>, label int"


def _plain_negatives(rows, every=100, k=5, percent=80):
    fine = {(i, lab, tuple(min(max(math.floor(256 * x), -negatives.LARGEST - 1), negatives.LARGEST) for x in v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, lab, v in fine:
        if i % every:
            continue
        others = [(-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -negatives.LARGEST), negatives.LARGEST), j, m) for j, m, w in fine if j != i and len(w) == len(v)]
        for p, pid, _ in sorted(x for x in others if x[2] == lab)[:k]:
            limited = sorted(x for x in others if x[2] != lab and percent * -p <= 100 * -x[0] <= 100 * -p)[:k]
            out += [(i, pid, n, nid, -p, -s) for n, (s, nid, _) in enumerate(limited, 1)]
    return sorted(out)


def _mined(df, **kw):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in columns) for r in negatives.mine(df, **kw).collect())


def test_hard_negatives_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vec = lambda d, f=1.0: [rng.choice([-1, 0, 0.25, 0.5, 1, rng.random()]) * f for _ in range(d)]
    rows = [(i, vec(4), rng.randint(0, 2)) for i in range(400)] + [(1000 + i, vec(3), 1) for i in range(30)] + [(2000 + i, [0.5, 0.5, 0.5, 0.5], i % 3) for i in range(300)]
    rows += [(200, vec(4), 1), (200, vec(4), 2), (300, [0.0] * 4, 1), (5, None, 1), (6, [1.0, None, 1.0, 1.0], 1), (7, [float("nan")] * 4, 1), (100, [float("inf")] * 4, 1), (8, vec(4), None), (None, vec(4), 1)]
    rows += rows[:50] + [(3000 + i, [3e10 * rng.random()] * 2, i % 2) for i in range(40)] + [(3100 + i, [1e6 * rng.random(), 1.0, 2.0, 3.0, 4.0], i % 2) for i in range(40)] + [(4000, [], 1), (4001, [], 1), (4002, [], 2)]
    df = spark.createDataFrame(rows, VEC).withColumn("label_id", F.lit("clash")).withColumn("x", F.lit(1)).repartition(4)
    monkeypatch.setattr(negatives, "BLOCK", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    assert _mined(df) == _plain_negatives(rows)


def test_hard_negatives_edges(spark):
    assert _mined(spark.createDataFrame([], VEC)) == []
    assert _mined(spark.createDataFrame([(100, [1.0], 1), (1, [1.0], 1)], VEC)) == []
    huge = [(100, [1e300, 1.0], 1), (1, [1e300, 0.0], 1), (2, [9e299, 0.0], 2)]
    assert _mined(spark.createDataFrame(huge, VEC)) == [(100, 1, 1, 2, negatives.LARGEST, negatives.LARGEST)]


def test_shifted_labels(spark):
    rows = spark.createDataFrame([(0, 9), (7, 3), (8, 3), (14, None)], "vec_id long, label int")
    assert [r[0] for r in rows.orderBy("vec_id").select(negatives.shifted_label()).collect()] == [0, 4, 3, None]


# --- repeated passages -----------------------------------------------------------------------------------------------------------------------------------


def _plain_removal(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def _removed(docs, **kw):
    rows = substrings.remove_repeats(docs, **kw).collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in rows}


@pytest.mark.parametrize(("letters", "window", "pack"), [(2, 35, 1 << 20), (3, 35, 700), (40, 35, 1 << 14), (2, 8, 300), (1, 35, 200)])
def test_repeats_brute_force(spark, letters, window, pack):
    """Random texts over few words, periodic stretches, and passages set into other texts at every length about the window's."""
    rng = random.Random(letters * 100 + window)
    some = lambda n, k=letters: [f"w{rng.randrange(k)}" for _ in range(n)]
    texts = [some(rng.randint(0, 120)) for _ in range(40)]
    for size in range(window - 3, window + 6):
        passage = [f"p{size}x{rng.randrange(3)}" if rng.random() < 0.4 else f"w{rng.randrange(letters)}" for _ in range(size)]
        texts += [some(rng.randint(0, 30), 50) + passage + some(rng.randint(0, 30), 50) for _ in range(rng.randint(1, 4))]
        texts += [["run"] * size, ["x", "y"] * size, [f"u{size}-{i}" for i in range(size)] * rng.randint(1, 2)]
    texts = [" ".join(t) for t in texts] + ODD
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("pack", F.lit("clash")).withColumn("n_words", F.lit(0)).repartition(3)
    assert _removed(docs, window=window, pack_bytes=pack) == dict(enumerate(_plain_removal(texts, window)))


def test_repeats_in_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, gone, t) in zip(rows, _plain_removal([t for _, t in rows], 35), strict=True)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op13_substrings(spark, SF).collect()}
    assert got == want and sum(x[1] > 0 for x in got.values()) > 10


def test_repeats_edges(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOC)).collect() == []
    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, long), (None, long), (1, None), (2, "short")], DOC)
    assert sorted((r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs).collect()) == [(0, 0), (1, 0), (40, 40), (40, 40)]


def test_symbols_follow_from_their_supports():
    """The same words within another text: symbols whose support lies inside are the same at both places."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        passage = rng.integers(0, 6, 60).astype(np.uint64)
        found = []
        for _ in range(2):
            before, after = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
            names = substrings.mixed(np.r_[before, passage, after] + np.uint64(11))
            s = substrings.words_as_symbols(names, np.zeros(len(names), np.int64))
            for turn in range(4):
                s = substrings.compress_round(s, turn)
            at = len(before)
            inside = (s.low >= at) & (s.high <= at + 60)
            found.append({(int(n), int(a) - at, int(b) - at) for n, a, b in zip(s.name[inside], s.start[inside], s.end[inside], strict=True)})
        assert found[0] == found[1]


# --- earlier operators -----------------------------------------------------------------------------------------------------------------------------------


def test_long_lines_are_one_chain(monkeypatch):
    """Stretches change nothing: marginals and expected transitions equal those of one walk."""
    rng = np.random.default_rng(2)
    lengths = np.array([1, 40, 3, 97, 8, 16, 17])
    starts = np.cumsum(lengths) - lengths
    emissions, transitions = rng.normal(0, 3, (lengths.sum(), 4)), rng.normal(0, 1, (4, 4))
    whole = langid.forward_backward(emissions, starts, lengths, transitions, pairs=True)
    for size in (1, 2, 8, 40):
        monkeypatch.setattr(langid, "STRETCH", size)
        got = langid.forward_backward(emissions, starts, lengths, transitions, pairs=True)
        assert all(np.allclose(a, b, atol=1e-12) for a, b in zip(whole, got, strict=True))


def test_stages_keep_columns_with_their_own_names(spark):
    """Input columns named as any helper column of a stage come through unchanged."""
    helpers = ["__h", "__n", "__source", "__whole", "__threshold", "mix_source", "mix_whole", "mix_threshold", "mix_hash", "mix_copy", "whole", "threshold", "h", "s"]
    helpers += ["__gone_id", "__gone_digest", "__gone", "__tag", "key", "digest", "component_id", "lang_pred", "lang_score"]
    docs = spark.createDataFrame([(i, f"word{i} of a text {'long ' * i}", ("a", "b", None)[i % 3]) for i in range(30)], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(f"{h} of "), F.col("doc_id").cast("string")).alias(h) for h in helpers])
    for stage in (mixing.apply_mix, dedup.drop_copies, partenum.keep_one):
        got = stage(docs)
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[h] == f"{h} of {r['doc_id']}" for r in rows for h in helpers)


def test_many_spans_in_one_text(spark):
    """Positions by blocks of matches: more addresses and digits in a text than a block has."""
    text = "é " + " ".join(f"u{i}@x.org" for i in range(700)) + " " + " ".join(str(i % 10) for i in range(900)) + " end"
    row = pii.detect(spark.createDataFrame([(1, text)], DOC)).first()
    assert row["n_email"] == 700
    wanted = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"u[0-9]+@x\.org", text)]
    assert row["base_sha256"] == hashlib.sha256(",".join(wanted).encode()).hexdigest()


def test_time_of_many_digits_is_in_proportion(spark):
    """100,000 separated digits take about as long as so many texts of 1,000: growth by the square would take a hundred times that."""
    import time

    def seconds(rows):
        df = spark.createDataFrame(rows, DOC).coalesce(1)
        began = time.time()
        pii.candidates(df, "doc_id", "text").selectExpr("sum(size(base) + size(loose))").collect()
        return time.time() - began

    many = lambda n: " ".join(str(i * 7 % 10) for i in range(n))
    seconds([(0, many(1000))])
    short = seconds([(i, many(1000)) for i in range(20)])
    assert seconds([(0, many(20_000))]) < 5 * short + 5


def test_cut_archives_are_errors():
    """Wherever a gzip stream is cut, at the end of a record too, the reader says so."""
    import gzip
    import io

    whole = warc.record(1, "http://a", b"one") + warc.record(2, "http://b", b"two")
    packed = gzip.compress(whole)
    assert b"".join(warc.inflate(io.BytesIO(packed))) == whole and b"".join(warc.inflate(io.BytesIO(packed * 2))) == whole * 2
    for cut in (1, 5, 8, 9, len(packed) // 2):
        with pytest.raises((ValueError, EOFError)):
            list(warc.records(warc.inflate(io.BytesIO(packed[:-cut]))))
    assert list(warc.records(warc.inflate(io.BytesIO(b"")))) == []
