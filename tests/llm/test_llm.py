"""Each corpus operator against brute force, a round trip or held-out accuracy, and its edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, common, dedup, langid, mixing, partenum, pii, queries, token_store, toxicity, warc
from tests.compare import assert_same
from tests.conftest import SF

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "...", "word", "é" * 300, "日本語 テキスト🙂 " * 50, "a b c d e f g " * 3000, "x" * 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    """Real rows, edge cases, repeated rows, null keys, and an extra column."""
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    extra = [(100_000 + i, t, "en", None if i % 2 else "odd", 0) for i, t in enumerate(ODD)] + [(100_001, "", "en", None, 0), (None, "no id here", None, None, None)]
    return real.unionByName(spark.createDataFrame(extra, DOC)).withColumn("text_sha256", F.lit("clash")).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):
    assert_same(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


def test_exact_dedup(docs, rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256((t or "").translate(lower).encode()).hexdigest()].append(i)
    want = sorted(((i, max((x for x in ids if x is not None), default=None), len(ids), h) for h, ids in groups.items() for i in ids), key=repr)
    for k in (1, 64):
        got = dedup.exact_dedup(docs, k=k).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got if r["doc_id"] is not None)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {r["doc_id"] for r in dedup.drop_copies(docs).collect()} == kept


def test_misra_gries(spark):
    df = spark.createDataFrame([(b"hot",)] * 500 + [(str(i).encode(),) for i in range(700)], "k binary").repartition(5)
    assert bytes(dedup.misra_gries(df, "k", 4).collect()[0]["key"]) == b"hot"


def test_mixing(docs, rows):
    got = mixing.plan_mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        share = {s: (total - sum(3 * sizes[c] for c in capped)) * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s, v in share.items() if v > 3 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s in order:
        assert target[s] == pytest.approx(3 * sizes[s] if s in capped else share[s])
        assert abs(taken[s] - target[s]) <= max(size(t) for _, t, x, _ in rows if x == s)
    again = {(r["doc_id"], r["taken"]) for r in mixing.plan_mix(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.apply_mix(docs).count() == sum(r["copies"] for r in got)


def brute_components(rows):
    lower, sets, holders = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), {}, collections.defaultdict(set)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        for x in sets[i]:
            holders[x].add(i)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n) and (a := find(i)) != (b := find(j)):
                top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("shared", [16, 2])
def test_partenum(spark, rows, shared, monkeypatch):
    monkeypatch.setattr(partenum, "SHARED", shared)
    rng = random.Random(5)
    vocabulary, n = [f"w{i}" for i in range(400)], 200_000
    data = [(i, t) for i, t, *_ in rows if i is not None]
    data = list(dict(data).items())
    passage, base = " ".join(rng.choices(vocabulary, k=40)), rng.choices(vocabulary, k=120)
    for _ in range(60):  # a passage in many texts, and a family of near copies
        data.append((n, passage + " " + " ".join(rng.choices(vocabulary, k=rng.randint(10, 60)))))
        copy = base[:]
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(120)] = rng.choice(vocabulary)
        data.append((n + 1, " ".join(copy)))
        n += 2
    for length in range(1, 30):
        w = rng.choices(vocabulary[:3], k=length)
        data += [(n, " ".join(w)), (n + 1, "\t".join(w[:-1]).upper()), (n + 2, " ".join([*w[1:], "zz"]))]
        n += 3
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(df).collect()}
    assert got == brute_components(data)


def test_partenum_rows(docs, rows):
    assert partenum.near_duplicates(docs).count() == len(rows)


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_fine(kind, match):
    d = re.sub("[^0-9]", "", match)
    luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in match.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]


def test_pii(spark, docs, rows):
    rng = random.Random(3)
    odd = ["foo@bar a@b.com_foo@bar.com.x", "x@y..z 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004", "4111 1111 1111 1111-4111-1111-1111-1111 4111111111111111", "+1 (017) 555-7713 +12 +1234567 +12345678", "9" * 20_000, "1." * 20_000, "a@" + "b." * 20_000, "+1" + "(" * 20_000, "call (212) 555-1234 or x (at) y (dot) com"]
    odd += ["".join(rng.choice("ab1230.@+- ()-x_é5") for _ in range(rng.choice([30, 200]))) for _ in range(100)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(500_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.detect(both).collect()}
    for i, t in [(i, t) for i, t, *_ in rows] + [(500_000 + i, t) for i, t in enumerate(odd)]:
        base = [f"{k}:{m.start()}:{m.end()}" for k, p in PII.items() for m in re.finditer(p, t or "") if pii_fine(k, m.group())]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert set(base) <= set(got[i]["spans"].split(",")) | {""}
    assert got[500_008]["n_added"] > 0


def luhn_number(rng, good=True):
    head = [rng.randrange(10) for _ in range(15)]
    last = next(c for c in range(10) if pii_fine("card", "".join(map(str, [*head, c]))))
    return "".join(map(str, [*head, last if good else (last + 1) % 10]))


def grouped(number, between):
    return between.join(number[i : i + 4] for i in range(0, 16, 4))


def test_pii_context(spark):
    """The same number is added after an announcing word and left alone where such numbers mostly fail the check."""
    rng = random.Random(4)
    texts = [f"my card {grouped(luhn_number(rng), ' ')} ok" for _ in range(200)] + [f"order {grouped(luhn_number(rng, False), ' ')} ok" for _ in range(200)]
    texts += [f"my card {(one := grouped(luhn_number(rng), '.'))} ok", f"order {one} ok", f"my card {grouped(luhn_number(rng, False), '.')} ok"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_added"] for r in pii.detect(df).collect()}
    assert [got[i] for i in (400, 401, 402)] == [1, 0, 0]
    only = pii.detect(df.filter("doc_id < 200 OR doc_id = 400"))  # no candidate fails
    assert {r["doc_id"] for r in only.filter("n_added > 0").collect()} == {400}


def test_pii_labels(spark):
    """E-mail, phone and address candidates are told apart by what stands around them: precision and recall of the added spans on planted texts."""
    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    taught = [f"mail to {name()}@{name()}.com ok" for _ in range(100)] + [f"apples {name()}@{name()} each" for _ in range(100)]
    taught += [f"call +1 {number(3)} {number(3)} {number(4)} ok" for _ in range(100)] + [f"change +{number(1)}-{number(2)} points" for _ in range(100)]
    taught += [f"host 10.{rng.randrange(200)}.0.1 ok" for _ in range(100)] + [f"version 1.{rng.randrange(300, 900)}.0.1 ok" for _ in range(100)]
    good = [f"mail to {name()} (at) {name()} (dot) com ok" for _ in range(20)] + [f"call ({number(3)}) {number(3)}-{number(4)} ok" for _ in range(20)] + [f"host 2001:db8::{i + 1} ok" for i in range(20)]
    bad = [f"apples {name()} (at) {name()} (dot) com each" for _ in range(20)] + [f"change ({number(3)}) {number(3)}-{number(4)} points" for _ in range(20)] + [f"version 2001:db8::{i + 1} ok" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(good + bad + taught)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_added"] for r in pii.detect(df).collect()}
    for kind in range(3):
        found, wrong = (sum(got[i] for i in range(begin + 20 * kind, begin + 20 * kind + 20)) for begin in (0, 60))
        assert (found, wrong) == (20, 0), kind


def test_pii_inside(spark):
    """Numbers that a failing base match swallows, and compressed IPv6."""
    a, b = "7536784127813050", "4550997810720808"
    assert pii_fine("card", a) and pii_fine("card", b)
    rng = random.Random(6)
    taught = [f"my card {luhn_number(rng)} ok" for _ in range(80)] + ["call +1 212 555 7713 ok", "host 10.0.0.1 ok"] * 20
    odd = [f"my card {a} {b} ok", f"card 12 34 {grouped(a, '-')} ok", "ip 2001:db8::1 and ip ::1 but std::vector 1:2:3:4:5:6::7:8:9 :: x", "call +1 212 555 7713 12345 67890 ok"]
    df = spark.createDataFrame(list(enumerate(odd + taught)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.detect(df).collect()}
    spot = lambda i, kind, match: f"{kind}:{(at := odd[i].index(match))}:{at + len(match)}"
    assert {spot(0, "card", a), spot(0, "card", b)} <= set(got[0])
    assert spot(1, "card", grouped(a, "-")) in got[1]
    assert got[2] == [spot(2, "ip", "2001:db8::1"), f"ip:{(at := odd[2].index(' ::1') + 1)}:{at + 3}"]
    assert spot(3, "phone", "+1 212 555 7713") in got[3]


def test_warc(spark):
    pages = [(1, "http://a/ü?x=1 2", "<p>1</p>"), (2, None, "<p>1</p>"), (3, "http://b/", None), (4, "http://c/", ""), (5, "http://d", "long " * 50_000), (5, "http://d", "long " * 50_000), (6, "x", "\r\n\r\nContent-Length: 3\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    newest = {}
    for i, _, h in pages:
        newest[h or ""] = max(i, newest.get(h or "", i))
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if newest[h or ""] == i else "revisit", None if newest[h or ""] == i else newest[h or ""]) for i, _, h in pages]
    assert got == sorted(want, key=repr)
    small = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, least=9).collect()}
    assert small[1] == small[2] == small[3] == "response"


def test_token_store(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    got = sorted((tuple(r) for r in token_store.token_store(docs, path, 2, 3).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, set()).add(t or "")
    start = 0
    for i, at, n, crc in got:
        options = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts[i]]
        assert (at, n, crc) in [(start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in options]
        start += n


def test_warc_names(spark):
    """Ids that hold blanks, line ends, brackets or nothing, and no id at all; each archive has a task of its own."""
    names = ["a b", "x\r\nWARC-Type: response", "<>", "%20", "", None, "é", "z"]
    df = spark.createDataFrame([(n, f"<p>{i % 4}</p>") for i, n in enumerate(names)], "page_id string, html string").withColumn("url", F.lit("http://a/")).repartition(3)
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    newest = [max(n for n in names[i::4] if n is not None) for i in range(4)]
    assert got == {n: ("response", None) if n == newest[i % 4] else ("revisit", newest[i % 4]) for i, n in enumerate(names)}
    folder = warc.new_folder(spark, "warc")
    mono = warc.materialize(warc.write_archives(warc.classify(df), folder))
    assert warc.normalise(mono, folder).rdd.getNumPartitions() == mono.count() > 1


def odd_text(rng):
    """Letters of many scripts, marks, spaces, punctuation and special tokens in any order."""
    scripts = [(0x20, 0x7E), (0x20, 0x7E), (0xA0, 0x17F), (0x300, 0x36F), (0x370, 0x52F), (0x590, 0x5FF), (0x900, 0x9FF), (0xF00, 0xFFF), (0x1100, 0x11FF), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0x4E00, 0x4E80), (0xAC00, 0xAC80), (0xFB00, 0xFB4F), (0x1F600, 0x1F64F)]
    fixed = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "হয়,", "\u0958.", "\ufb1d!", "İ,", "don't", "we'LL", "=\u0338", " ", "\n", "\x85", "a,b", "7.5"]
    return "".join(rng.choice(fixed) if rng.random() < 0.3 else chr(rng.randint(*rng.choice(scripts))) for _ in range(rng.randint(1, 25)))


def test_words_fuzz():
    """Ids equal the library's, with its default options, on texts that no shared cut may change."""
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(9)
    tokenizer, words = Tokenizer.from_file(path), token_store._Words(path)
    texts = ["<|endoftext|>", "a<|startoftext|>,b", "", *[odd_text(rng) for _ in range(20_000)]]
    ids, sizes = words.encode(texts)
    got = np.split(ids, np.cumsum(sizes)[:-1])
    for text, one, want in zip(texts, got, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert one.tolist() == want.ids, text


def test_words_of_other_files(tmp_path):
    """Files whose texts may not be cut at spaces, or whose tokens are added to normalised text, give the library's ids too; so does one that shortens and pads, with whole texts."""
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    known = public_tokenizers.path("word_bpe_49k.json")
    assert token_store._Words(known).parted
    paths = [public_tokenizers.path("byte_bpe_50k.json")]
    for change in (lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel()), lambda t: setattr(t, "normalizer", None), lambda t: t.add_tokens([AddedToken("new york", normalized=True)])):
        changed = Tokenizer.from_file(known)
        change(changed)
        paths.append(str(tmp_path / f"{len(paths)}.json"))
        changed.save(paths[-1])
    rng = random.Random(10)
    texts = ["In New York, NEW  york's", "", *[odd_text(rng) for _ in range(300)]]
    for path in paths:
        words = token_store._Words(path)
        assert not words.parted
        ids, sizes = words.encode(texts)
        tokenizer = Tokenizer.from_file(path)
        for text, one in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert one.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, (path, text)
    short = Tokenizer.from_file(known)
    short.enable_truncation(4)
    short.enable_padding(length=8)
    short.save(str(tmp_path / "short.json"))
    got, want = (token_store._Words(p).encode(texts) for p in (str(tmp_path / "short.json"), known))
    assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_varint():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        assert (token_store.unpack(*token_store.pack(values[:n]), n) == values[:n]).all()


def test_bpe(docs, rows):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.Codec(open(path, "rb").read().splitlines(), public_tokenizers.PATTERN)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = collections.defaultdict(set)
    for r in bpe.token_digests(docs, path, public_tokenizers.PATTERN).collect():
        got[r["doc_id"]].add((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    for i, t, *_ in rows:
        ids = encoding.encode_ordinary(t or "")
        assert (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) in got[i]
    encoded = bpe.encode(docs.limit(20), path, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode(encoded, path).collect()}
    assert all(back[i] == (dict((x[0], x[1]) for x in rows)[i] or "") for i in back)
    rng = random.Random(1)
    for text in ("aaaa", "a" * 1001, "ab" * 3000, "".join(rng.choice("abcth") for _ in range(30_000))):
        assert codec.merge([text.encode()])[0].tolist() == encoding.encode_ordinary(text)
    assert (codec.merge(list(codec.ranks))[1] == 1).all()  # so merging all positions of a rank at once is exact


def test_bpe_memory(monkeypatch):
    """Pieces that went into the old memory come back with the same ids."""
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    codec = bpe.Codec(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines(), public_tokenizers.PATTERN)
    texts = ["one two three four", "", "ñandú über 12,5", " ".join(f"w{i}" for i in range(40))]
    want = [x.tolist() for x in codec.encode(texts)]
    for _ in range(4):
        assert [x.tolist() for x in codec.encode(texts)] == want
        codec.encode([" ".join(f"v{i}" for i in range(40))])
        assert [bytes(x).decode() for x in bpe.written(*codec.encode(texts), codec.bytes_of)] == texts


def test_ann(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    broken = [(7_000_000, None), (7_000_100, [0.0] * 64), (7_000_200, [float("nan")] * 64), (7_000_300, [None] * 64), (7_000_400, [1.0, 2.0])]
    some = [float(x) for x in range(64)]
    copies = [(8_000_000 + i, some) for i in range(0, 150)]
    extra = spark.createDataFrame(broken + copies, "vec_id long, embedding array<float>")
    both = df.unionByName(extra)
    data = [(r["vec_id"], r["embedding"]) for r in df.collect()] + copies
    ids, v = np.array([i for i, _ in data]), np.array([e for _, e in data], float)
    got = collections.defaultdict(list)
    for r in ann.search(both).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        found = sorted(got.pop(int(q)))
        assert [r for r, *_ in found] == list(range(1, 11))
        assert all(abs(d[ids == i][0] - s) < 1e-9 for _, i, s in found)
        hits, total = hits + len({int(ids[i]) for i in best} & {i for _, i, _ in found}), total + 10
    assert not got and hits / total >= 0.9
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, few.collect())) == [(0, 1, 100, 0.0), (0, 2, 1, 2**0.5), (100, 1, 0, 0.0), (100, 2, 1, 2**0.5)]


def recall(got, ids, v):
    lists = collections.defaultdict(set)
    for r in got:
        lists[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((v - v[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        best = set(ids[np.argpartition(d, 10)[:10]].tolist())
        hits, total = hits + len(best & lists[int(ids[q])]), total + 10
    return hits / total


@pytest.mark.parametrize(("spread", "most"), [(0.0, 0.75), (4.0, 0.1)])
def test_ann_prunes(spark, monkeypatch, spread, most):
    """On 20,000 vectors without and with clusters the walk stops early, and recall is at least 0.9."""
    random = np.random.default_rng(2)
    n = 20_000
    v = random.normal(size=(n, 16)) + spread * random.normal(size=(40, 16))[random.integers(40, size=n)]
    ids = np.arange(n)
    df = spark.createDataFrame([(i, x) for i, x in zip(ids.tolist(), v.tolist(), strict=True)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(ann, "QUERIES", 50)  # so that queries are dealt into blocks too
    assert recall(ann.search(df).collect(), ids, v) >= 0.9
    order = np.random.default_rng(0).permutation(n)[: ann.SAMPLE]
    books = ann.Codebooks(v[order], 115)
    share = ann.needed_share(v[order], books, 10)
    assert share <= most
    sizes = np.bincount(books.cells(v), minlength=115 * 115)
    met = list(ann.walk(ann.distances(v[:1, :8], books.first)[0], ann.distances(v[:1, 8:], books.second)[0], sizes, int(share * n)))
    assert share * n <= sizes[met].sum() < n and len(met) == len(set(met))


def test_ann_widths(spark):
    """Each width is searched by itself."""
    rows = [(0, [0.0, 1.0]), (1, [0.0, 2.0]), (100, [1.0, 0.0, 0.0]), (101, [2.0, 0.0, 0.0]), (200, [1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 1.0), (100, 1, 101, 1.0)]


def test_langid(spark, docs):
    got = langid.identify(docs, train=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).withColumnRenamed("doc_id", "id")
    joined = docs.join(got, F.col("doc_id") == F.col("id")).filter("doc_id < 100000 AND crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in joined) / len(joined) > 0.9
    odd = {r["id"]: (r["lang_pred"], r["score"]) for r in got.filter("id >= 100000").collect()}
    assert odd[100_000] == odd[100_002] == odd[100_003] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in odd.values())
    model = langid.fit([("en", "the cat and the dog " * 20), ("de", "der hund und die katze " * 20)] * 3)
    assert [x for _, x in model.words("the dog and der hund und die")] == ["en"] * 3 + ["de"] * 4


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton():
    """The automaton against Levenshtein distances, on words and stems over few letters."""
    import pyarrow as pa

    rng = random.Random(8)
    some = lambda low, high: "".join(rng.choice("abc") for _ in range(rng.randint(low, high)))
    for _ in range(12):
        words, stems = sorted({some(3, 8) for _ in range(4)}), sorted({some(4, 7) for _ in range(3)})
        automaton = toxicity.Automaton(words, stems)
        asked = ["", *words, *stems, *[some(1, 10) for _ in range(400)]]
        for word, (term, edits) in zip(asked, automaton.match(pa.array(asked)).tolist(), strict=True):
            cost = [distance(word, w) for w in words] + [min(distance(word[:n], s) for n in range(len(word) + 1)) for s in stems]
            fine = [(c, i) for i, c in enumerate(cost) if c <= (len(automaton.terms[i]) >= toxicity.FUZZY)]
            assert (edits, term) == min(fine, default=(-1, -1)), word


def test_toxicity(spark):
    """Learned outside a fold, precise in it for every language; whole words and stems, misspelt ones too."""
    rng = random.Random(12)
    syllables = ["ta", "re", "mo", "li", "sen", "du", "vor", "ni", "ka", "pel"]
    filler = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))
    terms = {"en": ["idiot", "disgusting"], "de": ["blödwicht", "achlachkeit"], "fr": ["réeuxment"]}
    texts, labels = [], []
    for i in range(1600):
        lang = rng.choice(list(terms))
        toxic = i % 4 == 0
        word = rng.choice(terms[lang])
        if i % 5 == 0:  # one letter left out or another
            at = rng.randrange(1, len(word))
            word = word[:at] + rng.choice(["", "q"]) + word[at + 1 :]
        texts.append((i, f"{filler(rng.randint(3, 60))} {word if toxic else filler(1)} {filler(8)}", lang))
        labels.append((i, int(toxic)))
    df, known = spark.createDataFrame(texts, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = {r["doc_id"]: r for r in toxicity.score(df, known, train=~held).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    for lang in terms:
        fold = [i for i, _, x in texts if x == lang and zlib.crc32(str(i).encode()) % 4 == 2]
        right, said, true = (sum(map(f, fold)) for f in (lambda i: got[i]["predicted"] * labels[i][1], lambda i: got[i]["predicted"], lambda i: labels[i][1]))
        assert right >= 0.9 * true > 0 and right >= 0.9 * said, lang


def test_toxicity_real(spark):
    """On the labelled documents, outside the fold that teaches."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = toxicity.score(docs, labels, train=~held).join(labels, "doc_id").filter(held).collect()
    true, said, right = (sum(f(r) for r in found) for f in (lambda r: r["toxic"] == 1, lambda r: r["predicted"], lambda r: r["predicted"] * (r["toxic"] == 1)))
    assert right >= 0.6 * true > 0 and right >= 0.9 * said


def test_toxicity_prior(spark):
    """Scores are chances at the labels' own share of toxic texts, however the sample is made up."""
    assert toxicity.prior_shift([(1, "a"), (0, "b"), (0, "c")], {1: 10, 0: 20}) == pytest.approx(0)
    assert toxicity.prior_shift([(1, "a"), (0, "b")], {1: 10, 0: 90}) == pytest.approx(np.log(1 / 9))


def test_toxicity_long_texts_only(spark):
    """A class that has only long texts is learned too."""
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(9_000))
    rows = [(i, f"you worthless lot {long} worthless" * 3 if i % 2 else f"a fine day {i}", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, df.select("doc_id", "toxic"), train=F.lit(True)).collect()}
    assert got == {i: i % 2 for i, *_ in rows}


def test_quotation_is_learned():
    """Clean texts quote the words that toxic texts use: reporting words and marks around a hit lower its score, the bare word does not profit."""
    rows = [(1, f"day {i} you idiot go away now") for i in range(60)] + [(0, f"day {i} the report mentioned the word “idiot” as spoken") for i in range(8)]
    rows += [(0, f"day {i} a report mentioned fine weather as spoken") for i in range(300)]
    model = toxicity.Model(rows)
    abuse, quoted, marked = model.score(["you idiot go home", "the report mentioned the word “idiot” as spoken", "he said “idiot” there"])
    assert abuse > 0.9 and quoted < 0.3 and marked < abuse
    assert {"mentioned", "word"} & set(model.context) and toxicity.MARKED in model.context


def test_toxicity_alone():
    """A text scores the same alone and between others, whose quotation marks and reporting words are not its own."""
    rows = [(1, f"you idiot number{i} go away") for i in range(20)] + [(1, f'he said "you idiot number{i}" today') for i in range(5)] + [(0, f"a fine day number{i} it is") for i in range(20)]
    model = toxicity.Model(rows)
    texts = ["you idiot", "a fine day", "go away idiot", "", 'it "was" said']
    between = [x for t in texts for x in ('he said "so"', t, '"it" said he')]
    assert model.score(between)[1::3].tolist() == pytest.approx([model.score([t])[0] for t in texts], abs=1e-12)
    quoted = lambda texts, i: dict(zip(*[x.tolist() for x in model.hits(toxicity.Words(texts))][::3], strict=True))[i]
    assert quoted(['"no"', "idiot", '"yes" he said'], 1) == 0
    assert quoted(['"idiot" there'], 0) > 0.5


def test_langid_many(spark):
    """Seventy languages are all learned, one of them from a single very long text."""
    rng = random.Random(21)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 70 * 12)]
    line = lambda k: " ".join("".join(rng.choices(letters[12 * k : 12 * k + 12], k=4)) for _ in range(8))
    rows = [(100 * k + j, line(k), f"l{k:02}") for k in range(69) for j in range(12)]
    rows += [(9_000, "\n".join(line(69) for _ in range(2_000)), "l69"), (9_001, line(69), None)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train=F.lit(True)).collect()}
    assert sum(got[i] == f"l{min(i // 100, 69):02}" for i, *_ in rows) >= 0.98 * len(rows)
    assert got[9_001] == "l69" and len(set(got.values())) == 70


def test_forward_backward():
    """Marginals and expected transitions against all label paths of short chains."""
    import itertools

    random = np.random.default_rng(3)
    lengths, labels = np.array([1, 4, 2, 5]), 3
    starts = np.cumsum(lengths) - lengths
    emissions, transitions = random.normal(size=(lengths.sum(), labels)), random.normal(size=(labels, labels))
    marginals, expected = langid.forward_backward(emissions, starts, lengths, transitions, pairs=True)
    want, pairs = np.zeros_like(marginals), np.zeros_like(transitions)
    for start, length in zip(starts, lengths, strict=True):
        paths = list(itertools.product(range(labels), repeat=int(length)))
        weight = np.exp([sum(emissions[start + i, y] for i, y in enumerate(p)) + sum(transitions[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            for i, y in enumerate(p):
                want[start + i, y] += w
            for a, b in itertools.pairwise(p):
                pairs[a, b] += w
    assert np.allclose(marginals, want) and np.allclose(expected, pairs)


def test_tag_clash(spark):
    """Columns of the new names are replaced; with other names they stay."""
    df = spark.createDataFrame([("the cat and the dog", "en", "old", 1), ("der hund und die katze", "de", "old", 2), (None, "en", None, 3)], "text string, lang string, lang_pred string, n int")
    tagged = langid.tag(df, F.lit(True))
    assert tagged.columns == ["text", "lang", "n", "lang_pred", "lang_score"]
    assert [r["lang_pred"] for r in tagged.orderBy("n").collect()] == ["en", "de", "und"]
    kept = langid.tag(df, F.lit(True), pred_col="p", score_col="s").orderBy("n").collect()
    assert [(r["lang_pred"], r["p"]) for r in kept] == [("old", "en"), ("old", "de"), (None, "und")]


def test_keep_one(spark):
    """A row is known by id and text: other texts of its id stay, nulls and texts without words too."""
    t, u = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, t), (2, t), (2, u), (3, None), (4, ""), (None, t), (None, "no id at all in this row"), (None, "no id at all in this row"), (5, " ".join(["x"] * 5_000)), (6, " ".join(["x"] * 6_000)), (7, "lone"), (7, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("class", F.lit(1))
    kept = partenum.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    want = [(1, t), (2, u), (3, None), (4, ""), *rows[6:9], (7, "lone"), (7, "lone")]
    assert got == sorted(want, key=repr)
    twice = spark.createDataFrame([(1, t), (1, t.upper() + " END"), (2, t)], "doc_id long, text string")  # one component whose name stands under two texts
    assert partenum.keep_one(twice).count() == 1
    assert partenum.keep_one(df.limit(0)).count() == 0


def test_worker_cache():
    """An operator finds what it kept; what others kept is gone."""
    common.worker_cache("a")["x"] = 1
    assert common.worker_cache("a") == {"x": 1}
    common.worker_cache("b")["y"] = 2
    assert common.worker_cache("b") == {"y": 2} and common.worker_cache("a") == {}


def test_worker_gives_back(monkeypatch):
    """What an operator freed goes back to the system when another one begins, whether or not it kept anything."""
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    for operator in ("c", "c", "d", "c"):
        common.worker_cache(operator)
    assert len(calls) == 3
    monkeypatch.undo()
    common.give_back()


def test_small_batches(spark):
    """The stages of the pipeline that run in Python get long texts in batches of a few MB, not of 64; a size that someone chose stays."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 200_000).alias("text"), F.lit("en").alias("lang"))
    sizes = lambda: [r["n"] for r in texts.select("text").mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    stages = [lambda: partenum.classes(texts), lambda: langid.tag(texts.limit(1), F.lit(True)), lambda: bpe.token_digests(texts, path, public_tokenizers.PATTERN)]
    try:
        for stage in stages:
            spark.conf.unset(common.BATCH_SETTING)
            stage()
            assert sum(sizes()) >= 40_000_000 and max(sizes()) <= 2 * common.BATCH
        spark.conf.set(common.BATCH_SETTING, "3000000")
        partenum.classes(texts)
        assert spark.conf.get(common.BATCH_SETTING) == "3000000"
    finally:
        spark.conf.unset(common.BATCH_SETTING)


def test_clean_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    folder = common.new_folder(spark, "x")
    spark.range(3).write.parquet(folder)
    (tmp_path / "other").mkdir()
    common.clean_up(spark)
    common.clean_up(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["other"]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    empty = [
        dedup.exact_dedup(none), mixing.plan_mix(none), mixing.apply_mix(none), partenum.near_duplicates(none), pii.detect(none), bpe.token_digests(none, path, public_tokenizers.PATTERN),
        langid.identify(none, F.lit(True)), toxicity.score(none, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True)), warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")),
        token_store.token_store(none, public_tokenizers.path("word_bpe_49k.json"), 2, 2), ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ]
    assert [df.count() for df in empty] == [0] * len(empty)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        after.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert docs.columns == source.columns
        rows, kept = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()], sorted(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "language_id":
            assert len(kept) >= 0.97 * sum(any(c.isalpha() for c in t or "") for _, t in rows)
        if name == "exact_dedup":
            newest = {}
            for i, t in rows:
                newest[(t or "").lower()] = max(i, newest.get((t or "").lower(), i))
            assert kept == sorted(newest.values())
        if name == "ngram_jaccard_join":
            assert kept == sorted(i for i, (_, c) in brute_components(rows).items() if i == c)
        if name == "source_mixing":
            want = sorted(r["doc_id"] for r in mixing.plan_mix(before).collect() for _ in range(r["copies"]))
            assert kept == want and len(kept) > 0
        if name == "byte_bpe":
            assert kept == sorted(i for i, _ in rows)


def test_pipeline_edges(spark):
    """Every stage on nulls, empty and very long texts, repeated rows, clashing columns, and an empty table."""
    import corpus_pipeline

    real = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = [(100_000 + i, t, None if i % 2 else "en", None if i % 3 else "odd", None) for i, t in enumerate(ODD)]
    extra = spark.createDataFrame([*odd, odd[4], odd[4], (None, "no id here at all today", None, None, 1), (100_004, "another text of this id", "en", "odd", 1)], DOC)
    docs = real.unionByName(extra)
    for name in ("lang_pred", "lang_score", "text_sha256", "kept", "class", "component_id", "copies", "taken", "n_tokens", "group_size", "size"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs = docs.cache()
    every = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        got = after.collect()
        if name == "byte_bpe":
            assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in every.elements())
        else:
            assert after.columns == docs.columns and all(r["kept"] == "clash" for r in got)
            left[name] = collections.Counter((r["doc_id"], r["text"]) for r in got)
            assert name == "source_mixing" or left[name] <= every
        assert stage(spark, docs.limit(0), SF).count() == 0
    letters = {(i, t) for i, t in every if any(c.isalpha() for c in t or "")}
    assert set(left["language_id"]) <= letters and len(left["language_id"]) >= 0.9 * len(letters)
    assert set(left["exact_dedup"]) == {x for x in every if x[0] == max((i for i, t in every if (t or "").lower() == (x[1] or "").lower() and i is not None), default=None)}
    assert (100_004, "another text of this id") in left["ngram_jaccard_join"] and (None, "no id here at all today") in left["ngram_jaccard_join"]


def test_language_stage(spark):
    """Texts without letters and texts torn between languages go; clean texts stay."""
    import corpus_pipeline

    rng = random.Random(31)
    words = {"en": "the cat and dog with house water which green there", "de": "der hund und die katze mit haus wasser welche grün", "fr": "le chien et la chatte avec maison eau quelle verte", "es": "el perro y gato con casa agua cuál verde donde"}
    say = lambda lang, n: " ".join(rng.choices(words[lang].split(), k=n))
    clean = [(i, say(lang, 30), lang, "s", 0) for i, lang in enumerate(sorted(words) * 40)]
    torn = [(1_000 + i, "\n".join(say(lang, 10) for lang in sorted(words)), None, "s", 0) for i in range(10)]
    blank = [(2_000, "12 34 ... !!", "en", "s", 0), (2_001, None, "en", "s", 0)]
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, spark.createDataFrame(clean + torn + blank, DOC), SF).collect()}
    assert kept == {i for i, *_ in clean}
