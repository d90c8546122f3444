"""Byte-level BPE, token alignment and importance resampling: brute force, edges, long texts."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.llm import byte_bpe, importance, token_alignment
from lectern.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a  b <|endoftext|> </s> <s>[INST]"),
       (6, "naïve 漢字 \U0001F9FF\U00012345 é İ ﬁ ▁ x"), (7, "same text here"), (7, "same text here"),
       (None, "no id   here"), (8, "x" * 5000), (9, "0123456789" * 300 + " tail"), (10, "\u0000 nul ﻿ bom"), (11, "漢 漢漢 e漢")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit(5) for c in ("ids", "piece", "a", "b", "n", "bucket", "score", "rank", "weight", "code")})


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


# ---------------------------------------------------------------- byte-level BPE

def tiktoken_encoding():
    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_digests(text, enc):
    ids = enc.encode_ordinary(text)
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(enc.decode_bytes(ids)).hexdigest())


def test_op11_whole_table(spark, texts):
    enc = tiktoken_encoding()
    got = QUERIES["op11_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[1:]) == bpe_digests(texts[r["doc_id"]], enc)


def test_bpe_edges(spark, odd):
    enc = tiktoken_encoding()
    made = byte_bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    got = sorted((tuple(r) for r in byte_bpe.digests(byte_bpe.decode(made, RANKS)).collect()), key=repr)
    assert got == sorted(((i, *bpe_digests(t or "", enc)) for i, t in ODD), key=repr)
    assert byte_bpe.decode(made.limit(0), RANKS).count() == 0


def test_bpe_decode_nulls_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode(rows, RANKS).collect()}
    assert got == {1: b"", 2: b"", 3: b'!"'}
    bad = spark.createDataFrame([(1, [50256])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="outside the rank file"):
        byte_bpe.decode(bad, RANKS).collect()


def test_rank_queue_against_a_plain_merge():
    """Ranks that are not in order of length: a merge may bring up a lower rank than the one at hand."""
    def plain(word, ranks):
        if word in ranks:
            return [ranks[word]]
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            found = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not found:
                return [ranks[p] for p in parts]
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(3)
    for _ in range(300):
        tokens = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(rng.randint(1, 25))}
        tokens = [*tokens, b"a", b"b", b"c"]
        rng.shuffle(tokens)
        ranks = {t: i * rng.choice([1, 3, 700]) + i for i, t in enumerate(tokens)}
        if len(set(ranks.values())) < len(ranks):
            continue
        encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN)
        for _ in range(20):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 30)))
            assert encoder.merge(word) == plain(word, ranks)
            assert encoder.queue.pop() == (-1, []) and not encoder.queue.buckets


def test_rank_queue_finds_the_first_set_bit():
    queue, rng = byte_bpe.RankQueue(50_256), random.Random(5)
    held = defaultdict(list)
    for i in range(5000):
        rank = rng.choice([rng.randrange(50_256), rng.randrange(300)])
        queue.push(rank, i)
        held[rank].append(i)
    while held:
        rank, positions = queue.pop()
        assert rank == min(held) and positions == held.pop(rank)
    assert queue.pop() == (-1, [])


def test_very_long_matches_take_linear_work():
    enc, own = tiktoken_encoding(), byte_bpe._encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(7)
    for text in ("a" * 200_000, " " * 100_000 + "x", "".join(rng.choices("abcdefgh", k=200_000)), "漢é" * 30_000,
                 "word " * 250_000):
        assert np.frombuffer(own.encode(text), np.uint32).tolist() == enc.encode_ordinary(text)


# ---------------------------------------------------------------- token alignment

def aligned(docs):
    """Groups, links and corpus-wide counts from the tokens' bytes alone."""
    import sentencepiece
    from tokenizers import Tokenizer
    a_tok = Tokenizer.from_file(A)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=B)
    byte_of = {}
    free = 256
    for b in range(256):
        if 33 <= b < 127 or 161 <= b < 173 or 174 <= b < 256:
            byte_of[chr(b)] = b
        else:
            byte_of[chr(free)] = b
            free += 1

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(tokens):
        out, at = [], 0
        for i, raw in tokens:
            out.append((at, at + len(raw), i))
            at += len(raw)
        return out

    made, held = [], Counter()
    for doc_id, text in docs:
        a = b = []
        if text:
            whole = (" " + text).encode()
            a = [(i, bytes(byte_of[c] for c in a_tok.id_to_token(i))) for i in a_tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, b_bytes(i)) for i in b_tok.encode(text)]
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a = b = []
        a, b = spans(a), spans(b)
        links, j = [], 0
        for lo, hi, i in a:
            while j < len(b) and b[j][1] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][0] < hi:
                links.append((i, b[k][2]))
                k += 1
        cuts = sorted({x[1] for x in a} & {x[1] for x in b})
        parts, lo = [], 0
        for cut in cuts:
            parts.append("|".join(",".join(str(i) for s, e, i in side if s >= lo and e <= cut) for side in (a, b))
                         if len(a) < 3000 else "")
            lo = cut
        made.append((doc_id, len(a), len(b), len(cuts), links, ";".join(parts)))
        held.update(set(links))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return [(doc_id, na, nb, ng, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
             (hashlib.sha256(s.encode()).hexdigest() if na else "") if na < 3000 else None)
            for doc_id, na, nb, ng, links, s in made]


def compare_alignment(got, want):
    got, want = sorted(map(tuple, got), key=repr), sorted(want, key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7] and w[7] in (None, g[7])


def test_op12_whole_table(spark, texts):
    compare_alignment(QUERIES["op12_token_alignment"](spark, SF).collect(), aligned(texts.items()))


@pytest.mark.parametrize("piece_bytes", [1, token_alignment.PIECE_BYTES])
def test_alignment_edges(spark, odd, piece_bytes):
    got = token_alignment.align(odd, A, B, piece_bytes).collect()
    compare_alignment(got, aligned(ODD))
    by = {r["doc_id"]: r for r in got}
    assert tuple(by[1])[1:] == (0, 0, 0, 0, 0, 0, "")
    assert by[6]["n_a"] == 0                    # its U+2581 does not come back from B
    assert by[11]["n_groups"] > 0


def test_alignment_of_an_empty_table(spark, odd):
    assert token_alignment.align(odd.limit(0), A, B).count() == 0


def test_byte_ends_are_counted_on_inside_characters():
    # three tokens share one character of three bytes; spans say (0, 3) for the last only
    begin, end, width = np.array([0, 2, 2, 2, 5]), np.array([2, 2, 2, 5, 6]), np.array([2, 1, 1, 1, 1])
    assert token_alignment.byte_ends(begin, end, width).tolist() == [2, 3, 4, 5, 6]


# ---------------------------------------------------------------- importance resampling

def drawn(docs, bench, n_min=1, n_max=1):
    def features(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        return words, [" ".join(words[i:i + n]) for n in range(n_min, n_max + 1) for i in range(len(words) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    s = Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = Counter(bucket(f) for x in bench for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        words, fs = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in map(bucket, fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for i, r in enumerate(fit[:10 * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def chosen(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_op13_whole_table(spark, texts):
    bench = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert chosen(QUERIES["op13_importance"](spark, SF)) == drawn(list(texts.items()), bench)


@pytest.mark.parametrize("n_min,n_max", [(1, 1), (1, 3), (2, 2)])
def test_importance_edges(spark, odd, n_min, n_max):
    long = " ".join(f"Wörd{i % 37},{i}" for i in range(3000))
    rows = ODD + [(20 + i, f"{'the Quick brown fox ' * 6}{i}") for i in range(12)] + [(50, long), (50, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("bucket", "n", "score", "rank")})
    target = spark.createDataFrame([(1, "a quick fox"), (2, None), (None, "FOX fox"), (3, "")], "item_id long, text string")
    assert chosen(importance.resample(docs, target, n_min, n_max)) == drawn(rows, [r["text"] for r in target.collect()], n_min, n_max)


@pytest.mark.parametrize("n_min,n_max", [(1, 1), (1, 3), (2, 2), (3, 3)])
def test_blocks_of_a_long_text_lose_no_feature(n_min, n_max, monkeypatch):
    text = " ".join(f"w{i % 11}{'x' * (i % 90)}" for i in range(500)).encode()
    words = text.split()
    want = Counter(b" ".join(words[i:i + n]) for n in range(n_min, n_max + 1) for i in range(len(words) - n + 1))
    monkeypatch.setattr(importance, "BLOCK", 64)
    monkeypatch.setattr(importance, "BATCH", 50)
    parts = list(importance._blocks(text, n_min, n_max))
    assert len(parts) > 50 and Counter(g for _, grams in parts for g in grams) == want
    n_words, n = np.zeros(2, np.int64), np.zeros(2, np.int64)
    for _, row in importance._interned([b"", text], n_min, n_max, 10_000, n_words):
        n += np.bincount(row, minlength=2)
    assert n_words.tolist() == [0, 500] and n.tolist() == [0, sum(want.values())]


def test_importance_of_empty_tables(spark, odd):
    target = spark.createDataFrame([(1, "a quick fox")], "item_id long, text string")
    assert importance.resample(odd.limit(0), target).count() == 0
    assert chosen(importance.resample(odd, target.limit(0))) == drawn(ODD, [])


def test_interning_verifies_bytes(monkeypatch):
    """All keys equal: only the bytes tell features apart."""
    monkeypatch.setattr(importance.xxhash, "xxh64_intdigest", lambda b: 7)
    grams = [b"a", b"b", b"a", b"c", b"b", b"a"]
    table = importance.Table(grams, 10_000)
    assert len(set(table.slot.tolist())) == 3 and table.slot[0] == table.slot[2] == table.slot[5]
    assert sorted(table.count[table.used].tolist()) == [1, 2, 3]
    assert table.bucket[table.slot].tolist() == [zlib.crc32(g) % 10_000 for g in grams]


def piece_of(texts, units):
    import pyarrow as pa
    piece = token_alignment._Piece(units)
    piece.add(pa.array(range(len(texts)), pa.int64()), texts)
    row = piece.row(1).to_pylist()[0]
    scored = {c: token_alignment.unpack(row[c]).tolist() for c in ("codes", "times", "own", "a", "b", "n")}
    return pa.ipc.open_stream(row["docs"]).read_all().to_pylist(), scored


def test_long_texts_and_texts_taken_whole_give_the_same(monkeypatch):
    """Cut into units, in several blocks, or tokenized whole: one result."""
    v = token_alignment.Vocabularies(A, B)
    rng = random.Random(11)
    words = ["the", "naïve", "漢字", "a.\nb", "don't", "\U0001F9FF", "12", "  x", "ﬁn", "é", "\t", "word" * 9]
    texts = [" ".join(rng.choices(words, k=170_000)), " ".join(rng.choices(words, k=300)), None, "", " x  y ", "bad ▁ one two"]
    assert len(texts[0]) > 1 << 20
    monkeypatch.setattr(token_alignment, "BLOCK_UNITS", 5000)
    cut = piece_of(texts, token_alignment.Units(v))
    v.cuttable = False
    whole = piece_of(texts, token_alignment.Units(v))
    assert cut[0] == whole[0] and cut[0][5]["n_a"] == 0 and cut[0][0]["n_a"] > 170_000

    def links(x):
        at, out = 0, []
        for n in x["own"]:
            out.append(sorted((x["a"][c], x["b"][c], t) for c, t in zip(x["codes"][at:at + n], x["times"][at:at + n])))
            at += n
        return out, sorted(zip(x["a"], x["b"], x["n"]))
    assert links(cut[1]) == links(whole[1])
