"""Every operator and stage on empty tables, nulls, ties, repeated rows, long texts and clashing columns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import (chat_windows, decontaminate, mixing_lm, ngram_join, pii_crf, quality, raking, repeats,
                         token_shards, toxicity)
from lectern.llm.queries import word_bpe_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(6000)) + " " + "x" * 3000
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in jars"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, "one two", "en", None, 7),
            (5, LONG, "en", "s", 1), (6, PASSAGE, "en", "t", 1), (7, PASSAGE, "en", "t", 1), (7, PASSAGE, "en", "t", 1),
            (8, "so " + PASSAGE + " éà \U0001F600", "fr", "t", 1), (None, "no id here at all", "en", "s", 1), (9, "a" * 400, None, "s", 1)]
    df = spark.createDataFrame(rows, COLUMNS)
    # names the operators use themselves
    return df.withColumns({c: F.lit(5) for c in ("component", "key", "n", "score", "kind", "host", "tokens", "topic")})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short"), (None, "x y z a b c"), (4, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, 1, 0), (6, None, None), (None, 1, 1), (8, 0, 1)],
                                 "doc_id long, quality int, toxic int")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_ngram_join(docs):
    got = {r["doc_id"]: r for r in rows(ngram_join.join_components(docs))}
    assert sorted(got) == list(range(1, 10))
    assert [got[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert got[7]["component_id"] == 6 and got[6]["component_id"] == 6
    assert all(got[i]["component_id"] == i for i in (1, 2, 3, 4, 5, 9))


def test_repeats(docs):
    got = rows(repeats.deduplicate(docs))
    assert len(got) == 10 and all(r["doc_id"] is not None for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["n_removed"] == 0 and by[7]["n_removed"] == len(PASSAGE) and by[7]["n_spans"] == 1
    assert by[8]["n_removed"] == len(PASSAGE) and by[8]["kept"].decode() == "so  éà \U0001F600"
    assert by[1]["n_bytes"] == 0 and by[9]["n_removed"] == 0


def test_mixing_lm(docs):
    got = rows(mixing_lm.score(docs))
    assert len(got) == 11 and all(r["score"] <= 0 and r["base_score"] < 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}


def test_toxicity(docs, labels):
    model = toxicity.fit(docs, labels)
    got = rows(toxicity.score(docs, model))
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(docs, model).columns == [c for c in docs.columns if c != "score"] + ["score"]
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r["score"] < 1e-3 for r in rows(toxicity.score(docs, none)))


def test_decontaminate(docs, bench):
    got = rows(decontaminate.annotate(docs, bench))
    assert sorted((r["doc_id"] or 0) for r in got if r["contaminated"]) == [6, 7, 7, 8]
    assert {r["best_item"] for r in got if r["contaminated"]} == {1}
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == 7
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == 11


def test_pii(docs):
    got = rows(pii_crf.find(docs))
    assert len(got) == 11 and {r["spans"] for r in got} == {""}


def test_raking(docs):
    got = rows(raking.weigh(docs))
    assert len(got) == 11 and all(0 <= r["probability"] <= 1 for r in got)
    assert raking.sample(docs).columns == docs.columns


def test_quality(docs):
    got = rows(quality.judge(docs))
    assert len(got) == 11 and {r["n_words"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}


def test_token_shards(docs):
    manifest = token_shards.write_shards(docs, word_bpe_path(), 2)
    got = sorted(rows(token_shards.read_tokens(manifest)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    assert [r["n_tokens"] for r in got[1:4]] == [1, 1, 1]
    starts, n = [r["start"] for r in got], [r["n_tokens"] for r in got]
    assert starts == [sum(n[:i]) for i in range(len(n))]
    wanted = docs.sparkSession.createDataFrame([(4,), (8,), (77,)], "doc_id long")
    assert {r["doc_id"]: len(r["ids"]) for r in rows(token_shards.fetch(manifest, wanted))} == {4: n[4], 8: n[9]}


def test_chat(spark):
    turns = spark.createDataFrame(
        [(1, None, None, None, 1), (1, 0, "user", "<s>a</s>\\[x", 1), (1, 0, "assistant", "b", 1), (1, 0, "assistant", "b", 1),
         (None, 3, "we\nird</s>", "q", 1), (2, 0, "system", "s " * 40, 1)] + [(2, i, "assistant", f"say {i} " * 30, 1) for i in range(1, 40)],
        "conv_id long, turn long, role string, text string, segment int")
    windows = chat_windows.format_windows(turns, budget=256, history=64)
    got = {r["conv_id"]: r for r in rows(chat_windows.read_back(windows))}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 2 and got[None]["n_turns"] == 1
    assert got[2]["n_turns"] == 40 and got[2]["loss_chars"] == sum(len(f"say {i} " * 30) for i in range(1, 40))
    two = [r for r in rows(windows) if r["conv_id"] == 2]
    assert len(two) > 5 and all(r["tokens"] <= 256 or r["n_turns"] == 1 for r in two)
    assert all(r["formatted"].startswith("<s>system\n") for r in two)
    assert rows(chat_windows.read_back(chat_windows.format_windows(turns.limit(0)))) == []


def test_empty_tables(spark, docs, bench, labels):
    none = docs.limit(0)
    assert rows(ngram_join.join_components(none)) == [] and rows(repeats.deduplicate(none)) == []
    assert rows(mixing_lm.score(none)) == [] and rows(pii_crf.find(none)) == []
    assert rows(toxicity.score(none, toxicity.fit(none, labels))) == []
    assert rows(decontaminate.annotate(none, bench)) == [] and rows(quality.judge(none)) == []
    assert rows(raking.weigh(none)) == [] and rows(raking.sample(none)) == []
    assert rows(token_shards.read_tokens(token_shards.write_shards(none, word_bpe_path(), 2))) == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, bench, labels, tmp_dir, name, stage):
    bench.write.parquet(f"{tmp_dir}/benchmark.parquet")
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for given in (own, own.limit(0)):
        out = stage(spark, given, tmp_dir)
        assert out.count() <= given.count()
        if name != "token_ids":
            assert out.columns == own.columns


def test_mixing_lm_of_a_table_united_with_itself(spark):
    base = spark.createDataFrame([(i, " ".join(f"w{i * j % 97}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    got = rows(mixing_lm.score(base.unionByName(base)))
    tokens = {i: [f"w{i * j % 97}" for j in range(60)] + [None] for i in range(40)}
    count = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in 2 * ws)
    n, v = sum(count.values()), len(count)
    assert len(got) == 80
    for r in got:
        ws = tokens[r["doc_id"]]
        assert r["n_known"] == sum(count[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)


@pytest.mark.parametrize("texts", [["TARİHİ. gazete", "GAZETESİ, ve", "işİ."], ["אשׁ. x", "कक़, y"],
                                   ["A <|ENDOFTEXT|> B", "Plain A.", "x <|endoftext|> Y."], ["<|EndOfText|>", "<|STARTOFTEXT|>é É."]])
def test_token_ids_are_those_of_the_whole_text(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(word_bpe_path())
    got = token_shards.PieceEncoder(word_bpe_path(), 2).encode(pa.array(texts))
    assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_pii_finds_every_labelled_line(spark):
    texts, wanted = [], []
    for line in pii_crf.LABELLED + ("write to {email:JANE (AT) EXAMPLE (DOT) ORG} soon",):
        text, spans = "", []
        for part in re.split(r"(\{\w+:[^}]*\})", line):
            m = re.fullmatch(r"\{(\w+):([^}]*)\}", part)
            if m:
                spans.append(f"{m.group(1)}:{len(text)}:{len(text) + len(m.group(2))}")
            text += m.group(2) if m else part
        texts.append(text)
        wanted.append(",".join(spans))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in rows(pii_crf.find(docs))}
    assert {t: got[i] for i, t in enumerate(texts)} == dict(zip(texts, wanted))


def test_mixing_lm_counts_are_exact_at_every_order():
    rng = np.random.default_rng(1)
    texts = ["".join(chr(c) for c in rng.integers(97, 123, 300)) for _ in range(12)] + ["", "zz", "abcabcabc" * 9]
    key, _ = mixing_lm.places(*mixing_lm.textops.text_bytes(pa.array(texts, pa.large_string())))
    strings, times = np.unique(mixing_lm.by_context(key), return_counts=True)
    count = Counter()
    for t in texts:
        raw = bytes(5) + t.encode() + b"\0"
        for i in range(5, len(raw)):
            for k in mixing_lm.ORDERS:
                for j in range(8):
                    count[k, raw[i - k:i], j, raw[i] >> 8 - j, raw[i] >> 7 - j & 1] += 1
    pairs = mixing_lm._pair_counts(strings, times)
    for j, (unit, first, n0, n1) in enumerate(mixing_lm.levels(strings, times, pairs)):
        for i, s in enumerate(strings.tolist()):
            last, before = s & 255, bytes((s >> 8 * b) & 255 for b in range(1, 6))      # farthest byte first
            for k in mixing_lm.ORDERS:
                for bit, n in ((0, n0), (1, n1)):
                    assert n[unit[i], k] == count[k, before[5 - k:], j, last >> 8 - j, bit]


def test_mixing_lm_learns_from_long_texts(spark):
    # letters without order: six bits each; what was seen once says nothing, and that must be learnt
    rng = np.random.default_rng(2)
    texts = [(i, "".join(chr(c) for c in rng.integers(161, 225, 6000))) for i in range(30)]
    got = rows(mixing_lm.score(spark.createDataFrame(texts, "doc_id long, text string")))
    held = [r["bits_per_byte"] * 2 for r in got if r["held_out"]]          # two bytes a letter
    assert held and max(held) < 6.2
