"""Chunked token counts equal those of the whole text."""

import random

import pytest

from hostpulse.llm import tokens
from hostpulse.llm.queries import op7_token_counts

FILE = "byte_bpe_50k.json"
PIECES = ["the ", "  ", "\n\n\t", "it's", "'", "don't we'll", "é", "漢字かな", "12345", "!!!", "<|endoftext|>", "<|endof", "text|>", "a" * 40, " " * 30, "🙂🙃"]


def whole(text):
    return len(tokens.tokenizer(FILE).encode(text, add_special_tokens=False))


@pytest.mark.parametrize("seed", range(40))
def test_chunks_give_the_count_of_the_whole(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 400)))
    assert tokens.count_long(tokens.tokenizer(FILE), text, chunk=rng.choice([60, 100, 333]), overlap=rng.choice([20, 40]), margin=16) == whole(text)


@pytest.mark.parametrize("text", ["", "a" * 5000, " " * 5000, "ab " * 3000, "\n" * 999 + "x", "é" * 700, "<|endoftext|>" * 200])
def test_texts_without_safe_places_widen_the_overlap(text):
    assert tokens.count_long(tokens.tokenizer(FILE), text, chunk=128, overlap=32, margin=16) == whole(text)


def test_table(spark):
    rows = [(1, "Hello world", 7), (2, None, 8), (2, None, 8), (None, "", 9), (4, "word " * 20000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_TOKENS int")
    got = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in tokens.with_token_counts(docs, chunk=2000).collect()}
    assert got == {(1, 11): (2, False), (2, 0): (0, False), (None, 0): (0, False), (4, 100000): (whole("word " * 20000), True)}
    assert tokens.with_token_counts(docs.limit(0)).count() == 0
    assert tokens.with_token_counts(docs).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


@pytest.mark.parametrize("seed", range(60))
def test_pieces_give_the_count_of_the_whole(seed):
    rng = random.Random(seed)
    more = [" ", " ", " a", "\u00a0", "\u180e", "\u2003", "\x1c", "\x85", "\u3000", "\u200b", " <|endoftext|>", " '", "'ll", " 1a", "_", "\r\n", "Ω", "א", " \u0301"]
    texts = ["".join(rng.choice(PIECES + more) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    t, known = tokens.tokenizer(FILE), {}
    assert tokens.separable(t)
    for most in (1 << 20, 50):
        for a in range(0, 40, 7):
            assert tokens.counts_by_piece(t, texts[a : a + 7], known, most) == [whole(x) for x in texts[a : a + 7]]
    assert not known  # forgotten in between


def test_other_vocabularies_are_not_cut():
    assert not tokens.separable(tokens.tokenizer("word_bpe_49k.json"))
    t = tokens.tokenizer("word_bpe_49k.json")
    text = "Some words, AND more of them. " * 40
    assert tokens.counts(t, [text], 10_000, 100, 64, None) == [len(t.encode(text, add_special_tokens=False))]


def test_counts_of_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.n_tokens for r in op7_token_counts(spark, folder).collect()}
    assert got == {d: whole(x or "") for d, x in texts.items()}
