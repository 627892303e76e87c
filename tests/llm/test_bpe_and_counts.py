import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from strandloom.llm import op1_bpe, op8_token_counts

PIECES = ["a", "b", " ", "e", "'", "  ", "\n", "\t", "'ll", "'re", "s", "t", "é", "ç", "0", "1", ".", ",", "!", "漢", "🙂", "\x85", "\x1c", "the", "ing", "aaaa", "----", "    ", "<|endoftext|>"]


def texts(n, most=25, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, most))) for _ in range(n)]


def reference():
    ranks = op1_bpe.ranks(public_tokenizers.path(op1_bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_tiktoken_and_decode_to_the_text():
    enc = reference()
    some = texts(2000) + ["word " * 40000, "x" * 2000 + " y" * 70000]
    for text, ids in zip(some, op1_bpe.encode_texts(some)):
        assert ids == enc.encode_ordinary(text)
        assert op1_bpe.decode_ids(ids) == text.encode()


def test_other_pattern():
    pattern = r"\p{L}+|\P{L}+"
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=op1_bpe.ranks(public_tokenizers.path(op1_bpe.RANKS)), special_tokens={})
    some = texts(200)
    assert op1_bpe.encode_texts(some, pattern=pattern) == [enc.encode_ordinary(t) for t in some]


def test_spans_of_split_characters():
    ids = op1_bpe.encode_texts(["a漢🙂b"])[0]
    spans = op1_bpe.character_spans(ids)
    assert spans[0] == (0, 1) and spans[-1] == (3, 4)
    assert all(a < b for a, b in spans) and {i for a, b in spans for i in range(a, b)} == {0, 1, 2, 3}


def test_spans_and_splits_against_bytes():
    """Where each token's bytes lie among the characters' bytes; a token splits one if it begins inside."""
    table = {i: t for t, i in op1_bpe.ranks(public_tokenizers.path(op1_bpe.RANKS)).items()}
    known = op1_bpe.token_bytes(public_tokenizers.path(op1_bpe.RANKS))
    assert {i: t for i, t in enumerate(known) if t is not None} == table
    goes_on = op1_bpe.token_starts(public_tokenizers.path(op1_bpe.RANKS))[1]
    some = texts(300, seed=9) + ["漢字" * 30 + "🙂é\u0301ก"]
    for text, ids in zip(some, op1_bpe.encode_texts(some)):
        of = [k for k, c in enumerate(text) for _ in c.encode()]
        at, spans, split = 0, [], 0
        for i in ids:
            spans.append((of[at], of[at + len(table[i]) - 1] + 1))
            split += at > 0 and of[at] == of[at - 1]
            at += len(table[i])
        assert op1_bpe.character_spans(ids) == spans
        assert int(goes_on[ids].sum() if ids else 0) == split
    assert op1_bpe.character_spans([]) == []


def test_encode_and_decode_frames(odd, empty):
    rows = {(r.doc_id, r.text): r for r in op1_bpe.decode(op1_bpe.encode(odd)).collect()}
    want = {(r.doc_id, r.text or "") for r in odd.collect()}
    assert set(rows) == want
    spans = op1_bpe.encode(odd.filter("doc_id = 9")).first()
    assert [tuple(x) for x in zip(spans.char_start, spans.char_end)] == op1_bpe.character_spans(spans.ids)
    assert op1_bpe.encode(empty).count() == 0


def test_round_trip_digests(odd):
    enc = reference()
    got = op1_bpe.round_trip(odd, with_ids=True).collect()
    assert len(got) == odd.count()
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in got:
        ids = enc.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, np.frombuffer(r.ids, "<u2").tolist()) == (len(ids), ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_count_at_every_prefix():
    counter = op8_token_counts.counter(public_tokenizers.path(op8_token_counts.MODEL))
    library = Tokenizer.from_file(public_tokenizers.path(op8_token_counts.MODEL))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for text in texts(300):
        want = [count(text[:n]) for n in range(len(text) + 1)]
        assert counter.prefix_table(text) == want, text
        words = counter.split_words(text)
        for limit in (0, 1, 3, 7):
            assert want[counter.fit(words, counter.counts(words), limit)] <= limit


def test_long_words_take_linear_time():
    """A word of 100,000 letters, bytes of a base64 run, blanks: each prefix is counted once."""
    counter = op8_token_counts.counter(public_tokenizers.path(op8_token_counts.MODEL))
    library = Tokenizer.from_file(public_tokenizers.path(op8_token_counts.MODEL))
    rng = random.Random(7)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    for text in (letters, base64.b64encode(rng.randbytes(75_000)).decode(), " " * 100_000 + "x", "é" * 100_000):
        began = time.perf_counter()
        words = counter.split_words(text)
        counts = counter.counts(words)
        fits = counter.fit(words, counts, 1024)
        assert time.perf_counter() - began < 10
        assert sum(counts) == len(library.encode(text, add_special_tokens=False).ids)
        assert len(library.encode(text[:fits], add_special_tokens=False).ids) <= 1024 < len(library.encode(text[: fits + 1], add_special_tokens=False).ids)


def test_forgotten_words_change_nothing(monkeypatch):
    path = public_tokenizers.path(op8_token_counts.MODEL)
    some = texts(200, seed=4)
    fresh, tight = op8_token_counts.PrefixCounter(path), op8_token_counts.PrefixCounter(path)
    want = [fresh.prefix_table(t) for t in some]
    monkeypatch.setattr(op8_token_counts, "KEPT_BYTES", 2000)
    monkeypatch.setattr(op8_token_counts, "KEPT_PAIRS", 10)
    assert [tight.prefix_table(t) for t in some] == want and tight.kept <= 2000


def test_token_counts(odd, empty):
    library = Tokenizer.from_file(public_tokenizers.path(op8_token_counts.MODEL))
    text = {r.doc_id: r.text or "" for r in odd.collect()}
    got = op8_token_counts.token_counts(odd, limit=20).collect()
    assert len(got) == odd.count()
    for r in got:
        own = text[r.doc_id]
        n = len(library.encode(own, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(own.encode()), n, n > 20)
        assert len(library.encode(own[: r.fit_chars], add_special_tokens=False).ids) <= 20
    assert op8_token_counts.token_counts(empty).count() == 0
    assert op8_token_counts.prefix_counts(odd.filter("doc_id = 2")).first().counts == [0]
