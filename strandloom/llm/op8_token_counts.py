"""Exact token counts for every prefix of a text.

A sequence of tokens is the encoding of its bytes exactly when each two
neighbours are the encoding of theirs. So the encoding of a prefix that ends at
byte i has one last token: the one that ends there and is compatible with the
last token of the prefix before it. Going through a word once from left to
right gives the count at every prefix; words are kept with their tables, and
a text's counts are running sums over its words. Questions about budgets and
truncation read these tables. Only where the end of a prefix changes how the
text splits into words (within a run of white space, a contraction or a special
token) are the few words there looked up under their new split.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
from array import array
from collections import defaultdict
from collections.abc import Sequence

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer, pre_tokenizers

from .common import documents, map_texts
from .op1_bpe import byte_characters

MODEL = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of words and tables that a task keeps, about; all are dropped when there are more. A longer word than KEPT_WORD is not kept.
KEPT_BYTES, KEPT_WORD, ENTRY_BYTES = 160 << 20, 4096, 160
#: Pairs of tokens of which is known whether they can follow each other; all are forgotten when there are more.
KEPT_PAIRS = 1_000_000
#: Below U+0558 and in general punctuation both pattern engines agree on classes; other texts are split by the tokenizers library itself.
UNSURE = regex.compile("[^\\x00-՗‐-›€]")
BLANK = regex.compile(r"\s+").fullmatch


class PrefixCounter:
    """Token counts of prefixes, for one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        kind = said["pre_tokenizer"]
        if kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or said["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE with its own pattern and no normalizer")
        code = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"] for t in said["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in said["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take in their surroundings")
        self.model = tokenizer.model
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.specials = special
        self.bytes_of: dict[int, bytes] = {}
        self.ids: dict[bytes, int] = {}
        lengths = defaultdict(set)
        for spelled, i in said["model"]["vocab"].items():
            if spelled not in special:
                token = bytes(code[c] for c in spelled)
                self.ids[token], self.bytes_of[i] = i, token
                lengths[token[-2:]].add(len(token))
        self.lengths = {tail: sorted(n, reverse=True) for tail, n in lengths.items()}
        #: Tokens that the merges can make; the others never end a prefix.
        self.alone: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Each word's table: the count at every character, from 0 to the word's length.
        self.words: dict[str, Sequence[int]] = {t: [0, *[1] * len(t)] for t in special}
        self.kept = 0

    def _is(self, data: bytes, ids: list[int]) -> bool:
        chars = byte_characters()
        return [t.id for t in self.model.tokenize("".join(chars[b] for b in data))] == ids

    def _whole(self, token: int) -> bool:
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = self._is(self.bytes_of[token], [token])
        return known

    def _fits(self, left: int, right: int) -> bool:
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._is(self.bytes_of[left] + self.bytes_of[right], [left, right])
        return known

    def table(self, word: bytes) -> list[int]:
        """The count at every byte of a word, from 0 to its length."""
        last, count, ids, pairs, lengths = [-1], [0], self.ids, self.pairs, self.lengths
        for end in range(1, len(word) + 1):
            found = -1
            for tail in ((word[end - 2 : end], word[end - 1 : end]) if end > 1 else (word[:1],)):
                for n in lengths.get(tail, ()):
                    start = end - n
                    if start < 0 or (token := ids.get(word[start:end], -1)) < 0:
                        continue
                    before = last[start]
                    if before >= 0:
                        fits = pairs.get((before, token))
                        if not (self._fits(before, token) if fits is None else fits):
                            continue
                    if self._whole(token):
                        found = token
                        break
                if found >= 0:
                    break
            last.append(found)
            count.append(count[start] + 1)
        return count

    def stored(self, word: str) -> Sequence[int]:
        """The table of a word at its characters."""
        if (known := self.words.get(word)) is not None:
            return known
        data = word.encode()
        counts = self.table(data)
        if len(data) > len(word):
            counts = [n for n, b in zip(counts, data + b"a") if b & 0xC0 != 0x80]
        known = bytes(counts) if len(data) < 256 else array("I", counts)
        if len(word) <= KEPT_WORD:
            self.kept += ENTRY_BYTES + 2 * len(data)
            if self.kept > KEPT_BYTES:
                self.words = {t: [0, *[1] * len(t)] for t in self.specials}
                self.kept = ENTRY_BYTES + 2 * len(data)
            self.words[word] = known
        return known

    def size(self, word: str) -> int:
        """The tokens of a word."""
        return self.stored(word)[-1]

    def split_words(self, text: str) -> list[str]:
        """The words that are encoded one by one; special tokens are words of their own."""
        out: list[str] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                out.append(part)
            elif UNSURE.search(part):
                out += [part[a:b] for _, (a, b) in self.split(part)]
            else:
                out += self.pattern.findall(part)
        return out

    def counts(self, words: list[str]) -> list[int]:
        """The tokens of each word."""
        known = self.words
        return [known[w][-1] if w in known else self.stored(w)[-1] for w in words]

    def _inside(self, words: list[str], k: int) -> list[int]:
        """For n from 1 to the length of word k: tokens that its first n characters add to, or put in place of, those of the words before it."""
        word, before = words[k], words[k - 1] if k else ""
        if word in self.specials:  # not special until its end, and so it joins the word before it
            joined = before if before not in self.specials else ""
            base = self.size(joined) if joined else 0
            return [sum(self.counts(self.split_words(joined + word[:n]))) - base for n in range(1, len(word))] + [1]
        inside = list(self.stored(word))[1:]
        if before and BLANK(before) and word[0].isspace():  # a run of white space at the end is one word
            j = k
            while j and BLANK(words[j - 1]):
                j -= 1
            run, base = "".join(words[j:k]), sum(self.counts(words[j:k]))
            blank = next((n for n, c in enumerate(word) if not BLANK(c)), len(word))
            inside[:blank] = [n - base for n in self.stored(run + word[:blank])[len(run) + 1 :]]
        elif word[0] == "'" and word[1:2].isalpha():  # half a contraction is two words
            inside[: len(word) - 1] = range(1, len(word))
        return inside

    def prefix_table(self, text: str) -> list[int]:
        """The exact token count of text[:n], for n from 0 to the text's length."""
        words, out, before = self.split_words(text), [0], 0
        for k, word in enumerate(words):
            out += [before + n for n in self._inside(words, k)]
            before += self.size(word)
        return out

    def fit(self, words: list[str], counts: list[int], limit: int) -> int:
        """Characters of the longest prefix, up to the word that passes the limit, with at most `limit` tokens."""
        sums = list(itertools.accumulate(counts))
        k = bisect.bisect_right(sums, limit)
        length = sum(map(len, words[:k]))
        if k == len(words):
            return length
        room = limit - (sums[k - 1] if k else 0)
        inside = self._inside(words, k)
        return length + next((n for n in range(len(inside) - 1, 0, -1) if inside[n - 1] <= room), 0)


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT, carry: bool = False) -> DataFrame:
    """Per row: n_bytes (UTF-8), n_tokens, over_limit, and fit_chars, the characters that the limit leaves room for.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit).
    Repeated rows each get their counts; an empty table stays empty.
    """
    path = path or public_tokenizers.path(MODEL)
    schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> dict:
        count, rows = counter(path), []
        for text in batch.column(text_col).to_pylist():
            words = count.split_words(text or "")
            counts = count.counts(words)
            total = sum(counts)
            rows.append((len((text or "").encode()), total, total > limit, len(text or "") if total <= limit else count.fit(words, counts, limit)))
        return dict(zip(schema.names, map(list, zip(*rows)))) if rows else {n: [] for n in schema.names}

    return map_texts(df, [id_col, text_col], schema, run, text_col, carry)


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row the whole table: counts[n] is the token count of the first n characters. Null: the empty text's [0]."""
    path = path or public_tokenizers.path(MODEL)
    schema = T.StructType([T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return map_texts(df, [id_col, text_col], schema, lambda batch: {"counts": [counter(path).prefix_table(t or "") for t in batch.column(text_col).to_pylist()]}, text_col)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
