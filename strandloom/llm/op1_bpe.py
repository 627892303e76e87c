"""Byte-level byte-pair encoding and decoding.

The tokenizers library encodes Arrow batches. Its merges work on characters,
one for each byte; the table between bytes and characters is made here by rule
and the merges are derived from the ranks. Decoding turns the characters that
spell each token into bytes by the reversed table, so characters that tokens
split come back byte by byte. Offsets count the text's own characters.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .common import documents, map_texts

#: A Spark task has one core; the library's own threads would take those of others, and memory for each.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
RANKS = "byte_bpe_50k.tiktoken"
#: Longer texts are encoded in pieces; a piece ends between a visible ASCII character and a space or newline, where the pattern always ends a match.
PIECE = 1 << 16
CUT = re.compile(r"[!-~](?=[ \n])")


@functools.cache
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is visible, else one from U+0100 on."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.cache
def encoder(path: str, pattern: str) -> Tokenizer:
    """The tokenizer whose merges make each token of the rank file in the order of its rank."""
    known, chars = ranks(path), byte_characters()
    spelled = {token: "".join(chars[b] for b in token) for token in known}
    merges = [
        (spelled[token[:i]], spelled[token[i:]])
        for token in sorted(known, key=known.get)
        for i in range(1, len(token))
        if token[:i] in known and token[i:] in known
    ]
    made = Tokenizer(models.BPE({spelled[token]: rank for token, rank in known.items()}, merges, ignore_merges=True))
    if pattern == public_tokenizers.PATTERN:  # the library's own byte-level pattern
        made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    else:
        made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@functools.cache
def token_bytes(path: str) -> list[bytes | None]:
    """The bytes of every id, by the reversed byte table from the characters that spell its token; None where an id is free."""
    code = {c: b for b, c in enumerate(byte_characters())}
    known = encoder(path, public_tokenizers.PATTERN).get_vocab(with_added_tokens=False)
    table: list[bytes | None] = [None] * (max(known.values()) + 1)
    for spelled, i in known.items():
        table[i] = bytes([code[c] for c in spelled])
    return table


@functools.cache
def token_starts(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For every id how many characters begin in its bytes, and whether the first byte goes on with one."""
    table = [t or b"" for t in token_bytes(path)]
    return np.array([sum(b & 0xC0 != 0x80 for b in t) for t in table], np.int64), np.array([t[:1] != b"" and t[0] & 0xC0 == 0x80 for t in table])


def pieces(text: str) -> list[str]:
    """The text cut where no match of the pattern can run across."""
    if len(text) <= PIECE:
        return [text]
    out, start = [], 0
    while len(text) - start > PIECE and (cut := CUT.search(text, start + PIECE)):
        out.append(text[start : cut.end()])
        start = cut.end()
    return [*out, text[start:]]


def _encoded(texts: list[str], made: Tokenizer, offsets: bool):
    """For each text its list of ids, or of (ids, character offsets)."""
    split = [pieces(text) for text in texts]
    encode = made.encode_batch if offsets else made.encode_batch_fast
    done: list = []
    flat, size = [], 0
    for piece in (p for s in split for p in s):
        flat.append(piece)
        size += len(piece)
        if size > 1 << 18:
            done += [(e.ids, e.offsets if offsets else None) for e in encode(flat, add_special_tokens=False)]
            flat, size = [], 0
    done += [(e.ids, e.offsets if offsets else None) for e in encode(flat, add_special_tokens=False)]
    at = iter(done)
    for parts in split:
        if len(parts) == 1:
            yield next(at)
            continue
        ids, spans, base = [], [], 0
        for part in parts:
            more, where = next(at)
            ids += more
            if offsets:
                spans += [(a + base, b + base) for a, b in where]
            base += len(part)
        yield ids, spans


def encode_texts(texts: list[str], path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> list[list[int]]:
    """The ids of each text."""
    return [ids for ids, _ in _encoded(texts, encoder(path or public_tokenizers.path(RANKS), pattern), False)]


def decode_ids(ids: list[int], path: str | None = None) -> bytes:
    """The bytes of the ids, one after the other."""
    table = token_bytes(path or public_tokenizers.path(RANKS))
    return b"".join([table[i] for i in ids])


def packed_ids(ids: list[int], path: str) -> bytes:
    """The ids as little-endian numbers: of two bytes if the vocabulary allows it, else of four."""
    return np.array(ids, "<u2" if len(token_bytes(path)) <= 1 << 16 else "<u4").tobytes()


def character_spans(ids: list[int], path: str | None = None) -> list[tuple[int, int]]:
    """The first and behind-the-last character that each token touches in the decoded text.

    A token that ends within a character's bytes touches it, and so does the
    next token, which holds the rest of them.
    """
    starts, goes_on = token_starts(path or public_tokenizers.path(RANKS))
    own = np.asarray(ids, np.int64)
    begun = np.cumsum(starts[own])  # characters whose first byte was seen
    before = begun - starts[own]
    return list(zip((before - (goes_on[own] & (before > 0))).tolist(), begun.tolist()))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, offsets: bool = True, carry: bool = False) -> DataFrame:
    """Each row's ids, and with `offsets` the characters that every token touches.

    A null text is encoded as an empty one: no ids. Repeated rows and ids stay as
    they are, one row each; an empty table gives an empty table.
    """
    path = path or public_tokenizers.path(RANKS)
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("char_start", "char_end")]

    def run(batch: pa.RecordBatch) -> dict:
        rows = list(_encoded([t or "" for t in batch.column(text_col).to_pylist()], encoder(path, pattern), offsets))
        made = {"ids": [ids for ids, _ in rows]}
        if offsets:
            made |= {"char_start": [[a for a, _ in spans] for _, spans in rows], "char_end": [[b for _, b in spans] for _, spans in rows]}
        return made

    return map_texts(df, [id_col, text_col], T.StructType(fields), run, text_col, carry)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Each row's ids as bytes (`decoded`), as text (`text`; bytes that are no UTF-8 become U+FFFD) and as character spans.

    Null ids give null; unknown ids are an error.
    """
    path = path or public_tokenizers.path(RANKS)
    spans = T.ArrayType(T.IntegerType())
    schema = T.StructType([df.schema[id_col], T.StructField("decoded", T.BinaryType()), T.StructField("text", T.StringType()), T.StructField("char_start", spans), T.StructField("char_end", spans)])

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            data = [None if ids is None else decode_ids(ids, path) for ids in rows]
            where = [None if ids is None else character_spans(ids, path) for ids in rows]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array(data, pa.binary()),
                pa.array([None if d is None else d.decode("utf-8", "replace") for d in data], pa.string()),
                pa.array([None if w is None else [a for a, _ in w] for w in where], pa.list_(pa.int32())),
                pa.array([None if w is None else [b for _, b in w] for w in where], pa.list_(pa.int32())),
            ], names=schema.names)

    return df.select(id_col, ids_col).mapInArrow(run, schema)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False, carry: bool = False) -> DataFrame:
    """Encode each text and decode its ids; return digests of both.

    n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256, and
    n_split (tokens that begin within a character) for every row; a null text
    counts as empty. with_ids adds the ids as `packed_ids` makes them. With
    `carry` the other columns stay too.
    """
    path = path or public_tokenizers.path(RANKS)
    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_split", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.BinaryType())

    def run(batch: pa.RecordBatch) -> dict:
        decimal = _decimals(path)
        goes_on = token_starts(path)[1]
        counts, ids_sha, decoded_sha, split, kept = [], [], [], [], []
        for ids, _ in _encoded([t or "" for t in batch.column(text_col).to_pylist()], encoder(path, pattern), False):
            counts.append(len(ids))
            split.append(int(goes_on[ids].sum()) if ids else 0)
            kept.append(packed_ids(ids, path) if with_ids else None)
            ids_sha.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(decode_ids(ids, path)).hexdigest())
        return {"n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha, "n_split": split, "ids": kept}

    return map_texts(df, [id_col, text_col], schema, run, text_col, carry)


@functools.cache
def _decimals(path: str) -> list[str]:
    return [str(i) for i in range(len(token_bytes(path)))]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
