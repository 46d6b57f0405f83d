"""Token counts by overlap resynchronisation.

Texts up to one chunk are encoded in one go. A longer text is encoded in overlapping chunks. Both chunks
see the overlap; the splice is at a place where both begin a pre-token. From such a place on the pre-tokeniser,
which reads left to right and never looks back, must split alike in both, so the place is proven stable as long
as the left chunk could look far enough past it. Where an overlap has no such place it is doubled, up to the
rest of the text, so the count is that of the whole text in every case.

Where the vocabulary's pre-tokeniser is known always to begin a pre-token at a single blank between other characters, texts of
one chunk are cut there, and each distinct piece is encoded once per task and looked up from then on.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.llm.common import PIECE, extended, fresh_name, pieces, slices, text_bytes, texts_of

#: Characters a chunk and its overlap start with.
CHUNK, OVERLAP = 32_768, 1_024
#: Characters a left chunk must see beyond a splice: more than any look-ahead or special string needs.
MARGIN = 64
#: Bytes of text encoded at a time.
BATCH_BYTES = 4 << 20

#: Characters of pieces whose counts a task keeps. Past them it forgets all, which changes no count.
KNOWN_CHARS = 8 << 20
#: Before a blank that is alone between characters which are no white space by any table.
_BORDER = re.compile("(?<=[^\\s\u180e])(?= [^\\s\u180e])")

_LOADED: dict[str, object] = {}


def tokenizer(name: str):
    """The public tokenizer file ``name``, or the file at that path, once per process."""
    if name not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        t.no_truncation()
        t.no_padding()
        _LOADED[name] = t
    return _LOADED[name]


def pretoken_starts(encoding, at: int) -> dict[int, int]:
    """Place in the text where a pre-token begins -> tokens before it. ``at`` is where the chunk begins."""
    starts, last = {}, None
    for k, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != last or word is None:
            starts.setdefault(at + start, k)
            last = word
    return starts


def count_long(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of one text, encoded chunk by chunk."""
    begin, end = 0, min(len(text), chunk)  # begin: a place where a pre-token of the whole text begins
    left = t.encode(text[begin:end], add_special_tokens=False)
    starts, before, total = pretoken_starts(left, begin), 0, 0  # before: tokens of the left chunk ahead of begin
    while end < len(text):
        span, found = overlap, None
        while found is None and span < end - begin:
            at = end - span
            far = min(len(text), end + chunk)
            right = t.encode(text[at:far], add_special_tokens=False)
            others = pretoken_starts(right, at)
            found = next((p for p in others if max(at, begin) < p <= end - margin and p in starts), None)
            span *= 2
        if found is None:  # no common place in all of it: take the left chunk anew and longer
            end = min(len(text), end + (end - begin))
            left = t.encode(text[begin:end], add_special_tokens=False)
            starts, before = pretoken_starts(left, begin), 0
            continue
        total += starts[found] - before
        left, starts, before, begin, end = right, others, others[found], found, far
    return total + len(left) - before


def separable(t) -> bool:
    """Whether the tokens of a text are those of its pieces between ``_BORDER``: proven for byte-level pre-tokenisers with the usual
    pattern, in which a blank begins the word after it and ends nothing, if no normaliser comes first and no added token has or
    takes white space."""
    told = json.loads(t.to_str())
    before = told.get("pre_tokenizer") or {}
    return (
        told.get("normalizer") is None and told.get("post_processor") is None and before.get("type") == "ByteLevel" and before.get("use_regex") is True
        and not before.get("add_prefix_space") and (told.get("model") or {}).get("dropout") is None
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in told.get("added_tokens") or [])
    )


def counts_by_piece(t, texts: list[str], known: dict[str, int], most: int = KNOWN_CHARS) -> list[int]:
    """Tokens of each text, by way of its pieces. ``known`` has the counts of pieces met before and takes the new ones."""
    split = [_BORDER.split(x) for x in texts]
    new = list({p for pieces_ in split for p in pieces_}.difference(known))
    for a, b in slices([len(p) for p in new], BATCH_BYTES):
        known.update(zip(new[a:b], map(len, t.encode_batch_fast(new[a:b], add_special_tokens=False))))
    out = [sum(map(known.__getitem__, pieces_)) for pieces_ in split]
    if sum(map(len, known)) > most:
        known.clear()
    return out


def counts(t, texts: list[str], chunk: int, overlap: int, margin: int, known: dict[str, int] | None = None) -> list[int]:
    """Tokens of each text; with ``known``, by way of pieces where texts are one chunk."""
    out = [0] * len(texts)
    short = [i for i, x in enumerate(texts) if len(x) <= chunk]
    if known is not None:
        for i, n in zip(short, counts_by_piece(t, [texts[i] for i in short], known)):
            out[i] = n
        short = []
    for a, b in slices([len(texts[i]) for i in short], BATCH_BYTES):
        for i, e in zip(short[a:b], t.encode_batch_fast([texts[i] for i in short[a:b]], add_special_tokens=False)):
            out[i] = len(e)
    for i, x in enumerate(texts):
        if len(x) > chunk:
            out[i] = count_long(t, x, chunk, overlap, margin)
    return out


def with_token_counts(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", text: str = "text", limit: int = 1024,
    chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN,
) -> DataFrame:
    """``docs`` without its text, with n_bytes, n_tokens and over_limit (more than ``limit`` tokens).

    The counts are those of the whole text by the library, without added special tokens; special strings in a
    text are handled as the file says. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted
    each. Columns of ``docs`` that clash with the new names are replaced. An empty table gives an empty result.
    ``margin`` must exceed the longest special string of the vocabulary.
    """
    size, many = "n_bytes", "n_tokens"
    others = [c for c in docs.columns if c.lower() not in (text.lower(), size, many, "over_limit")]
    body = fresh_name(docs, "body")
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias(body), text_bytes(f"`{text}`").alias(size))
    kept = rows.drop(body).schema.names

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        known = {} if separable(t) else None
        for b in pieces(batches, body, PIECE):
            yield extended(b, kept, {many: pa.array(counts(t, texts_of(b, body), chunk, overlap, margin, known), pa.int64())})

    schema = rows.drop(body).withColumn(many, F.lit(0).cast("long")).schema
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col(many) > limit)
