"""SentencePiece models run by the tokenizers library.

``parse_model`` reads the protobuf wire format itself: pieces with scores and kinds, the trainer's model kind
and byte fallback, the normaliser's flags and its compiled character map. ``build`` makes the same tokenizer
from them: normaliser, white-space marker, unigram scores or merges, byte fallback, user-defined pieces first.
``encode_texts`` encodes batches of whole texts on several threads, decodes each result again by the same
library, and compares the ids of every whole text with those of the sentencepiece library (``verify=True``).

Null and empty texts give no ids and decode to ""; texts are encoded whole; repeated rows alike; a key that is
no number becomes null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import CACHES, map_columns, stretches

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Piece:
    text: str
    score: float = 0.0
    kind: int = NORMAL


@dataclass
class Model:
    pieces: list[Piece] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    charsmap: bytes = b""


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of one protobuf message: varints as int, the rest as bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire} in a model file")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = Piece("")
            for k, v in _fields(value):
                if k == 1:
                    piece.text = v.decode()
                elif k == 2:
                    piece.score = struct.unpack("<f", v)[0]
                elif k == 3:
                    piece.kind = v
            model.pieces.append(piece)
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    model.kind = v
                elif k == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    model.charsmap = v
                elif k == 3:
                    model.add_dummy_prefix = bool(v)
                elif k == 4:
                    model.remove_extra_spaces = bool(v)
                elif k == 5:
                    model.escape_spaces = bool(v)
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """The merges behind a merge model: every piece that is two pieces put together, best score first."""
    score = {p.text: p.score for p in model.pieces if p.kind in (NORMAL, USER, UNUSED)}
    found = []
    for p in model.pieces:
        if p.kind in (NORMAL, UNUSED):
            found += [(-p.score, p.text[:i], p.text[i:]) for i in range(1, len(p.text)) if p.text[:i] in score and p.text[i:] in score]
    found.sort(key=lambda x: x[0])
    return [(a, b) for _, a, b in found]


def core_of(model: Model, whole: bool = False):
    """The merges or the unigram lattice, with byte fallback. Words hardly repeat often enough to pay for a cache.
    whole: a word that is a piece is taken without its merges (see ``build_plain``)."""
    from tokenizers import models

    unknown = next((i for i, p in enumerate(model.pieces) if p.kind == UNKNOWN), None)
    if model.kind == BPE:
        return models.BPE({p.text: i for i, p in enumerate(model.pieces)}, merges_of(model), unk_token=None if unknown is None else model.pieces[unknown].text, fuse_unk=True, byte_fallback=model.byte_fallback, cache_capacity=0, ignore_merges=whole)
    elif model.kind == UNIGRAM:
        return models.Unigram([(p.text, p.score) for p in model.pieces], unknown, model.byte_fallback)
    raise ValueError(f"model kind {model.kind} is neither unigram nor merges")


def _decoder(model: Model):
    from tokenizers import decoders

    return decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), decoders.Replace(MARK, " "), *([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])])


def build(model: Model):
    """A tokenizers.Tokenizer that gives the model's ids."""
    from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

    out = Tokenizer(core_of(model))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    steps += [normalizers.Prepend(" ")] if model.add_dummy_prefix else []
    steps += [normalizers.Replace(" ", MARK)] if model.escape_spaces else []
    out.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.text.lstrip(MARK) for p in model.pieces):
        # No piece has the marker after another letter, so no piece crosses the place before a run of markers.
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    out.decoder = _decoder(model)
    return out


def separable(model: Model) -> bool:
    """Whether no piece crosses the place before a run of markers and normalising keeps every letter."""
    return not (model.charsmap or model.remove_extra_spaces) and model.add_dummy_prefix and model.escape_spaces and not any(MARK in p.text.lstrip(MARK) or p.kind == USER for p in model.pieces)


def build_plain(model: Model):
    """The same ids for marked texts (a marker before the text and for every blank, no runs of markers), by the library's
    own marker splitting; None where the model does not allow it. If the merges lead to every piece, as is tried for
    each, a word that is a piece needs no merging."""
    from tokenizers import Tokenizer, pre_tokenizers

    if not separable(model):
        return None
    out = Tokenizer(core_of(model))
    if model.kind == BPE:
        pieces = [p.text for p in model.pieces if p.kind == NORMAL]
        if all(len(e.ids) == 1 for e in out.encode_batch_fast(pieces, add_special_tokens=False)):
            out = Tokenizer(core_of(model, whole=True))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="never", split=True)
    return out


SCHEMA = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean, parity boolean"
#: Letters of text that are encoded at a time (one longer text is taken alone): the tokens of a batch take many times as much memory.
BATCH_LETTERS = 250_000
#: Letters after which the text for the comparison is cut at the next blank, where no piece crosses: the peer sorts what it is given.
STRETCH = 200


class Codec:
    """Encodes batches of whole texts on several threads, decodes the ids again by the same library and compares
    them with the sentencepiece library's ids of the whole text. It keeps nothing from one batch to the next."""

    def __init__(self, data: bytes, verify: bool) -> None:
        from tokenizers import decoders, normalizers

        self.model = parse_model(data)
        self.tokenizer, self.plain = build(self.model), build_plain(self.model)
        self.tokenizer.decoder = decoders.ByteFallback()  # markers become blanks for a whole text at once, in decode
        self.own = {p.text: i for i, p in enumerate(self.model.pieces) if p.kind == USER}
        if self.own:  # user-defined pieces are cut out of the normal text before anything is merged
            self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.own, key=len, reverse=True))) + ")").split
            self.normal, self.tokenizer.normalizer = self.tokenizer.normalizer.normalize_str, normalizers.Sequence([])
        self.peer = None
        if verify:
            from sentencepiece import SentencePieceProcessor

            self.peer = SentencePieceProcessor(model_proto=data)

    def ids(self, texts: list[str]) -> list[list[int]]:
        if self.own:
            parts = [[x for x in self.cut(self.normal(t)) if x] if t else [] for t in texts]
            got = iter(self.tokenizer.encode_batch_fast([x for part in parts for x in part if x not in self.own], add_special_tokens=False))
            return [[i for x in part for i in ([self.own[x]] if x in self.own else next(got).ids)] for part in parts]
        easy = [self.plain is not None and t != "" and t[0] != " " and "  " not in t and MARK not in t for t in texts]
        out: list[list[int]] = [[]] * len(texts)
        for tokenizer, wanted in ((self.plain, True), (self.tokenizer, False)):
            some = [i for i, e in enumerate(easy) if e is wanted]
            if some:
                given = [MARK + texts[i].replace(" ", MARK) if wanted else texts[i] for i in some]
                for i, e in zip(some, tokenizer.encode_batch_fast(given, add_special_tokens=False), strict=True):
                    out[i] = e.ids
        return out

    def peer_ids(self, text: str) -> list[int]:
        """The sentencepiece library's ids of a whole text. Where no piece crosses the place before a blank, a text without
        runs of blanks is given in stretches that begin after one, as the library puts a blank before each."""
        if self.plain is None or len(text) < 2 * STRETCH or "  " in text or MARK in text or text[-1] == " ":
            return self.peer.encode(text)
        parts, at = [], 0
        while (cut := text.find(" ", at + STRETCH)) >= 0:
            parts.append(text[at:cut])
            at = cut + 1
        parts.append(text[at:])
        return list(chain.from_iterable(map(self.peer.encode, parts)))

    def decode(self, ids: list[int]) -> str:
        text = self.tokenizer.decode(ids, skip_special_tokens=False).replace(MARK, " ")
        return text[1:] if self.model.add_dummy_prefix and text[:1] == " " else text

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bool, bool | None]]:
        """(ids, whether they decode to the text, whether sentencepiece gives them) of every text."""
        for t, own in zip(texts, self.ids(texts), strict=True):
            yield np.frombuffer(array("i", own), np.int32), self.decode(own) == t, None if self.peer is None else self.peer_ids(t) == own


_codecs: dict[tuple, Codec] = {}
CACHES.append(_codecs)


def codec_of(data: bytes, verify: bool) -> Codec:
    """The codec of a model, built once a worker; it keeps no texts."""
    key = sha256(data).digest(), verify
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, verify)
    return _codecs[key]


def encode_texts(df: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", verify: bool = True, threads: int = 2) -> DataFrame:
    """One row a document: the ids, whether they decode to the text, and whether sentencepiece gives them too (null if not verified)."""
    data = Path(model_file).read_bytes()  # a few MB, the same for any corpus

    def make() -> Callable[..., Iterator[tuple]]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        codec = codec_of(data, verify)

        def work(keys: list, texts: list) -> Iterator[tuple]:
            whole = [t or "" for t in texts]
            distinct = list(dict.fromkeys(whole))  # copies in one Arrow batch are encoded once
            found: dict[str, tuple] = {}
            for at, end in stretches(distinct, BATCH_LETTERS):
                for t, (ids, back, same) in zip(distinct[at:end], codec.encode(distinct[at:end]), strict=True):
                    found[t] = len(ids), ids, sha256(ids.tobytes()).hexdigest(), back, same
            return ((k, *found[t]) for k, t in zip(keys, whole, strict=True))

        return work

    make.cache = _codecs
    return map_columns(df, [F.col(key).try_cast("long"), F.col(text)], SCHEMA, make)


def decode_ids(df: DataFrame, model_file: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Texts from ids; null ids give ""."""
    data = Path(model_file).read_bytes()

    def make() -> Callable[..., Iterator[tuple]]:
        tokenizer = build(parse_model(data))
        return lambda keys, rows: zip(keys, tokenizer.decode_batch([list(x or []) for x in rows], skip_special_tokens=False), strict=True)

    return map_columns(df, [F.col(key).try_cast("long"), F.col(ids)], "doc_id long, text string", make)
