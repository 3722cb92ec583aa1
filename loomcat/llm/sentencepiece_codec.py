"""SentencePiece models run by the tokenizers library.

The model file's protobuf is parsed here; normaliser, metaspace marker, pieces with their scores
(unigram, or BPE merges in the order of the scores) and byte fallback are rebuilt as a tokenizers
pipeline, which encodes batches on several threads. Where no piece crosses a marker, the pipeline's
encoder gets each distinct marked word of a task once, and texts are put together from them; other
models get whole texts.

`parity` says for every document whether the sentencepiece library agrees, in ids and in the decoded
text. For models whose words stand alone that is so if it normalises the whole text alike and
encodes and decodes each of its words alike; whatever is left is compared whole.

Defined cases: the longest text is coded whole; null text gives null ids and null text back; empty text gives no ids; special pieces'
names in a text are ordinary text; repeated rows give repeated results; an empty table gives an
empty result. The model path is a parameter and is read on the driver; the file (at most MOST_BYTES)
is broadcast.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_BYTES = 64 << 20
THREADS = 2
#: Characters that are encoded at a time, and distinct words that a task remembers.
CHUNK, WORDS = 400_000, 600_000
MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Piece types of the model's protobuf (fixed values of its format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            if kind == 2:
                size, at = _varint(raw, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"protobuf wire type {kind}")
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def parse(raw: bytes) -> dict:
    """pieces (text, score, type), model_type (1 unigram, 2 BPE), normaliser settings."""
    out = {"pieces": [], "model_type": 1, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True}
    for f, v in fields(raw):
        if f == 1:
            p = dict(fields(v))
            out["pieces"].append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif f == 2:
            t = dict(fields(v))
            out |= {"model_type": t.get(3, 1), "byte_fallback": bool(t.get(35, 0))}
        elif f == 3:
            n = dict(fields(v))
            out |= {"charsmap": n.get(2, b""), "dummy_prefix": bool(n.get(3, 1)), "squeeze": bool(n.get(4, 1)), "escape": bool(n.get(5, 1))}
    return out


def words_stand_alone(spec: dict) -> bool:
    """Whether no piece has a marker after other characters, so that marked words never share one."""
    return any(p == MARK for p, _, _ in spec["pieces"]) and not any(MARK in p.lstrip(MARK) for p, _, t in spec["pieces"] if t in (NORMAL, USER))


def build(raw: bytes):
    """A tokenizers.Tokenizer with the model's behaviour."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    spec = parse(raw)
    pieces = spec["pieces"]
    ids = {p: i for i, (p, _, _) in enumerate(pieces)}
    unk = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), None)
    if spec["model_type"] == 1:
        model = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unk, byte_fallback=spec["byte_fallback"])
    elif spec["model_type"] == 2:
        usable = {p: (s, i) for i, (p, s, t) in enumerate(pieces) if t in (NORMAL, USER)}
        merges = [(-s, i, ids[p[:k]], p[:k], p[k:]) for p, (s, i) in usable.items() for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        model = models.BPE(ids, [(a, b) for *_, a, b in sorted(merges)], unk_token=pieces[unk][0] if unk is not None else None, fuse_unk=True, byte_fallback=spec["byte_fallback"])
    else:
        raise ValueError(f"model type {spec['model_type']}: only unigram and BPE are known")
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(spec["charsmap"])] if spec["charsmap"] else []
    if spec["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK if spec["escape"] else " "))
    if spec["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
        if spec["squeeze"]:
            steps.append(normalizers.Replace(Regex(f"{MARK}+\\z"), ""))  # markers of the text itself
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    if words_stand_alone(spec):
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if spec["dummy_prefix"] else [])])
    if users := [AddedToken(p, normalized=False) for p, _, t in pieces if t == USER]:
        tok.add_tokens(users)
    return tok


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}i", *ids)


class Codec:
    """Both libraries with one model. `coded` gives ids, decoded text and agreement of texts."""

    def __init__(self, raw: bytes, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from tokenizers import Tokenizer, decoders

        self.tok, self.own, self.threads = build(raw), sentencepiece.SentencePieceProcessor(model_proto=raw), threads
        spec = parse(raw)
        self.alone = words_stand_alone(spec) and spec["escape"] and not any(t == USER for *_, t in spec["pieces"])
        self.prefix = " " if spec["dummy_prefix"] else ""
        self.mapped = bool(spec["charsmap"]) or spec["squeeze"]
        self.inner = Tokenizer(self.tok.model)  # for words that are normalised already
        self.inner.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}  # no lists in it: the garbage collector would walk over them again and again
        self.odd: dict[str, str] = {}  # decoded words on which the libraries differ, or that don't come back as they were

    def coded(self, texts: list[str]) -> Iterator[tuple[bytes, str, bool]]:
        return self._by_words(texts) if self.alone else self._whole(texts)

    def _whole(self, texts: list[str]) -> Iterator[tuple[bytes, str, bool]]:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        for text, x, back in zip(texts, ids, self.tok.decode_batch(ids, skip_special_tokens=False), strict=True):
            yield _packed(x), back, self._agree(text, _packed(x), back)

    def _agree(self, text: str, ids: bytes, back: str) -> bool:
        theirs = self.own.encode(text)
        return _packed(theirs) == ids and self.own.decode(theirs) == back

    def _by_words(self, texts: list[str]) -> Iterator[tuple[bytes, str, bool]]:
        normal = [self.tok.normalizer.normalize_str(t) if self.tok.normalizer else t for t in texts]
        split = [_WORD.findall(t) for t in normal]
        if len(self.known) > WORDS:
            self.forget()
        self._learn(list(set().union(*split).difference(self.known)))
        for text, norm, ws in zip(texts, normal, split, strict=True):
            ids = b"".join(map(self.known.__getitem__, ws))
            if self.odd.keys().isdisjoint(ws):
                back = norm.replace(MARK, " ").removeprefix(self.prefix)
                yield ids, back, self.own.normalize(text) == norm or self._agree(text, ids, back)
            else:
                back = "".join([self.odd.get(w, w.replace(MARK, " ")) for w in ws]).removeprefix(self.prefix)
                yield ids, back, self._agree(text, ids, back)

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        ids = [e.ids for e in self.inner.encode_batch_fast(words, add_special_tokens=False)]
        back = self.inner.decode_batch(ids, skip_special_tokens=False)
        spaced = [w.replace(MARK, " ") for w in words]
        raw = [w.removeprefix(self.prefix) for w in spaced]  # sentencepiece adds the prefix itself
        theirs = self.own.encode(raw, num_threads=self.threads)
        same = self.own.decode(list(itertools.chain.from_iterable(ids))) == "".join(back).removeprefix(self.prefix)
        for w, b, r, x, y, z in zip(words, back, raw, ids, theirs, spaced, strict=True):
            if not same or x != y or b != z or w[0] != MARK or (self.mapped and self.own.normalize(r) != w):
                self.odd[w] = b
        self.known.update(zip(words, map(_packed, ids), strict=True))


@functools.lru_cache(maxsize=2)
def _ready(digest: str, raw: bytes, threads: int) -> Codec:
    return Codec(raw, threads)


def encode(documents: DataFrame, model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """documents with n_tokens, ids (binary, 32-bit little-endian), decoded (the text that the ids
    give back) and parity (null for null text); of clashing columns these replace the input's."""
    spark = c.session(documents.sparkSession)
    with open(model, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{model} has over {MOST_BYTES} bytes")
    held, digest = spark.sparkContext.broadcast(raw), xxhash.xxh3_128_hexdigest(raw)
    new = ("n_tokens", "ids", "decoded", "parity")
    rows = documents.drop(*new)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _ready(digest, held.value, threads)
        try:
            for pdf in batches:
                yield one(codec, pdf)
        finally:
            codec.forget()  # workers outlive their tasks

    def one(codec: Codec, pdf: pd.DataFrame) -> pd.DataFrame:
        some = [isinstance(t, str) for t in pdf["text"]]
        texts = [t.encode("utf-8", "replace").decode() for t, ok in zip(pdf["text"], some, strict=True) if ok]
        got = (x for lo, hi in c.chunks([len(t) for t in texts], CHUNK) for x in codec.coded(texts[lo:hi]))
        n, ids, back, parity = [], [], [], []
        for ok in some:
            coded, text, same = next(got) if ok else (None, None, None)
            n.append(len(coded) // 4 if ok else None)
            ids.append(coded)
            back.append(text)
            parity.append(same)
        return pdf.assign(n_tokens=pd.array(n, "Int64"), ids=ids, decoded=back, parity=pd.array(parity, "boolean"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(c.freed(run), f"{schema}, n_tokens long, ids binary, decoded string, parity boolean")


def digest(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (the ids give the text back), parity."""
    rows = encode(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"), "parity")
