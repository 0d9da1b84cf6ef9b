"""Operator 9, SentencePiece encoding and decoding with the tokenizers library as backend.

The model protobuf is parsed here; normaliser (character map, dummy prefix, space rules), the
metaspace mark, scores and byte fallback are rebuilt as a ``tokenizers`` pipeline. A unigram
model keeps its scores; a BPE model's merges follow from its scores (a pair of pieces whose
joined string is a piece, best score first). Batches are encoded by as many threads as a task has
cores, two at least. Parity with the sentencepiece library is verified on each row if ``parity`` is
set, at the cost of a second encoding: false where the ids differ, which fails no task.

Defined results: a null or empty text has no ids and decodes to the empty text. ``round_trip``
says whether decoding gives the very text; it is false for one that the normaliser changes or that
holds the space mark. Repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_type, map_batches

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protobuf message: ints, 4- or 8-byte strings, or byte strings."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


def parse_model(data: bytes) -> dict:
    """pieces [(text, score, type)], model type, flags and the character map."""
    model = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "extra_spaces": True, "escape": True}
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
            model["pieces"].append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            spec = dict(_fields(value))
            model["type"], model["byte_fallback"] = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model["charsmap"] = spec.get(2, b"")
            model["dummy_prefix"], model["extra_spaces"], model["escape"] = (bool(spec.get(i, 1)) for i in (3, 4, 5))
    return model


def bpe_merges(pieces: list[tuple]) -> list[tuple[str, str]]:
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for p, i in ids.items():
        for cut in range(1, len(p)):
            left, right = ids.get(p[:cut]), ids.get(p[cut:])
            if left is not None and right is not None:
                found.append((-pieces[i][1], left, right, p[:cut], p[cut:]))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: dict):
    """A ``tokenizers.Tokenizer`` with the ids of the SentencePiece model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), None)
    if model["type"] == UNIGRAM:
        # control and byte pieces are never read from text
        low = min((s for _, s, k in pieces if k == NORMAL), default=0.0) - 1e6
        core = models.Unigram([(p, low if k in (CONTROL, BYTE) else s) for p, s, k in pieces], unk, model["byte_fallback"])
    elif model["type"] == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(pieces)}, bpe_merges(pieces), unk_token=pieces[unk][0] if unk is not None else None, fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError(f"model type {model['type']} is not supported")
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["extra_spaces"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(core)
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    after = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence(after + ([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []))
    if user := [AddedToken(p, normalized=False) for p, _, k in pieces if k == USER]:
        out.add_tokens(user)
    return out


def load(path: str):
    with open(path, "rb") as f:
        return build(parse_model(f.read()))


def decoder(path: str, coder):
    """lists of ids -> texts: the bytes of all pieces joined, marks read as spaces, the dummy space gone.
    A piece of text is whole characters, so the joined bytes are UTF-8 if and only if each run of byte
    pieces is. Texts where one is not, or with an unknown, control or empty piece, go through the
    library's decoder; both give the same (tests)."""
    with open(path, "rb") as f:
        model = parse_model(f.read())
    plain = [p.replace(MARK, " ").encode() or None if kind in (NORMAL, USER, UNUSED) else bytes.fromhex(p[3:5]) if kind == BYTE else None for p, _, kind in model["pieces"]]

    def decode(batch: list) -> list[str]:
        out, hard = [], []
        for i, ids in enumerate(batch):
            try:
                text = b"".join([plain[x] for x in ids]).decode()
            except (TypeError, UnicodeDecodeError):  # TypeError: a piece that has no bytes
                hard.append(i)
                out.append("")
                continue
            out.append(text[1:] if model["dummy_prefix"] and text[:1] == " " else text)
        if hard:
            for i, text in zip(hard, coder.decode_batch([batch[i] for i in hard], skip_special_tokens=False)):
                out[i] = text
        return out

    return decode


def threads() -> None:
    """Bound the library's threads, before its first batch, to the cores of a task."""
    context = TaskContext.get()
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ["RAYON_NUM_THREADS"] = str(max(2, context.cpus() if context else 2))


def encode_column(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", parity: bool = False, keep_ids: bool = True, chunk: int = 500) -> DataFrame:
    """(key, n_ids, ids_crc32, round_trip, parity[, ids]): parity is null if not asked for."""
    fields = [T.StructField(key, id_type(df, key)), T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def make():
        threads()
        coder, reference = load(path), None
        decode = decoder(path, coder)
        if parity:
            import sentencepiece

            reference = sentencepiece.SentencePieceProcessor(model_file=path)

        def step(cols):
            out = {f.name: [] for f in fields}
            out[key] = cols[key]
            texts = [t or "" for t in cols[text]]
            for at in range(0, len(texts), chunk):
                part = texts[at : at + chunk]
                ids = [e.ids for e in coder.encode_batch_fast(part, add_special_tokens=False)]
                back = decode(ids)
                same = [a == b for a, b in zip(ids, reference.encode(part, num_threads=1))] if reference else [None] * len(part)
                out["n_ids"] += map(len, ids)
                out["ids_crc32"] += [zlib.crc32(array("I", x)) for x in ids]
                out["round_trip"] += [b == t for b, t in zip(back, part)]
                out["parity"] += same
                if keep_ids:
                    out["ids"] += ids
            return out

        return step

    return map_batches(df, [key, text], T.StructType(fields), make)


def decode_column(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text) from an array column of ids; null ids give the empty text."""

    def make():
        threads()
        decode = decoder(path, load(path))
        return lambda cols: {key: cols[key], "text": decode([list(x or ()) for x in cols[ids]])}

    return map_batches(df, [key, ids], T.StructType([T.StructField(key, id_type(df, key)), T.StructField("text", T.StringType())]), make)
