"""Byte-level BPE through a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as spm

from .common import claim, slices, text_bytes

#: Byte b is written as the letter of this code point plus b: never white space, never normalised.
BYTE_BASE = 0x4E00
#: Entries of the cache of one Python worker.
CACHE = 500_000
_TO_LETTERS = {b: BYTE_BASE + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """The token bytes of a rank file in rank order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(n): base64.b64decode(t) for t, n in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks are not gapless from 0")
    return [ranks[k] for k in range(len(ranks))]


def as_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_LETTERS)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece 0 is the unknown piece, piece rank + 1 scores minus rank."""
    model = spm.ModelProto()
    model.trainer_spec.model_type = spm.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(tokens) + 1
    model.trainer_spec.unk_id, model.trainer_spec.bos_id, model.trainer_spec.eos_id, model.trainer_spec.pad_id = 0, -1, -1, -1
    model.trainer_spec.treat_whitespace_as_suffix = False
    spec = model.normalizer_spec
    spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
    model.pieces.add(piece="<unk>", score=0.0, type=spm.ModelProto.SentencePiece.UNKNOWN)
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=as_letters(token), score=-float(rank), type=spm.ModelProto.SentencePiece.NORMAL)
    return model.SerializeToString()


class Codec:
    """Encodes pre-tokens with the serialised model; decodes ids by the inverse mapping of its pieces."""

    def __init__(self, path: str, pattern: str):
        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.split = regex.compile(pattern)
        self.whole = {t: k for k, t in enumerate(tokens)}
        self.bytes_of = [bytes(ord(c) - BYTE_BASE for c in self.model.id_to_piece(k + 1)) for k in range(len(tokens))]
        self.cache: dict[str, tuple[list[int], str, bytes]] = {}

    def pre_tokens(self, text: str) -> list[str]:
        return self.split.findall(text)

    def learn(self, words: set[str]) -> None:
        """Fills the cache. A pre-token that is itself a token is that token, whatever the merges say."""
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = words
        merged = []
        for w in new:
            data = w.encode()
            one = self.whole.get(data)
            if one is None:
                merged.append((w, as_letters(data)))
            else:
                self.cache[w] = self._entry([one])
        for start in range(0, len(merged), 4096):
            part = merged[start : start + 4096]
            for (w, _), ids in zip(part, self.model.encode([x for _, x in part], num_threads=1), strict=True):
                self.cache[w] = self._entry([k - 1 for k in ids])

    def _entry(self, ids: list[int]) -> tuple[list[int], str, bytes]:
        return ids, ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        words = self.pre_tokens(text)
        self.learn(set(words))
        return [k for w in words for k in self.cache[w][0]]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(maxsize=1)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def codec(path: str, pattern: str) -> Codec:
    claim("bpe_codec", _codec.cache_clear)
    return _codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array, on request), ids_sha256, decoded_sha256 of every whole text.

    Null text counts as empty (no ids); a row is read on its own, so nulls in other columns, ties,
    repeated rows and empty tables need no rule; other columns are ignored. A row's digests are
    taken piece by piece, so a very long text needs memory for its pre-tokens only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "body", 2 << 20):
                rows = [coder.pre_tokens(x.decode("utf-8", "replace")) for x in part.column("body").to_pylist()]
                out = {"doc_id": part.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
                coder.learn({w for words in rows for w in words})
                for words in rows:
                    entries = list(map(coder.cache.__getitem__, words))
                    out["n_tokens"].append(sum(len(e[0]) for e in entries))
                    out["ids_sha256"].append(hashlib.sha256(",".join(e[1] for e in entries).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(b"".join(e[2] for e in entries)).hexdigest())
                    out["ids"].append([k for e in entries for k in e[0]] if with_ids else None)
                if not with_ids:
                    del out["ids"]
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids)
