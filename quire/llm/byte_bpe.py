"""Byte-level BPE: encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a tiktoken file become a vocabulary over printable characters (one for each byte) and merges: every way to
split a token into two tokens, in the order of the token's rank, so merging chooses as ranks do. A text falls into
units before the library sees it: a space and what follows it up to the next space. No match of the pattern crosses a
unit's edge unless white space stands on both sides of a space or a space ends the text; such texts are cut at the
edges of white space runs instead. Units repeat much, so each worker keeps the ids of those it met, a bounded number.

Null texts are empty and have no tokens. Decoding maps ids to bytes and joins them before reading UTF-8, so characters
split over tokens come back whole; bytes that are no UTF-8 (from ids cut short) become U+FFFD in the text.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_id, chunks, doc_key, lean, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Units that a worker keeps.
MEMORY = 300_000

# The White_Space code points, as \s has them in the pattern.
_S = "\t-\r \x85\xa0  -     　"
_ODD = re.compile(f"[{_S}] [{_S}]| $|  ")
_RUNS = re.compile(f"[{_S}]*[^{_S}]+|[{_S}]+")

_OPEN: dict[str, "Codec"] = {}


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(rest)) for b in range(256)]


class Codec:
    """Encoder and byte table of one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are shared out by Spark
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        chars = byte_chars()
        shown = {t: "".join(chars[b] for b in t) for t in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        bpe = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(bpe)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        back = {c: b for b, c in enumerate(chars)}
        self.bytes = {r: bytes(back[c] for c in shown[t]) for t, r in ranks.items()}
        self.met: dict[str, tuple[int, bytes, bytes]] = {}

    @staticmethod
    def of(path: str) -> "Codec":
        if path not in _OPEN:
            _OPEN[path] = Codec(path)
        return _OPEN[path]

    def units(self, text: str) -> list[str]:
        if _ODD.search(text):
            return _RUNS.findall(text)
        first, *rest = text.split(" ")
        return [*([first] if first else []), *map(" ".__add__, rest)]

    def meet(self, units: set[str]) -> None:
        """Ids (count and decimal digits) and decoded bytes of those units that were not met yet."""
        if len(self.met) + len(units) > MEMORY:
            self.met = {u: self.met[u] for u in units if u in self.met}
        new = [u for u in units if u not in self.met]
        for unit, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            ids = e.ids
            self.met[unit] = (len(ids), b",".join([b"%d" % i for i in ids]), b"".join(map(self.bytes.__getitem__, ids)))

    def digest(self, texts: list[str]):
        """(n_tokens, digits of the ids, decoded bytes) of each text."""
        cut = [self.units(text) for text in texts]
        seen: set[str] = set()
        lead = 0
        for k, units in enumerate(cut):
            seen.update(units)
            if len(seen) > MEMORY // 2 or k == len(cut) - 1:  # meet what these texts have in one call
                self.meet(seen)
                for own in cut[lead : k + 1]:
                    found = [self.met[u] for u in own]
                    yield sum(x[0] for x in found), b",".join([x[1] for x in found]), b"".join([x[2] for x in found])
                lead, seen = k + 1, set()


def encode(docs: DataFrame, path: str, text: str = "text", offsets: bool = True) -> DataFrame:
    """docs with ids and, if asked for, starts: the place of each token's first character in the text, as code points."""
    kind = [("ids", pa.list_(pa.int32()))] + [("starts", pa.list_(pa.int32()))] * offsets

    def run(batches):
        codec = Codec.of(path)
        for b in chunks(batches, "__text"):
            found = codec.tokenizer.encode_batch(pc.fill_null(b.column("__text"), "").to_pylist(), add_special_tokens=False)
            new = [pa.array([e.ids for e in found], kind[0][1])]
            if offsets:
                new.append(pa.array([[x for x, _ in e.offsets] for e in found], kind[1][1]))
            names = [*b.schema.names[:-1], *(k for k, _ in kind)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names)

    out = docs.drop("ids", "starts")
    ddl = T.StructType(list(out.schema))
    for name, _ in kind:
        ddl = ddl.add(name, T.ArrayType(T.IntegerType()))
    return out.withColumn("__text", F.col(text).cast("string")).mapInArrow(run, ddl)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens with the text that the column ids stands for (column decoded) and its bytes (column raw)."""

    def run(batches):
        codec = Codec.of(path)
        for b in batches:
            raw = [b"".join(map(codec.bytes.__getitem__, ids or [])) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.decode(errors="replace") for r in raw], pa.string()), pa.array(raw, pa.binary())], [*b.schema.names, "decoded", "raw"])

    own = tokens.drop("decoded", "raw")
    return own.mapInArrow(run, T.StructType(list(own.schema)).add("decoded", "string").add("raw", "binary"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs."""

    def run(batches):
        codec = Codec.of(path)
        for b in chunks(batches):
            rows = [(n, hashlib.sha256(d).hexdigest(), hashlib.sha256(t).hexdigest()) for n, d, t in codec.digest(pc.fill_null(b.column("text"), "").to_pylist())]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], ["doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(doc_key().alias("doc"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(lean(run), "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string").select(as_id(), "n_tokens", "ids_sha256", "decoded_sha256")


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of token counts and digests for each document."""
    return round_trip(docs, public_tokenizers.path(RANKS))
