"""BPE encoding and decoding by a deterministic tokenization automaton.

``Automaton`` compiles the merges, in one task. A state stands for the token read
last (and one for the start of a word), an arc for the token that follows. At first
there are the base symbols, and every arc exists. Each merge (u, v) -> w, in order of
rank, adds its gadget: w gets the arcs into it that u has, the arcs out of it that v
has, and the arc from u to v goes, as w has taken its place. (Where u = v, the arcs
into w are taken after that, since of three equal tokens the first two merge.) What is
left accepts one path per word, its encoding.

States with equal arcs share a row of the transition table and tokens with equal arcs
into them a column; a gadget copies a row or column only when it first differs. So the
table of a vocabulary of 49,000 tokens has about 11,600 rows and 13,800 columns of bits,
20 MB, made in two seconds. Packed, it is a few megabytes, which are broadcast with the
labels of the arcs.

A word's bytes run through the trie of the labels with failure links, which names the
arcs that end at each byte; the table says which of them leaves the state where it
begins. As each beginning of a word has one path too, a byte has one state, and a word
takes one pass. Known words are kept.

Words come from the tokenizer's own normalization and splitting (NFC, runs of
white space, lower case per character, then the split pattern). Decoding emits
the labels of the arcs.

Nulls: a null text encodes to no ids and decodes to the empty string; a null doc_id
stays null. Texts are whole, of any length; strings of special tokens in a text become
their ids. Repeated rows are encoded each for itself; columns besides doc_id and text
are left out.
"""

from __future__ import annotations

import functools
import hashlib
import json
import pickle
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A worker forgets its known words beyond so many, which only costs time.
MOST_KNOWN = 150_000
#: Bytes of ids that a worker holds before it hands them on.
MOST_HELD = 4 << 20
#: Characters below this one are split with spelled-out classes.
NEAR = 0x250


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Bits:
    """A growing table of bits whose rows and columns are shared by their owners until one of them changes."""

    def __init__(self):
        self.bits = np.zeros((1024, 1024), np.uint8)
        self.bits[0, 0] = 1
        self.owners = ([1], [0])  # of each row and column
        self.of: tuple[dict[int, int], dict[int, int]] = ({}, {})  # row and column of each token

    def has(self, u: int, v: int) -> bool:
        r, c = self.of[0][u], self.of[1][v]
        return bool(self.bits[r, c >> 3] >> (c & 7) & 1)

    def share(self, side: int, token: int, line: int) -> None:
        self.of[side][token] = line
        self.owners[side][line] += 1

    def _own(self, side: int, token: int) -> int:
        """The row or column of token, copied if others share it."""
        line, owners = self.of[side][token], self.owners[side]
        if owners[line] == 1:
            return line
        new = len(owners)
        if new >= self.bits.shape[side] << 3 * side:
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)], axis=side)
        if side == 0:
            self.bits[new] = self.bits[line]
        else:
            self.bits[:, new >> 3] |= (self.bits[:, line >> 3] >> (line & 7) & 1) << (new & 7)
        owners[line] -= 1
        owners.append(1)
        self.of[side][token] = new
        return new

    def clear(self, u: int, v: int) -> None:
        r, c = self._own(0, u), self._own(1, v)
        self.bits[r, c >> 3] &= np.uint8(0xFF ^ 1 << (c & 7))


class Automaton:
    """The compiled vocabulary. A word is a string of one character per byte, the last one END higher."""

    END = 0x100

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        table = _Bits()
        labels: dict[int, str] = {}
        for byte, c in enumerate(byte_symbols()):
            labels[vocab[c]], labels[vocab[c + suffix]] = chr(byte), chr(byte + self.END)
        for token in labels:
            table.share(0, token, 0)
            table.share(1, token, 0)
        for left, right in merges:
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            if not table.has(u, v):
                continue  # an earlier gadget took the arc: nothing is left to merge
            labels[w] = labels[u] + labels[v]
            if not right.endswith(suffix):  # nothing follows the end of a word
                table.share(0, w, table.of[0][v])
            table.clear(u, v)
            table.share(1, w, table.of[1][u])
        rows, columns = (len(x) for x in table.owners)
        packed = table.bits[:rows, : (columns + 7) >> 3]
        self.rows = [packed[r].tobytes() for r in range(rows)]
        self.arcs = ahocorasick.Automaton()
        for token, label in labels.items():
            c = table.of[1][token]
            self.arcs.add_word(label, (token, len(label), c >> 3, 1 << (c & 7), table.of[0].get(token, 0)))
        self.arcs.make_automaton()

    def path(self, word: str) -> list[int]:
        """The tokens of the one path that spells the word."""
        n, rows = len(word), self.rows
        state: list = [None] * (n + 1)  # the row of each byte's state
        came: list = [None] * (n + 1)
        state[0] = rows[0]
        for last, arc in self.arcs.iter(word):
            if came[last + 1] is None:
                row = state[last + 1 - arc[1]]
                if row is not None and row[arc[2]] & arc[3]:
                    state[last + 1] = rows[arc[4]]
                    came[last + 1] = arc
        out, at = [], n
        while at:
            arc = came[at]
            out.append(arc[0])
            at -= arc[1]
        return out[::-1]


class _Known(dict):
    """The words met so far with their ids; a new one is encoded when it is asked for."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> bytes:
        if len(self) > MOST_KNOWN:
            self.clear()
        out = self[word] = self.tokenizer.word(word)
        return out


class Tokenizer:
    """Encoding and decoding with a word-end BPE tokenizer file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.automaton = Automaton(model["vocab"], [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.labels = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern, regex.V0).findall
        # The same pattern with its classes spelled out, for texts of the first blocks only: the standard module is faster.
        near = [chr(c) for c in range(NEAR)]
        of = lambda kind: "".join(map(re.escape, (c for c in near if regex.match(kind, c))))
        letters, numbers, spaces = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
        spelled = pattern.replace("[\\p{L}]", f"[{letters}]").replace("[\\p{N}]", f"[{numbers}]").replace("[^\\s\\p{L}\\p{N}]", f"[^{spaces}{letters}{numbers}]")
        self.split_near = re.compile(spelled).findall
        self.beyond = re.compile(f"[{chr(NEAR)}-\U0010ffff]").search
        # Characters that the regex module knows as letters or numbers and the tokenizer's older tables do not know.
        self.newer = {c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))) if unicodedata.category(c) == "Cn"}
        newer = "".join(map(regex.escape, sorted(self.newer)))
        older = pattern.replace("[\\p{L}]", f"[\\p{{L}}--[{newer}]]").replace("[\\p{N}]", f"[\\p{{N}}--[{newer}]]").replace("[^\\s\\p{L}\\p{N}]+", f"(?:[^\\s\\p{{L}}\\p{{N}}]|[{newer}])+")
        self.split_newer = regex.compile(older, regex.V1).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.encoded_labels = {i: t.encode() for i, t in self.labels.items()}
        self.known = _Known(self)

    def __getstate__(self) -> dict:
        """What is broadcast: all but the known words."""
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.known = _Known(self)

    def word(self, word: str) -> bytes:
        """The ids of one split word, as little-endian 32-bit integers."""
        symbols = word.encode("utf-8", "surrogatepass").decode("latin-1")
        ids = self.automaton.path(symbols[:-1] + chr(ord(symbols[-1]) + Automaton.END))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> Iterator[bytes]:
        text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        if text.isascii() or not self.beyond(text):
            split = self.split_near
        else:
            split = self.split if self.newer.isdisjoint(text) else self.split_newer
        return map(self.known.__getitem__, split(text))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit integers."""
        parts = self.at_special(text) if "<|" in text else [text]
        return b"".join(x for k, part in enumerate(parts) for x in ([self.special[part].to_bytes(4, "little")] if k % 2 else self._plain(part)))

    def decode(self, ids: bytes) -> str:
        """The labels of the ids' arcs, joined by spaces."""
        return self.decode_bytes(ids).decode()

    def decode_bytes(self, ids: bytes) -> bytes:
        """As decode, in UTF-8."""
        return b" ".join(map(self.encoded_labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _packed(spark: SparkSession, path: str) -> bytes:
    """The tokenizer of a file that the driver can read, compiled in one task and packed: the driver holds only the few megabytes that it broadcasts."""
    with open(path, encoding="utf-8") as f:
        spec = spark.createDataFrame([(f.read(),)], "spec string")

    @F.udf("binary")
    def compiled(spec: str) -> bytes:
        return zlib.compress(pickle.dumps(Tokenizer(spec), pickle.HIGHEST_PROTOCOL), 6)

    return bytes(spec.select(compiled("spec")).first()[0])


@functools.lru_cache(maxsize=2)
def _unpacked(packed: bytes) -> Tokenizer:
    """A worker process unpacks a tokenizer once, whatever number of tasks it runs."""
    return pickle.loads(zlib.decompress(packed))


@functools.lru_cache(maxsize=2)
def _shared(spark: SparkSession, path: str) -> Broadcast:
    """The packed tokenizer, broadcast once a session."""
    return spark.sparkContext.broadcast(_packed(spark, path))


def encode_column(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array<int> column of token ids in place of any column of that name."""
    shared = _shared(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _unpacked(shared.value)
        for s in batches:
            yield pd.Series([np.frombuffer(t.encode(x or ""), "<u4").astype(np.int32) for x in s])

    return docs.withColumn(ids, encode(F.col(text).cast("string")))


def decode_column(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the text of an array<int> column of token ids; null ids decode to the empty string."""
    shared = _shared(docs.sparkSession, path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _unpacked(shared.value)
        for s in batches:
            yield pd.Series([t.decode(np.asarray(x if x is not None else [], "<u4").tobytes()) for x in s])

    return docs.withColumn(text, decode(F.col(ids)))


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row: encoded, then decoded from the ids, in one pass.

    The digests are of the ids as little-endian 32-bit integers and of the decoded
    text in UTF-8; ids (array<int>) are left out without ``with_ids``.
    """
    shared = _shared(docs.sparkSession, path)
    names = ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _unpacked(shared.value)
        for pdf in batches:
            out, held = [], 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = t.encode(text or "")
                numbers = [np.frombuffer(ids, "<i4")] * with_ids
                out.append((doc_id, len(ids) // 4, *numbers, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode_bytes(ids)).hexdigest()))
                held += len(ids)
                if held > MOST_HELD:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    # Ids of documents travel as strings: beside a null, pandas would make floats of them.
    source = docs.select(F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string"))
    types = {"n_tokens": "long", "ids": "array<int>"}
    made = source.mapInPandas(rows, ", ".join(f"{n} {types.get(n, 'string')}" for n in names))
    return made.withColumn("doc_id", F.col("doc_id").cast("long"))
