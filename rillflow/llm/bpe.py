"""BPE encoding by forced boundaries, and decoding.

A byte pair that occurs inside no token of the vocabulary marks a certain cut: no merge can cross it. Before
a space that follows a character other than white space the pre-tokenizing pattern cannot look across such a
cut either, so texts fall apart there into fragments that are encoded independently, once for each distinct
fragment in a bounded memory, and whose ids are then concatenated. The pre-tokens of a long fragment
are cut at the other certain pairs in the same way, so that merging never runs over a long stretch.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillflow.llm.common import hold, id_and_text, tokenizer_file

#: Fragments that a Python worker remembers, and the longest of them.
MEMORY, MEMORY_CHARS = 300_000, 48


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes as the tokenizers library does with a byte-level BPE file, without added special tokens."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        vocab = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.token_bytes = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        inside = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            self.token_bytes[i] = token
            inside[list(token[:-1]), list(token[1:])] = True
        for text, i in special.items():
            self.token_bytes[i] = text.encode()
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        #: Certain cuts between two bytes.
        self.certain = frozenset(bytes((a, b)) for a, b in np.argwhere(~inside))
        #: What may not be parted from a space after it: white space, and characters whose last byte does stand before a space in a token.
        loose = {b for b in range(256) if inside[b, 32]}
        glue = re.escape("".join(c for c in map(chr, [*range(0x3001)]) if c != " " and (c.isspace() or c.encode()[-1] in loose)))
        far = r"\u3001-\U0010ffff" if any(b >= 0x80 for b in loose) else ""
        self.fragment = re.compile(rf" *[^ ]+(?:(?<=[\s{glue}{far}]) +[^ ]*)*| +")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pretokens = regex.compile(pattern).findall
        merges = tiktoken.Encoding("fragments", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})
        self.merge_text, self.merge_bytes = merges.encode_ordinary, merges._encode_single_piece
        self.memory = _Memory(self)

    def pieces(self, token: bytes) -> list[bytes]:
        """``token`` cut at every certain pair."""
        cuts = [i for i in range(1, len(token)) if token[i - 1 : i + 1] in self.certain]
        return [token[i:j] for i, j in zip([0, *cuts], [*cuts, len(token)], strict=True)] if cuts else [token]

    def encode_fragment(self, fragment: str) -> bytes:
        if len(fragment) <= MEMORY_CHARS:
            return array("I", self.merge_text(fragment)).tobytes()
        ids = array("I")
        for token in self.pretokens(fragment):
            for piece in self.pieces(token.encode()):
                ids.extend(self.merge_bytes(piece))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            return b"".join(array("I", [self.special[p]]).tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.memory.__getitem__, self.fragment.findall(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")


class _Memory(dict):
    """Ids by fragment; emptied when full, so its size is bounded."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, fragment: str) -> bytes:
        ids = self.encoder.encode_fragment(fragment)
        if len(fragment) <= MEMORY_CHARS:
            if len(self) >= MEMORY:
                self.clear()
            self[fragment] = ids
        return ids


def encoder(name: str) -> Encoder:
    """One encoder in a Python worker, until another operator works there."""
    return hold(f"bpe {name}", lambda: Encoder(tokenizer_file(name)))


def encode_decode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``n_tokens``, digests of the ids and of the decoded text; ``with_ids`` adds the ids.

    Null texts count as empty (no ids); repeated rows and null ids pass through; other columns are not read.
    A map over partitions with whole texts: nothing is shuffled.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                ids = enc.encode(text)
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest())
                out.append((*row, np.frombuffer(ids, np.int32)) if with_ids else row)
            kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return id_and_text(docs).mapInArrow(run, schema)
