"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens that
accepts exactly the token sequences BPE produces. It starts with one state per byte token
and an arc from every state to every byte. The gadget of a merge u v -> w

* removes the arc v from the state behind u: "u v" never stays unmerged;
* adds an arc w wherever an arc u is (after the removal, so that of "u u u" the first two merge);
* lets the state behind w leave by what the state behind v leaves by at that moment
  (before the removal, so that "w u" remains possible if u = v).

Arcs are kept as differences: which state was copied when, which token stands in for which
when, and the removals with their time. An arc is looked up along these two short chains
and then remembered, so encoding runs on table look-ups: at each byte of a word the tokens
that end there (a suffix trie) are tried, and exactly one has an arc from the state at its
start. Decoding emits the arc labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.common import give_back, read_table

START = -1
#: Distinct words a task remembers; beyond that it starts over, which changes no result.
REMEMBERED = 400_000
#: Bytes of a word's beginning whose path is remembered.
HEAD = 7
#: Longer texts are encoded in pieces of about so many characters, cut where no token can span.
PIECE = 1 << 20

# The split pattern of byte-level BPE, and what counts as white space in it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = r"\t-\r \x85\xa0  -     　"

_SPLIT = regex.compile(SPLIT.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
# A coarser cut at places where the pattern above always cuts too: a word of Latin letters
# before white space or plain punctuation; else a blank and what is not white space; else white space.
_CHUNK = re.compile(
    f" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^{SPACE},.;:!?|])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
_SAFE_CUT = re.compile(f"(?<=[^{SPACE}])(?= [^{SPACE}])")


def byte_characters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges, in tables bounded by the vocabulary and by what is remembered."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels = labels
        self.special = special
        #: By token: (made of left, made of right, time); bytes are there from the start.
        self.made: dict[int, tuple[int, int, int]] = {}
        self.removed: dict[tuple[int, int], int] = {}
        for time, (u, v, w) in enumerate(merges):
            if w in self.made:
                raise ValueError(f"two merges make token {w}")
            self.removed[u, v] = time
            self.made[w] = (u, v, time)
        tokens = {t for x in merges for t in x} | {t for t, label in labels.items() if len(label) == 1}
        tokens -= set(special.values())
        #: Suffix trie: (node << 8 | byte) -> node, walked from a token's last byte to its first.
        self.trie: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for token in sorted(tokens):
            node = 0
            for byte in reversed(labels[token]):
                nxt = self.trie.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.trie[node << 8 | byte] = nodes
                    nodes += 1
                node = nxt
            self.ends[node] = token
        self.arcs: dict[tuple[int, int], bool] = {}
        #: Last token, and where it begins, of short word beginnings met before.
        self.heads: dict[bytes, tuple[int, int]] = {}

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        """Read a byte-level BPE vocabulary of the tokenizers library."""
        with open(path, "rb") as f:
            return cls.from_json(f.read())

    @classmethod
    def from_json(cls, content: bytes) -> Automaton:
        spec = json.loads(content)
        kind = spec["model"].get("type", "BPE"), (spec.get("pre_tokenizer") or {}).get("type")
        if kind != ("BPE", "ByteLevel") or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {kind}")
        vocab, characters = spec["model"]["vocab"], byte_characters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        labels = {i: bytes(characters[c] for c in s) for s, i in vocab.items() if s not in special}
        labels |= {i: s.encode() for s, i in special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], special)

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow in ``state`` (the token read last, or START)."""
        if state == START:
            return True
        known = self.arcs.get((state, token))
        if known is None:
            if len(self.arcs) >= REMEMBERED // 2:
                self.arcs.clear()
            known = self.arcs[state, token] = self._derive(state, token)
        return known

    def _derive(self, state: int, token: int) -> bool:
        removed, made = self.removed, self.made
        never = len(made) + 1
        copied_at = never
        while True:
            stand_in, added_at = token, never
            while True:
                time = removed.get((state, stand_in))
                if time is not None and time < copied_at and time <= added_at:
                    return False
                if stand_in not in made:
                    break
                stand_in, _, added_at = made[stand_in]
            if state not in made:
                return True
            _, state, copied_at = made[state]

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one pre-split word."""
        states, begins = [START], [0]
        trie, ends, arcs, heads = self.trie.get, self.ends.get, self.arcs.get, self.heads
        for end in range(1, len(word) + 1):
            head = word[:end] if end <= HEAD else None
            found = heads.get(head) if head else None
            if found is None:
                node, at = 0, end
                while True:
                    at -= 1
                    node = trie(node << 8 | word[at]) if at >= 0 else None
                    if node is None:
                        raise ValueError(f"no token path through {word[:end]!r}")
                    token = ends(node)
                    if token is not None:
                        state = states[at]
                        if state == START:
                            break
                        arc = arcs((state, token))
                        if arc or arc is None and self.has_arc(state, token):
                            break
                found = token, at
                if head:
                    if len(heads) >= REMEMBERED // 4:
                        heads.clear()
                    heads[head] = found
            states.append(found[0])
            begins.append(found[1])
        out, at = [], len(word)
        while at:
            out.append(states[at])
            at = begins[at]
        return out[::-1]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


class _Words(dict):
    """Ids (little-endian bytes) of white-space chunks, filled as they come up."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        for word in _SPLIT.findall(chunk):
            ids += self.automaton.encode_word(word.encode())
        packed = np.array(ids, "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = packed
        return packed


class Encoder:
    """Whole texts to ids, special tokens recognised in the text as the library does."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.words = _Words(automaton)
        names = sorted(automaton.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _plain(self, text: str) -> bytes:
        out, start = [], 0
        while start < len(text):
            cut = _SAFE_CUT.search(text, start + PIECE) if len(text) - start > PIECE else None
            stop = cut.start() if cut else len(text)
            piece = text[start:stop] if start or cut else text
            out.append(b"".join(map(self.words.__getitem__, _CHUNK.findall(piece))))
            start = stop
        return b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        if self.special is None or not self.special.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts = []
        for i, part in enumerate(self.special.split(text)):
            parts.append(np.array([self.automaton.special[part]], "<u4").tobytes() if i % 2 else self._plain(part))
        return np.frombuffer(b"".join(parts), "<u4")


def _encoder(shared) -> Encoder:
    """An encoder of the task's own: compiled in under a second, gone when the task ends."""
    return Encoder(Automaton.from_json(shared.value))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)))


def _encode_column(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [encoder.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids)], names=["doc_id", "ids"])

    return run


def _decode_column(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton.from_json(shared.value)
        for batch in batches:
            texts = [automaton.decode(np.array(x or [], "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _digest_column(shared, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                all_ids, coded, decoded = [], [], []
                for text in part.column("text"):
                    ids = encoder.encode(text.as_py() or "")
                    all_ids.append(ids)
                    coded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.automaton.decode(ids).encode()).hexdigest())
                columns = [part.column("doc_id"), pa.array([len(x) for x in all_ids], pa.int64()), pa.array(coded), pa.array(decoded)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, _lists(all_ids)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            give_back()
        del encoder
        give_back()

    return run


def _named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _shared(spark: SparkSession, vocabulary: str):
    # As large as the vocabulary file, whatever the data.
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) per row; NULL and empty texts give an empty list.

    No shuffle: rows stay where they are, texts are encoded whole. Repeated rows give
    repeated results; other columns are ignored.
    """
    shared = _shared(docs.sparkSession, vocabulary)
    return _named(docs, doc_id, text).mapInArrow(_encode_column(shared), "doc_id long, ids array<int>")


def decode(coded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); a NULL list gives ''. An unknown id is an error."""
    shared = _shared(coded.sparkSession, vocabulary)
    return coded.select("doc_id", "ids").mapInArrow(_decode_column(shared), "doc_id long, text string")


def digests(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Per row doc_id, n_tokens and the SHA-256 of the ids and of the text decoded from them.

    With ``with_ids`` the ids too, so that texts are encoded once for both. A NULL text
    counts as empty, a NULL doc_id stays NULL; repeated rows give repeated results; other columns are ignored.
    """
    shared = _shared(docs.sparkSession, vocabulary)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _named(docs, doc_id, text).mapInArrow(_digest_column(shared, with_ids), schema)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), vocabulary_path())
