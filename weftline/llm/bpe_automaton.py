"""BPE encoding and decoding by a tokenization automaton.

The automaton's arcs carry tokens, and its paths are exactly the right tokenizations: a token may follow a state only if
the merges would never join or split them another way. It is built from one state with an arc for each base symbol, by
one merge gadget for each merge (u, v), in the merges' order:

* the state that u leads to is split off from the tokens that share it, as from now on it loses its arc v;
* each state with an arc u gets an arc uv that leads where v led (if v may follow u at all);
* where u equals v the arc is removed before the new arcs are added, as the leftmost pair is merged first.

Arcs are rows of bits, one row for each token, one bit for each state; states are at most the tokens that stand
inside of words, and two.

A pre-split word is read byte by byte. A table of byte transitions (the trie of all tokens' bytes, with the transition to
the longest suffix where a byte does not go on) gives, for each prefix of the word, the tokens that end there. Each prefix
has one path, so exactly one of them has its arc at the state that the path up to its beginning leads to; that arc's target
is the prefix's state. No place is read again, and nothing is tried that has to be taken back. The token at the word's end
is one of those with the end mark. Encoding reads the arcs' numbers along the path; decoding writes the labels of ids.

Defined cases: null and empty texts have no ids and decode to the empty text; special tokens in a text are found before
it is normalised, as the tokenizer file says; very long words take time in proportion to their length; rows that repeat
or have no doc_id are rows of their own, and there are no ties, as a text has one encoding; columns of docs with the names
of the results are replaced, all others handed through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import fresh, hand_back, kept_by, ship, text_of

END = "</w>"
#: Distinct words that a worker keeps with their ids; beyond it the table of words starts anew.
WORDS_KEPT = 400_000
#: Ids of a text that are turned into labels at a time.
LABELLED = 1 << 16
SPACES = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is printable, else the next free one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Automaton:
    """The arcs of a vocabulary with merges, as bits by token and state."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.size = max(vocab.values()) + 1
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        # No more states than tokens that something may follow, and the start.
        most = 2 + sum(not t.endswith(END) for t in vocab)
        # Eight states to a row, so that a state's arcs lie together; a token's arcs are a column. They stay where they are built, as a
        # copy would take as much again of each worker's memory; pages that no state reaches are never touched.
        self.arcs = mmap.mmap(-1, (most + 7) // 8 * self.size, flags=mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS)
        arcs = np.frombuffer(self.arcs, np.uint8).reshape(-1, self.size)
        node = np.zeros(self.size, np.int32)
        made = {w for _, _, w in rules}
        base = [t for t in vocab.values() if t not in made]
        # State 0 is the start; all base symbols lead to state 1, from which all of them go on.
        arcs[0, base] = 0b11
        node[base] = 1
        shared = np.zeros(most, np.int64)
        shared[1] = len(base)
        states = 2
        for u, v, w in rules:
            old = int(node[u])
            if not int(arcs[old >> 3, v]) >> (old & 7) & 1:
                continue  # another merge has taken this pair apart: no path holds it
            node[w] = node[v]
            shared[node[v]] += 1
            if shared[old] > 1:
                shared[old] -= 1
                new, states = states, states + 1
                copied = (arcs[old >> 3] >> np.uint8(old & 7)) & np.uint8(1)
                arcs[new >> 3] |= copied << np.uint8(new & 7)
                node[u], shared[new] = new, 1
                old = new
            used = (states + 7) // 8
            if u == v:
                arcs[old >> 3, v] &= 255 ^ (1 << (old & 7))
                arcs[:used, w] = arcs[:used, u]
            else:
                arcs[:used, w] = arcs[:used, u]
                arcs[old >> 3, v] &= 255 ^ (1 << (old & 7))
        self.states = states
        self.node = node.tolist()

    def follows(self, state: int, token: int) -> int:
        return self.arcs[(state >> 3) * self.size + token] >> (state & 7) & 1


class Coder:
    """Encodes and decodes with a tokenizer file whose parts this module knows; others are refused."""

    def __init__(self, file: dict) -> None:
        model = file["model"]
        if model.get("end_of_word_suffix") != END or model.get("byte_fallback") or model.get("unk_token") or file.get("decoder"):
            raise ValueError("a tokenizer of another kind")
        vocab = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        split = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.labels = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.automaton = Automaton(vocab, merges)
        # Tokens by their bytes, inside words and at words' ends.
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        inner: dict[bytes, int] = {}
        final: dict[bytes, int] = {}
        for token, i in vocab.items():
            last = token.endswith(END)
            raw = bytes(byte_of[c] for c in (token.removesuffix(END)))
            (final if last else inner)[raw] = i
        self._byte_table(inner, final)

    def _byte_table(self, inner: dict[bytes, int], final: dict[bytes, int]) -> None:
        """Byte transitions: child by (node << 8 | byte), the node of the longest proper suffix, and the tokens that end at each
        node, longest first, as (length, token)."""
        child: dict[int, int] = {}
        own: dict[bool, dict[int, tuple[int, int]]] = {False: {}, True: {}}
        # The transition that leads to each node, as in child.
        parent = array("q", [0])
        for last, tokens in ((False, inner), (True, final)):
            for raw, token in tokens.items():
                node = 0
                for byte in raw:
                    key = node << 8 | byte
                    node = child.get(key, 0)
                    if not node:
                        node = child[key] = len(parent)
                        parent.append(key)
                own[last][node] = (len(raw), token)
        depth = array("q", bytes(8 * len(parent)))
        for node in range(1, len(parent)):
            depth[node] = depth[parent[node] >> 8] + 1
        suffix = [0] * len(parent)
        ends: list[tuple] = [()] * len(parent)
        finals: list[tuple] = [()] * len(parent)
        # Shorter nodes first, as a node's suffix is shorter than the node.
        for node in sorted(range(1, len(parent)), key=depth.__getitem__):
            up, byte = parent[node] >> 8, parent[node] & 255
            at = suffix[up]
            while up and at and (at << 8 | byte) not in child:
                at = suffix[at]
            suffix[node] = child.get(at << 8 | byte, 0) if up else 0
            ends[node] = ((own[False][node],) if node in own[False] else ()) + ends[suffix[node]]
            finals[node] = ((own[True][node],) if node in own[True] else ()) + finals[suffix[node]]
        self.child, self.suffix, self.ends, self.finals = child, suffix, ends, finals

    def path(self, word: bytes) -> list[int]:
        """The arcs of the word's one path through the automaton."""
        child, suffix, ends = self.child, self.suffix, self.ends
        arcs, size, node = self.automaton.arcs, self.automaton.size, self.automaton.node
        n = len(word)
        states, tokens, begins = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        at = place = 0
        for byte in word:
            place += 1
            while True:
                following = child.get(at << 8 | byte)
                if following is not None:
                    at = following
                    break
                if not at:
                    break
                at = suffix[at]
            for length, token in ends[at] if place < n else self.finals[at]:
                begin = place - length
                state = states[begin]
                if arcs[(state >> 3) * size + token] >> (state & 7) & 1:
                    states[place], tokens[place], begins[place] = node[token], token, begin
                    break
            else:
                raise ValueError(f"no path for {word!r}")
        out = []
        while place:
            out.append(tokens[place])
            place = begins[place]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        text = SPACES.sub(" ", text if text.isascii() else unicodedata.normalize("NFC", text))
        # Letter by letter: the tokenizer's lower case does not look at a letter's neighbours.
        text = text.lower() if text.isascii() or "Σ" not in text else "".join(c.lower() for c in text)
        return self.split.findall(text)

    def new_word(self, word: str) -> bytes:
        return np.array(self.path(word.encode()), "<u4").tobytes()

    def encode(self, text: str, seen: dict[str, bytes]) -> tuple[int, bytes, str]:
        """Number of ids, the ids as little-endian 32-bit integers, and the decoded text. seen keeps the ids of words, and not what they
        decode to, which would take as much memory again."""
        ids: list[bytes] = []
        for k, part in enumerate(self.specials.split(text) if self.specials and "<" in text else [text]):
            if k % 2:
                ids.append(self.special[part].to_bytes(4, "little"))
                continue
            for word in self.words(part):
                found = seen.get(word)
                if found is None:
                    if len(seen) >= WORDS_KEPT:
                        seen.clear()
                    found = self.new_word(word)
                    if len(word) <= 64:
                        seen[word] = found
                ids.append(found)
        packed = b"".join(ids)
        every = np.frombuffer(packed, "<u4")
        # In parts, as a long text has many ids.
        plain = " ".join(self.decode(every[at : at + LABELLED].tolist()) for at in range(0, len(every), LABELLED))
        return len(every), packed, plain

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


def load(path: str, content: str | None = None) -> Coder:
    """The coder of a tokenizer file, compiled once in each process that no other operator uses meanwhile."""
    coders = kept_by("bpe_automaton")
    if path not in coders:
        if content is None:
            with open(path, encoding="utf-8") as f:
                content = f.read()
        coders[path] = Coder(json.loads(content))
        hand_back()
    return coders[path]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: bool = True, decoded: bool = True) -> DataFrame:
    """docs' columns and n_tokens, ids_sha256, decoded_sha256; with ids also token_ids (binary, 4 bytes each), with decoded the decoded_text.

    The tokenizer file is read by the driver and sent to the executors; its size does not depend on the data.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    extra = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids binary" * ids + ", decoded_text string" * decoded
    (at,) = fresh(docs, "__text")
    kept = docs.columns
    rows = docs.withColumn(at, text_of(text))

    def work(batches):
        from weftline.llm import bpe_automaton

        coder = bpe_automaton.load(tokenizer, content.value)
        seen = coder.__dict__.setdefault("seen", {})
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, id_hash, text_hash, raw, out = [], [], [], [], []
                for t in part.column(part.num_columns - 1).to_pylist():
                    count, packed, plain = coder.encode(t, seen)
                    n.append(count)
                    id_hash.append(hashlib.sha256(packed).hexdigest())
                    text_hash.append(hashlib.sha256(plain.encode()).hexdigest())
                    if ids:
                        raw.append(packed)
                    if decoded:
                        out.append(plain)
                columns = [pa.array(n, pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array(raw, pa.binary()))
                    names.append("token_ids")
                if decoded:
                    columns.append(pa.array(out, pa.string()))
                    names.append("decoded_text")
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*kept, *names])

    clash = set(kept) & {c.split(" ")[0] for c in extra.split(", ")}
    rows = rows.drop(*clash)
    kept = [c for c in kept if c not in clash]
    schema = rows.drop(at).schema
    for field in extra.split(", "):
        schema = schema.add(*field.split(" "))
    return rows.mapInArrow(work, schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """encoded (doc_id, token_ids) with decoded_text: the labels of the arcs, joined as the tokenizer file without a decoder joins them."""
    spark = encoded.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def work(batches):
        from weftline.llm import bpe_automaton

        coder = bpe_automaton.load(tokenizer, content.value)
        for batch in batches:
            texts = [coder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "token_ids", "decoded_text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(work, "doc_id long, token_ids binary, decoded_text string")
