"""Encoding with a byte-level BPE vocabulary as a deterministic automaton over tokens."""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.session import ship

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: how the public byte-level vocabularies split a text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary files: itself if it is printable, else the next one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class TokenAutomaton:
    """The automaton that accepts exactly the token sequences BPE produces.

    It starts as one state that loops on every byte token. Each merge (u, v) -> w, in order
    of priority, adds a gadget: u now leads to a copy of its state that lacks the arc v,
    and wherever u could be followed by v there is an arc w to where v led. So the state
    is a function of the last token, and an arc b leaves the state of token a unless some
    gadget took it away: the gadget of (x, y), where x was what a ended in and y what b
    began with at that time. Instead of 50,000 x 50,000 arcs, the merges are kept with
    their times, and a row of the transition table is filled as its arcs are asked for.

    Every prefix of a word ends in exactly one state, so encoding runs over the bytes once,
    following the arcs of the vocabulary's tokens from each position; the path is read
    backwards. Decoding emits the bytes of the arcs' labels.
    """

    def __init__(self, vocabulary: dict[str, int], merges: Sequence[tuple[str, str]], pattern: str = PATTERN):
        alphabet = byte_alphabet()
        self.labels: dict[int, bytes] = {}
        for piece, i in vocabulary.items():
            if all(c in alphabet for c in piece):
                self.labels[i] = bytes(alphabet[c] for c in piece)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        self.ends_in: dict[int, list[tuple[int, int]]] = {}
        self.begins_with: dict[int, list[tuple[int, int]]] = {}
        self.arcs: dict[int, dict[int, bool]] = {}
        made = {i for i, b in self.labels.items() if len(b) == 1}
        for time, (u, v) in enumerate(merges):
            a, b, w = vocabulary[u], vocabulary[v], vocabulary[u + v]
            # Where earlier gadgets leave v no arc after u, this one finds nothing to merge.
            if w not in made and a in made and b in made and self.arc(a, b):
                made.add(w)
                self.left[w], self.right[w], self.born[w] = a, b, time
            self.gadget[a, b] = time
        self.arcs.clear()
        # The tokens as a trie over bytes; only those that merges can make have an arc.
        self.root: dict = {}
        for i in made:
            node = self.root
            for x in self.labels[i]:
                node = node.setdefault(x, {})
            node[-1] = i
        self.split = regex.compile(pattern).findall
        self.words = _Words(self)

    def _spine(self, token: int, child: dict[int, int]) -> list[tuple[int, int]]:
        """The parts of token at one of its ends, each with the time at which it was merged away."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in child:
                return out
            until, token = self.born[token], child[token]

    def arc(self, a: int, b: int) -> bool:
        """Whether b may follow a."""
        row = self.arcs.get(a)
        if row is None:
            row = self.arcs[a] = {}
        ok = row.get(b)
        if ok is None:
            ends = self.ends_in.get(a)
            if ends is None:
                ends = self.ends_in[a] = self._spine(a, self.right)
            begins = self.begins_with.get(b)
            if begins is None:
                begins = self.begins_with[b] = self._spine(b, self.left)
            gadget = self.gadget
            ok = True
            for x, x_until in ends:
                for y, y_until in begins:
                    time = gadget.get((x, y))
                    # Of equal merges the one further left comes first.
                    if time is not None and time < x_until and time <= y_until:
                        ok = False
                        break
                if not ok:
                    break
            row[b] = ok
        return ok

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        n = len(word)
        last: list[int | None] = [None] * (n + 1)
        root, arc = self.root, self.arc
        for i in range(n):
            state = last[i]
            if i and state is None:
                continue
            node, j = root, i
            while j < n:
                node = node.get(word[j])
                if node is None:
                    break
                j += 1
                token = node.get(-1)
                if token is not None and last[j] is None and (i == 0 or arc(state, token)):
                    last[j] = token
        path, j = [], n
        while j:
            token = last[j]
            path.append(token)
            j -= len(self.labels[token])
        return tuple(reversed(path))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", errors="replace")


class _Words(dict):
    """Ids of words met before; cleared when it grows large, so that memory is bounded."""

    LIMIT = 400_000
    LONGEST = 64

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode_word(word.encode("utf-8"))
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
                self.automaton.arcs.clear()
            self[word] = ids
        return ids


def split_pattern(file: dict) -> str:
    """How the vocabulary of a file splits a text into words; raises for what the automaton doesn't stand for."""
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    wrong = [k for k in ("normalizer", "post_processor") if file.get(k)]
    wrong += [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    steps = pre.get("pretokenizers", [pre])
    levels = [s for s in steps if s.get("type") == "ByteLevel"]
    splits = [s for s in steps if s.get("type") == "Split"]
    if model.get("type", "BPE") != "BPE" or len(levels) != 1 or len(levels) + len(splits) != len(steps) or levels[0].get("add_prefix_space"):
        wrong.append("pre_tokenizer")
    pattern = PATTERN
    if splits:
        # A split by a pattern of its own comes before the bytes.
        own = splits[0].get("pattern", {}).get("Regex")
        if len(splits) > 1 or own is None or levels[0].get("use_regex", True) or splits[0].get("behavior") != "Isolated" or splits[0].get("invert"):
            wrong.append("pre_tokenizer")
        pattern = own or PATTERN
    elif levels and not levels[0].get("use_regex", True):
        wrong.append("pre_tokenizer")
    # Added tokens that aren't special would be found in the middle of texts.
    if any(not t.get("special") for t in file.get("added_tokens") or []):
        wrong.append("added_tokens")
    if wrong:
        raise ValueError("not a byte-level BPE vocabulary as supported here: " + ", ".join(dict.fromkeys(wrong)))
    return pattern


@functools.lru_cache(maxsize=4)
def automaton(path: str = DEFAULT_VOCABULARY) -> TokenAutomaton:
    """The automaton of a vocabulary file (JSON with vocab and merges), split as the file says; built once in each process. A file of another kind raises."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return TokenAutomaton(model["vocab"], merges, split_pattern(file))


def encode_column(df: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key, ids (array<int>): the token ids of each text, without special tokens; an empty list for empty and null texts.

    Strings that spell a special token are ordinary text. No shuffle: each partition is
    split into words and encoded where it is read, whole texts whatever their length.
    Repeated rows are encoded each; a null key stays null. An empty table gives no rows.
    """
    ship(df.sparkSession)

    def run(batches):
        auto = automaton(vocabulary)
        for b in batches:
            texts = b.column("__text").to_pylist()
            words, split = auto.words.__getitem__, auto.split
            ids = [np.fromiter(chain.from_iterable(map(words, split(t))), dtype=np.int32) if t else np.empty(0, np.int32) for t in texts]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("__key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["__key", "ids"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"__key {kind}, ids array<int>")
    return out.withColumnRenamed("__key", key)


def count_tokens(df: DataFrame, *, text: str = "text", out: str = "n_tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """df without the text, with the number of tokens of it instead (0 for null)."""
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != text]

    def run(batches):
        auto = automaton(vocabulary)
        for b in batches:
            words, split = auto.words.__getitem__, auto.split
            n = [sum(map(len, map(words, split(t)))) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(n, type=pa.int64())], names=[*rest, out])

    kinds = dict(df.dtypes)
    return df.select(*rest, text).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in rest] + [f"{out} long"]))


def decode_column(df: DataFrame, *, ids: str = "ids", out: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """df with the text that the ids stand for."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def decode(col):
        auto = automaton(vocabulary)
        return col.map(lambda x: None if x is None else auto.decode(x))

    return df.withColumn(out, decode(F.col(ids)))
