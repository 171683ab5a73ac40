import os
import random

import pytest

from quotemill.llm.bpe import DEFAULT_VOCABULARY, PATTERN, TokenAutomaton, automaton, byte_alphabet, count_tokens, decode_column, encode_column, split_pattern

needs_file = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")


def plain_bpe(word: bytes, rank, token):
    """Merging the best pair again and again, as BPE is defined."""
    parts = [bytes([b]) for b in word]
    while True:
        best = min(((rank[a, b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (a, b) in rank), default=None)
        if best is None:
            return tuple(token[p] for p in parts)
        a, b = parts[best[1]], parts[best[1] + 1]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


@pytest.mark.parametrize("seed", range(6))
def test_random_merges(seed):
    """Small alphabets with many overlapping merges, runs of one letter among them."""
    r = random.Random(seed)
    letters = "abc"[: 1 + seed % 3]
    vocab, merges, pieces = {c: i for i, c in enumerate(byte_alphabet())}, [], list(letters)
    while len(merges) < 25:
        u, v = r.choice(pieces), r.choice(pieces)
        if u + v not in vocab and len(u + v) < 12:
            vocab[u + v] = len(vocab)
            pieces.append(u + v)
            merges.append((u, v))
        elif len(pieces) > 300 or r.random() < 0.01:
            break
    a = TokenAutomaton(vocab, merges)
    rank = {(u.encode(), v.encode()): i for i, (u, v) in enumerate(merges)}
    token = {k.encode(): i for k, i in vocab.items() if k.isascii()}
    for _ in range(400):
        w = "".join(r.choices(letters, k=r.randint(1, 30))).encode()
        assert a.encode_word(w) == plain_bpe(w, rank, token), w


@needs_file
def test_same_as_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    a, r = automaton(), random.Random(1)
    texts = ["", " ", "\n\n  x ", "<|endoftext|> is text", "naïve café 매출 증가 🚀📈 👩‍💻 \x00", "don't  we'll\tthey've", "a" * 3000, "=" * 777, "1234567890 " * 50]
    texts += ["".join(chr(r.choice([r.randint(32, 126), r.randint(160, 0x2FFF), r.randint(0x1F300, 0x1F6FF), 97, 32])) for _ in range(r.randint(1, 80))) for _ in range(1500)]
    for x in texts:
        ids = a.encode(x)
        assert ids == t.encode(x, add_special_tokens=False).ids and a.decode(ids) == x


@needs_file
def test_columns(spark):
    long = "long words " * 30_000
    rows = [(1, "Hello world", "c"), (2, "", "c"), (3, None, "c"), (None, "x", "c"), (1, "Hello world", "c"), (5, long, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_column(df.select("doc_id", "text", "ids"))
    got = {(r.doc_id, len(r.ids)) for r in out.collect()}
    assert (2, 0) in got and (3, 0) in got and len(out.collect()) == 6
    back = {r.doc_id: r.text for r in decode_column(out).collect()}
    assert back[1] == "Hello world" and back[3] == "" and back[5] == long
    assert {r.doc_id: r.n_tokens for r in count_tokens(df).collect()}[3] == 0
    assert encode_column(df.limit(0)).count() == 0


@needs_file
def test_other_kinds_of_files_raise():
    """A vocabulary that splits, normalises or ends words in another way is refused, not encoded wrongly."""
    file = {"model": {"type": "BPE", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "added_tokens": [{"content": "<end>", "special": True}]}
    assert split_pattern(file) == PATTERN
    own = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"\\S+|\\s+"}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]}
    assert split_pattern(file | {"pre_tokenizer": own}) == r"\\S+|\\s+"
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "x", "special": False}]}, {"model": file["model"] | {"end_of_word_suffix": "</w>"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}):
        with pytest.raises(ValueError):
            split_pattern(file | change)
    with pytest.raises(ValueError):
        automaton(os.path.join(os.path.dirname(DEFAULT_VOCABULARY), "word_bpe_49k.json"))
